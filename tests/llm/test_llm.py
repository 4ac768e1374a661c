"""Operators against brute force, on small tables with nulls, repeats, ties and clashing columns."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrank.llm import QUERIES, SQL
from loomrank.llm import distinctive, fusion, markup, mixing, packing, repetition, topn, tries
from tests.compare import compare, duck

SCHEMA = "word_val bigint, page_id bigint, freq int, tier string, score double, place int, load string"


def _postings(spark, seed=1):
    r = random.Random(seed)
    once = {}
    for _ in range(4000):
        w = r.choice([1, 2, 27, 28, 729, -5, 27**13 + 4, 0] + list(range(1000, 1400)))
        once.setdefault((w, r.randrange(200)), (r.choice([None, 0, -2, *range(1, 40)]), r.choice(["title", "category", "high", "low"])))
    rows = [(w, p, f, t, 0.5, 1, None) for (w, p), (f, t) in once.items()]
    rows += rows[:500] + [(None, 1, 1, "low", None, None, None), (5, None, 1, "high", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), once


@pytest.fixture(scope="module")
def made(spark):
    df, once = _postings(spark)
    return df.persist(), once


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert compare(spark, duck(data), name, QUERIES[name], SQL[name], data) is None


def test_tries(made, monkeypatch):
    df, once = made
    want = {w: (sum(f or 0 for (x, _), (f, _) in once.items() if x == w), sum(x == w for x, _ in once)) for w in {w for w, _ in once}}
    for routes in (1, 50):
        assert {r["word_val"]: (r["occurrences"], r["pages"]) for r in tries.count_terms(df, routes).collect()} == want
    assert tries.marked_terms(df.limit(0)).collect() == []
    bounds = tries.directory(df.where("word_val is not null"), "word_val", 50)
    assert bounds[0] == 0 and (np.diff(bounds) > 0).all() and len(bounds) > 20
    # by a count of every prefix: those with more than 1 / 50 of the rows are split, and no others
    at = tries.places(np.array([r["word_val"] for r in df.where("word_val is not null").select("word_val").collect()]))
    want = {0}
    for depth in range(tries.DIGITS):
        width = tries.BASE ** (tries.DIGITS - depth)
        for a, n in Counter((at // width).tolist()).items():
            if n > len(at) // 50:
                want |= {a * width + c * (width // tries.BASE) for c in range(tries.BASE)}
    assert set(bounds.tolist()) == want


def test_trie_bursts_and_keeps_all():
    values = np.random.default_rng(1).integers(1, 27**6, 30000)
    trie = tries.BurstTrie(0, 64)
    for part in np.split(values, 10):
        trie.add(tries.merged(tries.places(part), part, np.ones((len(part), 2), dtype=np.int64)))
    leaves = list(trie.leaves())
    got = {int(v): int(c) for x in leaves for v, c in zip(x.value, x.count[:, 0])}
    assert got == Counter(values.tolist()) and max(len(x.value) for x in leaves) <= 64 and trie.children
    assert (np.diff(np.concatenate([x.place for x in leaves])) >= 0).all()


def _em(tf, background, own=distinctive.OWN, rounds=20_000):
    tf, background = np.array(tf, dtype=float), np.array(background)
    p = tf / (tf.sum() or 1)
    for _ in range(rounds):
        below = own * p + (1 - own) * background
        e = tf * np.divide(own * p, below, out=np.zeros_like(p), where=below > 0)
        p = e / (e.sum() or 1)
    return p.tolist()


@pytest.mark.parametrize("giants", [False, True])
def test_distinctive(spark, made, giants):
    df, once = made
    giant = spark.createDataFrame([(3, 9), (4, 9)], "page_id bigint, estimate bigint") if giants else None
    got = {(r["page_id"], r["word_val"]): r["score"] for r in distinctive.distinctive_words(df, giant=giant).collect()}
    occurrences = Counter()
    for (w, _), (f, _) in once.items():
        occurrences[w] += f or 0
    total, pages = sum(occurrences.values()), defaultdict(list)
    for (w, p), (f, t) in once.items():
        if t in ("title", "category"):
            pages[p].append((w, max(f or 0, 0)))
    assert len(got) == sum(map(len, pages.values()))
    for p in (3, 4, 5, 77):
        want = _em([f for _, f in pages[p]], [max(occurrences[w], 0) / total for w, _ in pages[p]])
        assert [got[p, w] for w, _ in pages[p]] == pytest.approx(want, abs=1e-5)
    assert distinctive.distinctive_words(df.limit(0)).collect() == []


def test_every_page_converges_by_itself():
    r = np.random.default_rng(1)
    sizes = [3, 40, 1, 7, 120, 2, 4]
    tf, background = r.integers(0, 12, sum(sizes)).astype(float), r.random(sum(sizes)) / 400
    tf[-4:] = 0  # a page without occurrences
    background[5] = 0
    start = np.cumsum(sizes) - sizes
    p = distinctive.maximise(start, tf, background)
    for a, n in zip(start, sizes):
        own, t, b = p[a : a + n], tf[a : a + n], background[a : a + n]
        assert np.abs(distinctive.maximise(np.array([0]), t, b) - own).max() < 1e-12
        assert np.abs(_em(t, b) - own).max() < 1e-5
        e = t * own / np.where(own + b > 0, own + b, 1)
        assert np.abs(e / (e.sum() or 1) - own).max() < 1e-12  # another round changes nothing
    assert distinctive.maximise(np.zeros(0, dtype=int), np.zeros(0), np.zeros(0)).tolist() == []


def test_top_n(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.choice([0.5, 1.0, r.random(), None, math.nan]), 0) for i in range(3000)] + [(None, 1, 1.0, 0), (9, 5, 2.0, 0), (9, 5, 2.0, 0)]
    df = spark.createDataFrame(rows, "word_val bigint, page_id bigint, score double, place int").repartition(7)
    got = defaultdict(list)
    for x in topn.top_n(df, "word_val", "page_id", "score", 5).orderBy("word_val", "place").collect():
        got[x["word_val"]].append((x["score"], x["page_id"]))
    for g in (1, 2, 3, 9):
        assert got[g] == sorted(((s, i) for w, i, s, _ in rows if w == g and s is not None and s == s), reverse=True)[:5]
    assert topn.top_n(df.limit(0), "word_val", "page_id", "score").count() == 0


def test_top_n_of_partitions_that_give_out_early():
    r = np.random.default_rng(4)
    group, item, score = r.integers(0, 3000, 40_000), np.arange(40_000), r.integers(0, 50, 40_000) / 10
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 500]) for x in (group, item, score)], names=["g", "i", "s"]) for i in range(0, 40_000, 500)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topn, "BLOCK", 1000)
        m.setattr(topn, "HELD", 3000)
        got = pa.Table.from_batches(topn._local_best(2)(iter(batches))).to_pylist()
    best = {g: sorted(zip(score[group == g], item[group == g]), reverse=True)[:2] for g in range(3000)}
    assert len(got) > 6000
    kept, bounds = defaultdict(set), {}
    for x in got:
        kept[x["g"]].add((x["s"], x["i"]))
        if x["bound_s"] is not None:
            bounds[x["g"]] = max(bounds.get(x["g"], (-1, -1)), (x["bound_s"], x["bound_i"]))
    for g, want in best.items():
        assert set(want) <= kept[g] and (len(want) < 2 or bounds.get(g, (-1, -1)) <= want[1])


@pytest.mark.parametrize("spread", [False, True])
def test_median_rank(spark, spread):
    r = random.Random(3)
    rows = [(g, i, r.choice([0.0, 5.0, None, math.nan, r.random()]), float(r.randrange(3)), r.random() * 1e6, 7) for g in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "q bigint, i bigint, a double, b double, c double, estimate int").repartition(5)
    large = spark.createDataFrame([(1, 60), (3, 60)], "q bigint, estimate bigint") if spread else None
    got = {(x["q"], x["i"]): x for x in fusion.median_rank(df, "q", "i", {"a": 1.0, "b": 1.0, "c": 1.0}, large).collect()}
    clean = lambda x: 0.0 if x is None or x != x else x
    for g in (1, 2, 3):
        own = [(x[1], [clean(v) for v in x[2:5]]) for x in rows if x[0] == g]
        ranks = {i: [1 + sum(w[k] > v[k] for _, w in own) for k in range(3)] for i, v in own}
        order = sorted(ranks, key=lambda i: (sorted(ranks[i])[1], sum(ranks[i]) / 3, i))
        for n, i in enumerate(order):
            x = got[g, i]
            assert [x["rank_a"], x["rank_b"], x["rank_c"]] == ranks[i] and x["place"] == n + 1 and x["items"] == 60 and x["estimate"] == 7
    assert fusion.median_rank(df.limit(0), "q", "i", {"a": 1.0}).count() == 0


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 5.0, 9.0)], "a double, b double, c double")
    row = df.select(fusion.median_of(["a", "b", "c"], [1, 1, 1]), fusion.median_of(["a", "b", "c"], [5, 1, 1]), fusion.median_of(["a", "b", "c"], [1, 1, 5])).first()
    assert tuple(row) == (5.0, 1.0, 9.0)


KINDS = [
    ("A <b>x</b>", "html"), ("<span style='a'\n class='b'>x</span>", "html"), ("a &amp; b", "html"), ("&#x2013;", "html"), ("<!-- x -->", "html"), ("a<ref name=x>b</ref>", "html"),
    ("## Head", "markdown"), ("Head\n====", "markdown"), ("*x* y", "markdown"), ("a **b** c", "markdown"), ("_x y_", "markdown"), ("~~x~~", "markdown"), ("[a](/b)", "markdown"),
    ("![a](b.png)", "markdown"), ("Type `[[x]] <b>` now", "markdown"), ("```html\n<b>x</b> {{y}}\n```", "markdown"), ("~~~\nx\n~~~", "markdown"), ("| a | b |\n|---|---|\n| c | d |", "markdown"),
    ("- [x] a", "markdown"), ("See [a][1].\n\n[1]: /x", "markdown"), ("[[a|b]]", "wiki"), ("{{a|b=c}}", "wiki"), ("== A ==", "wiki"), ("{| class=x\n|-\n| a\n|}", "wiki"), ("''a''", "wiki"),
    ("'''a''' b", "wiki"), ("[//a.b/c d]", "wiki"), ("\\emph{x}", "latex"), ("\\begin{verbatim}\n<b>x</b> [[y]]\n\\end{verbatim}", "latex"), ("$x^2$", "latex"), ("$$x$$", "latex"), ("\\[ u \\]", "latex"),
    ("x.\\footnote{y}", "latex"), ("Let \\alpha be", "latex"), ("<math>\\sqrt{2}</math>", "html latex"),
]
PLAIN = ["", None, "It costs $5 or $10 per x.", "If x < y and y > 3 it holds.", "<12 paces, >2 gates.", "3 * 4 * 5", "One ` tick | one bar ~ 3. One ` tick", "rank_of_x and page_id_y", "a == 1", "a = b; c[1] stays.",
         "The C# scale [sic]", "xaa\\15\\4 holds", "The keepers' 'mark' is 2^8", "Salt & reed -- moss", "5 % < 7 % [x]", "#12 (see {x})", "* a\n** b\n* c", "C* x", "100% x", "List_of_x", "A's b"]


@pytest.mark.parametrize("text,kinds", KINDS + [(t, "") for t in PLAIN])
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds.split()


@pytest.mark.parametrize("text,want", [
    (None, None), ("", ""), ("a  b", "a b"), ("== H ==\ntext", "## H\ntext"), ("<h3 id=x>\nH\n</h3>t", "### H\nt"), ("H\n===\nx", "# H\nx"), ("\\section{H} x", "# H\n x"),
    ("* [[A|b]]\n** c", "- b\n  - c"), ("<ul><li>a</li><li>b c</li></ul>", "- a\n- b c"), ("<pre><code>a = b\nc</code></pre>", "```\na = b\nc\n```"), ("```py\nx < y\n```", "```py\nx < y\n```"),
    ("<math>\\sqrt{2}</math> $n^2$", "$\\sqrt{2}$ $n^2$"), ("\\begin{equation}\nx\n\\end{equation}", "$$\nx\n$$"), ("[[File:x.png|thumb|A [[b]]]] c", "A b c"), ("{{x}}a{{y|{{z}}}}", "a"),
    ("{| class=g\n! a !! b\n|-\n| c || d\n|}", "a | b\nc | d"), ("a &amp;lt;i&amp;gt;", "a &lt;i&gt;"), ("**a** __b__ ~~c~~", "a b c"), ("costs $5 or $6, 3 * 4", "costs $5 or $6, 3 * 4"),
])
def test_clean(text, want):
    assert markup.clean(text) == want


def test_clean_takes_very_long_and_broken_texts():
    for text in ("<div>" * 20000, "{{" * 20000, "[[a" * 20000, "`" * 50000, "$a" * 20000, "*a" * 20000, "x " * 300000, "\\begin{verbatim}" * 2000):
        assert markup.clean(text) is not None and markup.subtrees(text) == []


@pytest.mark.parametrize("text,want", [
    ("{{a|" * 200 + "x" + "}}" * 200 + " end", "end"), ("\\emph{" * 30 + "x" + "}" * 30 + " end", "x end"),
    ("\\foo{$$\\begin{align}\n`x y`\n\\end{align}$$} end", "$\\foo{$$$$\n`x y`\n$$$$}$ end"),
])
def test_clean_at_any_depth(text, want):
    assert markup.clean(text) == want


@pytest.mark.parametrize("unclosed", ["<p>", "<span>", "{{", "<ul><p>"])
def test_subtree_with_many_unclosed_elements(unclosed):
    block = f"<div>{unclosed * 200} Home pages and contents</div>"
    text = f"a {block} <p>the words after that</p> {block}"
    found = markup.subtrees(text)
    assert [text[a:b] for a, b, _ in found] == [block, "<p>the words after that</p>", block] and found[0][2] == found[2][2]


@pytest.mark.parametrize("large", [False, True])
def test_furniture_is_removed(spark, large, monkeypatch):
    if large:  # as where furniture is too much for a broadcast
        monkeypatch.setattr("loomrank.operators.skew.LEAST_ROWS", 1)
        monkeypatch.setattr("loomrank.operators.skew.BROADCAST_ROWS", 0)
    menu = '<div class="menu"><p>Home pages and contents</p></div>'
    rows = [(i, f"T{i}", f"{menu} Text {i} <div>Only {i} has this one text</div>", "xa", None, "h") for i in range(30)] + [(100 + i, "T", f"{menu} Text", "xb", None, "h") for i in range(3)]
    rows += [rows[0], (None, "t", "t", "xa", None, "h"), (200, None, None, None, None, None), (201, "", "", "xa", None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, title string, text string, file_name string, loaded_at timestamp, host string").repartition(4)
    got = {r["page_id"]: r for r in markup.clean_pages(df).collect()}
    assert len(got) == 35
    assert all("Home" not in got[i]["text"] and "has this one" in got[i]["text"] and got[i]["removed"] == 2 and got[i]["text_kinds"] == ["html"] for i in range(30))
    assert "Home" in got[100]["text"] and got[200]["text"] is None and got[201]["text"] == "" and got[200]["title_kinds"] == []
    assert markup.clean_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [64, 512])
def test_packing(spark, capacity):
    r = random.Random(4)
    sizes = [r.choice([r.randrange(1, 40), r.randrange(40, 500), r.randrange(500, 2000)]) for _ in range(3000)]
    rows = list(enumerate(sizes)) + [(5000, None), (5001, 0), (5002, capacity), (5003, 2 * capacity), (5003, 2 * capacity)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("slot", F.lit("x")).repartition(4)
    got = packing.pack(df, capacity).collect()
    used, pieces = Counter(), defaultdict(list)
    for x in got:
        used[x["slot"]] += x["tokens"]
        pieces[x["doc_id"]].append((x["piece"], x["tokens"], x["pieces"], x["slot"]))
    assert used.pop(None) == 0 and max(used.values()) <= capacity
    for d, n in rows:
        own = pieces[d]
        assert sum(t for _, t, _, _ in own) == (n or 0) * (2 if d == 5003 else 1)
        if (n or 0) <= capacity:
            assert len(own) == 1 and own[0][2] == 1
        elif d != 5003:
            assert sorted(p for p, *_ in own) == list(range(-(-n // capacity))) and all(c == len(own) for _, _, c, _ in own)
    assert len(used) <= 1.04 * sum(used.values()) / capacity + 2
    assert packing.pack(df.limit(0), capacity).count() == 0


def test_configurations_meet_the_demand():
    sizes, demand = np.array([300, 200, 150, 90]), np.array([100, 150, 77, 301])
    plan = packing.configurations(sizes, demand, 512)
    assert (sum(f * n for f, n in plan) == demand).all() and all(f @ sizes <= 512 for f, _ in plan)
    assert sum(n for _, n in plan) <= math.ceil(sizes @ demand / 512 * 1.05) + 4


def test_too_few_columns_are_logged(caplog):
    sizes, demand = np.array([300, 200, 150, 90]), np.array([100, 150, 77, 301])
    plan = packing.configurations(sizes, demand, 512, rounds=0)
    assert (sum(f * n for f, n in plan) == demand).all() and "did not reach the optimum" in caplog.text


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["A", " a", "b", "B\t", "c", "zz", None]), r.choice([None, *range(1, 50)]), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int, copies string").repartition(4)
    weights = spark.createDataFrame([("a", 0.2, 1), ("b", 0.2, 2), ("c", 0.5, 2), ("d", 0.1, 4)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, weights)
    got, told = chosen.collect(), {x["source"]: x for x in report.collect()}
    tokens = Counter()
    for x in got:
        tokens[x["source"]] += x["tokens"] * x["copies"]
        assert 1 <= x["copies"] <= {"a": 1, "b": 2, "c": 2}[x["source"]]
    assert {s: told[s]["chosen_tokens"] for s in "abc"} == dict(tokens) and told["d"]["short"] and told["d"]["chosen_tokens"] == 0
    have = Counter()
    for _, s, n, _ in rows:
        if s and s.strip().lower() in "abc":
            have[s.strip().lower()] += n or 0
    total = sum(have.values())
    for s, share, most in (("a", 0.2, 1), ("b", 0.2, 2), ("c", 0.5, 2)):
        assert told[s]["tokens"] == have[s] and told[s]["short"] == (most * have[s] < share * total)
        if not told[s]["short"]:
            assert abs(tokens[s] - share * total) <= 50
    larger = {x["doc_id"] for x in mixing.mix(df, weights, 0.5 * total)[0].where("source = 'a'").collect()}
    assert {x["doc_id"] for x in mixing.mix(df, weights, 0.2 * total)[0].where("source = 'a'").collect()} <= larger
    assert mixing.mix(df.limit(0), weights)[0].count() == 0 and mixing.mix(df.limit(0), weights)[1].count() == 4


def _brute(text, run=5):
    words = repetition.WORD.findall(text.lower())
    runs = defaultdict(list)
    for i in range(len(words) - run + 1):
        runs[tuple(words[i : i + run])].append(i)
    return len(words), len({i + k for at in runs.values() if len(at) > 1 for i in at for k in range(run)})


def test_repeated_words():
    r = random.Random(6)
    for n in (0, 3, 5, 6, 11, 80, 700):
        for words in (2, 6, 40, 9000):
            text = " ".join(f"W{r.randrange(words)}É" for _ in range(n))
            assert repetition.repeated_words(text) == _brute(text)
    assert repetition.repeated_words("a b c d e " * 2) == (10, 10)


def test_repetition(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(2, 9))) for _ in range(n))
    texts = [None, "", "   ", "buy this now please today " * 40, prose(300), prose(60) + " " + "the same words come again and " * 12, prose(20000), prose(3000) + " same old text again here" * 900]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, band string")
    rows = repetition.repetition(df).collect()
    assert len(rows) == 2 * len(texts)
    for x in rows:
        t = texts[x["doc_id"]]
        if t is None:
            assert x["band"] is None and x["ratio"] is None
        elif (b := _brute(t))[0] and b[1] >= 0.3 * b[0]:
            assert (x["words"], x["repeated_words"]) == b and x["band"] in ("suspicious", "repetitive")
    assert repetition.repetition(df.limit(0)).count() == 0
    assert {x["doc_id"] for x in repetition.repetition(df, "all").where("words is null").collect()} == {0}


def test_list_like_repetition_is_found(spark, tmp_path):
    r = random.Random(8)
    texts = []
    for n in (60, 250, 400, 900):
        items = [f"{''.join(r.choice('abcdefghijklmnoprstuvw') for _ in range(6))} {r.randrange(1000, 10000)}" for _ in range(n)]
        twice = items[: n // 5]
        rest = items[n // 5 :]
        for k in range(0, len(twice) - 2, 3):  # six words, standing twice
            rest.insert(r.randrange(len(rest)), " ".join(twice[k : k + 3]))
        texts.append(" ".join(twice + rest))
    shares = [b / a for a, b in map(_brute, texts)]
    assert min(shares) >= 0.3
    packer = repetition.compressor()
    assert "ordinary" in {repetition.bands(t, packer)[2] for t in texts}
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(x["doc_id"] for x in repetition.p9_found(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    assert all((x["words"], x["repeated_words"]) == _brute(texts[x["doc_id"]]) for x in repetition.repetition(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
