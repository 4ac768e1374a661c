import functools
import itertools

import pytest
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.functions import text
from loomrank.operators import index, links, search, skew
from loomrank.operators.pagerank import most_rounds, pagerank, step
from loomrank.sources import dump

PAGES = [
    ("Alpha Beta", "Alpha links [[Gamma]] and [[Delta|the delta]] and [[gamma]] [[File:pic.png|thumb]] [[Missing]] [[Category:Greek letters|Alpha]] [[Gamma Ray]]"),
    ("Gamma", "See [[Alpha Beta]]."),
    ("Delta", "omega " * 8 + "sigma " * 7),
    ("Gamma Ray", "[[Gamma]] and [[Gamma Ray]]"),
]
CFG = EngineConfig(stop_words=(*DEFAULT.stop_words, "see", "miss"))
EXACT = EngineConfig(stop_words=CFG.stop_words, stop_residual=1e-24)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    record = "<page><title>{}</title><id>1</id><text xml:space=\"preserve\">{}</text></page>\n"
    (folder / "xaa").write_text("<mediawiki>\n" + "".join(record.format(*p) for p in PAGES) + "</mediawiki>\n")
    (folder / "yaa").write_text("not read")
    return dump.numbered(dump.read_dump(spark, str(folder))).persist()


@pytest.fixture(scope="module")
def engine(spark, corpus):
    return search.Engine(spark, EXACT).build(corpus)


def test_pages(corpus):
    assert [(r["page_id"], r["title"]) for r in corpus.orderBy("page_id").collect()] == [(i + 1, t) for i, (t, _) in enumerate(PAGES)]


def test_links(corpus):
    found = links.extract_links(corpus)
    assert sorted(map(tuple, links.distinct_edges(links.resolve_links(found, corpus)).collect())) == [(1, 2), (1, 3), (2, 1), (4, 2), (4, 4)]
    assert [r["target"] for r in links.unresolved_links(found, corpus).collect()] == ["Missing"]
    stats = links.corpus_stats(corpus).first()
    assert (stats["pages"], stats["titles"], stats["links"], stats["found"]) == (4, 4, 6, 5)
    by_number = EngineConfig(match_by_number=True)
    assert links.distinct_edges(links.resolve_links(found, corpus, by_number)).count() == 5


def test_pagerank(engine, corpus):
    want = {1: 0.11639581383476559, 2: 0.10164213392325364, 3: 0.07946822087977537, 4: 0.05217391304347826}
    got = {r["page_id"]: r["pr"] for r in engine.ranks.collect()}
    assert got == pytest.approx(want, abs=1e-7)
    loose = {r["page_id"]: r["pr"] for r in pagerank(engine.edges, corpus).collect()}
    assert loose == pytest.approx(want, abs=1e-5)


def test_postings(engine):
    got = {(r["stem"], r["page_id"]): (r["freq"], r["tier"]) for r in engine.postings.collect()}
    want = {
        ("alpha", 1): (2, "title"), ("alpha", 2): (1, "low"), ("beta", 1): (1, "title"), ("beta", 2): (1, "low"), ("gamma", 1): (2, "low"),
        ("gamma", 2): (1, "title"), ("gamma", 4): (3, "title"), ("delta", 1): (2, "low"), ("delta", 3): (1, "title"), ("rai", 4): (2, "title"),
        ("greek", 1): (1, "category"), ("letter", 1): (1, "category"), ("omega", 3): (8, "high"), ("sigma", 3): (7, "low"),
    }
    want |= {(w, 1): (1, "low") for w in ("link", "file", "pic", "png", "thumb")}
    want |= {(w, p): (1, "low") for w in ("xml", "space", "preserv") for p in (1, 2, 3, 4)}
    assert got == want


@pytest.mark.parametrize("query,want", [
    ("gamma", [("gamma ray", 15.652174), ("gamma", 10.164213)]), ("gamma ray", [("gamma ray", 36.521739)]), ("Gamma, ray", [("gamma ray", 36.521739)]),
    ("gamma gamma", [("gamma ray", 31.304348), ("gamma", 20.328427)]), ("alpha", [("alpha beta", 23.279163)]), ("alpha beta", [("alpha beta", 34.918744)]),
    ("letters", [("alpha beta", 3.491874)]), ("omega", [("delta", 0.635746)]), ("sigma", []), ("the", []), ("", []), (None, []), ("c:gamma", [("gamma ray", 15.652174), ("gamma", 10.164213)]),
    ("gamma-ray", []), ("gammz", []),
])
def test_search(engine, query, want):
    got = [(r["title"], r["score"]) for r in engine.search(query).collect()]
    assert [t for t, _ in got] == [t for t, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_search_flags(engine):
    ask = engine.spark.createDataFrame([(1, "t:greek"), (2, "c:greek"), (3, "t:gamma")], "query_id bigint, query_text string")
    run = lambda cfg, q: [(r["query_id"], r["title"]) for r in search.search_batch(q, engine.postings, engine.ranks, engine.titles, cfg).collect()]
    assert sorted(run(EngineConfig(enforce_fields=True), ask)) == [(2, "alpha beta"), (3, "gamma"), (3, "gamma ray")]
    ask = engine.spark.createDataFrame([(1, "gammz"), (2, "gamma"), (3, "zzzzzzzzz")], "query_id bigint, query_text string")
    assert sorted(run(EngineConfig(lower_bound=True), ask)) == [(1, "alpha beta"), (2, "gamma"), (2, "gamma ray")]
    ask = engine.spark.createDataFrame([(1, "sigma")], "query_id bigint, query_text string")
    assert run(EngineConfig(include_low=True), ask) == [(1, "delta")]


def test_search_plan_stays_in_the_jvm(engine):
    df = search.conjunctive(search.parse_query(engine.spark.createDataFrame([(1, "gamma ray")], "query_id bigint, query_text string")), engine.postings)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_categories(spark):
    df = spark.createDataFrame([(1, "t", 'a [[Category:One two|x]] category [[categories:three four]] five [[Category:six]]'), (2, "t", "no [[:Category:link]] here"), (3, None, None)], "page_id int, title string, text string")
    got = sorted((r["page_id"], r["field"], r["word"]) for r in index.tokens(df).collect())
    assert got == [(1, "body", "a"), (1, "category", "one"), (1, "category", "three"), (1, "category", "two"), (1, "title", "t"),
                   (2, "body", "here"), (2, "body", "link"), (2, "body", "no"), (2, "title", "t")]


STEMS = """caresses caress ponies poni ties ti cats cat caress caress feed feed agreed agre matting mat mating mate meetings meet running run controlling control
happy happi sky sky category categori categories categori hopeful hope goodness good electrical electric formalize formal triplicate triplic formative form
relational relational adjustment adjustment preserve preserv space space file file cease ceas having have was wa yes ye goes goe ies i be be as as missing miss""".split()


def test_stems(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2])), "word string, want string")
    assert df.withColumn("got", text.stem(F.col("word"))).where("got <> want").collect() == []
    shapes = spark.createDataFrame([("syzygy",), ("yellow",), ("tree",), ("",)], "w string").select(text.shape(F.col("w"))).collect()
    assert [r[0] for r in shapes] == ["CVCVCV", "CVCCVC", "CCVV", ""]


def test_numbers(spark):
    words = {"categori": 32058264654, "aikxt": 717275, "gamma": 3749599, "ray": 13174, "internationalization": 6864395910329938750}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.word_number(F.col("w")).alias("n"))
    assert {r["w"]: int(r["n"]) for r in df.collect()} == words
    back = df.where("length(w) <= 13").select("w", text.word_of_number(F.col("n")).alias("b")).collect()
    assert all(r["w"] == r["b"] for r in back)
    titles = {"Gamma": 14670091, "Gamma Ray": 30589136649335, "Gamma_Ray": 30589136155487, "Apollo 9": 163804795249, "Apollo u": 163804795249, "": 0}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.title_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: int(r["n"]) for r in got} == titles


def test_engine_on_empty_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, title string, text string")
    assert search.Engine(spark).build(none).search("gamma").collect() == []


SUFFIXES = ("", "y", "yy", "i", "e", "ie", "ative", "ful", "ness", "ed", "eed", "ing", "s", "es", "ies", "ss", "ate", "l", "x")


def test_category_words_are_those_with_its_stem(spark):
    made = ["categor" + "".join(x) for x in itertools.product(SUFFIXES, SUFFIXES[8:], SUFFIXES[8:])] + ["categor" + "".join(x) for x in itertools.product(SUFFIXES, SUFFIXES, SUFFIXES)]
    made += ["categor" + "".join(x) for x in itertools.product(("i", "ie"), ("ative", "ful", "ness", "fulness"), ("ed", "ing", "eding", "inged"), ("", "s", "es", "ss"))]
    made += ["category" + "x" * 70, "subcategory", "categor", "categorical", "catégories"]
    df = spark.createDataFrame([(w,) for w in sorted(set(made))], "w string").repartition(8)
    got = df.select("w", (text.stem(F.col("w")) == "categori").alias("want"), text.is_category(F.col("w")).alias("is"))
    assert got.where("want <> is").collect() == []
    found = {r["w"] for r in got.where("is").collect()}
    assert {"category", "categories", "categoryings", "categoriness", "categoriful", "categorieds", "categoriing", "categoryeds"} <= found


def test_all_category_forms_open_a_name(spark):
    forms = ["Categoryings", "categoriness", "CATEGORIFUL", "categorieds", "categoriing", "categoryeds", "category"]
    rows = [(i, "t", f"words [[{f}:One two|x]] after") for i, f in enumerate(forms)] + [(90, "t", "[[Categorical:One two|x]] after"), (91, "t", "about categoriness it")]
    got = sorted((r["page_id"], r["field"], r["word"]) for r in index.tokens(spark.createDataFrame(rows, "page_id int, title string, text string")).where("field <> 'title'").collect())
    want = [x for i in range(len(forms)) for x in ((i, "body", "words"), (i, "category", "one"), (i, "category", "two"))]
    assert got == want + [(90, "body", w) for w in ("after", "categorical", "one", "two", "x")] + [(91, "body", "about"), (91, "body", "it")]


def test_redirects_are_not_indexed(spark):
    rows = [(1, "Old name", "#REDIRECT [[New]]"), (2, "New", "x #a"), (3, None, None)]
    assert {r["page_id"] for r in index.tokens(spark.createDataFrame(rows, "page_id int, title string, text string")).collect()} == {2}


def test_full_stemmer(spark):
    words = """relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
    analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl homologi homolog revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
    defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti
    angular homologous homolog effective effect bowdlerize bowdler generalizations gener oscillators oscil missing miss category categori""".split()
    df = spark.createDataFrame(list(zip(words[::2], words[1::2])), "word string, want string")
    assert df.withColumn("got", text.stem(F.col("word"), True)).where("got <> want").collect() == []
    page = spark.createDataFrame([(1, "Relational", "adjustment")], "page_id int, title string, text string")
    stems = lambda cfg: {r["stem"] for r in index.term_freq(page, cfg).collect()}
    assert stems(EngineConfig(full_stemmer=True)) == {"relat", "adjust"} and stems(DEFAULT) == {"relational", "adjustment"}


def test_lower_bound_search_is_spread(spark):
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "bdfhjlnprt" for c in "acegikmoqs"]
    entries = spark.createDataFrame([(w,) for w in words] * 2, "stem string")
    asked = [(i, 0, 7, w) for i, w in enumerate(["aaa", "bzz", "cb", "jts", "jtt", "zzz", "a", None, "efi", *["dbb"] * 50, "abcdefghijklmnopqrst"])]
    terms = spark.createDataFrame(asked, "query_id bigint, pos int, flags int, stem string")
    value = lambda w: functools.reduce(lambda a, c: (a * 27 + ord(c) - 96) % 2**64, w, 0)
    order = sorted(words, key=value)
    want = {i: next((x for x in order if value(x) >= value(w)), None) for i, _, _, w in asked if w}
    got = {r["query_id"]: r["stem"] for r in search.next_words(terms, entries).collect()}
    assert got == {i: x for i, x in want.items() if x}
    fewer = {r["query_id"]: r["stem"] for r in search.next_words(terms, entries, drop_first=True).collect()}
    assert fewer == {i: x for i, x in got.items() if x != order[0]}
    assert search.next_words(terms, entries.limit(0)).collect() == []
    numbers = entries.distinct().select(text.word_number(F.col("stem")).alias("n")).repartitionByRange(4, "n").groupBy(F.spark_partition_id()).count().collect()
    assert len(numbers) == 4 and max(r["count"] for r in numbers) <= 2 * 1000 / 4


def test_pagerank_stops_by_itself_only(spark):
    rows = [(i, (i * 7 + 1) % 50) for i in range(50)] + [(0, i) for i in range(50)]
    edges, ids = spark.createDataFrame(rows, "src bigint, dst bigint"), spark.createDataFrame([(i,) for i in range(51)], "page_id bigint")
    seen = []
    got = {r["page_id"]: r["pr"] for r in pagerank(edges, ids, EngineConfig(stop_residual=1e-18), residuals=seen).collect()}
    links_of = {s: {d for a, d in rows if a == s} for s in range(51)}
    pr = dict.fromkeys(range(51), 1 / 52)
    for _ in range(len(seen)):
        pr = {i: 0.15 / 52 + 0.85 * sum(pr[s] / len(t) for s, t in links_of.items() if i in t) if links_of[i] else pr[i] for i in pr}
    pr[50] = 0.15 / 52
    assert got == pytest.approx(pr, abs=1e-12) and seen[-1] <= 1e-18 < seen[-2] and len(seen) <= most_rounds(EngineConfig(stop_residual=1e-18))
    with pytest.raises(ValueError):
        pagerank(edges, ids, EngineConfig(damping=1.0))
    hub = skew.heavy_keys(edges, "src", 0.3, 1)
    ranks = spark.createDataFrame([(i, len(links_of[i]), 0.5 + i) for i in range(51)], "page_id bigint, n bigint, pr double")
    usual = step(ranks, edges.distinct(), 0.1, False, 0.85)
    parts = step(ranks, edges.distinct().where("src <> 0"), 0.1, False, 0.85, (edges.distinct().where("src = 0"), hub.select("src")))
    assert hub.count() == 1 and {r[0]: r["pr"] for r in usual.collect()} == pytest.approx({r[0]: r["pr"] for r in parts.collect()})
