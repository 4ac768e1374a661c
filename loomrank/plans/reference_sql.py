"""SQL of the queries in reference.py."""

from __future__ import annotations

from loomrank.config import STOP_WORDS
from loomrank.functions.text import FOURTH, LOWER, SECOND, THIRD, UPPER

LC = f"'{UPPER}', '{LOWER}'"

RAW = """raw AS (SELECT page_id, file_name, seq, '<page><title>' || replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
|| '</title><text xml:space="preserve">' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text></page>' AS raw
FROM (SELECT DISTINCT page_id, file_name, seq, title, text FROM page))"""
PAGES = RAW + r""",
pages AS (SELECT page_id, regexp_extract(raw, '<title[^>]*>([^<]*)<', 1) AS title, regexp_extract(raw, '<text([^<]*)<', 1) AS text FROM raw)"""

def _shape(w: str) -> str:
    return f"""list_reduce(list_prepend('', string_split({w}, '')), lambda a, c: a || CASE WHEN c = '' THEN '' WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND a LIKE '%C') THEN 'V' ELSE 'C' END)"""


def _m(s: str) -> str:
    return f"len(regexp_extract_all({s}, 'V+C'))"


def _cut(w: str, n: int | str) -> str:
    return f"left({w}, greatest(length({w}) - {n}, 0))"


def _suffixes(table: dict[str, str], least: int = 0) -> str:
    """The branches of a step: the first suffix that fits is replaced, if the rest has a measure above `least`."""
    return " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m(_cut('s', len(a)))} > {least} THEN {_cut('w', len(a))} || '{b}' ELSE w END" for a, b in table.items())


def stems(words: str, out: str = "stemmed", full: bool = False) -> str:
    """CTEs down to stemmed(word, stem) of the words of a table."""
    k = [f"{out}{i}" for i in range(13)]
    closed = "r LIKE '%CVC' AND right(t, 1) NOT IN ('w', 'x', 'y')"
    fourth = {f: f[0] if f in ("sion", "tion") else "" for f in FOURTH}
    fourth = " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m(_cut('s', len(a) - len(b)))} > 1 THEN {_cut('w', len(a) - len(b))} ELSE w END" for a, b in fourth.items())
    steps = [_suffixes(SECOND), _suffixes(THIRD), fourth] if full else [_suffixes(THIRD)]
    sql = f""",
{k[1]} AS (SELECT word, CASE WHEN ends_with(word, 'sses') OR ends_with(word, 'ies') THEN {_cut('word', 2)} WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN {_cut('word', 1)} ELSE word END AS w FROM (SELECT DISTINCT word FROM {words})),
{k[2]} AS (SELECT word, w, {_shape('w')} AS s, CASE WHEN ends_with(w, 'ed') THEN 2 WHEN ends_with(w, 'ing') THEN 3 ELSE 0 END AS n FROM {k[1]}),
{k[3]} AS (SELECT word, w, s, n, {_cut('w', 'n')} AS t, {_cut('s', 'n')} AS r FROM {k[2]}),
{k[4]} AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(_cut('s', 3))} > 0 THEN {_cut('w', 1)} ELSE w END
WHEN n > 0 AND contains(r, 'V') THEN CASE WHEN ends_with(t, 'at') OR ends_with(t, 'bl') OR ends_with(t, 'iz') THEN t || 'e'
WHEN length(t) > 1 AND ends_with(r, 'C') AND right(t, 1) = left(right(t, 2), 1) THEN CASE WHEN right(t, 1) IN ('l', 's', 'z') THEN t ELSE {_cut('t', 1)} END
WHEN {_m('r')} = 1 AND {closed} THEN t || 'e' ELSE t END ELSE w END AS w FROM {k[3]}),
{k[5]} AS (SELECT word, CASE WHEN ends_with(w, 'y') AND contains({_cut(_shape('w'), 1)}, 'V') THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM {k[4]})"""
    at = k[5]
    for i, step in enumerate(steps):
        sql += f""",
{at}s{i} AS (SELECT word, w, {_shape('w')} AS s FROM {at}),
{at}w{i} AS (SELECT word, CASE {step} ELSE w END AS w FROM {at}s{i})"""
        at = f"{at}w{i}"
    return sql + f""",
{k[8]} AS (SELECT word, w, {_shape('w')} AS s, {_cut('w', 1)} AS t FROM {at}),
{k[9]} AS (SELECT word, w, s, t, {_cut('s', 1)} AS r, {_m('s')} AS m FROM {k[8]}),
{k[10]} AS (SELECT word, m, CASE WHEN ends_with(w, 'e') AND (m > 1 OR (m = 1 AND NOT ({closed}))) THEN t ELSE w END AS w FROM {k[9]}),
{out} AS (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN m > 1 AND ends_with(w, 'll') THEN {_cut('w', 1)} ELSE w END AS stem FROM {k[10]})"""


#: Words with what stands before them; a name goes on while no ] was seen since the word category after [.
TOKENS = PAGES + rf""",
pieces AS (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT page_id, regexp_extract_all(translate(text, {LC}), '[^a-z]*[a-z]+') AS p FROM pages)),
words AS (SELECT page_id, i, regexp_extract(piece, '^([^a-z]*)', 1) AS sep, regexp_extract(piece, '([a-z]+)$', 1) AS w FROM pieces),
likely AS (SELECT DISTINCT w AS word FROM words WHERE w LIKE 'categor%'){stems("likely", "likely_stem")},
forms AS (SELECT word FROM likely_stem WHERE stem = 'categori'),
marks AS (SELECT *, w IN (FROM forms) AS form, w IN (FROM forms) AND sep LIKE '%[' AS opens,
count(*) FILTER (sep LIKE '%]%') OVER (PARTITION BY page_id ORDER BY i) AS closed, coalesce(lead(sep) OVER (PARTITION BY page_id ORDER BY i), ']') AS following FROM words),
names AS (SELECT *, coalesce(max(CASE WHEN opens THEN closed END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) = closed AS inside,
min(CASE WHEN opens THEN i END) OVER (PARTITION BY page_id) AS first FROM marks),
ends AS (SELECT *, min(CASE WHEN i > first AND NOT inside AND NOT form THEN i END) OVER (PARTITION BY page_id) AS stop FROM names),
tokens AS (
SELECT page_id, 'title' AS field, left(unnest(regexp_extract_all(translate(title, {LC}), '[a-z]+')), 63) AS word FROM pages
UNION ALL SELECT page_id, 'body', left(w, 64) FROM ends WHERE (first IS NULL OR i < first) AND NOT form
UNION ALL SELECT page_id, 'category', left(w, 64) FROM ends WHERE inside AND i < coalesce(stop, i + 1) AND NOT following LIKE ']%')"""


STOPS = "SELECT unnest([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]) AS word"
STOP = f"stop AS ({STOPS})"
ALL = TOKENS + f", {STOP}, vocabulary AS (SELECT word FROM tokens UNION SELECT word FROM stop)" + stems("vocabulary")
KEPT = ALL + """,
kept AS (SELECT page_id, field, stem FROM tokens JOIN stemmed USING (word) WHERE stem NOT IN (SELECT stem FROM stop JOIN stemmed USING (word))),
freqs AS (SELECT stem, page_id, CAST(count(*) AS INTEGER) AS freq, bool_or(field = 'title') AS in_title, bool_or(field = 'category') AS in_category FROM kept GROUP BY ALL),
tiers AS (SELECT *, CASE WHEN in_title THEN 'title' WHEN in_category THEN 'category' WHEN freq < 8 THEN 'low' ELSE 'high' END AS tier FROM freqs)"""

_LINKS = rf"""links AS (SELECT src, target, translate(target, {LC}) AS title_key FROM (SELECT page_id AS src, unnest(regexp_extract_all(split_part(text, '[[Category:', 1), '(?s)\[\[(?:(?:Image|File):|(.*?)(?:\||\]\]))', 1)) AS target FROM pages) WHERE coalesce(target, '') <> ''),
titles AS (SELECT translate(title, {LC}) AS title_key, max(page_id) AS page_id FROM pages GROUP BY ALL)"""
LINKS = f"{PAGES},\n{_LINKS}"
EDGES = "e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), ids AS (SELECT DISTINCT page_id FROM page WHERE page_id IS NOT NULL)"


def _rank(rounds: int) -> str:
    """rounds updates of pages with links, then one of those without."""
    out = f"""WITH {EDGES}, inside AS (SELECT e.* FROM e JOIN ids a ON a.page_id = e.src JOIN ids b ON b.page_id = e.dst),
total AS (SELECT count(*) + 1 AS t FROM ids), deg AS (SELECT src, count(*) AS n FROM inside GROUP BY src),
r0 AS (SELECT page_id, coalesce(n, 0) AS n, 1.0::DOUBLE / t AS pr FROM ids LEFT JOIN deg ON src = page_id, total)"""
    for k in range(rounds + 1):
        takes = "n = 0" if k == rounds else "n > 0"
        out += f""", g{k} AS (SELECT dst, sum(pr / n) AS got FROM inside JOIN r{k} ON src = page_id GROUP BY dst),
r{k + 1} AS (SELECT page_id, n, CASE WHEN {takes} THEN (1 - 0.85::DOUBLE) / t + 0.85::DOUBLE * coalesce(got, 0) ELSE pr END AS pr FROM r{k} LEFT JOIN g{k} ON dst = page_id, total)"""
    return out + f" SELECT page_id, round(pr, 12) AS pr FROM r{rounds + 1}"


#: Rounds until the sum of squared changes is 1e-12 at most, then one of the pages without links; ends with final(page_id, pr).
CONVERGED = """inside AS (SELECT e.* FROM e JOIN ids a ON a.page_id = e.src JOIN ids b ON b.page_id = e.dst),
total AS (SELECT count(*) + 1 AS t FROM ids), deg AS (SELECT src, count(*) AS n FROM inside GROUP BY src),
r AS (SELECT 0 AS round, page_id, coalesce(n, 0) AS n, 1.0::DOUBLE / t AS pr, NULL::DOUBLE AS old FROM ids LEFT JOIN deg ON src = page_id, total
UNION ALL SELECT round + 1, r.page_id, r.n, CASE WHEN r.n > 0 THEN (1 - 0.85::DOUBLE) / t + 0.85::DOUBLE * coalesce(got, 0) ELSE pr END, pr
FROM r LEFT JOIN (SELECT dst, sum(pr / n) AS got FROM inside JOIN r ON src = page_id GROUP BY dst) g ON dst = page_id, total
WHERE (SELECT coalesce(sum((pr - old) ** 2), 1) FROM r) > 1e-12),
last AS (SELECT * FROM r WHERE round = (SELECT max(round) FROM r)),
final AS (SELECT page_id, CASE WHEN n = 0 THEN (1 - 0.85::DOUBLE) / t + 0.85::DOUBLE * coalesce(got, 0) ELSE pr END AS pr
FROM last LEFT JOIN (SELECT dst, sum(pr / n) AS got FROM inside JOIN last ON src = page_id GROUP BY dst) g ON dst = page_id, total)"""

_POWERS = "[" + ", ".join(str(27**i) for i in range(13)) + "]::BIGINT[]"


def letters(v: str) -> str:
    """The word of a base-27 value."""
    return f"array_to_string(list_transform(list_reverse(list_filter({_POWERS}, lambda p: {v} >= p)), lambda p: chr(CAST(96 + ({v} // p) % 27 AS INTEGER))), '')"


POSTINGS = "p AS (SELECT word_val, page_id, max(freq) AS freq, max(tier) AS tier FROM postings WHERE word_val IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL)"
WEIGHT = "CAST(coalesce(freq, 0) * CASE tier WHEN 'title' THEN 100 WHEN 'category' THEN 30 ELSE 1 END AS BIGINT)"
RANKS = "ranks AS (SELECT page_id, max(pr) AS pr FROM pageranks WHERE pr IS NOT NULL AND NOT isnan(pr) GROUP BY page_id)"
GIVEN = "terms AS (SELECT query_id, pos, 7 AS flags, word_val FROM query_terms WHERE query_id IS NOT NULL AND word_val IS NOT NULL)"
PARSED = rf"""
asked AS (SELECT query_id, generate_subscripts(r, 1) AS k, unnest(r) AS raw FROM (SELECT query_id, string_split(regexp_replace(translate(query_text, {LC}), '[^a-z: ]', '', 'g'), ' ') AS r FROM queries WHERE query_id IS NOT NULL)),
parts AS (SELECT query_id, k, left(regexp_extract(raw, '([^:]*)$', 1), 63) AS word, CASE WHEN NOT contains(raw, ':') THEN 7
ELSE CASE regexp_extract(regexp_extract(raw, '^(.*):', 1), '([a-z])[a-z]*:?$', 1) WHEN 't' THEN 1 WHEN 'c' THEN 3 ELSE 7 END END AS flags FROM asked),
asked_stop AS (FROM ({STOPS})), asked_words AS (SELECT word FROM parts WHERE word <> '' UNION SELECT word FROM asked_stop){stems("asked_words", "asked_stem")},
parsed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS INTEGER) AS pos, word, stem, flags FROM parts JOIN asked_stem USING (word)
WHERE stem NOT IN (SELECT stem FROM asked_stop JOIN asked_stem USING (word)))"""
NUMBER = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(stem, ''), lambda c: (ascii(c) - 96)::HUGEINT)), lambda a, c: (a * 27 + c) % 18446744073709551616)"
NAMES = f"dict AS (SELECT word_val, {letters('word_val')} AS stem FROM (SELECT DISTINCT word_val FROM p))"
FOUND = PARSED + f", {POSTINGS}, {NAMES}, terms AS (SELECT query_id, pos, flags, word_val FROM parsed JOIN dict USING (stem))"


def searching(low: bool = False, fields: bool = False, asked: str = "terms") -> str:
    """CTEs from terms and p down to weights; asked: the table that has all words of the queries."""
    tiers = "" if low else " AND tier <> 'low'"
    only = " AND (flags = 7 OR tier = 'title' OR (flags = 3 AND tier = 'category'))" if fields else ""
    return f""",
hits AS (SELECT query_id, pos, page_id, {WEIGHT} AS weight, count(*) OVER (PARTITION BY query_id, pos) AS list_pages FROM terms JOIN p USING (word_val) WHERE true{tiers}{only}),
longest AS (SELECT query_id, max(list_pages) AS longest FROM hits GROUP BY query_id),
weights AS (SELECT query_id, page_id, CAST(sum(least(100, longest // list_pages) * weight) AS BIGINT) AS weight FROM hits JOIN longest USING (query_id) GROUP BY query_id, page_id
HAVING count(*) = (SELECT count(*) FROM {asked} a WHERE a.query_id = hits.query_id))"""


BEST = f""", {RANKS},
best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pr * weight DESC, page_id DESC) - 1 AS INTEGER) AS rank, page_id, pr * weight AS score FROM weights JOIN ranks USING (page_id))"""
TOP = f", {PAGES} SELECT query_id, rank, page_id, translate(title, {LC}) AS title, round(score, 9) AS score FROM best JOIN pages USING (page_id) WHERE rank < 10"


def _topk(query: str) -> str:
    return (f"WITH {FOUND}" + searching(asked="parsed") + BEST + TOP).replace("FROM queries WHERE query_id IS NOT NULL", f"FROM (SELECT 0::BIGINT AS query_id, '{query}' AS query_text)")


def title_number(c: str) -> str:
    return f"""list_reduce(list_prepend(0::HUGEINT, list_transform(list_filter(string_split(translate({c}, {LC}), ''), lambda c: c <> ''), lambda c: CAST(CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 96
WHEN c BETWEEN '0' AND '8' THEN ascii(c) - 21 WHEN c = '.' THEN 37 ELSE ascii(c) % 36 END AS HUGEINT))), lambda a, c: (a * 38 + c) % 18446744073709551616)"""


def varint(n: str) -> str:
    """A number from 0 on as the hexadecimal bytes of its varint."""
    return f"""array_to_string(list_transform(list_filter(range(0, 9), lambda i: i = 0 OR {n} >= (1::BIGINT << (7 * i)::INTEGER)), lambda i: printf('%02x',
CAST((({n} >> (7 * i)::INTEGER) & 127) * 2 + CASE WHEN {n} >= (1::BIGINT << (7 * (i + 1))::INTEGER) THEN 1 ELSE 0 END AS INTEGER))), '')"""


_LISTS = f"WITH {POSTINGS}, l AS (SELECT word_val, tier, f AS freq, 0 AS segment, list(page_id ORDER BY page_id) AS ids FROM (SELECT *, CASE WHEN tier = 'low' THEN freq END AS f FROM p) GROUP BY word_val, tier, f)"
_COUNTS = "SELECT page_id, word, count(*) AS n FROM tokens WHERE field = '{}' GROUP BY ALL"
_INDEX = "SELECT stem, tier, 0 AS segment, count(*) AS n, string_agg(page_id || ':' || freq, ',' ORDER BY page_id) AS items FROM (SELECT stem, CASE WHEN tier = 'low' THEN 'low' || freq ELSE tier END AS tier, page_id, freq FROM tiers) GROUP BY stem, tier"

SQL = {
    "scan_pages": f"WITH {RAW} SELECT page_id, file_name, seq, length(raw) AS raw_length FROM raw",
    "page_count": "SELECT count(DISTINCT page_id) + 1 AS stored_pages FROM page",
    "page_id_offsets": "SELECT file_name, CAST(coalesce(sum(n) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_id FROM (SELECT file_name, count(DISTINCT page_id) AS n FROM page GROUP BY file_name)",
    "extract_title": f"WITH {PAGES} SELECT page_id, title FROM pages",
    "extract_text": f"WITH {PAGES} SELECT page_id, text FROM pages",
    "dump_round_trip": f"WITH {PAGES} SELECT row_number() OVER (ORDER BY file_name, seq, page_id) AS page_id, title, CAST(length(text) AS INTEGER) AS text_length FROM raw JOIN pages USING (page_id)",
    "redirect_filter": f"WITH {PAGES} SELECT page_id FROM pages WHERE NOT starts_with(text, '#')",
    "redirect_plain": "SELECT DISTINCT page_id FROM page WHERE NOT starts_with(coalesce(text, ''), '#')",
    "ascii_lower": f"SELECT DISTINCT page_id, translate(title, {LC}) AS title_lc FROM page WHERE title IS NOT NULL",
    "tokenize": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, left(unnest(regexp_extract_all(translate(text, {LC}), '[a-z]+')), 63) AS word FROM documents) GROUP BY ALL",
    "porter_measure": f"WITH {TOKENS}, v AS (SELECT DISTINCT word FROM tokens), s AS (SELECT word, {_shape('word')} AS shape FROM v) SELECT word, shape, CAST({_m('shape')} AS INTEGER) AS m FROM s",
    "stem": f"WITH {TOKENS}{stems('tokens')} SELECT word, stem FROM stemmed",
    "stem_full": f"WITH {TOKENS}{stems('tokens', full=True)} SELECT word, stem FROM stemmed",
    "word_hash": f"WITH {TOKENS} SELECT word, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(word, ''), lambda c: (ascii(c) - 96)::HUGEINT)), lambda a, c: (a * 27 + c) % 18446744073709551616) AS VARCHAR) AS number FROM (SELECT DISTINCT word FROM tokens)",
    "word_unhash": f"SELECT word_val, {letters('word_val')} AS word FROM (SELECT DISTINCT word_val FROM postings WHERE word_val IS NOT NULL)",
    "title_hash": f"SELECT title, CAST({title_number('title')} AS VARCHAR) AS number FROM (SELECT DISTINCT title FROM page WHERE title IS NOT NULL)",
    "stop_stems": f"WITH {STOP}{stems('stop')} SELECT DISTINCT stem FROM stemmed",
    **{f"{f}_tokens": f"WITH {TOKENS} {_COUNTS.format(f)}" for f in ("title", "body", "category")},
    "tokens_nostop": f"WITH {KEPT} SELECT page_id, field, stem, count(*) AS n FROM kept GROUP BY ALL",
    "term_freq": f"WITH {KEPT} SELECT * FROM freqs",
    "posting_pack": f"WITH {KEPT} SELECT stem, page_id, CAST(freq * 4 + in_title::INTEGER + 2 * in_category::INTEGER AS INTEGER) AS payload FROM freqs",
    "posting_unpack": f"WITH {POSTINGS} SELECT word_val, page_id, CAST(freq * 4 + CASE tier WHEN 'title' THEN 1 WHEN 'category' THEN 2 ELSE 0 END AS INTEGER) AS payload, freq, tier = 'title' AS in_title, tier = 'category' AS in_category FROM p WHERE freq IS NOT NULL",
    "vocabulary_size": f"WITH {KEPT} SELECT count(DISTINCT stem) AS words, count(*) AS postings FROM freqs",
    "posting_tier": f"WITH {KEPT} SELECT stem, page_id, freq, tier FROM tiers",
    "inverted_index": f"WITH {KEPT} {_INDEX}",
    "low_lists": f"WITH {KEPT} SELECT stem, freq, 0 AS segment, count(*) AS n, string_agg(page_id, ',' ORDER BY page_id) AS items FROM tiers WHERE tier = 'low' GROUP BY stem, freq",
    "dictionary": f"WITH {KEPT} SELECT stem, count(*) AS pages, count(*) FILTER (tier <> 'low') AS searchable FROM tiers GROUP BY stem",
    "posting_lists": f"WITH {POSTINGS} SELECT word_val, tier, count(*) AS pages, CAST(coalesce(sum(freq), 0) AS BIGINT) AS occurrences FROM p GROUP BY ALL",
    "nested_lists": """SELECT word_val, tier, x.page_id AS page_id, x.freq AS freq FROM (
SELECT word_val, 'title' AS tier, unnest(title_list) AS x FROM posting_list UNION ALL SELECT word_val, 'category', unnest(category_list) FROM posting_list
UNION ALL SELECT word_val, 'high', unnest(high_list) FROM posting_list) WHERE word_val IS NOT NULL
UNION ALL SELECT word_val, 'low', unnest(ids), f FROM (SELECT word_val, unnest(low_list) AS ids, CAST(generate_subscripts(low_list, 1) - 1 AS INTEGER) AS f FROM posting_list WHERE word_val IS NOT NULL)""",
    "doc_freq": f"WITH {POSTINGS} SELECT word_val, count(*) AS searchable_pages FROM p WHERE tier <> 'low' GROUP BY word_val",
    "title_offsets": f"WITH {PAGES} SELECT page_id, size, CAST(coalesce(sum(size) OVER (PARTITION BY file_name ORDER BY seq, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS title_offset FROM (SELECT page_id, file_name, seq, CAST(strlen(title) + 1 AS BIGINT) AS size FROM raw JOIN pages USING (page_id))",
    "delta_encode": f"{_LISTS} SELECT word_val, tier, freq, segment, array_to_string(list_transform(ids, lambda x, i: x - coalesce(ids[i - 1], 0)), ',') AS gaps FROM l",
    "delta_decode": f"{_LISTS} SELECT word_val, tier, freq, segment, array_to_string(ids, ',') AS ids FROM l",
    "delta_backlinks": f"WITH {EDGES}, l AS (SELECT dst, list(src ORDER BY src) AS ids FROM e GROUP BY dst) SELECT dst, 0 AS segment, array_to_string(list_transform(ids, lambda x, i: x - coalesce(ids[i - 1], 0)), ',') AS gaps FROM l",
    "varint_encode": f"SELECT n, {varint('n')} AS bytes FROM (SELECT DISTINCT dst AS n FROM edges WHERE dst IS NOT NULL)",
    "signed_encode": f"""SELECT n, printf('%02x', CAST(CASE WHEN n < 0 THEN 128 ELSE 0 END + (abs(n) & 63) * 2 + CASE WHEN abs(n) > 63 THEN 1 ELSE 0 END AS INTEGER)) || CASE WHEN abs(n) > 63 THEN {varint('(abs(n) >> 6)')} ELSE '' END AS bytes
FROM (SELECT DISTINCT dst - src AS n FROM edges WHERE dst IS NOT NULL)""",
    "varint_round_trip": "SELECT n, n AS back, n AS plain FROM (SELECT dst - src AS n FROM edges WHERE dst IS NOT NULL UNION SELECT (dst - src) * (dst - src) * (dst - src) FROM edges WHERE dst IS NOT NULL)",
    "byte_encode": "SELECT DISTINCT freq, printf('%02x', freq % 256) AS bytes, freq % 256 AS back FROM postings",
    "short_encode": "SELECT DISTINCT n_chars, printf('%04x', n_chars % 65536) AS bytes, CAST(n_chars % 65536 AS INTEGER) AS back FROM documents",
    "double_round_trip": "SELECT DISTINCT pr, CASE WHEN pr IS NOT NULL THEN 8 END AS size, pr AS back FROM pageranks WHERE pr IS NULL OR NOT isnan(pr)",
    "packed_words": rf"""WITH {TOKENS} SELECT word, array_to_string(list_transform(range(0, length(word) // 3 + 1), lambda g: printf('%04x', CAST(list_reduce(list_prepend(0, list_transform(range(1, 4),
lambda i: CASE WHEN 3 * g + i <= length(word) THEN ascii(word[CAST(3 * g + i AS INTEGER)]) - 96 ELSE 0 END)), lambda a, x: a * 32 + x) * 2 + CASE WHEN 3 * g + 3 <= length(word) THEN 1 ELSE 0 END AS INTEGER))), '') AS bytes, word AS back
FROM (SELECT DISTINCT word FROM tokens)""",
    "text_encode": "SELECT DISTINCT title, lower(hex(title)) || '00' AS bytes, title AS back FROM page",
    "backlink_bytes": f"""WITH {EDGES}, l AS (SELECT dst, list(src ORDER BY src) AS ids FROM e GROUP BY dst), g AS (SELECT dst, unnest(ids) AS id, unnest(list_transform(ids, lambda x, i: x - coalesce(ids[i - 1], 0))) AS gap FROM l),
b AS (SELECT dst, string_agg({varint('gap')}, '' ORDER BY id) || '00' AS bytes FROM g GROUP BY dst)
SELECT dst, 0 AS segment, bytes, CAST(coalesce(sum(length(bytes) // 2) OVER (ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM b""",
    "extract_links": f"WITH {LINKS} SELECT src, target, count(*) AS n FROM links GROUP BY ALL",
    "title_dict": f"WITH {LINKS} SELECT title_key, page_id FROM titles",
    "resolve_links": f"WITH {LINKS} SELECT src, page_id AS dst, target, count(*) AS n FROM links JOIN titles USING (title_key) GROUP BY ALL",
    "resolve_by_number": f"WITH {LINKS}, t AS (SELECT {title_number('title')} AS v, max(page_id) AS dst FROM pages GROUP BY ALL) SELECT src, dst, target, count(*) AS n FROM (SELECT src, target, {title_number('target')} AS v FROM links) JOIN t USING (v) GROUP BY ALL",
    "terms_per_file": f"WITH {KEPT} SELECT file_name, count(DISTINCT stem) AS terms, count(*) AS postings FROM freqs JOIN raw USING (page_id) GROUP BY file_name",
    "unresolved_links": f"WITH {LINKS} SELECT src, target, count(*) AS n FROM links ANTI JOIN titles USING (title_key) GROUP BY ALL",
    "page_edges": f"WITH {LINKS} SELECT DISTINCT src, page_id AS dst FROM links JOIN titles USING (title_key)",
    "edges": f"WITH {EDGES} SELECT src, dst FROM e",
    "out_degree": f"WITH {EDGES} SELECT page_id, count(dst) AS n FROM ids LEFT JOIN e ON src = page_id GROUP BY page_id",
    "backlinks": f"WITH {EDGES} SELECT dst, 0 AS segment, count(*) AS n, string_agg(src, ',' ORDER BY src) AS items FROM e GROUP BY dst",
    "corpus_stats": f"""WITH {LINKS}, t AS (SELECT src, page_id AS dst FROM links LEFT JOIN titles USING (title_key)), f AS (SELECT count(*) AS found FROM (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL))
SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM titles) AS titles, found + (SELECT count(*) FROM t WHERE dst IS NULL) AS links, found FROM f""",
    "pagerank_init": f"WITH {EDGES} SELECT page_id, round(1.0::DOUBLE / (SELECT count(*) + 1 FROM ids), 12) AS pr FROM ids",
    "pagerank_step": _rank(1),
    "pagerank_rounds": _rank(4),
    "pagerank": f"WITH RECURSIVE {EDGES}, {CONVERGED} SELECT page_id, round(pr, 12) AS pr FROM final",
    "pagerank_residuals": f"WITH RECURSIVE {EDGES}, {CONVERGED} SELECT CAST(round - 1 AS INTEGER) AS round, round(sum((pr - old) ** 2), 12) AS residual FROM r WHERE round > 0 GROUP BY ALL",
    "parse_query": f"WITH {PARSED} SELECT query_id, pos, word, stem, flags FROM parsed",
    "lookup_exact": f"WITH {PARSED}, {POSTINGS}, {NAMES} SELECT query_id, pos, stem FROM parsed JOIN dict USING (stem)",
    "lookup_lower_bound": f"WITH {PARSED}, {POSTINGS}, {NAMES}, n AS (SELECT query_id, pos, {NUMBER} AS v FROM parsed), d AS (SELECT word_val::HUGEINT AS v, stem FROM dict) SELECT query_id, pos, d.stem AS stem FROM n ASOF JOIN d ON n.v <= d.v",
    "lookup_first_dropped": f"""WITH {PARSED}, {POSTINGS}, {NAMES}, n AS (SELECT query_id, pos, {NUMBER} AS v FROM (SELECT query_id, pos, stem FROM parsed UNION ALL SELECT query_id, pos + 1000, 'a' || left(stem, 1) FROM parsed)),
d AS (SELECT word_val::HUGEINT AS v, stem FROM dict) SELECT query_id, pos, d.stem AS stem FROM n ASOF JOIN d ON n.v <= d.v WHERE d.v > (SELECT min(v) FROM d)""",
    "lookup_postings": f"WITH {POSTINGS} SELECT word_val, page_id, freq, tier FROM p SEMI JOIN query_terms USING (word_val) WHERE tier <> 'low'",
    "merge_high_list": f"WITH {POSTINGS} SELECT word_val, page_id, {WEIGHT} AS weight FROM p WHERE tier <> 'low'",
    "idf_weight": f"WITH {POSTINGS}, {GIVEN}{searching()} SELECT DISTINCT query_id, pos, list_pages, least(100, longest // list_pages) AS g FROM hits JOIN longest USING (query_id)",
    "intersect_two": f"WITH {POSTINGS}, {GIVEN}{searching()} SELECT query_id, page_id, CAST(sum(weight) AS BIGINT) AS weight FROM hits WHERE pos < 2 GROUP BY ALL HAVING count(*) = 2",
    "intersect_pages": f"WITH {POSTINGS}, {GIVEN}{searching()} SELECT query_id, page_id FROM weights",
    "conjunctive_search": f"WITH {POSTINGS}, {GIVEN}{searching()} SELECT query_id, page_id, weight FROM weights",
    "rank_list": f"WITH {POSTINGS}, {GIVEN}{searching()}{BEST} SELECT query_id, rank, page_id, round(score, 9) AS score FROM best WHERE rank < 10",
    "fetch_title": f"WITH {PAGES} SELECT page_id, translate(title, {LC}) AS title FROM pages SEMI JOIN pageranks USING (page_id)",
    "search_topk": _topk("list of c:stub"),
    "search_batch": f"WITH {FOUND}{searching(asked='parsed')}{BEST}{TOP}",
    "search_lower_bound": f"WITH {PARSED}, {POSTINGS}, {NAMES}, n AS (SELECT query_id, pos, flags, {NUMBER} AS v FROM parsed), d AS (SELECT word_val, word_val::HUGEINT AS v FROM dict), terms AS (SELECT query_id, pos, flags, word_val FROM n ASOF JOIN d ON n.v <= d.v){searching()}{BEST}{TOP}",
    "search_fields": f"WITH {FOUND}{searching(fields=True, asked='parsed')}{BEST}{TOP}",
    "search_low": f"WITH {FOUND}{searching(low=True, asked='parsed')}{BEST}{TOP}",
    "search_saved": f"WITH {FOUND}{searching(asked='parsed')}{BEST}{TOP}",
    "engine": f"""WITH RECURSIVE {KEPT}, {_LINKS}, e AS (SELECT DISTINCT src, page_id AS dst FROM links JOIN titles USING (title_key)), ids AS (SELECT page_id FROM pages), {CONVERGED},
ranks AS (SELECT page_id, round(pr, 12) AS pr FROM final), {PARSED.strip().replace("FROM queries WHERE", "FROM (SELECT page_id AS query_id, title AS query_text FROM pages WHERE page_id % 50 = 0) WHERE")}, p AS (SELECT stem AS word_val, page_id, freq, tier FROM tiers), terms AS (SELECT query_id, pos, flags, stem AS word_val FROM parsed){searching(asked='parsed')},
{BEST[BEST.index('best AS'):]} SELECT query_id, rank, page_id, translate(title, {LC}) AS title, round(score, 9) AS score FROM best JOIN pages USING (page_id) WHERE rank < 10""",
    "saved_dictionary": f"WITH {POSTINGS}, {NAMES} SELECT stem, count(*) AS pages, count(*) FILTER (tier <> 'low') AS searchable, CAST(word_val AS VARCHAR) AS number FROM p JOIN dict USING (word_val) GROUP BY stem, word_val",
    "saved_postings": f"WITH {POSTINGS}, {NAMES} SELECT stem, page_id, coalesce(freq, 0) AS freq, tier FROM p JOIN dict USING (word_val)",
    "saved_titles": f"WITH {PAGES} SELECT page_id, title FROM pages",
    "saved_degrees": f"WITH {EDGES} SELECT page_id, count(dst) AS n FROM ids LEFT JOIN e ON src = page_id GROUP BY page_id",
    "saved_backlinks": f"WITH {EDGES} SELECT dst, src FROM e",
    "saved_ranks": f"WITH {RANKS} SELECT page_id, pr FROM ranks",
    "saved_page_stats": "SELECT file_name, CAST(coalesce(sum(n) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_id FROM (SELECT file_name, count(DISTINCT page_id) AS n FROM page GROUP BY file_name)",
}
