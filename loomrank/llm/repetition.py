"""Repetition within a document: problem 9.

zstandard packs repeated phrases into short references, so the ratio of a document's bytes to its compressed
bytes, of the whole and of fixed chunks, tells repetitive from ordinary text at little cost. What is ordinary
depends on the length, so the limits do. No ratio proves that a text repeats little, so the bands decide nothing
about p9_found: repeated words are counted in every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.sources.tables import spread, table

RUN, FOUND = 5, 0.3
CHUNK = 4096
#: From this many bytes on: (ratio below which text is ordinary, ratio from which it is repetitive). The first is set
#: for prose; lists and numbers pack so poorly that texts of which 30 % is repeated lie below it too.
LIMITS = ((0, 0.0, 1.6), (200, 1.4, 1.8), (400, 1.5, 1.95), (800, 1.65, 2.2), (1600, 1.8, 2.4), (3200, 1.95, 2.7), (6400, 2.05, 3.0), (25600, 2.1, 3.4))
#: Text that zstandard cannot shorten to this ratio, from so many bytes on, is no prose.
INCOMPRESSIBLE, INCOMPRESSIBLE_FROM = 1.05, 400
WORD = re.compile(r"[^\W_]+")
_START = np.array([x[0] for x in LIMITS])


def limits(size: int) -> tuple[float, float]:
    return LIMITS[int(np.searchsorted(_START, size, side="right")) - 1][1:]


def compressor() -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(3, window_log=23, enable_ldm=False, write_content_size=False)
    return zstandard.ZstdCompressor(compression_params=parameters)


def bands(text: str, packer: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """(ratio of the whole, greatest ratio of a chunk, band): ordinary, suspicious, repetitive or incompressible."""
    data = text.encode("utf-8", "replace")
    if not data:
        return 0.0, 0.0, "ordinary"
    whole = len(data) / len(packer.compress(data))
    low, high = limits(len(data))
    chunk = whole
    if len(data) > CHUNK:
        starts = range(0, len(data), CHUNK)
        sizes = [(min(CHUNK, len(data) - a), a) for a in starts]
        ratios = [(n / len(packer.compress(data[a : a + n])), n) for n, a in sizes if n >= CHUNK // 2]
        chunk = max(r for r, _ in ratios)
        below, above = limits(CHUNK)
        if whole < high and chunk >= above:
            return whole, chunk, "repetitive"
        if whole < low and chunk >= below:
            return whole, chunk, "suspicious"
    if whole >= high:
        return whole, chunk, "repetitive"
    if len(data) >= INCOMPRESSIBLE_FROM and whole < INCOMPRESSIBLE:
        return whole, chunk, "incompressible"
    return whole, chunk, "suspicious" if whole >= low else "ordinary"


def repeated_words(text: str, run: int = RUN) -> tuple[int, int]:
    """(words, words that belong to a run of `run` consecutive words occurring at least twice, overlaps included)."""
    words = WORD.findall(text.lower())
    n = len(words)
    if n <= run:
        return n, 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) > n - 1:
        return n, 0
    runs, base = ids[: n - run + 1].copy(), len(known)
    room = base
    for k in range(1, run):
        if room > 2**62 // base:  # number the runs so far anew, so that none overflows
            _, runs = np.unique(runs, return_inverse=True)
            room = int(runs.max()) + 1
        runs = runs * base + ids[k : k + n - run + 1]
        room *= base
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return n, 0
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[:-run] += again
    cover[run:] -= again
    return n, int((np.cumsum(cover)[:n] > 0).sum())


def _measure(exact: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = compressor()
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if text is None:
                    out.append((None,) * 5)
                    continue
                whole, chunk, band = bands(text, packer) if exact != "all" else (None, None, None)
                out.append((whole, chunk, band, *(repeated_words(text) if exact != "none" else (None, None))))
            kinds = (pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "ratio", "chunk_ratio", "band", "words", "repeated_words"])

    return run


def repetition(documents: DataFrame, exact: str = "both") -> DataFrame:
    """(doc_id, ratio, chunk_ratio, band, words, repeated_words) of every document, without a shuffle but
    for spread() of tables in very few files.

    exact: `both` gives the bands and counts the words of every document, `all` only counts and leaves the bands null,
    `none` only gives the bands. A null text has nulls; an empty one ratio 0 and, if counted, 0 words. Whole texts are read,
    however long. An empty table gives no rows; repeated rows each have theirs; other columns are ignored.
    """
    schema = "doc_id bigint, ratio double, chunk_ratio double, band string, words int, repeated_words int"
    rows = spread(documents.select(F.col("doc_id").cast("bigint"), "text"), "doc_id", documents)
    return rows.mapInArrow(_measure(exact), schema)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = repetition(table(spark, folder, "documents"), "all")
    return rows.where((F.col("words") > 0) & (F.col("repeated_words") >= FOUND * F.col("words"))).select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    share = F.when(F.col("words") > 0, F.col("repeated_words") / F.col("words")).otherwise(F.when(F.col("words") == 0, 0.0))
    return repetition(table(spark, folder, "documents"), "all").select("doc_id", "words", "repeated_words", share.alias("share"))


def p9_bands(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents"), "none").select("doc_id", "ratio", "chunk_ratio", "band")


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_bands": p9_bands}
_SHARES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+{RUN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {RUN - 2})) AS i FROM w WHERE len(w) >= {RUN})),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range({RUN})) AS k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS INTEGER) AS words, CASE WHEN w IS NOT NULL THEN CAST(coalesce(r.n, 0) AS INTEGER) END AS repeated_words,
CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE coalesce(r.n, 0)::DOUBLE / len(w) END AS share FROM w LEFT JOIN r USING (doc_id)"""
_SHARES = _SHARES.replace("coalesce(r.n, 0)::DOUBLE / len(w)", "CASE WHEN w IS NOT NULL THEN coalesce(r.n, 0) END / len(w)::DOUBLE")
SQL = {"p9_shares": _SHARES, "p9_found": f"SELECT doc_id FROM ({_SHARES}) WHERE words > 0 AND repeated_words >= {FOUND} * words"}
