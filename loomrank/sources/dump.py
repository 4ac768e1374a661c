"""Wiki dumps: page records from XML files or from tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.sources.tables import saved, spread

#: What stands between `<text` and the text of a page in a dump, and is part of what is indexed.
TEXT_TAG = ' xml:space="preserve">'


def title_of(raw: Column) -> Column:
    """The title of a page record; '' if there is none."""
    return F.regexp_extract(raw, "<title[^>]*>([^<]*)<", 1)


def text_of(raw: Column) -> Column:
    """What follows `<text` up to the next `<`: the attributes of the tag are part of it, as in the index."""
    return F.regexp_extract(raw, "<text([^<]*)<", 1)


def read_dump(spark: SparkSession, path: str, names: str = "x*") -> DataFrame:
    """(file_name, block, raw): the page records of the XML files of a folder whose names match.

    Files are split at the end of a page, so that large files are read by many tasks; block is where a task's part of
    the file begins. Text after the last page is dropped. Within a block the order of the rows is that of the file.
    """
    lines = spark.read.option("lineSep", "</page>").option("pathGlobFilter", names).text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = lines.select(name.alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))
    return rows.where(F.col("raw").contains("<page"))


def first_ids(pages: DataFrame) -> DataFrame:
    """(file_name, first_id): the number of each file's first page, counting from 1 in the order of file names."""
    sizes = pages.groupBy("file_name").agg(F.count("*").alias("n"))
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return sizes.select("file_name", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first_id"))


def numbered(records: DataFrame) -> DataFrame:
    """(page_id, file_name, seq, title, text) of the records of read_dump: numbered from 1 over files by name, and within
    them by place; seq counts the pages of a file from 0.

    The dump is read once: titles and texts are saved with a number that ascends within a block, and the places follow
    from narrow columns of what was saved. Only a row per block is sorted.
    """
    at = F.monotonically_increasing_id().alias("at")
    rows = saved(records.select("file_name", "block", at, title_of(F.col("raw")).alias("title"), text_of(F.col("raw")).alias("text")), "records")
    blocks = rows.groupBy("file_name", "block").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    order = Window.orderBy("file_name", "block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    key = F.concat_ws("|", F.col("block").cast("string"), "file_name")
    first = saved(blocks.select(key.alias("_k"), "start", (before(order) + 1).alias("first"), before(inside).alias("first_seq")), "blocks")
    placed = skew.lookup(rows.withColumn("_k", key), first, "_k").withColumn("_at", F.col("at") - F.col("start"))
    return placed.select((F.col("first") + F.col("_at")).alias("page_id"), "file_name", (F.col("first_seq") + F.col("_at")).alias("seq"), "title", "text")


def escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def delivered_once(rows: DataFrame, key: str, columns: list[str], loaded: str = "loaded_at") -> DataFrame:
    """`columns` of rows, one row per key: the first loaded. Rows without key are left out.

    For rows read from files only narrow columns are grouped: they tell which keys stand there repeatedly, and which row
    of these is the first; all else is filtered as it is read, without a shuffle while the repeated keys are few enough
    to be broadcast. Other rows are grouped whole.
    """
    rows, key_ = rows.where(F.col(key).isNotNull()), F.col(key)
    path = F.col("_metadata.file_path")
    place = [F.xxhash64(path).alias("_file"), F.xxhash64(F.lit(1), path).alias("_file2"), F.col("_metadata.row_index").alias("_row")]  # 128 bits of the path
    try:
        at = rows.select(*{key: 0, **dict.fromkeys(columns)}, F.col(loaded).alias("_loaded"), *place)
    except AnalysisException:  # not from files
        first = F.min(F.struct(F.col(loaded).alias("_loaded"), *[c for c in columns if c != key])).alias("_r")
        return rows.groupBy(key).agg(first).select(*[key_ if c == key else F.col(f"_r.{c}") for c in columns])
    again = saved(rows.groupBy(key).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return at.select(columns)
    first = skew.lookup(at.select(key, "_loaded", "_file", "_file2", "_row"), again, key).groupBy(key).agg(F.min(F.struct("_loaded", "_file", "_file2", "_row")).alias("_r"))
    first = saved(first.select(key, F.struct("_r._file", "_r._file2", "_r._row").alias("_first")), "first_rows")
    return skew.lookup(at, first, key, "left").where(F.col("_first").isNull() | (F.col("_first") == F.struct("_file", "_file2", "_row"))).select(columns)


def records(page: DataFrame) -> DataFrame:
    """(page_id, file_name, seq, raw): the rows of the table page as page records of a dump, every page once."""
    title, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "text"))
    raw = F.concat(F.lit("<page><title>"), title, F.lit(f"</title><text{TEXT_TAG}"), text, F.lit("</text></page>"))
    return spread(delivered_once(page, "page_id", ["page_id", "file_name", "seq", "title", "text"]), "page_id", page).select("page_id", "file_name", "seq", raw.alias("raw"))


def pages(page: DataFrame) -> DataFrame:
    """(page_id, title, text): what title_of and text_of give for records(page), but titles without reading the texts."""
    title, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "text"))
    once = spread(delivered_once(page, "page_id", ["page_id", "title", "text"]), "page_id", page)
    return once.select("page_id", title.alias("title"), F.concat(F.lit(TEXT_TAG), text).alias("text"))


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words of a stop list, one per line; entries with other characters than letters match no token and are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where(F.col("w").rlike("^[A-Za-z]+$")).distinct().collect()
    return tuple(sorted(r["w"].lower() for r in rows))
