"""The inverted index: tokens of title, body and category names, term frequencies, tiers and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.functions.text import CATEGORY, ascii_lower, letter_runs, stem, word_number
from loomrank.operators import skew
from loomrank.sources.tables import local_table, saved

TITLE_FLAG, CATEGORY_FLAG = 1, 2
#: From the first category link on: category names, one after another with nothing but non-letters and the bare word between.
CHAIN = rf"^(?:[^a-z]*+(?:(?<=\[){CATEGORY}[^\]]*+(?:\]|\z)|(?<!\[){CATEGORY}))*+"


def body_part(low: Column) -> Column:
    """The text, in lower case already, before its first category link."""
    return F.when(low.contains("[categor"), F.regexp_replace(low, rf"(?s)\[{CATEGORY}.*", "")).otherwise(low)


def category_names(rest: Column) -> Column:
    """The category names of the chain that a text begins with, without the last word of each if it touches the closing bracket."""
    names = F.regexp_extract_all(F.regexp_extract(rest, CHAIN, 0), F.lit(rf"\[{CATEGORY}([^\]]*)"), F.lit(1))
    return F.transform(names, lambda n: F.regexp_replace(n, "[a-z]+$", ""))


def tokens(pages: DataFrame, cfg: EngineConfig = DEFAULT, fields: tuple[str, ...] = ("title", "body", "category")) -> DataFrame:
    """(page_id, field, word): every indexed word occurrence, stop words included, before stemming.

    Text after a category link is not indexed, nor is the word category itself outside titles and names. A page whose
    text begins with # is a redirect and not indexed at all; in a dump the attributes of the tag stand first, so there
    is none.
    """
    pages = pages.where(~F.coalesce("text", F.lit("")).startswith("#"))
    # in steps, so that each part of a text is made once
    low = pages.select("page_id", ascii_lower(F.col("title")).alias("title"), ascii_lower(F.col("text")).alias("low"))
    cut = low.select("page_id", "title", "low", body_part(F.col("low")).alias("body"))
    rest = F.when(F.length("body") < F.length("low"), F.substring("low", F.length("body") + 1, F.length("low")))
    cut = cut.select("page_id", "title", "body", rest.alias("rest"))
    body = F.when(F.col("body").contains("categor"), F.regexp_replace("body", f"(?<![a-z]){CATEGORY}", " ")).otherwise(F.col("body"))
    name = F.flatten(F.transform(category_names(F.col("rest")), lambda n: letter_runs(n, cfg.body_letters)))
    words = {"title": letter_runs(F.col("title"), cfg.title_letters), "body": letter_runs(body, cfg.body_letters), "category": name}
    each = F.array(*[F.struct(F.lit(f).alias("field"), words[f].alias("words")) for f in fields])
    return cut.select("page_id", F.explode(each).alias("f")).select("page_id", "f.field", F.explode("f.words").alias("word"))


_STOPS: dict[tuple, list[str]] = {}


def stop_stems(spark, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(stem): the stems of the stop words; further words with these stems are stopped too.

    The list is stemmed once a process: it is a parameter, and small.
    """
    key = cfg.stop_words, cfg.full_stemmer
    if key not in _STOPS:
        words = local_table(spark, [(w,) for w in cfg.stop_words if w.isascii() and w.isalpha()], "word string")
        _STOPS[key] = sorted({r["stem"] for r in words.select(stem(ascii_lower(F.col("word")), cfg.full_stemmer).alias("stem")).collect()})
    return local_table(spark, [(x,) for x in _STOPS[key]], "stem string")


def stems_of(counted: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """counted (with a column word) with the stem of each word; words whose stem is a stop word's are dropped.

    Only distinct words are stemmed, and joined back: by broadcast while they are few; beyond that common words by
    broadcast, as each stands on most pages, and the rest by a shuffle join.
    """
    # saved before the stop list is applied: the planner would otherwise stem every row to apply it early
    stemmed = saved(counted.select("word").distinct().withColumn("stem", stem(F.col("word"), cfg.full_stemmer)), "stems")
    stops = stop_stems(counted.sparkSession, cfg)
    return skew.lookup(counted, stemmed.join(F.broadcast(stops), "stem", "left_anti"), "word")  # the list is a parameter, and small


def term_freq(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(stem, page_id, freq, in_title, in_category): title, body and category occurrences of a stem add up.

    Occurrences are counted per page and word before anything is stemmed, where they stand together.
    """
    counted = tokens(pages, cfg).groupBy("page_id", "word").agg(
        F.count("*").alias("n"),
        F.bit_or(F.when(F.col("field") == "title", TITLE_FLAG).when(F.col("field") == "category", CATEGORY_FLAG).otherwise(0)).alias("flags"),
    )
    stemmed = stems_of(saved(counted, "words"), cfg)
    once = stemmed.groupBy("page_id", "stem").agg(F.sum("n").cast("int").alias("freq"), F.bit_or("flags").alias("flags"))
    return once.select("stem", "page_id", "freq", ((F.col("flags") % 2) == 1).alias("in_title"), (F.col("flags") >= 2).alias("in_category"))


def tier(cfg: EngineConfig = DEFAULT) -> Column:
    return F.when(F.col("in_title"), "title").when(F.col("in_category"), "category").when(F.col("freq") < cfg.high_from, "low").otherwise("high")


def postings_of(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(stem, page_id, freq, in_title, in_category, tier): every posting has one tier."""
    return term_freq(pages, cfg).withColumn("tier", tier(cfg))


def posting_pack() -> Column:
    """Frequency and flags in one number: freq * 4, plus 1 for title and 2 for category."""
    flags = F.col("in_title").cast("int") * TITLE_FLAG + F.col("in_category").cast("int") * CATEGORY_FLAG
    return F.shiftleft(F.col("freq"), 2).bitwiseOR(flags)


def posting_unpack(payload: Column) -> tuple[Column, Column, Column]:
    """(freq, in_title, in_category) of a number of posting_pack."""
    return F.shiftright(payload, 2), payload.bitwiseAND(TITLE_FLAG) > 0, payload.bitwiseAND(CATEGORY_FLAG) > 0


def inverted_index(postings: DataFrame, length: int = 50_000) -> DataFrame:
    """(stem, tier, segment, n, items): the sorted lists of every stem; low lists stand under low1, low2 and so on by frequency."""
    name = F.when(F.col("tier") == "low", F.concat(F.lit("low"), F.col("freq").cast("string"))).otherwise(F.col("tier"))
    rows = postings.select(F.concat_ws("|", "stem", name).alias("k"), "page_id", "freq")
    lists = skew.per_key_lists(rows, "k", "page_id", "freq", F.struct("page_id", "freq"), length)
    part = lambda i: F.split("k", r"\|")[i]
    return lists.select(part(0).alias("stem"), part(1).alias("tier"), "segment", "n", "items")


def low_lists(postings: DataFrame, length: int = 50_000) -> DataFrame:
    """(stem, freq, segment, n, items): the pages of every stem by exact low frequency."""
    lists = inverted_index(postings.where(F.col("tier") == "low"), length)
    return lists.select("stem", F.substring("tier", 4, 10).cast("int").alias("freq"), "segment", "n", F.transform("items", lambda x: x["page_id"]).alias("items"))


def dictionary(postings: DataFrame) -> DataFrame:
    """(stem, pages, searchable, title_pages, category_pages): pages of every stem; those of its title, category and high
    lists; and those of the title and of the category list."""
    of = lambda tier: F.count(F.when(F.col("tier") == tier, 1))
    counts = [F.count("*").alias("pages"), F.count(F.when(F.col("tier") != "low", 1)).alias("searchable")]
    return postings.groupBy("stem").agg(*counts, of("title").alias("title_pages"), of("category").alias("category_pages"))


def write_index(postings: DataFrame, path: str) -> None:
    """Postings as Parquet by tier, sorted by stem within files, so that a search reads few row groups and no low lists."""
    postings.repartitionByRange("stem", "page_id").sortWithinPartitions("tier", "stem", "page_id").write.partitionBy("tier").mode("overwrite").parquet(path)


def write_dictionary(postings: DataFrame, path: str) -> None:
    """The dictionary with the number of every stem, in the order of numbers."""
    numbered = dictionary(postings).withColumn("number", word_number(F.col("stem")))
    numbered.repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(path)
