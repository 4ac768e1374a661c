"""The engine's operators as queries over the tables, with the same results in SQL.

Text operators run over page, rendered as the records of a dump; graph operators over edges and page; list and
search operators over postings, pageranks, query_terms and queries, and, where they need flags, over page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.config import DEFAULT, EngineConfig
from loomrank.functions import codec, text
from loomrank.operators import index, links, pagerank, search, skew
from loomrank.operators.postings import TIERS, distinct_postings
from loomrank.plans.reference_sql import SQL as _SQL
from loomrank.sources import dump
from loomrank.sources.tables import local_table, new_path, saved, settled, table

SQL = dict(_SQL)
ROUNDS = 4
FIELDS = EngineConfig(enforce_fields=True)


def _pages(s: SparkSession, d: str) -> DataFrame:
    return dump.pages(table(s, d, "page"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return dump.records(table(s, d, "page"))


def scan_pages(s, d):
    return _records(s, d).select("page_id", "file_name", "seq", F.length("raw").alias("raw_length"))


def page_count(s, d):
    """N + 1, as the index stores it."""
    return table(s, d, "page").where("page_id is not null").agg((F.count_distinct("page_id") + 1).alias("stored_pages"))


def page_id_offsets(s, d):
    return dump.first_ids(_records(s, d))


def extract_title(s, d):
    return _records(s, d).select("page_id", dump.title_of(F.col("raw")).alias("title"))


def extract_text(s, d):
    return _records(s, d).select("page_id", dump.text_of(F.col("raw")).alias("text"))


def dump_round_trip(s, d):
    """The records written as XML files in the order of file_name and seq, read back and numbered."""
    path, rows = new_path(s, "dump"), _records(s, d)
    rows.repartitionByRange("file_name", "seq", "page_id").sortWithinPartitions("file_name", "seq", "page_id").select(F.concat("raw", F.lit("\n"))).write.text(path)
    return dump.numbered(dump.read_dump(s, path, "part-*")).select("page_id", "title", F.length("text").alias("text_length"))


def redirect_filter(s, d):
    """Pages whose text group, the attributes of its tag included, does not begin with #."""
    return _pages(s, d).where(~F.col("text").startswith("#")).select("page_id")


def redirect_plain(s, d):
    """Pages whose text without a tag does not begin with #."""
    return table(s, d, "page").where(~F.coalesce("text", F.lit("")).startswith("#")).select("page_id").distinct()


def ascii_lower(s, d):
    return table(s, d, "page").where("title is not null").select("page_id", text.ascii_lower(F.col("title")).alias("title_lc")).distinct()


def tokenize(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(text.letter_runs(text.ascii_lower(F.col("text")), 63)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _vocabulary(s, d):
    return index.tokens(_pages(s, d)).select("word").distinct()


def porter_measure(s, d):
    of = text.shape(F.col("word"))
    return _vocabulary(s, d).select("word", of.alias("shape")).withColumn("m", text.measure(F.col("shape")))


def stem(s, d):
    return _vocabulary(s, d).select("word", text.stem(F.col("word")).alias("stem"))


def stem_full(s, d):
    return _vocabulary(s, d).select("word", text.stem(F.col("word"), True).alias("stem"))


def word_hash(s, d):
    return _vocabulary(s, d).select("word", text.word_number(F.col("word")).cast("string").alias("number"))


def word_unhash(s, d):
    return table(s, d, "postings").where("word_val is not null").select("word_val").distinct().select("word_val", text.word_of_number(F.col("word_val")).alias("word"))


def title_hash(s, d):
    return table(s, d, "page").where("title is not null").select("title").distinct().select("title", text.title_number(F.col("title")).cast("string").alias("number"))


def stop_stems(s, d):
    return index.stop_stems(s)


def _field_tokens(field):
    return lambda s, d: index.tokens(_pages(s, d), fields=(field,)).groupBy("page_id", "word").agg(F.count("*").alias("n"))


def tokens_nostop(s, d):
    t = index.tokens(_pages(s, d)).groupBy("page_id", "field", "word").agg(F.count("*").alias("n"))
    return index.stems_of(saved(t, "words")).groupBy("page_id", "field", "stem").agg(F.sum("n").alias("n"))


def term_freq(s, d):
    return index.term_freq(_pages(s, d))


def posting_pack(s, d):
    return index.term_freq(_pages(s, d)).select("stem", "page_id", index.posting_pack().alias("payload"))


def posting_unpack(s, d):
    """The numbers of posting_pack for the given postings, and what is unpacked from them."""
    rows = _tiered(s, d).where("freq is not null").select("word_val", "page_id", "freq", (F.col("tier") == "title").alias("in_title"), (F.col("tier") == "category").alias("in_category"))
    freq, title, category = index.posting_unpack(F.col("payload"))
    return rows.select("word_val", "page_id", index.posting_pack().alias("payload")).select("word_val", "page_id", "payload", freq.alias("freq"), title.alias("in_title"), category.alias("in_category"))


def vocabulary_size(s, d):
    """(words, postings) of the index over page."""
    return index.dictionary(index.postings_of(_pages(s, d))).agg(F.count("*").alias("words"), F.sum("pages").alias("postings"))


def posting_tier(s, d):
    return index.postings_of(_pages(s, d)).select("stem", "page_id", "freq", "tier")


def _told(df: DataFrame, column: str) -> DataFrame:
    """A list as one string."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


def inverted_index(s, d):
    lists = index.inverted_index(saved(index.postings_of(_pages(s, d)), "postings"))
    return _told(lists.withColumn("items", F.transform("items", lambda x: F.concat_ws(":", x["page_id"], x["freq"]))), "items")


def low_lists(s, d):
    return _told(index.low_lists(saved(index.postings_of(_pages(s, d)), "postings")), "items")


def dictionary(s, d):
    return index.dictionary(index.postings_of(_pages(s, d))).select("stem", "pages", "searchable")


def _tiered(s, d):
    """The given postings with tier names."""
    names = F.array(*[F.lit(t) for t in (*TIERS, "other")])
    return distinct_postings(table(s, d, "postings")).withColumn("tier", F.get(names, F.col("tier_no"))).drop("tier_no")


def posting_lists(s, d):
    """The lists of posting_list, put together from postings: pages and known occurrences by tier."""
    return _tiered(s, d).groupBy("word_val", "tier").agg(F.count("*").alias("pages"), F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"))


def nested_lists(s, d):
    """posting_list unnested to (word_val, tier, page_id, freq)."""
    t = table(s, d, "posting_list").where("word_val is not null")
    parts = [t.select("word_val", F.lit(k).alias("tier"), F.explode(f"{k}_list").alias("x")).select("word_val", "tier", "x.page_id", "x.freq") for k in TIERS[:3]]
    low = t.select("word_val", F.posexplode("low_list").alias("freq", "ids")).select("word_val", F.lit("low").alias("tier"), F.explode("ids").alias("page_id"), "freq")
    out = parts[0]
    for p in (*parts[1:], low):
        out = out.unionByName(p)
    return out


def doc_freq(s, d):
    return _tiered(s, d).where("tier <> 'low'").groupBy("word_val").agg(F.count("*").alias("searchable_pages"))


def title_offsets(s, d):
    """Byte offsets of the stored titles within their file, each closed by one byte."""
    t = _records(s, d).select("file_name", "seq", "page_id", (F.octet_length(dump.title_of(F.col("raw"))) + 1).cast("bigint").alias("size"))
    return skew.running_sum(t, "file_name", [F.col("seq"), F.col("page_id")], F.col("size"), "title_offset").select("page_id", "size", "title_offset")


def _lists_of_all(s, d):
    """(word_val, tier, freq, segment, items): the title, category and high list of every word, and its low lists by freq."""
    freq = F.when(F.col("tier") == "low", F.col("freq").cast("string"))
    rows = _tiered(s, d).select(F.concat_ws("|", F.col("word_val").cast("string"), "tier", freq).alias("k"), "page_id", F.lit(0).alias("load"))
    lists = skew.per_key_lists(rows, "k", "page_id", "load", F.col("page_id"))
    part = lambda i: F.get(F.split("k", r"\|"), F.lit(i))
    return lists.select(part(0).cast("bigint").alias("word_val"), part(1).alias("tier"), part(2).cast("int").alias("freq"), "segment", "items")


def _gaps_of_all(s, d):
    return _lists_of_all(s, d).withColumn("gaps", text.deltas(F.col("items"))).drop("items")


def delta_encode(s, d):
    """The gaps of the lists of all tiers, the low ones by freq. Every list starts anew, also the low ones, whose gaps the reference carries on from freq to freq."""
    return _told(_gaps_of_all(s, d), "gaps")


def delta_decode(s, d):
    return _told(_gaps_of_all(s, d).withColumn("ids", text.undeltas(F.col("gaps"))).drop("gaps"), "ids")


def delta_backlinks(s, d):
    return _told(links.backlinks(table(s, d, "edges")).select("dst", "segment", text.deltas(F.col("items")).alias("gaps")), "gaps")


def _hex(c):
    return F.lower(F.hex(c))


def _links_to(s, d):
    return table(s, d, "edges").where("dst is not null")


def varint_encode(s, d):
    return _links_to(s, d).select(F.col("dst").alias("n")).distinct().withColumn("bytes", _hex(codec.varint("n")))


def signed_encode(s, d):
    return _links_to(s, d).select((F.col("dst") - F.col("src")).alias("n")).distinct().withColumn("bytes", _hex(codec.signed("n")))


def varint_round_trip(s, d):
    """Numbers of every size and sign, squares of distances in the graph among them, through both encodings."""
    far = F.col("dst") - F.col("src")
    rows = _links_to(s, d).select(far.alias("n")).union(_links_to(s, d).select(far * far * far)).distinct()
    return rows.withColumn("back", codec.unsigned(codec.signed("n"))).withColumn("plain", codec.unvarint(codec.varint("n")))


def byte_encode(s, d):
    rows = table(s, d, "postings").select("freq").distinct()
    return rows.withColumn("bytes", _hex(codec.byte(F.col("freq")))).withColumn("back", codec.unbyte(codec.byte(F.col("freq"))))


def short_encode(s, d):
    rows = table(s, d, "documents").select("n_chars").distinct()
    return rows.withColumn("bytes", _hex(codec.short(F.col("n_chars")))).withColumn("back", codec.unshort(codec.short(F.col("n_chars"))))


def double_round_trip(s, d):
    rows = table(s, d, "pageranks").where("pr is null or not isnan(pr)").select("pr").distinct()
    return rows.withColumn("size", F.octet_length(codec.double("pr"))).withColumn("back", codec.undouble(codec.double("pr")))


def packed_words(s, d):
    return _vocabulary(s, d).withColumn("bytes", _hex(codec.packed_word(F.col("word")))).withColumn("back", codec.unpacked_word(codec.packed_word(F.col("word"))))


def text_encode(s, d):
    rows = table(s, d, "page").select("title").distinct()
    return rows.withColumn("bytes", _hex(codec.text_bytes(F.col("title")))).withColumn("back", codec.text_of_bytes(codec.text_bytes(F.col("title"))))


def backlink_bytes(s, d):
    """The lists of back-links as bytes, and the offset of each where they stand one after another in the order of dst."""
    rows = links.backlinks(table(s, d, "edges")).select("dst", "segment", codec.gaps("items").alias("bytes"), F.lit(0).alias("file"))
    at = skew.running_sum(rows, "file", [F.col("dst"), F.col("segment")], F.octet_length("bytes").cast("bigint"), "byte_offset")
    return at.select("dst", "segment", _hex("bytes").alias("bytes"), "byte_offset")


def extract_links(s, d):
    return links.extract_links(_pages(s, d)).groupBy("src", "target").agg(F.count("*").alias("n"))


def title_dict(s, d):
    return links.title_dict(_pages(s, d))


def resolve_links(s, d):
    p = _pages(s, d)
    return links.resolve_links(links.extract_links(p), p).groupBy("src", "dst", "target").agg(F.count("*").alias("n"))


def unresolved_links(s, d):
    p = _pages(s, d)
    return links.unresolved_links(links.extract_links(p), p).groupBy("src", "target").agg(F.count("*").alias("n"))


def page_edges(s, d):
    p = _pages(s, d)
    return links.distinct_edges(links.resolve_links(links.extract_links(p), p))


def edges(s, d):
    return links.distinct_edges(table(s, d, "edges"))


def out_degree(s, d):
    return links.out_degree(table(s, d, "edges"), table(s, d, "page"))


def backlinks(s, d):
    return _told(links.backlinks(table(s, d, "edges")), "items")


def terms_per_file(s, d):
    """(file_name, terms, postings): what each file of the dump gives to the index."""
    page = dump.delivered_once(table(s, d, "page"), "page_id", ["page_id", "file_name"])
    counts = index.term_freq(_pages(s, d)).join(page, "page_id").groupBy("file_name", "stem").agg(F.count("*").alias("n"))
    return counts.groupBy("file_name").agg(F.count("*").alias("terms"), F.sum("n").alias("postings"))


def resolve_by_number(s, d):
    p, cfg = _pages(s, d), EngineConfig(match_by_number=True)
    return links.resolve_links(links.extract_links(p), p, cfg).groupBy("src", "dst", "target").agg(F.count("*").alias("n"))


def corpus_stats(s, d):
    return links.corpus_stats(_pages(s, d))


def pagerank_init(s, d):
    return pagerank.start(table(s, d, "page")).select("page_id", F.round("pr", 12).alias("pr"))


def _ranks(rounds):
    def run(s, d):
        r = pagerank.pagerank(table(s, d, "edges"), table(s, d, "page"), rounds=rounds)
        return r.select("page_id", F.round("pr", 12).alias("pr"))

    return run


def pagerank_residuals(s, d):
    """(round, residual): the sum of squared changes of every round."""
    seen: list[float] = []
    pagerank.pagerank(table(s, d, "edges"), table(s, d, "page"), residuals=seen)
    return local_table(s, [(i, round(r, 12)) for i, r in enumerate(seen)], "round int, residual double")


def parse_query(s, d):
    return search.parse_query(table(s, d, "queries"))


def _dictionary_terms(s, d):
    words = table(s, d, "postings").where("word_val is not null and page_id is not null").select("word_val").distinct()
    return saved(words.select("word_val", text.word_of_number(F.col("word_val")).alias("stem")), "words")


def lookup_exact(s, d):
    terms = search.parse_query(table(s, d, "queries")).select("query_id", "pos", "stem")
    return skew.lookup(terms, _dictionary_terms(s, d), "stem").select("query_id", "pos", "stem")


def lookup_lower_bound(s, d):
    return search.next_words(search.parse_query(table(s, d, "queries")), _dictionary_terms(s, d)).select("query_id", "pos", "stem")


def lookup_first_dropped(s, d):
    """lookup_lower_bound without terms that became the first word of the dictionary, for queries and the words before them."""
    terms = search.parse_query(table(s, d, "queries"))
    terms = terms.unionByName(terms.withColumn("pos", F.col("pos") + 1000).withColumn("stem", F.concat(F.lit("a"), F.left("stem", F.lit(1)))))
    return search.next_words(terms, _dictionary_terms(s, d), drop_first=True).select("query_id", "pos", "stem")


def _postings(s, d):
    """The given postings as an index; their number stands for the stem."""
    return _tiered(s, d).select(F.col("word_val").alias("stem"), "page_id", F.coalesce("freq", F.lit(0)).alias("freq"), "tier")


def _terms(s, d):
    t = table(s, d, "query_terms").select("query_id", "pos", F.lit(7).alias("flags"), F.col("word_val").alias("stem"))
    return t.where("query_id is not null and stem is not null")


def _numbered(terms: DataFrame) -> DataFrame:
    """Parsed terms with the number of their stem; above 13 letters none, as no word of the postings is so long."""
    return terms.withColumn("stem", F.when(F.length("stem") <= 13, text.word_number(F.col("stem")).cast("bigint")))


def lookup_postings(s, d):
    return search.named(_tiered(s, d).where("tier <> 'low'"), "word_val", table(s, d, "query_terms"), "words")


def merge_high_list(s, d):
    return search.searchable(_postings(s, d)).select(F.col("stem").alias("word_val"), "page_id", search.merged_weight().alias("weight"))


def idf_weight(s, d):
    terms = settled(_terms(s, d), "terms")
    lists = index.dictionary(search.named(_postings(s, d), "stem", terms, "stems"))
    return search.weighted_terms(terms, lists).where("g is not null").select("query_id", "pos", "list_pages", "g")


def intersect_two(s, d):
    """Pages that the first two words of a query share, with their weights."""
    h = search.hits(_terms(s, d), _postings(s, d)).where("pos < 2")
    two = h.groupBy("query_id", "page_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return two.where("n = 2").select("query_id", "page_id", "weight")


def intersect_pages(s, d):
    return conjunctive_search(s, d).select("query_id", "page_id")


def conjunctive_search(s, d):
    return search.conjunctive(_terms(s, d), _postings(s, d))


def _usable(s, d):
    t = table(s, d, "pageranks").where("page_id is not null and pr is not null and not isnan(pr)")
    return t.groupBy("page_id").agg(F.max("pr").alias("pr"))


def rank_list(s, d):
    best = search.rank_list(search.conjunctive(_terms(s, d), _postings(s, d)), _usable(s, d))
    return best.withColumn("score", F.round("score", 9))


def fetch_title(s, d):
    ids = table(s, d, "pageranks").where("page_id is not null").select("page_id").distinct()
    return ids.join(_pages(s, d).select("page_id", text.ascii_lower(F.col("title")).alias("title")), "page_id")


def _searched(cfg: EngineConfig, query: str | None = None):
    def run(s, d):
        queries = table(s, d, "queries") if query is None else local_table(s, [(0, query)], "query_id bigint, query_text string")
        got = search.answer(_numbered(search.parse_query(queries, cfg)), _postings(s, d), _usable(s, d), _pages(s, d), cfg)
        return got.select("query_id", "rank", "page_id", "title", F.round("score", 9).alias("score"))

    return run


def search_lower_bound(s, d):
    """search_batch where an unknown word becomes the next of the dictionary."""
    terms = search.next_words(search.parse_query(table(s, d, "queries")), _dictionary_terms(s, d))
    got = search.answer(_numbered(terms), _postings(s, d), _usable(s, d), _pages(s, d))
    return got.select("query_id", "rank", "page_id", "title", F.round("score", 9).alias("score"))


def engine(s, d):
    """The whole engine on the pages of the table: links, ranks, index, and as queries the titles of the pages whose number
    50 divides, against all pages. Ranks are rounded, so that those that are equal but for the order of a sum are equal."""
    e = search.Engine(s).build(_pages(s, d))
    e.ranks = e.ranks.select("page_id", F.round("pr", 12).alias("pr"))
    asked = e.titles.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.col("title").alias("query_text"))
    return e.search_batch(asked).withColumn("score", F.round("score", 9))


def _reloaded(s, d, *names: str):
    """An engine of the given tables, saved and loaded again; names: those needed."""
    tables = {"titles": lambda: _pages(s, d).select("page_id", "title"), "edges": lambda: links.distinct_edges(table(s, d, "edges")),
              "degrees": lambda: links.out_degree(table(s, d, "edges"), table(s, d, "page")), "ranks": lambda: _usable(s, d),
              "files": lambda: dump.first_ids(dump.delivered_once(table(s, d, "page"), "page_id", ["page_id", "file_name"]))}
    rows = skew.lookup(_tiered(s, d), _dictionary_terms(s, d), "word_val").withColumn("freq", F.coalesce("freq", F.lit(0)))
    path = new_path(s, "index")
    search.Engine(s, postings=rows.select("stem", "page_id", "freq", "tier"), **{n: tables[n]() for n in names}).save(path)
    return search.Engine.load(s, path)


def search_saved(s, d):
    got = _reloaded(s, d, "titles", "ranks").search_batch(table(s, d, "queries"))
    return got.select("query_id", "rank", "page_id", "title", F.round("score", 9).alias("score"))


def saved_dictionary(s, d):
    return _reloaded(s, d).dictionary.select("stem", "pages", "searchable", F.col("number").cast("string").alias("number"))


def saved_postings(s, d):
    return _reloaded(s, d).postings


def saved_titles(s, d):
    return _reloaded(s, d, "titles").titles


def saved_degrees(s, d):
    return _reloaded(s, d, "degrees").degrees


def saved_backlinks(s, d):
    return _reloaded(s, d, "edges").edges.select("dst", "src")


def saved_ranks(s, d):
    return _reloaded(s, d, "ranks").ranks


def saved_page_stats(s, d):
    return _reloaded(s, d, "files").files


QUERIES = {f.__name__: f for f in (
    scan_pages, dump_round_trip, page_count, page_id_offsets, extract_title, extract_text, redirect_filter, redirect_plain, ascii_lower, tokenize, porter_measure,
    stem, stem_full, word_hash, word_unhash, title_hash, stop_stems, tokens_nostop, term_freq, posting_pack, posting_unpack, posting_tier, inverted_index, low_lists,
    dictionary, vocabulary_size, posting_lists, nested_lists, doc_freq, title_offsets, delta_encode, delta_decode, delta_backlinks, varint_encode, signed_encode, varint_round_trip, byte_encode, short_encode, double_round_trip, packed_words, text_encode, backlink_bytes,
    extract_links, title_dict, resolve_links, unresolved_links, page_edges, edges, out_degree, backlinks, corpus_stats, terms_per_file, resolve_by_number, pagerank_init, pagerank_residuals,
    parse_query, lookup_exact, lookup_lower_bound, lookup_first_dropped, lookup_postings, merge_high_list, idf_weight, intersect_two, intersect_pages,
    conjunctive_search, rank_list, fetch_title, engine, search_lower_bound, search_saved, saved_dictionary, saved_postings, saved_titles, saved_degrees, saved_backlinks, saved_ranks,
    saved_page_stats,
)}
QUERIES |= {f"{f}_tokens": _field_tokens(f) for f in ("title", "body", "category")}
QUERIES |= {
    "pagerank_step": _ranks(1), "pagerank_rounds": _ranks(ROUNDS), "pagerank": _ranks(None), "search_topk": _searched(DEFAULT, "list of c:stub"),
    "search_batch": _searched(DEFAULT), "search_fields": _searched(FIELDS), "search_low": _searched(EngineConfig(include_low=True)),
}
