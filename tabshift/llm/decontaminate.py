"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

Test items give windows of WINDOW consecutive words. The corpus is counted once for the words of the items; each window is
then represented by its rarest words (by corpus count), and postings (term, document, position) are stored for those terms.
A posting minus the word's place in the item is the place where the item would begin in the document; places at which the
lists of a window's rarest words meet are candidates. Candidates are few and are verified word by word against their
documents, so the result is exact. ``proximity`` uses the same postings for terms within a span, in any order.

No list is capped. Terms are joined to exploded words by the join that Spark chooses from the staged tables' sizes; candidate
documents are picked from the corpus by a broadcast of their keys only while those are at most BROADCAST_KEYS, else by a
shuffled join.

Defined results: null texts have no words; an item of fewer words than a window, but not none, is one window; an item without
words never matches; rows with equal ids are told apart by their texts, and repeated rows get the same result each; a null
item id counts and is written as an empty string; an empty table gives an empty result, no items leave all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import discard, staged

WINDOW, RAREST = 10, 2
BROADCAST_KEYS = 500_000
#: What parts words: ASCII other than letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BREAK), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h tells rows with one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, iw): one row an item with words."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("iw"))
    return staged(rows.filter(F.size("iw") > 0), "items")


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each of ``terms`` occurs in the whole corpus.

    Words are counted before they meet the terms, by tasks first, so that a common word sends a row a task and a term list of any
    length meets one row a word.
    """
    said = docs.select(F.explode(words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return said.join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, h, pos) of every occurrence of ``terms``."""
    said = _keyed(docs, id_col, text_col).select("id", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return said.join(terms, "term").select("term", "id", "h", "pos")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, needs): for each distinct window its rarest words as (count, term, ipos), ipos their places in the item."""
    at = items.select("item", F.size("iw").alias("n"), F.posexplode("iw").alias("ipos", "term")).join(counts, "term", "left")
    ranked = at.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce(F.col("n_corpus"), F.lit(0)).alias("count"), "term"))).alias("ws"))
    width = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.lit(0), F.col("n") - width)
    rare = lambda s: F.slice(F.array_sort(F.transform(F.slice("ws", s + 1, window), lambda w: F.struct(w["count"].alias("count"), w["term"].alias("term"), w["ipos"].alias("ipos")))), 1, rarest)
    return ranked.select("item", F.array_distinct(F.transform(starts, rare)).alias("needs"))


def candidates(stored: DataFrame, needs: DataFrame) -> DataFrame:
    """(item, id, h, start): places where the offset-adjusted lists of some window's rarest words meet."""
    asked = needs.select("item", F.explode(F.flatten("needs")).alias("a")).select("item", F.col("a.ipos").alias("ipos"), F.col("a.term").alias("term")).distinct()
    adjusted = stored.join(asked, "term").select("item", "id", "h", (F.col("pos") - F.col("ipos")).alias("start"), "ipos")
    met = adjusted.groupBy("item", "id", "h", "start").agg(F.collect_set("ipos").alias("have"))
    pairs = needs.select(F.col("item").alias("n_item"), F.transform("needs", lambda w: F.transform(w, lambda a: a["ipos"])).alias("sets"))
    joined = met.join(pairs, met["item"] == pairs["n_item"])
    return joined.filter(F.exists("sets", lambda s: F.size(F.array_except(s, F.col("have"))) == 0)).select("item", "id", "h", "start")


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """(id, h, spans) of the documents with a verified match; a span is (item_id, at, length)."""
    items = items_of(benchmark, item_id_col, "text")
    vocabulary = staged(items.select(F.explode("iw").alias("term")).distinct(), "vocabulary")
    counts = staged(term_counts(docs, vocabulary, text_col), "term-counts")
    counted = counts.withColumnRenamed("n", "n_corpus")
    needs = staged(anchors(items, counted, window), "anchors")
    # a window with a word that the corpus lacks can't occur
    terms = staged(needs.select(F.explode(F.flatten("needs")).alias("a")).select("a.term").distinct().join(counted, "term").select("term"), "anchor-terms")
    index = staged(postings(docs, terms, id_col, text_col), "postings")
    # an item's words go once to a document, however many places they may stand at
    places = candidates(index, needs).groupBy("item", "id", "h").agg(F.collect_set("start").alias("starts"))
    found = staged(places.join(items, "item").groupBy("id", "h").agg(F.collect_list(F.struct("item_id", "iw", "starts")).alias("found")), "candidates")

    keyed = _keyed(docs, id_col, text_col)
    keys = found.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"))
    if keys.count() <= BROADCAST_KEYS:
        small = F.broadcast(keys)
        keyed = keyed.join(small, keyed["id"].eqNullSafe(small["k_id"]) & (keyed["h"] == small["k_h"]), "left_semi")
    named = found.select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), "found")
    both = keyed.dropDuplicates(["id", "h"]).join(named, keyed["id"].eqNullSafe(named["f_id"]) & (keyed["h"] == named["f_h"]))
    # written, as the functions below would else part the text into words again for every place
    both = staged(both.select("id", "h", words(F.col("text")).alias("dw"), "found"), "candidate-words")
    discard(items, vocabulary, counts, needs, terms, index, found)

    def spans(c: Column) -> Column:
        width = F.least(F.lit(window), F.size(c["iw"]))

        def at(start: Column) -> Column:
            here = F.filter(F.sequence(F.lit(0), F.size(c["iw"]) - width), lambda j: (start + j >= 0) & (F.slice(F.col("dw"), F.greatest(start + j, F.lit(0)) + 1, width) == F.slice(c["iw"], j + 1, width)))
            return F.transform(here, lambda j: F.struct(c["item_id"].alias("item_id"), (start + j).alias("at"), width.alias("length")))

        return F.flatten(F.transform(c["starts"], at))

    return both.select("id", "h", F.flatten(F.transform("found", spans)).alias("spans")).filter(F.size("spans") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = matches(docs, benchmark, window=window, id_col=id_col, text_col=text_col, item_id_col=item_id_col)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.coalesce(s["item_id"], F.lit("")))))
    found = staged(found.select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), hit.cast("long").alias("n_hit"), ids.alias("items")), "hits")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BREAK), "")).cast("long").alias("n_words"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["f_id"]) & (rows["h"] == found["f_h"]), "left")
    none = F.expr("cast(array() as array<string>)")
    items = F.coalesce("items", none)
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark."""
    found = matches(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("id").alias("m_id"), F.col("h").alias("m_h"))
    return docs.join(found, docs[id_col].eqNullSafe(found["m_id"]) & (F.xxhash64(docs[text_col]) == found["m_h"]), "left_anti")


def proximity(stored: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query, id, h, at): the ends of spans of at most ``span`` words in which all terms of a query (query, term) occur."""
    wanted = queries.distinct().withColumn("terms", F.count("*").over(Window.partitionBy("query")))
    near = Window.partitionBy("query", "id", "h").orderBy("pos").rangeBetween(-(span - 1), 0)
    seen = stored.join(wanted, "term").withColumn("seen", F.size(F.collect_set("term").over(near)))
    return seen.filter(F.col("seen") == F.col("terms")).select("query", "id", "h", F.col("pos").alias("at"))
