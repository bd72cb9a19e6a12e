"""Benchmark decontamination on a positional inverted index, in DataFrame operations only.

Every benchmark item is cut into windows of successive words. The corpus's term counts tell the rarest term of each
window; postings (document, position, neighbouring words) are stored for those terms. A window occurs where, for a
posting of its rarest term, the list entry at every other term's offset holds that term: offset-adjusted intersection,
begun from the shortest list. A proximity match asks only that all its terms lie within the posting's neighbourhood.
Postings stay with their document, so the corpus is never shuffled; what moves is one row per matched window.

Null and empty texts have no words. An item of fewer words than a window is one window; an item without words is never
found. An item without an id is hit like others, but not listed. Repeated documents and items each count. Empty tables give no hits. Columns other than the ids and texts are not
looked at. Texts of any length are one row until their few postings leave them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    """window: words of a window; slop: further words on either side in which proximity matches may find terms;
    broadcast_rows: windows or terms up to which the benchmark's side is sent to every executor (about 300 bytes a row)
    and its rarest terms stand in the plan; a larger benchmark is joined by shuffling both sides."""

    window: int = 10
    slop: int = 0
    broadcast_rows: int = 20_000

    @property
    def reach(self) -> int:
        return self.window - 1 + self.slop


def tokens(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), BETWEEN), "")


def small(df: DataFrame, rows: int, p: Decontamination) -> DataFrame:
    """Marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= p.broadcast_rows else df


def benchmark_windows(items: DataFrame, p: Decontamination) -> DataFrame:
    """terms, items (the ids, as strings, of all items with that window), window_id."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - p.window + 1, F.lit(1)))
    rows = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("t", i, p.window))).alias("terms"))
    grouped = rows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    return stored(grouped.withColumn("window_id", F.monotonically_increasing_id()), "windows")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, p: Decontamination) -> DataFrame:
    """Occurrences, in all documents, of each of the terms. explode_outer: explode would split every text twice, as
    Spark derives a filter on its argument."""
    exploded = docs.select(F.explode_outer(tokens(F.col("text"))).alias("term"))
    return exploded.join(small(terms, n_terms, p), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame, n_terms: int, p: Decontamination) -> DataFrame:
    """Each window with its rarest term and that term's offset; windows with a term that no document has drop out."""
    placed = windows.select("window_id", F.posexplode("terms").alias("offset", "term")).join(small(counts, n_terms, p), "term")
    best = placed.groupBy("window_id").agg(F.count("*").alias("known"), F.min_by(F.struct("term", "offset"), F.struct("n", "offset")).alias("rarest"))
    return windows.join(best, "window_id").filter(F.col("known") == F.size("terms")).select("items", "terms", F.col("rarest.term").alias("term"), F.col("rarest.offset").alias("offset"))


def neighbourhoods(split: DataFrame, positions: Column, p: Decontamination) -> DataFrame:
    """doc_id, tokens and positions -> doc_id, n_words, postings."""
    padding = F.array_repeat(F.lit(None).cast("string"), p.reach)
    padded = split.select("*", positions.alias("positions"), F.concat(padding, "tokens", padding).alias("padded"))
    posting = F.transform("positions", lambda i: F.struct(F.element_at("tokens", i + 1).alias("term"), i.alias("position"), F.slice("padded", i + 1, 2 * p.reach + 1).alias("around")))
    return padded.select("row", "doc_id", F.size("tokens").cast("long").alias("n_words"), posting.alias("postings"))


def positional_index(docs: DataFrame, terms: DataFrame, n_terms: int, p: Decontamination) -> DataFrame:
    """A stored row per document: row, doc_id, n_words and its postings of the terms."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text")).alias("tokens"))
    if n_terms <= p.broadcast_rows:
        held = [r.term for r in terms.collect()]
        places = F.transform("tokens", lambda t, i: F.when(t.isin(held), i)) if held else F.array().cast("array<int>")
        return stored(neighbourhoods(split, F.filter(places, lambda i: i.isNotNull()), p), "postings")
    split = stored(split, "tokens")
    exploded = split.select("row", F.posexplode("tokens").alias("position", "term"))
    positions = exploded.join(terms, "term", "left_semi").groupBy("row").agg(F.collect_list("position").alias("found"))
    return stored(neighbourhoods(split.join(positions, "row", "left"), F.coalesce("found", F.array().cast("array<int>")), p), "postings")


def matches(index: DataFrame, anchors: DataFrame, n_anchors: int, p: Decontamination) -> DataFrame:
    """row, start (of an exact match; null for proximity alone), n_terms, items."""
    spots = index.select("row", F.inline("postings"))
    at = F.col("position") - F.col("offset")
    exact = F.slice("around", F.lit(p.reach + 1) - F.col("offset"), F.size("terms")) == F.col("terms")
    near = F.size(F.array_except("terms", "around")) == 0
    joined = spots.join(small(anchors, n_anchors, p), "term").filter(near)
    return joined.select("row", F.when(exact, at).alias("start"), F.size("terms").alias("n_terms"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, p: Decontamination | None = None) -> DataFrame:
    """A row per document: n_words, n_hit, the sorted ids of the items found exactly, those found or near, and their number."""
    p = p or Decontamination()
    docs = docs.select("doc_id", "text")
    windows = benchmark_windows(items, p)
    n_windows = windows.count()
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    n_terms = min(terms.count(), p.window * n_windows)
    counts = stored(term_counts(docs, terms, n_terms, p), "counts")
    anchors = stored(anchored(windows, counts, n_terms, p), "anchors")
    rare = anchors.select("term").distinct()
    index = positional_index(docs, rare, rare.count(), p)

    found = matches(index, anchors, n_windows, p)
    places = F.filter(F.collect_set(F.struct("start", "n_terms")), lambda s: s["start"].isNotNull())
    spread = F.flatten(F.transform("places", lambda s: F.sequence(s["start"], s["start"] + s["n_terms"] - 1)))
    unique = lambda c: F.array_sort(F.array_distinct(F.flatten(c)))
    hits = found.groupBy("row").agg(places.alias("places"), unique(F.collect_list(F.when(F.col("start").isNotNull(), F.col("items")))).alias("items"), unique(F.collect_list("items")).alias("near_items"))
    hits = hits.select("row", F.size(F.array_distinct(spread)).cast("long").alias("n_hit"), "items", "near_items")
    joined = index.select("row", "doc_id", "n_words").join(hits, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = F.array().cast("array<string>")
    near = F.coalesce("near_items", none)
    return joined.select("doc_id", "n_words", zero("n_hit"), F.coalesce("items", none).alias("items"), near.alias("near_items"), F.size(near).cast("long").alias("n_near"))
