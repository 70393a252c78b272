"""Document outlines: chapters, trims, skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

MAIN = "main"
TITLE_LENGTH = 120


def chapter_of(items: DataFrame, outline: DataFrame, *, key: str = "doc_id", at: str = "chunk_idx") -> DataFrame:
    """items with chapter: the heading of the last level-1 section at or before each item.

    items(key, at, ...), outline(key, ord, position, level, heading). Items before all chapters belong to the
    first one; without any chapter the name is "main". Both sides go into one sorted pass by key: the
    last non-null heading up to a row is the answer, so no pair of item and section is ever formed.
    """
    top = outline.where("level = 1")
    # of sections at one position, the one listed last holds
    marks = top.groupBy(key, F.col("position").alias("_at")).agg(F.max_by("heading", "ord").alias("_heading"))
    fields = [c for c in items.columns if c != key]
    left = marks.select(key, "_at", F.lit(0).alias("_side"), "_heading", *(F.lit(None).cast(items.schema[c].dataType).alias(c) for c in fields))
    right = items.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_heading"), *fields)
    both = left.unionByName(right)
    so_far = F.last("_heading", ignorenulls=True).over(W.partitionBy(key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0))
    first = F.first("_heading", ignorenulls=True).over(W.partitionBy(key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = both.withColumn("chapter", F.coalesce(so_far, first, F.lit(MAIN)))
    return found.where("_side = 1").select(*items.columns, "chapter")


def outline_starts(items: DataFrame, outline: DataFrame, *, key: str = "doc_id", at: str = "chunk_idx") -> DataFrame:
    """key, at, start: for each distinct item the position of its chapter, from which its part of the outline begins.

    The last level-1 section at or before the item, else the first one, else 0; in one sorted pass by key.
    """
    marks = outline.where("level = 1").select(key, F.col("position").alias("_at"), F.lit(0).alias("_side"), F.col("position").alias("start")).distinct()
    rows = items.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(outline.schema["position"].dataType).alias("start")).distinct()
    order = W.partitionBy(key).orderBy("_at", "_side")
    so_far = F.last("start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    first = F.min("start").over(W.partitionBy(key))
    found = marks.union(rows).withColumn("start", F.coalesce(so_far, first, F.lit(0)))
    return found.where("_side = 1").select(key, F.col("_at").cast(items.schema[at].dataType).alias(at), "start")


def outlines_from(starts: DataFrame, outline: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, start, ord, heading: all level-1 sections and whatever stands at or after `start`, once for each start of a key."""
    return starts.select(key, "start").distinct().join(outline, key).where((F.col("level") == 1) | (F.col("position") >= F.col("start"))).select(key, "start", "ord", "heading")


def trimmed_outline(items: DataFrame, outline: DataFrame, *, key: str = "doc_id", at: str = "chunk_idx") -> DataFrame:
    """key, at, ord, heading: for each item, all level-1 sections and whatever stands at or after its chapter's position.

    This has a row for each item and section; where many items share a chapter, outline_starts() and outlines_from() say the same
    with a row for each chapter and section.
    """
    starts = outline_starts(items, outline, key=key, at=at)
    return starts.join(outlines_from(starts, outline, key=key), [key, "start"]).select(key, at, "ord", "heading")


def level_histogram(outline: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, level, sections."""
    return outline.groupBy(key, "level").agg(F.count("*").alias("sections"))


def skeleton(toc: DataFrame, titles: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, title: the document's own title, else its first level-1 heading, else its first heading; cut to 120.

    toc(key, position, level, heading) with blank headings already dropped, titles(key, title).
    """
    heads = toc.groupBy(key).agg(F.min_by("heading", F.when(F.col("level") == 1, F.col("position"))).alias("_chapter"), F.min_by("heading", "position").alias("_first"))
    joined = titles.select(key, F.nullif(F.trim("title"), F.lit("")).alias("_own")).join(heads, key, "full")
    return joined.select(key, F.substring(F.coalesce("_own", "_chapter", "_first"), 1, TITLE_LENGTH).alias("title"))


def toc_rows(docs: DataFrame, *, key: str = "doc_id", toc: str = "toc") -> DataFrame:
    """key, position, level, heading, page of docs(key, toc array<struct<level, heading, page>>); blank headings go."""
    rows = docs.select(key, F.posexplode(toc).alias("position", "t"))
    return rows.select(key, F.col("position").cast("long").alias("position"), "t.level", F.trim("t.heading").alias("heading"), "t.page").where("heading != ''")


def routed(docs: DataFrame, *, most_chapters: int = 3, most_chars: int = 100_000) -> DataFrame:
    """docs(..., chapters, total_chars) with mode: "multi" if both limits are exceeded, else "single"."""
    both = (F.col("chapters") > most_chapters) & (F.col("total_chars") > most_chars)
    return docs.withColumn("mode", F.when(both, "multi").otherwise("single"))


def page_title(spans: DataFrame, *, key: str = "doc_id", tolerance: float = 0.95) -> DataFrame:
    """key, title: the texts of all spans near the largest size on page 1, in order, cut to 120.

    spans(key, ord, size, text); blank ones are left out.
    """
    seen = spans.where("trim(text) != ''").withColumn("_max", F.max("size").over(W.partitionBy(key)))
    seen = seen.where(F.col("size") >= F.col("_max") * tolerance)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return seen.groupBy(key).agg(F.trim(F.substring(text, 1, TITLE_LENGTH)).alias("title"))


def title_of(spans: Column, *, tolerance: float = 0.95) -> Column:
    """The title that page_title() gives, of a list of the spans(size, text) of page 1 in order; empty without any."""
    seen = F.filter(spans, lambda x: F.trim(x["text"]) != "")
    most = F.array_max(F.transform(seen, lambda x: x["size"]))
    texts = T.bound(most, lambda m: F.transform(F.filter(seen, lambda x: x["size"] >= m * tolerance), lambda x: F.trim(x["text"])))
    return F.trim(F.substring(F.array_join(texts, " "), 1, TITLE_LENGTH))


def body_size(spans: DataFrame, *, key: str = "doc_id", value: str = "size") -> DataFrame:
    """key, body_size: the upper median of the positive sizes, 10.0 without any.

    Counted by value, so a key holds its distinct sizes and not its spans.
    """
    kept = spans.select(key, F.when(F.col(value) > 0, F.col(value)).alias("_v"))
    tally = kept.groupBy(key, "_v").agg(F.count("_v").alias("_n"))
    order = W.partitionBy(key).orderBy(F.col("_v").asc_nulls_first())
    tally = tally.withColumn("_to", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(W.partitionBy(key)))
    middle = F.floor(F.col("_all") / 2)
    return tally.groupBy(key).agg(F.coalesce(F.min(F.when((F.col("_n") > 0) & (F.col("_to") > middle), F.col("_v"))), F.lit(10.0)).alias("body_size"))
