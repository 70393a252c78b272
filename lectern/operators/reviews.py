"""Drafting and review: batches, merges of model answers, corrections, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tags of slides that sum up.
SUMMARY_TAGS = ("Summary", "Takeaway")


def batches(slides: DataFrame, size: int, *, key: list[str], order: str) -> DataFrame:
    """slides with batch: 0 for the first `size` of each key, and so on."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1
    return slides.withColumn("batch", F.floor(place / size).cast("long"))


def with_planned_figures(draft: DataFrame, plan: DataFrame, *, key: list[str]) -> DataFrame:
    """draft(key, slide_index, ..., image_refs) with the figures of the plan(key, slide_index, figure_ids); none where the plan has none."""
    refs = plan.select(*key, "slide_index", F.col("figure_ids").alias("_refs"))
    joined = draft.drop("image_refs").join(refs, [*key, "slide_index"], "left")
    return joined.withColumn("image_refs", F.coalesce("_refs", F.array().cast("array<long>"))).drop("_refs").select(*draft.columns)


def corrected(slides: DataFrame, fixes: DataFrame, *, key: list[str], fields: list[str]) -> DataFrame:
    """slides with the fields of the fix of the same index; fixes without a slide are ignored."""
    new = fixes.select(*key, F.struct(*fields).alias("_fix"))
    joined = slides.join(new, key, "left")
    return joined.select(*(F.when(F.col("_fix").isNotNull(), F.col(f"_fix.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in slides.columns))


def failed(reviews: DataFrame) -> DataFrame:
    return reviews.where(~F.col("passed"))


def verdicts(reviews: DataFrame, *keys: str) -> DataFrame:
    """keys, all_passed; decks without reviews don't appear and count as passed."""
    return reviews.groupBy(*keys).agg(F.bool_and("passed").alias("all_passed"))


def unresolved(reviews: DataFrame, *keys: str) -> DataFrame:
    """keys, slide_index, note: the first issue of each slide that failed; one without issues says so."""
    first = F.try_element_at("issues", F.lit(1))
    note = F.coalesce(F.concat(first["type"], F.lit(": "), first["detail"]), F.lit("failed without an issue"))
    return failed(reviews).select(*keys, "slide_index", note.alias("note"))


def critiques(reviews: DataFrame, *keys: str) -> DataFrame:
    """keys, critique: a line for each failed slide with the details of its issues."""
    line = F.format_string("Slide %d: %s", "slide_index", F.array_join(F.transform("issues", lambda i: i["detail"]), "; "))
    rows = failed(reviews).select(*keys, "slide_index", line.alias("l"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_index", "l"))), lambda x: x["l"]), "\n").alias("critique"))


def split_summary(slides: DataFrame, *, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(content, summary): the first Summary or Takeaway slide of each deck apart from all others."""
    first = slides.where(F.col("tag").isin(*SUMMARY_TAGS)).groupBy(*key).agg(F.min("ord").alias("_first"))
    joined = slides.join(first, key, "left")
    return joined.where("_first is null or ord != _first").drop("_first"), joined.where("ord = _first").drop("_first")


def merged_lists(rows: DataFrame, *keys: str, lists: list[str], order: str, scalars: list[str] = [], more: list[Column] = []) -> DataFrame:
    """One row for each key: lists become their distinct elements in the order of first appearance, other fields the first non-null one; `more` are aggregates."""
    out = []
    for c in lists:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])  # noqa: B023
        out.append(F.array_distinct(F.flatten(F.filter(parts, lambda x: x.isNotNull()))).alias(c))
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    return rows.groupBy(*keys).agg(*out, *more)


def two_level_merge(rows: DataFrame, key: str, part: str, *, lists: list[str], order: str, scalars: list[str] = []) -> DataFrame:
    """One row for each key: rows are merged by part first, then the parts in order of their first row; parts and items count both."""
    inner = merged_lists(rows, key, part, lists=lists, order=order, scalars=scalars, more=[F.count("*").alias("_items"), F.min(order).alias("_first")])
    return merged_lists(inner, key, lists=lists, order="_first", scalars=scalars, more=[F.count("*").alias("parts"), F.sum("_items").alias("items")])


def failure_runs(events: DataFrame, *, key: str, order: list[str], bad: Column) -> DataFrame:
    """key, run, length: runs of consecutive failures between successes."""
    good = F.sum(F.when(bad, 0).otherwise(1)).over(W.partitionBy(key).orderBy(*order))
    marked = events.withColumn("_bad", bad).withColumn("run", good)
    return marked.where("_bad").groupBy(key, "run").agg(F.count("*").alias("length"))


def latest_progress(events: DataFrame, *keys: str, order: list[str], fields: list[str]) -> DataFrame:
    """keys and fields of the last event of each key."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_x"))
    return last.select(*keys, *(F.col(f"_x.{f}").alias(f) for f in fields))
