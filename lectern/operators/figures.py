"""Figures: captions, tags, catalog, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.tables import LINE_ENDS, whole_lines
from lectern.storage import Scratch, small

#: Figures that a slide may own.
PER_SLIDE = 3


def figure_catalog(captions: DataFrame, chunk_figures: DataFrame, purposes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, figure_id, caption, purpose, source_chunk.

    captions(key, figure_id, ord, caption), chunk_figures(key, chunk_idx, figure_id), purposes(key, chunk_idx, figure_id, purpose).
    Only figures with a caption that some chunk refers to; the last of repeated captions holds, the
    purpose is that of the first chunk which gives one, the source the first chunk that refers to the figure.
    """
    named = captions.groupBy(key, "figure_id").agg(F.max_by("caption", "ord").alias("caption")).where(T.strip(F.col("caption")) != "")
    first = chunk_figures.groupBy(key, "figure_id").agg(F.min("chunk_idx").alias("source_chunk"))
    meant = purposes.groupBy(key, "figure_id").agg(F.min_by("purpose", "chunk_idx").alias("purpose"))
    out = named.join(first, [key, "figure_id"]).join(meant, [key, "figure_id"], "left")
    return out.select(key, "figure_id", "caption", F.coalesce("purpose", F.lit("unspecified")).alias("purpose"), "source_chunk")


def figure_owners(requests: DataFrame, catalog: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, figure_id, slide_index, overlap: one slide for each requested figure of the catalog.

    requests(key, slide_index, chunk_indices, figure_id). A slide that works on the figure's source chunk
    comes first, then the earlier one.
    """
    known = requests.join(catalog.select(key, "figure_id", "source_chunk"), [key, "figure_id"])
    known = known.withColumn("overlap", F.array_contains("chunk_indices", F.col("source_chunk")))
    rank = F.row_number().over(W.partitionBy(key, "figure_id").orderBy(F.desc("overlap"), "slide_index"))
    return known.withColumn("_r", rank).where("_r = 1").select(key, "figure_id", "slide_index", "overlap")


def capped_figures(owners: DataFrame, *, key: str = "doc_id", most: int = PER_SLIDE) -> DataFrame:
    """owners with place: each slide keeps its first `most` figures, overlapping ones first; the others have no owner."""
    place = F.row_number().over(W.partitionBy(key, "slide_index").orderBy(F.desc("overlap"), "figure_id"))
    return owners.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def referenced_images(images: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    return images.join(references.select(*on), on, "left_semi")


def inject_figure_ids(docs: DataFrame, figures: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, text: the first line that opens with a figure's keyword and number gets its tag.

    figures(key, figure_id, caption). Lines may open with up to two asterisks. Tags of several figures
    with one keyword and number come in order of figure_id.
    """
    numbered = F.transform(whole_lines(F.col("text")), lambda w, i: F.struct(i.cast("long").alias("line"), F.regexp_replace(w, r"^\*{0,2}", "").alias("l")))
    opening = docs.select(key, F.explode(F.filter(numbered, lambda x: x["l"].rlike(T.CAPTION_KEY + r"\b"))).alias("x")).select(key, "x.line", T.caption_key(F.col("x.l")).alias("_k"))
    wanted = figures.withColumn("_k", T.caption_key(F.col("caption"))).where("_k is not null")
    wanted = wanted.groupBy(key, "_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("figure_id")), lambda n: F.concat(F.lit(" [FIGURE_ID: "), n.cast("string"), F.lit("]"))), "").alias("_tags"))
    first = opening.where("_k is not null").groupBy(key, "_k").agg(F.min("line").alias("line"))
    tags = first.join(wanted, [key, "_k"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line", "_tags"))).alias("_tags"))
    out = docs.select(key, "text").join(small(Scratch(docs.sparkSession, "figures").save(tags, "tags"), 100_000), key, "left")
    end = f"((?:\\r\\n|[{LINE_ENDS}])?)\\z"

    def tagged(w: Column, i: Column) -> Column:
        tag = F.try_element_at("_tags", i.cast("long"))
        return F.when(tag.isNotNull(), F.concat(F.regexp_replace(w, end, ""), tag, F.regexp_extract(w, end, 1))).otherwise(w)

    return out.select(key, F.when(F.col("_tags").isNotNull(), F.array_join(F.transform(whole_lines(F.col("text")), tagged), "")).otherwise(F.col("text")).alias("text"))


def format_catalog(catalog: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, catalog: one line for each figure, in order."""
    line = F.format_string("[%d] (%s, chunk %d) %s", "figure_id", "purpose", "source_chunk", "caption")
    rows = catalog.select(key, "figure_id", line.alias("l"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("figure_id", "l"))), lambda x: x["l"]), "\n").alias("catalog"))


def source_chunks(slides: DataFrame, chunks: DataFrame, *, key: str = "doc_id", empty: str = "(no source chunks)") -> DataFrame:
    """key, slide_index, context: the texts of a slide's chunks in order; ids out of range and repeats are dropped.

    slides(key, slide_index, chunk_indices), chunks(key, chunk_idx, chunk).
    """
    wanted = slides.select(key, "slide_index", F.explode(F.array_distinct("chunk_indices")).alias("chunk_idx"))
    texts = wanted.join(chunks, [key, "chunk_idx"]).withColumn("l", F.format_string("[chunk %d]\n%s", "chunk_idx", "chunk"))
    texts = texts.groupBy(key, "slide_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "l"))), lambda x: x["l"]), "\n\n").alias("context"))
    return slides.select(key, "slide_index").join(texts, [key, "slide_index"], "left").select(key, "slide_index", F.coalesce("context", F.lit(empty)).alias("context"))
