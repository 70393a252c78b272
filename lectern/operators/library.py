"""The library of finished decks: rebuild, upsert, prune, archive, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "title string, file string, type string, generated_at string, provider string, model string, doc_hash string, slide_count long, deck_count long, archived boolean"
COLUMNS = [x.split()[0] for x in ENTRY.split(", ")]


def deck_type(said: Column, slides: Column, decks: Column) -> Column:
    """The stated type if it is one of the two, else by what the file holds; null if neither."""
    return F.when(said.isin("single_deck", "multi_deck"), said).when(slides.isNotNull(), "single_deck").when(decks.isNotNull(), "multi_deck")


def library_counts(decks: DataFrame, chapters: DataFrame, *, on: str = "file") -> DataFrame:
    """decks with deck_count and slide_count: a deck's own slides, or those of the chapter files of an index.

    decks(on, type, own_slides), chapters(on, slides) with null slides where a chapter can't be read.
    """
    sums = chapters.groupBy(on).agg(F.count("*").alias("_decks"), F.sum(F.coalesce("slides", F.lit(0))).alias("_slides"))
    single = F.col("type") == "single_deck"
    joined = decks.join(sums, on, "left")
    return joined.withColumn("slide_count", F.when(single, F.col("own_slides")).otherwise(F.coalesce("_slides", F.lit(0))).cast("long")).withColumn("deck_count", F.when(single, 1).otherwise(F.coalesce("_decks", F.lit(0))).cast("long")).drop("_decks", "_slides")


def upserted(library: DataFrame, entries: DataFrame) -> DataFrame:
    """library with entries in place of those of the same file; new ones aren't archived unless they say so."""
    new = entries.withColumn("archived", F.coalesce("archived", F.lit(False)))
    return library.join(new.select("file"), "file", "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def newest_first(library: DataFrame) -> DataFrame:
    return library.orderBy(F.col("generated_at").desc_nulls_last(), "file")


def pruned(library: DataFrame, runs: DataFrame) -> DataFrame:
    """library without what runs(doc_hash, keep_file) replaced: same hash, another file, not archived; blank hashes replace nothing."""
    kept = runs.where("doc_hash != ''").select("doc_hash", F.col("keep_file").alias("file"))
    stale = library.join(kept.select("doc_hash").distinct(), "doc_hash", "left_semi").where("not coalesce(archived, false)")
    stale = stale.join(kept, ["doc_hash", "file"], "left_anti").select("file")
    return library.join(stale, "file", "left_anti").select(*library.columns)


def archived(library: DataFrame, slugs: DataFrame, value: bool = True) -> DataFrame:
    """library with the entries of slugs(file) marked as archived or restored; others as they were."""
    joined = library.join(slugs.select("file", F.lit(True).alias("_hit")).distinct(), "file", "left")
    return joined.withColumn("archived", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("archived"))).select(*library.columns)


def archive_status(library: DataFrame, slugs: DataFrame, value: bool = True) -> DataFrame:
    """file, status of a request: 200, 404 where there is no such entry to move, 409 where it is there already."""
    joined = slugs.select("file").join(library.groupBy("file").agg(F.max("archived").alias("_a")), "file", "left")
    return joined.select("file", F.when(F.col("_a").isNull(), 404).when(F.col("_a") == F.lit(value), 409).otherwise(200).alias("status"))


def deleted(library: DataFrame, slugs: DataFrame) -> DataFrame:
    """library without the archived entries of slugs(file)."""
    gone = library.where("archived").join(slugs.select("file"), "file", "left_semi").select("file")
    return library.join(gone, "file", "left_anti").select(*library.columns)


def unique_names(outputs: DataFrame, slug: str, stamp: str, order: str) -> DataFrame:
    """outputs with name: slug_stamp for the first of them, then with _2, _3 and so on."""
    n = F.row_number().over(W.partitionBy(slug, stamp).orderBy(order))
    base = F.concat_ws("_", slug, stamp)
    return outputs.withColumn("name", F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))


def free_names(outputs: DataFrame, taken: DataFrame, slug: str, stamp: str, order: str) -> DataFrame:
    """unique_names() that also keeps clear of taken(taken): the first counters that are free, in order.

    Of the names slug_stamp, slug_stamp_2 and so on, a slug with n outputs and m taken names needs no more than n + m.
    """
    base = F.concat_ws("_", slug, stamp)
    rows = outputs.withColumn("_base", base).withColumn("_n", F.row_number().over(W.partitionBy(slug, stamp).orderBy(order)))
    used = taken.select(F.col("taken").alias("_name"), F.explode(F.array_distinct(F.array("taken", F.regexp_replace("taken", "_[0-9]+$", "")))).alias("_base"))
    sizes = rows.groupBy("_base").agg(F.count("*").alias("_all")).join(used.groupBy("_base").agg(F.count("*").alias("_used")), "_base", "left")
    places = sizes.select("_base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all") + F.coalesce("_used", F.lit(0)))).alias("_k"))
    places = places.withColumn("_name", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_k").cast("string")))).join(used, ["_base", "_name"], "left_anti")
    places = places.withColumn("_n", F.row_number().over(W.partitionBy("_base").orderBy("_k"))).select("_base", "_n", F.col("_name").alias("name"))
    return rows.join(places, ["_base", "_n"]).drop("_base", "_n")


def deck_numbers(chapters: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """chapters(key, chapter, failed) that worked out, with deck_no 01, 02 and so on in order of chapter."""
    n = F.row_number().over(W.partitionBy(key).orderBy("chapter"))
    return chapters.where("not failed").withColumn("deck_no", F.lpad(n.cast("string"), 2, "0"))


def stale_outputs(outputs: DataFrame, *, policy: str = "overwrite") -> DataFrame:
    """outputs(file, doc_hash, generated_at, archived) that a later one of the same content replaces."""
    if policy == "keep_both":
        return outputs.where("false")
    latest = F.row_number().over(W.partitionBy("doc_hash").orderBy(F.desc("generated_at"), F.desc("file")))
    return outputs.where("not archived and doc_hash != ''").withColumn("_r", latest).where("_r > 1").drop("_r")


def run_key(content_hash: Column, model: str, chunk_size: int, overlap: int | None = None, extractor: str | None = None) -> Column:
    """Key of a run's cached stages; with overlap and extractor, runs that differ in these don't share stages."""
    more = [F.lit(str(x)) for x in (overlap, extractor) if x is not None]
    return F.substring(F.sha2(F.concat(content_hash, F.lit(model), F.lit(str(chunk_size)), *more), 256), 1, 16)


def content_hash(content: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(content, 256), 1, length)
