"""Readers of documents, block lists, libraries and stage caches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectern.functions import text as T
from lectern.operators import library as L
from lectern.operators.blocks import BLOCK
from lectern.session import ship
from lectern.sources.registry import register

#: Characters under which a document of several pages is suspicious.
SPARSE = 200
DECK = (
    "title string, type string, generated_at string, provider string, model string, doc_hash string, "
    "slides array<struct<index:long,tag:string,heading:string,body:string,image_refs:array<long>>>, decks array<struct<chapter_title:string,file:string>>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, doc_hash, text of the text files below path, one document each."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), L.content_hash(F.col("value").cast("binary")).alias("doc_hash"), F.col("value").alias("text"))


def binary_documents(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """doc_id, path, doc_hash, content of the files below path with a suffix, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").endswith(suffix))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", L.content_hash(F.col("content")).alias("doc_hash"), "content")


def parsed_documents(documents: DataFrame, parser: Callable[[bytes], tuple[str, str]]) -> DataFrame:
    """documents with markdown: of the two renderings that a parser gives (layout, plain), the layout one unless it is short.

    The parser of a binary format is the caller's; it runs on Arrow batches. A layout text of less than
    half the plain text's length gives way. `sparse` marks texts that look empty.
    """
    ship(documents.sparkSession)
    columns = [c for c in documents.columns if c != "content"]

    def parsed(batches):
        for batch in batches:
            both = [parser(c) for c in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.string())], [*columns, "layout", "plain"])

    schema = ST.StructType([documents.schema[c] for c in columns]).add("layout", "string").add("plain", "string")
    out = documents.mapInArrow(parsed, schema)
    return out.withColumn("markdown", preferred(F.col("layout"), F.col("plain"))).withColumn("sparse", F.char_length(T.strip(F.col("markdown"))) < SPARSE).drop("layout", "plain")


def with_parser(parser: Callable[[bytes], tuple[str, str]], suffix: str = ".pdf") -> Callable[[SparkSession, str], DataFrame]:
    """An extractor (for register()) of binary documents: doc_id, path, doc_hash, text, sparse."""

    def extract(spark: SparkSession, path: str) -> DataFrame:
        return parsed_documents(binary_documents(spark, path, suffix), parser).withColumnRenamed("markdown", "text")

    return extract


def preferred(layout: Column, plain: Column) -> Column:
    """The layout text, unless it has less than half the characters of the plain one."""
    size = lambda c: F.char_length(T.strip(F.coalesce(c, F.lit(""))))
    return F.when(size(layout) >= 0.5 * F.greatest(size(plain), F.lit(1)), layout).otherwise(plain)


def block_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of BLOCK from JSON files, each a list of content blocks in order."""
    fields = [x for x in BLOCK.replace(", ", ",").split(",") if x.split()[0] not in ("doc_id", "ord", "has_crop")]
    schema = "array<struct<" + ",".join(":".join(x.split(" ", 1)) for x in fields) + ">>"
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.posexplode(F.from_json("value", schema)).alias("ord", "b"))
    return rows.select("doc_id", "ord", *(F.col(f"b.{x.split()[0]}") for x in fields), F.col("b.img_path").isNotNull().alias("has_crop"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """The library manifest at path (JSON lines or one list); a missing or unreadable one is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], L.ENTRY)
    text = spark.read.text(path, wholetext=True)
    schema = "array<struct<" + ",".join(":".join(x.split()) for x in L.ENTRY.split(", ")) + ">>"
    rows = text.select(F.explode(F.from_json("value", schema)).alias("e"))
    return rows.select("e.*").where("file is not null")


def deck_files(spark: SparkSession, path: str) -> DataFrame:
    """file, folder, name, archived, is_index, chapter, data of the deck files below path.

    Files at the top, and an index in a folder there, are decks; likewise below archive/. Other files in such
    folders are chapters. Anything deeper, the manifest, and what isn't JSON is left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    inner = F.regexp_replace(F.regexp_replace(F.url_decode("_metadata.file_path"), "^[a-z]+:/+", "/"), "^" + base.rstrip("/").replace("\\", "\\\\"), "")
    rows = files.select(inner.alias("file"), F.from_json("value", DECK).alias("data")).where("data is not null and not file like '%/library.json'")
    rows = rows.withColumn("archived", F.col("file").startswith("/archive/")).withColumn("_in", F.regexp_replace("file", "^/archive", ""))
    rows = rows.withColumn("_parts", F.size(F.split("_in", "/")) - 1).withColumn("name", F.element_at(F.split("file", "/"), -1))
    rows = rows.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")).where("_parts <= 2")
    top = F.col("_parts") == 1
    rows = rows.withColumn("is_index", ~top & (F.col("name") == "index.json")).withColumn("chapter", ~top & (F.col("name") != "index.json"))
    return rows.select("file", "folder", "name", "archived", "is_index", "chapter", "data")


def rebuilt_library(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as the files below path give it (schema ENTRY)."""
    files = deck_files(spark, path)
    decks = files.where("not chapter").withColumn("type", L.deck_type(F.col("data.type"), F.col("data.slides"), F.col("data.decks"))).where("type is not null")
    decks = decks.withColumn("own_slides", F.coalesce(F.size("data.slides"), F.lit(0)))
    parts = decks.where("type = 'multi_deck'").select("file", "folder", F.explode("data.decks").alias("d")).select("file", F.concat("folder", F.lit("/"), "d.file").alias("_path"))
    read = files.select(F.col("file").alias("_path"), F.greatest(F.size("data.slides"), F.lit(0)).alias("slides"))
    counted = L.library_counts(decks, parts.join(read, "_path", "left").select("file", "slides"))
    text = lambda c: F.coalesce(F.col(f"data.{c}"), F.lit("")).alias(c)
    return counted.select(text("title"), "file", "type", text("generated_at"), text("provider"), text("model"), text("doc_hash"), "slide_count", "deck_count", "archived")


def stage(spark: SparkSession, root: str, key: str, name: str, *, resume: bool) -> DataFrame | None:
    """A cached stage of a run, if the run resumes and the stage was finished."""
    path = f"{root}/{key}/{name}"
    return spark.read.parquet(path) if resume and _exists(spark, f"{path}/_SUCCESS") else None


register("text", text_documents)
register("blocks", block_lists)
