"""Sinks: decks, indexes, the manifest, stage caches."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import library as L
from lectern.sources import files
from lectern.storage import Scratch


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_decks(decks: DataFrame, path: str, *, stamp: str, generated_at: str, provider: str, model: str, debug: bool = False) -> DataFrame:
    """Writes decks(doc_id, deck_id, mode, chapter, title, doc_hash, slides, images, ...) as files; returns them with `file`.

    Single decks are SLUG_HASH_STAMP.json; a multi deck is such a folder, with NN_CHAPTER.json for each deck that worked
    out, numbered in order, and index.json, which comes last. Names that are taken get a counter. The executors write files and
    move each into place, so none is ever half there and none is replaced; a run cut short leaves only new files. Decks without
    slides are left out. The driver sees a count from each task.
    """
    spark = decks.sparkSession
    fresh = Scratch(spark, "publish")
    good = fresh.save(decks.where("slides is not null"), "good")
    docs = good.groupBy("doc_id", "mode", "doc_hash").agg(F.min_by("title", "deck_id").alias("_title"))
    docs = docs.withColumn("stem", F.concat_ws("_", T.output_slug(F.col("_title")), "doc_hash")).withColumn("stamp", F.lit(stamp))
    taken = spark.createDataFrame([(re.sub(r"\.json$", "", n),) for n in _names(spark, path, f"*_{stamp}*")] or [("",)], "taken string")  # of this second alone
    named = L.free_names(docs, taken, "stem", "stamp", "doc_id").select("doc_id", "name")
    rows = L.deck_numbers(good.withColumn("failed", F.lit(False)).withColumn("_c", F.col("chapter")).withColumn("chapter", F.col("deck_id")).drop("deck_no")).withColumn("chapter", F.col("_c")).join(named, "doc_id")
    multi = F.col("mode") == "multi"
    inner = F.concat("deck_no", F.lit("_"), T.slug(F.col("chapter")), F.lit(".json"))
    rows = rows.withColumn("part", F.when(multi, inner)).withColumn("file", F.concat(F.lit("/"), "name", F.when(multi, F.lit("/index.json")).otherwise(F.lit(".json"))))
    rows = fresh.save(rows.drop("_c", "failed"), "rows")
    head = [F.lit(generated_at).alias("generated_at"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("doc_hash")]
    deck = F.to_json(F.struct("title", F.lit("single_deck").alias("type"), *head, "slides", "images"))
    parts = rows.select(F.when(multi, F.concat("name", F.lit("/"), "part")).otherwise(F.concat("name", F.lit(".json"))).alias("to"), deck.alias("value"), F.lit(0).alias("turn"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("deck_no", F.col("chapter").alias("chapter_title"), F.col("part").alias("file")))), lambda x: x.dropFields("deck_no"))
    index = rows.where(multi).groupBy("name", "doc_hash").agg(F.min_by("title", "deck_id").alias("title"), entries.alias("decks"))
    index = index.select(F.concat("name", F.lit("/index.json")).alias("to"), F.to_json(F.struct("title", F.lit("multi_deck").alias("type"), *head, "decks")).alias("value"), F.lit(1).alias("turn"))
    every = parts.union(index)
    if debug:
        every = every.union(rows.select(F.concat(F.lit("debug/"), "name", F.lit("_"), "deck_no", F.lit(".json")), F.to_json(F.struct("*")), F.lit(0)))
    _placed(every, path)
    return rows.drop("deck_no", "part", "name")


#: Files of an archive, and bytes of a part of it that readers hold at once.
ARCHIVED, ARCHIVE_PART = 4096, 16 << 20


def archive(pieces: DataFrame, path: str, by: list[str] = []) -> None:
    """pieces(name, content, *by), very many small files, as archives below path that format("lectern") reads; folders by the columns `by`.

    Names hold no slash. One file each would cost a creation, a move by the driver and an entry of its listing.
    """
    pieces.select("name", "content", *by).write.partitionBy(*by).option("maxRecordsPerFile", ARCHIVED).option("parquet.block.size", ARCHIVE_PART).parquet(path)


def _names(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    target, fs = _fs(spark, f"{path}/{pattern}")
    return [s.getPath().getName() for s in fs.globStatus(target) or []]


def _placed(pieces: DataFrame, path: str) -> None:
    """pieces(to, value, turn) as single files below path, each put in place by the executor that writes it, in order of turn."""
    spark = pieces.sparkSession
    files.register(spark)
    pieces = Scratch(spark, "place").save(pieces, "files")
    for turn in (0, 1):
        pieces.where(F.col("turn") == turn).select("to", "value").write.format("lectern").mode("append").save(path)


def delete_outputs(spark: SparkSession, path: str, files: DataFrame) -> None:
    """Deletes the decks of files(file): the file, or the whole folder of an index. Only names go through the driver."""
    for row in files.select("file").distinct().toLocalIterator():
        target, fs = _fs(spark, f"{path}{row.file}")
        fs.delete(target.getParent() if target.getName() == "index.json" else target, True)


class Conflict(Exception):
    """Another writer was first, time after time."""


#: Versions that stay for readers that have just begun, and how often a change is made anew after losing to another writer.
KEPT_VERSIONS, TRIES = 4, 50
_LOG = re.compile(r"^(\d{12})\.version$")


def update_library(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replaces the manifest by change(manifest); returns the number of the version that is then the latest.

    The manifest is a folder of versions and a log of their names. A version counts once its log entry is there, and
    an entry is put under its number only if there is none: of two writers at once, one finds the number taken, reads what the
    other wrote, and applies its change to that. So no change is lost, and whoever reads at any moment, or after a crash at any
    step, sees one version or the next.
    """
    for _ in range(TRIES):
        number, name = _latest(spark, path)
        version = f"v-{uuid.uuid4().hex}"
        change(_version(spark, path, name)).select(*L.COLUMNS).write.json(f"{path}/{version}")
        if _put_if_absent(spark, f"{path}/{number + 1:012d}.version", version):
            _forget_versions(spark, path, number + 1)
            return number + 1
        target, fs = _fs(spark, f"{path}/{version}")
        fs.delete(target, True)
    raise Conflict(f"{path}: {TRIES} times another writer was first")


def write_library(library: DataFrame, path: str) -> None:
    """The manifest as it is to be, whatever it was; see update_library() for changes."""
    update_library(library.sparkSession, path, lambda _: library)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with a text in one step, unless there is one."""
    jvm = spark._jvm
    target, fs = _fs(spark, path)
    target = fs.makeQualified(target)
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":  # a rename there would replace; a link doesn't
            of = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{p.toUri().getRawPath()}"))
            jvm.java.nio.file.Files.createLink(of(target), of(staged))
        else:
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, how)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(staged, False)


def _log(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for n in _names(spark, path) if (m := _LOG.match(n)))


def _latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, name) of the latest version; (0, None) where there is none."""
    numbers = _log(spark, path)
    return (numbers[-1], spark.read.text(f"{path}/{numbers[-1]:012d}.version").first().value.strip()) if numbers else (0, None)


def _forget_versions(spark: SparkSession, path: str, number: int) -> None:
    """Deletes all but the last versions that the log knows; what no entry names may still become one."""
    for old in _log(spark, path):
        if old <= number - KEPT_VERSIONS:
            entry, fs = _fs(spark, f"{path}/{old:012d}.version")
            with contextlib.suppress(AnalysisException, Py4JJavaError):  # another writer tidies up as well
                name = spark.read.text(f"{path}/{old:012d}.version").first().value.strip()
                fs.delete(_fs(spark, f"{path}/{name}")[0], True)
                fs.delete(entry, False)


def _version(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    return spark.read.schema(L.ENTRY).json(f"{path}/{name}") if name else spark.createDataFrame([], L.ENTRY)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The latest manifest, newest entries first; empty if there is nothing."""
    return L.newest_first(_version(spark, path, _latest(spark, path)[1]))


def save_stage(df: DataFrame, root: str, key: str, name: str, *, most: int = 0) -> DataFrame:
    """Caches a stage of a run, in files of at most so many rows if `most` says, and returns it as read back."""
    df.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{root}/{key}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{key}/{name}")


def clear_stages(spark: SparkSession, root: str, key: str) -> None:
    target, fs = _fs(spark, f"{root}/{key}")
    fs.delete(target, True)


def point_to(spark: SparkSession, root: str, key: str, output: str) -> None:
    """Remembers where the output of a run is."""
    spark.createDataFrame([(key, output)], "run_key string, output string").coalesce(1).write.mode("overwrite").json(f"{root}/outputs/{key}")


def output_of(spark: SparkSession, root: str, key: str) -> str | None:
    target, fs = _fs(spark, f"{root}/outputs/{key}")
    row = spark.read.schema("run_key string, output string").json(f"{root}/outputs/{key}").first() if fs.exists(target) else None
    return row.output if row else None
