"""Registered queries that go by way of files, table functions and streams, each with its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import tables
from lectern.operators import library
from lectern.queries import ORACLES, query
from lectern.session import table
from lectern.sources import files, pdf, pdf_writer, writers
from lectern.storage import Scratch
from lectern.streaming import breaker

_PIECE = 80
#: The visible pieces of at most 80 characters of each document's lines, in order, 50 to a page.
_PIECES = f"""
l AS (SELECT doc_id, p, x[p] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(p)),
c AS (SELECT doc_id, p, k, substr(l, CAST(k AS BIGINT) + 1, {_PIECE}) AS s FROM l, unnest(range(0, greatest(length(l), 1), {_PIECE})) AS t(k)),
v AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS i FROM c WHERE regexp_matches(s, '\\S'))"""


#: Bytes of archives that one task takes; reading them is work for the processor.
_TASK = 8 << 20


def _pdf_files(spark: SparkSession, d: str, by: list[str] = []) -> DataFrame:
    """Pages of the PDF files that were written from the documents, one for each, whose title names the document; in archives, in folders by columns."""
    files.register(spark)
    # dealt by document, so that a table of few input splits is written by as many tasks as there are
    docs = table(spark, d, "documents").select("doc_id", "text", *by).repartition("doc_id")
    cut = F.transform(F.split("text", "\n", -1), lambda l: F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(l) - 1, F.lit(0)), F.lit(_PIECE)), lambda k: F.substring(l, k + 1, F.lit(_PIECE))))
    lines = F.filter(F.flatten(cut), lambda s: s.rlike(r"(?U)\S"))
    path = Scratch(spark, "pdf").path("files")
    made = pdf_writer.pdf_texts(docs.select(F.struct("doc_id", *by).alias("key"), lines.alias("lines"), (F.col("doc_id") % 2 == 0).alias("packed"), F.concat(F.lit("Document "), "doc_id").alias("title")))
    writers.archive(made.select(F.concat(F.col("key.doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("value").cast("binary").alias("content"), *(F.col(f"key.{c}") for c in by)), path, by)
    return spark.read.format("lectern").option("archive", ".parquet").option("suffix", ".pdf").option("partitionBytes", _TASK).load(path)


def _pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pdf_files(spark, d).withColumn("doc_id", F.regexp_extract("pdf_title", r"(\d+)$", 1).cast("long"))


@query(f"WITH {_PIECES} SELECT doc_id, CAST(i // 50 + 1 AS INTEGER) AS page, count(*) AS n_lines, md5(string_agg(s, chr(10) ORDER BY i)) AS lines_md5 FROM v GROUP BY 1, 2")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _pdf_pages(spark, d).where(F.size("lines") > 0)
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return pages.select("doc_id", "page", F.size("lines").cast("long").alias("n_lines"), F.md5(text.cast("binary")).alias("lines_md5"))


@query(
    f"""WITH {_PIECES},
n AS (SELECT doc_id, count(*) AS n, max(s) FILTER (WHERE i = 0) AS head, coalesce(sum(length(s)) FILTER (WHERE i > 0), 0) >= max(length(s)) FILTER (WHERE i = 0) AS headed FROM v GROUP BY 1),
m AS (
  SELECT doc_id, string_agg(CASE WHEN i = 0 THEN '' WHEN i % 50 = 0 OR (i = 1 AND headed) THEN chr(10) || chr(10) ELSE chr(10) END ||
         CASE WHEN i = 0 AND headed THEN '# ' || regexp_replace(s, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(s, '\\s+$', '') END, '' ORDER BY i) AS text FROM v JOIN n USING (doc_id) GROUP BY 1)
SELECT d.doc_id, md5(coalesce(m.text, '')) AS text_md5, 'Document ' || d.doc_id AS title,
       CAST(greatest(1, (coalesce(n, 0) + 49) // 50) AS INTEGER) AS page_count, coalesce(n, 0) > 50 AND length(regexp_replace(coalesce(m.text, ''), '^\\s+|\\s+$', '', 'g')) < 200 AS sparse,
       coalesce(head, '') AS toc_heading
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
)
def pdf_documents(spark: SparkSession, d: str) -> DataFrame:
    found = pdf.documents_of(_pdf_pages(spark, d), key=["doc_id"])
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "title", "page_count", "sparse", F.get("toc", F.lit(0))["heading"].alias("toc_heading"))


@query(f"WITH {_PIECES} SELECT v.doc_id, CAST(i // 50 + 1 AS INTEGER) AS page, count(*) AS n_lines FROM v JOIN documents USING (doc_id) WHERE lang = (SELECT min(lang) FROM documents) GROUP BY 1, 2")
def source_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """A folder of PDF files for each language, of which a filter on the path leaves one, before any file is opened."""
    first = table(spark, d, "documents").agg(F.min("lang")).first()[0]
    pages = _pdf_files(spark, d, by=["lang"]).where(F.col("path").contains(f"/lang={first}/"))
    return pages.where(F.size("lines") > 0).select(F.regexp_extract("pdf_title", r"(\d+)$", 1).cast("long").alias("doc_id"), "page", F.size("lines").cast("long").alias("n_lines"))


# ---------------------------------------------------------------- table functions


@query(ORACLES["chunk_chars_1000"])
def lateral_chunks(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("_lateral_documents")
    return spark.sql("SELECT doc_id, c.chunk_idx, CAST(char_length(c.chunk) AS BIGINT) AS n_chars, md5(CAST(c.chunk AS BINARY)) AS chunk_md5 FROM _lateral_documents, LATERAL lectern_chunks(text, 1000, 200) AS c")


@query("SELECT p_partkey, CAST(k AS BIGINT) AS ord, CAST(CASE k WHEN 0 THEN p_partkey ELSE p_size END AS BIGINT) AS figure_id FROM part, (VALUES (0), (1)) AS t(k)")
def lateral_tags(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    text = F.concat("p_name", F.lit(" [FIGURE_ID: "), F.col("p_partkey").cast("string"), F.lit("] and [FIGURE_ID:"), F.col("p_size").cast("string"), F.lit("] [FIGURE_ID: x]"))
    table(spark, d, "part").select("p_partkey", text.alias("text")).createOrReplaceTempView("_lateral_parts")
    return spark.sql("SELECT p_partkey, t.ord, t.figure_id FROM _lateral_parts, LATERAL lectern_tags(text) AS t")


# ---------------------------------------------------------------- state over a stream

_AFTER, _PAUSE = 2, 2 * 86400


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, 0 AS failures, CAST(NULL AS TIMESTAMP) AS since, '' AS phase, true AS allowed FROM e WHERE r = 1
  UNION ALL
  SELECT user_id, r, event_id, CASE WHEN blocked THEN failures WHEN ok THEN 0 ELSE n END, CASE WHEN blocked THEN since WHEN NOT ok AND n >= {_AFTER} THEN ts END,
         CASE WHEN blocked THEN 'open' WHEN since IS NULL THEN 'closed' ELSE 'half_open' END, NOT blocked
  FROM (SELECT e.*, f.failures, f.since, f.since IS NOT NULL AND e.ts < f.since + INTERVAL {_PAUSE} SECOND AS blocked, CASE WHEN f.since IS NULL THEN f.failures ELSE {_AFTER - 1} END + 1 AS n
        FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
SELECT user_id, event_id, phase, allowed, failures FROM f WHERE r > 0"""
)
def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as results of calls, in four files by time, through a stream whose state outlives its batches."""
    out = Scratch(spark, "breaker")
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    first, last = calls.agg(F.min("ts"), F.max("ts")).first()
    cut = F.floor(F.least(F.lit(3.999), 4 * (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (1 + F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))))
    for k in range(4):  # a file for each quarter of the time, one after the other
        calls.where(cut == k).coalesce(1).write.mode("append").parquet(out.path("calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(out.path("calls"))
    breaker.decisions(stream, after=_AFTER, pause=_PAUSE).writeStream.format("parquet").option("checkpointLocation", out.path("checkpoint")).trigger(availableNow=True).start(out.path("decided")).awaitTermination()
    decided = spark.read.schema(breaker.OUT).parquet(out.path("decided")).where("event_id is not null")
    return decided.select(F.col("key").cast("long").alias("user_id"), "event_id", "phase", "allowed", "failures")


# ---------------------------------------------------------------- writers at once


@query("SELECT '/' || c_custkey AS file, c_name AS title FROM customer")
def library_concurrent(spark: SparkSession, d: str) -> DataFrame:
    """Four writers bring parts of the customers into one manifest at the same time."""
    path = Scratch(spark, "race").path("manifest")
    rows = table(spark, d, "customer").select(F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_name").alias("title"), (F.col("c_custkey") % 4).alias("part"))
    other = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in library.ENTRY.split(", ") if x.split()[0] not in ("file", "title")]

    def add(k: int) -> int:
        return writers.update_library(spark, path, lambda held: library.upserted(held, rows.where(F.col("part") == k).select("file", "title", *other)))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    return writers.read_library(spark, path).select("file", "title")
