"""WARC archives: writing captures as records, reading records back, assembling transactions.

A capture is a response (or revisit) with the requests and metadata records of the same event. Here request and
metadata name the response in WARC-Concurrent-To; other writers let the response name them, or name several.
Archives are WARC/1.1 files, gzip-compressed as a whole, that Spark writes and reads line by line: a file is one
split, so a reader holds one record at a time however long the archive is. Archives without compression, which
Spark splits, have their lines brought back into order by file first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship
from lectern.storage import Scratch

CRLF = "\r\n"
#: Payloads from so many bytes on are written once; their copies revisit them.
REVISIT_FROM = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2026-01-05T10:00:00Z"


def _bytes(c: Column) -> Column:
    return F.octet_length(c)


def _uuid(*parts: Column) -> Column:
    """A record id made of a hash of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(p for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in (F.substring(h, k, n), F.lit("-" if k < 21 else ">"))))


def _record(kind: Column, ident: Column, uri: Column, block: Column, headers: list[tuple[str, Column]]) -> Column:
    """One record without the two line ends that close it."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {_DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]  # null headers are left out
    return F.concat(F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), _bytes(block).cast("string"))), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Writes pages(page_id, url, html) as archives below path.

    Of rows with equal payloads of REVISIT_FROM bytes and more, that with the largest page_id is a
    response and the others revisit it; where rows repeat that page_id, each of them is a response.
    Null html is an empty payload, a null url an empty URI; null page_ids are smaller than any other. A revisit
    names the URI and date of its response, and like it the digest of the payload.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # line ends in a URI would break the header
    pages = pages.withColumn("url", F.regexp_replace("url", r"[\r\n]", " "))
    payload = F.col("html").cast("binary")
    hashed = pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("key"), F.sha2(payload, 256).alias("sha256"), _bytes(F.col("html")).alias("bytes"), "url")
    hashed = scratch.save(hashed.where(f"bytes >= {REVISIT_FROM}").select("key", "sha256", "url"), "hashed")
    newest = hashed.groupBy("sha256").agg(F.max(F.struct("key", "url")).alias("newest"), F.count("*").alias("n")).where("n > 1")
    newest = scratch.save(newest.select("sha256", F.col("newest.key").alias("newest"), F.col("newest.url").alias("first_url")), "newest")
    again = scratch.save(hashed.drop("url").join(newest, "sha256").where("key != newest").select("key", "sha256", "first_url").distinct(), "again")
    scratch.drop("hashed", "newest")

    row = pages.withColumn("key", F.coalesce("page_id", F.lit(-(2**63))))
    row = row.join(again.withColumnRenamed("sha256", "copied"), "key", "left")
    # a repeated page_id with another payload isn't that copy
    row = row.withColumn("revisit", F.coalesce(F.sha2(payload, 256) == F.col("copied"), F.lit(False)))
    row = row.withColumn("sha1", F.sha1(payload)).withColumn("serial", F.monotonically_increasing_id().cast("string"))
    key = [F.col("page_id").cast("string"), F.col("sha1"), F.col("serial")]
    first = _uuid(F.lit("r"), *key)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), _bytes(F.col("html")).cast("string"), F.lit(CRLF * 2))
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}User-Agent: lectern{CRLF * 2}"))
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.lit("payload-bytes: "), _bytes(F.col("html")).cast("string"), F.lit(CRLF))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    main = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        first,
        F.col("url"),
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
        [("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(F.col("revisit"), F.lit(_PROFILE))),
         ("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("first_url"))), ("WARC-Refers-To-Date", F.when(F.col("revisit"), F.lit(_DATE)))],
    )
    request = _record(F.lit("request"), _uuid(F.lit("q"), *key), F.col("url"), ask, [("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", first)])
    metadata = _record(F.lit("metadata"), _uuid(F.lit("m"), *key), F.col("url"), note, [("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", first)])
    lines = row.select(F.explode(F.array(request, main, metadata)).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _parsed(lines, payloads: bool):
    """Records of (file, line) pairs, the lines of a file in order and without their line feed."""
    state = None  # [file, header lines, block parts, bytes of the block still to come]
    for name, line in lines:
        if state is None or state[0] != name:
            state = [name, None, [], 0]
        if state[1] is None:
            if line.startswith(b"WARC/"):
                state[1], state[2] = [], []
        elif state[3] == 0:
            text = line.rstrip(b"\r")
            if text:
                state[1].append(text)
                continue
            state[1] = _headers(state[1])
            length = state[1].get("content-length", ["0"])[0]
            state[3] = int(length) if length.isascii() and length.isdigit() else 0  # without a length the block is empty; what follows is passed over up to the next record
            if not state[3]:
                yield _row(state[1], b"", payloads)
                state = [name, None, [], 0]
        else:
            part = line + b"\n"
            if len(part) >= state[3]:
                state[2].append(part[: state[3]])
                yield _row(state[1], b"".join(state[2]), payloads)
                state = [name, None, [], 0]
            else:
                state[2].append(part)
                state[3] -= len(part)


def _headers(lines: list[bytes]) -> dict[str, list[str]]:
    """The values of each header, in order."""
    found: dict[str, list[str]] = {}
    for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines):
        found.setdefault(k.strip().lower(), []).append(v.strip())
    return found


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    first = lambda name: headers.get(name, [None])[0]
    kind = first("warc-type")
    fields, payload = None, block
    if "application/http" in (first("content-type") or ""):
        head, _, payload = block.partition(b"\r\n\r\n")
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if k}
    said = first("warc-payload-digest")
    return (
        first("warc-record-id"), kind, first("warc-target-uri"), first("warc-date"), headers.get("warc-concurrent-to", []), said.removeprefix("sha1:") if said else None,
        len(payload), hashlib.sha1(payload).hexdigest() if kind in ("response", "resource") else None, list(fields.items()) if fields is not None else None, payload if payloads else None,
    )


RECORD = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, stated_digest string, "
    "bytes long, digest string, fields map<string,string>, payload binary"
)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of the archives below path, one row each (schema RECORD); digest is taken from the bytes read.

    Files whose names end in "z" are read as they are, others may be split and are put in order by file. A header
    that is missing is null (concurrent_to: empty), a length that isn't a number counts as 0; text between
    records is passed over, a record cut off by the end of its file is left out, an empty file has none. Repeated
    records come out as often as they occur.
    """
    ship(spark)
    reader = spark.read.option("lineSep", "\n")
    whole = reader.option("pathGlobFilter", "*z").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*[^z]").text(path)
    cut = cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    cut = cut.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "value")
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def records(batches):
        def each():
            for batch in batches:
                files = batch.column(0).to_pylist()
                values = batch.column(1).cast(pa.binary()).to_pylist() if batch.column(1).type != pa.binary() else batch.column(1).to_pylist()
                yield from zip(files, values)

        held, size = [], 0
        for row in _parsed(each(), payloads):
            held.append(row)
            size += len(row[9] or b"") + 300
            if size > 8 << 20 or len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return whole.mapInArrow(records, RECORD).union(cut.mapInArrow(records, RECORD))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, requests, metadata (arrays in order of record_id).

    A capture is a response or revisit. Requests and metadata belong to it if they name it in concurrent_to, if it
    names them, or if they and one that belongs to it name each other. Records that belong to no capture,
    or have no id or type, are left out; of several records with one id any one counts; captures without partners have
    empty arrays. Columns beyond those of RECORD go along inside the structs.
    """
    columns = [c for c in records.columns if c not in ("concurrent_to",)]
    main = F.col("record_type").isin("response", "revisit")
    known = records.where("record_id is not null")
    rest = known.where(F.col("record_type").isin("request", "metadata")).withColumn("record", F.struct(*columns))
    captures = known.where(main).groupBy(F.col("record_id").alias("main")).agg(F.any_value(F.struct(*columns)).alias("response"))
    named = rest.select(F.explode("concurrent_to").alias("main"), "record_id", "record")
    names = known.where(main).select(F.col("record_id").alias("main"), F.explode("concurrent_to").alias("record_id"))
    links = rest.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y")).join(rest.select(F.col("record_id").alias("y")), "y", "left_semi")
    links = links.select("x", "y").union(links.select("y", "x"))
    direct = names.union(named.select("main", "record_id")).join(links.select(F.col("x").alias("record_id"), "y"), "record_id").select("main", F.col("y").alias("record_id"))
    others = names.union(direct).join(rest.select("record_id", "record"), "record_id").select("main", "record_id", "record")
    every = captures.join(named.union(others), "main", "left")
    single = every.groupBy("main", "record_id").agg(F.any_value("response").alias("response"), F.any_value("record").alias("record"))
    kept = lambda kind: F.collect_list(F.when(F.col("record.record_type") == kind, F.col("record")))
    order = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    return single.groupBy(F.col("main").alias("record_id")).agg(F.any_value("response").alias("response"), F.array_sort(kept("request"), order).alias("requests"), F.array_sort(kept("metadata"), order).alias("metadata"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each row of pages, by way of archives.

    Pages are written as WARC, read back, assembled to captures, and revisits resolved to the response
    with their payload digest; lengths and digests are those of the bytes read. Columns other
    than page_id, url and html aren't read. Repeated rows come back as often as they went in.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.path("archive"), scratch)
    records = read_archives(spark, scratch.path("archive"), payloads=False)
    records = scratch.save(records.drop("payload"), "records")
    captures = transactions(records).select(
        F.get("metadata", F.lit(0))["fields"]["page-id"].try_cast("long").alias("page_id"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.bytes").alias("bytes"),
        F.col("response.digest").alias("digest"),
        F.col("response.stated_digest").alias("stated"),
    )
    captures = scratch.save(captures, "captures")
    originals = captures.where(f"record_type = 'response' and bytes >= {REVISIT_FROM}").groupBy(F.col("digest").alias("stated")).agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("full"))
    originals = scratch.save(originals, "originals")
    responses = captures.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = captures.where("record_type = 'revisit'").join(originals, "stated").select("page_id", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    return responses.union(revisits)
