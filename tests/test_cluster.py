"""State and commits that all executors and writers share: breaker, manifest, table functions."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from lectern.functions import tables
from lectern.operators import chunking, library
from lectern.sources import writers
from lectern.streaming import breaker

T0 = dt.datetime(2026, 1, 1)
CALLS = "key string, event_id long, ts timestamp, ok boolean"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def fold(calls, after, pause):
    """The breaker of one process over calls(event_id, seconds, ok) in order."""
    from lectern.model.client import Breaker, Open

    now = [0.0]
    b, out = Breaker(after=after, pause=pause, now=lambda: now[0]), []
    for event, s, ok in sorted(calls, key=lambda c: (c[1], c[0])):
        now[0] = s
        half = b.since is not None
        try:
            b.check()
        except Open:
            out.append((event, "open", False))
            continue
        out.append((event, "half_open" if half else "closed", True))
        b.success() if ok else b.failure()
    return out


def test_breaker_stream_is_the_one_of_a_process(spark, tmp_path):
    rnd = random.Random(4)
    calls = [(key, i, rnd.randrange(0, 900), rnd.random() < 0.4) for i, key in enumerate(rnd.choice(["a", "b", None]) for _ in range(240))]
    calls += [("silent", 500 + k, 10 + k, False) for k in range(3)]  # nothing comes after its third failure
    for part in range(3):
        rows = [(k, i, at(s), ok) for k, i, s, ok in calls if s // 300 == part]
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    stream = lambda: spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/calls")
    run = lambda: breaker.decisions(stream(), after=3, pause=40).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    run()
    rows = spark.read.schema(breaker.OUT).parquet(f"{tmp_path}/out").collect()
    got = {(r.key, r.event_id): (r.phase, r.allowed) for r in rows if r.event_id is not None}
    want = {(k or "", e): (phase, ok) for k in ("a", "b", "silent", None) for e, phase, ok in fold([c[1:] for c in calls if c[0] == k], 3, 40)}
    assert got == want and {p for p, _ in got.values()} == {"closed", "open", "half_open"}
    ended = [r for r in rows if r.event_id is None]
    assert {(r.key, r.ts) for r in ended} >= {("silent", at(52))} and all(r.phase == "half_open" and r.failures >= 3 for r in ended)
    # started again with more calls, the state goes on from where it was
    more = [("a", 1000 + i, at(2000 + i), False) for i in range(4)]
    spark.createDataFrame(more, CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    run()
    late = {r.event_id: r.allowed for r in spark.read.schema(breaker.OUT).parquet(f"{tmp_path}/out").where("event_id >= 1000").collect()}
    known = fold([c[1:] for c in calls if c[0] == "a"] + [(e, 2000 + e - 1000, False) for _, e, _, _ in more], 3, 40)
    assert late == {e: ok for e, _, ok in known if e >= 1000}


def test_states_and_admitted_calls(spark):
    rows = [
        ("shut", 1, at(0), "closed", True, 4), ("shut", 2, at(1), "closed", True, 5), ("shut", 3, at(2), "open", False, 5),
        ("over", 1, at(0), "closed", True, 5), ("over", None, at(60), "half_open", True, 5),
        ("again", 1, at(0), "closed", True, 5), ("again", 2, at(70), "half_open", True, 5),
        ("fine", 1, at(0), "half_open", True, 0),
    ]
    known = breaker.states(spark.createDataFrame(rows, breaker.OUT))
    got = {r.key: (r.phase, r.since) for r in known.collect()}
    assert got == {"shut": ("open", at(1)), "over": ("half_open", at(0)), "again": ("open", at(70)), "fine": ("closed", None)}
    calls = spark.createDataFrame([(k, n) for k in ("shut", "over", "fine", "new", None) for n in (2, 1)], "key string, n int")
    ok = lambda s: {(r.key, r.n) for r in breaker.admitted(calls, known, F.lit(at(s)), order=["n"]).where("admitted").collect()}
    free = {(k, n) for k in ("fine", "new", None) for n in (1, 2)}
    assert ok(30) == free | {("over", 1)} and ok(61) == free | {("over", 1), ("shut", 1)}


ENTRY = ("t", "single_deck", "1", "p", "m", "h", 1, 1, False)


def entries(spark, *names):
    return spark.createDataFrame([(ENTRY[0], n, *ENTRY[1:]) for n in names], library.ENTRY)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/library"
    barrier = threading.Barrier(2)

    def change(k):
        met = []

        def add(held):
            if not met:  # both have read the same version before either writes
                met.append(1)
                barrier.wait(30)
            return library.upserted(held, entries(spark, f"/{k}"))

        return add

    numbers = []
    writers.write_library(entries(spark, "/old"), path)
    threads = [threading.Thread(target=lambda k=k: numbers.append(writers.update_library(spark, path, change(k)))) for k in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(numbers) == [2, 3] and {r.file for r in writers.read_library(spark, path).collect()} == {"/old", "/0", "/1"}


def test_versions_are_put_once_and_forgotten(spark, tmp_path):
    path = f"{tmp_path}/library"
    for k in range(7):
        writers.update_library(spark, path, lambda held: library.upserted(held, entries(spark, f"/{k}")))
    assert writers._log(spark, path) == [4, 5, 6, 7] and writers.read_library(spark, path).count() == 7
    assert len(list((tmp_path / "library").glob("v-*"))) == 4 and not [p for p in (tmp_path / "library").glob(".*") if p.suffix != ".crc"]
    assert not writers._put_if_absent(spark, f"{path}/{7:012d}.version", "other")
    assert writers._put_if_absent(spark, f"{path}/{8:012d}.version", "v-x") and (tmp_path / "library" / f"{8:012d}.version").read_text() == "v-x"


def test_a_writer_that_never_wins_says_so(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "_put_if_absent", lambda *a: False)
    monkeypatch.setattr(writers, "TRIES", 2)
    with pytest.raises(writers.Conflict):
        writers.write_library(entries(spark, "/a"), f"{tmp_path}/library")
    assert not list((tmp_path / "library").glob("v-*"))


def test_table_functions(spark):
    tables.register(spark)
    texts = ["short", "", "  ", None, "a b\n\nc d " * 40, "x" * 130, "é" * 51]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.createOrReplaceTempView("_docs")
    got = spark.sql("SELECT doc_id, c.* FROM _docs, LATERAL lectern_chunks(text, 50, 12) AS c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunking.chunk_chars(docs, 50, 12).collect()))
    tags = spark.sql("SELECT t.* FROM VALUES ('a [FIGURE_ID: 7] [FIGURE_ID:8][FIGURE_ID: x]'), (NULL) AS v(s), LATERAL lectern_tags(s) AS t").collect()
    assert sorted(map(tuple, tags)) == [(0, 7, 2), (1, 8, 17)]
    assert spark.sql("SELECT * FROM lectern_chunks(NULL, 5, 1)").count() == 0


def test_decks_are_placed_by_executors(spark, tmp_path):
    parts = spark.createDataFrame([(f"n/{k}.json", json.dumps({"k": k}), k % 2) for k in range(6)], "to string, value string, turn int").repartition(3)
    writers._placed(parts, str(tmp_path))
    assert sorted(json.loads(p.read_text())["k"] for p in (tmp_path / "n").glob("*.json")) == list(range(6))
