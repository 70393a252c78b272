"""Operators whose work must grow no faster than their rows."""

import json
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import images
from lectern.functions import text as T
from lectern.llm import hashing, packing
from lectern.model.stub import Stub
from lectern.operators import blocks as B
from lectern.operators import geometry as G
from lectern.plans import decks, stages
from lectern.sources.registry import settings


def test_a_table_of_very_many_rows(spark):
    """Cells are looked for once, and not again for each row."""
    n = 2000
    html = "<table>" + "".join(f"<tr><td>{k}</td><td>a|b</td>{'<td>x</td>' if k == 7 else ''}</tr>" for k in range(n)) + "</table>"
    began = time.time()
    df = spark.createDataFrame([(1, 0, "table", html)], "doc_id long, ord int, type string, table_body string")
    others = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in B.BLOCK.split(", ") if c.split()[0] not in df.columns}
    text = B.markdown(B.rendered_blocks(df.withColumns(others))).first().text
    assert text.split("\n")[:3] == ["| 0 | a\\|b |  |", "| --- | --- | --- |", "| 1 | a\\|b |  |"] and text.count("\n") == n and time.time() - began < 60


def test_a_bound_value_is_named_often(spark):
    got = spark.range(3).select(T.bound(F.col("id") + 1, lambda x: x * x).alias("x"), T.bound(F.lit(None).cast("long"), lambda x: F.coalesce(x, F.lit(7))).alias("y")).collect()
    assert [tuple(r) for r in got] == [(1, 7), (4, 7), (9, 7)]


def total(spark, measure: str) -> int:
    """The sum of a measure of all stages so far."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(getattr(found.apply(k), measure)() for k in range(found.size()))


def test_pages_of_few_rectangles_are_not_dealt_by_cells(spark):
    """Every rectangle is shuffled once a side, and what is counted of it, where one has some thirty cells."""
    x, y = F.pmod(F.xxhash64("id"), F.lit(500)), F.pmod(F.xxhash64(F.col("id") + 7), F.lit(700))
    rects = spark.range(60_000).select((F.col("id") % 12_000).alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("region_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 40).cast("double").alias("x1"), (y + 30).cast("double").alias("y1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total(spark, "shuffleWriteBytes")
        assert G.panel_links(rects).count() > 0
        assert total(spark, "shuffleWriteBytes") - before < 80 * rects.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowded_pages_and_others_at_once(spark):
    rows = [(1, page, k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0) for page, n in ((0, G.FEW), (1, 5), (None, 3)) for k in range(n)]
    rects = spark.createDataFrame(rows, "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double")
    assert [r.page for r in G.crowded_pages(rects, rects).collect()] in ([0], [0, None], [None, 0])
    got = G.panel_links(rects).groupBy("page").count().collect()
    assert {r.page: r["count"] for r in got} == {0: 2 * G.FEW - 3, 1: 7}


def test_encoding_needs_little_memory_beside_the_cache():
    """The slices of a batch are small, so that several workers fit beside what earlier stages hold."""
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("etaoinshr", k=rnd.randrange(2, 9))) for _ in range(3000)) for _ in range(240)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(texts)], ["doc_id", "text"])
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    peaks = []
    for part in hashing.parts(batch, 1, packing.SLICE):
        tracemalloc.start()
        coder.encode([t.encode() for t in part.column(1).to_pylist()])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 64 << 20


def test_a_wave_reads_its_own_calls(spark, tmp_path, monkeypatch):
    """Rows read are in proportion to the calls, and not to calls times waves."""
    monkeypatch.setattr(stages, "WAVE", 5)
    docs = spark.range(60).selectExpr("id as doc_id", """concat('{"slides": [{"heading": "h', id, '"}], "summary_index": 1}') as payload""")
    steps = stages.Stages(docs, Stub(), settings(max_concurrent=1), root=str(tmp_path))
    before = total(spark, "inputRecords")
    said = steps.answers(docs, "closing", "summarise", ["doc_id"])
    assert total(spark, "inputRecords") - before <= 4 * 60
    assert {r.doc_id for r in said.collect() if f'"body": "h{r.doc_id}"' in r.answer} == set(range(60))


def test_waves_of_fast_calls_grow(spark, tmp_path, monkeypatch):
    """Sixty fast calls take a few jobs and not twelve; where a wave takes long, the next has no more calls than the first."""
    monkeypatch.setattr(stages, "WAVE", 5)
    docs = spark.range(60).repartition(2).selectExpr("id as doc_id", """concat('{"slides": [{"heading": "h', id, '"}], "summary_index": 1}') as payload""")
    waves, answered = [], stages.answered
    monkeypatch.setattr(stages, "answered", lambda rows, *a, **how: waves.append(rows.count()) or answered(rows, *a, **how))
    for seconds in (1000.0, 0.0):
        monkeypatch.setattr(stages, "WAVE_SECONDS", seconds)
        said = stages.Stages(docs, Stub(), settings(max_concurrent=1), root=str(tmp_path), key=str(seconds)).answers(docs, "closing", "summarise", ["doc_id"])
        assert sorted(r.doc_id for r in said.collect() if f'"body": "h{r.doc_id}"' in r.answer) == list(range(60))
    assert waves[:2] == [5, 55] and waves[2:] == [5] * 12


def test_drawing_takes_less_than_reading():
    """Rows of pixels are filtered all at once."""
    pixels = np.random.default_rng(1).integers(0, 256, (6, 4 * 58), dtype=np.uint8)
    began = time.process_time()
    files = [images.made_png(pixels, 6) for _ in range(500)]
    drawn = time.process_time()
    assert all((images.png(f).reshape(6, -1) == pixels).all() for f in files)
    assert drawn - began < time.process_time() - drawn


def test_images_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id as p_partkey", "cast(1 + id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    saved, save = [], queries.Scratch.save
    monkeypatch.setattr(queries.Scratch, "save", lambda self, df, name: saved.append(df.rdd.getNumPartitions()) or save(self, df, name))
    assert queries.QUERIES["png_images"](spark, str(tmp_path)).count() == 400
    assert saved == [spark.sparkContext.defaultParallelism]


def test_outlines_are_not_dealt_by_chunk_and_section(spark, monkeypatch):
    """A text of n sections is analysed with n headings each, but shuffles bytes in proportion to n."""
    n, asked = 600, []
    heading = [f"Part {random.Random(k).getrandbits(128):032x}" for k in range(n)]

    def answers(self, rows, *rest):
        asked.append(rows)
        raise StopIteration

    monkeypatch.setattr(stages.Stages, "answers", answers)
    text = "\n".join(f"{'#' * (1 + k % 2)} {heading[k]}\nwords" for k in range(n))
    try:
        decks.decks(spark.createDataFrame([(1, text)], "doc_id long, text string"), Stub(), settings())
    except StopIteration:
        pass
    before = total(spark, "shuffleWriteBytes")
    rows = {r.chunk_idx: json.loads(r.payload)["headings"] for r in asked[0].collect()}
    assert total(spark, "shuffleWriteBytes") - before < 600 * n
    assert len(rows) == n and all(rows[k] == [heading[i] for i in range(n) if i % 2 == 0 or i >= k - k % 2] for k in rows)
