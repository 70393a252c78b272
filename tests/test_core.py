"""Operators on small literals."""

import collections
import json
import pathlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.model import client
from lectern.operators import blocks, chunking, cost, figures, geometry, library, reviews, sections, tables, validation
from lectern.session import ship
from lectern.sources import readers, registry, writers


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, slug",
    [("Chapter 1: The Cell / Is it Alive?", "chapter_1_the_cell_is_it_alive"), ("  leading / trailing  ", "leading_trailing"), ("well-known result", "well_known_result"), ("", ""), ("a" * 200, "a" * 80), ("Café ﬁle", "cafe_file")],
)
def test_slug(spark, text, slug):
    assert col(spark, text, T.slug) == slug


@pytest.mark.parametrize(
    "text, value", [('here is the result: [{"value": "a"}] end', '[{"value": "a"}]'), ("plain prose", None), ('```json\n{"a": [1]}\n```', '{"a": [1]}'), ("{ never closed", None)]
)
def test_json_slice(spark, text, value):
    assert col(spark, text, T.json_slice) == value


def test_substitute_takes_longer_names_first(spark):
    out = spark.range(1).select(T.substitute("$a $ab ${a} $z", {"a": F.lit("1"), "ab": F.lit("2")}).alias("y")).first().y
    assert out == "1 2 1 $z"


# ---- chunks


def chunked(spark, text, size, overlap, **how):
    out = chunking.chunk_chars(spark.createDataFrame([(1, text)], "doc_id long, text string"), size, overlap, **how)
    return [r.chunk for r in out.orderBy("chunk_idx").collect()]


def test_tail_chunk_may_lie_inside_the_one_before(spark):
    assert [len(c) for c in chunked(spark, "x" * 13_500, 8000, 1500)] == [8000, 7000, 500]


def test_blank_line_near_the_start_moves_on_by_characters(spark):
    text = "a" * 100 + "\n\n" + "b" * 9000
    assert len(chunked(spark, text, 8000, 1500)) == 102
    assert len(chunked(spark, text, 8000, 1500, strict=True)) < 6


def test_large_text(spark):
    chunks = chunked(spark, "word " * 100_000, 8000, 1500)
    assert 50 <= len(chunks) <= 200 and all(len(c) <= 8000 for c in chunks)


def test_null_blank_and_short_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "  \n "), (3, " kept as is ")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk) for r in chunking.chunk_chars(df, 100, 10).collect()] == [(3, " kept as is ")]


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_windows_cover_the_text(text, size, overlap):
    spans = list(chunking.Snap(text, size, overlap).spans())
    covered = {i for a, b in spans for i in range(a, min(b, len(text)))}
    # where a window begins at a blank line, only its first line feed is passed over
    assert covered >= {i for i, c in enumerate(text) if c != "\n"}
    assert all(b - a <= size for a, b in spans) and [a for a, _ in spans] == sorted({a for a, _ in spans})


def test_sections_repeat_their_heading(spark):
    text = "pre\n# One\n" + "x" * 50 + "\n### not a cut\n## Two\nshort"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.chunk for r in chunking.chunk_sections(df, 40, 5).orderBy("chunk_idx").collect()]
    assert got[0] == "pre" and got[-1] == "## Two\nshort"
    assert all(c.startswith("# One\n") and len(c) <= 40 for c in got[1:-1])


# ---- blocks and tables


def test_furniture_and_missing_crops(spark):
    rows = [
        (1, 0, "footer", "f", None, 0, None, None, None, None, None, False),
        (1, 1, "image", None, None, 0, "a.png", ["Figure 1"], None, None, None, False),
        (1, 2, "image", None, None, 0, "b.png", ["Figure 2"], None, None, None, True),
        (1, 3, "text", "  ", None, 0, None, None, None, None, None, False),
    ]
    parts = blocks.rendered_blocks(spark.createDataFrame(rows, blocks.BLOCK))
    assert [r.part for r in parts.collect()] == ["Figure 2 [FIGURE_ID: 0]"]
    assert blocks.figures(parts).first().page == 1


def test_table_rules(spark):
    many = "\n".join(["| a |"] * 71)
    df = spark.createDataFrame([(1, many), (2, "| a | b |\n|---|---|\n| c | d |"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in tables.clean_tables(df).collect()}
    assert got[1] == "[TABLE]\n" and got[2].startswith("| a | b |") and got[3] == ""


# ---- figures


def catalog(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, figure_id long, source_chunk long")


@pytest.mark.parametrize(
    "slides, figure, owner",
    [
        ([(1, [0], 99)], (5, 0), None),
        ([(1, [0], 8), (2, [2], 8)], (8, 2), 2),
        ([(1, [0], 4), (2, [1], 4)], (4, 5), 1),
        ([(1, [0], 6)], (6, 9), 1),
    ],
)
def test_owner(spark, slides, figure, owner):
    req = spark.createDataFrame([(1, *s) for s in slides], "doc_id long, slide_index long, chunk_indices array<long>, figure_id long")
    got = figures.figure_owners(req, catalog(spark, [(1, *figure)])).collect()
    assert [r.slide_index for r in got] == ([owner] if owner else [])


def test_cap_keeps_three(spark):
    req = spark.createDataFrame([(1, 1, [0], f) for f in (1, 2, 3, 4)], "doc_id long, slide_index long, chunk_indices array<long>, figure_id long")
    owners = figures.figure_owners(req, catalog(spark, [(1, 1, 5), (1, 2, 0), (1, 3, 0), (1, 4, 0)]))
    assert sorted(r.figure_id for r in figures.capped_figures(owners).collect()) == [2, 3, 4]


# ---- geometry


@pytest.mark.parametrize(
    "figure, caption, gap",
    [((10, 50, 200, 180), (10, 185, 200, 200), 5), ((10, 50, 200, 180), (10, 180, 200, 195), 0), ((10, 50, 190, 180), (300, 185, 490, 200), None), ((10, 50, 200, 180), (200, 185, 390, 200), None), ((10, 50, 200, 180), (10, 260, 200, 275), 80), ((10, 50, 200, 180), (10, 261, 200, 275), None)],
)
def test_pairs(spark, figure, caption, gap):
    schema = "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double"
    f, c = (spark.createDataFrame([(1, 0, 1, *map(float, r))], schema) for r in (figure, caption))
    assert [r.gap for r in geometry.caption_pairs(f, c).collect()] == ([] if gap is None else [float(gap)])


def test_nearer_figure_wins_and_orphans_stay(spark):
    schema = "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double"
    f = spark.createDataFrame([(1, 0, 1, 10.0, 70.0, 200.0, 120.0), (1, 0, 2, 10.0, 125.0, 200.0, 180.0)], schema)
    c = spark.createDataFrame([(1, 0, 7, 10.0, 50.0, 200.0, 65.0), (2, 0, 8, 0.0, 0.0, 1.0, 1.0)], schema)
    got = {(r.figure_id, r.caption_id) for r in geometry.paired_figures(f, c).collect()}
    assert got == {(1, 7), (2, None), (None, 8)}


def test_panels_merge_transitively(spark):
    schema = "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double, confidence double"
    rows = [(1, 0, i, 40.0 * i, 0.0, 40.0 * i + 25, 20.0, i / 10) for i in range(4)] + [(1, 0, 9, 0.0, 300.0, 9.0, 310.0, 0.5)]
    got = sorted((r.component, r.x0, r.x1, r.confidence) for r in geometry.merged_panels(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0.0, 145.0, 0.3), (9, 0.0, 9.0, 0.5)]


def test_captions_absorb_what_follows(spark):
    schema = "doc_id long, page int, ord int, kind int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [
        (1, 0, 0, 0, "Body", 0.0, 0.0, 9.0, 9.0), (1, 0, 1, 0, "Figure 1. A photo-", 0.0, 10.0, 50.0, 20.0), (1, 0, 2, 0, "graph of it", 0.0, 25.0, 60.0, 30.0),
        (1, 0, 3, 0, "far away", 0.0, 60.0, 60.0, 70.0), (1, 0, 4, 0, "Table 2", 0.0, 80.0, 9.0, 85.0), (1, 0, 5, 1, None, 0.0, 86.0, 9.0, 90.0), (1, 0, 6, 0, "after an image", 0.0, 90.0, 9.0, 95.0),
    ]
    got = [(r.text, r.x1, r.y1) for r in geometry.scan_captions(spark.createDataFrame(rows, schema)).orderBy("caption_ord").collect()]
    assert got == [("Figure 1. A photograph of it", 60.0, 30.0), ("Table 2", 9.0, 85.0)]


def test_figure_regions(spark):
    caps = spark.createDataFrame([(1, 0, 1, "Figure 1", 100.0, 400.0, 300.0, 420.0), (2, 0, 1, "Figure 1", 100.0, 400.0, 300.0, 420.0)], "doc_id long, page int, caption_ord int, text string, x0 double, y0 double, x1 double, y1 double")
    draw = spark.createDataFrame([(1, 0, True, 100.0, 200.0, 300.0, 390.0), (1, 0, False, 100.0, 430.0, 300.0, 431.0)], "doc_id long, page int, filled boolean, x0 double, y0 double, x1 double, y1 double")
    text = spark.createDataFrame([(2, 0, 0, 0, 10.0, "Prose.", 90.0, 100.0, 310.0, 250.0), (2, 0, 1, 0, 10.0, "More.", 90.0, 430.0, 310.0, 500.0)], "doc_id long, page int, ord int, kind int, size double, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(k, 0, 0.0, 0.0, 600.0, 800.0, 10.0) for k in (1, 2)], "doc_id long, page int, px0 double, py0 double, px1 double, py1 double, body_size double")
    got = {r.doc_id: (r.x0, r.y0, r.x1, r.y1, r.source) for r in geometry.figure_regions(caps, draw, text, pages).collect()}
    assert got == {1: (92.0, 192.0, 308.0, 398.0, "drawing"), 2: (92.0, 250.0, 308.0, 400.0, "above")}


# ---- outlines


def test_chapters(spark):
    outline = spark.createDataFrame([(1, 0, 0, 1, "Introduction"), (1, 1, 3, 1, "Methods"), (1, 2, 6, 1, "Results")], "doc_id long, ord int, position int, level int, heading string")
    items = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(9)], "doc_id long, chunk_idx int")
    got = [(r.doc_id, r.chapter) for r in sections.chapter_of(items, outline).orderBy("doc_id", "chunk_idx").collect()]
    assert got == [(1, "Introduction")] * 3 + [(1, "Methods")] * 3 + [(1, "Results")] * 3 + [(2, "main")] * 9


def test_trim(spark):
    rows = [(1, 0, 0, 1, "1"), (1, 1, 1, 2, "1.1"), (1, 2, 2, 1, "2"), (1, 3, 3, 2, "2.1"), (1, 4, 5, 1, "3")]
    outline = spark.createDataFrame(rows, "doc_id long, ord int, position int, level int, heading string")
    got = [r.heading for r in sections.trimmed_outline(spark.createDataFrame([(1, 2)], "doc_id long, chunk_idx int"), outline).orderBy("ord").collect()]
    assert got == ["1", "2", "2.1", "3"]


@pytest.mark.parametrize("chapters, chars, mode", [(4, 50_000, "multi"), (4, 1000, "single"), (2, 50_000, "single"), (3, 50_000, "single"), (4, 40_000, "single"), (4, 40_001, "multi")])
def test_routes(spark, chapters, chars, mode):
    assert sections.routed(spark.createDataFrame([(chapters, chars)], "chapters long, total_chars long"), most_chars=40_000).first().mode == mode


def test_upper_median(spark):
    df = spark.createDataFrame([(1, x) for x in (8.0, 9.0, 10.0, 12.0)] + [(2, 0.0)], "doc_id long, size double")
    assert {r.doc_id: r.body_size for r in sections.body_size(df).collect()} == {1: 10.0, 2: 10.0}


# ---- cost, reviews, rules


def test_prices(spark):
    usage = spark.createDataFrame([("openai", "gpt-4o", 1_000_000, 0), ("ollama", "x", 5, 5), ("nobody", "x", 5, 5)], "provider string, model string, input_tokens long, output_tokens long")
    got = {r.provider: (r.cost, r.price_known) for r in cost.priced(usage, cost.prices(spark)).collect()}
    assert got == {"openai": (2.5, True), "ollama": (0.0, True), "nobody": (0.0, False)}


def test_reviews(spark):
    issue = "array<struct<type:string,detail:string>>"
    df = spark.createDataFrame([(1, 1, True, []), (1, 2, False, [("a", "b"), ("c", "d")]), (1, 3, False, []), (2, 1, True, [])], f"doc_id long, slide_index long, passed boolean, issues {issue}")
    assert {r.doc_id: r.all_passed for r in reviews.verdicts(df, "doc_id").collect()} == {1: False, 2: True}
    assert [r.note for r in reviews.unresolved(df, "doc_id").orderBy("slide_index").collect()] == ["a: b", "failed without an issue"]
    assert reviews.critiques(df, "doc_id").first().critique == "Slide 2: b; d\nSlide 3: "


def test_rules(spark):
    df = spark.createDataFrame([([1], "x"), ([1, 2, 3, 4], ""), (None, None)], "chunk_indices array<int>, body string")
    rules = [validation.Rule("chunk_indices", least=1, most=3, measure="items"), validation.Rule("body", least=1, most=1200, measure="chars")]
    assert [r.errors for r in validation.validated(df, rules).collect()] == [[], ["chunk_indices", "body"], ["chunk_indices", "body"]]


def test_batches(spark):
    df = spark.createDataFrame([(1, i) for i in range(16)], "doc_id long, slide_index long")
    assert sorted(r["count"] for r in reviews.batches(df, 5, key=["doc_id"], order="slide_index").groupBy("batch").count().collect()) == [1, 5, 5, 5]


# ---- model calls


class Script:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), 0

    def call(self, task, payload):
        self.asked += 1
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_answers_are_repaired_and_merged():
    caller = client.Caller(Script("prose", '{"b": 1}', 'so: [{"a": [1]}, {"a": [2, 1]}]'), lists={"t": {"a"}}, required={"t": {"a"}})
    assert caller("t", {}) == {"a": [1, 2]}
    with pytest.raises(ValueError):
        client.object_of([{"x": "a"}, {"y": "b"}], set())
    assert client.object_of([{"value": "ok"}], set()) == {"value": "ok"}


def test_transient_errors_wait_and_fatal_ones_do_not():
    waits = []
    caller = client.Caller(Script(client.Transient(), client.Transient(), "{}"), sleep=waits.append)
    assert caller("t", {}) == {} and waits == [4.0, 8.0]
    script = Script(client.Fatal())
    with pytest.raises(client.Fatal):
        client.Caller(script, sleep=waits.append)("t", {})
    assert script.asked == 1


def test_breaker_opens_and_probes():
    now = [0.0]
    b = client.Breaker(after=2, pause=10, now=lambda: now[0])
    b.failure(), b.failure()
    with pytest.raises(client.Open):
        b.check()
    now[0] = 11
    b.check()
    b.failure()
    with pytest.raises(client.Open):
        b.check()


# ---- library, sources, sinks


def entry(file, at, h="h", archived=False):
    return (file, file, "single_deck", at, "p", "m", h, 1, 1, archived)


def test_library_on_disk(spark, tmp_path):
    path = f"{tmp_path}/library"
    assert writers.read_library(spark, path).count() == 0
    writers.write_library(spark.createDataFrame([entry("/a", "1"), entry("/b", "2", archived=True)], library.ENTRY), path)
    lib = library.upserted(writers.read_library(spark, path), spark.createDataFrame([entry("/a", "3"), entry("/c", "0")], library.ENTRY))
    writers.write_library(lib, path)
    assert [(r.file, r.generated_at) for r in writers.read_library(spark, path).collect()] == [("/a", "3"), ("/b", "2"), ("/c", "0")]
    left = library.pruned(writers.read_library(spark, path), spark.createDataFrame([("h", "/c")], "doc_hash string, keep_file string"))
    assert sorted(r.file for r in left.collect()) == ["/b", "/c"]


def test_rebuild_from_files(spark, tmp_path):
    out = tmp_path / "outputs"
    (out / "book").mkdir(parents=True)
    (out / "archive").mkdir()
    slide = {"index": 1, "tag": "t", "heading": "h", "body": "b", "image_refs": []}
    (out / "one.json").write_text(json.dumps({"title": "One", "type": "single_deck", "generated_at": "2", "slides": [slide, slide]}))
    (out / "archive" / "old.json").write_text(json.dumps({"title": "Old", "slides": [slide]}))
    (out / "book" / "index.json").write_text(json.dumps(indent=2, obj={"title": "Book", "type": "multi_deck", "decks": [{"chapter_title": "c", "file": "01.json"}, {"chapter_title": "d", "file": "none.json"}]}))
    (out / "book" / "01.json").write_text(json.dumps({"slides": [slide] * 3}))
    (out / "broken.json").write_text("{")
    got = {r.title: (r.file, r.type, r.slide_count, r.deck_count, r.archived) for r in readers.rebuilt_library(spark, str(out)).collect()}
    assert got == {"One": ("/one.json", "single_deck", 2, 1, False), "Old": ("/archive/old.json", "single_deck", 1, 1, True), "Book": ("/book/index.json", "multi_deck", 3, 2, False)}


def test_block_lists(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(indent=2, obj=[{"type": "text", "text": "Hi", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<tr><td>a</td></tr>", "table_caption": ["T"]}]))
    got = readers.block_lists(spark, str(tmp_path))
    assert blocks.markdown(blocks.rendered_blocks(got)).first().text == "# Hi\n\nT\n\n| a |\n| --- |"


def test_parsed_documents(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"12345")
    (tmp_path / "x.txt").write_bytes(b"no")
    docs = readers.parsed_documents(readers.binary_documents(spark, str(tmp_path)), lambda b: ("a", b.decode() * 3))
    row = docs.first()
    assert docs.count() == 1 and row.markdown == "12345" * 3 and row.sparse


def test_stages_and_settings(spark, tmp_path):
    writers.save_stage(spark.range(3), str(tmp_path), "k", "s")
    assert readers.stage(spark, str(tmp_path), "k", "s", resume=True).count() == 3
    assert readers.stage(spark, str(tmp_path), "k", "s", resume=False) is None and readers.stage(spark, str(tmp_path), "k", "none", resume=True) is None
    writers.point_to(spark, str(tmp_path), "k", "/out")
    assert writers.output_of(spark, str(tmp_path), "k") == "/out" and writers.output_of(spark, str(tmp_path), "z") is None
    writers.clear_stages(spark, str(tmp_path), "k")
    assert readers.stage(spark, str(tmp_path), "k", "s", resume=True) is None
    (tmp_path / "s.json").write_text('{"PROVIDER": "mine", "MODELS": {"mine": "m"}, "PIPELINE": {"chunk_size": 5}}')
    said = registry.settings(str(tmp_path / "s.json"))
    assert (said.chunk_size, said.overlap_size, said.model, list(said.models)) == (5, 1500, "m", ["mine"])
    for bad in ('{"PIPELINE": {"nothing": 1}}', '{"PROVIDER": "none"}', "{", '{"chunk_size": 5}'):
        (tmp_path / "s.json").write_text(bad)
        with pytest.raises(ValueError):
            registry.settings(str(tmp_path / "s.json"))
    with pytest.raises(ValueError):
        registry.settings(nothing=1)
    with pytest.raises(ValueError):
        registry.settings(duplicate_policy="maybe")
    with pytest.raises(ValueError, match="blocks, pdf, text"):
        registry.extractor("none")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lectern import storage

    none = SimpleNamespace(get=lambda *a: None)
    context = lambda master: SimpleNamespace(master=master, getConf=lambda: none, getCheckpointDir=lambda: None)
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            storage.shared_dir(SimpleNamespace(sparkContext=context(master), conf=none))


def test_scratch_tables_can_be_deleted(spark, tmp_path):
    from lectern import storage

    scratch = storage.Scratch(spark, "t")
    folder = pathlib.Path(scratch.path("a").removeprefix("file:"))
    scratch.save(spark.range(3), "a")
    assert folder.exists()
    storage.clean(spark)
    assert not folder.exists()


def test_library_manifest_missing_or_corrupt(spark, tmp_path):
    assert readers.library(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{[")
    assert readers.library(spark, f"{tmp_path}/bad.json").count() == 0


def test_blank_images(spark):
    from lectern.functions.images import is_blank

    df = spark.createDataFrame([(1, bytearray(b"\xff" * 3000), 3), (2, bytearray(b"\xff" * 2997 + b"\x00" * 3000), 3), (3, None, 3), (4, bytearray(b"\xfa" * 4), 1)], "id int, px binary, n int")
    assert {r.id: r.b for r in df.select("id", is_blank(F.col("px"), F.col("n")).alias("b")).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_command_line(spark, tmp_path, capsys):
    from lectern.__main__ import main

    (tmp_path / "a.txt").write_text("# One\n" + "word " * 400 + "\nsecond line\n")
    docs = readers.text_documents(spark, str(tmp_path)).collect()
    assert [d.text for d in docs] == [(tmp_path / "a.txt").read_text()]
    main(["estimate", str(tmp_path)])
    assert "claude-sonnet" in capsys.readouterr().out
    main(["run", str(tmp_path), "--fast", "--provider", "stub", "--out", f"{tmp_path}/out", "--cache", f"{tmp_path}/cache", "--resume", "--max-concurrent", "2"])
    assert "single" in capsys.readouterr().out and len(list((tmp_path / "out").glob("one_*.json"))) == 1


def test_unions_of_partitioned_rows_lose_nothing(spark):
    """What trimmed_outline() makes of many items and sections: a union of two inputs partitioned by key, used twice."""
    ship(spark)
    events = spark.range(4000).select((F.col("id") % 37).alias("doc_id"), F.col("id").alias("e"), (F.col("id") * 7919 % 5).alias("kind"))
    numbered = events.withColumn("chunk_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("e")).cast("long"))
    items = numbered.where("kind = 4").select("doc_id", "chunk_idx")
    outline = numbered.where("kind < 3").select("doc_id", F.col("chunk_idx").alias("ord"), F.col("chunk_idx").alias("position"), F.when(F.col("kind") == 0, 1).otherwise(2).alias("level"), F.col("e").cast("string").alias("heading"))
    got = {tuple(r) for r in sections.trimmed_outline(items, outline).collect()}
    rows, tops = outline.collect(), collections.defaultdict(list)
    for r in rows:
        if r.level == 1:
            tops[r.doc_id].append(r.position)
    want = set()
    for i in items.collect():
        start = max([p for p in tops[i.doc_id] if p <= i.chunk_idx] or [min(tops[i.doc_id], default=0)])
        want |= {(i.doc_id, i.chunk_idx, r.ord, r.heading) for r in rows if r.doc_id == i.doc_id and (r.level == 1 or r.position >= start)}
    assert got == want and len(want) > 10_000


def test_providers_of_their_own_form():
    from lectern.model import providers

    sent, replies = [], []

    def post(url, headers, body, timeout):
        sent.append((url, headers, body))
        return replies.pop(0)

    google = providers.Gemini("gem", "k", post=post)
    replies.append((200, json.dumps({"candidates": [{"content": {"parts": [{"text": "hm", "thought": True}, {"text": '{"a":'}, {"text": " 1}"}]}}]})))
    assert google.call("t", {"prompt": "p", "rejected": ["bad", "again"]}) == '{"a": 1}'
    url, headers, body = sent[-1]
    assert url.endswith("/models/gem:generateContent") and headers == {"x-goog-api-key": "k"}
    assert [(c["role"], c["parts"][0]["text"]) for c in body["contents"]] == [("user", "p"), ("model", "bad"), ("user", "again")]
    assert body["generationConfig"]["responseMimeType"] == "application/json" and body["systemInstruction"]
    for reply, kind in (
        ((400, '{"error": {"status": "RESOURCE_EXHAUSTED"}}'), client.Transient), ((503, "down"), client.Transient), ((429, "[]"), client.Transient),
        ((400, '{"error": {"status": "INVALID_ARGUMENT"}}'), client.Fatal), ((200, '{"promptFeedback": {"blockReason": "SAFETY"}}'), client.Fatal),
    ):
        replies.append(reply)
        with pytest.raises(kind):
            google.call("t", {})
    other = providers.Messages("m", "k", post=post)
    replies.append((200, json.dumps({"content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "[]"}]})))
    assert other.call("t", {"prompt": "p"}) == "[]" and sent[-1][1]["x-api-key"] == "k" and sent[-1][2]["max_tokens"] > 0 and sent[-1][2]["messages"] == [{"role": "user", "content": "p"}]
    replies.append((529, "overloaded"))
    with pytest.raises(client.Transient):
        other.call("t", {})


def test_providers():
    from lectern.model import providers

    said = []

    def post(url, headers, body, timeout):
        said.append((headers, body))
        return (200, json.dumps({"choices": [{"message": {"content": '{"a": 1}'}}]})) if len(said) == 1 else (int(body["model"]), "no")

    http = lambda model: providers.Http(model, "k", post=post)
    assert http("m").call("t", {"prompt": "p", "rejected": ["x", "wrong"]}) == '{"a": 1}'
    assert said[0][0] == {"Authorization": "Bearer k"} and [(m["role"], m["content"]) for m in said[0][1]["messages"]] == [("user", "p"), ("assistant", "x"), ("user", "wrong")]
    for status, kind in (("429", client.Transient), ("503", client.Transient), ("400", client.Fatal), ("401", client.Fatal)):
        with pytest.raises(kind):
            http(status).call("t", {})
    with pytest.raises(client.Transient):
        providers.Http("m", url="http://127.0.0.1:9/", timeout=1).call("t", {})
    assert providers.client_for("google-fast", "m").provider == "google"
    with pytest.raises(ValueError, match="anthropic"):
        providers.client_for("nobody", "m")


def test_corrections_name_what_is_wrong():
    from lectern.model.answers import SHAPES

    script = Script('{"title": "t", "total_slides": 99, "slides": [{"index": 1}]}', "{}", "{}")
    with pytest.raises(ValueError, match="total_slides: needed"):
        client.Caller(script, shapes=SHAPES)("plan", {"max_slides": 3})
    wrong = SHAPES["plan"].errors({"title": "t", "total_slides": 5, "slides": [{"index": 1, "tag": "odd"}] * 4}, {"max_slides": 3})
    assert any(e.startswith("slides[0].tag: needed, one of Introduction") for e in wrong) and "slides: at most 3" in wrong
