"""Plans and streams from end to end."""

import json
import pathlib
import sys
import uuid

import pytest
from pyspark import cloudpickle

from lectern.model.stub import Stub
from lectern.plans import decks
from lectern.sources import readers, writers
from lectern.sources.registry import settings
from lectern.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def test_decks_and_one_failing_chapter(spark):
    text = "# Alpha\n" + "first chapter words " * 30 + "\n# Beta\nBROKEN chapter\n# Gamma\n" + "third chapter text " * 30
    docs = spark.createDataFrame([(1, text), (2, "no headings here at all, only prose")], "doc_id long, text string")
    made = decks.decks(docs, Stub(fail=("BROKEN",), flag=1), settings(chapters_for_multi=2, chars_for_multi=100, chunk_size=400, overlap_size=50, review_cycles=2)).cache()
    rows = {(r.doc_id, r.chapter): r for r in made.collect()}
    assert set(rows) == {(1, "Alpha"), (1, "Beta"), (1, "Gamma"), (2, "")}
    assert rows[1, "Beta"].error and rows[1, "Beta"].slides is None
    for key in ((1, "Alpha"), (1, "Gamma"), (2, "")):
        slides = rows[key].slides
        assert rows[key].error is None and len(slides) >= 4 and slides[-1].tag == "Summary"
    assert all("BROKEN" not in s.body for key in ((1, "Alpha"), (1, "Gamma")) for s in rows[key].slides)


def test_unresolved_notes_stay_at_the_last_cycle(spark):
    docs = spark.createDataFrame([(1, "some words of a text " * 5)], "doc_id long, text string")
    row = decks.decks(docs, Stub(flag=9), settings(review_cycles=1)).first()
    # the summary is written after the reviews
    assert row.slides[-1].tag == "Summary" and len(row.unresolved) == sum(len(s.body) % 2 for s in row.slides[:-1])


class Counting(Stub):
    """Notes each call as a file, since calls happen in workers."""

    def __init__(self, folder, **how):
        super().__init__(**how)
        self.folder = str(folder)

    def call(self, task, payload):
        with open(f"{self.folder}/{task}-{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps(payload))
        return super().call(task, payload)

    def calls(self, task):
        return [json.loads(p.read_text()) for p in pathlib.Path(self.folder).glob(f"{task}-*")]


SIXTEEN = "\n".join(f"# Part {i}\n" + f"words about topic{i} " * 8 + ("\nFigure 1: a plot [FIGURE_ID: 0]" if i == 3 else "") for i in range(14))
IMAGES = [(1, 0, 0, "Figure 1: a plot", 2, "data:image/png;base64,AA=="), (1, 1, 1, "Figure 2: never tagged", 3, "data:image/png;base64,BB==")]


def test_writer_batches_and_figures(spark, tmp_path):
    client = Counting(tmp_path)
    docs = spark.createDataFrame([(1, SIXTEEN)], "doc_id long, text string")
    images = spark.createDataFrame(IMAGES, decks.IMAGE)
    row = decks.decks(docs, client, settings(max_slides=16, review_cycles=1), images=images, prompts={"plan": "Plan $title with $figure_catalog within $max_slides."}).first()
    assert len(row.slides) == 16 and len(client.calls("write")) == 4 and len(client.calls("summarise")) == 1
    assert len(client.calls("analyse")) == 14 and len(client.calls("merge_chapter")) == 14 and len(client.calls("merge_document")) == 1
    # one slide owns the only figure that a chunk tags; whatever images a draft names are replaced
    assert [s.image_refs for s in row.slides if s.image_refs] == [[0]] and [(i["index"], i.page) for i in row.images] == [(0, 2)]
    plan = client.calls("plan")[0]
    assert plan["scope_instruction"] == "" and "[0] (conceptual, chunk 3) Figure 1: a plot" in plan["prompt"] and plan["prompt"].endswith("within 16.")
    assert all(c["headings"] for c in client.calls("analyse")) and "[chunk 3]" in "".join(c["source_text"] for c in client.calls("write"))


def test_chapters_are_scoped(spark, tmp_path):
    client = Counting(tmp_path)
    docs = spark.createDataFrame([(1, SIXTEEN)], "doc_id long, text string")
    decks.decks(docs, client, settings(chapters_for_multi=2, chars_for_multi=10, review_cycles=1)).collect()
    assert sorted(c["scope_instruction"].split('"')[1] for c in client.calls("plan")) == sorted(f"Part {i}" for i in range(14))


def test_resume_asks_only_for_what_is_missing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# One\n" + "plain words " * 9), (2, "# Two\nBROKEN words")], "doc_id long, text string")
    first, second = tmp_path / "1", tmp_path / "2"
    first.mkdir(), second.mkdir()
    how = {"root": f"{tmp_path}/cache", "key": "k"}
    broken = {r.doc_id: r.error for r in decks.decks(docs, Counting(first, fail=("BROKEN",)), settings(review_cycles=1), **how).collect()}
    assert broken[1] is None and "analyse" in broken[2]
    client = Counting(second)
    made = {r.doc_id: r for r in decks.decks(docs, client, settings(review_cycles=1), resume=True, **how).collect()}
    assert made[1].error is None and made[1].slides
    assert made[2].error is None and made[2].slides
    assert [p["text"].split()[1] for p in client.calls("analyse")] == ["Two"] and len(client.calls("plan")) == 1


def test_lists_of_objects_are_merged_and_failures_are_told(spark):
    class Listing(Stub):
        def analyse(self, p):
            return [{"core_thesis": "a", "key_concepts": ["x"]}, {"core_thesis": "b", "key_concepts": ["y", "x"]}]

        def review(self, p):
            return {"slides": [{"index": 1}]}  # no verdict: not an answer

    docs = spark.createDataFrame([(1, "some words of a text " * 5)], "doc_id long, text string")
    row = decks.decks(docs, Listing(), settings(review_cycles=1)).first()
    assert row.slides is None and "slides[0].passed: needed" in row.error


def run(spark, path, rows, stamp, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return decks.run(docs, Stub(), settings(review_cycles=1, **how), str(path), stamp=stamp, generated_at=stamp)


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.json") if "library" not in str(p) and not p.name.startswith("."))


def test_runs_publish_and_replace(spark, tmp_path):
    one, two = (1, "# Alpha beta\n" + "first text " * 9), (2, "# Gamma\nx\n# Delta: d\ny")
    run(spark, tmp_path, [one], "20260101T000000")
    made = files(tmp_path)
    assert len(made) == 1 and made[0].startswith("alpha_beta_") and made[0].endswith("_20260101T000000.json")
    run(spark, tmp_path, [two], "20260102T000000", chapters_for_multi=1, chars_for_multi=1)
    names = files(tmp_path)
    assert made[0] in names and [n.split("/")[1] for n in names if "/" in n] == ["01_gamma.json", "02_delta_d.json", "index.json"]
    deck = json.loads((tmp_path / made[0]).read_text())
    assert deck["type"] == "single_deck" and deck["title"] == "Alpha beta" and len(deck["slides"]) == 4 and deck["images"] == []
    index = json.loads((tmp_path / next(n for n in names if n.endswith("index.json"))).read_text())
    assert [d["chapter_title"] for d in index["decks"]] == ["Gamma", "Delta: d"] and index["type"] == "multi_deck"
    # the files and the manifest say the same
    held = {r.file: (r.type, r.slide_count, r.deck_count, r.generated_at) for r in writers.read_library(spark, f"{tmp_path}/library").collect()}
    rebuilt = {r.file: (r.type, r.slide_count, r.deck_count, r.generated_at) for r in readers.rebuilt_library(spark, str(tmp_path)).where("file not like '/library/%'").collect()}
    assert held == rebuilt and len(held) == 2
    # the same content again: the new deck replaces the old one; with keep_both, both stay
    run(spark, tmp_path, [one], "20260103T000000")
    again = [n for n in files(tmp_path) if n.startswith("alpha")]
    assert len(again) == 1 and "20260103" in again[0]
    run(spark, tmp_path, [one], "20260103T000000", duplicate_policy="keep_both")
    assert [n.split("_", 3)[3] for n in files(tmp_path) if n.startswith("alpha")] == ["20260103T000000.json", "20260103T000000_2.json"]
    assert writers.read_library(spark, f"{tmp_path}/library").count() == 3


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    one = (1, "# Alpha\n" + "first text " * 9)
    run(spark, tmp_path, [one], "20260101T000000")
    before = [r.file for r in writers.read_library(spark, f"{tmp_path}/library").collect()]
    for step in ("update_library", "delete_outputs"):
        with monkeypatch.context() as m:
            m.setattr(writers, step, lambda *a: 1 / 0)
            try:
                run(spark, tmp_path, [one], f"2026020{len(step) % 9}T000000")
            except ZeroDivisionError:
                pass
        held = [r.file for r in writers.read_library(spark, f"{tmp_path}/library").collect()]
        assert held and all((tmp_path / f.lstrip("/")).exists() for f in held) and (tmp_path / before[0].lstrip("/")).exists()


def test_uploads_run_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.txt").write_bytes(b"y")
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    run = lambda work: jobs.run_jobs(jobs.uploads(spark, f"{tmp_path}/in"), work, out, check, once=True).awaitTermination()
    run(lambda b: b.select("job_id", "doc_hash"))
    (tmp_path / "in" / "c.pdf").write_bytes(b"z")

    def bad(batch):
        raise RuntimeError("no parser")

    run(bad)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in jobs.statuses(spark, out).collect()}
    assert got == {"a.pdf": "done", "c.pdf": "error"}
    assert jobs.resumable(jobs.statuses(spark, out)).count() == 1
    jobs.resume_jobs(spark, f"{tmp_path}/in", lambda b: b.select("job_id", "doc_hash"), out)
    assert {r.path.rsplit("/", 1)[1]: r.status for r in jobs.statuses(spark, out).collect()} == {"a.pdf": "done", "c.pdf": "done"}
    (tmp_path / "in" / "d.pdf").write_bytes(b"q")

    def lost(batch):
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")

    with pytest.raises(Exception, match="ExecutorLostFailure"):
        run(lost)
    run(lambda b: b.select("job_id", "doc_hash"))  # the same batch again
    assert {r.path.rsplit("/", 1)[1]: r.status for r in jobs.statuses(spark, out).collect()}["d.pdf"] == "done"


def test_progress(spark):
    df = spark.createDataFrame([("j", "s", 1, 3, 1, 1), ("j", "s", 2, 3, 2, 2), ("j", "t", 0, 1, 1, 3)], "job_id string, stage string, completed long, total long, ts long, event_id long")
    assert {(r.stage, r.completed) for r in jobs.progress(df).collect()} == {("s", 2), ("t", 0)}


def test_chapters_with_very_many_maps_are_merged_in_levels(spark, monkeypatch):
    text = "# One\n" + " ".join(f"wordnumber{i:04d}" for i in range(500))
    run_ = lambda: decks.decks(spark.createDataFrame([(1, text)], "doc_id long, text string"), Stub(), settings(chunk_size=500, overlap_size=0)).collect()
    at_once, most, levels = run_(), [], decks.merged_in_levels

    def counted(steps, maps, keys, *rest):
        out = levels(steps, maps, keys, *rest)
        most.append((maps.groupBy(*keys).count().agg({"count": "max"}).first()[0], out[0].groupBy(*keys).count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(decks, "FAN_IN", 3)
    monkeypatch.setattr(decks, "merged_in_levels", counted)
    assert run_() == at_once and at_once[0].slides
    assert most[0][0] > 9 and most[0][1] <= 3
