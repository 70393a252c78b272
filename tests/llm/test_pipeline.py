"""The pipeline's stages on what the stage before kept."""

import random

import zlib

import corpus_pipeline
import numpy as np
from test_ops import brute_components, brute_lines
from tokenizers import Tokenizer

from lectern.llm import quality
from lectern.session import table


def tables(spark, folder):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("lnrst") for _ in range(rnd.randint(1, 4)))
    line = lambda n=14: " ".join(word() for _ in range(n)) + "."
    good = ["\n".join(line() for _ in range(6)) for _ in range(80)]
    near = "\n".join(x.replace(".", ",") if k in (2, 5) else x for k, x in enumerate(good[3].split("\n")))  # no three lines alike
    bad = [" ".join(f"{word().upper()}!!$$" for _ in range(90)) for _ in range(40)]
    texts = good + bad + [good[0], near, "", None]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_stages_take_effect(spark, tmp_path):
    texts = tables(spark, str(tmp_path))
    docs = table(spark, str(tmp_path), "documents")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.collect()})
    assert not kept[0] & set(range(80, 120)) and len(kept[0] & set(range(80))) >= 78
    assert 120 not in kept[1] and kept[1] >= kept[0] - {120, 121}  # the copy is emptied
    assert kept[2] == kept[1] - {121}
    assert corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).where("piece = 0").count() == len(kept[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").count() == len(kept[2])
    assert len(texts) == 124


def test_run_is_that_of_brute_force(spark, tmp_path):
    """All four stages on plain lists; the scores of the first are held against a plain fit elsewhere."""
    texts = tables(spark, str(tmp_path))
    docs, labels = (table(spark, str(tmp_path), n) for n in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    left = [(i, texts[i]) for i in range(len(texts)) if scores[i] >= 0.3]
    assert 70 < len(left) < len(texts)
    lines = brute_lines([(i, t) for i, t in left if t is not None])
    left = [(i, lines[i][0] if i in lines else None) for i, _ in left if not (i in lines and lines[i][2] and not lines[i][0].strip())]
    groups = brute_components([(i, t) for i, t in left], 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    coder = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = set()
    for i, t in left:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    for n in {r.sequence_id for r in rows}:
        places = sorted((r.offset, r.length) for r in rows if r.sequence_id == n)
        assert [o for o, _ in places] == [sum(x for _, x in places[:k]) for k in range(len(places))] and sum(x for _, x in places) <= 4096


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and very long texts, ties and columns whose names the stages use themselves."""
    rows = [(i % 30 if i < 60 else None, None if i == 5 else "long " * 60_000 if i == 6 else f"text {i % 10}\nwith words {i % 10} and more of them\nthird line {i % 10}", 1, 0.5, "x") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stats int, _lines double, _gone string")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 3 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
