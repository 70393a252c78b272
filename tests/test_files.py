"""The data source of files: partitions, filters on paths, files placed by executors."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, pdf_writer


def folder(tmp_path):
    for k in range(6):
        to = tmp_path / ("a" if k % 2 else "b")
        to.mkdir(exist_ok=True)
        (to / f"f{k}.pdf").write_bytes(pdf_writer.made([f"Title {k}", "more text that is longer"], bool(k % 3)))
    (tmp_path / "a" / "notes.txt").write_text("text ü\nb")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_reads_files_in_partitions(spark, tmp_path):
    files.register(spark)
    path = folder(tmp_path)
    read = spark.read.format("lectern").option("suffix", ".pdf")
    rows = read.load(path).select("path", "page", "error", F.col("lines")[0]["text"].alias("t")).collect()
    assert sorted(r.t for r in rows) == [f"Title {k}" for k in range(6)] and not any(r.error for r in rows)
    split = read.option("partitionBytes", 2 * files.OPENING).load(path)
    assert split.select(F.spark_partition_id().alias("p")).distinct().count() == 6 and split.count() == 6
    text = spark.read.format("lectern").option("kind", "text").option("suffix", ".txt").load(path).collect()
    assert [(r.text, r.length) for r in text] == [("text ü\nb", 9)]
    assert spark.read.format("lectern").option("kind", "binary").load(path).count() == 7
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("lectern").option("kind", "x").load(path)


def test_filters_on_paths_choose_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

    path = folder(tmp_path)
    for f, n in ((StringStartsWith(("path",), f"{path}/a"), 4), (StringEndsWith(("path",), "2.pdf"), 1), (StringContains(("path",), "/b/"), 3), (EqualTo(("path",), f"{path}/b/f0.pdf"), 1), (In(("path",), (f"{path}/b/f0.pdf", "x")), 1)):
        reader = files.FileReader({"path": path})
        assert list(reader.pushFilters([f, GreaterThan(("page",), 1)])) == [GreaterThan(("page",), 1)]
        assert len(reader.files()) == n and sum(len(p.paths) for p in reader.partitions()) == n
    none = files.FileReader({"path": path})
    list(none.pushFilters([EqualTo(("path",), "nowhere")]))
    assert none.files() == [] and none.partitions() == [files.Files([])]


def test_filtered_files_are_not_opened(spark, tmp_path):
    files.register(spark)
    path = folder(tmp_path)
    (tmp_path / "b" / "f0.pdf").chmod(0)
    (tmp_path / "b" / "gone.pdf").symlink_to(tmp_path / "nowhere")
    found = spark.read.format("lectern").option("suffix", ".pdf").load(path).where(F.col("path").startswith(f"{path}/a/"))
    assert found.count() == 3
    assert "PushedFilters" in found._jdf.queryExecution().toString() or found.where("path = 'x'").count() == 0


def test_executors_place_files(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.json", f"value ü {k}") for k in range(20)], "to string, value string").repartition(5)
    rows.write.format("lectern").mode("append").save(path)
    found = sorted((str(p.relative_to(path)), p.read_text()) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert found == sorted((r.to, r.value) for r in rows.collect())
    rows.write.format("lectern").mode("append").save(path)  # the same again changes nothing
    with pytest.raises(Exception, match="FileExistsError"):
        rows.withColumn("value", F.lit("other")).write.format("lectern").mode("append").save(path)
    assert sorted(p.read_text() for p in (tmp_path / "out").rglob("*.json")) == sorted(v for _, v in found) and not list((tmp_path / "out").glob(".placed*"))
    with pytest.raises(Exception, match="append"):
        rows.write.format("lectern").mode("overwrite").save(path)


def in_archives(spark, path):
    from lectern.sources import writers

    rows = [(f"{k}.pdf", bytearray(pdf_writer.made([f"Title {k}", "more text that is longer"], bool(k % 3))), "de" if k % 2 else "fr") for k in range(40)]
    writers.archive(spark.createDataFrame([*rows, ("notes.txt", bytearray(b"x"), "de")], "name string, content binary, lang string").repartition(3), path, ["lang"])
    return path


def test_reads_files_in_archives(spark, tmp_path):
    files.register(spark)
    path = in_archives(spark, str(tmp_path / "held"))
    read = spark.read.format("lectern").option("archive", ".parquet").option("suffix", ".pdf")
    rows = read.load(path).select("path", "error", F.col("lines")[0]["text"].alias("t")).collect()
    assert sorted(r.t for r in rows) == sorted(f"Title {k}" for k in range(40)) and not any(r.error for r in rows)
    assert all(r.path.endswith(f"/{r.t[6:]}.pdf") for r in rows)
    assert read.load(path).where(F.col("path").endswith("/7.pdf")).count() == 1
    text = spark.read.format("lectern").option("archive", ".parquet").option("kind", "text").option("suffix", ".txt").load(path).collect()
    assert [(r.text, r.length) for r in text] == [("x", 1)]


def test_filters_on_paths_choose_archives(spark, tmp_path):
    """Archives of which no file can pass are not opened; of the others, the files that pass are read."""
    from pyspark.sql.datasource import EqualTo, In, StringContains, StringEndsWith, StringStartsWith

    path = in_archives(spark, str(tmp_path / "held"))
    every = [p for p, _ in files.FileReader({"path": path, "archive": ".parquet"}).files()]
    one = next(p for p in every if "/lang=de/" in p)
    held = [f"{p}/{n}" for p in every for n in spark.read.parquet(p).select("name").toPandas()["name"]]
    for f, test, opened in (
        (StringContains(("path",), "/lang=de/"), lambda p: "/lang=de/" in p, sum("/lang=de/" in p for p in every)),
        (StringContains(("path",), "=fr/part-"), lambda p: "=fr/part-" in p, sum("/lang=fr/" in p for p in every)),
        (StringContains(("path",), "7.pd"), lambda p: "7.pd" in p, len(every)),
        (StringContains(("path",), "parquet/7"), lambda p: "parquet/7" in p, len(every)),
        (StringStartsWith(("path",), f"{path}/lang=d"), lambda p: "/lang=de/" in p, sum("/lang=de/" in p for p in every)),
        (StringStartsWith(("path",), f"{one}/1"), lambda p: p.startswith(f"{one}/1"), 1),
        (StringEndsWith(("path",), ".parquet/11.pdf"), lambda p: p.endswith("/11.pdf"), len(every)),
        (StringEndsWith(("path",), "x/11.pdf"), lambda p: False, 0),
        (EqualTo(("path",), f"{one}/1.pdf"), lambda p: p == f"{one}/1.pdf", 1),
        (In(("path",), (f"{one}/1.pdf", None, f"{one}/x/1.pdf")), lambda p: p == f"{one}/1.pdf", 1),
    ):
        reader = files.FileReader({"path": path, "kind": "binary", "archive": ".parquet"})
        assert list(reader.pushFilters([f])) == [] and len(reader.files()) == opened, f
        assert sorted(p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()) == sorted(filter(test, held)), f


def test_queries_write_few_files(spark, tmp_path, monkeypatch):
    """A file each would cost the driver a move and an entry of its listing."""
    from lectern import file_queries, storage

    for query in (file_queries.pdf_pages, file_queries.source_pushdown):
        root = tmp_path / query.__name__
        monkeypatch.setattr(storage, "shared_dir", lambda _: str(root))
        assert query(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() > 20
        assert 0 < len([p for p in root.rglob("*.*") if p.is_file() and p.suffix != ".crc"]) <= 40
