"""A data source of files: spark.read.format("lectern") reads documents, df.write.format("lectern") places files.

Files are listed once, dealt to partitions by size, and read and written by the executors, with any file system that Arrow knows
(local, HDFS, S3, GCS). Filters on `path` choose files before any is opened. Writers give each file its name in one move, so none is
ever half there, and the driver gets a count from each task and no names.

Very many small files are kept in archives: Parquet files of (name, content), as writers.archive() makes them. With the option `archive`,
files of that suffix are read as folders of what they hold, by the paths ARCHIVE/NAME, on which filters work as on all others; archives
that can hold nothing of what filters leave are not opened.

    register(spark)
    spark.read.format("lectern").option("kind", "pdf").load(folder).where("path like '%/2024/%'")
    files.select("to", "value").write.format("lectern").mode("append").save(folder)
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from lectern.session import ship
from lectern.sources import pdf

#: Bytes of a partition, with those that opening a file counts for; option `partitionBytes`.
PARTITION, OPENING = 64 << 20, 1 << 20
#: Files of an archive that are read at once, and bytes of texts or contents that go to Spark at once.
READ, SENT = 64, 8 << 20
KINDS = {"pdf": pdf.PAGES, "text": "text string", "binary": "content binary"}


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Placed(WriterCommitMessage):
    files: int
    marks: str


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path, re.I) else (pafs.LocalFileSystem(), path)


def _last_folder(value: str) -> str:
    return value[: value.rfind("/") + 1]


#: By kind of filter: whether a path passes, and whether any file right below a folder, whose path ends in a slash, can.
_TESTS = {
    EqualTo: (lambda p, v: p == v, lambda d, v: _last_folder(v) == d),
    In: (lambda p, v: p in v, lambda d, v: any(_last_folder(x) == d for x in v if x is not None)),
    StringStartsWith: (str.startswith, lambda d, v: d.startswith(v) or v.startswith(d)),
    StringEndsWith: (str.endswith, lambda d, v: d.endswith(_last_folder(v))),
    StringContains: (str.__contains__, lambda d, v: v in d or d.endswith(_last_folder(v))),
}


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.kind = options["path"], options.get("kind", "pdf")
        self.suffix, self.archive, self.most = options.get("suffix", ""), options.get("archive"), int(options.get("partitionbytes", PARTITION))
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes what filters say of `path`; Spark applies all others, and those on null paths, of which there are none."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("path",):
                self.tests.append((*_TESTS[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return path.lower().endswith(self.suffix) and all(test(path, v) for test, _, v in self.tests)

    def _is_archive(self, path: str) -> bool:
        return bool(self.archive) and path.lower().endswith(self.archive)

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files that filters leave, and of archives that may hold such, in order."""
        fs, root = _opened(self.root)
        scheme = self.root[: len(self.root) - len(root)] if self.root.endswith(root) else ""
        found = [(scheme + x.path, x.size or 0) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        hidden = lambda p: any(part[:1] in "._" for part in p[len(scheme + root) :].split("/") if part)
        wanted = lambda p: all(may(f"{p}/", v) for _, may, v in self.tests) if self._is_archive(p) else self._wanted(p)
        return sorted(x for x in found if not hidden(x[0]) and wanted(x[0]))

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, n in self.files():
            if out[-1].paths and size + n + OPENING > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n + OPENING
        return out

    def _contents(self, paths: list[str]) -> Iterator[tuple[str, bytes]]:
        """(path, content) of files, and of those in archives that filters leave."""
        for path in paths:
            fs, at = _opened(path)
            if not self._is_archive(path):
                with fs.open_input_stream(at) as f:
                    yield path, f.read()
                continue
            with fs.open_input_file(at) as f:
                for batch in pq.ParquetFile(f).iter_batches(READ, columns=["name", "content"]):
                    for k, name in enumerate(batch.column("name").to_pylist()):
                        if not name or "/" in name:
                            raise ValueError(f"{path}: name {name!r} of a file in an archive")
                        if self._wanted(f"{path}/{name}"):
                            yield f"{path}/{name}", batch.column("content")[k].as_py() or b""

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        heads: list[tuple[str, int]] = []

        def contents() -> Iterator[bytes]:
            for path, data in self._contents(partition.paths):
                heads.append((path, len(data)))
                yield data

        made = pdf.paged(contents()) if self.kind == "pdf" else self._slices(contents())
        for at, columns in made:
            paths, sizes = zip(*(heads[k] for k in at))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), *columns], ["path", "length", *(list(pdf._ARROW) if self.kind == "pdf" else [KINDS[self.kind].split()[0]])])

    def _slices(self, contents: Iterator[bytes]) -> Iterator[tuple[list[int], list[pa.Array]]]:
        """Whole texts or contents, a few MB at a time."""
        kind = pa.string() if self.kind == "text" else pa.binary()
        at, found, size = [], [], 0
        for k, data in enumerate(contents):
            at.append(k)
            found.append(data.decode("utf-8", "replace") if self.kind == "text" else data)
            size += len(data)
            if size >= SENT:
                yield at, [pa.array(found, kind)]
                at, found, size = [], [], 0
        if at:
            yield at, [pa.array(found, kind)]


class FileWriter(DataSourceWriter):
    """Rows (to, value): a file each, of text or bytes, named below the folder. A name that is taken by other content is an error."""

    def __init__(self, options: dict):
        self.root, self.run = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator) -> Placed:
        fs, root = _opened(self.root)
        files, marks = 0, f"{root}/.placed-{self.run}"
        for row in rows:
            data = row.value.encode() if isinstance(row.value, str) else bytes(row.value or b"")
            target = f"{root}/{row.to}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            if fs.get_file_info(target).type == pafs.FileType.File:
                with fs.open_input_stream(target) as f:
                    if f.read() != data:
                        raise FileExistsError(target)
                files += 1
                continue  # this task was here before
            fs.create_dir(marks, recursive=True)
            staged = f"{marks}/{uuid.uuid4().hex}"
            with fs.open_output_stream(staged) as f:
                f.write(data)
            fs.move(staged, target)
            files += 1
        return Placed(files, marks)

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        """Files in place stay: they are whole, and a new run finds them."""
        self._clear()

    def _clear(self) -> None:
        fs, root = _opened(self.root)
        if fs.get_file_info(f"{root}/.placed-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/.placed-{self.run}")


class LecternSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern"

    def schema(self) -> str:
        kind = self.options.get("kind", "pdf")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are: {', '.join(sorted(KINDS))}")
        return f"path string, length long, {KINDS[kind]}"

    def reader(self, schema) -> FileReader:
        return FileReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added: mode('append')")
        return FileWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes format("lectern") known to a session, filters included."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LecternSource)
