"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are the same bytes without white space. Their 64-bit hash is the key of the index.

1. Keys are counted in a scan; those of two rows and more go into a Bloom filter of bounded size.
2. In a second scan each task chains the texts that pass the filter by key, compares bytes along the chain, and
   keeps one text of its own copies, its delegate; other rows only name their delegate. Batches of any group thus
   shrink to a text a task before anything moves.
3. Delegates are counted by leading bits of their keys. The directory starts with one bucket; a bucket over capacity
   splits by its next bit, and the directory doubles where the bucket's depth has reached its own. Buckets are ranges of keys.
4. Each bucket has one owner task, which takes its delegates in the order of keys, chains those of one key, again by
   comparing bytes, and writes the class of every delegate to the shared folder: the index.
5. Sizes and best rows are summed up by delegate and then by class, and every row looks its delegate up.

A hash never decides that texts are equal; with keys of few bits the result is the same.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import hashing as H
from lectern.llm.jaccard_join import _filter as bloom_filter, _places as filter_places
from lectern.storage import Scratch, free_name, small

#: Delegates in a bucket, where the directory has fewer than 2 ** MOST_DEPTH entries.
CAPACITY = 2_000
#: Bits of the directory at most, 8 MB; buckets that would split further keep longer chains.
MOST_DEPTH = 20
#: Bytes of delegates that a task holds; then it starts afresh, and the owners bring its delegates together.
HELD = 64 << 20
BLANK = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without white space characters of ASCII; a null text is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANK, "")


class Directory:
    """Which bucket each prefix of a key belongs to, by doubling; `slots[p]` is the bucket of the prefix p of `depth` bits."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """counts[p]: entries with the prefix p of log2(len(counts)) bits, the deepest that may be told apart."""
        self.most = len(counts).bit_length() - 1
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        self.depth, self.slots, self.local = 0, np.zeros(1, np.int64), [0]
        first = {0: 0}  # of each bucket, its first slot
        over = [0] if self._size(0, 0) > capacity else []
        while over:
            bucket = over.pop()
            if self.local[bucket] == self.most:
                continue
            if self.local[bucket] == self.depth:
                self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
                first = {b: 2 * p for b, p in first.items()}
            self.local[bucket] += 1
            half = 1 << (self.depth - self.local[bucket])
            new, at = len(self.local), first[bucket] + half
            self.slots[at : at + half] = new
            self.local.append(self.local[bucket])
            first[new] = at
            over += [b for b in (bucket, new) if self._size(first[b], self.local[b]) > capacity]

    def _size(self, slot: int, local: int) -> int:
        """Entries of the bucket of a local depth that begins at a slot."""
        wide = self.most - self.depth
        begin = slot << wide
        return int(self.sums[begin + (1 << (self.most - local))] - self.sums[begin])


def _entries(docs: DataFrame, shared: np.ndarray, n: int) -> DataFrame:
    """Rows of docs (n columns, sha, chars, key, norm) with row, a number of their own, and delegate, the row of their text's
    delegate; bytes are norm where a row is a delegate. Rows whose key is surely alone have no delegate.
    """
    bits = 8 * len(shared)

    def chained(batches):
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        chains: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        held = 0
        for batch in batches:
            for part in H.parts(batch, batch.num_columns - 1):
                keys = part.column(n + 2).to_numpy(zero_copy_only=False)
                ok = np.ones(part.num_rows, dtype=bool)
                for at in filter_places(keys, bits):
                    ok &= (shared[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                data, offsets = H.text_buffers(part.column(n + 3))
                delegates, texts = [None] * part.num_rows, [None] * part.num_rows
                for i in np.flatnonzero(ok).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    chain = chains[keys[i]]
                    mine = next((d for t, d in chain if t == text), None)
                    if mine is None:
                        mine, texts[i] = row + i, text
                        chain.append((text, mine))
                        held += len(text) + 200
                    delegates[i] = mine
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(n + 3)), pa.array(rows), pa.array(delegates, pa.int64()), pa.array(texts, pa.binary())],
                    [*part.schema.names[: n + 3], "row", "delegate", "bytes"],
                )
                if held > HELD:
                    chains.clear()
                    held = 0

    schema = T.StructType([*docs.schema.fields[: n + 3], *(T.StructField(c, t) for c, t in (("row", T.LongType()), ("delegate", T.LongType()), ("bytes", T.BinaryType())))])
    return docs.mapInArrow(chained, schema)


def directory(delegates: DataFrame, capacity: int) -> Directory:
    """The directory for delegates(key): counts by prefix, as deep as the number of delegates asks for."""
    total = delegates.count()
    capacity = max(capacity, total >> (MOST_DEPTH - 4))
    depth = min(MOST_DEPTH, max(1, (total // capacity + 1).bit_length() + 4))
    counts = np.zeros(1 << depth, np.int64)
    for p, n in delegates.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("p")).agg(F.count("*").alias("n")).toLocalIterator():
        counts[p] = n
    return Directory(counts, capacity)


def _owned(delegates: DataFrame, capacity: int) -> DataFrame:
    """(key, delegate, class) of delegates(key, delegate, bytes): the bytes' first delegate in the order of the key's chain."""
    spark = delegates.sparkSession
    found = directory(delegates.select("key"), capacity)
    buckets = len(found.local)
    slots = spark.createDataFrame([(p, int(b)) for p, b in enumerate(found.slots)], "slot long, bucket int")
    slot = F.shiftrightunsigned("key", 64 - found.depth) if found.depth else F.lit(0).cast("long")
    # at most 2 ** MOST_DEPTH slots
    dealt = delegates.withColumn("slot", slot).join(F.broadcast(slots), "slot").select("bucket", "key", "delegate", "bytes")
    dealt = dealt.repartitionById(buckets, "bucket").sortWithinPartitions("key", "delegate")

    def classed(batches):
        last, chain = None, []
        for batch in batches:
            keys, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            data, offsets = H.text_buffers(batch.column(3))
            classes = np.empty(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                if keys[i] != last:
                    last, chain = keys[i], []
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                mine = next((d for t, d in chain if t == text), None)
                if mine is None:
                    mine = int(names[i])
                    chain.append((text, mine))
                classes[i] = mine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(classes)], ["bucket", "key", "delegate", "class"])

    return dealt.mapInArrow(classed, "bucket int, key long, delegate long, class long")


def _grouped(docs: DataFrame, columns: list[str], key_bits: int, capacity: int) -> tuple[DataFrame, dict[str, str]]:
    """The columns of docs with keep_id, group_size, kept and text_sha256, and the names that these have there."""
    scratch = Scratch(docs.sparkSession, "exact")
    # the rows' own columns travel under numbers, so that they clash with nothing
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    own = own.withColumn("norm", normalised(F.col("_text")))
    own = own.withColumn("key", F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits), 64 - key_bits))
    counts = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = bloom_filter(scratch.save(counts.select("key"), "shared"))
    numbered = [f"c{k}" for k in range(len(columns))] + ["_id"]
    keyed = own.select(*numbered, F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.char_length(F.coalesce(F.col("_text").cast("string"), F.lit(""))).cast("long").alias("chars"), "key", "norm")
    entries = scratch.save(_entries(keyed, shared, len(numbered)), "entries")
    index = scratch.save(_owned(entries.where("bytes is not null").select("key", "delegate", "bytes"), capacity).select("delegate", "class"), "index")
    best = lambda c: F.max(c).alias("best")
    order = F.struct("chars", F.col("_id").isNotNull().alias("known"), (-F.col("_id")).alias("small"), (-F.col("row")).alias("early"))
    by_delegate = entries.where("delegate is not null").groupBy("delegate").agg(F.count("*").alias("n"), best(order))
    by_class = scratch.save(index.join(by_delegate, "delegate").groupBy("class").agg(F.sum("n").alias("n"), best("best")), "classes")
    found = index.join(by_class, "class").select("delegate", "n", (-F.col("best.small")).alias("keep"), (-F.col("best.early")).alias("keep_row"))
    found = small(scratch.save(found, "found"), 300_000)
    names = {n: free_name(docs, n) for n in ("keep_id", "group_size", "kept", "text_sha256")}
    made = entries.join(found, "delegate", "left").select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)),
        F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("keep")).alias(names["keep_id"]),
        F.coalesce("n", F.lit(1)).cast("long").alias(names["group_size"]),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias(names["kept"]),
        F.col("sha").alias(names["text_sha256"]),
    )
    return made, names


def exact_duplicates(docs: DataFrame, *, key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs(doc_id, text, ...).

    Texts are equal when they are so without the white space of ASCII; null counts as empty. Of equal texts the one with the most
    characters stays, then that with the smallest doc_id; null doc_ids come last; of rows equal in both one stays, whichever
    the scan numbers first. An empty table gives none. Other columns aren't read. `key_bits` shortens the keys of the
    index (for tests: longer chains, same result).
    """
    return _grouped(docs.select("doc_id", "text"), ["doc_id"], key_bits, capacity)[0]


def without_duplicates(docs: DataFrame, *, key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with their own columns; see exact_duplicates."""
    made, names = _grouped(docs, docs.columns, key_bits, capacity)
    return made.where(f"`{names['kept']}`").select(*(F.col(f"`{c}`") for c in docs.columns))
