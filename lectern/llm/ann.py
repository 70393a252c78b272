"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks. Every block of queries meets every block of candidates; the product
of their int8 codes bounds all cosines of the tile from both sides. Only pairs whose upper bound
reaches the k-th largest lower bound are recomputed in double precision from the original numbers,
so the result is exact. The k best of each tile are merged by heaps, first within a partition, then by query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship

#: Vectors in a block of queries and in a block of candidates.
QUERY_BLOCK = 1024
BLOCK = 2048
#: Least number of tasks that tiles are dealt to.
LANES = 16


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: no null, zero, or non-finite vectors, no null ids."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x != 0)")


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    dot = np.einsum("ij,ij->i", a, b)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        c = dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    odd = ~np.isfinite(c) | (np.abs(dot) < 1e-280)
    if odd.any():
        c[odd] = np.einsum("ij,ij->i", unit(a[odd]), unit(b[odd]))
    return c


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their steps, and a bound of the length of what rounding took."""
    step = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / step[:, None]).astype(np.int8)
    lost = u - codes * step[:, None]
    return codes, step, np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-12


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of a tile.

    With u = codes * step + lost, <u, w> differs from the product of the codes by at most
    |lost_u| + |lost_w| + 3 |lost_u| |lost_w|, as unit vectors' codes are no longer than 1 + |lost|.
    """
    # int8 products summed as float32 are exact up to 2 ** 24, hence for 1,000 dimensions and more
    wide = np.float32 if q[0].shape[1] <= 1024 else np.float64
    near = (q[0].astype(wide) @ c[0].astype(wide).T) * q[1][:, None] * c[1][None, :]
    slack = q[2][:, None] + c[2][None, :] + 3 * q[2][:, None] * c[2][None, :] + 1e-9
    return near - slack, near + slack


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """dim, ids, vectors, codes, step, lost: up to `size` vectors of one length in a row, as bytes, with their int8 codes.

    Vectors travel in single precision where that holds all of a block's numbers.
    """

    def packed(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = matrix(vectors.take(pa.array(at)), len(at))
                for i in range(0, len(at), size):
                    held.setdefault(int(d), []).append((ids[at[i : i + size]], x[i : i + size]))
                while sum(len(p[0]) for p in held[int(d)]) >= size:
                    yield block(held, int(d))
        for d in list(held):
            while held[d]:
                yield block(held, d)

    def block(held, d):
        ids, x = (np.concatenate([p[k] for p in held[d]]) for k in (0, 1))
        held[d] = [(ids[size:], x[size:])] if len(ids) > size else []
        ids, x = ids[:size], x[:size]
        with np.errstate(over="ignore"):
            slim = x.astype(np.float32)
        parts = [ids.astype(np.int64), slim if (slim == x).all() else x, *quantised(unit(x))]
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], ["dim", *PARTS])

    return rows.mapInArrow(packed, "dim int, " + ", ".join(f"{p} binary" for p in PARTS))


PARTS = ("ids", "vectors", "codes", "step", "lost")


def unpacked(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, tuple]:
    """(ids, vectors, codes with steps and what rounding took) of a block."""
    ids, x, codes, step, lost = (batch.column(prefix + p)[i].as_buffer() for p in PARTS)
    ids = np.frombuffer(ids, np.int64)
    codes = np.frombuffer(codes, np.int8).reshape(len(ids), -1)
    return ids, np.frombuffer(x, np.float32 if len(x) == 4 * codes.size else np.float64).reshape(codes.shape), (codes, np.frombuffer(step), np.frombuffer(lost))


class Heaps:
    """The k best (score, vec_id) of each query: highest score first, then smallest vec_id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, vec: int, score: float) -> None:
        mine = self.of.setdefault(query, {})
        if vec in mine:
            mine[vec] = max(mine[vec], score)
            return
        mine[vec] = score
        if len(mine) >= 8 * self.k:
            self.of[query] = dict(self.best(mine))

    def best(self, mine: dict) -> list:
        return heapq.nsmallest(self.k, mine.items(), key=lambda x: (-x[1], x[0]))

    def batch(self) -> pa.RecordBatch:
        rows = [(q, r + 1, v, s) for q, mine in self.of.items() for r, (v, s) in enumerate(self.best(mine))]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["query_id", "rank", "vec_id", "score"])


FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(queries: DataFrame, rows: DataFrame, *, k: int = 5) -> DataFrame:
    """The k rows with the largest cosine for each query (schema FOUND); all of them, if fewer.

    Both sides hold vec_id and embedding. A row with the query's vec_id is the query's own and no
    candidate. Unusable vectors (null, zero, null or non-finite components) take no part; vectors only
    meet vectors of their length. Rows that repeat a vec_id count once, with the best score. Ties go to
    the smaller vec_id. Other columns aren't read.
    """
    ship(rows.sparkSession)
    # candidate blocks are dealt to lanes, query blocks go to every lane: each tile is made once, in the task of its lane
    lanes = max(LANES, min(4096, rows.count() // (8 * BLOCK)))
    asked = blocks(usable(queries), QUERY_BLOCK).select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *(F.col(p).alias(f"q{p}") for p in PARTS))
    held = blocks(usable(rows), BLOCK).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    tiles = held.join(asked, ["dim", "lane"]).select(*PARTS, *(f"q{p}" for p in PARTS))

    def scored(batches):
        heaps = Heaps(k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, coded = unpacked(batch, i)
                qids, q, qcoded = unpacked(batch, i, "q")
                low, high = bounds(qcoded, coded)
                own = qids[:, None] == ids[None, :]
                low[own] = high[own] = -np.inf
                # repeated vec_ids may hide others behind them: the k-th bound is taken over distinct ids
                if len(np.unique(ids)) == len(ids) and len(ids) > k:
                    edge = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    edge = np.full(len(qids), -np.inf)
                a, b = np.nonzero((high >= edge[:, None]) & ~own)
                for at in range(0, len(a), 65536):
                    p, r = a[at : at + 65536], b[at : at + 65536]
                    for query, vec, score in zip(qids[p].tolist(), ids[r].tolist(), cosines(q[p].astype(np.float64), x[r].astype(np.float64)).tolist()):
                        heaps.add(query, vec, score)
            if len(heaps.of) > 50_000:
                yield heaps.batch()
                heaps = Heaps(k)
        yield heaps.batch()

    def merged(batches):
        heaps, last = Heaps(k), None
        for batch in batches:  # sorted by query: a query is done when the next one comes
            for query, vec, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if query != last and len(heaps.of) >= 2000:
                    yield heaps.batch()
                    heaps = Heaps(k)
                last = query
                heaps.add(query, vec, score)
        yield heaps.batch()

    parts = tiles.mapInArrow(scored, FOUND).select("query_id", "vec_id", "score")
    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, FOUND)
