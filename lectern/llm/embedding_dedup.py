"""Near-duplicate embeddings by NN-descent over a neighbour graph.

1. Equal vectors are one class, whose copies count as links without being compared.
2. A pass deals all vectors to groups by codes of random hyperplanes, in as many tables as a pair at the threshold needs to
   meet but for a share of MISS (groups are dealt to parts of 2 * GROUP members at most, so a dense region is no single
   task). Every pair of a group that may reach the threshold, and each member's best others, enter neighbour lists.
3. Descent: around every vector, its neighbours and a bounded number of those that have it as a neighbour are
   compared with each other; better ones enter the lists, until nearly none does. Lists whose last entry still
   reaches the threshold are saturated, and are doubled, up to MOST_K.
4. Threshold edges are kept over all passes; those that the int8 codes leave open are recomputed in double precision.
   Recall is audited twice: each pass by what the passes before it missed among its links, and at the end link by
   link for a sample of vectors compared with all others. Passes go on until the estimate of what all of them
   missed is under LOST; if the audit finds missing links after the last pass, all pairs are compared in tiles.
5. Vectors with MOST_K edges and more (dense ones) may have more links than groups and lists hand on. They form cells around
   leaders, and every leader is compared with all vectors: who is nearer to it than the threshold less the cell's
   radius links with the whole cell, who is farther than the threshold and the radius with none of it; only vectors
   in between are compared with the cell's members. Links within dense groups are so counted without pairs.
6. Components of all edges. Links of other vectors are counted from the edges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import ann
from lectern.llm.graph import components
from lectern.storage import Scratch, small

K = 8
MOST_K = 64
#: Members of a hyperplane group, on average, and how many of a member's best others a group hands on whatever their cosine.
GROUP, BEST = 256, 2
#: Share of pairs at the threshold that one pass may miss, and all passes together (estimated); most tables of a pass.
MISS, LOST, MOST_TABLES = 0.05, 0.001, 48
PASSES, DESCENTS = 6, 3
#: Vectors up to which, after PASSES, all pairs are compared in tiles at once; more go on to so many passes first.
TILES_TO, MORE_PASSES = 300_000, 16
#: Vectors whose links are audited against all vectors.
AUDIT = 512
#: Rounds in which dense vectors are put into cells; who has found none is a cell.
CELLS = 3
#: Vectors in a block: an eighth of those compared, within these bounds and at most so many numbers.
BLOCK, MOST_BLOCK, NUMBERS = 128, 8192, 1 << 20
#: Rows of a tile that are multiplied at once.
STRIP = 512
_CODED = "id long, dim int, codes binary, step double, lost double"


def _coded(vectors: DataFrame) -> DataFrame:
    def made(batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == d))
                codes, step, lost = ann.quantised(ann.unit(ann.matrix(batch.column(1).take(at), len(at))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.full(len(at), d, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(lost)], ["id", "dim", "codes", "step", "lost"])

    return vectors.select("id", "v").mapInArrow(made, _CODED)


def _tables(total: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): codes short enough for groups of GROUP, tables enough for pairs at the threshold."""
    bits = int(np.clip(np.ceil(np.log2(max(total, 2) / GROUP)), 1, 30))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, int(np.clip(math.ceil(math.log(MISS) / math.log(max(1 - alike, 1e-9))), 2, MOST_TABLES))


def _hyperplane_groups(coded: DataFrame, total: int, threshold: float, seed: int, scratch: Scratch) -> DataFrame:
    """grp, id: a group of each table for every vector."""
    bits, tables = _tables(total, threshold)

    def made(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.int8).reshape(len(at), -1).astype(np.float32)
                rng = np.random.default_rng([seed, int(d)])
                for t in range(tables):
                    side = x @ rng.normal(size=(x.shape[1], bits)).astype(np.float32) > 0
                    code = side @ (1 << np.arange(bits, dtype=np.int64)) + (np.int64(t) << 30) + (np.int64(d) << 38)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(code)], ["id", "code"])

    codes = scratch.save(coded.mapInArrow(made, "id long, code long"), f"codes{seed}")
    parts = codes.groupBy("code").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("parts"))
    parts = scratch.save(parts.where("parts > 1"), f"parts{seed}")
    return codes.join(small(parts), "code", "left").select(F.xxhash64("code", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "code"), "parts"))).alias("grp"), "id")


def _around(lists: DataFrame, step: int) -> DataFrame:
    """grp, id: every vector's neighbours, and at most K of those whose neighbour it is."""
    ahead = lists.select(F.col("id").alias("grp"), F.col("near").alias("id"))
    turn = F.xxhash64(F.lit(step), "id", "near")
    back = lists.groupBy("near", F.pmod(F.xxhash64("id", F.lit(step)), F.lit(K)).alias("slot")).agg(F.min(F.struct(turn.alias("turn"), "id")).alias("x"))
    return ahead.union(back.select(F.col("near").alias("grp"), "x.id")).distinct()


def _compared(groups: DataFrame, coded: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """id, near, sim, slack: for the members of each group, others in it that beat their lists.

    All that may reach the threshold, or the BEST others where there are no more. Members with MOST_K and more such others
    come as their own neighbours, and with the K best alone.
    """
    rows = groups.join(coded, "id").join(state, "id", "left").select("grp", "id", "codes", "step", "lost", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    rows = rows.repartition("grp").sortWithinPartitions("grp")

    def found(batches):
        out: list = []
        for ids, codes, step, lost, bar in _groups(batches):
            m = len(ids)
            if m < 2:
                continue
            x = np.frombuffer(b"".join(codes), np.int8).reshape(m, -1).astype(np.float32)
            sim = (x @ x.T) * step[:, None] * step[None, :]
            sim[ids[:, None] == ids[None, :]] = -3
            reach = sim + lost[:, None] + lost[None, :] + 3 * lost[:, None] * lost[None, :] + 1e-6 >= threshold
            links = reach.sum(1)
            row, col = [], []
            for low, high, most in ((0, BEST, BEST), (BEST + 1, MOST_K - 1, MOST_K), (MOST_K, m, K)):
                some = np.flatnonzero((links >= low) & (links <= high))
                most = min(m - 1, most)
                if len(some):
                    top = np.argpartition(-sim[some], most - 1, axis=1)[:, :most]
                    ok = reach[some[:, None], top] | (low == 0)
                    row.append(np.repeat(some, most)[ok.ravel()]), col.append(top[ok])
            crowded = np.flatnonzero(links >= MOST_K)
            out.append((ids[crowded], ids[crowded], np.full(len(crowded), 2.0), np.zeros(len(crowded))))
            row, col = np.concatenate(row), np.concatenate(col)
            s = sim[row, col]
            ok = s > bar[row]
            row, col, s = row[ok], col[ok], s[ok]
            slack = lost[row] + lost[col] + 3 * lost[row] * lost[col] + 1e-6
            out.append((ids[row], ids[col], s.astype(np.float64), slack))
            if sum(len(o[0]) for o in out) > 50_000:
                yield _links_batch(out)
                out = []
        if out:
            yield _links_batch(out)

    return rows.mapInArrow(found, "id long, near long, sim double, slack double")


def _links_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], ["id", "near", "sim", "slack"])


def _groups(batches):
    """Runs of equal first columns over all batches: the other columns, numbers as arrays."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(keys)]:
            if held and keys[lo] != last:
                yield _columns(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
            lo = hi
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list:
    whole = pa.Table.from_batches(held)
    return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in whole.columns[1:]]


def _updated(lists: DataFrame | None, found: DataFrame, state: DataFrame) -> DataFrame:
    """The k best of old and new entries of each list; fresh tells which are new."""
    found = found.where("id != near").withColumn("fresh", F.lit(1))
    every = found if lists is None else lists.select("id", "near", "sim", "slack").withColumn("fresh", F.lit(0)).union(found)
    every = every.groupBy("id", "near").agg(F.max("sim").alias("sim"), F.max("slack").alias("slack"), F.min("fresh").alias("fresh"))
    every = every.join(state.select("id", "k"), "id", "left").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "near")))
    return every.where(F.col("place") <= F.coalesce("k", F.lit(K))).select("id", "near", "sim", "slack", "fresh")


def _states(lists: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """id, k, bar: the length of each list, doubled where saturated, and what beats it."""
    now = lists.groupBy("id").agg(F.min(F.col("sim") + F.col("slack")).alias("least"), F.min("sim").alias("bar"), F.count("*").alias("n"))
    now = now.join(state.select("id", "k"), "id", "left").withColumn("k", F.coalesce("k", F.lit(K)))
    full = F.col("n") >= F.col("k")
    grown = full & (F.col("least") >= threshold) & (F.col("k") < MOST_K)
    return now.select("id", F.when(grown, F.col("k") * 2).otherwise(F.col("k")).cast("int").alias("k"), F.when(full & ~grown, F.col("bar")).otherwise(-2.0).alias("bar"))


def _exact(links: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """links(u, v) whose cosine in double precision reaches the threshold."""
    joined = links.join(vectors.select(F.col("id").alias("u"), F.col("v").alias("x")), "u").join(vectors.select(F.col("id").alias("v"), F.col("v").alias("y")), "v").select("u", "v", "x", "y")

    def kept(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.concatenate([ann.cosines(ann.matrix(batch.column(2).slice(i, 1), 1), ann.matrix(batch.column(3).slice(i, 1), 1)) for i in range(batch.num_rows)])
            yield batch.select(["u", "v"]).filter(pa.array(c >= threshold))

    return joined.mapInArrow(kept, "u long, v long")


def _tiled(members: DataFrame, threshold: float) -> DataFrame:
    """id, other, links: for members(root, known, id, copies, v), all pairs of equal root compared.

    Blocks are compared two by two; a member goes to each pair of blocks that holds its own. Rows with
    null `other` hold the copies linked with id in one tile, the others are links between two known components.
    """
    n = F.count("*")
    most = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.lit(NUMBERS) / F.max(F.size("v"))))
    sizes = members.groupBy("root").agg(F.ceil(n / F.least(most, F.greatest(F.lit(BLOCK), n / 8))).cast("int").alias("blocks"))
    rows = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "root", "known", "block", "id", "copies", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "v")
    rows = rows.repartition("tile", "root", "lo", "hi").sortWithinPartitions("tile", "root", "lo", "hi")

    def compared(batches):
        for known, block, ids, copies, lo, hi, v in _tiles(batches):
            raw = np.array(v, np.float64).reshape(len(ids), -1)
            x = ann.unit(raw).astype(np.float32)
            # rounding of the numbers and of sums in single precision, each at most 2 ** -24 of the lengths
            slack = (raw.shape[1] + 8) * 2.0**-23
            right = np.flatnonzero(block == hi[0])
            links = np.zeros(len(ids))
            joined = np.zeros((0, 2), np.int64)
            left = np.flatnonzero(block == lo[0])
            for at in range(0, len(left), STRIP):
                some = left[at : at + STRIP]
                c = x[some] @ x[right].T
                a, b = np.nonzero(c >= threshold - slack)
                open_ = np.flatnonzero(c[a, b] <= threshold + slack)
                a, b = some[a], right[b]
                keep = a != b
                for i in range(0, len(open_), 65536):
                    o = open_[i : i + 65536]
                    keep[o] &= ann.cosines(raw[a[o]], raw[b[o]]) >= threshold
                a, b = a[keep], b[keep]
                links += np.bincount(a, copies[b], len(ids))
                if lo[0] != hi[0]:
                    links += np.bincount(b, copies[a], len(ids))
                new = known[a] != known[b]
                if new.any():
                    joined = _forest(np.concatenate([joined, np.stack([known[a[new]], known[b[new]]], 1)]))
            hit = np.flatnonzero(links)
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), none, pa.array(links[hit].astype(np.int64))], ["id", "other", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(joined[:, 0]), pa.array(joined[:, 1]), pa.array(np.zeros(len(joined), np.int64))], ["id", "other", "links"])

    return rows.mapInArrow(compared, "id long, other long, links long")


def _forest(links: np.ndarray) -> np.ndarray:
    """Each label of the links with the smallest one reachable from it, where that is another."""
    labels, ends = np.unique(links, return_inverse=True)
    ends = ends.reshape(links.shape)
    root = np.arange(len(labels))
    while True:
        low = root[ends].min(1)
        new = root.copy()
        for k in (0, 1):
            np.minimum.at(new, ends[:, k], low)
            np.minimum.at(new, root[ends[:, k]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(labels)))
    return np.stack([labels[moved], labels[root[moved]]], 1)


def _summed(tiled: DataFrame) -> DataFrame:
    return tiled.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """id, links: for members(root, id, copies, v), the copies of all others of the same root that reach the threshold."""
    return _summed(_tiled(members.withColumn("known", F.lit(0).cast("long")), threshold))


def _tiles(batches):
    """Runs of equal (tile, root, lo, hi)."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole():
        t = pa.Table.from_batches(held)
        named = {n: c for n, c in zip(t.schema.names, t.columns)}
        return [named[n].to_numpy() for n in ("known", "block", "id", "copies", "lo", "hi")] + [named["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tile", "root", "lo", "hi")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        at = 0
        for to in [*cuts.tolist(), len(keys)]:
            key = tuple(keys[at])
            if held and key != last:
                yield whole()
                held = []
            held.append(batch.slice(at, to - at))
            last, at = key, to
    if held:
        yield whole()


def _cosine_of(rows: DataFrame, kept: str) -> DataFrame:
    """kept, c: the cosine in double precision of rows(..., x, y) (arrays of equal length)."""
    names = [n.split()[0] for n in kept.split(", ")]

    def made(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            c = np.concatenate([np.zeros(0), *(ann.cosines(ann.matrix(x.slice(i, 1), 1), ann.matrix(y.slice(i, 1), 1)) for i in range(batch.num_rows))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(c)], [*names, "c"])

    return rows.select(*names, "x", "y").mapInArrow(made, f"{kept}, c double")


def _cells(dense: DataFrame, tight: DataFrame, vectors: DataFrame, threshold: float, scratch: Scratch, tag: str) -> DataFrame:
    """id, cell, angle for dense(id): each one's cell, named by its leader, and an upper bound of the angle between them.

    Cells are components of tight(u, v), links within a quarter of the threshold's angle; whoever is farther than that from
    the leader tries again among those left over.
    """
    quarter = math.acos(threshold) / 4
    left, made = dense, []
    for turn in range(CELLS):
        both = tight.join(left.withColumnRenamed("id", "u"), "u", "left_semi").join(left.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
        found = components(both, scratch, f"cells{tag}{turn}").toDF("id", "cell")
        cells = left.join(found, "id", "left").select("id", F.coalesce("cell", "id").alias("cell"))
        rows = cells.where("id != cell").join(vectors.select("id", F.col("v").alias("x")), "id").join(vectors.select(F.col("id").alias("cell"), F.col("v").alias("y")), "cell")
        near = _cosine_of(rows, "id long, cell long").select("id", "cell", (F.acos(F.least(F.col("c"), F.lit(1.0))) + 1e-6).alias("angle"))
        near = near.union(cells.where("id = cell").select("id", "cell", F.lit(0.0)))
        near = scratch.save(near, f"near{tag}{turn}")
        made.append(near.where(F.col("angle") <= quarter))
        left = scratch.save(near.where(F.col("angle") > quarter).select("id"), f"left{tag}{turn}")
        if left.isEmpty():
            break
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return scratch.save(out.union(left.select("id", F.col("id").alias("cell"), F.lit(0.0))), f"members{tag}")


SCANNED = "cell long, y long, weight long, sure boolean"


def _scanned(leaders: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Every leader(id, r, v) compared with every row(id, copies, dense, v), in tiles (schema SCANNED).

    Dense rows that surely link with the whole cell are summed up: rows with a null y hold their copies, rows of weight 0 name
    them. All others that may link with some member of the cell come one by one, and not as sure.
    """
    theta = math.acos(threshold)
    lanes = max(ann.LANES, min(4096, rows.count() // (8 * ann.BLOCK)))

    def blocks(df, size, extra):
        """Rows of one length by the block: ids, vectors of length 1, and the extra numbers, as bytes."""

        def packed(batches):
            held: dict[int, list] = {}
            for batch in batches:
                lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    x = ann.unit(ann.matrix(part.column("v"), part.num_rows)).astype(np.float32)
                    new = [part.column("id").to_numpy(), x, *(part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in extra)]
                    held[d] = [np.concatenate(p) for p in zip(held[d], new)] if d in held else new
                    while len(held[d][0]) >= size:
                        yield block([p[:size] for p in held[d]], d)
                        held[d] = [p[size:] for p in held[d]]
            for d, parts in held.items():
                if len(parts[0]):
                    yield block(parts, d)

        def block(parts, d):
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], ["dim", "ids", "vectors", *extra])

        return df.select("id", "v", *extra).mapInArrow(packed, "dim int, ids binary, vectors binary" + "".join(f", {c} binary" for c in extra))

    asked = blocks(leaders, ann.QUERY_BLOCK, ["r"]).withColumnsRenamed({"ids": "qids", "vectors": "qv"}).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    held = blocks(rows.select("id", "v", "copies", F.col("dense").cast("int").alias("dense")), ann.BLOCK, ["copies", "dense"])
    held = held.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    names = [x.split()[0] for x in SCANNED.split(", ")]

    def said(cell, y, weight, sure):
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(y, pa.int64()) if y is not None else pa.nulls(len(cell), pa.int64()), pa.array(weight, pa.int64()), pa.array(np.full(len(cell), sure))], names)

    def scanned(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                cell, r, ids, copies, dense = get("qids", np.int64), get("r", np.float64), get("ids", np.int64), get("copies", np.float64), get("dense", np.float64) > 0
                q, x = get("qv", np.float32).reshape(len(cell), -1), get("vectors", np.float32).reshape(len(ids), -1)
                slack = (q.shape[1] + 8) * 2.0**-22
                for at in range(0, len(cell), STRIP):
                    mine, far = cell[at : at + STRIP], r[at : at + STRIP]
                    c = (q[at : at + STRIP] @ x.T).astype(np.float64)
                    # the limits as cosines, moved by what single precision may have lost
                    inner = np.cos(np.clip(theta - far - 1e-6, 0, math.pi)) + slack
                    outer = np.cos(np.minimum(theta + far + 1e-6, math.pi)) - slack
                    a, b = np.nonzero(c >= outer[:, None])
                    sure = (c[a, b] >= inner[a]) & dense[b]
                    weight = np.bincount(a[sure], copies[b[sure]], len(mine)).astype(np.int64)
                    hit = np.flatnonzero(weight)
                    yield said(mine[hit], None, weight[hit], True)
                    yield said(mine[a[sure]], ids[b[sure]], np.zeros(sure.sum(), np.int64), True)
                    yield said(mine[a[~sure]], ids[b[~sure]], copies[b[~sure]].astype(np.int64), False)

    tiles = held.join(asked, ["dim", "lane"]).select("ids", "vectors", "copies", "dense", "qids", "qv", "r")
    return tiles.mapInArrow(scanned, SCANNED)


def _sparse(pairs: DataFrame, dense: DataFrame) -> DataFrame:
    """pairs(u, v) of which at least one isn't dense(id)."""
    both = pairs.join(dense.select(F.col("id").alias("u")), "u", "left_semi").join(dense.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    return pairs.select("u", "v").join(both, ["u", "v"], "left_anti")


def _pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """u, v, sim, slack of the list entries that may reach the threshold, each pair once."""
    rows = entries.where((F.col("sim") + F.col("slack") >= threshold) & (F.col("id") != F.col("near")))
    return rows.groupBy(F.least("id", "near").alias("u"), F.greatest("id", "near").alias("v")).agg(F.max("sim").alias("sim"), F.max("slack").alias("slack"))


class Descent:
    """The neighbour lists, and the pairs that may link found so far, over passes."""

    def __init__(self, coded: DataFrame, threshold: float, scratch: Scratch):
        self.coded, self.threshold, self.scratch, self.total = coded, threshold, scratch, coded.count()
        self.state = scratch.save(coded.where("false").selectExpr("id", "cast(0 as int) as k", "0D as bar"), "state0")
        self.lists: DataFrame | None = None
        self.known: DataFrame | None = None
        #: Vectors with MOST_K pairs and more, and those that a group has shown to have as many.
        self.dense: DataFrame | None = None
        self.crowded = scratch.save(coded.where("false").select("id"), "crowded0")
        self.step = self.passes = 0

    def _step(self, groups: DataFrame) -> DataFrame:
        """Compares groups and brings the lists up to date; returns what was found."""
        self.step += 1
        found = self.scratch.save(_compared(groups, self.coded, self.state, self.threshold), f"found{self.step}")
        self.lists = self.scratch.save(_updated(self.lists, found, self.state), f"lists{self.step}")
        self.state = self.scratch.save(_states(self.lists, self.state, self.threshold), f"state{self.step}")
        self.crowded = self.scratch.save(self.crowded.union(found.where("id = near").select("id")).distinct(), f"crowded{self.step}")
        return found

    def run(self) -> float:
        """One pass: new hyperplanes, then descents. Returns the estimated share of pairs that all passes have missed.

        Pairs between dense vectors count for nothing here, as cells take care of them.
        """
        self.passes += 1
        first = self._step(_hyperplane_groups(self.coded, self.total, self.threshold, self.passes, self.scratch))
        met = self.scratch.save(_pairs(first, self.threshold), f"met{self.passes}")
        every = [met]
        for _ in range(DESCENTS):
            fresh = _pairs(self._step(_around(self.lists, self.step)), self.threshold)
            new = self.scratch.save(fresh.join(every[-1].select("u", "v"), ["u", "v"], "left_anti"), f"fresh{self.step}")
            every.append(new)
            if new.count() * 1000 <= self.lists.count():
                break
        union = before = self.known
        for more in every:
            union = more if union is None else union.union(more)
        self.known = self.scratch.save(union.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("slack").alias("slack")), f"known{self.passes}")
        ends = self.known.select(F.col("u").alias("id")).union(self.known.select("v"))
        many = ends.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= MOST_K).select("id")
        self.dense = self.scratch.save(many.union(self.crowded).distinct(), f"dense{self.passes}")
        lost = 1.0
        if before is not None:
            mine = self.scratch.save(_sparse(met, self.dense), f"mine{self.passes}")
            before = self.scratch.save(_sparse(before, self.dense), f"before{self.passes}")
            found, held, again = mine.count(), before.count(), mine.join(before, ["u", "v"], "left_semi").count()
            lost = (1 - again / max(found, 1)) * (1 - again / max(held, 1)) if found else float(held > 0)
        old = [f"{name}{k}" for name in ("found", "lists", "state", "crowded") for k in range(self.step)]
        self.scratch.drop(*old, f"known{self.passes - 1}", f"told{self.passes - 1}", f"dense{self.passes - 1}")
        return lost

    def learn(self, links: DataFrame) -> None:
        """Adds links(u, v) that were proved elsewhere to the pairs known, above any doubt."""
        more = self.known.union(links.select("u", "v", F.lit(2.0).alias("sim"), F.lit(0.0).alias("slack")))
        self.known = self.scratch.save(more.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("slack").alias("slack")), f"told{self.passes}")

    def links(self, vectors: DataFrame) -> DataFrame:
        """The pairs known that reach the threshold."""
        sure = self.known.where(f"sim - slack >= {self.threshold}").select("u", "v")
        return self.scratch.save(sure.union(_exact(self.known.where(f"sim - slack < {self.threshold}").select("u", "v"), vectors, self.threshold)), f"links{self.passes}")


def _audited(links: DataFrame, vectors: DataFrame, dense: DataFrame, threshold: float, scratch: Scratch, tag: int) -> tuple[int, DataFrame]:
    """Links of AUDIT vectors that aren't dense, found by comparing them with all: how many, and (u, v) of those not in links."""
    some = vectors.join(dense, "id", "left_anti").orderBy(F.xxhash64(F.lit(tag), "id")).limit(AUDIT).select("id", F.lit(0.0).alias("r"), "v")
    some = scratch.save(some, f"audit{tag}")
    found = _scanned(some, vectors.withColumn("dense", F.lit(False)), threshold).where("cell != y")
    true = scratch.save(_exact(found.select(F.least("cell", "y").alias("u"), F.greatest("cell", "y").alias("v")).distinct(), vectors, threshold), f"true{tag}")
    return true.count(), scratch.save(true.join(links.select("u", "v"), ["u", "v"], "left_anti"), f"missed{tag}")


def near_duplicates(rows: DataFrame, *, threshold: float = 0.9, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vec_id of rows(vec_id, embedding, ...).

    Null, zero and non-finite vectors link with nothing; vectors only link with vectors of their length.
    Of rows that repeat a vec_id the smallest usable vector counts. Rows with a null vec_id are one
    row with null component_id and kept. An empty table gives none. Other columns aren't read. `report` gets passes, lost
    (the estimated share of missed links), audited (links of the audit), recall (of these), dense, cells, and exact
    (whether all pairs were compared in the end).
    """
    scratch = Scratch(rows.sparkSession, "neardup")
    single = ann.usable(rows).groupBy("vec_id").agg(F.min("v").alias("v"))
    single = scratch.save(single.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(5), "v")), "single")
    classes = scratch.save(single.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    vectors = scratch.save(single.join(classes.select(F.col("id").alias("vec_id"), "copies"), "vec_id").select(F.col("vec_id").alias("id"), "copies", "v"), "vectors")
    graph = Descent(scratch.save(_coded(vectors), "coded"), threshold, scratch)

    audited, recall, lost = 0, 1.0, 1.0
    passes = PASSES if graph.total <= TILES_TO else MORE_PASSES
    while True:
        while graph.passes < 2 or lost > LOST and graph.passes < passes:
            lost = graph.run()
        links, dense = graph.links(vectors), graph.dense
        audited, missed = _audited(links, vectors, dense, threshold, scratch, graph.passes)
        short = missed.count()
        recall = 1 - short / max(audited, 1)
        if not short or graph.passes >= passes:
            break
        graph.learn(missed)
        lost = graph.run()
    exact = short > 0 or lost > LOST
    if report is not None:
        report.update(passes=graph.passes, lost=lost, audited=audited, recall=recall, exact=exact, dense=dense.count())
    counts, joined = _all_pairs(vectors, links, threshold, scratch) if exact else _by_edges(vectors, links, dense, threshold, scratch, report)
    of = classes.join(joined, "id", "left").join(counts, "id", "left")
    of = of.select("h", "g", F.coalesce("root", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = scratch.save(of, "of")
    linked = scratch.save(single.select("vec_id", "h", "g").join(of, ["h", "g"]).select("vec_id", "n_links", "component_id"), "linked")
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = every.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _by_edges(vectors: DataFrame, links: DataFrame, dense: DataFrame, threshold: float, scratch: Scratch, report: dict | None) -> tuple[DataFrame, DataFrame]:
    """(id, links: copies of all others linked), (id, root): from edges, and by cells for dense vectors."""
    sizes = vectors.select("id", "copies")
    edges, crowd = [links.select("u", "v")], None
    if not dense.isEmpty():
        tight = _exact(links.select("u", "v"), vectors, math.cos(math.acos(threshold) / 4))
        members = _cells(dense, scratch.save(tight, "tight"), vectors, threshold, scratch, "")
        leaders = members.groupBy("cell").agg(F.max("angle").alias("r")).join(vectors.select(F.col("id").alias("cell"), "v"), "cell").select(F.col("cell").alias("id"), "r", "v")
        leaders = scratch.save(leaders, "leaders")
        if report is not None:
            report.update(cells=leaders.count())
        marked = scratch.save(vectors.join(dense.withColumn("dense", F.lit(True)), "id", "left").withColumn("dense", F.coalesce("dense", F.lit(False))), "marked")
        scan = scratch.save(_scanned(leaders, marked, threshold), "scan")
        whole = scan.where("y is null").groupBy("cell").agg(F.sum("weight").alias("weight"))
        spread = members.select("id", "cell").join(scan.where("not sure").select("cell", "y"), "cell").where("id != y").select(F.col("id").alias("u"), F.col("y").alias("v"))
        met = scratch.save(_exact(scratch.save(spread, "spread"), vectors, threshold), "met")
        # a dense vector counts itself with its cell
        some = members.join(whole, "cell").join(sizes, "id").select("id", (F.col("weight") - F.col("copies")).alias("links"))
        more = met.join(sizes.select(F.col("id").alias("v"), "copies"), "v").select(F.col("u").alias("id"), F.col("copies").alias("links"))
        crowd = some.union(more).groupBy("id").agg(F.sum("links").alias("links"))
        edges += [met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))]
        edges += [members.where("id != cell").select(F.least("id", "cell").alias("u"), F.greatest("id", "cell").alias("v")), scan.where("sure and y is not null and cell != y").select(F.least("cell", "y").alias("u"), F.greatest("cell", "y").alias("v"))]
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    every = scratch.save(every.distinct(), "edges")
    both = every.union(every.select("v", "u")).toDF("id", "other").join(sizes.toDF("other", "copies"), "other")
    counts = both.join(dense, "id", "left_anti").groupBy("id").agg(F.sum("copies").alias("links"))
    counts = scratch.save(counts if crowd is None else counts.union(crowd), "counts")
    return counts, components(every, scratch, "cc").toDF("id", "root")


def _all_pairs(vectors: DataFrame, links: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same by comparing all pairs in tiles, whatever the graph has missed."""
    known = components(links, scratch, "cc")
    known = scratch.save(vectors.select("id").join(known.toDF("id", "known"), "id", "left").select("id", F.coalesce("known", "id").alias("known")), "known")
    members = vectors.join(known, "id").select(F.size("v").alias("root"), "known", "id", "copies", "v")
    tiled = scratch.save(_tiled(members, threshold), "tiled")
    joined = components(tiled.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), scratch, "joined").toDF("known", "over")
    return scratch.save(_summed(tiled), "counts"), known.join(joined, "known", "left").select("id", F.coalesce("over", "known").alias("root"))
