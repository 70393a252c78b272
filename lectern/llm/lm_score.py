"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased words and an end of text. Counts of all training tokens give the smoothed
unigram model. The softmax is factored by classes, in four steps of WIDE branches each: class, two levels of subclasses, member.
The SINGLES most frequent words have members of their own. All other words of the vocabulary, whatever its
size, are dealt to the remaining members: classes are bands of equal frequency mass, subclasses and member come from
the hash; words that share a member are told apart by their smoothed counts. Each step's softmax sums the
weights of hashed features: the word before, the pair before, and single words further back (skips), joined
with the branch taken so far. Weights start from zero and biases from the counts, so an untrained
model is the unigram model.

Training is distributed: every task takes gradient steps over its part of the training documents
from the weights at hand; of each weight row the changes of all tasks are averaged by how often they met it, in
slices, and the next round starts from there. The weight table has a row for each ROW_WORDS words of the
vocabulary, within bounds. Weights, and the table of HEAD frequent words that scoring looks up in numpy,
have a bounded size; counts of the other words are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.llm.graph import most_frequent
from lectern.storage import Scratch

#: Words whose counts every task holds (16 bytes each); the others are joined.
HEAD = 1 << 18
#: Branches of each step; the first OWN classes are made of single words. For each step, the contexts whose weights
#: it sums: the words one and two back, and the pair before.
WIDE, OWN = 8, 4
CONTEXTS = (("1", "pair"), ("1", "2"), ("1",), ("1",))
LEAVES = WIDE ** len(CONTEXTS)
INNER = LEAVES // WIDE
SINGLES = OWN * INNER
#: Weight rows (32 bytes each): one for each ROW_WORDS words of the vocabulary, within bounds.
ROW_WORDS, LEAST_ROWS, MOST_ROWS = 2, 1 << 14, 1 << 18
#: Each training document gives its gradients at every position; each round takes its share of documents.
ROUNDS = 2
STEP, MINI = 0.15, 4096
SLICES = 32
#: Training tasks for each core at most: each sends its changed rows once, however much it has read.
TASKS = 4
ALPHA = 0.1
_END = H.mixed(np.array([0x656E64], np.uint64))[0]
_START = H.mixed(np.array([0x7374617274], np.uint64))[0]
_ODD = H._MIX


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the tokens of each text, the end last."""
    data, offsets = H.text_buffers(column)
    starts, ends, per = H.word_spans(data, offsets)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, np.uint64)
    stop = per[1:] + np.arange(1, n + 1)
    last = np.zeros(len(out), dtype=bool)
    last[stop - 1] = True
    out[~last] = H.word_hashes(data, starts, ends)
    out[last] = _END
    return out, np.concatenate([[0], stop])


def _hashed_leaf(h: np.ndarray) -> np.ndarray:
    """Subclass and member, as one number, of words that have no member of their own."""
    return ((h >> np.uint64(40)) & np.uint64(INNER - 1)).astype(np.int64)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the HEAD words
    counts: np.ndarray
    total: float  # N
    distinct: float  # V
    tail: np.ndarray  # sums of count + ALPHA of the training words beyond the head, by hashed leaf
    leaf: np.ndarray = field(default=None)  # of each head word
    mass: np.ndarray = field(default=None)  # of each leaf
    bias: list[np.ndarray] = field(default=None)
    w: np.ndarray = field(default=None)

    def __post_init__(self):
        ranked = np.lexsort((self.words, -self.counts))
        single = ranked[:SINGLES][self.counts[ranked[:SINGLES]] > 0]
        rest = ranked[len(single) :]
        weight = self.counts + ALPHA * (self.counts > 0)
        run = np.cumsum(weight[rest])
        bands = WIDE - OWN - 1  # the last class holds what is beyond the head
        band = np.minimum((run - weight[rest]) / max(run[-1] if len(run) else 1, 1e-9) * bands, bands - 1).astype(np.int64)
        self.leaf = np.zeros(len(self.words), np.int64)
        self.leaf[single] = np.arange(len(single))
        self.leaf[rest] = (OWN + band) * INNER + _hashed_leaf(self.words[rest])
        self.mass = np.bincount(self.leaf, weight, LEAVES).astype(np.float64)
        self.mass[-INNER:] += self.tail
        self.mass[SINGLES:] += ALPHA  # an unknown word in each
        with np.errstate(divide="ignore"):
            logs = [np.log(self.mass.reshape(WIDE**k, -1).sum(1)) for k in range(len(CONTEXTS) + 1)]
        above = [np.maximum(x, -1e9).reshape(-1, 1) for x in logs]
        self.bias = [np.maximum(x.reshape(-1, WIDE) - up, -1e9).astype(np.float32) for x, up in zip(logs[1:], above)]
        rows = 1 << max(0, int(self.distinct) // ROW_WORDS).bit_length()
        self.w = np.zeros((min(max(rows, LEAST_ROWS), MOST_ROWS), WIDE), np.float32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into the head words or -1, leaf) of words."""
        beyond = (WIDE - 1) * INNER + _hashed_leaf(h)
        if not len(self.words):
            return np.full(len(h), -1), beyond
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, at, -1), np.where(known, self.leaf[at], beyond)

    @staticmethod
    def contexts(h: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """What stands before each token: the words one and two back, and both."""
        c, last = [], h
        for _ in range(2):
            back = np.empty_like(h)
            back[1:] = last[:-1]
            back[offsets[:-1]] = _START
            c.append(back)
            last = back
        return {"1": c[0], "2": c[1], "pair": c[0] * _ODD[6] + (c[1] ^ (c[1] >> np.uint64(31))) * _ODD[7]}

    def features(self, c: dict[str, np.ndarray], leaf: np.ndarray, some: slice) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each step, at some positions: the node that it starts from, the branch taken, and the weight rows."""
        shift = np.uint64(64 - (len(self.w) - 1).bit_length())
        out = []
        for k, names in enumerate(CONTEXTS):
            taken = leaf[some] // (LEAVES // WIDE ** (k + 1))
            node = taken // WIDE
            path = (node + WIDE**k).astype(np.uint64) * _ODD[5]
            rows = []
            for name in names:
                x = c[name][some] + path * np.uint64(2 * len(name) + (name == "2"))
                x ^= x >> np.uint64(29)
                rows.append((x * _ODD[k] >> shift).view(np.int64))
            out.append((node, taken % WIDE, rows))
        return out

    def weights(self, step: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """The exponents of all branches."""
        z = self.bias[step][node]
        for r in rows:
            z += self.w[r]
        return np.minimum(z, 60, out=z)

    def logs(self, h: np.ndarray, offsets: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log probability of each token's leaf after the words before it."""
        out = np.zeros(len(h))
        c = self.contexts(h, offsets)
        for lo in range(0, len(h), MINI):
            some = slice(lo, lo + MINI)
            for k, (node, branch, rows) in enumerate(self.features(c, leaf, some)):
                z = self.weights(k, node, rows)
                own = z[np.arange(len(z)), branch]
                out[some] += own - np.log(np.exp(z, out=z) @ _ONES)
        return out


_ONES = np.ones(WIDE, np.float32)


def descend(model: Model, squares: np.ndarray, seen: np.ndarray, h: np.ndarray, offsets: np.ndarray) -> None:
    """Adaptive gradient steps on all tokens of some texts; squares and seen sum up squared gradients and uses by row."""
    _, leaf = model.look_up(h)
    c = model.contexts(h, offsets)
    for lo in range(0, len(h), MINI):
        for k, (node, branch, rows) in enumerate(model.features(c, leaf, slice(lo, lo + MINI))):
            error = np.exp(model.weights(k, node, rows))
            error /= (error @ _ONES)[:, None]
            error[np.arange(len(error)), branch] -= 1
            every = np.concatenate(rows)
            order = np.argsort(every)
            every = every[order]
            cut = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            g = np.add.reduceat(error[order % len(error)], cut, axis=0)
            hit = every[cut]
            s = squares[hit] + np.einsum("ij,ij->i", g, g)
            squares[hit] = s
            model.w[hit] -= (STEP / np.sqrt(s / 4 + 1))[:, None] * g
            seen[hit] += np.diff(np.append(cut, len(every)))


def _train(docs: DataFrame, model: Model) -> None:
    """docs(text, turn): rounds of local descent and averaging, each over its share: one pass at every size."""
    most = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    for turn in range(ROUNDS):
        part = docs.where(F.col("turn") == turn)

        def local(batches, model=model):
            import copy

            mine = copy.copy(model)
            mine.w = model.w.copy()
            squares, seen = np.zeros(len(mine.w), np.float32), np.zeros(len(mine.w), np.int64)
            for batch in (part for whole in batches for part in H.parts(whole, 0, 2 << 20)):
                descend(mine, squares, seen, *tokens(batch.column(0)))
            for s in range(SLICES):
                met = np.flatnonzero(seen[s::SLICES]) * SLICES + s
                if len(met):
                    change = (mine.w[met] - model.w[met]) * seen[met, None].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (met, seen[met], change))], ["slice", "rows", "seen", "change"])

        def summed(batches):
            total: dict[int, tuple] = {}
            for batch in batches:
                for s, rows, seen, change in zip(*(c.to_pylist() for c in batch.columns)):
                    if s not in total:
                        total[s] = np.zeros(len(model.w) // SLICES, np.int64), np.zeros((len(model.w) // SLICES, WIDE))
                    at = np.frombuffer(rows, np.int64) // SLICES
                    total[s][0][at] += np.frombuffer(seen, np.int64)
                    total[s][1][at] += np.frombuffer(change, np.float32).reshape(-1, WIDE)
            for s, (seen, change) in total.items():
                mean = (change / np.maximum(seen, 1)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["slice", "change"])

        schema = "slice int, rows binary, seen binary, change binary"
        sent = part.select("text").coalesce(most).mapInArrow(local, schema).repartition(SLICES, "slice")
        for row in sent.mapInArrow(summed, "slice int, change binary").toLocalIterator():
            model.w[row.slice :: SLICES] += np.frombuffer(row.change, np.float32).reshape(-1, WIDE)


def _scored(model: Model, text: pa.Array):
    """For each text: tokens, known, base and score sums over what the model holds, and the hashes of the other words."""
    h, offsets = tokens(text)
    at, leaf = model.look_up(h)
    count = np.where(at >= 0, model.counts[at] if len(model.counts) else 0, 0)
    shared = np.where(at >= 0, np.log10(count + ALPHA), 0.0)  # without log10 of the denominators
    inside = np.log10(model.mass)[leaf]
    score = model.logs(h, offsets, leaf) / np.log(10) + shared - inside
    begin, n = offsets[:-1], np.diff(offsets)
    z = np.log10(model.total + ALPHA * (model.distinct + 1))
    known = np.add.reduceat((count > 0).astype(np.int64), begin)
    tail = at < 0
    return n, known, np.add.reduceat(shared, begin) - n * z, np.add.reduceat(score, begin), h[tail], np.add.reduceat(tail.astype(np.int64), begin)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text, ...).

    Rows whose crc32(doc_id as text) mod 10 is 0 are held out, all others train; rows with a null
    doc_id train. Null texts are empty: one token, the end. Scores are log10 probabilities. With no
    training document every word is unknown. Repeated rows are counted and scored as often as they
    occur. Other columns aren't read. Words are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))

    def counted(batches):
        for batch in (part for whole in batches for part in H.parts(whole, 1, 16 << 20)):
            h, offsets = tokens(batch.column(1))
            train = np.repeat(~batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets))
            words, where = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(np.bincount(where, train, minlength=len(words)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(words)).astype(np.int64))], ["word", "c", "uses"]
            )

    counts = docs.select("held_out", "text").mapInArrow(counted, "word long, c long, uses long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))
    counts = scratch.save(counts, "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v or 0)
    head = most_frequent(counts, "uses", HEAD).toArrow()
    words, c = head.column("word").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(words)
    words, c = words[order], c[order]
    beyond = counts.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"word": words.view(np.int64)}))), "word", "left_anti") if len(words) else counts
    spot = F.shiftrightunsigned("word", 40).bitwiseAND(F.lit(INNER - 1).cast("long"))
    tail = np.zeros(INNER)
    for row in beyond.where("c > 0").groupBy(spot.alias("spot")).agg(F.sum(F.col("c") + F.lit(ALPHA)).alias("mass")).collect():
        tail[row.spot] = row.mass
    model = Model(words, c, float(total), float(distinct), tail)
    training = docs.where("not held_out").select("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ROUNDS)).alias("turn"))
    _train(training, model)

    def scored(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in H.parts(whole, 2):
                n, known, base, score, tail, sizes = _scored(model, batch.column(2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(n))), batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(score), H.lists(tail.view(np.int64), sizes)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "part", "tail"],
                )
                row += len(n)

    parts = docs.mapInArrow(scored, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, part double, tail array<long>")
    parts = scratch.save(parts, "parts")  # row numbers are those of the written table from here on
    tail = parts.select("row", F.explode("tail").alias("word")).join(counts.select("word", "c"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("more"), F.count_if(F.col("c") > 0).alias("also"))
    out = parts.drop("tail").join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("part") + more).alias("score"),
    )
