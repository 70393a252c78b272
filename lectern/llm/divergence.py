"""How far the sources of a language differ in their words, and in which.

1. Exact document frequencies: each document counts once for a term; terms in at least `least` documents of a language are kept.
2. A second pass over the texts recounts the kept terms with an automaton for each language, whose patterns are
   padded with a delimiter, so that only whole terms match. The HEAD terms of most documents make up automata that
   every task has. What other terms a text holds is dealt to shards by hash, and the automaton of its shard recounts
   it: texts stay where they are, and no automaton outgrows its bound, whatever the size of the vocabulary.
3. Counts become sparse postings, a row a term with the sources that use it. Pairs are summed over postings alone: terms
   that both sources use; terms that one of them uses, from a histogram of its values; and the number of all others.

All values are integers and exact: quotients are whole parts of decimals.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.llm.graph import most_frequent
from lectern.storage import Scratch, small

#: Terms in the automata that all tasks have, and in the automata of a shard: some 150 bytes of a worker each.
HEAD = SHARD = 1_000_000
#: Counters, 16 bytes each, and terms that a task holds before it passes them on; and counters by term, some 150 bytes each.
HELD, HELD_TERMS = 1_000_000, 300_000
#: Terms in a row for a shard.
LOAD = 8_000
#: Kept terms whose counts one task brings together, on average, where there are more than shuffle partitions ask for.
BUCKET = 50_000
#: Values are shares of a billion.
UNIT = 1_000_000_000
_GAP = "\n"
#: Bytes of terms, lower-cased where they are A to Z; all others are delimiters. Terms are letters of ASCII and all characters beyond it.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else ord(_GAP) for c in range(256))
_GROUP = ("lang", "source")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*_GROUP, "text")))


def _marked(batch: pa.RecordBatch):
    """(row, text with delimiters for all that isn't part of a term) of the last column, in slices."""
    row = 0
    for part in H.parts(batch, batch.num_columns - 1):
        data, offsets = H.text_buffers(part.column(part.num_columns - 1))
        for i in range(part.num_rows):
            yield row + i, data[offsets[i] : offsets[i + 1]].tobytes().translate(_TERMS)
        row += part.num_rows


def _rows(counts: dict[tuple, Counter], names: tuple[str, ...]) -> pa.RecordBatch:
    """A row for each counter and term: the counter's name, the term, n."""
    each = [len(c) for c in counts.values()]
    heads = [pa.array([k[i] for k in counts], pa.string()).take(pa.array(np.repeat(np.arange(len(each)), each))) for i in range(len(names))]
    terms = pa.array([t for c in counts.values() for t in c], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*heads, terms, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], [*names, "term", "n"])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, n of docs(lang, source, text) without nulls: the documents of the language that hold the term."""

    def counted(batches):
        counts: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, text in _marked(batch):
                counts[(langs[i],)].update(set(text.split()))
                if sum(map(len, counts.values())) > HELD_TERMS:
                    yield _rows(counts, ("lang",))
                    counts.clear()
        yield _rows(counts, ("lang",))
        counts.clear()
        H.trimmed()

    return docs.select("lang", "text").mapInArrow(counted, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _automata(langs: list[str], terms: list[str]) -> dict:
    """By language, an automaton that finds the terms between delimiters; its values are the terms' places in the list."""
    import ahocorasick

    found: dict = {}
    for k, (lang, term) in enumerate(zip(langs, terms)):
        if lang not in found:
            found[lang] = ahocorasick.Automaton()
        found[lang].add_word(_GAP + term + _GAP, k)
    for machine in found.values():
        machine.make_automaton()
    return found


class Tally:
    """Occurrences by group and place of a term, summed up as they come."""

    def __init__(self, ids: np.ndarray, buckets: int):
        self.ids, self.buckets, self.groups = ids, buckets, {}
        self.codes, self.sums, self.more, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, group: int, machine, text: bytes) -> None:
        """Counts the machine's terms in a marked text."""
        found = np.fromiter(map(_SECOND, machine.iter(f"{_GAP}{text.decode('utf-8', 'replace')}{_GAP}")), np.int64)
        if len(found):
            self.more.append(found | self.groups.setdefault(group, len(self.groups)) << 32)
            self.waiting += len(found)
            if self.waiting > HELD:
                self._sum()

    def _sum(self) -> None:
        if self.more:
            codes, counts = np.unique(np.concatenate(self.more), return_counts=True)
            self.codes, inverse = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            sums = np.zeros(len(self.codes), np.int64)
            np.add.at(sums, inverse, np.concatenate([self.sums, counts]))
            self.sums, self.more, self.waiting = sums, [], 0

    def full(self) -> bool:
        return len(self.codes) > HELD

    def rows(self) -> pa.RecordBatch:
        """A row for each bucket of terms: gids, ids, ns; and starts afresh."""
        self._sum()
        ids, gids = self.ids[self.codes & 0xFFFFFFFF], np.array(list(self.groups), np.int64)[self.codes >> 32] if len(self.codes) else np.zeros(0, np.int64)
        bucket = (ids ^ ids >> 33) % self.buckets
        order = np.argsort(bucket, kind="stable")
        which, sizes = np.unique(bucket, return_counts=True)
        made = pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *(H.lists(x[order], sizes) for x in (gids, ids, self.sums))], ["bucket", "gids", "ids", "ns"])
        self.__init__(self.ids, self.buckets)
        return made


_SECOND = itemgetter(1)
#: The automata of the last run in this process, which its tasks share.
_LAST: dict = {}


def shard_of(term: bytes, shards: int) -> int:
    return zlib.crc32(term) % shards


def occurrences(docs: DataFrame, kept: DataFrame, scratch: Scratch, *, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """id, used (the groups that hold the term and how often) for kept(lang, term, n, id) in docs(lang, gid, text)."""
    spark = docs.sparkSession
    terms = kept.count()
    first = scratch.save(most_frequent(kept, "n", head).select("lang", "term", "id"), "head") if terms > head else kept.select("lang", "term", "id")
    table = first.toArrow()  # at most `head` of them
    shards = -(-(terms - table.num_rows) // shard) if terms > table.num_rows else 0
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent, run = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), scratch.root
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-terms // BUCKET))
    del table

    def scanned(batches):
        if run not in _LAST:
            _LAST.clear()
            known = pa.ipc.open_stream(sent.value).read_all()
            langs, names = known.column(0).to_pylist(), known.column(1).to_pylist()
            heads: dict[str, set] = defaultdict(set)
            for lang, name in zip(langs, names) if shards else ():
                heads[lang].add(name.encode())
            _LAST[run] = _automata(langs, names), heads, known.column(2).to_numpy()
            del known, langs, names
            H.trimmed()
        machines, heads, ids = _LAST[run]
        tally = Tally(ids, buckets)
        loads: dict[tuple, list[bytes]] = defaultdict(list)
        waiting = 0
        for batch in batches:
            langs, gids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in _marked(batch):
                lang = langs[i]
                if lang in machines:
                    tally.add(gids[i], machines[lang], text)
                if shards:
                    ours = heads.get(lang, ())
                    for t in [t for t in text.split() if t not in ours]:
                        loads[lang, gids[i], shard_of(t, shards)].append(t)
                        waiting += 1
                if tally.full():
                    yield _with_loads(tally.rows(), {})
                if waiting > HELD:
                    yield _with_loads(tally.rows(), loads)
                    loads.clear()
                    waiting = 0
        yield _with_loads(tally.rows(), loads)

    sums = "bucket int, gids array<long>, ids array<long>, ns array<long>"
    found = docs.select("lang", "gid", "text").mapInArrow(scanned, f"{sums}, lang string, gid long, shard int, load string")
    names = ["bucket", "gids", "ids", "ns"]
    if shards:
        found = scratch.save(found, "scanned")
        # the terms of a shard come first, then its loads, in any number
        of = (F.crc32(F.col("term").cast("binary")) % shards).cast("int")
        rest = kept.join(first, "id", "left_anti").select("lang", F.col("id").alias("gid"), of.alias("shard"), F.lit(0).alias("kind"), F.col("term").alias("load"))
        both = rest.union(found.where("load is not null").select("lang", "gid", "shard", F.lit(1).alias("kind"), "load"))
        dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")

        def recounted(batches):
            at, tally, machines, langs_, terms_, ids_ = None, None, {}, [], [], []
            for batch in batches:
                langs, gids, which, kinds, loads = (c.to_pylist() for c in batch.columns)
                for i, load in enumerate(loads):
                    if which[i] != at:
                        if tally is not None:
                            yield tally.rows()
                        at, tally, machines, langs_, terms_, ids_ = which[i], None, {}, [], [], []
                    if not kinds[i]:
                        langs_.append(langs[i]), terms_.append(load), ids_.append(gids[i])
                        continue
                    if tally is None:
                        tally, machines = Tally(np.array(ids_, np.int64), buckets), _automata(langs_, terms_)
                    if langs[i] in machines:
                        tally.add(gids[i], machines[langs[i]], load.encode())
                    if tally.full():
                        yield tally.rows()
            if tally is not None:
                yield tally.rows()

        found = found.where("load is null").select(*names).union(dealt.mapInArrow(recounted, sums))

    def together(batches):
        codes, sums = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)

        def summed(codes, sums):
            if not codes.shape[1]:
                return codes, sums
            order = np.lexsort(codes)
            codes, sums = codes[:, order], sums[order]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0).any(axis=0)]))
            return codes[:, begin], np.add.reduceat(sums, begin)

        last = 0
        for batch in batches:
            gids, ids, ns = (c.flatten().to_numpy() for c in batch.columns[1:])
            codes, sums = np.concatenate([codes, np.stack([gids, ids])], axis=1), np.concatenate([sums, ns])
            if len(sums) > 2 * last + HELD:
                codes, sums = summed(codes, sums)
                last = len(sums)
        codes, sums = summed(codes, sums)
        ids, sizes = np.unique(codes[1], return_counts=True)
        for at in range(0, len(ids), 10_000):
            to = at + 10_000
            lo, hi = sizes[:at].sum(), sizes[:to].sum()
            used = pa.StructArray.from_arrays([pa.array(codes[0, lo:hi]), pa.array(sums[lo:hi])], ["gid", "n"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[at:to])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:to]), pa.ListArray.from_arrays(offsets, used)], ["id", "used"])

    return found.select(*names).repartitionById(buckets, "bucket").mapInArrow(together, "id long, used array<struct<gid:long,n:long>>")


def _with_loads(rows: pa.RecordBatch, loads: dict[tuple, list[bytes]]) -> pa.RecordBatch:
    """Rows of counts, and rows of terms that go to a shard."""
    sent = [(*k, _GAP.encode().join(terms[at : at + LOAD])) for k, terms in loads.items() for at in range(0, len(terms), LOAD)]
    lang, gid, shard, load = zip(*sent) if sent else ((), (), (), ())
    more = [pa.array(lang, pa.string()), pa.array(gid, pa.int64()), pa.array(shard, pa.int32()), pa.array(load, pa.binary()).cast(pa.string())]
    none = lambda kinds, n: [pa.nulls(n, k) for k in kinds]
    left = [pa.concat_arrays([c, x]) for c, x in zip(rows.columns, none((c.type for c in rows.columns), len(sent)))]
    right = [pa.concat_arrays([x, c]) for c, x in zip(more, none((c.type for c in more), rows.num_rows))]
    return pa.RecordBatch.from_arrays([*left, *right], [*rows.schema.names, "lang", "gid", "shard", "load"])


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a / b as a long."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + the whole part of UNIT * (count + 1) / (total + terms), at any size; null without terms."""
    part = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(terms > 0, _whole(part, (total + terms).cast("decimal(20,0)")) + 1)


def gap(p: Column, q: Column) -> Column:
    """The whole part of (p - q) ** 2 / q, for shares."""
    return _whole((p - q) * (p - q), q)


def _common(postings: DataFrame) -> DataFrame:
    """lang, source, item, n, both, left, right: over terms of both sources, their number and the sums of the gaps of p and q, p and q0, p0 and q."""

    def summed(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            langs, sources = batch.column(0).dictionary_encode(), flat.field("source").dictionary_encode()
            lang = langs.indices.to_numpy()[row].astype(np.int64)
            source = sources.indices.to_numpy().astype(np.int64)
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            width = len(sources.dictionary)
            code, sums = np.zeros(0, np.int64), np.zeros((4, 0), np.int64)
            for k in range(1, int(sizes.max(initial=0))):
                i = np.flatnonzero(row[k:] == row[:-k])
                for a, b in ((i, i + k), (i + k, i)):
                    values = np.stack([np.ones(len(a), np.int64), *((x[a] - y[b]) ** 2 // y[b] for x, y in ((p, p), (p, p0), (p0, p)))])
                    code = np.concatenate([code, (lang[a] * width + source[a]) * width + source[b]])
                    sums = np.concatenate([sums, values], axis=1)
                    order = np.argsort(code, kind="stable")
                    code, sums = code[order], sums[:, order]
                    begin = np.flatnonzero(np.diff(code, prepend=-1))
                    code, sums = code[begin], np.add.reduceat(sums, begin, axis=1) if len(begin) else sums
            of = [langs.dictionary.take(pa.array(code // width // width)), *(sources.dictionary.take(pa.array(x % width)) for x in (code // width, code))] if width else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*of, *(pa.array(x) for x in sums)], ["lang", "source", "item", "n", "both", "left", "right"])

    found = postings.select("lang", "used").mapInArrow(summed, "lang string, source string, item string, n long, both long, left long, right long")
    return found.groupBy("lang", "source", "item").agg(*(F.sum(c).alias(c) for c in ("n", "both", "left", "right")))


def divergence(docs: DataFrame, *, least: int = 3, ranks: int = 200, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and its most typical terms.

    docs(lang, source, text, ...): nulls count as empty strings; other columns aren't read. Part `pair` has all other sources
    of the language, `term` the terms that the source uses more than the language does, `ranks` at most. Ties
    of values go by item. A language without kept terms has pairs of value 0 only; with one source it has no pairs;
    rows that repeat count again; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = _texts(docs)
    kept = document_frequencies(texts).where(F.col("n") >= least)
    kept = scratch.save(kept.withColumn("id", F.monotonically_increasing_id()), "kept")
    named = scratch.save(texts.select(*_GROUP).distinct().withColumn("gid", F.monotonically_increasing_id()), "named")
    grouped = texts.join(small(named), list(_GROUP))
    lists = scratch.save(occurrences(grouped, kept, scratch, head=head, shard=shard), "lists")
    counts = lists.select("id", F.inline("used"))
    none = F.lit(0).cast("long")
    sizes = counts.groupBy("gid").agg(F.sum("n").alias("total"), F.count("*").alias("uses"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = named.join(sizes, "gid", "left").join(vocabulary, "lang", "left")
    groups = groups.select("gid", *_GROUP, *(F.coalesce(c, none).alias(c) for c in ("total", "uses", "terms")))
    groups = scratch.save(groups.withColumn("p0", share(none, F.col("total"), F.col("terms"))), "groups")
    langs = scratch.save(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms")), "langs")

    shares = counts.join(small(groups), "gid").select("id", "source", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0")
    # a term's list has an entry for each source of its language at most
    used = shares.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "p0")).alias("used"))
    postings = used.join(kept.select("id", "lang", "term"), "id").join(small(langs), "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"), "used")
    postings = scratch.save(postings, "postings")

    single = postings.select("lang", "term", "q", F.inline("used"))
    typical = single.where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    typical = typical.withColumn("rank", place).where(F.col("rank") <= ranks)

    common = scratch.save(_common(postings), "common")
    values = single.groupBy(*_GROUP, "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    own = values.join(small(others), "lang").where("source != item")
    alone = own.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * gap(F.col("p"), F.col("q0"))).alias("mine"), F.sum(F.col("n") * gap(F.col("q0"), F.col("p"))).alias("theirs"))
    alone = scratch.save(alone, "alone")
    every = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("uses").alias("uses_"), F.col("p0").alias("q0")), "lang").where("source != item")
    every = every.join(common, ["lang", "source", "item"], "left").join(alone.select("lang", "source", "item", "mine"), ["lang", "source", "item"], "left")
    every = every.join(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "theirs"), ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(c, none)
    unused = F.col("terms") - F.col("uses") - F.col("uses_") + zero(F.col("n"))
    value = zero(F.col("both")) + zero(F.col("mine")) - zero(F.col("left")) + zero(F.col("theirs")) - zero(F.col("right")) + zero(unused * gap(F.col("p0"), F.col("q0")))
    pairs = every.select(*_GROUP, F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", place)
    return pairs.union(typical)
