"""N-gram Jaccard self-join by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches `percent` / 100. The join is exact; every pruning step is a bound.

1. One order of all shingles: shingles that are frequent in some batch of documents go
   last (a bounded list, which only orders and never drops), all others by hash.
2. Documents with equal sets are one class, kept by its smallest doc_id.
3. Classes with the same size and the same prefix in that order collapse into a group. Members
   are verified against the group's first member; those that don't link with it form groups of their own.
4. Leaders: for each of the first LEAD shingles of a prefix, the group links with the smallest
   group there, if their sets say so. Large clusters become one component from a linear number of pairs.
   ROUNDS more rounds (one) give every prefix shingle that still spans components a leader of its own, drawn by
   hash, and compare all others there with it: dense clusters merge, shingles of two groups are done.
5. Group pairs from different components that share a prefix shingle, each given once, at the first such shingle,
   are filtered by size and by a lower bound of their difference: 512 parity bits of each set (each differing
   shingle flips one), and for large sets the prefixes themselves. Survivors are verified; where the triangle
   inequality leaves room for a link between members, the pair expands into its members and these are verified.
6. Components of all verified links, then back to all documents.

doc_id is the key: null doc_ids link with nothing; rows that repeat a doc_id count as one
document with each of its texts.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.llm.graph import components, most_frequent
from lectern.storage import Scratch

#: How many frequent shingles at most are put last in the order; a broadcast of 8 bytes each.
FREQUENT = 200_000
#: A shingle counts as frequent in a batch from so many documents on.
OFTEN = 2
#: Prefix shingles by which a group looks for its leaders.
LEAD = 8
#: Rounds of leaders drawn by hash; they only spare the last join pairs, which is exact after any number of them.
ROUNDS = 1
#: 64-bit words of parity bits for a set. From LARGE shingles on they say too little, and prefixes are compared too.
PARITY = 8
LARGE = 1500
#: Most bits of the filter that selects documents whose sets are built.
FILTER_BITS = 1 << 28
#: Most tasks that each fill a filter of their own; the driver takes one after the other.
FILTERS = 32
_HEAVY = np.uint64(1 << 62)


def _documents(batch: pa.RecordBatch, size: int):
    """(row, distinct shingle hashes) of the documents of a batch of (doc_id, text)."""
    row = 0
    for part in H.parts(batch, 1):
        data, offsets = H.text_buffers(part.column(1))
        starts, ends, per = H.word_spans(data, offsets)
        words = H.word_hashes(data, starts, ends)
        for i in range(part.num_rows):
            yield row + i, H.distinct(H.shingles(words[per[i] : per[i + 1]], size) >> np.uint64(2))
        row += part.num_rows


def frequent_shingles(docs: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """Sorted hashes of the shingles that most documents share, as far as batches show; FREQUENT at most."""

    def counted(batches):
        for batch in (part for whole in batches for part in H.parts(whole, 1, 8 << 20)):
            sets = [s for _, s in _documents(batch, size)]
            values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            often = counts >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(values[often].astype(np.int64)), pa.array(counts[often])], ["shingle", "n"])

    counts = scratch.save(docs.mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 3"), "frequent")
    top = most_frequent(counts, "n", FREQUENT).select("shingle").toArrow().column(0)
    scratch.drop("frequent")
    return np.sort(top.to_numpy().astype(np.uint64))


def _ordered(values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Order keys of sorted hashes: frequent ones get a high bit."""
    if not len(heavy) or not len(values):
        return values
    at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
    mark = heavy[at] == values
    return np.concatenate([values[~mark], values[mark] | _HEAVY]) if mark.any() else values


def _least_overlap(a: str, b: str, percent: int) -> str:
    """SQL: the smallest intersection with which sets of sizes a and b link."""
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}D)"


def _verify(pairs: DataFrame, sets: DataFrame, extra: list[str]) -> DataFrame:
    """Adds n_a, n_b and common, the exact set sizes and intersection, to pairs(a, b)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"))
    joined = pairs.select("a", "b", *extra).join(left, "a").join(right, "b").select("a", "b", *extra, "ka", "kb")

    def compared(batches):
        for batch in batches:
            da, oa = H.text_buffers(batch.column(batch.num_columns - 2))
            db, ob = H.text_buffers(batch.column(batch.num_columns - 1))
            common = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x = np.frombuffer(da[oa[i] : oa[i + 1]].tobytes(), np.uint64)
                y = np.frombuffer(db[ob[i] : ob[i + 1]].tobytes(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common[i] = np.count_nonzero(y[at] == x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(np.diff(oa) // 8), pa.array(np.diff(ob) // 8), pa.array(common)],
                [*batch.schema.names[:-2], "n_a", "n_b", "common"],
            )

    kinds = ", ".join(f"{n} {t}" for n, t in joined.drop("ka", "kb").dtypes)
    return joined.mapInArrow(compared, f"{kinds}, n_a long, n_b long, common long")


def _parity(keys: np.ndarray) -> np.ndarray:
    """PARITY words, of which bit h(key) tells whether the number of keys there is odd."""
    place = np.bincount((H.mixed(keys) >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(place.astype(np.uint8), bitorder="little").view(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of ids(doc_id), FILTER_BITS at most."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def marked(batches):
        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(FILTERS).mapInArrow(marked, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total


def _places(ids: np.ndarray, bits: int):
    h = H.mixed(ids.astype(np.int64).view(np.uint64))
    for shift in (0, 17, 34):
        yield ((h >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def _sets(docs: DataFrame, ids: DataFrame, heavy: np.ndarray, size: int) -> DataFrame:
    """(doc_id, keys) of at least the documents in ids: their whole sets, from their texts."""
    found = _filter(ids)
    bits = 8 * len(found)

    def full(batches):
        for batch in batches:
            known = batch.filter(pa.array(batch.column(0).is_valid()))
            ok = np.ones(known.num_rows, dtype=bool)
            for at in _places(known.column(0).to_numpy(zero_copy_only=False), bits):
                ok &= (found[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            known = known.filter(pa.array(ok))
            for at in range(0, known.num_rows, 500):
                part = known.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_ordered(v, heavy).tobytes() for _, v in _documents(part, size)], pa.binary())], ["doc_id", "keys"])

    sets = docs.mapInArrow(full, "doc_id long, keys binary")
    return sets if bits < FILTER_BITS else sets.join(ids, "doc_id", "left_semi")


def jaccard_components(docs: DataFrame, *, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id.

    Null and empty texts, and texts without words, have n_shingles 0 and link with nothing. A null
    doc_id links with nothing and has a null component_id. Repeated rows come out as often as they came
    in. Columns other than doc_id and text aren't read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heavy = frequent_shingles(docs, shingle, scratch)
    linked = f"100 * common >= {percent} * (n_a + n_b - common)"
    apart = "n_a + n_b - 2 * common"
    bits = [f"b{k}" for k in range(PARITY)]

    def signed(batches):
        for batch in (part for whole in batches for part in H.parts(whole, 1)):
            sizes, signs, groups, prefixes, parity = [], [], [], [], []
            for _, values in _documents(batch, shingle):
                keys = _ordered(values, heavy)
                n = len(keys)
                prefix = keys[: n - -(-percent * n // 100) + 1] if n else keys
                sizes.append(n)
                signs.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest() if n else None)
                groups.append(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest() if n else None)
                prefixes.append(prefix.astype(np.int64))
                parity.append(_parity(keys))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            words = np.array(parity, np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(groups, pa.binary()), H.lists(flat, [len(x) for x in prefixes]), *(pa.array(words[:, k]) for k in range(PARITY))],
                ["doc_id", "n", "sig", "grp", "prefix", *bits],
            )

    signed_docs = scratch.save(docs.mapInArrow(signed, "doc_id long, n long, sig binary, grp binary, prefix array<long>, " + ", ".join(f"{b} long" for b in bits)), "signed")
    whole = signed_docs.where("n > 0 and doc_id is not null")

    # classes of equal sets, groups of classes with equal prefix and size
    classes = scratch.save(whole.groupBy("sig", "grp", "n").agg(F.min("doc_id").alias("class")), "classes")
    heads = scratch.save(classes.groupBy("grp", "n").agg(F.min("class").alias("head"), F.count("*").alias("classes")), "heads")
    head_rows = whole.join(heads.select(F.col("head").alias("doc_id"), F.col("grp").alias("g")), "doc_id").where("grp = g").select("doc_id", "n", "prefix", *bits).distinct()
    head_rows = scratch.save(head_rows, "head_rows")
    member = classes.join(heads.where("classes > 1").select("grp", "head"), "grp").select(F.col("class").alias("doc_id"), "n", "head")
    member = scratch.save(member.distinct(), "member")

    # prefix shingles that groups share, with the smallest group head of each
    posts = head_rows.select("doc_id", F.posexplode("prefix").alias("pos", "token"))
    shared = scratch.save(posts.groupBy("token").agg(F.count("*").alias("uses"), F.min("doc_id").alias("leader")).where("uses > 1").select("token", "leader"), "shared")
    posts = scratch.save(posts.join(shared, "token").select("token", "doc_id", "leader", (F.col("pos") < LEAD).alias("early")), "posts")

    # members against heads, groups against leaders
    sized = head_rows.select("doc_id", "n", *bits)
    led = posts.where("early and leader != doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    led = led.join(sized.toDF("a", "xn", *(f"x{b}" for b in bits)), "a").join(sized.toDF("b", "yn", *(f"y{b}" for b in bits)), "b")
    led = scratch.save(led.where(_close("0", percent)).select("a", "b", F.greatest("xn", "yn").alias("most")), "led")
    led = _near(led, head_rows, percent)
    in_group = member.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    pairs = scratch.save(led.withColumn("inner", F.lit(False)).union(in_group.withColumn("inner", F.lit(True))), "pairs")

    if not pairs.isEmpty():
        sets = scratch.save(_sets(docs, _ends(pairs), heavy, shingle), "sets1")
        first = _verify(pairs, sets, ["inner"])
    else:
        first = pairs.selectExpr("*", "0L as n_a", "0L as n_b", "0L as common")
    first = scratch.save(first.withColumn("linked", F.expr(linked)), "first")
    links = first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    start = components(links, scratch, "cc1")

    # units: a head with the members that link with it; far: the largest set difference to one of them
    held = first.where("inner and linked").groupBy(F.col("b").alias("doc_id"), F.col("a").alias("head")).agg(F.max(F.expr(apart)).alias("far"))
    member = member.join(held, ["doc_id", "head"], "left").select("doc_id", F.when(F.col("far").isNotNull() | (F.col("doc_id") == F.col("head")), F.col("head")).otherwise(F.col("doc_id")).alias("unit"), F.coalesce("far", F.lit(0)).alias("far"), "head")
    member = scratch.save(member, "units")
    far = member.groupBy(F.col("unit").alias("doc_id")).agg(F.max("far").alias("far"))
    loose = scratch.save(member.where("unit = doc_id and unit != head").select("doc_id").distinct(), "loose")  # heads of their own
    rows, lists = head_rows, posts.select("token", "doc_id")
    if not loose.isEmpty():
        rows = scratch.save(rows.union(whole.join(loose, "doc_id", "left_semi").select(*rows.columns)).distinct(), "unit_rows")
        again = member.select(F.col("head").alias("doc_id")).union(loose).distinct()
        lists = lists.union(rows.join(again, "doc_id", "left_semi").select(F.explode("prefix").alias("token"), "doc_id")).distinct()
    facts = rows.select("doc_id", "n", *bits).join(far, "doc_id", "left").select("doc_id", "n", F.coalesce("far", F.lit(0)).alias("far"), *bits)
    facts = scratch.save(facts, "facts")
    lists = scratch.save(_rooted(lists, start), "lists0")
    scratch.drop("posts", "shared", "sets1")

    # further leaders: one for each shingle that spans components, compared with all others there
    reached, tables = start, []
    for turn in range(1, ROUNDS + 1):
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "token", "doc_id").alias("turn"), "doc_id", "root")).alias("lead")
        spans = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("uses"), drawn).where("lo != hi")
        spans = scratch.save(spans.select("token", "uses", F.col("lead.doc_id").alias("lead"), F.col("lead.root").alias("lead_root")), f"spans{turn}")
        met = lists.join(spans, "token").where("root != lead_root").select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
        met = met.join(_named(facts, "x").withColumnRenamed("xdoc_id", "a"), "a").join(_named(facts, "y").withColumnRenamed("ydoc_id", "b"), "b").where(_close("xfar + yfar", percent))
        met = scratch.save(met.select("a", "b", F.greatest("xn", "yn").alias("most"), F.expr("xfar + yfar").alias("reach")), f"met{turn}")
        met = scratch.save(_near(met, rows, percent, ["reach"]), f"near{turn}")
        if met.isEmpty():
            break
        sets = scratch.save(_sets(docs, _ends(met), heavy, shingle), f"sets{turn + 1}")
        tables.append(scratch.save(_verify(met, sets, ["reach"]).withColumn("linked", F.expr(linked)), f"compared{turn}"))
        scratch.drop(f"sets{turn + 1}", f"met{turn}", f"near{turn}")
        more = tables[-1].where("linked")
        if more.isEmpty():
            break
        links = links.union(more.select("a", "b"))
        reached = components(links, scratch, f"cc1_{turn}")
        # two alone at a shingle have met, and those of one component need not
        lists = scratch.save(_rooted(lists.drop("root").join(spans.where("uses > 2").select("token"), "token", "left_semi"), reached), f"lists{turn}")
        scratch.drop(f"lists{turn - 1}", f"spans{turn}")

    # pairs of units that are still in different components, at their first common shingle
    open_ = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("uses")).where(f"lo != hi and uses > {2 if ROUNDS else 1}").select("token")
    own = lists.join(open_, "token", "left_semi").groupBy("doc_id", "root").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    own = scratch.save(own, "own").join(facts, "doc_id").select("*", F.posexplode("tokens").alias("pos", "token"))
    own = own.select("token", "doc_id", "root", "n", "far", *bits, F.slice("tokens", F.lit(1), F.col("pos")).alias("before"))
    crossed = _named(own, "x", "token").join(_named(own, "y", "token"), "token")
    crossed = crossed.where("xdoc_id < ydoc_id and xroot != yroot and " + _close("xfar + yfar", percent) + " and not arrays_overlap(xbefore, ybefore)")
    crossed = scratch.save(crossed.select(F.col("xdoc_id").alias("a"), F.col("ydoc_id").alias("b"), F.greatest("xn", "yn").alias("most"), F.expr("xfar + yfar").alias("reach")), "crossed")
    crossed = scratch.save(_near(crossed, rows, percent, ["reach"]), "near")
    if not crossed.isEmpty():
        sets = scratch.save(_sets(docs, _ends(crossed), heavy, shingle), "sets0")
        tables.append(scratch.save(_verify(crossed, sets, ["reach"]).withColumn("linked", F.expr(linked)), "compared0"))
        links = links.union(tables[-1].where("linked").select("a", "b"))

    # members of unit pairs whose distance leaves room for a link
    if tables:
        compared = reduce(DataFrame.union, tables)
        room = f"n_a + n_b - 2 * {_least_overlap('n_a', 'n_b', percent)}"
        wide = scratch.save(compared.where(f"not linked and reach > 0 and {apart} - reach <= {room}").select("a", "b").distinct(), "wide")
        if not wide.isEmpty():
            crew = member.select(F.col("unit"), "doc_id").union(wide.select("a", "a")).union(wide.select("b", "b")).distinct()
            spread = wide.join(crew.toDF("a", "da"), "a").join(crew.toDF("b", "db"), "b").where("a != da or b != db").select(F.col("da").alias("a"), F.col("db").alias("b"))
            spread = scratch.save(spread, "spread")
            sets = scratch.save(_sets(docs, _ends(spread), heavy, shingle), "sets_wide")
            links = links.union(scratch.save(_verify(spread, sets, []).where(linked).select("a", "b"), "second"))
        reached = components(links, scratch, "cc2")
    scratch.drop("head_rows", "sets0", "sets_wide", "unit_rows", "facts", "own", *(f"lists{k}" for k in range(ROUNDS + 1)))
    classes = classes.join(reached.select(F.col("id").alias("class"), "root"), "class", "left").select("sig", F.coalesce("root", "class").alias("root"))
    classes = scratch.save(classes, "classes_out")
    slim = signed_docs.select("doc_id", "n", "sig")
    out = slim.where("doc_id is not null and n > 0").join(classes, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    alone = slim.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(alone)


def _rooted(units: DataFrame, roots: DataFrame) -> DataFrame:
    """units(doc_id, ...) with the root of each in roots(id, root), or itself."""
    return units.join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def _named(rows: DataFrame, prefix: str, key: str | None = None) -> DataFrame:
    """rows with the prefix before the names of all columns but the key."""
    return rows.select(*(F.col(c).alias(c if c == key else prefix + c) for c in rows.columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _close(reach: str, percent: int) -> str:
    """SQL on x.. and y..: sizes fit, and the parity bits leave room for a link, given the reach of members."""
    differ = " + ".join(f"bit_count(xb{k} ^ yb{k})" for k in range(PARITY))
    return f"100 * xn >= {percent} * yn and 100 * yn >= {percent} * xn and {differ} <= xn + yn - 2 * {_least_overlap('xn', 'yn', percent)} + {reach}"


def _near(pairs: DataFrame, rows: DataFrame, percent: int, extra: list[str] = []) -> DataFrame:
    """Pairs (a, b) without those of LARGE sets whose prefixes already differ by more than linked sets may.

    Below the smaller of the two last prefix keys, both prefixes show all that the sets hold. Members
    of a unit have the prefix of its head, so what rules out the heads rules out the members.
    """
    small = pairs.where(f"most < {LARGE}").select("a", "b", *extra)
    large = rows.where(f"n >= {LARGE // 2}")
    x, y = (large.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab")
    joined = pairs.where(f"most >= {LARGE}").join(x, "a").join(y, "b").withColumn("lim", F.expr("least(element_at(pa, -1), element_at(pb, -1))"))
    room = f"na + nb - 2 * {_least_overlap('na', 'nb', percent)}"
    ruled = f"size(filter(pa, x -> x <= lim)) + size(filter(pb, x -> x <= lim)) - 2 * size(array_intersect(pa, pb)) <= {room}"
    return small.union(joined.where(ruled).select("a", "b", *extra))


def kept_documents(docs: DataFrame, *, shingle: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs of which one stays for each component: that with the smallest doc_id.

    Rows with a null doc_id or without words stay. Rows that repeat the kept doc_id exactly all stay.
    """
    linked = jaccard_components(docs, shingle=shingle, percent=percent)
    gone = linked.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
