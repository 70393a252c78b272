"""Fill-in-the-middle, source divergence and exact dedup against brute force and on odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import divergence, exact_dedup, fill_in_middle
from test_ops import DOCS, corpus, frame

ODD = ["a\x01b\n\x02a\x02b\n\n\x01\x01\n", "\n", "\n\n\n", "no line feed", "x\n<P>\ny", "end <", "<\nP>\n<S\n>", "\r\n\u2028\x85\ntail", "😀\n\U0010ffff\nä", "$0\\1\n$1 \\x01\n", "l\n" * 30_000]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 11


def fim(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (100, 100)])
def test_fill_in_middle(spark, rate, spm):
    texts = corpus() + ODD * 5
    docs = frame(spark, texts).select("doc_id", "text")
    made = fill_in_middle.fill_in_middle(docs, rate=rate, suffix_first=spm)
    made = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == docs.count()
    forms = collections.Counter()
    for r in rows:
        n, form, prefix, middle, suffix, output = fim(r.doc_id, r.text, rate, spm)
        assert (r.n_units, r.form, r.prefix, r.middle, r.suffix, r.output) == (n, form, prefix, middle, suffix, output)
        assert r.again == (r.text or "")
        forms[form] += 1
    assert forms["plain"] and (forms["spm"] > 0) == (spm > 0) and (forms["psm"] > 0) == (spm < 100)


def test_fill_in_middle_digest_keeps_to_its_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\n", "x", 1, None), (None, None, None, None, None)], "doc_id long, text string, output string, form int, _text string")
    rows = fill_in_middle.digest(docs).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n, form, prefix, middle, _, output = fim(1, "a\nb\n", 100, 50)
    assert sorted(rows, key=repr) == sorted([(1, n, form, len(prefix), len(middle), sha(output), sha("a\nb\n")), (None, 0, "plain", None, None, sha(""), sha(""))], key=repr)
    whole = fill_in_middle.fill_in_middle(docs)
    assert whole.columns[:5] == docs.columns and whole.columns[5:7] == ["output_", "form_"]
    assert fill_in_middle.digest(docs.where("false")).count() == 0
    other = fill_in_middle.fill_in_middle(spark.createDataFrame([(5, "one two three ")], "doc_id long, text string"), units="[^ ]* |[^ ]+").first()
    assert other.n_units == 3 and other.prefix + other.middle + other.suffix == "one two three "


# ---------------------------------------------------------------- 12


def diverged(rows, least, ranks):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = collections.Counter(t for r, w in zip(rows, terms) if r[0] == lang for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: collections.Counter() for l, s, _ in rows if l == lang}
        for r, w in zip(rows, terms):
            if r[0] == lang:
                count[r[1]].update(t for t in w if df[t] >= least)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), collections.Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            term = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out, key=repr)


def sourced(spark, texts):
    rows = [(["aa", "bb", None, ""][i % 4], [None, "s1", "s2", "s3", "Ü"][i * 7 % 5], t, i, "x") for i, t in enumerate(texts)]
    rows += [("only", "one", "x y", 0, None), ("few", "p", "rare words", 1, None), ("few", "q", None, 2, None), ("one source", "s", "w w w", 3, None)] + [("one source", "s", "w v", 3, None)] * 3
    return rows, spark.createDataFrame(rows, "lang string, source string, text string, n long, term string").repartition(3)


@pytest.mark.parametrize("head,shard", [(1_000_000, 1_000_000), (20, 90), (0, 10_000)])
def test_divergence(spark, head, shard):
    texts = corpus(seed=5) + ["É é Ää _x_ don't A1b2", "word\x00word\x7fword", "É", "日本 語", "É 日本"] * 4
    rows, docs = sourced(spark, texts)
    made = divergence.divergence(docs, least=3, ranks=7, head=head, shard=shard)
    assert rows_of(made) == diverged([r[:3] for r in rows], 3, 7)
    assert dict(made.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_divergence_passes_counters_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    monkeypatch.setattr(divergence, "LOAD", 30)
    rows, docs = sourced(spark, corpus(seed=6, n=20))
    assert rows_of(divergence.divergence(docs, least=2, ranks=3, head=30, shard=40)) == diverged([r[:3] for r in rows], 2, 3)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(docs).count() == 0
    none = spark.createDataFrame([("x", "a", None), ("x", "b", "once"), (None, None, "")], docs.schema)
    assert rows_of(divergence.divergence(none)) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_shares_stay_exact_at_any_size(spark):
    n, total, terms = 12_345_678_901_234_567, 98_765_432_109_876_543, 123_456_789
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"), divergence.gap(F.lit(1_000_000_001).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + terms) and row.f == (1_000_000_001 - 3) ** 2 // 3


# ---------------------------------------------------------------- 13


def deduplicated(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept = False
        for d, t in members:
            stays = not kept and (d, len(t)) == (best[0], len(best[1]))
            kept |= stays
            out.append((d, best[0], len(members), stays, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def copies():
    texts = corpus(seed=9)
    spaced = [t.replace(" ", "  \t").replace("\n", "\x0b\x0c\r\n") for t in texts[:30] if t]
    return texts + spaced + texts[:10] + ["same text of all"] * 300 + ["same  text of all"] * 3 + ["", " ", None, "\u00a0", "\u00a0\n", "sametextofall "]


@pytest.mark.parametrize("bits,capacity", [(64, 2000), (64, 3), (3, 4), (1, 1)])
def test_exact_dedup(spark, bits, capacity):
    docs = frame(spark, copies()).repartition(5)
    made = exact_dedup.exact_duplicates(docs, key_bits=bits, capacity=capacity)
    assert made.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(made) == deduplicated([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_dedup_starts_chains_afresh(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 2_000)
    docs = frame(spark, copies())
    assert rows_of(exact_dedup.exact_duplicates(docs)) == deduplicated([(r.doc_id, r.text) for r in docs.collect()])


def test_without_duplicates_keeps_columns(spark):
    rows = [(1, "a b", "k", 5, None), (2, "ab ", None, 6, 1), (3, "c", "m", 7, 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept int, `_id` int")
    left = exact_dedup.without_duplicates(docs)
    assert left.schema == docs.schema and rows_of(left) == sorted([rows[0], rows[2], rows[3]], key=repr)
    assert exact_dedup.without_duplicates(docs.where("false")).count() == 0 and exact_dedup.exact_duplicates(docs.where("false")).count() == 0


def test_directory_doubles_and_splits():
    counts = np.zeros(64, np.int64)
    counts[:8] = [5, 0, 1, 1, 900, 2, 2, 2]
    counts[40] = 3
    found = exact_dedup.Directory(counts, capacity=6)
    assert found.depth == 6 and len(found.slots) == 64  # the 900 of one prefix can't be split further
    size = lambda b: counts[found.slots == b].sum()
    for b, local in enumerate(found.local):
        slots = np.flatnonzero(found.slots == b)
        assert len(slots) == 1 << (6 - local) and np.array_equal(slots, np.arange(slots[0], slots[0] + len(slots)))  # a range of keys
        assert size(b) <= 6 or local == 6
    assert sum(size(b) for b in range(len(found.local))) == counts.sum()
    assert exact_dedup.Directory(counts * 0, 1).depth == 0
