"""The first ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, chat_format, embedding_dedup, hashing, jaccard_join, line_dedup, lm_score, packing, quality, sentencepiece_fst, warc
from lectern.llm.graph import components, most_frequent
from lectern.storage import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n long, score double, prefix string, keys string, _gone string, component_id long"


def corpus(seed=1, n=60):
    """Random documents with near and exact copies, shared lines, and the odd cases."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(n):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 9))]
        texts.append("\n".join(lines))
        if rnd.random() < 0.4:
            words = texts[-1].split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
        if rnd.random() < 0.2:
            texts.append(rnd.choice(texts).upper())
    shared = "one shared line\nsecond shared line here\nthird of them\nfourth"
    texts += [shared + "\nx", "y\n" + shared, shared, "", "   \n\t ", "word", "two words", "é" * 50 + " Ünïcode ß", None]
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(60_000)))
    return texts


def frame(spark, texts, repeat=True):
    rows = [(i, t, 1, 0.5, "p", "k", "g", -1) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[0], rows[0], (None, "a text without an id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---------------------------------------------------------------- shared parts


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["A b\x0bc", "", None, "b a", "ab" * 3_000_000 + " tail", "ab" * 3_000_000]
    data, offsets = hashing.text_buffers(pa.array(texts))
    starts, ends, per = hashing.word_spans(data, offsets)
    h = hashing.word_hashes(data, starts, ends)
    assert per.tolist() == [0, 3, 3, 3, 5, 7, 8]
    assert h[0] == h[4] and h[1] == h[3] and h[5] == h[7] and len(set(h.tolist())) == 5


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    parent = {v: v for e in links for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    alone = {a for a, b in links if a == b}
    assert {v: got.get(v, v) for v in parent} == {v: find(v) for v in parent} and set(parent) - set(got) <= alone
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([9, 5, 5, 3_000_000, 1])], "w long, n long")
    assert sorted(r.n for r in most_frequent(df, "n", 3).collect()) == [9, 3_000_000]
    assert most_frequent(df, "n", 9).count() == 5 and most_frequent(df.where("false"), "n", 9).count() == 0


# ---------------------------------------------------------------- 1 quality


def test_quality_separates_and_survives(spark):
    rnd = random.Random(5)
    good = lambda: " ".join(rnd.choice(["river", "house", "walks", "slowly", "under", "the", "a", "old", "bridge"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "NOW###", "win&&&"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(240)]
    odd = [(900, None), (901, ""), (902, "word " * 150_000), (None, "text"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 0, 9.0) for i, t in rows + odd], "doc_id long, text string, predicted int, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i, _ in rows] + [(None, 1, "x"), (901, None, "x"), (0, 0, "x")], "doc_id long, quality int, text string")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert {r.doc_id for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < 200


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(60)], "doc_id long, text string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in held)) for i in range(60)], "doc_id long, quality int")
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(docs, labels(f)).collect()} for f in (0, 1))
    assert one == two


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).count() == 0
    assert [r.score for r in quality.quality_scores(spark.createDataFrame([(1, "x")], docs.schema), labels).collect()] == [0.5]


def plain_statistics(text):
    """What quality.statistics() says of one text, from strings and counters."""
    found, raw = words(text), (text or "").encode()
    if not found:
        return [0.0] * quality.N_STATS
    n, m = len(raw), len(found)
    kinds = [lambda c: 65 <= c < 91, lambda c: 97 <= c < 123, lambda c: 48 <= c < 58, lambda c: 128 <= c < 192, lambda c: c >= 192, lambda c: c in (9, 10, 11, 12, 13, 32), lambda c: c == 10, lambda c: c < 9 or 14 <= c < 32]
    kinds += [lambda c, x=ord(x): c == x for x in quality.MARKS]
    size = [len(w.encode()) for w in found]
    mean = sum(size) / m
    share = [k / m for k in collections.Counter(found).values()]
    runs = [tuple(found[i : i + 3]) for i in range(m - 2)] or [tuple(found)]
    return [math.sqrt(sum(map(kind, raw)) / n) for kind in kinds] + [
        math.log(n), math.log(m), mean / 8, math.sqrt(sum((x - mean) ** 2 for x in size) / m) / 8, min(max(size), 200) / 50, sum(x <= 2 for x in size) / m, sum(x >= 12 for x in size) / m,
        len(share) / m, max(share), -sum(x * math.log(x) for x in share) / max(1.0, math.log(m)), sum(a == b for a, b in zip(found, found[1:])) / (m - 1) if m > 1 else 0.0, 1 - len(set(runs)) / len(runs),
    ]


@pytest.mark.parametrize("single", [False, True])
def test_quality_is_that_of_one_plain_fit(spark, single):
    """Statistics, kernel ridge and calibration at once over all rows; with `single`, all labels are alike."""
    rnd = random.Random(12)
    texts = corpus(13, 60) + [" ".join(rnd.choice(["BUY!!", "now", "x"]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    label = [1 if single else int(i < 60 or rnd.random() < 0.2) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")).collect()}
    x = np.array([plain_statistics(t) for t in texts], np.float32).astype(np.float64)
    late = {r.doc_id: r.late for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0).alias("late")).collect()}
    learn = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    early, late = [i for i in learn if not late[i]], [i for i in learn if late[i]]
    y = np.array(label, float)
    mean, scale = x[early].mean(0), x[early].std(0)
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(11)
    w, b = rng.normal(size=(quality.N_STATS, quality.FEATURES)) / np.sqrt(2.0 * quality.N_STATS), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))])
    # ridge as least squares over rows for the penalty
    root = np.sqrt(np.append(np.full(quality.FEATURES, quality.RIDGE * len(early) / quality.FEATURES), 1e-9 * len(early)))
    beta = np.linalg.lstsq(np.vstack([z[early], np.diag(root)]), np.concatenate([y[early], np.zeros(len(root))]), rcond=None)[0]
    raw = z @ beta
    bins = sorted({int(v) for v in np.rint(np.clip(raw[late], -1, 2) * quality.BINS)})
    rows = [[i for i in late if int(np.rint(np.clip(raw[i], -1, 2) * quality.BINS)) == k] for k in bins]
    weight = np.array([len(r) for r in rows], float)
    value = np.array([(y[r].sum() + 1 / len(bins)) / (len(r) + 2 / len(bins)) for r in rows])
    # isotonic regression by its formula: the largest over begins of the smallest mean over ends
    fit = [max(min(np.average(value[a : e + 1], weights=weight[a : e + 1]) for e in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    at, to = [], []
    for v in sorted(set(np.round(fit, 12))):
        block = [i for i in range(len(bins)) if round(fit[i], 12) == v]
        at.append(np.average(np.array(bins)[block] / quality.BINS, weights=weight[block])), to.append(v)
    want = np.clip(np.interp(raw, at, to), 0, 1)
    assert max(abs(got[i] - want[i]) for i in range(len(texts))) < 2e-3 and len(set(np.round(want, 3))) > (0 if single else 10)


def test_pooling():
    x, y = quality.pooled(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and abs(y[1] - 1.1 / 3) < 1e-12


# ---------------------------------------------------------------- 2 WARC


def test_archives(spark):
    big, other = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 1500, "y\n" * 700
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u\r\nWARC-Type: request", "small"), (5, "http://a", "small"), (6, "v", None), (7, "w", ""), (8, "z", other), (8, "z", other), (9, "q", other + "\n"), (10, "long", "ab\n" * 400_000), (None, "n", "no id"), (4, "u\r\nWARC-Type: request", "small")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    newest = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            newest[h] = max(newest.get(h, i), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = newest.get(h, i)
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to)] += 1
    assert got == want
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_transactions_are_nested_and_whole(spark):
    scratch = Scratch(spark, "t")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "<html>")], "page_id long, url string, html string"), scratch.path("a"), scratch)
    row = warc.transactions(warc.read_archives(spark, scratch.path("a"))).first()
    assert bytes(row.response.payload) == b"<html>" and [r.target_uri for r in row.requests] == ["http://a/"] and [m.fields["page-id"] for m in row.metadata] == ["1"]
    assert row.response.digest == row.response.stated_digest == hashlib.sha1(b"<html>").hexdigest()


def warc_record(kind, ident, block=b"", *more, length=None):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *more, b"Content-Length: " + (str(len(block)).encode() if length is None else length)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_transactions_follow_both_ways_and_several_names(spark, tmp_path):
    to = lambda x: b"WARC-Concurrent-To: " + x
    (tmp_path / "x.warc").write_bytes(
        warc_record(b"warcinfo", b"<i>", b"software: x")
        # the request comes first, and the response names it and a metadata record
        + warc_record(b"request", b"<q1>") + warc_record(b"response", b"<r1>", b"one", to(b"<q1>"), to(b"<m1>")) + warc_record(b"metadata", b"<m1>", b"a: 1\r\n")
        # two metadata records, one of which names the request only; two names in one record
        + warc_record(b"response", b"<r2>", b"two") + warc_record(b"request", b"<q2>", b"", to(b"<r2>"), to(b"<nowhere>"))
        + warc_record(b"metadata", b"<m2>", b"b: 2", to(b"<r2>"), to(b"<r2>")) + warc_record(b"metadata", b"<m3>", b"c: 3", to(b"<q2>"))
        + warc_record(b"response", b"<r3>", b"three") + warc_record(b"request", b"<q9>", b"", to(b"<nowhere>"))
    )
    got = {r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.transactions(warc.read_archives(spark, str(tmp_path))).collect()}
    assert got == {"<r1>": (["<q1>"], ["<m1>"]), "<r2>": (["<q2>"], ["<m2>", "<m3>"]), "<r3>": ([], [])}
    assert warc.transactions(warc.read_archives(spark, str(tmp_path)).where("false")).count() == 0


def test_archives_beyond_a_split_and_with_bad_headers(spark, tmp_path):
    bodies = [(f"line {i}\n" * 700).encode() for i in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(warc_record(b"resource", f"<{i}>".encode(), b) for i, b in enumerate(bodies)))
    (tmp_path / "empty.warc").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"<{i}>": b for i, b in enumerate(bodies)}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(
        warc_record(b"resource", b"<1>", b"lost", length=b"four") + warc_record(b"resource", b"<2>", b"kept") + b"WARC/1.1\r\nno colon here\r\n\r\n" + warc_record(b"resource", b"<3>", b"cut off", length=b"9999")
    )
    assert [(r.record_id, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "b")).collect()] == [("<1>", b""), ("<2>", b"kept"), (None, b"")]


def test_revisits_name_their_response(spark):
    scratch = Scratch(spark, "t")
    html = "x" * 1200
    warc.write_archives(spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html)], "page_id long, url string, html string"), scratch.path("a"), scratch)
    import gzip
    import pathlib

    text = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(scratch.path("a").removeprefix("file:")).glob("*.gz"))
    revisit = next(x for x in text.split(b"WARC/1.1") if b"WARC-Type: revisit" in x)
    assert b"WARC-Target-URI: http://a/" in revisit and b"WARC-Refers-To-Target-URI: http://b/" in revisit and b"WARC-Refers-To-Date: " in revisit


# ---------------------------------------------------------------- 3 n-gram Jaccard


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard(spark, size, percent, seed):
    texts = corpus(seed, 40)
    got = jaccard_join.jaccard_components(frame(spark, texts), shingle=size, percent=percent).collect()
    assert len(got) == len(texts) + 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(list(enumerate(texts)), size, percent)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_chains_large_groups_and_borderline_pairs(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for step in range(30):  # a chain: neighbours link, ends don't
        docs.append(base[step : step + 150])
    for _ in range(120):  # many near copies of one text
        copy = list(base)
        copy[rnd.randrange(200)] = f"z{rnd.randrange(3)}"
        docs.append(copy)
    for k in range(20):  # one set and its parts at the threshold
        docs.append([f"v{j}" for j in range(100 - k)])
    texts = [" ".join(d) for d in docs]
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for size, percent in ((1, 90), (2, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, shingle=size, percent=percent).collect()}
        assert got == brute_components(docs, size, percent)


def test_jaccard_keeps_one_of_each_group(spark):
    df = frame(spark, ["a b c d e f g", "x", "A b c d e f g", None, "", "x"])
    kept = jaccard_join.kept_documents(df, shingle=5, percent=80)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 0, 0, 1, 3, 4, None, None], key=str)
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0


# ---------------------------------------------------------------- 4 language model


def test_lm_base_counts_are_exact(spark):
    texts = corpus(4, 80)
    df = frame(spark, texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 2 + [(None, "a text without an id at all"), (None, None)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, words(t) + ["\n"]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, ws in tokens:
        want[(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 5))] += 1
    out = lm_score.lm_scores(df).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_lm_is_a_distribution_and_learns_context(spark):
    rnd = random.Random(2)
    texts = [" ".join(("red blue " if rnd.random() < 0.5 else "cat dog ") * 1 for _ in range(60)) for _ in range(300)]
    out = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)


def lm_model(texts, seed=None):
    """A model over the words of some texts, without training; with a seed, its weights are random."""
    import pyarrow as pa

    h, offsets = lm_score.tokens(pa.array(texts))
    words_, counts = np.unique(h, return_counts=True)
    head = len(words_) // 2  # the others are beyond the head, as in a large corpus
    tail = np.bincount(lm_score._hashed_leaf(words_[head:]), counts[head:] + 0.1, lm_score.INNER)
    model = lm_score.Model(words_[:head], counts[:head], float(counts.sum()), float(len(words_)), tail)
    if seed is not None:
        model.w += np.random.default_rng(seed).normal(size=model.w.shape).astype(np.float32)
    return model, h, offsets, dict(zip(words_.tolist(), counts.tolist()))


def naive_probabilities(model, h, offsets, leaf, i):
    """Of all steps, the distribution over branches at position i, the branch taken and the weight rows, by plain loops."""
    begin = max(o for o in offsets[:-1] if o <= i)
    text = h[begin : i + 1]
    c = model.contexts(text, np.array([0, len(text)]))
    out = []
    for k, (node, branch, rows) in enumerate(model.features(c, leaf[begin : i + 1], slice(len(text) - 1, len(text)))):
        z = [float(model.bias[k][node[0], j]) + sum(float(model.w[r[0], j]) for r in rows) for j in range(lm_score.WIDE)]
        most = max(z)
        total = sum(math.exp(v - most) for v in z)
        out.append(([math.exp(v - most) / total for v in z], int(branch[0]), [int(r[0]) for r in rows]))
    return out


def test_lm_score_is_that_of_plain_loops_and_a_distribution():
    import pyarrow as pa

    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(9) if rnd.random() < 0.4 else rnd.randrange(6000)}" for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    model, h, offsets, counts = lm_model(texts, seed=1)
    assert len(counts) > 1.5 * lm_score.SINGLES
    asked = [texts[0], "w1 unseen w2 w1", ""]
    h, offsets = lm_score.tokens(pa.array(asked))
    _, leaf = model.look_up(h)
    n, _, _, score, tail, sizes = lm_score._scored(model, pa.array(asked))
    at = 0
    for d in range(len(asked)):
        want = 0.0
        for i in range(offsets[d], offsets[d + 1]):
            want += sum(math.log10(p[j]) for p, j, _ in naive_probabilities(model, h, offsets, leaf, i))
            want += math.log10((counts.get(int(h[i]), 0) + 0.1) / model.mass[leaf[i]])
        got = score[d] + sum(math.log10(counts.get(int(x), 0) + 0.1) for x in tail[at : at + sizes[d]])
        at += sizes[d]
        assert abs(got - want) < 1e-3 * max(1, abs(want))
    # inside each leaf, its words and one unknown word sum up to 1; leaves of single words hold nothing else
    known = np.array(list(counts), np.uint64)
    held = np.bincount(model.look_up(known)[1], [counts[int(x)] + 0.1 for x in known], lm_score.LEAVES)
    unknown = np.where(np.arange(lm_score.LEAVES) >= lm_score.SINGLES, 0.1, 0.0)
    assert np.allclose(held + unknown, model.mass)


def test_lm_gradients_at_every_position_are_those_of_plain_loops():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    model, h, offsets, _ = lm_model(texts)
    assert len(h) < lm_score.MINI
    _, leaf = model.look_up(h)
    want = model.w.astype(np.float64).copy()
    squares = np.zeros(len(want))
    met = np.zeros(len(want), int)
    for k in range(len(lm_score.CONTEXTS)):  # one batch: all positions see the same weights, steps follow each other
        model_now = lm_score.Model(model.words, model.counts, model.total, model.distinct, model.tail)
        model_now.w = want.astype(np.float32)
        g = np.zeros_like(want)
        for i in range(len(h)):
            p, branch, rows = naive_probabilities(model_now, h, offsets, leaf, i)[k]
            for r in rows:
                met[r] += 1
                for j in range(lm_score.WIDE):
                    g[r, j] += p[j] - (j == branch)
        hit = np.flatnonzero(np.abs(g).sum(1) > 0)
        squares[hit] += (g[hit] ** 2).sum(1)
        want[hit] -= lm_score.STEP * g[hit] / np.sqrt(squares[hit] / 4 + 1)[:, None]
    got_squares, seen = np.zeros(len(model.w), np.float32), np.zeros(len(model.w), np.int64)
    lm_score.descend(model, got_squares, seen, h, offsets)
    assert seen.sum() == sum(map(len, lm_score.CONTEXTS)) * len(h) and (seen == met).all()  # all features of every token, none left out
    assert np.abs(model.w - want).max() < 1e-3 and np.abs(want).max() > 0.01


def test_lm_trains_once_on_each_text_and_averages_by_use(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))) for _ in range(40)]
    one, h, offsets, _ = lm_model(texts)
    frame_ = spark.createDataFrame([(t, 0) for t in texts], "text string, turn int").repartition(1)
    lm_score._train(frame_, one)
    two, h, offsets, _ = lm_model(texts)
    lm_score.descend(two, np.zeros(len(two.w), np.float32), np.zeros(len(two.w), np.int64), h, offsets)
    assert np.abs(one.w - two.w).max() < 1e-5
    # a row that one of two tasks has met moves by the whole of its change
    apart = spark.createDataFrame([("a b", 0)], "text string, turn int").coalesce(1).union(spark.createDataFrame([("g h g h", 0)], "text string, turn int").coalesce(1))
    three, *_ = lm_model(texts)
    lm_score._train(apart, three)
    four, *_ = lm_model(texts)
    import pyarrow as pa

    lm_score.descend(four, np.zeros(len(four.w), np.float32), seen := np.zeros(len(four.w), np.int64), *lm_score.tokens(pa.array(["a b"])))
    five, *_ = lm_model(texts)
    lm_score.descend(five, np.zeros(len(five.w), np.float32), other := np.zeros(len(five.w), np.int64), *lm_score.tokens(pa.array(["g h g h"])))
    alone = (seen > 0) & (other == 0)
    assert alone.any() and np.abs(three.w[alone] - four.w[alone]).max() < 1e-6


def test_lm_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_scores(df).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm_score.lm_scores(spark.createDataFrame([(lone, "only held out")], df.schema)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (4, 0, 0, True) and abs(row.base_score) < 1e-9


# ---------------------------------------------------------------- 5 and 8 embeddings


def vectors(seed=1, n=150, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for k in range(0, n, 5):
        x[k] = x[k // 2] + rng.normal(size=dim) * 0.05
    x[7] = x[8]
    x[9] = 3 * x[8]
    rows = [(i, [float(v) for v in r], 0, "s") for i, r in enumerate(x)]
    odd = [(500, None), (501, [0.0] * dim), (502, [float("nan")] + [1.0] * (dim - 1)), (503, [None] + [1.0] * (dim - 1)), (504, [float("inf")] * dim), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, [1.0] * dim), (600, [1e-30] * dim), (650, [1e30] * dim)]
    return rows + [(*o, 0, "s") for o in odd]


VEC = "vec_id long, embedding array<float>, label int, score string"


def usable(rows):
    return {i: np.array(e, float) for i, e, *_ in rows if i is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) if len(a) == len(b) else -9.0


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + rows[:3], VEC).repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df.where("vec_id % 10 = 0"), df, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = usable(rows)
    for q in (i for i in v if i % 10 == 0):
        want = sorted(((-round(cosine(v[q], v[c]), 12), c) for c in v if c != q and len(v[c]) == len(v[q])))[:5]
        assert [(k, i) for k, i, _ in got[q]] == [(n + 1, c) for n, (_, c) in enumerate(want)]
        assert np.allclose([s for *_, s in got[q]], [-s for s, _ in want], atol=1e-9)
    assert set(got) == {i for i in v if i % 10 == 0}
    assert ann.nearest(df.where("false"), df).count() == 0 and ann.nearest(df, df.where("false")).count() == 0


def test_nearest_in_many_dimensions(spark):
    """Beyond 1,024 dimensions products of codes no longer fit single precision; numbers here need double precision."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 1500)) * 10.0 ** rng.integers(-3, 3, size=(60, 1))
    x[1] = x[0] + 1e-9 * rng.normal(size=1500)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = ann.unit(x)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df, k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(60):
        want = sorted((-c, i) for i, c in enumerate(u @ u[q]) if i != q)[:3]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([c for _, c in got[q]], [-c for c, _ in want], atol=1e-12)


def test_quantised_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = ann.unit(rng.normal(size=(60, 33)) ** 3), ann.unit(rng.normal(size=(70, 33)))
    low, high = ann.bounds(ann.quantised(x), ann.quantised(y))
    exact = x @ y.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < 0.2


def test_near_duplicates(spark):
    rows = vectors(2, 300)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + rows[:2], VEC).repartition(4), report=report).collect()}
    v = usable(rows)
    links = {i: {j for j in v if j != i and cosine(v[i], v[j]) >= 0.9} for i in v}
    root = {i: i for i in v}
    for _ in range(len(v)):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in v}
    want = {i: (len(links.get(i, ())), root.get(i, i), root.get(i, i) == i) for i, *_ in rows if i is not None} | {None: (0, None, None)}
    assert report["recall"] == 1.0 and not report["exact"] and got == want
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def exact_components(x, threshold):
    """(links of each row, smallest row of its component) by brute force."""
    u = ann.unit(x)
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (low == root).all():
            return linked.sum(1), root
        root = low


def deduplicated(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    return np.array([got[i].n_links for i in range(len(x))]), np.array([got[i].component_id for i in range(len(x))])


def test_near_duplicates_keep_lost_pairs_beside_a_hot_group(spark):
    """The links of one large group must not hide that isolated pairs are lost."""
    rng = np.random.default_rng(7)
    hot = rng.normal(size=32) + 0.1 * rng.normal(size=(200, 32))
    first = ann.unit(rng.normal(size=(150, 32)))
    off = rng.normal(size=first.shape)
    off = ann.unit(off - (off * first).sum(1)[:, None] * first)
    x = np.concatenate([hot, first, 0.905 * first + np.sqrt(1 - 0.905**2) * off, rng.normal(size=(700, 32))]).astype(np.float32).astype(np.float64)
    links, root = deduplicated(spark, x)
    want_links, want_root = exact_components(x, 0.9)
    assert (links == want_links).all() and (root == want_root).all()


def test_near_duplicates_count_links_beyond_full_lists(spark):
    """Both ends of the links between groups have more nearer partners than a list holds."""
    rng = np.random.default_rng(8)
    middle, sides = ann.unit(rng.normal(size=(1, 48)))[0], np.linalg.qr(rng.normal(size=(48, 3)))[0].T
    sides = ann.unit(sides - (sides @ middle)[:, None] * middle)
    groups = np.sqrt(0.915) * middle + np.sqrt(0.085) * sides
    x = np.repeat(groups, 90, axis=0) + 0.004 * rng.normal(size=(270, 48))
    links, root = deduplicated(spark, x)
    want_links, want_root = exact_components(x, 0.9)
    assert want_links.min() > 89 and (links == want_links).all() and (root == want_root).all()


def bridged(rng, n=100, dims=32, noise=0.02):
    """Two clusters of n, one pair of which links at a cosine of 0.913 though all others are farther apart."""
    a = ann.unit(rng.normal(size=(1, dims)))[0]
    off = rng.normal(size=dims)
    off = off - (off @ a) * a
    off /= np.linalg.norm(off)
    turn = lambda v, c: c * v + np.sqrt(1 - c * c) * off
    left = ann.unit(a + noise * rng.normal(size=(n, dims)) / np.sqrt(dims))
    right = ann.unit(turn(a, 0.87) + noise * rng.normal(size=(n, dims)) / np.sqrt(dims))
    angle = np.arccos(0.87) - np.arccos(0.913)
    # the ends lean towards each other, each near its own cluster
    ends = [np.cos(angle / 2) * a + np.sin(angle / 2) * off, np.cos(np.arccos(0.87) - angle / 2) * a + np.sin(np.arccos(0.87) - angle / 2) * off]
    return np.concatenate([left, right, ends])


def test_near_duplicates_keep_a_bridge_between_full_lists(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([bridged(rng), rng.normal(size=(800, 32))])
    want_links, want_root = exact_components(x, 0.9)
    assert (ann.unit(x[:100]) @ ann.unit(x[100:200]).T).max() < 0.9 and want_links[200] == want_links[201] == 101 and len(set(want_root[:202])) == 1
    links, root = deduplicated(spark, x)
    assert (links == want_links).all() and (root == want_root).all()


def test_near_duplicates_of_loose_and_wide_groups(spark, monkeypatch):
    """Groups whose members only partly link, many of them with more links than lists hold; and lists so short that all are."""
    rng = np.random.default_rng(11)
    centres = ann.unit(rng.normal(size=(3, 24)))
    loose = np.concatenate([c + s * rng.normal(size=(150, 24)) / np.sqrt(24) for c, s in zip(centres, (0.33, 0.25, 0.1))])
    x = np.concatenate([loose, rng.normal(size=(300, 24))])
    want_links, want_root = exact_components(x, 0.9)
    assert 64 < want_links.max() < 150 and (want_links[:150] > 0).any()
    links, root = deduplicated(spark, x)
    assert (links == want_links).all() and (root == want_root).all()
    monkeypatch.setattr(embedding_dedup, "MOST_K", 4)
    links, root = deduplicated(spark, x)
    assert (links == want_links).all() and (root == want_root).all()


def test_near_duplicates_go_on_where_the_audit_finds_losses(spark, monkeypatch):
    rng = np.random.default_rng(12)
    first = ann.unit(rng.normal(size=(400, 32)))
    off = rng.normal(size=first.shape)
    off = ann.unit(off - (off * first).sum(1)[:, None] * first)
    x = np.concatenate([first, 0.902 * first + np.sqrt(1 - 0.902**2) * off])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want_links, _ = exact_components(x, 0.9)
    report = {}
    monkeypatch.setattr(embedding_dedup, "GROUP", 8)  # codes so long that a table seldom brings a pair together
    monkeypatch.setattr(embedding_dedup, "MISS", 0.6)
    monkeypatch.setattr(embedding_dedup, "DESCENTS", 0)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, report=report).collect()}
    assert report["passes"] > 2 and [got[i] for i in range(len(x))] == want_links.tolist()
    monkeypatch.setattr(embedding_dedup, "PASSES", 2)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, report=report).collect()}
    assert report["exact"] and [got[i] for i in range(len(x))] == want_links.tolist()


def test_link_counts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)) * 0.25 + 1
    df = spark.createDataFrame([(0, i, 1 + i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "root long, id long, copies long, v array<double>")
    got = {r.id: r.links for r in embedding_dedup._link_counts(df, 0.95).collect()}
    assert got == {i: sum(1 + j % 2 for j in range(40) if j != i and cosine(x[i], x[j]) >= 0.95) for i in range(40)}


# ---------------------------------------------------------------- 6 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = corpus(6, 50) + ["<|endoftext|> İstanbul ΣΑΣ don't I'LL x. y.. z,, (a). ½ … ,", "a" * 9000]
    df = frame(spark, texts)
    rows = list(enumerate(texts)) + [(0, texts[0])] * 2 + [(None, "a text without an id at all"), (None, None)]
    coder = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), 512)):
            want[(i, p, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))] += 1
    out = packing.pack(df, tokenizer=WORD_BPE, capacity=512).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(held) <= 1.02 * -(-sum(r.length for r in out) // 512) + 1
    assert packing.pack(df.where("false"), tokenizer=WORD_BPE).count() == 0


@pytest.mark.parametrize("counts", [{}, {10: 3}, {7: 1000, 3: 1}, {6: 5, 4: 5, 3: 9, 1: 2}, {5: 1_000_000_000_000}, {k: 17 * k % 23 for k in range(1, 11)}])
def test_plan_uses_up_the_counts(counts):
    used, total = collections.Counter(), 0
    for times, runs in packing.plan(counts, 10):
        assert sum(n * c for n, c in runs) <= 10 and times > 0
        for n, c in runs:
            used[n] += times * c
        total += times
    assert used == +collections.Counter(counts)
    assert total >= -(-sum(n * c for n, c in counts.items()) // 10)


# ---------------------------------------------------------------- 7 chat


def test_chat_round_trip(spark):
    rnd = random.Random(8)
    parts = ["\\", "### Assistant: ", "</turn>", "###", " </turn>\n", "a", "é😀", "\n", ":", "### User: ", "\\n", ""]
    rows = []
    for conv in range(30):
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "tool: x\n\\", "", "user"])
            rows.append((conv, turn, role, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))))
    rows += [(40, 0, "user", None), (40, 1, "assistant", "x" * 300_000), (40, 1, "assistant", "tie"), (41, 0, "user", "same"), (41, 0, "user", "same"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, loss boolean").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.segments(df)).collect()}
    convs = collections.defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((n, r, t or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-7].valid and not got[41].valid and got[41].bad_turn == 1
    assert chat_format.read_back(chat_format.segments(df.where("false"))).count() == 0


def test_chat_reads_any_role_back(spark):
    roles = ["\\n", "\n", "\\\n", "a:b\\:", "\\", "### User: ", " </turn>\n", "+", "-", ": "]
    rows = [(1, k, r, "t") for k, r in enumerate(roles)]
    got = chat_format.read_back(chat_format.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == len(roles) and got.turns_sha256 == hashlib.sha256("".join(f"{r}\nt\n" for r in roles).encode()).hexdigest()


def test_chat_nulls_and_machine(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, None, None, "b"), (3, 0, "system", "s"), (3, 1, "user", "u")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.valid, r.bad_turn) for r in chat_format.read_back(chat_format.segments(df)).collect()}
    assert got == {None: (2, False, 0), 3: (2, False, None)}
    flags = [r.loss for r in chat_format.segments(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], df.schema)).orderBy("segment").collect()]
    assert flags == [False, False, False, False, True, False, False]


# ---------------------------------------------------------------- 9 lines


def brute_lines(docs):
    first, found = {}, []
    for i, t in docs:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = "\n".join(lines[p : p + 3])
            if w.strip():
                found.append((w, (i, p)))
                first[w] = min(first.get(w, (i, p)), (i, p))
    gone = collections.defaultdict(set)
    for w, at in found:
        if first[w] != at:
            gone[at[0]] |= {at[1], at[1] + 1, at[1] + 2}
    return {i: ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), t.count("\n") + 1, len(gone[i])) for i, t in docs}


def test_lines(spark):
    texts = corpus(7, 40) + ["a\nb\nc\na\nb\nc\na\nb\nc", "\n\n\n\n", "l\n" * 30_000 + "end"]
    got = line_dedup.dedup_lines(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 4
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got if r.doc_id is not None and r.text is not None} == brute_lines([(i, t) for i, t in enumerate(texts) if t is not None])
    assert [(r.n_lines, r.n_removed) for r in got if r.text is None] == [(0, 0)] * 2


def test_lines_as_a_stage(spark):
    df = frame(spark, ["a\nb\nc", "a\nb\nc", "", "x\na\nb\nc", None], repeat=False).withColumn("n_chars", F.lit(7).cast("long")).withColumn("_lines", F.lit(1))
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text is not None) == [(0, "a\nb\nc", 5), (2, "", 0), (3, "x", 1)]
    assert line_dedup.without_repeated_lines(df.where("false")).count() == 0


# ---------------------------------------------------------------- 10 SentencePiece


def test_sentencepiece_ids_and_round_trip(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rnd = random.Random(3)
    texts = corpus(8, 30) + ["".join(rnd.choice("   abcdethoniger▁é漢ßΩ\n\t.!0123ЖLOHEU😀<s>") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [" ", "  a  b ", "<s></s><unk><0x41>", "a" * 5000]
    df = frame(spark, texts)
    ids = sentencepiece_fst.encode(df, model=PIECES)
    got = {r.doc_id: r.ids for r in ids.where("doc_id is not null").collect()}
    assert all(got[i] == model.encode(t or "") for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(ids, model=PIECES).where("doc_id is not null").collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    digest = sentencepiece_fst.coding_digest(df, model=PIECES).collect()
    assert len(digest) == len(texts) + 4 and {r.doc_id: r.n_ids for r in digest if r.doc_id is not None} == {i: len(x) for i, x in got.items()}
    assert sentencepiece_fst.encode(df.where("false"), model=PIECES).count() == 0


def test_near_duplicates_keep_what_only_the_audit_finds(spark, monkeypatch):
    """A descent that finds nothing, and an audit that looks only once."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 32))
    x[7] = x[3] + 0.1 * rng.normal(size=32)
    audit, calls = embedding_dedup._audited, []

    def once(links, *rest):
        calls.append(1)
        n, missed = audit(links, *rest)
        return (n, missed) if len(calls) == 1 else (0, missed.where("false"))

    monkeypatch.setattr(embedding_dedup, "_compared", lambda groups, coded, state, threshold: coded.where("false").selectExpr("id", "id as near", "0D as sim", "0D as slack"))
    monkeypatch.setattr(embedding_dedup, "_audited", once)
    monkeypatch.setattr(embedding_dedup, "PASSES", 4)
    # whatever the estimate says, the result comes from the links known
    edges = lambda vectors, links, threshold, scratch: embedding_dedup._by_edges(vectors, links, vectors.where("false").select("id"), threshold, scratch, None)
    monkeypatch.setattr(embedding_dedup, "_all_pairs", edges)
    links, root = deduplicated(spark, x)
    assert links.tolist() == [int(i in (3, 7)) for i in range(60)] and root[7] == root[3] == 3


# ---------------------------------------------------------------- ids of words


def test_word_ids_are_the_tokenizers(monkeypatch):
    """Every character below U+0180 beside marks, and odd texts, with a cache that forgets."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(packing, "CACHE", 700)
    coder = packing.WordIds(WORD_BPE)
    texts = [w + m for c in map(chr, range(0x21, 0x180)) for w in (c, "a" + c, c + "a", "A" + c + "B") for m in (", y", ". y", " z", ",\nq", ".\nq", ".")]
    rnd = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüßéèñçåøœřżłšđABCÄÖİıſŉ×÷ªº'.,-!?0123 \n\t<|>    жя日本"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["", "   ", "<|endoftext|> a", "İ, ", "aİ, x", "it's don't WE'LL", "a" * 31, "ab" * 16, "ab" * 17, "é" * 16, "x" * 5000, "Ö ж Ö"]
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, where = coder.encode([t.encode() for t in part])
        for k, t in enumerate(part):
            assert ids[where[k] : where[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert len(coder.keys) <= packing.CACHE and len(coder.ids) == coder.size.sum()
