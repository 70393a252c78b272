"""Best-fit packing of documents into sequences of a fixed length, by exact complements.

All that packing needs of the corpus is how many pieces there are of each length: at
most `capacity` numbers. On these counts the driver plans patterns. For each length, from the
longest, it looks up what fills the gap exactly: a single length, a pair, a triple; and uses the
combination as often as the counts allow. What is left goes best-fit, longest first. Each step
uses up a length or a class of gaps, so the plan stays a few thousand rows for any corpus.
Then every piece gets its number among those of its length (counted within hash buckets and
shifted by the buckets before, so that no task holds all pieces of a length) and looks its
place up in the plan.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.storage import Scratch

#: Pieces in a numbering bucket, on average; the sums by bucket and length are few beside so many.
BUCKET = 50_000
#: Words that a worker keeps the ids of, about 40 bytes each.
CACHE = 1_000_000
#: Bytes of text that are encoded at once; the working arrays of a worker are some forty times as large.
SLICE = 512 << 10
#: Id that ends each document.
END = 1


#: First bytes of characters from U+0180 on, whose lower case may depend on their neighbours.
_BEYOND = re.compile(rb"[\xc6-\xff]")
#: Kinds of bytes: a for letters, digits and white space, . for comma and stop, x for all others.
_KIND = bytearray(b"x" * 256)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c in b" \t\n\r\v\f" or _c >= 0x80 and _c not in (0x97, 0xB7):
        _KIND[_c] = ord("a")
_KIND[ord(".")] = _KIND[ord(",")] = ord(".")


_SAME = np.arange(256, dtype=np.uint8)


def _apart(text: bytes) -> bytes:
    """The text with single commas and stops apart from the words they follow, as the tokenizer takes them.

    Texts with other runs of marks before them, or marks of U+0080 to U+00BF, stay as they are.
    """
    kinds = text.translate(_KIND)
    if b".." in kinds or b"x." in kinds or b"\xc2" in text:
        return text
    return text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")


class Merges:
    """Ids of whole words by the tokenizer's own merges, for many words at once.

    Words are rows of a matrix of symbols; in each step every row merges its leftmost pair of the lowest rank.
    """

    LONGEST = 32

    def __init__(self, state: dict, alphabet: dict[int, str]):
        """state: the tokenizer file's model; alphabet: the character that stands for each byte."""
        vocabulary, end = state["vocab"], state["end_of_word_suffix"]
        # a symbol that is lacking would be none of the tokenizer's: words with it are left to the tokenizer
        self.inner = np.array([vocabulary.get(alphabet[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocabulary.get(alphabet[b] + end, -1) for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in state["merges"]]
        code = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.code[at] == code), self.rank[at], self.none)

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words of at most LONGEST bytes."""
        width = int(sizes.max())
        place = np.arange(width)
        inside = place < sizes[:, None]
        bytes_ = data[np.where(inside, starts[:, None] + place, starts[:, None])]
        symbols = np.where(place == sizes[:, None] - 1, self.last[bytes_], self.inner[bytes_])
        symbols[~inside] = -1
        symbols = np.concatenate([symbols, np.full((len(sizes), 1), -1)], axis=1)
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(sizes))  # those that may still merge
        out = symbols.copy()
        while len(rows):
            pos = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), pos]
            go = lowest < self.none
            out[rows[~go]] = symbols[~go]
            rows, symbols, ranks, pos, lowest = rows[go], symbols[go], ranks[go], pos[go], lowest[go]
            if not len(rows):
                break
            k = np.arange(len(rows))
            symbols[k, pos] = self.made[lowest]
            ahead = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > pos[:, None]), width)
            symbols = np.take_along_axis(symbols, ahead, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(ahead[:, :-1], width - 1), axis=1)
            ranks[:, -1] = self.none
            ranks[k, pos] = self._ranks(symbols[k, pos], symbols[k, pos + 1])
            left = pos > 0
            ranks[k[left], pos[left] - 1] = self._ranks(symbols[k[left], pos[left] - 1], symbols[k[left], pos[left]])
        full = out >= 0
        return out[full], full.sum(axis=1)


#: Letters of one or two bytes below U+0180 in lower case, as far as bytes tell; the two marks among them are looked for.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[0x80:0xC0] = _LETTER[0xC3:0xC6] = True


def _byte_alphabet() -> dict[int, str]:
    """The characters of byte-level vocabularies: visible ones of Latin-1 for themselves, the rest in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts from a tokenizer file, one run of visible characters at a time.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    runs; each distinct run of a slice is looked up once. The ids of runs met lately are kept in arrays, some 40 bytes a run;
    runs are told apart by a 64-bit hash and their length.
    """

    _kept: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model, _byte_alphabet()) if model.get("end_of_word_suffix") and not model.get("dropout") else None
        #: Sorted hashes, and of each: the slice that used it last, where its ids begin, and how many there are.
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.slices = 0

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin, with the end last) of texts."""
        plain = np.array([self._is_plain(t) for t in texts], dtype=bool)
        texts = [_apart(t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()) if ok else t for t, ok in zip(texts, plain)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        starts, ends, per = H.word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = H.mixed(H.word_hashes(data, starts, ends, _SAME) ^ (ends - starts).astype(np.uint64))
        words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.slices += 1
        at = np.searchsorted(self.keys, words)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != words) if len(self.keys) else np.arange(len(words))
        if len(new):
            first = first[new]
            self._learn(words[new], data, starts[first], ends[first], np.repeat(plain, np.diff(per))[first])
            at = np.searchsorted(self.keys, words)
        self.used[at] = self.slices
        sizes = self.size[at][which]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begin[at][which] - done[:-1], sizes) + np.arange(done[-1])]
        self._forget()
        return ids, done[per]

    @staticmethod
    def _is_plain(text: bytes) -> bool:
        """Whether lower-casing the text before is the same to the tokenizer; its special strings are case-sensitive, U+0130 becomes two characters."""
        return not (b"<|" in text or b"\xc4\xb0" in text or _BEYOND.search(text))

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Adds words; of texts that aren't plain, those with other letters than a to z are left to the tokenizer."""
        size = ends - starts
        letters = np.zeros(len(keys), dtype=bool)
        if self.merges is not None:
            other = np.concatenate([[0], np.cumsum(~_LETTER[data])])
            mark = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)), out=mark[1:-1])
            mark[-1] = mark[-2]
            letters = (size <= Merges.LONGEST) & (other[ends] == other[starts]) & (mark[ends - 1] == mark[starts])
            high = np.concatenate([[0], np.cumsum(data >= 0x80)])
            letters &= plain | (high[ends] == high[starts])
        counts = np.zeros(len(keys), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 8), (8, 14), (14, Merges.LONGEST)):
            some = np.flatnonzero(letters & (size > low) & (size <= high))
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                ids, n = self.merges.encode(data, starts[part], size[part])
                counts[part] = n
                found.append((part, ids))
        rest = np.flatnonzero(~letters)
        for at in range(0, len(rest), 2048):
            part = rest[at : at + 2048]
            ids, n = self._tokenized([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part].tolist())])
            counts[part] = n
            found.append((part, ids))
        begin = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(begin[-1], np.uint32)
        for part, some in found:
            n = counts[part]
            ids[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(len(some))] = some
        place = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, place, begin[:-1] + len(self.ids))
        self.size, self.used = np.insert(self.size, place, counts), np.insert(self.used, place, self.slices)
        self.keys, self.ids = np.insert(self.keys, place, keys), np.concatenate([self.ids, ids])

    def _tokenized(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each run) of runs in one go; a token belongs to the run in which it starts."""
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.searchsorted([o[0] for o in found.offsets], begin)
        return np.array(found.ids, np.uint32), np.diff(cut)

    def _forget(self) -> None:
        """Beyond CACHE runs, keeps the half used last."""
        if len(self.keys) <= CACHE:
            return
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.keys, self.used, begin, self.size = self.keys[keep], self.used[keep], self.begin[keep], self.size[keep]
        done = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = self.ids[np.repeat(begin - done[:-1], self.size) + np.arange(done[-1])]
        self.begin = done[:-1]


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs(doc_id, text); a null text is empty."""

    def cut(batches):
        coder = WordIds.of(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in (part for whole in batches for part in H.parts(whole, 1, SLICE)):
            data, offsets = H.text_buffers(batch.column(1))
            found, at = coder.encode([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows)])
            found = found.astype("<u4", copy=False)
            rows, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = found[at[i] : at[i + 1]].tobytes() + end
                n = len(ids) // 4
                for k, begin in enumerate(range(0, n, capacity)):
                    rows.append(i), piece.append(k), start.append(begin), length.append(min(capacity, n - begin))
                    crc.append(zlib.crc32(ids[4 * begin : 4 * (begin + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Index of what one, two and three available lengths sum up to.

    pair[s] is the larger of two lengths with sum s, triple[s] the largest of three; 0 where there are none.
    Lengths only ever run out, so a 0 stays right; an entry whose lengths have run out is looked for anew.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        n = len(have)
        here = np.flatnonzero(have > 0)
        self.pair, self.triple = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, a in enumerate(here):
            sums = a + here[: k + 1]
            self.pair[sums[sums < n]] = a
        two = np.flatnonzero(self.pair)
        for c in here:
            sums = c + two
            self.triple[sums[sums < n]] = c

    def two(self, total: int) -> tuple[int, int] | None:
        a = int(self.pair[total])
        if a and not self._there(a, total - a):
            a = self.pair[total] = self._larger(total)
        return (a, total - a) if a else None

    def three(self, total: int) -> tuple[int, int, int] | None:
        c = int(self.triple[total])
        while c:
            rest = self.two(total - c) if self.have[c] > 0 else None
            if rest and c in rest:  # the third one may be what the pair needs
                self.have[c] -= 1
                a = rest[0] if self._there(*rest) else self._larger(total - c)
                self.have[c] += 1
                rest = (a, total - c - a) if a else None
            if rest:
                self.triple[total] = c
                return (c, *rest)
            lower = np.arange(c - 1, 0, -1)
            ok = np.flatnonzero((self.have[lower] > 0) & (self.pair[total - lower] > 0))
            c = int(lower[ok[0]]) if len(ok) else 0
        self.triple[total] = 0
        return None

    def _there(self, a: int, b: int) -> bool:
        return self.have[a] > 0 and self.have[b] > (a == b)

    def _larger(self, total: int) -> int:
        """The largest of the lengths that make up the sum with another one, or 0."""
        larger = np.arange(total - 1, (total - 1) // 2, -1)
        ok = np.flatnonzero((self.have[larger] > 0) & (self.have[total - larger] > (larger == total - larger)))
        return int(larger[ok[0]]) if len(ok) else 0

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths that sum up to gap."""
        return (gap,) if self.have[gap] > 0 else self.two(gap) or self.three(gap)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, copies), ...]) that use up the counts."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if have[capacity]:
        out.append((int(have[capacity]), [(capacity, 1)]))
        have[capacity] = 0
    index = Sums(have)
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            have[length] -= 1
            rest = index.filling(capacity - length)
            have[length] += 1
            if not rest:
                break
            need = defaultdict(int)
            for x in (length, *rest):
                need[x] += 1
            times = min(int(have[x]) // n for x, n in need.items())
            for x, n in need.items():
                have[x] -= times * n
            out.append((times, sorted(need.items(), reverse=True)))
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    open_gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity - 1, 0, -1):
        left = int(have[length])
        while left:
            fits = np.flatnonzero(open_gaps[length:])
            gap = length + int(fits[0]) if len(fits) else capacity
            times, runs = gaps[gap].pop() if len(fits) else (left, [])
            if len(fits) and not gaps[gap]:
                open_gaps[gap] = False
            each = min(left, gap // length)  # the fullest sequence that fits takes the next one as well
            used = min(times, left // each)
            if times > used and len(fits):
                gaps[gap].append((times - used, runs))
                open_gaps[gap] = True
            gaps[gap - each * length].append((used, [*runs, (length, each)]))
            open_gaps[gap - each * length] = True
            left -= used * each
    for packed in gaps.values():
        out += packed
    return out


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text, ...).

    Null and empty texts are one id, the end. doc_id may be null or repeat; each row is packed by
    itself. Longer documents are cut every `capacity` ids. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer=tokenizer, capacity=capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = cut.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    sums = scratch.save(sums.select("bucket", "length", before.alias("before")), "before")
    place = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    # the window has the rows where the join wants them: only the sums move, and nothing is broadcast
    ranked = cut.withColumn("at", place).join(sums.hint("merge"), ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("at") - 1)

    slots, sequences, taken = [], 0, defaultdict(int)
    for times, runs in plan(counts, capacity):
        offset = 0
        for length, copies in runs:
            slots.append((length, taken[length], sequences, copies, offset))
            taken[length] += times * copies
            offset += length * copies
        sequences += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    keys = table[:, 0] << np.int64(44) | table[:, 1]

    def placed(batches):
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << np.int64(44) | rank, side="right") - 1] if batch.num_rows else table[:0]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
