"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to three machines. The normaliser reads spaces and other characters and writes the
space mark for spaces, with arcs for the space in front of a text and for extra spaces (the model's own
character map must be the identity). The lexicon is a trie of all pieces over characters; a piece weighs
minus its score. Byte fallback reads any character that no piece covers, at a fixed weight, and writes its
UTF-8 bytes as byte pieces. They are composed with each input as it is read, and the shortest path in the
tropical semiring (sums of weights, least of all paths) gives the pieces.

The model is a BPE model, and sums of scores alone do not rank segmentations as merging does. So the composed
machine's states are pairs of position and last piece, and an arc from a state to a piece has infinite weight
unless merging the two pieces' characters gives back just these two. Merging gives a sequence exactly if that
holds for all its neighbours: whatever it does inside two neighbours it does to their characters alone as well.
No piece holds a space mark after another character, so inputs are composed run by run, and runs met before are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import hashing as H
from lectern.session import ship

MARK = "▁"
#: Runs (twice as many) and pairs of pieces that a worker remembers.
KEPT = 500_000
#: Characters of a run from which on it isn't remembered.
LONG = 4096
#: Weight of a character by byte fallback, beyond that of any piece.
FALLBACK = 1e6


class Normaliser:
    """arcs: (state, whether a space is read) -> (what is written: the mark, the character), next state.

    States: 0 at the start of a text, 1 after a visible character, 2 after spaces.
    """

    def __init__(self, prefix: bool, squeeze: bool):
        if squeeze:  # spaces are written with the character after them, so those at the ends never are
            self.arcs = {(0, True): (0, 0, 0), (0, False): (int(prefix), 1, 1)} | {(s, True): (0, 0, 2) for s in (1, 2)} | {(s, False): (s - 1, 1, 1) for s in (1, 2)}
        else:
            self.arcs = {(s, True): (1 + (prefix and s == 0), 0, 2) for s in (0, 1, 2)} | {(s, False): (int(prefix and s == 0), 1, 1) for s in (0, 1, 2)}

        # where states 1 and 2 write alike, they are one state with an arc for each character
        same = all(self.arcs[1, x][:2] == self.arcs[2, x][:2] for x in (True, False))
        self.loop = {ord(" "): MARK * self.arcs[1, True][0]} if same else None

    def written(self, run: str, state: int) -> str:
        if state and self.loop is not None:
            return run.translate(self.loop)
        out = []
        for c in run:
            marks, own, state = self.arcs[state, c == " "]
            out.append(MARK * marks + c * own)
        return "".join(out)


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    """Compiled from a model file; encodes texts to piece ids and back."""

    _kept: dict[str, "Transducer"] = {}

    @classmethod
    def of(cls, path: str) -> "Transducer":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        with open(path, "rb") as f:
            model = f.read()
        normaliser: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, 1)
                n = len(self.pieces)
                self.pieces.append(text)
                if kind == 6:
                    self.byte[int(text[3:5], 16)] = n
                elif kind in (1, 4):
                    self.id[text] = n
                    self.score[text] = struct.unpack("<f", piece[2])[0]
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("only models with the identity as their character map are compiled")
        self.prefix = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(self.prefix, bool(normaliser.get(4, 1)))
        if len(self.byte) != 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces with an inner space mark aren't supported")
        inner = {c for p in self.id if len(p) > 1 for c in p}
        cut = "".join(c for c in "\n\t\r" if c not in inner)
        self.run = re.compile(f" *[^ {re.escape(cut)}]+| +" + (f"|[{re.escape(cut)}]" if cut else ""))
        self.trie: dict = {}
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, -self.score[p], {})
        #: Ids of runs met lately, and of those met before these.
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fallback: dict[str, dict[str, bool]] = {}
        self.spines: dict[str, tuple | None] = {}
        #: For each right piece and left one, whether the arc is finite; as many as the lists at the leaves hold.
        self.pairs: list[tuple[dict, str]] = []
        byte_of = {n: b for b, n in self.byte.items()}
        self.out = [bytes([byte_of[n]]) if n in byte_of else (p.replace(MARK, " ").encode() if p in self.id and self.id[p] == n else b"") for n, p in enumerate(self.pieces)]

    def spine(self, piece: str) -> tuple | None:
        """(right, left): what stands at the right and at the left end of a piece while its characters merge.

        Each is a list of (piece, score of the merge that ends it), from the character up to the piece itself, which
        nothing ends. None if merging the characters doesn't give the piece.
        """
        if piece in self.spines:
            return self.spines[piece]
        parts = list(piece)
        right, left = [], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            if at == 0:
                left.append((parts[0], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        whole = [(piece, -math.inf)]
        self.spines[piece] = (right + whole, left + whole) if len(parts) == 1 else None
        return self.spines[piece]

    def joins(self, left: str, right: str) -> bool:
        """Whether the arc from a state with piece `left` (empty: the start) to piece `right` has finite weight.

        Both merge by themselves, best score first and leftmost among equals, unless at some time what stands on either side of
        the boundary would merge before either is merged into more of its own piece.
        """
        inner = self.spine(right)
        if inner is None or not left:
            return inner is not None
        outer = self.spine(left)
        if outer is None:
            return False
        a, b = outer[0], inner[1]
        i = j = 0
        while True:
            (x, ends_x), (y, ends_y) = a[i], b[j]
            s = self.score.get(x + y)
            if s is not None and s > ends_x and s >= ends_y:
                return False
            if ends_x == ends_y == -math.inf:
                return True
            # the better merge comes first, the left one of equals
            if ends_x >= ends_y:
                i += 1
            else:
                j += 1

    def path(self, run: str) -> list[str]:
        """The pieces (or characters for byte fallback) on the shortest path through what the normaliser wrote.

        A state is (last piece, least weight so far, the state before it); states are grouped by position.
        """
        if len(self.pairs) > KEPT:
            for known, left in self.pairs:
                known.pop(left, None)
            self.pairs.clear()
        end, trie, pieces = len(run), self.trie, self.id
        states: list[list[tuple] | None] = [None] * (end + 1)
        states[0] = [("", 0.0, None)]
        for at in range(end):
            here = states[at]
            if here is None:
                continue
            c = run[at]
            leaf = None if c in pieces else (c, FALLBACK, self.fallback.setdefault(c, {}))
            node, to = trie, at
            while True:
                if leaf is not None:
                    piece, weight, known = leaf
                    best = None
                    for state in here:
                        ok = known.get(state[0])
                        if ok is None:
                            ok = known[state[0]] = self.joins(state[0], piece)
                            self.pairs.append((known, state[0]))
                        if ok and (best is None or state[1] < best[1]):
                            best = state
                    if best is not None:
                        reached = at + len(piece)
                        if states[reached] is None:
                            states[reached] = [(piece, best[1] + weight, best)]
                        else:
                            states[reached].append((piece, best[1] + weight, best))
                if to == end:
                    break
                node = node.get(run[to])
                if node is None:
                    break
                to += 1
                leaf = node.get("")
        state = min(states[end], key=lambda s: s[1])
        out = []
        while state[2] is not None:
            out.append(state[0])
            state = state[2]
        return out[::-1]

    def _ids(self, run: str, state: int) -> bytes:
        ids: list[int] = []
        for piece in self.path(self.normaliser.written(run, state)):
            n = self.id.get(piece)
            ids += [n] if n is not None else [self.byte[b] for b in piece.encode("utf-8", "replace")]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The piece ids as little-endian unsigned 32-bit numbers."""
        if len(self.runs) > KEPT:
            self.older, self.runs = self.runs, {}
        runs, older = self.runs, self.older
        found = self.run.findall(text.replace(MARK, " "))
        if not found:
            return b""
        first, rest = found[0], found[1:]
        for run in set(rest).difference(runs):
            if len(run) <= LONG:
                ids = older.get(run)
                runs[run] = ids if ids is not None else self._ids(run, 1)
        return b"".join([self._ids(first, 0), *(runs[r] if len(r) <= LONG else self._ids(r, 1) for r in rest)])

    def decode(self, ids: bytes) -> str:
        """The text of piece ids; ids beyond the model and pieces without text are skipped."""
        out = self.out
        data = b"".join([out[n] for n in np.frombuffer(ids, "<u4").tolist() if n < len(out)])
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encode(docs: DataFrame, *, model: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs(doc_id, text, ...).

    Null and empty texts have no ids. doc_id may be null or repeat; other columns aren't read.
    """
    ship(docs.sparkSession)

    def coded(batches):
        coder = Transducer.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), H.lists(np.frombuffer(b"".join(ids), "<i4"), [len(x) // 4 for x in ids], pa.int32())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(coded, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, *, model: str) -> DataFrame:
    """doc_id, text for every row of coded(doc_id, ids, ...); null ids are an empty text."""
    ship(coded.sparkSession)

    def texts(batches):
        coder = Transducer.of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")


def coding_digest(docs: DataFrame, *, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip: each text encoded, and its ids decoded again.

    Null and empty texts have no ids and decode to an empty text. doc_id may be null or repeat, each row is coded by
    itself; other columns aren't read; an empty table gives none. ids_crc32 is over little-endian unsigned 32-bit ids; round_trip tells whether the decoded text is the text.
    """
    ship(docs.sparkSession)

    def coded(batches):
        coder = Transducer.of(model)
        for batch in batches:
            size, crc, sha, same = [], [], [], []
            data, offsets = H.text_buffers(batch.column(1))
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                ids = coder.encode(text)
                back = coder.decode(ids)
                size.append(len(ids) // 4), crc.append(zlib.crc32(ids)), same.append(back == text)
                sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(coded, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
