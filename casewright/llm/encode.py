"""Byte-level BPE encoding of a whole corpus, merged in numpy matrices."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How the public byte-level vocabulary parts a text before merging (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest pieces of each matrix, in bytes; longer pieces are merged through a heap, in n log n instead of n * n steps.
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256)
#: Pieces that a worker remembers, and texts encoded at once: bounds of memory only, no result depends on them.
REMEMBERED, AT_ONCE_CHARS = 400_000, 4_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Hash table from a pair of ids to (rank, merged id), looked up for whole arrays at once."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        """Rank is the position in the arrays; ids are below 2**24."""
        self.bits = max(4, int(len(left)).bit_length() + 2)
        n = 1 << self.bits
        self.keys = np.full(n, -1, np.int64)
        self.rank = np.full(n, NONE, np.int32)
        self.merged = np.full(n, -1, np.int32)
        keys = self._key(left, right)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            at = slot[put]
            self.keys[at], self.rank[at], self.merged[at] = keys[todo[put]], todo[put], merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + (~free)[~put]) & (n - 1)

    @staticmethod
    def _key(left, right) -> np.ndarray:
        return (np.asarray(left, np.int64) << 24) | np.asarray(right, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self._MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and ranks of pairs of any shape; NONE is the rank of a pair that never merges."""
        shape = left.shape
        keys = self._key(left, right).ravel()
        slot = self._slot(keys)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[todo]]
            todo = todo[(seen != keys[todo]) & (seen != -1)]
        rank = np.where(self.keys[slot] == keys, self.rank[slot], NONE)
        return slot.reshape(shape), rank.reshape(shape)


NONE = np.int32(2**31 - 1)


class MatrixBPE:
    """Encoder of one vocabulary; ``encode_pieces`` merges many pieces side by side."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        self.pairs = PairTable(left, right, merged)
        self.known: dict[str, np.ndarray] = {}
        self.split = regex.compile(PIECES).findall

    @staticmethod
    def arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id of each byte, left, right and merged id of each merge in order) of a vocabulary file."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        bytes_ = np.zeros(256, np.int32)
        for symbol, b in _byte_symbols().items():
            bytes_[b] = vocab[symbol]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([(vocab[x], vocab[y], vocab[x + y]) for x, y in merges], np.int32).reshape(-1, 3)
        return bytes_, a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Rounds over a padded matrix: each row merges its leftmost pair of least rank, finished rows leave."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        m = np.full((n, width), -1, np.int32)
        filled = np.arange(width) < lengths[:, None]
        m[filled] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        rows = np.arange(n)
        while len(rows):
            if m.shape[1] < 2:
                ended = np.ones(len(rows), bool)
            else:
                left, right = m[:, :-1], m[:, 1:]
                both = right >= 0
                slot = np.zeros(left.shape, np.int64)
                rank = np.full(left.shape, NONE, np.int32)
                slot[both], rank[both] = self.pairs.find(left[both], right[both])
                at = rank.argmin(1)
                ended = rank[np.arange(len(rows)), at] == NONE
            for k in np.flatnonzero(ended):
                out[rows[k]] = m[k, : lengths[rows[k]]].copy()
            go = ~ended
            if not go.any():
                break
            rows, m, at, slot = rows[go], m[go], at[go], slot[go]
            lengths[rows] -= 1
            put = self.pairs.merged[slot[np.arange(len(rows)), at]]
            source = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, source + (source > at[:, None]), 1)
            m[np.arange(len(rows)), at] = put
            m = m[:, : max(1, int(lengths[rows].max()))]
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece: a heap of ranked pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        slots, ranks = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), k, ids[k], ids[k + 1], int(s)) for k, (r, s) in enumerate(zip(ranks, slots)) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def push(k: int, j: int) -> None:
            pair = ids[k], ids[j]
            if pair not in memo:
                s, r = self.pairs.find(np.array([pair[0]]), np.array([pair[1]]))
                memo[pair] = int(r[0]), int(s[0])
            r, s = memo[pair]
            if r != NONE:
                heapq.heappush(heap, (r, k, *pair, s))

        while heap:
            _, k, a, b, s = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = int(self.pairs.merged[s]), -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                push(k, after[j])
            if before[k] >= 0:
                push(before[k], k)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        bucket = np.searchsorted(BUCKETS, np.fromiter(map(len, raw), np.int64, len(raw)))
        for b in np.unique(bucket):
            where = np.flatnonzero(bucket == b)
            if b == len(BUCKETS):
                for k in where:
                    out[k] = self._heap(raw[k])
                continue
            step = max(1, 2_000_000 // BUCKETS[b])
            for s in range(0, len(where), step):
                part = where[s : s + step]
                for k, ids in zip(part, self._matrix([raw[k] for k in part], BUCKETS[b])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, one after the other; null and empty texts have no ids."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({p for pieces in cut for p in pieces if p not in known})
        known.update(zip(new, self.encode_pieces(new)))
        flat = [known[p] for pieces in cut for p in pieces]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.cumsum([0, *map(len, cut)])
        return ends[counts], np.concatenate(flat) if flat else np.zeros(0, np.int32)


def encode_column(df: DataFrame, key: str, text: str, vocab: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """Ids of every text by a byte-level BPE vocabulary, without special tokens: columns ``key`` and ``ids``.

    One row for each row of ``df``, repeats included, no shuffle. Null and empty texts both give the empty list;
    strings of special tokens in a text are ordinary text. ``vocab`` is read by the driver, and its merges (about
    1 MB, bounded by the file) are broadcast. A batch is encoded in groups of at most ``AT_ONCE_CHARS`` characters or
    one text; a very long piece is merged through a heap. Other columns are not read. Null keys stay null.
    """
    if not os.path.exists(vocab):
        raise FileNotFoundError(vocab)
    tables = df.sparkSession.sparkContext.broadcast(MatrixBPE.arrays(vocab))
    source = df.select(df[key].alias(key), df[text].alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MatrixBPE(*tables.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars + len(texts[end] or "") <= AT_ONCE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                offsets, ids = coder.encode(texts[begin:end])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=[key, "ids"])
                begin = end

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
