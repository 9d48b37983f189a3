"""Byte-level BPE encoding and decoding on numpy matrices.

Pieces of a block are deduplicated, grouped by length and laid out as padded matrices of token ids.
In each round every row merges its leftmost pair of least rank; ranks of pairs come from an open-addressing
hash table, rows without a mergeable pair leave the matrix, and the rest is compacted by one column.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded, mix64

NONE = np.int32(2**31 - 1)
#: Longer pieces are merged with a heap: a matrix would need as many rounds as the piece has bytes.
WIDEST = 256


class PairTable:
    """Hash table from (left id, right id) to the id of the merged token; linear probing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(len(keys) * 3 + 1).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            first = np.unique(slot[todo[free]], return_index=True)[1]
            placed = todo[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            taken = self.keys[slot[todo]] != keys[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix64(keys).astype(np.int64) & self.mask

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge. Ids below 0 are padding."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.int64).astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return np.where((left < 0) | (right < 0), NONE, out)


class Encoder:
    """Ranks of a byte-level BPE. ``ranks``: bytes of each token to its id; all 256 bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.pair_dict: dict[tuple[int, int], int] | None = None
        size = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def from_bytes(cls, content: bytes, pattern: str) -> Encoder:
        """Read lines of base64 token and rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > WIDEST:
                out[i] = self._heap(piece)
            elif piece:
                groups.setdefault(len(piece) if len(piece) <= 16 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in groups.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        rank = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, out = np.arange(len(pieces)), [[] for _ in pieces]
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for r, line, n in zip(rows[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[r] = line[:n]
                live = ~done
                rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            ids[n, at] = least
            after = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            if rank.shape[1]:
                inner = at < rank.shape[1]
                rank[n[inner], at[inner]] = self.pairs.lookup(ids[n[inner], at[inner]], ids[n[inner], at[inner] + 1])
                left = at > 0
                rank[n[left], at[left] - 1] = self.pairs.lookup(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return out

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        if self.pair_dict is None:
            used = self.pairs.values != NONE
            self.pair_dict = {(int(k >> np.uint64(32)), int(k & np.uint64(0xFFFFFFFF))): int(v) for k, v in zip(self.pairs.keys[used], self.pairs.values[used], strict=True)}
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pair_dict.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the end of each text's ids."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > 200_000:
            self.cache.clear()
        new = [p for p in set().union(*split) if p not in self.cache] if split else []
        self.cache.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        get = self.cache.__getitem__
        flat: list[int] = []
        ends = []
        for pieces in split:
            for ids in map(get, pieces):
                flat += ids
            ends.append(len(flat))
        return np.array(flat, np.int32), np.array(ends, np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens one after the other, and where each token's bytes end."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.offsets[ids] - (ends - size), size)
        return self.flat[shift + np.arange(len(shift))], ends


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a rank file, built once."""
    key = (hash(content), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder.from_bytes(content, pattern)
    return _ENCODERS[key]


def _decimals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) of each whole text; null counts as empty. A column named ids is replaced."""
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast((rank_file, pattern))
    carried = [c for c in docs.columns if c != "ids"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*shared.value)
        for batch in blocks(batches, "__text"):
            ids, ends = own.encode(batch.column("__text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), lists], names=[*carried, "ids"])

    return docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, f"{fields}, ids array<int>")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (bytes decoded from the ids).

    Encodes and decodes within one pass, so ids never leave the worker. Null texts are empty texts;
    repeated rows give repeated results.
    """
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*shared.value)
        names = _decimals(len(own.lengths))
        for batch in blocks(batches):
            ids, ends = own.encode(batch.column("text").to_pylist())
            data, token_ends = own.decode(ids)
            byte_ends = np.concatenate(([0], token_ends))[ends]
            raw, listed = memoryview(data), ids.tolist()
            sums, decoded, at, b = [], [], 0, 0
            for end, byte_end in zip(ends.tolist(), byte_ends.tolist(), strict=True):
                sums.append(hashlib.sha256(",".join([names[i] for i in listed[at:end]]).encode()).hexdigest())
                decoded.append(hashlib.sha256(raw[b:byte_end]).hexdigest())
                at, b = end, byte_end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(np.concatenate(([0], ends)))), pa.array(sums), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
