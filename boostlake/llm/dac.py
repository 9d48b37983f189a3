"""Token ids in directly addressable codes: chunk levels, continuation bitmaps and rank directories.

An id is cut into 8-bit chunks, low first. Level k holds the k-th chunk of every id that has one; bitmap k
says which of them go on to level k + 1; a rank directory holds the ones before each 512-bit block of the
bitmap, so that any token is reached by one rank per level, without decoding a block.

File format: a Parquet table with one row per block of whole documents: part, block, start_in_part,
n_tokens, known (bitmap of documents with an id), doc_ids (int64 LE), doc_ends (int64 LE), levels, bitmaps, ranks (lists of binary).
Parts are ranges of doc_id in ascending order; blocks ascend within a part.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boostlake.llm.blocks import blocks, bounded, durable
from boostlake.llm.bpe import NONE, PairTable

FORMAT = "part int, block long, start_in_part long, n_tokens long, known binary, doc_ids binary, doc_ends binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Bytes of bitmap between entries of a rank directory.
STEP = 64
#: Tokens in a cell, by which places find their blocks: a block lies in few cells and a cell in few blocks.
CELL = 1 << 18


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of non-negative ids."""
    levels, bitmaps, ranks, rest = [], [], [], np.asarray(ids, np.uint64)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_POPCOUNT[bits], np.arange(0, len(bits), STEP), dtype=np.uint32)
        levels.append((rest & np.uint64(255)).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        rest = rest[more] >> np.uint64(8)
    return levels, bitmaps, ranks


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The tokens at places ``at``, by one rank per level; nothing else is decoded."""
    at = np.asarray(at, np.int64)
    out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, (level, bits, directory) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        if not len(open_):
            break
        own, held = np.frombuffer(level, np.uint8), np.frombuffer(bits, np.uint8)
        out[open_] |= own[at].astype(np.uint32) << np.uint32(8 * k)
        more = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        open_, at = open_[more], at[more]
        byte = at >> 3
        first = byte // STEP * STEP
        # bits set from the directory's entry up to the place
        near = first[:, None] + np.arange(STEP)
        whole = np.where(near < byte[:, None], _POPCOUNT[held[np.minimum(near, len(held) - 1)]], 0).sum(axis=1, dtype=np.int64)
        at = np.frombuffer(directory, "<u4")[first // STEP] + whole + _POPCOUNT[held[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
    return out


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All tokens as uint32."""
    rest: np.ndarray | None = None
    for level, bits in zip(reversed(levels), reversed(bitmaps), strict=True):
        own = np.frombuffer(level, np.uint8).astype(np.uint32)
        if rest is not None:
            own[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own), bitorder="little").view(bool)] |= rest << np.uint32(8)
        rest = own
    return np.zeros(0, np.uint32) if rest is None else rest


#: Entries of a generation of the piece cache.
CACHED = 250_000
#: Bytes of the longest piece that is merged in a matrix and cached.
WIDEST = 64
#: Bytes of text cut into pieces at once.
SPAN_BYTES = 4 << 20
_BLANK, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[33:127] = _MARK
_KIND[ord("'")] = _OTHER  # may begin a contraction
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEXT_BLANK = re.compile(rb"[\x09-\x0d ]").search
# The normalizer and pre-tokenizer under which words between blanks can be encoded one by one.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level models use: printable ones stay, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """A byte-level model's merges, on matrices with one piece a row: each round joins every row's leftmost pair of least rank."""

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        split = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(split)}
        self.merged = np.array([vocab[a + b] for a, b in split], np.int32)
        left, right = np.array(list(ranks), np.int64).reshape(-1, 2).T
        self.pairs = PairTable(left, right, np.array(list(ranks.values()), np.int32))

    @classmethod
    def of(cls, model: dict, letters: dict[int, str]) -> Merges | None:
        """None for a model with other rules, or without tokens for all bytes."""
        other = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or any(model.get(k) for k in other) or not all(x in model["vocab"] and x + suffix in model["vocab"] for x in letters.values()):
            return None
        return cls(model, letters)

    def encode(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces of 1 to WIDEST bytes at ``starts`` of ``chars``, no byte 0: in groups, their numbers, how many ids each has, and the ids."""
        widths = np.array([8, 16, 32, WIDEST])
        group = np.searchsorted(widths, sizes)
        for k, width in enumerate(widths.tolist()):
            rows, step = np.flatnonzero(group == k), (1 << 20) // width
            for at in range(0, len(rows), step):
                part, place = rows[at : at + step], np.arange(width)
                raw = np.where(place < sizes[part, None], chars[np.minimum(starts[part, None] + place, len(chars) - 1)], 0)
                held = (ids := self._matrix(raw)) >= 0
                yield part, held.sum(axis=1), ids[held]

    def _matrix(self, raw: np.ndarray) -> np.ndarray:
        """Ids of each row's piece, then -1."""
        sizes, width = (raw != 0).sum(axis=1), raw.shape[1]
        ids = np.where(raw != 0, self.inner[raw], np.int32(-1))
        rows = np.arange(len(raw))
        ids[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        rank = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raw), width - 1)
        out = np.full(raw.shape, -1, np.int32)
        while len(rows):
            n = np.arange(len(rows))
            at = rank.argmin(axis=1)
            least = rank[n, at]
            live = least != NONE
            if not live.all():
                out[rows[~live]] = ids[~live]
                rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
                n = n[: len(rows)]
            # what follows the merged pair moves one place to the left
            ids[n, at] = self.merged[least]
            after = np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            inner = np.flatnonzero(at < width - 1)
            rank[inner, at[inner]] = self.pairs.lookup(ids[inner, at[inner]], ids[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.pairs.lookup(ids[inner, at[inner] - 1], ids[inner, at[inner]])
        return out


class Pool:
    """Runs of ids by number, one after the other."""

    def __init__(self):
        self.n, self.ends, self.flat = 0, np.zeros(1024, np.int64), np.zeros(1024, np.uint32)

    def add(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new runs of ``counts`` ids."""
        held, to = int(self.ends[self.n]), self.n + len(counts)
        if to >= len(self.ends):
            self.ends = np.concatenate((self.ends[: self.n + 1], np.zeros(2 * to - self.n, np.int64)))
        if held + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[:held], np.zeros(2 * (held + len(ids)) - held, np.uint32)))
        self.ends[self.n + 1 : to + 1] = held + np.cumsum(counts)
        self.flat[held : held + len(ids)] = ids
        at, self.n = np.arange(self.n, to), to
        return at

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the runs numbered ``at`` ends when they are joined, from 0, and the ids."""
        held = 4 * self.ends[: self.n + 1]
        runs = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(held), pa.py_buffer(self.flat)])
        _, ends, ids = runs.take(pa.array(at)).buffers()
        ends = np.frombuffer(ends, np.int64, len(at) + 1) // 4
        return ends, np.frombuffer(ids, np.uint32, ends[-1]) if ends[-1] else np.zeros(0, np.uint32)


class WordTokenizer:
    """The library's ids of texts, as unsigned 32-bit integers (of a little-endian machine).

    Under WORD_STEPS the pre-tokenizer never joins across ASCII white space, and a word of ASCII and Latin-1 letters,
    digits and ASCII punctuation other than apostrophes falls into runs of letters, single digits and runs of
    punctuation, only lower-cased. Blocks are cut in numpy into these pieces and the remaining words, of which Arrow finds
    the distinct ones; new pieces are merged by the model's ranks, new words go through all steps of the library. Two
    generations of CACHED short ones are held. Texts with an added token's string, and all texts of files with other
    steps, go through the library as a whole. ``special_as_text`` reads the strings of special tokens as ordinary text,
    which the library as loaded doesn't.
    """

    def __init__(self, content: bytes, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        steps = json.loads(content)
        added = [t for t in steps.get("added_tokens") or [] if not (special_as_text and t["special"])]
        self.by_word = all(steps.get(k) == v for k, v in WORD_STEPS.items()) and not any(t["normalized"] for t in added)
        self.added = [t["content"] for t in added]
        self.letters = _byte_letters()
        self.merges = Merges.of(steps["model"], self.letters) if self.by_word else None
        # numbers of pieces in the pool of their generation
        self.known: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.pool, self.old_pool = Pool(), Pool()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_word or any(x in t for x in self.added)]
        if not whole:
            return self._encode_words(texts)
        known = dict(zip(whole, self._encode_whole([texts[i] for i in whole]), strict=True))
        rest = iter(self._encode_words([t for i, t in enumerate(texts) if i not in known]))
        return [known[i] if i in known else next(rest) for i in range(len(texts))]

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 4096):
            out += (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts[at : at + 4096], add_special_tokens=False))
        return out

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        held = [t.encode() for t in texts]
        raw = b"\n".join(held)
        text_ends = np.cumsum([len(x) + 1 for x in held], dtype=np.int64) - 1
        flat, ends, size, at = [], [], 0, 0
        while at < len(raw):  # spans end at white space, so that a long text is not worked on at once
            cut = _NEXT_BLANK(raw, at + SPAN_BYTES)
            to = cut.end() if cut else len(raw)
            starts, id_ends, ids = self._encode_span(np.frombuffer(raw, np.uint8, to - at, at))
            inside = text_ends[len(ends) : np.searchsorted(text_ends, to, side="right")]
            ends += (size + 4 * id_ends[np.searchsorted(starts, inside - at)]).tolist()
            flat.append(ids.tobytes())
            size, at = size + len(flat[-1]), to
        ends += [size] * (len(held) - len(ends))
        joined = b"".join(flat)
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_span(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start, how many ids are before each piece and after the last, and the ids."""
        kind, low = _KIND[data], _LOWER[data]
        lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
        after = data[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)
        lead, after = lead[letter], after[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] += np.where(after < 0x9F, 32, 0).astype(np.uint8)
        if (other := kind == _OTHER).any():
            word = np.cumsum(kind == _BLANK, dtype=np.int32)
            odd = np.zeros(word[-1] + 1, bool)
            odd[word[other]] = True
            whole = odd[word] & (kind != _BLANK)
            kind[whole], low[whole] = _OTHER, data[whole]
        shown = kind != _BLANK
        begins = shown & (np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == _DIGIT))
        starts, chars = np.flatnonzero(begins), low[shown]
        bounds = np.append(np.flatnonzero(begins[shown]), len(chars)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(chars)]).dictionary_encode()
        at = pieces.indices.to_numpy()
        plain = np.zeros(len(pieces.dictionary), bool)
        plain[at] = kind[starts] != _OTHER
        return starts, *self._ids(pieces.dictionary, plain, at)

    def _ids(self, pieces: pa.Array, plain: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``Pool.take`` of the distinct ``pieces`` numbered ``at``; ``plain`` are those that need no step before the model."""
        if len(self.known) > CACHED:
            self.old, self.old_pool, self.known, self.pool = self.known, self.pool, {}, Pool()
        keys = pieces.to_pylist()
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        before = np.fromiter((self.old.get(keys[i], -1) for i in new.tolist()), np.int64, len(new))
        ends, ids = self.old_pool.take(before[before >= 0])
        place[new[before >= 0]] = self.pool.add(np.diff(ends), ids)
        lost = new[before < 0]
        bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
        sizes = np.diff(bounds)
        short = sizes <= WIDEST
        if self.merges:
            fit = lost[plain[lost] & short[lost]]
            chars = np.frombuffer(pieces.buffers()[2], np.uint8) if len(fit) else None
            for part, counts, ids in self.merges.encode(chars, bounds[fit], sizes[fit]):
                place[fit[part]] = self.pool.add(counts, ids)
            lost = lost[place[lost] < 0]
        for some in (lost[short[lost]], lost[~short[lost]]):
            self._add_by_library(keys, some, plain, place)
        kept = new[short[new]]
        self.known.update(zip([keys[i] for i in kept.tolist()], place[kept].tolist(), strict=True))
        out = self.pool.take(place[at])
        self.pool.n -= int((~short).sum())  # long pieces were added last and are not held
        return out

    def _add_by_library(self, keys: list[bytes], some: np.ndarray, plain: np.ndarray, place: np.ndarray) -> None:
        """Encode ``some`` of the pieces ``keys`` one by one and note their numbers in ``place``."""
        model, other = some[plain[some]], some[~plain[some]]
        made = [array("I", [t.id for t in self.tokenizer.model.tokenize(keys[i].decode("latin-1").translate(self.letters))]).tobytes() for i in model.tolist()]
        made += self._encode_whole([keys[i].decode() for i in other.tolist()])
        place[np.concatenate((model, other))] = self.pool.add(np.array([len(x) // 4 for x in made], np.int64), np.frombuffer(b"".join(made), np.uint32))


_TOKENIZERS: dict[tuple[int, bool], WordTokenizer] = {}


def _tokenizer(content: bytes, special_as_text: bool) -> WordTokenizer:
    key = hash(content), special_as_text
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(content, special_as_text)
    return _TOKENIZERS[key]


def write(docs: DataFrame, tokenizer_file: bytes, *, end_id: int = 2, block_tokens: int = 1 << 18, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and store them in the file format, in ascending doc_id order; the table is reread.

    Null texts are empty; each document ends with ``end_id``. Rows of equal doc_id follow by text, those
    without a doc_id come first, kept apart from ids by a bitmap. Ranges of doc_id come from quantiles of the column and
    go to tasks as they are; equal ids share a part. ``special_as_text``: see WordTokenizer.
    """
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast(tokenizer_file)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = tasks
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.select(F.col("doc_id").cast("long")).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.coalesce(_range_of("doc_id", cuts), F.lit(0))
    dealt = rows.withColumn("part", part.cast("int")).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(shared.value, special_as_text)
        state = {"part": None, "block": 0, "start": 0}
        docs_, ids, ends = [], [], []
        last = struct.pack("<I", end_id)

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            levels, bitmaps, ranks = pack(flat)
            row = {"part": [state["part"]], "block": [state["block"]], "start_in_part": [state["start"]], "n_tokens": [len(flat)]}
            known = np.array([d is not None for d in docs_])
            row |= {"known": [np.packbits(known, bitorder="little").tobytes()], "doc_ids": [np.array([d or 0 for d in docs_], "<i8").tobytes()]}
            row |= {"doc_ends": [np.array(ends, "<i8").tobytes()], "levels": [levels], "bitmaps": [bitmaps], "ranks": [ranks]}
            state["block"] += 1
            state["start"] += len(flat)
            for x in (docs_, ids, ends):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for batch in blocks(batches, limit=SPAN_BYTES):
            encoded = own.encode(batch.column("text").to_pylist())
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), encoded, strict=True):
                if p != state["part"]:
                    if docs_:
                        yield flush()
                    state |= {"part": p, "block": 0, "start": 0}
                ids += (x, last)
                docs_.append(d)
                ends.append((ends[-1] if ends else 0) + len(x) // 4 + 1)
                if ends[-1] >= block_tokens:
                    yield flush()
        if docs_:
            yield flush()

    return durable(dealt.select("part", "doc_id", "text").mapInArrow(run, FORMAT), "tokens")


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.binary()), ("doc_ids", pa.binary()), ("doc_ends", pa.binary())]
    + [(x, pa.list_(pa.binary())) for x in ("levels", "bitmaps", "ranks")]
)


def _range_of(column: str, cuts: list[int]):
    """How many cuts are at or below the column, by a search in a sorted literal array."""
    if not cuts:
        return F.lit(0)
    held = ",".join(f"{c}L" for c in cuts)
    return F.expr(f"aggregate(sequence(1, {max(1, len(cuts)).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo >= s.hi, s, if(element_at(array({held}), int((s.lo + s.hi) div 2) + 1) <= {column}, named_struct('lo', int((s.lo + s.hi) div 2) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)))), s -> s.lo)")


def read(table: DataFrame) -> DataFrame:
    """Per document of a stored table: doc_id, start (tokens of all documents before it), n_tokens, ids (array of long)."""

    def make(ids: np.ndarray, ends: np.ndarray, r: dict) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64)))]

    return _documents(table, "ids array<long>", make)


def digest(table: DataFrame) -> DataFrame:
    """As ``read``, with ids_crc32 of the ids as little-endian uint32 and first_id, the document's first token as
    ``access`` finds it, in place of the ids."""

    def make(ids: np.ndarray, ends: np.ndarray, r: dict) -> list[pa.Array]:
        flat, begins = ids.astype("<u4"), np.concatenate(([0], ends[:-1]))
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
        return [pa.array(sums, pa.int64()), pa.array(access(r["levels"], r["bitmaps"], r["ranks"], begins).astype(np.int64))]

    return _documents(table, "ids_crc32 long, first_id long", make)


def _starts(table: DataFrame) -> DataFrame:
    """(part, part_start): tokens before each part; one row per part, whose number is fixed by the number of tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _documents(table: DataFrame, columns: str, make) -> DataFrame:
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.frombuffer(r["doc_ends"], "<i8")
                begins = np.concatenate(([0], ends[:-1]))
                known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(ends), bitorder="little").view(bool)
                first = r["part_start"] + r["start_in_part"]
                made = make(unpack(r["levels"], r["bitmaps"]), ends, r)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=~known), pa.array(first + begins), pa.array(ends - begins), *made], names=["doc_id", "start", "n_tokens", *names])

    return table.join(F.broadcast(_starts(table)), "part").drop("part", "block", "n_tokens").mapInArrow(run, f"doc_id long, start long, n_tokens long, {columns}")


def fetch(table: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id) for the distinct ``places`` (place long, counted over all tokens in document order) that a stored
    table holds. Each block is read once, and only the places wanted are decoded. Null places and ones beyond the
    table's tokens give no row."""
    starts = F.broadcast(_starts(table))
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = places.select(F.col("place").cast("long").alias("place")).where((F.col("place") >= 0) & (F.col("place") < total)).distinct()
    # places and blocks meet in cells of the token count
    cell = F.floor(F.col("place") / CELL)
    ends = table.select("part", "block", "start_in_part", "n_tokens").join(starts, "part").select(F.struct("part", "block").alias("at"), (F.col("part_start") + F.col("start_in_part")).alias("from"), F.col("n_tokens").alias("n")).where("n > 0")
    covers = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / CELL), F.floor((F.col("from") + F.col("n") - 1) / CELL))))
    found = wanted.withColumn("cell", cell).join(covers, "cell").where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("n")))
    dealt = found.groupBy("at").agg(F.min("from").alias("from"), F.collect_list("place").alias("places")).select("at.part", "at.block", "from", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.array(r["places"], np.int64)
                ids = access(r["levels"], r["bitmaps"], r["ranks"], at - r["from"])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int64))], names=["place", "id"])

    return table.select("part", "block", "levels", "bitmaps", "ranks").join(dealt, ["part", "block"]).drop("part", "block").mapInArrow(run, "place long, id long")
