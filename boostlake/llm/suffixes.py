"""Removal of repeated byte strings by a distributed suffix sort.

Every string of ``length`` bytes that also starts earlier is removed (earlier: smaller doc_id, or the same document
and an earlier start). Winnowing picks anchors, so that equal strings hold equal anchors at equal places; only suffixes
at anchors whose gram repeats are sorted. Sampled splitters range-partition them by their leading bytes and, for a gram
that fills several buckets, by document; each bucket is sorted by multikey quicksort (rightwards from the anchor, and
leftwards for what precedes it), and the common prefixes of neighbours give, for every place, which strings are equal
and which of them comes first.

A gram that lies at the boundary of a bucket may go on in the next one. Of such grams every bucket gives the strings
that are first in it, one row per string; these are compared across boundaries by their hashes.

Exact copies of a text are set aside before: all their strings start earlier in the first copy. Rows with equal doc_id
and text count as one document; different texts of one doc_id follow the order of their hashes. A null doc_id comes first.
Texts may be of any length; those of 16 MiB and more give their anchors by stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded, drop, durable, mix64, text_bytes

#: Bytes of the gram hashed at each place.
GRAM = 32
#: Suffixes that are sorted at a time, and about how many a bucket takes.
SORTED = 60_000
#: Groups up to this size end the quicksort and are ordered symbol by symbol.
SMALL = 16
#: Bytes of text whose anchors meet in one group of the gram join, about.
GROUP_BYTES = 16 << 20
#: Rows up to which the table of copied texts is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_PLACE = np.uint64(0xFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (the last ones read zeros)."""
    padded = np.concatenate((data, np.zeros(GRAM, np.uint8)))
    n = len(data)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        word = np.ndarray(n, "<u8", padded, k, (1,)).astype(np.uint64)
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the concatenated texts: document, place of the anchor, first and last window start it serves, hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data)
    packed = (hashes & ~_PLACE) | np.arange(len(data), dtype=np.uint64)
    at = (sliding_min(packed, length - GRAM + 1) & _PLACE).astype(np.int64)[: len(data) - length + 1]
    starts = np.arange(len(at))
    doc = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[doc]
    starts, doc, at = starts[inside], doc[inside], at[inside]
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return doc[new], at[new], starts[new], starts[last], hashes[at[new]]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of uint64 symbols by multikey quicksort.

    Each group of rows is parted by a pivot symbol, the median of three, into smaller, equal and larger ones; the equal
    ones go on with their next symbol. All groups are parted at once; small ones are left to ``_finish``.
    """
    n, depth = words.shape
    order, group, at = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n) if n > SMALL and depth else np.arange(0)
    while len(open_):
        begin = np.flatnonzero(np.concatenate(([True], group[open_[1:]] != group[open_[:-1]])))
        size = np.diff(np.append(begin, len(open_)))
        symbol = words[order[open_], at[open_]]
        three = np.sort(np.stack((symbol[begin], symbol[begin + size // 2], symbol[begin + size - 1])), axis=0)
        pivot = np.repeat(three[1], size)
        side = (symbol > pivot).astype(np.int64) - (symbol < pivot) + 1
        key = np.repeat(np.arange(len(begin)), size) * 3 + side
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[open_] = order[open_][by]
        at[open_] += side[by] == 1
        parted = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(parted, len(key)))
        group[open_] = np.repeat(open_[parted], count)
        open_ = open_[np.repeat(count > SMALL, count) & (at[open_] < depth)]
    return _finish(words, order, group, at)


def _finish(words: np.ndarray, order: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order the rows within each group from symbol ``at`` on, a symbol at a time for all groups."""
    depth = words.shape[1]
    group, open_ = group.copy(), np.flatnonzero(at < depth)
    at = at.copy()
    while len(open_):
        g = group[open_]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        open_ = open_[np.repeat(np.diff(np.append(first, len(open_))) > 1, np.diff(np.append(first, len(open_))))]
        if not len(open_):
            break
        rows, g, d = order[open_], group[open_], at[open_]
        key = words[rows, d]
        by = np.lexsort((key, g))
        order[open_], key = rows[by], key[by]
        run = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]))))
        count = np.diff(np.append(run, len(open_)))
        group[open_] = np.repeat(open_[run], count)
        at[open_] += 1
        open_ = open_[np.repeat(count > 1, count) & (at[open_] < depth)]
    return order


def _classes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows and the common prefix of each with the one before (0 for the first)."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    common = np.zeros(len(matrix), np.int64)
    for at in range(1, len(matrix), 1 << 16):
        to = min(len(matrix), at + (1 << 16))
        differ = matrix[order[at:to]] != matrix[order[at - 1 : to - 1]]
        common[at:to] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, common


def repeated_windows(contexts: list[bytes], left: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which windows occur before, for anchors in document order.

    Context i holds the bytes from the first window start that anchor i serves to the end of its last window; the
    anchor is ``left[i]`` bytes into it and it serves ``count[i]`` windows. Returns a matrix of booleans: row i,
    column l is the window that starts l bytes before the anchor.
    """
    n, reach = len(contexts), length - GRAM + 1
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(c) for c in contexts])[:-1])).astype(np.int64)
    end = begin + np.array([len(c) for c in contexts], np.int64)
    padded = np.concatenate((flat, np.zeros(length, np.uint8)))
    ahead = (begin + left)[:, None] + np.arange(length)
    right = np.where(ahead < end[:, None], padded[np.minimum(ahead, len(padded) - 1)], 0).astype(np.uint8)
    back = (begin + left)[:, None] - 1 - np.arange(reach - 1)
    before = np.where(back >= begin[:, None], padded[np.maximum(back, 0)], 0).astype(np.uint8)
    right_order, right_common = _classes(right)
    left_order, left_common = _classes(before)
    found = np.zeros((n, reach), bool)
    for shift in range(reach):
        own = np.flatnonzero((left >= shift) & (left - count < shift))
        if len(own) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[right_order] = np.cumsum(right_common < length - shift)
        b[left_order] = np.cumsum(left_common < shift) if shift else 0
        first = np.unique(a[own] * (n + 1) + b[own], return_index=True)[1]
        again = np.ones(len(own), bool)
        again[first] = False
        found[own[again], shift] = True
    return found


def _runs(found: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each run of repeated windows."""
    grid = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    grid[:, 1:-1] = found[:, ::-1]  # by rising window start
    edge = np.diff(grid, axis=1)
    row, s = np.nonzero(edge == 1)
    e = np.nonzero(edge == -1)[1]
    first = at[row] - (found.shape[1] - 1) + s
    return row, first, first + (e - s) + length - 1


def _keys() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def _with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with k1, k2 (hashes of the text), place (doc_id as order), copy (an equal text has a smaller doc_id) and
    twice (the row is one of several with its doc_id and text)."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    rows = rows.select("*", *_keys())
    each = rows.groupBy("k1", "k2", "place").agg(F.count("*").alias("n"))
    of_text = each.groupBy("k1", "k2").agg(F.min(F.struct("place", "n")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    firsts = durable(of_text.select("k1", "k2", F.col("first.place").alias("first_place"), (F.col("first.n") > 1).alias("twice")), "copies")
    small = firsts.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(firsts) if small else firsts, ["k1", "k2"], "left")
    return joined.withColumn("copy", F.coalesce(F.col("place") > F.col("first_place"), F.lit(False))).withColumn("twice", F.coalesce("twice", F.lit(False))).drop("first_place")


def _marks(rows: DataFrame, length: int, groups: int) -> DataFrame:
    """Anchors of ``rows`` (one row per document) whose gram occurs again: k1, k2, marks (anchor, first and last window start).

    Grams that repeat within a block are known to: their anchors are marked at once, and a task tells the others about
    such a gram once. So a gram that fills much of the corpus brings few rows together.
    """
    kind = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<i4"), ("lo", "<u1"), ("n", "<u1")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.uint64)
        turn = TaskContext.get().partitionId()
        for batch in blocks(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            if ends[-1] >= LONG:
                found = _long_anchors(texts[0], length, STEP)  # alone in its block
            else:
                found = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
            doc, at, first, last, h = found
            if not len(doc):
                continue
            base = np.concatenate(([0], ends[:-1]))[doc]
            out = np.zeros(len(doc), kind)
            out["h"], out["at"], out["lo"], out["n"] = h, at - base, at - first, last - first + 1
            for k in ("k1", "k2"):
                out[k] = np.asarray(batch.column(k))[doc]
            grams, which, count = np.unique(h, return_inverse=True, return_counts=True)
            known = (count > 1) | np.isin(grams, told)
            news = np.setdiff1d(grams[count > 1], told)
            told = np.concatenate((told, news))[-TOLD:]
            marked, rest = out[known[which]], out[~known[which]]
            names, ready, pieces = [], [], []
            if len(marked):
                turn += 1
                names.append(turn % groups)
                ready.append(True)
                pieces.append(_squeeze(marked))
            bucket = (rest["h"] >> np.uint64(20)) % np.uint64(groups)
            order = np.argsort(bucket, kind="stable")
            rest, bucket = rest[order], bucket[order]
            far = (news >> np.uint64(20)) % np.uint64(groups)
            for b in np.union1d(bucket, far).tolist():
                lo, hi = np.searchsorted(bucket, (b, b + 1)).tolist()
                own = news[far == b]
                names.append(b)
                ready.append(False)
                pieces.append(np.array([len(own)], "<u4").tobytes() + own.astype("<u8").tobytes() + (_squeeze(rest[lo:hi]) if hi > lo else b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(ready), pa.array(pieces, pa.binary())], names=["bucket", "ready", "piece"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        news, held = [], []
        for batch in batches:
            for x, done in zip(batch.column("piece").to_pylist(), batch.column("ready").to_pylist(), strict=True):
                if done:
                    yield marks_of(_stretch(x, kind))
                    continue
                n = int(np.frombuffer(x, "<u4", 1)[0])
                news.append(np.frombuffer(x, "<u8", n, 4))
                if len(x) > 4 + 8 * n:
                    held.append(_stretch(x[4 + 8 * n :], kind))
        if held:
            keep = np.concatenate(held)
            grams, which, count = np.unique(keep["h"], return_inverse=True, return_counts=True)
            yield marks_of(keep[((count > 1) | np.isin(grams, np.concatenate(news)))[which]])

    def marks_of(keep: np.ndarray) -> pa.RecordBatch:
        """A document's anchors make one row."""
        keep = keep[np.lexsort((keep["at"], keep["k2"], keep["k1"]))]
        begin = np.flatnonzero(np.concatenate(([True], (keep["k1"][1:] != keep["k1"][:-1]) | (keep["k2"][1:] != keep["k2"][:-1])))) if len(keep) else np.zeros(0, np.int64)
        marks = np.zeros(len(keep), MARK)
        marks["f0"], marks["f1"], marks["f2"] = keep["at"], keep["lo"], keep["n"]
        end = np.append(begin[1:], len(keep)) if len(keep) else begin
        return pa.RecordBatch.from_pydict({"k1": pa.array(keep["k1"][begin]), "k2": pa.array(keep["k2"][begin]), "marks": pa.array([marks[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())})

    pieces = rows.select("k1", "k2", "text").mapInArrow(emit, "bucket int, ready boolean, piece binary")
    return pieces.repartitionById(groups, "bucket").mapInArrow(match, "k1 long, k2 long, marks binary")


#: A marked anchor: place, and first and last window start.
MARK = "<i4,<u1,<u1"
#: Grams a task remembers to have told of; it may tell of others again.
TOLD = 1 << 18


#: Bytes from which a text gives its anchors by stretches, and window starts in a stretch.
LONG, STEP = 1 << 24, 1 << 23


def _long_anchors(text: bytes, length: int, step: int) -> tuple[np.ndarray, ...]:
    """Anchors of one text too long for a block's place numbers: by overlapping stretches, equal anchors joined."""
    parts = []
    data = np.frombuffer(text, np.uint8)
    for a in range(0, len(data) - length + 1, step):
        part = data[a : a + step + length - 1]
        _, at, first, last, h = anchors(part, np.array([len(part)]), length)
        parts.append((at + a, first + a, last + a, h))
    at, first, last, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    # an anchor that serves windows on both sides of a cut comes from both stretches
    at, begin = np.unique(at, return_index=True)
    first, last, h = np.minimum.reduceat(first, begin), np.maximum.reduceat(last, begin), h[begin]
    return np.zeros(len(at), np.int64), at, first, last, h


def _squeeze(x: np.ndarray) -> bytes:
    """Anchors of a piece, with the keys of each document once."""
    both = np.stack((x["k1"], x["k2"]), axis=1)
    new = np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1)))
    n = np.array([len(x), int(new.sum())], "<u4")
    doc = (np.cumsum(new) - 1).astype("<u2" if n[1] < 65536 else "<u4")
    return b"".join((n.tobytes(), both[new].astype("<i8").tobytes(), doc.tobytes(), x["h"].tobytes(), x["at"].tobytes(), x["lo"].tobytes(), x["n"].tobytes()))


def _stretch(b: bytes, kind: np.dtype) -> np.ndarray:
    n, docs = np.frombuffer(b, "<u4", 2).tolist()
    at = 8
    keys = np.frombuffer(b, "<i8", 2 * docs, at).reshape(-1, 2)
    at += 16 * docs
    doc = np.frombuffer(b, "<u2" if docs < 65536 else "<u4", n, at)
    at += doc.nbytes
    out = np.zeros(n, kind)
    out["k1"], out["k2"] = keys[doc, 0], keys[doc, 1]
    for field in ("h", "at", "lo", "n"):
        out[field] = np.frombuffer(b, kind[field], n, at)
        at += n * kind[field].itemsize
    return out


def _suffixes(marked: DataFrame, length: int) -> DataFrame:
    """One row per marked anchor: its gram, document order, place, and the bytes of its windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            lead, place, k1, k2, at, left, count, context = ([] for _ in range(8))
            for t, p, a, b, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "place", "k1", "k2", "marks")), strict=True):
                if not marks:
                    continue
                raw = t.encode()
                for m in marks:
                    for x, lo, n in np.frombuffer(m, MARK).tolist():
                        lead.append(raw[x : x + GRAM])
                        place.append(p), k1.append(a), k2.append(b), at.append(x), left.append(lo), count.append(n)
                        context.append(raw[x - lo : x - lo + n - 1 + length])
            if lead:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead, pa.binary()), *(pa.array(x, pa.int64()) for x in (place, k1, k2)), *(pa.array(x, pa.int32()) for x in (at, left, count)), pa.array(context, pa.binary())],
                    names=["lead", "place", "k1", "k2", "at", "left", "count", "context"],
                )

    schema = "lead binary, place long, k1 long, k2 long, at int, left int, count int, context binary"
    return marked.select("text", "place", "k1", "k2", "marks").mapInArrow(cut, schema)


def _compare(suffixes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeated runs (k1, k2, start, end), found within buckets; of grams at a boundary also hash, place and start of
    the windows that come first on their side of it (end is 0)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; they are compared SORTED at a time, and a piece's ends are boundaries like a bucket's."""
        held: list[pa.RecordBatch] = []
        rows, before = 0, None
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SORTED:
                whole = pa.Table.from_batches(held)
                lead = whole.column("lead").to_pylist()
                to = len(lead)
                while to and lead[to - 1] == lead[-1]:
                    to -= 1
                to = to or len(lead)  # one gram fills the piece
                yield from compared(whole.slice(0, to), before is None or lead[0] == before, to == len(lead))
                before, held = lead[to - 1], whole.slice(to).to_batches()
                rows = len(lead) - to
        if held:
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield from compared(whole, before is None or whole.column("lead")[0].as_py() == before, True)

    def compared(t: pa.Table, from_before: bool, goes_on: bool) -> Iterator[pa.RecordBatch]:
        place, k1, k2, at, left, count = (np.asarray(t.column(c)) for c in ("place", "k1", "k2", "at", "left", "count"))
        lead = t.column("lead")
        first_gram, last_gram = lead[0].as_py(), lead[len(lead) - 1].as_py()
        edge = np.zeros(len(place), bool)
        for gram, open_ in ((first_gram, from_before), (last_gram, goes_on)):
            if open_:
                edge |= np.asarray(pc.equal(lead, gram))
        order = np.lexsort((at, k2, k1, place))
        context = t.column("context").to_pylist()
        context = [context[i] for i in order]
        place, k1, k2, at, left, count, edge = (x[order] for x in (place, k1, k2, at, left, count, edge))
        found = repeated_windows(context, left, count, length)
        row, first, end = _runs(found, at.astype(np.int64), length)
        zero = np.zeros(len(row), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], first, end, zero, zero, zero)], names=NAMES)
        shift = np.arange(found.shape[1])
        new = edge[:, None] & ~found & (shift <= left[:, None]) & (shift > (left - count)[:, None])
        row, shift = np.nonzero(new)
        for a in range(0, len(row), SORTED):
            i, s = row[a : a + SORTED], shift[a : a + SORTED]
            sums = [hashlib.blake2b(context[x][y : y + length], digest_size=16).digest() for x, y in zip(i.tolist(), (left[i] - s).tolist(), strict=True)]
            h = np.frombuffer(b"".join(sums), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[i], k2[i], at[i] - s.astype(np.int64), np.zeros(len(i), np.int64), place[i], h[:, 0], h[:, 1])], names=NAMES)

    NAMES = ["k1", "k2", "start", "end", "place", "h1", "h2"]
    by = ["lead", "place", "k1", "k2", "at"]
    dealt = suffixes.repartitionByRange(buckets, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(sort, "k1 long, k2 long, start long, end long, place long, h1 long, h2 long")


def repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, ...) with copy (the text is an exact copy) and spans: binary pairs of int64, the
    first byte and end of runs covered by repeated strings, unmerged. Null text is empty."""
    if not GRAM <= length <= 255:
        raise ValueError(f"length must be from {GRAM} to 255")
    bounded(docs.sparkSession)
    rows = _with_copies(docs)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(docs)
    firsts = rows.where("not copy")
    once = firsts.where("not twice").select("text", "place", "k1", "k2").unionByName(firsts.where("twice").select("text", "place", "k1", "k2").dropDuplicates(["k1", "k2"]))
    found = durable(_marks(once, length, max(tasks, -(-size // GROUP_BYTES))), "marks")
    anchored = found.agg(F.sum(F.octet_length("marks"))).first()[0] or 0
    marks = found.groupBy("k1", "k2").agg(F.collect_list("marks").alias("marks"))
    once = once.repartition(tasks, "k1", "k2").join(marks, ["k1", "k2"])
    buckets = max(tasks, -(-anchored // (np.dtype(MARK).itemsize * SORTED)))
    runs = durable(_compare(_suffixes(once, length), length, buckets), "runs")
    drop(found)
    across = Window.partitionBy("h1", "h2").orderBy("place", "k1", "k2", "start")
    late = runs.where("end = 0").withColumn("n", F.row_number().over(across)).where("n > 1").select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    spans = runs.where("end > 0").select("k1", "k2", "start", "end").unionByName(late)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    copies = rows.where("copy").withColumn("spans", F.when(F.octet_length("text") >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))).otherwise(none))
    return firsts.join(spans, ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", none)).unionByName(copies).drop("twice")


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the spans, and the number of maximal removed runs."""
    out, at, runs = [], 0, 0
    for s, e in sorted(spans):
        if not runs or s > at:
            out.append(text[at:s])
            runs += 1
        at = max(at, e)
    out.append(text[at:])
    return b"".join(out), runs


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, sums = [], [], [], []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = t.encode()
                kept, k = kept_bytes(raw, [(x["start"], x["end"]) for x in spans])
                n.append(len(raw)), removed.append(len(raw) - len(kept)), runs.append(k), sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = repeated(docs.select(F.col("doc_id").cast("long"), "text"), length)
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated strings taken out of text; characters cut in two go. Texts that lose all go as rows."""
    columns = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_bytes(t.encode(), [(x["start"], x["end"]) for x in spans])[0].decode(errors="ignore") if spans else t for t, spans in zip(batch.column("__t").to_pylist(), batch.column("__s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(kept, pa.string()), batch.column("__s")], names=[*columns, "text", "__s"])

    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    rows = repeated(packed, length).select("__row.*", F.col("text").alias("__t"), F.col("spans").alias("__s"))
    out = rows.mapInArrow(run, f"{fields}, text string, __s array<struct<start:bigint,end:bigint>>")
    return out.where("size(__s) = 0 or trim(text) <> ''").select(*docs.columns)
