"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are banded by size so that linked sets lie in the same or neighbouring bands; within a band the sizes bound
their symmetric difference by some K. The feature domain is hashed into first-level parts, each of them into two
second-level parts; a pair with at most K differences has first-level parts with at most one of them, hence agrees on one
second-level part there. A signature is the hash of a set's features in one second-level part.

An empty part tells nothing. There are some more parts than K asks for in large bands, so that a set with no more
empty parts than those to spare shares a filled one with every linked set; other sets give signatures under another
hash function as well, and sets that only agree on empty parts meet there. Sets that meet are compared in full.

Texts with equal sets are one node, a 64-bit hash; sets that share it by chance are told apart by 64 bits more and get nodes
of their own. Signatures with the same nodes make one group; the member with most meetings
leads it, and the groups of one leader make a cell. Members are compared with their leaders first, in chunks. Cells
that then still hold several components are cut into chunks of members, those of the leader's component apart from
the rest, and every chunk of the rest is compared with every chunk of the cell. Pairs within a component are never
needed. Pairs are first held against counts of their features in hashed slots, SLOTS or half as many as features:
sets differ in at least as many features as these counts do, so that most pairs that can't link are known without
their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded, drop, durable, mix64, sized, text_bytes, word_hashes
from boostlake.llm.components import components

#: Hash functions tried for sets with empty parts; the last one's empty parts count as signatures.
SEEDS = 6
#: Bands with K of at least this have spare parts, about as many as the emptiest sets of middle size need.
SPARE_FROM = 16
#: Members of one leader compared in a task, and members of a chunk of a cell.
CHUNK = 400
BLOCK = 256
#: Least number of slots of the feature counts; a power of two.
SLOTS = 256
#: Bytes of text whose signatures meet in one group, about.
GROUP_BYTES = 16 << 20
#: Nodes whose signatures a task remembers to have given; it may give others again.
GIVEN = 1 << 20
#: Rows of node ids up to which the table of nodes to compare is broadcast; beyond, texts are shuffled.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; fewer words make one shingle, none make none."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    starts, _, words = word_hashes(data)
    upto = np.searchsorted(starts, doc_ends)
    full = mix64(words + np.uint64(width))[: max(0, len(words) - width + 1)]
    for k in range(1, width):
        full = mix64(full ^ words[k : len(words) - width + 1 + k]) if len(full) else full
    out, at = [], 0
    for to in upto.tolist():
        if to - at >= width:
            out.append(np.unique(full[at : to - width + 1]))
        elif to > at:
            h = mix64(words[at : at + 1] + np.uint64(to - at))
            for k in range(at + 1, to):
                h = mix64(h ^ words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at = to
    return out


@lru_cache(maxsize=100_000)
def bands(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, K, first-level parts) of the band instances a set of this size takes part in; none where only equal sets link."""
    low, i = 1, 0
    before: tuple[int, int, int, int] | None = None
    while True:
        high = low * 100 // percent
        most = high * 100 // percent
        k = (100 - percent) * (high + most) // (100 + percent)
        empty = (k + 1) * math.exp(-(low + most) / 2 / (k + 1))
        spare = math.ceil(empty + 2 * math.sqrt(empty)) if k >= SPARE_FROM else 0
        parts = -(-(k + 1 + spare) // 2)
        if low <= size <= high:
            own = [(i, k, parts)] if k else []
            return tuple([*([before[:3]] if before and before[1] and size <= before[3] else []), *own])
        before = (i, k, parts, most)
        low, i = high + 1, i + 1


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the set and signature, for all signatures of all sets."""
    owner, sums = [], []
    todo = [(i, *band) for i, s in enumerate(sets) if len(s) for band in bands(len(s), percent)]
    for seed in range(SEEDS):
        if not todo:
            break
        index = np.array([x[0] for x in todo])
        k = np.array([x[2] for x in todo])
        parts = 2 * np.array([x[3] for x in todo])
        tag = np.array([x[1] for x in todo], np.uint64) * np.uint64(64) + np.uint64(seed)
        of = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in index])
        h = mix64(np.concatenate([sets[i] for i in index]) ^ mix64(tag)[of])
        base = np.concatenate(([0], np.cumsum(parts)[:-1]))
        place = base[of] + (h % parts.astype(np.uint64)[of]).astype(np.int64)
        h = mix64(h)
        total = int(parts.sum())
        low = np.bincount(place, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(place, (h >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        value = low + (high << np.uint64(32))
        empty = np.bincount(place, minlength=total) == 0
        group = np.repeat(np.arange(len(todo)), parts)
        number = (np.arange(total) - np.repeat(base, parts)).astype(np.uint64)
        named = mix64(value ^ mix64(tag[group] + mix64(number)))
        use = ~empty if seed < SEEDS - 1 else np.ones(total, bool)
        owner.append(index[group[use]])
        sums.append(named[use])
        again = np.bincount(group[empty], minlength=len(todo)) > parts - k - 1
        todo = [x for x, e in zip(todo, again, strict=True) if e]
    return (np.concatenate(owner), np.concatenate(sums)) if owner else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set: the node, and the mark that tells sets of one node apart."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist())


def _scan(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Documents (doc_id, n_shingles, node, mark) and nodes that share a signature (node, key, n). Pieces of a block's
    signatures go to the task of their bucket, its documents to any. A task gives the signatures of a set once, however
    many copies it has."""
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // GROUP_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in blocks(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            nodes, marks = np.array([set_id(s) for s in sets], np.int64).reshape(-1, 2).T
            ids = np.array([NULL if d is None else d for d in batch.column("doc_id").to_pylist()], "<i8")
            names, pieces = [int(ids.sum() % buckets)], [np.stack((ids, np.array([len(s) for s in sets], "<i8"), nodes, marks)).astype("<i8").tobytes()]
            distinct = np.unique(np.stack((nodes, marks)), axis=1, return_index=True)[1]
            distinct = np.array([i for i in distinct.tolist() if int(marks[i]) not in given], int)
            given = (set() if len(given) > GIVEN else given) | set(marks[distinct].tolist())
            owner, sums = signatures([sets[i] for i in distinct], percent)
            if len(owner):
                bucket = sums % np.uint64(buckets)
                order = np.lexsort((owner, bucket))
                owner, sums = owner[order], sums[order]
                found, begin = np.unique(bucket[order], return_index=True)
                names += found.astype(np.int64).tolist()
                for a, b in zip(begin, [*begin[1:], len(owner)], strict=True):
                    own, place = np.unique(owner[a:b], return_inverse=True)
                    head = np.array([b - a, len(own)], "<u4").tobytes()
                    pieces.append(head + nodes[distinct[own]].astype("<i8").tobytes() + place.astype("<u4" if len(own) > 65535 else "<u2").tobytes() + _short(sums[a:b] // np.uint64(buckets)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([True] + [False] * (len(names) - 1)), pa.array(pieces, pa.binary())], names=["bucket", "rows", "piece"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            pieces, rows = batch.column("piece").to_pylist(), batch.column("rows").to_pylist()
            held += [b for b, r in zip(pieces, rows, strict=True) if not r]
            for b in (b for b, r in zip(pieces, rows, strict=True) if r):
                ids, sizes, nodes, marks = np.frombuffer(b, "<i8").reshape(4, -1)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL), pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array(marks), none, none], names=NAMES)
        if held:
            key, node = _groups(held)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(node), none, pa.array(key), pa.array(np.ones(len(key), np.int64))], names=NAMES)

    NAMES = ["doc_id", "n_shingles", "node", "mark", "key", "n"]
    dealt = docs.mapInArrow(run, "bucket int, rows boolean, piece binary").repartitionById(buckets, "bucket")
    return dealt.mapInArrow(meet, "doc_id long, n_shingles long, node long, mark long, key long, n long")


NULL = np.iinfo(np.int64).min
#: Bytes of a signature that are kept within its bucket; sets that meet by chance are told apart in full.
WIDE = 6


def _short(sums: np.ndarray) -> bytes:
    return np.ascontiguousarray(sums.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE]).tobytes()


def _groups(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that share a signature: (key of the group, node); the key follows from the group's nodes alone."""
    sums, nodes = [], []
    for b in pieces:
        n, k = np.frombuffer(b, "<u4", 2).tolist()
        own = np.frombuffer(b, "<i8", k, 8)
        place = np.frombuffer(b, "<u4" if k > 65535 else "<u2", n, 8 + 8 * k)
        short = np.zeros((n, 8), np.uint8)
        short[:, :WIDE] = np.frombuffer(b, np.uint8, WIDE * n, 8 + 8 * k + place.nbytes).reshape(n, WIDE)
        sums.append(short.view("<u8").ravel())
        nodes.append(own[place])
    s, n = np.concatenate(sums), np.concatenate(nodes)
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(s)])))
    many = np.repeat(size > 1, size)
    s, n = s[many], n[many]
    order = np.lexsort((n, s))
    s, n = s[order], n[order]
    if not len(s):
        return np.zeros(0, np.int64), n
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])))
    s, n = s[fresh], n[fresh]
    bound = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.concatenate((bound, [len(s)])))
    key = mix64(np.add.reduceat(mix64(n.view(np.uint64)), bound) + size.astype(np.uint64)).view(np.int64)
    keep = np.repeat(size > 1, size)
    return np.repeat(key, size)[keep], n[keep]


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link. Each a is compared with chunks of its partners, so no task holds all partners of one."""
    large = sized(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "large", BROADCAST_ROWS)
    dealt = pairs.join(large, "a", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)), F.lit(0)))
    rows = dealt.select("a", "chunk", F.col("b").alias("node")).unionByName(dealt.select("a", "chunk", F.col("a").alias("node")).distinct())

    def compare(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        nodes = group.column("node").to_pylist()
        sets = dict(zip(nodes, shingle_sets(group.column("text").to_pylist(), width), strict=True))
        own, found = sets.pop(a), []
        for b, s in sets.items():
            most = min(len(own), len(s))
            if 100 * most >= percent * max(len(own), len(s)):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    found.append(b)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.join(texts.select("node", "text"), "node").groupBy("a", "chunk").applyInArrow(lambda t: compare(t), "a long, b long")


def _within(cells: DataFrame, roots: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a cell that are in different components so far."""
    nodes = cells.select("a", F.col("b").alias("node")).unionByName(cells.select("a", F.col("a").alias("node")).distinct())
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = sized(cells.select("a").distinct().join(roots.select(F.col("node").alias("a"), F.col("root").alias("head")), "a", "left").withColumn("head", F.coalesce("head", "a")), "heads", BROADCAST_ROWS)
    sided = durable(labelled.join(heads, "a").select("a", "node", "root", (F.col("root") != F.col("head")).alias("rest")), "sided")
    sizes = sided.groupBy("a").agg(F.count(F.when(~F.col("rest"), 1)).alias("n0"), F.count(F.when(F.col("rest"), 1)).alias("n1")).where("n1 > 0 and n0 + n1 > 2")
    parts = sized(sizes.select("a", F.ceil(F.col("n0") / BLOCK).cast("int").alias("k0"), F.ceil(F.col("n1") / BLOCK).cast("int").alias("k1")), "parts", BROADCAST_ROWS)
    spread = F.xxhash64("node")
    chunk = F.when(F.col("rest"), F.col("k0") + F.pmod(spread, F.col("k1"))).otherwise(F.pmod(spread, F.col("k0"))).cast("int")
    placed = sided.join(parts, "a").withColumn("c", chunk)
    # chunk pairs (i, j): i of the rest, j of the leader's component or at most i
    of_rest = F.concat(F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"))), F.when(F.col("c") + 1 < F.col("k0") + F.col("k1"), F.transform(F.sequence(F.col("c") + 1, F.col("k0") + F.col("k1") - 1), lambda i: F.struct(i.alias("i"), F.col("c").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")))
    of_head = F.transform(F.sequence(F.col("k0"), F.col("k0") + F.col("k1") - 1), lambda i: F.struct(i.alias("i"), F.col("c").alias("j")))
    rows = placed.select("a", "node", "root", F.explode(F.when(F.col("rest"), of_rest).otherwise(of_head)).alias("p")).select("a", "p.i", "p.j", "node", "root")

    def compare(group: pa.Table) -> pa.Table:
        nodes, root, size = (np.asarray(group.column(c)) for c in ("node", "root", "size"))
        held = group.column("slots").to_pylist()
        slots = _matrix(held, min(map(len, held)))
        x, y = [], []
        for k in range(len(nodes) - 1):
            ok = (root[k + 1 :] != root[k]) & _may_link(slots[k + 1 :], slots[k], size[k + 1 :], size[k], percent)
            found = np.flatnonzero(ok) + k + 1
            x.append(np.full(len(found), nodes[k])), y.append(nodes[found])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
        return pa.table({"a": pa.array(np.maximum(x, y), pa.int64()), "b": pa.array(np.minimum(x, y), pa.int64())})

    found = rows.join(texts.select("node", "size", "slots"), "node").groupBy("a", "i", "j").applyInArrow(lambda t: compare(t), "a long, b long")
    return _verify(durable(found.distinct(), "pairs"), texts, width, percent)


def link(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Two texts link when 100 * common >= ``percent`` * all of their shingles of ``width`` words; component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no shingles and link with nothing; repeated
    rows give repeated results, and equal texts of any ids are linked. Rows without a doc_id are members like others, but a
    text that only they have gives no links to near copies; their component_id is the smallest doc_id of the component,
    or null. Sets are held as 64-bit hashes of shingles.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = durable(_scan(rows, width, percent), "signatures")
    sets = scanned.where("key is null").select("doc_id", "n_shingles", "node", "mark")
    met = scanned.where("key is not null").groupBy(F.col("key").alias("sig"), "node").agg(F.sum("n").alias("n"))
    strangers = _strangers(sets)
    if strangers is not None:
        sets = sets.join(strangers, ["node", "mark"], "left").select("doc_id", "n_shingles", F.coalesce("other", "node").alias("node"), "mark")
        met = met.unionByName(met.join(strangers, "node").select("sig", F.col("other").alias("node"), "n")).distinct()
    meetings = durable(met, "meetings")
    weights = meetings.groupBy("node").agg(F.sum("n").alias("n"))
    members = durable(meetings.select("sig", "node").join(weights, "node"), "members")
    drop(meetings)

    wanted = sized(members.select("node").distinct(), "wanted", BROADCAST_ROWS)
    first = durable(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark")), "nodes")
    known = first.where("doc_id is not null")
    held = rows.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "doc_id").select("node", "mark", "text")
    # rows that repeat a doc_id with another text are told apart by their set
    texts = durable(_of_node(held, width), "texts")

    leaders = sized(members.groupBy("sig").agg(F.max(F.struct("n", "node")).alias("leader")).select("sig", F.col("leader.node").alias("a")), "leaders", BROADCAST_ROWS)
    cells = durable(members.join(leaders, "sig").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "cells")
    drop(members), drop(leaders)
    close = durable(_near(cells, texts, percent), "pairs")
    near = durable(_verify(close, texts, width, percent), "links")
    roots = components(near)
    far = durable(_within(cells, roots, texts, width, percent), "links")
    if far.limit(1).count():
        roots = components(near.unionByName(far))
    for done in (texts, first, wanted, cells, close, near, far):
        drop(done)
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    own = sets.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shared = own.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = own.join(sized(shared, "components", BROADCAST_ROWS), "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(sets.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _strangers(sets: DataFrame) -> DataFrame | None:
    """(node, mark, other): nodes of their own for sets that share a node by chance; None if there are none. Their number
    grows with the square of the sets over 2^65, so that the table is small."""
    double = sets.where("node is not null").groupBy("node").agg(F.min("mark").alias("own"), F.max("mark").alias("most")).where("own <> most").select("node", "own")
    held = durable(sets.join(durable(double, "double"), "node").where("mark <> own").select("node", "mark").distinct(), "strangers")
    if not held.limit(1).count():
        drop(held)
        return None
    return held.withColumn("other", F.xxhash64("node", "mark"))


def _of_node(held: DataFrame, width: int) -> DataFrame:
    """(node, size, slots, text) of rows whose text has the node's set, one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            own = pa.array([set_id(s)[1] == m for s, m in zip(sets, batch.column("mark").to_pylist(), strict=True)], pa.bool_())
            counts = pa.array([_slots(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), counts, batch.column("text")], names=["node", "size", "slots", "text"]).filter(own)

    return held.mapInArrow(run, "node long, size long, slots binary, text string")


def _slots(s: np.ndarray) -> np.ndarray:
    """Features per slot, at most 255; the number of slots follows from the size."""
    n = max(SLOTS, (1 << max(len(s) - 1, 0).bit_length()) // 2)
    return np.minimum(np.bincount(((s >> np.uint64(32)) & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def _matrix(counts: list[bytes], n: int) -> np.ndarray:
    """Slot counts of several sets over n slots; those with more slots are folded."""
    out = np.zeros((len(counts), n), np.int16)
    for i, c in enumerate(counts):
        out[i] = np.frombuffer(c, np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int16)
    return out


def _may_link(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with slot counts x and y (last axis) can link."""
    apart = np.abs(x - y).sum(axis=-1, dtype=np.int64)
    return (apart <= (100 - percent) * (a + b) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can link by their slot counts."""
    counts = texts.select("node", "size", "slots")
    side = lambda c: counts.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("slots").alias(f"slots_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("slots_a", "slots_b"))
            a, b = (np.asarray(batch.column(c)) for c in ("size_a", "size_b"))
            width = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
            keep = np.zeros(len(width), bool)
            for n in np.unique(width):
                at = np.flatnonzero(width == n)
                keep[at] = _may_link(_matrix([x[i] for i in at], n), _matrix([y[i] for i in at], n), a[at], b[at], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "slots_a", "slots_b")
    return both.mapInArrow(run, "a long, b long")


def representatives(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, null last. Texts without shingles stay.

    Where doc_ids are null or repeated, rows are numbered and told apart by their number.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        docs_ = durable(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        linked = link(docs_.select(F.col("__row").alias("doc_id"), "text"), width=width, percent=percent)
        rows = durable(linked.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("root")).join(docs_.select("__row", F.col("doc_id").cast("long").alias("id")), "__row"), "rows")
        kept = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row"))["__row"].alias("__row"))
        gone, key = durable(rows.select("__row").join(kept, "__row", "left_anti"), "gone"), "__row"
    else:
        docs_, key = docs, "doc_id"
        linked = link(docs, width=width, percent=percent)
        gone = durable(linked.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs_.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti").select(*docs.columns)
