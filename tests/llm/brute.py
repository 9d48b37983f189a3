"""Plain versions of the corpus operators, for small inputs."""

import base64
import re
from collections import defaultdict

import public_tokenizers
import tiktoken


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, width):
    w = space_words(lower(t))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(docs, width, percent):
    """doc_id to (set size, smallest id reachable)."""
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def cleaned(docs, length):
    """doc_id to the bytes left and covered flags, in order of doc_id."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                hit[p : p + length] = b"\1" * length
            seen.add(s)
        out[d] = (raw, bytes(hit))
    return out


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def hits(text, items, window=10):
    """Number of hit words and the ids of items that occur."""
    words, hit, found = bench_words(text), set(), set()
    for item, t in items:
        w = bench_words(t)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), found


def repeats(text):
    """Words in five-word windows found twice or more, and lines equal to an earlier one."""
    w, places, seen, again = space_words(text), defaultdict(list), set(), 0
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    for line in (text or "").split("\n"):
        if space_words(line):
            again += line in seen
            seen.add(line)
    return len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}), again


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks
