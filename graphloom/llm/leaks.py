"""Passages of held-out items inside documents.

Windows of words get 64-bit SimHashes of their words, at two sizes. Windows as long as an item find it whole, be it edited here and
there: an index of four 16-bit blocks, each with all values one bit away, meets every window within Hamming distance 7 of an item's,
and the exact weighted similarity of five-word shingles then verifies the two. Windows as long as the smallest part that counts as a
leak find parts of an item: such a part has to be equal, so its fingerprint is, and the words are compared.

Items are an evaluation set that is fixed while the corpus grows; they travel to the documents, in as many parts as their size asks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")  # what words() finds, for the reader and the tests
RADIUS, BLOCKS, SHINGLE, SIMILAR = 7, 4, 5, 0.8
#: Items of which the index goes to the documents at once; lengths up to so many times the shortest share a window size.
PART_WORDS, SPREAD = 2_000_000, 1.25
PIECE = 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, _kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - kept for the next call
    """Powers of _BASE and of its inverse modulo 2^64, by doubling."""
    if not _kept or len(_kept[0]) < n:
        _kept.clear()
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
            _kept.append(p)
    return _kept[0], _kept[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_CHAR = mix(np.arange(1, 257, dtype=np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, one after the other; where each text's begin, and the end). Words are the longest runs of
    a-z and 0-9 of the lower-cased text. The bytes are worked on in pieces that end between words."""
    low = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and _IN_WORD[data[end - 1]]:
            end += 1
        piece = data[at:end]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = _IN_WORD[piece]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CHAR[piece] * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    begin = np.searchsorted(np.concatenate(starts), np.cumsum([0, *(len(x) + 1 for x in low)]))
    return np.concatenate(hashes), begin


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers held as bit planes, the lowest first: 64 counters in each element."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x, y = (a[i] if i < len(a) else None), (b[i] if i < len(b) else None)
        if x is None or y is None:
            x = y if x is None else x
            s, c = (x, None) if carry is None else (x ^ carry, x & carry)
        else:
            half = x ^ y
            s, c = (half, x & y) if carry is None else (half ^ carry, (x & y) | (half & carry))
        out.append(s)
        carry = c
    return out if carry is None else [*out, carry]


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of `size` words: bit by bit the majority of the words' hash bits, ties counting as 0. The windows' counters
    are added up in halves, 64 bits at once."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    double, width, planes, covered = [hashes], 1, None, 0
    while True:
        if size & width:
            part = [p[covered : covered + n] for p in double]
            planes = part if planes is None else _add(planes, part)
            covered += width
        if width * 2 > size:
            break
        double = _add([p[:-width] for p in double], [p[width:] for p in double])
        width *= 2
    least, reached = size // 2 + 1, None  # counts of at least this many
    for i, p in enumerate(planes):
        if least >> i & 1:
            reached = p if reached is None else p & reached
        else:
            reached = np.full(n, ~np.uint64(0)) if reached is None else p | reached
    return reached if not least >> len(planes) else np.zeros(n, np.uint64)


def _blocks(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)


@dataclass
class Near:
    """Fingerprints of items of about one length: of their first and their last `size` words."""

    size: int
    prints: np.ndarray
    item: np.ndarray  # number of the item
    shift: np.ndarray  # of the window in the item
    lists: list[tuple[np.ndarray, np.ndarray]]  # by block: offsets of each value, numbers of the prints within one bit of it


@dataclass
class Index:
    part: int
    ids: np.ndarray
    words: list[np.ndarray]
    near: list[Near]
    prints: np.ndarray  # of all windows of `part` words, ascending
    item: np.ndarray
    start: np.ndarray
    known: np.ndarray  # by the lowest 16 bits: whether any print has them


def near_index(size: int, prints: np.ndarray, item: np.ndarray, shift: np.ndarray) -> Near:
    lists = []
    close = np.concatenate([[0], 1 << np.arange(16)]).astype(np.int64)
    for b in range(BLOCKS):
        values = (_blocks(prints, b).astype(np.int64)[:, None] ^ close).ravel()
        order = np.argsort(values, kind="stable")
        lists.append((np.searchsorted(values[order], np.arange(65537)), order // len(close)))
    return Near(size, prints, item, shift, lists)


def build_index(items: list[tuple[int, str]], part: int) -> Index:
    own = [words([text or ""])[0] for _, text in items]
    cat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
    prints = [simhashes(w, part) for w in own]
    flat, item, start = cat(prints, np.uint64), np.repeat(np.arange(len(own)), [len(p) for p in prints]), cat([np.arange(len(p)) for p in prints], np.int64)
    order = np.argsort(flat, kind="stable")
    known = np.zeros(65536, bool)
    known[_blocks(flat, 0)] = True
    near, long = [], sorted((len(w), k) for k, w in enumerate(own) if len(w) >= part)
    while long:
        size = long[0][0]
        here = [k for n, k in long if n <= size * SPREAD]
        ends = [(k, s) for k in here for s in sorted({0, len(own[k]) - size})]
        near.append(near_index(size, cat([simhashes(own[k][s : s + size], size) for k, s in ends], np.uint64), np.array([k for k, _ in ends]), np.array([s for _, s in ends])))
        long = long[len(here) :]
    return Index(part, np.array([i for i, _ in items], np.int64), own, near, flat[order], item[order], start[order], known)


def near_windows(near: Near, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text window, number of the item print) of all pairs within the radius: seven bits over four blocks leave one block
    with at most one."""
    left, right = [], []
    for b, (offsets, order) in enumerate(near.lists):
        v = _blocks(prints, b)
        count = np.diff(offsets)[v]
        hit = np.flatnonzero(count)
        n = count[hit]
        lo = np.repeat(hit, n)
        within = np.arange(len(lo)) - np.repeat(np.cumsum(n) - n, n)
        hi = order[np.repeat(offsets[v[hit]], n) + within]
        close = np.bitwise_count(prints[lo] ^ near.prints[hi]) <= RADIUS
        left.append(lo[close])
        right.append(hi[close])
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
    return pairs[0], pairs[1]


def equal_windows(ix: Index, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text window, number of the item's) of all pairs with the same fingerprint."""
    maybe = np.flatnonzero(ix.known[_blocks(prints, 0)])
    lo, hi = (np.searchsorted(ix.prints, prints[maybe], s) for s in ("left", "right"))
    n = hi - lo
    return np.repeat(maybe, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _weights(hashes: np.ndarray) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    w = hashes.tolist()
    for i in range(len(w) - SHINGLE + 1):
        k = tuple(w[i : i + SHINGLE])
        out[k] = out.get(k, 0) + 1
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared five-word shingles by count, over all of both (weighted Jaccard)."""
    x, y = _weights(a), _weights(b)
    both = sum(min(n, y.get(k, 0)) for k, n in x.items())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


def _parts(items: DataFrame, item_key: str, passage: str) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    for i, t in items.select(F.col(item_key).cast("long"), F.col(passage)).where(F.col(item_key).isNotNull() & F.col(passage).isNotNull()).toLocalIterator():
        part.append((i, t))
        size += len(t) // 6
        if size > PART_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, size: int = 12) -> DataFrame:
    """(doc, item, n_windows, longest, similarity): each document with each item of which it has at least `size` consecutive words, or which
    is SIMILAR to a stretch of it as long as the item.

    n_windows counts the item's windows of `size` words found, longest is the longest common run of words, similarity the weighted shingle
    similarity of the passage and the stretch. Texts are read whole; null texts and passages and those under `size` words match nothing;
    equal passages of different items all match."""
    out = None
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= 2 * size - 1)
    for part in _parts(items, item_key, passage):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(sorted(part, key=lambda x: x[0]), size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    piece = b.slice(at, 500)
                    found = _search(shared.value, piece.column(0).to_pylist(), piece.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc", "item", "n_windows", "longest", "similarity"])

        hits = rows.mapInArrow(run, "doc long, item long, n_windows int, longest int, similarity double")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc long, item long, n_windows int, longest int, similarity double")


def _search(ix: Index, ids: list[int], texts: list[str]) -> list[tuple]:
    """The rows of some documents. Their words stand in one array, so that the windows of all are fingerprinted at once; a window that
    reaches from one text into the next is dropped. Long arrays are cut into overlapping parts."""
    h, begin = words(texts)
    doc_of = np.repeat(np.arange(len(ids)), np.diff(begin))
    same: dict[tuple, list[tuple[int, int]]] = {}
    stretch: dict[tuple, set[int]] = {}
    for at in range(0, len(h), 200_000):

        def inside(w: np.ndarray, size: int) -> np.ndarray:
            return doc_of[w] == doc_of[np.minimum(w + size - 1, len(h) - 1)]

        w, k = equal_windows(ix, simhashes(h[at : at + 200_000 + ix.part - 1], ix.part))
        w = w + at
        ok = inside(w, ix.part)
        for x, d, i, s in zip(w[ok].tolist(), doc_of[w[ok]].tolist(), ix.item[k[ok]].tolist(), ix.start[k[ok]].tolist()):
            if np.array_equal(h[x : x + ix.part], ix.words[i][s : s + ix.part]):
                same.setdefault((d, i), []).append((x, s))
        for near in ix.near:
            w, k = near_windows(near, simhashes(h[at : at + 200_000 + near.size - 1], near.size))
            w = w + at
            ok = inside(w, near.size)
            for x, d, i, s in zip(w[ok].tolist(), doc_of[w[ok]].tolist(), near.item[k[ok]].tolist(), near.shift[k[ok]].tolist()):
                stretch.setdefault((d, i), set()).add(x - s)
    out = []
    for d, i in sorted(same.keys() | stretch.keys()):
        hits, own, first, last = same.get((d, i), []), ix.words[i], int(begin[d]), int(begin[d + 1])
        run, shift = _longest_run(hits)
        lines = stretch.get((d, i), set()) | ({shift} if hits else set())
        best = max(weighted_similarity(own, h[max(first, s) : min(last, s + len(own))]) for s in lines)
        if hits or best >= SIMILAR:
            longest = run - 1 + ix.part if hits else max(_common_run(own, h, s, first, last) for s in lines)
            out.append((ids[d], int(ix.ids[i]), len({s for _, s in hits}), longest, round(best, 6)))
    return out


def _longest_run(hits: list[tuple[int, int]]) -> tuple[int, int]:
    """(number of windows, shift) of the longest run of hits that go on in step in text and item."""
    best = (0, 0)
    at: dict[int, tuple[int, int]] = {}
    for x, s in sorted(hits):
        lo, hi = at.get(x - s, (x, x - 1))
        at[x - s] = lo, hi = (lo, x) if x == hi + 1 else (x, x)
        if hi - lo + 1 > best[0]:
            best = (hi - lo + 1, x - s)
    return best


def _common_run(own: np.ndarray, h: np.ndarray, shift: int, first: int, last: int) -> int:
    """Words of the longest run that text and item have in common where the item is laid at `shift`."""
    a, b = max(first, shift), min(last, shift + len(own))
    differ = np.flatnonzero(np.concatenate([[True], h[a:b] != own[a - shift : b - shift], [True]]))
    return int(np.diff(differ).max() - 1)
