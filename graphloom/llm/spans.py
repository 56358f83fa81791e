"""Long verbatim spans shared between records.

Texts are cut into anchored blocks: among the rolling hashes of all 100-character windows, the smallest of each 101 neighbouring ones
is an anchor, so any shared span of 500 characters holds the same anchors in both texts. A block runs from an anchor over at least
200 characters to the next anchor and its window (300 to 400 characters). Equal blocks are the hits; they are extended to maximal spans.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

GRAM, NEAR = 100, 101
BASE = 6364136223846793005
CHUNK = 400_000


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, by doubling."""
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.ones(1, np.uint64)
        while len(p) < 2 * CHUNK:
            p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
        out.append(p)
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks_of(points: np.ndarray, gram: int = GRAM, near: int = NEAR, least: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the anchored blocks of a text given as code points. A text longer than a chunk is worked on in chunks that
    overlap by more than a block, so that no block is lost or depends on the cut; duplicates from the overlap are dropped."""
    if len(points) <= 2 * CHUNK - 1:
        return _chunk(points, 0, gram, near, least)
    parts, lap = [], 4 * (gram + near + least)
    for at in range(0, len(points), CHUNK):
        parts.append(_chunk(points[at : at + CHUNK + lap], at, gram, near, least))
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    _, first = np.unique(np.stack([s, e]), axis=1, return_index=True)
    return h[first], s[first], e[first]


def _chunk(points: np.ndarray, offset: int, gram: int, near: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(points)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < gram + near - 1:
        return none
    up, down = _powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << 20) - 1)
    ranked = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64) % (low + np.uint64(1)))  # of equal hashes the last
    best = _window_min(ranked, near)
    anchors = np.unique(best, return_index=True)[1]  # any window that chose it
    base = np.arange(len(best))[anchors]
    slot = (low - (best[anchors] & low)).astype(np.int64)
    pos = np.sort(base // (1 << 20) * (1 << 20) + slot + np.where(slot < base % (1 << 20), 1 << 20, 0))
    last = np.searchsorted(pos, pos + least)
    ok = last < len(pos)
    start, end = pos[ok], pos[last[ok]] + gram
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start + offset, end + offset


def anchored_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, doc, start, stop): the anchored blocks of all texts; null texts and texts under the guaranteed length have none."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out = b.slice(at, 500), []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h, s, e = blocks_of(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
                    out.append((h.view(np.int64), np.full(len(h), doc, np.int64), s.astype(np.int32), e.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "doc", "start", "stop"])

    return rows.mapInArrow(run, "h long, doc long, start int, stop int")


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, rep): the smallest key with exactly the same text. Only digests move."""
    d = docs.select(F.col(key).cast("long").alias("doc"), F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).alias("n")).where("n >= 500")
    reps = d.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return d.join(reps, "digest").select("doc", "rep")


def shared_spans(docs: DataFrame, key: str, text: str, at_least: int, copies: DataFrame) -> DataFrame:
    """(a, b, start_a, start_b, length), a < b: the maximal verbatim spans of at_least (500 or more) characters that two different texts
    have in common; of each class of equal texts only the representative takes part. Positions are code points from 0. A span that
    starts or ends inside a repeat of itself is reported once per alignment of the two texts."""
    blocks = anchored_blocks(docs, key, text)
    blocks = materialize(blocks.join(copies.where("doc <> rep").select("doc"), "doc", "left_anti"))
    a = blocks.select("h", F.col("doc").alias("a"), F.col("start").alias("sa"), F.col("stop").alias("ea"))
    b = blocks.select("h", F.col("doc").alias("b"), F.col("start").alias("sb"), F.col("stop").alias("eb"))
    hits = a.join(b, "h").where("a < b and ea - sa = eb - sb").select("a", "b", (F.col("sb") - F.col("sa")).alias("shift"), "sa", "ea").distinct()
    line = Window.partitionBy("a", "b", "shift").orderBy("sa", "ea")
    before = F.max("ea").over(line.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce((F.col("sa") > before).cast("int"), F.lit(1)))
    hits = hits.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy("a", "b", "shift", "run").agg(F.min("sa").alias("sa"), F.max("ea").alias("ea")).drop("run")
    near = 2 * (GRAM + NEAR)  # beyond this an extension would hold another block
    runs = materialize(runs.select("a", "b", "sa", (F.col("sa") + F.col("shift")).alias("sb"), (F.col("ea") - F.col("sa")).alias("n")))
    hit = runs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()  # other texts stay where they are
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= at_least).join(hit, "doc", "left_semi")

    def around(df: DataFrame, side: str) -> DataFrame:
        t, s = F.col("text"), F.col(f"s{side}")
        left = F.substring(t, F.greatest(s - near, F.lit(0)) + 1, F.least(s, F.lit(near)))
        cut = [left.alias(f"left_{side}"), F.unhex(F.sha2(F.substring(t, s + 1, F.col("n")), 256)).alias(f"mid_{side}"), F.substring(t, s + F.col("n") + 1, F.lit(near)).alias(f"right_{side}")]
        rest = [c for c in df.columns]
        return df.join(texts, F.col(side) == F.col("doc")).select(*rest, *cut)

    near_both = around(around(runs, "a"), "b").where("mid_a = mid_b")
    cols = ["a", "b", "sa", "sb", "n", "left_a", "right_a", "left_b", "right_b"]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            r = x.to_pydict()
            more = [len(os.path.commonprefix([p[::-1], q[::-1]])) for p, q in zip(r["left_a"], r["left_b"])]
            after = [len(os.path.commonprefix([p, q])) for p, q in zip(r["right_a"], r["right_b"])]
            sa, sb, n = (np.array(r[c], np.int64) for c in ("sa", "sb", "n"))
            m = np.array(more, np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(sa - m), pa.array(sb - m), pa.array(n + m + np.array(after, np.int64))], ["a", "b", "start_a", "start_b", "length"])

    spans = near_both.select(*cols).mapInArrow(extend, "a long, b long, start_a long, start_b long, length long")
    return spans.where(F.col("length") >= at_least).distinct()


def expand_copies(pairs: DataFrame, copies: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the pairs of representatives, of their copies, and of the copies among themselves."""
    same = copies.select(F.col("rep"), F.col("doc"))
    both = pairs.select("a", "b").distinct()
    out = [both.select(F.col("a").alias("x"), F.col("b").alias("y"))]
    more = same.where("doc <> rep")
    wide = both.join(same.select(F.col("rep").alias("a"), F.col("doc").alias("da")), "a", "left").join(same.select(F.col("rep").alias("b"), F.col("doc").alias("db")), "b", "left")
    out.append(wide.where("da is not null or db is not null").select(F.coalesce("da", "a").alias("x"), F.coalesce("db", "b").alias("y")))
    out.append(same.select("rep", F.col("doc").alias("x")).join(more.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y"))
    u = out[0].unionByName(out[1]).unionByName(out[2])
    return u.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_per_record(docs: DataFrame, key: str, text: str, spans: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, n_chars, rep, n_partners, shared_chars, shared_ratio), one row for each text: how many of its characters lie in a span
    that another text has too. Copies count as partners of each other and are shared whole; null texts have 0 characters."""
    sides = spans.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
    sides = sides.unionByName(spans.select(F.col("b").alias("rep"), F.col("a").alias("other"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e")))
    partners = sides.groupBy("rep").agg(F.count_distinct("other").alias("others"))
    line = Window.partitionBy("rep").orderBy("s", "e")
    before = F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    covered = sides.select("rep", "s", "e").distinct().withColumn("fresh", F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0))))
    covered = covered.groupBy("rep").agg(F.sum(F.greatest("fresh", F.lit(0))).alias("covered"))
    sizes = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    d = d.join(copies.select(F.col("doc").alias("doc_id"), "rep"), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    d = d.join(partners, "rep", "left").join(covered, "rep", "left").join(sizes, "rep", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(zero("covered")).cast("long")
    ratio = F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    return d.select("doc_id", "n_chars", "rep", (zero("others") + F.greatest(zero("copies") - 1, F.lit(0))).cast("long").alias("n_partners"), shared.alias("shared_chars"), ratio.alias("shared_ratio"))
