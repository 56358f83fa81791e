"""Cutting items that are too long at natural boundaries.

Each gap between lines gets the similarity of the words in the lines before and after it (sliding blocks); valleys of that curve are
changes of topic. A gap after which nothing is left open weighs more. Within the window that the size limit leaves, the deepest valley
is the cut; where a line alone exceeds the window, the cut falls inside it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPAN, DIMS = 10, 128
PER_ROW = 256
#: Lines whose words are held as vectors at once.
STRETCH = 16_384


def clean_path(path: Column) -> Column:
    """Slashes for backslashes, one for several, without a leading `./` or `/`."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"), r"^(\./|/)", "")


def oversized(items: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, path, first, last, size) of the items (id, path, a, b) whose lines a to b (either order, from 1) hold more than `limit`
    characters of the file (path, text). Items with a null id, path or line, of unknown files, or beyond their file's end are no case.
    Only line lengths of files longer than the limit meet the items, never the text."""
    f = files.where(F.length("text") > limit).select("path", F.transform(F.split("text", "\n", -1), F.length).alias("lens"))
    n = items.where("id is not null and path is not null and a is not null and b is not null")
    n = n.select("id", "path", F.greatest(F.least("a", "b"), F.lit(1)).alias("first"), F.greatest("a", "b").alias("until"))
    j = n.join(f, "path").withColumn("last", F.least("until", F.size("lens"))).where("first <= last")
    part = F.slice("lens", F.col("first"), F.col("last") - F.col("first") + 1)
    size = F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x) + F.col("last") - F.col("first")
    return j.select("id", "path", "first", "last", size.alias("size")).where(F.col("size") > limit)


def _similarity(lines: list[str], first: int, last: int) -> np.ndarray:
    """Cosine of the words of the SPAN lines up to each of the lines first to last and of the SPAN after it. Only these and the lines
    around them are held as vectors, so a file of any length takes the memory of one stretch."""
    lo, hi = max(0, first - SPAN), min(len(lines), last + SPAN)
    counts = np.zeros((hi - lo + 1, DIMS), np.int32)
    rows, cols = [], []
    for k in range(lo, hi):
        words = WORD.findall(lines[k])
        rows += [k - lo + 1] * len(words)
        cols += [zlib.crc32(w.lower().encode()) % DIMS for w in words]
    np.add.at(counts, (rows, cols), 1)
    np.cumsum(counts, axis=0, out=counts)
    at = np.arange(first + 1, last + 1) - lo
    left = (counts[at] - counts[np.maximum(at - SPAN, 0)]).astype(np.float64)
    right = (counts[np.minimum(at + SPAN, hi - lo)] - counts[at]).astype(np.float64)
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    return np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0.0)


def gap_scores(lines: list[str]) -> np.ndarray:
    """A score for the gap after each line: depth of its valley of lexical similarity, plus what speaks for an end of something there."""
    n = len(lines)
    sim = np.concatenate([_similarity(lines, at, min(at + STRETCH, n)) for at in range(0, n, STRETCH)])
    pad = np.pad(sim, SPAN, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(pad, SPAN + 1)
    depth = np.maximum(view[:n].max(axis=1) - sim, 0) + np.maximum(view[SPAN : SPAN + n].max(axis=1) - sim, 0)
    indent = np.array([len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines])
    after = indent.copy()
    for k in range(n - 2, -1, -1):
        after[k] = indent[k] if indent[k] >= 0 else after[k + 1]
    following = np.append(after[1:], 0)
    closes = np.array([x.strip()[:1] in ("}", ")", "]") or not x.strip() for x in lines])
    opens = np.array([x.rstrip()[-1:] in ("{", "(", "[", ":", ",") for x in lines])
    return depth + 2.0 / (1 + np.maximum(following, 0)) + 0.5 * closes - 2.0 * opens


def cut_points(lengths: list[int], scores: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = 0.5) -> list[int]:
    """Ends of the pieces, in characters of the text whose lines (joined by one character) have these lengths. The first piece holds up to
    `limit` characters, each further one `overlap` fewer, as it repeats so many. Cuts fall after a line's end (with its line break) where
    one lies in the second half of the window."""
    ends = np.cumsum(np.asarray(lengths, np.int64) + 1)
    total = int(ends[-1]) - 1
    ends[-1] = total
    out, start = [], 0
    while True:
        room = limit if not out else limit - overlap
        if total - start <= room:
            out.append(total)
            return out
        lo, hi = np.searchsorted(ends, start + int(room * fill), "right"), np.searchsorted(ends, start + room, "right")
        if lo < hi:
            best = lo + int(np.argmax(scores[lo:hi]))
            start = int(ends[best])
        else:
            earlier = np.searchsorted(ends, start, "right")
            start = int(ends[hi - 1]) if hi > earlier else start + room
        out.append(start)


def split_items(items: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece_no, first_line, last_line, n_chars[, text]): the pieces of all oversized items, numbered from 1.

    Every piece has at most `limit` characters; from the second on it begins with the last `overlap` characters of the one before. Lines
    are numbered in the file. A piece is the item's text between two cuts, so the pieces without their overlaps join to the item exactly.
    items: id, path, a, b; files: path, text. Items meet their file's text in rows of about PER_ROW items, each file being scored once a row."""
    over = oversized(items, files, limit)
    counts = over.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / PER_ROW).cast("int").alias("parts"))
    packed = over.join(counts, "path").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = packed.groupBy("path", "part").agg(F.collect_list(F.struct("id", "first", "last")).alias("own"))
    rows = packed.join(files.where(F.length("text") > limit).select("path", "text"), "path").select("own", "text")
    schema = "id string, piece_no int, first_line int, last_line int, n_chars int" + (", text string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own, text in zip(b["own"], b["text"]):
                lines = text.split("\n")
                scores = gap_scores(lines)
                for item in own:
                    out += _pieces(item["id"], lines[item["first"] - 1 : item["last"]], scores[item["first"] - 1 : item["last"]], item["first"], limit, overlap, with_text)
            yield pd.DataFrame(out, columns=["id", "piece_no", "first_line", "last_line", "n_chars", *["text"] * with_text])

    return rows.mapInPandas(run, schema)


def _pieces(id: str, lines: list[str], scores: np.ndarray, first: int, limit: int, overlap: int, with_text: bool) -> list[tuple]:
    body, out, begin = "\n".join(lines), [], 0
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    line_at = lambda c: int(np.searchsorted(starts, c, "right")) - 1 + first
    for k, end in enumerate(cut_points([len(x) for x in lines], scores, limit, overlap)):
        lo = max(0, begin - overlap) if k else 0
        out.append((id, k + 1, line_at(lo), line_at(max(lo, end - 1)), end - lo, *[body[lo:end]] * with_text))
        begin = end
    return out
