"""Mixing sources to target shares of tokens.

Every source is a stream of its records, pass after pass, cut into blocks of equal numbers of tokens. Block j of a source with share w
is released at slot floor(j / w) and due at slot ceil((j + 1) / w) (Pfair windows); slots go to the earliest deadline among the released
blocks. So at any point each source is less than one block away from its share. As shares are multiples of 1/10 000, the schedule repeats
after at most 10 000 slots: one period is simulated, every record finds its slot by arithmetic.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize, plain

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this public vocabulary's tokenizer cuts text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RESOLUTION, BUCKETS, MAX_SOURCES = 10_000, 4096, 10_000
_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file: the copy sent to this worker, else the file itself."""
    if path not in _encodings:
        import base64

        import tiktoken

        sent = SparkFiles.get(os.path.basename(path))
        with open(sent if os.path.exists(sent) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_name(c: Column | str) -> Column:
    """A source in its plain form: lower case, without outer blanks, words joined by `_`."""
    return F.regexp_replace(plain(c), r"[\s-]+", "_")


def token_counts(docs: DataFrame, key: str, text: str, source: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens): whole texts counted; a null text has none. The vocabulary file travels to the executors."""
    if os.path.exists(tokenizer):
        docs.sparkSession.sparkContext.addFile(tokenizer)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long")


@dataclass
class Plan:
    source: str
    share: float  # of the total, of all sources that hold anything
    size: int  # tokens there are
    need: int  # tokens to draw
    weight: int  # blocks in each period
    slots: list[int]  # of these blocks
    max_repeats: int


def pfair_period(weights: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(weights) slots, earliest deadline first, ties to the first source."""
    period = sum(weights)
    done, out = [0] * len(weights), [[] for _ in weights]
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // w), s) for s, w in enumerate(weights) if done[s] < w and done[s] * period // w <= slot]
        _, s = min(ready)
        out[s].append(slot)
        done[s] += 1
    return out


def make_plan(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[list[Plan], int]:
    """(plans, period): the largest total at which no source is needed more than max_repeats times. Sources without tokens or share take
    no part and the others keep their proportions; a null or negative share is 0, a null max_repeats 1."""
    live = [(s, w, max(1, r or 1)) for s, w, r in sorted(targets) if sizes.get(s, 0) > 0 and (w or 0) > 0]
    if not live:
        return [], 1
    share_sum = sum(w for _, w, _ in live)
    total = min(r * sizes[s] * share_sum / w for s, w, r in live)
    exact = [w / share_sum * RESOLUTION for _, w, _ in live]
    weights = [max(1, math.floor(x)) for x in exact]
    for k in sorted(range(len(live)), key=lambda k: weights[k] - exact[k])[: max(0, RESOLUTION - sum(weights))]:
        weights[k] += 1
    g = math.gcd(*weights)
    weights = [w // g for w in weights]
    slots = pfair_period(weights)
    return [Plan(s, w / share_sum, sizes[s], min(round(w / share_sum * total), r * sizes[s]), weights[k], slots[k], r) for k, (s, w, r) in enumerate(live)], sum(weights)


def mix(counted: DataFrame, targets: DataFrame, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    draws (doc_id, source, repeat_no, n_tokens, slot, position): one row for each time a record is drawn; sorting by slot, source and
    position gives the mixed order. Every source runs through its records in an order scattered by their ids, whole passes first; of the
    last pass those records are drawn whose middle lies before the end of what is needed. A record longer than a block stays whole; such
    records come last in a pass, so that one of them in its midst does not push the others out of reach. Records of sources without a target are not drawn. shares has a row for each target source: tokens there are, drawn,
    target and actual share, largest repeat. Repeated rows of a record are records of their own; an empty table draws nothing.
    Per-source positions are prefix sums in two steps over BUCKETS hash ranges, so a source holding most rows is no single task's work."""
    goals = [(r[0], r[1], r[2]) for r in targets.select(source_name("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null").limit(MAX_SOURCES + 1).collect()]
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    order = F.xxhash64("doc_id")
    rows = materialize(counted.where(F.col("source").isin([g[0] for g in goals])).withColumn("bucket", F.shiftrightunsigned(order, 52).cast("int") + F.when(F.col("n_tokens") > block, BUCKETS).otherwise(0)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held"))
    sizes = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("held")).collect()}
    plans, period = make_plan(sizes, goals)
    base = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(base, F.lit(0)).alias("base"))  # at most 2 * BUCKETS rows for each source
    inside = Window.partitionBy("source", "bucket").orderBy(order, "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "bucket"])
    spark = counted.sparkSession
    table = spark.createDataFrame([(p.source, p.size, p.need, p.weight, p.slots) for p in plans], "source string, size long, need long, weight int, slots array<int>")
    at = F.col("base") + F.col("inner")
    placed = placed.join(F.broadcast(table), "source").withColumn("at", at)
    full = F.floor(F.col("need") / F.col("size"))
    rest = F.col("need") - full * F.col("size")
    times = full + (F.col("at") + F.col("n_tokens") / 2 <= rest).cast("long")
    drawn = placed.withColumn("times", times.cast("int")).where("times > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    where = (F.col("repeat_no") - 1) * F.col("size") + F.col("at")
    number = F.floor(where / block)
    slot = F.floor(number / F.col("weight")) * period + F.element_at("slots", (number % F.col("weight") + 1).cast("int"))
    draws = drawn.select("doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", slot.cast("long").alias("slot"), where.cast("long").alias("position"))
    got = draws.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat_no").alias("largest_repeat"))
    goal_rows = spark.createDataFrame([(s, w, r, sizes.get(s, 0)) for s, w, r in goals], "source string, target_share double, max_repeats int, source_tokens long")
    shares = goal_rows.join(got, "source", "left").select("source", "target_share", "max_repeats", "source_tokens", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("largest_repeat", F.lit(0)).alias("largest_repeat"))
    all_drawn = F.sum("drawn_tokens").over(Window.partitionBy())
    return draws, shares.withColumn("actual_share", F.when(all_drawn > 0, F.round(F.col("drawn_tokens") / all_drawn, 6)).otherwise(F.lit(0.0)))
