"""Which source files people of the project wrote, and which are generated, minified, vendored or data.

A random forest learns from the files that say what they are: a notice of a generator, a library's licence or a bundler makes a positive
example, its absence a negative one, each weighted by the share of its class among all files. Notices, like all comments, are hidden
from the features, so the forest also knows such files without their notice. Exact checks follow for what no feature tells: a notice
over text that looks written by hand, and a body equal, but for comments and blanks, to bodies that carry notices.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialize

#: Notices by which generators, libraries and bundlers mark a file; each must fill the start of a comment line.
NOTICES = {
    "generated": [
        r"code generated by [\w.-]+[.;] do not edit", r"@generated\b", r"<auto-?generated\b", r"auto-?generated file\b", r"auto-?generated from [\w./-]+", r"this file (?:was|is) auto(?:matically )?-?(?:created|generated)\b",
        r"generated (?:automatically )?by [\w.-]+[.,;:]? *(?:v?[\d.]+|do not|please)", r"regenerate with\b", r"do not (?:edit|modify)(?:[.!]|$)", r"machine[- ]?(?:written|generated|made) (?:output|file|code)\b",
    ],
    "vendored": [
        r"spdx-license-identifier:", r"copyright (?:\(c\) )?[\d, -]+ [\w.-]+ (?:contributors|authors|developers)", r"\(c\) the [\w.-]+ authors", r"[\w.-]+ v?\d[\w.]* +[-–|] +released under the", r"[\w.-]+ v?\d[\w.]* *\| *[\w.-]+ *\| *upstream copy",
        r"taken unchanged from the\b", r"upstream tag: ", r"@license\b", r"@preserve\b", r"permission is hereby granted", r"licensed under the (?:apache|mit|bsd)",
    ],
    "minified": [r"[\w.-]+ bundle$"],
}
_NOTICE = {k: re.compile("|".join(f"(?:{p})" for p in v), re.I) for k, v in NOTICES.items()}
_MARK = re.compile(r"^\s*(?:#+|//+|/\*+!?|\*+(?!/))\s*(.*?)\s*(?:\*+/)?\s*$")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|\Z)")
_LEXEMES = {
    "hash": re.compile(r'(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<note>#[^\n]*)', re.S),
    "slash": re.compile(r'(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))', re.S),
}
HASHES, SLASHES = (".py", ".sh", ".rb", ".yaml", ".yml"), (".js", ".jsx", ".ts", ".tsx", ".mjs", ".go", ".java")
_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|[^\w\s]')
_VERSION = re.compile(r"""["'`][^"'`\n]*\bv?\d+\.\d+\.\d+\b[^"'`\n]*["'`]""")
FEATURES = ["size", "lines", "longest_line", "mean_line", "blank_share", "compression", "entropy", "name_length", "short_names", "distinct_names", "comment_share", "digit_share", "literal_share", "number_share", "punctuation_share", "shape_share", "indent_share", "version_name"]


_HEAD = {True: re.compile(r"(?:\s*#[^\n]*(?:\n|\Z))*"), False: re.compile(r"(?:\s*(?://[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)))*", re.S)}


def comments(text: str, hashes: bool) -> list[tuple[int, int]]:
    """(start, end) of each comment."""
    return [m.span() for m in _LEXEMES["hash" if hashes else "slash"].finditer(text) if m.lastgroup == "note"]


def notice(text: str, notes: list[tuple[int, int]] | None = None) -> str | None:
    """The kind of the first notice a file carries in its comment lines, if any, wherever in the file they stand: generators write
    footers too. Lines at its start and end that are comments in some language count whatever notes, its comments, are; without notes
    all lines do, even those within longer strings."""
    if notes is None:
        lines = text.split("\n")
    else:
        whole = [text[a:b] for a, b in notes if not text[text.rfind("\n", 0, a) + 1 : a].strip()]
        every = text.split("\n")
        lines = [x for c in [*whole, *takewhile(_COMMENT.match, every), *takewhile(_COMMENT.match, reversed(every))] for x in c.split("\n")]
    for line in lines:
        m = _MARK.match(line)
        if m and m[1]:
            for kind, p in _NOTICE.items():
                if p.match(m[1]):
                    return kind
    return None


def between(text: str, hashes: bool, notes: list[tuple[int, int]]) -> tuple[str, str]:
    """text without the comments it begins and ends with, and that without its other comments."""
    first, last, inner = _HEAD[hashes].match(text).end(), len(text), list(notes)
    while inner and inner[-1][0] >= first and not text[inner[-1][1] : last].strip():
        last = inner.pop()[0]
    parts, at = [], first
    for start, end in inner:
        if start >= first:
            parts.append(text[at:start])
            at = end
    return text[first:last], "".join([*parts, text[at:last]])


def body_digest(body: str) -> bytes:
    return hashlib.md5("".join(body.split()).encode("utf-8", "surrogatepass")).digest()


def describe(text: str, hashes: bool, notes: list[tuple[int, int]]) -> tuple[list[float], bytes, int]:
    """(features, digest of the body, size of the body) of a whole file; an empty body has all its shares at 0."""
    text, body = between(text, hashes, notes)  # the comments a file begins and ends with may be notices
    solid = len(body) - body.count(" ") - body.count("\n") - body.count("\t") - body.count("\r")
    lines = [x for x in body.split("\n") if x.strip()]
    tokens = _TOKEN.findall(body)
    n = max(1, len(tokens))
    counts = Counter(tokens)
    names = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] in "_$"]
    named = max(1, sum(c for _, c in names))
    literal = number = mark = 0
    for t, c in counts.items():
        if t[0] in "\"'`":
            literal += c
        elif t[0].isdigit():
            number += c
        elif not (t[0].isalpha() or t[0] in "_$"):
            mark += c
    raw = body.encode("utf-8", "surrogatepass")
    shapes = {re.sub(r"\w+", "w", x.strip()) for x in lines}
    f = [
        math.log1p(len(body)), math.log1p(len(lines)), math.log1p(max(map(len, lines), default=0)), math.log1p(solid / max(1, len(lines))), 1 - solid / max(1, len(body)), len(zlib.compress(raw, 1)) / max(1, len(raw)),
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(len(t) * c for t, c in names) / named, sum(c for t, c in names if len(t) <= 2) / named, len(names) / named, 1 - len(body) / max(1, len(text)),
        sum(map(body.count, "0123456789")) / max(1, len(body)), literal / n, number / n, mark / n, len(shapes) / max(1, len(lines)), sum(x[0] in " \t" for x in lines) / max(1, len(lines)), float(bool(_VERSION.search(body))),
    ]
    return f, body_digest(body), solid


def describe_files(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, kind, f, digest, solid): notice, features, digest and size of the body of each file. A null text is an empty file."""
    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [p.lower().endswith(HASHES) for p in b["path"]]
            notes = [comments(t, h) for t, h in zip(b["text"], hashes)]
            got = [describe(t, h, n) for t, h, n in zip(b["text"], hashes, notes)]
            yield pd.DataFrame({"key": b["key"], "kind": [notice(t, n if p.lower().endswith(HASHES + SLASHES) else None) for p, t, n in zip(b["path"], b["text"], notes)], "f": [g[0] for g in got], "digest": [g[1] for g in got], "solid": [g[2] for g in got]})

    return rows.mapInPandas(run, rows.select("key").schema.add("kind", "string").add("f", T.ArrayType(T.DoubleType())).add("digest", "binary").add("solid", "integer"))


#: The forest learns from at most so many files of each label, the first by a hash of their keys; each label weighs what it weighs among
#: all files, so the bounds move no threshold.
MAX_MARKED, MAX_UNMARKED = 3000, 6000
#: Unmarked examples that forests of other examples give this probability are no examples of handwriting; passes that look for them.
DOUBT, PASSES = 0.2, 2
#: A body is a copy of marked ones if this share of the files that hold it carry notices.
KIN_SHARE = 0.25
#: Data carries no notice; so a share of literals among the tokens, in a body of some size, labels examples of it. Labels only.
DATA_SHARE, DATA_SIZE = 0.28, 300
_LITERAL, _NUMBER = FEATURES.index("literal_share"), FEATURES.index("number_share")


def with_kin(described: DataFrame) -> DataFrame:
    """described with n, the number of files with the same body, and `kin`, whether KIN_SHARE of them carry a notice. Digests alone move:
    they are counted before the shuffle, and bodies held once, nearly all, need no join partner beyond their own row."""
    bodies = described.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("marked")).where("n > 1")
    both = described.join(bodies, "digest", "left")
    return both.select("key", "kind", "f", "solid", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce((F.col("solid") > 0) & (F.col("marked") >= F.col("n") * KIN_SHARE), F.lit(False)).alias("kin"))


def is_data(f: Column, solid: Column) -> Column:
    """Next to nothing but literals."""
    return (F.element_at(f, _LITERAL + 1) + F.element_at(f, _NUMBER + 1) >= DATA_SHARE) & (solid >= DATA_SIZE)


def train(table: DataFrame, trees: int = 40, depth: int = 10, seed: int = 7):
    """A fitted forest, or None where there are no examples of one label.

    Unmarked files are mostly written by hand, but not all. So the sample is halved by a hash, a forest of each half judges the other, and
    the unmarked files it doubts are left out; PASSES times, as each pass finds what the examples it still had hid. Repeated bodies are
    examples like others. Weights are the labels' counts over all files."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    marked = F.col("kind").isNotNull() | F.col("kin") | is_data(F.col("f"), F.col("solid"))
    order = F.xxhash64(F.col("key"))
    examples = table.select("key", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(2)).alias("half"), marked.alias("marked"), array_to_vector("f").alias("v"))
    total = {r.marked: r.n for r in examples.groupBy("marked").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    weight = {m: total[m] / min(total[m], most) for m, most in ((True, MAX_MARKED), (False, MAX_UNMARKED))}
    yes = examples.where("marked").orderBy(order, "key").limit(MAX_MARKED).withColumn("w", F.lit(weight[True] / min(weight.values())))
    no = examples.where("not marked").orderBy(order, "key").limit(MAX_UNMARKED).withColumn("w", F.lit(weight[False] / min(weight.values())))
    sample = materialize(yes.unionByName(no).select("key", "half", "v", F.col("marked").cast("double").alias("label"), "w").coalesce(1).sortWithinPartitions("key"))
    forest = RandomForestClassifier(featuresCol="v", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2, featureSubsetStrategy="onethird")
    sure = sample
    for _ in range(PASSES):
        judged = None
        for half in (0, 1):
            others = sure.where(F.col("half") != half)
            if others.select("label").distinct().count() < 2:
                continue  # too few files to halve
            judge = forest.fit(others).copy()  # a copy has no training summary, which would take the session along to the executors
            part = judge.transform(sample.where(F.col("half") == half)).where((F.col("label") == 1) | (vector_to_array("probability")[1] < DOUBT)).select(*sample.columns)
            judged = part if judged is None else judged.unionByName(part)
        if judged is None or judged.select("half").distinct().count() < 2:
            break
        sure = materialize(judged.coalesce(1).sortWithinPartitions("key"))
    if sure.select("label").distinct().count() < 2:
        return None
    return forest.fit(sure).copy()


def verdicts(files: DataFrame, key: str, path: str, text: str, threshold: float = 0.5) -> DataFrame:
    """(key, verdict, probability, notice): one row per file; verdict is handwritten, generated, minified, vendored or data.

    Notices and comments are read over the whole text, however long. A file is not handwritten if the forest's probability reaches the
    threshold, or, by the exact checks after it, if it carries a notice or is a copy of files that do (see KIN_SHARE). The kind is the
    notice's, or follows what is plain: data, copies, long lines, else generated. Null and empty texts and comments alone are handwritten
    unless a notice says otherwise; a null path counts as code with slash comments; equal files get equal verdicts."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    table = materialize(with_kin(materialize(describe_files(files, key, path, text))))
    model = train(table)
    scored = model.transform(table.withColumn("v", array_to_vector("f"))).withColumn("p", vector_to_array("probability")[1]) if model else table.withColumn("p", F.lit(0.0))
    scored = scored.withColumn("p", F.when(F.col("solid") > 0, F.col("p")).otherwise(F.lit(0.0)))
    data, long_lines = is_data(F.col("f"), F.col("solid")), F.element_at("f", FEATURES.index("mean_line") + 1) > math.log1p(200)
    hit = (F.col("p") >= threshold) | F.col("kind").isNotNull() | F.col("kin")
    kind = F.when(~hit, "handwritten").when(F.col("kind").isNotNull(), F.col("kind")).when(data, "data").when(F.col("n") > 1, "vendored").when(long_lines, "minified").otherwise("generated")
    return scored.select(F.col("key").alias(key), kind.alias("verdict"), F.round("p", 4).alias("probability"), F.col("kind").alias("notice"))
