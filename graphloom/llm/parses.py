"""Source files that are not valid in the language of their extension."""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import lexers
from graphloom.llm.glr import END, Recogniser, build

#: extension: language, grammar files (later rules replace earlier ones), lexer
LANGUAGES = {
    "py": ("python", ("python",), lexers.Python),
    "js": ("javascript", ("javascript",), lexers.Script),
    "ts": ("typescript", ("javascript", "typescript"), lexers.Script),
    "go": ("go", ("go",), lexers.Go),
    "java": ("java", ("java",), lexers.Java),
}
EMPTY_IS_VALID = {"py", "js", "ts", "java"}
_made: dict[str, Parser] = {}


class Parser:
    """first_error(text): None, or (line from 1, token class) of the first token that fits no parse of the text before it."""

    def __init__(self, ext: str):
        _, files, lexer = LANGUAGES[ext]
        table = build("\n".join(pkgutil.get_data(__package__, f"grammars/{f}.gr").decode() for f in files))
        self.ext, self.lexer, self.rec = ext, lexer(table.terminals), Recogniser(table, lexer.asi)

    def first_error(self, text: str) -> tuple[int, str] | None:
        if self.rec.full():
            self.rec.reset()
        if text.startswith("\ufeff") and self.ext != "java":
            text = text[1:]
        lines = re.split(r"\r\n|\n|\r", text) if "\r" in text else text.split("\n")
        if self.ext == "js" and lines[0].startswith("#!"):
            lines[0] = ""
        return self._python(lines) if self.ext == "py" else self._braces(lines)

    def _braces(self, lines: list[str]) -> tuple[int, str] | None:
        lex, rec, cache, done = self.lexer.lex, self.rec, self.lexer.cache, self.rec.lines
        mode, front, any_token = self.lexer.start, self.rec.start, False
        asi = self.lexer.asi
        for k, line in enumerate(lines):
            toks, mode = cache.get((line, mode)) or lex(line, mode)
            if not toks:
                continue
            any_token = True
            if asi and toks[0] in ("'++'", "'--'"):
                front = rec.step(front, "ASI") or front
            new, at = done.get((front, toks)) or rec.line(front, toks)
            if not new:
                return k + 1, toks[at]
            front = new
            if asi and toks[-1] in ("'return'", "'break'", "'continue'"):
                front = tuple(sorted({*front, *rec.step(front, "ASI")}))
        if self.lexer.unfinished(mode) or (len(mode) > 1 and mode[1]):
            return len(lines), "unfinished"
        if not any_token:
            return None if self.ext in EMPTY_IS_VALID else (1, END)
        return None if rec.line(front, (END,))[0] else (len(lines), END)

    def _python(self, lines: list[str]) -> tuple[int, str] | None:
        lexer, rec = self.lexer, self.rec
        mode, front, any_token = lexer.start, rec.start, False
        levels = [(0, 0)]
        for k, line in enumerate(lines):
            fresh = mode == lexer.start
            toks, mode = lexer.lex(line, mode)
            if "\0" in line:
                return k + 1, "BAD"
            going = mode[0] != "n" or mode[1] > 0 or mode[2]
            if not toks and fresh and not going:
                continue
            if fresh:
                at = lexer.indent(line)
                if at != levels[-1]:
                    if at[0] > levels[-1][0] and at[1] > levels[-1][1]:
                        levels.append(at)
                        toks = ("INDENT", *toks)
                    else:
                        n = 0
                        while levels[-1][0] > at[0]:
                            levels.pop()
                            n += 1
                        if levels[-1] != at:
                            return k + 1, "INDENT"
                        toks = (*("DEDENT",) * n, *toks)
            if not going and (toks or not fresh):
                toks = (*toks, "NEWLINE")
            if not toks:
                continue
            any_token = True
            new, at = rec.line(front, toks)
            if not new:
                return k + 1, toks[at]
            front = new
        if not any_token:
            return None
        if mode != lexer.start:
            return len(lines), "unfinished"
        new, _ = rec.line(front, (*("DEDENT",) * (len(levels) - 1), END))
        return None if new else (len(lines), END)


def parser(ext: str) -> Parser:
    if ext not in _made:
        _made[ext] = Parser(ext)
    return _made[ext]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def parse_files(files: DataFrame, key: str, path: str, text: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, keep..., parsed_as, error_line, error_token): every file whose extension is one of LANGUAGES, parsed whole by the grammar of
    that language. error_line is null for a valid file. A null text is an empty file; other extensions and null paths are left out.
    Files go through narrow tasks, so no shuffle is made; a worker builds each grammar's table once."""
    rows = files.select(F.col(key), *keep, extension(F.col(path)).alias("_ext"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.col("_ext").isin(*LANGUAGES))
    schema = rows.select(key, *keep).schema.add("parsed_as", "string").add("error_line", "integer").add("error_token", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parser(e).first_error(t) or (None, None) for e, t in zip(b["_ext"], b["_text"])]
            out = b[[key, *keep]].copy()
            out["parsed_as"] = [LANGUAGES[e][0] for e in b["_ext"]]
            out["error_line"] = pd.array([x for x, _ in found], dtype="Int32")
            out["error_token"] = pd.array([y for _, y in found], dtype="string")
            yield out

    return rows.mapInPandas(run, schema)


def invalid_rates(parsed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., parsed_as, n_files, n_invalid, invalid_rate): null keys form their own group."""
    bad = F.count("error_line")
    return parsed.groupBy(*by, "parsed_as").agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("invalid_rate"))
