"""Entities of source files: functions, classes, interfaces and imports, with the files that define them.

Python goes through its own syntax tree. The languages with braces go through one scan that blanks out comments and the insides of
strings, so that declarations are found by pattern in code alone and their ends by counting braces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.extract import _entities, language_of

#: Words in a class's text that make it a data model, and such as make it an interface.
MODEL_WORDS = ["model", "schema", "document", "entity", "base", "mongoose", "sequelize", "typeorm", "sqlalchemy"]
INTERFACE_WORDS = ["abstract", "abc", "protocol"]
LANGUAGES = ["python", "javascript", "typescript", "java", "go"]

_NOISE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)
_WORD = r"[A-Za-z_$][\w$]*"
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "do", "try", "synchronized", "throw", "await", "typeof", "constructor"}
_METHOD = rf"^[ \t]*(?:(?:public|private|protected|static|readonly|abstract|override|final|synchronized|async|get|set)[ \t]+|\*[ \t]*)*(?P<name>{_WORD})[ \t]*(?:<[^>(]*>)?\((?:[^()]|\([^()]*\))*\)[ \t]*(?::[^\n{{;=]+)?\{{"
_DECLARATIONS = {
    "javascript": [("function", rf"(?P<async>\basync[ \t]+)?\bfunction\b[ \t]*\*?[ \t]*(?P<name>{_WORD})"), ("function", rf"\b(?:const|let|var)[ \t]+(?P<name>{_WORD})[^=;\n]*=[ \t]*(?P<async>async\b[ \t]*)?(?:function\b|(?:\((?:[^()]|\([^()]*\))*\)|{_WORD})[ \t]*(?::[^=\n]+)?=>)"), ("class", rf"\b(?:abstract[ \t]+)?class[ \t]+(?P<name>{_WORD})")],
    "java": [("class", rf"\b(?:abstract[ \t]+)?(?:class|enum|record)[ \t]+(?P<name>{_WORD})"), ("interface", rf"\binterface[ \t]+(?P<name>{_WORD})"), ("function", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>]*>[ \t]*)?[\w.<>\[\], ?]+[ \t]+(?P<name>{_WORD})[ \t]*\([^()]*\)[ \t]*(?:throws[^{{;]+)?\{{")],
    "go": [("function", rf"^func[ \t]+(?:\([^)]*\)[ \t]*)?(?P<name>{_WORD})"), ("class", rf"^type[ \t]+(?P<name>{_WORD})[ \t]+struct\b"), ("interface", rf"^type[ \t]+(?P<name>{_WORD})[ \t]+interface\b")],
}
_DECLARATIONS["typescript"] = [*_DECLARATIONS["javascript"], ("interface", rf"\binterface[ \t]+(?P<name>{_WORD})"), ("function", _METHOD)]
_PATTERNS = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARATIONS.items()}
_IMPORTS = {
    "script": re.compile(r"""^[ \t]*import[ \t]+(?:[\w$*{},\s]+?\bfrom\b[ \t]*)?['"]([^'"\n]+)['"]|^[ \t]*export[ \t]+[\w$*{},\s]+?\bfrom\b[ \t]*['"]([^'"\n]+)['"]|\brequire\s*\(\s*['"]([^'"\n]+)['"]\s*\)""", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;", re.M),
    "go": re.compile(r"""^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"|^import[ \t]*\(([^)]*)\)""", re.M),
}


def blanked(text: str) -> str:
    """text with comments and what stands in strings as blanks, line breaks kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return _NOISE.sub(blank, text)


def _end(code: str, at: int) -> int:
    """The position after the body that opens next outside round brackets; the end of the line where none opens."""
    depth = round_ = 0
    stop = code.find("\n", at)
    for m in re.compile(r"[(){};]").finditer(code, at):
        c = m[0]
        if c in "()":
            round_ += 1 if c == "(" else -1
        elif round_ > 0:
            continue
        elif c == ";" and not depth:
            return m.end()
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(code) if depth or stop < 0 else stop


def entities(text: str, language: str) -> list[tuple]:
    """(kind, name, first_line, last_line, is_async, is_model, confidence) by place; kind is Function, DataModel or TypeDef. A class is a
    TypeDef if it is an interface or its text speaks of one, else a DataModel, a sure one (1.0, else .8) if its text speaks of models."""
    out = []
    if language == "python":
        lines = text.split("\n")
        for kind, name, a, b, is_async, _ in _entities(text):
            if kind == "error":
                return []
            out.append(_entity("function" if kind == "Function" else "class", name, a, b, bool(is_async), "\n".join(lines[a - 1 : b])))
        return sorted(out, key=lambda x: x[2:4])
    code, seen = blanked(text), set()
    for kind, pattern in _PATTERNS.get(language, []):
        for m in pattern.finditer(code):
            if m["name"] in _NO_NAME or m.start("name") in seen:
                continue
            seen.add(m.start("name"))
            end = _end(code, m.end("name"))
            first = code.count("\n", 0, m.start("name")) + 1
            out.append(_entity(kind, m["name"], first, first + code.count("\n", m.start("name"), end), "async" in m.re.groupindex and m["async"] is not None, text[m.start() : end]))
    return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def _entity(kind: str, name: str, a: int, b: int, is_async: bool, body: str) -> tuple:
    if kind == "function":
        return ("Function", name, a, b, is_async, False, 1.0)
    low = body.lower()
    model, interface = any(w in low for w in MODEL_WORDS), kind == "interface" or any(w in low for w in INTERFACE_WORDS)
    return ("TypeDef" if interface else "DataModel", name, a, b, False, model, 1.0 if model or interface else 0.8)


def imports(text: str, language: str) -> list[str]:
    """What a file imports, as written; of scripts the quoted paths of import, export and require, of Python nothing, as it quotes none."""
    if language in ("javascript", "typescript"):
        return [a or b or c for a, b, c in _IMPORTS["script"].findall(text)]
    if language == "java":
        return _IMPORTS["java"].findall(text)
    if language == "go":
        return [x for a, b in _IMPORTS["go"].findall(text) for x in ([a] if a else re.findall(r'"([^"\n]+)"', b))]
    return []


def file_nodes(files: DataFrame) -> DataFrame:
    """(id, type, name, file_path, first_line, last_line, source_hash, language, confidence): a File node for each file of a known language."""
    lang = language_of(F.col("file_path"))
    text = F.coalesce("text", F.lit(""))
    return files.where(lang.isin(LANGUAGES)).select(F.concat(F.lit("file:"), "project_id", F.lit(":"), "file_path").alias("id"), F.lit("File").alias("type"), F.substring_index("file_path", "/", -1).alias("name"), "file_path", F.lit(1).alias("first_line"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("last_line"), F.sha2(text, 256).alias("source_hash"), lang.alias("language"), F.lit(1.0).alias("confidence"))


def parsed(files: DataFrame) -> DataFrame:
    """(project_id, file_path, language, kind, name, first_line, last_line, is_async, is_model, confidence): entities, and imports with kind
    `import` and the path as name. Files go through narrow tasks as a whole."""
    lang = language_of(F.col("file_path"))
    rows = files.where(lang.isin(LANGUAGES)).select("project_id", "file_path", lang.alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    columns = ["project_id", "file_path", "language", "kind", "name", "first_line", "last_line", "is_async", "is_model", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, f, lang, t in zip(b["project_id"], b["file_path"], b["language"], b["text"]):
                out += [(p, f, lang, *e) for e in entities(t, lang)] + [(p, f, lang, "import", i, None, None, None, None, 1.0) for i in imports(t, lang)]
            x = pd.DataFrame(out, columns=columns)
            yield x.astype({"first_line": "Int32", "last_line": "Int32", "is_async": "boolean", "is_model": "boolean", "confidence": "float64"})

    return rows.mapInPandas(run, "project_id string, file_path string, language string, kind string, name string, first_line int, last_line int, is_async boolean, is_model boolean, confidence double")


#: How ids of entities begin.
HEADS = {"Function": "function", "DataModel": "datamodel", "TypeDef": "typedef"}


def entity_nodes(found: DataFrame) -> DataFrame:
    """(id, type, name, file_path, first_line, last_line, is_async, confidence) from parsed(): one node per id, the last in the file."""
    head = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])[F.col("kind")]
    e = found.where("kind <> 'import'").withColumn("id", F.concat_ws(":", head, "project_id", "file_path", "name"))
    last = e.groupBy("id").agg(F.max(F.struct("first_line", "last_line", "kind", "name", "file_path", "is_async", "confidence")).alias("v"))
    return last.select("id", F.col("v.kind").alias("type"), "v.name", "v.file_path", "v.first_line", "v.last_line", "v.is_async", "v.confidence")


def syntax_edges(found: DataFrame) -> DataFrame:
    """(source_id, target_id, type): DEFINES from the file to each entity, IMPORTS from the file to what it imports, as written."""
    head = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])[F.col("kind")]
    is_import = F.col("kind") == "import"
    target = F.when(is_import, F.concat_ws(":", F.lit("file"), "project_id", "name")).otherwise(F.concat_ws(":", head, "project_id", "file_path", "name"))
    return found.select(F.concat_ws(":", F.lit("file"), "project_id", "file_path").alias("source_id"), target.alias("target_id"), F.when(is_import, "IMPORTS").otherwise("DEFINES").alias("type")).distinct()
