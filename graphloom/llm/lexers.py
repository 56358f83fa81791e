"""Line-wise lexers. lex(line, mode) gives the token classes of one line and the mode in which the next line starts, so equal lines in
equal modes are lexed once. A character sequence that is no token of the language becomes BAD, which no grammar accepts."""

from __future__ import annotations

import re

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
WORD = r"(?:[^\W\d])\w*"


def _ops(terminals: set[str]) -> str:
    marks = sorted((t[1:-1] for t in terminals if t[0] == "'" and not t[1].isalpha()), key=len, reverse=True)
    return "|".join(map(re.escape, marks))


class Lexer:
    """start is the mode of the first line; unfinished(mode) tells whether a file may not end in it."""

    start: tuple = ("n",)
    asi = False

    def __init__(self, terminals: set[str]):
        self.known = {t[1:-1]: t for t in terminals if t[0] == "'"}
        self.cache: dict[tuple, tuple] = {}
        self.master = re.compile(self.pattern(_ops(terminals)), re.S)

    def pattern(self, ops: str) -> str:
        raise NotImplementedError

    def lex(self, line: str, mode: tuple) -> tuple[tuple, tuple]:
        key = (line, mode)
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.scan(line, mode)
            if len(line) < 300:
                self.cache[key] = got
        return got

    def unfinished(self, mode: tuple) -> bool:
        return mode[0] != "n"


class Java(Lexer):
    def pattern(self, ops: str) -> str:
        esc = r"\\(?:[btnfrs\"'\\\n]|[0-7]{1,3}|u+[0-9a-fA-F]{4})"
        return rf"""(?P<S>[ \t\f]+)|(?P<LC>//.*)|(?P<BC>/\*)|(?P<TB>\"\"\")|(?P<STRING>"(?:[^"\\\n]|{esc})*")|(?P<CHAR>'(?:[^'\\\n]|{esc})')|(?P<NUMBER>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w]))|(?P<NONSEALED>non-sealed\b)|(?P<NAME>(?:[^\W\d]|\$)[\w$]*)|(?P<OP>{ops})|(?P<BAD>.)"""

    def scan(self, line: str, mode: tuple) -> tuple[tuple, tuple]:
        out, pos = [], 0
        if mode[0] == "c":
            end = line.find("*/")
            if end < 0:
                return (), mode
            pos, mode = end + 2, ("n",)
        elif mode[0] == "t":
            m = re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""').match(line)
            if not m:
                return (), mode
            out.append("STRING")
            pos, mode = m.end(), ("n",)
        while pos < len(line):
            m = self.master.match(line, pos)
            kind, pos = m.lastgroup, m.end()
            if kind in ("S", "LC"):
                continue
            if kind == "BC":
                end = line.find("*/", pos)
                if end < 0:
                    return tuple(out), ("c",)
                pos = end + 2
            elif kind == "TB":
                if line[pos:].strip():
                    out.append("BAD")
                    break
                return tuple(out), ("t",)
            else:
                out.append(self.known.get(m.group(), kind))
        return tuple(out), mode


class Go(Lexer):
    ENDS = {"NAME", "NUMBER", "STRING", "CHAR", "'break'", "'continue'", "'fallthrough'", "'return'", "'++'", "'--'", "')'", "']'", "'}'"}

    def pattern(self, ops: str) -> str:
        esc = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
        return rf"""(?P<S>[ \t\r]+)|(?P<LC>//.*)|(?P<BC>/\*)|(?P<RAW>`)|(?P<STRING>"(?:[^"\\\n]|{esc})*")|(?P<CHAR>'(?:[^'\\\n]|{esc})')|(?P<NUMBER>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?(?!\w))|(?P<NAME>{WORD})|(?P<OP>{ops})|(?P<BAD>.)"""

    def scan(self, line: str, mode: tuple) -> tuple[tuple, tuple]:
        out, pos = [], 0
        if mode[0] in "cr":
            mark = "*/" if mode[0] == "c" else "`"
            end = line.find(mark)
            if end < 0:
                return (), mode
            if mode[0] == "r":
                out.append("STRING")
            pos, mode = end + len(mark), ("n",)
        while pos < len(line):
            m = self.master.match(line, pos)
            kind, pos = m.lastgroup, m.end()
            if kind in ("S", "LC"):
                continue
            if kind in ("BC", "RAW"):
                mark = "*/" if kind == "BC" else "`"
                end = line.find(mark, pos)
                if kind == "RAW" and end >= 0:
                    out.append("STRING")
                if end < 0:
                    mode = ("c",) if kind == "BC" else ("r",)
                    break
                pos = end + len(mark)
            else:
                out.append(self.known.get(m.group(), kind))
        if out and mode[0] != "r" and out[-1] in self.ENDS:
            out.append("';'")
        return tuple(out), mode


class Script(Lexer):
    """JavaScript and TypeScript. mode: (kind, open braces of each template around, a regular expression may start here)."""

    start = ("n", (), True)
    asi = True
    OPERAND = {"NAME", "NUMBER", "STRING", "TEMPLATE", "TTAIL", "REGEX", "PRIVATE", "')'", "']'", "'this'", "'super'", "'null'", "'true'", "'false'"}
    STRING_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]+\}}|0(?!\d)|[^xu0-9\n]))*") for q in "\"'"}
    TEMPLATE_BODY = re.compile(r"(?:[^`\\$]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?!\d)|[^xu0-9])|\\$|\$(?!\{))*")
    NAME = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
    REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")

    def pattern(self, ops: str) -> str:
        ops = ops.replace(r"\?\.|", "", 1)  # it has a rule of its own: `a?.5:b` is no optional chain
        return rf"""(?P<S>[ \t\f\v\xa0\ufeff]+)|(?P<LC>//.*)|(?P<BC>/\*)|(?P<Q>["'])|(?P<T>`)|(?P<NUMBER>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))|(?P<NAME>{self.NAME})|(?P<PRIVATE>\#{self.NAME})|(?P<OP>\?\.(?!\d)|{ops})|(?P<BAD>.)"""

    def scan(self, line: str, mode: tuple) -> tuple[tuple, tuple]:
        kind, stack, regex = mode
        out, pos, n = [], 0, len(line)
        if kind == "c":
            end = line.find("*/")
            if end < 0:
                return (), mode
            pos, kind = end + 2, "n"
        elif kind[0] == "q":
            m = self.STRING_BODY[kind[1]].match(line)
            if line[m.end() :] == "\\":
                return (), mode
            if line[m.end() : m.end() + 1] != kind[1]:
                return ("BAD",), ("n", stack, False)
            out.append("STRING")
            pos, kind, regex = m.end() + 1, "n", False
        stack = list(stack)
        in_template = kind == "t"
        while pos < n or in_template:
            if in_template:  # text of a template up to its end or to the next ${
                fresh = kind == "t0"
                m = self.TEMPLATE_BODY.match(line, pos)
                pos = m.end()
                if line.startswith("`", pos):
                    out.append("TEMPLATE" if not stack or stack[-1] >= 0 else "TTAIL")
                    if stack and stack[-1] < 0:
                        stack.pop()
                    pos, regex, in_template = pos + 1, False, False
                elif line.startswith("${", pos):
                    if stack and stack[-1] == -1:
                        out.append("TMID")
                        stack[-1] = 0
                    else:
                        out.append("THEAD")
                        stack.append(0)
                    pos, regex, in_template = pos + 2, True, False
                elif pos >= n:
                    return tuple(out), ("t", tuple(stack), True)
                else:
                    out.append("BAD")
                    break
                del fresh
                continue
            m = self.master.match(line, pos)
            k = m.lastgroup
            if k == "S":
                pos = m.end()
                continue
            if k == "LC":
                break
            if k == "BC":
                end = line.find("*/", m.end())
                if end < 0:
                    return tuple(out), ("c", tuple(stack), regex)
                pos = end + 2
                continue
            if k == "Q":
                q = m.group()
                e = self.STRING_BODY[q].match(line, m.end()).end()
                if line[e:] == "\\":
                    return tuple(out), ("q" + q, tuple(stack), False)
                if line[e : e + 1] != q:
                    out.append("BAD")
                    break
                out.append("STRING")
                pos, regex = e + 1, False
                continue
            if k == "T":
                pos, in_template = m.end(), True
                continue
            text = m.group()
            if text[0] == "/" and regex:
                r = self.REGEX.match(line, pos)
                if not r:
                    out.append("BAD")
                    break
                out.append("REGEX")
                pos, regex = r.end(), False
                continue
            pos = m.end()
            if stack:
                if text == "{":
                    stack[-1] += 1
                elif text == "}":
                    if stack[-1] == 0:  # ends a substitution
                        stack[-1], in_template = -1, True
                        continue
                    stack[-1] -= 1
            after_dot = bool(out) and out[-1] in ("'.'", "'?.'")
            tok = self.known.get(text, k)
            out.append(tok)
            regex = tok not in self.OPERAND and not (after_dot and k == "NAME") and not (k == "NAME" and tok[1:-1] in SOFT)
        return tuple(out), ("n", tuple(stack), regex)


SOFT = {"of", "get", "set", "async", "from", "as", "type", "require", "namespace", "module", "declare", "global", "abstract", "asserts", "is", "keyof", "unique", "readonly", "infer", "satisfies", "override", "accessor", "out", "static", "using"}


PY_ESC = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{[^}\n]+\}|[^xuUN])"


def _body(raw: bool, q: str) -> re.Pattern:
    """The text of a Python string on one line, up to its closing quote or the line's end."""
    c, escaped = q[0], r"\\." if raw else PY_ESC
    return re.compile(rf"(?:[^\\{c}\n]|{escaped})*" if len(q) == 1 else rf"(?:[^\\{c}]|{escaped}|\\$|{c}(?!{c * 2}))*", re.S)


class Python(Lexer):
    """mode: (kind, open brackets, continued by a backslash). kind is "n", or what a line's end has interrupted, from the outside in:
    strings ("s", raw, quote), f-strings' text ("t", raw, quote), their expressions ("e", open brackets, quote) and format specifications
    ("p", quote). Indentation is the caller's: see indent()."""

    start = ("n", 0, False)
    PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
    ESC = re.compile(PY_ESC, re.S)
    BODY = {(raw, q): _body(raw, q) for raw in (True, False) for q in ("'", '"', "'''", '"""')}

    def pattern(self, ops: str) -> str:
        return rf"""(?P<S>[ \t\f]+)|(?P<LC>\#.*)|(?P<STR>{self.PREFIX}(?:'''|\"\"\"|'|"))|(?P<NUMBER>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:[1-9](?:_?\d)*|0(?:_?0)*)[jJ]?)(?!\w))|(?P<NAME>{WORD})|(?P<BS>\\$)|(?P<OP>{ops})|(?P<BAD>.)"""

    OLD_OCTAL = re.compile(r"0\d*[1-9]\d*$")

    def scan(self, line: str, mode: tuple) -> tuple[tuple, tuple]:
        kind, depth, _ = mode
        frames, out, pos, n = [] if kind == "n" else list(kind), [], 0, len(line)
        broken = lambda: ((*out, "BAD"), ("n", depth, False))
        while True:
            top = frames[-1] if frames else None
            if top and top[0] == "s":
                e = self.BODY[top[1], top[2]].match(line, pos).end()
                if line.startswith(top[2], e):
                    out.append("STRING")
                    frames.pop()
                    pos = e + len(top[2])
                elif len(top[2]) == 3 and e >= n or line[e:] == "\\":
                    return tuple(out), (tuple(frames), depth, False)
                else:
                    return broken()
                continue
            if top and top[0] in "tp":
                raw, q = top[1:] if top[0] == "t" else (True, top[1])
                if pos >= n:
                    if len(q) == 3 or top[0] == "p":
                        return tuple(out), (tuple(frames), depth, False)
                    return broken()
                c = line[pos]
                if line.startswith(q, pos):
                    if top[0] == "p":
                        return broken()
                    out.append("FEND")
                    frames.pop()
                    pos += len(q)
                elif c == "{" and (top[0] == "p" or not line.startswith("{{", pos)):
                    out.append("FEXPR")
                    frames.append(("e", 0, q))
                    pos += 1
                elif c == "}" and top[0] == "p":
                    frames.pop()
                    pos += 1
                elif c in "{}":
                    if not line.startswith(c * 2, pos):
                        return broken()
                    pos += 2
                elif c == "\\" and not raw:
                    m = self.ESC.match(line, pos)
                    if not m:
                        return (tuple(out), (tuple(frames), depth, False)) if pos == n - 1 else broken()
                    pos = m.end()
                else:
                    pos += 1
                continue
            if pos >= n:
                return tuple(out), (tuple(frames) or "n", depth, False)
            if top and top[1] == 0:  # an expression of an f-string, outside its own brackets
                if line.startswith(("!r", "!s", "!a"), pos) and line[pos + 2 :].lstrip()[:1] in (":", "}"):
                    pos += 2
                    continue
                if line[pos] in ":}":
                    out.append("FCLOSE")
                    frames[-1:] = [("p", top[2])] if line[pos] == ":" else []
                    pos += 1
                    continue
            m = self.master.match(line, pos)
            k, text, pos = m.lastgroup, m.group(), m.end()
            if k == "S":
                continue
            if k == "LC" or k == "BS":
                return tuple(out), (tuple(frames) or "n", depth, k == "BS" and not frames)
            if k == "STR":
                q = text[-3:] if text[-3:] in ("'''", '"""') else text[-1]
                head = text[: -len(q)].lower()
                if "f" in head:
                    out.append("FSTART")
                elif "b" in head and not line[pos : self.BODY["r" in head, q].match(line, pos).end()].isascii():
                    return broken()
                frames.append(("t" if "f" in head else "s", "r" in head, q))
                continue
            if k == "NUMBER" and self.OLD_OCTAL.match(text):
                k = "BAD"
            out.append(self.known.get(text, k) if k in ("NAME", "OP") else k)
            change = (text in OPEN) - (text in CLOSE)
            if top:
                frames[-1] = ("e", max(0, top[1] + change), top[2])
            else:
                depth = max(0, depth + change)

    @staticmethod
    def indent(line: str) -> tuple[int, int]:
        col = alt = 0
        for c in line:
            if c == " ":
                col, alt = col + 1, alt + 1
            elif c == "\t":
                col, alt = col // 8 * 8 + 8, alt + 1
            elif c == "\f":
                col = alt = 0
            else:
                break
        return col, alt
