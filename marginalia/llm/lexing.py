"""Comments and string literals of source files, tolerant of text that does not parse."""

from __future__ import annotations

import re
from typing import NamedTuple


class Piece(NamedTuple):
    """A comment or literal; ``start``/``end`` are offsets of its inner text, ``line`` that of its first character."""

    kind: str  # comment, string
    line: int
    start: int
    end: int
    text: str


_PY = re.compile(
    r"""(?P<c>\#[^\n]*)
    |(?P<t>\"\"\"(?P<t1>(?:[^"\\]|\\.|"(?!""))*)(?:\"\"\"|\Z)|'''(?P<t2>(?:[^'\\]|\\.|'(?!''))*)(?:'''|\Z))
    |(?P<s>"(?P<s1>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z)|'(?P<s2>(?:[^'\\\n]|\\.)*)(?:'|(?=\n)|\Z))""",
    re.X | re.S,
)
_JS = re.compile(
    r"""(?P<c>//[^\n]*)|(?P<b>/\*(?P<b1>.*?)(?:\*/|\Z))
    |(?P<r>(?<=[=(,:\[!&|?{};])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)
    |(?P<t>`(?P<t1>(?:[^`\\]|\\.)*)(?:`|\Z))
    |(?P<s>"(?P<s1>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z)|'(?P<s2>(?:[^'\\\n]|\\.)*)(?:'|(?=\n)|\Z))""",
    re.X | re.S,
)
_JSON = re.compile(r'(?P<s>"(?P<s1>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z))', re.S)
_LEXERS = {"py": _PY, "toml": _PY, "js": _JS, "json": _JSON}
_LOOKS_PY = re.compile(r"^(?:def \w+\(.*\).*:|class \w+.*:|from [\w.]+ import |import \w+(?:\.\w+)*)[ \t\r]*$", re.M)
_LOOKS_JS = re.compile(r"^(?:export (?:default |async )?(?:function|const|class)|const \w+ =|function \w+\(|import .* from ['\"]|!function\()", re.M)
_LOOKS_TOML = re.compile(r"^\[[\w.\"-]+\][ \t\r]*$", re.M)


def language_of(path: str | None, text: str) -> str:
    """The language whose comments ``text`` is read by: that of the extension unless the text is plainly another's."""
    ext = (path or "").rpartition(".")[2].lower()
    if ext not in _LEXERS:
        ext = ""
    if ext in ("py", "js", ""):
        js, py = bool(_LOOKS_JS.search(text)), bool(_LOOKS_PY.search(text))
        if js != py:
            return "js" if js else "py"
    if ext:
        return ext
    if text.lstrip()[:1] == "{":
        return "json"
    return "toml" if _LOOKS_TOML.search(text) else "py"


def pieces(text: str, language: str) -> list[Piece]:
    """Comments and literals in order; comments after code and comments on their own lines come one by one."""
    out, line, at = [], 1, 0
    for m in _LEXERS[language].finditer(text):
        kind = m.lastgroup
        if kind == "r":
            continue
        start = m.start()
        line += text.count("\n", at, start)
        at = start
        if m.group("c") if language != "json" else False:
            skip = 1 if language != "js" else 2
            out.append(Piece("comment", line, start + skip, m.end(), m.group()[skip:]))
            continue
        inner = next((g for g in ("s1", "s2", "t1", "t2", "b1") if g in m.re.groupindex and m.group(g) is not None), None)
        if inner is not None:
            out.append(Piece("comment" if inner == "b1" else "string", line, *m.span(inner), m.group(inner)))
    return out


def passages(text: str, language: str) -> list[Piece]:
    """Pieces with adjoining comment-only lines joined into one."""
    out: list[Piece] = []
    own_line = False
    last = -2
    for p in pieces(text, language):
        if p.kind == "comment":
            begin = text.rfind("\n", 0, p.start) + 1
            alone = not text[begin : p.start].strip(" \t\r\f#/*")
            if alone and own_line and p.line == last + 1:
                q = out[-1]
                out[-1] = Piece("comment", q.line, q.start, p.end, q.text + "\n" + p.text)
            else:
                out.append(p)
            own_line = alone
            last = p.line + p.text.count("\n")
        else:
            out.append(p)
            own_line = False
    return out
