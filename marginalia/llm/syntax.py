"""Tokens of Python, JavaScript, JSON and TOML, and the derivative parse of a whole file."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from typing import NamedTuple

from .grammars import GRAMMARS


class Verdict(NamedTuple):
    """``fail_line`` is the line of the failing token, null when the text just ends too early."""

    valid: bool
    truncated: bool
    fail_line: int | None
    fail_token: str | None


class _Classes(dict):
    """Token text -> class, worked out at first sight; forgets all when it holds too many names."""

    def __init__(self, classify) -> None:
        super().__init__()
        self.classify = classify

    def __missing__(self, text: str) -> str:
        if len(self) > 300_000:
            self.clear()
        got = self[text] = self.classify(text)
        return got


# ---- Python

_PY_WORDS = frozenset(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield match case type _".split()
)
_PY_OP = {o: o for o in "( ) [ ] { } , : ; . = := -> ... + - * ** / ~ @ |".split()}
_PY_OP |= dict.fromkeys("// % & ^ << >>".split(), "BINOP")
_PY_OP |= dict.fromkeys("< > == != <= >=".split(), "CMP")
_PY_OP |= dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "AUG")
_PY_NUM = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)\Z"
)
_PY_INT0 = re.compile(r"0[0-9_]*[1-9]")
_PY_TOKENS = re.compile(
    r"""[ \t\f]*(?:\#[^\n]*)?(\n[ \t\f]*(?:\#[^\n]*)?|\\\n
    |(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''
    |"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')
    |[^\W\d]\w*|\.?\d(?:[eE][+-]\d|[\w.])*|\.\.\.|->|:=|\*\*=?|//=?|<<=?|>>=?|[-+*/%@&|^=<>!]=|.|\Z)""",
    re.X | re.S,
)
_PY_BADESC = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N)")
_PY_BYTES_X = re.compile(r"\\x(?![0-9a-fA-F]{2})")
_F_PARTS = re.compile(r"\{\{|\}\}|[{}]")


def _py_class(t: str) -> str:
    if not t:
        return ""
    c = t[0]
    if c.isidentifier():
        q = t[-1]
        if q in "\"'":
            prefix = t[: min(x for x in (t.find('"'), t.find("'")) if x >= 0)].lower()
            body = t[len(prefix) :]
            if "b" in prefix:
                return "BSTR" if body.isascii() and ("r" in prefix or not _PY_BYTES_X.search(body)) else "BAD"
            if "f" in prefix:
                return "STR" if _f_string_ok(t, body, "r" in prefix) else "BAD"
            return "STR" if "r" in prefix or not _escape_bad(body) else "BAD"
        if t in _PY_WORDS:
            return t
        if t in ("None", "True", "False"):
            return "CONST"
        return "NAME" if t.isidentifier() else "BAD"
    if c in "\"'":
        return "STR" if len(t) > 1 and not _escape_bad(t) else "BAD"
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        ok = _PY_NUM.match(t) and not (_PY_INT0.match(t) and not re.search(r"[.eEjJ]", t))
        return "NUM" if ok else "BAD"
    if c == "\n":
        return "\n"
    if t == "\\\n":
        return ""
    return _PY_OP.get(t, "BAD")


def _escape_bad(body: str) -> bool:
    return "\\" in body and _PY_BADESC.search(body.replace("\\\\", "")) is not None


def _f_string_ok(whole: str, body: str, raw: bool) -> bool:
    """Whether each replacement field holds an expression; doubtful ones are left to the exact check."""
    if not raw and _escape_bad(body):
        return False
    n = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
    return _fields_ok(body[n:-n])


def _fields_ok(text: str) -> bool:
    depth, start, fields = 0, 0, []
    brackets = 0
    i = 0
    while i < len(text):
        c = text[i]
        if depth == 0:
            if c in "{}":
                if text[i : i + 2] in ("{{", "}}"):
                    i += 1
                elif c == "}":
                    return False
                else:
                    depth, start, brackets = 1, i + 1, 0
        elif c in "([{":
            brackets += 1
        elif c == "}" and brackets == 0:
            fields.append((text[start:i], ""))
            depth = 0
        elif c in ")]}":
            brackets -= 1
        elif c in "\"'\\#":
            if c in "\"'":
                end = text.find(c, i + 1)
                if end < 0:
                    return False
                i = end
            else:
                return False
        elif brackets == 0 and (c == ":" or (c == "!" and text[i + 1 : i + 2] != "=")):
            expr = text[start:i]
            if c == "!":
                m = re.match(r"![rsa](?=[:}])", text[i:])
                if not m:
                    return False
                i += 2
                c = text[i]
            spec = ""
            if c == ":":
                j, level = i + 1, 0
                while j < len(text) and not (text[j] == "}" and level == 0):
                    level += (text[j] == "{") - (text[j] == "}")
                    j += 1
                if j >= len(text):
                    return False
                spec, i = text[i + 1 : j], j
            fields.append((expr, spec))
            depth = 0
        i += 1
    if depth:
        return False
    for expr, spec in fields:
        if expr.endswith("="):
            expr = expr[:-1]
        if not expr.strip() or not _fragment_ok("py", expr.strip()):
            return False
        if spec and not _fields_ok(spec):
            return False
    return True


def _fragment_ok(ext: str, text: str) -> bool:
    grammar, _ = GRAMMARS[ext]
    state = grammar.start("fragment")
    for t in (_PY_TOKENS if ext == "py" else _JS_TOKENS).findall(text):
        c = (PY_CLASS if ext == "py" else JS_CLASS)[t]
        if c in ("", "\n"):
            continue
        state = grammar.derive(state, c)
        if state == grammar.dead:
            return False
    return grammar.is_nullable(state)


PY_CLASS = _Classes(_py_class)


_DEEPER = frozenset("([{")
_SHALLOWER = frozenset(")]}")


def _line_derivative(grammar, state: int, line: str) -> tuple[int, int]:
    """Derivative of ``state`` by a line of token classes, and by how much its brackets change the depth."""
    depth = 0
    for cls in line.split():
        state = grammar.derive(state, cls)
        depth += (cls in _DEEPER) - (cls in _SHALLOWER)
        if depth > 200:  # as deep as the language allows
            return grammar.dead, depth
    return state, depth


def _accepts_python(text: str) -> bool:
    """The derivative parse with whole lines of token classes as memoised steps; only tells yes or no."""
    grammar, top = GRAMMARS["py"]
    state = grammar.start(top)
    if len(grammar.memo) > 500_000:
        grammar.memo.clear()
    memo, derive = grammar.memo, grammar.derive
    tokens = _PY_TOKENS.findall(text)
    lines = " ".join(map(PY_CLASS.__getitem__, tokens)).split("\n")
    breaks = iter([t for t in tokens if t[:1] == "\n"])
    depth, indents, pending = 0, [""], ""
    margin = ""
    for line in lines:
        line = line.strip()
        if line:
            if depth == 0:
                pending = ""
                if margin != indents[-1]:
                    margin = margin.rpartition("\f")[2]
                    if margin.startswith(indents[-1]):
                        if margin != indents[-1]:
                            indents.append(margin)
                            state = derive(state, "INDENT")
                    else:
                        while len(indents) > 1 and indents[-1] != margin and indents[-1].startswith(margin):
                            indents.pop()
                            state = derive(state, "DEDENT")
                        if indents[-1] != margin:
                            return False
                    if "\t" in margin and " " in margin:
                        return False
            key = (state, line)
            step = memo.get(key)
            if step is None:
                step = memo[key] = _line_derivative(grammar, state, line)
            state = step[0]
            depth += step[1]
            if depth == 0:
                state = derive(state, "NEWLINE")
            if state == grammar.dead or depth < 0:
                return False
        token = next(breaks, "\n")
        margin = token[1:] if "#" not in token else indents[-1]
    if depth:
        return False
    for _ in indents[1:]:
        state = derive(state, "DEDENT")
    return grammar.is_nullable(state)


def parse_python(text: str) -> Verdict:
    """Accepts by lines; a text that fails so is parsed again token by token to find the failing one."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _accepts_python("\n" + text):
        return Verdict(True, False, None, None)
    grammar, top = GRAMMARS["py"]
    state = grammar.start(top)
    trans, derive, dead = grammar.trans, grammar.derive, grammar.dead
    indents, depth, fresh, tabbed, spaced = [""], 0, True, False, False
    line = 1
    token = "\n"
    for token in _PY_TOKENS.findall("\n" + text):
        cls = PY_CLASS[token]
        if cls == "":
            line += token == "\\\n"
            continue
        if cls == "\n":
            if depth == 0 and not fresh:
                state = trans[state].get("NEWLINE") or derive(state, "NEWLINE")
                fresh = True
                if state == dead:
                    return Verdict(False, False, line - 1, "\\n")
            line += 1
            if depth == 0:
                margin = token[1:]
                if "#" in margin:
                    margin = None
            continue
        if fresh:
            fresh = False
            if margin is None:
                margin = indents[-1]
            margin = margin.rpartition("\f")[2]
            if margin != indents[-1]:
                tabbed |= "\t" in margin
                spaced |= " " in margin
                if tabbed and spaced:
                    return Verdict(False, False, line - 1, token)
                if margin.startswith(indents[-1]):
                    indents.append(margin)
                    state = derive(state, "INDENT")
                else:
                    while len(indents) > 1 and indents[-1] != margin and indents[-1].startswith(margin):
                        indents.pop()
                        state = derive(state, "DEDENT")
                    if indents[-1] != margin:
                        return Verdict(False, False, line - 1, token)
                if state == dead:
                    return Verdict(False, False, line - 1, token)
        nxt = trans[state].get(cls)
        state = derive(state, cls) if nxt is None else nxt
        if state == dead:
            return Verdict(False, False, line - 1, token)
        if cls in "([{":
            depth += 1
            if depth > 200:
                return Verdict(False, False, line - 1, token)
        elif cls in ")]}":
            depth -= 1
        if "\n" in token:
            line += token.count("\n")
    if depth == 0:
        if not fresh:
            state = derive(state, "NEWLINE")
        for _ in indents[1:]:
            state = derive(state, "DEDENT")
    ok = depth == 0 and state != dead and grammar.is_nullable(state)
    return Verdict(ok, not ok, None, None)


# ---- JavaScript

_JS_CONTEXT = frozenset("async of get set static as from".split())
_JS_WORDS = frozenset(
    "this super import export default var let const if else while do for await continue break return throw switch case try catch "
    "finally debugger function class extends yield in instanceof typeof void delete new with".split()
)
_JS_RESERVED = frozenset("enum implements interface package private protected public".split())
_JS_OP = {o: o for o in "( ) [ ] { } , : ; . ... ?. ? => = + - * / ! ~".split()}
_JS_OP |= dict.fromkeys("% ** << >> >>> < > <= >= == != === !== & | ^ && || ??".split(), "BINOP")
_JS_OP |= dict.fromkeys("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split(), "ASSIGN")
_JS_OP |= dict.fromkeys(("++", "--"), "INCDEC")
_JS_NUM = re.compile(
    r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n"
    r"|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)\Z"
)
_JS_TOKENS = re.compile(
    r"""[ \t\v\f\u00a0\ufeff]+|\r?\n|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|"[^"\\\n]*(?:\\(?:\r\n|.)[^"\\\n]*)*"|'[^'\\\n]*(?:\\(?:\r\n|.)[^'\\\n]*)*'
    |\#?[^\W\d][\w$]*|\#?\$[\w$]*|\.?\d(?:[eE][+-]\d|[\w.])*|\.\.\.|\?\.(?!\d)|=>|>>>=|[<>=!]==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|[-+*/%&|^<>=!]=|.""",
    re.X | re.S,
)
_JS_RE = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these classes a slash divides; anywhere else it opens a regular expression.
_JS_ENDS = frozenset(["NAME", "NUM", "STR", "TPL", "RE", "CONST", "this", "super", ")", "]", "}", "PRIV", "INCDEC", *_JS_CONTEXT])


def _js_class(t: str) -> str:
    c = t[0]
    if c in " \t\v\f\u00a0\ufeff" or t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) > 3 else "BAD"
    if c in "\n\r\u2028\u2029":
        return "\n"
    if c in "\"'":
        return "STR" if len(t) > 1 else "BAD"
    if c == "#":
        return "PRIV" if len(t) > 1 else "BAD"
    if c == "$" or c.isidentifier():
        if t in _JS_CONTEXT or t in _JS_WORDS:
            return t
        if t in ("null", "true", "false"):
            return "CONST"
        return "KEYWORD" if t in _JS_RESERVED else "NAME"
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "NUM" if _JS_NUM.match(t) else "BAD"
    return _JS_OP.get(t, "BAD")


JS_CLASS = _Classes(_js_class)


def _template_end(text: str, at: int) -> tuple[int, bool]:
    """End of the template literal that opens at ``at``, and whether what it substitutes are expressions."""
    i, ok = at + 1, True
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, ok
        elif c == "$" and text[i + 1 : i + 2] == "{":
            level, j = 1, i + 2
            while j < len(text) and level:
                if text[j] == "`":
                    j, _ = _template_end(text, j)
                    if j < 0:
                        return -1, False
                    continue
                if text[j] in "\"'":
                    end = text.find(text[j], j + 1)
                    if end < 0:
                        return -1, False
                    j = end
                level += (text[j] == "{") - (text[j] == "}")
                j += 1
            if level:
                return -1, False
            inner = text[i + 2 : j - 1]
            ok = ok and (("`" in inner) or _fragment_ok("js", inner))
            i = j
        else:
            i += 1
    return -1, False


_JS_SPECIAL = re.compile(r"[`/]")


def parse_javascript(text: str) -> Verdict:
    grammar, top = GRAMMARS["js"]
    state = grammar.start(top)
    trans, derive, dead = grammar.trans, grammar.derive, grammar.dead
    pos = text.find("\n") if text.startswith("#!") else 0
    pos, end = max(pos, 0), len(text)
    prev, newline, line = "", False, 1
    match = _JS_TOKENS.match
    while pos < end:
        token = match(text, pos).group()
        cls = JS_CLASS[token]
        if token[0] in "`/" and cls not in ("", "\n"):
            if token[0] == "`":
                stop, ok = _template_end(text, pos)
                token, cls = (text[pos:stop], "TPL") if stop > 0 and ok else (token, "BAD")
            elif prev not in _JS_ENDS:
                m = _JS_RE.match(text, pos)
                token, cls = (m.group(), "RE") if m else (token, "BAD")
        pos += len(token)
        if cls == "":
            continue
        if cls == "\n":
            newline = True
            line += token.count("\n")
            continue
        if newline and (cls == "INCDEC" or prev in ("return", "break", "continue", "throw")):
            forced = derive(state, "ASI")  # restricted productions end at the line break
            state = forced if forced != dead else state
        nxt = trans[state].get(cls)
        if nxt is None:
            nxt = derive(state, cls)
        if nxt == dead and (newline or cls == "}"):
            nxt = derive(derive(state, "ASI"), cls)
        if nxt == dead:
            return Verdict(False, False, line, token[:80])
        state, prev, newline = nxt, cls, False
        if "\n" in token:
            line += token.count("\n")
    if not grammar.is_nullable(state):
        state = derive(state, "ASI")
    ok = grammar.is_nullable(state)
    return Verdict(ok, not ok, None, None)


# ---- JSON and TOML

_JSON_TOKENS = re.compile(r'[ \t\n\r]+|"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z]+|.', re.S)


def _json_class(t: str) -> str:
    c = t[0]
    if c in " \t\n\r":
        return ""
    if c == '"':
        return "STR" if len(t) > 1 else "BAD"
    if c.isdigit() or (c == "-" and len(t) > 1):
        return "NUM"
    if t in ("true", "false", "null"):
        return "CONST"
    return t if c in "{}[]:," else "BAD"


_TOML_TOKENS = re.compile(
    r"""[ \t]+|\r?\n|\#[^\n]*|\"\"\"(?:[^\\]|\\.)*?\"\"\"\"{0,2}(?!\")|'''.*?''''{0,2}(?!')|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\n]*'
    |[A-Za-z0-9_+:-][A-Za-z0-9_+:.-]*|.""",
    re.X | re.S,
)
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\Z")
_TOML_VALUE = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])(?:T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?)\Z"
)
_TOML_ESC = re.compile(r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U000[0-9a-fA-F]{5}|\s*\n)')
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


def _toml_string(t: str) -> str:
    if _CONTROL.search(t.replace("\r\n", "\n")) or (t[0] == '"' and "\\" in _TOML_ESC.sub("", t)) or "\\u" in t.lower():
        return "BAD"
    return "MSTR" if t[:3] in ('"""', "'''") and len(t) >= 6 else "STR"


JSON_CLASS = _Classes(_json_class)


def parse_json(text: str) -> Verdict:
    grammar, top = GRAMMARS["json"]
    state, line = grammar.start(top), 1
    for token in _JSON_TOKENS.findall(text):
        cls = JSON_CLASS[token]
        if cls:
            state = grammar.derive(state, cls)
            if state == grammar.dead:
                return Verdict(False, False, line, token[:80])
        else:
            line += token.count("\n")
    ok = grammar.is_nullable(state)
    return Verdict(ok, not ok, None, None)


def parse_toml(text: str) -> Verdict:
    """Besides the grammar, a key or header seen twice counts as failing; the exact check judges it."""
    grammar, top = GRAMMARS["toml"]
    state, line, prev, value = grammar.start(top), 1, "\n", False
    tokens = [t for t in _TOML_TOKENS.findall(text) if t[0] not in " \t"]
    header, seen, level, key = "", set(), 0, []
    for k, token in enumerate(tokens):
        c = token[0]
        if c == "#":
            cls = "BAD" if _CONTROL.search(token.rstrip("\r")) else ""
        elif token in ("\n", "\r\n"):
            cls = "NEWLINE"
        elif c in "\"'":
            cls = _toml_string(token) if len(token) > 1 else "BAD"
        elif value and (c.isalnum() or c in "+-"):
            cls = "BAREVAL" if _TOML_VALUE.match(token) else "BAD"
        elif c.isalnum() or c in "_-":
            cls = "BARE" if _TOML_BARE.match(token) else "BAD"
        elif prev in ("NEWLINE", "\n") and token == "[" and level == 0:
            cls = "["
        else:
            cls = token if token in "[]{}=,." else "BAD"
        if cls == "":
            continue
        double = cls in ("[", "]") and not value and level == 0 and (tokens[k + 1 : k + 2] == [cls] or (k and tokens[k - 1] == cls))
        if double:
            if k and tokens[k - 1] == cls and prev != "NEWLINE":
                continue
            cls = "[[" if cls == "[" else "]]"
        state = grammar.derive(state, cls)
        if state == grammar.dead:
            return Verdict(False, False, line, token[:80])
        if not value:
            if cls in ("BARE", "STR", "."):
                key.append(token.strip("\"'"))
            elif cls in ("]", "]]"):
                header = "".join(key) + (f"#{line}" if cls == "]]" else "")
                if header in seen and cls == "]":
                    return Verdict(False, False, line, header)
                seen.add(header)
            elif cls == "=":
                name = f"{header}\n{''.join(key)}"
                if name in seen or "." in name.partition("\n")[2] or c == "{":
                    return Verdict(False, False, line, token)
                seen.add(name)
        if cls == "=":
            value = True
        if value:
            if cls == "{":
                return Verdict(False, False, line, token)  # inline tables: the exact check decides on their keys
            level += (cls == "[") - (cls == "]")
        if cls == "NEWLINE":
            line += 1
            if level == 0:
                value, key = False, []
        elif "\n" in token:
            line += token.count("\n")
        prev = cls
    ok = grammar.is_nullable(state) and level == 0
    return Verdict(ok, not ok, None, None)


PARSERS = {"py": parse_python, "js": parse_javascript, "json": parse_json, "toml": parse_toml}


def _raise_constant(name: str):
    raise ValueError(name)


def really_invalid(ext: str, text: str) -> bool:
    """Exact check of a text that the derivative parse rejected; JavaScript has no other judge."""
    try:
        if ext == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif ext == "json":
            json.loads(text, parse_constant=_raise_constant)
        elif ext == "toml":
            tomllib.loads(text)
        else:
            return True
    except (SyntaxError, ValueError):
        return True
    except (RecursionError, MemoryError):
        return False
    return False


def check(ext: str, text: str) -> Verdict | None:
    """The verdict on ``text``, or null for an extension without a grammar."""
    parse = PARSERS.get(ext)
    if parse is None:
        return None
    verdict = parse(text)
    if not verdict.valid and not really_invalid(ext, text):
        return Verdict(True, False, None, None)
    return verdict
