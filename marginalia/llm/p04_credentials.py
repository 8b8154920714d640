"""Problem 4: credentials embedded in source code.

The method: quoted strings (adjoining ones joined) and long tokens are the candidates; one is a credential when its
Shannon entropy reaches that of random text of the same alphabet and length, less some deviations (``typical_entropy``
is fitted on seeded random texts), and digests, identifiers, encoded data and placeholders are excluded.
``p4_method`` is that and no more: no name has to announce a value.  Passwords that people choose, short or made of
words, have the entropy of words, and digests that of keys, so the method cannot find every credential: ``secrets`` goes
on to what a name, flag or header announces (keys there by entropy too, with a wider margin) and to pairs of user and
password in URLs and Basic headers, bearer tokens, query parameters and private-key blocks.  Redaction replaces
nothing but the values.

Defined cases: null ids or texts give no rows, null target comments or prompt codes are skipped; each place of a
value comes out; rows delivered twice count once.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexing
from .common import flat_map, table

MASK = "REDACTED"
#: The sample that thresholds are fitted on: random texts per alphabet and length, and the length beyond which it is that of LONGEST.
DRAWS, LONGEST = 300, 128
# How far below random a value may lie under a name that announces a key, and with no more than a neutral name or a hint.
NAMED, NEUTRAL, ALONE = 6.0, 4.0, 2.5


class Secret(NamedTuple):
    """``start``/``end`` are offsets of the value in the text; ``probe`` is its first line's text."""

    start: int
    end: int
    line: int
    probe: str


# The words of names that announce a password, a key or token, and values that are no secrets.
_PASSWORD = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|kennwort|passwort|contrase(?:na|ña)|clave|senha|mot_?de_?passe|mdp|has(?:lo|ło)|sifre|şifre|parol|пароль)s?\d*$")
_KEY = re.compile(
    r"(?i)(?:token|api[_-]?key|apikey|key|auth|authorization|cred(?:ential)?s?|bearer|license|licence|signing|cipher|jwt|pat|dsn|conn(?:ection)?|salt|pin|access|private|x-api-key|x-auth|basic|cookie|session_?id|schluessel|schlüssel)\d*$"
)
_NEUTRAL_OK = re.compile(r"(?i)(?:cfg|conf|config|setting|settings|value|val|data|opt|option|arg|default|material|blob)\d*$")
_HASH_NAME = re.compile(r"(?i)^(?:.*[_.\- ])?(?:sha\d*|md5|crc\d*|hash|digest|checksum|revision|rev|commit|integrity|etag|uuid|guid|id|ids|fingerprint|nonce|version|build|icon|image|logo|png|public[_-]?key|pub[_-]?key|verify[_-]?key|thumbprint|trace|span|seed)\d*$")
_PLACEHOLDER = re.compile(
    r"(?i)^\s*$|\$\{|\$\(|\{\{|<[^>]*>|^\{.*\}$|^env[:.]|^%[\w(]|^\$[A-Z_]|^vault:|^ssm:|^secret[s]?[:/]|^(?:os|process)\.|\*{3,}|x{4,}|\.{3}|changeme|change[_-]?(?:me|it)|placeholder|^your[_-]|[_-]here$|"
    r"^(?:example|dummy|sample|redacted|none|null|undefined|todo|tbd|fixme|test|testing|secret|password|passwd|pass|token|default|empty|unset|insert|replace|fake|foo|bar|n/?a|true|false|admin|root|guest|hidden|masked|removed)\d*$"
)
_IDENT = re.compile(r"^[A-Za-z]+(?:[_.\-/ :][A-Za-z]+)*[_.\-]?$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]+$")
_KNOWN = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}$|^xox[abprs]-[\w-]{10,}$|^sk[_-](?:live|test|ant|proj)?[_-]?[A-Za-z0-9]{16,}$|^AIza[\w-]{30,}$|^glpat-[\w-]{16,}$")
_TOKENISH = re.compile(r"^[A-Za-z0-9+/=_.~\-]+$")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_URL_PAIR = re.compile(r"\b[a-z][a-z0-9+.\-]*://[^\s/:@\"'`]*:([^\s@\"'`]+)@[\w\[{$]")
_QUERY = re.compile(r"(?i)[?&](?:access_?token|api_?key|apikey|token|key|secret|client_secret|password|passwd|pwd|auth|sig|signature)=([^&\s\"'`]+)")
_HEADER = re.compile(r"(?i)\b(?:bearer|token)\s+([A-Za-z0-9+/=_.~\-]{12,})")
_BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
_INLINE = re.compile(r"(?i)(?<![\w\-])([\w\-]*?(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credential|cred|kennwort))\b(?:\s+(?:for|of|in|on|is)\b[\w ]{0,30})?[\"']?\s*[:=]\s*[\"']?([^\s\"'`,;]{6,})")
_LONG = re.compile(r"[A-Za-z0-9+/=_.~\-]{20,}")
_NAME = re.compile(r"(?<![\w$\-])([\w$\-]+)[\"'`]?\]?\s*(?::\s*\w+(?:\[\w+\])?\s*)?(?:=>|:=|\?\?=|=|:|\()\s*[(\[]?\s*[bBrRuUfF]{0,2}[\"'`]*$")
_FLAG = re.compile(r"[\"']--?([\w\-]+)[\"']")
_DEFAULT = re.compile(r"\bdefault\s*=\s*[bBrRuUfF]{0,2}[\"'`]*$")
_ACCOUNTS = re.compile(r"(?i)(?:accounts?|users?|logins?|credentials?)\s*=\s*[\[({]")
_PAIR = re.compile(r"[(\[]\s*[\"'][^\"']+[\"']\s*,\s*[\"']$")
_LOGIN = re.compile(r"(?i)(?:log_?in|sign_?in|authenticate|auth|connect)\(\s*[\"'][^\"']+[\"']\s*,\s*[\"']$")
_TOLD = re.compile(r"(?i)\b(?:access|log ?in|sign ?in|get in|credentials?|password|account)\b[^\n:]{0,40}:\s*[^\s/]+\s*/\s*([^\s/]{6,})")
LOGIN_WORD = 40  # no call that takes user and password has a longer name
ALONE_LETTERS, ALONE_MOST = 20, 120  # of values that nothing announces: shorter ones are too many, longer ones are data
_BARE = re.compile(r"[A-Za-z0-9_\-]+")
_SPOKEN = re.compile(r"[A-Z]?[a-z]*[aeiouy][a-z]*|[A-Z]*[AEIOUY][A-Z]*")
_BLOB_LINE = re.compile(r"[\"'`(,+\s]*[bBrR]?[\"'`]?[A-Za-z0-9+/=_\\\-]{40,}[\"'`),+;\s\\]*(?:\\n)?[\"'`),+;\s\\]*")
_HINT = re.compile(r"(?i)#|//")
_HINT_WORD = re.compile(r"(?i)\b(?:live|prod|production|rotate|secret|do not commit|private|staging)\b")


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _alphabet(value: str) -> int:
    if _HEX.match(value):
        return 16
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search(r"\d", value))
    return size + 2 * bool(re.search(r"[^A-Za-z0-9]", value))


@lru_cache(maxsize=4096)
def typical_entropy(size: int, n: int) -> tuple[float, float]:
    """Mean and standard deviation of the entropy of random text of ``n`` letters of an alphabet, from DRAWS seeded texts."""
    rows = np.sort(np.random.default_rng(size * 1000 + n).integers(0, size, (DRAWS, n)), axis=1)
    bits = [-sum(c / n * math.log2(c / n) for c in np.unique(r, return_counts=True)[1].tolist()) for r in rows]
    return float(np.mean(bits)), float(np.std(bits))


def is_random(value: str, deviations: float) -> bool:
    """Whether the entropy is no more than so many deviations below that of random text of this alphabet and length."""
    size, n = _alphabet(value), len(value)
    if size < 2 or n < 8:
        return False
    mean, deviation = typical_entropy(size, min(n, LONGEST))  # it hardly changes beyond
    return entropy(value) >= mean - deviations * deviation


def _wordy(value: str) -> bool:
    """Made of words only: identifiers, labels, paths, sentences."""
    if " " in value.strip():
        return True
    return bool(_IDENT.match(value)) and not re.search(r"[a-z][A-Z]{2,}|[A-Z]{2,}[a-z]", value) and (value.islower() or value.isupper() or bool(re.search(r"[_.\-/:]", value)) or bool(re.fullmatch(r"[a-z]*(?:[A-Z][a-z]+)*", value)))


def judge(value: str, name: str, hinted: bool = False) -> bool:
    """Whether ``value`` under ``name`` is a credential."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.search(v) or len(set(v)) < 4:
        return False
    if _KNOWN.match(v):
        return True
    tail = _tail(name)
    secret = bool(_PASSWORD.search(tail))
    if secret:
        if "://" in v:
            return False
        if _wordy(v):
            return v.count("-") >= 2 and not re.search(r"(?i)token|key|secret|pass", v)
        return " " not in v
    if _UUID.match(v) or "://" in v or re.search(r"[\s\"'`()\[\]{}<>,;\\]", v):
        return False
    if _KEY.search(tail) and not _HASH_NAME.match(tail):
        if _wordy(v) or re.fullmatch(r"[\d.\-]+", v):
            return bool(re.fullmatch(r"[a-z]+(?:-[a-z]+){2,}-\d+", v))
        if re.fullmatch(r"[a-z]+(?:-[a-z]+){2,}-\d+", v):
            return True
        if re.fullmatch(r"[a-z]+(?:[_\-][a-z0-9]+)+", v) and not re.search(r"\d\D*\d", v) and not re.search(r"-\d\d$", v):
            return False
        return len(v) >= 8 and bool(re.search(r"\d", v) or re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v)) and is_random(v, NAMED)
    if _HASH_NAME.match(tail) or (_HEX.match(v) and not hinted):
        return False
    if not _TOKENISH.match(v) or not (hinted or _NEUTRAL_OK.search(tail)):
        return False
    return len(v) >= 20 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and is_random(v, NEUTRAL)


def _basic_pair(value: str) -> bool:
    try:
        user, sep, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return False
    return bool(sep) and user.isprintable() and password.isprintable() and len(password) >= 4 and not _PLACEHOLDER.search(password)


def _within(text: str):
    """(start, end) of the credentials that stand inside a string or comment."""
    if "://" in text:
        for m in _URL_PAIR.finditer(text):
            v = m.group(1)
            if not _PLACEHOLDER.search(v) and not re.match(r"[{$%<]", v) and len(v) >= 4 and v.lower() not in ("pass", "password", "pwd"):
                yield m.span(1)
        for m in _QUERY.finditer(text):
            if judge(m.group(1), "token"):
                yield m.span(1)
    for m in _HEADER.finditer(text):
        if judge(m.group(1), "token"):
            yield m.span(1)
    if "Basic" in text:
        for m in _BASIC.finditer(text):
            if _basic_pair(m.group(1)):
                yield m.span(1)


def _inline(text: str):
    """(start, end) of ``name: value`` and of long random tokens in prose."""
    for m in _INLINE.finditer(text):
        v = m.group(2).rstrip(".)]}>")
        if "://" not in v and not v.endswith("(") and "(" not in v and judge(v, m.group(1)):
            yield m.start(2), m.start(2) + len(v)
    for m in _TOLD.finditer(text):
        if judge(m.group(1), "password"):
            yield m.span(1)
    for m in _LONG.finditer(text):
        v = m.group().strip("-=.")
        if _KNOWN.match(v):
            yield m.start() + m.group().find(v), m.start() + m.group().find(v) + len(v)


_JOIN = {"py": re.compile(r"[\"']+(?:\s|\\\n)*[bBrRuUfF]{0,2}[\"']+\Z"), "js": re.compile(r"[\"'`]\s*\+\s*[\"'`]\Z")}


def _literals(text: str, language: str):
    """Strings with those that adjoin them joined: (pieces, value)."""
    group: list[lexing.Piece] = []
    joins = _JOIN.get(language)
    for p in lexing.pieces(text, language):
        if p.kind == "string" and group and joins and group[-1].kind == "string" and joins.match(text[group[-1].end : p.start]):
            group.append(p)
            continue
        if group:
            yield group
        group = [p]
    if group:
        yield group


def _offset(group: list[lexing.Piece], at: int) -> int:
    """Where character ``at`` of the joined literals stands in the text."""
    for p in group:
        if at < len(p.text):
            return p.start + at
        at -= len(p.text)
    raise IndexError(at)


class _Context:
    """What stands around the literals of a text; lines, flags, lists of accounts and hints are sought once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.flags = [(m.start(), m.group(1)) for m in _FLAG.finditer(text)]
        self.accounts = [m.start() for m in _ACCOUNTS.finditer(text)]
        self.hints = [m.start() for m in _HINT.finditer(text)]

    def line(self, at: int) -> tuple[int, int]:
        """Where the line of ``at`` begins and ends."""
        k = bisect_left(self.breaks, at)
        return (self.breaks[k - 1] + 1 if k else 0), (self.breaks[k] if k < len(self.breaks) else len(self.text))

    def name(self, before: int, start: int) -> str:
        """The name, flag or call that the literal at ``start`` belongs to; the literal before it begins at ``before``."""
        text = self.text
        begin, _ = self.line(start)
        local = text[max(begin, before) : start]
        if _DEFAULT.search(local):
            k = bisect_left(self.flags, (start,)) - 1
            if k >= 0 and self.flags[k][0] >= begin:
                return self.flags[k][1]
        m = _NAME.search(local)
        if m:
            return m.group(1)
        if _LOGIN.search(text[max(begin, before - LOGIN_WORD) : start]):
            return "password"
        if _PAIR.search(text[max(begin, before - 2) : start]):
            k = bisect_left(self.accounts, start) - 1
            if k >= 0 and self.accounts[k] >= begin:
                return "password"
        if before < begin and not local.strip(" \t\"'`bBrRuUfF(["):
            above = text[max(before, self.line(begin - 1)[0]) : begin].rstrip()
            m = _NAME.search(above + '"')
            if m:
                return m.group(1)
        return ""

    def hinted(self, end: int) -> bool:
        """Whether a comment behind ``end`` on its line says that a value is live or secret."""
        _, stop = self.line(end)
        k = bisect_left(self.hints, end)
        return k < len(self.hints) and self.hints[k] < stop and _HINT_WORD.search(self.text, self.hints[k], stop) is not None

    def in_blob(self, start: int, end: int) -> bool:
        """Whether the line above or below holds nothing but text of the same kind: a part of a longer block."""
        begin, stop = self.line(start)[0], self.line(end)[1]
        around = ([self.line(begin - 1)] if begin else []) + ([self.line(stop + 1)] if stop < len(self.text) else [])
        return any(b - a < 4 * ALONE_MOST and _BLOB_LINE.fullmatch(self.text[a:b].strip()) for a, b in around)


def _tail(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).strip("_-$").lower()


def _made_of_words(value: str) -> bool:
    """Whether most letters of a value stand in words of one case, as in identifiers, file names and slugs."""
    parts = [x for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if x]
    words = sum(len(x) for x in parts if len(x) >= 3 and _SPOKEN.fullmatch(x))
    return words >= 0.5 * sum(map(len, parts))


def random_spans(text: str, path: str | None = None):
    """The method: (start, end) of quoted strings and long tokens with the entropy of random text of their alphabet and length.

    Left out are digests (hexadecimal text, names of digests and ids), identifiers and words, placeholders, encoded data
    (marked as such or in blocks of lines) and parts of paths.  No name has to announce a credential.
    """
    context, last = _Context(text), 0
    for group in _literals(text, lexing.language_of(path, text)):
        before, last = last, group[0].start
        body = "".join(p.text for p in group)
        if len(body) < ALONE_LETTERS or "base64," in body:
            continue
        whole = _TOKENISH.match(body.strip()) is not None
        for m in _LONG.finditer(body):
            v = m.group().strip("-=./~_")
            at = m.start() + m.group().find(v)
            if len(v) < ALONE_LETTERS or len(v) > ALONE_MOST or not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search(r"\d.*\d", v)):
                continue
            if _HEX.match(v) or _UUID.match(v) or not _BARE.fullmatch(v) or _PLACEHOLDER.search(v) or _made_of_words(v) or body[at - 1 : at] in ("/", "@", ":", "#", "%", "\\"):
                continue
            if not is_random(v, ALONE):
                continue
            start, end = _offset(group, at), _offset(group, at + len(v) - 1) + 1
            name = _tail(context.name(before, group[0].start)) if whole else ""
            if (name and _HASH_NAME.match(name)) or context.in_blob(start, end):
                continue
            yield start, end


def random_values(text: str, path: str | None = None) -> list[Secret]:
    """The places that the method alone finds, in order."""
    return _ordered(text, list(random_spans(text, path)))


def _named_spans(text: str, path: str | None) -> list[tuple[int, int]]:
    """What names, flags, headers and fences announce, whatever its entropy."""
    keys = [m.span() for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else []
    spans = list(keys)
    context, begun = _Context(text), 0
    for group in _literals(text, lexing.language_of(path, text)):
        first, last = group[0], group[-1]
        before, begun = begun, first.start
        body = first.text if len(group) == 1 else "".join(p.text for p in group)
        if len(body) < 6 or _meets(keys, first.start, last.end):
            continue
        if first.kind == "comment":
            inner = [*_within(body), *_inline(body)]
            spans += [(first.start + a, first.start + b) for a, b in inner]
            continue
        inner = list(_within(body))
        if inner:
            spans += [(first.start + a, first.start + b) for a, b in inner] if len(group) == 1 else [(first.start, last.end)]
            continue
        if len(group) == 1 and "\n" in body:
            for a, b in _inline(body):
                spans.append((first.start + a, first.start + b))
            continue
        if " " in body.strip():
            spans += [(_offset(group, a), _offset(group, b - 1) + 1) for a, b in _inline(body)]
            continue
        if judge(body, context.name(before, first.start), context.hinted(last.end)):
            spans.append((first.start, last.end))
    return spans


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and apart, overlaps another one."""
    k = bisect_left(spans, (end,)) - 1
    return k >= 0 and spans[k][1] > start


def secrets(text: str, path: str | None = None) -> list[Secret]:
    """Every place of a credential in ``text``, in order, without overlaps.

    What the method finds by entropy, and what a name, header, URL or private-key fence announces though a person chose
    it, so that its entropy is that of words.
    """
    named = _named_spans(text, path)
    found = _ordered(text, named)
    apart = [(s.start, s.end) for s in found]
    alone = [x for x in random_spans(text, path) if not _meets(apart, *x)]
    return _ordered(text, named + alone) if alone else found


def _ordered(text: str, spans: list[tuple[int, int]]) -> list[Secret]:
    out: list[Secret] = []
    line, seen = 1, 0
    for a, b in sorted(spans):
        if out and a < out[-1].end:
            continue
        probe = text[a:b].split("\n", 1)[0].rstrip("\r").rstrip("\"'` +(\\")
        line, seen = line + text.count("\n", seen, a), a
        out.append(Secret(a, b, line, probe))
    return out


def _starts(secret: Secret, text: str, code: str):
    """Offsets in ``code`` at which the same value begins."""
    at = code.find(secret.probe)
    follow = text[secret.start : secret.end].split("\n")[1:2]
    follow = follow[0].strip() if follow else ""
    while at >= 0:
        if not secret.probe.startswith("-----BEGIN") or follow in code[at : at + len(secret.probe) + len(follow) + 40]:
            yield at
        at = code.find(secret.probe, at + len(secret.probe))


def _places(secret: Secret, text: str, code: str) -> list[int]:
    """Lines of ``code`` on which the same value begins."""
    return [code.count("\n", 0, at) + 1 for at in _starts(secret, text, code)]


def _copies(secret: Secret, text: str, code: str):
    """(start, end) of the whole value in ``code``, whose lines may be indented otherwise or hold only a part of it."""
    first, *rest = (ln.rstrip("\r") for ln in text[secret.start : secret.end].split("\n"))
    for at in _starts(secret, text, code):
        end = at + len(first if code.startswith(first, at) else secret.probe)
        for ln in rest:
            m = re.compile(r"[ \t\r]*\n[ \t]*" + re.escape(ln.strip())).match(code, end)
            if not m:
                break
            end = m.end()
        yield at, end
    for ln in rest:  # where the code begins within the value
        part = ln.strip(" \t\"'`+()\\#/*")
        if len(part) >= 16 and not part.startswith("-----") and " " not in part:
            yield from ((m.start(), m.end()) for m in re.finditer(re.escape(part), code))


def secrets_of_code(found: list[Secret], text: str, code: str) -> list[Secret]:
    """The places in ``code`` of the values found in ``text``, in order, those that overlap as one."""
    out: list[Secret] = []
    for a, b in sorted(x for s in found for x in _copies(s, text, code)):
        if out and a < out[-1].end:
            out[-1] = out[-1]._replace(end=max(b, out[-1].end))
        else:
            out.append(Secret(a, b, code.count("\n", 0, a) + 1, code[a:b].split("\n", 1)[0]))
    return out


def _found(file_id, path, text, comments):
    for s in secrets(text, path):
        yield file_id, 0, s.line
        for c in comments or ():
            if c and c["prompt_code"] and c["start_line"] is not None:
                for line in _places(s, text, c["prompt_code"]):
                    yield file_id, c["start_line"], line


# What stays of a private key (fences, its headers, escapes, prefixes of literals), else a run of its value.
_PEM_BODY = re.compile(r"(-----(?:BEGIN|END)[A-Z0-9 ]*-----|\b(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\n\"'`\\]*|\\.|(?<![\w+/=])[bBrRuUfF]{1,2}(?=[\"']))|[+/]*[A-Za-z0-9][A-Za-z0-9+/]*={0,2}")


def redact(text: str, found: list[Secret]) -> str:
    """``text`` with only the values replaced; quotes, line ends and private-key fences stay."""
    out, at = [], 0
    for s in found:
        out.append(text[at : s.start])
        value = text[s.start : s.end]
        if value.startswith("-----BEGIN"):
            value = _PEM_BODY.sub(lambda m: m.group() if m.group(1) else MASK, value)
        elif re.search(r"[\"'`]\s*(?:\+\s*)?[bBrRuUfF]{0,2}[\"'`]", value):
            value = re.sub(r"(^|[\"'`])([^\"'`\s+][^\"'`]*)(?=[\"'`]|$)", rf"\g<1>{MASK}", value)
        else:
            value = MASK
        out.append(value)
        at = s.end
    return "".join(out) + text[at:]


def _redacted(file_id, path, text):
    found = secrets(text, path)
    if found:
        yield file_id, len(found), redact(text, found)


def _redacted_comments(file_id, path, text, comments):
    found = secrets(text, path) if text is not None else []
    for pos, c in enumerate(comments or ()):
        code = c and c["prompt_code"]
        if not code:
            continue
        places = secrets_of_code(found, text, code) if text is not None else secrets(code, path)
        if places:
            yield file_id, pos, c["start_line"], len(places), redact(code, places)


def _files(dataset: DataFrame, *extra) -> DataFrame:
    return dataset.select("file_id", "new_path", "source_code", *extra).where(F.col("file_id").isNotNull() & F.col("source_code").isNotNull())


def _slim():
    return F.transform("target_comments", lambda c: F.struct(c["start_line"].alias("start_line"), c["prompt_code"].alias("prompt_code"))).alias("comments")


def credential_places(dataset: DataFrame) -> DataFrame:
    """(file_id, comment_line, line_no): see the statement of the problem; ``comment_line`` 0 is the file itself."""
    return flat_map(_files(dataset, _slim()), _found, "file_id long, comment_line int, line_no int").distinct()


def redacted_sources(dataset: DataFrame) -> DataFrame:
    """(file_id, n_secrets, source_code) of each file with credentials, its values replaced."""
    return flat_map(_files(dataset), _redacted, "file_id long, n_secrets int, source_code string").dropDuplicates(["file_id"])


def redacted_comments(dataset: DataFrame) -> DataFrame:
    """(file_id, pos, comment_line, n_secrets, prompt_code) of each target comment whose prompt code holds credentials of its file.

    ``pos`` is the place in ``target_comments``, from 0.  A prompt code without a source text is searched itself.
    """
    held = dataset.select("file_id", "new_path", "source_code", _slim()).where(F.col("file_id").isNotNull() & (F.size("comments") > 0))
    schema = "file_id long, pos int, comment_line int, n_secrets int, prompt_code string"
    return flat_map(held, _redacted_comments, schema).dropDuplicates(["file_id", "pos"])


def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line_no) of what the entropy of quoted strings and long tokens tells by itself."""

    def found(file_id, path, text):
        for s in random_values(text, path):
            yield file_id, s.line

    return flat_map(_files(table(spark, sf_dir, "dataset")), found, "file_id long, line_no int").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_places(table(spark, sf_dir, "dataset"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_sources(table(spark, sf_dir, "dataset"))


def p4_redacted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_comments(table(spark, sf_dir, "dataset"))


QUERIES = {"p4_method": p4_method, "p4_found": p4_found, "p4_redacted": p4_redacted, "p4_redacted_comments": p4_redacted_comments}
