"""Problem 10: sentence boundaries across languages and scripts.

A text is cut into blocks: headings and list items are one unit each, text in code fences holds none, blank lines
end a paragraph.  In a paragraph a semi-Markov dynamic programme selects whole spans between possible ends: final
marks (with closing quotes) before white space, the final marks of scripts without spaces, and in Thai a space
between Thai letters.  A span is scored as a whole: its length; its closing word and mark; its opening word; the
quotations and brackets it opens, which have to close within it; and the final marks it holds, which cost nothing
inside a quotation or bracket that the span itself closes and are charged otherwise.

The search is linear in the marks (see ``_spans``).  Defined cases: null, empty and blank texts give no rows; an
unclosed fence holds the rest of the text; a quotation of more than ``QUOTE_WORDS`` words counts as unclosed, and
behind it its span heeds no others; offsets count code points; very long texts are treated whole; repeated texts come out per document.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_map, table

# Words before a full stop that end no sentence, those that may, and month names after an ordinal.
NEVER_LAST = frozenset(
    "mr mrs ms dr dra sr sra srta prof st mme mlle mgr hr fr herr frau ing dipl gen col lt sgt rev hon pres "
    "no nos nr núm num nº n° art sec sect fig figs abb tab eq ch chap vol p pp pg pág págs pag s str стр рис см напр г гг т д в ср п пп "
    "cf vgl bkz zob patrz np tj tzn m.in e.g i.e eg ie viz approx aprox ca ca c env etw max min incl inkl vs evtl ggf z u o d sog bspw örn vb ör yy "
    "ex ej ee c.-à-d t.e т.е т.к т.н и.о д-р г-н г-жа проф ул им الخ د أ م डॉ श्री श्रीमती ul godz pt dot al ok tel dept mon tue wed thu fri sat sun jan feb mar apr jun jul aug sept sep oct nov dec".split()
)
MAY_BE_LAST = frozenset("etc usw itd itp al a.m p.m u.s u.k e.u uu jr inc ltd co corp т.д т.п др p.s d.c v.chr n.chr h a m".split())
CAPITAL_ONLY = frozenset("ms hon col fr gen sat sun mar dec jan jun st pres rev mon thu nov oct mm pt".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner maerz".split())

_CLOSERS = "\"'”’»›」』）)]}》〉】“"
_LINE = re.compile(r"[^\n]*\n?")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
_ITEM = re.compile(r"\s*(?:[*+\-•·–]|\d{1,9}[.)]|[a-zA-Z][)])[ \t]+")
_END = re.compile(r"(?:[.!?…؟।॥۔]+)[ \t\xa0]?[»”“’\"')\]）」』›]*(?=\s|$)|[.!?…؟।॥۔]+[»”“’\"')\]」』›]*(?=\s|$)|[。！？｡]+|(?<=[ก-๛])[ \t\xa0\n]+(?=[ก-๛])")
_EMOJI = "[\U0001f000-\U0001faff☀-➿️‍⬀-⯿]"
_NEXT = re.compile(rf"(?:\s|{_EMOJI})*([\"'“„«»‹「『(\[（¿¡—–\-`*_]*)\s?(\w[\w.\-]*|[^\w\s]|$)")
_LAST = re.compile(r"([^\s\"'“„«»(\[（]+)$")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»", "‹": "›", "“": "”", "„": "“"}
_ENDS = {v: k for k, v in _PAIRS.items() if v != "“"}
_DELIMITER = re.compile("[\"`'" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values())) + "]")
# Scores.  A span pays ONE_WORD when it is that short and LONG for each word beyond MANY_WORDS; UNCLOSED when it leaves a
# quotation or bracket open, STRAY when it closes one that another span has opened.
ONE_WORD, LONG, MANY_WORDS = -0.4, -0.3, 80
UNCLOSED, STRAY = -8.0, -4.0
QUOTE_WORDS = 400
WORST = 24.0  # no boundary costs more, a quotation left open by it included


def _events(text: str) -> list[tuple[int, str, str]]:
    """(offset, kind, role) of quotes and brackets: what each may do by the characters beside it.

    Role ``(`` opens, ``)`` closes, ``|`` does either; whether it closes anything is seen within a span.
    """
    found = []
    n = len(text)
    for m in _DELIMITER.finditer(text):
        i = m.start()
        c = text[i]
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if c in '"`':
            opens = (before in " \t\n\xa0(（[「『—–" or not before.isascii()) and i + 1 < n and not after.isspace()
            found.append((i, c, "(" if opens and before.isspace() else "|" if opens else ")"))
        elif c == "'":
            if before in " \t\n\xa0(" and after.isalnum():
                found.append((i, c, "("))
            elif not before.isspace() and not (after.isascii() and after.isalnum()):
                found.append((i, c, ")"))
        elif c == "“":
            found.append((i, c, "|"))
        elif c in _ENDS:
            found.append((i, _ENDS[c], ")"))
        else:
            found.append((i, c, "("))
    return found


def _closing(text: str, begin: int, end: int, word: str) -> float:
    """How well a span ends with the mark at ``begin:end``, by the mark, the word before it and the ``word`` behind."""
    mark = text[begin:end]
    core = mark.rstrip(_CLOSERS + " \t\xa0")
    score = 1.5 if core == "." else 0.5 if core in ("...", "…", "..", "....") else 2.0
    if mark != "." and mark.strip(". \t\xa0\n") or core != ".":
        return score
    last = _LAST.search(text, max(0, begin - 40), begin)
    held = last.group(1) if last else ""
    before = held.lower()
    if re.fullmatch(r"[^\W\d_]", before) and (held.isupper() or before in NEVER_LAST):
        return score - 6.0
    if before in MAY_BE_LAST:
        return score - 1.0
    if (before in NEVER_LAST and not (before in CAPITAL_ONLY and held[0].islower())) or before.endswith("-d"):
        return score - 6.0
    if re.fullmatch(r"[^\W\d_](?:\.[^\W\d_])+", before):
        return score - 2.0
    if before.isdigit() and len(before) <= 2 and word.lower() in MONTHS:
        return score - 8.0
    return score - 3.0 if re.fullmatch(r"\d+|[ivxlc]+", before) and word[:1].islower() else score


def _opening(text: str, mark: str, at: int, opened: str, word: str) -> float:
    """How well a span begins with ``word``, which stands at ``at`` behind the marks ``opened``, after ``mark``."""
    core = mark.rstrip(_CLOSERS + " \t\xa0")
    first = word[:1]
    if not word:
        return 1.0
    if opened[:1] and opened[0] in "—–-" and not first.isupper():
        return -5.0
    if not first.isalnum() and first != "_":
        return -6.0 if first in ",;:.!?)]…»" else -0.5
    if first.islower() and first.lower() != first.upper():
        named = "_" in word or re.match(r"\w+(?:\.\w+|\()", text[at : at + 60]) is not None
        return 0.0 if "`" in opened or (named and core != "...") else -5.0
    if mark.rstrip() != core and first.lower() == first.upper() and not first.isdigit():
        return -3.0  # no case tells whether the clause goes on after the quotation, as it mostly does
    return 1.0


def _gain(text: str, begin: int, end: int) -> float:
    """How well the mark at ``begin:end`` parts two spans by the words on both sides, quotations aside."""
    mark = text[begin:end]
    if mark[0] in "。！？｡":
        return 3.0
    if mark.isspace():
        return 2.0
    if mark.rstrip(_CLOSERS + " \t\xa0") == "…" and end < len(text) and not text[end : end + 1].isspace():
        return -6.0
    m = _NEXT.match(text, end)
    return _closing(text, begin, end, m.group(2)) + _opening(text, mark, m.start(2), m.group(1), m.group(2))


def _length(n: int) -> float:
    return ONE_WORD if n < 2 else LONG * (n - MANY_WORDS) if n > MANY_WORDS else 0.0


class _Quotes:
    """The quotations and brackets of one span, and the final marks they hold."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, float]] = []  # kind, words before it, gains held when it opened
        self.held = 0.0  # gains of the marks inside what is open
        self.lost = 0.0
        self.plain = False  # something was open for too long: nothing opens any more
        self.kinds: Counter[str] = Counter()

    def read(self, kind: str, role: str, words: int) -> None:
        wanted = ("„", "“") if kind == "“" else (kind,)
        if role != "(" and any(self.kinds[w] for w in wanted):
            opened = ""
            while opened not in wanted:
                opened, _, self.held = self.stack.pop()
                self.kinds[opened] -= 1
        elif role == ")":
            self.lost += STRAY * (kind != "'")
        elif not self.plain:
            self.stack.append((kind, words, self.held))
            self.kinds[kind] += 1

    def expire(self, words: int) -> None:
        if self.stack and words - self.stack[0][1] > QUOTE_WORDS:
            self.lost += UNCLOSED - self.held
            self.stack.clear()
            self.kinds.clear()
            self.held, self.plain = 0.0, True

    def cost(self) -> float:
        """Of a span that ends here."""
        return self.lost + (UNCLOSED - self.held if self.stack else 0.0)


def _spans(text: str) -> list[tuple[int, int]]:
    """The sentences of one paragraph as offsets in it: the sequence of spans with the greatest total score.

    From each start, spans are tried up to the first end behind which none can belong to the best sequence: once a
    mark outside the span's quotations gains more than two short spans lose, cutting there is better whatever follows
    (the spans behind it see the same quotations); the same holds for any such mark with enough words on both sides
    of it that the length saved outweighs the worst boundary.
    """
    size = len(text.rstrip())
    marks = [(m.start(), m.end()) for m in _END.finditer(text) if m.end() < size]
    if not marks:
        return [(0, len(text))]
    gains = [_gain(text, a, b) for a, b in marks]
    cuts = [0, *(b for _, b in marks), len(text)]
    last = len(cuts) - 1
    total = [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        total.append(total[-1] + (len(text[a:b].split()) or 1))
    inside: list[list[tuple[int, str, str]]] = [[] for _ in range(last)]
    k = 0
    for event in _events(text):
        while event[0] >= cuts[k + 1]:
            k += 1
        inside[k].append(event)
    apart = int(WORST / -LONG) + MANY_WORDS
    best = [0.0] + [float("-inf")] * last
    back = [0] * (last + 1)
    for i in range(last):
        quotes, held, safe = _Quotes(), 0.0, -1
        for j in range(i + 1, last + 1):
            for _, kind, role in inside[j - 1]:
                quotes.read(kind, role, total[j - 1])
            words = total[j] - total[i]
            quotes.expire(total[j])
            gain = gains[j - 1] if j < last else 0.0
            value = best[i] + _length(words) + quotes.cost() - held + min(0.0, gain)
            if value > best[j]:
                best[j], back[j] = value, i
            if quotes.stack:
                quotes.held += max(0.0, gain)
                continue
            if gain > -2 * ONE_WORD or (safe >= 0 and total[j] - safe >= apart):
                break
            held += max(0.0, gain)
            if safe < 0 and words >= apart:
                safe = total[j]
    out, j = [], last
    while j:
        out.append((cuts[back[j]], cuts[j]))
        j = back[j]
    return out[::-1]


def _blocks(text: str):
    """(start, end, single) of headings, list items and paragraphs."""
    start, end, single = -1, -1, False
    fence = ""
    after_item = True
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        line = text[a:b]
        f = _FENCE.match(line)
        if fence:
            if f and f.group(1)[0] == fence[0] and len(f.group(1)) >= len(fence) and not line[f.end() :].strip():
                fence = ""
            continue
        heading = _HEADING.match(line)
        item = _ITEM.match(line) if (start < 0 or single or after_item) else None
        if f or not line.strip() or heading or item:
            if start >= 0:
                yield start, end, single
            start = -1
            if f:
                fence = f.group(1)
            elif heading:
                yield a + heading.end(), b, True
            elif item:
                start, end, single = a + item.end(), b, True
            after_item = True
            continue
        after_item = False
        if start < 0:
            start, single = a, False
        end = b
    if start >= 0:
        yield start, end, single


def sentences(text: str) -> list[tuple[int, int]]:
    """(start_char, end_char) of every sentence of ``text``, without surrounding blanks."""
    out = []
    for a, b, single in _blocks(text):
        block = text[a:b]
        for s, e in [(0, len(block))] if single else _spans(block):
            piece = block[s:e]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if left < right:
                out.append((a + s + left, a + s + right))
    return out


def _rows(doc_id, text):
    for s, e in sentences(text):
        yield doc_id, s, e


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence."""
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return flat_map(rows, _rows, "doc_id long, start_char int, end_char int")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found}
