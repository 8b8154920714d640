"""Native column expressions on comment and message texts (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that text handling strips, and line ends of a text.
_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Words and prefixes that mark a comment as meant for tools.
DIRECTIVE_WORDS = ("noqa", "nosec", "noinspection", "todo", "fixme", "hack", "xxx")
DIRECTIVE_PREFIXES = ("type", "pragma", "fmt", "isort", "pylint", "ruff", "mypy", "pyright", "doctest")
MISSING_ERROR = "No comment returned and no error recorded"
BLANK_ERROR = "Failed with an empty error message"
REASON_LENGTH = 80


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both ends without blanks of any kind, as Python's ``strip`` sees them."""
    return F.regexp_replace(_col(c), rf"\A{_BLANK}+|{_BLANK}+\z", "")


def lines(c: Column | str) -> Column:
    """The lines of a text; the empty piece after a final line end is no line."""
    parts = F.split(_col(c), _LINE_END)
    return F.when(_col(c) == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normalize_comment(c: Column | str) -> Column:
    """STR-1: per line without its leading ``#`` marks, runs of blanks as one space, lines joined by one."""
    bare = F.transform(lines(c), lambda ln: F.regexp_replace(strip(ln), r"\A#+", ""))
    joined = F.regexp_replace(F.array_join(bare, " "), rf"{_BLANK}+", " ")
    return strip(joined)


def is_directive_line(line: Column) -> Column:
    """FIL-3: shebangs, cell marks, encoding declarations and tool directives."""
    bare = strip(line)
    body = strip(F.regexp_replace(bare, r"\A#+", ""))
    words = rf"(?i)\A(?:(?:{'|'.join(DIRECTIVE_WORDS)})(?![A-Za-z0-9])|(?:{'|'.join(DIRECTIVE_PREFIXES)}):)"
    marked = bare.startswith("#!") | body.startswith("%%") | body.rlike(r"(?i)coding[:=]\s*[-\w.]+") | body.rlike(words)
    return bare.startswith("#") & marked


def is_directive(c: Column | str) -> Column:
    """FIL-4: any line is a directive."""
    return F.exists(lines(c), is_directive_line)


def has_letter(c: Column | str) -> Column:
    """FIL-5."""
    return _col(c).rlike(r"\p{L}")


def is_separator(c: Column | str) -> Column:
    """FIL-6: five equal punctuation marks in a row, ``#`` aside."""
    return _col(c).rlike(r"([^\p{L}\p{N}\s\p{Z}\x{1c}-\x{1f}\x{85}#])\1{4}")


def is_ascii(c: Column | str) -> Column:
    """FIL-7."""
    return _col(c).rlike(r"\A[\x00-\x7F]*\z")


def contains_any(c: Column | str, needles: Sequence[str]) -> Column:
    """FIL-2: whether a text contains one of the markers, case ignored."""
    low = F.lower(_col(c))
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(low, F.lit(needle.lower()))
    return out


def failure_reason(error: Column | str, truncate: bool = True) -> Column:
    """STR-3: the first line of an error with its numbers replaced, so that like failures group together."""
    first = F.element_at(F.split(strip(error), "\n"), 1)
    spaced = strip(F.regexp_replace(first, rf"{_BLANK}+", " "))
    general = F.regexp_replace(spaced, r"\p{Nd}+(?:\.\p{Nd}+)?", "N")
    if truncate:
        short = F.regexp_replace(F.substring(general, 1, REASON_LENGTH), rf"{_BLANK}+\z", "")
        general = F.when(F.char_length(general) <= REASON_LENGTH, general).otherwise(F.concat(short, F.lit("...")))
    return F.when(_col(error).isNull(), MISSING_ERROR).when(spaced == "", BLANK_ERROR).otherwise(general)


def is_failed(error: Column, text: Column, skipped: Sequence[str] = ()) -> Column:
    """FIL-11 and FIL-12: no text, or any error at all; failures whose reason holds a skipped text do not count."""
    failed = error.isNotNull() | text.isNull()
    return failed & ~contains_any(failure_reason(error, truncate=False), skipped) if skipped else failed


def clean_tags(tags: Column | str) -> Column:
    """STR-4: trimmed, lower case, inner blanks as hyphens, empty ones dropped, the first of equals kept."""
    each = F.transform(_col(tags), lambda t: F.regexp_replace(F.lower(strip(t)), rf"{_BLANK}+", "-"))
    return F.array_distinct(F.filter(each, lambda t: t != ""))


def unwrap(c: Column | str, depth: int = 4) -> Column:
    """STR-2: without code fences and tags around the whole text, up to ``depth`` layers; ``unwrap_all`` has no limit."""
    text = strip(c)
    for _ in range(depth):
        fenced = F.regexp_replace(text, r"(?s)\A```[^\n]*\n(.*?)\n?```\z", "$1")
        tagged = F.regexp_replace(text, r"(?s)\A<([A-Za-z][\w-]*)(?:\s[^>]*)?>(.*)</\1>\z", "$2")
        text = strip(F.when(fenced != text, fenced).otherwise(tagged))
    return text


def fill_template(template: str, **values: Column) -> Column:
    """STR-7: placeholders replaced one after another in the order given, so later ones reach into earlier values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def star_cell(value: Column, p_value: Column) -> Column:
    """STR-9: four decimals, a star where p is below 0.05, a dash for none."""
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string("%.4f", value), F.when(p_value < 0.05, "*").otherwise("")))
