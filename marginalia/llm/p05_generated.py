"""Problem 5: generated, minified or vendored source files.

The method: phrases of notices in a file's header (comments and docstring before the first statement) are found by a
multi-pattern automaton, and each hit is held against the words around it, so that only a statement about the file
itself counts; paths are judged by rules for vendored directories, generator suffixes, lockfiles and minified names.
``p5_method`` is that and no more.  Minified code without a telling name and data without logic carry neither notice
nor path, so the method cannot find them: ``reason`` goes on to judge such files by shape (lines too long and dense to
be written by hand, lines that repeat a few token shapes, literals without logic).  A notice further down, such as a
template that writes one, counts for nothing.

Defined cases: null ids, texts or paths and extensions other than .py and .js give no rows; an empty file is
hand-written; rows delivered twice count once.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_map, sources, table

# What notices say, by how much else they need, and names of directories that hold others' code.
NOTICES = {
    # enough by themselves
    "alone": (
        "@generated", "auto-generated file", "autogenerated file", "auto generated file", "automatically generated file", "automatically generated code", "code generated by", "generated file", "generated code",
        "machine-made", "machine-generated", "machine generated", "自动生成", "自動生成", "자동 생성", "请勿修改", "請勿修改", "編集しないで", "수정하지 마",
    ),
    # forbid editing: nothing but the file may be meant
    "command": (
        "do not edit", "do not modify", "do not change", "don't edit", "don't modify", "ne pas modifier", "ne pas éditer", "ne pas editer", "nicht bearbeiten", "nicht ändern", "nicht aendern", "no editar", "no modificar",
        "não editar", "nao editar", "não modifique", "nie edytować", "nie edytowac", "düzenlemeyin", "duzenlemeyin", "не редактировать",
    ),
    # say where it comes from: at the beginning of a line, or of this file
    "origin": (
        "generated by", "generated from", "generated with", "generated using", "generated automatically", "auto-generated", "autogenerated", "auto generated", "automatically generated", "automatically produced", "automatically created",
        "genere automatiquement", "généré automatiquement", "automatisch erzeugt", "automatisch generiert", "generado automáticamente", "generado automaticamente", "gerado automaticamente", "wygenerowano automatycznie", "otomatik olarak oluşturul", "сгенерирован",
    ),
    # the same, of words that people use of their own work too: a tool with its version, or the file it was made from, has to follow
    "made": ("created by", "built by", "built from", "produced by", "produced from", "written by", "made by", "made from", "compiled by", "compiled from", "emitted by", "derived from"),
    "vendored": ("vendored from", "vendored copy", "bundled copy of", "bundled from", "copied verbatim from", "send changes upstream", "do not patch here", "third-party copy of", "third party copy of"),
    # with a line of name and version
    "banner": ("contributors", "license", "licence", "copyright", "(c)"),
}
VENDORED_DIRS = frozenset("vendor vendors vendored _vendor _vendored third_party third-party thirdparty 3rdparty external externals extern externs deps node_modules bower_components jspm_packages site-packages dist-packages".split())
GENERATED_DIRS = frozenset("gen generated __generated__ _generated autogen _autogen".split())
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?|_pb|_stubs?|_generated|[._-]gen(?:erated)?|\.g|_auto_[0-9a-z]+)\.(?:py|js)$|(?:^|/)migrations/\d{4}_auto")
_LOCK_NAME = re.compile(r"(?i)(?:^|[.\-_])(?:lock|lockfile|shrinkwrap)\.(?:py|js)$")
_MIN_NAME = re.compile(r"(?i)[.\-_]min(?:\.\w+)?\.js$|[.\-]bundle(?:\.\w+)?\.js$|[.\-]packed\.js$|[.\-]chunk\.js$")

_AUTOMATON = ahocorasick.Automaton()
for _kind, _phrases in NOTICES.items():
    for _phrase in _phrases:
        _AUTOMATON.add_word(_phrase, (_kind, len(_phrase)))
_AUTOMATON.make_automaton()
_SELF = re.compile(r"\b(?:this|the) (?:file|module|code|script|source|header|stub|package|document)\b|\b(?:fichier|datei|archivo|arquivo|fichero|plik|dosya|файл)\b|文件|ファイル|파일")
_COMMANDED = re.compile(r"\s*(?:$|[\n.!;:,)\]*/#\-—–\"']|(?:by hand|manually|directly|it\b|this\b|here\b|the file|bu dosya|вручную|manuell|von hand|à la main))")
_TOOL = re.compile(r"\s+(?:the\s+)?[\w.\-/]*(?:\s+v?\d+(?:\.\d+)+|\s+(?:compiler|generator|tool|script)\b|\.\w{1,8}\b)|\s+(?:the\s+)?\w+\s+(?:compiler|generator)\b")
_HOLDER = re.compile(r"copyright\W+(?:\(c\)\W+)?(?:\d{4}(?:-\d{4})?,?\s+)?(?:by\s+)?(?:the\s+)?([\w.\-]+) (?:contributors|authors|developers|project|team)\b")
_LINE_MARKS = " \t#*/!\"'-:;|<>.\r\ufeff"

_HEADER = {
    "py": re.compile(r'(?:﻿|[ \t\r\f]*\n|[ \t]*#[^\n]*(?:\n|\Z)|[rRuU]?"""(?:[^"\\]|\\.|"(?!""))*"""|[rRuU]?\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')*'),
    "js": re.compile(r"(?:﻿|\s|//[^\n]*(?:\n|\Z)|/\*.*?\*/|(['\"])use strict\1;?)*", re.S),
}
_STRINGS = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|`(?:[^`\\]|\\.)*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_COMMENTS = {"py": re.compile(r"#[^\n]*"), "js": re.compile(r"//[^\n]*|/\*.*?\*/", re.S)}
_LOGIC = re.compile(r"\b(?:def|class|if|elif|while|return|lambda|with|try|function|switch|raise|throw|assert|yield|await|print)\b|=>|\w\(|\bfor\b|#include|\{ return")
_NUMBER = re.compile(r"[-+]?(?:0[xXbBoO])?\b[0-9][0-9a-fA-F_.]*(?:[eE][-+]?\d+)?")
_WORD = re.compile(r"[^\W\d]\w*|\d[\w.]*")
_VERSION_BANNER = re.compile(r"(?m)^\s*(?:#|//|/?\*+!?)\s*(?:@(?:license|preserve)\s+)?([\w.\-]+) v?\d+\.\d+(?:\.\d+)*\s*(?:\||$|\*/|\r)")


def notice(header: str, repo: str | None = None, folders: frozenset[str] = frozenset()) -> str | None:
    """What a header says about its file: generated, vendored or nothing.

    ``repo`` is the repository's own name; a holder of rights after whom one of the file's folders is named is another.
    """
    header = header.lower()
    found = None
    for last, (kind, size) in _AUTOMATON.iter(header):
        begin, end = last + 1 - size, last + 1
        word = header[begin].isalnum() and begin and header[begin - 1].isalnum() or header[last].isalnum() and header[end : end + 1].isalnum() and header[last].isascii()
        if word and kind != "origin":
            continue  # within a longer word; word stems of other languages stand under origin
        line = header[header.rfind("\n", 0, begin) + 1 : begin]
        first = not line.strip(_LINE_MARKS) or line.rstrip(" ").endswith("*/") or line.rstrip().endswith("//")
        about = first or bool(_SELF.search(line))
        if kind == "alone" or (kind == "command" and _COMMANDED.match(header, end)) or (kind == "origin" and about) or (kind == "made" and about and _TOOL.match(header, end)):
            return "generated"
        if kind == "vendored":
            found = "vendored"
        elif kind == "banner" and found is None:
            named = _VERSION_BANNER.search(header) or _HOLDER.search(header)
            if named and not _own(named.group(1), repo) and (named.re is _VERSION_BANNER or named.group(1) in folders):
                found = "vendored"
    return found


def _own(name: str, repo: str | None) -> bool:
    """Whether a banner names the repository it stands in."""
    plain = lambda x: re.sub(r"[\W_]|\.?js$", "", x.lower())
    return bool(repo) and plain(name) in (plain(part) for part in repo.split("/"))


def _minified(text: str) -> bool:
    lines = [ln for ln in text.split("\n") if ln.strip()]
    if not lines:
        return False
    long = [ln for ln in lines if len(ln) > 250 or (len(ln) > 80 and ln.count(";") >= 5)]
    if sum(map(len, long)) < 0.6 * sum(map(len, lines)) or not long:
        return False
    code = _STRINGS.sub('""', " ".join(long))
    if len(code) < 150:
        return False
    blank = sum(c in " \t" for c in code) / len(code)
    joined = code.count(";") / len(code)  # statements that share a line
    return (blank < 0.16 and joined + (code.count("{") + code.count(",")) / len(code) > 0.02) or (blank < 0.28 and joined > 0.02)


def _mostly_data(text: str, ext: str) -> bool:
    body = _STRINGS.sub(lambda m: "§" * len(m.group()), text)
    body = _COMMENTS[ext].sub("", body)
    size = len("".join(body.split()))
    if size < 200:
        return False
    body = re.sub(r"(?m)^[ \t]*(?:import|from|export default|module\.exports)\b[^\n({\[]*", "", body)
    if _LOGIC.search(re.sub(r"\b(?:bytes|bytearray|frozenset|set|dict|tuple|list|b64decode|fromhex|freeze|Uint8Array|Float32Array|array)\(", "", body)):
        return False
    literal = body.count("§") + sum(len(m.group()) for m in _NUMBER.finditer(body.replace("§", "")))
    punctuation = len(re.findall(r"[\[\](){},:;=\s]", body))
    return literal >= 0.55 * (len(body) - punctuation) and literal >= 150


def _repetitive(text: str, ext: str) -> bool:
    """A handful of token shapes make up nearly all statements, numbered or listing fields."""
    lines = [ln.strip() for ln in _COMMENTS[ext].sub("", text).split("\n")]
    lines = [ln for ln in lines if len(ln) > 3]
    if len(lines) < 8 or (ext == "py" and sum(ln.endswith((";", "}", "fi")) for ln in lines) > 0.3 * len(lines)):
        return False  # too short, or another language under this extension
    shapes = Counter(_WORD.sub("w", _STRINGS.sub("s", ln)).replace(" ", "") for ln in lines)
    top = shapes.most_common(2)
    share = sum(n for _, n in top) / len(lines)
    numbers = sum(len(_NUMBER.findall(ln)) for ln in lines) / len(lines)
    return share >= 0.75 and top[0][1] >= 5 and numbers >= 0.5 and len(top[0][0]) >= 10


def named_reason(path: str, text: str, repo: str | None = None) -> str | None:
    """The method: by its notice and path, why a file is not hand-written source of its repository."""
    ext = path.rpartition(".")[2].lower()
    if ext not in ("py", "js") or not text.strip():
        return None
    *folders, name = path.split("/")
    folders = {f.lower() for f in folders}
    if folders & VENDORED_DIRS:
        return "vendored"
    said = notice(_HEADER[ext].match(text).group(), repo, frozenset(folders))
    if said:
        return said
    if _MIN_NAME.search(name):
        return "minified"
    return "generated" if folders & GENERATED_DIRS or _GENERATED_NAME.search(path) or _LOCK_NAME.search(name) else None


def reason(path: str, text: str, repo: str | None = None) -> str | None:
    """``named_reason``, or what the shape of the text shows where notice and path say nothing."""
    named = named_reason(path, text, repo)
    ext = path.rpartition(".")[2].lower()
    if named or ext not in ("py", "js") or not text.strip():
        return named
    if _minified(text):
        return "minified"
    if _mostly_data(text, ext):
        return "data"
    return "generated" if _repetitive(text, ext) else None


def _judge(file_id, repo_name, path, text):
    why = reason(path, text, repo_name)
    if why:
        yield file_id, repo_name, why


def _judge_by_name(file_id, repo_name, path, text):
    why = named_reason(path, text, repo_name)
    if why:
        yield file_id, repo_name, why


def _paths(df: DataFrame) -> DataFrame:
    return df.where(F.col("new_path").rlike(r"(?i)\.(?:py|js)\z"))


def not_handwritten(dataset: DataFrame) -> DataFrame:
    """(file_id, repo_name, reason): generated, minified, vendored or data."""
    return flat_map(_paths(sources(dataset, "repo_name")), _judge, "file_id long, repo_name string, reason string").dropDuplicates(["file_id"])


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, reason): what notices and paths tell by themselves."""
    rows = _paths(sources(table(spark, sf_dir, "dataset"), "repo_name"))
    return flat_map(rows, _judge_by_name, "file_id long, repo_name string, reason string").select("file_id", "reason").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(sources(table(spark, sf_dir, "dataset"), "repo_name"))
    return flat_map(rows, _judge, "file_id long, repo_name string, reason string").select("file_id").distinct()


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_name, reason, n_files)."""
    return not_handwritten(table(spark, sf_dir, "dataset")).groupBy("repo_name", "reason").agg(F.count("*").alias("n_files"))


def p5_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id) of the .py and .js files that remain, those without text aside."""
    dataset = table(spark, sf_dir, "dataset")

    def keep(file_id, repo_name, path, text):
        if reason(path, text, repo_name) is None:
            yield (file_id,)

    return flat_map(_paths(sources(dataset, "repo_name")), keep, "file_id long").distinct()


QUERIES = {"p5_method": p5_method, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_handwritten": p5_handwritten}
