"""Problem 7: broken prompt and response pairs.

The method: per comment, one suffix automaton over the words of its prompt is traversed by every answer to measure how
much of it is copied; a refusal automaton, whose hits are held against the words behind them, a delimiter stack,
wrappers left open in the answer or the raw response, and votes of the words' languages tell the other defects.
``p7_method`` is that and no more.  An answer that breaks off between or within words leaves no delimiter open, so the
method cannot see it; ``defective_results`` adds what counts over all answers say: how often a word ends one, and
whether a last word is the beginning of a frequent one.

Defined cases: a null or blank answer is ``empty`` whatever the error; null prompts have nothing to copy; null
ids give no rows; results delivered twice count once; at most one defect per result, in the order empty,
truncated (cut by a limit or inside a wrapper), refusal, copy, other_language, truncated (text); runs of more than
``WORD_LETTERS`` letters are no words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import langid
from .common import flat_map, table

# Phrases by which an answer declines or asks back, by what has to stand behind them for it.
REFUSALS = {
    "": (
        "i am unable", "i'm unable", "i won't be able", "i will not be able", "i am not able", "i'm not able", "unable to comply", "cannot comply", "can't comply", "as a language model", "as an ai", "as a large language", "i'm sorry", "i am sorry",
        "my apologies", "i apologize", "sorry, but", "sorry, no", "sorry, i", "my guidelines", "must decline", "have to decline", "i decline", "respectfully decline", "no answer possible", "no comment possible", "no comment can be given",
        "rather not guess", "leaving this blank", "what i can assist", "not something i can", "not able to comment", "let me know if you need", "let me know what you", "i do not feel comfortable", "against my policy", "request falls outside",
        "lo siento", "je suis désolé", "es tut mir leid", "desculpe", "извините", "我无法", "抱歉", "申し訳", "죄송",
    ),
    "act": ("i cannot", "i can not", "i can't", "can't assist", "cannot assist", "can't help", "cannot help", "no puedo", "je ne peux pas", "ich kann nicht", "ich kann diesen", "não posso", "not be appropriate for me to", "not be appropriate to"),
    "ask": ("could you share", "could you provide", "could you clarify", "can you provide", "can you share", "can you clarify", "please share", "please provide", "please clarify"),
    "lack": ("insufficient context", "not enough context", "not enough information", "lack the context", "don't have enough", "do not have enough", "more context is needed", "need more context", "need more information"),
    "first": ("apologies,", "n/a"),
}
_BEHIND = {
    "act": re.compile(r"\W*(?:(?:possibly|safely|reliably|really|with|you)\W+)*(?:provid|writ|comment|help|assist|describ|document|determin|generat|tell|say|answer|see|giv|complet|do\b|fulfil|explain|summari|judg|produc|creat|suggest|infer|this|that|responder|escribir|écrire|répondre|schreiben|beantworten|escrever)|\W*$"),
    "ask": re.compile(r"\s+(?:me\s+|us\s+)?(?:with\s+)?(?:a\s+bit\s+)?(?:more|some|any|additional|further|the\s+(?:rest|full|whole|complete|missing|entire|surrounding|code|context|file|function|snippet|relevant)|your|context|details|what|which|how)\b"),
    "lack": re.compile(r"\W*(?:$|to\b|for\s+(?:me|this|a)\b|here\b|about\b|of\s+(?:the|this)\b|and\b|context|information|details)"),
}
_REFUSAL = ahocorasick.Automaton()
for _kind, _phrases in REFUSALS.items():
    for _p in _phrases:
        _REFUSAL.add_word(_p, (_kind, len(_p)))
_REFUSAL.make_automaton()

_MARKS = re.compile(r"^[ \t]*(?:#+|//+|/\*+|\*+/?)[ \t]*", re.M)
_BLANK = re.compile(r"[\s ­᠎​-‏ - ⁠-⁤﻿#*/`\"'.\-–—_…<>]+|</?comment>|```\w*", re.I)
_LIMIT = re.compile(r"(?i)limit of \d+|max(?:imum)?[_ ](?:new_)?tokens|token limit|length limit|stopped at|finish_reason.*length|cut off")
_WORD = re.compile(r"[^\W_]+(?:[_'’][^\W_]+)*|[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})", re.M)
_TAG = re.compile(r"^\s*<([A-Za-z][\w-]*)>")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]`]*\s*$")
RUN, COVER = 4, 0.85
WORD_LETTERS = 100
SALTS = 16
NUMBER = "0"
# Shares of their uses in which words that end nothing and words that may end a comment are last, how much likelier the
# former must be, and the share of a word's uses that are cut short within it at the same place.
OPEN_ENDS, WHOLE_ENDS, SURE, CUT_SHARE = 0.01, 0.10, 5, 0.02


class SuffixAutomaton:
    """All runs of words of one text; ``matches`` gives the longest run ending at each word of another."""

    def __init__(self, words: list[str]) -> None:
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for w in words:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, nxt: dict) -> int:
        self.link.append(0)
        self.length.append(length)
        self.next.append(nxt)
        return len(self.link) - 1

    def matches(self, words: list[str]) -> list[int]:
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                state, n = 0, 0
            out.append(n)
        return out


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(_MARKS.sub("", text).lower()) if w not in "#*`"]


def copied_share(automaton: SuffixAutomaton, words: list[str], run: int = RUN) -> tuple[float, float]:
    """Share of ``words`` inside copied runs of at least ``run`` words, and share of the longest run."""
    n = len(words)
    covered, reach = 0, n
    ends = automaton.matches(words)
    for k in range(n - 1, -1, -1):
        if ends[k] >= min(run, n):
            begin = k - ends[k] + 1
            covered += max(0, min(k + 1, reach) - begin)
            reach = min(reach, begin)
    return covered / n, max(ends) / n


def _copies(prompt: tuple[SuffixAutomaton, set[str]], text: str) -> bool:
    words = _words(text)
    if not words:
        return False
    automaton, lines = prompt
    letters = [w for w in words if w[0].isalnum()]
    if len(letters) < RUN:
        return " ".join(words) in lines
    share, longest = copied_share(automaton, words)
    if "\n" not in text.strip():
        return longest == 1.0  # one line: the prompt must hold it whole
    return share >= COVER and longest >= 0.6 or (share >= 0.75 and "\n" in text.strip() and longest >= 0.4)


def _open_wrapper(text: str) -> bool:
    if len(_FENCE.findall(text)) % 2:
        return True
    tag = _TAG.match(text)
    return bool(tag) and f"</{tag.group(1)}>" not in text


def _unbalanced(text: str) -> bool:
    """Whether a delimiter stack ends with something open."""
    stack: list[str] = []
    for c in text:
        if c == "`":
            stack.pop() if stack and stack[-1] == "`" else stack.append(c)
        elif stack and stack[-1] == "`":
            continue
        elif c in "([{":
            stack.append(c)
        elif c in ")]}" and stack:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1 or text.count("“") > text.count("”") or text.count("«") > text.count("»")


def refuses(text: str) -> bool:
    """Whether an answer declines or asks back: a phrase of whole words with what makes it one behind it."""
    plain = text.replace("’", "'").lower()
    for last, (kind, size) in _REFUSAL.iter(plain):
        begin, end = last + 1 - size, last + 1
        latin = plain[begin].isascii()
        if latin and (plain[begin - 1 : begin].isalnum() or (plain[last].isalpha() and plain[end : end + 1].isalnum())):
            continue
        before = plain[:begin].strip(" \t\n#/*\"'`<>")
        if kind == "first":
            rest = plain[end:].lstrip(" ")
            if not before and (not rest.strip() or size > 3 or rest[0] in "-–—.,:;("):
                return True
        elif kind == "lack":
            if _BEHIND[kind].match(plain, end) and (not before or before.endswith(("have", "is", "there is", "a", "-", "–", "—", ":", ",", ".", "with", "i")) or plain[begin:end].startswith(("i ", "need", "don't", "do not", "lack", "more"))):
                return True
        elif not kind or _BEHIND[kind].match(plain, end):
            return True
    return False


def _other_language(text: str, model: langid.Model) -> bool:
    letters = Counter()
    sure = False
    for r in model.segments(text):
        letters[r.lang] += r.letters
        sure |= r.lang not in ("en", langid.OTHER) and (langid.is_prose(r) or (r.lang not in model.langs and r.letters >= 4))
    foreign = sum(n for lang, n in letters.items() if lang not in ("en", langid.OTHER))
    return sure and foreign > letters["en"]


def last_word(text: str) -> str | None:
    """The word an answer ends with, null when it ends with a mark that closes a sentence or is no plain word."""
    text = text.rstrip()
    if not text or _END.search(text):
        return None
    tail = re.search(r"(\S+)$", text).group(1).strip("\"'”’»)]`,;:-")
    if re.fullmatch(r"[\d.,]+", tail):
        return NUMBER
    return tail.lower() if re.fullmatch(r"[A-Za-z]+(?:['’][a-z]+)?", tail) else None


def defect(answer: str | None, error: str | None, prompt: tuple[SuffixAutomaton, set[str]] | None, model: langid.Model, raw: str | None = None) -> str | None:
    """The method: the defect that one result shows by itself; ``None`` leaves whether its text breaks off between words."""
    if answer is None or not _BLANK.sub("", answer):
        return "empty"
    if (error and _LIMIT.search(error)) or _open_wrapper(answer) or (raw and _open_wrapper(raw)):
        return "truncated"
    if refuses(answer):
        return "refusal"
    if prompt is not None and _copies(prompt, answer):
        return "copy"
    if _other_language(answer, model):
        return "other_language"
    return "truncated" if _unbalanced(answer) else None


def _judge(prompt, results, model):
    built = None
    for r in results or ():
        if r is None or r["result_id"] is None:
            continue
        answer = r["comment_text"]
        if built is None and prompt and answer:
            built = (SuffixAutomaton(_words(prompt)), {" ".join(_words(ln)) for ln in prompt.split("\n")})
        found = defect(answer, r["error"], built, model, r["raw_response"])
        yield r["result_id"], found, None if found or answer is None else last_word(answer)


def _comments(generated: DataFrame) -> DataFrame:
    slim = F.transform("c.results", lambda r: F.struct(r["result_id"].alias("result_id"), r["comment_text"].alias("comment_text"), r["raw_response"].alias("raw_response"), r["error"].alias("error")))
    return generated.select(F.explode("comment_generations").alias("c")).select(F.col("c.prompt").alias("prompt"), slim.alias("results"))


def word_ends(generated: DataFrame) -> DataFrame:
    """(word, n, n_last, longer): how often a word occurs and ends an answer, and the count of its most frequent continuation."""

    def count(batches):
        import pyarrow as pa

        total, last = Counter(), Counter()

        def flush():
            words = list(total)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64()), pa.array([last[w] for w in words], pa.int64())], names=["word", "n", "n_last"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [w.lower() if w[0].isalpha() else NUMBER for w in re.findall(r"[A-Za-z]+(?:['’][a-z]+)?|\d[\d.,]*", _MARKS.sub("", text)) if len(w) <= WORD_LETTERS]
                total.update(words)
                # words before a closing mark end a sentence as well as an answer
                ends = re.findall(r"([A-Za-z]+(?:['’][a-z]+)?|\d[\d.,]*\b)[\"'”’»)\]`]*(?:[.!?]|\s*$|\n)", _MARKS.sub("", text))
                last.update(w.lower() if w[0].isalpha() else NUMBER for w in ends if len(w) <= WORD_LETTERS)
            if len(total) > 200_000:
                yield flush()
                total.clear()
                last.clear()
        yield flush()

    # doubled rows would shift the ratios below, so texts are moved to their ids; the count is fixed, as counting costs more than the bytes tell
    results = generated.select(F.explode("comment_generations").alias("c")).select(F.explode("c.results").alias("r")).select("r.result_id", F.col("r.comment_text").alias("t"))
    n_tasks = int(generated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = results.where("result_id IS NOT NULL AND t IS NOT NULL").repartition(n_tasks, "result_id").dropDuplicates(["result_id"]).select("t")
    counts = texts.mapInArrow(count, "word string, n long, n_last long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_last").alias("n_last"))
    longer = counts.where(F.length("word") > 1).select(F.expr("explode(transform(sequence(1, length(word) - 1), k -> substring(word, 1, k)))").alias("begin"), "n")
    longer = longer.groupBy("begin").agg(F.max("n").alias("longer"))
    return counts.join(longer, counts.word == longer.begin, "left").select("word", "n", "n_last", F.coalesce("longer", F.lit(0)).alias("longer"))


def _judged(generated: DataFrame, model: langid.Model) -> DataFrame:
    """(result_id, defect, last) of each result once."""
    shared = generated.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    judge = lambda prompt, results: _judge(prompt, results, shared.value)
    return flat_map(_comments(generated), judge, "result_id long, defect string, last string").dropDuplicates(["result_id"])


def broken_off_words(generated: DataFrame) -> DataFrame:
    """(word): the last words that tell that their answer breaks off."""
    # the likelihood of the word's other uses, were it one that ends no answer or one that may; for many uses the bound is near 4 %
    k = F.greatest(F.col("n_last") - 1, F.lit(0))
    odds = k * math.log(OPEN_ENDS / WHOLE_ENDS) + (F.col("n") - 1 - k) * math.log((1 - OPEN_ENDS) / (1 - WHOLE_ENDS))
    rare_end = odds >= math.log(SURE)
    # a fragment ends as few answers as are cut within the longer word, whoever else uses it; one more is chance
    cut_word = (F.col("longer") >= 4 * F.col("n")) & (F.col("n_last") <= 1 + CUT_SHARE * F.col("longer"))
    return word_ends(generated).where((F.col("n_last") > 0) & (rare_end | cut_word)).select("word")


def defective_results(generated: DataFrame, model: langid.Model) -> DataFrame:
    """(result_id, defect) of each defective result."""
    judged = _judged(generated, model).withColumn("salt", F.pmod(F.xxhash64("result_id"), F.lit(SALTS)).cast("int"))
    # a last word may be that of a third of all results, so words are copied for each salt
    words = broken_off_words(generated).select("word", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # results that need no look-up are most of all; a key of their own keeps them from meeting in one task
    key = F.coalesce("last", F.concat(F.lit("\0"), F.col("result_id").cast("string")))
    broken = judged.join(words.withColumnRenamed("salt", "s"), (key == F.col("word")) & (F.col("salt") == F.col("s")), "left")
    late = F.when(F.col("word").isNotNull(), F.lit("truncated"))
    return broken.select("result_id", F.coalesce("defect", late).alias("defect")).where(F.col("defect").isNotNull())


def fitted(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_codes"))


def p7_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, defect) by the method alone, without counts over other answers."""
    return _judged(table(spark, sf_dir, "generated_scored"), fitted(spark, sf_dir)).where("defect IS NOT NULL").select("result_id", "defect")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_results(table(spark, sf_dir, "generated_scored"), fitted(spark, sf_dir))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(defect, n_results)."""
    return p7_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_results"))


QUERIES = {"p7_method": p7_method, "p7_found": p7_found, "p7_rates": p7_rates}
