"""Languages of mixed-language spans: per-word scores, a switching penalty, and the best segmentation.

``fit`` learns the words of each language that is written in Latin letters from a bounded sample of documents with a
language label; scripts of one language each speak for themselves.  ``Model.segments`` runs a Viterbi search over the
words of a span: every word scores for every language, entering another language than English and each change cost
``SWITCH``, and the assignment of greatest total score is returned as runs.  A run too few of whose words its
language knows is of ``OTHER`` language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

HIT, SWITCH = 2.0, 4.0
CLIP = 3.0  # a word speaks no stronger than this against a language
UNKNOWN_WEIGHT = 0.4  # of words that no language's sample holds, judged by their letters
MIN_WORDS, MIN_LETTERS = 4, 8
KNOWN_SHARE = 1 / 3
TELLING = 1.0  # a word tells of its language when English is so much less likely
OTHER = "other"
MIN_EVIDENCE = 2  # words that tell of the language, in a run that counts as its prose
PRIOR = 0.001  # share of a language's words that each closed-class word has before any text is seen
# Closed-class words (articles, prepositions, pronouns, conjunctions, auxiliaries, particles).
CLOSED = {
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen und oder aber sondern denn nicht ist sind war waren wird werden wurde wurden hat haben hatte kann können konnte darf dürfen muss müssen soll sollen will "
    "im am um zu zum zur mit ohne von vom für auf aus bei nach vor über unter durch gegen wegen zwischen wenn weil dass damit obwohl sich wir ihr sie es ich er wie was warum wann wo welche dieser diese dieses jeder jede auch nur noch schon sehr als bis",
    "en": "the a an and or but nor not if then else when while so as than because though although since until unless whether of to in on at by for from with without into onto over under about between through during before after above below "
    "against i you he she it we they me him her us them my your his its our their this that these those who whom whose which what where why how is are was were be been being am do does did done has have had having can could will would shall "
    "should may might must cannot there here also only just even still yet too very each every all any some no none both either neither such same other another more most many much few less least own once again instead always never",
    "es": "el la los las un una unos unas y o u pero sino no ni es son era eran está están estaba ha han había hay de del al a en con sin por para según sobre entre hasta desde hacia contra que se su sus lo le les me te nos mi tu este esta estos estas ese esa "
    "eso esto aquel qué quién cuál como cómo cuando cuándo donde dónde porque si sí más menos muy ya todavía también tampoco antes después cada todo toda todos todas otro otra nada nadie algo alguien mismo así",
    "fr": "le la les un une des du de et ou mais ni ne pas est sont était étaient a ont avait être avoir il elle ils elles on nous vous je tu ce cet cette ces ceci cela se sa son ses leur leurs mon ma mes au aux en dans par pour avec sans sur sous entre vers chez "
    "contre selon que qui quoi dont où quand comment pourquoi comme si alors donc car parce plus moins très déjà encore aussi avant après depuis jusque pendant ici tout toute tous toutes rien aucun aucune chaque même y",
    "pl": "i oraz lub albo ale ani nie jest są był była było były być ma mają w we z ze na do od po za przed przez przy pod nad o u dla bez między się to ten ta te tego tej tym tych ich jego jej go mu co kto jak gdy kiedy gdzie dlaczego ponieważ bo że żeby aby "
    "jeśli jeżeli czy już jeszcze tylko też także tutaj tu tam więc dlatego zanim dopóki każdy wszystko nic nikt ktoś coś zawsze nigdy bardzo",
    "pt": "o a os as um uma uns umas e ou mas nem não é são era eram está estão estava foi foram ser ter há de do da dos das ao aos à às em no na nos nas com sem por pelo pela para até sobre entre desde contra que se seu sua seus suas lhe me te nós este esta esse "
    "essa isto isso aquele quem qual como quando onde porque se mais menos muito já ainda também antes depois cada todo toda todos todas outro outra nada ninguém algo alguém mesmo assim",
    "tr": "ve veya ya da de ama fakat ancak değil bir bu şu o ki mi mı mu mü için ile gibi kadar sonra önce daha en çok az her hiç bütün tüm ne neden niye niçin nasıl nerede burada orada şimdi eğer ise yoksa var yok olan olarak ben sen biz siz onlar bunu onun bunun "
    "şey kim hangi çünkü yalnızca sadece hem bazı birçok başka aynı kendi",
}
UNSPACED = frozenset(["zh", "ja", "th"])
#: Parameters of the sample: labelled documents per language, and their greatest length.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 250, 4000

_TOKEN = re.compile(
    r"""(?P<id>(?:https?://|www\.)\S+|(?=[A-Za-z=]*[0-9+/])[A-Za-z0-9+/=]{20,}|[A-Za-z]\w*(?:[_.]\w+)+(?:\(\))?|\w*\d\w*)
    |(?P<la>[A-Za-zª-ɏḀ-ỿ̀-ͯ]+)
    |(?P<cy>[Ѐ-ԯ̀-ͯ]+)|(?P<ar>[ؐ-ؚؠ-ٟٮ-ۓە-ۯݐ-ݿ]+)|(?P<hi>[ऀ-ॣॱ-ॿ‌‍]+)
    |(?P<th>[ก-ฺเ-๎]+)|(?P<ko>[가-힯ᄀ-ᇿ㄰-㆏]+)|(?P<ka>[ぁ-ヿㇰ-ㇿｦ-ﾝ]+)|(?P<ha>[㐀-䶿一-鿿豈-﫿々]+)""",
    re.X | re.A,
)
_SCRIPT = {
    "cy": {"ru": HIT}, "ar": {"ar": HIT}, "hi": {"hi": HIT}, "th": {"th": HIT}, "ko": {"ko": HIT},
    "ka": {"ja": 2 * HIT, "zh": -HIT}, "ha": {"zh": HIT, "ja": HIT - 0.5},
}
_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ı": "i", "ł": "l"})
_RUN_SCRIPTS = frozenset(["th", "ka", "ha"])  # a token of these is a run of many words


_LETTER, _LATIN_LETTER = re.compile(r"[^\W\d_]"), re.compile("[A-Za-z\u00aa-\u024f]")


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _spellings(word: str) -> set[str]:
    """The word without its accents, and with umlauts spelled out, where that differs."""
    return {_bare(word).replace("ı", "i").replace("ł", "l").replace("ß", "ss"), _bare(word.translate(_SPELLED))} - {word}


class Run(NamedTuple):
    """``words`` counts the run's words, ``letters`` its letters; ``start`` and ``end`` are offsets in the span.

    ``evidence`` counts the words, single letters aside, that tell of the language, ``known`` those it knows.
    """

    lang: str
    start: int
    end: int
    words: int
    letters: int
    evidence: int
    known: int


class _Letters:
    """Likelihood of a word by its letters: trigrams backed by pairs, letters and a constant."""

    def __init__(self, words: Iterable[str]) -> None:
        self.counts: list[Counter] = [Counter(), Counter(), Counter()]
        self.contexts: list[Counter] = [Counter(), Counter(), Counter()]
        for w in words:
            for a, b, c in self._grams(w):
                for n, (context, gram) in enumerate((("", c), (b, b + c), (a + b, a + b + c))):
                    self.counts[n][gram] += 1
                    self.contexts[n][context] += 1

    @staticmethod
    def _grams(word: str):
        padded = f"  {word} "
        return zip(padded, padded[1:], padded[2:])

    def log(self, word: str) -> float:
        total = 0.0
        for a, b, c in self._grams(word):
            p = 1 / 60
            for n, (context, gram) in enumerate((("", c), (b, b + c), (a + b, a + b + c))):
                p = (self.counts[n][gram] + 5 * p) / (self.contexts[n][context] + 5)
            total += math.log(p)
        return total


class Model:
    """Word scores of the languages in Latin letters; English is always among them."""

    def __init__(self, texts: Iterable[tuple[str, list[str]]]) -> None:
        """``texts`` has a language and the Latin words, in lower case, of each text to learn from."""
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, words in texts:
            counts[lang].update(words)
        for lang in [x for x in counts if sum(counts[x].values()) < 20 and x != "en"]:
            del counts[lang]
        counts["en"] += Counter()
        for lang, c in counts.items():
            share = max(1.0, PRIOR * sum(c.values()))
            for w in set(CLOSED.get(lang, "").split()):
                c[w] += share
        spelled = {lang: Counter(c) for lang, c in counts.items()}
        for lang, c in counts.items():
            for w, n in c.items():
                for other in _spellings(w):
                    spelled[lang][other] += n / 2
        self.langs = sorted(counts)
        self.english = self.langs.index("en")
        letters = {lang: _Letters(w for w, n in spelled[lang].items() if n >= 1) for lang in self.langs}
        self.letters = [letters[lang] for lang in self.langs]
        totals = [sum(spelled[lang].values()) or 1.0 for lang in self.langs]
        self.known: dict[str, int] = {}  # bits of the languages that know a word
        self.scores: dict[str, tuple[float, ...]] = {}
        everything = set().union(*spelled.values())
        for w in everything:
            n = [spelled[lang][w] for lang in self.langs]
            by_letters = [x.log(w) for x in self.letters]
            logs = [math.log((k + 0.02 * math.exp(b)) / t) if k else max(b, -30.0) + math.log(0.02 / t) for k, b, t in zip(n, by_letters, totals, strict=True)]
            top = max(logs)
            self.scores[w] = tuple(max(-CLIP, x - top) for x in logs)
            rate = [k / t for k, t in zip(n, totals, strict=True)]
            self.known[w] = sum(1 << i for i, r in enumerate(rate) if r and r >= 0.01 * max(rate))

    def score(self, word: str) -> tuple[float, ...]:
        """For each language how much less likely than in the likeliest a Latin word is, at most CLIP."""
        got = self.scores.get(word)
        if got is None:
            logs = [x.log(word) for x in self.letters] if len(word) <= 40 else [0.0] * len(self.langs)
            top = max(logs)
            got = tuple(max(-CLIP, x - top) * UNKNOWN_WEIGHT for x in logs)
            if len(self.scores) < 400_000:
                self.scores[word] = got
        return got

    def label(self, words: list[str]) -> str:
        """The language that the words of a whole text speak for most."""
        total = [0.0] * len(self.langs)
        for w, n in Counter(words).items():
            for k, s in enumerate(self.score(w)):
                total[k] += n * s
        return self.langs[max(range(len(total)), key=total.__getitem__)]

    def _words(self, text: str) -> list[tuple[int, int, str, tuple[float, ...] | None, str]]:
        """(start, end, kind, scores, word) of each word; names, numbers and identifiers are left out."""
        out = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "id":
                continue
            word = m.group()
            out.append((m.start(), m.end(), kind, self.score(word.lower()) if kind == "la" else None, word.lower()))
        return out

    def all_english(self, words) -> bool:
        """True only where no segmentation is better than English throughout.

        Another language is entered at least once, for SWITCH, and no word gains more than its best score less that of
        English.
        """
        gain = 0.0
        for _, _, kind, scores, _ in words:
            if kind != "la":
                return False
            gain += max(scores) - scores[self.english]
        return gain < SWITCH

    def segments(self, text: str, shortcut: bool = True) -> list[Run]:
        """The runs of one language in ``text``, in order."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        words = self._words(text)
        if not words:
            return []
        if shortcut and self.all_english(words):
            return self._runs(words, [self.english] * len(words), self.langs)
        langs = [*self.langs, *sorted({lang for w in words if w[2] != "la" for lang in _SCRIPT[w[2]]})]
        size, latin = len(langs), len(self.langs)
        best = [0.0 if k == self.english else -SWITCH for k in range(size)]
        back: list[list[int]] = []
        nowhere = (-CLIP,) * (size - latin)
        for _, _, kind, scores, word in words:
            if kind == "la":
                row = scores + nowhere
            else:
                strength = len(word) / 4 if kind in _RUN_SCRIPTS and len(word) > 4 else 1.0
                own = _SCRIPT[kind]
                row = [(own[lang] * strength if lang in own else -CLIP) for lang in langs]
            top = max(range(size), key=best.__getitem__)
            change = best[top] - SWITCH
            back.append([k if best[k] >= change else top for k in range(size)])
            best = [max(b, change) + r for b, r in zip(best, row, strict=True)]
        k = max(range(size), key=best.__getitem__)
        path = []
        for step in reversed(back):
            path.append(k)
            k = step[k]
        path.reverse()
        return self._runs(words, path, langs)

    def _runs(self, words, path: list[int], langs: list[str]) -> list[Run]:
        runs: list[Run] = []
        at = 0
        while at < len(words):
            lang, begin = path[at], at
            n = evidence = known = 0
            while at < len(words) and path[at] == lang:
                _, _, kind, scores, word = words[at]
                n += len(word)
                if kind != "la":
                    own = _SCRIPT[kind].get(langs[lang], 0) > 0
                    known, evidence = known + own, evidence + own
                elif lang < len(self.langs):
                    mine = self.known.get(word, 0) >> lang & 1
                    known += mine
                    evidence += bool(mine and len(word) > 1 and scores[lang] - scores[self.english] >= TELLING)
                at += 1
            name = langs[lang]
            if at - begin >= MIN_WORDS and known < KNOWN_SHARE * (at - begin):
                name = OTHER
            runs.append(Run(name, words[begin][0], words[at - 1][1], at - begin, n, evidence, known))
        return runs


def _latin_words(text: str) -> list[str]:
    return [m.group().lower() for m in _TOKEN.finditer(unicodedata.normalize("NFC", text)) if m.lastgroup == "la"]


def is_prose(run: Run) -> bool:
    """At least four words, of which some tell of the language, or eight letters in a script that sets no spaces."""
    return run.letters >= MIN_LETTERS if run.lang in UNSPACED else run.words >= MIN_WORDS and (run.evidence >= MIN_EVIDENCE or run.lang == "en")


def train(texts: list[tuple[str, str]]) -> Model:
    """Learns from labelled texts: of the languages mostly written in Latin letters, the texts that are.

    It learns twice, as texts that the first model gives to another language were labelled wrongly.
    """
    latin = [(lang, text) for lang, text in texts if 2 * len(_LATIN_LETTER.findall(text)) > len(_LETTER.findall(text))]
    total, own = Counter(lang for lang, _ in texts), Counter(lang for lang, _ in latin)
    kept = [(lang, _latin_words(text)) for lang, text in latin if 2 * own[lang] > total[lang]]
    first = Model(kept)
    return Model([(lang, words) for lang, words in kept if lang in first.langs and first.label(words) == lang])


def fit(documents: DataFrame, codes: DataFrame) -> Model:
    """Learns from at most SAMPLE_DOCUMENTS texts a language, of at most SAMPLE_CHARS characters, chosen by a hash of their id.

    Labels are brought to the codes' form; others are left out.
    """
    names = {r.lang for r in codes.select("lang").dropna().limit(1000).collect()}  # a fixed parameter table
    lang = F.lower(F.regexp_extract(F.trim("lang"), r"\A[A-Za-z]+", 0))
    rows = documents.select("doc_id", lang.alias("lang"), "text").where(F.col("lang").isin(sorted(names)) & (F.length("text") <= SAMPLE_CHARS))
    counted = {r.lang: r.n for r in documents.select("doc_id", lang.alias("lang")).groupBy("lang").agg(F.count("*").alias("n")).collect() if r.lang in names}
    if not counted:
        return train([])
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(3.0 * SAMPLE_DOCUMENTS / n)) for name, n in sorted(counted.items())))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share)  # texts are moved for these few only
    kept = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).where(F.col("k") <= SAMPLE_DOCUMENTS)
    return train(sorted((r.lang, r.text) for r in kept.select("lang", "text").collect()))
