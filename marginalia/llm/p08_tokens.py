"""Problem 8: encoding of the whole corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern.  The new distinct words of a batch are encoded together by
merge replay: an inverted index leads from each merge's rank to the positions where its pair stands, merges are
applied in rank order over all words at once, and only the touched neighbours are entered anew.  A word is encoded
once per worker; as no word's result depends on another's, partitions need no exchange.

Defined cases: null and empty texts give the empty list; text that looks like a special token is plain text; very
long texts and words are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.session import widen

from .common import table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MAX_WORDS, MAX_PAIRS = 1_000_000, 2_000_000  # that a worker remembers


def read_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    """The vocabulary file: a line per token, its bytes in base64 and its rank, which is also its id."""
    return Path(folder, name).read_bytes()


class MergeReplay:
    """Encodes many words at once; ``ranks`` maps a token's bytes to its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], int | None] = {}

    def _rank(self, left: int, right: int) -> int | None:
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
        return self.pairs[key]

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        token: list[int] = []
        starts: list[int] = []
        single: dict[int, tuple[int, ...]] = {}
        for k, word in enumerate(words):
            starts.append(len(token))
            whole = self.ranks.get(word)
            if whole is not None:
                single[k] = (whole,)
            else:
                token.extend(self.ranks[word[i : i + 1]] for i in range(len(word)))
        n = len(token)
        starts.append(n)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts:
            if s < n:
                before[s] = -1
            if s:
                after[s - 1] = n
        index: dict[int, list[int]] = {}
        for i in range(n):
            if after[i] < n:
                rank = self._rank(token[i], token[after[i]])
                if rank is not None:
                    index.setdefault(rank, []).append(i)
        queue = list(index)
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            rank = heapq.heappop(queue)
            for i in sorted(index.pop(rank, ())):
                j = after[i]
                if gone[i] or j >= n or self._rank(token[i], token[j]) != rank:
                    continue
                token[i] = rank
                gone[j] = 1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left >= 0 and right < n:
                        new = self._rank(token[left], token[right])
                        if new is not None:
                            if new not in index:
                                index[new] = []
                                heapq.heappush(queue, new)
                            index[new].append(left)
        out = []
        for k in range(len(words)):
            out.append(single.get(k) or tuple(token[i] for i in range(starts[k], starts[k + 1]) if not gone[i]))
        return out


class Encoder:
    """Texts to ids; remembers the words it has met."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.replay = MergeReplay(ranks)
        self.known: dict[str, tuple[int, ...]] = {}

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """The ids of each text, word by word."""
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        cut = [PATTERN.findall(t) if t else [] for t in texts]
        new = sorted(set(chain.from_iterable(cut)) - self.known.keys())
        if new:
            self.known.update(zip(new, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        known = self.known
        return [[known[w] for w in words] for words in cut]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    got = _ENCODERS.get(shared.id if hasattr(shared, "id") else 0)
    if got is None:
        got = Encoder(shared.value)
        _ENCODERS.clear()
        _ENCODERS[shared.id if hasattr(shared, "id") else 0] = got
    return got


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, ids: bool = True, step: int = 2000) -> DataFrame:
    """(doc_id, ids) of each document; with ``ids`` false (doc_id, n_tokens).  The vocabulary file is under 1 MB."""
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizers))

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = encoder.batch(part.column(1).to_pylist())
                flat = [list(chain.from_iterable(r)) for r in rows]
                if ids:
                    offsets = np.zeros(len(flat) + 1, np.int32)
                    np.cumsum([len(r) for r in flat], out=offsets[1:])
                    values = pa.array(np.fromiter(chain.from_iterable(flat), np.int32, int(offsets[-1])))
                    result = pa.ListArray.from_arrays(pa.array(offsets), values)
                else:
                    result = pa.array([len(r) for r in flat], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), result], names=["doc_id", "ids" if ids else "n_tokens"])

    return widen(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>" if ids else "doc_id long, n_tokens long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
