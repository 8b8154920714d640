"""Repository search and model completions as sources with an injected transport (SRC-14 to SRC-16, SRC-21, DATE-1)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT_LIMIT = 1000
REPOSITORY = "id long, full_name string, html_url string, default_branch string, size long, stargazers_count long"


@dataclass(frozen=True)
class Slice(InputPartition):
    """Repositories with stars and push dates in closed ranges; an open upper end is null."""

    language: str
    low: int
    high: int | None
    pushed_from: date
    pushed_to: date | None = None

    def text(self) -> str:
        stars = f"stars:{self.low}..{self.high}" if self.high is not None else f"stars:>={self.low}"
        pushed = f"pushed:{self.pushed_from}..{self.pushed_to}" if self.pushed_to else f"pushed:>={self.pushed_from}"
        return f"language:{self.language} {stars} {pushed}"


def halves(s: Slice, today: date) -> list[Slice]:
    """The slice in two: by stars while there are several counts of them, then by push date; none if it is a point."""
    if s.high is not None and s.high > s.low:
        middle = (s.low + s.high) // 2
        return [replace(s, high=middle), replace(s, low=middle + 1)]
    end = s.pushed_to or today
    if end > s.pushed_from:
        middle = s.pushed_from + timedelta(days=(end - s.pushed_from).days // 2)
        return [replace(s, pushed_to=middle), replace(s, pushed_from=middle + timedelta(days=1), pushed_to=end)]
    return []


def plan(start: Slice, count: Callable[[Slice], int], highest: Callable[[], int], today: date, warn: Callable[[str], None] = print) -> list[Slice]:
    """SRC-15: slices small enough to be listed whole; a point that is still too large is kept, with a warning."""
    if count(start) <= RESULT_LIMIT:
        return [start]
    done, open_ = [], [replace(start, high=highest())]
    while open_:
        s = open_.pop()
        n = count(s)
        if not n:
            continue
        parts = halves(s, today) if n > RESULT_LIMIT else []
        if parts:
            open_.extend(reversed(parts))
        else:
            if n > RESULT_LIMIT:
                warn(f"{s.text()} has {n} results, of which only {RESULT_LIMIT} can be listed")
            done.append(s)
    return done


def with_retries(call: Callable[[str], tuple[int, dict, object]], tokens: list[str], wait: Callable[[float], None] = time.sleep, attempts: int = 5):
    """SRC-16: the next token after a limit, then waits that double; returns headers and body."""
    last: Exception | None = None
    for attempt in range(attempts):
        for token in tokens[attempt % len(tokens) :] + tokens[: attempt % len(tokens)] if tokens else [""]:
            try:
                status, headers, body = call(token)
            except OSError as e:
                last = e
                break
            if status < 400:
                return headers, body
            last = RuntimeError(f"status {status}")
            if status not in (403, 429):
                break
        wait(2**attempt)
    raise RuntimeError(f"gave up after {attempts} attempts") from last


def pages(fetch: Callable[[str], tuple[dict, list[dict]]], first: str) -> Iterator[dict]:
    """SRC-14: records of every page, following the header's next link."""
    url: str | None = first
    while url:
        headers, items = fetch(url)
        yield from items
        links = (part.split(";") for part in headers.get("Link", "").split(",") if ";" in part)
        url = next((u.strip().strip("<>") for u, rel in links if 'rel="next"' in rel), None)


class RepositorySource(DataSource):
    """One partition per search slice.  ``transport`` in the options names ``module:function`` of slice -> records."""

    @classmethod
    def name(cls) -> str:
        return "repository_search"

    def schema(self) -> str:
        return REPOSITORY

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        module, _, function = options["transport"].partition(":")
        self.module, self.function = module, function
        self.names = schema.fieldNames()
        self.slices = [Slice(options.get("language", "python"), int(a), int(b), date.fromisoformat(options.get("pushed_from", "1970-01-01"))) for a, b in (x.split("-") for x in options["stars"].split(","))]

    def partitions(self) -> list[Slice]:
        return self.slices

    def read(self, partition: Slice) -> Iterator[tuple]:
        from importlib import import_module

        for record in getattr(import_module(self.module), self.function)(partition):
            yield tuple(record.get(n) for n in self.names)


def listing(call: Callable[[str, str], tuple[int, dict, object]], tokens: list[str], base: str, per_page: int = 100, wait: Callable[[float], None] = time.sleep) -> Callable[[Slice], list[dict]]:
    """SRC-14: a transport that asks a search service for a slice page by page, over ``call`` of (url, token).

    The query is the slice's text; answers hold ``items`` and name the next page in their headers.
    """
    from urllib.parse import urlencode

    def fetch(url: str) -> tuple[dict, list[dict]]:
        headers, body = with_retries(lambda token: call(url, token), tokens, wait)
        return headers, body["items"]

    return lambda s: list(pages(fetch, f"{base}?{urlencode({'q': s.text(), 'per_page': per_page, 'sort': 'stars', 'order': 'desc'})}"))


def offline(partition: Slice) -> list[dict]:
    """Transport without a network: finds nothing and says so by its emptiness."""
    return []


def search(spark: SparkSession, transport: str, stars: list[tuple[int, int]], **options: str) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository_search").options(transport=transport, stars=",".join(f"{a}-{b}" for a, b in stars), **options).load()


# ---- completions

COMPLETION = "raw_response string, comment_text string, error string"


def complete(prompts: DataFrame, client: Callable[[], Callable[[str, str], str]], attempts: int = 5, seed: int = 0) -> DataFrame:
    """SRC-21, PRJ-4: ``prompts`` (key columns, model, prompt) with each model's answer or error.

    ``client`` is called once per worker and returns a function of model and prompt.  Failed calls are tried again
    with growing random waits; an answer that is empty once unwrapped is an error but keeps its raw text.
    """
    from marginalia.functions.udfs import unwrap_text

    schema = T.StructType([*prompts.schema.fields, *T._parse_datatype_string(COMPLETION).fields])

    def run(batches):
        ask = client()
        rng = random.Random(seed)
        for pdf in batches:
            out = []
            for model, prompt in zip(pdf["model"], pdf["prompt"], strict=True):
                raw = text = error = None
                for attempt in range(attempts):
                    try:
                        raw = ask(model, prompt)
                        error = None
                        break
                    except (OSError, TimeoutError) as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(rng.random() * 0.01 * 2**attempt)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                if raw is not None:
                    text = unwrap_text(raw) or None
                    error = None if text else "Model returned an empty comment"
                out.append((raw, text, error))
            yield pdf.assign(**{n: [o[k] for o in out] for k, n in enumerate(("raw_response", "comment_text", "error"))})

    return prompts.mapInPandas(run, schema)
