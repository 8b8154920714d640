"""Models that answer prompts (SRC-21 to SRC-23): profiles by name, and a local pipeline with a guard of its context.

A client is made once per worker and is a function of model and prompt; ``search.complete`` calls it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

OUTPUT_TOKENS = 512
VARIABLE = "MODEL_PROFILE"
Client = Callable[[str, str], str]


@dataclass(frozen=True)
class Profile:
    """Models that are asked together, and what makes their client."""

    models: tuple[str, ...]
    client: Callable[[], Client]


_PROFILES: dict[str, Profile] = {}


def register(name: str, models: Sequence[str], client: Callable[[], Client]) -> None:
    _PROFILES[name] = Profile(tuple(models), client)


def profile(name: str | None = None, default: str = "offline") -> Profile:
    """SRC-23: the profile by name, by the environment, or the default."""
    name = name or os.environ.get(VARIABLE) or default
    if name not in _PROFILES:
        raise ValueError(f"no profile {name!r}; there are: {', '.join(sorted(_PROFILES))}")
    return _PROFILES[name]


def local(load: Callable[[str], Callable[[str, int], str]], limits: dict[str, int], counter: Callable[[], Callable[[Sequence[str]], Sequence[int]]], output: int = OUTPUT_TOKENS) -> Callable[[], Client]:
    """SRC-22: a client over pipelines that ``load`` makes for each model once per worker.

    A prompt whose tokens and the answer's exceed the model's context is an error, not cut.
    """

    def make() -> Client:
        pipelines: dict[str, Callable[[str, int], str]] = {}
        count = counter()

        def ask(model: str, prompt: str) -> str:
            held = count([prompt])[0]
            if held > limits[model] - output:
                raise ValueError(f"the prompt has {held} tokens; with {output} of the answer it exceeds the context of {limits[model]}")
            if model not in pipelines:
                pipelines[model] = load(model)
            return pipelines[model](prompt, output)

        return ask

    return make


def _offline() -> Client:
    def ask(model: str, prompt: str) -> str:
        raise RuntimeError("no model is attached to the offline profile")

    return ask


register("offline", ("offline",), _offline)
