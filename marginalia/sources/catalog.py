"""Folders named by time, their manifests and how arguments name them (SRC-10 to SRC-13, SRC-18)."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

NAME = "%Y-%m-%dT%H-%M-%S"


def parse_name(name: str) -> datetime | None:
    try:
        return datetime.strptime(name, NAME)
    except ValueError:
        return None


def create(root: str | Path, now: datetime | None = None) -> Path:
    path = Path(root, (now or datetime.now()).strftime(NAME))
    path.mkdir(parents=True)
    return path


def latest(root: str | Path) -> Path | None:
    """The greatest name of any subfolder, whether or not it is a time."""
    if not Path(root).is_dir():
        return None
    return max((p for p in Path(root).iterdir() if p.is_dir()), key=lambda p: p.name, default=None)


def resolve(root: str | Path, argument: str | None = None, make: bool = False) -> Path:
    """A folder by its name or path; without an argument the latest, or a new one if ``make``."""
    if argument is not None:
        for path in (Path(argument), Path(root, argument)):
            if path.is_dir():
                return path
        if make and parse_name(argument):
            path = Path(root, argument)
            path.mkdir(parents=True)
            return path
        raise FileNotFoundError(f"no folder {argument} in {root}")
    found = latest(root)
    if found is None and make:
        return create(root)
    if found is None:
        raise FileNotFoundError(f"{root} holds no folders")
    return found


def resolve_run(root: str | Path, dataset: str | None = None, run: str | None = None, make: bool = False) -> tuple[Path, Path]:
    """A dataset's folder and a run's folder in it."""
    base = resolve(root, dataset)
    return base, resolve(base / "runs", run, make)


def write_manifest(folder: str | Path, name: str, **values) -> None:
    """Written last and in one step: its presence says that the rest is whole."""
    target = Path(folder, name)
    staged = target.with_suffix(".staged")
    staged.write_text(json.dumps(values, indent=2, ensure_ascii=False), encoding="utf-8")
    staged.rename(target)


def read_manifest(folder: str | Path, name: str) -> dict:
    return json.loads(Path(folder, name).read_text(encoding="utf-8"))


def require_same(manifest: dict, **expected) -> None:
    """Guard of a resumed run: the same settings as when it began."""
    differing = {k: (manifest.get(k), v) for k, v in expected.items() if manifest.get(k) != v}
    if differing:
        raise ValueError(f"the run was begun with other settings: {differing}")


def cached(path: str | Path, make: Callable[[], list[dict]]) -> list[dict]:
    """SRC-18: what was stored before wins over any newer request."""
    path = Path(path)
    if not path.exists():
        path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in make()), encoding="utf-8")
    return [json.loads(line) for line in path.read_text(encoding="utf-8").splitlines() if line]


def git_commit() -> str | None:
    got = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() or None if got.returncode == 0 else None
