"""Notes on sampled items (SRC-25, STR-5, AGG-21): a log that only grows, its latest state, and a small service over it."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from . import jsonl

PAGE = "<!doctype html><title>Items</title><pre id=o></pre><script>fetch('/api/items').then(r=>r.text()).then(t=>document.getElementById('o').textContent=t)</script>"


def clean_tags(tags: list[str]) -> list[str]:
    """STR-4 on the driver."""
    return list(dict.fromkeys(t for t in ("-".join(x.lower().split()) for x in tags) if t))


def checked(payload: object, known: set[str], now: datetime | None = None) -> dict:
    """STR-5: the row of the log for a payload; raises ValueError for one that does not describe a known item."""
    if not isinstance(payload, dict) or payload.get("id") not in known:
        raise ValueError("unknown item")
    tags, notes = payload.get("tags", []), payload.get("notes", "")
    if not isinstance(tags, list) or not all(isinstance(t, str) for t in tags):
        raise ValueError("tags are a list of texts")
    if not isinstance(notes, str):
        raise ValueError("notes are a text")
    flags = {k: payload.get(k, False) for k in ("done", "revealed")}
    if not all(isinstance(v, bool) for v in flags.values()):
        raise ValueError("done and revealed are true or false")
    return {"id": payload["id"], "tags": clean_tags(tags), "notes": notes, **flags, "updated_at": (now or datetime.now(timezone.utc)).isoformat(timespec="seconds")}


def latest(log: str | Path) -> dict[str, dict]:
    """The last row of each id by its place in the log."""
    return {row["id"]: row for row in jsonl.iter_lines(str(log))} if Path(log).exists() else {}


def service(items: list[dict], log: str | Path, port: int = 0) -> HTTPServer:
    """A server on this machine: GET / and /api/items, POST /api/annotations.  Port 0 takes a free one."""
    known = {i["id"] for i in items}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, PAGE, "text/html")
            elif self.path == "/api/items":
                self._send(200, json.dumps({"items": items, "annotations": latest(log)}, ensure_ascii=False), "application/json")
            else:
                self._send(404, "not found", "text/plain")

        def do_POST(self) -> None:
            if self.path != "/api/annotations":
                return self._send(404, "not found", "text/plain")
            try:
                row = checked(json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null"), known)
            except ValueError as e:
                return self._send(400, json.dumps({"error": str(e)}), "application/json")
            with open(log, "a", encoding="utf-8") as f:
                f.write(json.dumps(row, ensure_ascii=False) + "\n")
            return self._send(200, json.dumps(row, ensure_ascii=False), "application/json")

        def log_message(self, *args) -> None:
            """Requests are not told."""

    return HTTPServer(("127.0.0.1", port), Handler)
