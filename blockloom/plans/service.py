"""A thin HTTP shell over the query plans: routes to functions, and a server for them from the standard library.

``read`` gives the newest committed window as a DataFrame with number, hash, parent_number, parent_hash, json_line; the handler
itself holds no state, so several servers may stand before one window.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import zstandard
from pyspark.sql import DataFrame

from . import queries as qu

MAX_BODY = 1024


class Service:
    def __init__(self, read: Callable[[], DataFrame], finalized: Callable[[], int], archive: DataFrame | None = None, ready: Callable[[], bool] = lambda: True, metrics: Callable[[str | None], str] = lambda name: "", block_time: Callable[[int], int | None] = lambda n: None, wait_s: float = 5.0):
        self.read, self.finalized, self.archive, self.ready, self.metrics, self.block_time, self.wait_s = read, finalized, archive, ready, metrics, block_time, wait_s

    def get(self, path: str) -> tuple[int, str]:
        """(status, text) of a GET."""
        if path == "/":
            return 200, "block stream"
        if path in ("/head", "/finalized-head"):
            w = qu.watermarks(self.read(), self.finalized()).first()
            ref = w.head if path == "/head" else w.finalized
            return 200, json.dumps({"number": ref.number, "hash": ref.hash} if ref else None)
        if path == "/readiness":
            return (200, "ready") if self.ready() else (503, "not ready")
        if path == "/metrics" or path.startswith("/metrics/"):
            text = self.metrics(path.removeprefix("/metrics").lstrip("/") or None)
            return (200, text) if text or path == "/metrics" else (404, "no such metric")
        if path.startswith("/block-time/") and path.rpartition("/")[2].isdigit():
            at = self.block_time(int(path.rpartition("/")[2]))
            return (200, str(at)) if at is not None else (404, "unknown height")
        return 404, "not found"

    def stream(self, body: bytes) -> tuple[int, str | None, Iterator[str] | None]:
        """(status, JSON, records) of a range query: 200 with records, 204, 409 with refs, or an error."""
        if len(body) > MAX_BODY:
            return 413, "body too large", None
        try:
            asked = json.loads(body)
            start, parent = asked["fromBlock"], asked.get("parentBlockHash")
            if not isinstance(start, int) or isinstance(start, bool) or start < 0 or not (parent is None or isinstance(parent, str)):
                raise ValueError("fromBlock must be a height")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return 400, str(e), None
        got = qu.wait_for(self.read, start, parent, self.wait_s)
        if got.kind == "below":
            try:
                got = qu.Answer("data", qu.backfill(self.archive, self.read(), start)) if self.archive is not None else got
            except LookupError:
                return 500, "internal error", None
        if got.kind == "data":
            return 200, None, qu.records(got)
        if got.kind == "conflict":
            return 409, json.dumps({"previousBlocks": [{"number": n, "hash": h} for n, h in got.prev]}), None
        return (204, None, None) if got.kind == "empty" else (500, "internal error", None)


def serve(service: Service, port: int = 3000) -> ThreadingHTTPServer:
    """A server; each record is a frame of its own, zstd where the reader takes it, else gzip."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.0"

        def _answer(self, status: int, text: str | None) -> None:
            raw = (text or "").encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._answer(*service.get(self.path))

        def do_POST(self) -> None:
            if self.path != "/stream":
                self._answer(404, "not found")
                return
            size = int(self.headers.get("Content-Length") or 0)
            status, text, rows = service.stream(self.rfile.read(min(size, MAX_BODY + 1)))
            if rows is None:
                self._answer(status, text)
                return
            zstd = "zstd" in (self.headers.get("Accept-Encoding") or "")
            own = zstandard.ZstdCompressor(level=1)
            first = next(rows, None)  # the first record comes before the status is told
            if first is None:
                self._answer(204, None)
                return
            self.send_response(200)
            self.send_header("Content-Encoding", "zstd" if zstd else "gzip")
            self.end_headers()
            for line in (x for part in ([first], rows) for x in part):
                self.wfile.write(own.compress(line.encode()) if zstd else gzip.compress(line.encode(), 1, mtime=0))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
