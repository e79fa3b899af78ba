"""A small HTTP front: writing line protocol, declaring tables, querying."""

from __future__ import annotations

import gzip
import hmac
import json
import queue
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from siltstone.operators.bad_rows import parse_lines
from siltstone.plans.catalog import CatalogError, Lakehouse, from_request
from siltstone.plans.query import run, to_json
from siltstone.sources.lineproto import records
from siltstone.streaming.ingest import write_points

WRITE = ("/write", "/insert", "/api/v2/write", "/api/v3/write_lp")


class BadLines(ValueError):
    """Some lines of a body don't parse; nothing of it was written."""


@dataclass
class Body:
    """A body of lines on its way in; `done` holds the rows stored or the error."""

    data: bytes
    database: str | None
    precision: str = "ns"
    permissive: bool = False
    done: Future = field(default_factory=Future)


#: Lines of one body, by number, take less than so many ids.
_SPAN = 1 << 40


def write_bodies(lake: Lakehouse, bodies: list[Body]) -> None:
    """Store bodies with one parse and one write per table for all of them, and settle their futures.

    Each body is stored whole or not at all, unless it is permissive. Bodies that can't be stored together, such
    as with a field of two types, are stored one by one.
    """
    now = datetime.now(UTC)
    lines = [(k * _SPAN + i, b.database, b.precision, now, line) for k, b in enumerate(bodies) for i, line in records(b.data.decode("utf-8", "replace").split("\n"))]
    try:
        frame = lake.spark.createDataFrame(lines, "line_id bigint, db_name string, precision string, received_at timestamp, line string")
        parsed = parse_lines(frame).withColumn("body", F.expr(f"line_id div {_SPAN}")).persist()
        try:
            failed: dict[int, list] = {}
            for r in parsed.where("reason is not null").select("line_id", "reason").orderBy("line_id").toLocalIterator():
                failed.setdefault(r.line_id // _SPAN, []).append(f"line {r.line_id % _SPAN + 1}: {r.reason}")
            refused = [k for k in failed if not bodies[k].permissive]
            kept = parsed.where(~F.col("body").isin(refused)) if refused else parsed
            rows = {r.body: r.n for r in kept.where("reason is null").groupBy("body").agg(F.count("*").alias("n")).collect()}
            try:
                write_points(lake, kept.drop("body"))
            except CatalogError as e:
                if len(bodies) - len(refused) > 1:
                    for k, b in enumerate(bodies):
                        if k not in refused:
                            write_bodies(lake, [b])
                    rows = {}
                else:
                    for k, b in enumerate(bodies):
                        if k not in refused:
                            b.done.set_exception(e)
            for k in refused:
                bodies[k].done.set_exception(BadLines("; ".join(failed[k][:10])))
            for k, b in enumerate(bodies):
                if not b.done.done():
                    b.done.set_result(rows.get(k, 0))
        finally:
            parsed.unpersist()
    except Exception as e:  # noqa: BLE001
        for b in bodies:
            if not b.done.done():
                b.done.set_exception(e)


def write_body(lake: Lakehouse, body: bytes, database: str | None, precision: str = "ns", permissive: bool = False) -> int:
    """Store a body of lines; returns the rows stored. All or nothing, unless `permissive`."""
    one = Body(body, database, precision, permissive)
    write_bodies(lake, [one])
    return one.done.result()


def write_ndjson(lake: Lakehouse, body: bytes, database: str | None, table: str) -> int:
    """Store a body of JSON objects, one a line, in one table with a column per key; all or nothing."""
    rows = []
    for i, line in enumerate(body.decode("utf-8", "replace").split("\n")):
        if line.strip():
            try:
                row = json.loads(line)
            except json.JSONDecodeError:
                row = None
            if not isinstance(row, dict):
                raise BadLines(f"line {i + 1}: no JSON object")
            rows.append(line)
    if not rows:
        return 0
    return lake.write(database or "default", table, lake.spark.read.option("mode", "FAILFAST").json(lake.spark.sparkContext.parallelize(rows)))


class Writer:
    """Bodies of many clients, stored together: those that come while a write runs, or within `wait_s` of the first
    waiting one, share the next write. A body is acknowledged when its rows are committed."""

    def __init__(self, lake: Lakehouse, wait_s: float = 0.05, max_bodies: int = 1000):
        self.lake, self.wait_s, self.max_bodies = lake, wait_s, max_bodies
        self._waiting: queue.Queue[Body] = queue.Queue(10 * max_bodies)  # full: clients wait
        threading.Thread(target=self._run, daemon=True).start()

    def write(self, body: bytes, database: str | None, precision: str = "ns", permissive: bool = False) -> int:
        one = Body(body, database, precision, permissive)
        self._waiting.put(one)
        return one.done.result()

    def _run(self) -> None:
        while True:
            some = [self._waiting.get()]
            until = time.monotonic() + self.wait_s
            while len(some) < self.max_bodies:
                try:
                    some.append(self._waiting.get(timeout=max(0.0, until - time.monotonic())))
                except queue.Empty:
                    break
            write_bodies(self.lake, some)


#: Further routes by (method, path): functions of (lakehouse, options of the URL, body) to (status, text, content type).
ROUTES: dict[tuple[str, str], Callable[[Lakehouse, dict[str, str], bytes], tuple[int, str, str]]] = {}


def route(method: str, path: str):
    """Decorator that adds a route to all servers of this process."""

    def add(function):
        ROUTES[method, path] = function
        return function

    return add


def handler(lake: Lakehouse, wait_s: float = 0.05, secret: str = "", allow_local: bool = True) -> type[BaseHTTPRequestHandler]:
    writer = Writer(lake, wait_s)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: str = "", kind: str = "text/plain") -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            if secret and not hmac.compare_digest(self.headers.get("Authorization") or "", f"Bearer {secret}"):
                self._answer(401, "no valid token")
                return False
            return True

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            path = url.path
            if path not in ("/health", "/ping") and not self._allowed():
                return
            if more := ROUTES.get(("GET", path)):
                self._answer(*more(lake, {k: v[-1] for k, v in parse_qs(url.query).items()}, b""))
                return
            self._answer(*((200, json.dumps({"status": "pass"}), "application/json") if path == "/health" else (204, "") if path == "/ping" else (404, "no such route")))

        def do_POST(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            options = {k: v[-1] for k, v in parse_qs(url.query).items()}
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if not self._allowed():
                return
            if self.headers.get("Content-Encoding") == "gzip":
                body = gzip.decompress(body)
            database = options.get("db") or options.get("bucket")
            try:
                if more := ROUTES.get(("POST", url.path)):
                    self._answer(*more(lake, options, body))
                elif "ndjson" in (self.headers.get("Content-Type") or "") and "table" in options:
                    write_ndjson(lake, body, database, options["table"])
                    self._answer(204)
                elif url.path in WRITE or url.path.startswith("/write/"):
                    database = url.path.removeprefix("/write/") if url.path.startswith("/write/") else database
                    writer.write(body, database, options.get("precision", "ns"), options.get("permissive") == "true")
                    self._answer(204)
                elif url.path == "/create":
                    spec = from_request(body.decode(), database or "default")
                    if not spec.location and not allow_local:
                        raise CatalogError("tables need an s3_url here")
                    lake.create(spec)
                    self._answer(200, "ok")
                elif url.path == "/query":
                    self._answer(200, to_json(run(lake, database or "default", json.loads(body)["query"])), "application/json")
                else:
                    self._answer(404, "no such route")
            except (BadLines, CatalogError, KeyError, json.JSONDecodeError) as e:
                self._answer(400, str(e))
            except Exception as e:  # noqa: BLE001
                self._answer(500, str(e)[:2000])

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(lake: Lakehouse, host: str = "0.0.0.0", port: int = 7971, wait_s: float = 0.05, secret: str = "", allow_local: bool = True) -> ThreadingHTTPServer:
    """A server ready to run; call serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(lake, wait_s, secret, allow_local))
