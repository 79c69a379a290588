"""Starting, polling and stopping queries: a store behind a lock, a pool of threads, and HTTP in front.

POST /StartQuery {"query": "<SQL>"} answers {"qID": ...} at once; GET /GetQueryResult?qID= the latest estimates;
POST /StopQuery?qID= ends a run after its step.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from tidemark.plans.progressive import StepResult


class QueryService:
    """``start`` makes the steps of a query text; results of the last ``keep`` queries that ended are kept."""

    def __init__(self, start: Callable[[str], Iterator[StepResult]], workers: int = 4, keep: int = 1000):
        self._keep = keep
        self._start, self._pool, self._lock = start, ThreadPoolExecutor(workers), threading.Lock()
        self._store: dict[str, dict] = {}

    def submit(self, sql: str) -> str:
        qid = uuid.uuid4().hex
        with self._lock:
            self._store[qid] = {"state": "running", "step": 0, "result": {}, "stop": False}
        self._pool.submit(self._run, qid, sql)
        return qid

    def _run(self, qid: str, sql: str) -> None:
        try:
            for step in self._start(sql):
                rows = [r.asDict() for r in step.estimates.collect()]
                result = {}
                for r in rows:
                    group = ",".join(str(v) for k, v in r.items() if k not in ("agg", "est", "ci_low", "ci_high", "error"))
                    result[f"({r['agg']},{group})"] = {"Estimate": r["est"], "CI_low": r["ci_low"], "CI_high": r["ci_high"], "Error": r["error"]}
                with self._lock:
                    self._store[qid] |= {"step": step.step, "result": result}
                    if self._store[qid]["stop"]:
                        break
            state = "done"
        except Exception as e:
            state = f"failed: {e}"
        with self._lock:
            self._store[qid]["state"] = state
            ended = [q for q, x in self._store.items() if x["state"] != "running"]
            for q in ended[: max(0, len(ended) - self._keep)]:
                del self._store[q]

    def poll(self, qid: str) -> dict | None:
        with self._lock:
            found = self._store.get(qid)
            return {k: v for k, v in found.items() if k != "stop"} if found else None

    def stop(self, qid: str) -> bool:
        with self._lock:
            if qid in self._store:
                self._store[qid]["stop"] = True
            return qid in self._store

    def close(self) -> None:
        self._pool.shutdown(wait=True)


def serve(service: QueryService, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _qid(self) -> str:
            return parse_qs(urlparse(self.path).query).get("qID", [""])[0]

        def do_POST(self) -> None:
            at = urlparse(self.path).path
            if at == "/StartQuery":
                try:
                    sql = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["query"]
                except (ValueError, KeyError, TypeError):
                    return self._answer(400, {"error": "a JSON object with a query is needed"})
                return self._answer(200, {"qID": service.submit(sql)})
            if at == "/StopQuery":
                return self._answer(*((200, {"stopped": True}) if service.stop(self._qid()) else (404, {"error": "unknown qID"})))
            return self._answer(404, {"error": "unknown path"})

        def do_GET(self) -> None:
            found = service.poll(self._qid()) if urlparse(self.path).path == "/GetQueryResult" else None
            self._answer(*((200, found) if found else (404, {"error": "unknown qID or path"})))

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
