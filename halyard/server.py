"""A thin HTTP façade over a store; all semantics are the store's."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from halyard.streaming.store import VectorStore

LIMIT_BYTES, MOST_K = 48 << 20, 1000


class BadRequest(ValueError):
    pass


def make_handler(store: VectorStore):
    writes = threading.Lock()
    spark = store.spark

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_):
            pass

        def _send(self, status: int, value: dict) -> None:
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json; charset=utf-8")
            self.send_header("content-length", str(len(data)))
            self.send_header("x-response-time", f"{(time.time() - self.began) * 1000:.1f}ms")
            self.end_headers()
            self.wfile.write(data)

        def _body(self) -> dict:
            size = int(self.headers.get("content-length") or 0)
            if size > LIMIT_BYTES:
                raise BadRequest("body is too large")
            try:
                value = json.loads(self.rfile.read(size) or b"{}")
            except ValueError as e:
                raise BadRequest("body is not JSON") from e
            if not isinstance(value, dict):
                raise BadRequest("body must be an object")
            return value

        def _answer(self, method: str) -> None:
            self.began = time.time()
            path = self.path.split("?")[0]
            try:
                found = self._route(method, path)
            except BadRequest as e:
                found = 400, {"error": str(e)}
            except Exception as e:
                found = (400 if "dimension mismatch" in str(e) else 500), {"error": str(e)[:500]}
            self._send(*found)

        def _route(self, method: str, path: str) -> tuple[int, dict]:
            if (method, path) == ("GET", "/healthz"):
                return 200, {"ok": True, "count": store.sizes()["live"]}
            if (method, path) == ("GET", "/stats"):
                return 200, store.info()
            if path.startswith("/vectors/"):
                name = unquote(path.removeprefix("/vectors/"))
                if method == "GET":
                    vec = store.get(name)
                    return (200, {"id": name, "vec": list(vec)}) if vec is not None else (404, {"error": "not found"})
                if method == "DELETE":
                    with writes:
                        return 200, {"removed": store.remove([name]) > 0}
            if (method, path) == ("POST", "/vectors"):
                rows = self._body().get("vectors")
                if not isinstance(rows, list):
                    raise BadRequest("vectors must be an array")
                try:
                    data = [(str(r["id"]), [float(x) for x in r["vec"]], i) for i, r in enumerate(rows)]
                except (KeyError, TypeError, ValueError) as e:
                    raise BadRequest("each vector needs an id and numbers") from e
                with writes:
                    done = store.upsert(spark.createDataFrame(data, "id string, vec array<float>, ord long")) if data else 0
                return 200, {"upserted": done, "count": store.sizes()["live"]}
            if (method, path) == ("POST", "/search"):
                return self._search(self._body())
            if (method, path) == ("POST", "/checkpoint"):
                with writes:
                    store.checkpoint()
                return 200, {"ok": True}
            return 404, {"error": "no such route"}

        def _search(self, body: dict) -> tuple[int, dict]:
            vec, k = body.get("vec"), body.get("k", 10)
            if not isinstance(vec, list) or isinstance(k, bool) or not isinstance(k, int):
                raise BadRequest("vec must be an array and k an integer")
            if len(vec) != store.options.dim:
                raise BadRequest(f"vector dimension mismatch: expected {store.options.dim}, got {len(vec)}")
            query = spark.createDataFrame([(0, [float(x) for x in vec])], "qid long, vec array<float>")
            ef, k = body.get("ef"), max(1, min(k, MOST_K))
            if ef is not None and (isinstance(ef, bool) or not isinstance(ef, int)):
                raise BadRequest("ef must be an integer")
            out: dict = {}
            if body.get("trace"):
                with writes:
                    hits, traced = store.search_with_trace(query, k, ef)
                out["trace"] = [r.asDict(recursive=True) for r in traced.collect()]
            else:
                hits = store.search(query, k, ef=ef)
            hits = hits.orderBy("rk").collect()
            return 200, {"results": [{"id": r["vid"], "dist": r["dist"]} for r in hits], "tookMs": round((time.time() - self.began) * 1000, 1)} | out

        do_GET = lambda self: self._answer("GET")
        do_POST = lambda self: self._answer("POST")
        do_DELETE = lambda self: self._answer("DELETE")

    return Handler


class Server:
    def __init__(self, store: VectorStore, host: str = "127.0.0.1", port: int = 8787):
        """Listen at once; port 0 takes a free one."""
        self.http = ThreadingHTTPServer((host, port), make_handler(store))
        self.port = self.http.server_address[1]
        self.url = f"http://{host}:{self.port}"
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()
        self.thread.join()
