"""A thin HTTP server over an engine and, if there is one, a store.

GET or POST: /sparql (JSON), /stream (lines), /count; POST: /update, /checkpoint.
The text comes as `query` or `update` or as the body; `infer=rdfs` turns inference on.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .sources.graph import Graph, Store

#: Bytes of a request's body at most.
MAX_BODY = 64 << 20


class Service:
    """The current engine, replaced when the store changes; one writer at a time."""

    def __init__(self, graph: Graph | None = None, store: Store | None = None, cache: int = 256, cap: int | None = None):
        self.store, self.cache, self.cap = store, cache, cap
        self.writing = threading.Lock()
        self.engine = Engine(graph if graph is not None else store.graph(), cap, cache)

    def _renew(self) -> None:
        self.engine = Engine(self.store.graph(), self.cap, self.cache)

    def update(self, text: str) -> dict:
        with self.writing:
            if self.store is not None:
                version = self.store.update(text)
                self._renew()
                return {"version": version}
            self.engine = Engine(self.engine.source.update(text), self.cap, self.cache)
            return {"ok": True}

    def checkpoint(self) -> dict:
        if self.store is None:
            raise ValueError("there is no store to checkpoint")
        with self.writing:
            n = self.store.checkpoint()
            self._renew()
            return {"triples": n}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _reply(self, code: int, text: str, kind: str = "application/json") -> None:
            data = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _fail(self, code: int, error: Exception | str) -> None:
            self._reply(code, json.dumps({"error": str(error)}))

        def _do(self, post: bool) -> None:
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self.close_connection = True
                return self._fail(413, "body too large")
            body = self.rfile.read(size).decode() if post else ""
            if self.headers.get("Content-Type", "").startswith("application/x-www-form-urlencoded"):
                form = {k: v[0] for k, v in parse_qs(body).items() if k in ("query", "update", "infer")}
                given, body = given | form, "" if form else body  # some clients send bare text under this type
            infer = given.get("infer")
            try:
                match url.path:
                    case "/sparql":
                        self._reply(200, service.engine.json(given.get("query") or body, infer), "application/sparql-results+json")
                    case "/count":
                        self._reply(200, service.engine.query(given.get("query") or body, infer).count_json())
                    case "/stream":
                        self._stream(given.get("query") or body, infer)
                    case "/update" if post:
                        self._reply(200, json.dumps(service.update(given.get("update") or body)))
                    case "/checkpoint" if post:
                        self._reply(200, json.dumps(service.checkpoint()))
                    case _:
                        self._fail(404, "no such place")
            except ValueError as e:
                self._fail(400, e)
            except Exception as e:  # the request failed, the server goes on
                self._fail(500, e)

        def _stream(self, text: str, infer: str | None) -> None:
            lines = service.engine.query(text, infer).ndjson()
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()

            def chunk(data: bytes) -> None:
                self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")

            try:
                for line in lines:
                    chunk(line.encode() + b"\n")
            except Exception as e:  # the status is sent: the error is a line
                chunk(json.dumps({"error": str(e)}).encode() + b"\n")
            self.wfile.write(b"0\r\n\r\n")

        def do_GET(self) -> None:
            self._do(False)

        def do_POST(self) -> None:
            self._do(True)

    return Handler


def serve(service: Service, port: int = 9080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound; call serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(service))
