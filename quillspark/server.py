"""A thin HTTP front: SQL, transactions, key-value rows, flush."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import logging
import re
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlparse

from .engine import Engine
from .errors import EngineError

log = logging.getLogger("quillspark.server")


class _Refused(Exception):
    def __init__(self, status: int, error: str):
        super().__init__(error)
        self.status, self.error = status, error


def allowed(address: str, trusted: tuple[str, ...]) -> bool:
    """Whether an address is in the list of addresses and networks; IPv4 within IPv6 counts as IPv4."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return any(ip in ipaddress.ip_network(t, strict=False) for t in trusted if ipaddress.ip_network(t, strict=False).version == ip.version)


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    protocol_version = "HTTP/1.1"

    def log_message(self, form: str, *args: Any) -> None:
        log.debug(form, *args)

    def _reply(self, status: int, body: Any = None) -> None:
        data = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
        self.send_response(status)
        if body is not None:
            self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _body(self) -> dict:
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        try:
            body = json.loads(raw or b"{}")
        except ValueError as e:
            raise _Refused(400, f"bad JSON: {e}") from e
        if not isinstance(body, dict):
            raise _Refused(400, "an object is wanted")
        return body

    def _db(self, name: str) -> int:
        found = self.engine.db_id(name)
        if found is None:
            raise _Refused(404, "Database not found")
        return found

    def _handle(self) -> None:
        try:
            body = self._body()
            if not allowed(self.client_address[0], self.engine.config.trusted_ips):
                raise _Refused(403, "Forbidden")
            if self.headers.get("x-api-key") != self.engine.config.secret_key:
                raise _Refused(401, "Unauthorized")
            path = urlparse(self.path).path
            for method, pattern, act in ROUTES:
                m = re.fullmatch(pattern, path)
                if m and method == self.command:
                    out = act(self, body, *map(unquote, m.groups()))
                    return self._reply(204 if out is None else 200, out)
            raise _Refused(404, "Not found")
        except _Refused as e:
            self._reply(e.status, {"error": e.error})
        except EngineError as e:
            self._reply(400, {"error": str(e)})
        except Exception:
            log.exception("request failed")
            self._reply(500, {"error": "Internal server error"})

    do_GET = do_POST = do_PUT = do_DELETE = _handle

    # --- what the routes do

    def query(self, body: dict, db: str) -> dict:
        start = time.perf_counter()
        out = self.engine.query(self._db(db), str(body.get("sql", "")), body.get("params") or [], body.get("txId")).to_json()
        t = out["timing"]
        log.info("db=%s engine=%dus params=%dus encode=%dus total=%dus http_total=%dus", db, t["engine_us"], t["params_us"], t["encode_us"], t["total_us"], (time.perf_counter() - start) * 1e6)
        return out

    def begin(self, body: dict, db: str) -> dict:
        return {"txId": self.engine.begin(self._db(db))}

    def commit(self, body: dict, db: str, tx: str) -> None:
        self.engine.commit(int(tx))

    def rollback(self, body: dict, db: str, tx: str) -> None:
        self.engine.rollback(int(tx))

    def put(self, body: dict, db: str, table: str, key: str) -> None:
        value = body.get("value")
        if not value:
            raise _Refused(400, '"value" field is required')
        if not isinstance(value, str):
            raise _Refused(400, "Unsupported value type")
        try:
            raw = base64.b64decode(value, validate=True)
        except (binascii.Error, ValueError):
            raw = value.encode()
        self.engine.put(self._db(db), table, key.encode(), raw)

    def get(self, body: dict, db: str, table: str, key: str) -> dict:
        value = self.engine.get(self._db(db), table, key.encode())
        if value is None:
            raise _Refused(404, "Row not found")
        return {"value": base64.b64encode(value).decode()}

    def remove(self, body: dict, db: str, table: str, key: str) -> None:
        self.engine.remove(self._db(db), table, key.encode())

    def flush(self, body: dict) -> None:
        self.engine.flush()


_DB = "/api/db/([^/]+)"
ROUTES: list[tuple[str, str, Callable]] = [
    ("POST", f"{_DB}/query", Handler.query),
    ("POST", f"{_DB}/transaction/begin", Handler.begin),
    ("POST", rf"{_DB}/transaction/(\d+)/commit", Handler.commit),
    ("POST", rf"{_DB}/transaction/(\d+)/rollback", Handler.rollback),
    ("PUT", f"{_DB}/table/([^/]+)/row/([^/]+)", Handler.put),
    ("GET", f"{_DB}/table/([^/]+)/row/([^/]+)", Handler.get),
    ("DELETE", f"{_DB}/table/([^/]+)/row/([^/]+)", Handler.remove),
    ("POST", "/api/flush", Handler.flush),
]


def serve(engine: Engine, host: str = "127.0.0.1", port: int | None = None) -> ThreadingHTTPServer:
    """A server on the engine; call its serve_forever()."""
    return ThreadingHTTPServer((host, engine.config.http_port if port is None else port), type("Bound", (Handler,), {"engine": engine}))
