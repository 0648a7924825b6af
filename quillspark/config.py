"""Configuration, as TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from .errors import ConfigError

#: Names the file that ``load`` reads if it is given none.
VARIABLE = "QUILLSPARK_CONFIG"


@dataclass(frozen=True)
class Database:
    id: int
    name: str


@dataclass(frozen=True)
class Config:
    server_id: int = 1
    replication_port: int = 9999
    peer_address: str | None = None
    base_dir: str = "quillspark-data"
    flush_interval_secs: int = 1
    batch_size: int = 1000
    http_port: int = 3000
    trusted_ips: tuple[str, ...] = ("127.0.0.1",)
    secret_key: str = "change-me"
    databases: tuple[Database, ...] = (Database(0, "default"),)
    max_entries_per_table: int = 0  # kept for old files; logs live in storage, so nothing spills
    extra: dict = field(default_factory=dict, compare=False)


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
        server, storage, wal, http = (raw.get(k, {}) for k in ("server", "storage", "wal", "http"))
        base = Config()
        return Config(
            server_id=int(server.get("id", base.server_id)),
            replication_port=int(server.get("replication_port", base.replication_port)),
            peer_address=raw.get("peer", {}).get("address"),
            base_dir=str(storage.get("base_dir", base.base_dir)),
            flush_interval_secs=int(wal.get("flush_interval_secs", base.flush_interval_secs)),
            batch_size=int(wal.get("batch_size", base.batch_size)),
            http_port=int(http.get("port", base.http_port)),
            trusted_ips=tuple(http.get("trusted_ips", base.trusted_ips)),
            secret_key=str(http.get("secret_key", base.secret_key)),
            databases=tuple(Database(int(d["id"]), str(d["name"])) for d in raw.get("databases", [])) or base.databases,
            max_entries_per_table=int(raw.get("memory", {}).get("max_entries_per_table", 0)),
            extra={k: v for k, v in raw.items() if k not in {"server", "peer", "storage", "wal", "http", "databases", "memory"}},
        )
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"invalid configuration: {e}") from e


def load(path: str | None = None) -> Config:
    path = path or os.environ.get(VARIABLE, "/etc/quillspark/config.toml")
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
