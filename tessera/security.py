"""Roles, redaction, the audit log, rate limits, metrics."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time

from .dialect import AccessDenied, Statement

#: Roles with administrative rights (the third is this engine's own).
ADMIN_ROLES = ("admin", "root", "tessera_admin")

ADMIN_ONLY = {"create table", "drop table", "create index", "enable rls", "create policy", "analyze", "add column"}

#: Words whose following literal is a secret.
SENSITIVE = ("password", "identified by", "secret", "token", "api_key", "apikey", "private_key")


def is_admin(role: str) -> bool:
    return role.lower() in ADMIN_ROLES


def authorize(role: str, statement: Statement) -> None:
    if statement.kind in ADMIN_ONLY and not is_admin(role):
        raise AccessDenied("DDL and security statements need an admin role")
    if statement.kind == "set role" and is_admin(statement.names[0]) and not is_admin(role):
        raise AccessDenied("an admin role can be taken by an admin only")


_SECRET = re.compile("(" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in SENSITIVE) + r")(\s*=?\s*)'(?:[^']|'')*'", re.I)


def redact(sql: str) -> str:
    """Mask the literals that follow a sensitive word."""
    return _SECRET.sub(lambda m: f"{m[1]}{m[2]}'***'", sql)


class AuditLog:
    """Append-only JSON lines; each entry's hash covers the one before."""

    START = "0" * 64

    def __init__(self, path: str):
        self.path, self._lock = path, threading.Lock()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.last = self.START
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    self.last = json.loads(line)["chain_hash"]

    @staticmethod
    def _link(before: str, entry: dict) -> str:
        own = {k: v for k, v in entry.items() if k != "chain_hash"}
        return hashlib.sha256((before + json.dumps(own, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()

    def append(self, tenant: str, user: str, sql: str, rows: int) -> None:
        with self._lock:
            entry = {"ts_unix_ms": int(time.time() * 1000), "tenant": tenant, "user": user, "query": redact(sql), "rows_affected": rows}
            entry["chain_hash"] = self._link(self.last, entry)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(entry, ensure_ascii=False) + "\n")
                f.flush()
                os.fsync(f.fileno())
            self.last = entry["chain_hash"]

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(x) for x in f]

    def verify(self) -> bool:
        before = self.START
        for e in self.entries():
            if e["chain_hash"] != self._link(before, e):
                return False
            before = e["chain_hash"]
        return True

    def export_tsv(self) -> str:
        return "\n".join("\t".join(str(e[k]).replace("\t", " ").replace("\n", " ") for k in ("ts_unix_ms", "tenant", "user", "rows_affected", "query", "chain_hash")) for e in self.entries())


class RateLimiter:
    """Token bucket per session."""

    def __init__(self, qps: float = 5_000, burst: float = 10_000):
        self.qps, self.burst, self._state, self._lock = max(1.0, qps), max(1.0, burst), {}, threading.Lock()

    def take(self, session, now: float | None = None) -> None:
        now = time.monotonic() if now is None else now
        with self._lock:
            tokens, last = self._state.get(session, (self.burst, now))
            tokens = min(self.burst, tokens + (now - last) * self.qps)
            if tokens < 1:
                self._state[session] = tokens, now
                raise RuntimeError("rate limit exceeded")
            self._state[session] = tokens - 1, now


class Metrics:
    """Counters and a latency histogram in Prometheus text form."""

    BOUNDS = (0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10)

    def __init__(self):
        self.queries = self.errors = self.hits = self.misses = 0
        self.total, self.buckets = 0.0, [0] * (len(self.BOUNDS) + 1)
        self._lock = threading.Lock()

    def record(self, seconds: float, ok: bool) -> None:
        with self._lock:
            self.queries += 1
            self.errors += not ok
            self.total += seconds
            self.buckets[next((k for k, b in enumerate(self.BOUNDS) if seconds <= b), len(self.BOUNDS))] += 1

    def cache(self, hit: bool) -> None:
        with self._lock:
            self.hits += hit
            self.misses += not hit

    def render(self) -> str:
        out = [f"tessera_queries_total {self.queries}", f"tessera_query_errors_total {self.errors}", f"tessera_cache_hits_total {self.hits}", f"tessera_cache_misses_total {self.misses}"]
        n = 0
        for b, k in zip((*self.BOUNDS, "+Inf"), self.buckets):
            n += k
            out.append(f'tessera_query_duration_seconds_bucket{{le="{b}"}} {n}')
        return "\n".join([*out, f"tessera_query_duration_seconds_sum {self.total}", f"tessera_query_duration_seconds_count {self.queries}"]) + "\n"
