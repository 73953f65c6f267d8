"""The engine: SQL text in, DataFrame out, with DML, transactions, roles and row policies over Parquet folders."""

from __future__ import annotations

import functools
import os
import tempfile
import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .catalog import Catalog, Outdated, read, schema_of
from .dialect import SqlError, Statement, Token, branches, names_in, parse, raw, recursive, render, shim, solid, validate
from .functions import cast_boolean, cast_date, cast_vector
from .operators.recursive import fixpoint
from .security import AuditLog, Metrics, RateLimiter, authorize


class ConstraintError(ValueError):
    """A row breaks PRIMARY KEY, UNIQUE, NOT NULL or a vector's size."""


class ConflictError(RuntimeError):
    """Another transaction changed a written table first."""


class DeadlineError(TimeoutError):
    """The statement took longer than the engine's deadline."""


@dataclass
class Session:
    role: str = "admin"
    tenant: str = "default"
    spark: SparkSession | None = None
    prepared: dict[str, list[Token]] = field(default_factory=dict)
    draft: dict | None = None  # the transaction's catalog state
    base: dict | None = None  # the catalog state it began with
    written: set[str] = field(default_factory=set)


class Engine:
    """Engine(spark, path): `path` holds the manifest and data; `tables` maps names to read-only Parquet paths.

    audit_path: a driver-local file of the audit log (default: below `path` if local, else no log).
    deadline: seconds a statement may take. With one, a query is computed within `sql`, into a table of
    the engine's folder, and jobs that run beyond it are cancelled; without, results are lazy.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None, role: str = "admin", audit_path: str | None = None, qps: float = 5_000, burst: float = 10_000, deadline: float | None = None, cache_size: int = 4096):
        self.spark, self.catalog = spark, Catalog(spark, path)
        self.external = {k.lower(): v for k, v in (tables or {}).items()}
        self.sessions: dict = {}
        self.default_role, self.deadline = role, deadline
        self.metrics, self.limiter = Metrics(), RateLimiter(qps, burst)
        if audit_path is None and ":" not in path.split("/")[0]:
            audit_path = os.path.join(path, "audit", "audit.log")
        self.audit = AuditLog(audit_path) if audit_path else None
        self.statistics: dict[str, dict] = {}
        self._lock = threading.RLock()
        self._cache: OrderedDict = OrderedDict()
        self._cache_size = cache_size

    # -- entry points --

    def session(self, name="default") -> Session:
        if name not in self.sessions:
            own = self.spark.newSession()
            own.conf.set("spark.sql.runSQLOnFiles", "false")  # files are reached through tables and their policies alone
            self.sessions[name] = Session(role=self.default_role, spark=own)
        return self.sessions[name]

    def sql(self, text: str, params: list | None = None, session="default") -> DataFrame:
        """Run one statement; statements without rows give an empty DataFrame."""
        s = self.session(session)
        self.limiter.take(session)
        began, ok, timer, late = time.monotonic(), False, None, threading.Event()
        context = self.spark.sparkContext
        try:
            tokens = validate(text)
            statement = parse(tokens)
            authorize(s.role, statement)
            if self.deadline:
                group = f"tessera-{id(s)}-{began}"
                context.setJobGroup(group, "statement", interruptOnCancel=True)

                def cancel():
                    late.set()
                    while not ok and timer is not None:  # also jobs that begin later
                        context.cancelJobGroup(group)
                        time.sleep(0.05)

                timer = threading.Timer(self.deadline, cancel)
                timer.daemon = True
                timer.start()
            out, rows = self._run(s, statement, text, params)
            if self.deadline and statement.kind in ("select", "execute"):
                out = self._computed(s, out)
            if late.is_set():
                raise DeadlineError(f"more than {self.deadline} s")
            ok = True
            if self.audit:
                self.audit.append(s.tenant, s.role, text, rows)
            return out
        except DeadlineError:
            raise
        except Exception as e:
            if late.is_set():
                raise DeadlineError(f"more than {self.deadline} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
                timer = None
                context.setLocalProperty("spark.jobGroup.id", None)
            self.metrics.record(time.monotonic() - began, ok)

    def _computed(self, s: Session, df: DataFrame) -> DataFrame:
        folder = self.catalog.new_folder("results").replace("/data/results/", "/results/")
        names = [f"c{k}" for k in range(len(df.columns))]
        df.toDF(*names).write.parquet(folder)
        return s.spark.read.schema(df.toDF(*names).schema).parquet(folder).toDF(*df.columns)

    def explain(self, text: str, params: list | None = None, session="default") -> str:
        """The plan of a query, with Spark's row and size estimates."""
        s = self.session(session)
        statement = parse(validate(text))
        if statement.kind != "select":
            raise SqlError("only queries can be explained")
        return plans.explain(self._query(s, statement.body, params), "cost")

    def bulk_insert(self, table: str, df: DataFrame, session="default") -> None:
        """Append rows without constraint checks; inside the session's transaction, if one is open."""
        self._alter(self.session(session), table, lambda state: self._append(state, table, df))

    def _append(self, state: dict, table: str, df: DataFrame) -> int:
        t = self._table(state, table)
        t["folders"].append(self._write(t, df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(t)])))
        self._bump(state, table)
        return 0

    def _alter(self, s: Session, table: str, change) -> int:
        """Apply change(state) to the session's draft, or to the newest state and save it; begun anew if another process was first."""
        with self._lock:
            if s.draft is not None:
                rows = change(s.draft)
                s.written.add(table.lower())
                return rows
            while True:
                self.catalog.reload()
                before = self.catalog.draft()
                state = self.catalog.draft()
                rows = change(state)
                if rows < 0:
                    return rows
                try:
                    self.catalog.save(state)
                except Outdated:
                    continue
                self._purge(before, state)
                return rows

    def _purge(self, before: dict, after: dict) -> None:
        """Remove the data of tables that a change has dropped."""
        kept = {f for t in after["tables"].values() for f in t["folders"]}
        for name, t in before["tables"].items():
            if name not in after["tables"]:
                for f in set(t["folders"]) - kept:
                    self.catalog.remove(f)

    def vacuum(self) -> int:
        """Remove data folders that the newest manifest and open transactions do not list; the number removed. Not beside running statements."""
        with self._lock:
            self.catalog.reload()
            states = [self.catalog.state, *(x for s in self.sessions.values() for x in (s.draft, s.base) if x)]
            kept = {f for x in states for t in x["tables"].values() for f in t["folders"]}
            gone = [f for f in self.catalog.folders() if f not in kept]
            for f in gone:
                self.catalog.remove(f)
            return len(gone)

    # -- dispatch --

    def _run(self, s: Session, st: Statement, text: str, params) -> tuple[DataFrame, int]:
        empty = s.spark.createDataFrame([], "result string")
        kind = st.kind
        if kind == "select":
            return self._cached(s, st, text, params), 0
        if kind == "prepare":
            s.prepared[st.names[0].lower()] = st.body
            return empty, 0
        if kind == "execute":
            body = s.prepared.get(st.names[0].lower())
            if body is None:
                raise SqlError(f"nothing prepared as {st.names[0]}")
            need = max([int(t.text[1:]) for t in body if t.kind == "param"], default=0)
            if need != len(st.extra["values"]):
                raise SqlError(f"{need} values are needed")
            return self._query(s, body, st.extra["values"]), 0
        if kind == "set role":
            s.role = st.names[0]
            return empty, 0
        if kind == "begin":
            if s.draft is not None:
                raise SqlError("a transaction is open")
            self.catalog.reload()
            s.base, s.draft, s.written = self.catalog.draft(), self.catalog.draft(), set()
            return empty, 0
        if kind == "rollback":
            if s.draft is None:
                raise SqlError("no transaction is open")
            s.draft = s.base = None
            return empty, 0
        if kind == "commit":
            self._commit(s)
            return empty, 0
        if kind == "analyze":
            df = self._rows(s, st.table)
            stats = plans.statistics(df)
            self.statistics[st.table.lower()] = stats
            rows = [(st.table, c, stats["rows"], n) for c, n in stats["distinct"].items()]
            return s.spark.createDataFrame(rows, "table string, column string, n_rows long, n_distinct long"), 0
        return empty, max(self._alter(s, st.table, lambda state: self._change(s, state, st, params)), 0)

    def _commit(self, s: Session) -> None:
        """First committer wins: written tables must be as they were at BEGIN."""
        if s.draft is None:
            raise SqlError("no transaction is open")
        with self._lock:
            try:
                while True:
                    self.catalog.reload()
                    before, state = self.catalog.draft(), self.catalog.draft()
                    for name in s.written:
                        now, then = state["tables"].get(name), s.base["tables"].get(name)
                        if (now or {}).get("version") != (then or {}).get("version"):
                            raise ConflictError(f"{name} was changed by another transaction")
                    state["version"] = max(state["version"], s.draft["version"]) + 1
                    for name in s.written:
                        if name in s.draft["tables"]:
                            state["tables"][name] = s.draft["tables"][name] | {"version": state["version"]}
                        else:
                            state["tables"].pop(name, None)
                    try:
                        if s.written:
                            self.catalog.save(state)
                            self._purge(before, state)
                        return
                    except Outdated:
                        continue
            finally:
                s.draft = s.base = None

    # -- queries --

    def _state(self, s: Session) -> dict:
        return s.draft if s.draft is not None else self.catalog.state

    @staticmethod
    def _table(state: dict, name: str) -> dict:
        t = state["tables"].get(name.lower())
        if t is None:
            raise SqlError(f"unknown table {name}")
        return t

    def _rows(self, s: Session, name: str, state: dict | None = None) -> DataFrame:
        """A table as the session's role sees it: every policy must hold; without one, a protected table is empty."""
        state = state or self._state(s)
        t = state["tables"].get(name.lower())
        if t is None:
            if name.lower() in self.external:
                return s.spark.read.parquet(self.external[name.lower()])
            raise SqlError(f"unknown table {name}")
        df = read(s.spark, t)
        if t["rls"]:
            policies = [shim(validate(p["using"]), user=s.role) for p in t["policies"]]
            df = df.where(functools.reduce(lambda a, b: f"({a}) AND ({b})", policies) if policies else "false")
        return df

    def _views(self, s: Session, tokens: list[Token]) -> None:
        """Register the tables a statement names as temporary views of the session, policies applied."""
        state = self._state(s)
        names = {t.text.strip('"`').lower() for t in tokens if t.kind == "name"}
        for name in names & (set(state["tables"]) | set(self.external)):
            self._rows(s, name).createOrReplaceTempView(name)
        for view in s.spark.catalog.listTables():
            if view.isTemporary and view.name.lower() in names and view.name.lower() not in state["tables"] and view.name.lower() not in self.external:
                s.spark.catalog.dropTempView(view.name)

    def _query(self, s: Session, body: list[Token], params) -> DataFrame:
        self._views(s, body)
        found = recursive(body)
        if found and any(name.lower() in names_in(query) for name, _, query in found[0]):
            body = self._fixpoints(s, *found, params)
        return s.spark.sql(shim(body, user=s.role, params=params))

    def _fixpoints(self, s: Session, ctes: list, main: list[Token], params) -> list[Token]:
        """Compute the CTEs that name themselves, by `fixpoint`; what is left is a plain WITH over their results."""
        plain: list[Token] = []

        def with_plain(query: list[Token]) -> list[Token]:
            return [raw("WITH "), *plain, raw(" "), *query] if plain else query

        for name, columns, query in ctes:
            if name.lower() not in names_in(query):
                head = f"{', ' if plain else ''}`{name}`{' (' + ', '.join(f'`{c}`' for c in columns) + ')' if columns else ''} AS ("
                plain += [raw(head), *query, raw(")")]
                continue
            anchor, step = branches(query)
            first = s.spark.sql(shim(with_plain(anchor), user=s.role, params=params))
            first = first.toDF(*columns) if columns else first
            text = shim(with_plain(step), user=s.role, params=params)

            def grow(new: DataFrame, name=name, text=text) -> DataFrame:
                new.createOrReplaceTempView(name)
                return s.spark.sql(text)

            fixpoint(first, grow).createOrReplaceTempView(name)
        return with_plain(main)

    def _cached(self, s: Session, st: Statement, text: str, params) -> DataFrame:
        """Plans by (catalog version, role, text); a transaction's own reads are never shared."""
        if s.draft is not None or self._cache_size <= 0:
            return self._query(s, st.body, params)
        self.catalog.reload()
        key = (self.catalog.state["version"], id(s), s.role, text, repr(params))
        hit = key in self._cache
        self.metrics.cache(hit)
        if hit:
            self._cache.move_to_end(key)
            return self._cache[key]
        out = self._cache[key] = self._query(s, st.body, params)
        while len(self._cache) > self._cache_size:
            self._cache.popitem(last=False)
        return out

    # -- changes --

    def _bump(self, state: dict, name: str) -> None:
        state["version"] += 1
        if name.lower() in state["tables"]:
            state["tables"][name.lower()]["version"] = state["version"]

    def _write(self, table: dict, df: DataFrame) -> str:
        folder = self.catalog.new_folder(table["name"])
        df.write.parquet(folder)
        return folder

    def _change(self, s: Session, state: dict, st: Statement, params) -> int:
        """Apply DDL or DML to a catalog state; the number of rows, or -1 where nothing changed."""
        name = st.table.lower()
        if st.kind == "create table":
            if name in state["tables"]:
                if st.extra["quiet"]:
                    return -1
                raise SqlError(f"table {st.table} exists")
            state["tables"][name] = {"name": st.table, "columns": [{k: c[k] for k in ("name", "type", "size", "not_null", "unique")} for c in st.names], "primary": st.extra["primary"], "folders": [], "rls": False, "policies": [], "indexes": [], "version": 0}
            self._bump(state, name)
            return 0
        if st.kind == "drop table":
            if name not in state["tables"]:
                if st.extra["quiet"]:
                    return -1
                raise SqlError(f"unknown table {st.table}")
            del state["tables"][name]
            self.statistics.pop(name, None)
            self._bump(state, name)
            return 0
        t = self._table(state, name)
        columns = [c["name"].lower() for c in t["columns"]]
        if st.kind == "add column":
            c = st.names[0]
            if c["name"].lower() in columns:
                raise SqlError(f"column {c['name']} exists")
            if c["primary"]:
                raise SqlError("a primary key cannot be added")
            if c["not_null"] and not read(s.spark, t).isEmpty():
                raise ConstraintError("existing rows would hold null")
            t["columns"].append({k: c[k] for k in ("name", "type", "size", "not_null", "unique")})
        elif st.kind == "enable rls":
            t["rls"] = True
        elif st.kind == "create policy":
            read(s.spark, t).where(shim(st.body, user=s.role))  # raises if the expression does not resolve
            t["policies"].append({"name": st.names[0], "using": render(st.body)})
        elif st.kind == "create index":
            if st.names[1].lower() not in columns:
                raise SqlError(f"unknown column {st.names[1]}")
            if any(x["name"].lower() == st.names[0].lower() for x in t["indexes"]):
                raise SqlError(f"index {st.names[0]} exists")
            t["indexes"].append({"name": st.names[0], "column": st.names[1]})
        elif st.kind == "insert":
            n = self._insert(s, t, st, params)
            self._bump(state, name)
            return n
        elif st.kind in ("update", "delete"):
            n = self._rewrite(s, t, st, params)
            if n:
                self._bump(state, name)
            return n
        self._bump(state, name)
        return 0

    def _typed(self, column, spec: dict):
        """A value's column cast to the declared type by the engine's rules."""
        if spec["type"] == "boolean":
            return cast_boolean(column)
        if spec["type"] == "date":
            return cast_date(column)
        if spec["type"] == "timestamp":
            return column.cast("timestamp")
        if spec["type"] == "array<float>":
            return column
        return column.cast(spec["type"])

    def _insert(self, s: Session, t: dict, st: Statement, params) -> int:
        self._views(s, st.body)
        text = shim(st.body, user=s.role, params=params)
        df = s.spark.sql(f"SELECT * FROM {text}" if solid(st.body)[0].word == "VALUES" else text)
        given = [n.lower() for n in st.names] or [c["name"].lower() for c in t["columns"]]
        known = {c["name"].lower(): c for c in t["columns"]}
        for n in given:
            if n not in known:
                raise SqlError(f"unknown column {n}")
        if len(set(given)) < len(given) or len(df.columns) != len(given):
            raise SqlError("as many values as columns are needed")
        df = df.toDF(*[f"v{k}" for k in range(len(given))])
        kinds = dict(df.dtypes)
        out = []
        for c in t["columns"]:
            if c["name"].lower() in given:
                v = f"v{given.index(c['name'].lower())}"
                if c["type"] == "array<float>":
                    value = cast_vector(v, c["size"]) if not kinds[v].startswith("array") else F.when(F.col(v).isNull() | (F.size(v) == c["size"]), F.col(v).cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector of {c['size']} numbers is needed")))
                else:
                    value = self._typed(F.col(v), c)
            else:
                value = F.lit(None).cast(c["type"])
            out.append(value.alias(c["name"]))
        # written first, checked from its own folder, and listed only if it passes
        folder = self._write(t, df.select(*out))
        new = s.spark.read.schema(schema_of(t)).parquet(folder)
        self._check(s, t, new, read(s.spark, t))
        t["folders"].append(folder)
        return new.count()

    def _check(self, s: Session, t: dict, new: DataFrame, old: DataFrame | None) -> None:
        """NOT NULL, PRIMARY KEY and UNIQUE of new rows among themselves and against old ones, by aggregation and semi joins."""
        for c in t["columns"]:
            if c["not_null"] and not new.where(F.col(f"`{c['name']}`").isNull()).isEmpty():
                raise ConstraintError(f"{c['name']} may not be null")
        keys = ([t["primary"]] if t["primary"] else []) + [[c["name"]] for c in t["columns"] if c["unique"]]
        for key in keys:
            own = new.select(*key).dropna()
            if not own.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"duplicate key ({', '.join(key)})")
            if old is not None and not old.select(*key).join(own, key, "left_semi").isEmpty():
                raise ConstraintError(f"duplicate key ({', '.join(key)})")

    def _rewrite(self, s: Session, t: dict, st: Statement, params) -> int:
        """Copy-on-write UPDATE and DELETE: only folders that hold a row to change are written again."""
        if not t["folders"]:
            return 0
        schema = schema_of(t)
        condition = "true"
        if st.body:
            condition = shim(st.body, user=s.role, params=params)
        hit = f"coalesce(({condition}), false)"
        if t["rls"]:
            policies = [shim(validate(p["using"]), user=s.role) for p in t["policies"]]
            hit = f"({hit}) AND coalesce({' AND '.join(f'({p})' for p in policies) if policies else 'false'}, false)"
        sets = {}
        if st.kind == "update":
            known = {c["name"].lower(): c for c in t["columns"]}
            for column, body in st.names:
                if column.lower() not in known:
                    raise SqlError(f"unknown column {column}")
                sets[column.lower()] = shim(body, user=s.role, params=params)
        tokens = [*st.body, *(x for _, body in st.names for x in body)] if st.kind == "update" else st.body
        if tokens:
            self._views(s, tokens)  # subqueries see whole tables, policies applied
        folders, changed, fresh = [], 0, []
        for folder in t["folders"]:
            part = f"__part_{uuid.uuid4().hex}"
            s.spark.read.schema(schema).parquet(folder).createOrReplaceTempView(part)
            source = f"{part} AS `{t['name']}`"
            marked = s.spark.sql(f"SELECT *, {hit} AS __hit FROM {source}")
            n = marked.where("__hit").count()
            if not n:
                s.spark.catalog.dropTempView(part)
                folders.append(folder)
                continue
            changed += n
            if st.kind == "delete":
                rows = marked.where("not __hit").drop("__hit")
            else:
                whole = s.spark.sql(f"SELECT *, {hit} AS __hit{''.join(f', ({e}) AS `__set_{c}`' for c, e in sets.items())} FROM {source}")
                rows = whole.select(*[F.when(F.col("__hit"), self._typed(F.col(f"__set_{c['name'].lower()}"), c)).otherwise(F.col(f"`{c['name']}`")).cast(c["type"]).alias(c["name"]) if c["name"].lower() in sets else F.col(f"`{c['name']}`") for c in t["columns"]])
            new = self._write(t, rows)
            s.spark.catalog.dropTempView(part)
            folders.append(new)
            fresh.append(new)
        if st.kind == "update" and fresh:
            whole = s.spark.read.schema(schema).parquet(*folders)
            keyed = {k.lower() for k in t["primary"]} | {c["name"].lower() for c in t["columns"] if c["unique"]}
            self._check(s, t if keyed & set(sets) else t | {"primary": [], "columns": [c | {"unique": False} for c in t["columns"]]}, whole, None)
        t["folders"] = folders
        return changed

    def compact(self, table: str, files: int | None = None, session="default") -> None:
        """Rewrite a table as one folder, laid out by its first index column if it has one; inside the session's transaction, if one is open."""

        def change(state: dict) -> int:
            t = self._table(state, table)
            if not t["folders"]:
                return -1
            df = read(self.spark, t)
            if t["indexes"]:
                key = t["indexes"][0]["column"]
                df = (df.repartitionByRange(files, key) if files else df.repartitionByRange(key)).sortWithinPartitions(key)
            t["folders"] = [self._write(t, df)]
            self._bump(state, table)
            return 0

        self._alter(self.session(session), table, change)


def scratch_engine(spark: SparkSession, tables: dict[str, str] | None = None) -> Engine:
    """An engine in a fresh folder below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or (os.path.join(tempfile.gettempdir(), "tessera-checkpoints") if spark.sparkContext.master.startswith("local") else None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return Engine(spark, f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}", tables)
