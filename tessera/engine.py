"""The engine: SQL text in, DataFrames out, over registered and stored tables.

Queries are rewritten (``tessera.dialect``) and handed to Spark. Statements that
change tables make new immutable versions and, outside a transaction, commit at
once. A transaction works on a copy of the catalog; savepoints are copies on a
stack; COMMIT fails if another writer has committed meanwhile.

Engines may share a Spark session. Its temporary views are bound anew whenever
another engine's statement is analysed, and a DataFrame keeps what it was analysed
with, so each engine's SQL reads its own tables in its own snapshot.
"""

from __future__ import annotations

import copy
import threading
import uuid
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import dialect
from tessera.dialect import DialectError, Rewriter, spark_type
from tessera.operators.json_ops import json_contains
from tessera.shipping import ship
from tessera.store import tables as st
from tessera.store.manifest import Manifests
from tessera.store.tables import CatalogError, ConstraintError

QUERY = ("select", "with", "values", "(")
#: By session: the engine whose tables its temporary views are.
_OWNERS: dict[str, "Engine"] = {}
_BINDING = threading.RLock()

# Settings that PRAGMA knows and the values they take (None: any whole number).
SETTINGS = {"wal": ("on", "off"), "wal_autoflush": ("on", "off"), "synchronous": ("off", "normal", "full"), "join_memory_budget": None, "wal_checkpoint_threshold": None}


class TransactionError(RuntimeError):
    pass


def _kind_of(spark_name: str) -> str:
    if spark_name in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    return "float" if spark_name in ("float", "double") else "text" if spark_name == "string" else "array" if spark_name.startswith("array") else "other"


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        ship(spark)
        spark.udf.register("json_contains", F.pandas_udf(lambda a, b: pd.Series([json_contains(x, y) for x, y in zip(a, b)]), "boolean"))
        self.external: dict[str, DataFrame] = {}
        self.kinds: dict[str, str] = {}
        self.manifests = Manifests(spark, root) if root else None
        self.storage = st.Storage(spark, root) if root else None
        self.state = self.manifests.latest() if root else {"version": 0, "schemas": ["root"], "tables": {}, "views": {}}
        self.open: dict | None = None  # the state that a transaction began with
        self.read_only = False
        self.savepoints: list[tuple[str, dict]] = []
        self.foreign_keys = True
        self.settings = {"wal": "on", "wal_autoflush": "on", "synchronous": "full", "join_memory_budget": "10485760", "wal_checkpoint_threshold": "1000"}
        self.bound: dict[str, DataFrame] = {}  # what the session's views are to be
        self.fresh: set[str] = set()  # of these, what the session may not have yet
        self.stale = True  # whether views are to be analysed anew
        self._rebind()

    # ---- names

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame a table that can be read but not changed."""
        self.external[name.lower()] = df
        self._bind(name.lower(), df)

    def register_dir(self, sf_dir: str, names=None) -> "Engine":
        from tessera.sources.tables import TABLES, table

        for name in names or TABLES:
            self.register(name, table(self.spark, sf_dir, name))
        return self

    def _bind(self, name: str, df: DataFrame) -> None:
        self.bound[name] = df
        self.fresh.add(name)
        for column, kind in df.dtypes:
            known = _kind_of(kind)
            column = column.lower()
            self.kinds[column] = known if self.kinds.get(column, known) == known else "other"

    def _spark_sql(self, text: str, args=None) -> DataFrame:
        """Analyses a statement over this engine's tables, whatever other engines the session has."""
        with _BINDING:
            session = self.spark._jsparkSession.sessionUUID()
            owner = _OWNERS.get(session)
            if owner is not self:
                for name in owner.names() - self.names() if owner is not None else ():
                    self.spark.catalog.dropTempView(name)
                _OWNERS[session] = self
                self.fresh, self.stale = set(self.bound), True
            for name in self.fresh:
                self.bound[name].createOrReplaceTempView(name)
            if self.stale or self.fresh:
                for name, view in self.state["views"].items():
                    try:
                        self.spark.sql(view).createOrReplaceTempView(name)
                    except AnalysisException:  # what it reads is gone; it is bound again when that is back
                        self.spark.catalog.dropTempView(name)
            self.fresh, self.stale = set(), False
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def names(self) -> set[str]:
        return {*self.bound, *self.state["views"]}

    def _unbind(self, name: str) -> None:
        self.bound.pop(name, None)
        self.fresh.discard(name)
        if _OWNERS.get(self.spark._jsparkSession.sessionUUID()) is self:
            self.spark.catalog.dropTempView(name)

    def _table(self, name: str) -> dict:
        found = self.state["tables"].get(name.lower().removeprefix("root."))
        if found is None:
            raise CatalogError(f"no table {name}")
        return found

    def table(self, name: str) -> DataFrame:
        low = name.lower().removeprefix("root.")
        return self.external[low] if low in self.external else self.storage.read(self._table(low))

    def _rebind(self) -> None:
        tables = {name.replace(".", "_"): table for name, table in self.state["tables"].items()}
        for name in set(self.bound) - set(tables) - set(self.external):
            self._unbind(name)
        for name, table in tables.items():
            self._bind(name, self.storage.read(table))
        self.stale = True

    # ---- statements

    def sql(self, text: str, params: list | dict | None = None) -> DataFrame | None:
        """Runs one statement. Queries and RETURNING give a DataFrame; so do counts of changed rows."""
        r = Rewriter(text.strip().rstrip(";"), self.kinds)
        word = r.peek().low or r.peek().text
        if word in QUERY:
            return self.query(text, params)
        if params:
            return self.sql(bound(text, params))
        run = getattr(self, f"_{word}", None)
        if run is None:
            raise DialectError(f"unsupported statement {word.upper()}")
        r.take()
        if word not in ("begin", "start", "commit", "rollback", "savepoint", "release", "set", "explain", "pragma") and self.read_only:
            raise TransactionError("the transaction is read-only")
        return run(r)

    def query(self, text: str, params: list | dict | None = None) -> DataFrame:
        rewritten = self.rewrite(text)
        if isinstance(params, (list, tuple)):
            rewritten = _positional(rewritten)
        return self._spark_sql(rewritten, params)

    def rewrite(self, text: str) -> str:
        return dialect.rewrite(text, self.kinds)

    def prepare(self, text: str):
        """A statement to be called with its values. A query's text is rewritten once."""
        if (dialect.tokens(text)[0].low or "(") not in QUERY:
            return lambda *values: self.sql(text, list(values))
        rewritten = _positional(self.rewrite(text))
        return lambda *values: self._spark_sql(rewritten, list(values))

    def _changed(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows long")

    def _done(self) -> None:
        if self.open is None:
            self.state = self.manifests.commit(self.state) if self.manifests else self.state
        self._rebind()

    def _atomic(self, change):
        """Runs a change; if it raises, the catalog is as before."""
        before = copy.deepcopy(self.state)
        try:
            out = change()
            self._done()
            return out
        except Exception:
            self.state = before
            raise

    # transactions

    def _begin(self, r) -> None:
        if self.open is not None:
            raise TransactionError("a transaction is open already")
        self.state = self.manifests.latest() if self.manifests else self.state
        self.open, self.savepoints = copy.deepcopy(self.state), []
        self._rebind()
        rest = " ".join(t.low for t in r.tokens[r.at :])
        self.read_only = "read only" in rest

    _start = _begin

    def _commit(self, r) -> None:
        self._need()
        changed = self.state != self.open
        self.open, self.savepoints, self.read_only, before = None, [], False, self.open
        if changed and self.manifests:
            try:
                self.state = self.manifests.commit(self.state)
            except Exception:
                self.state = before
                self._rebind()
                raise

    def _rollback(self, r) -> None:
        self._need()
        if r.peek().low == "to":
            r.take()
            if r.peek().low == "savepoint":
                r.take()
            k = self._savepoint_at(r.take().text)
            self.state = copy.deepcopy(self.savepoints[k][1])
            del self.savepoints[k + 1 :]
        else:
            self.state, self.open, self.savepoints, self.read_only = self.open, None, [], False
        self._rebind()

    def _savepoint(self, r) -> None:
        self._need()
        self.savepoints.append((r.take().text.lower(), copy.deepcopy(self.state)))

    def _release(self, r) -> None:
        self._need()
        if r.peek().low == "savepoint":
            r.take()
        del self.savepoints[self._savepoint_at(r.take().text) :]

    def _savepoint_at(self, name: str) -> int:
        for k in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[k][0] == name.lower():
                return k
        raise TransactionError(f"no savepoint {name}")

    def _need(self) -> None:
        if self.open is None:
            raise TransactionError("no transaction is open")

    # settings

    def _set(self, r) -> None:
        name = r.take().low
        if r.peek().text in ("=", "") or r.peek().low == "to":
            r.take()
        value = r.take().text.strip("'").lower()
        if name == "foreign_keys":
            self.foreign_keys = value in ("on", "1", "true")

    def _pragma(self, r) -> DataFrame:
        """Settings are kept and checked (they have no bearing on how Spark runs); what is asked of the
        database is read from its manifests. wal_checkpoint compacts all tables."""
        name, value = r.take().low, None
        if r.peek().text == "=":
            r.take()
            value = r.sequence().strip("'").lower()
        if name in SETTINGS:
            if value is not None:
                value = {"true": "on", "1": "on", "false": "off", "0": "off"}.get(value, value) if SETTINGS[name] == ("on", "off") else value
                if not (value.isdigit() if SETTINGS[name] is None else value in SETTINGS[name]):
                    raise DialectError(f"invalid value {value!r} of PRAGMA {name}")
                self.settings[name] = value
            found = self.settings[name]
        elif name in ("wal_checkpoint", "wal_checkpoint_stats"):
            found = str(self.compact())
        elif name in ("wal_frame_count", "wal_size"):
            sizes = [self.manifests.fs.getFileStatus(p).getLen() for p in self.manifests.versions()] if self.manifests else []
            found = str(len(sizes) if name == "wal_frame_count" else sum(sizes))
        elif name in ("memory_budget", "memory_stats", "persisted_memory_stats"):
            found = self.spark.sparkContext.getConf().get("spark.executor.memory", "1g")
        elif name == "database_mode":
            found = "read_only" if self.read_only else "read_write"
        elif name == "recover_wal":
            self.state = self.manifests.latest() if self.manifests and self.open is None else self.state
            self._rebind()
            found = str(self.state["version"])
        elif name == "schema_version":
            found = str(self.state["version"])
        else:
            raise DialectError(f"unknown PRAGMA {name}")
        return self.spark.createDataFrame([(name, found.upper())], "name string, value string")

    def _explain(self, r) -> DataFrame:
        """The plan of a query, or of what a change of rows reads."""
        mode = "formatted"
        if r.peek().low == "verbose":
            r.take()
            mode = "extended"
        word = r.peek().low
        if word == "insert":
            r.take()
            self._words(r, "into")
            table = self._table(self._name(r))
            columns = self._names(r) if r.peek().text == "(" else [c["name"] for c in table["columns"]]
            body = "SELECT 1" if self._words(r, "default", "values") else self._body(r, columns)
        elif word in ("update", "delete"):
            r.take()
            self._words(r, "from")
            name = self._name(r)
            if word == "update":
                self._words(r, "set")
                self._assignments(r)
            other = r.sequence("where", "returning") if self._words(r, "using") or self._words(r, "from") else None
            where = r.sequence("returning") if self._words(r, "where") else None
            body = f"SELECT * FROM {name.replace('.', '_')}" + (f", {other}" if other else "") + (f" WHERE {where}" if where else "")
        else:
            body = r.sequence()
        return self._spark_sql(f"EXPLAIN {mode.upper()} {body}")

    def _show(self, r) -> DataFrame:
        """SHOW TABLES, SCHEMAS, VIEWS, INDEXES, COLUMNS FROM a table, or a setting."""
        what = r.take().low
        rows = {
            "tables": lambda: sorted(self.state["tables"]) + sorted(self.external),
            "schemas": lambda: sorted(self.state["schemas"]),
            "databases": lambda: sorted(self.state["schemas"]),
            "views": lambda: sorted(self.state["views"]),
            "indexes": lambda: sorted(i for t in self.state["tables"].values() for i in t["indexes"]),
        }
        if what == "columns":
            if not (self._words(r, "from") or self._words(r, "in")):
                raise DialectError("SHOW COLUMNS needs FROM")
            return self.spark.createDataFrame(self.table(self._name(r)).dtypes, "name string, type string")
        if what in rows:
            return self.spark.createDataFrame([(x,) for x in rows[what]()], "name string")
        if what in self.settings or what == "foreign_keys":
            value = ("on" if self.foreign_keys else "off") if what == "foreign_keys" else self.settings[what]
            return self.spark.createDataFrame([(what, value.upper())], "name string, value string")
        raise DialectError(f"unsupported SHOW {what.upper()}")

    def _reset(self, r) -> None:
        if r.take().low in ("foreign_keys", "all"):
            self.foreign_keys = True

    # upkeep

    def compact(self, name: str | None = None, most: int = 1) -> int:
        """Rewrites each table of over ``most`` folders as one; returns how many were."""
        wanted = [n for n, t in self.state["tables"].items() if name in (None, n) and len(t["files"]) > most]

        def change():
            for n in wanted:
                self._replace(n, self.table(n))
            return len(wanted)

        return self._atomic(change) if wanted else 0

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all manifests but the newest ``keep`` and the folders that none of these names; returns how
        many folders went. Readers of older versions, and writers that haven't committed yet, lose theirs."""
        if self.open is not None:
            raise TransactionError("a transaction is open")
        versions = self.manifests.versions()
        kept = versions[-max(1, keep) :]
        used = {f["path"].rstrip("/").rsplit("/", 1)[-1] for v in kept for t in self.manifests.read(v)["tables"].values() for f in t["files"]}
        gone = [p for p in self.storage.folders(self.manifests) if p.getName() not in used]
        for p in [*versions[: -len(kept)], *gone]:
            self.manifests.fs.delete(p, True)
        return len(gone)

    # definitions

    def _name(self, r) -> str:
        name = r.take().text.strip('"`').lower()
        while r.peek().text == ".":
            r.take()
            name += "." + r.take().text.strip('"`').lower()
        return name.removeprefix("root.")

    def _words(self, r, *words: str) -> bool:
        if all(r.peek(k).low == w for k, w in enumerate(words)):
            r.at += len(words)
            return True
        return False

    def _create(self, r):
        unique = self._words(r, "unique")
        if self._words(r, "table"):
            return self._atomic(lambda: self._create_table(r))
        if self._words(r, "index"):
            return self._atomic(lambda: self._create_index(r, unique))
        if self._words(r, "schema"):
            there = self._words(r, "if", "not", "exists")
            return self._atomic(lambda: self._create_schema(self._name(r), there))
        if self._words(r, "or", "replace", "view") or self._words(r, "view"):
            name = self._name(r)
            if not self._words(r, "as"):
                raise DialectError("CREATE VIEW needs AS")
            text = r.sequence()
            return self._atomic(lambda: self.state["views"].update({name: text}))
        raise DialectError("unsupported CREATE")

    def _create_schema(self, name: str, quiet: bool) -> None:
        if name in self.state["schemas"]:
            if not quiet:
                raise CatalogError(f"schema {name} is there already")
        else:
            self.state["schemas"].append(name)

    def _create_table(self, r) -> None:
        quiet = self._words(r, "if", "not", "exists")
        name = self._name(r)
        if name in self.state["tables"]:
            if quiet:
                return
            raise CatalogError(f"table {name} is there already")
        if "." in name and name.split(".")[0] not in self.state["schemas"]:
            raise CatalogError(f"no schema {name.split('.')[0]}")
        table = {"columns": [], "files": [], "unique": [], "checks": [], "foreign": [], "next": {}, "indexes": {}}
        r.expect("(")
        while True:
            self._column_or_constraint(r, table)
            if r.take().text == ")":
                break
        self.state["tables"][name] = table

    def _names(self, r) -> list[str]:
        r.expect("(")
        out = [r.take().text.strip('"`')]
        while r.take().text == ",":
            out.append(r.take().text.strip('"`'))
        return out

    def _reference(self, r) -> dict:
        key = {"table": self._name(r), "target": self._names(r) if r.peek().text == "(" else ["id"], "delete": "restrict", "update": "restrict"}
        while self._words(r, "on"):
            which = r.take().low
            words = [r.take().low]
            if words[0] in ("set", "no"):
                words.append(r.take().low)
            key[which] = {"no action": "restrict"}.get(" ".join(words), " ".join(words))
        return key

    def _column_or_constraint(self, r, table: dict) -> None:
        if self._words(r, "constraint"):
            r.take()
        if self._words(r, "primary", "key"):
            keys = self._names(r)
            table["unique"].append(keys)
            for c in table["columns"]:
                if c["name"].lower() in [k.lower() for k in keys]:
                    c["not_null"] = True
            return
        if r.peek().low == "unique" and r.peek(1).text == "(":
            r.take()
            table["unique"].append(self._names(r))
            return
        if self._words(r, "check"):
            r.expect("(")
            table["checks"].append(r.sequence(")"))
            r.expect(")")
            return
        if self._words(r, "foreign", "key"):
            columns = self._names(r)
            self._words(r, "references")
            table["foreign"].append(self._reference(r) | {"columns": columns})
            return
        table["columns"].append(self._column(r))

    def _column(self, r) -> dict:
        name = r.take().text.strip('"`')
        kind, argument = r.type_name()
        c = st.column(name, spark_type(kind, argument))
        if kind.upper() in ("CHAR", "VARCHAR") and argument:
            c["length"] = int(argument)
        if kind.upper().endswith("SERIAL"):
            c |= {"auto": True, "not_null": True}
        while r.peek().text not in (",", ")", ""):
            if self._words(r, "not", "null"):
                c["not_null"] = True
            elif self._words(r, "null"):
                pass
            elif self._words(r, "primary", "key"):
                c["primary"] = True
            elif self._words(r, "unique"):
                c["unique"] = True
            elif self._words(r, "default"):
                c["default"] = r.expression(0)[0]
            elif self._words(r, "check"):
                r.expect("(")
                c["check"] = r.sequence(")")
                r.expect(")")
            elif self._words(r, "references"):
                c["references"] = self._reference(r)
            elif r.peek().low in ("auto_increment", "autoincrement"):
                r.take()
                c["auto"] = True
            else:
                raise DialectError(f"unexpected {r.peek().text!r} after column {name}")
        return c

    def _create_index(self, r, unique: bool) -> None:
        quiet = self._words(r, "if", "not", "exists")
        name = r.take().text.lower()
        if not self._words(r, "on"):
            raise DialectError("CREATE INDEX needs ON")
        of = self._name(r)
        table = self._table(of)
        if name in table["indexes"]:
            if quiet:
                return
            raise CatalogError(f"index {name} is there already")
        method = r.take() and r.take().low if r.peek().low == "using" else "btree"
        r.expect("(")
        keys = []
        while True:
            keys.append(r.sequence(",", ")").removesuffix(" ASC").removesuffix(" DESC").removesuffix(" asc").removesuffix(" desc"))
            if r.take().text == ")":
                break
        if self._words(r, "using"):
            method = r.take().low
        partial = r.sequence() if self._words(r, "where") else None
        index = {"keys": keys, "unique": unique, "where": partial, "using": method}
        self._check_index(of, self.table(of), None, index)
        table["indexes"][name] = index

    def _check_index(self, name: str, fresh: DataFrame, old: DataFrame | None, index: dict) -> None:
        if index["unique"]:
            fresh, old = (df.where(index["where"]) if index["where"] and df is not None else df for df in (fresh, old))
            if st.repeated(fresh, old, [F.expr(k) for k in index["keys"]]):
                raise ConstraintError(f"{name}: duplicate key in a unique index on ({', '.join(index['keys'])})")

    def _drop(self, r):
        what = r.take().low
        quiet = self._words(r, "if", "exists")
        name = self._name(r)

        def change():
            if what == "index":
                for table in self.state["tables"].values():
                    if table["indexes"].pop(name, None):
                        return
            elif what == "schema":
                if name in self.state["schemas"]:
                    if any(t.startswith(f"{name}.") for t in self.state["tables"]) and not self._words(r, "cascade"):
                        raise CatalogError(f"schema {name} has tables")
                    self.state["tables"] = {t: d for t, d in self.state["tables"].items() if not t.startswith(f"{name}.")}
                    self.state["schemas"].remove(name)
                    return
            elif self.state[{"table": "tables", "view": "views"}[what]].pop(name, None) is not None:
                self._unbind(name.replace(".", "_"))
                return
            if not quiet:
                raise CatalogError(f"no {what} {name}")

        return self._atomic(change)

    def _alter(self, r):
        self._words(r, "table")
        name = self._name(r)

        def change():
            table = self._table(name)
            if self._words(r, "add"):
                self._words(r, "column")
                fresh = self._column(r)
                if fresh["name"].lower() in [c["name"].lower() for c in table["columns"]]:
                    raise CatalogError(f"{name} has a column {fresh['name']}")
                table["columns"].append(fresh)
                st.check_rows(name, table, self.table(name))
            elif self._words(r, "drop"):
                self._words(r, "column")
                gone = r.take().text.strip('"`').lower()
                if gone not in [c["name"].lower() for c in table["columns"]]:
                    raise CatalogError(f"{name} has no column {gone}")
                table["columns"] = [c for c in table["columns"] if c["name"].lower() != gone]
            elif self._words(r, "rename", "to"):
                new = self._name(r)
                self.state["tables"][new] = self.state["tables"].pop(name)
                self._unbind(name.replace(".", "_"))
            elif self._words(r, "rename"):
                self._words(r, "column")
                old = r.take().text.strip('"`').lower()
                self._words(r, "to")
                found = next((c for c in table["columns"] if c["name"].lower() == old), None)
                if found is None:
                    raise CatalogError(f"{name} has no column {old}")
                found["name"] = r.take().text.strip('"`')
            else:
                raise DialectError("unsupported ALTER TABLE")

        return self._atomic(change)

    def _truncate(self, r):
        self._words(r, "table")
        name = self._name(r)
        restart = self._words(r, "restart", "identity")

        def change():
            table = self._table(name)
            table["files"] = []
            if restart:
                table["next"] = {}

        return self._atomic(change)

    # ---- changes of rows

    def _validate(self, name: str, fresh: DataFrame, old: DataFrame | None = None) -> None:
        """Fresh rows against the table's constraints; old: the rows that stay beside them."""
        table = self._table(name)
        st.check_rows(name, table, fresh)
        st.check_unique(name, table, fresh, old)
        for index in table["indexes"].values():
            self._check_index(name, fresh, old, index)
        if self.foreign_keys:
            st.check_references(name, table, fresh, lambda p: (fresh if old is None else old.unionByName(fresh)) if p == name else self.table(p))

    def _write(self, df: DataFrame) -> DataFrame:
        """The rows written once, so that what is checked is what is stored."""
        path = f"{self.storage.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _replace(self, name: str, df: DataFrame) -> None:
        table = self._table(name)
        table["files"] = [self.storage.write(table, st.conform(table, df))]

    def insert(self, name: str, rows: DataFrame, conflict: list[str] | None = None, update: dict[str, str] | None = None) -> DataFrame:
        """Appends rows (columns by name; the others get their default). conflict: keys, [] for any
        key; rows that meet one are left out, or update the row there. Returns what was written."""
        name = name.lower().removeprefix("root.")

        def change():
            table = self._table(name)
            there = {c.lower() for c in rows.columns}
            unknown = there - {c["name"].lower() for c in table["columns"]}
            if unknown:
                raise CatalogError(f"{name} has no column {sorted(unknown)[0]}")
            given = self._write(st.placed(rows)) if conflict is not None or any(c.get("auto") for c in table["columns"]) else rows
            for c in table["columns"]:
                column = c["name"]
                if c.get("auto"):
                    first = table["next"].get(column, 1)
                    given = st.numbered(given, first, "tessera_auto")
                    own = F.col(f"`{column}`") if column.lower() in there else F.lit(None)
                    given = given.withColumn(column, F.coalesce(own.cast("long"), F.col("tessera_auto"))).drop("tessera_auto")
                    table["next"][column] = max(first, (given.agg(F.max(column)).first()[0] or 0) + 1)
                elif column.lower() not in there:
                    given = given.withColumn(column, F.expr(c.get("default") or "NULL"))
            if conflict is None:
                fresh = self._write(st.conform(table, given))
                self._validate(name, fresh, self.table(name))
                table["files"] = table["files"] + [self.storage.write(table, fresh)]
                return fresh
            fresh = self._write(self._conformed(table, given))
            if update is not None:
                return self._upsert(name, table, fresh, conflict, update)
            for key in [conflict] if conflict else st.unique_keys(table):
                null = reduce(Column.__or__, [F.col(k).isNull() for k in key])
                new = fresh.join(self.table(name).select(*key).dropna(), key, "left_anti")
                first = Window.partitionBy(*key).orderBy("tessera_place")
                one = new.where(~null).withColumn("tessera_n", F.row_number().over(first)).where("tessera_n = 1").drop("tessera_n")
                fresh = new.where(null).unionByName(one)
            fresh = self._write(fresh.select(*st.names(table)))
            self._validate(name, fresh, self.table(name))
            table["files"] = table["files"] + [self.storage.write(table, fresh)]
            return fresh

        return self._atomic(change)

    def _conformed(self, table: dict, given: DataFrame) -> DataFrame:
        return given.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(c["name"]) for c in table["columns"]], "tessera_place")

    def _upsert(self, name: str, table: dict, fresh: DataFrame, key: list[str], update: dict[str, str]) -> DataFrame:
        """Rows in the order of their places: the first of a key that isn't there goes in, any other updates
        the row of its key as it is by then. Returns the rows that went in or were updated, as they are at last."""
        low = {k.lower(): v for k, v in update.items()}
        columns = st.names(table)
        null = reduce(Column.__or__, [F.col(k).isNull() for k in key])
        order = Window.partitionBy(*key).orderBy("tessera_place")
        there = self.table(name).select(*key).dropna().distinct().withColumn("tessera_there", F.lit(1))
        ranked = fresh.where(~null).join(there, key, "left").withColumn("tessera_n", F.row_number().over(order) - F.when(F.col("tessera_there").isNull(), 1).otherwise(0))
        ranked = self._write(ranked.drop("tessera_place", "tessera_there"))
        entering = fresh.where(null).select(*columns).unionByName(ranked.where("tessera_n = 0").select(*columns))
        whole = self.table(name).withColumn("tessera_hit", F.lit(False)).unionByName(entering.withColumn("tessera_hit", F.lit(True)))
        same = reduce(Column.__and__, [F.col(k) == F.col(f"excluded_{k}") for k in key])
        for n in range(1, (ranked.agg(F.max("tessera_n")).first()[0] or 0) + 1):  # as often as one key is given
            new = ranked.where(F.col("tessera_n") == n).select(*[F.col(c).alias(f"excluded_{c}") for c in columns], F.lit(True).alias("tessera_met"))
            met = F.coalesce("tessera_met", F.lit(False))
            values = [
                (F.when(met, F.expr(low[c["name"].lower()]).cast(c["type"])).otherwise(F.col(c["name"])) if c["name"].lower() in low else F.col(c["name"])).alias(c["name"]) for c in table["columns"]
            ]
            whole = self._write(whole.join(new, same, "left").select(*values, (F.col("tessera_hit") | met).alias("tessera_hit")))
        table["files"] = [self.storage.write(table, whole, "tessera_hit")]
        stored = self.spark.read.schema(table["files"][0]["schema"] + ", tessera_hit boolean").parquet(table["files"][0]["path"])
        both = stored.select(*[F.col(f"`{c['stored']}`").alias(c["name"]) for c in table["columns"]], "tessera_hit")
        changed, rest = both.where("tessera_hit").drop("tessera_hit"), both.where("NOT tessera_hit").drop("tessera_hit")
        self._validate(name, changed, rest)
        return changed

    def _insert(self, r):
        self._words(r, "into")
        name = self._name(r)
        table = self._table(name)
        columns = self._names(r) if r.peek().text == "(" else [c["name"] for c in table["columns"]]
        if self._words(r, "default", "values"):
            given = self.spark.range(1).drop("id")
        else:
            given = self._spark_sql(self._body(r, columns))
            if len(given.columns) != len(columns):
                raise ConstraintError(f"{name}: {len(given.columns)} values for {len(columns)} columns")
            given = given.toDF(*columns)
        conflict = update = None
        if self._words(r, "on", "conflict"):
            conflict = self._names(r) if r.peek().text == "(" else []
            self._words(r, "do")
            if not self._words(r, "nothing"):
                self._words(r, "update")
                self._words(r, "set")
                update = {k: v.replace("excluded.", "excluded_").replace("EXCLUDED.", "excluded_") for k, v in self._assignments(r).items()}
                conflict = conflict or (st.unique_keys(table) or [[]])[0]
        fresh = self.insert(name, given, conflict, update)
        return self._returned(r, fresh)

    def _body(self, r, columns: list[str]) -> str:
        """The query that an INSERT takes its rows from."""
        return r.sequence("on", "returning") if r.peek().low != "values" else "SELECT * FROM " + r.take().text + " " + r.sequence("on", "returning")

    def _assignments(self, r) -> dict[str, str]:
        out = {}
        while True:
            name = r.take().text.strip('"`')
            r.expect("=")
            out[name] = r.sequence(",", "where", "from", "returning")
            if r.peek().text != ",":
                return out
            r.take()

    def _returned(self, r, df: DataFrame) -> DataFrame:
        if self._words(r, "returning"):
            return df.selectExpr(*_listed(r))
        return self._changed(df.count())

    def update(self, name: str, values: dict[str, str], where: str | None = None, other: str | None = None) -> DataFrame:
        """Sets columns to expressions of the old row. other: a table (and alias) to join, the condition
        in ``where``; of several rows there that meet one, any one is taken."""
        name = name.lower().removeprefix("root.")

        def change():
            table = self._table(name)
            low = {k.lower(): v for k, v in values.items()}
            unknown = set(low) - {c["name"].lower() for c in table["columns"]}
            if unknown:
                raise CatalogError(f"{name} has no column {sorted(unknown)[0]}")
            old, alias = self.storage.read(table, "tessera_row"), name.replace(".", "_")
            sets = ", ".join(f"CAST({v} AS {next(c['type'] for c in table['columns'] if c['name'].lower() == k)}) AS `tessera_set_{k}`" for k, v in low.items())
            source = f"tessera_old AS {alias}" + (f", {other}" if other else "")
            hit = self._over_old(old, f"SELECT `{alias}`.tessera_row AS tessera_hit, {sets} FROM {source}" + (f" WHERE {where}" if where else "")).dropDuplicates(["tessera_hit"])
            joined = old.join(hit, F.col("tessera_row") == F.col("tessera_hit"), "left")
            merged = [
                (F.when(F.col("tessera_hit").isNotNull(), F.col(f"tessera_set_{c['name'].lower()}")).otherwise(F.col(c["name"])) if c["name"].lower() in low else F.col(c["name"])).alias(c["name"])
                for c in table["columns"]
            ]
            # Written once: as the table, with marks beside its columns that only this statement reads.
            file = self.storage.write(table, joined.select(*merged, F.col("tessera_hit").isNotNull().alias("tessera_hit"), "tessera_row"), "tessera_hit", "tessera_row")
            marked = self.spark.read.schema(file["schema"] + ", tessera_hit boolean, tessera_row string").parquet(file["path"])
            marked = marked.select(*[F.col(f"`{c['stored']}`").alias(c["name"]) for c in table["columns"]], "tessera_hit", "tessera_row")
            fresh, rest = marked.where("tessera_hit").select(*st.names(table)), marked.where("NOT tessera_hit").select(*st.names(table))
            pairs = old.join(marked.where("tessera_hit").select("tessera_row", *[F.col(c).alias(f"new_{c}") for c in st.names(table)]), "tessera_row")
            table["files"] = [file]
            if self.foreign_keys:
                self._follow(name, pairs, set(low))
            self._validate(name, fresh, rest)
            return fresh

        return self._atomic(change)

    def _over_old(self, old: DataFrame, text: str) -> DataFrame:
        """A query over the view tessera_old of the given rows."""
        with _BINDING:
            old.createOrReplaceTempView("tessera_old")
            return self._spark_sql(text)

    def _children(self, name: str):
        for child, table in self.state["tables"].items():
            for key in st.foreign_keys(table):
                if key["table"] == name:
                    yield child, key

    def _follow(self, name: str, pairs: DataFrame, changed: set[str]) -> None:
        """ON UPDATE of the tables that refer to changed keys."""
        for child, key in list(self._children(name)):
            if not {c.lower() for c in key["target"]} & changed:
                continue
            moved = pairs.select(*[F.col(c).alias(f"was_{c}") for c in key["target"]], *[F.col(f"new_{c}").alias(f"now_{c}") for c in key["target"]])
            moved = moved.where(reduce(Column.__or__, [~F.col(f"was_{c}").eqNullSafe(F.col(f"now_{c}")) for c in key["target"]]))
            rows = self.table(child)
            same = reduce(Column.__and__, [F.col(a) == F.col(f"was_{b}") for a, b in zip(key["columns"], key["target"])])
            action = key["update"]
            if action == "restrict":
                if rows.join(moved, same, "left_semi").limit(1).count():
                    raise ConstraintError(f"{child} refers to rows of {name}")
                continue
            table = self._table(child)
            default = {c["name"].lower(): c.get("default") for c in table["columns"]}
            value = {a.lower(): F.col(f"now_{b}") if action == "cascade" else F.lit(None) if action == "set null" else F.expr(default[a.lower()] or "NULL") for a, b in zip(key["columns"], key["target"])}
            hit = F.col(f"was_{key['target'][0]}").isNotNull()
            joined = rows.join(moved.dropDuplicates([f"was_{c}" for c in key["target"]]), same, "left")
            self._replace(child, joined.select(*[(F.when(hit, value[c.lower()]).otherwise(F.col(c)) if c.lower() in value else F.col(c)).alias(c) for c in st.names(table)]))
            st.check_rows(child, table, self.table(child))

    def _update(self, r):
        name = self._name(r)
        if not self._words(r, "set"):
            raise DialectError("UPDATE needs SET")
        values = self._assignments(r)
        other = r.sequence("where", "returning") if self._words(r, "from") else None
        where = r.sequence("returning") if self._words(r, "where") else None
        return self._returned(r, self.update(name, values, where, other))

    def delete(self, name: str, where: str | None = None, using: str | None = None) -> DataFrame:
        """Deletes rows for which the condition is true; returns them."""
        name = name.lower().removeprefix("root.")

        def change():
            rows, alias = self.storage.read(self._table(name), "tessera_row"), name.replace(".", "_")
            hit = self._over_old(rows, f"SELECT `{alias}`.tessera_row FROM tessera_old AS {alias}" + (f", {using}" if using else "") + (f" WHERE {where}" if where else "")).distinct()
            gone = self._write(rows.join(hit, "tessera_row", "left_semi"))
            self._replace(name, rows.join(gone.select("tessera_row"), "tessera_row", "left_anti"))
            if self.foreign_keys:
                self._orphans(name, gone)
            return gone.drop("tessera_row")

        return self._atomic(change)

    def _orphans(self, name: str, gone: DataFrame) -> None:
        """ON DELETE of the tables that refer to deleted rows, and of those that refer to them."""
        for child, key in list(self._children(name)):
            keys = gone.select(*[F.col(c).alias(f"was_{c}") for c in key["target"]]).dropna().distinct()
            same = reduce(Column.__and__, [F.col(a) == F.col(f"was_{b}") for a, b in zip(key["columns"], key["target"])])
            rows = self.table(child)
            hit = self._write(rows.join(keys, same, "left_semi"))
            if not hit.limit(1).count():
                continue
            action, table = key["delete"], self._table(child)
            if action == "restrict":
                raise ConstraintError(f"{child} refers to rows of {name}")
            kept = rows.join(keys, same, "left_anti")
            if action == "cascade":
                self._replace(child, kept)
                self._orphans(child, hit)
                continue
            default = {c["name"]: c.get("default") for c in table["columns"]}
            fresh = hit
            for c in key["columns"]:
                fresh = fresh.withColumn(c, F.expr((default[c] if action == "set default" else None) or "NULL"))
            fresh = st.conform(table, fresh)
            st.check_rows(child, table, fresh)
            self._replace(child, kept.unionByName(fresh))

    def _merge(self, r):
        """MERGE INTO t [AS x] USING s ON c, then WHEN [NOT] MATCHED [AND c] THEN UPDATE SET, DELETE, INSERT or DO
        NOTHING: of the clauses that fit a row the first holds. A row may be met by one source row at most."""
        self._words(r, "into")
        name = self._name(r)
        table = self._table(name)
        alias = name.replace(".", "_")
        if self._words(r, "as") or r.peek().low != "using":
            alias = r.take().text
        if not self._words(r, "using"):
            raise DialectError("MERGE needs USING")
        source = r.sequence("on")
        self._words(r, "on")
        on = r.sequence("when")
        clauses = []
        while self._words(r, "when"):
            met = not self._words(r, "not")
            if not self._words(r, "matched"):
                raise DialectError("WHEN needs MATCHED")
            also = r.sequence("then") if self._words(r, "and") else "TRUE"
            self._words(r, "then")
            values = None
            if self._words(r, "update", "set"):
                values, what = self._merge_sets(r), "update"
            elif self._words(r, "delete"):
                what = "delete"
            elif self._words(r, "insert"):
                columns = self._names(r) if r.peek().text == "(" else [c["name"] for c in table["columns"]]
                if not self._words(r, "values"):
                    raise DialectError("INSERT of MERGE needs VALUES")
                r.expect("(")
                listed = [r.sequence(",", ")")]
                while r.take().text == ",":
                    listed.append(r.sequence(",", ")"))
                if len(listed) != len(columns):
                    raise ConstraintError(f"{name}: {len(listed)} values for {len(columns)} columns")
                values, what = dict(zip(columns, listed)), "insert"
            elif self._words(r, "do", "nothing"):
                what = "nothing"
            else:
                raise DialectError(f"unexpected {r.peek().text!r} in MERGE")
            if (what == "insert") == met and what != "nothing":
                raise DialectError(f"{what.upper()} doesn't go with WHEN {'' if met else 'NOT '}MATCHED")
            clauses.append((met, also, what, {k.lower(): v for k, v in (values or {}).items()}))
        if r.peek().kind != "end":
            raise DialectError(f"unexpected {r.peek().text!r} in MERGE")
        return self._atomic(lambda: self._changed(self._merged(name, table, alias, source, on, clauses)))

    def _merge_sets(self, r) -> dict[str, str]:
        out = {}
        while True:
            column = r.take().text.strip('"`')
            r.expect("=")
            out[column] = r.sequence(",", "when")
            if r.peek().text != ",":
                return out
            r.take()

    def _merged(self, name: str, table: dict, alias: str, source: str, on: str, clauses: list) -> int:
        columns = {c["name"].lower(): c for c in table["columns"]}
        for *_, values in clauses:
            if unknown := set(values) - set(columns):
                raise CatalogError(f"{name} has no column {sorted(unknown)[0]}")
        old = self.storage.read(table, "tessera_row")
        which = lambda met: "CASE " + " ".join(f"WHEN {c[1]} THEN {k}" for k, c in enumerate(clauses) if c[0] == met) + " END" if any(c[0] == met for c in clauses) else "CAST(NULL AS INT)"

        def value(k: int, c: dict, kept: str) -> str:
            return f"CAST({clauses[k][3].get(c['name'].lower(), kept)} AS {c['type']})"

        def cases(met: bool, c: dict, kept: str) -> str:
            mine = [k for k, x in enumerate(clauses) if x[0] == met and x[2] != "nothing" and x[2] != "delete"]
            return f"CASE tessera_which {' '.join(f'WHEN {k} THEN {value(k, c, kept)}' for k in mine)} ELSE {kept} END" if mine else kept

        own = lambda c: f"{alias}.`{c['name']}`"
        pairs = f"FROM tessera_old AS {alias} JOIN {source} ON {on}"
        sets = ", ".join(f"{cases(True, c, own(c))} AS `tessera_set_{k}`" for k, c in columns.items()).replace("tessera_which", f"({which(True)})")
        hit = self._over_old(old, f"SELECT {alias}.tessera_row AS tessera_hit, {which(True)} AS tessera_which, {sets} {pairs}")
        deleting = [k for k, c in enumerate(clauses) if c[2] == "delete"]
        changing = [k for k, c in enumerate(clauses) if c[2] == "update"]
        hit = hit.where(F.col("tessera_which").isin(deleting + changing)) if deleting + changing else hit.limit(0)
        if hit.groupBy("tessera_hit").count().where("count > 1").limit(1).count():
            raise ConstraintError(f"{name}: a row is met by several rows of the source")
        defaults = {k: c.get("default") or "NULL" for k, c in columns.items()}
        news = ", ".join(f"{cases(False, c, f'CAST({defaults[k]} AS {c['type']})')} AS `{c['name']}`" for k, c in columns.items()).replace("tessera_which", f"({which(False)})")
        fresh = self._over_old(old, f"SELECT {news}, {which(False)} AS tessera_which FROM {source} LEFT ANTI JOIN tessera_old AS {alias} ON {on}")
        inserting = [k for k, c in enumerate(clauses) if c[2] == "insert"]
        fresh = fresh.where(F.col("tessera_which").isin(inserting)) if inserting else fresh.limit(0)
        joined = old.join(hit, F.col("tessera_row") == F.col("tessera_hit"), "left")
        merged = [F.when(F.col("tessera_hit").isNotNull(), F.col(f"tessera_set_{k}")).otherwise(F.col(f"`{c['name']}`")).alias(c["name"]) for k, c in columns.items()]
        kind = F.when(F.col("tessera_which").isin(deleting), "gone").when(F.col("tessera_hit").isNotNull(), "new").otherwise("old") if deleting else F.when(F.col("tessera_hit").isNotNull(), "new").otherwise("old")
        marked = joined.select(*merged, kind.alias("tessera_kind"), "tessera_row")
        marked = self._write(marked.unionByName(fresh.select(*st.names(table), F.lit("new").alias("tessera_kind"), F.lit(None).cast("string").alias("tessera_row"))))
        changed, rest = marked.where("tessera_kind = 'new'"), marked.where("tessera_kind = 'old'")
        table["files"] = [self.storage.write(table, marked.where("tessera_kind <> 'gone'"))]
        if self.foreign_keys:
            pairs_ = old.join(changed.where("tessera_row IS NOT NULL").select("tessera_row", *[F.col(c).alias(f"new_{c}") for c in st.names(table)]), "tessera_row")
            self._follow(name, pairs_, {k for c in clauses if c[2] == "update" for k in c[3]})
            self._orphans(name, old.join(marked.where("tessera_kind = 'gone'").select("tessera_row"), "tessera_row", "left_semi"))
        self._validate(name, changed.select(*st.names(table)), rest.select(*st.names(table)))
        return marked.where("tessera_kind <> 'old'").count()

    def _delete(self, r):
        self._words(r, "from")
        name = self._name(r)
        using = r.sequence("where", "returning") if self._words(r, "using") else None
        where = r.sequence("returning") if self._words(r, "where") else None
        return self._returned(r, self.delete(name, where, using))


def literal(value) -> str:
    """A Python value as a literal of the dialect."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (bytes, bytearray)):
        return f"unhex('{bytes(value).hex()}')"
    if isinstance(value, (list, tuple)):
        return f"ARRAY[{', '.join(map(literal, value))}]"
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def bound(text: str, params: list | dict) -> str:
    """A statement with ``?``, ``$n`` or ``:name`` replaced by literals."""
    out, at = [], 0
    for t in dialect.tokens(text):
        if t.kind != "param":
            out.append(t.text)
        elif t.text == "?":
            out.append(literal(params[at]))
            at += 1
        else:
            out.append(literal(params[int(t.text[1:]) - 1] if t.text[0] == "$" else params[t.text[1:]]))
    return " ".join(out)


def _listed(r: Rewriter) -> list[str]:
    out = [r.sequence(",")]
    while r.peek().text == ",":
        r.take()
        out.append(r.sequence(","))
    return out


def _positional(sql: str) -> str:
    """``$1`` style parameters, in order, as ``?``."""
    return " ".join("?" if t.kind == "param" and t.text.startswith("$") else t.text for t in dialect.tokens(sql)) if "$" in sql else sql
