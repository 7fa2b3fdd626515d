"""Table definitions, their data as lists of immutable folders, and constraint checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ConstraintError(ValueError):
    """Rows that a constraint forbids."""


class CatalogError(ValueError):
    """A name that is missing, or there already."""


def column(name: str, kind: str, **more) -> dict:
    """more: not_null, default, check, unique, primary, auto, references, length. Files know a column
    by a name of its own that never changes, whatever it is renamed to."""
    return {"name": name, "type": kind, "stored": f"{name}_{uuid.uuid4().hex[:8]}"} | more


def schema_text(table: dict) -> str:
    return ", ".join(f"`{c['name']}` {c['type']}" for c in table["columns"])


def names(table: dict) -> list[str]:
    return [c["name"] for c in table["columns"]]


def unique_keys(table: dict) -> list[list[str]]:
    single = [[c["name"]] for c in table["columns"] if c.get("unique") or c.get("primary")]
    return single + table.get("unique", [])


class Storage:
    """Reads and writes table data below a root; nothing that is written is changed later."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: dict, place: str | None = None) -> DataFrame:
        """The rows; folders of one schema are read in one scan. place: the name of a further column that tells
        each row by its file and its number there, which never change."""
        if not table["files"]:
            empty = self.spark.createDataFrame([], schema_text(table))
            return empty.withColumn(place, F.lit(None).cast("string")) if place else empty
        alike: dict[str, list[str]] = {}
        for f in table["files"]:
            alike.setdefault(f["schema"], []).append(f["path"])
        parts = [self.spark.read.schema(schema).parquet(*paths) for schema, paths in alike.items()]
        return reduce(DataFrame.unionByName, [self._as(table, p, place) for p in parts])

    def _as(self, table: dict, part: DataFrame, place: str | None = None) -> DataFrame:
        """Columns that were added after a file was written have their default there."""
        out = []
        for c in table["columns"]:
            value = F.col(f"`{c['stored']}`") if c["stored"] in part.columns else F.expr(c.get("default") or "NULL")
            out.append(value.cast(c["type"]).alias(c["name"]))
        if place:
            out.append(F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias(place))
        return part.select(*out)

    def write(self, table: dict, df: DataFrame, *more: str) -> dict:
        """Writes the table's columns, and further ones beside them that its readers don't see."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{c['name']}`").alias(c["stored"]) for c in table["columns"]], *more).write.parquet(path)
        return {"path": path, "schema": ", ".join(f"`{c['stored']}` {c['type']}" for c in table["columns"])}

    def folders(self, manifests) -> list:
        """The paths of all data folders."""
        top = manifests._path(f"{self.root}/data")
        return [s.getPath() for s in manifests.fs.listStatus(top)] if manifests.fs.exists(top) else []


def conform(table: dict, df: DataFrame) -> DataFrame:
    """Columns in order and of the declared types; a value that doesn't fit its type raises when it is written."""
    return df.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(c["name"]) for c in table["columns"]])


def check_rows(name: str, table: dict, df: DataFrame) -> None:
    """NOT NULL, lengths and CHECKs of the rows, in one pass; a CHECK passes if it isn't false."""
    rules: list[tuple[str, Column]] = []
    for c in table["columns"]:
        value = F.col(f"`{c['name']}`")
        if c.get("not_null") or c.get("primary"):
            rules.append((f"{name}.{c['name']} must not be null", value.isNull()))
        if c.get("length"):
            rules.append((f"{name}.{c['name']} is longer than {c['length']}", F.char_length(value) > c["length"]))
        if c.get("check"):
            rules.append((f"{name}: CHECK ({c['check']})", ~F.expr(c["check"])))
    rules += [(f"{name}: CHECK ({text})", ~F.expr(text)) for text in table.get("checks", [])]
    if rules:
        counts = df.agg(*[F.count(F.when(bad, 1)).alias(f"r{k}") for k, (_, bad) in enumerate(rules)]).first()
        for (what, _), n in zip(rules, counts):
            if n:
                raise ConstraintError(f"{what}: {n} rows")


def check_unique(name: str, table: dict, fresh: DataFrame, old: DataFrame | None = None) -> None:
    """Keys of the fresh rows, among themselves and against the rows that are there; a key with a null in
    it is never a duplicate."""
    for key in unique_keys(table):
        found = repeated(fresh, old, [F.col(f"`{k}`") for k in key])
        if found:
            raise ConstraintError(f"{name}: duplicate key {found} of ({', '.join(key)})")


def repeated(fresh: DataFrame, old: DataFrame | None, key: list[Column]) -> tuple | None:
    """A key that two fresh rows have, or a fresh row and an old one."""
    keyed = lambda df: df.select(*[k.alias(f"k{i}") for i, k in enumerate(key)]).dropna()
    mine = keyed(fresh)
    twice = mine.groupBy(*mine.columns).count().where("count > 1").limit(1).collect()
    if not twice and old is not None:
        twice = mine.join(keyed(old), mine.columns, "left_semi").withColumn("n", F.lit(0)).limit(1).collect()
    return tuple(twice[0])[:-1] if twice else None


def foreign_keys(table: dict) -> list[dict]:
    own = [c["references"] | {"columns": [c["name"]]} for c in table["columns"] if c.get("references")]
    return own + table.get("foreign", [])


def check_references(name: str, table: dict, df: DataFrame, parent_of) -> None:
    for key in foreign_keys(table):
        parent = parent_of(key["table"]).select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(key["target"])]).distinct()
        child = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(key["columns"])]).dropna()
        same = reduce(Column.__and__, [F.col(f"c{k}") == F.col(f"p{k}") for k in range(len(key["columns"]))])
        missing = child.join(parent, same, "left_anti").limit(1).collect()
        if missing:
            raise ConstraintError(f"{name}: {tuple(missing[0])} isn't in {key['table']} ({', '.join(key['target'])})")


def placed(df: DataFrame) -> DataFrame:
    """Marks each row with its place (partition, then row), before the rows are written."""
    return df.withColumn("tessera_place", F.monotonically_increasing_id())


def numbered(df: DataFrame, first: int, into: str) -> DataFrame:
    """Consecutive numbers in the order of places, without gathering all rows in one task.
    The rows must not change between runs: place them, then write them."""
    parted = df.withColumn("tessera_p", F.shiftright("tessera_place", 33))
    sizes = {r["tessera_p"]: r["count"] for r in parted.groupBy("tessera_p").count().collect()}
    starts, at = {}, first
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("tessera_p")] if starts else F.lit(first)
    row = F.row_number().over(Window.partitionBy("tessera_p").orderBy("tessera_place"))
    return parted.withColumn(into, (start + row - 1).cast("long")).drop("tessera_p")
