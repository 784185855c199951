"""Projections: specifications of tables over nested frames, compiled to DataFrame plans.

A specification names tables; each has an anchor path, columns, and optionally a filter, a key and states that accumulate along
the document. Mistakes are found when it is compiled (``ProjectionError`` with a code and the place). Keys are dense from 1 in
each file, in document order, over the rows that the filter keeps; states see all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.functions.expr import Lowering, Node, Value, parse, truthy, value_of
from binframe.functions.types import SPARK, cast

RESERVED_COLUMNS, RESERVED_TABLES = {"_src_start", "_src_end", "_src_ranges", "_src_file"}, {"errors", "_files"}
VERSIONS = ("0.4", "0.5")


class ProjectionError(ValueError):
    def __init__(self, code: str, path: str, message: str = "") -> None:
        super().__init__(f"{code} in {path}: {message}")
        self.code, self.path = code, path


_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\*|\d+)\]")


def parse_anchor(path: str) -> list[str | int]:
    """Steps of ``$.a[*].b[0]``: field names, "*" and positions."""
    if not path.startswith("$"):
        raise ProjectionError("ANCHOR_SYNTAX", path, "starts with $")
    at, steps = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ProjectionError("ANCHOR_SYNTAX", path, f"unexpected {path[at]!r} at {at}")
        steps.append(m[1] or ("*" if m[2] == "*" else int(m[2])))
        at = m.end()
    return steps


@dataclass
class Table:
    name: str
    rows: str
    columns: list[dict[str, Any]]
    where: str | None = None
    key: str | None = None
    state: list[dict[str, str]] = field(default_factory=list)
    parent: str | None = None


def compile_spec(spec: dict[str, Any]) -> list[Table]:
    """Checked tables of a specification."""
    if str(spec.get("version", VERSIONS[-1])) not in VERSIONS:
        raise ProjectionError("UNSUPPORTED_VERSION", "version", str(spec.get("version")))
    out, seen = [], set()
    for t in spec.get("tables", []):
        name = t.get("name", "")
        if name.lower() in RESERVED_TABLES:
            raise ProjectionError("RESERVED_TABLE", name)
        if name.lower() in seen:
            raise ProjectionError("DUPLICATE_TABLE", name)
        seen.add(name.lower())
        steps = parse_anchor(t["rows"])
        columns = set()
        for c in t.get("columns", []):
            where = f"{name}.{c.get('name')}"
            if c.get("name") in RESERVED_COLUMNS or c.get("name") in columns or c.get("name") == t.get("key"):
                raise ProjectionError("RESERVED_COLUMN" if c["name"] in RESERVED_COLUMNS else "DUPLICATE_COLUMN", where)
            columns.add(c["name"])
            if c.get("type") not in SPARK:
                raise ProjectionError("UNKNOWN_TYPE", where, str(c.get("type")))
            parse(c["expr"])
            if c.get("when"):
                parse(c["when"])
        for s in t.get("state", []):
            scope = parse_anchor(s.get("scope", "$"))
            if steps[: len(scope)] != scope:
                raise ProjectionError("STATE_SCOPE", f"{name}.{s['name']}", "must begin the table's anchor")
            parse(s["init"])
            parse(s["update"])
        out.append(Table(name, t["rows"], t.get("columns", []), t.get("where"), t.get("key"), t.get("state", []), t.get("parent")))
    return out


def traverse(frames: DataFrame, root: str, anchor: str) -> tuple[DataFrame, str, list[str], list[str]]:
    """Rows of an anchor: frames with a column for the node, for each parent and for each position of an iteration.

    Iterations explode, so that nested ones give their product in document order; absent fields and positions match nothing.
    """
    df, node, parents, indexes = frames.withColumn("__n0", F.col(root)), "__n0", [], []
    for k, step in enumerate(parse_anchor(anchor), 1):
        t = df.schema[node].dataType
        new = f"__n{k}"
        parents.insert(0, node)
        if step == "*":
            if not isinstance(t, T.ArrayType):
                raise ProjectionError("ANCHOR_TYPE", anchor, "[*] needs an array")
            index = f"__i{len(indexes)}"
            df = df.select("*", F.posexplode(node).alias(index, new))
            indexes.append(index)
        elif isinstance(step, int):
            if not isinstance(t, T.ArrayType):
                raise ProjectionError("ANCHOR_TYPE", anchor, "[n] needs an array")
            df = df.withColumn(new, F.get(node, F.lit(step))).where(F.size(node) > step)
        else:
            if not isinstance(t, T.StructType) or step not in t.names:
                raise ProjectionError("ANCHOR_FIELD", anchor, step)
            df = df.withColumn(new, F.col(node).getField(step)).where(F.col(node).getField(step).isNotNull())
        node = new
    return df, node, parents, indexes


def _uses(node: Node, name: str) -> bool:
    return node[:2] == ("name", name) or any(_uses(x, name) for x in node if isinstance(x, tuple))


def _with_state(df: DataFrame, s: dict[str, str], names: dict[str, Value], indexes: list[str], order: list[str]) -> tuple[DataFrame, Value]:
    """A column for one state: its value after the row's update.

    ``r + f(row)`` is a running sum and ``f(row)`` without r just f; other updates fold over the rows so far, whose number the
    scope bounds.
    """
    scope = [i for i, _ in zip(indexes, [x for x in parse_anchor(s.get("scope", "$")) if x == "*"], strict=False)]
    w = Window.partitionBy("_src_file", *(["ordinal"] if scope or s.get("scope", "$") != "$" else []), *scope).orderBy("ordinal", *order).rowsBetween(Window.unboundedPreceding, 0)
    lower = Lowering(names, [F.col(i) for i in indexes])
    init, update, name = lower(s["init"]), parse(s["update"]), s["name"]
    column = f"__s_{name}"
    if not _uses(update, name):
        v = lower.lower(update)
        return df.withColumn(column, v.column), Value(F.col(column), v.kind)
    for add, other in ((update[1], update[2]), (update[2], update[1])) if update[0] == "+" and len(update) == 3 else ():
        if add[:2] == ("name", name) and not _uses(other, name):
            v = lower.lower(other)
            if v.kind in ("long", "double") and init.kind in ("long", "double"):
                kind = "long" if v.kind == init.kind == "long" else "double"
                return df.withColumn(column, (init.column + F.sum(v.column).over(w)).cast(kind)), Value(F.col(column), kind)
    inputs = {k: v for k, v in names.items() if _uses(update, k)}
    seen = F.collect_list(F.struct(F.lit(0).alias("__"), *[v.column.alias(k) for k, v in inputs.items()])).over(w)
    held = df.withColumn(column, seen)
    types = {f.name: f.dataType for f in held.schema[column].dataType.elementType.fields}

    def step(acc: Column, row: Column) -> Column:
        bound = {k: value_of(row[k], types[k]) for k in inputs} | {name: Value(acc, init.kind)}
        return Lowering(bound).lower(update).column.cast("long" if init.kind == "long" else init.kind)

    return held.withColumn(column, F.aggregate(column, init.column, step)), Value(F.col(column), init.kind)


def project(frames: DataFrame, table: Table, *, root: str = "root", strict: bool = False) -> DataFrame:
    """One table of a specification over frames (_src_file, ordinal, root, _src_start, _src_end; parent keys are carried)."""
    df, node, parents, indexes = traverse(frames, root, table.rows)
    names: dict[str, Value] = {"_": value_of(F.col(node), df.schema[node].dataType), "_root": value_of(F.col("__n0"), df.schema["__n0"].dataType)}
    if parents:
        names["_parent"] = value_of(F.col(parents[0]), df.schema[parents[0]].dataType)
    for s in table.state:
        df, names[s["name"]] = _with_state(df, s, names, indexes, indexes)
    lower = Lowering(names, [F.col(i) for i in indexes], strict)
    if table.where:
        df = df.where(truthy(lower(table.where)))
    out: list[Column] = []
    if table.key:
        w = Window.partitionBy("_src_file").orderBy("ordinal", *indexes)
        out.append(F.row_number().over(w).cast("long").alias(table.key))
    if table.parent:
        out.append(F.col(table.parent))
    for c in table.columns:
        value = cast(lower(c["expr"]).column, c["type"])
        out.append((F.when(truthy(lower(c["when"])), value) if c.get("when") else value).alias(c["name"]))
    return df.select(*out, *[F.col(c) for c in ("_src_start", "_src_end", "_src_file") if c in frames.columns])
