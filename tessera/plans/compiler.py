"""A Select to a lazy DataFrame: names, joins, filters, aggregates, order and limits; no job is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousColumnError, BareTableNameError, EngineError, TypeMismatchError, UnknownAliasError, UnknownColumnError
from ..functions.expressions import Compiler
from ..functions.types import TAGS, family_of
from . import nodes as n


class Relation:
    """A joined relation whose columns have the internal names alias.column."""

    def __init__(self, df: DataFrame, names: list[tuple[str, str]], families: dict[tuple[str, str], str], tables: dict[str, str], merged: set[str]):
        self.df, self.names, self.families, self.tables, self.merged = df, names, families, tables, merged

    @staticmethod
    def of(source: n.Source, df: DataFrame) -> Relation:
        names = [(source.alias, f.name) for f in df.schema.fields]
        families = {(source.alias, f.name): family_of(f) for f in df.schema.fields}
        renamed = df.select(*[F.col(f"`{c}`").alias(inner(source.alias, c)) for c in df.columns])
        return Relation(renamed, names, families, {source.alias: source.table}, set())

    def find(self, name: n.Name) -> tuple[str, str]:
        if name.table is not None:
            if name.table not in self.tables:
                if name.table in self.tables.values():
                    raise BareTableNameError(f"{name.table} has an alias here: {', '.join(a for a, t in self.tables.items() if t == name.table)}")
                raise UnknownAliasError(f"no table or alias {name.table}")
            if (name.table, name.column) not in self.families:
                raise UnknownColumnError(f"{name.table} has no column {name.column}")
            return name.table, name.column
        hits = [x for x in self.names if x[1] == name.column]
        if not hits:
            raise UnknownColumnError(f"no column {name.column}")
        if len(hits) > 1 and name.column not in self.merged and len({self.tables[a] for a, _ in hits}) > 1:
            raise AmbiguousColumnError(f"{name.column} is in {', '.join(a for a, _ in hits)}")
        return hits[0]  # of a self-join or a merged column the left one

    def resolve(self, name: n.Name) -> tuple[Column, str]:
        at = self.find(name)
        return F.col(f"`{inner(*at)}`"), self.families[at]


def inner(alias: str, column: str) -> str:
    return f"{alias}\x1f{column}"


def label(item) -> str:
    if isinstance(item, n.Name):
        return item.column
    if isinstance(item, n.Aggregate):
        return f"{item.func}({item.column})"
    if isinstance(item, n.Literal):
        return f"L[{TAGS[item.family]}]:{item.value!r}" if item.typed else f"L:{item.value!r}"
    return "BinaryOp" if isinstance(item, n.Binary) else "UnaryOp"


def labels(items) -> list[str]:
    """Output names; a repeated one is told apart by its table or a number."""
    out: list[str] = []
    for item in items:
        name = label(item)
        if name in out and isinstance(item, n.Name) and item.table:
            name = f"{item.table}.{item.column}"
        base, k = name, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def _on(e, compiler: Compiler) -> Column:
    """A join condition; equality of two columns does not match nulls, so that it stays an ordinary join key."""
    if isinstance(e, n.Binary) and e.op == "AND":
        return _on(e.left, compiler) & _on(e.right, compiler)
    if isinstance(e, n.Binary) and e.op == "=" and isinstance(e.left, n.Name) and isinstance(e.right, n.Name):
        (a, f), (b, g) = compiler.value(e.left), compiler.value(e.right)
        if f == g or {f, g} <= {"int", "float", "decimal"}:
            return a == b
    return compiler.truth(e)


def joined(left: Relation, join: n.Join, right: Relation, null_safe_on: bool) -> Relation:
    if set(left.tables) & set(right.tables):
        raise EngineError(f"the alias {join.source.alias} is used twice")
    both = Relation(left.df, left.names + right.names, left.families | right.families, left.tables | right.tables, left.merged | set(join.using))
    compiler = Compiler(both.resolve)
    if join.using:
        condition = None
        for c in join.using:
            a, f = left.resolve(n.Name(c))
            b, g = right.resolve(n.Name(c))
            if f != g and not {f, g} <= {"int", "float", "decimal"}:
                raise TypeMismatchError(f"USING {c} joins {f} and {g}")
            one = a.eqNullSafe(b) if null_safe_on else a == b
            condition = one if condition is None else condition & one
    else:
        condition = compiler.truth(join.on) if null_safe_on else _on(join.on, compiler)
    both.df = left.df.join(right.df, condition, join.how)
    return both


def aggregate(func: str, column: Column | None, family: str) -> Column:
    if column is None:
        if func != "COUNT":
            raise EngineError(f"{func}(*) has no value")
        return F.count(F.lit(1))
    if func in ("SUM", "AVG") and family not in ("int", "float", "decimal", "null"):
        raise TypeMismatchError(f"{func} takes numbers, not {family}")
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[func](column)


def ordered(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def compile_select(select: n.Select, table: Callable[[str], DataFrame], null_safe_on: bool = False) -> DataFrame:
    """The statement's DataFrame. Nulls come last in ascending and first in descending order."""
    rel = Relation.of(select.source, table(select.source.table))
    for join in select.joins:
        rel = joined(rel, join, Relation.of(join.source, table(join.source.table)), null_safe_on)
    compiler = Compiler(rel.resolve)
    df = rel.df if select.where is None else rel.df.where(compiler.truth(select.where))
    aggregates = [x for x in select.items or () if isinstance(x, n.Aggregate)]
    if aggregates or select.group is not None:
        df = _grouped(select, rel, df, aggregates)
    else:
        if select.items is None:
            shown: dict[str, Column] = {}
            for at in rel.names:
                shown.setdefault(at[1], F.col(f"`{inner(*at)}`"))
            out = [c.alias(name) for name, c in shown.items()]
        else:
            out = [compiler.value(x)[0].alias(name) for x, name in zip(select.items, labels(select.items), strict=True)]
        if select.order:
            df = df.orderBy(*[ordered(rel.resolve(c)[0], d) for c, d in select.order])
        df = df.select(*out)
    if select.limit is not None:
        df = df.offset(select.offset).limit(select.limit) if select.offset else df.limit(select.limit)
    return df


def _grouped(select: n.Select, rel: Relation, df: DataFrame, aggregates: list[n.Aggregate]) -> DataFrame:
    if select.items is None:
        raise EngineError("SELECT * has no meaning with GROUP BY")
    keys = [rel.find(n.Name(c)) for c in select.group or ()]
    for x in select.items:
        if not isinstance(x, n.Aggregate) and (not isinstance(x, n.Name) or rel.find(x) not in keys):
            raise EngineError(f"{label(x)} is neither a group key nor an aggregate")
    names = labels(select.items)
    made = {}
    for x in aggregates:
        column, family = (None, "") if x.column == "*" else rel.resolve(n.Name(x.column))
        made[label(x)] = aggregate(x.func, column, family).alias(label(x))
    if keys:
        inside = [inner(*k) for k in keys]
        df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in inside))
        grouped = df.groupBy(*[F.col(f"`{k}`") for k in inside])
        df = grouped.agg(*made.values()) if made else df.select(*[F.col(f"`{k}`") for k in inside]).distinct()
    else:
        df = df.agg(*made.values())
    if select.order:
        by = []
        for c, d in select.order:
            if c.table is None and c.column in made:
                by.append(ordered(F.col(f"`{c.column}`"), d))
            elif rel.find(c) in keys:
                by.append(ordered(F.col(f"`{inner(*rel.find(c))}`"), d))
            else:
                raise EngineError(f"ORDER BY {c.column} is not a group key")
        df = df.orderBy(*by)
    return df.select(*[F.col(f"`{label(x)}`" if isinstance(x, n.Aggregate) else f"`{inner(*rel.find(x))}`").alias(name) for x, name in zip(select.items, names, strict=True)])
