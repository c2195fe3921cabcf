"""INSERT, UPDATE and DELETE as whole-set rewrites into new directories, checked before they count."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ConstraintViolation, NotNullViolation, TypeMismatchError, UnknownAliasError, UnknownColumnError
from ..functions.expressions import Compiler
from ..functions.types import coerced, spark_type
from ..plans import nodes as n
from ..sources.store import Store, Table

#: So many directories of one size tier are merged into one; a tier holds sizes within a factor of TIER.
MERGED, TIER, LEAST_BYTES = 32, 8, 1 << 20
#: An INSERT of more rows looks its keys up by a join.
MOST_LITERALS = 256
#: Characters of the longest text that a manifest keeps as a bound of a directory's keys.
LONGEST_BOUND = 64


def _compiler(table: Table) -> Compiler:
    families = {c.name: c.family for c in table.columns}

    def resolve(name: n.Name):
        if name.table not in (None, table.name):
            raise UnknownAliasError(f"no table or alias {name.table}")
        if name.column not in families:
            raise UnknownColumnError(f"{table.name} has no column {name.column}")
        return F.col(f"`{name.column}`"), families[name.column]

    return Compiler(resolve)


def _column(table: Table, name: str) -> n.Column:
    for c in table.columns:
        if c.name == name:
            return c
    raise UnknownColumnError(f"{table.name} has no column {name}")


def _repeated(df: DataFrame, key: tuple[str, ...]) -> bool:
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    return not known.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _literals(table: Table, rows: list[tuple]) -> pa.Table:
    schema = to_arrow_schema(table.schema)
    columns = [pa.array([bytes(v) if isinstance(v, bytearray) else v for v in c], f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.Table.from_arrays(columns, schema=schema)


def _range(values: list) -> list | None:
    """The least and the greatest of a key's whole numbers or short texts, [] of none; None where they are not kept."""
    if not all(type(v) is int or type(v) is str and len(v) <= LONGEST_BOUND for v in values):
        return None
    return [min(values), max(values)] if values else []


def _apart(bounds: list | None, values: set) -> bool:
    """Whether a directory with these bounds surely holds none of the values."""
    return bounds is not None and (not bounds or all(v < bounds[0] or v > bounds[1] for v in values))


def insert(store: Store, table: Table, statement: n.Insert) -> int:
    names = list(statement.columns) if statement.columns is not None else [c.name for c in table.columns]
    if len(set(names)) != len(names):
        raise ValueError("a column is named twice")
    columns = [_column(table, c) for c in names]
    rows = []
    for values in statement.rows:
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for {len(names)} columns")
        given = {c.name: coerced(v.value, c) for c, v in zip(columns, values, strict=True)}
        for c in table.columns:
            if c.not_null and given.get(c.name) is None:
                raise NotNullViolation(f"{table.name}.{c.name} is NOT NULL")
        rows.append(tuple(given.get(c.name) for c in table.columns))
    new = _literals(table, rows)
    at, ranges = {c.name: i for i, c in enumerate(table.columns)}, {}
    for key in table.unique_keys():
        keys = [k for r in rows if None not in (k := tuple(bytes(r[at[c]]) if isinstance(r[at[c]], bytearray) else r[at[c]] for c in key))]
        first = {k[0] for k in keys}
        files = [f for f in table.files if not _apart(table.ranges.get(f, {}).get(key[0]), first)]
        bounds = _range([r[at[key[0]]] for r in rows if r[at[key[0]]] is not None])
        if bounds is not None:
            ranges[key[0]] = bounds
        clash = len(set(keys)) != len(keys)
        if not clash and keys and files:
            old = store.read(Table(table.name, table.columns, files, table.indexes))
            if len(key) == 1 and len(keys) <= MOST_LITERALS:
                clash = not old.where(F.col(f"`{key[0]}`").isin([k[0] for k in keys])).isEmpty()  # pushed to the files
            else:
                # The statement's own literals are the small side; their number is the statement's.
                ours = F.broadcast(store.spark.createDataFrame(new, table.schema).select(*[F.col(f"`{c}`") for c in key]))
                clash = not old.join(ours, list(key), "left_semi").isEmpty()
        if clash:
            raise ConstraintViolation(f"UNIQUE {table.name}({', '.join(key)})")
    table.files.append(store.write_rows(table, new))
    table.ranges[table.files[-1]] = ranges
    if len(table.files) > MERGED and len(table.files) % 8 == 0:
        compact(store, table)
    return len(rows)


def compact(store: Store, table: Table) -> int:
    """Merge directories of like size where there are MERGED or more; how many went.

    Only these are read and written, so a row is rewritten about once for every factor of TIER by
    which its directory grows, whatever the size of the table.
    """
    tiers: dict[int, list[str]] = {}
    for f in table.files:
        bytes_, tier = store.size(f), 0
        while bytes_ > LEAST_BYTES:
            bytes_, tier = bytes_ // TIER, tier + 1
        tiers.setdefault(tier, []).append(f)
    gone = 0
    for tier in sorted(tiers):
        if len(tiers[tier]) >= MERGED:
            part = Table(table.name, table.columns, tiers[tier], table.indexes)
            new = store.write(table, store.read(part).coalesce(1) if not tier else store.read(part), whole=tier > 0)
            table.files = [f for f in table.files if f not in tiers[tier]] + [new]
            known = [table.ranges.pop(f, {}) for f in tiers[tier]]
            table.ranges[new] = {c: _range([v for r in known for v in r[c]]) for c in set.intersection(*map(set, known))}
            gone += len(tiers[tier])
    return gone


def append(store: Store, table: Table, rows: DataFrame) -> None:
    """Rows of any size from a DataFrame, by column name; constraints are checked as for INSERT.

    The new rows are checked among themselves; of the old ones only those with a key of theirs are
    looked for, by a semi-join on the key.
    """
    new = rows.select(*[F.col(f"`{c.name}`").cast(spark_type(c.family, c.size)).alias(c.name) if c.name in rows.columns else F.lit(None).cast(spark_type(c.family, c.size)).alias(c.name) for c in table.columns])
    old, staged = Table(table.name, table.columns, list(table.files), table.indexes), store.write(table, new)
    added = Table(table.name, table.columns, [staged], table.indexes)
    check(store, table, store.read(added), [c.name for c in table.columns], staged)
    for key in table.unique_keys() if old.files else ():
        same = store.read(added).select(*[F.col(f"`{c}`") for c in key])
        if not same.join(store.read(old).select(*same.columns), list(key), "left_semi").isEmpty():
            store.remove([staged])
            raise ConstraintViolation(f"UNIQUE {table.name}({', '.join(key)})")
    table.files.append(staged)


def check(store: Store, table: Table, df: DataFrame, changed: list[str], staged: str) -> None:
    """NOT NULL and UNIQUE of the changed columns over what would be the table; else the directory goes."""
    try:
        strict = [c.name for c in table.columns if c.not_null and c.name in changed]
        if strict and not df.where(" OR ".join(f"`{c}` IS NULL" for c in strict)).limit(1).isEmpty():
            raise NotNullViolation(f"{table.name}: NOT NULL {', '.join(strict)}")
        for key in table.unique_keys():
            if set(key) & set(changed) and _repeated(df, key):
                raise ConstraintViolation(f"UNIQUE {table.name}({', '.join(key)})")
    except Exception:
        store.remove([staged])
        raise


def assigned(value: SparkColumn, family: str, to: n.Column) -> SparkColumn:
    """value as column `to` stores it: the same rules as for literals, refused at planning where the types show it."""
    kind = spark_type(to.family, to.size)
    if family in (to.family, "null") and to.family not in ("decimal", "int"):
        return value.cast(kind)
    if to.family == "float" and family == "int" or to.family == "int" and family in ("int", "null") or to.family == "decimal" and family == "null":
        return value.cast(kind)
    if to.family == "int" and family == "float":
        return F.when(value.isNull() | (value == F.floor(value)), value.cast("bigint")).otherwise(F.raise_error(F.lit(f"{to.name} takes whole numbers only")).cast("bigint"))
    if to.family == "decimal" and family in ("int", "decimal"):
        return F.when(value.isNull() | (value == value.cast(kind)), value.cast(kind)).otherwise(F.raise_error(F.lit(f"{to.name} would be rounded")).cast(kind))
    raise TypeMismatchError(f"{to.name} does not take {family}")


def update(store: Store, table: Table, statement: n.Update) -> int:
    """Every right side sees the old row; the number of rows comes with the write itself."""
    compiler = _compiler(table)
    sets = {}
    for name, e in statement.sets:
        column = _column(table, name)
        if isinstance(e, n.Literal) and e.family not in ("null", "decimal", "int", "float") and e.family != column.family and column.family != "json":
            coerced(e.value, column)
        sets[name] = assigned(*compiler.value(e), column)
    hit = F.lit(True) if statement.where is None else F.coalesce(compiler.truth(statement.where), F.lit(False))
    old = store.read(table)
    seen = Observation()
    marked = old.withColumn("\x1fhit", hit).observe(seen, F.coalesce(F.sum(F.col("\x1fhit").cast("bigint")), F.lit(0)).alias("n"))
    new = marked.select(*[(F.when(F.col("\x1fhit"), sets[c]).otherwise(F.col(f"`{c}`")) if c in sets else F.col(f"`{c}`")).alias(c) for c in old.columns])
    staged = store.write(table, new)
    table.files = [staged]
    check(store, table, store.read(table), list(sets), staged)
    return seen.get["n"]


def delete(store: Store, table: Table, statement: n.Delete) -> int:
    old = store.read(table)
    if statement.where is None:
        count, table.files = old.count(), []
        return count
    hit = F.coalesce(_compiler(table).truth(statement.where), F.lit(False))
    seen = Observation()
    marked = old.withColumn("\x1fhit", hit).observe(seen, F.coalesce(F.sum(F.col("\x1fhit").cast("bigint")), F.lit(0)).alias("n"))
    table.files = [store.write(table, marked.where(~F.col("\x1fhit")).drop("\x1fhit"))]
    return seen.get["n"]


def create_index(store: Store, table: Table, name: str, columns: list[str], unique: bool) -> None:
    """Note the index; the table's first one also sorts its files, so that a probe of the columns skips
    row groups and files by their least and greatest values."""
    for c in columns:
        _column(table, c)
    if unique and _repeated(store.read(table), tuple(columns)):
        raise ConstraintViolation(f"UNIQUE {table.name}({', '.join(columns)})")
    before = table.layout()
    table.indexes[name] = {"columns": list(columns), "unique": unique}
    if table.files and table.layout() != before:
        table.files = [store.write(table, store.read(table), whole=True)]
