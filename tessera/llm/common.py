"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_SHARED: list[str] = []
#: What materialise has written and clear has not removed, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session has none (single-machine tests) a temporary folder stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_SHARED:
        _LOCAL_SHARED.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _LOCAL_SHARED[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that what several later branches use is computed once and a lost
    executor costs only a reread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application's operators; how many went.

    Results are lazy and read them: write what is still wanted first.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's executors this package, once an application, through Spark's own file server."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; -1 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1)).cast("int")


def with_columns(schema: T.StructType, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    """schema plus extra; an input column whose name clashes with an extra one gives way."""
    names = {name.lower() for name, _ in extra}
    kept = [f for f in schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in extra])


def appended(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with extra columns in place of any of the same name."""
    names = {n.lower() for n in extra}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    arrays = [a for _, a in kept] + list(extra.values())
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kept] + list(extra))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: What a worker keeps between the tasks of one operator.
_KEPT: dict = {}


def let_go() -> None:
    """Drop what this worker keeps, and give freed memory back to the system.

    A worker serves one operator after the other, and each one's caches would otherwise stay.
    """
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept(key, make: Callable):
    """What make() gave this worker in the last task that asked for key, if none asked for another since."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def map_arrow(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """mapInArrow over batches; make() runs once a task and returns a batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)
