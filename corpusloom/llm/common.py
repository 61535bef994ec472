"""Shared helpers: table access, shared-folder materialisation, partition counts."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where it is unset a folder of our own, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parents = set()
    for f in df.inputFiles():
        parents.add(f.rsplit("/", 1)[0])
    for p in parents:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast that workers can read without this package: objects go by value. Read it by `received`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(value: Broadcast):
    return pickle.loads(value.value)


def map_rows(df: DataFrame, keep: list[str], inputs: list[str], schema: str, start: Callable) -> DataFrame:
    """The columns `keep` of df, which stay in Arrow as they are, and the columns of `schema`, which Python makes of `inputs`.

    `start()` runs once a task and returns step(*lists) -> (row numbers or None for all rows in order, lists of the new columns);
    step may also be a generator of such results. Ids of 64 bits, nulls and dates beside them pass unchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    made = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    inner = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], *[quoted(c).alias(f"i{i}") for i, c in enumerate(inputs)])
    out = StructType(inner.schema.fields[: len(keep)])
    for i, f in enumerate(made.fields):
        out = out.add(f"m{i}", f.dataType)
    kinds = list(to_arrow_schema(StructType(made.fields)).types)
    n_keep, names = len(keep), out.fieldNames()

    def run(batches):
        import types

        import pyarrow as pa

        step = start()
        for batch in batches:
            kept = [batch.column(i) for i in range(n_keep)]
            found = step(*[batch.column(i).to_pylist() for i in range(n_keep, batch.num_columns)])
            for rows, columns in found if isinstance(found, types.GeneratorType) else [found]:
                own = kept if rows is None else [c.take(pa.array(rows, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    return inner.mapInArrow(trimmed(run), out).toDF(*keep, *made.fieldNames())


def trimmed(f):
    """f over batches; when they end, the Python worker gives free memory back, as it may idle beside others for long."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return run
