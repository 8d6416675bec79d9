"""What the corpus operators share: tables, scratch folders and Arrow helpers."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the separators of words in every contract: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows here hold whole texts or packed arrays, so Arrow batches are bounded by bytes too; and the shuffle files of a
#: job that writes a table go when the table is there.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def options(spark: SparkSession, wanted: dict[str, str]):
    """The session's options for a while."""
    was = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else None
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with options(spark, WRITING):
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_blocks(parts, name: str) -> DataFrame:
    """The tables that ``parts`` (functions) make, one after the other, as one table: a block's shuffle files go before the next begins."""
    path, schema, spark = None, None, None
    for i, part in enumerate(parts):
        df = part()
        spark, schema = df.sparkSession, df.schema
        path = path or scratch(spark, name)
        with options(spark, WRITING):
            df.write.parquet(f"{path}/block={i}")
    return spark.read.schema(schema).parquet(*[f"{path}/block={i}" for i in range(len(parts))])


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add (the operator's value wins)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column so named."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fields(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more]])


def batch_of(names: list[str], columns: list, schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names) if schema is None else pa.RecordBatch.from_arrays(columns, schema=schema)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced (same name) or added."""
    names, columns = list(batch.schema.names), list(batch.columns)
    for n, c in new.items():
        if n in names:
            columns[names.index(n)] = c
        else:
            names.append(n)
            columns.append(c)
    return pa.RecordBatch.from_arrays(columns, names=names)


def given_back(batches):
    """The same batches; a worker gives Arrow's free memory back at the end, as it stays for the jobs that follow."""
    yield from batches
    pa.default_memory_pool().release_unused()


def small_slices(batches, rows: int):
    """The same rows in batches of at most ``rows``, to bound what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
