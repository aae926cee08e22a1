"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Limits of one Arrow batch, so that a worker holds a few megabytes of text at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

#: ASCII capitals to small letters, and everything outside [0-9a-z] and non-ASCII bytes to a space.
FOLD_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: ASCII capitals to small letters only.
FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _shared(spark: SparkSession) -> str:
    """The reliable folder that the cluster names; one of this machine only where the machine is the cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable folder that the cluster names."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder, which takes less disk than a checkpoint."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` on the executors' disks until ``dismiss``; what is lost with an executor is computed again.

    Spark forgets that it is dealt by the whole-number ``keys``: a join on them
    deals both sides, and only so it can split a skewed one.
    """
    df = df.select(*[F.bitwise_not(F.bitwise_not(c)).alias(c) if c in keys else c for c in df.columns]).persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def dismiss(*tables: DataFrame) -> None:
    for df in tables:
        df.unpersist()
    settle(tables[0].sparkSession)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more, and let Spark drop the shuffles that made them."""
    spark = tables[0].sparkSession
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    settle(spark)


def settle(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds that nothing refers to them, which may else take half an hour."""
    spark._jvm.System.gc()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema) -> DataFrame:
    """``mapInArrow`` with one handler per task.

    ``make`` builds the handler in the worker; the handler turns a batch into a
    dict of columns (lists or Arrow arrays) under the names of ``schema``, or
    None. A ``finish`` attribute of the handler gives what is left at the end.
    """
    bound_batches(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            out = handle(batch) if batch.num_rows else None
            if out is not None:
                yield to_batch(out, arrow)
        last = getattr(handle, "finish", None)
        for out in last() if last else ():
            yield to_batch(out, arrow)

    return df.mapInArrow(run, kind)


def append(df: DataFrame, text_col: str, make, added: str) -> DataFrame:
    """Add columns that a handler derives from the text of each row.

    The handler gets the list of texts (bytes, null as empty) and returns the
    added columns. All columns of ``df`` go along unseen under neutral names, so
    theirs can't clash; one that bears the name of an added column is replaced.
    """
    new = StructType.fromDDL(added)
    kept = [i for i, c in enumerate(df.columns) if c not in new.names]
    at = kept.index(df.columns.index(text_col))
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in kept])
    names = [df.columns[i] for i in kept]
    old, text = list(inner.columns), inner.columns[at]
    schema = StructType([*inner.schema.fields, *[StructField(f"n{i}", f.dataType) for i, f in enumerate(new)]])

    def build():
        work = make()

        def handle(batch: pa.RecordBatch) -> dict:
            out = work(texts(batch, text))
            return {c: batch.column(c) for c in old} | {f"n{i}": out[name] for i, name in enumerate(new.names)}

        return handle

    return map_batches(inner, build, schema).toDF(*names, *new.names)


def sheltered(docs: DataFrame, used: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with all but the used columns under names that can't clash.

    Returns the columns of ``docs`` of its result, under their own names.
    """
    hidden = [c if c in set(used) else f"_hidden{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*hidden)).select(*hidden).toDF(*docs.columns)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if not isinstance(values, pa.Array):
            values = pa.array(values, type=field.type)
        elif values.type != field.type:
            values = values.cast(field.type)
        arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
