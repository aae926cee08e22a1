"""Sinks: run folders that are complete or absent."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_safe(value):
    """Plain JSON values; numbers that aren't finite become null, keys that collide as text are an error."""
    if isinstance(value, dict):
        out = {str(k): json_safe(v) for k, v in value.items()}
        if len(out) != len(value):
            raise ValueError("keys collide as text")
        return out
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    number = float(value)
    return number if math.isfinite(number) else None


def canonical_json(value) -> str:
    return json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


class Folder:
    """A folder that appears whole or not at all, on any file system that Spark writes to.

    Everything is written to a hidden sibling, which takes the folder's name when
    the block ends and is deleted when it fails. The folder must not exist.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.target = spark, path.rstrip("/")
        head, slash, name = self.target.rpartition("/")
        self.path = f"{head}{slash}.{name}-{uuid.uuid4().hex}"

    def _at(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), made

    def exists(self) -> bool:
        files, path = self._at(self.target)
        return files.exists(path)

    def __enter__(self) -> Folder:
        if self.exists():
            raise FileExistsError(self.target)
        return self

    def __exit__(self, kind, value, trace) -> None:
        files, path = self._at(self.path)
        if kind is not None:
            files.delete(path, True)
        elif self.exists() or not files.rename(path, self._at(self.target)[1]):
            files.delete(path, True)
            raise FileExistsError(self.target)

    def text(self, name: str, content: str) -> str:
        """Write a small file; returns its digest."""
        data = content.encode()
        files, path = self._at(f"{self.path}/{name}")
        stream = files.create(path, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return hashlib.sha256(data).hexdigest()

    def table(self, name: str, df: DataFrame) -> str:
        """Write a report-sized table as one CSV file, in the order of its columns; returns its digest."""
        parts = f"{self.path}/{name}.parts"
        df.repartition(1).sortWithinPartitions(*df.columns).write.mode("error").csv(parts, header=True)
        files, folder = self._at(parts)
        found = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
        if not found or not files.getFileStatus(found[0]).getLen():  # no rows, no file or an empty one
            files.delete(folder, True)
            return self.text(f"{name}.csv", ",".join(df.columns) + "\n")
        if not files.rename(found[0], self._at(f"{self.path}/{name}.csv")[1]):
            raise OSError(f"{name}.csv can't be moved into place")
        files.delete(folder, True)
        return digest(self.spark, f"{self.path}/{name}.csv")


def digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file, read as a stream; ``damaged`` if it doesn't pass its file system's own checksums."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(made)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    except Py4JJavaError as e:
        if "ChecksumException" in str(e.java_exception):
            return "damaged"
        raise
    finally:
        stream.close()


def write_run(path: str, panel: DataFrame, reports: dict[str, DataFrame], documents: dict[str, object], order: tuple[str, ...] = ("as_of_date", "symbol")) -> None:
    """A research run: the panel as Parquet in canonical order, reports as CSV, JSON beside them, the manifest last."""
    with Folder(panel.sparkSession, path) as folder:
        keys = [c for c in order if c in panel.columns]
        (panel.orderBy(*keys) if keys else panel).write.mode("error").parquet(f"{folder.path}/panel.parquet")
        files = {f"{name}.csv": folder.table(name, df) for name, df in reports.items()}
        for name, value in documents.items():
            files[f"{name}.json"] = folder.text(f"{name}.json", canonical_json(value))
        folder.text("manifest.json", canonical_json({"files": files}))


def write_bundle(path: str, tables: dict[str, DataFrame], manifest: dict, schemas: dict[str, str] | None = None) -> dict[str, str]:
    """Report-sized tables as CSV files and a manifest of their digests, written last. Schemas that are given must match exactly."""
    for name, expected in (schemas or {}).items():
        check_schema(tables[name], expected)
    spark = next((df.sparkSession for df in tables.values()), None) or SparkSession.active()
    with Folder(spark, path) as folder:
        digests = {f"{name}.csv": folder.table(name, df) for name, df in tables.items()}
        types = {name: [[f.name, f.dataType.simpleString()] for f in df.schema] for name, df in tables.items()}
        folder.text("manifest.json", canonical_json(manifest | {"files": digests, "types": types}))
    return digests


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest of a bundle and its tables with their types.

    Files must be the ones that the manifest lists, to the byte, with its columns
    in order, and every cell must be a value of its column's type; otherwise the
    first cells that aren't are named.
    """
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))
    out = {}
    for name, types in manifest["types"].items():
        if digest(spark, f"{path}/{name}.csv") != manifest["files"][f"{name}.csv"]:
            raise ValueError(f"{name}.csv isn't the file that was written")
        out[name] = typed(spark.read.csv(f"{path}/{name}.csv", header=True), types, name)
    return manifest, out


def typed(cells: DataFrame, types: list[list[str]], name: str) -> DataFrame:
    """A table of text as its types; a cell that isn't a value of its column's type is an error that names it."""
    if cells.columns != [c for c, _ in types]:
        raise ValueError(f"{name} has columns {cells.columns}")
    value = lambda c, kind: F.col(c).try_cast(kind)
    wrong = [F.when(F.col(c).isNotNull() & value(c, kind).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(kind).alias("type"))) for c, kind in types if kind != "string"]
    if wrong:
        bad = cells.select(F.explode(F.array_compact(F.array(*wrong))).alias("x")).select("x.*").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{name}.{r['column']}: {r['value']!r} is no {r['type']}" for r in bad))
    return cells.select(*[value(c, kind).alias(c) for c, kind in types])


def check_schema(df: DataFrame, expected: str) -> None:
    """Exact columns in order and their types."""
    want = T.StructType.fromDDL(expected)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"expected {want.simpleString()}, got {df.schema.simpleString()}")
