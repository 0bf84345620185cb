"""Shared plumbing: scratch tables, table readers and pass-through batch maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and driver and executors are one process (tests) a folder of this machine is
    used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folio-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the JVM ends."""
    path = f"{scratch_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def open_store(uri: str):
    """(file system, path) of a folder in the shared store, for Python workers."""
    from pyarrow import fs

    for own, known in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = known + uri[len(own) :] if uri.startswith(own) else uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def saved(df: DataFrame, name: str, path: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation
    of what led here. The path is added to ``paths``, for whoever drops the table.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column, modulus: int):
    """crc32 of the value's text, modulo; null where the value is null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def add_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    compute: Callable[..., list[list]],
    slice_chars: int = 4_000_000,
) -> DataFrame:
    """Append columns computed by Python over Arrow batches, row by row aligned.

    ``compute`` gets one Python list per input column and returns one list per
    output column. A batch is handed over in slices of about ``slice_chars``
    characters of the first input, so memory does not depend on how long the
    texts are. An existing column that has the name of an output is replaced.
    """
    new = [f.name for f in outputs]
    keep = others(df, new)
    missing = [c for c in inputs if c not in keep]
    if missing:
        raise ValueError(f"columns {missing} are needed as inputs and asked for as outputs")
    base = df.select(*columns(keep))
    schema = T.StructType([*base.schema.fields, *outputs.fields])
    order = {c: keep.index(c) for c in inputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, order[inputs[0]], slice_chars):
                got = compute(*[part.column(order[c]).to_pylist() for c in inputs])
                made = [pa.array(values, type=arrow_type(f.dataType)) for values, f in zip(got, outputs.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=keep + new)

    return base.mapInArrow(run, schema)


def others(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that none of ``names`` replaces (Spark's names ignore case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def columns(names: list[str]) -> list:
    return [F.col(f"`{c}`") for c in names]


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, slice_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running length of ``column`` passes ``slice_chars``."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths) // slice_chars
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
