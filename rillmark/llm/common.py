"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ship import ship_code

__all__ = ["KEY", "blocks", "checkpoint_dir", "checkpointed", "computed", "discard", "documents", "id_and_text", "packed", "row_key", "same_row", "ship_code", "stored", "stored_at", "unpacked"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; all others are ignored, whatever their names."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def blocks(batches: Iterator, max_chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Arrow batches of (doc_id, text) as lists of ids and texts, cut so that a block stays
    near ``max_chars`` characters (one longer text makes a block of its own).  Null texts
    come out as empty ones."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if ids and size + len(text) > max_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one is set only where none is and the session is local, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="rillmark-checkpoints")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet into the shared folder and read back: cuts the lineage."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the path.  What :func:`discard` has not deleted by then goes when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rillmark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, target = _target(spark, path)
    fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what :func:`stored_at` wrote, once nothing that is still to run reads it."""
    fs, target = _target(spark, path)
    fs.delete(target, True)


def row_key(text: Column) -> Column:
    """64 bits of the text: with the id they tell rows apart that share an id or have none."""
    return F.xxhash64(text)


def same_row(id_a: Column, id_b: Column, key_a: Column, key_b: Column) -> Column:
    return id_a.eqNullSafe(id_b) & (key_a == key_b)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumn`` whose values are computed once for each row, in a Generate node: the optimizer
    copies a plain projection into the expressions above it, where a lambda would repeat it for
    each element."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


#: Name of helper columns that meet the columns of a caller.
KEY = "__rillmark_key"


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns as one struct), ``doc_id`` and ``text``: no name of the caller can clash."""
    columns = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(columns.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def unpacked(df: DataFrame, columns: list[str], **changed: str) -> DataFrame:
    """The caller's columns again, in order; ``changed`` names the columns that replace some of them."""
    return df.select(*[(F.col(changed[c]) if c in changed else F.col(f"row.`{c}`")).alias(c) for c in columns])
