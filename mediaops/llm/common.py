"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty) of ``docs``, as ``doc_id`` and ``text``."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def tidy(compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compute``, after which its worker gives freed memory back: workers that wait count against their executor too."""

    @wraps(compute)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compute(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries do without
        if trim:
            trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside exchange at most ``rows`` rows at a time with Python, so that a batch of texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front that ``docs`` has no such column in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


def spread_join(rows: DataFrame, groups: DataFrame, key: str, salt: str) -> DataFrame:
    """Join each row with the one row of its group without gathering a large group in one task.

    ``rows`` carry ``salt``; ``groups`` has one row per ``key`` with the array ``salts`` of the salts that its
    members have, so it is repeated at most once per salt and never for members that do not exist.  Either side grows
    with the input and Spark takes the groups for as few as before they are repeated, so none is sent out.
    """
    spread = groups.withColumn(salt, F.explode("salts")).drop("salts")
    return rows.join(spread.hint("merge"), [key, salt])


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], most_broadcast: int = 500_000) -> DataFrame:
    """Rows of ``docs`` whose keys (null-safe) are not in ``dropped``, which is sent out only if it has few rows.

    ``dropped`` must be cheap to read again, such as a written table.
    """
    few = dropped.count() <= most_broadcast
    right = dropped.select(*[F.col(k).alias(f"_dropped_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & docs[k].eqNullSafe(right[f"_dropped_{k}"])
    return docs.join(F.broadcast(right) if few else right, same, "left_anti")
