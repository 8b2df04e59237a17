"""What the training-data operators share: table paths, cut lineage, byte columns."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of two 64-bit numbers up to which a table is broadcast (some 64 bytes each, 32 MB in all).
BROADCAST_ROWS = 500_000

#: Rows of a narrow table in one file of it, and the least number of files that are not put together.
PART_ROWS = 1 << 20
LEAST_PARTS = 8
#: Rows whose texts one worker turns into Python objects at once.
SLICE_ROWS = 512

_LOCAL = re.compile(r"local(\[[^\]]*\])?$")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it from there.

    ``rows``, a bound of its rows where one is known, keeps a narrow table in few files: one for each ``PART_ROWS``, but
    ``LEAST_PARTS`` at least.

    The folder is ``spark.checkpoint.dir``; a temporary one is set only where a
    local session has none, as in tests.  A cluster without one is refused: its
    executors could not read what the driver's own folder holds.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not _LOCAL.match(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sluice-checkpoint-"))
    if rows is not None:
        df = df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be written already and narrow, to be broadcast if it has ``rows`` or fewer."""
    return F.broadcast(df) if df.count() <= rows else df


def without_keys(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) is not among ``keys`` (doc_id, text_key), or is, with ``left_semi``.

    Few keys are broadcast, so that the texts stay where they are.
    """
    id_name, key_name = unused(docs, "key_doc_id", "key_text")
    right = if_small(keys.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)))
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(key_name)), how)


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with a function of a few rows that returns as a batch what comes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that few texts at once are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_key(*columns: str):
    """A 64-bit key of a row's columns that is never null."""
    return F.xxhash64(*[F.col(c) for c in columns])


def sha256_hex(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)
