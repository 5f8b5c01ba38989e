"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.folders import shared_folder

#: A word of a text: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, which all machines share, and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a checkpointed ``df`` for broadcast if it has at most ``max_rows`` rows.

    Beyond that bound it is returned as it is: the join then shuffles both sides, and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_columns(
    df: DataFrame,
    read: list[Column],
    out: str,
    body: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]],
) -> DataFrame:
    """Run ``body`` over Arrow batches of the columns ``read``; it yields columns for ``out``.

    ``out`` is a DDL schema. The closure carries only ``body`` and the Arrow schema.
    """
    schema = T.StructType.fromDDL(out)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*read).mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; a null is an empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)
