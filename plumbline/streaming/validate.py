"""The same validation on streams: it keeps no state, so a stream gives the rows of a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.validate import validate_configs


def validate_stream(stream: DataFrame, **columns) -> DataFrame:
    """Verdicts of a streaming DataFrame, for any sink in append mode."""
    return validate_configs(stream, **columns)


def run_once(spark: SparkSession, verdicts: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now into Parquet below ``folder``, and read it back as a batch."""
    base = f"{folder}/verdicts-{uuid.uuid4().hex}"
    query = (
        verdicts.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(verdicts.schema).parquet(f"{base}/data")
