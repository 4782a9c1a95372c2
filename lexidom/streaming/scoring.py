"""Scoring of a stream of domains."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..ml.scoring import join_requests, request_features, score_rows
from ..operators.reference_tables import Lexicon
from ..session import path_exists


def read_requests(
    spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """File stream; ``max_files`` bounds the size of a micro-batch."""
    reader = spark.readStream.schema(ddl).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    trigger: dict | None = None,
):
    """Apply a batch plan to every micro-batch and commit its rows to ``out``.

    The features group by domain, which only has to hold within a batch, so they run
    per batch and the stream keeps no state. A batch's rows go to a folder of their own;
    its line in the manifest is written last and names that folder. A batch that is
    replayed after its commit is left as it is; one that broke off before is written to
    another folder, and what lies in the first is never read. Returns the started query.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = f"{out}/manifest/batch={batch_id}"
        if not path_exists(spark, f"{line}/_SUCCESS"):
            folder = f"rows/batch={batch_id}-{uuid.uuid4().hex}"
            transform(batch).write.parquet(f"{out}/{folder}")
            commit(spark, line, batch_id, folder)

    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def commit(spark: SparkSession, line: str, batch_id: int, folder: str) -> None:
    """The manifest's line of a batch whose rows are complete."""
    row = spark.createDataFrame([(batch_id, folder)], "batch_id BIGINT, folder STRING")
    row.coalesce(1).write.mode("overwrite").parquet(line)


def read_batches(spark: SparkSession, out: str, ddl: str) -> DataFrame:
    """The rows of all committed batches; none, if nothing was committed yet."""
    if not path_exists(spark, f"{out}/manifest"):
        return spark.createDataFrame([], ddl)
    lines = spark.read.schema("batch_id BIGINT, folder STRING").parquet(f"{out}/manifest/batch=*")
    folders = [f"{out}/{r.folder}" for r in lines.orderBy("batch_id").collect()]  # one line a batch
    return spark.read.schema(ddl).parquet(*folders) if folders else spark.createDataFrame([], ddl)


def score_stream(
    requests: DataFrame, model: PipelineModel, lexicon: Lexicon, out: str, checkpoint: str,
    domain: str = "domain", trigger: dict | None = None,
):
    """One verdict per request row, with all request columns, against the static lookup tables."""
    score = lambda batch: score_rows(batch, model, lexicon, domain)
    return write_batches(requests, score, out, checkpoint, trigger)


def feature_stream(
    requests: DataFrame, lexicon: Lexicon, out: str, checkpoint: str, domain: str = "domain",
    trigger: dict | None = None,
):
    """The five features of each request row, with all request columns."""
    with_features = lambda batch: join_requests(batch, request_features(batch, lexicon, domain).drop("n_requests"), domain)
    return write_batches(requests, with_features, out, checkpoint, trigger)
