"""Nested run-metric documents: one field per experiment, an array of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import RUN_DDL


def write_runs(runs: DataFrame, path: str, experiment: str) -> None:
    """Nested documents, one run each, so no run list has to fit one task."""
    fields = [c.split()[0] for c in RUN_DDL[experiment].split(", ")]
    run = F.struct(*[F.col(c) for c in fields if c in runs.columns])
    runs.select(F.array(run).alias(experiment)).write.mode("overwrite").json(path)


def read_runs(
    spark: SparkSession, path: str, experiment: str, multi_line: bool = False
) -> DataFrame:
    """Flatten the runs of one experiment.

    ``multi_line`` reads whole-file documents; otherwise one document a line,
    which Spark can split. Documents without the experiment give no rows.
    """
    docs = (
        spark.read.schema(f"`{experiment}` ARRAY<STRUCT<{_struct(RUN_DDL[experiment])}>>")
        .option("multiLine", multi_line)
        .json(path)
    )
    return docs.select(F.inline(experiment))


def write_documents(runs: DataFrame, path: str, experiments: dict[str, list[str]]) -> None:
    """Documents of several experiments at once: the named columns of ``runs`` for each, a run a document."""
    fields = [F.array(F.struct(*columns)).alias(e) for e, columns in experiments.items()]
    runs.select(*fields).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Whole documents without a declared schema: experiment, run, field, number, text.

    Experiments are a list of runs, an object of named runs, or a plain value; whatever
    a document holds is kept, known or not. ``run`` is the position or the name.
    ``multi_line`` takes each file for one document.
    """
    docs = spark.read.text(path, wholetext=multi_line).where("trim(value) <> ''")
    return spark.sql(
        """SELECT e.key AS experiment, coalesce(r.key, cast(r.pos AS STRING)) AS run, f.key AS field,
             try_variant_get(coalesce(f.value, r.value, e.value), '$', 'double') AS number,
             try_variant_get(coalesce(f.value, r.value, e.value), '$', 'string') AS text
           FROM (SELECT parse_json(value) AS doc FROM {docs}) d,
             LATERAL variant_explode(d.doc) e,
             LATERAL variant_explode_outer(e.value) r,
             LATERAL variant_explode_outer(r.value) f""",
        docs=docs,
    )


# Models and scores of the model-comparison part.
MODELS = ["decision_tree", "random_forest"]
SCORES = ["accuracy", "precision", "recall", "f1", "inference_latency_ms", "train_time_sec"]


def read_model_scores(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The nested model comparison (E6) as model, metric, value."""
    scores = ", ".join(f"{c}: DOUBLE" for c in SCORES)
    models = ", ".join(f"{m}: STRUCT<{scores}>" for m in MODELS)
    docs = spark.read.schema(f"E6 STRUCT<{models}>").option("multiLine", multi_line).json(path)
    rows = [
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("metric"), F.col(f"E6.{m}.{c}").alias("value"))
        for m in MODELS for c in SCORES
    ]
    return docs.select(F.inline(F.array(*rows))).where("value IS NOT NULL")


def read_overall(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The sequential baseline and the measured exchange overhead."""
    ddl = (
        "sequential_baseline_sec DOUBLE, ipc_overhead STRUCT<serialize_time_sec: DOUBLE, "
        "deserialize_time_sec: DOUBLE, total_overhead_sec: DOUBLE, overhead_percentage: DOUBLE>"
    )
    docs = spark.read.schema(ddl).option("multiLine", multi_line).json(path)
    return docs.select("sequential_baseline_sec", "ipc_overhead.*")


def _struct(ddl: str) -> str:
    return ", ".join("{}: {}".format(*field.split()) for field in ddl.split(", "))
