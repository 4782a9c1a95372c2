"""Raw log to everything the later steps read: the whole preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import cap_per_class, clean
from ..operators.ordering import assign_ord
from ..operators.ranking import stratified_split
from ..operators.reference_tables import fit_trigrams
from ..session import stage
from ..sources import tables
from ..sources.raw_log import read_raw_log


def preprocess(
    spark: SparkSession, raw_path: str, out: str, rules: DataFrame, dictionary: DataFrame,
    cap: int | None = 500_000, test_size: float = 0.2, seed: int = 42, fit_on: str = "all",
) -> None:
    """Write words, trigrams and the train/test split under ``out``.

    Scan, cap each class in file order, clean, put in alphabetical order,
    split, learn the trigrams of the benign rows.
    """
    raw = stage(read_raw_log(spark, raw_path).select("domain", "label", "ord"), "raw")
    capped = raw if cap is None else cap_per_class(raw, cap)
    cleaned = clean(capped.drop("ord"), rules)
    ordered = stage(assign_ord(cleaned, ["domain"]), "cleaned")
    split = stratified_split(ordered, test_size, seed=seed)
    tables.write_split(split, f"{out}/split")
    tables.write_words(dictionary, f"{out}/english_dictionary")
    labelled = tables.read_split(
        spark, f"{out}/split", ddl="domain STRING, label INT, ord BIGINT"
    )
    tables.write_trigrams(fit_trigrams(labelled, fit_on), f"{out}/trigrams")
