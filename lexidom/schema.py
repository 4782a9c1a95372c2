"""Column lists and DDL shared by every module."""

# Feature names in model order.
FEATURES_6 = [
    "length",
    "numerical_ratio",
    "meaningful_word_ratio",
    "pronounceability",
    "lms_percentage",
    "levenshtein",
]
FEATURES_5 = FEATURES_6[:5]

RAW_LOG_DDL = "domain STRING, threat STRING"
LABELLED_DDL = "domain STRING, label INT"
TRIGRAMS_DDL = "gram STRING, p DOUBLE"

# Run-metric records, one DDL per experiment of the nested metrics file.
RUN_DDL = {
    "E1": "k INT, rep INT, time_sec DOUBLE, speedup DOUBLE, cpu_util_avg DOUBLE, "
          "ipc_overhead_pct DOUBLE",
    "E2": "k INT, rep INT, time_sec DOUBLE, speedup DOUBLE, efficiency DOUBLE, "
          "cpu_util_avg DOUBLE, ipc_overhead_pct DOUBLE, mem_delta_mb DOUBLE",
    "E3": "n INT, rep INT, time_sec DOUBLE, throughput DOUBLE",
    "E4": "k_split INT, chunk_size INT, rep INT, time_sec DOUBLE, throughput DOUBLE",
    "E5": "n_estimators INT, accuracy DOUBLE, f1 DOUBLE, train_time_sec DOUBLE",
    "E7": "n_features INT, features_used ARRAY<STRING>, accuracy DOUBLE, f1 DOUBLE",
    "E8": "k INT, n INT, rep INT, time_sec DOUBLE",
}


def feature_names(levenshtein: bool = True) -> list[str]:
    return FEATURES_6 if levenshtein else FEATURES_5
