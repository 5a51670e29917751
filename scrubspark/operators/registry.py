"""Operator names as a recipe spells them, mapped to the library functions."""

from __future__ import annotations

from scrubspark.functions.stats import DEFAULT_ACCURACY
from scrubspark.operators import cells, correlation, reports, rows


def handle_missing_values(df, column, strategy="mean", constant_value=None, exact=True, accuracy=DEFAULT_ACCURACY):
    if strategy == "drop_rows":
        return rows.drop_missing_rows(df, column)
    return cells.fill_missing(df, column, strategy, constant_value, accuracy=accuracy, exact=exact)


OUTLIER_METHODS = {"cap": cells.cap_outliers, "remove": rows.remove_outliers}


def handle_outliers(df, column, method="cap", iqr_multiplier=1.5, exact=True, accuracy=DEFAULT_ACCURACY):
    if method not in OUTLIER_METHODS:
        raise ValueError(f"handle_outliers: method {method!r} is none of {list(OUTLIER_METHODS)}")
    return OUTLIER_METHODS[method](df, column, iqr_multiplier, accuracy=accuracy, exact=exact)


# name -> DataFrame -> DataFrame (a new table version)
TRANSFORMS = {
    "drop_duplicates": rows.drop_duplicates,
    "handle_missing_values": handle_missing_values,
    "drop_column": cells.drop_column,
    "rename_column": cells.rename_column,
    "convert_dtype": cells.convert_dtype,
    "handle_outliers": handle_outliers,
    "standardize_text": cells.standardize_text,
    "find_and_replace": cells.find_and_replace,
    "split_column": cells.split_column,
    "filter_rows": rows.filter_rows,
    "merge_columns": cells.merge_columns,
    "extract_datetime_parts": cells.extract_datetime_parts,
    "remove_type_anomalies": cells.remove_type_anomalies,
    "clip_numeric_range": cells.clip_numeric_range,
    "sort_dataset": rows.sort_dataset,
}

# name -> DataFrame -> report DataFrame (no new version)
ANALYSES = {
    "profile_column": reports.profile_column,
    "compute_correlation": correlation.compute_correlation,
    "detect_outliers_report": reports.detect_outliers_report,
    "value_counts": reports.value_counts,
    "detect_missing_pattern": reports.detect_missing_pattern,
}
