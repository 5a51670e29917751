"""The same operators over the text-heavy tables (whole documents, whole pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubspark.functions.parse import WHITESPACE_CLASS
from scrubspark.operators import cells, reports, rows
from scrubspark.suite.dirty import table
from scrubspark.suite.registry import register

_WS = WHITESPACE_CLASS  # the trim set as a regex class (RE2 and Java read it alike)


@register("doc_dedup_text", """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def doc_dedup_text(spark, sf):
    return rows.drop_duplicates(table(spark, sf, "documents"), ["text"], "first", ["doc_id"])


@register("doc_text_normalize", f"""
SELECT doc_id, lower(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS text FROM documents""")
def doc_text_normalize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return cells.standardize_text(d, "text", case="lower")


@register("doc_filter_license", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE NOT coalesce(regexp_matches(text, '(?i)licen[cs]e'), false)""")
def doc_filter_license(spark, sf):
    d = table(spark, sf, "documents")
    return rows.filter_rows(d, "text", "contains", "(?i)licen[cs]e").drop("text")


@register("doc_lang_counts", """
SELECT value, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS pct, CAST(rank AS INTEGER) AS rank
FROM (SELECT lang AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang NULLS LAST) AS rank
      FROM documents GROUP BY lang) WHERE rank <= 10""")
def doc_lang_counts(spark, sf):
    return reports.value_counts(table(spark, sf, "documents"), "lang", 10)


@register("doc_profile_nchars", """
SELECT 'n_chars' AS column, round(min(n_chars)::DOUBLE, 3) AS min, round(max(n_chars)::DOUBLE, 3) AS max,
  round(avg(n_chars), 3) AS mean, round(quantile_cont(n_chars, 0.5)::DOUBLE, 3) AS median,
  round(stddev_samp(n_chars), 3) AS std, round(skewness(n_chars), 3) AS skewness,
  round(kurtosis(n_chars), 3) AS kurtosis FROM documents""")
def doc_profile_nchars(spark, sf):
    p = reports.profile_column(table(spark, sf, "documents"), "n_chars")
    return p.select("column", "min", "max", "mean", "median", "std", "skewness", "kurtosis")


@register("labels_summary", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count, "
    f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std FROM labels" for c in ["doc_id", "quality", "toxic"]))
def labels_summary(spark, sf):
    s = reports.column_summary(table(spark, sf, "labels"))
    return s.select("column", "null_count", "unique_count", "min", "max", "mean", "std")


@register("page_split_url", """
SELECT page_id, split_part(url, '://', 1) AS scheme,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS address FROM pages""")
def page_split_url(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return cells.split_column(p, "url", "://", ["scheme", "address"])


@register("page_html_outliers", """
WITH l AS (SELECT page_id, length(html)::DOUBLE AS html_len FROM pages),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
      (SELECT quantile_cont(html_len, 0.25) AS q1, quantile_cont(html_len, 0.75) AS q3 FROM l))
SELECT 'html_len' AS column, count(*) FILTER (WHERE html_len < lo OR html_len > hi) AS n_outliers,
  round(count(*) FILTER (WHERE html_len < lo OR html_len > hi) * 100.0::DOUBLE / count(*), 2) AS outlier_pct,
  round(any_value(lo), 2) AS lower, round(any_value(hi), 2) AS upper FROM l, b""")
def page_html_outliers(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.length("html").cast("double").alias("html_len"))
    return reports.detect_outliers_report(p, "html_len").select("column", "n_outliers", "outlier_pct", "lower",
                                                                 "upper")
