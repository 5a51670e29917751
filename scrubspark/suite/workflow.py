"""Checks for the recipe, version, history, CSV and streaming operators (whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubspark.operators import history, rows
from scrubspark.plans import recipe, versions
from scrubspark.session import scratch_path
from scrubspark.sources import csv
from scrubspark.suite.dirty import table, view, with_views
from scrubspark.suite.registry import num_sql, register

# --- recipe ---------------------------------------------------------------------------

CLEAN_CUSTOMER_STEPS = [
    {"name": "standardize_text", "args": {"column": "segment", "case": "upper"}},
    {"name": "handle_missing_values", "args": {"column": "acctbal", "strategy": "median"}},
    {"name": "remove_type_anomalies", "args": {"column": "nation_txt", "expected_type": "numeric"}},
    {"name": "convert_dtype", "args": {"column": "nation_txt", "target_type": "int"}},
    {"name": "standardize_text", "args": {"column": "segment", "case": "upper"}},   # repeated: skipped
    {"name": "drop_column", "args": {"columns": ["no_such_column"]}},               # error: logged, skipped
    {"name": "drop_duplicates", "args": {"subset": ["segment", "nation_txt"], "keep": "first",
                                         "order_by": ["c_custkey"]}},
    {"name": "value_counts", "args": {"column": "segment", "top_n": 5}},            # report only
]


@register("recipe_clean_customer", with_views("dirty_customer") + f"""
, s1 AS (SELECT c_custkey, acctbal, upper(trim(segment)) AS segment, nation_txt, segment_gap FROM dirty_customer),
s2 AS (SELECT c_custkey, coalesce(acctbal, (SELECT quantile_cont(acctbal, 0.5) FROM s1)) AS acctbal, segment,
         nation_txt, segment_gap FROM s1),
s3 AS (SELECT c_custkey, acctbal, segment,
         CASE WHEN nation_txt IS NOT NULL AND {num_sql('nation_txt')} IS NULL THEN NULL ELSE nation_txt END AS nation_txt,
         segment_gap FROM s2),
s4 AS (SELECT c_custkey, acctbal, segment, CAST({num_sql('nation_txt')} AS BIGINT) AS nation_txt, segment_gap FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY segment, nation_txt ORDER BY c_custkey) AS rn FROM s4)
SELECT c_custkey, round(acctbal, 6) AS acctbal, segment, nation_txt, segment_gap FROM s5 WHERE rn = 1""")
def recipe_clean_customer(spark, sf):
    res = recipe.run_recipe(view(spark, sf, "dirty_customer"), CLEAN_CUSTOMER_STEPS)
    return res.df.withColumn("acctbal", F.round("acctbal", 6))


@register("recipe_audit", with_views("dirty_customer") + """
, a AS (SELECT acctbal FROM dirty_customer), b AS (SELECT * FROM a WHERE acctbal IS NOT NULL),
c AS (SELECT * FROM b WHERE NOT acctbal < 0)
SELECT 0 AS step, 'Success' AS outcome, (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after
UNION ALL SELECT 1, 'Error', (SELECT count(*) FROM b), (SELECT count(*) FROM b)
UNION ALL SELECT 2, 'Success', (SELECT count(*) FROM b), (SELECT count(*) FROM c)""")
def recipe_audit(spark, sf):
    steps = [{"name": "handle_missing_values", "args": {"column": "acctbal", "strategy": "drop_rows"}},
             {"name": "drop_column", "args": {"columns": ["no_such_column"]}},
             {"name": "filter_rows", "args": {"column": "acctbal", "condition": "less_than", "value": 0}}]
    res = recipe.run_recipe(view(spark, sf, "dirty_customer").select("acctbal"), steps)
    res.df.take(3)                     # reading a part of the result is not the run that is audited
    res.write(scratch_path(spark, "audited"))
    return res.audit().select("step", "outcome", "rows_before", "rows_after")


CELL_AUDIT_STEPS = [
    {"name": "standardize_text", "args": {"column": "segment", "case": "upper"}},
    {"name": "handle_missing_values", "args": {"column": "acctbal", "strategy": "median"}},
    {"name": "remove_type_anomalies", "args": {"column": "nation_txt", "expected_type": "numeric"}},
    {"name": "handle_missing_values", "args": {"column": "segment_gap", "strategy": "drop_rows"}},
    {"name": "find_and_replace", "args": {"column": "segment", "old_value": "BUILDING", "new_value": "HOUSING"}},
    {"name": "clip_numeric_range", "args": {"column": "acctbal", "min_value": 0, "max_value": 5000}},
]


@register("recipe_audit_cells", with_views("dirty_customer") + f"""
, s AS (SELECT acctbal, segment, upper(trim(segment)) AS up, nation_txt, segment_gap FROM dirty_customer),
f AS (SELECT coalesce(acctbal, (SELECT quantile_cont(acctbal, 0.5) FROM s)) AS acctbal, up, segment_gap FROM s),
k AS (SELECT * FROM f WHERE segment_gap IS NOT NULL)
SELECT 0 AS step, (SELECT count(*) FROM s WHERE segment IS DISTINCT FROM up) AS cells_changed,
  (SELECT count(*) FROM s) AS rows_after
UNION ALL SELECT 1, (SELECT count(*) FROM s WHERE acctbal IS NULL), (SELECT count(*) FROM s)
UNION ALL SELECT 2, (SELECT count(*) FROM s WHERE nation_txt IS NOT NULL AND {num_sql('nation_txt')} IS NULL),
  (SELECT count(*) FROM s)
UNION ALL SELECT 3, 0, (SELECT count(*) FROM k)
UNION ALL SELECT 4, (SELECT count(*) FROM k WHERE up = 'BUILDING'), (SELECT count(*) FROM k)
UNION ALL SELECT 5, (SELECT count(*) FROM k WHERE acctbal < 0 OR acctbal > 5000), (SELECT count(*) FROM k)""")
def recipe_audit_cells(spark, sf):
    res = recipe.run_recipe(view(spark, sf, "dirty_customer"), CELL_AUDIT_STEPS)
    log = scratch_path(spark, "change-log")
    res.write(scratch_path(spark, "audited"), log_path=log)
    return spark.read.parquet(log).select("step", "cells_changed", "rows_after")


VALUE_AUDIT_STEPS = [
    {"name": "handle_missing_values", "args": {"column": "acctbal", "strategy": "median"}},
    {"name": "handle_outliers", "args": {"column": "acctbal", "method": "cap", "iqr_multiplier": 0.5}},
    {"name": "clip_numeric_range", "args": {"column": "acctbal", "min_value": 0}},
    {"name": "handle_missing_values", "args": {"column": "segment_gap", "strategy": "drop_rows"}},
]


@register("recipe_audit_values", with_views("dirty_customer") + """
, m AS (SELECT quantile_cont(acctbal, 0.5) AS med FROM dirty_customer),
f AS (SELECT coalesce(acctbal, med) AS v FROM dirty_customer, m),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM f)
SELECT 0 AS step, round(med, 6) AS fill, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM m
UNION ALL SELECT 1, NULL, round(q1 - 0.5::DOUBLE * (q3 - q1), 6), round(q3 + 0.5::DOUBLE * (q3 - q1), 6) FROM q
UNION ALL SELECT 2, NULL, 0, NULL UNION ALL SELECT 3, NULL, NULL, NULL""")
def recipe_audit_values(spark, sf):
    res = recipe.run_recipe(view(spark, sf, "dirty_customer"), VALUE_AUDIT_STEPS)
    return res.audit().select("step", *[F.round(F.col("values")[k], 6).alias(k) for k in ("fill", "lower", "upper")])


# --- versions -------------------------------------------------------------------------

@register("version_diff", with_views("dup_orders") + """
, d AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM dup_orders),
k AS (SELECT DISTINCT * FROM d)
SELECT change, o_orderkey, o_custkey, o_orderstatus, o_totalprice, count(*) AS copies FROM (
  SELECT 'removed' AS change, * FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM k)
  UNION ALL
  SELECT 'added' AS change, * FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM d)) GROUP BY ALL""")
def version_diff(spark, sf):
    vt = versions.VersionedTable(spark, scratch_path(spark, "versions"),
                                 view(spark, sf, "dup_orders").drop("copy_no"))
    vt.apply(rows.drop_duplicates(vt.current()))
    vt.undo()
    vt.redo()
    return vt.diff(0, vt.current_version())


@register("version_diff_dropped", with_views("dup_orders") + """
, d AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM dup_orders)
SELECT 'removed' AS change, o_orderkey, o_custkey, o_orderstatus, count(*) AS copies FROM d
WHERE o_custkey IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'added', o_orderkey, NULL, o_orderstatus, count(*) FROM d WHERE o_custkey IS NOT NULL GROUP BY ALL""")
def version_diff_dropped(spark, sf):
    base = view(spark, sf, "dup_orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    vt = versions.VersionedTable(spark, scratch_path(spark, "versions"), base)
    vt.apply(vt.current().drop("o_custkey"))
    return vt.diff(0, 1)


_LOG_SQL = """CASE WHEN event_type = 'view' THEN 'undo' WHEN event_type = 'error' THEN 'redo' ELSE 'apply' END"""


@register("version_replay", f"""
WITH RECURSIVE log AS (
  SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {_LOG_SQL} AS action
  FROM events),
walk(s, i, cur, len) AS (
  SELECT DISTINCT s, 0, 0, 1 FROM log
  UNION ALL
  SELECT w.s, w.i + 1,
    CASE WHEN l.action = 'apply' THEN w.cur + 1 WHEN l.action = 'undo' AND w.cur > 0 THEN w.cur - 1
         WHEN l.action = 'redo' AND w.cur < w.len - 1 THEN w.cur + 1 ELSE w.cur END,
    CASE WHEN l.action = 'apply' THEN w.cur + 2 ELSE w.len END
  FROM walk w JOIN log l ON l.s = w.s AND l.i = w.i + 1),
last AS (SELECT s, max(i) AS i FROM walk GROUP BY s)
SELECT w.s AS user_id, CAST(w.cur AS INTEGER) AS current_index, CAST(w.len AS INTEGER) AS n_versions,
  w.cur > 0 AS can_undo, w.cur < w.len - 1 AS can_redo
FROM walk w JOIN last USING (s, i)""")
def version_replay(spark, sf):
    e = table(spark, sf, "events")
    log = e.select("user_id", "event_id", F.expr(_LOG_SQL).alias("action"))
    return versions.replay_version_log(log, "user_id", "event_id", "action")


# --- history --------------------------------------------------------------------------

@register("recent_turns", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""")
def recent_turns(spark, sf):
    return history.last_n_per_key(table(spark, sf, "conversations"), ["conv_id"], "turn", 3)


@register("older_transcript", """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS cnt,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations)
SELECT conv_id, count(*) AS n_folded, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM r WHERE cnt > 5 AND from_end > 3 GROUP BY conv_id""")
def older_transcript(spark, sf):
    _, folded = history.fold_older_turns(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text",
                                         trigger=5, keep=3)
    return folded


@register("kept_turns", """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS cnt,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations)
SELECT conv_id, turn, role, text FROM r WHERE NOT (cnt > 5 AND from_end > 3)""")
def kept_turns(spark, sf):
    kept, _ = history.fold_older_turns(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text",
                                       trigger=5, keep=3)
    return kept


# --- CSV ------------------------------------------------------------------------------

@register("csv_roundtrip", """
SELECT count(*) AS n_rows, round(sum(c_acctbal), 2) AS sum_acctbal, count(DISTINCT c_mktsegment) AS n_segments,
  CAST(sum(c_nationkey) AS BIGINT) AS sum_nationkey,
  'c_custkey:bigint,c_name:string,c_nationkey:bigint,c_acctbal:double,c_mktsegment:string' AS inferred
FROM customer""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf, "customer"), path)
    back = csv.read_csv(spark, path)
    inferred = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in back.schema.fields)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("sum_acctbal"),
                    F.count_distinct("c_mktsegment").alias("n_segments"),
                    F.sum("c_nationkey").alias("sum_nationkey"), F.lit(inferred).alias("inferred"))


# texts with quotes, newlines, delimiters, null tokens and outer spaces
_ODD_CELL = """CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN concat('say "hi", ', text)
  WHEN 2 THEN concat('a', chr(10), '"', chr(10), text) WHEN 3 THEN 'NA' WHEN 4 THEN concat('  ', text, ' ')
  ELSE concat(text, '"') END"""


@register("csv_cells", f"""
WITH d AS (SELECT doc_id, lang, source, n_chars, {_ODD_CELL} AS cell FROM documents)
SELECT doc_id, lang, source, n_chars, md5(nullif(nullif(cell, ''), 'NA')) AS cell_md5 FROM d""")
def csv_cells(spark, sf):
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf, "documents").select("doc_id", F.expr(_ODD_CELL).alias("cell"), "lang", "source",
                                                       "n_chars"), path)
    return csv.read_csv(spark, path).select("doc_id", "lang", "source", "n_chars", F.md5("cell").alias("cell_md5"))


# --- streaming ------------------------------------------------------------------------

STREAM_STEPS = [
    {"name": "handle_outliers", "args": {"column": "value", "method": "cap"}},
    {"name": "standardize_text", "args": {"column": "event_type", "case": "upper"}},
    {"name": "filter_rows", "args": {"column": "value", "condition": "less_than", "value": 1}},
]


@register("stream_clean_events", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
c AS (SELECT e.event_id, upper(trim(e.event_type)) AS event_type,
        CASE WHEN e.value < b.lo THEN b.lo WHEN e.value > b.hi THEN b.hi ELSE e.value END AS value
      FROM events e, b)
SELECT event_id, event_type, round(value, 6) AS value FROM c WHERE NOT coalesce(value < 1, false)""")
def stream_clean_events(spark, sf):
    from scrubspark.streaming.clean import apply_to_stream, freeze_steps

    batch = table(spark, sf, "events")
    frozen = freeze_steps(batch, STREAM_STEPS)
    stream = (spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = (apply_to_stream(stream, frozen).select("event_id", "event_type", "value").writeStream
         .format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("value", F.round("value", 6))
