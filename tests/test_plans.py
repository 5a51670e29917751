"""Plan shape: native expressions, pushed filters, pruned scans, bounded windows."""

from scrubspark.operators import cells, history, rows
from scrubspark.suite.dirty import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cell_chain_is_one_projection_without_python(spark):
    c = table(spark, SF, "customer")
    out = cells.standardize_text(c, "c_mktsegment", case="title")
    out = cells.find_and_replace(out, "c_mktsegment", "Building", "Construction")
    out = cells.clip_numeric_range(out, "c_acctbal", 0, 5000)
    out = cells.merge_columns(out, ["c_name", "c_mktsegment"], "label")
    p = plan(out)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # one scan, no shuffle; the title-case lambda stays its own (interpreted) projection
    assert p.count("FileScan") == 1 and "Exchange" not in p and p.count("Project") <= 2


def test_filter_reaches_the_scan(spark):
    o = table(spark, SF, "orders").select("o_orderkey", "o_custkey")
    p = plan(rows.filter_rows(o, "o_custkey", "greater_than", 1000))
    assert "PushedFilters: [Or(LessThanOrEqual(o_custkey,1000),IsNull(o_custkey))]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


def test_dedup_is_an_aggregate_not_a_window(spark):
    o = table(spark, SF, "orders")
    p = plan(rows.drop_duplicates(o, ["o_custkey"], "first", ["o_orderdate", "o_orderkey"]))
    assert "Window" not in p and "partial_min_by" in p


def test_last_n_is_limited_before_the_shuffle(spark):
    conv = table(spark, SF, "conversations")
    out = history.last_n_per_key(conv, ["conv_id"], "turn", 3)
    out.collect()
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_value_counts_run_no_python(spark):
    from scrubspark.operators import reports

    e = table(spark, SF, "events")
    p = plan(reports.value_counts(e, "event_type"))
    assert "Python" not in p and "Pandas" not in p


def test_column_summary_scans_a_column_once_for_values(spark):
    from scrubspark.operators import reports

    li = table(spark, SF, "lineitem")
    out = reports.column_summary(li)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one scan for the wide aggregate, one for the values of each family of types (its columns alone); texts
    # were counted by hash before, what is read of that is a small table
    scans = [line.split("ReadSchema: ")[-1] for line in final.splitlines()
             if "FileScan parquet" in line and "h1:" not in line]
    assert len(scans) == 4
    for c in li.columns:
        assert sum(f"{c}:" in x for x in scans) <= 2, c
    assert not any("hashpartitioning(value" in line for line in final.splitlines())


def test_no_query_plans_pairs_or_python_rows(spark):
    from scrubspark import suite
    from scrubspark.suite.registry import QUERIES

    suite.load_all()
    hazards = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
    for name, q in QUERIES.items():
        df = q(spark, SF)
        p = df._jdf.queryExecution().executedPlan().toString()
        found = [h for h in hazards if h in p]
        assert not found, f"{name}: {found}"
