"""Recipe, versions, history, CSV and stream application."""

import tempfile

import pytest

from scrubspark.operators import history, rows
from scrubspark.plans import recipe, versions
from scrubspark.session import scratch_path
from scrubspark.sources import csv


def test_recipe_equals_step_by_step(people):
    from scrubspark.operators import cells

    steps = [{"name": "standardize_text", "args": {"column": "city", "case": "title"}},
             {"name": "handle_missing_values", "args": {"column": "age", "strategy": "median"}},
             {"name": "filter_rows", "args": {"column": "age", "condition": "greater_than", "value": 120}}]
    res = recipe.run_recipe(people, steps)
    manual = rows.filter_rows(cells.fill_missing(cells.standardize_text(people, "city", case="title"),
                                                 "age", "median"), "age", "greater_than", 120)
    assert sorted(res.df.collect()) == sorted(manual.collect())


def test_recipe_validation_skip_and_errors(people, spark):
    steps = [{"name": "drop_column", "args": {"columns": ["price"]}},
             {"name": "drop_column", "args": {"columns": ["price"]}},
             {"name": "no_such_tool", "args": {}},
             {"name": "rename_column", "args": {"old_name": "age"}},
             {"name": "clip_numeric_range", "args": {"column": "age", "min_value": 0, "colour": "red"}},
             {"name": "value_counts", "args": {"column": "status"}},
             {"name": "drop_duplicates", "args": {}}]
    res = recipe.run_recipe(people, steps)
    res.write(scratch_path(spark, "recipe-test"))
    audit = {r["step"]: r for r in res.audit().collect()}
    assert [audit[i]["outcome"] for i in range(7)] == ["Success", "Skipped", "Error", "Error", "Error",
                                                        "Result", "Success"]
    assert audit[6]["rows_after"] == 7 and audit[6]["rows_before"] == 8
    assert audit[0]["rows_before"] == 8 and audit[0]["rows_after"] == 8
    assert 5 in res.reports and "price" not in res.df.columns


def test_versioned_table_undo_redo(spark, people):
    vt = versions.VersionedTable(spark, scratch_path(spark, "vt-test"), people)
    assert not vt.can_undo() and not vt.can_redo()
    vt.apply(rows.drop_duplicates(vt.current()))
    vt.apply(vt.current().where("age IS NOT NULL"))
    assert vt.current().count() == 5
    assert vt.undo() and vt.current().count() == 7 and vt.can_redo()
    vt.apply(vt.current().limit(3))          # branching drops the redo future
    assert not vt.can_redo() and vt.current_version() == 2
    assert vt.undo() and vt.undo() and not vt.undo()
    assert vt.current().count() == 8
    d = vt.diff(0, 1)
    assert d.where("change = 'removed'").count() == 1 and d.where("change = 'added'").count() == 0


def test_replay_version_log(spark):
    log = spark.createDataFrame([(1, 1, "apply"), (1, 2, "apply"), (1, 3, "undo"), (1, 4, "undo"), (1, 5, "undo"),
                                 (1, 6, "redo"), (2, 1, "redo"), (2, 2, "apply"), (2, 3, "undo"), (2, 4, "apply")],
                                "s int, seq int, action string")
    out = {r["s"]: r for r in versions.replay_version_log(log, "s", "seq", "action").collect()}
    assert (out[1]["current_index"], out[1]["n_versions"], out[1]["can_redo"]) == (1, 3, True)
    assert (out[2]["current_index"], out[2]["n_versions"], out[2]["can_undo"]) == (1, 2, True)


def test_history(spark):
    conv = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}.{t}")
                                  for c in range(3) for t in range(c * 4 + 2)], "c int, t int, role string, text string")
    recent = history.last_n_per_key(conv, ["c"], "t", 2)
    assert recent.groupBy("c").count().where("count > 2").count() == 0 and recent.count() == 6
    kept, folded = history.fold_older_turns(conv, ["c"], "t", "role", "text", trigger=5, keep=2)
    f = {r["c"]: r for r in folded.collect()}
    assert set(f) == {1, 2} and f[1]["n_folded"] == 4
    assert f[1]["transcript"].split("\n")[0] == "user: m1.0"
    assert kept.count() == conv.count() - 4 - 8
    nulls = conv.selectExpr("CASE WHEN c = 2 THEN NULL ELSE c END AS c", "t", "role", "text")
    kept_n, folded_n = history.fold_older_turns(nulls, ["c"], "t", "role", "text", trigger=5, keep=2)
    assert kept_n.count() == kept.count() and folded_n.count() == 2


def test_csv_roundtrip_inference(spark, people):
    path = scratch_path(spark, "csv-test")
    csv.write_csv(people, path)
    back = csv.read_csv(spark, path)
    types = dict(back.dtypes)
    assert types["customer_id"] == "bigint" and types["age"] == "double" and types["salary"] == "double" and types["city"] == "string"
    assert back.count() == 8 and back.where("age IS NULL").count() == 2


def test_stream_applies_fitted_steps(spark, tmp_path):
    from scrubspark.streaming.clean import apply_to_stream, freeze_steps

    src = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{src}/events.parquet")
    steps = [{"name": "handle_outliers", "args": {"column": "value", "method": "cap"}},
             {"name": "standardize_text", "args": {"column": "event_type", "case": "upper"}},
             {"name": "filter_rows", "args": {"column": "value", "condition": "less_than", "value": 1}}]
    frozen = freeze_steps(batch, steps)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(src)
    q = (apply_to_stream(stream, frozen).writeStream.format("memory").queryName("cleaned_events")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("cleaned_events")
    want = apply_to_stream(batch, frozen)
    assert got.count() == want.count() > 0
    assert got.where("event_type <> upper(event_type)").count() == 0


def test_stream_rejects_stateful_steps(spark):
    from scrubspark.streaming.clean import freeze_steps

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    with pytest.raises(ValueError, match="stream"):
        freeze_steps(batch, [{"name": "drop_duplicates", "args": {}}])


def test_file_order_dedup_and_missing_pattern_match_pandas(spark):
    import pandas as pd

    from scrubspark.operators import reports
    from scrubspark.sources.parquet import ORDER_COLUMNS, read_parquet_ordered

    path = "/root/testdata/sf0.01/orders.parquet"
    df = read_parquet_ordered(spark, path)
    got = rows.drop_duplicates(df, ["o_custkey"], "first", ORDER_COLUMNS)
    pdf = pd.read_parquet(path)
    want = pdf.drop_duplicates(subset=["o_custkey"], keep="first")
    assert sorted(r["o_orderkey"] for r in got.select("o_orderkey").collect()) == sorted(want.o_orderkey.tolist())

    gaps = df.selectExpr("*", "CASE WHEN o_orderkey % 3 = 0 OR o_custkey < 200 THEN NULL ELSE o_totalprice END AS p")
    rep = reports.detect_missing_pattern(gaps, "p", ORDER_COLUMNS).first()
    is_null = ((pdf.o_orderkey % 3 == 0) | (pdf.o_custkey < 200)).to_numpy()
    run = best = 0
    for v in is_null:
        run = run + 1 if v else 0
        best = max(best, run)
    assert rep["n_missing"] == int(is_null.sum()) and rep["longest_run"] == best


def test_recipe_batches_independent_fits(spark, monkeypatch):
    from scrubspark.functions import stats

    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").selectExpr(
        "l_orderkey", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS q",
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS d", "l_extendedprice", "l_tax")
    steps = [{"name": "handle_missing_values", "args": {"column": "q", "strategy": "median"}},
             {"name": "handle_missing_values", "args": {"column": "d", "strategy": "mean"}},
             {"name": "handle_outliers", "args": {"column": "l_extendedprice", "method": "cap"}},
             {"name": "handle_outliers", "args": {"column": "l_tax", "method": "cap"}}]
    calls = []
    real_fit = stats.fit
    monkeypatch.setattr(stats, "fit", lambda *a, **k: calls.append(1) or real_fit(*a, **k))
    batched = recipe.run_recipe(df, steps).df
    assert len(calls) == 1
    monkeypatch.setattr(stats, "fit", real_fit)
    from scrubspark.operators import cells

    one = cells.fill_missing(df, "q", "median")
    one = cells.fill_missing(one, "d", "mean")
    one = cells.cap_outliers(one, "l_extendedprice")
    one = cells.cap_outliers(one, "l_tax")
    assert sorted(batched.collect()) == sorted(one.collect())


def test_csv_file_order_and_failfast(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("k,v\n" + "".join(f"{i % 7},{i}\n" for i in range(500)))
    df = csv.read_csv(spark, str(p), with_order=True)
    first = rows.drop_duplicates(df, ["k"], "first", csv.ORDER_COLUMNS)
    assert sorted(r["v"] for r in first.collect()) == list(range(7))
    bad = tmp_path / "bad.csv"
    bad.write_text("k,v\n1,2\n3,4,5\n")
    with pytest.raises(Exception):
        csv.read_csv(spark, str(bad)).collect()


def test_checkpoint_folder_rules():
    from scrubspark import session

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class SC:
        def __init__(self, master):
            self.master, self.applicationId, self.dir = master, "app-x", None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Sess:
        def __init__(self, conf, master):
            self.conf, self.sparkContext = Conf(conf), SC(master)

    shared = Sess({"spark.checkpoint.dir": "hdfs://nn/shared"}, "yarn")
    assert session.checkpoint_dir(shared) == "hdfs://nn/shared"
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Sess({}, "yarn"))          # never invent a local folder on a cluster
    local = Sess({}, "local[4]")
    first = session.checkpoint_dir(local)
    assert first.startswith(tempfile.gettempdir()) and session.checkpoint_dir(local) == first


def test_version_diff_counts_copies(spark):
    base = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None)], "k int, v string")
    vt = versions.VersionedTable(spark, scratch_path(spark, "vt-diff"), base)
    vt.apply(spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (3, "y")], "k int, v string"))
    d = sorted((r["change"], r["k"], r["v"], r["copies"]) for r in vt.diff(0, 1).collect())
    assert d == [("added", 3, "y", 2), ("removed", 1, "x", 2)]


def test_diff_over_changed_columns(spark):
    base = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "k int, v string, `a.b` int")
    vt = versions.VersionedTable(spark, scratch_path(spark, "vt-diff"), base)
    vt.apply(base.drop("v"))
    vt.apply(base.selectExpr("cast(k as string) as k", "v", "`a.b`"))
    vt.apply(base.selectExpr("if(k = 1, 'one', '2') as k", "v", "`a.b`"))
    dropped = sorted((r["change"], r["k"], r["v"], r["a.b"], r["copies"]) for r in vt.diff(0, 1).collect())
    assert dropped == [("added", 1, None, 5, 1), ("removed", 1, "x", 5, 1)]
    assert vt.diff(0, 2).count() == 0          # the same values as text
    assert vt.diff(0, 3).count() == 2
    assert [tuple(r) for r in vt.schema_diff(0, 1).collect()] == [("v", "string", None)]
    assert [tuple(r) for r in vt.schema_diff(0, 2).collect()] == [("k", "int", "string")]


def test_snapshots_are_written_once(spark, people):
    root = scratch_path(spark, "vt-once")
    vt = versions.VersionedTable(spark, root, people)
    vt.apply(people.limit(5))
    redo = vt.current()
    vt.undo()
    vt.apply(redo.limit(3))                    # reads the snapshot that the redo version had
    assert vt.current().count() == 3 and not vt.can_redo()
    other = versions.VersionedTable(spark, root)
    other.apply(people.limit(2))
    assert vt.current_version() == 2 and vt.current().count() == 2 and vt.version(1).count() == 3
    vt.apply(people.limit(1))
    assert other.version(2).count() == 2 and other.current().count() == 1


def test_exact_integers(spark):
    from scrubspark.operators import cells, reports

    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,), (None,)], "k long")
    kept = {r[0] for r in rows.filter_rows(df, "k", "equals", str(big + 1)).collect()}
    assert kept == {big, big + 2, None}
    assert {r[0] for r in rows.filter_rows(df, "k", "greater_than", str(big)).collect()} == {big, None}
    assert {r[0] for r in cells.fill_missing(df, "k", "constant", str(big + 3)).collect()} == {big, big + 1, big + 2, big + 3}
    assert {r[0] for r in cells.find_and_replace(df, "k", str(big + 1), str(big + 9)).collect()} == {big, big + 9, big + 2, None}
    assert reports.column_summary(df).first()["unique_count"] == 3
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert {r[0] for r in rows.filter_rows(flags, "b", "equals", "True").collect()} == {False, None}
    assert [r[0] for r in cells.find_and_replace(flags, "b", "True", "False").collect()] == [False, False, None]


def test_column_clashes_are_found_case_aside(spark):
    from scrubspark.operators import cells

    df = spark.createDataFrame([("a b", "x", "2020-01-02")], "t string, First string, d string")
    with pytest.raises(ValueError):
        cells.split_column(df, "t", " ", ["first", "second"])
    with pytest.raises(ValueError):
        cells.merge_columns(df, ["t", "d"], "first")
    twice = cells.extract_datetime_parts(cells.extract_datetime_parts(df, "d", ["year"]), "d", ["year"])
    assert twice.columns.count("d_year") == 1 and twice.first()["d_year"] == 2020


def test_order_is_asked_for(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        rows.drop_duplicates(df, ["k"], "last")
    ordered = df.selectExpr("*", "'f' as _file", "if(v = 'a', 0L, 1L) as _row")
    assert rows.drop_duplicates(ordered, ["k"], "last").first()["v"] == "b"


def test_audit_counts_what_was_written(spark, people, tmp_path):
    res = recipe.run_recipe(people, [{"name": "drop_duplicates", "args": {}},
                                     {"name": "drop_column", "args": {"columns": ["price"]}}])
    res.df.show(3)
    assert [r["rows_after"] for r in res.audit().collect()] == [None, None]
    res.write(str(tmp_path / "out"))
    audit = res.audit().collect()
    assert [(r["rows_before"], r["rows_after"]) for r in audit] == [(8, 7), (7, 7)] and audit[0]["written_at"]


def test_audit_counts_changed_cells_and_keeps_a_log(spark, people, tmp_path):
    steps = [{"name": "standardize_text", "args": {"column": "city", "case": "upper"}},
             {"name": "handle_missing_values", "args": {"column": "AGE", "strategy": "median", "exact": False}},
             {"name": "find_and_replace", "args": {"column": "customer_id", "old_value": "1", "new_value": "one"}},
             {"name": "drop_column", "args": {"columns": ["state"]}}]
    ids_cities = [tuple(r) for r in people.select("customer_id", "city").collect()]
    changed = sum(c is not None and c != c.strip().upper() for _, c in ids_cities)
    ones = sum(i == 1 for i, _ in ids_cities)
    res, log = recipe.run_recipe(people, steps), str(tmp_path / "log")
    res.write(str(tmp_path / "a"), log_path=log)
    res.write(str(tmp_path / "b"), log_path=log)
    got = [r["cells_changed"] for r in res.audit().orderBy("step").collect()]
    assert got == [changed, people.where("age IS NULL").count(), ones, None]
    assert spark.read.parquet(log).groupBy("step").count().where("count = 2").count() == len(steps)
    assert spark.read.parquet(str(tmp_path / "a")).columns == [c for c in people.columns if c != "state"]


def test_csv_reads_what_pandas_reads(spark, tmp_path):
    import pandas as pd

    p = tmp_path / "odd.csv"
    p.write_text('k,x,t\n1,inf,"a\nb"\n2,-Infinity\n3,2.5,"say ""hi"""\n4,,  pad \n5,NA,x\n')
    df = csv.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"k": "bigint", "x": "double", "t": "string"}
    want = pd.read_csv(p)
    got = {r["k"]: (r["x"], r["t"]) for r in df.collect()}
    for k, x, t in want.itertuples(index=False):
        assert got[k] == (None if pd.isna(x) else x, None if pd.isna(t) else t)
    long = tmp_path / "long.csv"
    long.write_text("k,v\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells"):
        csv.read_csv(spark, str(long), infer_types=False).select("k").collect()


def test_written_csv_comes_back_cell_by_cell(spark):
    rows_ = [(1, 'a "quoted", cell'), (2, "two\nlines"), (3, " padded "), (4, None), (5, "back\\slash"), (6, "r\r\nn")]
    path = scratch_path(spark, "csv-cells")
    csv.write_csv(spark.createDataFrame(rows_, "k long, t string"), path)
    assert sorted(tuple(r) for r in csv.read_csv(spark, path).collect()) == rows_
