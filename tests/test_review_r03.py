"""Growth of the panel and of rank correlations: what is shuffled, and how often it is sorted."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.operators.comparison import assignment_table
from signalloom.operators.evaluation import walk_forward_report
from signalloom.operators.grid import active_members, calendar, dense_grid
from signalloom.operators.panel import PanelConfig, build_panel, forward_labels, forward_targets, label_sessions
from signalloom.operators.portfolio import balance
from signalloom.operators.signals import daily_rank_ic, rank_ic, redundancy
from signalloom.operators.tuning import grouped_moments
from signalloom.plans import derived, queries
from signalloom.plans.derived import CONFIG, TARGET, Universe


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_two_sides_take_a_sort_each(spark):
    long = spark.range(40).selectExpr("id % 3 AS day", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    steps = plan(rank_ic(long, ["day"], "x", "y", 2))
    assert steps.count("Exchange hashpartitioning") == 1 and steps.count("Sort [") == 2
    rows = spark.range(40).selectExpr("id % 3 AS as_of_date", "id AS symbol", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    assert plan(redundancy(rows, ["x", "y"], 2)).count("Sort [") == 2


def test_panel_reads_the_grid_once_and_shuffles_no_lookback(spark):
    u = Universe(spark, "/root/testdata/sf0.001")
    panel = build_panel(u.prices, u.calendar, u.bench, u.members, u.dates, CONFIG)
    steps = plan(panel)
    # Lists of a lookback's prices and returns end below the join with active members.
    joined = steps[: steps.index("collect_list(price")]
    assert "LeftSemi" in joined and steps.count("collect_list(price") <= 2
    assert sum("lead(price" in line and "Window" in line for line in steps.splitlines()) == 1


def test_no_task_gathers_a_fold(spark):
    rows = spark.createDataFrame(
        [(1, "training", "2020-01-01", "2020-01-09"), (1, "training", "2020-01-02", "2020-01-08"), (1, "evaluation", "2020-02-01", None), (2, "excluded", "2020-01-01", "2020-01-09")],
        "fold int, role string, as_of_date string, label_end_date string",
    ).selectExpr("*", "null AS exclusion_reason", "'2020-02-01' AS evaluation_start", "'2020-02-02' AS evaluation_end")
    table = assignment_table(rows, F.col("as_of_date"))
    assert "Window" not in plan(table)
    assert {(r["fold"], r["row_id"], r["train_end_date"], r["train_label_end_max"]) for r in table.collect()} == {
        (1, "2020-01-01", "2020-01-02", "2020-01-09"), (1, "2020-01-02", "2020-01-02", "2020-01-09"), (1, "2020-02-01", "2020-01-02", "2020-01-09"), (2, "2020-01-01", None, None),
    }


def test_scores_meet_the_bounds_of_folds_without_a_shuffle(spark):
    steps = plan(queries.QUERIES["evidence_violations"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in steps.splitlines() if "SortMergeJoin [fold#" in line and line.split("SortMergeJoin [")[1].split("]")[0].count("#") == 1]


def test_the_grid_is_made_by_all_tasks(spark):
    prices = spark.createDataFrame([(s, d, 1.0) for s in range(40) for d in ("2020-01-06", "2020-01-13")], "symbol long, session string, price double").selectExpr("symbol", "CAST(session AS date) AS session", "price")
    grid = dense_grid(prices, calendar(prices))
    assert grid.count() == 80 and "REPARTITION_BY_NUM" in plan(grid)


def test_frames_of_symbols_are_not_put_into_fewer_tasks(spark):
    u = Universe(spark, "/root/testdata/sf0.001")
    below = plan(build_panel(u.prices, u.calendar, u.bench, u.members, u.dates, CONFIG)).split("collect_list(price")[-1]
    frames = next(line for line in below.splitlines() if "Exchange hashpartitioning(symbol" in line)
    assert "REPARTITION_BY_NUM" in frames


def test_rows_of_ranks_carry_numbers_for_names(spark):
    rows = spark.range(60).selectExpr("id % 3 AS as_of_date", "id AS symbol", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y", "CAST(id % 11 AS DOUBLE) AS z", "1 AS fold", "IF(id % 3 = 2, 'test', 'training') AS role")
    for made in (redundancy(rows, ["x", "y", "z"], 2), daily_rank_ic(rows, ["x", "y"], "z", 2), walk_forward_report(rows, ["x", "y"], "z", 2, 2)):
        dealt = [line for line in plan(made).splitlines() if "REPARTITION_BY_NUM" in line]
        assert dealt and not any(name in line for line in dealt for name in ("left", "feature", "role"))
    assert {(r["left"], r["right"]) for r in redundancy(rows, ["x", "y", "z"], 2).collect()} == {("x", "y"), ("x", "z"), ("y", "z")}
    assert {r["feature"] for r in daily_rank_ic(rows, ["x", "y"], "z", 2).collect()} == {"x", "y"}
    assert {r["feature"] for r in walk_forward_report(rows, ["x", "y"], "z", 2, 2).collect()} == {"x", "y"}


def test_a_journal_is_replayed_once_for_its_balance(spark):
    made = queries._journal(Universe(spark, "/root/testdata/sf0.001", "brand"), queries._ACCOUNT)
    assert plan(balance(made, 1e6)).count("FlatMapGroupsInPandas") == 1


def test_moments_meet_a_row_once(spark):
    train = spark.range(30).selectExpr("1 AS outer", "CAST(id % 2 AS INT) AS inner", "CAST(id AS DOUBLE) AS x", "IF(id % 5 = 0, NULL, CAST(id % 4 AS DOUBLE)) AS z", "CAST(id % 3 AS DOUBLE) AS y", "1.0D AS weight")
    made = grouped_moments(train, ["outer", "inner"], ["x", "z"], "y")
    assert "explode(array(struct" not in made._jdf.queryExecution().optimizedPlan().toString() and plan(made).count("Generate") == 0
    for r in made.collect():
        ids = [i for i in range(30) if i % 2 == r["inner"]]
        middle = sorted(i % 4 for i in ids if i % 5)
        half = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
        rows = [(1.0, float(i), half if i % 5 == 0 else float(i % 4), 0.0, float(i % 5 == 0), float(i % 3)) for i in ids]
        want = {(a, b): sum(v[a] * v[b] for v in rows) for a in range(6) for b in range(a, 6)}
        assert {(t["i"], t["j"]): t["p"] for t in r["sums"]} == want == {(t["i"], t["j"]): t["w"] for t in r["sums"]}


def test_splits_build_no_panel(spark):
    derived.release()
    for name in ("training_weights", "fold_assignments", "outer_folds", "training_cross_sections", "evaluation_cross_sections", "maturity_mask", "assignment_violations", "evidence_violations"):
        steps = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "collect_list(price" not in steps and "lead(price" not in steps
    assert not {"panel", "prices"} & {key[3] for key in derived._KEPT}


def test_targets_are_those_of_the_panel(spark):
    for by in ("supplier", "brand"):
        u = Universe(spark, "/root/testdata/sf0.01", by)
        want = u.panel.select("as_of_date", "symbol", "label_end_date", "forward_return", TARGET)
        assert u.targets.count() == want.count() > 0 and not u.targets.exceptAll(want).count()


def test_targets_of_gaps_and_of_the_calendar_s_end(spark):
    day = "DATE_ADD(DATE '2020-01-06', CAST(7 * id AS INT))"
    prices = spark.range(6).selectExpr(f"{day} AS session", "EXPLODE(ARRAY(1, 2, 3)) AS symbol", "CAST(10 + id * id AS DOUBLE) AS price").where("NOT (symbol = 2 AND session = '2020-01-20') AND NOT (symbol = 3 AND session = '2020-02-03')")
    cal, bench = calendar(prices), prices.groupBy("session").agg(F.avg("price").alias("price")).where("session <> '2020-02-10'")
    active = cal.select(F.col("session").alias("as_of_date")).crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("symbol")))
    config = PanelConfig(target_horizon_sessions=2)
    made = forward_targets(prices, bench, label_sessions(cal, config), active)
    want = forward_labels(dense_grid(prices, cal, bench), cal, bench, active, config).select(*made.columns)
    assert made.count() == 24 and not made.exceptAll(want).count() and 0 < made.where("forward_return IS NULL").count() < 24


def test_members_meet_their_dates_in_all_tasks(spark):
    dates = spark.createDataFrame([("2020-01-06",), ("2020-01-13",)], "as_of_date string").selectExpr("CAST(as_of_date AS date) AS as_of_date")
    members = spark.range(40).selectExpr("id AS symbol", "DATE '2020-01-01' AS effective_from", "CAST(NULL AS date) AS effective_to")
    active = active_members(dates, members)
    below = plan(active).split("Generate explode(filter(_bins")[1]
    assert active.count() == 80 and "REPARTITION_BY_NUM" in below
