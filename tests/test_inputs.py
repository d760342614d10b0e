"""Odd inputs: nulls, levels outside the design, constant columns, empty profiles, unlisted strata."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from poolwise import FactorSpec
from poolwise.operators import cells as C, models as M, partitions as R, prep as P, search
from poolwise.operators.search import exhaustive_set, frontier_set

SPEC = FactorSpec(["a", "b"], [4, 3])


def facts(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, y double")


def test_rows_without_a_level_count_nowhere(spark):
    got = C.cell_moments(SPEC, facts(spark, [(1, 1, 2.0), (None, 1, 5.0), (1, None, 5.0), (1, 1, None)])).collect()
    assert [(r["n"], r["sum_y"]) for r in got] == [(1, 2.0)]


@pytest.mark.parametrize("row", [(1, 3, 1.0), (4, 0, 1.0), (-1, 0, 1.0)])
def test_a_level_outside_the_design_is_an_error(spark, row):
    with pytest.raises(PySparkException, match="level outside the design"):
        C.cell_moments(SPEC, facts(spark, [(1, 1, 2.0), row])).collect()


def test_outlier_filter_keeps_rows_without_a_value(spark):
    df = facts(spark, [(1, 1, 2.0), (1, 1, None), (None, 1, 20.0)])
    assert [r["y"] for r in P.without_outliers(df, "y", high=9).collect()] == [2.0, None]
    assert P.without_keys(df, "a", [1]).count() == 1


def test_constant_columns_scale_to_null(spark):
    df = facts(spark, [(1, 1, 2.0), (1, 2, 2.0)])
    assert [r["s"] for r in P.min_max_scale(df, "y", "s").collect()] == [None, None]


def test_cells_without_rows_make_boxes_without_error(spark):
    cells = C.complete_cells(SPEC, C.cell_table(SPEC, facts(spark, [(1, 1, 2.0), (2, 1, 3.0)])).select("policy_id", "n", "sum_y", "mean_y", "ssw", "profile_id"))
    boxes = R.box_moments(SPEC, cells.withColumn("profile_id", SPEC.profile_of_policy()))
    assert boxes.where("n = 0 AND mean_y IS NOT NULL").count() == 0 and boxes.where("sse IS NULL").count() == 0


@pytest.mark.parametrize("budget", [None, 3])
def test_a_profile_without_cells_has_no_scores_on_either_route(spark, monkeypatch, budget):
    cells = C.cell_table(SPEC, facts(spark, [(1, 1, 2.0), (2, 1, 3.0), (3, 2, 1.0)]))
    for limit in (R.LOOKUPS, 0):
        monkeypatch.setattr(R, "LOOKUPS", limit)
        assert R.score_space(SPEC, cells, 0.1, 1, budget).count() == 0
        full = R.score_space(SPEC, cells, 0.1, SPEC.full_profile, budget)
        assert full.count() == (8 if budget is None else full.where("h <= 3").count())
    assert exhaustive_set(SPEC, cells, theta=10.0, reg=0.1, profile_id=1).count() == 0
    assert frontier_set(SPEC, cells, theta=10.0, reg=0.1, profile_id=1).count() == 0


def test_a_threshold_needs_a_positive_step(spark):
    with pytest.raises(ValueError, match="step"):
        search.expanding_threshold(spark.createDataFrame([(1.0,)], "q double"), 0.5, 0.0)


def test_an_unlisted_stratum_is_named(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, "x"), (2, 1, 3.0, "y"), (1, 2, 1.0, "z")], "a int, b int, y double, s string")
    cells = C.cell_table(SPEC, rows, by=["s"])
    with pytest.raises(PySparkException, match="not among the listed strata: z"):
        M.stratified_models(SPEC, M.stratified_scores(SPEC, cells, "s", 0.1, SPEC.full_profile), "s", ["x", "y"], 25.0).collect()


def test_collapsed_models_take_loss_and_size_of_the_pooled_one(spark):
    found = spark.sql("SELECT '0:1|1:1' AS model_key, 0.9D AS loss, 4L AS n_pools, array(named_struct('slot', 0, 'cut_mask', 1L), named_struct('slot', 1, 'cut_mask', 1L)) AS members")
    pooled = spark.sql("SELECT 1L AS cut_mask, 0.7D AS q, 2L AS h")
    row = M.collapse_homogeneous(found, pooled, 2).first()
    assert (row["model_key"], row["loss"], row["n_pools"], row["is_pooled"]) == ("-1:1", 0.7, 2, True)
    assert M.collapse_homogeneous(found, pooled.where(F.lit(False)), 2).first()["loss"] == 0.9
