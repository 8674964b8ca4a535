"""Physical plan checks: pushdown, pruning, broadcast, shuffles."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from cohortbeam import fixtures as fx
from cohortbeam.operators import evaluate as ev
from cohortbeam.operators import joins as jn
from cohortbeam.operators import registry as rg
from cohortbeam.sources import readers as rd


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exclusion_is_broadcast_anti_join(spark):
    p = plan(jn.exclude(fx.studies(spark, SF_SMALL), fx.bad_labels(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_path_index_never_reads_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    df = rd.path_index(spark, str(tmp_path))
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in p.split("ReadSchema")[-1] if "ReadSchema" in p else "content" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = fx.paths(spark, SF_SMALL)
    p = plan(df)
    assert "ReadSchema: struct<event_id:bigint>" in p
    lk = rg.lookup(spark.read.parquet(f"{SF_SMALL}/part.parquet").withColumnRenamed("p_name", "folder_name"), "x")
    assert "PushedFilters: [IsNotNull(p_name), EqualTo(p_name,x)]" in plan(lk)


def test_roc_reads_the_scores_once(spark):
    p = plan(ev.roc_points(fx.scored_long(spark, SF_SMALL)))
    assert "Window" in p and "embeddings.parquet" not in p  # only the checkpointed groups are left
    assert plan(ev.score_groups(fx.scored_long(spark, SF_SMALL))).count("Scan parquet") == 1


def test_histograms_have_no_nested_loop_and_one_scan_of_values(spark):
    from cohortbeam.operators import cohort as co
    df = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    p = plan(co.histogram(df, "p_size", 5))
    assert "NestedLoop" not in p and "Cartesian" not in p
    assert "NestedLoop" not in plan(co.histogram(df, "p_size", 5, by="p_type"))


def test_row_local_queries_do_not_shuffle(spark):
    q = E.queries()
    for name in ("group_split", "cam_heatmap", "topk_predictions", "format_predictions", "validate_rows"):
        df = q[name](spark, SF_SMALL)
        assert "Exchange" not in plan(df), name


def test_scoring_uses_arrow_batches(spark):
    p = plan(E.queries()["score_table"](spark, SF_SMALL))
    assert "ArrowEvalPython" in p or "MapInPandas" in p or "PythonUDF" in p


def test_last_write_wins_uses_partial_aggregation(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"))
    p = plan(rg.latest_per_key(df, "k", ["ts"]))
    assert "partial_max" in p and "Window" not in p


def _final_plan(df) -> str:
    """The final adaptive plan only (the text also carries the initial plan)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_roc_shuffles_distinct_scores_once(spark):
    p = _final_plan(ev.score_groups(fx.scored_long(spark, SF_SMALL)))
    big = [ln for ln in p.splitlines() if "Exchange hashpartitioning(label" in ln and "score" in ln]
    assert len(big) == 1, big  # the pre-aggregated (label, score) shuffle happens once


def test_bulk_job_is_one_branch_with_one_model_call(spark):
    p = _final_plan(E.queries()["bulk_patient_job"](spark, SF_SMALL))
    assert "Union" not in p
    assert p.count("ArrowEvalPython") == 1
