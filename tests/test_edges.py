"""Edge cases and the reference behaviours B1-B16 on tiny literal frames."""
import math

import pytest
from pyspark.sql import functions as F

from cohortbeam.functions import features as feat
from cohortbeam.functions import text as tx
from cohortbeam.operators import cohort as co
from cohortbeam.operators import evaluate as ev
from cohortbeam.operators import ranking as rk
from cohortbeam.operators import registry as rg
from cohortbeam.operators import validate as va


def test_parse_age_guards(spark):
    df = spark.createDataFrame([("058Y",), (" 7 ",), ("+7",), ("-3Y",), ("5.0",), ("1_0",), ("Y",), ("abc",), (None,),
                                ("99999999999",), ("Y4Y5",)], "a string")
    got = [r[0] for r in df.select(feat.parse_age("a")).collect()]
    assert got == [58, 7, 7, -3, None, None, None, None, None, None, 45]


def test_sanitize_title_case_b1(spark):
    df = spark.createDataFrame([("john doe",), ("johnDOEoNeil",), ("1234",), ("",), (None,), ("Mary-Ann O'Neil",)], "n string")
    got = [r[0] for r in df.select(tx.sanitize_name("n")).collect()]
    assert got == ["Johndoe", "Johndoeoneil", "Unknown", "Unknown", "Unknown", "Maryannoneil"]


def test_folder_key_roundtrip(spark):
    df = spark.createDataFrame([("ann lee", "2026-02-09"), ("x9", "2025-12-31")], "n string, d string")
    k = df.select(tx.folder_key("n", F.to_date("d")).alias("k"))
    p = k.select("k", *[v.alias(n) for n, v in tx.parse_folder(F.col("k")).items()]).collect()
    assert [(r.k, r.patient_name, r.date, r.date_raw) for r in p] == [
        ("Annlee20260209", "Annlee", "2026-02-09", "20260209"), ("X20251231", "X", "2025-12-31", "20251231")]


def test_folder_parse_fallback_f11(spark):
    df = spark.createDataFrame([("run_31",), ("Abc2026010",), ("Abc99999999",)], "folder_name string")
    r = df.select(*[v.alias(n) for n, v in tx.parse_folder(F.col("folder_name")).items()]).collect()
    assert (r[0].patient_name, r[0].date, r[0].date_raw) == ("run_31", "Unknown", "00000000")
    assert r[1].date == "Unknown"
    assert r[2].date == "9999-99-99"  # text only; not a date check


def test_registry_sort_tiebreak_b15(spark):
    df = spark.createDataFrame([("Bob20260101",), ("Amy20260101",), ("Cy20260105",), ("bad",)], "folder_name string")
    got = [r.folder_name for r in rg.registry_list(df).collect()]
    assert got == ["Cy20260105", "Amy20260101", "Bob20260101", "bad"]


def test_last_write_wins_b2(spark):
    log = spark.createDataFrame([("A", 1, 10, "old"), ("A", 2, 20, "new"), ("A", 3, 20, "newer"), ("B", 4, 5, "b")],
                                "folder_name string, idx int, ts int, v string")
    got = {r.folder_name: r.v for r in rg.latest_per_key(log, "folder_name", ["ts", "idx"]).collect()}
    assert got == {"A": "newer", "B": "b"}


def test_band_after_rounding_b16(spark):
    df = spark.createDataFrame([(0.49951,), (0.2495,), (0.24949,), (0.5,)], "p double")
    got = [r[0] for r in df.select(tx.risk_band("p")).collect()]
    assert got == ["high", "medium", "low", "high"]


def test_age_operators_b7_b8(spark):
    df = spark.createDataFrame([(450,), (-5,), (30,)], "age int")
    r = df.select(feat.train_age_norm("age").alias("t"), feat.serve_age_norm("age").alias("s")).collect()
    assert [x.t for x in r] == [4.5, -0.05, 0.3]
    assert [x.s for x in r] == [1.0, 0.0, 0.3]
    v = va.validate(spark.createDataFrame([(151, "m", "pa", None), (150, "F", "AP", None)],
                                          "age int, gender string, view string, content binary"), content=None)
    assert [r.valid for r in v.collect()] == [False, True]


def test_view_parse_and_onehot_b10(spark):
    df = spark.createDataFrame([("AP supine",), ("PA",), ("LL",), (None,), ("pa",)], "v string")
    assert [r[0] for r in df.select(feat.parse_view("v")).collect()] == ["AP", "PA", "UNK", "UNK", "UNK"]
    ap, pa = feat.serve_view_onehot("v")
    assert [(r[0], r[1]) for r in df.select(ap, pa).collect()] == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_validation_collects_all_messages(spark):
    df = spark.createDataFrame([(200, "x", "LL", bytearray(b"GIF89a..."))], "age int, gender string, view string, content binary")
    errs = va.validate(df).first().errors
    assert errs == ["Invalid age: 200. Must be between 0 and 150.", "Invalid gender: x. Must be 'M' or 'F'.",
                    "Invalid view: LL. Must be 'AP' or 'PA'.", "Invalid image format: GIF. Must be PNG or JPEG."]


def test_topk_tie_orders_t1_t2(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5, 0.1],)], "s array<double>")
    m = F.map_from_arrays(F.array(*[F.lit(x) for x in "abcd"]), F.col("s"))
    r = df.select(rk.top_k(m, 3).alias("t"), rk.top_indices(F.col("s"), 3).alias("i"), rk.top_prediction(m).alias("p")).first()
    assert [e.key for e in r.t] == ["b", "c", "a"]  # map order on ties
    assert list(r.i) == [2, 1, 0]                    # reverse class order on ties
    assert r.p == "b"


def test_exclusion_compat_b9(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "idx long, Mass int")
    paths = spark.createDataFrame([(1, "a.png"), (2, "b.png")], "idx long, file_path string")
    cat = spark.createDataFrame([(1, 7, "050Y", "M", "PA"), (2, 8, "060Y", "F", "AP")],
                                "idx long, patient_id long, age_raw string, gender string, view_position string")
    bad = spark.createDataFrame([(2,)], "idx long")
    strict = co.build_cohort(labels, paths, cat, bad).collect()
    compat = co.build_cohort(labels, paths, cat, bad, compat_exclusion=True).orderBy("idx").collect()
    assert [r.idx for r in strict] == [1]
    assert [(r.idx, r.patient_id) for r in compat] == [(1, 7), (2, None)]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "image_key long, label string, score double, truth int")


def test_one_sided_class_is_skipped_b4(spark):
    rows = [(i, "A", i / 10, i % 2) for i in range(10)] + [(i, "B", i / 10, 0) for i in range(10)]
    rep = {r.Pathology: r for r in ev.eval_report(_scored(spark, rows), labels=["A", "B"]).collect()}
    assert rep["B"].skipped and rep["B"].AUC_ROC is None and rep["B"].OptimalThreshold is None
    assert not rep["A"].skipped and rep["A"].AUC_ROC is not None


def test_threshold_is_inclusive_b6(spark):
    rows = [(0, "A", 0.9, 1), (1, "A", 0.5, 1), (2, "A", 0.5, 0), (3, "A", 0.1, 0)]
    r = ev.eval_report(_scored(spark, rows), labels=["A"]).first()
    # points: (thr .9: tp1 fp0, J=.5), (thr .5: tp2 fp1, J=.5), first max -> .9
    assert r.OptimalThreshold == 0.9 and r.TP == 1 and r.FP == 0 and r.FN == 1 and r.TN == 2
    assert math.isclose(r.AUC_ROC, (1 + 1 + 0.5 + 1) / 4)


def test_youden_infinite_when_nothing_beats_start(spark):
    rows = [(0, "A", 0.9, 0), (1, "A", 0.1, 1)]
    r = ev.eval_report(_scored(spark, rows), labels=["A"]).first()
    assert r.OptimalThreshold == float("inf") and r.TP == 0 and r.FP == 0 and r.Precision == 0.0


def test_histogram_total_and_empty_bins(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (10,)], "age int")
    h = co.histogram(df, "age", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 0, 0, 0, 1]
    assert sum(r["count"] for r in h) == 4
    assert h[0].interval == "1 to 2" and h[-1].right == 10.0
    assert h[1].log_count is None


def test_drop_if_exists_and_strip(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, b int")
    assert df.drop("No Finding").columns == [" a ", "b"]
    assert df.toDF(*[c.strip() for c in df.columns]).columns == ["a", "b"]


def test_input_contract_v3(spark):
    df = spark.createDataFrame([([1.0], [1.0])], "image array<double>, meta array<double>")
    va.require_columns(df, {"image": "array<double>", "meta": "array<double>"})
    with pytest.raises(ValueError):
        va.require_columns(df, {"image": "array<double>", "meta": "array<float>", "extra": ""})


def test_label_list_f14(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 0)], "a int, b int, c int")
    got = [r[0] for r in df.select(tx.label_list({"a": "a", "b": "b", "c": "c"})).collect()]
    assert got == ["a|c", "No Label"]


def test_filename_label_roundtrip_f19(spark):
    df = spark.createDataFrame([("Pleural Thickening",), ("a/b",)], "l string")
    r = df.select(tx.heatmap_filename("l").alias("f")).select("f", tx.label_from_filename("f").alias("b")).collect()
    assert [(x.f, x.b) for x in r] == [("gradcam_Pleural_Thickening.png", "Pleural_Thickening"), ("gradcam_a_b.png", "a_b")]


def test_iso_date_part_f13(spark):
    df = spark.createDataFrame([("2026-01-05T10:00:00",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.iso_date_part("t")).collect()] == ["2026-01-05", "N/A", "N/A"]


def test_distinct_count_exact_and_approx(spark):
    df = spark.range(20000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE id % 5000 END AS p")
    assert co.distinct_count(df, "p").first()[0] == 4500  # multiples of 10 only come from NULLed ids
    approx = co.distinct_count(df, "p", approx=True, rsd=0.02).first()[0]
    assert abs(approx - 4500) / 4500 < 0.08


def test_strict_threshold_option_b6(spark):
    rows = [(0, "A", 0.9, 1), (1, "A", 0.9, 0), (2, "A", 0.5, 1), (3, "A", 0.1, 0)]
    df = _scored(spark, rows)
    ge = ev.eval_report(df, labels=["A"]).first()
    gt = ev.eval_report(df, labels=["A"], strict=True).first()
    assert ge.OptimalThreshold == gt.OptimalThreshold == 0.5
    assert (ge.TP, ge.FP) == (2, 1) and (gt.TP, gt.FP) == (1, 1)
