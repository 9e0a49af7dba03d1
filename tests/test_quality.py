import pytest
from pyspark.sql import functions as F

from auditlake.operators import quality
from auditlake.sources import readers, schemas, sinks

RAW = schemas.RAW_CLAIMS


def raw(spark, **change):
    base = {
        "claim_id": "C1", "provider_id": "P1", "provider_name": "Dr", "specialty": "S", "patient_id": "A",
        "service_date": "2024-01-02", "fee_code": "00790", "fee_description": "d", "service_minutes": "10",
        "units": "1", "amount_billed": "5.50", "modifier": "", "clinic_id": "C",
    }
    base.update(change)
    return spark.createDataFrame([tuple(base[f.strip().split(" ")[0]] for f in RAW.split(","))], RAW)


@pytest.mark.parametrize("change", [
    {"service_date": "not a date"}, {"service_date": None}, {"provider_id": None}, {"provider_id": "  "},
    {"fee_code": ""}, {"specialty": None},
])
def test_unusable_rows_are_dropped(spark, change):
    assert quality.validate_claims(raw(spark, **change)).count() == 0


@pytest.mark.parametrize("change,minutes,amount", [
    ({"service_minutes": "abc"}, None, 5.5), ({"service_minutes": "-3"}, -3.0, 5.5),
    ({"amount_billed": "free"}, 10.0, None), ({"amount_billed": "-7"}, 10.0, -7.0), ({"patient_id": None}, 10.0, 5.5),
])
def test_odd_numbers_are_kept(spark, change, minutes, amount):
    row = quality.validate_claims(raw(spark, **change)).first()
    assert (row.service_minutes, row.amount_billed, row.fee_code) == (minutes, amount, "00790")


def test_csv_round_trip_keeps_leading_zeros_and_defaults(spark, tmp_path):
    narrow = raw(spark).drop("modifier", "units")
    sinks.export_csv(narrow, str(tmp_path / "claims"))
    back = readers.read_claims_csv(spark, str(tmp_path / "claims"))
    row = quality.validate_claims(back).first()
    assert row.fee_code == "00790" and row.modifier == "" and row.units == 1 and row.service_minutes == 10.0


@pytest.mark.parametrize("given,clean", [("25.0", "25"), ("25", "25"), (None, ""), ("nan", "")])
def test_modifier_cleanup(spark, given, clean):
    assert readers.with_optional_columns(raw(spark, modifier=given)).first().modifier == clean


def test_counters(spark):
    both = raw(spark, service_minutes="x", amount_billed="-1").unionByName(raw(spark, provider_id=" ", service_minutes="0"))
    row = quality.quality_counts(both).first()
    assert (row.n_rows, row.non_numeric_service_minutes, row.non_positive_minutes, row.negative_amounts, row.blank_provider_id) == (2, 1, 1, 1, 1)


def test_risk_scores_are_clipped(spark):
    scores = spark.createDataFrame([("a", -5.0), ("b", 110.0), ("c", float("nan")), ("d", None)], "provider_id string, risk_score double")
    got = {r.provider_id: r.risk_score for r in quality.validate_risk_scores(scores).collect()}
    assert got == {"a": 0.0, "b": 100.0, "c": 0.0, "d": 0.0}
    assert tuple(quality.risk_score_counts(scores).first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        quality.validate_risk_scores(scores.drop("risk_score"))


def test_truth_and_fee_files(spark, tmp_path):
    (tmp_path / "truth.json").write_text(
        '{"all_bad_actors": ["P1", "P2"],\n "clean_providers": {"T1": {"description": "d", "type": "t"}},\n "schemes": {"up": ["P1"]}}'
    )
    truth = readers.read_ground_truth(spark, str(tmp_path / "truth.json"))
    assert sorted(map(tuple, readers.truth_labels(truth).collect())) == [("P1", 1), ("P2", 1), ("T1", 0)]
    assert [tuple(r) for r in readers.truth_schemes(truth).collect()] == [("P1", "up")]
    (tmp_path / "fees.csv").write_text("fee_code,description,amount,tier,minutes\n00790,Anesthesia,500.0,3,60\n1,x,2.0,,\n")
    fees = readers.read_fee_schedule(spark, str(tmp_path / "fees.csv"))
    assert {r.fee_code: (r.amount, r.tier, r.minutes) for r in fees.collect()} == {"00790": (500.0, 3, 60), "1": (2.0, 0, 0)}
    priced = readers.price_of(raw(spark).unionByName(raw(spark, fee_code="zz")), fees)
    assert {r.fee_code: r.scheduled_amount for r in priced.collect()} == {"00790": 500.0, "zz": None}


def test_dataset_names_and_empty_tables(spark):
    assert readers.Dataset("/data/", "large").path("claims.csv") == "/data/claims_large.csv"
    assert readers.Dataset("/data").path("claims.csv") == "/data/claims.csv"
    empty = readers.empty(spark, schemas.RULE_FLAGS)
    assert empty.count() == 0 and "evidence" in empty.columns


def test_append_missing_skips_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_missing(spark.createDataFrame([(1, "a")], "k int, v string"), path, "k")
    sinks.append_missing(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_report_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    sinks.export_text(lines, str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["a", "b"]
    sinks.export_json(lines, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_claims_layout_prunes_months(spark, make_claims, tmp_path):
    claims = make_claims([{"service_date": f"2024-0{m}-05", "provider_id": f"P{m}"} for m in range(1, 7)])
    sinks.save_claims_layout(claims, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 6
    one = back.where(F.col("service_month_key") == "2024-03")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_month_key" in plan
