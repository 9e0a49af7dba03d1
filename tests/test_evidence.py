import datetime

import pytest
from pyspark.sql import functions as F

from auditlake.operators import evidence, reviews, rollups, statutory
from auditlake.params import Params
from auditlake.plans import recovery
from auditlake.session import materialize

P = Params()


def inputs(claims):
    return evidence.Inputs(claims, rollups.provider_day(claims), rollups.provider_code(claims), rollups.provider_dim(claims))


def visits(pid, n, code, amount, specialty="Family Medicine", day=None):
    return [
        {"provider_id": pid, "specialty": specialty, "fee_code": code, "amount": amount, "patient_id": f"{pid}{code}{i}",
         "service_date": day or f"2024-{i % 12 + 1:02d}-{i % 27 + 1:02d}"} for i in range(n)
    ]


def test_upcoding_against_the_cohort(make_claims):
    rows = [r for p in ("A", "B", "C") for r in visits(p, 30, "99213", 85.0)]
    rows += visits("X", 20, "99215", 200.0) + visits("X", 10, "99213", 85.0)
    got = evidence.upcoding(inputs(make_claims(rows)), P).collect()
    assert [r.provider_id for r in got] == ["X"]
    assert got[0].support_claims == 30
    assert got[0].estimated_extra_revenue == pytest.approx(30 * ((20 * 200 + 10 * 85) / 30 - 85))
    assert got[0].evidence.startswith("Top-tier E/M codes on 67% of 30 office visits vs Family Medicine cohort median 0%")


def test_too_few_visits_say_nothing(make_claims):
    assert evidence.upcoding(inputs(make_claims(visits("X", 24, "99215", 200.0))), P).count() == 0


def test_duplicate_scheme_counts_resubmissions(make_claims):
    rows = [{"patient_id": str(i), "amount": 10.0} for i in range(3) for _ in range(3)]
    row = evidence.duplicates(inputs(make_claims(rows)), P).first()
    assert (row.support_claims, row.estimated_extra_revenue) == (3, 60.0)


def test_unbundling_scheme_clips_the_total_only(make_claims):
    rows = []
    for patient, amount in (("A", 50.0), ("B", 30.0)):
        rows += [{"patient_id": patient, "fee_code": c, "amount": amount} for c in ("93005", "93010")]
    assert evidence.unbundling(inputs(make_claims(rows)), P).first().estimated_extra_revenue == 20.0


def test_weekend_and_unit_inflation(make_claims):
    rows = visits("W", 20, "99213", 10.0, day="2024-01-06") + [
        {"provider_id": p, "fee_code": "96372", "units": u, "amount": 10.0 * u, "patient_id": str(i)}
        for p, u in (("N1", 1), ("N2", 1), ("U", 8)) for i in range(12)
    ]
    got = {r.scheme: r for r in evidence.findings(inputs(make_claims(rows)), P).collect()}
    assert got[evidence.WEEKEND].support_claims == 20
    assert got[evidence.UNITS].provider_id == "U"
    assert got[evidence.UNITS].estimated_extra_revenue == pytest.approx(12 * 7 * 10.0)


def found(spark, rows):
    return spark.createDataFrame(rows, "provider_id string, specialty string, scheme string, evidence string, estimated_extra_revenue double, support_claims long")


def window(spark, make_claims, months, ratio=1.0):
    """months: {first day: amount}; returns the best window of one provider."""
    days = materialize(rollups.provider_day(make_claims([{"service_date": d, "amount": a} for d, a in months.items()])))
    total = sum(months.values())
    recovery_ = statutory.statutory_recovery(
        found(spark, [("P1", "S", evidence.WEEKEND, "e", total * ratio, 1)]), days, P, statutory.request_date(days)
    )
    return recovery_.first()


def test_short_span_is_fully_recoverable(spark, make_claims):
    row = window(spark, make_claims, {"2023-01-10": 100.0, "2023-11-10": 50.0}, 0.5)
    assert (row.recoverable, row.months_in_window, row.outside_window) == (75.0, 11, 0.0)
    assert (row.window_start, row.window_end) == (datetime.date(2023, 1, 1), datetime.date(2023, 11, 1))


@pytest.mark.parametrize("months", [
    {"2020-01-10": 5.0, "2021-06-10": 7.0, "2021-12-10": 7.0, "2023-01-10": 9.0, "2023-02-10": 1.0},
    {"2020-01-10": 50.0, "2023-02-10": 1.0},
    {"2020-01-10": 1.0, "2020-02-10": 80.0, "2021-11-10": 1.0, "2022-06-10": 3.0, "2023-03-10": 80.0},
])
def test_best_window_equals_the_filled_walk(spark, make_claims, months):
    row = window(spark, make_claims, months)
    first, last = min(months), max(months)
    n = (int(last[:4]) - int(first[:4])) * 12 + int(last[5:7]) - int(first[5:7]) + 1
    filled = [0.0] * n
    for d, a in months.items():
        filled[(int(d[:4]) - int(first[:4])) * 12 + int(d[5:7]) - int(first[5:7])] += a
    sums = [sum(filled[i - 23:i + 1]) for i in range(23, n)]
    end = 23 + sums.index(max(sums))
    assert row.recoverable == max(sums) and row.outside_window == sum(filled) - max(sums)
    y, m = divmod(int(first[:4]) * 12 + int(first[5:7]) - 1 + end, 12)
    assert row.window_end == datetime.date(y, m + 1, 1) and row.months_in_window == 24


def test_claims_before_the_lookback_do_not_count(spark, make_claims):
    row = window(spark, make_claims, {"2010-01-10": 1000.0, "2023-01-10": 10.0})
    assert row.recoverable == 10.0 and row.total_billed == 1010.0


def test_pathways_and_provenance(spark, make_claims):
    claims = make_claims(visits("A", 40, "99213", 3000.0, day="2024-01-06") + visits("B", 40, "99213", 10.0, day="2024-01-06"))
    meta = spark.createDataFrame([("demo_src", None, "1", None, False)], "source string, description string, version string, effective_date string, authoritative boolean")
    run = recovery.run(claims, P, meta)
    got = {r.provider_id: r for r in run.summary.collect()}
    assert got["A"].recommended_next_step.endswith("Request for Records and Information letter")
    assert got["B"].recommended_next_step.endswith("request records for the flagged dates")
    assert got["A"].figure_status == "INDICATIVE" and got["A"].fee_schedule == "demo_src (1) — NOT authoritative"
    real = statutory.provenance(meta.withColumn("authoritative", F.lit(True)), validated=True).first()
    assert real.figure_status == "DEFENSIBLE" and real.fee_schedule == "demo_src v1"
    lines = [r.line for r in recovery.casebook_lines(run).orderBy("line_no").collect()]
    assert lines[0].startswith("Providers with a concern: 2") and len(lines) == 3


def test_unknown_scheme_gets_the_default_concern(spark):
    row = statutory.classify(found(spark, [("A", "S", "Something new", "e", 1.0, 1)])).first()
    assert (row.concern, row.circumstances, row.needs_medical_consult) == ("Potential Billing Concern", ["b"], True)


def test_only_unreviewed_clinical_findings_are_pending(spark):
    rows = [("A", "S", evidence.UPCODING, "e", 1.0, 1), ("B", "S", evidence.UPCODING, "e", 1.0, 1), ("C", "S", evidence.WEEKEND, "e", 1.0, 1)]
    log = spark.createDataFrame([(1, "B", evidence.UPCODING, "supports_necessity", "Dr")], "seq long, provider_id string, concern string, opinion string, consultant string")
    assert [tuple(r) for r in reviews.pending_reviews(found(spark, rows), log).collect()] == [("A", evidence.UPCODING)]
    with pytest.raises(Exception, match="unknown opinion"):
        reviews.checked_opinions(log.withColumn("opinion", F.lit("maybe"))).collect()


def test_report_lines_follow_the_sections(spark, tmp_path):
    from auditlake.operators import report
    from auditlake.sources import sinks

    found = spark.createDataFrame(
        [("A", "S", "x", "seen twice", 100.0, 2), ("A", "S", "y", "seen once", 50.0, 1), ("B", "S", "x", "seen thrice", 300.5, 3)],
        "provider_id string, specialty string, scheme string, evidence string, estimated_extra_revenue double, support_claims long",
    )
    days = spark.createDataFrame([("A", datetime.date(2024, 1, 5), 4), ("B", datetime.date(2024, 2, 1), 6)], "provider_id string, service_date date, n_claims long")
    codes = spark.createDataFrame([("A", "1"), ("B", "1")], "provider_id string, fee_code string")
    people = spark.createDataFrame([("A", "S"), ("B", "S"), ("C", "T")], "provider_id string, specialty string")
    rows = report.report_rows(found, days, codes, people, spark.createDataFrame([("A",), ("C",)], "provider_id string"), examples=1)
    assert rows.count() == 8 + 2 + 2 + 2 + 3
    sinks.export_text(report.report_lines(rows), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[:3] == ["## Dataset", "- claims; 10", "- providers; 3"] and "- last day; 2024-02-01" in lines
    assert lines[9:12] == ["## Providers", "- B; S: x; 1; $300", "- A; S: x, y; 2; $150"]
    assert lines[12:18] == ["## Schemes", "- x; 2; $400", "- y; 1; $50", "## Examples", "- B; x: seen thrice; 3; $300", "- A; y: seen once; 1; $50"]
    assert lines[18:] == ["## Truth", "- hit; 1", "- missed; 1", "- not_planted; 1"]
    assert report.report_rows(found.limit(0), days.limit(0), codes.limit(0), people.limit(0)).count() == 8
