import datetime
import math

import pytest
from pyspark.sql import functions as F

from auditlake.operators import cases, chain, chain_store, evaluation, explain, fairness
from auditlake.params import Params
from auditlake.session import materialize
from auditlake.streaming import streams

P = Params()
EVENT = "provider_id string, seq long, event_date date, kind string, stage string, field string, value date"
D = datetime.date


def events(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        day = D(2024, 3, i + 1)
        if r in cases.STAGES:
            full.append(("A", i, day, "stage", r, None, None))
        else:
            full.append(("A", i, day, "mark", None, r[0], r[1]))
    return spark.createDataFrame(full, EVENT)


def test_full_review_opens_the_clock(spark):
    row = cases.case_states(events(spark, cases.INITIAL, cases.REVIEW, cases.REVIEW), P).first()
    assert (row.stage, row.status, row.records_requested_date, row.ack_due_date) == (cases.REVIEW, "records_requested", D(2024, 3, 2), D(2024, 3, 16))


def test_entered_dates_win_or_yield_by_order(spark):
    row = cases.case_states(events(spark, ("records_requested_date", D(2024, 1, 1)), cases.REVIEW), P).first()
    assert (row.records_requested_date, row.ack_due_date, row.status) == (D(2024, 1, 1), None, "preliminary_review")
    row = cases.case_states(events(spark, ("ack_due_date", D(2024, 1, 1)), cases.REVIEW), P).first()
    assert row.ack_due_date == D(2024, 3, 16)
    row = cases.case_states(events(spark, cases.REVIEW, ("ack_due_date", D(2024, 5, 1)), cases.HEARING), P).first()
    assert (row.ack_due_date, row.gm_opinion_date, row.status) == (D(2024, 5, 1), D(2024, 3, 3), "hsarb_referred")


def test_overdue(spark):
    late = cases.case_states(events(spark, cases.REVIEW), P)
    as_of = F.to_date(F.lit("2024-03-16"))
    assert cases.overdue_cases(late, as_of).count() == 1
    assert cases.overdue_cases(late, F.to_date(F.lit("2024-03-15"))).count() == 0
    answered = cases.case_states(events(spark, cases.REVIEW, ("ack_received_date", D(2024, 3, 9))), P)
    assert cases.overdue_cases(answered, as_of).count() == 0


def test_bad_events_are_refused_and_defaults_exist(spark):
    with pytest.raises(Exception, match="bad case event"):
        cases.checked_events(events(spark, ("birthday", D(2024, 1, 1)))).collect()
    people = spark.createDataFrame([("A",), ("B",)], "provider_id string")
    got = {r.provider_id: r.stage for r in cases.with_default_cases(people, cases.case_states(events(spark, cases.CLOSED), P)).collect()}
    assert got == {"A": cases.CLOSED, "B": cases.INITIAL}


def test_letters(spark):
    states = cases.case_states(events(spark, cases.REVIEW), P)
    found = spark.createDataFrame([("A", "S", "one; two", 1234.5, "INDICATIVE")], "provider_id string, specialty string, concerns string, statutory_recoverable double, figure_status string")
    as_of = F.to_date(F.lit("2024-03-05"))
    text = cases.letters(states, found, "records_request", as_of, P).first().letter
    assert "- one\n- two" in text and "2024-03-15" in text
    assert "$1,234" in cases.letters(states, found, "gm_opinion", as_of, P).first().letter
    with pytest.raises(ValueError):
        cases.letters(states, found, "postcard", as_of, P)


FIELDS = ("event_type", "who")


def log(spark, n=600):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.lit("flag_viewed").alias("event_type"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("u"), F.col("id"))).alias("who"))
    return materialize(chain.chained(rows, FIELDS))


def test_chain_finds_the_first_bad_row(spark):
    intact = log(spark)
    assert tuple(chain.verify(intact, FIELDS).first()) == (True, 600, None, "intact")
    tampered = intact.withColumn("who", F.when(F.col("seq").isin(300, 410), "x").otherwise(F.col("who")))
    assert tuple(chain.verify(tampered, FIELDS).first()) == (False, 600, 300, "tampered")
    assert tuple(chain.verify(intact.where("seq <> 20"), FIELDS).first()) == (False, 599, 21, "break")
    assert tuple(chain.verify(log(spark, 0), FIELDS).first()) == (True, 0, None, "intact")


def test_seals_catch_whole_and_cut_segments(spark):
    intact = log(spark)
    seals = materialize(chain.seal_segments(intact))
    assert chain.verify_seals(intact, seals).count() == 0
    assert tuple(chain.verify(intact, FIELDS, seals=seals).first()) == (True, 600, None, "intact")
    assert chain.verify(intact.where("segment <> 2"), FIELDS).first().ok  # rows alone cannot tell
    assert [r.segment for r in chain.verify_seals(intact.where("segment <> 2"), seals).collect()] == [2]
    assert tuple(chain.verify(intact.where("segment <> 1"), FIELDS, seals=seals).first()) == (False, 344, 256, "removed")
    assert tuple(chain.verify(intact.where("seq <> 255"), FIELDS, seals=seals).first()) == (False, 599, 255, "removed")
    assert tuple(chain.verify(intact.where("seq < 599"), FIELDS, seals=seals).first()) == (False, 599, 599, "removed")
    assert tuple(chain.verify(intact.where("seq <> 20 and seq <> 255"), FIELDS, seals=seals).first()) == (False, 598, 21, "break")


def test_seals_end_in_one_root(spark):
    many = spark.range(0, 256 * 300, 256).select(F.col("id").alias("seq"), F.lit("flag_viewed").alias("event_type"), F.lit("u").alias("who"))
    intact = materialize(chain.chained(many, FIELDS))
    seals = chain.seal_segments(intact)
    assert [r.n for r in seals.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect()] == [300, 2, 1]
    roots = {chain.root(chain.seal_segments(x)).first().root for x in (intact, intact.where("segment <> 299"), intact.where("segment <> 7"))}
    assert len(roots) == 3


def stored(spark, base):
    log = chain_store.read_log(spark, base)
    seals = chain_store.read_seals(spark, base).select("level", "seq", "n_rows", "last_hash", "prev_hash", "row_hash")
    return sorted(log.select("seq", "segment", "prev_hash", "row_hash").collect()), sorted(seals.collect())


def whole(spark, events):
    log = materialize(chain.chained(events, FIELDS))
    seals = chain.seal_segments(log).select("level", "seq", "n_rows", "last_hash", "prev_hash", "row_hash")
    return sorted(log.select("seq", "segment", "prev_hash", "row_hash").collect()), sorted(seals.collect())


@pytest.mark.parametrize("ids", [
    [range(0, 10), range(10, 600), range(600, 601), range(601, 1100)],
    # ids with gaps: 256 segments and more, so a third level begins; an append into a new segment; one that jumps far
    [range(0, 256 * 255, 256), range(256 * 255, 256 * 257, 128), [256 * 257 + 5], [256 * 600]],
])
def test_appending_equals_chaining_everything(spark, tmp_path, ids):
    base, done = str(tmp_path / "log"), []
    for n, part in enumerate(ids, 1):
        done += part
        events = spark.createDataFrame([(i, "flag_viewed", f"u{i % 7}") for i in done], "seq long, event_type string, who string")
        assert chain_store.append(spark, base, events if n % 2 else events.where(F.col("seq") >= min(part)), FIELDS) == n
        assert stored(spark, base) == whole(spark, events)
        # tried again: nothing happens
        assert chain_store.append(spark, base, events, FIELDS) == n
    seals = chain_store.read_seals(spark, base)
    assert chain.verify(chain_store.read_log(spark, base), FIELDS, seals=seals).first().ok


def test_an_append_that_was_cut_short_does_not_count(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "log")
    events = spark.range(900).selectExpr("id as seq", "'flag_viewed' as event_type", "'u' as who")
    chain_store.append(spark, base, events.where("seq < 300"), FIELDS)
    before = stored(spark, base)
    monkeypatch.setattr(chain_store, "_HEAD", "broken")
    with pytest.raises(Exception):
        chain_store.append(spark, base, events.where("seq < 700"), FIELDS)
    monkeypatch.undo()
    assert stored(spark, base) == before
    chain_store.append(spark, base, events, FIELDS)
    assert stored(spark, base) == whole(spark, events)


def test_an_append_does_not_read_earlier_rows(spark, tmp_path):
    """The stored rows and seals may even be out of reach: only the head is read."""
    base = str(tmp_path / "log")
    events = spark.range(900).selectExpr("id as seq", "'flag_viewed' as event_type", "'u' as who")
    chain_store.append(spark, base, events.where("seq < 700"), FIELDS)
    for table in ("log", "seals"):
        (tmp_path / "log" / table).rename(tmp_path / f"away-{table}")
    chain_store.append(spark, base, events.where("seq >= 700"), FIELDS)
    for table in ("log", "seals"):
        (tmp_path / f"away-{table}" / "batch=1").rename(tmp_path / "log" / table / "batch=1")
    assert stored(spark, base) == whole(spark, events)


def test_unknown_event_type_is_refused(spark):
    with pytest.raises(Exception, match="unknown event type"):
        chain.checked_events(spark.createDataFrame([("x",)], "event_type string")).collect()


def test_confusion_and_scorecard(spark):
    labels = spark.createDataFrame([("A", 1), ("B", 1), ("C", 0), ("D", 0)], "provider_id string, label int")
    flagged = spark.createDataFrame([("A",), ("C",)], "provider_id string")
    row = evaluation.confusion(labels, flagged).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.precision, row.recall, row.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    none = evaluation.confusion(labels, flagged.where("provider_id = 'zz'")).first()
    assert none.precision is None and none.recall == 0.0 and none.f1 is None
    ranked = spark.createDataFrame([("A", 3, 80.0, 1.0), ("C", 1, 50.0, 1.0), ("E", 2, 60.0, 1.0)], "provider_id string, rank long, risk_score double, estimated_exposure double")
    card = evaluation.scorecard(ranked, labels, P).first()
    assert (card.n_caught_10, card.det_rate_10, card.avg_rank, card.n_fp, card.fp_rate) == (1, 50.0, 3.0, 1, 50.0)
    assert [r.provider_id for r in evaluation.unregistered(ranked, labels).collect()] == ["E"]
    moved = evaluation.scorecard_change(evaluation.scorecard(ranked, labels, P), evaluation.scorecard(ranked.where("rank > 1"), labels, P))
    assert {r.metric: r.delta for r in moved.collect()}["n_fp"] == 1.0


def test_label_sources(spark):
    out = spark.createDataFrame([("A", "Confirmed", 5.0), ("B", "cleared", None)], "provider_id string, outcome string, recovered_amount double")
    got = evaluation.resolve_labels(spark, outcomes=out).collect()
    assert {(r.provider_id, r.label, r.basis) for r in got} == {("A", 1, "ADJUDICATED_OUTCOMES"), ("B", 0, "ADJUDICATED_OUTCOMES")}
    disp = spark.createDataFrame([(1, "A", "confirmed")], "seq long, provider_id string, outcome string")
    assert evaluation.resolve_labels(spark, dispositions=disp, trusted=True).first().basis == "AUDITOR_DISPOSITIONS"
    assert evaluation.resolve_labels(spark, dispositions=disp).count() == 0
    est = spark.createDataFrame([("A", 10.0)], "provider_id string, statutory_recoverable double")
    assert tuple(evaluation.calibration(evaluation.resolve_labels(spark, outcomes=out), est).first()) == (1, 2.0, 5.0)


def test_chi_square(spark):
    df = spark.createDataFrame([(10, 10, 5, 35), (0, 10, 0, 20), (3, 7, 3, 7)], "a long, b long, c long, d long")
    got = df.select(fairness.chi2_yates(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).withColumn("p", fairness.chi2_p_value("x")).collect()
    n, ad_bc = 60, 10 * 35 - 10 * 5
    assert got[0].x == pytest.approx(n * (ad_bc - n / 2) ** 2 / (20 * 40 * 15 * 45))
    assert got[1].x == 0.0 and got[1].p == pytest.approx(1.0, abs=2e-7) and got[2].x == 0.0
    tail = spark.range(2000).select((F.col("id") / 40).alias("x")).withColumn("p", fairness.chi2_p_value("x")).collect()
    assert max(abs(r.p - math.erfc(math.sqrt(r.x / 2))) for r in tail) <= 1.5e-7


def test_feature_labels(spark):
    df = spark.createDataFrame([("pct_99213",), ("spec_Surgery",), ("dup_rate",), ("odd_one",)], "f string")
    assert [r[0] for r in df.select(explain.feature_label(F.col("f"))).collect()] == [
        "large share of code 99213", "membership of specialty Surgery", "elevated duplicate claim rate", "odd one"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("event_type"),
        (F.col("id") % 11).cast("double").alias("value"),
    )
    path = str(tmp_path / "in")
    rows.repartitionByRange(4, "ts").write.parquet(path)
    stream = streams.read_table_stream(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double")
    live = streams.run_once(streams.latest_states(stream), mode="update", keys=("user_id",))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, streams.latest_states(rows).collect()))
    alerts = streams.run_once(streams.daily_alerts(stream, 10.0))
    closed = streams.daily_alerts(rows, 10.0).where(F.col("day") < F.to_date(F.lit("2024-01-16")))
    assert sorted(map(tuple, alerts.collect())) == sorted(map(tuple, closed.collect()))
