import pytest

from auditlake.operators import quality, rollups, rules
from auditlake.params import Params

P = Params()


def flags(claims, rule):
    out = rules.rule_flags(claims, rollups.provider_day(claims), rollups.provider_dim(claims), P).where(f"rule = '{rule}'")
    return out.collect()


@pytest.mark.parametrize("minutes,hit", [((700, 739), 0), ((720, 720), 0), ((720, 721), 1), ((0,), 0)])
def test_impossible_day_is_strict(make_claims, minutes, hit):
    claims = make_claims([{"minutes": float(m), "patient_id": str(i)} for i, m in enumerate(minutes)])
    assert len(flags(claims, "impossible_day")) == hit


def test_impossible_day_text_and_exposure(make_claims):
    row = flags(make_claims([{"minutes": 1000.0, "amount": 10.1}, {"minutes": 600.0, "amount": 0.2}]), "impossible_day")[0]
    assert row.evidence == "Billed 1,600 service-minutes on 2024-01-02 across 2 claims (max 1 440 per day)"
    assert row.estimated_exposure == 10.3


@pytest.mark.parametrize("second,hit", [({}, 1), ({"patient_id": "B"}, 0), ({"service_date": "2024-01-03"}, 0), ({"fee_code": "99214"}, 0)])
def test_duplicates_need_the_whole_key(make_claims, second, hit):
    found = flags(make_claims([{"amount": 100.0}, {"amount": 90.0, **second}]), "duplicate_billing")
    assert len(found) == hit
    if hit:
        assert found[0].estimated_exposure == 100.0  # one first unit per group


def test_null_patient_is_no_duplicate_key(make_claims):
    assert flags(make_claims([{"patient_id": None}, {"patient_id": None}]), "duplicate_billing") == []


def test_unbundling_needs_all_components_and_clips_each_event(make_claims):
    both = [{"fee_code": "93005", "amount": 35.0}, {"fee_code": "93010", "amount": 45.0}]
    cheap = [{"fee_code": "93005", "amount": 5.0, "patient_id": "B"}, {"fee_code": "93010", "amount": 5.0, "patient_id": "B"}]
    alone = [{"fee_code": "93005", "patient_id": "C"}]
    found = flags(make_claims(both + cheap + alone), "unbundling")
    assert len(found) == 1
    assert found[0].estimated_exposure == 10.0
    assert found[0].evidence.startswith("Billed 2 patient-dates")


def test_empty_claims_keep_the_schema(make_claims):
    claims = make_claims([])
    out = rules.rule_flags(claims, rollups.provider_day(claims), rollups.provider_dim(claims), P)
    assert out.columns == list(rules.FLAG_COLUMNS) and out.count() == 0


def test_missing_column_is_named(make_claims):
    with pytest.raises(ValueError, match="Missing columns: \\['fee_code'\\]"):
        quality.validate_claims(make_claims([{}]).drop("fee_code"))


def test_partitioning_does_not_change_results(make_claims):
    claims = make_claims([
        {"provider_id": f"P{i % 3}", "minutes": 100.0 + i, "amount": 0.1 * i, "patient_id": str(i % 7)} for i in range(200)
    ])
    one, many = claims.coalesce(1), claims.repartition(13)
    a = rules.rule_flags(one, rollups.provider_day(one), rollups.provider_dim(one), P).collect()
    b = rules.rule_flags(many, rollups.provider_day(many), rollups.provider_dim(many), P).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
