"""Every threshold, code set and key list of the engine, in one frozen object.

The defaults are the published audit thresholds.  Other data sets pass other values; operators
never hold a number of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BundleRule:
    """Component codes that must be billed as one bundle code at one price."""

    components: tuple[str, ...]
    bundle_code: str
    bundle_desc: str
    bundle_amt: float


# ---- fixed values: code groups, thresholds and weights the results depend on ----
OFFICE_VISIT_CODES = ("99202", "99203", "99204", "99205", "99211", "99212", "99213", "99214", "99215")
OFFICE_VISIT_TOP_CODES = ("99204", "99205", "99215")
THERAPY_CODES = ("90832", "90834", "90837")
HIGH_VALUE_IMAGING_CODES = ("70553", "71250", "72148", "73721", "74177")
UNIT_BILLABLE_CODES = ("17003", "67028", "96372", "96413", "96415")
FINGERPRINT_CODES = (
    "99213", "99214", "99215", "99232", "93000", "93005", "93010", "72148",
    "70553", "90837", "90834", "11100", "11101", "27447", "43239",
)
PEER_TOP_CODES = {
    "Family Medicine": ("99204", "99215"),
    "Cardiology": ("93306", "93350", "93458", "99215"),
    "Radiology": ("70553", "71250", "72148", "73721", "74177"),
    "Psychiatry": ("90791", "90837"),
    "Dermatology": ("11100", "17000"),
    "Surgery": ("27447", "43239"),
    "Internal Medicine": ("99215", "99233"),
    "Orthopedic Surgery": ("27447", "29881"),
    "General Surgery": ("43239", "45380", "47562", "49505"),
    "Gastroenterology": ("43235", "43239", "45378", "91110"),
    "Ophthalmology": ("66984", "67028"),
    "OB/GYN": ("57454", "59400"),
    "Neurology": ("64483", "95816", "95910"),
    "Emergency Medicine": ("99284", "99285"),
    "Endocrinology": ("99215",),
    "Pulmonology": ("31628",),
}
MODEL_TOP_CODES = {
    "Family Medicine": ("99215",),
    "Cardiology": ("99215",),
    "Radiology": ("70553",),
    "Psychiatry": ("90837",),
    "Dermatology": ("11100",),
    "Surgery": ("27447", "43239"),
}
ECG_BUNDLE = BundleRule(("93005", "93010"), "93000", "ECG Complete", 70.0)
RULE_POINTS = {"impossible_day": 40.0, "duplicate_billing": 35.0, "unbundling": 30.0}
RECOVERY_LIKELIHOOD = {"HIGH": 0.70, "MEDIUM": 0.40, "LOW": 0.15}
PEER_METRICS = ("avg_billed", "claims_per_day", "top_tier_share", "services_per_patient", "avg_minutes")
# ---- end of fixed values ----


@dataclass(frozen=True)
class Params:
    # rules
    max_day_minutes: float = 1440.0
    duplicate_keys: tuple[str, ...] = ("provider_id", "patient_id", "fee_code", "service_date")
    bundle_keys: tuple[str, ...] = ("provider_id", "patient_id", "service_date")
    bundle_rules: tuple[BundleRule, ...] = (ECG_BUNDLE,)

    # peer cohorts
    peer_top_codes: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PEER_TOP_CODES))
    working_days: int = 261
    part_time_below: float = 0.40
    min_cohort: int = 5
    z_threshold: float = 3.5
    z_overrides: dict[tuple[str, str], float] = field(
        default_factory=lambda: {("Radiology", "claims_per_day"): 65.0}
    )

    # code mix
    kl_above: float = 0.10
    cosine_above: float = 0.15
    kl_epsilon: float = 1e-9

    # temporal
    min_active_months: int = 3
    cusum_at: float = 3.0
    spike_at: float = 3.5

    # anomaly ensemble
    model_top_codes: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(MODEL_TOP_CODES))
    fingerprint_codes: tuple[str, ...] = FINGERPRINT_CODES
    #: specialties with a column of their own in the model; None takes those of the data, the most frequent
    #: ``max_specialties`` of them.  All others share the column "other".
    specialties: tuple[str, ...] | None = None
    max_specialties: int = 64
    contamination: float = 0.10
    forest_trees: int = 300
    forest_sample: int = 256
    lof_neighbours: int = 20
    #: one-class SVM: random features, steps at most, and the share of |w|^2 that the objective may miss the optimum by
    svm_features: int = 128
    svm_steps: int = 60
    svm_tolerance: float = 0.01
    weight_forest: float = 0.50
    weight_lof: float = 0.30
    weight_svm: float = 0.20
    votes_needed: int = 2
    funnel_points: float = 5.0
    seed: int = 42

    # scoring
    rule_points: dict[str, float] = field(default_factory=lambda: dict(RULE_POINTS))
    rule_points_other: float = 25.0
    rules_cap: float = 50.0
    peer_cap: float = 25.0
    ml_cap: float = 15.0
    codemix_cap: float = 10.0
    temporal_cap: float = 5.0
    feedback_cap: float = 10.0
    worklist_from: float = 10.0
    fallback_exposure_share: float = 0.10
    likelihood: dict[str, float] = field(default_factory=lambda: dict(RECOVERY_LIKELIHOOD))

    # feedback
    min_labels: int = 6
    #: labelled rows that the boosted trees are fitted on, at most; the logistic model takes all
    feedback_rows: int = 200_000
    feedback_trees: int = 100
    feedback_depth: int = 3
    feedback_rate: float = 0.1
    feedback_ridge: float = 1.0
    #: Newton steps at most, and the gradient a row at which they end
    feedback_steps: int = 100
    feedback_tolerance: float = 1e-9

    # evidence miner
    office_codes: tuple[str, ...] = OFFICE_VISIT_CODES
    office_top_codes: tuple[str, ...] = OFFICE_VISIT_TOP_CODES
    therapy_codes: tuple[str, ...] = THERAPY_CODES
    therapy_long_code: str = "90837"
    therapy_price_gap: float = 40.0
    imaging_codes: tuple[str, ...] = HIGH_VALUE_IMAGING_CODES
    imaging_specialty: str = "Radiology"
    unit_codes: tuple[str, ...] = UNIT_BILLABLE_CODES
    min_visits: int = 25
    upcode_share: float = 0.45
    upcode_delta: float = 0.20
    therapy_share: float = 0.70
    therapy_delta: float = 0.25
    evidence_duplicate_keys: tuple[str, ...] = (
        "provider_id", "patient_id", "fee_code", "service_date", "units",
    )
    min_duplicate_events: int = 3
    volume_multiple: float = 3.0
    volume_floor: float = 8.0
    min_imaging: int = 10
    modifier: str = "25"
    min_modifier: int = 15
    unit_multiple: float = 2.5
    min_unit_claims: int = 10
    min_half_visits: int = 20
    escalation_rise: float = 0.30
    escalation_late: float = 0.50
    min_weekend: int = 20

    # statutory recovery
    recovery_months: int = 24
    lookback_years: int = 5
    high_value: float = 50_000.0

    # fairness
    min_group: int = 5
    alert_p: float = 0.05
    alert_chi2: float = 3.841458820694124

    # privacy
    epsilon: float = 1.0
    min_sensitivity: float = 1e-3

    # cases
    ack_days: int = 14
