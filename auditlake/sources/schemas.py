"""Declared schemas. Ids and codes are text: leading zeros matter, so nothing is inferred."""

from __future__ import annotations

CLAIMS = (
    "claim_id string, provider_id string, provider_name string, specialty string, "
    "patient_id string, service_date date, fee_code string, fee_description string, "
    "service_minutes double, units int, amount_billed double, modifier string, clinic_id string"
)
RAW_CLAIMS = (
    "claim_id string, provider_id string, provider_name string, specialty string, "
    "patient_id string, service_date string, fee_code string, fee_description string, "
    "service_minutes string, units string, amount_billed string, modifier string, clinic_id string"
)
FEE_SCHEDULE = "fee_code string, description string, amount double, tier int, minutes int"
FEE_META = (
    "source string, description string, version string, effective_date string, authoritative boolean, "
    "n_codes int"
)
GROUND_TRUTH = (
    "all_bad_actors array<string>, clean_providers map<string, struct<description: string, type: string>>, "
    "schemes map<string, array<string>>"
)
DISPOSITIONS = "seq long, provider_id string, outcome string, notes string, source string"
RULE_FLAGS = (
    "provider_id string, provider_name string, specialty string, rule string, evidence string, "
    "estimated_exposure double"
)
ML_SCORES = (
    "provider_id string, provider_name string, specialty string, ml_score double, ml_is_anomaly int, "
    "vote_count int, if_score double, if_flag int, lof_score double, lof_flag int, "
    "ocsvm_score double, ocsvm_flag int"
)
FEEDBACK_SCORES = "provider_id string, feedback_score double, feedback_prob double, feedback_label int"
