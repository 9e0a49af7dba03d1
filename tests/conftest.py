import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "auditlake-tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-tests-"))
    yield session
    session.stop()


CLAIM_SCHEMA = (
    "claim_id string, provider_id string, provider_name string, specialty string, patient_id string, "
    "service_date date, fee_code string, service_minutes double, units int, amount_billed double, "
    "modifier string, clinic_id string"
)


@pytest.fixture(scope="session")
def make_claims(spark):
    """Claims from short dicts; everything not given gets a harmless default."""
    import datetime

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            pid = r.get("provider_id", "P1")
            day = r.get("service_date", "2024-01-02")
            full.append((
                r.get("claim_id", f"C{i:05d}"), pid, f"Dr {pid}", r.get("specialty", "Cardiology"),
                r.get("patient_id", "A"), datetime.date.fromisoformat(day) if day else None, r.get("fee_code", "99213"),
                r.get("minutes", 10.0), r.get("units", 1), r.get("amount", 100.0), r.get("modifier", ""),
                r.get("clinic_id", "CL1"),
            ))
        return spark.createDataFrame(full, CLAIM_SCHEMA)

    return make
