import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from claimweave import schema
from claimweave.operators.extraction import split_envelope
from claimweave.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("claimweave-tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_extractions(spark):
    """Extraction rows from (claim, document, type, response, status, day) tuples; later entries are optional."""

    def make(rows):
        full = []
        for number, (claim, document, kind, response, *rest) in enumerate(rows):
            status, day = (list(rest) + ["EXTRACTED", 1][len(rest):])[:2]
            error = None if status == "EXTRACTED" else "failed"
            payload = json.dumps({"response": response, "scoring": None, "error": error})
            full.append((f"x{number:04}", document, claim, kind, f"{kind}_V1", f"f/{document}", payload, f"2024-01-{day:02} 00:00:00"))
        names = "extraction_id string, document_id string, claim_id string, document_type string, template_id string, relative_path string, payload string, at string"
        frame = spark.createDataFrame(full, names)
        split = split_envelope(frame).selectExpr("*", "CAST(at AS TIMESTAMP_NTZ) AS extracted_at")
        return split.select(*schema.DOCUMENT_EXTRACTIONS.names)

    return make


@pytest.fixture(scope="session")
def make_claims(spark):
    def make(rows):
        names = "claim_id string, patient_name string, claimed_amount string"
        return spark.createDataFrame(rows, names).selectExpr("claim_id", "patient_name", "CAST(claimed_amount AS DECIMAL(18,2)) AS claimed_amount")

    return make


@pytest.fixture(scope="session")
def make_documents(spark):
    def make(rows):
        return spark.createDataFrame(rows, "claim_id string, document_type string, processing_status string")

    return make
