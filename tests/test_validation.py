import json

import pytest
from pyspark.sql import functions as F

from claimweave.plans import features, validation
from claimweave.plans.features import Limits
from claimweave.vocabulary import REQUIRED_TYPES


def single(rows):
    return {r.claim_id: r for r in rows.collect()}


def amounts(hospital=None, pharmacy=None, receipt=None):
    return [
        (kind, {field: value})
        for kind, field, value in (
            ("HOSPITAL_INVOICE", "invoice_total", hospital), ("PHARMACY_INVOICE", "invoice_total", pharmacy), ("PAYMENT_RECEIPT", "amount_paid", receipt),
        )
        if value is not None
    ]


def extractions_of(make_extractions, per_claim):
    return make_extractions([
        (claim, f"{claim}-{i}", kind, response) for claim, docs in per_claim.items() for i, (kind, response) in enumerate(docs)
    ])


FINANCIAL = {
    # claim: (claimed, amounts, status, severity, start of the message)
    "exact": ("100.00", amounts("60", "40", "100"), "PASSED", "MEDIUM", "Claimed amount, invoice totals"),
    "on tolerance": ("101.00", amounts("60", "40", "99.00"), "PASSED", "MEDIUM", "Claimed amount, invoice totals"),
    "claim off": ("101.01", amounts("60", "40", "100"), "FAILED", "HIGH", "Claimed amount does not match"),
    "receipt off": ("100.00", amounts("100", None, "98.99"), "FAILED", "HIGH", "Payment receipt amount does not match"),
    "no hospital": ("100.00", amounts(None, "100", "100"), "WARNING", "MEDIUM", "Hospital invoice total"),
    "no receipt": ("100.00", amounts("$ 100", None, "n/a"), "WARNING", "MEDIUM", "Payment receipt amount could not"),
    "claim off before receipt": ("5", amounts("100"), "FAILED", "HIGH", "Claimed amount does not match"),
    "nothing": ("5", [], "WARNING", "MEDIUM", "Hospital invoice total"),
    "no claimed amount": (None, amounts("0.50", None, "0.50"), "PASSED", "MEDIUM", "Claimed amount, invoice totals"),
    "largest counts": ("100", amounts("100", None, "100") + amounts("20", None, "1"), "PASSED", "MEDIUM", "Claimed amount, invoice totals"),
}


def test_financial(make_claims, make_extractions):
    claims = make_claims([(c, "x", case[0]) for c, case in FINANCIAL.items()])
    found = single(validation.validate_financial(claims, extractions_of(make_extractions, {c: case[1] for c, case in FINANCIAL.items()})))
    for claim, (_, _, status, severity, message) in FINANCIAL.items():
        row = found[claim]
        assert (row.validation_status, row.severity, row.requires_review) == (status, severity, status != "PASSED"), claim
        assert row.validation_message.startswith(message), claim
    assert json.loads(found["nothing"].actual_value) == {"claimed_amount": 5, "supported_amount": 0, "claim_difference": 5, "receipt_difference": 0}


def named(*names):
    kinds = ("CLAIM_FORM", "PRESCRIPTION", "DIAGNOSTIC_REPORT")
    return [(kinds[i % 3], {"patient_name": name} if name is not None else {}) for i, name in enumerate(names)]


IDENTITY = {
    "same": ("Ann Lee", named("ANN LEE", "ann-lee."), "PASSED", "MEDIUM", 0, 0),
    "other": ("Ann Lee", named("Ann Lee", "Bob"), "FAILED", "HIGH", 0, 1),
    "missing": ("Ann Lee", named("Ann Lee", None), "WARNING", "MEDIUM", 1, 0),
    "blank is missing and different": ("Ann Lee", named("Ann Lee", "  "), "FAILED", "HIGH", 1, 1),
    "no documents": ("Ann Lee", [], "WARNING", "MEDIUM", 0, 0),
    "claim without name": (None, named("Ann", "Bob"), "PASSED", "MEDIUM", 0, 0),
    "other script": ("李", named("王", "張"), "PASSED", "MEDIUM", 0, 0),
}


def test_identity(make_claims, make_extractions):
    claims = make_claims([(c, case[0], None) for c, case in IDENTITY.items()])
    found = single(validation.validate_identity(claims, extractions_of(make_extractions, {c: case[1] for c, case in IDENTITY.items()})))
    for claim, (name, _, *expected) in IDENTITY.items():
        row = found[claim]
        assert [row.validation_status, row.severity, row.missing_names, row.name_mismatches] == expected, claim
        assert row.expected_value == name
    assert found["missing"].actual_value == "CLAIM_FORM: Ann Lee | PRESCRIPTION: NOT EXTRACTED"
    assert found["no documents"].actual_value == ""
    assert len(found["same"].source_documents) == 7


def stay(*dates, kinds=("CLAIM_FORM", "DISCHARGE_SUMMARY", "HOSPITAL_INVOICE")):
    return [(kinds[i], {"admission_date": a, "discharge_date": d}) for i, (a, d) in enumerate(dates)]


DATES = {
    "same day": (stay(("2024-01-05", "05-01-2024")), "PASSED", "INFO", "Admission and discharge dates are"),
    "no discharge": (stay(("2024-01-05", "later")), "WARNING", "MEDIUM", "Admission or discharge date is missing"),
    "admissions differ": (stay(("2024-01-05", "2024-01-06"), ("2024-01-04", "2024-01-07")), "FAILED", "HIGH", "Admission date is inconsistent"),
    "discharges differ": (stay(("2024-01-05", "2024-01-06"), ("05-01-2024", "2024-01-07")), "FAILED", "HIGH", "Discharge date is inconsistent"),
    "reversed": (stay(("2024-01-05", "2024-01-04")), "FAILED", "HIGH", "Admission date is later"),
    "other types do not count": ([("PRESCRIPTION", {"admission_date": "2024-01-05", "discharge_date": "2024-01-06"})], "WARNING", "MEDIUM", "Admission or discharge"),
    "other names": ([("CLAIM_FORM", {"date_of_admission": "2024-01-05", "admission_date": "?", "date_of_discharge": "2024-01-05"})], "PASSED", "INFO", "Admission and"),
    "nothing": ([], "WARNING", "MEDIUM", "Admission or discharge"),
}


def test_dates(make_claims, make_extractions):
    claims = make_claims([(c, "x", None) for c in DATES])
    found = single(validation.validate_dates(claims, extractions_of(make_extractions, {c: case[0] for c, case in DATES.items()})))
    for claim, (_, status, severity, message) in DATES.items():
        assert (found[claim].validation_status, found[claim].severity) == (status, severity), claim
        assert found[claim].validation_message.startswith(message), claim
    empty = json.loads(found["nothing"].actual_value)
    assert len(empty) == 8 and empty["minimum_admission_date"] is None and empty["admission_date_count"] == 0


def bought(prescribed, purchased):
    return [("PRESCRIPTION", {"medicines": {"medicine_name": prescribed}}), ("PHARMACY_INVOICE", {"medicine_items": {"medicine_name": purchased}})]


MEDICINES = {
    "contained": (bought(["Amoxicillin 500"], ["amoxicillin", "AMOXICILLIN-500 mg"]), "PASSED", 1, 2, []),
    "unmatched": (bought(["Zyrtec"], ["Zyrtec", "Advil", "ADVIL"]), "FAILED", 1, 2, ["ADVIL", "Advil"]),
    "only prescribed is fine": (bought(["a", "b"], ["a"]), "PASSED", 2, 1, []),
    "no prescription": (bought([], ["a"]), "WARNING", 0, 1, ["a"]),
    "no pharmacy": (bought(["a"], [None]), "WARNING", 1, 0, []),
    "neither": ([], "WARNING", 0, 0, []),
    "empty name matches all": (bought(["..."], ["anything"]), "PASSED", 1, 1, []),
    "scalar is no list": (bought("a", ["a"]), "WARNING", 0, 1, ["a"]),
    "numbers are text": (bought([12.5], ["12.5"]), "PASSED", 1, 1, []),
}


@pytest.mark.parametrize("limits", [Limits(), Limits(pairs=0), Limits(pairs=0, hot_rows=1)])
def test_medicines(make_claims, make_extractions, limits):
    claims = make_claims([(c, "x", None) for c in MEDICINES])
    rows = extractions_of(make_extractions, {c: case[0] for c, case in MEDICINES.items()})
    found = single(validation.validate_medicines(claims, rows, limits))
    for claim, (_, status, prescribed, purchased, unmatched) in MEDICINES.items():
        row = found[claim]
        assert (row.validation_status, row.prescribed_count, row.purchased_count, row.unmatched_count) == (status, prescribed, purchased, len(unmatched)), claim
        assert row.unmatched_items == unmatched, claim


def test_required_documents(make_claims, make_documents):
    claims = make_claims([("all", "x", None), ("some", "x", None), ("none", "x", None)])
    docs = [("all", kind, "EXTRACTED") for kind in REQUIRED_TYPES] + [("some", "CLAIM_FORM", "EXTRACTED"), ("some", "PRESCRIPTION", "FAILED"), ("some", "OTHER", "EXTRACTED")]
    found = single(validation.validate_required_documents(claims, make_documents(docs)))
    assert (found["all"].validation_status, found["all"].severity, found["all"].actual_value) == ("PASSED", "INFO", "[]")
    assert found["some"].source_documents == ["DISCHARGE_SUMMARY", "HOSPITAL_INVOICE", "PAYMENT_RECEIPT", "PRESCRIPTION"]
    assert found["none"].validation_status == "FAILED" and len(json.loads(found["none"].actual_value)) == 5


@pytest.fixture(scope="module")
def everything(make_claims, make_documents, make_extractions):
    """All cases above as claims of one table, plus a claim with very many documents."""
    claims, docs = [], {}
    for prefix, cases, at in (("F", FINANCIAL, 1), ("I", IDENTITY, 1), ("D", DATES, 0), ("M", MEDICINES, 0)):
        for name, case in cases.items():
            claim = f"{prefix}:{name}"
            claims.append((claim, case[0] if prefix == "I" else "x", case[0] if prefix == "F" else "10"))
            docs[claim] = case[at]
    claims.append(("hot", "Ann", "1"))
    docs["hot"] = named(*["Ann", "Bob", None] * 100) + bought([f"m{i}" for i in range(0, 40, 2)], [f"M{i} forte" for i in range(40)]) * 5
    registered = [(claim, kind, "EXTRACTED") for claim, rows in docs.items() for kind, _ in rows]
    return make_claims(claims), make_documents(registered), extractions_of(make_extractions, docs)


def comparable(rows):
    return sorted(map(str, rows.collect()))


def test_wide_claims_give_the_same_results(everything):
    plain = validation.validate_claims(*everything)
    for limits in (Limits(pairs=0), Limits(pairs=0, hot_rows=10), Limits(hot_rows=10)):
        assert comparable(validation.validate_claims(*everything, limits=limits)) == comparable(plain), limits
        claims, _, extractions = everything
        for check in (validation.validate_identity, validation.validate_medicines):
            assert comparable(check(claims, extractions, limits)) == comparable(check(claims, extractions)), (check, limits)
    hot = plain.filter("claim_id = 'hot' AND validation_category = 'IDENTITY'").first()
    assert hot.actual_value.count("CLAIM_FORM: ") + hot.actual_value.count(": ") > 300 and hot.validation_status == "FAILED"


def test_evidence_holds_what_listings_hold(everything):
    claims, documents, extractions = everything
    fields = features.stored_fields(extractions)
    evidence = features.claim_evidence(fields)
    assert evidence.filter("claim_id = 'hot' AND kind = 'NAME'").count() == 310
    listed = features.document_features(claims, fields).filter("claim_id = 'hot'").first()
    assert sorted(r.item for r in evidence.filter("claim_id = 'hot' AND kind = 'PURCHASED'").collect()) == listed.purchased_items


def test_one_claim_at_a_time_gives_the_same(everything):
    claims, documents, extractions = everything
    together = validation.validate_claims(claims, documents, extractions)
    for claim in ("F:claim off", "hot"):
        asked = claims.select("claim_id").filter(F.col("claim_id") == claim)
        own = validation.validate_requested(asked, claims, documents.withColumn("relative_path", F.uuid()), extractions)
        assert comparable(own) == comparable(together.filter(F.col("claim_id") == claim))


def test_consolidation(spark, everything):
    results = validation.validate_claims(*everything)
    summary = {r.claim_id: r for r in validation.validation_summary(results).collect()}
    decided = {r.claim_id: r for r in results.filter("validation_category = 'CLAIM_DECISION'").collect()}
    assert all(json.loads(decided[c].actual_value)["recommendation"] == summary[c].recommendation for c in decided)
    assert all(r.total_validations == 5 and r.quality_validation is None for r in summary.values())

    def recommend(medical, financial, other, warnings):
        row = spark.createDataFrame([(medical, financial, other, warnings)], "a int, b int, c int, d int")
        return row.select(validation.recommendation(*[F.col(c) for c in "abcd"])).first()[0]

    assert recommend(1, 1, 1, 1) == "MEDICAL_REVIEW_REQUIRED"
    assert recommend(0, 1, 1, 1) == "FINANCIAL_REVIEW_REQUIRED"
    assert recommend(0, 0, 1, 1) == "MORE_INFORMATION_REQUIRED"
    assert recommend(0, 0, 0, 1) == "MANUAL_REVIEW_REQUIRED"
    assert recommend(0, 0, 0, 0) == "READY_FOR_APPROVAL"
    asked = spark.createDataFrame([("hot",), ("unknown",)], "claim_id string")
    answers = {r.claim_id: r for r in validation.validation_requests(asked, validation.consolidate_claims(results)).collect()}
    assert (answers["hot"].request_status, answers["unknown"].request_status) == ("SUCCESS", "FAILED")
