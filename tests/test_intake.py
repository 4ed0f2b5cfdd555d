import pytest
from pyspark.sql import functions as F

from claimweave.operators import intake
from claimweave.vocabulary import DOCUMENT_TYPES

CASES = {
    "claim_form.pdf": "CLAIM_FORM",
    "CLAIM_information.pdf": "CLAIM_FORM",
    "Prescription.PNG": "PRESCRIPTION",
    "hospital_discharge_summary.pdf": "DISCHARGE_SUMMARY",
    "hospital_bill.pdf": "HOSPITAL_INVOICE",
    "pharmacy_receipt.jpg": "PHARMACY_INVOICE",
    "label_results.pdf": "DIAGNOSTIC_REPORT",
    "latest_report.pdf": "DIAGNOSTIC_REPORT",
    "payment_bill.pdf": "PAYMENT_RECEIPT",
    "receipt.pdf": "PAYMENT_RECEIPT",
    "hospital_pharmacy_invoice.pdf": "HOSPITAL_INVOICE",
    "pharmacy.pdf": "OTHER",
    "notes.pdf": "OTHER",
    "": "OTHER",
}


def test_classifier_takes_the_first_rule_that_matches(spark):
    frame = spark.createDataFrame([(n,) for n in CASES], "file_name string")
    found = {r.file_name: r for r in intake.classify_documents(frame).collect()}
    assert {name: found[name].document_type for name in CASES} == CASES
    for row in found.values():
        assert row.template_id == (f"{row.document_type}_V1" if row.document_type in DOCUMENT_TYPES else None)


@pytest.fixture(scope="module")
def changes(spark):
    rows = [
        ("A_B/claim_form.txt", "INSERT"), ("A_B/z_claim_form.pdf", "INSERT"), ("AxB/claim_form.pdf", "INSERT"),
        ("AxB/sub/deep.JPG", "INSERT"), ("root.pdf", "INSERT"), ("gone/claim_form.pdf", "DELETE"), ("txt/notes.txt", "INSERT"),
    ]
    return spark.createDataFrame(rows, "relative_path string, action string").withColumn("modified_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_claim_form_needs_no_extension(changes):
    found = {r.folder: r.form_path for r in intake.find_claim_forms(changes).collect()}
    assert found == {"A_B": "A_B/claim_form.txt", "AxB": "AxB/claim_form.pdf", "gone": "gone/claim_form.pdf"}


def test_new_folders(changes):
    assert sorted(r.folder for r in intake.new_folders(changes).collect()) == ["A_B", "AxB"]


def test_reload_takes_exactly_the_touched_folders(spark, changes):
    touched = spark.createDataFrame([("A_B",)], "folder string")
    assert sorted(r.relative_path for r in intake.folders_to_reload(changes, touched).collect()) == ["A_B/claim_form.txt", "A_B/z_claim_form.pdf"]


def test_listing_and_pending(spark, changes):
    assert "gone/claim_form.pdf" not in {r.relative_path for r in intake.current_listing(changes).collect()}
    done = spark.createDataFrame([("root.pdf",), ("A_B/claim_form.txt",)], "relative_path string")
    assert intake.pending_files(changes, done).count() == 4


def test_submission_reasons(spark):
    subs = spark.createDataFrame(
        [(1, " ", "r"), (2, "n", "\t"), (3, "n", "r"), (4, "n", "r"), (5, "Ann Lee", "ref #7"), (6, None, None)],
        "submission_id long, patient_name string, claim_reference string",
    )
    files = spark.createDataFrame([(4, "notes.pdf"), (5, "Claim-FORM.pdf"), (5, "x.pdf")], "submission_id long, file_name string")
    found = {r.submission_id: r for r in intake.check_submissions(subs, files).collect()}
    assert [found[i].reason for i in range(1, 7)] == [
        "Enter the patient name.", "Enter the claim reference.", "Upload at least one document.",
        "A claim form is required before submission.", None, "Enter the patient name.",
    ]
    assert (found[5].folder, found[5].file_count) == ("Ann_Lee_ref_7", 2)
