import datetime
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from claimweave.functions import errors
from claimweave.operators.extraction import extract_documents
from claimweave.operators.intake import classify_documents, list_documents
from claimweave.sources import listing, templates
from claimweave.sources.files import read_contents, stream_files
from claimweave.sources.tables import ClaimTables
from claimweave.operators.runs import run_history
from claimweave.streaming.process import ClaimProcessor, process_directory, process_new_claims, record_decisions


def put(root, folder, **files):
    (root / folder).mkdir(parents=True, exist_ok=True)
    for name, response in files.items():
        (root / folder / f"{name}.pdf").write_text(json.dumps(response))


@pytest.fixture
def stage(spark, tmp_path):
    root = tmp_path / "stage"
    root.mkdir()
    resolved = templates.resolve_templates(templates.builtin_templates(spark))
    tables = ClaimTables(spark, str(tmp_path / "tables"), buckets=4)

    def read_json(content, response_format):
        return {"response": json.loads(bytes(content)), "scoring": None, "error": None}

    def read_payloads(files):
        typed = classify_documents(list_documents(files)).select("relative_path", "template_id")
        contents = read_contents(files, str(root)).join(typed, "relative_path")
        return extract_documents(contents, resolved, "relative_path", "content", read_json)

    processor = ClaimProcessor(tables, read_payloads)

    def run():
        stream = listing.stream_directory(spark, str(root))
        process_new_claims(stream, processor, str(tmp_path / "checkpoint")).awaitTermination()

    return root, tables, processor, run


def statuses(tables):
    return {r.claim_id: r.claim_status for r in tables.read("claims").collect()}


def test_two_waves(spark, stage):
    root, tables, processor, run = stage
    put(root, "a", claim_form={"claim_id": "A", "patient_name": "Ann", "claimed_amount": "10"}, hospital_bill={"patient_name": "ann", "invoice_total": "10"})
    put(root, "b", receipt={"amount_paid": "5"})
    run()
    assert statuses(tables) == {"A": "MORE_INFORMATION_REQUIRED"}
    assert {r.folder: r.message for r in tables.read("run_log").collect()} == {"a": None, "b": "claim_form.pdf was not found."}
    first_results = tables.read("results").filter("claim_id = 'A'").collect()
    assert len(first_results) == 6
    first_ids = {r.relative_path: r.document_id for r in tables.read("documents").collect()}

    run()  # nothing new: no run is logged
    assert tables.read("run_log").count() == 2

    decisions = spark.createDataFrame([("A", "APPROVED", "fine", datetime.datetime(2024, 1, 1))], "claim_id string, decision string, comments string, decided_at timestamp_ntz")
    assert record_decisions(tables, decisions).first().reason is None
    assert statuses(tables) == {"A": "APPROVED"}

    # The form completes folder b; folder a is not touched and keeps its decision.
    put(root, "b", claim_form={"claim_id": "B", "patient_name": "Bob"})
    run()
    assert statuses(tables) == {"A": "APPROVED", "B": "MORE_INFORMATION_REQUIRED"}
    assert {r.relative_path for r in tables.read("documents").filter("claim_id = 'B'").collect()} == {"b/claim_form.pdf", "b/receipt.pdf"}
    assert sorted(map(str, tables.read("results").filter("claim_id = 'A'").collect())) == sorted(map(str, first_results))

    # A new file in folder a reloads all of it and takes the decision back.
    put(root, "a", prescription={"patient_name": "Eve"})
    run()
    claim = tables.read("claims").filter("claim_id = 'A'").first()
    assert (claim.claim_status, claim.reviewer_decision) == ("MORE_INFORMATION_REQUIRED", None)
    assert tables.read("extractions").filter("claim_id = 'A'").count() == 3
    identity = tables.read("results").filter("claim_id = 'A' AND validation_category = 'IDENTITY'").first()
    assert identity.validation_status == "FAILED"
    kept = {r.relative_path: r.document_id for r in tables.read("documents").collect()}
    assert all(kept[path] == document_id for path, document_id in first_ids.items())
    assert [r.folders_failed for r in processor.summaries().orderBy("run_id").collect()] == [1, 0, 0]


def test_replay_gives_the_same_tables(spark, stage):
    root, tables, processor, _ = stage
    put(root, "a", claim_form={"claim_id": "A", "patient_name": "Ann"}, receipt={"amount_paid": "1"})
    changes = listing.read_directory(spark, str(root))
    processor(changes, 0)

    def state():
        names = ("claims", "documents", "results", "extractions", "evidence", "claim_folders", "files")
        return {name: sorted(map(str, tables.read(name).collect())) for name in names}

    before = state()
    processor(changes, 0)
    assert state() == before and tables.read("extractions").count() == 2


def test_deleted_files_and_retry(spark, stage):
    root, tables, processor, _ = stage
    put(root, "a", claim_form={"claim_id": "A"}, receipt={"amount_paid": "1"}, prescription={"patient_name": "x"})
    put(root, "late", receipt={"amount_paid": "2"})
    processor(listing.read_directory(spark, str(root)), 0)
    later = F.lit("2100-01-01").cast("timestamp_ntz")
    changes = spark.createDataFrame([("a/prescription.pdf", "DELETE"), ("a/receipt.pdf", "INSERT")], "relative_path string, action string")
    processor(changes.withColumn("modified_at", later).withColumn("size", F.lit(1).cast("long")), 1)
    newest = tables.read("run_log").filter("run > 1000000 AND folder = 'a'")
    assert newest.count() == 1 and tables.read("files").filter("action = 'DELETE'").count() == 1
    assert {r.document_type for r in tables.read("extractions").collect()} == {"CLAIM_FORM", "PAYMENT_RECEIPT"}

    put(root, "late", claim_form={"claim_id": "L"})
    again = ClaimProcessor(tables, processor.read_payloads, retry_failed=True)
    form = listing.read_directory(spark, str(root)).filter("relative_path = 'late/claim_form.pdf'")
    again(form, 2)
    assert "L" in statuses(tables)


def test_change_log_source(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"relative_path":"a/x.pdf","modified_at":"2024-01-01T00:00:00","size":1,"action":"INSERT"}\n')
    seen = []
    stream = listing.stream_change_log(spark, str(log)).writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.relative_path, r.action) for r in seen] == [("a/x.pdf", "INSERT")]


def decide(spark, tables, claim, decision, comments="seen"):
    row = [(claim, decision, comments, datetime.datetime(2024, 1, 1))]
    return record_decisions(tables, spark.createDataFrame(row, "claim_id string, decision string, comments string, decided_at timestamp_ntz"))


def test_a_document_that_moves_to_another_claim(spark, stage):
    root, tables, processor, _ = stage
    put(root, "a", claim_form={"claim_id": "A", "patient_name": "Ann"}, receipt={"amount_paid": "1"})
    process_directory(processor, str(root))
    assert {r.claim_id for r in tables.read("documents").collect()} == {"A"}
    time.sleep(1.1)
    put(root, "a", claim_form={"claim_id": "B", "patient_name": "Ann, corrected"})  # the same name again
    process_directory(processor, str(root))
    for buckets in (None, tables.buckets_of(spark.createDataFrame([("a",)], "folder string"), "folder")):
        assert {r.claim_id for r in tables.read("documents", buckets=buckets).collect()} == {"B"}
        assert {r.claim_id for r in tables.read("extractions", buckets=buckets).collect()} == {"B"}
    identity = tables.read("results").filter("claim_id = 'B' AND validation_category = 'IDENTITY'").first()
    assert identity.expected_value == "Ann, corrected"
    process_directory(processor, str(root))
    assert processor.history().filter("return_value = 'no new files'").count() == 1


def test_decisions_of_several_writers(spark, stage):
    root, tables, processor, _ = stage
    for claim in ("A", "B"):
        put(root, claim.lower(), claim_form={"claim_id": claim, "patient_name": "Ann"})
    processor(listing.read_directory(spark, str(root)), 0)
    decide(spark, tables, "A", "APPROVED")
    decide(spark, tables, "B", "REJECTED")
    assert statuses(tables) == {"A": "APPROVED", "B": "REJECTED"}

    class Slow(ClaimTables):
        """A reviewer decides while a batch is between reading and writing claims."""

        def write(self, name, rows, run, observed=None):
            if name == "results":
                decide(spark, tables, "A", "REJECTED", "meanwhile")
            return super().write(name, rows, run, observed)

    form = listing.read_directory(spark, str(root)).filter("relative_path = 'a/claim_form.pdf'")
    ClaimProcessor(Slow(spark, tables.root, buckets=4), processor.read_payloads)(form, 1)
    claim = tables.read("claims").filter("claim_id = 'A'").first()
    assert (claim.claim_status, claim.reviewer_comments) == ("REJECTED", "meanwhile") and statuses(tables)["B"] == "REJECTED"


def test_a_folder_that_cannot_be_read(spark, stage):
    root, tables, processor, _ = stage
    for claim in ("A", "B", "C", "D"):
        put(root, claim.lower(), claim_form={"claim_id": claim, "patient_name": "Ann"})
    processor(listing.read_directory(spark, str(root)), 0)

    def refuse(files):
        bad = F.when(F.element_at(F.split("relative_path", "/"), 1).isin("b", "d"), "PermissionError: not yours")
        return processor.read_payloads(files).withColumn("read_error", bad)

    later = listing.read_directory(spark, str(root)).withColumn("modified_at", F.lit("2100-01-01").cast("timestamp_ntz"))
    ClaimProcessor(tables, refuse)(later, 1)
    assert {c: s == "EXTRACTION_FAILED" for c, s in statuses(tables).items()} == {"A": False, "B": True, "C": False, "D": True}
    assert tables.read("claims").filter("claim_id = 'B'").first().reviewer_comments == "Folder processing error: PermissionError: not yours"
    summary = processor.summaries().orderBy(F.desc("run_id")).first()
    assert (summary.folders_processed, summary.folders_failed, summary.last_error) == (2, 2, "PermissionError: not yours")
    processor.retry()
    assert not [c for c, s in statuses(tables).items() if s == "EXTRACTION_FAILED"]
    shown = [(r.state, r.return_value) for r in run_history(processor.history(), F.current_timestamp().cast("timestamp_ntz")).collect()]
    assert shown == [
        ("SUCCEEDED", "SUCCESS: 2 folders processed, 0 failed"), ("SUCCEEDED", "COMPLETED_WITH_ERRORS: 2 folders processed, 2 failed"),
        ("SUCCEEDED", "SUCCESS: 4 folders processed, 0 failed"),
    ]


def test_an_outage_fails_the_run_marks_nothing_and_is_replayed(spark, stage, tmp_path):
    """A service that is down meets every file: the extractor finds out on the executors."""
    root, tables, processor, _ = stage
    for claim in ("A", "B", "C", "D"):
        put(root, claim.lower(), claim_form={"claim_id": claim, "patient_name": "Ann"})
    down, calls = tmp_path / "down", []
    resolved = templates.resolve_templates(templates.builtin_templates(spark))

    def ask_service(content, response_format):
        if down.exists():
            raise ConnectionError("model service down")
        return {"response": json.loads(bytes(content)), "scoring": None, "error": None}

    def read(files):
        calls.append(1)
        typed = classify_documents(list_documents(files)).select("relative_path", "template_id")
        contents = read_contents(files, str(root)).join(typed, "relative_path")
        return extract_documents(contents, resolved, "relative_path", "content", ask_service)

    by_service = ClaimProcessor(tables, read)

    def run():
        changes = stream_files(spark, str(root), str(tmp_path / "state"), parts=3)
        process_new_claims(changes, by_service, str(tmp_path / "checkpoint-service")).awaitTermination()

    run()
    before = {name: sorted(map(str, tables.read(name).collect())) for name in ("claims", "results", "documents", "run_log")}
    assert set(statuses(tables)) == {"A", "B", "C", "D"} and "EXTRACTION_FAILED" not in statuses(tables).values()

    time.sleep(0.01)
    down.touch()
    for claim in ("A", "B", "C", "D"):
        put(root, claim.lower(), claim_form={"claim_id": claim, "patient_name": "Ann, corrected"})
    for _ in range(2):
        calls.clear()
        with pytest.raises(Exception, match="model service down"):
            run()
        assert len(calls) == 1  # no search for a folder to blame
    assert {name: sorted(map(str, tables.read(name).collect())) for name in before} == before
    last = processor.history().orderBy(F.desc("run_id")).first()
    assert last.state == "FAILED" and "model service down" in last.error_message

    down.unlink()
    run()
    assert {r.patient_name for r in tables.read("claims").collect()} == {"Ann, corrected"}
    assert processor.history().orderBy(F.desc("run_id")).first().state == "SUCCEEDED"


def test_a_reader_that_raises_fails_the_run(spark, stage):
    root, tables, _, _ = stage
    put(root, "a", claim_form={"claim_id": "A"})

    def at_fault(files):
        raise RuntimeError("no such service")

    with pytest.raises(RuntimeError, match="no such service"):
        ClaimProcessor(tables, at_fault)(listing.read_directory(spark, str(root)), 0)
    assert statuses(tables) == {} and tables.read("run_log").isEmpty()


def test_errors_about_a_file_and_others():
    about_a_file = [FileNotFoundError("x"), PermissionError("x"), ValueError("x"), KeyError("x"), UnicodeDecodeError("utf-8", b"", 0, 1, "x"), RuntimeError("x")]
    others = [ConnectionResetError("x"), TimeoutError("x"), OSError(28, "no space left"), MemoryError(), errors.ServiceUnavailable("x")]
    assert not any(map(errors.is_outage, about_a_file)) and all(map(errors.is_outage, others))


def document_check(tables, claim):
    row = tables.read("results").filter(f"claim_id = '{claim}' AND validation_category = 'DOCUMENT'").first()
    return str((row.validation_status, row.actual_value, row.validation_message))


def test_documents_whose_file_has_gone(spark, stage):
    """The form sent again, a deletion alone, a file that comes back, and a folder that loses everything."""
    root, tables, processor, _ = stage
    whole = dict(claim_form={"claim_id": "A", "patient_name": "Ann"}, prescription={"patient_name": "Ann"}, receipt={"amount_paid": "1"})
    put(root, "a", **whole)
    put(root, "b", claim_form={"claim_id": "B"}, prescription={"patient_name": "Bob"})
    process_directory(processor, str(root))
    with_prescription = document_check(tables, "A")
    others = sorted(map(str, tables.read("documents").filter("claim_id = 'B'").collect()))

    def names():
        return {r.file_name for r in tables.read("documents").filter("claim_id = 'A'").collect()}

    (root / "a" / "prescription.pdf").unlink()
    time.sleep(0.01)
    put(root, "a", claim_form=whole["claim_form"])
    process_directory(processor, str(root))
    assert names() == {"claim_form.pdf", "receipt.pdf"}
    assert {r.document_type for r in tables.read("extractions").filter("claim_id = 'A'").collect()} == {"CLAIM_FORM", "PAYMENT_RECEIPT"}
    without = document_check(tables, "A")
    assert without != with_prescription and "PRESCRIPTION" in without

    (root / "a" / "receipt.pdf").unlink()  # nothing is sent
    process_directory(processor, str(root))
    assert names() == {"claim_form.pdf"}

    put(root, "a", prescription=whole["prescription"])
    process_directory(processor, str(root))
    assert names() == {"claim_form.pdf", "prescription.pdf"}

    (root / "a" / "claim_form.pdf").unlink()  # the folder can't be loaded any more, but its claim has lost a document
    process_directory(processor, str(root))
    assert names() == {"prescription.pdf"} and "CLAIM_FORM" in document_check(tables, "A")
    (root / "a" / "prescription.pdf").unlink()
    process_directory(processor, str(root))
    assert names() == set() and tables.read("extractions").filter("claim_id = 'A'").isEmpty()
    assert sorted(map(str, tables.read("documents").filter("claim_id = 'B'").collect())) == others

    moved = tables.compacted(tables.root + "-compacted")
    for name in ("documents", "extractions", "claims", "results", "files"):
        assert sorted(map(str, moved.read(name).collect())) == sorted(map(str, tables.read(name).collect()))
    assert moved._versions("documents").filter("deleted").isEmpty()


def test_any_number_of_folders_that_cannot_be_read(spark, stage):
    """Errors that the reader gives for its files, on the executors: the folders that can be read load."""
    _, tables, processor, _ = stage
    rows = [(f"f{number:03}/claim_form.pdf", "2024-01-01", 1, "INSERT") for number in range(150)]
    changes = spark.createDataFrame(rows, "relative_path string, at string, size long, action string")
    changes = changes.selectExpr("relative_path", "CAST(at AS TIMESTAMP_NTZ) AS modified_at", "size", "action")

    def read(files):
        claim = F.col("folder")
        response = F.to_json(F.struct(F.struct(claim.alias("claim_id"), F.lit("Ann").alias("patient_name")).alias("response")))
        bad = F.when(claim >= "f020", F.concat(F.lit("no access to "), claim))
        return files.select("relative_path", F.when(bad.isNull(), response).alias("payload"), bad.alias("read_error"))

    ClaimProcessor(tables, read)(changes, 0)
    assert sorted(statuses(tables)) == [f"f{number:03}" for number in range(20)]
    logged = {r.folder: r.message or r.raised_error for r in tables.read("run_log").collect()}
    assert len(logged) == 150 and logged["f019"] is None and logged["f149"] == "no access to f149"


def test_compaction_into_a_new_root(spark, stage):
    root, tables, processor, _ = stage
    for number in range(3):
        put(root, "a", **{f"receipt_{number}": {"amount_paid": "1"}}, claim_form={"claim_id": "A"})
        changes = listing.read_directory(spark, str(root)).withColumn("modified_at", F.lit(f"210{number}-01-01").cast("timestamp_ntz"))
        processor(changes, number)
    decide(spark, tables, "A", "APPROVED")
    names = ("claims", "documents", "extractions", "results", "evidence", "files", "run_log", "runs", "decisions")
    before = {name: sorted(map(str, tables.read(name).collect())) for name in names}
    new = tables.compacted(tables.root + "-2")
    for at in (tables, new):
        assert {name: sorted(map(str, at.read(name).collect())) for name in names} == before
    assert new._versions("documents").select("run").distinct().count() == 1
    # The next batch goes on there.
    put(root, "b", claim_form={"claim_id": "B"})
    ClaimProcessor(new, processor.read_payloads)(listing.read_directory(spark, str(root)).filter("relative_path LIKE 'b/%'"), 3)
    assert set(statuses(new)) == {"A", "B"} and set(statuses(tables)) == {"A"} and statuses(new)["A"] == "APPROVED"


def test_no_untouched_bucket_is_read(spark, stage):
    root, tables, processor, _ = stage
    for number in range(6):
        put(root, f"f{number}", claim_form={"claim_id": f"C{number}"})
    processor(listing.read_directory(spark, str(root)), 0)
    touched = spark.createDataFrame([("f1",)], "folder string")
    buckets = tables.buckets_of(touched, "folder")
    for name in ("documents", "extractions", "files"):
        pruned = tables.read(name, buckets=buckets)
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN|=)", plan), plan
        opened = {r.f for r in tables._versions(name, buckets).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
        assert opened and all(f"/bucket={buckets[0]}/" in path for path in opened)
