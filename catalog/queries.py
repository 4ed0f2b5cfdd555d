"""Registered queries: every operator over whole tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import normalize_folder, sanitize_name
from claimweave.operators import extraction, intake, keyed, latest, medicines, review, runs
from claimweave.plans import features, loading, validation
from claimweave.session import materialize, scratch_dir
from claimweave.sources import clustered
from claimweave.sources import derived as D
from claimweave.sources import files as files_source
from claimweave.sources import listing, templates
from claimweave.sources.tables import ClaimTables
from claimweave.streaming import process

QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def joined(name: str):
    """An array as one text, for comparison; NULL stays NULL."""
    return F.array_join(name, "|").alias(name)


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- intake ---------------------------------------------------------------------------------------------------------


@query
def list_documents(spark, sf_dir):
    return intake.list_documents(D.event_files(spark, sf_dir)).select("event_id", "relative_path", "folder", "file_name")


@query
def normalize_paths(spark, sf_dir):
    files = D.event_files(spark, sf_dir)
    messy = F.concat(F.lit("  "), intake.folder_of(F.col("relative_path")), F.repeat(F.lit("/"), (F.col("event_id") % 4).cast("int")), F.lit(" "))
    return files.select("event_id", normalize_folder(messy).alias("folder_path"))


@query
def find_claim_forms(spark, sf_dir):
    return intake.find_claim_forms(D.event_files(spark, sf_dir))


@query
def classify_documents(spark, sf_dir):
    listed = intake.list_documents(D.event_files(spark, sf_dir))
    return intake.classify_documents(listed).select("event_id", "file_name", "document_type", "template_id")


@query
def new_folders(spark, sf_dir):
    return intake.new_folders(D.event_files(spark, sf_dir))


@query
def folders_to_reload(spark, sf_dir):
    files = D.event_files(spark, sf_dir)
    arrived = intake.new_folders(files.filter(F.col("modified_at") >= day("2024-01-25")))
    return intake.folders_to_reload(files, arrived).select("event_id", "relative_path", "folder")


@query
def pending_files(spark, sf_dir):
    files = D.event_files(spark, sf_dir)
    return intake.pending_files(files, files.filter(F.col("modified_at") < day("2024-01-16")))


@query
def sanitize_names(spark, sf_dir):
    folders = D.submissions(spark, sf_dir).select(
        F.lit("submission").alias("kind"), F.col("submission_id").alias("id"),
        intake.submission_folder(F.col("patient_name"), F.col("claim_reference")).alias("safe_name"),
    )
    urls = D.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), sanitize_name(F.col("url")).alias("safe_name")
    )
    return folders.unionByName(urls)


@query
def check_submissions(spark, sf_dir):
    return intake.check_submissions(D.submissions(spark, sf_dir), D.submission_files(spark, sf_dir))


# --- templates and extraction ---------------------------------------------------------------------------------------


@query
def resolve_templates(spark, sf_dir):
    resolved = templates.resolve_templates(D.template_registry(spark, sf_dir))
    parts = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("template_id"))
    asked = D.table(spark, sf_dir, "lineitem").select("l_partkey").join(parts, "l_partkey").groupBy("template_id").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return asked.join(resolved, "template_id", "left").select(
        "template_id", "template_version", "document_type", "template_description", "requests"
    )


@query
def template_field_catalog(spark, sf_dir):
    catalog = templates.field_catalog(templates.resolve_templates(templates.builtin_templates(spark)))
    fields = F.map_keys(F.try_variant_get("extracted_response", "$", "map<string,variant>"))
    newest = extraction.newest_typed(D.extractions(spark, sf_dir), None, F.col("template_id"), fields.alias("fields"))
    filled = newest.select("template_id", F.explode("fields").alias("field")).groupBy("template_id", "field").agg(
        F.count(F.lit(1)).alias("documents")
    )
    rows = catalog.join(filled, ["template_id", "field"], "left")
    return rows.select(
        "template_id", F.col("template_version").cast("bigint").alias("template_version"), "field", "kind",
        F.coalesce("columns", F.lit(0)).cast("bigint").alias("table_columns"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )


EXTRACTED_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+",
    "card_number": r"[0-9]{16}",
    "secret": r'token = "([0-9a-f]+)"',
}


def pattern_templates(languages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One template per language, with patterns as field descriptions."""
    properties = F.struct(*[
        F.struct(F.lit(pattern).alias("description"), F.lit("string").alias("type")).alias(field)
        for field, pattern in patterns.items()
    ])
    schema = F.struct(F.lit("object").alias("type"), properties.alias("properties")).alias("schema")
    return languages.select("template_id", F.to_variant_object(F.struct(schema)).alias("response_format"))


def _texts(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("template_id"))


def _fields(payloads: DataFrame, *kept: str) -> DataFrame:
    split = extraction.split_envelope(payloads)
    fields = [F.try_variant_get("extracted_response", f"$.{name}", "string").alias(name) for name in EXTRACTED_PATTERNS]
    return split.select("doc_id", *fields, "extraction_status", *kept)


@query
def extract_fields(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    registry = pattern_templates(texts.select("template_id").distinct(), EXTRACTED_PATTERNS)
    return _fields(extraction.extract_by_patterns(texts, registry, "doc_id", "text"))


def _careful(content, response_format):
    """A foreign extractor that refuses short texts."""
    if len(content) < 400:
        raise ValueError("too short")
    return extraction.pattern_extractor(content, response_format)


@query
def extract_isolated(spark, sf_dir):
    """A foreign extractor that fails on some documents, with a registry that lacks one language: the others go on."""
    texts = _texts(spark, sf_dir)
    registry = pattern_templates(texts.select("template_id").where("template_id <> 'fr'").distinct(), EXTRACTED_PATTERNS)
    return _fields(extraction.extract_documents(texts, registry, "doc_id", "text", _careful), "error_message")


@query
def extract_fields_adhoc(spark, sf_dir):
    texts = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = {"first_number": r"[0-9]+", "secret": r'token = "([0-9a-f]+)"', "shouted": r"[A-Z]{4,}"}
    return extraction.extract_patterns(texts, "text", asked).drop("text")


@query
def parse_layout(spark, sf_dir):
    blocks = extraction.parse_layout(D.table(spark, sf_dir, "pages"))
    return blocks.withColumn("block_no", F.col("block_no").cast("bigint"))


@query
def split_envelope(spark, sf_dir):
    split = extraction.split_envelope(D.extraction_payloads(spark, sf_dir))
    return split.select(
        "extraction_id", "extraction_status",
        F.col("extracted_response").isNotNull().alias("has_response"),
        F.try_variant_get("extracted_response", "$.patient_name", "string").alias("patient_name"),
        F.try_variant_get("extracted_response", "$.value", "string").alias("wrapped_value"),
        F.try_variant_get("extraction_error", "$.message", "string").alias("error_text"),
        F.try_variant_get("extraction_error", "$.code", "bigint").alias("error_code"),
    )


@query
def line_items(spark, sf_dir):
    extractions = D.extractions(spark, sf_dir)

    def lines(document_type, extra):
        rows = extraction.line_items(extractions, document_type)
        return rows.select("document_id", F.col("item_no").cast("bigint").alias("item_no"), "medicine_name", F.col(extra).alias("detail"))

    return lines("PRESCRIPTION", "dosage").unionByName(lines("PHARMACY_INVOICE", "quantity"))


@query
def extraction_scores(spark, sf_dir):
    return extraction.extraction_scores(D.extractions(spark, sf_dir)).select("document_id", "field", "score")


@query
def flatten_medicines(spark, sf_dir):
    return extraction.flatten_medicines(D.extractions(spark, sf_dir))


# --- keyed tables ---------------------------------------------------------------------------------------------------


@query
def latest_extractions(spark, sf_dir):
    newest = latest.latest_extractions(D.extractions(spark, sf_dir))
    return newest.select("claim_id", "document_id", "extraction_id", "document_type", "extraction_status")


@query
def current_documents(spark, sf_dir):
    uploads = D.extraction_payloads(spark, sf_dir).select(
        F.col("extraction_id").alias("document_id"), "relative_path", F.col("extracted_at").alias("uploaded_at")
    )
    return latest.current_documents(uploads).select("relative_path", "document_id")


@query
def upsert_claims(spark, sf_dir):
    claims = D.claims(spark, sf_dir)
    headers = claims.filter(F.col("created_at") >= day("1996-01-01")).select(
        "claim_id", "patient_id", F.upper("patient_name").alias("patient_name"), "policy_number",
        F.lit("RELOADED").alias("claim_type"), (F.col("claimed_amount") + 1).cast("decimal(18,2)").alias("claimed_amount"),
    )
    target = claims.filter(F.col("created_at") < day("1998-01-01"))
    return keyed.upsert_claims(target, headers, day("2024-01-31"))


@query
def upsert_documents(spark, sf_dir):
    documents = D.documents(spark, sf_dir)
    registered = documents.filter(F.col("uploaded_at") >= day("1996-01-01")).select(
        F.concat(F.lit("new-"), "document_id").alias("document_id"), "claim_id", F.upper("file_name").alias("file_name"),
        "relative_path", "document_type", F.concat("document_type", F.lit("_V2")).alias("template_id"),
    )
    target = documents.filter(F.col("uploaded_at") < day("1998-01-01"))
    return keyed.upsert_documents(target, registered, day("2024-01-31"))


@query
def sync_documents(spark, sf_dir):
    """Folders of finished orders are loaded again: forms come back, diagnostic reports are there and not loaded, all other files have gone."""
    documents = D.documents(spark, sf_dir)
    finished = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F").select("folder")
    listing = documents.filter(F.col("document_type").isin("CLAIM_FORM", "DIAGNOSTIC_REPORT"))
    registered = listing.filter(F.col("document_type") == "CLAIM_FORM").withColumn("folder", intake.folder_of(F.col("relative_path")))
    registered = registered.join(finished, "folder", "left_semi").drop("folder")
    synced = keyed.sync_documents(documents, registered, listing, finished, day("2024-01-31"))
    return synced.select("document_id", "claim_id", "document_type", "processing_status", "uploaded_at")


@query
def replace_by_key(spark, sf_dir):
    documents = D.documents(spark, sf_dir).select("claim_id", "document_type", "relative_path")
    lone_forms = documents.join(
        D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F").select("claim_id"), "claim_id", "left_semi"
    ).filter(F.col("document_type") == "CLAIM_FORM").withColumn("relative_path", F.lit("replaced"))
    return keyed.replace_by_key(documents, lone_forms, ["claim_id"])


@query
def apply_updates(spark, sf_dir):
    updates = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "P").select(
        "claim_id", F.lit("PENDING_ORDER").alias("claim_status"), F.lit(None).cast("string").alias("reviewer_decision")
    )
    return keyed.apply_updates(D.claims(spark, sf_dir), updates, ["claim_id"]).select(
        "claim_id", "claim_status", "reviewer_decision", "reviewer_comments"
    )


# --- loading --------------------------------------------------------------------------------------------------------


@query
def claim_headers(spark, sf_dir):
    return loading.claim_headers(D.folder_files(spark, sf_dir), D.folder_payloads(spark, sf_dir))


@query
def folder_load_summary(spark, sf_dir):
    """Only the outcome is asked for, so the extraction rows are not stored on the way."""
    files, payloads = D.folder_files(spark, sf_dir), D.folder_payloads(spark, sf_dir)
    return loading.load_folders(files, payloads, day("2024-01-31"), store=lambda rows: rows).summary


@query
def folder_failures(spark, sf_dir):
    """Claims after the folders of finished orders broke off."""
    failures = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F").select(
        "claim_id", F.concat(F.lit("broken off at "), F.col("k").cast("string")).alias("message")
    )
    return loading.raised_failure(D.claims(spark, sf_dir), failures).select("claim_id", "claim_status", "reviewer_comments")


@query
def claim_tables_current(spark, sf_dir):
    """Current rows of stored tables after several runs: documents that moved to another claim, and decisions of two writers."""
    tables = ClaimTables(spark, scratch_dir(spark, "claim-tables"), buckets=8)
    claims, documents = D.claims(spark, sf_dir), D.documents(spark, sf_dir)
    tables.write("claims", claims.withColumn("loaded_at", day("2024-01-01")), 1)
    tables.write("documents", documents, 1)
    moved = documents.join(D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "P").select("claim_id"), "claim_id", "left_semi")
    tables.write("documents", moved.withColumn("claim_id", F.concat(F.lit("M-"), "claim_id")), 2)
    number = F.substring("claim_id", 5, 8).cast("int")
    for divisor, decision, recorded in ((5, "APPROVED", "2024-01-02"), (7, "REJECTED", "2024-01-03"), (11, "APPROVED", "2023-12-31")):
        tables.append("decisions", claims.filter(number % divisor == 0).select(
            "claim_id", F.lit(decision).alias("reviewer_decision"), F.lit("by two writers").alias("reviewer_comments"),
            day(recorded).alias("reviewed_at"), day(recorded).alias("recorded_at"),
        ))
    counted = tables.read("documents").groupBy("claim_id").agg(F.count(F.lit(1)).alias("documents"))
    current = tables.read("claims").select("claim_id", "claim_status", "reviewer_decision")
    return counted.join(current, "claim_id", "left")


# --- validation -----------------------------------------------------------------------------------------------------


@query
def missing_documents(spark, sf_dir):
    return features.missing_documents(D.claims(spark, sf_dir), D.documents(spark, sf_dir))


@query
def unmatched_medicines(spark, sf_dir):
    names = extraction.flatten_medicines(D.extractions(spark, sf_dir))
    distinct = materialize(medicines.distinct_medicines(names.select("claim_id", "side", "medicine")), "medicines")
    return medicines.unmatched_medicines(distinct)


@query
def unmatched_medicines_by_join(spark, sf_dir):
    """The form for claims with very many names, here for all claims."""
    names = extraction.flatten_medicines(D.extractions(spark, sf_dir))
    distinct = materialize(medicines.distinct_medicines(names.select("claim_id", "side", "medicine")), "medicines")
    return medicines.unmatched_by_join(distinct).select("claim_id", "medicine")


@query
def claim_features(spark, sf_dir):
    fields = features.stored_versions(D.extractions(spark, sf_dir))
    rows = features.claim_features(D.claims(spark, sf_dir), D.documents(spark, sf_dir), fields)
    lists = [*features.LISTS, "missing_types"]
    return rows.select(*[joined(name) if name in lists else name for name in rows.columns])


def _checked(rows: DataFrame, *details: str) -> DataFrame:
    return rows.select(
        "claim_id", "validation_status", "severity", "requires_review", "validation_message", *details
    )


@query
def validate_required_documents(spark, sf_dir):
    rows = validation.validate_required_documents(D.claims(spark, sf_dir), D.documents(spark, sf_dir))
    return _checked(rows, joined("missing_types"))


@query
def validate_identity(spark, sf_dir):
    rows = validation.validate_identity(D.claims(spark, sf_dir), D.extractions(spark, sf_dir))
    return _checked(rows, "expected_value", "actual_value", "document_count", "missing_names", "name_mismatches")


@query
def validate_dates(spark, sf_dir):
    rows = validation.validate_dates(D.claims(spark, sf_dir), D.extractions(spark, sf_dir))
    return _checked(
        rows, "admission_count", "discharge_count", "admission_variants", "discharge_variants",
        "min_admission", "max_admission", "min_discharge", "max_discharge",
    )


@query
def validate_financial(spark, sf_dir):
    rows = validation.validate_financial(D.claims(spark, sf_dir), D.extractions(spark, sf_dir))
    return _checked(
        rows, "claimed_amount", "hospital_amount", "pharmacy_amount", "receipt_amount", "supported_amount",
        "claim_difference", "receipt_difference",
    )


@query
def claim_listings(spark, sf_dir):
    """Names and medicines of every claim in parts; short ones here, so that most claims have several."""
    listed = features.claim_listings(features.stored_fields(D.extractions(spark, sf_dir), (features.NAMES, features.MEDICINES)), most=120)
    return listed.select("claim_id", "kind", F.col("part").cast("long").alias("part"), "n_items", joined("listing"))


@query
def validate_medicines(spark, sf_dir):
    rows = validation.validate_medicines(D.claims(spark, sf_dir), D.extractions(spark, sf_dir))
    return _checked(
        rows, joined("prescribed_items"), joined("purchased_items"), joined("unmatched_items"),
        "prescribed_count", "purchased_count", "unmatched_count",
    )


@query
def validate_claims(spark, sf_dir):
    rows = validation.validate_claims(D.claims(spark, sf_dir), D.documents(spark, sf_dir), D.extractions(spark, sf_dir))
    return rows.select(
        "claim_id", "validation_category", "validation_name", "validation_status", "expected_value", "validation_message",
        "severity", "requires_review", joined("source_documents"),
    )


def _value(path: str):
    return F.get_json_object("actual_value", f"$.{path}")


@query
def validation_values(spark, sf_dir):
    """What the checks found, out of the JSON of their result rows."""
    rows = validation.validate_claims(D.claims(spark, sf_dir), D.documents(spark, sf_dir), D.extractions(spark, sf_dir))
    category = F.col("validation_category")

    def pick(**by_category):
        choice = F.lit(None).cast("string")
        for name, value in by_category.items():
            choice = F.when(category == name, value).otherwise(choice)
        return choice

    def money(path):
        return _value(path).cast("decimal(18,2)").cast("string")

    return rows.select(
        "claim_id", "validation_category",
        pick(DOCUMENT=F.col("actual_value"), TREATMENT_DATE=_value("minimum_admission_date"), FINANCIAL=money("supported_amount"),
             MEDICAL=_value("prescribed_medicine_count"), CLAIM_DECISION=_value("recommendation")).alias("first_value"),
        pick(TREATMENT_DATE=_value("maximum_discharge_date"), FINANCIAL=money("claim_difference"), MEDICAL=_value("purchased_medicines"),
             CLAIM_DECISION=_value("failed_validations")).alias("second_value"),
        pick(TREATMENT_DATE=_value("admission_date_variants"), FINANCIAL=money("payment_receipt_amount"), MEDICAL=_value("unmatched_medicines"),
             CLAIM_DECISION=_value("warning_validations")).alias("third_value"),
    )


@query
def claim_evidence(spark, sf_dir):
    return features.claim_evidence(features.stored_fields(D.extractions(spark, sf_dir)))


@query
def validation_summary(spark, sf_dir):
    """Counts and recommendation per claim, with status and message of each check out of the answer's JSON."""
    summary = validation.validation_summary(
        validation.validate_claims(D.claims(spark, sf_dir), D.documents(spark, sf_dir), D.extractions(spark, sf_dir))
    )
    checks = [
        F.get_json_object(f"{name}_validation", "$.validation_status").alias(f"{name}_status")
        for name in ("document", "identity", "date", "medical", "financial")
    ]
    message = F.get_json_object("financial_validation", "$.validation_message").alias("financial_message")
    return summary.select("claim_id", "status", "recommendation", "total_validations", "failed_validations", *checks, message)


@query
def validate_requested(spark, sf_dir):
    """Validation of the claims of open orders only."""
    asked = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "O").select("claim_id")
    rows = validation.validate_requested(asked, D.claims(spark, sf_dir), D.documents(spark, sf_dir), D.extractions(spark, sf_dir))
    return rows.select("claim_id", "validation_category", "validation_status", "severity", "validation_message")


@query
def consolidate_claims(spark, sf_dir):
    return validation.consolidate_claims(D.results(spark, sf_dir))


@query
def validation_requests(spark, sf_dir):
    """Answers for the claims of open orders, and for ids no order has."""
    asked = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "O").select(
        F.explode(F.array("claim_id", F.concat(F.lit("X-"), "claim_id"))).alias("claim_id")
    )
    return validation.validation_requests(asked, validation.consolidate_claims(D.results(spark, sf_dir)))


# --- review ---------------------------------------------------------------------------------------------------------


@query
def claim_worklist(spark, sf_dir):
    return review.claim_worklist(D.claims(spark, sf_dir)).select("claim_id", "claim_status", "status_group", "created_at")


@query
def search_claims(spark, sf_dir):
    return review.search_claims(D.claims(spark, sf_dir), " 00000012 ", "PROCESSING").select("claim_id", "patient_name", "claim_status")


def _clustered(spark, rows, key):
    path = scratch_dir(spark, f"by-{key}")
    clustered.write_clustered(rows, path, key)
    return path


@query
def worklist_second_page(spark, sf_dir):
    """A hundred claims after the first hundred, out of claims stored by time."""
    claims = spark.read.parquet(_clustered(spark, review.with_place(D.claims(spark, sf_dir)), "place"))
    last = review.worklist_page(claims, 100).select("created_at", "claim_id").collect()[-1]
    return review.worklist_page(claims, 100, (last.created_at, last.claim_id)).select("claim_id", "created_at")


@query
def search_claims_by_index(spark, sf_dir):
    claims = D.claims(spark, sf_dir)
    path = _clustered(spark, review.search_index(claims), "gram")

    def read_index(grams):
        return clustered.read_keys(spark, path, "gram", spark.createDataFrame([(gram,) for gram in grams], "gram string"))

    return review.search_by_index(claims, read_index, " 00000012 ", "PROCESSING").select("claim_id", "patient_name", "claim_status")


@query
def validate_stored_claims(spark, sf_dir):
    """Validation of the claims of pending orders, out of tables that are stored by claim."""
    asked = D.orders(spark, sf_dir).filter(F.col("o_orderstatus") == "P").select("claim_id")
    stored = {name: _clustered(spark, build(spark, sf_dir), "claim_id") for name, build in (("claims", D.claims), ("documents", D.documents), ("extractions", D.extractions))}
    rows = validation.validate_claims(*(clustered.read_keys(spark, path, "claim_id", asked) for path in stored.values()))
    return rows.select("claim_id", "validation_category", "validation_status", "severity", "validation_message")


@query
def status_options(spark, sf_dir):
    return review.status_options(D.claims(spark, sf_dir))


@query
def claim_documents_view(spark, sf_dir):
    return review.claim_documents_view(D.documents(spark, sf_dir)).select(
        "claim_id", F.col("position").cast("bigint").alias("position"), "type_rank", "file_name", "document_type", "processing_status", "error_message"
    )


@query
def claim_validations_view(spark, sf_dir):
    return review.claim_validations_view(D.results(spark, sf_dir)).select(
        "claim_id", F.col("position").cast("bigint").alias("position"), "status_rank", "validation_category", "validation_status", "severity"
    )


@query
def validation_counts(spark, sf_dir):
    return review.validation_counts(D.results(spark, sf_dir))


@query
def open_issues(spark, sf_dir):
    return review.open_issues(D.results(spark, sf_dir)).select("claim_id", "validation_category", "validation_status", "validation_message")


@query
def related_documents(spark, sf_dir):
    return review.related_documents(D.results(spark, sf_dir), D.documents(spark, sf_dir))


@query
def parse_source_documents(spark, sf_dir):
    orders = D.orders(spark, sf_dir)
    k = F.col("k")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('["CLAIM_FORM", "'), "o_orderpriority", F.lit('"]')))
        .when(k % 5 == 1, F.concat(F.lit('["CLAIM_FORM" ,, '), "o_orderpriority", F.lit("] , ")))
        .when(k % 5 == 2, F.concat(F.lit(" "), "c_name", F.lit(",OTHER")))
        .when(k % 5 == 3, F.lit("[]"))
    )
    return orders.select("claim_id", F.array_join(review.parse_source_documents(text), "|").alias("source_documents"))


@query
def apply_reviewer_decisions(spark, sf_dir):
    claims = D.claims(spark, sf_dir)
    checked = review.check_decisions(D.decisions(spark, sf_dir), claims)
    decided = review.apply_reviewer_decisions(claims, checked)
    return decided.join(checked.select("claim_id", "reason"), "claim_id").select(
        "claim_id", "claim_status", "reviewer_decision", "reviewer_comments", "reviewed_at", "reason"
    )


# --- runs and streams -----------------------------------------------------------------------------------------------


@query
def run_history(spark, sf_dir):
    log = D.run_log(spark, sf_dir)
    newest = log.agg(F.max("scheduled_at")).scalar()
    return runs.run_history(log, newest)


@query
def run_summary(spark, sf_dir):
    return runs.run_summary(D.folder_outcomes(spark, sf_dir))


@query
def stream_new_folders(spark, sf_dir):
    return process.stream_new_folders(spark, sf_dir)


@query
def stream_file_changes(spark, sf_dir):
    return process.stream_file_changes(spark, sf_dir)


@query
def listed_contents(spark, sf_dir):
    """Contents of the files of three sources out of a folder of all document texts; a listed file that is not there has a reason instead."""
    root = scratch_dir(spark, "texts")
    texts = D.table(spark, sf_dir, "documents").withColumn("folder", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    D.write_texts(texts, root)
    files = listing.read_directory(spark, root).withColumn("folder", F.regexp_extract("relative_path", "^folder=([^/]*)/", 1))
    wanted = files.join(texts.filter(F.col("source").isin("src0", "src1", "src2")).select("folder"), "folder", "left_semi").drop("folder")
    gone = texts.filter(F.col("doc_id") % 10 == 0).select(F.concat(F.lit("gone/"), "folder").alias("relative_path"), F.lit(None).alias("size"))
    found = files_source.read_contents(wanted.select("relative_path", "size").unionByName(gone), root)
    return found.select(
        F.regexp_extract("relative_path", "(?:folder=|gone/)([^/]*)", 1).alias("folder"), F.octet_length("content").cast("long").alias("n_bytes"),
        F.md5("content").alias("content_md5"), F.split_part("read_error", F.lit(":"), F.lit(1)).alias("error_class"),
    )


@query
def touched_folders(spark, sf_dir):
    return intake.touched_folders(D.event_files(spark, sf_dir))


@query
def process_changed_claims(spark, sf_dir):
    """Stored results after a run in which files were deleted, overwritten and unreadable."""
    tables = process.changed_processor(spark, sf_dir).tables
    status = tables.read("claims").select("claim_id", "claim_status")
    return tables.read("results").join(status, "claim_id").select("claim_id", "claim_status", "validation_category", "validation_status", "severity")


@query
def stored_documents(spark, sf_dir):
    """Stored documents after the same runs, with their newest extraction; ids are digests of path and run."""
    tables = process.changed_processor(spark, sf_dir).tables
    attempts = tables.read("extractions").select("document_id", "extraction_id", "extraction_status")
    return tables.read("documents").join(attempts, "document_id").select(
        "document_id", "extraction_id", "claim_id", "relative_path", "processing_status", "extraction_status"
    )


@query
def engine_history(spark, sf_dir):
    """The engine's own run history of those runs."""
    history = process.changed_processor(spark, sf_dir).history()
    shown = runs.run_history(history, history.agg(F.max("scheduled_at")).scalar())
    return shown.select("run_id", "state", "return_value", "error_message")


@query
def process_new_claims(spark, sf_dir):
    return process.process_derived_claims(spark, sf_dir)
