"""Claims data derived from general order tables, for tests, queries and benchmarks.

One claim per order; its documents, payload texts and amounts follow arithmetic rules on the order key, so that every
arm of every check occurs and the size grows with the tables. The rules are listed in FIXTURES.md.
"""

import re
from functools import partial
from uuid import uuid4

import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import sanitize_name
from claimweave.operators.extraction import envelope_parts, parse_envelope
from claimweave.operators.skew import with_part
from claimweave.session import scratch_dir, writer_of
from claimweave.sources.files import open_root
from claimweave.vocabulary import DECISIONS, DOCUMENT_TYPES

# More distinct medicines than this are spread over several documents.
NAMES_PER_DOCUMENT = 1000

FILE_STEMS = (
    "claim_form", "prescription", "discharge_summary", "hospital_invoice", "pharmacy_invoice", "diagnostic_report", "payment_receipt",
)
FILE_EXTENSIONS = ("pdf", "png", "pdf", "pdf", "jpg", "pdf", "jpeg")
EVENT_FILES = (
    "claim_form", "prescription", "discharge_summary", "hospital_invoice", "pharmacy_bill", "lab_report", "payment_receipt",
    "receipt", "pharmacy_receipt", "claim_information", "notes", "hospital_discharge_summary",
)


def _k() -> Column:
    return F.col("k")


def _t() -> Column:
    return F.col("t")


_STORED: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(build=None, *, view=None):
    """Writes a derived table once per application and then reads it back, as the tables of a running system are read.

    Columns that are made of others in their row (ids, paths, parts of a payload) are not stored: `view` adds them where they are read.
    """
    if build is None:
        return partial(stored, view=view)

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _STORED:
            path = scratch_dir(spark, build.__name__)
            writer_of(build(spark, sf_dir)).parquet(path)
            _STORED[key] = path
        rows = spark.read.parquet(_STORED[key])
        return view(rows) if view else rows

    read.__name__, read.__doc__ = build.__name__, build.__doc__
    return read


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order facts every rule is built on."""
    return _named(_facts(spark, sf_dir)).drop("_safe_name")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        "o_custkey", "o_orderpriority", "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_orderdate").cast("date").alias("d"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", sanitize_name(F.col("c_name")).alias("_safe_name")
    )
    return placed.join(customers, "o_custkey")


def _named(facts: DataFrame) -> DataFrame:
    """Facts with the names that are made of them."""
    return facts.withColumns({
        "claim_id": F.concat(F.lit("CLM-"), _padded(_k())), "folder": F.concat_ws("_", "_safe_name", _padded(_k())),
    })


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


def _pick(values, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), position)


@stored
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims table."""
    status = F.when(_k() % 31 != 0, _pick(("EXTRACTION_COMPLETED", "PROCESSING", "MANUAL_REVIEW_REQUIRED"), (_k() % 3 + 1).cast("int")))
    decided = _k() % 10 == 0
    return orders(spark, sf_dir).select(
        "claim_id",
        F.concat(F.lit("PAT-"), F.col("o_custkey").cast("string")).alias("patient_id"),
        F.col("c_name").alias("patient_name"),
        F.concat(F.lit("POL-"), (_k() % 1000).cast("string")).alias("policy_number"),
        F.when(_k() % 17 == 0, "UNKNOWN").otherwise(F.col("o_orderpriority")).alias("claim_type"),
        _amount(_claimed_cents()).alias("claimed_amount"),
        status.alias("claim_status"),
        F.when(decided, "APPROVED").alias("reviewer_decision"),
        F.when(decided, F.concat(F.lit("seen "), _k().cast("string"))).alias("reviewer_comments"),
        F.col("d").cast("timestamp_ntz").alias("created_at"),
        F.when(decided, F.date_add("d", 20).cast("timestamp_ntz")).alias("reviewed_at"),
    )


def _claimed_cents() -> Column:
    return F.col("cents") + F.when(_k() % 11 == 0, 500).when(_k() % 11 == 1, 100).otherwise(0)


def _amount(cents: Column) -> Column:
    return (cents.cast("decimal(16,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def _part(whole: str) -> Column:
    return F.expr(f"({whole}) div 10")


def _amount_text(cents: Column) -> Column:
    units = F.format_number(F.floor(cents / 100).cast("bigint"), 0)
    sign = F.when(_k() % 2 == 0, "$").otherwise("USD ")
    return F.concat(sign, units, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _present(t: int) -> Column:
    rules = {2: _k() % 13 != 0, 3: _k() % 19 != 0, 4: _k() % 23 != 0, 5: _k() % 3 != 0, 6: _k() % 4 == 0, 7: _k() % 29 != 0}
    return rules.get(t, F.lit(True))


def medicine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct part names per order, in lists of bounded length."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = lines.join(parts, "p_partkey").select("k", "p_name")
    # A line has as many names as parts have its key; where no order can have too many, names move once and are not counted first.
    most = parts.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    crowded = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * most > NAMES_PER_DOCUMENT)
    if crowded.isEmpty():
        split = named.repartition("k").distinct().withColumn("part", F.lit(0))
    else:
        split = with_part(named.distinct(), ["k"], F.col("p_name"), NAMES_PER_DOCUMENT)
    return split.groupBy("k", "part").agg(F.array_sort(F.collect_list("p_name")).alias("names"))


def _document_names(rows: DataFrame) -> DataFrame:
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("_"), F.col("part").cast("string"))).otherwise("")
    file_name = F.concat(_pick(FILE_STEMS, _t()), suffix, F.lit("."), _pick(FILE_EXTENSIONS, _t()))
    return _named(rows).select(
        "*",
        F.concat("claim_id", F.lit("-"), _t().cast("string"), suffix).alias("document_id"),
        _pick(DOCUMENT_TYPES, _t()).alias("document_type"),
        file_name.alias("file_name"),
        F.concat_ws("/", "folder", file_name).alias("relative_path"),
        ((_t() > 1) & ((_k() + _t()) % 31 == 0)).alias("failed"),
    )


@stored(view=_document_names)
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim document with the order facts it is built from.

    Orders are dealt by their key first: files of the source tables may be few, and every later table takes over their division into tasks.
    """
    facts = _facts(spark, sf_dir).repartition("k")
    plain = F.array_compact(F.array(*[F.when(_present(t), F.lit(t)) for t in (1, 3, 4, 6, 7)]))
    others = facts.withColumn("t", F.explode(plain)).withColumn("part", F.lit(0)).withColumn(
        "names", F.array().cast("array<string>")
    )
    listed = facts.join(medicine_lists(spark, sf_dir), "k", "left").withColumns({
        "part": F.coalesce("part", F.lit(0)), "names": F.coalesce("names", F.array().cast("array<string>")),
    })
    medicines = listed.withColumn("t", F.explode(F.array_compact(F.array(*[F.when(_present(t), F.lit(t)) for t in (2, 5)]))))
    return others.unionByName(medicines)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document register, a narrow view of the stored document rows."""
    uploaded = F.col("d").cast("timestamp_ntz")
    return document_rows(spark, sf_dir).select(
        "document_id", "claim_id", "file_name", "relative_path", "document_type",
        F.concat("document_type", F.lit("_V1")).alias("template_id"),
        F.when(F.col("failed"), "FAILED").otherwise("EXTRACTED").alias("processing_status"),
        F.when(F.col("failed"), "extraction timed out").alias("error_message"),
        uploaded.alias("uploaded_at"),
        uploaded.alias("processed_at"),
    )


def _response(stale: Column) -> Column:
    """Response JSON of a document; a stale version has wrong values everywhere."""
    name = (
        F.when(stale, "Stale Person")
        .when((_t() == 2) & (_k() % 37 == 0), "Other Person")
        .when((_t() == 6) & (_k() % 8 == 0), F.lit(None))
        .when((_t() == 7) & (_k() % 41 == 0), "  ")
        .otherwise(F.concat(F.upper("c_name"), F.lit(".")))
        .alias("patient_name")
    )
    dated = _k() % 59 != 0
    admission = F.date_add("d", F.when((_t() == 4) & (_k() % 43 == 0), 1).otherwise(0))
    stay = F.when(_k() % 53 == 0, -3).otherwise((_k() % 9).cast("int")) + F.when((_t() == 4) & (_k() % 47 == 0), 1).otherwise(0)
    discharge = F.date_add("d", stay)

    def date_text(value: Column) -> Column:
        right = F.when(_t() == 4, F.date_format(value, "dd-MM-yyyy")).otherwise(F.date_format(value, "yyyy-MM-dd"))
        return F.when(dated, F.when(stale, "1999-01-01").otherwise(right))

    def total(cents: Column, unreadable: Column, text) -> Column:
        return F.when(stale, "1.00").when(unreadable, text).otherwise(_amount_text(cents))

    renamed = (_t() == 3) & (_k() % 6 == 0)
    dates = [
        F.when(~renamed, date_text(admission)).alias("admission_date"),
        F.when(~renamed, date_text(discharge)).alias("discharge_date"),
        F.when(renamed, date_text(admission)).alias("date_of_admission"),
        F.when(renamed, date_text(discharge)).alias("date_of_discharge"),
    ]
    names = F.col("names")
    bought = F.when(_k() % 79 == 0, F.array().cast("array<string>")).otherwise(F.concat(
        F.transform(names, lambda n: F.concat(n, F.when(_k() % 2 == 0, " 500mg").otherwise(""))),
        F.when((_k() % 73 == 0) & (F.col("part") == 0), F.array(F.lit("zz unlisted"))).otherwise(F.array().cast("array<string>")),
        F.when(_k() % 5 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")),
    ))
    hospital = F.when(_k() % 3 != 0, _part("cents * 7")).otherwise(F.col("cents"))
    receipt = F.col("cents") - F.when(_k() % 67 == 0, 200).otherwise(0)
    never = F.lit(False)
    numbers = F.transform(names, lambda n: F.array_position(names, n).cast("string"))
    by_type = [
        [
            F.col("claim_id"), F.concat(F.lit("PAT-"), F.col("o_custkey").cast("string")).alias("patient_id"), name,
            F.concat(F.lit("POL-"), (_k() % 1000).cast("string")).alias("policy_number"),
            F.when(_k() % 17 == 0, "").otherwise(F.col("o_orderpriority")).alias("claim_type"),
            *dates, total(_claimed_cents(), never, "").alias("claimed_amount"),
        ],
        [name, F.struct(F.when(stale, F.array(F.lit("stale"))).otherwise(names).alias("medicine_name"), numbers.alias("dosage")).alias("medicines")],
        [name, *dates],
        [name, *dates, total(hospital, _k() % 71 == 0, "n/a").alias("invoice_total")],
        [
            name, total(F.col("cents") - _part("cents * 7"), never, "").alias("invoice_total"),
            F.struct(F.when(stale, F.array(F.lit("stale"))).otherwise(bought).alias("medicine_name"), numbers.alias("quantity")).alias("medicine_items"),
        ],
        [name, F.lit("central laboratory").alias("laboratory_name")],
        [name, total(receipt, _k() % 61 == 0, F.lit(None)).alias("amount_paid")],
    ]
    ladder = F.when((_t() == 6) & (_k() % 16 == 0) & ~stale, '"no structured result"')
    for number, fields in enumerate(by_type, start=1):
        ladder = ladder.when(_t() == number, F.to_json(F.struct(*fields)))
    return ladder




def _scoring() -> Column:
    score = ((_k() + _t()) % 100).cast("double") / 100
    dated = _t().isin(1, 3, 4)
    return F.to_json(F.struct(
        score.alias("patient_name"),
        F.when(dated, score).alias("admission_date"),
        F.when(dated, score).alias("discharge_date"),
        F.when(_t() == 1, score).alias("claimed_amount"),
        F.when(_t().isin(4, 5), score).alias("invoice_total"),
        F.when(_t() == 7, score).alias("amount_paid"),
    ))


def _payload(stale: Column, failed: Column) -> Column:
    error = F.when(_k() % 2 == 0, '{"code":504,"message":"extraction timed out"}').otherwise('"extraction timed out"')
    good = F.concat(F.lit('{"response":'), _response(stale), F.lit(',"scoring":'), _scoring(), F.lit(',"error":null}'))
    return F.when(failed, F.concat(F.lit('{"response":null,"scoring":null,"error":'), error, F.lit("}"))).otherwise(good)


@stored
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload text per file path, as an extractor would have written it."""
    return document_rows(spark, sf_dir).select("relative_path", _payload(F.lit(False), F.col("failed")).alias("payload"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per extraction attempt with its payload and what its names are made of."""
    rows = document_rows(spark, sf_dir)
    attempts = F.array_compact(F.array(
        F.lit(0),
        F.when(((_k() + _t()) % 5 == 0) & ~F.col("failed"), F.lit(1)),
        F.when((_k() + _t()) % 7 == 0, F.lit(2)),
    ))
    tried = rows.withColumn("attempt", F.explode(attempts))
    attempt = F.col("attempt")
    return tried.select("k", "t", "part", "_safe_name", "d", "attempt", _payload(attempt == 1, F.col("failed") | (attempt == 2)).alias("payload"))


def _attempt_names(attempts: DataFrame, *kept: str) -> DataFrame:
    attempt = F.col("attempt")
    days = F.when(attempt == 1, 9).when(attempt == 2, 11).otherwise(10)
    return _document_names(attempts).select(
        F.concat("document_id", F.lit("-"), attempt.cast("string")).alias("extraction_id"),
        "document_id", "claim_id", "document_type",
        F.concat("document_type", F.lit("_V1")).alias("template_id"),
        "relative_path", *kept,
        F.date_add("d", days).cast("timestamp_ntz").alias("extracted_at"),
    )


@stored
def extraction_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload text per extraction attempt: the valid one, stale older ones and failed newer ones."""
    return _attempt_names(_attempts(spark, sf_dir), "payload")


def _envelope_parts(rows: DataFrame) -> DataFrame:
    names = _attempt_names(rows, "extraction_result", "error_message", "extraction_status")
    return envelope_parts(names).select(
        *[name for name in names.columns if name not in ("extraction_result", "error_message", "extraction_status")],
        "extraction_result", "extraction_status", "extracted_response", "extraction_scoring", "extraction_error",
    )


@stored(view=_envelope_parts)
def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction table. Payload texts are parsed as they are made, and stored once: their parts are split off where they are read."""
    return parse_envelope(_attempts(spark, sf_dir))


@stored
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the claim folders, with gaps: no form in some, unsupported and unknown files in others."""
    rows = document_rows(spark, sf_dir)
    kept = rows.filter((_t() != 1) | (_k() % 97 != 0)).select("relative_path", "d")
    extra = F.array_compact(F.array(
        F.when(_k() % 6 == 0, F.lit("notes.pdf")), F.when(_k() % 10 == 0, F.lit("readme.txt")), F.when(_k() % 33 == 0, F.lit("claim_form_copy.pdf")),
    ))
    extras = orders(spark, sf_dir).filter(_k() % 97 != 0).withColumn("extra", F.explode(extra)).select(
        F.concat_ws("/", "folder", "extra").alias("relative_path"), "d"
    )
    return kept.unionByName(extras).select(
        "relative_path", F.col("d").cast("timestamp_ntz").alias("modified_at"),
        F.length("relative_path").cast("bigint").alias("size"), F.lit("INSERT").alias("action"),
    )


@stored
def folder_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads for `folder_files`: some forms failed, are empty, lack the claim id or give it under another name."""
    rows = document_rows(spark, sf_dir)
    form = F.col("document_type") == "CLAIM_FORM"
    usual = _payload(F.lit(False), F.col("failed"))
    changed = (
        F.when(form & (_k() % 89 == 0), '{"response":null,"scoring":null,"error":"unreadable"}')
        .when(form & (_k() % 101 == 0), '{"response":null,"scoring":null,"error":null}')
        .when(form & (_k() % 103 == 0), F.regexp_replace(usual, '"claim_id":"[^"]*"', '"claim_id":" "'))
        .when(form & (_k() % 25 == 0), F.regexp_replace(usual, '"claim_id"', '"claim_number"'))
        .when((F.col("document_type") == "PAYMENT_RECEIPT") & (_k() % 77 == 0), F.lit("{broken"))
        .otherwise(usual)
    )
    return rows.filter((F.col("document_type") != "DISCHARGE_SUMMARY") | (_k() % 83 != 0)).select("relative_path", changed.alias("payload"))


def write_texts(texts: DataFrame, root: str) -> None:
    """One file per text, in a folder of its own (`folder`, `doc_id`, `text`); folders that are there are written anew.

    Tasks put the files in place themselves, so the driver renames none, however many folders there are. A repeated task writes the same names.
    """
    files, base = open_root(root)
    files.create_dir(base, recursive=True)
    token = uuid4().hex

    def write(batches):
        files, base = open_root(root)
        last, number = None, 0
        for batch in batches:
            for folder, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/folder={_escaped(folder)}"
                if place != last:
                    last, number = place, 0
                    _cleared(files, place, token)
                with files.open_output_stream(f"{place}/part-{token}-{number}.txt", compression=None) as sink:
                    sink.write(value + b"\n")
                number += 1
            yield batch.slice(0, 0)

    folder = F.coalesce(F.nullif(F.col("folder"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    named = texts.select(folder.alias("folder"), F.coalesce("text", F.lit("")).cast("binary").alias("value"))
    written = named.repartition("folder").sortWithinPartitions("folder").mapInArrow(write, named.schema)
    written.write.format("noop").mode("overwrite").save()


def _escaped(folder: str) -> str:
    """A partition value as Spark writes it into a path."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda found: f"%{ord(found[0]):02X}", folder)


def _cleared(files: pa_fs.FileSystem, folder: str, token: str) -> None:
    """Makes a folder, or takes the files of earlier writings out of it."""
    files.create_dir(folder, recursive=True)
    for info in files.get_file_info(pa_fs.FileSelector(folder)):
        if info.is_file and token not in info.base_name:
            files.delete_file(info.path)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_files(table(spark, sf_dir, "events"))


def as_event_files(events: DataFrame) -> DataFrame:
    """Change log of a document stage, one row per event."""
    e = F.col("event_id")
    extension = F.when(e % 10 == 0, ".txt").when(e % 4 == 0, ".PNG").otherwise(".pdf")
    name = F.concat(_pick(EVENT_FILES, (e % 12 + 1).cast("int")), extension)
    folder = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return events.select(
        "event_id",
        F.when(e % 33 == 0, name).otherwise(F.concat_ws("/", folder, name)).alias("relative_path"),
        F.col("ts").cast("timestamp_ntz").alias("modified_at"),
        F.length("props").cast("bigint").alias("size"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT").alias("action"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("submission_id"),
        F.when(c % 17 == 0, "  ").otherwise(F.col("c_name")).alias("patient_name"),
        F.when(c % 19 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" #"), c.cast("string"))).alias("claim_reference"),
    )


def submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_rows(spark, sf_dir).filter((F.col("document_type") != "CLAIM_FORM") | (F.col("o_custkey") % 23 != 0))
    return rows.select(F.col("o_custkey").alias("submission_id"), "file_name")


@stored
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(
        "claim_id",
        F.when(_k() % 83 == 0, "MAYBE").otherwise(_pick(DECISIONS, (_k() % 6 + 1).cast("int"))).alias("decision"),
        F.when(_k() % 7 == 0, " ").otherwise(F.concat(F.lit("ok "), _k().cast("string"))).alias("comments"),
        F.date_add("d", 30).cast("timestamp_ntz").alias("decided_at"),
    )


def _stamped(rows: DataFrame) -> DataFrame:
    from claimweave.plans.validation import stamped

    return stamped(rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@stored(view=_stamped)
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation result table. Its ids, digests of claim and category, are nearly twice as long as all else, and made where they are read."""
    from claimweave.plans.validation import validate_claims

    return validate_claims(claims(spark, sf_dir), documents(spark, sf_dir), extractions(spark, sf_dir))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history, one run per event."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "FAILED").when(kind == "view", "SKIPPED").otherwise("SUCCEEDED")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), state.alias("state"), F.col("ts").cast("timestamp_ntz").alias("scheduled_at"),
        F.when(kind == "error", F.concat(F.lit("error in "), F.col("props"))).alias("error_message"),
    )


def folder_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder outcomes of daily runs, one per event: loaded, returned as failed, or broken off with an error."""
    kind, e = F.col("event_type"), F.col("event_id")
    raised = F.when(kind == "error", F.concat(F.lit("broken off at "), e.cast("string")))
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("folder"),
        F.col("ts").cast("timestamp_ntz").alias("logged_at"),
        F.when(kind.isin("error", "view"), "FAILED").when(kind == "click", "COMPLETED_WITH_ERRORS").otherwise("SUCCESS").alias("load_status"),
        F.when(kind != "signup", F.concat(F.lit("CLM-"), e.cast("string"))).alias("claim_id"),
        raised.alias("raised_error"),
    )


def template_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of templates: one template per brand, one version per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("template_id"), F.col("p_type").alias("document_type"),
        F.col("p_name").alias("template_description"), F.col("p_partkey").cast("int").alias("template_version"),
        F.to_variant_object(F.struct(F.col("p_size").alias("size"))).alias("response_format"),
        (F.col("p_size") % 3 != 0).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
