"""Registry of extraction templates: which fields to read from each document type."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.variants import entries
from claimweave.operators.latest import newest_per_key

# What each template is for.
DESCRIPTIONS = {
    "CLAIM_FORM": "Who claims what under which policy, from a claim form",
    "PRESCRIPTION": "Medicines and doses that a doctor has prescribed",
    "DISCHARGE_SUMMARY": "Stay, diagnosis and treatment in a hospital",
    "HOSPITAL_INVOICE": "Total and items that a hospital charges",
    "PHARMACY_INVOICE": "Total and medicines that a pharmacy charges",
    "DIAGNOSTIC_REPORT": "Results of tests and scans",
    "PAYMENT_RECEIPT": "What was paid, when and to whom",
}

# Fields per document type as (name, kind, columns); the columns of a table (object) are lists.
FIELDS = {
    "CLAIM_FORM": (
        ("claim_id", "string", ()),
        ("patient_id", "string", ()),
        ("patient_name", "string", ()),
        ("policy_number", "string", ()),
        ("insurance_provider", "string", ()),
        ("claim_type", "string", ()),
        ("hospital_name", "string", ()),
        ("admission_date", "string", ()),
        ("discharge_date", "string", ()),
        ("primary_diagnosis", "string", ()),
        ("claimed_amount", "string", ()),
        ("patient_signature_present", "string", ()),
    ),
    "PRESCRIPTION": (
        ("patient_name", "string", ()),
        ("patient_age", "string", ()),
        ("doctor_name", "string", ()),
        ("hospital_or_clinic", "string", ()),
        ("prescription_date", "string", ()),
        ("diagnosis", "string", ()),
        ("follow_up_instructions", "string", ()),
        ("doctor_signature_present", "string", ()),
        ("medicines", "object", ("medicine_name", "strength", "dosage", "frequency", "duration", "instructions")),
    ),
    "DISCHARGE_SUMMARY": (
        ("patient_name", "string", ()),
        ("patient_id", "string", ()),
        ("hospital_name", "string", ()),
        ("admission_date", "string", ()),
        ("discharge_date", "string", ()),
        ("attending_doctor", "string", ()),
        ("primary_diagnosis", "string", ()),
        ("clinical_summary", "string", ()),
        ("procedures_performed", "array", ()),
        ("discharge_medications", "array", ()),
        ("follow_up_advice", "string", ()),
        ("discharge_condition", "string", ()),
    ),
    "HOSPITAL_INVOICE": (
        ("invoice_number", "string", ()),
        ("claim_id", "string", ()),
        ("patient_name", "string", ()),
        ("patient_id", "string", ()),
        ("hospital_name", "string", ()),
        ("admission_date", "string", ()),
        ("discharge_date", "string", ()),
        ("diagnosis", "string", ()),
        ("subtotal", "string", ()),
        ("discount", "string", ()),
        ("tax_amount", "string", ()),
        ("invoice_total", "string", ()),
        ("invoice_items", "object", ("description", "quantity", "rate", "amount")),
    ),
    "PHARMACY_INVOICE": (
        ("invoice_number", "string", ()),
        ("claim_id", "string", ()),
        ("patient_name", "string", ()),
        ("pharmacy_name", "string", ()),
        ("invoice_date", "string", ()),
        ("prescribing_doctor", "string", ()),
        ("invoice_total", "string", ()),
        ("medicine_items", "object", ("medicine_name", "strength", "quantity", "unit_price", "line_amount")),
    ),
    "DIAGNOSTIC_REPORT": (
        ("patient_name", "string", ()),
        ("patient_id", "string", ()),
        ("laboratory_name", "string", ()),
        ("ordering_doctor", "string", ()),
        ("report_date", "string", ()),
        ("diagnosis", "string", ()),
        ("clinical_interpretation", "string", ()),
        ("test_results", "object", ("test_date", "test_name", "result", "reference_or_comment")),
    ),
    "PAYMENT_RECEIPT": (
        ("receipt_number", "string", ()),
        ("claim_id", "string", ()),
        ("patient_name", "string", ()),
        ("hospital_invoice_number", "string", ()),
        ("pharmacy_invoice_number", "string", ()),
        ("payment_date", "string", ()),
        ("amount_paid", "string", ()),
        ("payment_method", "string", ()),
        ("transaction_reference", "string", ()),
        ("payment_status", "string", ()),
    ),
}

TABLES = {
    document_type: next((name, columns) for name, kind, columns in fields if kind == "object")
    for document_type, fields in FIELDS.items()
    if any(kind == "object" for _, kind, _ in fields)
}

# How an answer should look, for fields where that matters; other fields are asked for by their name in words.
INSTRUCTIONS = {
    "claimed_amount": "Total amount that is claimed, digits with a decimal point, without currency sign.",
    "invoice_total": "Final amount of the invoice after discount and tax, digits with a decimal point, without currency sign.",
    "amount_paid": "Amount that was paid, digits with a decimal point, without currency sign.",
    "subtotal": "Sum before discount and tax, digits with a decimal point.",
    "discount": "Discount as an amount, digits with a decimal point; nothing if there is none.",
    "tax_amount": "Tax as an amount, digits with a decimal point; nothing if there is none.",
    "admission_date": "Date of admission as DD-MM-YYYY.",
    "discharge_date": "Date of discharge as DD-MM-YYYY.",
    "prescription_date": "Date on the prescription as DD-MM-YYYY.",
    "invoice_date": "Date of the invoice as DD-MM-YYYY.",
    "report_date": "Date of the report as DD-MM-YYYY.",
    "payment_date": "Date of the payment as DD-MM-YYYY.",
    "patient_name": "Full name of the patient as written, without title.",
    "patient_signature_present": "YES if the patient has signed, by hand or by stamp, else NO.",
    "doctor_signature_present": "YES if a doctor has signed, by hand or by stamp, else NO.",
    "medicine_name": "Name of the medicine as written, also by hand, without strength; one entry a line.",
    "strength": "Strength with its unit, in the order of the medicines.",
    "quantity": "Number of units, digits only, in the order of the lines.",
    "rate": "Price of one unit, digits with a decimal point, in the order of the lines.",
    "unit_price": "Price of one unit, digits with a decimal point, in the order of the lines.",
    "amount": "Amount of the line, digits with a decimal point, in the order of the lines.",
    "line_amount": "Amount of the line, digits with a decimal point, in the order of the lines.",
    "test_date": "Date of the test as DD-MM-YYYY, in the order of the tests.",
    "payment_status": "Whether the payment is complete, partial or open.",
}


def response_format(document_type: str) -> dict:
    """JSON schema of a template: a question for each field and, in tables, for each column."""

    def entry(name, kind, columns=()):
        schema = {"description": INSTRUCTIONS.get(name, name.replace("_", " ")), "type": kind}
        if columns:
            schema["column_ordering"] = list(columns)
            schema["properties"] = {column: entry(column, "array") for column in columns}
        return schema

    return {"schema": {"type": "object", "properties": {name: entry(name, kind, columns) for name, kind, columns in FIELDS[document_type]}}}


def builtin_templates(spark: SparkSession) -> DataFrame:
    """The seven templates, version 1, active. A constant relation of seven rows."""
    rows = [(f"{kind}_V1", kind, DESCRIPTIONS[kind], 1, json.dumps(response_format(kind)), True) for kind in FIELDS]
    columns = "template_id string, document_type string, template_description string, template_version int"
    frame = spark.createDataFrame(rows, f"{columns}, response_json string, is_active boolean")
    return _parsed(frame)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates kept as JSON lines: the columns of the registry, with the schema as an object or a text."""
    schema = T.StructType([
        T.StructField("template_id", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("template_description", T.StringType()),
        T.StructField("template_version", T.IntegerType()),
        T.StructField("response_format", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ])
    rows = spark.read.schema(schema).json(path).withColumnRenamed("response_format", "response_json")
    return _parsed(rows.withColumn("is_active", F.coalesce("is_active", F.lit(True))))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "template_id", "document_type", "template_description", "template_version",
        F.parse_json("response_json").alias("response_format"), "is_active",
        F.localtimestamp().alias("created_at"),
    )


def resolve_templates(templates: DataFrame) -> DataFrame:
    """Newest active version of every template id."""
    active = templates.filter(F.col("is_active"))
    return newest_per_key(active, ["template_id"], [F.col("template_version").desc_nulls_first()])


def field_catalog(templates: DataFrame) -> DataFrame:
    """One row per top-level template field with its kind."""
    properties = F.variant_get("response_format", "$.schema.properties", "variant")
    fields = entries(templates.withColumn("properties", properties), "properties")
    return fields.select(
        "template_id", "template_version", "document_type", F.col("key").alias("field"),
        F.try_variant_get("value", "$.type", "string").alias("kind"),
        F.size(F.try_variant_get("value", "$.column_ordering", "array<string>")).alias("columns"),
    )
