"""DuckDB twins of the registered queries, written from the base tables and the rules, without any JSON."""

ORDERS = """
o AS (
  SELECT o_orderkey AS k, o_custkey, o_orderpriority, o_orderstatus, c_name,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS d,
         'CLM-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS claim_id,
         regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')
           || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS folder
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""

CLAIMS = """
claims AS (
  SELECT claim_id, 'PAT-' || o_custkey AS patient_id, c_name AS patient_name, 'POL-' || (k % 1000) AS policy_number,
         CASE WHEN k % 17 = 0 THEN 'UNKNOWN' ELSE o_orderpriority END AS claim_type,
         CAST((cents + CASE WHEN k % 11 = 0 THEN 500 WHEN k % 11 = 1 THEN 100 ELSE 0 END) * 0.01 AS DECIMAL(18,2)) AS claimed_amount,
         CASE WHEN k % 31 <> 0 THEN (['EXTRACTION_COMPLETED', 'PROCESSING', 'MANUAL_REVIEW_REQUIRED'])[k % 3 + 1] END AS claim_status,
         CASE WHEN k % 10 = 0 THEN 'APPROVED' END AS reviewer_decision,
         CASE WHEN k % 10 = 0 THEN 'seen ' || k END AS reviewer_comments,
         CAST(d AS TIMESTAMP) AS created_at,
         CASE WHEN k % 10 = 0 THEN CAST(d + 20 AS TIMESTAMP) END AS reviewed_at
  FROM o
)"""

DOCS = """
docs AS (
  SELECT o.*, t,
         (['CLAIM_FORM', 'PRESCRIPTION', 'DISCHARGE_SUMMARY', 'HOSPITAL_INVOICE', 'PHARMACY_INVOICE', 'DIAGNOSTIC_REPORT',
           'PAYMENT_RECEIPT'])[t] AS document_type,
         (['claim_form.pdf', 'prescription.png', 'discharge_summary.pdf', 'hospital_invoice.pdf', 'pharmacy_invoice.jpg',
           'diagnostic_report.pdf', 'payment_receipt.jpeg'])[t] AS file_name,
         claim_id || '-' || t AS document_id,
         t > 1 AND (k + t) % 31 = 0 AS failed
  FROM o, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS t)
  WHERE t = 1 OR (t = 2 AND k % 13 <> 0) OR (t = 3 AND k % 19 <> 0) OR (t = 4 AND k % 23 <> 0) OR (t = 5 AND k % 3 <> 0)
     OR (t = 6 AND k % 4 = 0) OR (t = 7 AND k % 29 <> 0)
)"""

ATTEMPTS = """
attempts AS (
  SELECT docs.*, a, document_id || '-' || a AS extraction_id, failed OR a = 2 AS attempt_failed
  FROM docs, (SELECT unnest([0, 1, 2]) AS a)
  WHERE a = 0 OR (a = 1 AND (k + t) % 5 = 0 AND NOT failed) OR (a = 2 AND (k + t) % 7 = 0)
)"""

# Values of the valid version of every extracted document.
VALUES = """
vals AS (
  SELECT *,
         CASE WHEN t = 2 AND k % 37 = 0 THEN 'Other Person' WHEN t = 6 AND k % 8 = 0 THEN NULL
              WHEN t = 7 AND k % 41 = 0 THEN '  ' ELSE upper(c_name) || '.' END AS nm,
         CASE WHEN t IN (1, 3, 4) AND k % 59 <> 0
              THEN d + CAST(CASE WHEN t = 4 AND k % 43 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS adm,
         CASE WHEN t IN (1, 3, 4) AND k % 59 <> 0
              THEN d + CAST(CASE WHEN k % 53 = 0 THEN -3 ELSE k % 9 END + CASE WHEN t = 4 AND k % 47 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS dis,
         CASE WHEN t = 4 AND k % 71 <> 0 THEN CAST((CASE WHEN k % 3 <> 0 THEN cents * 7 // 10 ELSE cents END) * 0.01 AS DECIMAL(18,2)) END AS hospital,
         CASE WHEN t = 5 THEN CAST((cents - cents * 7 // 10) * 0.01 AS DECIMAL(18,2)) END AS pharmacy,
         CASE WHEN t = 7 AND k % 61 <> 0 THEN CAST((cents - CASE WHEN k % 67 = 0 THEN 200 ELSE 0 END) * 0.01 AS DECIMAL(18,2)) END AS receipt
  FROM docs WHERE NOT failed
)"""

MEDICINES = """
part_names AS (
  SELECT DISTINCT l_orderkey AS k, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
),
med AS (
  SELECT claim_id, document_id, 'PRESCRIBED' AS side, p_name AS medicine FROM docs JOIN part_names USING (k) WHERE t = 2 AND NOT failed
  UNION ALL
  SELECT claim_id, document_id, 'PURCHASED', p_name || CASE WHEN k % 2 = 0 THEN ' 500mg' ELSE '' END
  FROM docs JOIN part_names USING (k) WHERE t = 5 AND NOT failed AND k % 79 <> 0
  UNION ALL
  SELECT claim_id, document_id, 'PURCHASED', 'zz unlisted' FROM docs WHERE t = 5 AND NOT failed AND k % 79 <> 0 AND k % 73 = 0
),
medk AS (SELECT DISTINCT claim_id, side, medicine, regexp_replace(upper(medicine), '[^A-Z0-9]', '', 'g') AS mkey FROM med),
unmatched AS (
  SELECT b.claim_id, b.medicine FROM medk b
  WHERE b.side = 'PURCHASED' AND NOT EXISTS (
    SELECT 1 FROM medk p WHERE p.side = 'PRESCRIBED' AND p.claim_id = b.claim_id AND (contains(b.mkey, p.mkey) OR contains(p.mkey, b.mkey)))
)"""

FEATURES = """
v1 AS (
  SELECT claims.claim_id, string_agg(r.type, '|' ORDER BY r.type) FILTER (WHERE x.document_type IS NULL) AS missing
  FROM claims
  CROSS JOIN (SELECT unnest(['CLAIM_FORM', 'PRESCRIPTION', 'DISCHARGE_SUMMARY', 'HOSPITAL_INVOICE', 'PAYMENT_RECEIPT']) AS type) r
  LEFT JOIN (SELECT DISTINCT claim_id, document_type FROM vals) x ON x.claim_id = claims.claim_id AND x.document_type = r.type
  GROUP BY claims.claim_id
),
per_claim AS (
  SELECT claim_id, count(*) AS document_count, count(*) FILTER (WHERE nm IS NULL OR trim(nm) = '') AS missing_names,
         count(*) FILTER (WHERE nm IS NOT NULL AND regexp_replace(upper(nm), '[^A-Z0-9]', '', 'g') <> regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g')) AS name_mismatches,
         string_agg(document_type || ': ' || coalesce(nm, 'NOT EXTRACTED'), ' | ' ORDER BY document_type, nm) AS extracted_names,
         count(adm) AS admission_count, count(dis) AS discharge_count,
         count(DISTINCT adm) AS admission_variants, count(DISTINCT dis) AS discharge_variants,
         min(adm) AS min_admission, max(adm) AS max_admission, min(dis) AS min_discharge, max(dis) AS max_discharge,
         max(hospital) AS hospital_amount, max(pharmacy) AS pharmacy_amount, max(receipt) AS receipt_amount
  FROM vals GROUP BY claim_id
),
meds AS (
  SELECT claim_id,
         string_agg(medicine, '|' ORDER BY medicine) FILTER (WHERE side = 'PRESCRIBED') AS prescribed_items,
         string_agg(medicine, '|' ORDER BY medicine) FILTER (WHERE side = 'PURCHASED') AS purchased_items,
         count(DISTINCT mkey) FILTER (WHERE side = 'PRESCRIBED') AS prescribed_count,
         count(DISTINCT mkey) FILTER (WHERE side = 'PURCHASED') AS purchased_count
  FROM medk GROUP BY claim_id
),
um AS (SELECT claim_id, string_agg(medicine, '|' ORDER BY medicine) AS unmatched_items, count(*) AS unmatched_count FROM unmatched GROUP BY claim_id),
feat AS (
  SELECT claims.claim_id, claims.patient_name AS expected_name, claims.claimed_amount,
         coalesce(document_count, 0) AS document_count, coalesce(missing_names, 0) AS missing_names,
         coalesce(admission_count, 0) AS admission_count, coalesce(discharge_count, 0) AS discharge_count,
         coalesce(admission_variants, 0) AS admission_variants, coalesce(discharge_variants, 0) AS discharge_variants,
         min_admission, max_admission, min_discharge, max_discharge, hospital_amount, pharmacy_amount, receipt_amount,
         coalesce(name_mismatches, 0) AS name_mismatches, coalesce(extracted_names, '') AS extracted_names,
         coalesce(prescribed_items, '') AS prescribed_items, coalesce(purchased_items, '') AS purchased_items,
         coalesce(unmatched_items, '') AS unmatched_items,
         coalesce(prescribed_count, 0) AS prescribed_count, coalesce(purchased_count, 0) AS purchased_count,
         coalesce(unmatched_count, 0) AS unmatched_count, coalesce(missing, '') AS missing_types,
         CAST(coalesce(hospital_amount, 0) + coalesce(pharmacy_amount, 0) AS DECIMAL(18,2)) AS supported_amount,
         CAST(coalesce(claims.claimed_amount, 0) - coalesce(hospital_amount, 0) - coalesce(pharmacy_amount, 0) AS DECIMAL(18,2)) AS claim_difference,
         CAST(coalesce(receipt_amount, 0) - coalesce(hospital_amount, 0) - coalesce(pharmacy_amount, 0) AS DECIMAL(18,2)) AS receipt_difference
  FROM claims LEFT JOIN v1 USING (claim_id) LEFT JOIN per_claim USING (claim_id) LEFT JOIN meds USING (claim_id) LEFT JOIN um USING (claim_id)
)"""

# One arm per line with condition, status and message, as the checks have them.
LADDERS = {
    "DOCUMENT": (
        [("missing_types <> ''", "FAILED", "One or more mandatory documents are missing.")],
        "All mandatory documents are available.", "INFO",
    ),
    "IDENTITY": (
        [("document_count = 0", "WARNING", "No extracted documents are available for identity validation."),
         ("name_mismatches > 0", "FAILED", "Patient name does not match across all submitted documents."),
         ("missing_names > 0", "WARNING", "Patient name could not be extracted from one or more documents.")],
        "Patient name is consistent across the submitted documents.", "MEDIUM",
    ),
    "TREATMENT_DATE": (
        [("admission_count = 0 OR discharge_count = 0", "WARNING", "Admission or discharge date is missing from the extracted documents."),
         ("admission_variants > 1", "FAILED", "Admission date is inconsistent across the submitted documents."),
         ("discharge_variants > 1", "FAILED", "Discharge date is inconsistent across the submitted documents."),
         ("min_admission > max_discharge", "FAILED", "Admission date is later than discharge date.")],
        "Admission and discharge dates are consistent.", "INFO",
    ),
    "MEDICAL": (
        [("prescribed_count = 0 AND purchased_count = 0", "WARNING", "No medicines were extracted from either the prescription or pharmacy invoice."),
         ("prescribed_count = 0", "WARNING", "No medicines were extracted from the prescription."),
         ("purchased_count = 0", "WARNING", "No medicines were extracted from the pharmacy invoice."),
         ("unmatched_count > 0", "FAILED", "One or more purchased medicines were not found in the prescription.")],
        "All purchased medicines were found in the prescription.", "INFO",
    ),
    "FINANCIAL": (
        [("hospital_amount IS NULL", "WARNING", "Hospital invoice total could not be extracted."),
         ("abs(claim_difference) > 1.00", "FAILED", "Claimed amount does not match the supported invoice amount."),
         ("receipt_amount IS NULL", "WARNING", "Payment receipt amount could not be extracted."),
         ("abs(receipt_difference) > 1.00", "FAILED", "Payment receipt amount does not match the supported invoice amount.")],
        "Claimed amount, invoice totals and payment receipt are consistent.", "MEDIUM",
    ),
}
# Name, expectation and source documents of each check.
NAMES = {
    "DOCUMENT": ("Required documents available", "CAST(NULL AS VARCHAR)", "missing_types"),
    "IDENTITY": ("Patient identity consistency", "expected_name",
                 "'CLAIM_FORM|PRESCRIPTION|DISCHARGE_SUMMARY|HOSPITAL_INVOICE|PHARMACY_INVOICE|DIAGNOSTIC_REPORT|PAYMENT_RECEIPT'"),
    "TREATMENT_DATE": ("Admission and discharge date consistency",
                       "'Matching dates across claim form, discharge summary and hospital invoice'", "'CLAIM_FORM|DISCHARGE_SUMMARY|HOSPITAL_INVOICE'"),
    "MEDICAL": ("Prescription and pharmacy medicine match", "'All purchased medicines should be supported by the prescription.'",
                "'PRESCRIPTION|PHARMACY_INVOICE'"),
    "FINANCIAL": ("Claim amount reconciliation", "'Claimed and paid amounts should match supported invoice totals.'",
                  "'CLAIM_FORM|HOSPITAL_INVOICE|PHARMACY_INVOICE|PAYMENT_RECEIPT'"),
}


def _case(category, position, last):
    arms = " ".join(f"WHEN {arm[0]} THEN '{arm[position]}'" for arm in LADDERS[category][0])
    return f"CASE {arms} ELSE '{last}' END"


def _status(category):
    return _case(category, 1, "PASSED")


def _severity(status, passed):
    return f"CASE {status} WHEN 'FAILED' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' ELSE '{passed}' END"


def _with(*parts):
    """The CTEs; a query text that starts with a comma goes on with CTEs of its own."""
    return "WITH " + ",".join(parts) + "\n"


ALL_FEATURES = (ORDERS, CLAIMS, DOCS, VALUES, MEDICINES, FEATURES)


def _judged_columns(category):
    arms, otherwise, passed = LADDERS[category]
    status = _status(category)
    return (
        f"{status} AS validation_status, {_severity(status, passed)} AS severity, {status} <> 'PASSED' AS requires_review, "
        f"{_case(category, 2, otherwise)} AS validation_message"
    )


def _single(category, details):
    return _with(*ALL_FEATURES) + f"SELECT claim_id, {_judged_columns(category)}, {details} FROM feat"


# The recommendation and message texts in the results must match.
def _result_ctes():
    rows = [
        f"SELECT claim_id, '{category}' AS validation_category, '{name}' AS validation_name, {_judged_columns(category)}, "
        f"{expected} AS expected_value, {sources} AS source_documents FROM feat"
        for category, (name, expected, sources) in NAMES.items()
    ]
    checks = "checks AS (" + "\nUNION ALL\n".join(rows) + ")"
    summary = """
summary AS (
  SELECT claim_id, count(*) AS total_validations,
         count(*) FILTER (WHERE validation_status = 'PASSED') AS passed_validations,
         count(*) FILTER (WHERE validation_status = 'WARNING') AS warning_validations,
         count(*) FILTER (WHERE validation_status = 'FAILED') AS failed_validations,
         count(*) FILTER (WHERE validation_status = 'FAILED' AND validation_category = 'MEDICAL') AS medical_failed,
         count(*) FILTER (WHERE validation_status = 'FAILED' AND validation_category = 'FINANCIAL') AS financial_failed,
         count(*) FILTER (WHERE validation_status = 'FAILED' AND validation_category IN ('DOCUMENT', 'IDENTITY', 'TREATMENT_DATE')) AS other_failed
  FROM checks GROUP BY claim_id
),
recommended AS (
  SELECT *, CASE WHEN medical_failed > 0 THEN 'MEDICAL_REVIEW_REQUIRED' WHEN financial_failed > 0 THEN 'FINANCIAL_REVIEW_REQUIRED'
                 WHEN other_failed > 0 THEN 'MORE_INFORMATION_REQUIRED' WHEN warning_validations > 0 THEN 'MANUAL_REVIEW_REQUIRED'
                 ELSE 'READY_FOR_APPROVAL' END AS recommendation
  FROM summary
),
results AS (
  SELECT claim_id, validation_category, validation_name, validation_status, severity, requires_review, validation_message, expected_value, source_documents FROM checks
  UNION ALL
  SELECT claim_id, 'CLAIM_DECISION', 'Overall claim validation',
         CASE WHEN failed_validations > 0 THEN 'FAILED' WHEN warning_validations > 0 THEN 'WARNING' ELSE 'PASSED' END,
         CASE WHEN failed_validations > 0 THEN 'HIGH' WHEN warning_validations > 0 THEN 'MEDIUM' ELSE 'INFO' END,
         failed_validations > 0 OR warning_validations > 0,
         CASE recommendation
              WHEN 'MEDICAL_REVIEW_REQUIRED' THEN 'Medical validation failed. The claim requires medical review.'
              WHEN 'FINANCIAL_REVIEW_REQUIRED' THEN 'Financial validation failed. The claim requires financial review.'
              WHEN 'MORE_INFORMATION_REQUIRED' THEN 'Required information is missing or inconsistent.'
              WHEN 'MANUAL_REVIEW_REQUIRED' THEN 'The claim contains warnings that require manual review.'
              ELSE 'All completed validations passed. The claim is ready for approval.' END,
         'All mandatory claim validations should pass.', 'ALL_SUBMITTED_DOCUMENTS'
  FROM recommended
)"""
    return checks, summary


RESULTS = (*ALL_FEATURES, *_result_ctes())

FILES = """
files AS (
  SELECT event_id, ts, event_type, CASE WHEN event_id % 33 = 0 THEN '' ELSE 'u' || user_id || '/' END
      || (['claim_form', 'prescription', 'discharge_summary', 'hospital_invoice', 'pharmacy_bill', 'lab_report', 'payment_receipt',
           'receipt', 'pharmacy_receipt', 'claim_information', 'notes', 'hospital_discharge_summary'])[event_id % 12 + 1]
      || CASE WHEN event_id % 10 = 0 THEN '.txt' WHEN event_id % 4 = 0 THEN '.PNG' ELSE '.pdf' END AS relative_path,
      user_id
  FROM events
),
listed AS (
  SELECT *, 'u' || user_id AS folder, split_part(relative_path, '/', -1) AS file_name,
         regexp_matches(lower(relative_path), '[.](pdf|png|jpg|jpeg)$') AS supported
  FROM files WHERE event_id % 33 <> 0
)"""

# What the classifier makes of the twelve names, by rule: claim & form, prescription, discharge & summary, ...
EVENT_TYPES = """(['CLAIM_FORM', 'PRESCRIPTION', 'DISCHARGE_SUMMARY', 'HOSPITAL_INVOICE', 'PHARMACY_INVOICE', 'DIAGNOSTIC_REPORT', 'PAYMENT_RECEIPT',
           'PAYMENT_RECEIPT', 'PHARMACY_INVOICE', 'CLAIM_FORM', 'OTHER', 'DISCHARGE_SUMMARY'])[event_id % 12 + 1]"""


def _clean(text):
    return f"regexp_replace(regexp_replace({text}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"


SUBMISSIONS = """
subs AS (
  SELECT c_custkey AS submission_id, CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE c_name END AS patient_name,
         CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment || ' #' || c_custkey END AS claim_reference
  FROM customer
)"""

# The claim folders with their gaps, and the payload of every file.
# The messages of folders that cannot be loaded must match.
LOAD = """
form AS (
  SELECT *, k % 97 <> 0 AS has_form,
         CASE WHEN k % 89 = 0 THEN 'error' WHEN k % 101 = 0 THEN 'empty' WHEN k % 103 = 0 THEN 'no id' ELSE 'ok' END AS form_state
  FROM o
),
listing AS (
  SELECT k, folder, document_type, failed, t, (t = 7 AND k % 77 = 0) OR (t = 3 AND k % 83 = 0) AS unusable FROM docs WHERE t > 1 OR k % 97 <> 0
  UNION ALL SELECT k, folder, 'OTHER', false, 0, false FROM o WHERE k % 97 <> 0 AND k % 6 = 0
  UNION ALL SELECT k, folder, 'CLAIM_FORM', false, 1, false FROM o WHERE k % 97 <> 0 AND k % 33 = 0
),
heads AS (
  SELECT folder, k, CASE WHEN has_form THEN folder || '/claim_form.pdf' END AS form_path,
         CASE WHEN NOT has_form THEN 'claim_form.pdf was not found.' WHEN form_state = 'error' THEN 'Claim-form extraction failed.'
              WHEN form_state = 'empty' THEN 'Claim-form extraction returned no response.'
              WHEN form_state = 'no id' THEN 'Claim ID could not be extracted.' END AS message,
         has_form AND form_state IN ('ok', 'no id') AS has_response,
         CASE WHEN has_form AND form_state = 'ok' THEN claim_id END AS claim_id,
         'PAT-' || o_custkey AS patient_id, upper(c_name) || '.' AS patient_name, 'POL-' || (k % 1000) AS policy_number,
         CASE WHEN k % 17 = 0 THEN 'UNKNOWN' ELSE o_orderpriority END AS claim_type,
         CAST((cents + CASE WHEN k % 11 = 0 THEN 500 WHEN k % 11 = 1 THEN 100 ELSE 0 END) * 0.01 AS DECIMAL(18,2)) AS claimed_amount,
         CASE WHEN has_form AND form_state = 'error' THEN 'unreadable' END AS error_message
  FROM form WHERE folder IN (SELECT folder FROM listing)
),
tallied AS (
  SELECT folder, count(*) FILTER (WHERE document_type <> 'OTHER') AS found,
         count(*) FILTER (WHERE document_type <> 'OTHER' AND NOT failed AND NOT unusable) AS done,
         count(*) FILTER (WHERE document_type <> 'OTHER' AND (failed OR unusable)) AS bad,
         count(*) FILTER (WHERE document_type = 'OTHER') AS skipped
  FROM listing GROUP BY folder
)"""

ORACLES = {
    "list_documents": _with(FILES) + "SELECT event_id, relative_path, folder, file_name FROM listed WHERE supported",
    "normalize_paths": _with(FILES) + """
        SELECT event_id, CASE WHEN event_id % 33 = 0 THEN relative_path ELSE 'u' || user_id END AS folder_path FROM files""",
    "find_claim_forms": _with(FILES) + """
        SELECT folder, min(relative_path) AS form_path FROM listed WHERE contains(file_name, 'claim') AND contains(file_name, 'form') GROUP BY folder""",
    "classify_documents": _with(FILES) + f"""
        SELECT event_id, file_name, {EVENT_TYPES} AS document_type,
               CASE WHEN {EVENT_TYPES} <> 'OTHER' THEN {EVENT_TYPES} || '_V1' END AS template_id FROM listed WHERE supported""",
    "new_folders": _with(FILES) + "SELECT DISTINCT folder FROM listed WHERE supported AND event_type <> 'error'",
    "folders_to_reload": _with(FILES) + """
        SELECT event_id, relative_path, folder FROM listed WHERE folder IN (
          SELECT folder FROM listed WHERE supported AND event_type <> 'error' AND ts >= TIMESTAMP '2024-01-25')""",
    "pending_files": _with(FILES) + """
        SELECT DISTINCT relative_path FROM files WHERE event_type <> 'error'
          AND relative_path NOT IN (SELECT relative_path FROM files WHERE ts < TIMESTAMP '2024-01-16')""",
    "sanitize_names": _with(SUBMISSIONS) + f"""
        SELECT 'submission' AS kind, submission_id AS id, {_clean('patient_name')} || '_' || {_clean('claim_reference')} AS safe_name FROM subs
        UNION ALL SELECT 'page', page_id, {_clean('url')} FROM pages""",
    # The reasons against a submission must match.
    "check_submissions": _with(ORDERS, DOCS, SUBMISSIONS) + f""",
        counted AS (
          SELECT o_custkey AS submission_id, count(*) FILTER (WHERE t > 1 OR o_custkey % 23 <> 0) AS files,
                 count(*) FILTER (WHERE t = 1 AND o_custkey % 23 <> 0) AS forms FROM docs GROUP BY o_custkey
        ),
        judged AS (
          SELECT submission_id, coalesce(files, 0) AS file_count,
                 CASE WHEN trim(patient_name) = '' THEN 'Enter the patient name.' WHEN trim(claim_reference) = '' THEN 'Enter the claim reference.'
                      WHEN coalesce(files, 0) = 0 THEN 'Upload at least one document.'
                      WHEN forms = 0 THEN 'A claim form is required before submission.' END AS reason,
                 {_clean('patient_name')} || '_' || {_clean('claim_reference')} AS f
          FROM subs LEFT JOIN counted USING (submission_id)
        )
        SELECT submission_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN f END AS folder, file_count FROM judged""",
    "resolve_templates": """
        WITH active AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part WHERE p_size % 3 <> 0),
        asked AS (SELECT p_brand, count(*) AS requests FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
        SELECT asked.p_brand AS template_id, CAST(active.p_partkey AS INTEGER) AS template_version, active.p_type AS document_type,
               active.p_name AS template_description, requests
        FROM asked LEFT JOIN active ON active.p_brand = asked.p_brand AND n = 1""",
    "extract_fields": """
        SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), '') AS email,
               nullif(regexp_extract(text, '[0-9]{16}'), '') AS card_number,
               nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), '') AS secret, 'EXTRACTED' AS extraction_status
        FROM documents""",
    "extract_isolated": """
        SELECT doc_id, CASE WHEN ok THEN nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), '') END AS email,
               CASE WHEN ok THEN nullif(regexp_extract(text, '[0-9]{16}'), '') END AS card_number,
               CASE WHEN ok THEN nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), '') END AS secret,
               CASE WHEN ok THEN 'EXTRACTED' ELSE 'FAILED' END AS extraction_status,
               CASE WHEN NOT known THEN '{"code":"LookupError","message":"unknown template"}'
                    WHEN NOT ok THEN '{"code":"ValueError","message":"too short"}' END AS error_message
        FROM (SELECT *, coalesce(lang, '') <> 'fr' AS known, known AND length(text) >= 400 AS ok FROM documents)""",
    "extract_fields_adhoc": """
        SELECT doc_id, nullif(regexp_extract(text, '[0-9]+'), '') AS first_number,
               nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), '') AS secret,
               nullif(regexp_extract(text, '[A-Z]{4,}'), '') AS shouted FROM documents""",
    "parse_layout": r"""
        WITH visible AS (
          SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS h FROM pages
        ),
        pieces AS (
          SELECT page_id, string_split(regexp_replace(h, '(?s)<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM visible
        ),
        numbered AS (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM pieces),
        cleaned AS (
          SELECT page_id, pos, CASE WHEN pos > 1 THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag,
                 trim(CASE WHEN pos > 1 THEN split_part(piece, chr(2), 2) ELSE piece END, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM numbered
        )
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block_no,
               CASE WHEN tag = 'title' THEN 'TITLE' WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'HEADING' WHEN tag = 'p' THEN 'PARAGRAPH'
                    WHEN tag = 'li' THEN 'LIST_ITEM' WHEN tag IN ('td', 'th') THEN 'TABLE_CELL' WHEN tag = 'a' THEN 'LINK'
                    WHEN tag = 'footer' THEN 'FOOTER' ELSE 'TEXT' END AS block_type, text
        FROM cleaned WHERE text <> ''""",
    "split_envelope": _with(ORDERS, DOCS, ATTEMPTS) + """
        SELECT extraction_id, CASE WHEN attempt_failed THEN 'FAILED' ELSE 'EXTRACTED' END AS extraction_status,
               NOT attempt_failed AS has_response,
               CASE WHEN attempt_failed THEN NULL WHEN a = 1 THEN 'Stale Person' WHEN t = 6 AND k % 8 = 0 THEN NULL
                    WHEN t = 2 AND k % 37 = 0 THEN 'Other Person' WHEN t = 7 AND k % 41 = 0 THEN '  ' ELSE upper(c_name) || '.' END AS patient_name,
               CASE WHEN NOT attempt_failed AND a = 0 AND t = 6 AND k % 16 = 0 THEN 'no structured result' END AS wrapped_value,
               CASE WHEN attempt_failed THEN 'extraction timed out' END AS error_text,
               CAST(CASE WHEN attempt_failed AND k % 2 = 0 THEN 504 END AS BIGINT) AS error_code
        FROM attempts""",
    "line_items": _with(ORDERS, DOCS, MEDICINES) + """,
        numbered AS (SELECT k, p_name, row_number() OVER (PARTITION BY k ORDER BY p_name) AS n FROM part_names),
        sizes AS (SELECT docs.*, coalesce(c, 0) AS c FROM docs LEFT JOIN (SELECT k, count(*) AS c FROM part_names GROUP BY k) s USING (k) WHERE NOT failed)
        SELECT document_id, n AS item_no, p_name AS medicine_name, CAST(n AS VARCHAR) AS detail FROM sizes JOIN numbered USING (k) WHERE t = 2
        UNION ALL
        SELECT document_id, n, CASE WHEN k % 79 <> 0 THEN p_name || CASE WHEN k % 2 = 0 THEN ' 500mg' ELSE '' END END, CAST(n AS VARCHAR)
        FROM sizes JOIN numbered USING (k) WHERE t = 5
        UNION ALL SELECT document_id, c + 1, 'zz unlisted', NULL FROM sizes WHERE t = 5 AND k % 79 <> 0 AND k % 73 = 0
        UNION ALL SELECT document_id, c + 1 + CASE WHEN k % 73 = 0 THEN 1 ELSE 0 END, NULL, NULL FROM sizes WHERE t = 5 AND k % 79 <> 0 AND k % 5 = 0""",
    "extraction_scores": _with(ORDERS, DOCS) + """
        SELECT document_id, field, ((k + t) % 100) / 100.0::DOUBLE AS score
        FROM docs, (SELECT unnest(['patient_name', 'admission_date', 'discharge_date', 'claimed_amount', 'invoice_total', 'amount_paid']) AS field)
        WHERE NOT failed AND (field = 'patient_name' OR (field IN ('admission_date', 'discharge_date') AND t IN (1, 3, 4))
           OR (field = 'claimed_amount' AND t = 1) OR (field = 'invoice_total' AND t IN (4, 5)) OR (field = 'amount_paid' AND t = 7))""",
    "flatten_medicines": _with(ORDERS, DOCS, MEDICINES) + "SELECT claim_id, document_id, side, medicine FROM med",
    "latest_extractions": _with(ORDERS, DOCS) + """
        SELECT claim_id, document_id, document_id || '-0' AS extraction_id, document_type, 'EXTRACTED' AS extraction_status FROM docs WHERE NOT failed""",
    "current_documents": _with(ORDERS, DOCS, ATTEMPTS) + """
        SELECT folder || '/' || file_name AS relative_path, document_id || '-' || CASE WHEN max(a) = 2 THEN 2 ELSE 0 END AS document_id
        FROM attempts GROUP BY folder, file_name, document_id""",
    "upsert_claims": _with(ORDERS, CLAIMS) + """
        SELECT claim_id, patient_id, CASE WHEN hit THEN upper(patient_name) ELSE patient_name END AS patient_name, policy_number,
               CASE WHEN hit THEN 'RELOADED' ELSE claim_type END AS claim_type,
               CAST(CASE WHEN hit THEN claimed_amount + 1 ELSE claimed_amount END AS DECIMAL(18,2)) AS claimed_amount,
               CASE WHEN hit THEN 'PROCESSING' ELSE claim_status END AS claim_status,
               CASE WHEN NOT hit THEN reviewer_decision END AS reviewer_decision, CASE WHEN NOT hit THEN reviewer_comments END AS reviewer_comments,
               CASE WHEN created_at < TIMESTAMP '1998-01-01' THEN created_at ELSE TIMESTAMP '2024-01-31' END AS created_at,
               CASE WHEN NOT hit THEN reviewed_at END AS reviewed_at
        FROM (SELECT *, created_at >= TIMESTAMP '1996-01-01' AS hit FROM claims)""",
    "upsert_documents": _with(ORDERS, DOCS) + """
        SELECT CASE WHEN fresh THEN 'new-' || document_id ELSE document_id END AS document_id, claim_id,
               CASE WHEN hit THEN upper(file_name) ELSE file_name END AS file_name, folder || '/' || file_name AS relative_path, document_type,
               document_type || CASE WHEN hit THEN '_V2' ELSE '_V1' END AS template_id,
               CASE WHEN hit THEN 'EXTRACTING' WHEN failed THEN 'FAILED' ELSE 'EXTRACTED' END AS processing_status,
               CASE WHEN NOT hit AND failed THEN 'extraction timed out' END AS error_message,
               CASE WHEN fresh THEN TIMESTAMP '2024-01-31' ELSE CAST(d AS TIMESTAMP) END AS uploaded_at,
               CASE WHEN NOT hit THEN CAST(d AS TIMESTAMP) END AS processed_at
        FROM (SELECT *, d >= DATE '1996-01-01' AS hit, d >= DATE '1998-01-01' AS fresh FROM docs)""",
    "replace_by_key": _with(ORDERS, DOCS) + """
        SELECT claim_id, document_type, CASE WHEN o_orderstatus = 'F' THEN 'replaced' ELSE folder || '/' || file_name END AS relative_path
        FROM docs WHERE o_orderstatus <> 'F' OR t = 1""",
    "apply_updates": _with(ORDERS, CLAIMS) + """
        SELECT claims.claim_id, CASE WHEN o_orderstatus = 'P' THEN 'PENDING_ORDER' ELSE claim_status END AS claim_status,
               CASE WHEN o_orderstatus <> 'P' THEN reviewer_decision END AS reviewer_decision, reviewer_comments
        FROM claims JOIN o USING (claim_id)""",
    "claim_headers": _with(ORDERS, DOCS, LOAD) + """
        SELECT folder, form_path, claim_id, CASE WHEN has_response THEN patient_id END AS patient_id,
               CASE WHEN has_response THEN patient_name END AS patient_name, CASE WHEN has_response THEN policy_number END AS policy_number,
               CASE WHEN has_response THEN claim_type ELSE 'UNKNOWN' END AS claim_type,
               CASE WHEN has_response THEN claimed_amount END AS claimed_amount, message, error_message FROM heads""",
    "folder_load_summary": _with(ORDERS, DOCS, LOAD) + """
        SELECT folder, CASE WHEN message IS NOT NULL THEN 'FAILED' WHEN coalesce(bad, 0) = 0 THEN 'SUCCESS' ELSE 'COMPLETED_WITH_ERRORS' END AS load_status,
               message, CASE WHEN message IS NULL THEN claim_id END AS claim_id, CASE WHEN message IS NULL THEN patient_id END AS patient_id,
               CASE WHEN message IS NULL THEN patient_name END AS patient_name, CASE WHEN message IS NULL THEN policy_number END AS policy_number,
               CASE WHEN message IS NULL THEN claim_type END AS claim_type, CASE WHEN message IS NULL THEN claimed_amount END AS claimed_amount,
               CASE WHEN message IS NULL THEN found ELSE 0 END AS documents_found, CASE WHEN message IS NULL THEN done ELSE 0 END AS documents_extracted,
               CASE WHEN message IS NULL THEN bad ELSE 0 END AS documents_failed, CASE WHEN message IS NULL THEN skipped ELSE 0 END AS documents_skipped,
               CASE WHEN message IS NULL THEN CASE WHEN found = 0 THEN 'NO_SUPPORTED_DOCUMENTS' WHEN bad > 0 AND done > 0 THEN 'EXTRACTION_COMPLETED_WITH_ERRORS'
                    WHEN bad > 0 THEN 'EXTRACTION_FAILED' ELSE 'EXTRACTION_COMPLETED' END END AS claim_status
        FROM heads LEFT JOIN tallied USING (folder)""",
    "missing_documents": _with(ORDERS, CLAIMS, DOCS) + """
        SELECT claim_id, type AS document_type FROM claims,
          (SELECT unnest(['CLAIM_FORM', 'PRESCRIPTION', 'DISCHARGE_SUMMARY', 'HOSPITAL_INVOICE', 'PAYMENT_RECEIPT']) AS type) r
        WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.claim_id = claims.claim_id AND docs.document_type = r.type AND NOT failed)""",
    "unmatched_medicines": _with(ORDERS, DOCS, MEDICINES) + "SELECT claim_id, medicine FROM unmatched",
    "claim_features": _with(*ALL_FEATURES) + """
        SELECT claim_id, expected_name, claimed_amount, document_count, missing_names, admission_count, discharge_count, admission_variants,
               discharge_variants, min_admission, max_admission, min_discharge, max_discharge, hospital_amount, pharmacy_amount, receipt_amount,
               name_mismatches, extracted_names, prescribed_items, purchased_items, unmatched_items, prescribed_count, purchased_count,
               unmatched_count, missing_types FROM feat""",
    "validate_required_documents": _single("DOCUMENT", "missing_types"),
    "validate_identity": _single(
        "IDENTITY", "expected_name AS expected_value, extracted_names AS actual_value, document_count, missing_names, name_mismatches"),
    "validate_dates": _single(
        "TREATMENT_DATE", "admission_count, discharge_count, admission_variants, discharge_variants, min_admission, max_admission, min_discharge, max_discharge"),
    "validate_financial": _single(
        "FINANCIAL", "claimed_amount, hospital_amount, pharmacy_amount, receipt_amount, supported_amount, claim_difference, receipt_difference"),
    "validate_medicines": _single(
        "MEDICAL", "prescribed_items, purchased_items, unmatched_items, prescribed_count, purchased_count, unmatched_count"),
    "validate_claims": _with(*RESULTS) + """
        SELECT claim_id, validation_category, validation_name, validation_status, expected_value, validation_message, severity, requires_review,
               source_documents FROM results""",
    "validation_values": _with(*RESULTS) + """,
        picked AS (
          SELECT claim_id, 'DOCUMENT' AS validation_category,
                 '[' || CASE WHEN missing_types = '' THEN '' ELSE '"' || replace(missing_types, '|', '","') || '"' END || ']' AS first_value,
                 CAST(NULL AS VARCHAR) AS second_value, CAST(NULL AS VARCHAR) AS third_value FROM feat
          UNION ALL SELECT claim_id, 'IDENTITY', NULL, NULL, NULL FROM feat
          UNION ALL SELECT claim_id, 'TREATMENT_DATE', CAST(min_admission AS VARCHAR), CAST(max_discharge AS VARCHAR), CAST(admission_variants AS VARCHAR) FROM feat
          UNION ALL SELECT claim_id, 'FINANCIAL', CAST(supported_amount AS VARCHAR), CAST(claim_difference AS VARCHAR), CAST(receipt_amount AS VARCHAR) FROM feat
          UNION ALL SELECT claim_id, 'MEDICAL', CAST(prescribed_count AS VARCHAR),
                 '[' || CASE WHEN purchased_items = '' THEN '' ELSE '"' || replace(purchased_items, '|', '","') || '"' END || ']',
                 '[' || CASE WHEN unmatched_items = '' THEN '' ELSE '"' || replace(unmatched_items, '|', '","') || '"' END || ']' FROM feat
          UNION ALL SELECT claim_id, 'CLAIM_DECISION', recommendation, CAST(failed_validations AS VARCHAR), CAST(warning_validations AS VARCHAR) FROM recommended
        )
        SELECT * FROM picked""",
    "claim_evidence": _with(ORDERS, DOCS, VALUES, MEDICINES) + """
        SELECT claim_id, 'NAME' AS kind, document_id AS source, document_type || ': ' || coalesce(nm, 'NOT EXTRACTED') AS item FROM vals
        UNION ALL SELECT claim_id, side, NULL, medicine FROM medk""",
    "validation_summary": _with(*RESULTS) + """
        SELECT claim_id, 'SUCCESS' AS status, recommendation, total_validations, failed_validations,
               max(validation_status) FILTER (WHERE validation_category = 'DOCUMENT') AS document_status,
               max(validation_status) FILTER (WHERE validation_category = 'IDENTITY') AS identity_status,
               max(validation_status) FILTER (WHERE validation_category = 'TREATMENT_DATE') AS date_status,
               max(validation_status) FILTER (WHERE validation_category = 'MEDICAL') AS medical_status,
               max(validation_status) FILTER (WHERE validation_category = 'FINANCIAL') AS financial_status,
               max(validation_message) FILTER (WHERE validation_category = 'FINANCIAL') AS financial_message
        FROM checks JOIN recommended USING (claim_id) GROUP BY ALL""",
    "validate_requested": _with(*RESULTS) + """
        SELECT results.claim_id, validation_category, validation_status, severity, validation_message
        FROM results JOIN o USING (claim_id) WHERE o_orderstatus = 'O'""",
    "folder_failures": _with(ORDERS, CLAIMS) + """
        SELECT claims.claim_id, CASE WHEN o_orderstatus = 'F' THEN 'EXTRACTION_FAILED' ELSE claim_status END AS claim_status,
               CASE WHEN o_orderstatus = 'F' THEN 'Folder processing error: broken off at ' || k ELSE reviewer_comments END AS reviewer_comments
        FROM claims JOIN o USING (claim_id)""",
    "claim_tables_current": _with(ORDERS, CLAIMS, DOCS) + """
        SELECT d.claim_id, documents,
               CASE WHEN k % 7 = 0 THEN 'REJECTED' WHEN k % 5 = 0 THEN 'APPROVED' ELSE claim_status END AS claim_status,
               CASE WHEN k % 7 = 0 THEN 'REJECTED' WHEN k % 5 = 0 THEN 'APPROVED' ELSE reviewer_decision END AS reviewer_decision
        FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'M-' ELSE '' END || claim_id AS claim_id, count(*) AS documents FROM docs GROUP BY 1) d
        LEFT JOIN (SELECT claims.*, k FROM claims JOIN o USING (claim_id)) c ON c.claim_id = d.claim_id""",
    "consolidate_claims": _with(*RESULTS) + "SELECT * FROM recommended",
    "validation_requests": _with(*RESULTS) + """
        SELECT claim_id, 'SUCCESS' AS request_status, CAST(NULL AS VARCHAR) AS message, recommendation, total_validations
        FROM recommended JOIN o USING (claim_id) WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'X-' || claim_id, 'FAILED', 'Claim ID was not found.', NULL, NULL FROM o WHERE o_orderstatus = 'O'""",
    "claim_worklist": _with(ORDERS, CLAIMS) + """
        SELECT claim_id, claim_status, CASE claim_status WHEN 'EXTRACTION_COMPLETED' THEN 'DONE' WHEN 'PROCESSING' THEN 'IN_PROGRESS'
               WHEN 'MANUAL_REVIEW_REQUIRED' THEN 'MANUAL_REVIEW' ELSE 'INFO' END AS status_group, created_at FROM claims""",
    "search_claims": _with(ORDERS, CLAIMS) + """
        SELECT claim_id, patient_name, claim_status FROM claims WHERE claim_status = 'PROCESSING'
          AND (contains(claim_id, '00000012') OR contains(patient_name, '00000012') OR contains(patient_id, '00000012'))""",
    "status_options": _with(ORDERS, CLAIMS) + "SELECT DISTINCT claim_status FROM claims WHERE claim_status IS NOT NULL",
    "claim_documents_view": _with(ORDERS, DOCS) + """
        SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY t, file_name) AS position, CAST(t AS INTEGER) AS type_rank, file_name, document_type, CASE WHEN failed THEN 'FAILED' ELSE 'EXTRACTED' END AS processing_status,
               CASE WHEN failed THEN 'extraction timed out' END AS error_message FROM docs""",
    "claim_validations_view": _with(*RESULTS) + """
        SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY status_rank, validation_category) AS position FROM (
          SELECT claim_id, CASE validation_status WHEN 'FAILED' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'PASSED' THEN 3 ELSE 4 END AS status_rank,
                 validation_category, validation_status, severity FROM results)""",
    "validation_counts": _with(*RESULTS) + """
        SELECT claim_id, passed_validations AS passed_checks, warning_validations AS warnings, failed_validations AS failed_checks FROM summary""",
    "open_issues": _with(*RESULTS) + """
        SELECT claim_id, validation_category, validation_status, validation_message FROM checks WHERE validation_status IN ('FAILED', 'WARNING')""",
    "related_documents": _with(*RESULTS) + """
        SELECT docs.claim_id, validation_category, document_type, file_name, folder || '/' || file_name AS relative_path
        FROM results JOIN docs ON docs.claim_id = results.claim_id AND contains('|' || source_documents || '|', '|' || document_type || '|')""",
    "parse_source_documents": _with(ORDERS) + """
        SELECT claim_id, CASE k % 5 WHEN 0 THEN 'CLAIM_FORM|' || o_orderpriority WHEN 1 THEN 'CLAIM_FORM|' || o_orderpriority
               WHEN 2 THEN c_name || '|OTHER' ELSE '' END AS source_documents FROM o""",
    "apply_reviewer_decisions": _with(ORDERS, CLAIMS) + """,
        asked AS (
          SELECT claim_id, k, d, CASE WHEN k % 83 = 0 THEN 'MAYBE' ELSE (['PENDING', 'APPROVED', 'REJECTED', 'MORE_INFORMATION_REQUIRED',
                   'MEDICAL_REVIEW_REQUIRED', 'FINANCIAL_REVIEW_REQUIRED'])[k % 6 + 1] END AS decision,
                 CASE WHEN k % 7 = 0 THEN ' ' ELSE 'ok ' || k END AS comments FROM o
        ),
        judged AS (
          SELECT *, CASE WHEN decision = 'PENDING' THEN 'Select a final reviewer decision.' WHEN decision = 'MAYBE' THEN 'Unknown decision.'
                         WHEN trim(comments) = '' THEN 'Add reviewer comments before saving the decision.' END AS reason FROM asked
        )
        SELECT claim_id, CASE WHEN reason IS NULL THEN decision ELSE claim_status END AS claim_status,
               CASE WHEN reason IS NULL THEN decision ELSE reviewer_decision END AS reviewer_decision,
               CASE WHEN reason IS NULL THEN comments ELSE reviewer_comments END AS reviewer_comments,
               CASE WHEN reason IS NULL THEN CAST(d + 30 AS TIMESTAMP) ELSE reviewed_at END AS reviewed_at, reason
        FROM claims JOIN judged USING (claim_id)""",
    "run_history": """
        SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS state,
               ts AS scheduled_at, CASE WHEN event_type = 'error' THEN 'error in ' || props END AS error_message
        FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR ORDER BY ts DESC, event_id LIMIT 20""",
    "run_summary": """
        WITH x AS (
          SELECT strftime(ts, '%Y-%m-%d') AS run_id, ts, 'u' || user_id AS folder, event_type IN ('purchase', 'click') AS done,
                 CASE WHEN event_type = 'error' THEN 'broken off at ' || event_id END AS raised FROM events
        )
        SELECT run_id, CASE WHEN count(*) FILTER (WHERE NOT done) = 0 THEN 'SUCCESS' ELSE 'COMPLETED_WITH_ERRORS' END AS status,
               count(*) FILTER (WHERE done) AS folders_processed, count(*) FILTER (WHERE NOT done) AS folders_failed,
               arg_max(raised, ts) FILTER (WHERE raised IS NOT NULL) AS last_error
        FROM x GROUP BY run_id""",
}

# Fields of the built-in templates by document type, with their kind and the number of table columns.
CATALOG = (
    ("CLAIM_FORM", "claim_id", "string", 0),
    ("CLAIM_FORM", "patient_id", "string", 0),
    ("CLAIM_FORM", "patient_name", "string", 0),
    ("CLAIM_FORM", "policy_number", "string", 0),
    ("CLAIM_FORM", "insurance_provider", "string", 0),
    ("CLAIM_FORM", "claim_type", "string", 0),
    ("CLAIM_FORM", "hospital_name", "string", 0),
    ("CLAIM_FORM", "admission_date", "string", 0),
    ("CLAIM_FORM", "discharge_date", "string", 0),
    ("CLAIM_FORM", "primary_diagnosis", "string", 0),
    ("CLAIM_FORM", "claimed_amount", "string", 0),
    ("CLAIM_FORM", "patient_signature_present", "string", 0),
    ("PRESCRIPTION", "patient_name", "string", 0),
    ("PRESCRIPTION", "patient_age", "string", 0),
    ("PRESCRIPTION", "doctor_name", "string", 0),
    ("PRESCRIPTION", "hospital_or_clinic", "string", 0),
    ("PRESCRIPTION", "prescription_date", "string", 0),
    ("PRESCRIPTION", "diagnosis", "string", 0),
    ("PRESCRIPTION", "follow_up_instructions", "string", 0),
    ("PRESCRIPTION", "doctor_signature_present", "string", 0),
    ("PRESCRIPTION", "medicines", "object", 6),
    ("DISCHARGE_SUMMARY", "patient_name", "string", 0),
    ("DISCHARGE_SUMMARY", "patient_id", "string", 0),
    ("DISCHARGE_SUMMARY", "hospital_name", "string", 0),
    ("DISCHARGE_SUMMARY", "admission_date", "string", 0),
    ("DISCHARGE_SUMMARY", "discharge_date", "string", 0),
    ("DISCHARGE_SUMMARY", "attending_doctor", "string", 0),
    ("DISCHARGE_SUMMARY", "primary_diagnosis", "string", 0),
    ("DISCHARGE_SUMMARY", "clinical_summary", "string", 0),
    ("DISCHARGE_SUMMARY", "procedures_performed", "array", 0),
    ("DISCHARGE_SUMMARY", "discharge_medications", "array", 0),
    ("DISCHARGE_SUMMARY", "follow_up_advice", "string", 0),
    ("DISCHARGE_SUMMARY", "discharge_condition", "string", 0),
    ("HOSPITAL_INVOICE", "invoice_number", "string", 0),
    ("HOSPITAL_INVOICE", "claim_id", "string", 0),
    ("HOSPITAL_INVOICE", "patient_name", "string", 0),
    ("HOSPITAL_INVOICE", "patient_id", "string", 0),
    ("HOSPITAL_INVOICE", "hospital_name", "string", 0),
    ("HOSPITAL_INVOICE", "admission_date", "string", 0),
    ("HOSPITAL_INVOICE", "discharge_date", "string", 0),
    ("HOSPITAL_INVOICE", "diagnosis", "string", 0),
    ("HOSPITAL_INVOICE", "subtotal", "string", 0),
    ("HOSPITAL_INVOICE", "discount", "string", 0),
    ("HOSPITAL_INVOICE", "tax_amount", "string", 0),
    ("HOSPITAL_INVOICE", "invoice_total", "string", 0),
    ("HOSPITAL_INVOICE", "invoice_items", "object", 4),
    ("PHARMACY_INVOICE", "invoice_number", "string", 0),
    ("PHARMACY_INVOICE", "claim_id", "string", 0),
    ("PHARMACY_INVOICE", "patient_name", "string", 0),
    ("PHARMACY_INVOICE", "pharmacy_name", "string", 0),
    ("PHARMACY_INVOICE", "invoice_date", "string", 0),
    ("PHARMACY_INVOICE", "prescribing_doctor", "string", 0),
    ("PHARMACY_INVOICE", "invoice_total", "string", 0),
    ("PHARMACY_INVOICE", "medicine_items", "object", 5),
    ("DIAGNOSTIC_REPORT", "patient_name", "string", 0),
    ("DIAGNOSTIC_REPORT", "patient_id", "string", 0),
    ("DIAGNOSTIC_REPORT", "laboratory_name", "string", 0),
    ("DIAGNOSTIC_REPORT", "ordering_doctor", "string", 0),
    ("DIAGNOSTIC_REPORT", "report_date", "string", 0),
    ("DIAGNOSTIC_REPORT", "diagnosis", "string", 0),
    ("DIAGNOSTIC_REPORT", "clinical_interpretation", "string", 0),
    ("DIAGNOSTIC_REPORT", "test_results", "object", 4),
    ("PAYMENT_RECEIPT", "receipt_number", "string", 0),
    ("PAYMENT_RECEIPT", "claim_id", "string", 0),
    ("PAYMENT_RECEIPT", "patient_name", "string", 0),
    ("PAYMENT_RECEIPT", "hospital_invoice_number", "string", 0),
    ("PAYMENT_RECEIPT", "pharmacy_invoice_number", "string", 0),
    ("PAYMENT_RECEIPT", "payment_date", "string", 0),
    ("PAYMENT_RECEIPT", "amount_paid", "string", 0),
    ("PAYMENT_RECEIPT", "payment_method", "string", 0),
    ("PAYMENT_RECEIPT", "transaction_reference", "string", 0),
    ("PAYMENT_RECEIPT", "payment_status", "string", 0),
)


ORACLES["template_field_catalog"] = _with(ORDERS, DOCS, VALUES) + f""",
    catalog(document_type, field, kind, table_columns) AS (VALUES {', '.join(map(str, CATALOG))}),
    renamed AS (SELECT *, t = 3 AND k % 6 = 0 AS other_names FROM vals WHERE NOT (t = 6 AND k % 16 = 0)),
    filled AS (
      SELECT document_type, unnest(list_filter([
        CASE WHEN nm IS NOT NULL THEN 'patient_name' END,
        CASE WHEN adm IS NOT NULL AND NOT other_names THEN 'admission_date' END, CASE WHEN dis IS NOT NULL AND NOT other_names THEN 'discharge_date' END,
        CASE WHEN t = 1 THEN 'claim_id' END, CASE WHEN t = 1 THEN 'patient_id' END, CASE WHEN t = 1 THEN 'policy_number' END,
        CASE WHEN t = 1 THEN 'claim_type' END, CASE WHEN t = 1 THEN 'claimed_amount' END, CASE WHEN t = 2 THEN 'medicines' END,
        CASE WHEN t IN (4, 5) THEN 'invoice_total' END, CASE WHEN t = 5 THEN 'medicine_items' END, CASE WHEN t = 6 THEN 'laboratory_name' END,
        CASE WHEN receipt IS NOT NULL THEN 'amount_paid' END], lambda x: x IS NOT NULL)) AS field
      FROM renamed
    )
    SELECT catalog.document_type || '_V1' AS template_id, CAST(1 AS BIGINT) AS template_version, catalog.field, kind, CAST(table_columns AS BIGINT) AS table_columns,
           count(filled.field) AS documents
    FROM catalog LEFT JOIN filled ON filled.document_type = catalog.document_type AND filled.field = catalog.field
    GROUP BY ALL"""
ORACLES["unmatched_medicines_by_join"] = ORACLES["unmatched_medicines"]
ORACLES["stream_new_folders"] = ORACLES["new_folders"]

# Folders without a usable claim form are not loaded; some documents of the loaded ones have no usable payload.
_LOADED = "k % 97 <> 0 AND k % 89 <> 0 AND k % 101 <> 0 AND k % 103 <> 0"
_USABLE = f"{_LOADED} AND NOT (t = 7 AND k % 77 = 0) AND NOT (t = 3 AND k % 83 = 0)"
ORACLES["process_new_claims"] = _with(
    ORDERS,
    CLAIMS.replace("FROM o\n", f"FROM o WHERE {_LOADED}\n"),
    DOCS.replace("WHERE t = 1 OR", f"WHERE {_USABLE} AND (t = 1 OR").replace("k % 29 <> 0)\n)", "k % 29 <> 0))\n)"),
    VALUES, MEDICINES, FEATURES, *_result_ctes(),
) + """
    SELECT claim_id, recommendation AS claim_status, validation_category, validation_status, severity FROM results JOIN recommended USING (claim_id)"""

ORACLES["touched_folders"] = _with(FILES) + "SELECT DISTINCT folder FROM listed WHERE supported"
ORACLES["sync_documents"] = _with(ORDERS, DOCS) + """
    SELECT document_id, claim_id, document_type, CASE WHEN o_orderstatus = 'F' AND t = 1 THEN 'EXTRACTING' WHEN failed THEN 'FAILED' ELSE 'EXTRACTED' END AS processing_status,
           CAST(d AS TIMESTAMP) AS uploaded_at
    FROM docs WHERE o_orderstatus <> 'F' OR t IN (1, 6)"""
ORACLES["stream_file_changes"] = """
    SELECT 'folder=d' || doc_id AS folder, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS inserted, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS deleted,
           CAST((octet_length(encode(coalesce(text, ''))) + 1) * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS bytes
    FROM documents"""
ORACLES["listed_contents"] = """
    SELECT 'd' || doc_id AS folder, octet_length(encode(coalesce(text, ''))) + 1 AS n_bytes, md5(coalesce(text, '') || chr(10)) AS content_md5,
           CAST(NULL AS VARCHAR) AS error_class
    FROM documents WHERE source IN ('src0', 'src1', 'src2')
    UNION ALL SELECT 'd' || doc_id, NULL, NULL, 'FileNotFoundError' FROM documents WHERE doc_id % 10 = 0"""

# After the second run: prescriptions of every fifth order are gone and discharge summaries of every seventh unreadable, but not where
# the folder could not be opened (every eleventh); there everything is as before.
_KEPT = f"{_USABLE} AND NOT (t = 2 AND k % 5 = 0 AND k % 11 <> 0)"
_SPOILT = "(t = 3 AND k % 7 = 0 AND k % 11 <> 0)"
_CHANGED_DOCS = DOCS.replace("t > 1 AND (k + t) % 31 = 0 AS failed", f"(t > 1 AND (k + t) % 31 = 0) OR {_SPOILT} AS failed")
ORACLES["process_changed_claims"] = _with(
    ORDERS,
    CLAIMS.replace("FROM o\n", f"FROM o WHERE {_LOADED}\n"),
    _CHANGED_DOCS.replace("WHERE t = 1 OR", f"WHERE {_KEPT} AND (t = 1 OR").replace("k % 29 <> 0)\n)", "k % 29 <> 0))\n)"),
    VALUES, MEDICINES, FEATURES, *_result_ctes(),
) + """
    SELECT claim_id, CASE WHEN k % 11 = 0 THEN 'EXTRACTION_FAILED' ELSE recommendation END AS claim_status, validation_category, validation_status, severity
    FROM results JOIN recommended USING (claim_id) JOIN o USING (claim_id)"""

# Runs are numbered 1,000,000 and 2,000,000. A copied form is a supported file of its own.
_FOLDER_FILES = f"""
folder_files AS (
  SELECT k, folder, folder || '/' || file_name AS relative_path, t, claim_id,
         failed OR (t = 7 AND k % 77 = 0) OR (t = 3 AND k % 83 = 0) AS bad
  FROM docs
  UNION ALL SELECT k, folder, folder || '/claim_form_copy.pdf', 1, claim_id, FALSE FROM o WHERE k % 33 = 0
),
hit AS (
  SELECT *, k % 11 = 0 AS closed, bool_or((t = 2 AND k % 5 = 0) OR (t = 3 AND k % 7 = 0) OR (relative_path LIKE '%/claim_form.%' AND k % 11 = 0))
         OVER (PARTITION BY k) AS touched
  FROM folder_files WHERE {_LOADED}
),
after AS (
  SELECT *, CASE WHEN touched AND NOT closed THEN 2000000 ELSE 1000000 END AS run, bad OR {_SPOILT} AS failed_now
  FROM hit WHERE NOT (t = 2 AND k % 5 = 0 AND NOT closed)
)"""
ORACLES["stored_documents"] = _with(ORDERS, DOCS, _FOLDER_FILES) + """
    SELECT sha256(relative_path) AS document_id, sha256(sha256(relative_path) || '|' || run) AS extraction_id, claim_id, relative_path,
           CASE WHEN failed_now THEN 'FAILED' ELSE 'EXTRACTED' END AS processing_status,
           CASE WHEN failed_now THEN 'FAILED' ELSE 'EXTRACTED' END AS extraction_status
    FROM after"""
ORACLES["engine_history"] = _with(ORDERS, DOCS) + f"""
, folders AS (
  SELECT k, {_LOADED} AS loaded, k % 11 = 0 AS closed, bool_or((t = 2 AND k % 5 = 0) OR (t = 3 AND k % 7 = 0) OR (t = 1 AND k % 11 = 0 AND k % 97 <> 0)) AS touched
  FROM docs GROUP BY k
), counted AS (
  SELECT 1000000 AS run_id, count(*) FILTER (WHERE loaded) AS good, count(*) FILTER (WHERE NOT loaded) AS bad FROM folders
  UNION ALL SELECT 2000000, count(*) FILTER (WHERE touched AND loaded AND NOT closed), count(*) FILTER (WHERE touched AND (closed OR NOT loaded)) FROM folders
)
SELECT run_id, 'SUCCEEDED' AS state, CASE WHEN bad = 0 THEN 'SUCCESS: ' ELSE 'COMPLETED_WITH_ERRORS: ' END || good || ' folders processed, ' || bad || ' failed' AS return_value,
       CAST(NULL AS VARCHAR) AS error_message FROM counted"""
ORACLES["claim_listings"] = _with(ORDERS, DOCS, VALUES, MEDICINES) + """
, items AS (
  SELECT claim_id, 'NAME' AS kind, document_type, coalesce(nm, 'NOT EXTRACTED') AS name, document_type || ': ' || coalesce(nm, 'NOT EXTRACTED') AS item FROM vals
  UNION ALL SELECT claim_id, side, '', medicine, medicine FROM medk
), parted AS (
  SELECT *, coalesce(sum(length(item) + 3) OVER (PARTITION BY claim_id, kind ORDER BY document_type, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 120 AS part
  FROM items
)
SELECT claim_id, kind, CAST(part AS BIGINT) AS part, count(*) AS n_items, string_agg(item, '|' ORDER BY document_type, name) AS listing FROM parted GROUP BY ALL"""
ORACLES["search_claims_by_index"] = ORACLES["search_claims"]
ORACLES["worklist_second_page"] = _with(ORDERS, CLAIMS) + """
    SELECT claim_id, created_at FROM claims ORDER BY created_at DESC NULLS FIRST, claim_id LIMIT 100 OFFSET 100"""
ORACLES["validate_stored_claims"] = ORACLES["validate_requested"].replace("o_orderstatus = 'O'", "o_orderstatus = 'P'")
