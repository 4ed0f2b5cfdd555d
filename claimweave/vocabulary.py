"""Closed vocabularies, rule texts and limits of the claims data model."""

# Document types in display order; a type's template id is "<type>_V1".
DOCUMENT_TYPES = (
    "CLAIM_FORM",
    "PRESCRIPTION",
    "DISCHARGE_SUMMARY",
    "HOSPITAL_INVOICE",
    "PHARMACY_INVOICE",
    "DIAGNOSTIC_REPORT",
    "PAYMENT_RECEIPT",
)

# Fixed value: type of files that no rule fits.
OTHER = "OTHER"

# Types every claim has to bring.
REQUIRED_TYPES = ("CLAIM_FORM", "PRESCRIPTION", "DISCHARGE_SUMMARY", "HOSPITAL_INVOICE", "PAYMENT_RECEIPT")

# Types that carry admission and discharge dates.
DATED_TYPES = ("CLAIM_FORM", "DISCHARGE_SUMMARY", "HOSPITAL_INVOICE")

# Types that carry amounts.
AMOUNT_TYPES = ("CLAIM_FORM", "HOSPITAL_INVOICE", "PHARMACY_INVOICE", "PAYMENT_RECEIPT")

# File-name rules, tried in order. Each rule needs one word out of every group and none of the last tuple.
CLASSIFIER_RULES = (
    ("CLAIM_FORM", (("claim",), ("form",)), ()),
    ("PRESCRIPTION", (("prescription",),), ()),
    ("DISCHARGE_SUMMARY", (("discharge",), ("summary",)), ()),
    ("HOSPITAL_INVOICE", (("hospital",), ("invoice", "bill")), ()),
    ("PHARMACY_INVOICE", (("pharmacy",), ("invoice", "bill", "receipt")), ()),
    ("DIAGNOSTIC_REPORT", (("diagnostic", "laboratory", "lab", "test"), ("report", "result")), ()),
    ("PAYMENT_RECEIPT", (("payment",), ("receipt", "bill", "invoice")), ()),
    ("PAYMENT_RECEIPT", (("receipt",),), ("pharmacy",)),
)

# Fixed value: extensions of files that are processed.
SUPPORTED_FILE = r"[.](pdf|png|jpg|jpeg)$"

# Header fields with the names they may come under, in order of preference.
HEADER_ALIASES = {
    "claim_id": ("claim_id", "claim_number"),
    "patient_id": ("patient_id", "member_id"),
    "patient_name": ("patient_name", "insured_name"),
    "policy_number": ("policy_number", "policy_id"),
    "claim_type": ("claim_type", "treatment_type"),
}

# Names that amounts and dates may come under, in order of preference.
CLAIMED_AMOUNT_ALIASES = ("claimed_amount", "total_claim_amount", "claim_amount")
ADMISSION_ALIASES = ("admission_date", "date_of_admission")
DISCHARGE_ALIASES = ("discharge_date", "date_of_discharge")

# Decision options of a reviewer; the first one is "undecided".
DECISIONS = (
    "PENDING",
    "APPROVED",
    "REJECTED",
    "MORE_INFORMATION_REQUIRED",
    "MEDICAL_REVIEW_REQUIRED",
    "FINANCIAL_REVIEW_REQUIRED",
)

# Display group of each known status; unknown ones show as INFO.
STATUS_GROUPS = {
    "PASSED": "DONE",
    "SUCCESS": "DONE",
    "EXTRACTED": "DONE",
    "COMPLETED": "DONE",
    "EXTRACTION_COMPLETED": "DONE",
    "READY_FOR_APPROVAL": "DONE",
    "APPROVED": "DONE",
    "WARNING": "WARNING",
    "MANUAL_REVIEW_REQUIRED": "MANUAL_REVIEW",
    "MORE_INFORMATION_REQUIRED": "MORE_INFORMATION",
    "FAILED": "FAILED",
    "REJECTED": "FAILED",
    "EXTRACTION_FAILED": "FAILED",
    "FINANCIAL_REVIEW_REQUIRED": "FINANCIAL_REVIEW",
    "MEDICAL_REVIEW_REQUIRED": "MEDICAL_REVIEW",
    "PROCESSING": "IN_PROGRESS",
    "EXTRACTING": "IN_PROGRESS",
    "PENDING": "IN_PROGRESS",
    "UPLOADED": "UPLOADED",
}
DEFAULT_STATUS_GROUP = "INFO"

# Fixed value: amounts may differ by this much and still agree.
AMOUNT_TOLERANCE = "1.00"
