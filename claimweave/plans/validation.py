"""The five claim checks and their consolidation, for all claims at once.

Each check is a set of column expressions over the one-row-per-claim features; the six result rows of a claim come out of
one `inline`, so the features are computed once.
"""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import stable_id
from claimweave.operators.skew import hot_join
from claimweave.plans.features import (
    AMOUNTS,
    DATES,
    LISTS,
    MEDICINES,
    NAMES,
    TOTALS,
    Limits,
    claim_features,
    document_features,
    latest_fields,
    missing_types,
    present_types,
    stored_versions,
)
from claimweave.vocabulary import AMOUNT_TOLERANCE, AMOUNT_TYPES, DATED_TYPES, DOCUMENT_TYPES

PASSED, WARNING, FAILED = "PASSED", "WARNING", "FAILED"


@dataclass(frozen=True)
class Check:
    """One rule: `arms` are (condition, status, message), tried in order; `otherwise` is the message of PASSED."""

    category: str
    name: str
    arms: list[tuple[Column, str, str]]
    otherwise: str
    passed_severity: str
    sources: Column
    expected: Column
    actual: Column

    def _ladder(self, position: int, last: str) -> Column:
        ladder = F.when(self.arms[0][0], self.arms[0][position])
        for arm in self.arms[1:]:
            ladder = ladder.when(arm[0], arm[position])
        return ladder.otherwise(last)

    @property
    def status(self) -> Column:
        return self._ladder(1, PASSED)

    @property
    def status_column(self) -> str:
        return f"{self.category.lower()}_status"

    def row(self) -> Column:
        """The result row, reading the status from its column."""
        status = F.col(self.status_column)
        severity = F.when(status == FAILED, "HIGH").when(status == WARNING, "MEDIUM").otherwise(self.passed_severity)
        return F.struct(
            F.lit(self.category).alias("validation_category"),
            F.lit(self.name).alias("validation_name"),
            status.alias("validation_status"),
            self.expected.alias("expected_value"),
            self.actual.alias("actual_value"),
            self._ladder(2, self.otherwise).alias("validation_message"),
            severity.alias("severity"),
            (status != PASSED).alias("requires_review"),
            self.sources.alias("source_documents"),
        )


def _texts(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def _json(keep_nulls: bool, **fields: str | Column) -> Column:
    values = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
    return F.to_json(values, {"ignoreNullFields": "false" if keep_nulls else "true"})


# Names, expectations and messages of the checks.


def required_documents_check() -> Check:
    missing = F.col("missing_types")
    return Check(
        category="DOCUMENT",
        name="Required documents available",
        arms=[(F.size(missing) > 0, FAILED, "One or more mandatory documents are missing.")],
        otherwise="All mandatory documents are available.",
        passed_severity="INFO",
        sources=missing,
        expected=F.lit(None).cast("string"),
        actual=F.to_json(missing),
    )


def identity_check() -> Check:
    return Check(
        category="IDENTITY",
        name="Patient identity consistency",
        arms=[
            (F.col("document_count") == 0, WARNING, "No extracted documents are available for identity validation."),
            (F.col("name_mismatches") > 0, FAILED, "Patient name does not match across all submitted documents."),
            (F.col("missing_names") > 0, WARNING, "Patient name could not be extracted from one or more documents."),
        ],
        otherwise="Patient name is consistent across the submitted documents.",
        passed_severity="MEDIUM",
        sources=_texts(DOCUMENT_TYPES),
        expected=F.col("expected_name"),
        actual=F.col("extracted_names"),
    )


def dates_check() -> Check:
    none_found = (F.col("admission_count") == 0) | (F.col("discharge_count") == 0)
    return Check(
        category="TREATMENT_DATE",
        name="Admission and discharge date consistency",
        arms=[
            (none_found, WARNING, "Admission or discharge date is missing from the extracted documents."),
            (F.col("admission_variants") > 1, FAILED, "Admission date is inconsistent across the submitted documents."),
            (F.col("discharge_variants") > 1, FAILED, "Discharge date is inconsistent across the submitted documents."),
            (F.col("min_admission") > F.col("max_discharge"), FAILED, "Admission date is later than discharge date."),
        ],
        otherwise="Admission and discharge dates are consistent.",
        passed_severity="INFO",
        sources=_texts(DATED_TYPES),
        expected=F.lit("Matching dates across claim form, discharge summary and hospital invoice"),
        actual=_json(
            True,
            minimum_admission_date="min_admission",
            maximum_admission_date="max_admission",
            minimum_discharge_date="min_discharge",
            maximum_discharge_date="max_discharge",
            admission_date_count="admission_count",
            discharge_date_count="discharge_count",
            admission_date_variants="admission_variants",
            discharge_date_variants="discharge_variants",
        ),
    )


def financial_check(tolerance: str = AMOUNT_TOLERANCE) -> Check:
    limit = F.lit(tolerance).cast("decimal(18,2)")
    claim_off = F.abs("claim_difference") > limit
    receipt_off = F.abs("receipt_difference") > limit
    return Check(
        category="FINANCIAL",
        name="Claim amount reconciliation",
        arms=[
            (F.col("hospital_amount").isNull(), WARNING, "Hospital invoice total could not be extracted."),
            (claim_off, FAILED, "Claimed amount does not match the supported invoice amount."),
            (F.col("receipt_amount").isNull(), WARNING, "Payment receipt amount could not be extracted."),
            (receipt_off, FAILED, "Payment receipt amount does not match the supported invoice amount."),
        ],
        otherwise="Claimed amount, invoice totals and payment receipt are consistent.",
        passed_severity="MEDIUM",
        sources=_texts(AMOUNT_TYPES),
        expected=F.lit("Claimed and paid amounts should match supported invoice totals."),
        actual=_json(
            False,
            claimed_amount="claimed_amount",
            hospital_invoice_amount="hospital_amount",
            pharmacy_invoice_amount="pharmacy_amount",
            supported_amount="supported_amount",
            payment_receipt_amount="receipt_amount",
            claim_difference="claim_difference",
            receipt_difference="receipt_difference",
        ),
    )


def medicines_check() -> Check:
    none_prescribed, none_purchased = F.col("prescribed_count") == 0, F.col("purchased_count") == 0
    neither = "No medicines were extracted from either the prescription or pharmacy invoice."
    return Check(
        category="MEDICAL",
        name="Prescription and pharmacy medicine match",
        arms=[
            (none_prescribed & none_purchased, WARNING, neither),
            (none_prescribed, WARNING, "No medicines were extracted from the prescription."),
            (none_purchased, WARNING, "No medicines were extracted from the pharmacy invoice."),
            (F.col("unmatched_count") > 0, FAILED, "One or more purchased medicines were not found in the prescription."),
        ],
        otherwise="All purchased medicines were found in the prescription.",
        passed_severity="INFO",
        sources=_texts(("PRESCRIPTION", "PHARMACY_INVOICE")),
        expected=F.lit("All purchased medicines should be supported by the prescription."),
        actual=_json(
            False,
            prescribed_medicines="prescribed_items",
            purchased_medicines="purchased_items",
            unmatched_medicines="unmatched_items",
            prescribed_medicine_count="prescribed_count",
            purchased_medicine_count="purchased_count",
            unmatched_medicine_count="unmatched_count",
        ),
    )


CHECKS = (required_documents_check, identity_check, dates_check, medicines_check, financial_check)

# Recommendation with the message of the consolidated row, in order of precedence.
RECOMMENDATIONS = {
    "MEDICAL_REVIEW_REQUIRED": "Medical validation failed. The claim requires medical review.",
    "FINANCIAL_REVIEW_REQUIRED": "Financial validation failed. The claim requires financial review.",
    "MORE_INFORMATION_REQUIRED": "Required information is missing or inconsistent.",
    "MANUAL_REVIEW_REQUIRED": "The claim contains warnings that require manual review.",
    "READY_FOR_APPROVAL": "All completed validations passed. The claim is ready for approval.",
}
INFORMATION_CATEGORIES = ("DOCUMENT", "IDENTITY", "TREATMENT_DATE", "EXTRACTION_QUALITY")
DECISION = "CLAIM_DECISION"


def recommendation(medical_failed: Column, financial_failed: Column, other_failed: Column, warnings: Column) -> Column:
    """Recommendation from the counts of failed checks and warnings."""
    names = list(RECOMMENDATIONS)
    ladder = F.when(medical_failed > 0, names[0])
    for count, name in zip((financial_failed, other_failed, warnings), names[1:]):
        ladder = ladder.when(count > 0, name)
    return ladder.otherwise(names[-1])


def with_differences(features: DataFrame) -> DataFrame:
    """Adds the supported amount and how far claim and receipt are from it; sums out of range are NULL."""
    zero = F.lit(0).cast("decimal(18,2)")
    supported = (F.coalesce("hospital_amount", zero) + F.coalesce("pharmacy_amount", zero)).try_cast("decimal(18,2)")
    rows = features.withColumn("supported_amount", supported)

    def beyond_support(name: str) -> Column:
        return (F.coalesce(name, zero) - F.coalesce("supported_amount", zero)).try_cast("decimal(18,2)")

    return rows.withColumns({
        "claim_difference": beyond_support("claimed_amount"), "receipt_difference": beyond_support("receipt_amount"),
    })


def _judged(features: DataFrame, checks: list[Check]) -> DataFrame:
    return features.withColumns({check.status_column: check.status for check in checks})


def _how_many(checks: list[Check], status: str, categories: tuple[str, ...] | None = None) -> Column:
    flags = [
        (F.col(check.status_column) == status).cast("int")
        for check in checks
        if categories is None or check.category in categories
    ]
    return reduce(add, flags).cast("long")


def _consolidated(features: DataFrame, checks: list[Check]) -> DataFrame:
    counted = features.withColumns({
        "total_validations": F.lit(len(checks)).cast("long"),
        "passed_validations": _how_many(checks, PASSED),
        "warning_validations": _how_many(checks, WARNING),
        "failed_validations": _how_many(checks, FAILED),
    })
    return counted.withColumn("recommendation", recommendation(
        _how_many(checks, FAILED, ("MEDICAL",)),
        _how_many(checks, FAILED, ("FINANCIAL",)),
        _how_many(checks, FAILED, INFORMATION_CATEGORIES),
        F.col("warning_validations"),
    ))


def _decision_row() -> Column:
    failed, warned = F.col("failed_validations") > 0, F.col("warning_validations") > 0
    messages = F.create_map(*[F.lit(part) for pair in RECOMMENDATIONS.items() for part in pair])
    return F.struct(
        F.lit(DECISION).alias("validation_category"),
        F.lit("Overall claim validation").alias("validation_name"),
        F.when(failed, FAILED).when(warned, WARNING).otherwise(PASSED).alias("validation_status"),
        F.lit("All mandatory claim validations should pass.").alias("expected_value"),
        _json(
            False,
            recommendation="recommendation",
            total_validations="total_validations",
            passed_validations="passed_validations",
            warning_validations="warning_validations",
            failed_validations="failed_validations",
        ).alias("actual_value"),
        messages[F.col("recommendation")].alias("validation_message"),
        F.when(failed, "HIGH").when(warned, "MEDIUM").otherwise("INFO").alias("severity"),
        (failed | warned).alias("requires_review"),
        _texts(("ALL_SUBMITTED_DOCUMENTS",)).alias("source_documents"),
    )


def _result_rows(features: DataFrame, rows: list[Column], keep: list[str]) -> DataFrame:
    return features.select("claim_id", *keep, F.inline(F.array(*rows)))


def judged_claims(features: DataFrame, tolerance: str = AMOUNT_TOLERANCE) -> DataFrame:
    """Features with the status of every check, the counts and the recommendation."""
    checks = [make(tolerance) if make is financial_check else make() for make in CHECKS]
    return _consolidated(_judged(with_differences(features), checks), checks)


def result_rows(judged: DataFrame, tolerance: str = AMOUNT_TOLERANCE, keep: list[str] | None = None) -> DataFrame:
    """Five check rows and one decision row per claim, each with the columns `keep` of the claim."""
    checks = [make(tolerance) if make is financial_check else make() for make in CHECKS]
    return _result_rows(judged, [check.row() for check in checks] + [_decision_row()], keep or [])


def validate_claims(
    claims: DataFrame,
    documents: DataFrame,
    extractions: DataFrame,
    tolerance: str = AMOUNT_TOLERANCE,
    limits: Limits = Limits(),
) -> DataFrame:
    """Result rows of all given claims. Give fewer claims, documents and extractions to validate fewer."""
    features = claim_features(claims, documents, stored_versions(extractions), limits)
    return result_rows(judged_claims(features, tolerance), tolerance)


def validate_requested(
    requested: DataFrame, claims: DataFrame, documents: DataFrame, extractions: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Result rows of the claims in `requested` (claim_id); `validation_requests` tells which ids are unknown."""
    ids = requested.select("claim_id").distinct()

    def wanted(rows: DataFrame, spread_by: Column) -> DataFrame:
        return hot_join(rows, ids, ["claim_id"], "left_semi", spread_by, limits.hot_rows)

    return validate_claims(
        claims.join(ids, "claim_id", "left_semi"),
        wanted(documents, F.col("relative_path")),
        wanted(extractions, F.col("document_id")),
        limits=limits,
    )


def stamped(results: DataFrame, as_of: Column) -> DataFrame:
    """Result rows with id and time, ready to be stored."""
    ids = stable_id(F.col("claim_id"), F.col("validation_category"))
    return results.withColumn("validation_id", ids).withColumn("validated_at", as_of)


def validation_summary(results: DataFrame) -> DataFrame:
    """One row per validated claim: counts, recommendation and the outcome of each check."""
    counts = consolidate_claims(results)
    detail = F.to_json(F.struct("validation_status", "validation_message", "actual_value"))

    def outcome(category: str, alias: str) -> Column:
        return F.max(F.when(F.col("validation_category") == category, detail)).alias(alias)

    outcomes = results.groupBy("claim_id").agg(
        outcome("DOCUMENT", "document_validation"),
        outcome("IDENTITY", "identity_validation"),
        outcome("TREATMENT_DATE", "date_validation"),
        outcome("MEDICAL", "medical_validation"),
        outcome("FINANCIAL", "financial_validation"),
        outcome("EXTRACTION_QUALITY", "quality_validation"),
    )
    return counts.withColumn("status", F.lit("SUCCESS")).join(outcomes, "claim_id")


def consolidate_claims(results: DataFrame) -> DataFrame:
    """Counts and recommendation per claim from stored check rows; an earlier decision row is not counted."""
    category, status = F.col("validation_category"), F.col("validation_status")
    failed = status == FAILED
    counted = results.filter(category != DECISION).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(status == PASSED).alias("passed_validations"),
        F.count_if(status == WARNING).alias("warning_validations"),
        F.count_if(failed).alias("failed_validations"),
        F.count_if(failed & (category == "MEDICAL")).alias("medical_failed"),
        F.count_if(failed & (category == "FINANCIAL")).alias("financial_failed"),
        F.count_if(failed & category.isin(*INFORMATION_CATEGORIES)).alias("other_failed"),
    )
    return counted.withColumn("recommendation", recommendation(
        F.col("medical_failed"), F.col("financial_failed"), F.col("other_failed"), F.col("warning_validations")
    ))


def validation_requests(requested: DataFrame, summary: DataFrame) -> DataFrame:
    """Answer to each requested claim id; ids that are no claim get FAILED."""
    known = summary.withColumn("_known", F.lit(True))
    answered = requested.select("claim_id").distinct().join(known, "claim_id", "left")
    is_known = F.col("_known").isNotNull()
    return answered.select(
        "claim_id",
        F.when(is_known, "SUCCESS").otherwise(FAILED).alias("request_status"),
        F.when(~is_known, "Claim ID was not found.").alias("message"),
        "recommendation",
        "total_validations",
    )


# The checks one by one: each computes only the features it needs and keeps them next to its result row.


def _single(features: DataFrame, check: Check, keep: list[str]) -> DataFrame:
    return _result_rows(_judged(features, [check]), [check.row()], keep)


def validate_required_documents(claims: DataFrame, documents: DataFrame) -> DataFrame:
    flags = claims.select("claim_id").join(present_types(documents), "claim_id", "left")
    return _single(flags.select("claim_id", missing_types().alias("missing_types")), required_documents_check(), ["missing_types"])


def validate_dates(claims: DataFrame, extractions: DataFrame) -> DataFrame:
    rows = document_features(claims, latest_fields(extractions, (DATES,)), parts=(DATES,))
    return _single(rows, dates_check(), list(TOTALS[DATES]))


def validate_financial(claims: DataFrame, extractions: DataFrame, tolerance: str = AMOUNT_TOLERANCE) -> DataFrame:
    rows = with_differences(document_features(claims, latest_fields(extractions, (AMOUNTS,)), parts=(AMOUNTS,)))
    kept = ["claimed_amount", *TOTALS[AMOUNTS], "supported_amount", "claim_difference", "receipt_difference"]
    return _single(rows, financial_check(tolerance), kept)


def validate_identity(claims: DataFrame, extractions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    rows = document_features(claims, stored_versions(extractions, (NAMES,)), limits, (NAMES,))
    return _single(rows, identity_check(), ["document_count", "missing_names", "name_mismatches"])


def validate_medicines(claims: DataFrame, extractions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    rows = document_features(claims, stored_versions(extractions, (MEDICINES,)), limits, (MEDICINES,))
    return _single(rows, medicines_check(), [*LISTS, "prescribed_count", "purchased_count", "unmatched_count"])
