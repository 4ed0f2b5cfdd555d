"""Everything the validation rules need to know about a claim, as one row per claim."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.parsing import parse_amount, parse_date
from claimweave.functions.text import name_key
from claimweave.functions.variants import text_at, texts_at
from claimweave.operators.latest import newest_first, newest_per_key
from claimweave.operators.listings import listing_parts
from claimweave.operators.medicines import MAX_PAIRS, distinct_medicines, unmatched_by_join, unmatched_in_row
from claimweave.operators.skew import HOT_ROWS, hot_join_with
from claimweave.session import ID_CODEC, materialize
from claimweave.vocabulary import (
    ADMISSION_ALIASES,
    DATED_TYPES,
    DISCHARGE_ALIASES,
    REQUIRED_TYPES,
)

# What a pass over the extractions is asked for.
NAMES, DATES, AMOUNTS, MEDICINES = PARTS = ("names", "dates", "amounts", "medicines")
MEDICINE_TYPES = ("PRESCRIPTION", "PHARMACY_INVOICE")

NO_NAME = "NOT EXTRACTED"
SEPARATOR = " | "


@dataclass(frozen=True)
class Limits:
    """When a claim is too wide to be matched inside one row. The way changes, the result does not.

    `listing_chars` is the size of a listing's parts, and so of the listings in results: a longer one shows its first part and
    how many more there are. `claim_listings` has all parts.
    """

    pairs: int = MAX_PAIRS
    hot_rows: int = HOT_ROWS
    listing_chars: int = 1_000_000


def _for_type(kind: str, value: Column) -> Column:
    return F.when(F.col("document_type") == kind, value)


def _typed_fields(extractions: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Typed fields of all successful extractions, only those that `parts` needs."""
    response = F.col("extracted_response")
    dated = F.col("document_type").isin(*DATED_TYPES)
    fields = {
        NAMES: [text_at(response, "patient_name").alias("patient_name")],
        DATES: [
            F.when(dated, parse_date(*[text_at(response, name) for name in ADMISSION_ALIASES])).alias("admission_date"),
            F.when(dated, parse_date(*[text_at(response, name) for name in DISCHARGE_ALIASES])).alias("discharge_date"),
        ],
        AMOUNTS: [
            _for_type("HOSPITAL_INVOICE", parse_amount(text_at(response, "invoice_total"))).alias("hospital_amount"),
            _for_type("PHARMACY_INVOICE", parse_amount(text_at(response, "invoice_total"))).alias("pharmacy_amount"),
            _for_type("PAYMENT_RECEIPT", parse_amount(text_at(response, "amount_paid"))).alias("receipt_amount"),
        ],
        MEDICINES: [
            _for_type("PRESCRIPTION", texts_at(response, "medicines.medicine_name")).alias("prescribed"),
            _for_type("PHARMACY_INVOICE", texts_at(response, "medicine_items.medicine_name")).alias("purchased"),
        ],
    }
    done = extractions.filter(F.col("extraction_status") == "EXTRACTED")
    only = {(DATES,): DATED_TYPES, (MEDICINES,): MEDICINE_TYPES}.get(tuple(parts))
    if only:
        done = done.filter(F.col("document_type").isin(*only))
    return done.select(
        "claim_id", "document_id", "document_type", *_VERSION, *[field for part in parts for field in fields[part]]
    )


# What tells the versions of a document apart.
_VERSION = ("extraction_id", "extracted_at")


def _newest(fields: DataFrame) -> DataFrame:
    """The newest version of every document; rows that have no versions are returned as they are."""
    if not set(_VERSION) <= set(fields.columns):
        return fields
    return newest_per_key(fields, ["claim_id", "document_id"], newest_first("extracted_at", "extraction_id")).drop(*_VERSION)


def _sized(fields: DataFrame) -> DataFrame:
    """Adds the number and length of a document's medicines."""
    if "prescribed" not in fields.columns:
        return fields
    chars = {f"{side}_chars": F.coalesce(F.length(F.array_join(side, SEPARATOR)) + len(SEPARATOR), F.lit(0)) for side in ("prescribed", "purchased")}
    return fields.withColumns({
        "prescribed_rows": F.greatest(F.size("prescribed"), F.lit(0)), "purchased_rows": F.greatest(F.size("purchased"), F.lit(0)), **chars,
    })


def latest_fields(extractions: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Typed fields of the newest successful extraction of every document, only those that `parts` needs.

    Payloads are read before the shuffle, so only typed columns move. Where dates or medicines alone are asked for, documents
    of other types are left out before the newest row is chosen.
    """
    return _sized(_newest(_typed_fields(extractions, parts)))


def stored_fields(extractions: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """`latest_fields` as a table: the payloads are read once, every later pass reads narrow typed columns."""
    return materialize(latest_fields(extractions, parts), "claim-fields", ID_CODEC)


def stored_versions(extractions: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Typed fields of all successful extractions as a table, for `document_features` alone.

    Nothing moves before it is written. Wide claims are looked for first, and documents of all others are dealt once, by claim: their newest
    versions are chosen and gathered where they arrive.
    """
    return materialize(_sized(_typed_fields(extractions, parts)), "claim-versions", ID_CODEC)


def wide_claims(fields: DataFrame, limits: Limits) -> DataFrame:
    """Claims that are not matched inside one row: too many name pairs, too many documents, or listings of more than one part.

    Where `fields` has older versions of documents, they count as well, so a claim may be among these that need not be.
    """
    documents = F.count(F.lit(1))
    too_wide = documents > limits.hot_rows
    if "patient_name" in fields.columns:
        label = F.length(_label(F.col("document_type"), F.col("patient_name"))) + len(SEPARATOR)
        too_wide |= F.sum(label) > limits.listing_chars
    if "prescribed" in fields.columns:
        too_wide |= F.sum("prescribed_rows").cast("double") * F.sum("purchased_rows").cast("double") > limits.pairs
        too_wide |= (F.sum("prescribed_chars") > limits.listing_chars) | (F.sum("purchased_chars") > limits.listing_chars)
    sized = fields.groupBy("claim_id").agg(documents.alias("documents"), too_wide.alias("too_wide"))
    return sized.filter("too_wide").select("claim_id", F.ceil(F.col("documents") / limits.hot_rows).cast("int").alias("_parts"))


def _totals(parts: tuple[str, ...]) -> list[Column]:
    """Counts, date ranges and amounts of a claim. Buffers have a fixed size, so documents are combined before the shuffle."""
    name = F.col("patient_name")
    totals = {
        NAMES: lambda: [F.count_if(name.isNull() | (F.trim(name) == "")).alias("missing_names")],
        DATES: lambda: [
            F.count("admission_date").alias("admission_count"),
            F.count("discharge_date").alias("discharge_count"),
            F.min("admission_date").alias("min_admission"),
            F.max("admission_date").alias("max_admission"),
            F.min("discharge_date").alias("min_discharge"),
            F.max("discharge_date").alias("max_discharge"),
            # The calendar bounds the two sets, however many documents a claim has.
            F.size(F.collect_set("admission_date")).cast("long").alias("admission_variants"),
            F.size(F.collect_set("discharge_date")).cast("long").alias("discharge_variants"),
        ],
        AMOUNTS: lambda: [
            F.max("hospital_amount").alias("hospital_amount"),
            F.max("pharmacy_amount").alias("pharmacy_amount"),
            F.max("receipt_amount").alias("receipt_amount"),
        ],
        MEDICINES: lambda: [],
    }
    return [F.count(F.lit(1)).alias("document_count"), *[total for part in parts for total in totals[part]()]]


def claim_totals(fields: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    return fields.groupBy("claim_id").agg(*_totals(parts))


def _label(document_type: Column, name: Column) -> Column:
    return F.concat(document_type, F.lit(": "), F.coalesce(name, F.lit(NO_NAME)))


def _distinct_names(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array_compact(lists)))))


def _listing(documents: str) -> Column:
    """Documents of a claim as text, by type and then by name."""
    pairs = F.array_sort(F.transform(documents, lambda d: F.struct(d["document_type"], d["name"])))
    return F.array_join(F.transform(pairs, lambda pair: _label(pair["document_type"], pair["name"])), SEPARATOR)


def _gathered(parts: tuple[str, ...]) -> Column:
    """What has to be seen together, as one list per claim; only for claims that are not wide."""
    kept = []
    if NAMES in parts:
        kept += ["document_type", F.coalesce("patient_name", F.lit(NO_NAME)).alias("name"), name_key(F.col("patient_name")).alias("key")]
    if MEDICINES in parts:
        kept += ["prescribed", "purchased"]
    return F.collect_list(F.struct(*kept)).alias("_documents")


def dealt_by_claim(rows: DataFrame) -> DataFrame:
    """Rows dealt as they are, to be gathered where they arrive; only for claims that are not wide.

    Documents of a claim lie in different tasks, so lists made before the shuffle have one entry each: they take twice the bytes of the rows, and every
    task would sort all of its rows to make them.
    """
    return rows.repartition("claim_id")


def _narrow_findings(gathered: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Findings from the gathered documents, inside the row of the claim."""
    documents, rows = F.col("_documents"), gathered
    if NAMES in parts:
        rows = rows.withColumns({
            "name_mismatches": F.size(F.filter(documents["key"], lambda key: key != F.col("expected_key"))).cast("long"),
            "extracted_names": _listing("_documents"),
        })
    if MEDICINES in parts:
        rows = rows.withColumns({
            "prescribed_items": _distinct_names(documents["prescribed"]), "purchased_items": _distinct_names(documents["purchased"]),
        }).withColumns({
            "prescribed_count": F.size(F.array_distinct(F.transform("prescribed_items", name_key))).cast("long"),
            "purchased_count": F.size(F.array_distinct(F.transform("purchased_items", name_key))).cast("long"),
            "unmatched_items": unmatched_in_row(F.col("purchased_items"), F.col("prescribed_items")),
        }).withColumn("unmatched_count", F.size("unmatched_items").cast("long"))
    return rows


def _medicine_rows(documents: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.lit("PRESCRIBED").alias("side"), F.col("prescribed").alias("names")),
        F.struct(F.lit("PURCHASED").alias("side"), F.col("purchased").alias("names")),
    )
    sided = documents.select("claim_id", F.inline(sides))
    names = sided.select("claim_id", "side", F.explode("names").alias("medicine"))
    return names.filter(F.col("medicine").isNotNull())


def name_items(documents: DataFrame) -> DataFrame:
    """Documents of a claim as listing items."""
    name = F.coalesce("patient_name", F.lit(NO_NAME))
    return documents.select("claim_id", "document_type", name.alias("name"), _label(F.col("document_type"), F.col("patient_name")).alias("item"))


def _first_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, listing of the first part, and more: how many others there are."""
    counted = parts.groupBy(*keys).agg((F.max("part")).alias("more"))
    return parts.filter(F.col("part") == 0).join(counted, keys).select(*keys, "listing", "more")


def _wide_names(expected: DataFrame, wide: DataFrame, documents: DataFrame, limits: Limits) -> DataFrame:
    """Name mismatches and the listing of wide claims; mismatches by a grouping that combines documents before the shuffle."""
    keys = documents.groupBy("claim_id", name_key(F.col("patient_name")).alias("key")).agg(F.count("patient_name").alias("n"))
    # The claim's own name enters as a row of the same grouping, so no group of documents has to meet it in a join.
    own = expected.join(wide, "claim_id", "left_semi").select("claim_id", F.col("expected_key").alias("key"), F.lit(True).alias("own"))
    met = keys.withColumn("own", F.lit(False)).unionByName(own.withColumn("n", F.lit(0).cast("long"))).groupBy("claim_id", "key").agg(
        F.sum("n").alias("n"), F.max("own").alias("own")
    )
    names = met.groupBy("claim_id").agg(
        F.sum(F.when(~F.col("own") & F.col("key").isNotNull(), F.col("n")).otherwise(0)).alias("_other"),
        F.bool_or(F.col("own") & F.col("key").isNotNull()).alias("_has_own"),
    ).select("claim_id", F.when(F.col("_has_own"), F.col("_other")).otherwise(F.lit(0)).cast("long").alias("name_mismatches"))
    parts = listing_parts(name_items(documents), ["claim_id"], ["document_type", "name"], "item", limits.listing_chars, SEPARATOR)
    rest = F.when(F.col("more") > 0, F.concat(F.lit(f"{SEPARATOR}and "), F.col("more"), F.lit(" more parts"))).otherwise("")
    text = F.concat(F.array_join("listing", SEPARATOR), rest)
    listed = _first_parts(parts, ["claim_id"]).select("claim_id", text.alias("extracted_names"))
    return names.join(listed, "claim_id", "full_outer")


def _wide_medicines(documents: DataFrame, limits: Limits) -> DataFrame:
    """Medicine lists and counts of wide claims, matched by joins."""
    medicines = materialize(distinct_medicines(_medicine_rows(documents)), "wide-medicines")
    side = F.col("side")
    counts = medicines.select("claim_id", "side", "key").distinct().groupBy("claim_id").agg(
        F.count_if(side == "PRESCRIBED").alias("prescribed_count"), F.count_if(side == "PURCHASED").alias("purchased_count"),
    )
    unmatched = materialize(unmatched_by_join(medicines).select("claim_id", "medicine"), "wide-unmatched")
    total = unmatched.groupBy("claim_id").agg(F.count(F.lit(1)).alias("unmatched_count"))
    items = medicines.select("claim_id", "side", "medicine").unionByName(unmatched.withColumn("side", F.lit("UNMATCHED")))
    first = _first_parts(listing_parts(items, ["claim_id", "side"], ["medicine"], "medicine", limits.listing_chars, SEPARATOR), ["claim_id", "side"])
    names = {"PRESCRIBED": "prescribed_items", "PURCHASED": "purchased_items", "UNMATCHED": "unmatched_items"}
    lists = first.groupBy("claim_id").agg(*[F.first(F.when(side == kind, F.col("listing")), True).alias(name) for kind, name in names.items()])
    return counts.join(lists, "claim_id").join(total, "claim_id", "left")


def _wide_findings(expected: DataFrame, wide: DataFrame, documents: DataFrame, parts: tuple[str, ...], limits: Limits) -> DataFrame:
    """The same findings for claims too wide to be matched in one row, by joins, partial aggregates and listings in parts. No claim is gathered."""
    rows = wide.select("claim_id")
    if NAMES in parts:
        rows = rows.join(_wide_names(expected, wide, documents, limits), "claim_id", "left")
    if MEDICINES in parts:
        rows = rows.join(_wide_medicines(documents, limits), "claim_id", "left")
    filled = {name: F.coalesce(name, F.lit(0)).cast("long") for name in COUNTS if name in rows.columns}
    filled |= {name: F.coalesce(name, F.array().cast("array<string>")) for name in LISTS if name in rows.columns}
    return rows.withColumns(filled)


def present_types(documents: DataFrame) -> DataFrame:
    """Which required types a claim has as an extracted document; one flag per type."""
    done = documents.filter((F.col("processing_status") == "EXTRACTED") & F.col("document_type").isin(*REQUIRED_TYPES))
    flags = [F.max(F.col("document_type") == kind).alias(f"has_{kind.lower()}") for kind in REQUIRED_TYPES]
    return done.groupBy("claim_id").agg(*flags)


def missing_types() -> Column:
    """Required types without a flag, sorted."""
    absent = [F.when(~F.coalesce(F.col(f"has_{kind.lower()}"), F.lit(False)), kind) for kind in sorted(REQUIRED_TYPES)]
    return F.array_compact(F.array(*absent))


def missing_documents(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per claim and required type it lacks. The five types are expanded inside the claim's row, after one join."""
    flags = claims.select("claim_id").join(present_types(documents), "claim_id", "left")
    return flags.select("claim_id", F.explode(missing_types()).alias("document_type"))


COUNTS = (
    "document_count", "missing_names", "admission_count", "discharge_count", "admission_variants", "discharge_variants",
    "name_mismatches", "prescribed_count", "purchased_count", "unmatched_count",
)
LISTS = ("prescribed_items", "purchased_items", "unmatched_items")


FINDINGS = {
    NAMES: ("name_mismatches", "extracted_names"), MEDICINES: (*LISTS, "prescribed_count", "purchased_count", "unmatched_count"),
    DATES: (), AMOUNTS: (),
}
TOTALS = {
    NAMES: ("missing_names",),
    DATES: (
        "admission_count", "discharge_count", "admission_variants", "discharge_variants",
        "min_admission", "max_admission", "min_discharge", "max_discharge",
    ),
    AMOUNTS: ("hospital_amount", "pharmacy_amount", "receipt_amount"), MEDICINES: (),
}


def document_features(claims: DataFrame, fields: DataFrame, limits: Limits = Limits(), parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per claim with what `parts` asks of its extracted documents, also for claims without any.

    `fields` should be a table (`stored_fields` or `stored_versions`): it is read once to look for wide claims and once or twice more.
    """
    own = claims.select("claim_id", F.col("patient_name").alias("expected_name"), "claimed_amount").withColumn(
        "expected_key", name_key(F.col("expected_name"))
    )
    totals = [name for part in parts for name in TOTALS[part]]
    findings = [name for part in parts for name in FINDINGS[part]]
    if not findings:
        rows = own.join(claim_totals(_newest(fields), parts), "claim_id", "left")
    elif (wide := wide_claims(fields, limits)).isEmpty():
        gathered = _newest(dealt_by_claim(fields)).groupBy("claim_id").agg(*_totals(parts), _gathered(parts))
        rows = _narrow_findings(own.join(gathered, "claim_id", "left"), parts)
    else:
        wide = materialize(wide, "wide-claims")
        hot = wide.filter(F.col("_parts") > 1)
        ids = wide.select("claim_id")

        def pick(how: str) -> DataFrame:
            return hot_join_with(hot, fields, ids, ["claim_id"], how, F.col("document_id"))

        expected = own.select("claim_id", "expected_key")
        gathered = _newest(dealt_by_claim(pick("left_anti"))).groupBy("claim_id").agg(_gathered(parts)).join(expected, "claim_id", "left")
        found = _narrow_findings(gathered, parts).select("claim_id", *findings).unionByName(
            _wide_findings(expected, ids, materialize(_newest(pick("inner")), "wide-fields"), parts, limits).select("claim_id", *findings)
        )
        rows = own.join(claim_totals(_newest(fields), parts), "claim_id", "left").join(found, "claim_id", "left")
    # A claim without documents has empty listings.
    filled = {name: F.coalesce(name, F.lit(0)).cast("long") for name in COUNTS if name in rows.columns}
    filled |= {name: F.coalesce(name, F.array().cast("array<string>")) for name in LISTS if name in findings}
    if NAMES in parts:
        filled["extracted_names"] = F.coalesce("extracted_names", F.lit(""))
    return rows.withColumns(filled).select("claim_id", "expected_name", "claimed_amount", "document_count", *totals, *findings)


def claim_features(claims: DataFrame, documents: DataFrame, fields: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`document_features` and which required document types are missing."""
    rows = document_features(claims, fields, limits).join(present_types(documents), "claim_id", "left")
    flags = [f"has_{kind.lower()}" for kind in REQUIRED_TYPES]
    return rows.withColumn("missing_types", missing_types()).drop(*flags)


def claim_evidence(latest: DataFrame) -> DataFrame:
    """What the listings of a claim are made of, one row per document or medicine; never gathered per claim."""
    names = latest.select(
        "claim_id", F.lit("NAME").alias("kind"), F.col("document_id").alias("source"),
        _label(F.col("document_type"), F.col("patient_name")).alias("item"),
    )
    medicines = distinct_medicines(_medicine_rows(latest))
    sides = medicines.select("claim_id", F.col("side").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("medicine").alias("item"))
    return names.unionByName(sides)


def claim_listings(latest: DataFrame, most: int = Limits.listing_chars) -> DataFrame:
    """claim_id, kind, part, n_items and listing of every claim's names and medicines, whole, in parts of about `most` characters."""
    names = name_items(latest).select("claim_id", F.lit("NAME").alias("kind"), "document_type", "name", "item")
    medicines = distinct_medicines(_medicine_rows(latest))
    sides = medicines.select("claim_id", F.col("side").alias("kind"), F.lit("").alias("document_type"), F.col("medicine").alias("name"), F.col("medicine").alias("item"))
    items = materialize(names.unionByName(sides), "listing-items")
    return listing_parts(items, ["claim_id", "kind"], ["document_type", "name"], "item", most, SEPARATOR)
