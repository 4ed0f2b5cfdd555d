"""Field extraction, payload envelopes, line items, scores and page layout."""

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.errors import is_outage
from claimweave.functions.variants import is_object, null_as_null, parts_at, texts_at, value_at, wrapped
from claimweave.operators.latest import newest_first, newest_per_key
from claimweave.operators.skew import hot_join
from claimweave.sources.templates import TABLES

Extractor = Callable[[object, dict], dict]

# A registry of up to so many templates is sent to every executor; a response format has a few kilobytes.
MAX_TEMPLATES = 1_000


def pattern_extractor(content, response_format: dict) -> dict:
    """Bundled extractor: reads each field with the regular expression given as its description.

    The first match counts; with a group in the pattern, the group.
    """
    response, scoring = {}, {}
    for field, definition in response_format["schema"]["properties"].items():
        found = re.search(definition["description"], content)
        response[field] = (found.group(found.re.groups and 1) or None) if found else None
        scoring[field] = 1.0 if response[field] else 0.0
    return {"response": response, "scoring": scoring, "error": None}


def extract_documents(
    documents: DataFrame, templates: DataFrame, key: str, content: str, extractor: Extractor, outage: Callable[[BaseException], bool] = is_outage
) -> DataFrame:
    """Payload text per document, produced by a pluggable extractor on the executors.

    `documents` has `key`, `content` and template_id; `templates` holds one resolved version per id. A document whose
    extractor raises, or whose template is not known, gets an error payload with the error's class; the others go on. An error that
    `outage` says is not about the document (a service, a disk, memory) ends the job. Contents stay where they are: up to
    MAX_TEMPLATES formats travel to them; beyond, formats are joined to the ids first and only the format's text joins the contents.
    """
    formats = templates.select("template_id", F.to_json("response_format").alias("_format"))
    wanted = documents.select(key, content, "template_id")
    few = formats.limit(MAX_TEMPLATES + 1).collect()
    shared = None
    if len(few) <= MAX_TEMPLATES:
        shared = documents.sparkSession.sparkContext.broadcast({row["template_id"]: row["_format"] for row in few})
        asked = wanted
    else:
        asked = hot_join(wanted, formats, ["template_id"], "left", F.col(key)).select(key, content, "_format")
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for batch in batches:
            payloads = []
            texts = batch["_format"] if shared is None else batch["template_id"].map(shared.value)
            for value, text in zip(batch[content], texts):
                try:
                    if not isinstance(text, str):
                        raise LookupError("unknown template")
                    if text not in known:
                        known[text] = json.loads(text)
                    result = extractor(value, known[text])
                except Exception as problem:
                    if outage(problem):
                        raise
                    result = {"response": None, "scoring": None, "error": {"message": str(problem), "code": type(problem).__name__}}
                payloads.append(json.dumps(result))
            yield pd.DataFrame({key: batch[key], "payload": payloads})

    return asked.mapInPandas(run, f"{key} {key_type}, payload string")


def extract_by_patterns(documents: DataFrame, templates: DataFrame, key: str, content: str) -> DataFrame:
    """What `extract_documents` gives with the bundled extractor, by regular expressions inside Spark: no Python on the executors.

    `templates` is a registry of at most MAX_TEMPLATES rows. Its patterns are data: they travel to the contents, and one expression looks for
    all of a document's fields, each pattern once. So the plan has one size, whatever the registry.
    """
    spark = documents.sparkSession
    formats = templates.select("template_id", F.to_json("response_format").alias("format")).limit(MAX_TEMPLATES + 1).collect()
    if len(formats) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    asked = []
    for row in formats:
        fields = json.loads(row["format"])["schema"]["properties"]
        patterns = [(d["description"], 1 if re.compile(d["description"]).groups else 0) for d in fields.values()]
        asked.append((row["template_id"], list(fields), patterns))
    registry = spark.createDataFrame(asked, "template_id string, _names array<string>, _patterns array<struct<pattern:string,part:int>>")
    wanted = documents.select(key, content, "template_id").join(F.broadcast(registry), "template_id", "left")
    found = F.transform("_patterns", lambda p: F.call_function("regexp_extract", F.col(content), p["pattern"], p["part"]))
    found = wanted.select(key, "_names", found.alias("_found"))
    whole = F.struct(
        F.map_from_arrays("_names", F.transform("_found", lambda text: F.when(text != "", text))).alias("response"),
        F.map_from_arrays("_names", F.transform("_found", lambda text: F.when(text != "", 1.0).otherwise(0.0))).alias("scoring"),
        F.lit(None).cast("string").alias("error"),
    )
    unknown = {"response": None, "scoring": None, "error": {"message": "unknown template", "code": "LookupError"}}
    payload = F.when(F.col("_names").isNull(), json.dumps(unknown)).otherwise(F.to_json(whole, {"ignoreNullFields": "false"}))
    return found.select(key, payload.alias("payload"))


def _first_match(content: str, pattern: str) -> Column:
    """First match of a pattern, or of its group; NULL where nothing matches."""
    return F.nullif(F.regexp_extract(content, pattern, 1 if re.compile(pattern).groups else 0), F.lit(""))


def extract_patterns(documents: DataFrame, content: str, patterns: dict[str, str]) -> DataFrame:
    """Ad-hoc questions as native regular expressions: one text column per field, NULL where nothing matches."""
    return documents.withColumns({field: _first_match(content, pattern) for field, pattern in patterns.items()})


def parse_envelope(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Replaces payload text by the parsed VARIANT, an error text and a status: all that an outcome needs, in narrow columns.

    A payload without error is EXTRACTED, even with an empty response; an absent or malformed payload is FAILED.
    """
    parsed = rows.withColumn("extraction_result", F.try_parse_json(payload))
    parsed = parsed.withColumn("_error", F.try_variant_get("extraction_result", "$.error", "variant"))
    unusable = F.when(F.col(payload).isNull(), "no payload").when(F.col("extraction_result").isNull(), "invalid payload")
    error_text = F.coalesce(unusable, null_as_null(F.col("_error")).cast("string"))
    return parsed.withColumn("error_message", error_text).withColumn(
        "extraction_status", F.when(F.col("error_message").isNull(), "EXTRACTED").otherwise("FAILED")
    ).drop(payload, "_error")


def envelope_parts(parsed: DataFrame) -> DataFrame:
    """Adds response, scoring and error of a parsed envelope as VARIANT objects. Values that are no object are wrapped.

    The envelope is read once. Rows that met no payload at all (a left join) become FAILED here.
    """
    message = F.when(F.col("extraction_status").isNull(), "no payload").otherwise(F.col("error_message"))
    rows = parsed.withColumns({"error_message": message, "extraction_status": F.coalesce("extraction_status", F.lit("FAILED"))})
    rows = rows.withColumn("_parts", parts_at(F.col("extraction_result"), ["response", "scoring", "error"]))

    def as_object(name: str, field: str, as_text: bool = False) -> Column:
        part = F.col(f"_parts.{name}")
        lone = wrapped(field, part.cast("string") if as_text else part)
        return F.when(part.isNull() | F.is_variant_null(part), F.lit(None).cast("variant")).when(is_object(part), part).otherwise(lone)

    error_object = F.when(F.col("extraction_result").isNull(), wrapped("message", F.col("error_message"))).otherwise(as_object("error", "message", True))
    return rows.withColumns({
        "extracted_response": as_object("response", "value"),
        "extraction_scoring": as_object("scoring", "value"),
        "extraction_error": error_object,
    }).drop("_parts")


def split_envelope(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Splits payload text `{"response", "scoring", "error"}` into VARIANT columns, a status and an error text."""
    return envelope_parts(parse_envelope(rows, payload))


def newest_typed(extractions: DataFrame, types: tuple[str, ...] | None, *fields: Column) -> DataFrame:
    """claim_id, document_id, document_type and typed fields of every document's newest successful extraction of some types.

    Status and type are filtered, and fields taken out of the payload, before the newest row is chosen: no VARIANT is shuffled.
    """
    done = extractions.filter(F.col("extraction_status") == "EXTRACTED")
    if types:
        done = done.filter(F.col("document_type").isin(*types))
    typed = done.select("claim_id", "document_id", "document_type", "extraction_id", "extracted_at", *fields)
    return newest_per_key(typed, ["claim_id", "document_id"], newest_first("extracted_at", "extraction_id")).drop("extraction_id", "extracted_at")


def line_items(extractions: DataFrame, document_type: str) -> DataFrame:
    """Rows of a document's table, which is stored as one list per column. Short lists are padded with NULL."""
    table, columns = TABLES[document_type]
    lists = [
        F.coalesce(texts_at(F.col("extracted_response"), f"{table}.{column}"), F.array().cast("array<string>")).alias(column)
        for column in columns
    ]
    typed = newest_typed(extractions, (document_type,), *lists)
    zipped = typed.select("claim_id", "document_id", F.posexplode(F.arrays_zip(*columns)).alias("position", "item"))
    return zipped.select("claim_id", "document_id", (F.col("position") + 1).alias("item_no"), "item.*")


def flatten_medicines(extractions: DataFrame) -> DataFrame:
    """One row per medicine named in a prescription (PRESCRIBED) or pharmacy invoice (PURCHASED); nulls are left out."""
    kind, response = F.col("document_type"), F.col("extracted_response")
    names = F.when(kind == "PRESCRIPTION", texts_at(response, "medicines.medicine_name")).when(
        kind == "PHARMACY_INVOICE", texts_at(response, "medicine_items.medicine_name")
    )
    side = F.when(kind == "PRESCRIPTION", "PRESCRIBED").otherwise("PURCHASED")
    typed = newest_typed(extractions, ("PRESCRIPTION", "PHARMACY_INVOICE"), names.alias("names"))
    listed = typed.select("claim_id", "document_id", side.alias("side"), F.explode("names").alias("medicine"))
    return listed.filter(F.col("medicine").isNotNull())


def extraction_scores(extractions: DataFrame) -> DataFrame:
    """One row per scored field; a score that is no number is NULL."""
    values = F.try_variant_get("extraction_scoring", "$", "map<string,variant>")
    scores = F.transform_values(values, lambda _, value: F.try_variant_get(value, "$", "double"))
    typed = newest_typed(extractions, None, scores.alias("scores"))
    return typed.select("claim_id", "document_id", "document_type", F.explode("scores").alias("field", "score"))


# Tags that start a block, with the name of the block kind; any other tag is plain text.
BLOCK_KINDS = {
    "title": "TITLE", "h1": "HEADING", "h2": "HEADING", "h3": "HEADING", "h4": "HEADING", "h5": "HEADING", "h6": "HEADING",
    "p": "PARAGRAPH", "li": "LIST_ITEM", "td": "TABLE_CELL", "th": "TABLE_CELL", "a": "LINK", "footer": "FOOTER",
}
_INVISIBLE = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
# A tag starts with a letter or slash; any other angle bracket is text.
_TAG = r"(?s)<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>"
_EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"


def parse_layout(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Text blocks of marked-up pages in reading order, each with the kind of the tag before it.

    The page is cut at its tags, so text before the first tag, or on a page without any, is a block like others.
    """
    visible = F.regexp_replace(html, _INVISIBLE, "")
    texts = F.split(visible, _TAG)
    tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(visible, F.lit(_TAG), F.lit(1)))
    cleaned = F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("raw")), lambda s: F.struct(
        F.lower(s["tag"]).alias("tag"), F.regexp_replace(s["raw"], _EDGES, "").alias("text")
    ))
    blocks = F.filter(cleaned, lambda s: s["text"] != "")
    rows = pages.select(key, F.posexplode(blocks).alias("position", "block"))
    kinds = F.create_map(*[F.lit(part) for pair in BLOCK_KINDS.items() for part in pair])
    return rows.select(
        key,
        (F.col("position") + 1).alias("block_no"),
        F.coalesce(F.try_element_at(kinds, F.col("block.tag")), F.lit("TEXT")).alias("block_type"),
        F.col("block.text").alias("text"),
    )
