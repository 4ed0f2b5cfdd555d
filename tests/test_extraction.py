import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.operators import extraction
from claimweave.sources import templates


def split(spark, payloads):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    rows = extraction.split_envelope(frame).orderBy("i").select(
        "extraction_status", "error_message", F.to_json("extracted_response").alias("r"), F.to_json("extraction_scoring").alias("s"),
        F.to_json("extraction_error").alias("e"),
    )
    return [tuple(r) for r in rows.collect()]


def test_envelopes(spark):
    assert split(spark, [
        '{"response":{"a":"1"},"scoring":{"a":0.5},"error":null}',
        '{"response":5,"scoring":[1],"error":null}',
        '{"response":null,"error":null}',
        '{}',
        '{"response":{"a":1},"error":"broken"}',
        '{"response":null,"error":{"code":7}}',
        '{not json',
        None,
        '17',
    ]) == [
        ("EXTRACTED", None, '{"a":"1"}', '{"a":0.5}', None),
        ("EXTRACTED", None, '{"value":5}', '{"value":[1]}', None),
        ("EXTRACTED", None, None, None, None),
        ("EXTRACTED", None, None, None, None),
        ("FAILED", "broken", '{"a":1}', None, '{"message":"broken"}'),
        ("FAILED", '{"code":7}', None, None, '{"code":7}'),
        ("FAILED", "invalid payload", None, None, '{"message":"invalid payload"}'),
        ("FAILED", "no payload", None, None, '{"message":"no payload"}'),
        ("EXTRACTED", None, None, None, None),
    ]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["response", "scoring", "error", "x"]), inner, max_size=4),
    max_leaves=8,
)


@settings(max_examples=1, deadline=None)
@given(st.lists(json_values.map(json.dumps) | st.text(max_size=12), min_size=60, max_size=120))
def test_any_text_can_be_split(spark, payloads):
    assert len(split(spark, payloads)) == len(payloads)


def test_a_failing_document_does_not_stop_the_others(spark):
    def picky(content, response_format):
        if content == "bad":
            raise ValueError("cannot read")
        return {"response": {"seen": content, "asked": sorted(response_format["schema"]["properties"])[:1]}, "scoring": None, "error": None}

    resolved = templates.resolve_templates(templates.builtin_templates(spark))
    docs = spark.createDataFrame([(1, "ok", "PAYMENT_RECEIPT_V1"), (2, "bad", "PAYMENT_RECEIPT_V1"), (3, "x", "NONE")], "id long, content string, template_id string")
    payloads = extraction.extract_documents(docs, resolved, "id", "content", picky)
    found = {r.id: r for r in extraction.split_envelope(payloads).collect()}
    assert set(found) == {1, 2, 3}
    assert found[3].extraction_status == "FAILED" and json.loads(found[3].error_message)["message"] == "unknown template"
    assert found[1].extraction_status == "EXTRACTED" and found[2].extraction_status == "FAILED"
    assert json.loads(found[2].error_message) == {"message": "cannot read", "code": "ValueError"}


def test_line_items_pad_short_columns(make_extractions):
    rows = make_extractions([
        ("c", "d1", "PHARMACY_INVOICE", {"medicine_items": {"medicine_name": ["a", None, "b"], "quantity": ["1"], "unit_price": [2.5]}}),
        ("c", "d2", "PHARMACY_INVOICE", {"medicine_items": {"medicine_name": "scalar"}}),
        ("c", "d3", "PHARMACY_INVOICE", None),
    ])
    items = [tuple(r) for r in extraction.line_items(rows, "PHARMACY_INVOICE").orderBy("document_id", "item_no").collect()]
    assert items == [
        ("c", "d1", 1, "a", None, "1", "2.5", None), ("c", "d1", 2, None, None, None, None, None), ("c", "d1", 3, "b", None, None, None, None),
    ]


def test_layout_covers_text_after_closing_tags(spark):
    html = "<html><script>var x='<p>no</p>'</script><h1> Top </h1><p>one <b>two</b> three</p><!-- <p>no</p> --><ul><li>four</li></ul></html>"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")
    blocks = [tuple(r) for r in extraction.parse_layout(pages).orderBy("page_id", "block_no").collect()]
    assert blocks == [
        (1, 1, "HEADING", "Top"), (1, 2, "PARAGRAPH", "one"), (1, 3, "TEXT", "two"), (1, 4, "TEXT", "three"), (1, 5, "LIST_ITEM", "four"),
    ]


def test_layout_keeps_all_text(spark):
    pages = spark.createDataFrame([(1, "lead text <p>a < b and more</p> tail 3 <4"), (2, "no tags at all"), (3, "<p>x</p")], "page_id long, html string")
    blocks = [(r.page_id, r.block_type, r.text) for r in extraction.parse_layout(pages).orderBy("page_id", "block_no").collect()]
    assert blocks == [
        (1, "TEXT", "lead text"), (1, "PARAGRAPH", "a < b and more"), (1, "TEXT", "tail 3 <4"), (2, "TEXT", "no tags at all"), (3, "PARAGRAPH", "x</p"),
    ]


def test_patterns_inside_spark_equal_the_bundled_extractor(spark):
    formats = {"A": {"first": "[0-9]+", "word": "name: ([a-z]+)"}, "B": {"first": "[a-z]+"}}
    rows = [(name, json.dumps({"schema": {"type": "object", "properties": {f: {"type": "string", "description": p} for f, p in fields.items()}}})) for name, fields in formats.items()]
    registry = spark.createDataFrame(rows, "template_id string, format string").select("template_id", F.parse_json("format").alias("response_format"))
    docs = spark.createDataFrame([(1, "name: bob 12", "A"), (2, "none", "A"), (3, "12 x", "B"), (4, "x", "C"), (5, "x", None)], "id long, content string, template_id string")
    native = extraction.extract_by_patterns(docs, registry, "id", "content")
    foreign = extraction.extract_documents(docs, registry, "id", "content", extraction.pattern_extractor)
    assert {r.id: json.loads(r.payload) for r in native.collect()} == {r.id: json.loads(r.payload) for r in foreign.collect()}
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_data(spark):
    """A thousand templates of twelve fields: one plan of one size, each pattern looked for once."""
    def registry(count):
        rows = []
        for number in range(count):
            fields = {f"f{i}": {"type": "string", "description": f"t{number}f{i}=([a-z]+)"} for i in range(12)}
            rows.append((f"T{number}", json.dumps({"schema": {"type": "object", "properties": fields}})))
        return spark.createDataFrame(rows, "template_id string, format string").select("template_id", F.parse_json("format").alias("response_format"))

    docs = spark.createDataFrame([(i, f"t{i}f3=abc t{i}f11=x", f"T{i}") for i in range(0, 1000, 7)], "id long, content string, template_id string")
    plans = []
    for count in (1, 1000):
        found = extraction.extract_by_patterns(docs, registry(count), "id", "content")
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        assert plans[-1].count("regexp_extract(") == 1
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    payloads = {r.id: json.loads(r.payload) for r in found.collect()}
    assert all(p["response"] == {f"f{k}": {3: "abc", 11: "x"}.get(k) for k in range(12)} and p["scoring"]["f3"] == 1.0 for p in payloads.values())


def test_an_envelope_is_read_once(spark):
    """One look for the error text, one for the three parts, one for each part's kind."""
    rows = spark.range(3).select(F.concat(F.lit('{"response":'), F.col("id").cast("string"), F.lit("}")).alias("payload"))
    plan = extraction.split_envelope(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") == 5 and plan.count("parseJson(") == 1, plan


def test_contents_and_payloads_stay_out_of_needless_shuffles(spark, make_extractions):
    rows = make_extractions([("c", "d1", "PRESCRIPTION", {"medicines": {"medicine_name": ["a"]}})])
    for frame in (extraction.line_items(rows, "PRESCRIPTION"), extraction.flatten_medicines(rows), extraction.extraction_scores(rows)):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = frame._jdf.queryExecution().explainString(mode)
        for moved in re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan):
            assert "extracted_response" not in moved and "extraction_scoring" not in moved and "extraction_result" not in moved


def test_templates(spark, tmp_path):
    catalog = templates.field_catalog(templates.builtin_templates(spark))
    assert catalog.count() == 72 and catalog.filter("kind = 'object'").count() == 4
    path = tmp_path / "templates.json"
    lines = [
        {"template_id": "T", "document_type": "OTHER", "template_version": v, "response_format": {"schema": {"properties": {f"f{v}": {"type": "string"}}}}, "is_active": a}
        for v, a in ((1, True), (3, False), (2, None))
    ]
    path.write_text("\n".join(json.dumps(line) for line in lines))
    newest = templates.resolve_templates(templates.read_templates(spark, str(path)))
    assert [(r.template_version, r.field) for r in templates.field_catalog(newest).collect()] == [(2, "f2")]
