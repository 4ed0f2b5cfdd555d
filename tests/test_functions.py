import datetime
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.functions.parsing import parse_amount, parse_date
from claimweave.functions.text import blank_to_null, is_blank, name_key, normalize_folder, sanitize_name


def values(spark, texts, build):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row[0] for row in frame.orderBy("i").select(build(F.col("t"))).collect()]


def test_amounts(spark):
    cases = {
        "$1,234.50": Decimal("1234.50"),
        "USD 0.05": Decimal("0.05"),
        "Rs. 1,234": Decimal("0.12"),
        "(1,234.00)": Decimal("1234.00"),
        "-12.5": Decimal("-12.50"),
        "1234.565": Decimal("1234.57"),
        "500/-": None,
        "n/a": None,
        "1.2.3": None,
        "": None,
        "99999999999999999999": None,
    }
    assert values(spark, list(cases), parse_amount) == list(cases.values())


def test_dates(spark):
    cases = {
        "31-12-2024": datetime.date(2024, 12, 31),
        "2024-12-31": datetime.date(2024, 12, 31),
        "31-02-2024": None,
        "12/31/2024": None,
        "1-2-2024": None,
        "ab-cd-efgh": None,
        "": None,
    }
    assert values(spark, list(cases), parse_date) == list(cases.values())


def test_date_falls_through_to_the_next_text(spark):
    frame = spark.createDataFrame([("soon", "2024-01-02"), (None, "03-01-2024"), ("04-01-2024", "x")], "a string, b string")
    found = [str(r[0]) for r in frame.select(parse_date(F.col("a"), F.col("b"))).collect()]
    assert found == ["2024-01-02", "2024-01-03", "2024-01-04"]


def test_names(spark):
    assert values(spark, ["José Núñez", "o'Brien-2", "李", None], name_key) == ["JOSNEZ", "OBRIEN2", "", None]
    assert values(spark, [" a ", "  ", None], blank_to_null) == ["a", None, None]
    assert values(spark, ["\t\n ", "", None, "x"], is_blank) == [True, True, True, False]
    assert values(spark, ["  a/b/// ", "a", "/"], normalize_folder) == ["a/b", "a", ""]
    assert values(spark, [" Ann  Lee ", "..__a b/c__.", "###"], sanitize_name) == ["Ann_Lee", "a_b_c", ""]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=50, max_size=100))
def test_name_key_is_idempotent(spark, texts):
    once = values(spark, texts, name_key)
    assert once == values(spark, texts, lambda c: name_key(name_key(c)))
    assert all(set(key) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for key in once)
