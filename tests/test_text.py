import pytest
from pyspark.sql import functions as F

from glossweave.functions import text as t
from glossweave.operators import repair, validate


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    ("text", "norm"),
    [("Decades-Old!", "decadesold"), ("snake_case", "snake_case"), ("É, ô", "é ô"), ("\t a b \n", "a b"), ("", ""), (None, ""), ("²½", "²½")],
)
def test_normalize(spark, text, norm):
    assert one(spark, t.normalize_text(F.col("x")), x=text) == norm


def test_tokenize(spark):
    assert one(spark, t.tokenize(F.col("x")), x="  Well-known,   it's!  ") == ["wellknown", "its"]
    assert one(spark, t.tokenize(F.col("x")), x=" .. ") == []


@pytest.mark.parametrize(("label", "norm"), [("A_B", "a b"), (" a b ", "a b"), (None, ""), ("Name-Calling", "name-calling")])
def test_label(spark, label, norm):
    assert one(spark, t.normalize_label(F.col("x")), x=label) == norm


def test_window(spark):
    f = t.intersect_window(F.col("a"), F.col("b"))
    assert one(spark, f, a="one two three four five six seven", b="zero four") == "zero four"
    assert one(spark, f, a="x y", b="p q") is None
    assert one(spark, f, a="", b="p q") is None
    assert one(spark, f, a="a b c hit d e f", b="k l m n hit o p q r s") == "b c hit d e"


def test_title_case(spark):
    assert one(spark, t.title_capitalization(F.col("x")), x="the iPhone in NYC  now") == "the IPhone in NYC  Now"


def test_paragraphs(spark):
    words = ["w"] * 149 + ["end."] + ["tail"]
    p = t.paragraphs(F.col("x"))
    assert [len(x.split()) for x in one(spark, p, x=" ".join(words))] == [150, 1]
    quoted = ['"w'] + ["w"] * 148 + ["end."] + ['tail."']
    assert len(one(spark, p, x=" ".join(quoted))) == 1
    assert one(spark, p, x=None) is None


@pytest.mark.parametrize(("n", "valid"), [(3, False), (4, True), (25, True), (26, False), (0, False)])
def test_selection(spark, n, valid):
    assert one(spark, validate.selection_valid(F.col("x")), x=" ".join(["w"] * n)) is valid


def test_survey(spark):
    df = spark.createDataFrame([(3, 2, "x"), (0, 2, "x"), (3, 2, "  "), (None, 1, "x"), (3, 1, None)], "c int, b int, f string")
    assert [r[0] for r in df.select(validate.survey_complete(F.col("c"), F.col("b"), F.col("f"))).collect()] == [True, False, False, False, False]


def test_annotations(spark):
    df = spark.sql("SELECT array(named_struct('category', 'a', 'subcategory', '')) x UNION ALL SELECT array() UNION ALL SELECT null")
    assert [tuple(r) for r in df.select(validate.any_annotation(F.col("x")), validate.all_labelled(F.col("x"))).collect()] == [(True, False), (False, True), (False, True)]


def test_repair(spark):
    df = spark.createDataFrame([("caf√©",), ("cafÃ©",), ("café",), (None,), ("√2",)], "x string")
    assert [r[0] for r in df.select(repair.repair_cell("x")).collect()] == ["café", "café", "café", None, "√2"]
    assert one(spark, repair.latin1_repair(repair.latin1_garble(F.col("x"))), x="naïve “x”") == "naïve “x”"


def test_codes(spark):
    assert one(spark, t.completion_code(F.col("x")), x="k") == one(spark, t.completion_code(F.col("x")), x="k")
    assert one(spark, t.safe_title(F.col("x")), x="a  b\tc") == "a_b_c"
    assert one(spark, t.file_timestamp(F.to_timestamp("x")), x="2025-01-02 03:04:05.678") == "2025-01-02T03-04-05-678Z"
