import json

import pytest

from glossweave.operators.nested import flat_table, read_flat_table, tag_submissions, write_flat_tables
from glossweave.operators.skew import join_counted

COLS = "submission_key string, received_at timestamp, payload string, tag string"


def tagged(spark, *payloads, key="k"):
    from datetime import datetime

    rows = [(f"{key}{i}" if p is not None else f"{key}{i}", datetime(2025, 1, 1), p, "clash") for i, p in enumerate(payloads)]
    return tag_submissions(spark.createDataFrame(rows, COLS))


@pytest.mark.parametrize(
    ("annotations", "places"),
    [
        ({"7": [{"text": "a"}, None, {"text": "b"}]}, {(7, 0), (7, 2)}),
        ({"7": {"0": {"text": "a"}, "3": {"text": "b"}}}, {(7, 0), (7, 3)}),
        ({"7": {"text": "a"}}, {(7, 0)}),
        ([None, None, [{"text": "a"}]], {(2, 0)}),
        (json.dumps({"7": [{"text": "a"}]}), {(7, 0)}),
        ({"7": None, "8": "x", "9": [], "x": [{"text": "a"}]}, {(None, 0)}),
        (None, set()),
        (5, set()),
    ],
)
def test_shapes(spark, annotations, places):
    rows = flat_table(tagged(spark, json.dumps({"textAnnotations": annotations})), "annotations").collect()
    assert {(r.article_id, r.pos) for r in rows} == places


def test_tables_keep_links(spark, tmp_path):
    payload = {"completionCode": "Z", "timestamp": 5, "articleTitles": [{"id": "3", "title": None}], "surveyResponses": {"3": {"bias": "2", "confidence": 1}}, "textAnnotations": {"3": [{"text": "é\ud83d"}]}}
    write_flat_tables(tagged(spark, json.dumps(payload)), str(tmp_path / "t"))
    read = {t: read_flat_table(spark, str(tmp_path / "t"), t).collect() for t in ("submissions", "article_refs", "survey_answers", "annotations", "rejects")}
    assert (read["submissions"][0].completionCode, read["submissions"][0].timestamp) == ("Z", "5")
    assert read["article_refs"][0].id == 3
    assert (read["survey_answers"][0].bias, read["survey_answers"][0].article_id) == ("2", 3)
    assert {r.parent_pk for t in ("article_refs", "survey_answers", "annotations") for r in read[t]} == {"k0"}
    assert read["rejects"] == []


def test_rejects_and_copies(spark):
    from datetime import datetime

    deep = "[" * 100_000
    rows = [("a", datetime(2025, 1, 2), '{"completionCode": "late"}', ""), ("a", datetime(2025, 1, 1), '{"completionCode": "first"}', ""), ("b", None, "{", ""), ("c", None, None, ""), (None, None, "{}", ""), ("d", None, deep, ""), ("e", None, "[]", "")]
    t = tag_submissions(spark.createDataFrame(rows, COLS))
    assert [r.completionCode for r in flat_table(t, "submissions").collect()] == ["first"]
    assert flat_table(t, "rejects").count() == 5
    assert tag_submissions(spark.createDataFrame([], COLS)).isEmpty()


def test_hot_key_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, 0) for k in range(2, 50)] + [(None, 1)], "k int, v int")
    right = left.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    assert join_counted(left, right, ["k"], share=0.1).count() == 548
    assert join_counted(left.limit(0), right.limit(0), ["k"]).isEmpty()


def test_further_fields_are_kept(spark):
    payload = {"annotations": {"3": "x"}, "textAnnotations": {"3": [{"text": "a", "colour": [1]}]}, "surveyResponses": {"3": {"bias": 1, "mood": "ok"}}, "articleTitles": [{"id": 3, "url": None}]}
    t = tagged(spark, json.dumps(payload))
    rest = {k: json.loads(flat_table(t, k).first().rest) for k in ("submissions", "article_refs", "survey_answers", "annotations")}
    assert rest == {"submissions": {"annotations": {"3": "x"}}, "article_refs": {"url": None}, "survey_answers": {"mood": "ok"}, "annotations": {"colour": [1]}}
    assert flat_table(tagged(spark, "{}"), "submissions").first().rest is None
