import json

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossweave.operators.consensus import build_consensus, drop_sentinel
from glossweave.sources import files
from glossweave.operators import evaluate, validate
from glossweave.streaming.submissions import consensus_stream, flatten_stream, merged_table, stream_submissions


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_export(spark, tmp_path):
    one = {"articleTitles": [{"id": 4, "title": "The Tide"}], "completionCode": "c", "textAnnotations": {"4": [{"category": "C", "subcategory": "S", "text": "slow harbour tide"}, {"category": "N", "subcategory": "N", "text": "no polarizing language selected"}]}}
    df = files.submission_spans(files.read_submissions(spark, put(tmp_path, "s.json", {"w2": one, "w1": one})))
    assert [(r.worker, r.article_id, r.title) for r in df.orderBy("ord").collect()] == [("w2", 4, "The Tide")] * 2 + [("w1", 4, "The Tide")] * 2
    (gold,) = build_consensus(drop_sentinel(df)).collect()
    assert (gold.num_supporters, gold.confidence, gold.text) == (2, 0.67, "slow harbour tide")
    assert json.loads(files.gold_json(build_consensus(drop_sentinel(df))).first()[0])["spans"][0]["num_supporters"] == 2


@pytest.mark.parametrize("bad", ["", "  \n", "{", '{"a": '])
def test_bad_json(spark, tmp_path, bad):
    with pytest.raises((ValueError, Py4JError, PySparkException)):
        files.flatten_llm(spark, put(tmp_path, "b.json", bad)).collect()


def test_llm_shapes(spark, tmp_path):
    nested = [{"title": "T", "items": [], "annotations": [{"text": "a", "category": "C"}]}, {"items": [{"text": "b"}], "annotations": [{"text": "no"}]}, {"title": "U"}]
    rows = files.flatten_llm(spark, put(tmp_path, "n.json", nested)).orderBy("ord").collect()
    assert [(r.title, r.text, r.category, r.subcategory) for r in rows] == [("T", "a", "C", ""), ("UNKNOWN_TITLE", "b", "", "")]
    flat = files.flatten_llm_flat(spark, put(tmp_path, "f.json", [{"title": None, "text": "x", "category": None}])).first()
    assert (flat.title, flat.text, flat.category) == ("UNKNOWN_TITLE", "x", "")
    gold = files.flatten_gold(spark, put(tmp_path, "g.json", {"9": [{"title": "T", "text": "x"}], "8": [{"text": "y"}]})).orderBy("ord").collect()
    assert [(r.title, r.text) for r in gold] == [("T", "x"), ("UNKNOWN_TITLE", "y")]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'Headline,News body\n"A, b","x\ny ""q"""\n\nC,d\n')
    assert [tuple(r) for r in files.read_articles(spark, path).orderBy("id").collect()] == [(1, "A, b", 'x\ny "q"'), (2, "C", "d")]
    cells = files.read_cells(spark, path)
    assert cells.count() == 3
    files.write_csv(cells, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_cells(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, cells.collect()))


def test_usage_and_log(spark, tmp_path):
    assert files.read_usage(spark, str(tmp_path / "none")).isEmpty()
    log = spark.sql("SELECT 'A  b' title, 'w' worker, 1 saved_at, 'old' payload UNION ALL SELECT 'A b', 'w', 2, 'new' UNION ALL SELECT NULL, 'w', 1, 'x'")
    assert {(r.safe_title, r.payload) for r in files.latest_annotations(log).collect()} == {("A_b", "new"), (None, "x")}


def test_objects_of_consensus_and_comparison(spark):
    gold = spark.sql("SELECT 25L article_id, 1L leader, 'T' title, 'x' text, 'C' category, 'S' subcategory, 0.5D confidence, 2 num_supporters, true label_consistent UNION ALL SELECT 7, 1, null, 'y', 'C', 'S', 0.33, 1, true")
    made = json.loads(files.gold_object(gold).first().value)
    assert {k: [s["text"] for s in v] for k, v in made.items()} == {"25": ["x"], "7": ["y"]}
    assert json.loads(files.gold_object(gold.limit(0)).first().value) == {}
    counts = spark.createDataFrame([("T", 1, 3, 2)], "title string, correct bigint, total_llm bigint, total_gold bigint")
    out = json.loads(files.comparison_object(evaluate.scores(counts), evaluate.overall(counts)).first().value)
    assert out["overall"]["article_match"] == {"precision": 0.333, "recall": 0.5, "f1": 0.4, "correct_matches": 1, "total_llm": 3, "total_gold": 2}
    assert out["per_article"]["T"]["category_match"] == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "correct_matches": 1, "total_matches": 1}


def test_append_annotation(spark):
    df = spark.sql("SELECT map('1', array('a')) m UNION ALL SELECT null")
    got = df.select(validate.append_annotation(F.col("m"), F.lit("1"), F.lit("b")).alias("m"), validate.append_annotation(F.col("m"), F.lit("2"), F.lit("b")).alias("n")).collect()
    assert [(r.m, r.n) for r in got] == [({"1": ["a", "b"]}, {"1": ["a"], "2": ["b"]}), ({"1": ["b"]}, {"2": ["b"]})]


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("",), (" ",)], "value string")
    assert [r.j.a for r in files.load_json_lines(lines, "struct<a: int>").collect()] == [1]
    with pytest.raises((Py4JError, PySparkException)):
        files.load_json_lines(spark.createDataFrame([("{",)], "value string"), "struct<a: int>").collect()


def test_stream(spark, tmp_path):
    one = json.dumps({"completionCode": "c", "textAnnotations": {"4": [{"category": "C", "subcategory": "S", "text": "slow harbour tide"}]}})
    source, tables, out = (str(tmp_path / x) for x in ("in", "t", "g"))

    def send(at, *keys):
        rows = spark.createDataFrame([(k, one) for k in keys], "submission_key string, payload string").withColumn("received_at", F.lit(at).cast("timestamp"))
        rows.select("submission_key", "received_at", "payload").coalesce(1).write.mode("append").parquet(source)

    send("2025-06-01", "a", "a", "b", None, None)
    query = consensus_stream(stream_submissions(spark, source), tables, out, str(tmp_path / "cp")).start()
    query.processAllAvailable()
    send("2025-01-01", "a", "c", None)  # months late, and one key sent again
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(tables).where("tag = 'annotations'").count() == 4
    kept = merged_table(spark, tables, "annotations").collect()
    assert sorted((r.submission_key, r.received_at.month) for r in kept) == [("a", 1), ("b", 6), ("c", 1)]
    assert merged_table(spark, tables, "rejects").count() == 3
    assert [spark.read.parquet(f"{out}/batch={n}").first().num_supporters for n in (0, 1)] == [2, 3]
    query = flatten_stream(stream_submissions(spark, source), str(tmp_path / "f"), str(tmp_path / "cp2")).start()
    query.processAllAvailable()
    query.stop()
    assert merged_table(spark, str(tmp_path / "f"), "submissions").count() == 3
