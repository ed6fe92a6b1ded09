"""Nested submissions turned into flat tables by one depth-first pass with tagged rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGGED = "tag string, submission_key string, received_at timestamp, pk string, parent_pk string, article_id bigint, pos int, payload string"

#: Columns of each flat table besides its keys, read from the tagged row's payload; `rest` has all further fields as JSON.
SCHEMAS = {
    "submissions": "completionCode string, timestamp string, rest string",
    "article_refs": "id bigint, title string, rest string",
    "survey_answers": "bias string, confidence string, openFeedback string, rest string",
    "annotations": "category string, subcategory string, text string, title string, rest string",
    "rejects": "reason string, payload string",
}
#: Fields of a submission that have tables of their own.
TABLES = ("articleTitles", "surveyResponses", "textAnnotations")


def _children(node) -> list[tuple[str, object]]:
    """(place, child) of a map, a list or a JSON text that holds one of these; nothing for other values."""
    if isinstance(node, str):
        try:
            node = json.loads(node)
        except (ValueError, RecursionError):
            return []
    if isinstance(node, dict):
        return list(node.items())
    if isinstance(node, list):
        return [(str(i), x) for i, x in enumerate(node)]
    return []


def _number(place: str) -> int | None:
    return int(place) if place.isascii() and place.isdigit() and len(place) < 19 else None


def _objects(node) -> list[tuple[int, dict]]:
    """(position, object) of a list, of a map under numbers, or of an object that stands alone (position 0)."""
    if isinstance(node, str):
        try:
            node = json.loads(node)
        except (ValueError, RecursionError):
            return []
    if isinstance(node, dict) and not (node and all(_number(k) is not None for k in node)):
        return [(0, node)] if node else []
    return [(n, x) for k, x in _children(node) if isinstance(x, dict) and (n := _number(k)) is not None and n < 2**31]


def _scalar(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _fields(node: dict, names: tuple[str, ...], known: tuple[str, ...] = ()) -> dict:
    """The named fields as scalars, and all others but the `known` ones as one JSON text in `rest` (null for none)."""
    rest = {k: v for k, v in node.items() if k not in names and k not in known}
    return {k: _scalar(node.get(k)) for k in names} | {"rest": json.dumps(rest) if rest else None}


def visit(key: str | None, payload: str | None) -> Iterator[tuple]:
    """The tagged rows of one submission: (tag, submission_key, pk, parent_pk, article_id, pos, payload).

    A payload that is null, no valid JSON or no object, and a null key, give one row of table `rejects`.
    Objects in places where null stands are skipped, but the places keep their numbers.
    """

    def row(tag, pk, parent, article, pos, fields):
        return tag, key, pk, parent, article, pos, json.dumps(fields)

    try:
        root = json.loads(payload) if payload is not None and key is not None else None
        if not isinstance(root, dict):
            yield row("rejects", key or "", None, None, None, {"reason": "null key" if key is None else "null payload" if payload is None else "no object", "payload": payload})
            return
    except (ValueError, RecursionError):
        yield row("rejects", key, None, None, None, {"reason": "invalid JSON", "payload": payload})
        return
    yield row("submissions", key, None, None, None, _fields(root, ("completionCode", "timestamp"), TABLES))
    for pos, ref in _objects(root.get("articleTitles")):
        n = _number(str(ref.get("id")))
        yield row("article_refs", f"{key}/articleTitles/{pos}", key, n, pos, {"id": n} | _fields(ref, ("title",), ("id",)))
    for place, answer in _children(root.get("surveyResponses")):
        if isinstance(answer, dict):
            yield row("survey_answers", f"{key}/surveyResponses/{place}", key, _number(place), None, _fields(answer, ("bias", "confidence", "openFeedback")))
    for place, spans in _children(root.get("textAnnotations")):
        for pos, span in _objects(spans):
            yield row("annotations", f"{key}/textAnnotations/{place}/{pos}", key, _number(place), pos, _fields(span, ("category", "subcategory", "text", "title")))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tag", "submission_key", "pk", "parent_pk", "article_id", "pos", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    for b in batches:
        made = [list(visit(k, p)) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        received = b.column(2).take(pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]), pa.int64()))
        rows = [r for m in made for r in m]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns[:2], received, *columns[2:]], names=[*names[:2], "received_at", *names[2:]])


def tag_submissions(df: DataFrame, key: str = "submission_key", received: str = "received_at", payload: str = "payload") -> DataFrame:
    """Tagged rows (table tag, primary key, parent key, payload) of raw submissions, each submission once.

    Of rows with the same key the one received first counts (ties: the smallest payload; a null time
    comes last), chosen with map-side partial aggregation, so a key sent many times meets no hot task.
    Rows with a null key go to `rejects` one by one. Extra columns of `df` are ignored.
    """
    rows = df.select(F.col(key).alias("k"), F.col(received).cast("timestamp").alias("r"), F.col(payload).alias("p"))
    order = F.struct(F.col("r").isNull(), F.col("r"), F.col("p"))
    once = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.min_by("p", order).alias("p"), F.min("r").alias("r"))
    return once.unionByName(rows.where(F.col("k").isNull())).select("k", "p", "r").mapInArrow(_emit, TAGGED)


def flat_table(tagged: DataFrame, table: str) -> DataFrame:
    """One flat table: its keys, and the payload's fields under the table's schema."""
    return (
        tagged.where(F.col("tag") == table)
        .withColumn("f", F.from_json("payload", SCHEMAS[table]))
        .select("submission_key", "received_at", "pk", "parent_pk", "article_id", "pos", "f.*")
    )


def annotation_spans(annotations: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(article_id, ord, worker, text, category, subcategory[, title]) of the flat annotations of an article, in reading order.

    `ord` is a struct: submissions in the order received (then by key), annotations by their place in the article's list.
    With `refs`, the flat article references, a span has its own title or else the one its submission gives the article.
    """
    spans = annotations.where("article_id IS NOT NULL")
    place = F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")).alias("received_at"), "submission_key", "pos", "pk")
    columns = ["article_id", place.alias("ord"), F.col("submission_key").alias("worker"), "text", "category", "subcategory"]
    if refs is None:
        return spans.select(*columns)
    given = refs.where("article_id IS NOT NULL AND title IS NOT NULL").groupBy("submission_key", "article_id").agg(F.min_by("title", "pos").alias("ref_title"))
    return spans.join(given, ["submission_key", "article_id"], "left").select(*columns, F.coalesce("title", "ref_title").alias("title"))


def write_flat_tables(tagged: DataFrame, path: str) -> None:
    """All tables in one pass, as Parquet partitioned by tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_flat_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table written by write_flat_tables; only its own partition is read."""
    return flat_table(spark.read.schema(TAGGED).parquet(path), table)
