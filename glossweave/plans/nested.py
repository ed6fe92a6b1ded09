"""Queries p6_*: nested submissions as flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators.nested import flat_table, tag_submissions


def _tagged(spark, d):
    return tag_submissions(spark.read.parquet(f"{d}/submissions.parquet"))


def p6_found(spark, d):
    t = flat_table(_tagged(spark, d), "annotations")
    return t.where(F.col("article_id").isNotNull()).select("submission_key", "article_id", "pos")


def p6_tables(spark, d):
    """Rows of all flat tables with their keys, the parent key of each and its main field."""
    main = {"submissions": "completionCode", "article_refs": "title", "survey_answers": "openFeedback", "annotations": "text", "rejects": "reason"}
    value = F.coalesce(*[F.when(F.col("tag") == t, F.get_json_object("payload", f"$.{c}")) for t, c in main.items()])
    return _tagged(spark, d).select("tag", "submission_key", "pk", "parent_pk", "article_id", "pos", value.alias("value"))


def p6_submissions(spark, d):
    return flat_table(_tagged(spark, d), "submissions").select("submission_key", "completionCode", "timestamp")


_ONCE = """once AS (
  SELECT submission_key, arg_min(payload, received_at) AS p, min(received_at) AS received_at FROM submissions GROUP BY 1
), j AS (SELECT submission_key, received_at, p::JSON AS j FROM once WHERE json_valid(p) AND json_type(p) = 'OBJECT')"""

#: CTEs up to e: every annotation object with its submission, the article's key and number, and its place.
OBJECTS = f"""{_ONCE}, t AS (
  SELECT submission_key, received_at, CASE WHEN json_type(j->'$.textAnnotations') = 'VARCHAR' AND json_valid(j->>'$.textAnnotations')
    THEN (j->>'$.textAnnotations')::JSON ELSE j->'$.textAnnotations' END AS ta FROM j
), m AS (
  SELECT submission_key, received_at, unnest(json_keys(ta)) AS k, NULL::BIGINT AS i, ta FROM t WHERE json_type(ta) = 'OBJECT'
  UNION ALL
  SELECT submission_key, received_at, NULL::VARCHAR, unnest(range(json_array_length(ta)::BIGINT)), ta FROM t WHERE json_type(ta) = 'ARRAY'
), a AS (
  SELECT submission_key, received_at, coalesce(k, i::VARCHAR) AS place, CASE WHEN k IS NULL THEN i WHEN regexp_full_match(k, '[0-9]{{1,18}}') THEN k::BIGINT END AS article_id,
    CASE WHEN k IS NOT NULL THEN json_extract(ta, '$."' || k || '"') ELSE json_extract(ta, '$[' || i || ']') END AS v FROM m
), x AS (
  SELECT *, len(list_filter(json_keys(v), lambda x: NOT regexp_full_match(x, '[0-9]+'))) AS names FROM a WHERE json_type(v) = 'OBJECT'
), e AS (
  SELECT * FROM (
    SELECT submission_key, received_at, place, article_id, pos, json_extract(v, '$[' || pos || ']') AS o FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS pos FROM a WHERE json_type(v) = 'ARRAY')
    UNION ALL
    SELECT submission_key, received_at, place, article_id, try_cast(pk AS BIGINT), json_extract(v, '$."' || pk || '"') FROM (SELECT *, unnest(json_keys(v)) AS pk FROM x WHERE names = 0)
    UNION ALL
    SELECT submission_key, received_at, place, article_id, 0, v FROM x WHERE names > 0
  ) WHERE json_type(o) = 'OBJECT' AND pos < 2147483648
)"""

QUERIES = {"p6_found": p6_found, "p6_tables": p6_tables, "p6_submissions": p6_submissions}
ORACLE = {
    "p6_submissions": f"WITH {_ONCE} SELECT submission_key, j->>'$.completionCode' AS \"completionCode\", j->>'$.timestamp' AS \"timestamp\" FROM j",
    "p6_found": f"WITH {OBJECTS} SELECT DISTINCT submission_key, article_id, pos::INT AS pos FROM e WHERE article_id IS NOT NULL",
    "p6_tables": f"""WITH {OBJECTS}, refs AS (SELECT submission_key, unnest(range(json_array_length(j->'$.articleTitles')::BIGINT)) AS pos, j->'$.articleTitles' AS l FROM j WHERE json_type(j->'$.articleTitles') = 'ARRAY'),
r AS (SELECT submission_key, pos, json_extract(l, '$[' || pos || ']') AS o FROM refs),
s AS (SELECT submission_key, unnest(json_keys(j->'$.surveyResponses')) AS k, j->'$.surveyResponses' AS l FROM j WHERE json_type(j->'$.surveyResponses') = 'OBJECT'
  UNION ALL SELECT submission_key, unnest(range(json_array_length(j->'$.surveyResponses')::BIGINT))::VARCHAR, j->'$.surveyResponses' FROM j WHERE json_type(j->'$.surveyResponses') = 'ARRAY'),
w AS (SELECT submission_key, k, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[' || k || ']') ELSE json_extract(l, '$."' || k || '"') END AS o FROM s)
SELECT 'annotations' AS tag, submission_key, submission_key || '/textAnnotations/' || place || '/' || pos AS pk, submission_key AS parent_pk, article_id, pos::INT AS pos, o->>'$.text' AS value FROM e
UNION ALL SELECT 'submissions', submission_key, submission_key, NULL, NULL, NULL, j->>'$.completionCode' FROM j
UNION ALL SELECT 'article_refs', submission_key, submission_key || '/articleTitles/' || pos, submission_key, CASE WHEN regexp_full_match(o->>'$.id', '[0-9]{{1,18}}') THEN (o->>'$.id')::BIGINT END, pos::INT, o->>'$.title' FROM r WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT 'survey_answers', submission_key, submission_key || '/surveyResponses/' || k, submission_key, CASE WHEN regexp_full_match(k, '[0-9]{{1,18}}') THEN k::BIGINT END, NULL, o->>'$.openFeedback' FROM w WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT 'rejects', submission_key, submission_key, NULL, NULL, NULL, CASE WHEN p IS NULL THEN 'null payload' WHEN json_valid(p) THEN 'no object' ELSE 'invalid JSON' END FROM once WHERE p IS NULL OR NOT json_valid(p) OR json_type(p) <> 'OBJECT'""",
}
