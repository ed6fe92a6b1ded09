"""Typed values mapped to a canonical list by a partition-based pigeonhole join, in SQL alone."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.session import cut

# Cyrillic and Greek letters that look like Latin ones, and those letters.
LOOKALIKES = ("аеорсухікмтвнАВЕКМНОРСТУХІјЈѕЅԁοαε", "aeopcyxikmtbhABEKMHOPCTYXIjJsSdoae")

#: Latin letters with accents, by their decomposition, and the letters without.
_ACCENTED = [c for c in map(chr, range(0xDF, 0x250)) if c.islower() and unicodedata.normalize("NFKD", c)[0].isascii() and len(c.upper()) == 1]
LATIN = ("".join(_ACCENTED) + "łøđ", "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED) + "lod")

#: Edits allowed for a reference string, by its length; a transposition is two of them.
EDITS = "CASE WHEN length({0}) <= 3 THEN 0 WHEN length({0}) <= 5 THEN 2 WHEN length({0}) <= 7 THEN 3 ELSE 4 END"
#: Slips allowed (a transposition is one), from the edits and the letters put in, left out or exchanged.
SLIPS = "CASE WHEN length({0}) <= 5 THEN 1.0 ELSE 2.0 END"
#: Least letters of a shortened value.
PREFIX = 4


def _letters(x: str) -> str:
    return f"regexp_replace({x}, '[^\\\\p{{L}}\\\\p{{N}}]', '')"


def _folded(x: str) -> str:
    """In lower case and in Latin letters without accents, as far as they look like these."""
    return f"translate(lower(translate({x}, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')), '{LATIN[0]}', '{LATIN[1]}')"


def _in_order(x: str) -> str:
    return _letters(f"array_join(array_sort(split(regexp_replace({x}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' ')), '')")


def _gone(a: str, b: str) -> str:
    """Letters of a, counted with their number, that b lacks."""
    return f"aggregate(array_distinct(split({a}, '')), 0, (n, c) -> n + CASE WHEN c = '' THEN 0 ELSE greatest(0, length({a}) - length(replace({a}, c, '')) - (length({b}) - length(replace({b}, c, '')))) END)"


#: Views it reads: `typed` (kind, value, n: each value once, with its number of rows) and `reference` (ref_id, kind, name).
MEANT = f"""
WITH cleaned AS (
  -- in lower case, in Latin letters, without a counter before it or a bracket after it
  SELECT kind, value,
    regexp_replace(regexp_replace({_folded("value")},
      '^[^\\\\p{{L}}\\\\p{{N}}#(]*([#]?[0-9]+[.):]?[ ]+|[(]?[\\\\p{{L}}\\\\p{{N}}][.):][ ]+)?', ''), '[ ]*[(\\\\[][^)\\\\]]*[)\\\\]][^\\\\p{{L}}\\\\p{{N}}]*$', '') AS t
  FROM typed
), variants AS (
  -- a value as it is, its words in order, and what stands before a remark
  SELECT DISTINCT kind, value, v, how FROM (
    SELECT kind, value, {_letters("t")} AS v, 0 AS how FROM cleaned
    UNION ALL
    SELECT kind, value, {_in_order("t")}, 1 FROM cleaned WHERE trim(t) RLIKE '[\\\\p{{L}}\\\\p{{N}}][^\\\\p{{L}}\\\\p{{N}}]+[\\\\p{{L}}\\\\p{{N}}]'
    UNION ALL
    SELECT kind, value, {_letters("regexp_replace(t, '( [-/] |, | - ).*$', '')")}, 2 FROM cleaned WHERE t RLIKE ' [-/] |, '
  ) WHERE v <> ''
), names AS (
  SELECT DISTINCT ref_id, kind, r, how FROM (
    SELECT ref_id, kind, {_letters(_folded("name"))} AS r, 0 AS how FROM reference
    UNION ALL
    SELECT ref_id, kind, {_in_order(_folded("name"))}, 1 FROM reference
  ) WHERE r <> ''
), sized AS (
  SELECT *, {EDITS.format("r")} AS k FROM names
), segments AS (
  -- k + 1 segments: k edits leave one of them whole, at most k places from where it was
  SELECT ref_id, kind, r, how, k, i, CAST(floor(i * length(r) / (k + 1)) AS INT) AS at,
    substring(r, CAST(floor(i * length(r) / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * length(r) / (k + 1)) AS INT) - CAST(floor(i * length(r) / (k + 1)) AS INT)) AS segment
  FROM sized LATERAL VIEW explode(sequence(0, k)) AS i
), probes AS (
  -- the same substrings of the values, at every place that a segment can have moved to
  -- (shapes of segments are broadcast: at most four for each place in the longest reference string, kind and form)
  SELECT /*+ BROADCAST(s) */ DISTINCT v.kind, v.v, v.how, s.size, s.at, substring(v.v, p + 1, s.size) AS piece
  FROM (SELECT DISTINCT kind, v, how FROM variants) v
  JOIN (SELECT kind, how, at, length(segment) AS size, max(k) AS k, min(length(r) - k) AS least, max(length(r) + k) AS most FROM segments GROUP BY kind, how, at, length(segment)) s
    ON v.kind = s.kind AND (v.how = s.how OR (v.how = 2 AND s.how = 0)) AND length(v.v) BETWEEN s.least AND s.most
  LATERAL VIEW explode(sequence(greatest(0, s.at - s.k), greatest(0, least(s.at + s.k, length(v.v) - s.size)))) AS p
), candidates AS (
  SELECT DISTINCT p.kind, p.v, p.how, s.ref_id, s.r, s.k
  FROM probes p JOIN segments s ON p.kind = s.kind AND p.piece = s.segment AND p.size = length(s.segment) AND p.at = s.at AND (p.how = s.how OR (p.how = 2 AND s.how = 0))
  WHERE abs(length(p.v) - length(s.r)) <= s.k
), verified AS (
  SELECT *, (levenshtein(v, r) + greatest({_gone("v", "r")}, {_gone("r", "v")})) / 2.0 AS slips FROM candidates WHERE levenshtein(v, r) <= k
), prefixes AS (
  -- a shortened value is the beginning of names of one entry only
  SELECT v.kind, v.v, v.how, min(n.ref_id) AS ref_id
  FROM (SELECT DISTINCT kind, v, how FROM variants WHERE how = 0 AND length(v) >= {PREFIX}) v
  JOIN (SELECT DISTINCT ref_id, kind, substring(r, 1, size) AS beginning FROM names LATERAL VIEW explode(sequence({PREFIX}, greatest({PREFIX}, length(r) - 1))) AS size WHERE how = 0 AND length(r) > {PREFIX}) n
    ON v.kind = n.kind AND v.v = n.beginning
  GROUP BY v.kind, v.v, v.how HAVING count(DISTINCT n.ref_id) = 1
), meant AS (
  SELECT kind, value, min_by(ref_id, struct(slips, step, ref_id)) AS ref_id FROM (
    SELECT v.kind, v.value, c.ref_id, c.slips, v.how AS step FROM variants v JOIN verified c ON v.kind = c.kind AND v.v = c.v AND v.how = c.how WHERE c.slips <= {SLIPS.format("c.r")}
    UNION ALL
    SELECT v.kind, v.value, p.ref_id, 1.5, 3 FROM variants v JOIN prefixes p ON v.kind = p.kind AND v.v = p.v AND v.how = p.how
  ) GROUP BY kind, value
)
SELECT kind, value, ref_id FROM meant
"""

#: The typed values with the entry that they mean (`meant`, as above), and the unmatched ones.
ANSWERS = """
SELECT kind, value, n, ref_id FROM {typed} JOIN {meant} USING (kind, value)
UNION ALL
SELECT kind, value, n, 0 FROM {typed} LEFT ANTI JOIN {meant} USING (kind, value)
"""


def map_to_canonical(typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(kind, value, n, ref_id): each typed value with the entry that it means, or 0 if it means none.

    `typed` has kind, value and n (rows that the value stands for), each value once; `reference` has
    ref_id, kind and name, one row for each canonical name or alias. Values meet entries of their own
    kind only. Letter case, accents, separators, counters, bracketed remarks, word order and look-alike letters
    don't count, letters and digits of all scripts do; slips do, up to SLIPS; a shortened value must fit one entry. The nearest entry wins,
    ties go to the smallest ref_id. Values without letters or digits mean none.
    """
    spark = typed.sparkSession
    typed = cut(typed)
    meant = cut(spark.sql(MEANT.replace("{", "{{").replace("}", "}}").replace("FROM typed", "FROM {typed}").replace("FROM reference", "FROM {reference}"), typed=typed, reference=reference))
    return spark.sql(ANSWERS, typed=typed, meant=meant)


def _rows(spark, d):
    t = spark.read.parquet(f"{d}/test_chatgpt.parquet")
    return t.select("llm_id", F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("subcategory").alias("kind"), F.col("subcategory").alias("value")))).alias("f")).select("llm_id", "f.*").where("value IS NOT NULL AND value RLIKE '[^\\\\s\\\\p{Z}]'")


def _mapped(spark, d):
    ref = spark.read.parquet(f"{d}/label_reference.parquet")
    exact = ref.select(F.col("ref_kind").alias("kind"), F.col("canonical").alias("value"))
    rows = _rows(spark, d).join(exact, ["kind", "value"], "left_anti")
    names = ref.select("ref_id", F.col("ref_kind").alias("kind"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return rows, map_to_canonical(rows.groupBy("kind", "value").agg(F.count("*").alias("n")), names)


def p2_found(spark, d):
    rows, mapped = _mapped(spark, d)
    return rows.join(mapped, ["kind", "value"]).select("llm_id", F.col("kind").alias("field_name"), F.col("ref_id").cast("int").alias("ref_id"))


def p2_unmatched(spark, d):
    """Values that mean no entry, with their number of rows."""
    return _mapped(spark, d)[1].where("ref_id = 0").select(F.col("kind").alias("field_name"), "value", F.col("n").alias("n_rows"))


def _only(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _sorted(x: str) -> str:
    return _only(f"array_to_string(list_sort(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), '')")


def _lost(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: CASE WHEN c = '' THEN 0 ELSE greatest(0, length({a}) - length(replace({a}, c, '')) - (length({b}) - length(replace({b}, c, '')))) END)), 0)"


#: The same rules in DuckDB by brute force: every value against every name, without segments.
_BRUTE = f"""WITH fields AS (
  SELECT llm_id, 'category' AS kind, category AS value FROM test_chatgpt UNION ALL SELECT llm_id, 'subcategory', subcategory FROM test_chatgpt
), spelled AS (
  SELECT * FROM fields f WHERE regexp_matches(value, '[^\\s\\p{{Z}}]') AND NOT EXISTS (SELECT 1 FROM label_reference r WHERE r.ref_kind = f.kind AND r.canonical = f.value)
), cleaned AS (
  SELECT DISTINCT kind, value, regexp_replace(regexp_replace({_folded("value")},
    '^[^\\p{{L}}\\p{{N}}#(]*([#]?[0-9]+[.):]?[ ]+|[(]?[\\p{{L}}\\p{{N}}][.):][ ]+)?', ''), '[ ]*[(\\[][^)\\]]*[)\\]][^\\p{{L}}\\p{{N}}]*$', '') AS t FROM spelled
), variants AS (
  SELECT kind, value, {_only("t")} AS v, 0 AS how FROM cleaned UNION ALL
  SELECT kind, value, {_sorted("t")}, 1 FROM cleaned WHERE regexp_matches(trim(t), '[\\p{{L}}\\p{{N}}][^\\p{{L}}\\p{{N}}]+[\\p{{L}}\\p{{N}}]') UNION ALL
  SELECT kind, value, {_only("regexp_replace(t, '( [-/] |, | - ).*$', '')")}, 2 FROM cleaned WHERE regexp_matches(t, ' [-/] |, ')
), names AS (
  SELECT ref_id, ref_kind AS kind, unnest(list_concat([canonical], coalesce(aliases, []))) AS name FROM label_reference
), forms AS (
  SELECT DISTINCT ref_id, kind, {_only(_folded("name"))} AS r, 0 AS how FROM names UNION SELECT DISTINCT ref_id, kind, {_sorted(_folded("name"))}, 1 FROM names
), near AS (
  SELECT v.kind, v.value, f.ref_id, v.how AS step, (levenshtein(v.v, f.r) + greatest({_lost("v.v", "f.r")}, {_lost("f.r", "v.v")})) / 2.0 AS slips, f.r
  FROM variants v JOIN forms f ON v.kind = f.kind AND (v.how = f.how OR (v.how = 2 AND f.how = 0)) WHERE v.v <> '' AND levenshtein(v.v, f.r) <= {EDITS.format("f.r")}
), short AS (
  SELECT v.kind, v.value, min(f.ref_id) AS ref_id, 3 AS step, 1.5 AS slips FROM variants v JOIN forms f ON v.kind = f.kind AND v.how = 0 AND f.how = 0
    AND length(v.v) >= {PREFIX} AND length(v.v) < length(f.r) AND starts_with(f.r, v.v) GROUP BY 1, 2 HAVING count(DISTINCT f.ref_id) = 1
), meant AS (
  SELECT kind, value, first(ref_id ORDER BY slips, step, ref_id) AS ref_id FROM
    (SELECT kind, value, ref_id, step, slips FROM near WHERE slips <= {SLIPS.format("r")} UNION ALL SELECT kind, value, ref_id, step, slips FROM short) GROUP BY 1, 2
)"""

QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
ORACLE = {
    "p2_found": f"{_BRUTE} SELECT s.llm_id, s.kind AS field_name, coalesce(m.ref_id, 0)::INT AS ref_id FROM spelled s LEFT JOIN meant m USING (kind, value)",
    "p2_unmatched": f"{_BRUTE} SELECT s.kind AS field_name, s.value, count(*) AS n_rows FROM spelled s LEFT JOIN meant m USING (kind, value) WHERE m.ref_id IS NULL GROUP BY 1, 2",
}
