"""Duplicates hidden by writing: rolling skip-and-fold hashes, then verification by two-pointer comparison."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.llm.scan import folded_hashes, mix, pieces, same_but_for_writing
from glossweave.operators.skew import join_counted
from glossweave.session import cut

#: Copies of one record that share a task while they are compared with its first record.
BLOCK = 10_000


def _leaves(node, path: str, out: list[tuple[str, str | None, object]]) -> None:
    """(path, text, other value) of each leaf; list positions are part of a path, field order is not."""
    if isinstance(node, dict):
        out.append((path, None, "{}"))
        for k, v in node.items():
            _leaves(v, f"{path}/{k}", out)
    elif isinstance(node, list):
        out.append((path, None, f"[{len(node)}]"))
        for i, v in enumerate(node):
            _leaves(v, f"{path}#{i}", out)
    elif isinstance(node, str):
        out.append((path, node, None))
    else:
        out.append((path, None, json.dumps(node)))


def json_leaves(payload: str | None) -> list[tuple[str, str | None, object]]:
    """Leaves of a JSON text; a text that is no JSON is one leaf of its own kind."""
    out: list = []
    if payload is None:
        return [("", None, None)]
    try:
        _leaves(json.loads(payload), "", out)
    except (ValueError, RecursionError):
        out = [("!", payload, None)]
    return out


def same_json(a: str | None, b: str | None) -> bool:
    x, y = (sorted(json_leaves(v), key=lambda leaf: leaf[0]) for v in (a, b))
    return len(x) == len(y) and all(p[0] == q[0] and p[2] == q[2] and same_but_for_writing(p[1], q[1]) for p, q in zip(x, y, strict=True))


def _strings(values: list[str | None]) -> pa.Array:
    return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.large_string())


def _exact(value: object, seed: int) -> int:
    """A stable 64-bit hash of a small value's text."""
    h = 0xCBF29CE484222325 ^ seed
    for b in repr(value).encode("utf-8", "replace"):
        h = (h ^ b) * 0x100000001B3 & (2**64 - 1)
    return h


def _text_hash(column: pa.Array, seed: int) -> np.ndarray:
    h, n = folded_hashes(column, seed)
    return mix(h + np.uint64(3) * n.astype(np.uint64) + np.uint64(seed + 1))


def _fingerprints(text: list[str], exact: list[str], payload: list[str], mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, *[whole.schema.get_field_index(c) for c in (*text, *payload)])):
            out = []
            for seed in (1, 2):
                total = np.zeros(b.num_rows, np.uint64)
                for c in text:
                    col = b.column(b.schema.get_field_index(c))
                    h = np.where(np.asarray(col.is_null()), np.uint64(0x1234567), _text_hash(col, seed))
                    total += mix(h ^ np.uint64(_exact(c, seed)))
                for c in exact:
                    col = b.column(b.schema.get_field_index(c))
                    h = np.fromiter((_exact(v, seed) for v in col.to_pylist()), np.uint64, b.num_rows)
                    total += mix(h ^ np.uint64(_exact(c, seed)))
                for c in payload:
                    leaves = [json_leaves(v) for v in b.column(b.schema.get_field_index(c)).to_pylist()]
                    row = np.repeat(np.arange(b.num_rows), [len(x) for x in leaves])
                    flat = [leaf for x in leaves for leaf in x]
                    h = _text_hash(_strings([leaf[1] for leaf in flat]), seed)
                    other = np.fromiter((_exact(leaf[2], seed) if leaf[1] is None else 0 for leaf in flat), np.uint64, len(flat))
                    path = np.fromiter((_exact((c, leaf[0]), seed) for leaf in flat), np.uint64, len(flat))
                    np.add.at(total, row, mix(np.where(other > 0, other, h) ^ path))
                out.append((mix(total) & np.uint64(mask)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0]), pa.array(out[1])], names=["id", "h1", "h2"])

    return run


def writing_copies(df: DataFrame, id_col: str, text_cols: list[str] | None = None, exact_cols: list[str] | None = None, json_cols: tuple[str, ...] = (), hash_bits: int = 64) -> DataFrame:
    """(keep_id, copy_id): each record that differs from one with a smaller id only in writing.

    Text columns agree when they do so without letter case, white space, punctuation and symbols; exact
    columns when they are equal; JSON columns when their leaves agree (texts as text, everything else
    exactly, field order apart). Nulls agree with nulls only. By default all string columns are text and
    all others exact. `keep_id` is the smallest id of the group.

    Hashes of 2 x `hash_bits` bits find the groups; every member is then compared with its group's first
    record, so a collision costs time and never a wrong row: members that differ form their own groups in
    further rounds. Texts are hashed once, in slices of bounded size. Rows of a hot group are spread over tasks of BLOCK rows. Null ids are left out; an
    empty table gives no rows; repeated ids count as one record. `id_col` must be bigint or int.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    if text_cols is None:
        text_cols = [c for c, t in fields.items() if isinstance(t, T.StringType) and c != id_col and c not in json_cols]
    if exact_cols is None:
        exact_cols = [c for c in fields if c not in (id_col, *text_cols, *json_cols)]
    exact = {f"e{i}": c for i, c in enumerate(exact_cols)}
    text = {f"t{i}": c for i, c in enumerate(text_cols)}
    payload = {f"j{i}": c for i, c in enumerate(json_cols)}
    names = exact | text | payload
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[F.col(f"`{c}`").cast("string").alias(k) for k, c in names.items()])
    mask = 2**hash_bits - 1
    left = cut(rows.mapInArrow(_fingerprints(list(text), list(exact), list(payload), mask), "id bigint, h1 bigint, h2 bigint"))

    cols = list(names)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.ones(len(b), bool)
            for c in cols:
                for i, (x, y) in enumerate(zip(b[c], b[f"r_{c}"], strict=True)):
                    x, y = (None if pd.isna(v) else v for v in (x, y))
                    ok[i] = ok[i] and (x == y if c in exact else same_json(x, y) if c in payload else same_but_for_writing(x, y))
            yield pd.DataFrame({"keep_id": b["keep"], "copy_id": b["id"], "h1": b["h1"], "h2": b["h2"], "same": ok})

    found: list[DataFrame] = []
    while True:
        groups = left.groupBy("h1", "h2").agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1")
        members = join_counted(left, groups, ["h1", "h2"]).where("id <> keep").distinct().withColumn("block", (F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).cast("int"))
        first = groups.join(rows.withColumnRenamed("id", "keep"), "keep").withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))))
        first = first.select("keep", "block", *[F.col(c).alias(f"r_{c}") for c in cols])
        pairs = members.join(rows, "id").join(first, ["keep", "block"])
        checked = cut(pairs.select("id", "keep", "h1", "h2", *cols, *[f"r_{c}" for c in cols]).mapInPandas(verify, "keep_id bigint, copy_id bigint, h1 bigint, h2 bigint, same boolean"))
        found.append(checked.where("same").select("keep_id", "copy_id"))
        left = checked.where("not same").select(F.col("copy_id").alias("id"), "h1", "h2")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def collapse_copies(df: DataFrame, id_col: str, copies: DataFrame) -> DataFrame:
    """(keep_id, n_copies): each record once, with the number of records that it stands for (1: no copy)."""
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("copy_id")).distinct()
    return ids.join(copies, "copy_id", "left").groupBy(F.coalesce("keep_id", "copy_id").alias("keep_id")).agg(F.count("*").alias("n_copies"))


def _tables(spark, d):
    for name, key, payload in (("gold_standard_output", "gold_id", ()), ("test_chatgpt", "llm_id", ()), ("llm_raw", "raw_id", ("payload",))):
        df = spark.read.parquet(f"{d}/{name}.parquet")
        yield name, key, df, writing_copies(df, key, json_cols=payload)


def p1_found(spark, d):
    return reduce(DataFrame.unionByName, [c.select(F.lit(n).alias("table_name"), "keep_id", "copy_id") for n, _, _, c in _tables(spark, d)])


def p1_collapsed(spark, d):
    """Each record of the three tables once, with the number of its copies."""
    return reduce(DataFrame.unionByName, [collapse_copies(df, k, c).select(F.lit(n).alias("table_name"), "keep_id", "n_copies") for n, k, df, c in _tables(spark, d)])


def _n(c: str) -> str:
    return rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[\p{{P}}\p{{S}}\p{{Z}}\s\x{{1c}}-\x{{1f}}\x{{85}}]', '', 'g')"


_KEYS = f"""keyed AS (
  SELECT 'gold_standard_output' AS table_name, gold_id AS id, {{'a': article_id::VARCHAR, 'b': {_n('title')}, 'c': {_n('text')}, 'd': {_n('category')}, 'e': {_n('subcategory')}, 'f': confidence::VARCHAR, 'g': num_supporters::VARCHAR, 'h': label_consistent::VARCHAR}}::VARCHAR AS k FROM gold_standard_output
  UNION ALL
  SELECT 'test_chatgpt', llm_id, {{'a': {_n('title')}, 'b': {_n('category')}, 'c': {_n('subcategory')}, 'd': {_n('text')}, 'e': {_n('open_feedback')}}}::VARCHAR FROM test_chatgpt
  UNION ALL
  SELECT 'llm_raw', raw_id, {{'a': {_n("payload->>'$.title'")}, 'b': {_n("payload->>'$.category'")}, 'c': {_n("payload->>'$.subcategory'")}, 'd': {_n("payload->>'$.text'")}, 'e': {_n("payload->>'$.openFeedback'")}, 'f': list_sort(json_keys(payload))}}::VARCHAR FROM llm_raw
), g AS (SELECT *, min(id) OVER (PARTITION BY table_name, k) AS keep_id FROM keyed)"""

QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
ORACLE = {
    "p1_found": f"WITH {_KEYS} SELECT table_name, keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p1_collapsed": f"WITH {_KEYS} SELECT table_name, keep_id, count(*) AS n_copies FROM g GROUP BY 1, 2",
}
