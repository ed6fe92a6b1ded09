"""Texts put together into units of fixed capacity: optimal length buckets over the global histogram, then batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A public tokenizer's ranks; a parameter of every operator here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most length buckets of a packing; with as many buckets as lengths nothing is padded.
BUCKETS = 1024
#: Pieces of one length that are numbered together; more are spread over several groups.
GROUP = 20_000


@cache
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each document; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def optimal_buckets(histogram: dict[int, int], most: int) -> list[int]:
    """Upper bounds of at most `most` length buckets with the least padding, that is the least sum of bound - length.

    Dynamic programming over the distinct lengths. The best last split of a prefix never moves left as the prefix
    grows, so each layer halves its steps: between two known splits only the lengths between them are tried.
    """
    lengths = np.array(sorted(n for n in histogram if histogram[n] > 0), np.int64)
    m = len(lengths)
    if m <= most:
        return lengths.tolist()
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = np.concatenate([[0], lengths * number[1:] - volume[1:]])  # one bucket
    back = np.zeros((most, m + 1), np.int32)
    for layer in range(1, most):
        new, split = np.zeros(m + 1, np.int64), back[layer]
        step = 1 << m.bit_length()
        while step > 1:
            half = step >> 1
            j = np.arange(half, m + 1, step)
            low = split[j - half]
            right = j + half
            high = np.minimum(j - 1, np.where(right <= m, split[np.minimum(right, m)], m - 1))
            size = high - low + 1
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            i = np.arange(int(size.sum())) - np.repeat(start - low, size)
            x = np.repeat(lengths[j - 1], size)
            value = cost[i] - x * number[i] + volume[i]
            least = np.minimum.reduceat(value, start)
            hits = np.flatnonzero(value == np.repeat(least, size))
            split[j] = i[hits[np.searchsorted(hits, start)]]
            new[j] = least + lengths[j - 1] * number[j] - volume[j]
            step = half
        cost = new
    bounds, j = [], m
    for origin in back[::-1]:
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(origin[j])
    return bounds[::-1]


def batch_patterns(counts: dict[int, int], capacity: int, mix: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """(units, [(bucket bound, pieces a unit)]): how units are filled, the whole corpus at a time.

    The largest bucket that still has pieces opens a unit and takes as many as fit; with `mix`, the room
    left is filled from the largest bucket that fits, and so on. As many units as the scarcest bucket of
    a pattern allows are filled alike at once, so the work depends on the buckets and not on the pieces.
    """
    left = {b: n for b, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        room, pattern = capacity, []
        for b in order if mix else order[:1]:
            if b <= room:
                k = min(room // b, left[b])
                pattern.append((b, k))
                room -= k * b
        units = min(left[b] // k for b, k in pattern)
        for b, k in pattern:
            left[b] -= k * units
        out.append((units, pattern))
        order = [b for b in order if left[b] > 0]
    return out


def pack(sizes: DataFrame, capacity: int, buckets: int = BUCKETS, mix: bool = True) -> DataFrame:
    """(doc_id, piece, start, n_tokens, unit_id): every document in units of at most `capacity` tokens.

    `sizes` has doc_id and n_tokens. A document larger than the capacity is cut into full units and a
    rest; any other stays whole. Documents without tokens get no unit. Only the histogram of lengths (at most
    `capacity` counts) and the patterns come to the driver; pieces are numbered within their length in groups of about
    GROUP, so even one length for all documents makes no hot task.
    """
    spark = sizes.sparkSession
    cut_up = sizes.where("n_tokens > 0").select("doc_id", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"), "n_tokens")
    pieces = cut_up.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    bounds = np.array(optimal_buckets(histogram, buckets) or [capacity])
    lengths, counts = [], {}
    for n in sorted(histogram):  # where the numbers of each length start within its bucket
        bound = int(bounds[np.searchsorted(bounds, n)])
        lengths.append((n, bound, counts.get(bound, 0), -(-histogram[n] // GROUP)))
        counts[bound] = counts.get(bound, 0) + histogram[n]
    # each pattern takes a run of numbers from each of its buckets
    used, unit = dict.fromkeys(counts, 0), 0
    runs: dict[int, list] = {}
    for units, pattern in batch_patterns(counts, capacity, mix):
        for b, k in pattern:
            runs.setdefault(b, []).append((used[b], k, unit))
            used[b] += k * units
        unit += units
    shared = spark.sparkContext.broadcast({b: np.array(v, np.int64) for b, v in runs.items()})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            number, bound = b["number"].to_numpy(np.int64), b["bound"].to_numpy()
            units = np.empty(len(b), np.int64)
            for x in np.unique(bound):
                at, run = bound == x, shared.value[int(x)]
                r = run[np.searchsorted(run[:, 0], number[at], "right") - 1]
                units[at] = r[:, 2] + (number[at] - r[:, 0]) // r[:, 1]
            b["unit_id"] = units
            yield b[["doc_id", "piece", "start", "n_tokens", "unit_id"]]

    of_length = F.broadcast(spark.createDataFrame(lengths, "n_tokens int, bound int, base bigint, groups int"))  # at most capacity rows
    spread = pieces.join(of_length, "n_tokens").withColumn("spread", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups")).cast("int"))
    sized = spread.groupBy("n_tokens", "spread").agg(F.count("*").alias("n"), F.first("base").alias("base"))
    first = sized.select("n_tokens", "spread", (F.col("base") + F.sum("n").over(Window.partitionBy("n_tokens").orderBy("spread")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "spread").orderBy("doc_id", "piece"))
    numbered = spread.withColumn("place", own).join(first, ["n_tokens", "spread"]).withColumn("number", F.col("first") + F.col("place") - 1)
    return numbered.select("doc_id", "piece", "start", "n_tokens", "bound", "number").mapInPandas(assign, "doc_id bigint, piece int, start int, n_tokens int, unit_id bigint")


def unit_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: units, pieces, tokens, room left and fill of a packing."""
    units = packed.groupBy("unit_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    tokens = F.coalesce(F.sum("tokens"), F.lit(0))
    return units.agg(F.count("*").alias("n_units"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), tokens.alias("n_tokens"), (F.count("*") * capacity - tokens).alias("room_left"), F.max("tokens").alias("fullest"))


def _packed(spark, d):
    from glossweave.session import cut

    sizes = cut(token_counts(spark.read.parquet(f"{d}/documents.parquet")))
    kinds = spark.read.parquet(f"{d}/containers.parquet").where("capacity_tokens > 0").orderBy("container_kind").collect()
    return [(r.container_kind, r.capacity_tokens, pack(sizes, r.capacity_tokens)) for r in kinds]


def p7_units(spark, d):
    """Every piece of every document with its unit, for each kind of container."""
    parts = [p.select(F.lit(kind).alias("container_kind"), "unit_id", "doc_id", "piece", "start", "n_tokens") for kind, _, p in _packed(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p7_fill(spark, d):
    """How full the units of each kind of container are."""
    return reduce(DataFrame.unionByName, [unit_fill(p, c).select(F.lit(k).alias("container_kind"), "*") for k, c, p in _packed(spark, d)])


QUERIES = {"p7_units": p7_units, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
