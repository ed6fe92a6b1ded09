"""Keyword-stuffed and link-list pages: pointwise mutual information and repetition of neighbouring words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.scan import characters, mix, pieces, words
from glossweave.session import cut

#: Text in bytes of one block of documents; a block's dictionary is made and read in one task. 1 MB takes about
#: 15 MB of a task's memory, so on larger executors larger blocks leave fewer repeated words to send.
BLOCK_BYTES = 10 << 20
#: Text in bytes that a shard of the dictionaries stands for, and the least of a block's that makes a record of its own;
#: so a block has at most block_bytes / RECORD_BYTES shards, and records grow with the text and not with its square.
SHARD_BYTES, RECORD_BYTES = 10 << 20, 300
#: A page is spam when its neighbouring words are repeated collocations to at least this degree, when a single
#: collocation makes up at least TOP of them (for pages of ENOUGH words; chants in articles stay below), ...
STUFFED, TOP, ENOUGH = 0.58, 0.15, 20
#: ... or when fewer than PROSE of its words stand in sentences, and its collocations are repeated or incoherent.
PROSE, REPEATED, INCOHERENT = 0.4, 0.2, 2.5
#: Words of a sentence.
SENTENCE = (6, 80)

_PIECES = "kind int, route bigint, block bigint, ids binary, a binary, b binary, c binary"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="lz4_raw", asbytes=True) if x.nbytes else b""


def _unpack(raw: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(raw, n * kind.itemsize, codec="lz4_raw", asbytes=True), kind) if n else np.zeros(0, kind)


def _sentence_words(column: pa.Array, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row, its words that stand in sentences: 6 to 80 words, closed by a full stop, exclamation or question mark before a gap."""
    codes, at = characters(column)
    stop = np.isin(codes, np.frombuffer(".!?".encode("utf-32-le"), np.uint32))
    gap = np.isin(codes, np.frombuffer(" \t\r\n ".encode("utf-32-le"), np.uint32))
    close = np.isin(codes, np.frombuffer("”’\"')»]".encode("utf-32-le"), np.uint32))
    line = codes == 10
    free = np.append(gap[1:] | close[1:], True)
    free[at[1:][at[1:] > at[:-1]] - 1] = True  # a row's end
    closes = np.concatenate([[0], np.cumsum(stop & free)])
    breaks = np.concatenate([[0], np.cumsum(line & np.append((codes[1:] == 10) | (codes[1:] == 13), False))])
    n = len(starts)
    if not n:
        return np.zeros(len(rows) - 1, np.int64)
    following = np.append(starts[1:], len(codes))
    last = np.zeros(n, bool)
    ends_of_rows = rows[1:][rows[1:] > rows[:-1]] - 1
    last[ends_of_rows] = True
    closed = closes[following] > closes[ends]
    edge = closed | (breaks[following] > breaks[ends]) | last
    first = np.concatenate([[True], edge[:-1]])
    segment = np.cumsum(first) - 1
    size = np.bincount(segment)
    good = np.append(closed[edge], [])[: len(size)].astype(bool) & (size >= SENTENCE[0]) & (size <= SENTENCE[1])
    sums = np.concatenate([[0], np.cumsum(good[segment])])
    return sums[rows[1:]] - sums[rows[:-1]]


def _block(shards: int, block: int, ids: list, sizes: list, prose: list, own: list, pairs: list, owner: list) -> Iterator[pa.RecordBatch]:
    """A block's documents as numbers into its dictionary, and its dictionary by shard."""
    n_docs = sum(map(len, ids))
    h = np.concatenate(own)
    g = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
    # words have keys with the lowest bit 0, pairs with 1; keys are ordered by shard, then by key
    keys = np.concatenate([h & ~np.uint64(1), g | np.uint64(1)])
    del h, g
    keys = (keys % np.uint64(shards) << np.uint64(46)) | (keys >> np.uint64(19) << np.uint64(1) & np.uint64(2**46 - 1)) | (keys & np.uint64(1))
    unique, number, tf = np.unique(keys, return_inverse=True, return_counts=True)
    number = number.astype(np.int32)
    del keys
    at = np.repeat(np.arange(n_docs), np.concatenate(sizes))
    seen = np.unique(number.astype(np.int64) << 32 | np.concatenate([at, *owner]))
    df = np.bincount(seen >> 32, minlength=len(unique))
    del seen, at
    out = [(0, shards + block, block, np.concatenate([np.concatenate(ids), np.concatenate(sizes), np.concatenate(prose)]).tobytes(), _pack(number), len(number).to_bytes(8, "little"), b"")]
    bounds = np.searchsorted(unique, np.arange(shards + 1, dtype=np.uint64) << np.uint64(46))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[s], bounds[s + 1]
        out.append((1, s, block, int(b - a).to_bytes(8, "little"), _pack(unique[a:b]), _pack(tf[a:b].astype(np.int32)), _pack(df[a:b].astype(np.int32))))
    for row in out:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64()) + (pa.binary(),) * 4, strict=True)], names=["kind", "route", "block", "ids", "a", "b", "c"])


def _scan(shards: int, block_bytes: int):
    """A task's documents in blocks of about `block_bytes` of text, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n_docs, volume = TaskContext.get().partitionId() << 24, 0, 0
        parts: list[list] = [[] for _ in range(6)]
        for whole in batches:
            for b in pieces(whole, 1):
                h, rows, starts, ends = words(b.column(1))
                ids, sizes, prose, own, pairs, owner = parts
                ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                sizes.append(np.diff(rows))
                prose.append(_sentence_words(b.column(1), rows, starts, ends))
                own.append(h)
                doc = np.repeat(np.arange(n_docs, n_docs + b.num_rows), np.diff(rows))
                if len(h) > 1:
                    same = doc[1:] == doc[:-1]
                    pairs.append(mix(h[:-1] * np.uint64(3) + mix(h[1:]))[same])
                    owner.append(doc[1:][same])
                n_docs += b.num_rows
                volume += pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py() or 0
                if volume >= block_bytes:
                    yield from _block(shards, block, *parts)
                    block, n_docs, volume = block + 1, 0, 0
                    parts = [[] for _ in range(6)]
        if n_docs:
            yield from _block(shards, block, *parts)

    return run


def _total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One shard of all blocks' dictionaries, each with corpus-wide counts in the place of its own; documents pass."""
    if group["kind"].iloc[0] == 0:
        return group
    parts = []
    for r in group.itertuples():
        n = int.from_bytes(r.ids, "little")
        parts.append((r.block, _unpack(r.a, n, np.uint64), _unpack(r.b, n, np.int32), _unpack(r.c, n, np.int32)))
    unique, number = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    tf = np.zeros(len(unique), np.int64)
    df = np.zeros(len(unique), np.int64)
    np.add.at(tf, number, np.concatenate([p[2] for p in parts]))
    np.add.at(df, number, np.concatenate([p[3] for p in parts]))
    out, at = [], 0
    for block, k, _, _ in parts:
        i = number[at : at + len(k)]
        at += len(k)
        out.append((2, int(key[0]), int(block), len(k).to_bytes(8, "little"), _pack(tf[i]), _pack(df[i]), b""))
    return pd.DataFrame(out, columns=["kind", "route", "block", "ids", "a", "b", "c"])


def _score(group: pd.DataFrame) -> pd.DataFrame:
    """The measures of one block's documents; the mean mutual information lacks the corpus totals."""
    docs = group[group["kind"] == 0].iloc[0]
    shards = group[group["kind"] == 2].sort_values("route")
    sizes = [int.from_bytes(x, "little") for x in shards["ids"]]
    tf = np.concatenate([_unpack(x, n, np.int64) for x, n in zip(shards["a"], sizes, strict=True)] or [np.zeros(0, np.int64)]).astype(float)
    df = np.concatenate([_unpack(x, n, np.int64) for x, n in zip(shards["b"], sizes, strict=True)] or [np.zeros(0, np.int64)]).astype(float)
    head = np.frombuffer(docs["ids"], np.int64)
    n = len(head) // 3
    ids, size, prose = head[:n], head[n : 2 * n], head[2 * n :]
    number = _unpack(docs["a"], int.from_bytes(docs["b"], "little"), np.int32)
    n_words = int(size.sum())
    own, pair = number[:n_words], number[n_words:]
    doc = np.repeat(np.arange(n), size)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n_words else np.zeros(0, np.int64)
    pmi = np.log(tf[pair]) - np.log(tf[own[inner]]) - np.log(tf[own[inner + 1]])
    repeated = 1 - df[pair] / tf[pair]
    of, pairs = doc[inner], np.maximum(size - 1, 1)
    times, top = np.unique(of.astype(np.int64) << 32 | pair, return_counts=True), np.zeros(n, np.int64)
    np.maximum.at(top, times[0] >> 32, times[1])
    return pd.DataFrame({"doc_id": ids, "n_words": size, "mean_pmi": np.bincount(of, pmi, n) / pairs, "repeated": np.bincount(of, repeated, n) / pairs, "top": top / pairs, "prose": prose / np.maximum(size, 1)})


def score_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """(doc_id, n_words, mean_pmi, repeated, top, prose) of each document.

    `mean_pmi` is the mean pointwise mutual information of neighbouring words, from the counts of all
    words and neighbours in the whole corpus. `repeated` is the mean, over its neighbours, of the share of
    a collocation's occurrences that repeat it within a document. `prose` is the share of words in
    sentences. Documents with fewer than two words, null or empty texts have 0 in place of a mean.

    Each task cuts its documents into blocks of about `block_bytes` of text, where they stand; only a block's distinct
    words and pairs are counted over the corpus, in shards of the key space, and sent back to the block. Nothing is broadcast, and
    two totals are collected. A shard's part of all dictionaries is held by one task, so block_bytes bounds the corpus too:
    10 MB for some TB, 64 MB for 100 TB. `docs` must come in the same order when a task is run again, as from files
    or a checkpoint. Null ids are left out. A repeated id is scored once for each row.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards is None:  # of the table's size on disk, about 2.5 times as much text; a wrong size costs time only
        volume = 2.5 * int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        shards = int(min(max(partitions, volume // SHARD_BYTES), max(partitions, block_bytes // RECORD_BYTES)))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = texts.mapInArrow(_scan(shards, block_bytes), _PIECES)
    tasks = max(partitions, shards)
    totals = scanned.repartition(tasks, "route").groupBy("route").applyInPandas(_total, _PIECES)
    scores = cut(totals.repartition(tasks, "block").groupBy("block").applyInPandas(_score, "doc_id bigint, n_words bigint, mean_pmi double, repeated double, top double, prose double"))
    n, m = scores.agg(F.sum("n_words"), F.sum(F.greatest(F.col("n_words") - 1, F.lit(0)))).first()
    shift = 2 * math.log(max(n or 0, 1)) - math.log(max(m or 0, 1))
    return scores.withColumn("mean_pmi", F.when(F.col("n_words") > 1, F.col("mean_pmi") + shift).otherwise(0.0))


def spam_pages(scores: DataFrame) -> DataFrame:
    """The pages of score_pages that are word salad, keyword-stuffed or lists of links and tags."""
    listed = (F.col("prose") < PROSE) & ((F.col("repeated") >= REPEATED) | (F.col("mean_pmi") < INCOHERENT))
    stuffed = (F.col("repeated") >= STUFFED) | ((F.col("top") >= TOP) & (F.col("n_words") >= ENOUGH))
    return scores.where((F.col("n_words") > 1) & (listed | stuffed))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def p9_found(spark, d):
    return spam_pages(score_pages(_docs(spark, d))).select("doc_id")


def p9_scores(spark, d):
    """The measures of every page."""
    return score_pages(_docs(spark, d))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores}
ORACLE: dict[str, str] = {}
