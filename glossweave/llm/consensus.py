"""Consensus of unequal annotators: confusion matrices and an item classifier, fitted together by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.operators.skew import join_counted
from glossweave.session import cut

#: Items whose features and current labels come to the driver to fit the classifier; all other steps use every row.
SAMPLE = 20_000
#: Hashed word features, the classifier's penalty on squared weights for each item, and its steps in each round.
FEATURES, PENALTY, STEPS = 256, 0.05, 30
#: Labels that an annotator's matrix is worth before any evidence: it is drawn to a single accuracy, and that to START.
SHRINK, START, START_WORTH = 15.0, 0.6, 4.0
#: Most rounds, and the change of the mean log likelihood of an item below which they end.
ROUNDS, TOLERANCE = 10, 0.003


def _vector(n: int, prefix: str = "p") -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def label_classes(reference: DataFrame, kind: str = "subcategory") -> DataFrame:
    """(name, ref_id, parent_ref_id, y): each name and alias of a kind in lower case, with its entry and class number."""
    own = reference.where(F.col("ref_kind") == kind).select("ref_id", "parent_ref_id", "canonical", "aliases")
    names = own.select("ref_id", "parent_ref_id", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    numbered = own.select("ref_id", (F.row_number().over(W.orderBy("ref_id")) - 1).alias("y"))
    return names.select(F.lower(F.trim("name")).alias("name"), "ref_id", "parent_ref_id").groupBy("name").agg(F.min_by(F.struct("ref_id", "parent_ref_id"), "ref_id").alias("r")).select("name", "r.*").join(numbered, "ref_id")


def _features(text: Column, title: Column) -> Column:
    """Distinct buckets of an item's words; an item without words has none."""
    words = F.split(F.lower(F.concat_ws(" ", text, title)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _design(buckets) -> np.ndarray:
    x = np.zeros((len(buckets), FEATURES + 1))
    x[:, -1] = 1
    for i, b in enumerate(buckets):
        if b is not None and len(b):
            x[i, np.asarray(b)] = 1 / np.sqrt(len(b))
    return x


def fit_classifier(x: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax regression of soft labels p with a penalty on all weights but the intercept."""
    if not len(x):
        return weights
    free = np.ones((x.shape[1], 1))
    free[-1] = 0
    for _ in range(STEPS):
        weights = weights - 4.0 * (x.T @ (_softmax(x @ weights) - p) / len(x) + PENALTY * free * weights)
    return weights


def _matrices(k: int, parent: np.ndarray):
    """For each annotator, log P(label | true class) of each label given, from soft counts; `parent` has each class's category.

    A label k + c says the category c alone: its probability is that of all the category's classes.
    Rows come in order of annotators, each with as many rows as different labels at most; the last one of a batch may go on in the next.
    """

    def done(group: pd.DataFrame) -> pd.DataFrame:
        workers, w = np.unique(group["worker"].to_numpy(str), return_inverse=True)
        y, p = group["y"].to_numpy(int), group[_vector(k)].to_numpy(float)
        own = y < k
        counts = np.zeros((len(workers), k, k))  # annotator, true class, label
        counts[w[own], :, y[own]] = p[own]
        total = counts.sum(axis=(1, 2))
        accuracy = (np.trace(counts, axis1=1, axis2=2) + START * START_WORTH) / (total + START_WORTH)
        habit = (counts.sum(axis=1) + 0.5) / (total + 0.5 * k)[:, None]
        base = accuracy[:, None, None] * np.eye(k) + (1 - accuracy)[:, None, None] * habit[:, None, :]
        matrix = (counts + SHRINK * base) / (counts.sum(axis=2, keepdims=True) + SHRINK * base.sum(axis=2, keepdims=True))
        chance = np.zeros((len(y), k))
        chance[own] = matrix[w[own], :, y[own]]
        for i in np.flatnonzero(~own):
            chance[i] = matrix[w[i]][:, parent == y[i] - k].sum(axis=1)
        out = pd.DataFrame(np.log(np.maximum(chance, 1e-6)), columns=_vector(k, "m"))
        out.insert(0, "worker", group["worker"].to_numpy())
        out.insert(1, "y", y)
        out["n"] = group["n"].to_numpy()
        out["accuracy"] = accuracy[w]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b["worker"] == b["worker"].iloc[-1]).to_numpy() if len(b) else np.zeros(0, bool)
            held = b[last]
            if len(b) and not last.all():
                yield done(b[~last])
        if held is not None and len(held):
            yield done(held)

    return run


def clean_labels(labels: DataFrame, classes: DataFrame, categories: DataFrame, k: int) -> DataFrame:
    """(gold_id, worker, y): the last label of each annotator for each item, older names mapped to their class.

    A label whose subcategory no entry has, but whose category one has, counts as the category alone, y = k + its
    number. Null items and annotators, and labels without any known name, are left out; of labels given at the
    same time the one with the largest label_id counts.
    """
    last = labels.where(F.col("gold_id").isNotNull() & F.col("worker").isNotNull()).groupBy("gold_id", "worker").agg(F.max_by(F.struct("subcategory", "category"), F.struct("labelled_at", "label_id")).alias("label"))
    named = last.withColumn("name", F.lower(F.trim("label.subcategory"))).join(F.broadcast(classes.select("name", "y")), "name", "left")
    wider = named.withColumn("category", F.lower(F.trim("label.category"))).join(F.broadcast(categories.select(F.col("name").alias("category"), (F.col("y") + k).alias("c"))), "category", "left")
    return wider.select("gold_id", "worker", F.coalesce("y", "c").cast("int").alias("y")).where("y IS NOT NULL")


def annotate(labels: DataFrame, items: DataFrame, reference: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(consensus, annotators).

    consensus: gold_id, ref_id, category_ref_id (of the most likely class and of the most likely category, which sums
    its classes), confidence, category_confidence, agreement (share of equal pairs among an item's labels; null for
    fewer than two), n_labels. annotators: worker, n_labels, reliability.

    The true class of an item has as its prior the output of a classifier on the words of its text and
    title; labels have a confusion matrix for each annotator. Rounds of expectation (items, over all
    labels) and maximisation (matrices over all labels, the classifier on SAMPLE items) follow one
    another until the mean log likelihood of all items settles. Each round shuffles the labels by item and soft counts
    by annotator and label, the latter after partial sums; an annotator with very many labels meets a broadcast of
    bounded size. The number of classes is bounded by the reference list. Items without usable labels are left out.
    """
    spark = labels.sparkSession
    classes, categories = label_classes(reference), label_classes(reference, "category")
    entries = sorted({(r.y, r.ref_id, r.parent_ref_id) for r in classes.select("y", "ref_id", "parent_ref_id").collect()})
    groups = {r.ref_id: r.y for r in categories.select("y", "ref_id").collect()}  # both bounded by the reference list
    k = len(entries)
    if not k:
        raise ValueError("the reference list has no entries of this kind")
    parent = np.array([groups.get(p, -1) for _, _, p in entries])
    given = cut(clean_labels(labels, classes, categories, k))
    words = items.where(F.col("gold_id").isNotNull()).groupBy("gold_id").agg(F.min(F.struct("text", "title")).alias("i")).select("gold_id", _features(F.col("i.text"), F.col("i.title")).alias("buckets"))
    counts = [F.sum((F.col("y") == c).cast("int")).alias(f"s{c}") for c in range(k)] + [F.sum((F.col("y") == k + c).cast("int")).alias(f"g{c}") for c in sorted(groups.values())]
    known = cut(given.groupBy("gold_id").agg(*counts, F.count("*").alias("n_labels")).join(words, "gold_id", "left"))
    wide = {c: F.col(f"g{c}") / int((parent == c).sum()) for c in groups.values() if (parent == c).any()}
    posts = known.select("gold_id", *[((F.col(f"s{c}") + wide.get(int(parent[c]), F.lit(0))) / F.col("n_labels")).alias(f"p{c}") for c in range(k)])
    sample = known.orderBy(F.xxhash64("gold_id"), "gold_id").limit(SAMPLE).select("gold_id", "buckets").collect()
    place = {r.gold_id: i for i, r in enumerate(sample)}
    x = _design([r.buckets for r in sample])
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in place], "gold_id bigint"))  # at most SAMPLE ids
    weights = np.zeros((FEATURES + 1, k))
    params, before = None, -np.inf
    for _ in range(rounds):
        p = np.zeros((len(sample), k))
        for r in posts.join(chosen, "gold_id").select("gold_id", *_vector(k)).collect():
            p[place[r.gold_id]] = r[1:]
        weights = fit_classifier(x, p, weights)
        soft = given.join(posts, "gold_id").groupBy("worker", "y").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)], F.count("*").alias("n"))
        schema = "worker string, y int, " + ", ".join(f"{m} double" for m in _vector(k, "m")) + ", n bigint, accuracy double"
        params = cut(soft.repartition("worker").sortWithinPartitions("worker").mapInPandas(_matrices(k, parent), schema))
        evidence = join_counted(given, params, ["worker", "y"]).groupBy("gold_id").agg(*[F.sum(f"m{c}").alias(f"m{c}") for c in range(k)])
        shared = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                joint = b[_vector(k, "m")].to_numpy(float) + np.log(_softmax(_design(b["buckets"]) @ shared.value) + 1e-9)
                out = pd.DataFrame(_softmax(joint), columns=_vector(k))
                out.insert(0, "gold_id", b["gold_id"].to_numpy())
                out["likelihood"] = np.logaddexp.reduce(joint, axis=1) if len(b) else np.zeros(0)
                yield out

        posts = cut(evidence.join(known.select("gold_id", "buckets"), "gold_id").mapInPandas(expect, "gold_id bigint, " + ", ".join(f"{v} double" for v in _vector(k)) + ", likelihood double"))
        now = posts.agg(F.avg("likelihood")).first()[0]
        if now is None or abs(now - before) < TOLERANCE:
            break
        before = now
    best = F.array_max(F.array(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(-c).alias("c"), F.lit(entries[c][1]).alias("ref_id")) for c in range(k)]))
    of_category = [(r, sum((F.col(f"p{c}") for c in np.flatnonzero(parent == g).tolist()), F.lit(0.0))) for r, g in sorted(groups.items()) if (parent == g).any()]
    likeliest = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-r).alias("ref_id")) for r, p in of_category])) if of_category else F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("int").alias("ref_id"))
    n = sum((F.col(f"s{c}") for c in range(1, k)), F.col("s0"))
    agreement = sum((F.col(f"s{c}") * (F.col(f"s{c}") - 1) for c in range(1, k)), F.col("s0") * (F.col("s0") - 1)) / (n * (n - 1))
    settled = posts.select("gold_id", best.alias("b"), likeliest.alias("g")).select("gold_id", "b.ref_id", (-F.col("g.ref_id")).alias("category_ref_id"), F.col("b.p").alias("confidence"), F.col("g.p").alias("category_confidence"))
    consensus = settled.join(known.select("gold_id", "n_labels", F.when(n > 1, agreement).alias("agreement")), "gold_id").select("gold_id", "ref_id", "category_ref_id", "confidence", "category_confidence", "agreement", "n_labels")
    if params is None:
        return consensus, given.groupBy("worker").agg(F.count("*").alias("n_labels"), F.lit(START).alias("reliability"))
    return consensus, params.groupBy("worker").agg(F.sum("n").alias("n_labels"), F.max("accuracy").alias("reliability"))


def _annotated(spark, d):
    return annotate(*[spark.read.parquet(f"{d}/{t}.parquet") for t in ("span_labels", "gold_standard_output", "label_reference")])


def p4_found(spark, d):
    many = spark.read.parquet(f"{d}/span_labels.parquet").groupBy("gold_id").agg(F.countDistinct("worker").alias("n")).where("n >= 3").select("gold_id")
    return _annotated(spark, d)[0].join(many, "gold_id", "left_semi").select("gold_id", F.col("ref_id").cast("int").alias("ref_id"))


def p4_consensus(spark, d):
    """Category, subcategory, confidence and agreement of every labelled span."""
    return _annotated(spark, d)[0]


def p4_annotators(spark, d):
    """Each worker's number of labels and reliability."""
    return _annotated(spark, d)[1]


QUERIES = {"p4_found": p4_found, "p4_consensus": p4_consensus, "p4_annotators": p4_annotators}
ORACLE: dict[str, str] = {}
