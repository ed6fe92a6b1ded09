"""Model spans against consensus spans: greedy one-to-one matching and precision, recall and F1."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from tempfile import TemporaryFile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import normalize_label, normalize_text, safe_ratio, tokenize

#: Consensus spans of a group that its task holds at once; further ones wait in a file, with the model spans that the first leave free.
SMALL = 200_000
#: Consensus spans whose words share a bit mask.
BLOCK = 2_048


def _numbered(df: DataFrame, labelled: bool, normalize_titles: bool) -> DataFrame:
    """(g, title, ord, words): a span's group, that is its title and labels as one hash, its place and its distinct words."""
    title = F.coalesce("title", F.lit("UNKNOWN_TITLE"))
    key = [normalize_text(title) if normalize_titles else title] + ([normalize_label(F.col("category")), normalize_label(F.col("subcategory"))] if labelled else [])
    return df.select(F.unhex(F.md5(F.to_json(F.array(*key)))).alias("g"), key[0].alias("title"), "ord", F.array_join(F.array_distinct(tokenize(F.col("text"))), " ").alias("words"))


class _Free:
    """Consensus spans in order that no model span has taken: by blocks, and in each the spans of a word as a bit mask."""

    def __init__(self, spans: list[str], min_overlap: int) -> None:
        self.need, self.blocks = max(0, min_overlap), []
        for i in range(0, len(spans), BLOCK):
            masks: dict[str, int] = {}
            for k, words in enumerate(spans[i : i + BLOCK]):
                for w in words.split(" "):
                    masks[w] = masks.get(w, 0) | 1 << k
            masks.pop("", None)
            self.blocks.append([(1 << min(BLOCK, len(spans) - i)) - 1, masks])

    def take(self, words: str) -> bool:
        """Whether any shares enough of these words; the first one that does is taken."""
        for block in self.blocks:
            free, masks = block
            at = [free] + [0] * self.need  # at[k]: free spans with k of the words or more
            for w in words.split(" "):
                if m := masks.get(w):
                    for k in range(self.need, 0, -1):
                        at[k] |= at[k - 1] & m
            if hit := at[-1] & -at[-1]:
                block[0] ^= hit
                if not block[0]:
                    self.blocks.remove(block)
                return True
        return False


class _Group:
    """One group's spans: all consensus spans in order, then all model spans in order, each taking the first free one that overlaps it."""

    def __init__(self, title: str, min_overlap: int, small: int) -> None:
        self.title, self.min_overlap, self.small = title, min_overlap, small
        self.correct = self.total_llm = self.total_gold = 0
        self.held: list[str] = []
        self.free, self.more, self.left = None, None, None

    def gold(self, words: str) -> None:
        self.total_gold += 1
        if len(self.held) < self.small:
            self.held.append(words)
        else:
            self.more = self.more or TemporaryFile("w+", encoding="utf-8", newline="\n")
            self.more.write(words + "\n")

    def model(self, words: str) -> None:
        self.total_llm += 1
        if not self.free:
            self.free, self.held = _Free(self.held, self.min_overlap), []
            self.left = TemporaryFile("w+", encoding="utf-8", newline="\n") if self.more else None
        self._take(words)

    def _take(self, words: str) -> None:
        if self.free.take(words):
            self.correct += 1
        elif self.left:
            self.left.write(words + "\n")

    def counts(self) -> tuple[str, int, int, int]:
        """What is left goes on to the consensus spans that wait: which earlier ones a model span missed depends on no later ones."""
        if self.more and self.left:
            self.more.seek(0)
            while spans := [line[:-1] for line in islice(self.more, self.small)]:
                rest, self.left = self.left, TemporaryFile("w+", encoding="utf-8", newline="\n")
                self.free = _Free(spans, self.min_overlap)
                rest.seek(0)
                for line in rest:
                    self._take(line[:-1])
                rest.close()
            self.left.close()
        if self.more:
            self.more.close()
        return self.title, self.correct, self.total_llm, self.total_gold


def _greedy(min_overlap: int, small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["title", "correct", "total_llm", "total_gold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, None
        for batch in batches:
            done = []
            for g, title, side, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != last:
                    if group:
                        done.append(group.counts())
                    last, group = g, _Group(title, min_overlap, small)
                (group.model if side else group.gold)(words)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in group.counts()], names=names)

    return run


def count_matches(llm: DataFrame, gold: DataFrame, min_overlap: int = 2, labelled: bool = True, normalize_titles: bool = False, small: int = SMALL) -> DataFrame:
    """(title, correct, total_llm, total_gold) of each title on both sides.

    Both frames have title, ord (unique, of any ordered type), text, category, subcategory. Equal normalised labels
    are part of a group, so the ordered matching runs within one title and label; `labelled=False` matches by words
    alone. Titles are compared as they are, or without case and punctuation with `normalize_titles`. A null title
    counts as UNKNOWN_TITLE, a null text has no words. Titles on one side only count nowhere.

    Each model span in order takes the first free consensus span that shares `min_overlap` words or more. One task has a
    group, its spans come in order and no pairs are listed; it holds `small` consensus spans of the group at once.
    """
    x, y = (_numbered(df, labelled, normalize_titles) for df in (llm, gold))
    rows = y.select("g", "title", F.lit(0).alias("side"), F.col("ord").alias("o"), F.lit(None).alias("l"), "words").union(x.select("g", "title", F.lit(1).alias("side"), F.lit(None).alias("o"), F.col("ord").alias("l"), "words"))
    matched = rows.repartition("g").sortWithinPartitions("g", "side", "o", "l").select("g", "title", "side", "words")
    groups = matched.mapInArrow(_greedy(min_overlap, max(1, small)), "title string, correct bigint, total_llm bigint, total_gold bigint")
    return groups.groupBy("title").agg(*[F.sum(c).alias(c) for c in ("correct", "total_llm", "total_gold")]).where("total_llm > 0 AND total_gold > 0")


def rounded(scored: DataFrame, places: int = 3) -> DataFrame:
    """Scores for display: every double rounded half up to `places`; counts stay whole."""
    return scored.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in scored.schema.fields])


def scores(counts: DataFrame) -> DataFrame:
    """The counts with precision, recall, F1 (from unrounded values, 0 where undefined) and the category scores.

    Matches need equal labels, so every match is right by category: its scores are 1 where there is one.
    """
    p, r = safe_ratio(F.col("correct"), F.col("total_llm")), safe_ratio(F.col("correct"), F.col("total_gold"))
    whole = safe_ratio(F.col("correct"), F.col("correct"))
    return counts.withColumns({"precision": p, "recall": r, "f1": safe_ratio(2 * p * r, p + r), "category_precision": whole, "category_recall": whole, "category_f1": safe_ratio(2 * whole * whole, whole + whole)})


def overall(counts: DataFrame) -> DataFrame:
    """One row: the scores of the summed counts."""
    return scores(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "total_llm", "total_gold")]))
