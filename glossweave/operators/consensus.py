"""Consensus spans: leader clusters of matching spans within an article, label votes, confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import STOPWORDS, content_tokens, intersect_window, normalize_text, split_words
from glossweave.session import cut

#: Text that stands for "nothing selected".
SENTINEL = "no polarizing language selected"
#: Matches that one task settles in order; of more than these, rounds over all tasks settle what they can first.
SMALL = 200_000
#: Members of a cluster whose texts are folded in one row; larger clusters are folded in rounds.
FOLD = 10_000
#: Texts, and bytes of texts, that are searched at once.
SPREAD, CHUNK = 20_000, 1 << 19
#: Bytes of the longest window by which a text is found in others.
WINDOW = 64

_STOP = frozenset(STOPWORDS)
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def drop_sentinel(spans: DataFrame, normalize: bool = False) -> DataFrame:
    """Without spans that only say that nothing was selected; exactly so, or in any case with `normalize`."""
    text = F.lower(F.trim("text")) if normalize else F.col("text")
    return spans.where(F.col("text").isNotNull() & (text != F.lit(SENTINEL)))


def span_classes(spans: DataFrame) -> DataFrame:
    """(article_id, norm, content, ord): each normalised text of an article once, with its first place.

    Spans of equal normalised text share their cluster: whatever leader takes the first takes the others.
    """
    own = spans.select("article_id", "ord", normalize_text(F.col("text")).alias("norm")).groupBy("article_id", "norm").agg(F.min("ord").alias("ord"))
    return own.select("article_id", "norm", content_tokens(split_words(F.col("norm"))).alias("content"), "ord")


class _Windows:
    """Hashes of all windows of a size in some bytes, made of those of smaller windows."""

    def __init__(self, data: np.ndarray) -> None:
        self.size, self.of = len(data), {1: _BYTES[data]}

    def __getitem__(self, w: int) -> np.ndarray:
        if w not in self.of:
            a = 1 << (w - 1).bit_length() - 1
            n = max(0, self.size - w + 1)
            self.of[w] = self[a][:n] * np.uint64(pow(_BASE, w - a, 1 << 64)) + self[w - a][a : a + n]
        return self.of[w]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) of all k from low[i] to below high[i]."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


def _mixed(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = (first ^ (last >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64)


def _held_in(data: np.ndarray, at: np.ndarray, sought: np.ndarray, spread: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of texts, which lie in data[at[i]:at[i + 1]], such that the sought x may stand in y, each pair once and the y in ascending chunks.

    A text holds another only if it holds the other's first and last window, as far apart as there. Windows
    have WINDOW bytes; in texts shorter than that the largest power of two, under 8 bytes all of them.
    """
    size = np.diff(at)
    width = np.where(size < 8, size, 1 << np.minimum(WINDOW.bit_length() - 1, np.log2(np.maximum(size, 1)).astype(np.int64)))
    first, last = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)

    def chunks() -> Iterator[tuple[int, int, _Windows]]:
        low = 0
        while low < len(size):
            high = max(low + 1, min(low + spread, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1))
            yield low, high, _Windows(np.asarray(data[at[low] : at[high]]))
            low = high

    widths = np.unique(width[sought])
    for low, high, windows in chunks():
        own = sought[np.searchsorted(sought, low) : np.searchsorted(sought, high)]
        for w in np.unique(width[own]):
            x = own[width[own] == w]
            h = windows[int(w)]
            first[x], last[x] = h[at[x] - at[low]], h[at[x + 1] - w - at[low]]
    tables = {}
    for w in widths:
        x = sought[width[sought] == w]
        mixed = _mixed(first[x], last[x], size[x])
        x = x[np.argsort(mixed, kind="stable")]
        starts = np.unique(np.rec.fromarrays([first[x], size[x]], names="h,n"))
        keys, begin = np.unique(starts.h, return_index=True)
        bits = min(27, max(10, len(keys).bit_length() + 3))
        seen = np.zeros(1 << bits, bool)
        seen[keys >> np.uint64(64 - bits)] = True
        tables[int(w)] = x, np.sort(mixed), starts.n, keys, np.append(begin, len(starts)), seen, np.uint64(64 - bits)
    for low, high, windows in chunks():
        found = []
        for w, (x, mixed, sizes, keys, begin, seen, shift) in tables.items():
            h = windows[w]
            p = np.flatnonzero(seen[h >> shift])
            k = np.searchsorted(keys, h[p])
            k[k == len(keys)] = 0
            p, k = (v[keys[k] == h[p]] for v in (p, k))
            y = np.searchsorted(at, at[low] + p, "right") - 1
            i, j = _ranges(begin[k], begin[k + 1])
            i, j = (v[at[low] + p[i] + sizes[j] <= at[y[i] + 1]] for v in (i, j))
            key = _mixed(h[p[i]], h[p[i] + sizes[j] - w], sizes[j])
            i2, m = _ranges(np.searchsorted(mixed, key), np.searchsorted(mixed, key, "right"))
            found.append(np.column_stack([x[m], y[i[i2]]]))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        both = both[both[:, 0] != both[:, 1]]
        yield both[:, 0], both[:, 1]


class _Article:
    """An article's different texts in order: in a file, with their places in reading order beside."""

    def __init__(self, article: pa.Scalar) -> None:
        self.article, self.file = article, TemporaryFile()
        self.sizes: list[int] = []
        self.sought: list[int] = []
        self.ords: list[pa.Array] = []

    def add(self, texts: pa.Array, ords: pa.Array) -> None:
        for text in texts.to_pylist():
            raw = text.encode()
            if len(raw) >= WINDOW or len(raw) > 2 and len(set(text.split()) - _STOP) >= 2:
                self.sought.append(len(self.sizes))
            self.sizes.append(len(raw))
            self.file.write(raw)
        self.ords.append(ords)

    def candidates(self, spread: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.sought or not self.article.is_valid:
            return
        self.file.flush()
        data, at = np.memmap(self.file, np.uint8, "r"), np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64))])

        @lru_cache(1000)
        def read(i: int) -> tuple[str, set[str]]:
            text = data[at[i] : at[i + 1]].tobytes().decode()
            return text, set(text.split()) - _STOP

        self.read = read
        yield from _held_in(data, at, np.array(self.sought, np.int64), max(1, spread))

    def match(self, x: int, y: int) -> bool:
        return self.read(x)[0] in self.read(y)[0] and len(self.read(x)[1] & self.read(y)[1]) >= 2

    def rows(self, a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
        places = pa.chunked_array(self.ords)
        return pa.RecordBatch.from_arrays([pa.array([self.article.as_py()] * len(a), self.article.type), *(places.take(pa.array(v)).combine_chunks() for v in (a, b))], names=["article_id", *names])


def _pairs(article: _Article, spread: int) -> Iterator[pa.RecordBatch]:
    """Places a < b of the texts that match."""
    for x, y in article.candidates(spread):
        hit = [article.match(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        x, y = x[hit], y[hit]
        if len(x):
            yield article.rows(np.minimum(x, y), np.maximum(x, y), ["a", "b"])


def _led(article: _Article, spread: int) -> Iterator[pa.RecordBatch]:
    """Places of the texts that follow a leader, and of the earliest such leader; no pairs are kept.

    A chunk's texts stand in pairs with the texts that they hold and, in this or an earlier chunk, with those that hold them
    and come earlier. So all earlier matches of a text are known when its chunk is over, and only leaders are carried on.
    """
    leader = np.full(len(article.sizes), len(article.sizes))
    for x, y in article.candidates(spread):
        a, b = np.minimum(x, y), np.maximum(x, y)
        use = np.flatnonzero((a < leader[b]) & (leader[a] == len(leader)))
        use = use[np.lexsort((a[use], b[use]))]
        for i, j, p, q in zip(*(v[use].tolist() for v in (x, y, a, b)), strict=True):
            if p < leader[q] and leader[p] == len(leader) and article.match(i, j):
                leader[q] = p
    found = np.flatnonzero(leader < len(leader))
    for low in range(0, len(found), SPREAD):
        part = found[low : low + SPREAD]
        yield article.rows(part, leader[part], ["ord", "leader"])


def _by_article(of: Callable[[_Article, int], Iterator[pa.RecordBatch]], spread: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `of` finds in each article, whose texts (article_id, norm, ord) come in order of article and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            articles = batch.column(0)
            names = articles.to_pylist()
            low = 0
            while low < len(names):
                if last is None or names[low] != last.article.as_py():
                    if last is not None:
                        yield from of(last, spread)
                        last.file.close()
                    last = _Article(articles[low])
                high = next((i for i in range(low, len(names)) if names[i] != names[low]), len(names))
                last.add(batch.column(1)[low:high], batch.column(2)[low:high])
                low = high
        if last is not None:
            yield from of(last, spread)
            last.file.close()

    return run


def matching_pairs(classes: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(article_id, a, b): places a < b of different texts that match.

    One task has an article, its texts in a file and their windows' hashes in memory: `spread` texts at a time are
    searched for the first and last windows of all; the exact test follows.
    """
    kind = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    rows = classes.where("norm <> ''").select("article_id", "norm", "ord").repartition("article_id").sortWithinPartitions("article_id", "ord")
    return rows.mapInArrow(_by_article(_pairs, spread), f"article_id {kind['article_id']}, a {kind['ord']}, b {kind['ord']}")


def text_leaders(spans: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(article_id, ord, leader) of each different text, by its first place, that matches an earlier leader of its article.

    What `leader_clusters` gives for followers, without pairs: spans (article_id, ord, text) are shuffled once, by article, and the task that finds
    an article's matches, as in `matching_pairs`, settles them as well.
    """
    own = spans.select("article_id", "ord", normalize_text(F.col("text")).alias("norm")).where("article_id IS NOT NULL AND norm <> ''").repartition("article_id")
    rows = own.groupBy("article_id", "norm").agg(F.min("ord").alias("ord")).select("article_id", "norm", "ord").sortWithinPartitions("article_id", "ord")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_by_article(_led, spread), f"article_id {kind['article_id']}, ord {kind['ord']}, leader {kind['ord']}")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Followers among the b of matches (a before b) that come in order of b: those with an a that doesn't follow."""
    followers: set[tuple] = set()
    for batch in batches:
        keep = []
        for article, a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            new = (article, b) not in followers and (article, a) not in followers
            if new:
                followers.add((article, b))
            keep.append(new)
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(2)], names=["article_id", "ord"])


def followers(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(article_id, ord) of all texts that follow a leader, from the matches (article_id, a, b) with a before b.

    A text without an earlier match leads. Of up to `small` matches one task finds the followers in order.
    Of more, a round makes all that match such a leader followers and drops their matches on either
    side, until no more than `small` are left; most matches are settled in the first rounds.
    """
    rest, found = pairs, []
    while rest.count() > small:
        waiting = rest.select("article_id", F.col("b").alias("a")).distinct()
        led = cut(rest.join(waiting, ["article_id", "a"], "left_anti").select("article_id", "b").distinct())
        found.append(led.select("article_id", F.col("b").alias("ord")))
        rest = cut(rest.join(led, ["article_id", "b"], "left_anti").join(led.withColumnRenamed("b", "a"), ["article_id", "a"], "left_anti").select("article_id", "a", "b"))
    keyed = rest.select("article_id", "a", "b", F.to_json(F.struct("a")).alias("ka"), F.to_json(F.struct(F.col("b").alias("a"))).alias("kb"))
    place = pairs.schema["b"].dataType.simpleString()
    found.append(keyed.repartition(1).sortWithinPartitions("article_id", "b").mapInArrow(_settle, f"article_id {pairs.schema['article_id'].dataType.simpleString()}, ord {place}"))
    return cut(reduce(DataFrame.unionByName, found))


def leader_clusters(classes: DataFrame, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(article_id, ord, leader): in order, a text that no earlier leader matches leads, any other follows the earliest."""
    follow = followers(pairs, small)
    first = pairs.join(follow.withColumnRenamed("ord", "a"), ["article_id", "a"], "left_anti").groupBy("article_id", F.col("b").alias("ord")).agg(F.min("a").alias("a"))
    return classes.select("article_id", "ord").join(first, ["article_id", "ord"], "left").select("article_id", "ord", F.coalesce("a", "ord").alias("leader"))


def confidence(supporters: Column, consistent: Column, capped: bool = False) -> Column:
    """1.0 for three supporters, 0.67 for two of one mind, 0.5 for other two, else 0.33; with `capped`, more than three count as three."""
    n = F.least(supporters, F.lit(3)) if capped else supporters
    return F.when(n == 3, 1.0).when((n == 2) & consistent, 0.67).when(n == 2, 0.5).otherwise(0.33)


def _vote(spans: DataFrame, label: str) -> DataFrame:
    """The most frequent label of each cluster; ties go to the one seen first."""
    counts = spans.groupBy("article_id", "leader", label).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    fewest = counts.select("*", F.struct((-F.col("n")).alias("n"), "first").alias("rank"))
    return fewest.groupBy("article_id", "leader").agg(F.min_by(label, "rank").alias(label), (F.count("*") == 1).alias(f"one_{label}"))


def fold_texts(marked: DataFrame, sizes: DataFrame, pad: int = 2, fold: int = FOLD) -> DataFrame:
    """(article_id, leader, folded): each cluster's texts narrowed one after the other to the words that they share.

    `marked` has article_id, leader, ord, norm of every member, `sizes` (article_id, leader, num_supporters).
    Every member is folded, repeated texts as well. A fold never lengthens the text, and one that changes words shortens it, so
    clusters of more than `fold` members are folded in rounds: each finds the first member beyond
    the last one that changes the text. Rounds are as many as the most changes of a cluster's text.
    """
    key = ["article_id", "leader"]
    few = marked.join(sizes.where((F.col("num_supporters") > 1) & (F.col("num_supporters") <= fold)).select(*key), key, "left_semi")
    texts = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "norm"))).alias("texts"))
    out = texts.select(*key, F.aggregate(F.slice(F.col("texts.norm"), 2, F.size("texts")), F.element_at("texts.norm", 1), lambda t, m: F.coalesce(intersect_window(t, m, pad), t)).alias("folded"))
    large = sizes.where(F.col("num_supporters") > fold).select(*key)
    if large.isEmpty():
        return out
    many = cut(marked.join(large, key, "left_semi").select(*key, "ord", "norm"))
    distinct = cut(many.select(*key, "norm").distinct())
    state = cut(many.groupBy(*key).agg(F.min_by("norm", "ord").alias("t"), F.min("ord").alias("at")))
    done = []
    while True:
        changes = state.join(distinct, key).withColumn("new", intersect_window(F.col("t"), F.col("norm"), pad)).where("new <> t").select(*key, "norm", "new", "at")
        step = cut(many.join(changes, [*key, "norm"]).where("ord > at").groupBy(*key).agg(F.min_by("new", "ord").alias("t"), F.min("ord").alias("at")))
        done.append(state.join(step, key, "left_anti").select(*key, F.col("t").alias("folded")))
        if step.isEmpty():
            break
        state = step
    return reduce(DataFrame.unionByName, done, out)


def build_consensus(spans: DataFrame, pad: int = 2, capped: bool = False, small: int = SMALL, fold: int = FOLD) -> DataFrame:
    """(article_id, leader, [title,] text, category, subcategory, confidence, num_supporters, distinct_workers, label_consistent).

    `spans` has article_id, ord (the place in reading order, unique; a bigint or an ordered struct), text, category,
    subcategory, worker, and perhaps title: the first one of a cluster, or else of its article, is kept. Category and
    subcategory are voted for one by one. A cluster of one span keeps its raw text; otherwise the texts of all members
    are narrowed one after the other to the words that they share. Spans with a null article or text are left out;
    null labels vote as a label of their own.
    """
    titled = "title" in spans.columns
    named = spans.select("article_id", "ord", "text", "category", "subcategory", "worker", F.col("title") if titled else F.lit(None).cast("string").alias("title"))
    spans = cut(named.where(F.col("article_id").isNotNull() & F.col("text").isNotNull()))
    classes = cut(span_classes(spans))
    clusters = leader_clusters(classes, cut(matching_pairs(classes)), small)
    of_text = classes.join(clusters, ["article_id", "ord"]).select("article_id", "norm", (F.size("content") < 2).alias("alone"), "leader")
    own = spans.withColumn("norm", normalize_text(F.col("text")))
    # texts with under two words that count match nothing, not even their copies
    marked = cut(own.join(of_text, ["article_id", "norm"]).withColumn("leader", F.when(F.col("alone"), F.col("ord")).otherwise(F.col("leader"))).drop("alone"))
    key = ["article_id", "leader"]
    seen = F.struct(F.col("title").isNull(), "ord")
    base = cut(marked.groupBy(*key).agg(F.count("*").alias("num_supporters"), F.count_distinct("worker").alias("distinct_workers"), F.min_by("text", "ord").alias("raw"), F.min_by("title", seen).alias("own_title"), F.min("ord").alias("first")))
    out = base.join(fold_texts(marked, base, pad, fold), key, "left").join(_vote(marked, "category"), key).join(_vote(marked, "subcategory"), key)
    if titled:
        named = base.groupBy("article_id").agg(F.min_by("own_title", F.struct(F.col("own_title").isNull(), "first")).alias("article_title"))
        out = out.join(named, "article_id").withColumn("title", F.coalesce("own_title", "article_title"))
    consistent = F.col("one_category") & F.col("one_subcategory")
    return out.select(
        *key, *(["title"] if titled else []), F.when(F.col("num_supporters") == 1, F.col("raw")).otherwise(F.coalesce("folded", "raw")).alias("text"), "category", "subcategory",
        confidence(F.col("num_supporters"), consistent, capped).alias("confidence"), "num_supporters", "distinct_workers", consistent.alias("label_consistent"),
    )
