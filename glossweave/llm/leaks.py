"""Held-out test passages in a corpus: a generalised suffix automaton of the passages, streamed over with each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.scan import mix, pieces, words
from glossweave.session import cut

#: Words that a verbatim stretch needs to count; a changed word ends a stretch.
STRETCH = 5
#: Words, changed, put in or left out, that two stretches of one piece may be apart.
GAP = 8
#: Least share of the passage's words in a leaked piece.
SHARE = 1 / 3
#: A changed word near the end of a piece hides the words beyond it, fewer than a stretch; changed words hide as
#: much within a piece. So a piece counts from this share of the passage between its ends, and verbatim, on.
EXTENT, VERBATIM = 0.9 * SHARE, 0.75 * SHARE
#: No piece with fewer verbatim words counts: quotes of under ten words are no case.
LEAST = 10
#: Passage words in one automaton, at most two states each and about half a kilobyte a state in each worker; more
#: passages go into further automatons, one pass over the corpus each.
BLOCK_WORDS = 300_000


def passage(kind: str | None, text: str | None) -> str:
    """The passage of a test item: the whole text, or of a prompt what stands between its first and last paragraph."""
    text = text or ""
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    return "\n\n".join(parts[1:-1]) if kind == "prompt" and len(parts) > 2 else text


class Automaton:
    """Generalised suffix automaton over word numbers, with the places where each state's words end."""

    def __init__(self, texts: list[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(texts):
            last = 0
            for p, c in enumerate(text.tolist()):
                last = self._extend(last, c, ends)
                ends[last].append((k, p))
        self.children: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            self.children[self.link[s]].append(s)
        self.own = ends
        self.after = [[*t.tolist()[1:], -2] for t in texts]
        self._places: dict[int, np.ndarray] = {}

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q, ends)
        cur = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        new = self._state(self.length[p] + 1, ends)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def places(self, state: int) -> np.ndarray:
        """(passage, end) of every occurrence of the state's words."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self.own[s]
                todo += self.children[s]
            self._places[state] = np.array(found, np.int64).reshape(-1, 2)
        return self._places[state]

    def stretches(self, stream: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each longest match of at least `least` words that the next word doesn't prolong."""
        state = size = 0
        for q, c in enumerate(stream):
            nxt = self.next[state].get(c)
            if nxt is None and size >= least:
                yield q - 1, size, state
            while nxt is None and state:
                state = self.link[state]
                size = self.length[state]
                nxt = self.next[state].get(c)
            if nxt is not None:
                state, size = nxt, size + 1
        if size >= least:
            yield len(stream) - 1, size, state


    def matches(self, stream: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(passage, its end, end, size) of each stretch of at least `least` words, passage by passage, that no word prolongs.

        Suffix links lead from what all passages together have to what further passages have of it.
        """
        state = size = 0
        for q, c in enumerate(stream):
            nxt = self.next[state].get(c)
            while nxt is None and state:
                state = self.link[state]
                size = self.length[state]
                nxt = self.next[state].get(c)
            if nxt is not None:
                state, size = nxt, size + 1
            s, n, seen, following = state, size, set(), stream[q + 1] if q + 1 < len(stream) else -3
            while n >= least:
                at = self.places(s)
                if len(at) > len(seen):
                    for k, p in at.tolist():
                        if (k, p) not in seen:
                            seen.add((k, p))
                            if self.after[k][p] != following:
                                yield k, p, q, n
                s = self.link[s]
                n = self.length[s]


def _grams(h: np.ndarray) -> np.ndarray:
    g = np.zeros(max(0, len(h) - STRETCH + 1), np.uint64)
    for i in range(STRETCH):
        g = mix(g ^ h[i : len(h) - STRETCH + 1 + i])
    return g


class Passages:
    """What each task needs of one block of passages."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, rows, _, _ = words(pa.array(texts, pa.large_string()))
        self.vocabulary, number = np.unique(h, return_inverse=True)
        cut = [number[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.ids, self.sizes = np.array(ids), np.array([len(c) for c in cut])
        self.automaton = Automaton(cut)
        self.grams = np.unique(np.concatenate([_grams(h[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)] or [np.zeros(0, np.uint64)]))

    def pieces_of(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first word, last word + 1) of each leaked piece in a text with word hashes h."""
        if len(h) < STRETCH or not len(self.grams):
            return []
        g = _grams(h)
        hit = np.flatnonzero(self.grams[np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)] == g)
        if not len(hit):
            return []
        breaks = np.flatnonzero(np.diff(hit) > 1)
        firsts, lasts = hit[np.concatenate([[0], breaks + 1])], hit[np.concatenate([breaks, [len(hit) - 1]])] + STRETCH
        found = []  # passage, place in it, place in the text, words
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            numbers = np.minimum(np.searchsorted(self.vocabulary, h[a:b]), len(self.vocabulary) - 1)
            stream = np.where(self.vocabulary[numbers] == h[a:b], numbers, -1).tolist()
            found += [(k, p - size + 1, a + end - size + 1, size) for k, p, end, size in self.automaton.matches(stream, STRETCH)]
        if not found:
            return []
        m = np.array(found, np.int64)
        return self._chains(m[np.lexsort((m[:, 1], m[:, 2], m[:, 0]))])

    def _chains(self, m: np.ndarray) -> list[tuple[int, int, int]]:
        """Pieces made of stretches that follow one another in passage and text alike, at most GAP words apart."""
        out = []
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(m[:, 0])) + 1, [len(m)]])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            k = int(m[a, 0])
            n = int(self.sizes[k])
            if m[a:b, 3].sum() < min(n, max(LEAST, n * VERBATIM)):
                continue
            chains: list[list[int]] = []  # passage start, end, text start, end, verbatim words
            live: list[list[int]] = []  # stretches come in order of the text, so one that ended too far back is over
            for _, p, q, size in m[a:b].tolist():
                best = None
                live = [c for c in live if q - c[3] <= GAP]
                for c in reversed(live):
                    over = max(c[1] - p, c[3] - q, 0)
                    if p - c[1] <= GAP and over < size and abs((p - c[1]) - (q - c[3])) <= GAP // 2 and p + size > c[1] and (best is None or c[4] > best[4]):
                        best = c
                if best is None:
                    chains.append([p, p + size, q, q + size, size])
                    live.append(chains[-1])
                else:
                    gained = size - max(best[1] - p, best[3] - q, 0)
                    best[1], best[3], best[4] = p + size, q + size, best[4] + gained
            for p0, p1, q0, q1, verbatim in chains:
                if p1 - p0 >= n * EXTENT and verbatim >= min(n, max(LEAST, n * VERBATIM)) and verbatim >= 0.5 * (p1 - p0):
                    out.append((k, q0, q1))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, start, stop): leaked pieces of test passages in the documents, in characters.

    Passages and texts are compared as words in lower case, so layout, punctuation and symbols don't
    count. One pass over the corpus, without a shuffle, for each `block_words` words of passages: the
    automaton of a block is broadcast, and that bound is its size. Null and empty texts and items have no
    pieces; passages shorter than a stretch can't be found; a document twice in the corpus is reported
    twice. Items are the bounded, held-out side: `item_id`, `item_kind`, `text`.
    """
    spark = docs.sparkSession
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "item_kind", "text").orderBy("item_id").toLocalIterator()
    blocks, size = [[]], 0
    for r in rows:
        p = passage(r.item_kind, r.text)
        n = p.count(" ") + 1
        if size + n > block_words and blocks[-1]:
            blocks, size = [*blocks, []], 0
        blocks[-1].append((r.item_id, p))
        size += n

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Passages = shared.value
            for whole in batches:
                for b in pieces(whole, 1):
                    h, at, starts, ends = words(b.column(1))
                    ids, found = b.column(0).to_pylist(), []
                    offset = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False))])
                    for i in range(b.num_rows):
                        for k, q0, q1 in block.pieces_of(h[at[i] : at[i + 1]]):
                            found.append((int(block.ids[k]), ids[i], int(starts[at[i] + q0] - offset[i]), int(ends[at[i] + q1 - 1] - offset[i])))
                    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["item_id", "doc_id", "start", "stop"])

        return run

    out = None
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    for block in blocks:
        shared = spark.sparkContext.broadcast(Passages([i for i, _ in block], [p for _, p in block]))
        part = texts.mapInArrow(scan(shared), "item_id bigint, doc_id bigint, start int, stop int")
        out = part if out is None else out.unionByName(part)
    return out


def remove_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.5) -> DataFrame:
    """The documents without leaked spans; a document of which more than `max_share` leaked goes as a whole.

    Overlapping spans are cut once. Documents without leaks and null texts pass unchanged, and without Python; while
    the leaked ids are few enough to be broadcast by their measured size, no document is shuffled.
    """
    spans = cut(leaks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("_spans")).withColumnRenamed("doc_id", id_col))

    def cut_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, keep = [], []
            for text, found in zip(b[text_col], b["_spans"], strict=True):
                if text is None:
                    texts.append(text)
                    keep.append(True)
                    continue
                parts, at = [], 0
                for s in sorted((f["start"], f["stop"]) for f in found):
                    parts.append(text[at : max(at, s[0])])
                    at = max(at, s[1])
                texts.append("".join([*parts, text[at:]]))
                keep.append(len(texts[-1]) >= (1 - max_share) * len(text))
            b[text_col] = texts
            yield b.drop(columns="_spans")[pd.Series(keep, index=b.index)]

    columns = [id_col, *[c for c in docs.columns if c != id_col]]
    touched = docs.join(spans, id_col).select(*columns, "_spans").mapInPandas(cut_spans, docs.select(*columns).schema)
    return docs.join(spans.select(id_col), id_col, "left_anti").select(*columns).unionByName(touched)


def _found(spark, d):
    return find_leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_found(spark, d):
    return _found(spark, d).select("item_id", "doc_id").distinct()


def p8_spans(spark, d):
    """The leaked pieces with their places in each document."""
    return _found(spark, d)


def p8_cleaned(spark, d):
    """The corpus without leaked spans, as its documents' lengths."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return remove_leaks(docs, _found(spark, d)).select("doc_id", F.length("text").alias("n_chars"))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned}
ORACLE: dict[str, str] = {}
