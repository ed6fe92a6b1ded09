"""Text read in the wrong character encoding: transformations inferred from clean near-twins, applied to all records."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.session import cut

# Encodings that a text can have been written in, and others that it can have been read in.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "mac_roman", "cp1250")
READ = ("cp1252", "mac_roman", "cp1251", "gbk", "cp850", "cp437", "cp1250", "latin-1", "iso8859-2", "koi8-r", "cp866")

#: ASCII letters and digits on either side of a run of other characters that near-twins must share.
CONTEXT = 8
#: Different contexts in which a transformation must explain a run by a clean twin's run.
SUPPORT = 3
#: Records in which a character or a pair of neighbours must occur to count as usual.
USUAL = 3
#: Most characters of a garbled sequence that is learned from aligned runs.
SEQUENCE = 4
#: Votes that a learned sequence needs, as a share of the records with its rarest character: one in use as a letter has few.
VOTED = 0.3
#: Gain in log likelihood of neighbouring characters, a character, from which a text in one-byte encodings counts as misread.
GAIN = 1.5


@cache
def _shown(read: str) -> dict[int, str]:
    """The character for each upper byte of a one-byte encoding; undefined bytes stand for themselves."""
    return {b: bytes([b]).decode(read, "ignore") or chr(b) for b in range(0x80, 0x100)}


@cache
def _bytes_of(read: str) -> dict[str, int]:
    """The byte behind each character of a one-byte encoding, or behind a control character left of it."""
    return {chr(b): b for b in range(0x80, 0xA0)} | {c: b for b, c in _shown(read).items()}


def _misplaced(text: str) -> bool:
    """Whether a character stands where its kind hardly does: a symbol or a capital within a word, a letter at a figure."""
    for a, b, c in zip(f" {text}", text, f"{text[1:]} ", strict=False):
        if b.isascii():
            continue
        if (a.islower() and b.isupper()) or (b.isalpha() and c.isdigit()) or (a.isalpha() and c.isalpha() and not b.isalnum() and b not in _WITHIN):
            return True
    return False


# Signs that stand within words or between them.
_WITHIN = "’‘‑–—…\u00ad\u200b“”«»‹›"


def misread(text: str, written: str, read: str) -> str | None:
    """What becomes of a text that was written in one encoding and read in another, or None."""
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    if read == "gbk":
        return raw.decode("gbk", "replace")
    return "".join(chr(b) if b < 0x80 else _shown(read)[b] for b in raw)


@cache
def _alphabet() -> frozenset[str]:
    """Characters of the one-byte encodings in lower case: neighbours are counted among these and ASCII only, so their number is bounded."""
    one_byte = {e for e in (*WRITTEN, *READ) if e not in ("utf-8", "gbk")}
    return frozenset(c.lower() for e in one_byte for c in _shown(e).values() if len(c.lower()) == 1)


def _is_letter_of(c: str, low: int, high: int) -> bool:
    return low <= ord(c) <= high


def _cyrillic(c: str) -> bool:
    return _is_letter_of(c, 0x400, 0x45F)


class Model:
    """Usual characters and neighbours of the corpus, and the transformations in use."""

    def __init__(self, counts: dict[str, int], chains: list[tuple[str, str]], learned: dict[str, str] | None = None):
        self.counts = counts
        self.learned = learned or {}
        self.usual = {c for c, n in counts.items() if len(c) == 1 and n >= USUAL and not 0x80 <= ord(c) < 0xA0}
        self.total = sum(n for c, n in counts.items() if len(c) == 2) + 1
        self.chains = chains

    def _likelihood(self, text: str) -> tuple[float, int]:
        return self._likelihood_of(f" {text} ")

    def _likelihood_of(self, text: str) -> tuple[float, int]:
        pairs = [a + b for a, b in itertools.pairwise(text.lower()) if ord(a) > 127 or ord(b) > 127]
        return sum(math.log((self.counts.get(p, 0) + 0.1) / self.total) for p in pairs), len(pairs)

    def _undo_utf8(self, text: str, read: str) -> tuple[str, int]:
        """(text with each misread UTF-8 sequence restored, number of those)."""
        byte = _bytes_of(read)

        def options(c: str) -> set[int]:
            return {byte[v] for v in (c, c.upper(), c.lower()) if v in byte}

        out: list[str] = []
        done: list[int] = []
        i, restored = 0, 0
        while i < len(text):
            c = text[i]
            hit = None
            if ord(c) > 127:
                for lead in sorted(options(c), key=lambda b: byte.get(c) != b):
                    n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                    if not n or i + n > len(text) or any(ord(x) < 128 for x in text[i + 1 : i + n]):
                        continue
                    for rest in itertools.product(*[[b for b in sorted(options(x), key=lambda b, x=x: byte.get(x) != b) if 0x80 <= b <= 0xBF] for x in text[i + 1 : i + n]]):
                        try:
                            d = bytes([lead, *rest]).decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        exact = byte.get(c) == lead and all(byte.get(x) == b for x, b in zip(text[i + 1 : i + n], rest, strict=True))
                        letters = text[i : i + n].isalpha() and all(x.lower() in self.usual for x in text[i : i + n])
                        if (d in self.usual or (exact and d.lower() in self.usual)) and (exact or not letters or _cyrillic(d)):
                            hit = (d, n)
                            break
                    if hit:
                        break
            if hit:
                done.append(len(out))
                out.append(hit[0])
                i += hit[1]
                restored += 1
            else:
                out.append(c)
                i += 1
        lone = [k for k in done if _cyrillic(out[k])]
        if lone and not any(b - a == 1 for a, b in itertools.pairwise(lone)):  # a single letter can be chance
            return text, 0
        return "".join(out), restored

    def _undo_gbk(self, text: str) -> tuple[str, int]:
        out, i, restored = [], 0, 0
        while i < len(text):
            j = i
            while j < len(text) and (_is_letter_of(text[j], 0x2E80, 0x9FFF) or 0xE000 <= ord(text[j]) <= 0xF8FF):
                j += 1
            if j == i:
                out.append(text[i])
                i += 1
                continue
            try:
                raw = text[i:j].encode("gb18030")
                cut = 3 if text[j : j + 1] == "�" else 0
                for n in range(cut + 1):
                    try:
                        out.append(raw[: len(raw) - n].decode("utf-8") + "�" * (n > 0))
                        restored += 1
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(text[i:j])
            except UnicodeEncodeError:
                out.append(text[i:j])
            i = j
        return "".join(out), restored

    def _undo_whole(self, text: str, written: str, read: str) -> str | None:
        """The text re-read in the encoding that it was written in, if that makes all of it more usual."""
        byte = _bytes_of(read)
        try:
            new = "".join(c if ord(c) < 128 else bytes([byte[c]]).decode(written) for c in text)
        except (KeyError, UnicodeDecodeError):
            return None
        if any(ord(c) > 127 and c.lower() not in self.usual for c in new) or not (_misplaced(text) or any(map(_cyrillic, new)) or ("“" in new and "”" in new) or re.search(r"\w’s\b", new)):
            return None
        (a, n), (b, m) = self._likelihood(text), self._likelihood(new)
        return new if n and m and b / m - a / n > GAIN else None

    def _undo_learned(self, text: str) -> tuple[str, int]:
        """(text with runs rewritten by learned sequences where that makes them far more usual, number of these runs)."""
        out, done, i = [], 0, 0
        while i < len(text):
            if text[i].isascii():
                out.append(text[i])
                i += 1
                continue
            j = i
            while j < len(text) and not text[j].isascii():
                j += 1
            new, k = [], i
            while k < j:
                n = next((n for n in range(min(SEQUENCE, j - k), 0, -1) if text[k : k + n] in self.learned or text[k : k + n].lower() in self.learned), 0)
                seq = text[k : k + n] or text[k]
                new.append(self.learned.get(seq) or self.learned.get(seq.lower()) or seq)
                k += max(n, 1)
            run, before, after = "".join(new), text[i - 1 : i] or " ", text[j : j + 1] or " "
            cased = run.islower() and (before.isupper() or (before.isspace() and after.isupper()))  # a small letter among capitals
            if run != text[i:j] and not cased:
                (a, n), (b, m) = self._likelihood_of(before + text[i:j] + after), self._likelihood_of(before + run + after)
                if n and m and b / m - a / n > GAIN:
                    done += 1
                    out.append(run)
                    i = j
                    continue
            out.append(text[i:j])
            i = j
        return "".join(out), done

    def repair(self, text: str) -> tuple[str, bool]:
        """(restored text, whether it was damaged). Characters lost for good stay U+FFFD."""
        damaged = "�" in text
        for _ in range(3):
            best, most = text, 0
            for written, read in self.chains:
                if written == "utf-8":
                    new, n = self._undo_gbk(text) if read == "gbk" else self._undo_utf8(text, read)
                    if n > most:
                        best, most = new, n
            if not most:
                break
            text, damaged = best, True
        if not damaged:
            for written, read in self.chains:
                if written != "utf-8" and (new := self._undo_whole(text, written, read)) is not None:
                    return new, True
            new, n = self._undo_learned(text)
            if n:
                return new, True
        return text, damaged


def runs(text: str) -> list[tuple[str, str]]:
    """(context, run) of each run of non-ASCII characters.

    A context is the ASCII letters and digits around the run; and a hash of all those of the text, with the run's
    number, which also holds for texts with hardly any.
    """
    bare = "".join(c.lower() for c in text if c.isascii() and c.isalnum())
    out, k, i = [], 0, 0
    while i < len(text):
        if text[i].isascii():
            k += text[i].isalnum()
            i += 1
            continue
        j = i
        while j < len(text) and not text[j].isascii():
            j += 1
        out.append((k, text[i:j]))
        i = j
    near = [(f"{bare[k - CONTEXT : k]}|{bare[k : k + CONTEXT]}", r) for k, r in out if k >= CONTEXT and len(bare) - k >= CONTEXT]
    whole = blake2b(bare.encode(), digest_size=12).hexdigest()
    return near + [(f"{whole}#{n}/{len(out)}", r) for n, (_, r) in enumerate(out) if bare]


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """(sequence, character) pairs of two runs, character by character; none where it isn't certain which belong together.

    Equal characters at either end belong together; what is left between them does if it is one clean
    character, or as many characters on either side.
    """
    i, j = 0, 0
    while i < min(len(garbled), len(clean)) and garbled[i] == clean[i]:
        i += 1
    while j < min(len(garbled), len(clean)) - i and garbled[-1 - j] == clean[-1 - j]:
        j += 1
    g, c = garbled[i : len(garbled) - j], clean[i : len(clean) - j]
    if len(g) == len(c):
        return [(x, y) for x, y in zip(g, c, strict=True) if x != y]
    return [(g, c)] if len(c) == 1 and 0 < len(g) <= SEQUENCE else []


def explain(garbled: str, clean: str) -> tuple[str, str] | None:
    """The first transformation that turns the clean run into the garbled one, letter case apart."""
    for written, read in itertools.product(WRITTEN, READ):
        made = None if written == read else misread(clean, written, read)
        if made is not None and made != clean and made.lower() == garbled.lower():
            return written, read
    return None


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: Counter = Counter()
        for t in b["value"]:
            seen.update({c for c in t if ord(c) > 127} | {c.lower() for c in t if ord(c) > 127} | {p for p in map("".join, itertools.pairwise(f" {t.lower()} ")) if not p.isascii() and all(c.isascii() or c in _alphabet() for c in p)})
        yield pd.DataFrame({"c": list(seen.keys()), "n": list(seen.values())}, columns=["c", "n"])


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen = Counter(r for t in b["value"] for r in runs(t))
        yield pd.DataFrame([(k, r, n) for (k, r), n in seen.items()], columns=["context", "run", "n"])


def learn(values: DataFrame) -> Model:
    """The model of a column `value` without nulls.

    Runs of non-ASCII characters meet in the same context of ASCII letters; the run of the most usual
    characters is the clean one, and each other run votes for the encodings that make it from the clean one,
    and, aligned with it character by character, for the sequences that stand for single characters. Sequences need no
    encoding that is known. What comes to the driver are counts of characters (bounded by Unicode) and of neighbours
    (bounded by the square of the one-byte encodings' letters), of encodings (WRITTEN x READ), and the sequences
    of up to SEQUENCE characters with votes from SUPPORT contexts (for each clean letter in use a few).
    """
    odd = values.where("value RLIKE '[^\\\\x00-\\\\x7f]'").select("value")
    counts = {r.c: r.n for r in odd.mapInPandas(_counted, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= USUAL).toLocalIterator()}
    found = odd.mapInPandas(_run_rows, "context string, run string, n bigint").groupBy("context", "run").agg(F.sum("n").alias("n"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = [min(counts.get(c, 0) for c in r) for r in b["run"]]
            yield b

    marked = found.mapInPandas(scored, "context string, run string, n bigint, score bigint")
    clean = marked.groupBy("context").agg(F.max_by("run", F.struct("score", "n", "run")).alias("clean"), F.count("*").alias("variants")).where("variants > 1").select("context", "clean")

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes: Counter = Counter()
            for u, v in zip(b["run"], b["clean"], strict=True):
                if u.lower() != v.lower():
                    if e := explain(u, v):
                        votes["encoding", *e] += 1
                    votes.update({("sequence", x, y) for x, y in (*align(u, v), *align(u.lower(), v.lower()))})
            yield pd.DataFrame([(*k, n) for k, n in votes.items()], columns=["kind", "a", "b", "n"])

    votes = found.join(clean, "context").where("run <> clean").select("run", "clean").mapInPandas(explained, "kind string, a string, b string, n bigint")
    enough = cut(votes.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT))
    chains = [(r.a, r.b) for r in enough.where("kind = 'encoding'").orderBy(F.desc("n"), "a", "b").collect()]
    best = enough.where("kind = 'sequence'").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"), F.max("n").alias("n"))
    learned = {r.a: r.b for r in best.toLocalIterator() if r.n >= VOTED * min(counts.get(c, 0) for c in r.a)}
    return Model(counts, chains, learned)


def repair_values(values: DataFrame, model: Model) -> DataFrame:
    """The damaged rows of a frame with a column `value`, with the restored text in `restored`.

    Null and plain ASCII values are never damaged. All other columns pass through.
    """
    shared = values.sparkSession.sparkContext.broadcast(model)
    schema = values.drop("restored").schema.add("restored", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        for b in batches:
            done = [m.repair(t) for t in b["value"]]
            b["restored"] = [r for r, _ in done]
            yield b[[d for _, d in done]]

    return values.drop("restored").where("value RLIKE '[^\\\\x00-\\\\x7f]'").mapInPandas(run, schema)


def _values(spark, d):
    parts = []
    for table, key, cols in (("gold_standard_output", "gold_id", ("text", "title")), ("test_chatgpt", "llm_id", ("title",))):
        df = spark.read.parquet(f"{d}/{table}.parquet")
        parts += [df.select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in cols]
    return reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")


def _repaired(spark, d):
    values = _values(spark, d)
    # what the language model quoted is read for clean twins only
    quoted = spark.read.parquet(f"{d}/test_chatgpt.parquet").where("text IS NOT NULL").select(F.col("text").alias("value"))
    return repair_values(values, learn(values.select("value").unionByName(quoted)))


def p5_found(spark, d):
    return _repaired(spark, d).select("table_name", "row_id", "field_name")


def p5_restored(spark, d):
    """The damaged values with their original wording, where it can still be had."""
    return _repaired(spark, d).select("table_name", "row_id", "field_name", "restored")


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
ORACLE: dict[str, str] = {}
