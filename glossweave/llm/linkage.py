"""Matching quotes across sources without keys: soft-logic linkage solved by alternating directions."""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.session import cut

#: Bits of a word that the other side lacks (a name, or a slip), and from which a word counts as a name.
UNSEEN, NAME = 8.5, 8.5
#: Least share of letters in common, in order, of a word and the same word with slips.
SLIPS = 0.65
#: What another name or figure leaves of a similarity.
OTHER = 0.35
#: What candidates share at least: words, a share of the poorer record's words (by number), a share of its information; and the
#: bits of a word that the other side lacks, in this first test of quotes and of titles.
Near = namedtuple("Near", "common words bits lacking")
QUOTES, TITLES = Near(3, 0.5, 0.55, 1.5), Near(1, 0.0, 0.5, 8.5)
NEAR = (QUOTES.words, QUOTES.bits)
#: Records of a word from which its rows are spread over several tasks.
SPREAD = 16_384
#: Confidence from which a pair counts as a match.
CONFIDENT = 0.5
#: Weights of the rules, see `ground`.
RULES = {"text": 4.0, "title": 2.0, "no_text": 4.0, "no_title": 5.0, "prior": 0.6, "article": 2.0, "transitive": 3.0}
#: Most rounds of alternating directions, their step, and the largest change and disagreement of a value at which they end.
ROUNDS, STEP, TOLERANCE = 5_000, 20.0, 1e-3
#: Blocks of quotes that meet all others by text alone: model quotes without a title, and quotes of articles without one.
NO_TITLE, NO_ARTICLE_TITLE = -1, -2


def word_list(text: Column) -> Column:
    """Words in lower case without punctuation, hyphens and letters that encodings garble; an underscore is a space.

    Letters of other scripts than Latin and Cyrillic are kept in words of their own, but not beside Latin
    letters, where garbled accents show as such; signs of scripts that write no spaces are words by themselves.
    """
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_\s\p{Z}–—]+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N} ]|[\p{IsLatin}&&[^a-z]]", "")
    other = r"[\p{L}\p{M}\p{N}&&[^a-z0-9а-џ]]+"
    t = F.regexp_replace(t, f"(?<=[a-z0-9]){other}|{other}(?=[a-z0-9])", "")
    t = F.regexp_replace(t, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])", " $1 ")
    return F.filter(F.split(t, " +"), lambda w: w != "")


def _classes(df: DataFrame, id_col: str, extra: list[str]) -> DataFrame:
    """Records of equal words as one class: its smallest id, its words, and the class of each id."""
    words = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *extra, word_list(F.col("text")).alias("text_words"), word_list(F.col("title")).alias("title_words"))
    return words.withColumn("key", F.xxhash64("text_words", "title_words", *extra)).withColumn("key2", F.hash("title_words", "text_words", *extra))


def _packed(records: DataFrame, freq: DataFrame, total: Column, words: str = "text_words", lacking: float = QUOTES.lacking) -> DataFrame:
    """(id, packed, known): a record's distinct words, each as 48 bits of its hash and 16 of its information (in 1/100 bit).

    Both sides use the same counts, so equal words are equal numbers. Words that the other side lacks
    count `lacking` here, for quotes less than they do in quote_similarity; they are not among the known ones.
    """
    rows = records.select("id", F.explode(F.array_distinct(words)).alias("word")).withColumn("w", F.xxhash64("word")).join(freq, "w", "left")
    bits = F.round(F.coalesce(F.log2(total / F.col("n")), F.lit(lacking)) * 100).cast("bigint")
    word = F.shiftleft(F.col("w"), 16).bitwiseOR(F.least(bits, F.lit(65535)))
    return rows.groupBy("id").agg(F.collect_set(word).alias("packed"), F.collect_set(F.when(F.col("n").isNotNull(), word)).alias("known"))


def _marks(packed: Column) -> list[Column]:
    """A quote's words as marks in 4 x 64 places: a word without a mark on the other side is not one of its words."""
    hashed = F.transform(packed, lambda x: F.shiftright(x, 16).cast("bigint"))

    def marked(k):
        def add(s, x):
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
            return F.when(F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k, s.bitwiseOR(bit)).otherwise(s)

        return F.aggregate(hashed, F.lit(0).cast("bigint"), add).alias(f"m{k}")

    return [marked(k) for k in range(4)]


def _keys(packed: DataFrame, blocks: DataFrame, near: Near) -> DataFrame:
    """(block, word, id, size, bits, m0..m3, left): a record under each word by which it can be met, with the bits from this word on.

    Words are in the same order on both sides, rarest first. The first word that two candidates share has
    all that they share from its place on; so near.common words at least, and in `left` the bits of these and all later words.
    """
    row = F.struct(F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("word"))

    def add(s, v):  # a word with the sum so far
        return F.concat(s, F.array(F.struct((F.coalesce(F.get(s, F.size(s) - 1)["left"], F.lit(0)) + v["own"]).alias("left"), v["word"].alias("word"))))

    ordered = F.array_sort(F.transform("known", lambda w: F.struct(w.bitwiseAND(F.lit(65535)).alias("own"), w.alias("word"))))
    sums = F.aggregate(ordered, F.slice(F.array(row), 1, 0), add)
    marked = packed.select("id", F.size("packed").alias("size"), _bits(F.col("packed")).alias("bits"), *_marks(F.col("packed")), "known")
    joined = marked.join(blocks.select("id", "block"), "id")  # before the words are rows, which go through one shuffle then
    kept = F.when(F.size("known") >= near.common, F.slice(sums, near.common, F.greatest(F.lit(1), F.size("known"))))
    return joined.select("block", "id", "size", "bits", *[f"m{k}" for k in range(4)], F.inline(kept))


def _met(poor: DataFrame, rich: DataFrame, sides: tuple[str, str], total: Column, ties: bool, near: Near, spread: int) -> DataFrame:
    """(g, l) of all pairs that may pass the test, `poor` the record with less information; a pair may come twice.

    A poorer record is sought under its rarest words only, as long as those from there on hold near.bits of its
    information; the richer one under all of its words. Rows of a word with more than `spread` records
    go to several tasks. Marks and sizes exclude most pairs in the join's own stage.
    """
    need = F.lit(near.bits * (1 - 1e-9)) * F.greatest(F.lit(1), F.col("x.bits"))
    parts = F.ceil(total * F.pow(F.lit(2.0), -F.col("word").bitwiseAND(F.lit(65535)) / 100) / spread).cast("int")
    x = poor.where(F.col("left") >= F.lit(near.bits * (1 - 1e-9)) * F.greatest(F.lit(1), F.col("bits"))).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    y = rich.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1)))

    def at_most(a, b):  # words of a that b may have
        lacks = [F.bit_count(F.col(f"{a}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.m{k}")))) for k in range(4)]
        return F.col(f"{a}.size") - sum(lacks[1:], lacks[0])

    least = F.greatest(F.lit(near.common), F.least(F.col("x.size"), F.col("y.size")) * near.words)
    poorer = F.col("x.bits") <= F.col("y.bits") if ties else F.col("x.bits") < F.col("y.bits")
    both = x.alias("x").join(y.alias("y"), ["block", "word", "part"]).where(poorer & (F.col("y.left") >= need) & (at_most("x", "y") >= least) & (at_most("y", "x") >= least))
    return both.select(F.col("x.id").alias(sides[0]), F.col("y.id").alias(sides[1])).select("g", "l")


def _information(a: DataFrame, b: DataFrame, words: str) -> DataFrame:
    """(w, n): the number of records with each word that both sides have."""
    def df(r):
        return r.select(F.explode(F.array_distinct(F.col(words))).alias("w")).groupBy(F.xxhash64("w").alias("w")).agg(F.count("*").alias("n"))

    return df(a).join(df(b).withColumnRenamed("n", "m"), "w").select("w", (F.col("n") + F.col("m")).alias("n"))


def _bits(packed: Column) -> Column:
    return F.aggregate(packed, F.lit(0).cast("bigint"), lambda s, x: s + x.bitwiseAND(F.lit(65535)))


def _spelled(records: DataFrame, freq: DataFrame, words: str, total: Column, name: str) -> DataFrame:
    """(id, name): words in order, each with its bits, as one text; words that the other side lacks have none."""
    rows = records.select("id", F.posexplode(words).alias("pos", "word")).withColumn("w", F.xxhash64("word")).join(freq, "w", "left")
    word = F.struct("pos", F.concat_ws(":", "word", F.round(F.log2(total / F.col("n")), 2).cast("string")).alias("t"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(word))["t"], " ").alias(name))


def _alike(a: str, b: str) -> bool:
    """Whether two words are one with slips; figures never are."""
    m, n = len(a), len(b)
    if min(m, n) < 3 or 2 * min(m, n) < SLIPS * (m + n) or 2 * sum(c in b for c in a) < SLIPS * (m + n):
        return False  # so few letters in common that the ratio can't be reached
    return _ratio(a, b) >= SLIPS and not (a.isdigit() or b.isdigit())


@lru_cache(100_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, False).ratio()


def align(x: list[str], y: list[str]) -> tuple[list[int], list[tuple[range, range]]]:
    """(places in x of words that y has in the same order, gaps of both sides between them).

    Words that occur once on either side are the anchors: of these the longest run that rises in both
    is kept; in the gaps between, other equal words are taken from left to right.
    """
    at: dict[str, int] = {}
    for j, w in enumerate(y):
        at[w] = -1 if w in at else j
    ends: list[int] = []  # of the best rising run of each length: its last place in y
    last: list[int] = []  # and its last anchor
    anchors, before = [], []
    for i, w in enumerate(x):
        j = at.get(w, -1)
        if j >= 0 and x.count(w) == 1:
            k = bisect_left(ends, j)
            before.append(last[k - 1] if k else -1)
            anchors.append((i, j))
            if k == len(ends):
                ends.append(j)
                last.append(len(anchors) - 1)
            else:
                ends[k], last[k] = j, len(anchors) - 1
    run, k = [(len(x), len(y))], last[-1] if last else -1
    while k >= 0:
        run.append(anchors[k])
        k = before[k]
    equal, gaps, i0, j0 = [], [], 0, 0
    for i1, j1 in reversed(run):
        i, j = i0, j0
        while i < i1 and j < j1:
            if x[i] in y[j:j1]:
                k = y.index(x[i], j, j1)
                if i > i0 and k > j0:
                    gaps.append((range(i0, i), range(j0, k)))
                equal.append(i)
                i0, j0, j = i + 1, k + 1, k + 1
            i += 1
        if i0 < i1 and j0 < j1:
            gaps.append((range(i0, i1), range(j0, j1)))
        if i1 < len(x):
            equal.append(i1)
        i0, j0 = i1 + 1, j1 + 1
    return equal, gaps


def quote_similarity(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> float:
    """Information that two quotes have in common, in order, as a share of the poorer one's.

    Words with slips count as common. Another name or figure in the place of a name or figure says that
    the quotes are about something else, and leaves OTHER of the similarity.
    """
    x, y = [w for w, _ in a], [w for w, _ in b]
    equal, gaps = align(x, y)
    shared, others = sum(a[i][1] for i in equal), 0
    for mine, theirs in gaps:
        free, left = list(theirs), []
        for i in mine:
            k = next((j for j in free if _alike(x[i], y[j])), None)
            if k is None:
                left.append(i)
            else:
                free.remove(k)
                shared += min(a[i][1], b[k][1])
        figures = any(x[i].isdigit() for i in left) and any(y[j].isdigit() for j in free)
        names = any(a[i][1] >= NAME and not x[i].isdigit() for i in left) and any(b[j][1] >= NAME and not y[j].isdigit() for j in free)
        others += figures + names
    return OTHER**others * shared / max(0.1, min(sum(bits for _, bits in a), sum(bits for _, bits in b)))


@lru_cache(20_000)
def _words_of(spelled: str | None) -> list[tuple[str, float]]:
    return [(w, float(bits) if bits else UNSEEN) for w, _, bits in (x.partition(":") for x in (spelled or "").split())]


def near_pairs(gold: DataFrame, model: DataFrame, words: DataFrame, total: Column, spread: int = SPREAD, near: Near = QUOTES, column: str = "text_words", blocks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(g, l, share, info): all pairs of a block that share near.common words, and near.words and near.bits of the poorer's.

    `blocks` has (id, block) of either side, any number of blocks for a record; without it all records are in one.
    `share` is the share of the shorter one's words, `info` that of the poorer one's information.
    """
    packed = [cut(_packed(r, words, total, column, near.lacking)) for r in (gold, model)]
    g_keys, l_keys = (_keys(p, b if blocks else p.select("id", F.lit(0).alias("block")), near) for p, b in zip(packed, blocks or (None, None), strict=True))
    met = cut(_met(g_keys, l_keys, ("g", "l"), total, True, near, spread).unionByName(_met(l_keys, g_keys, ("l", "g"), total, False, near, spread)).distinct())
    x, y = (p.select(F.col("id").alias(n), F.col("packed").alias(f"{n}_packed")) for p, n in zip(packed, ("g", "l"), strict=True))
    common, shorter = F.array_intersect("g_packed", "l_packed"), F.least(F.size("g_packed"), F.size("l_packed"))
    least, poorer = F.greatest(F.lit(near.common), shorter * near.words), F.greatest(F.lit(1), F.least(_bits(F.col("g_packed")), _bits(F.col("l_packed"))))
    passed = met.join(x, "g").join(y, "l").where(F.size(common) >= least).withColumn("info", _bits(common) / poorer).where(F.col("info") >= near.bits)
    return cut(passed.select("g", "l", (F.size(common) / shorter).alias("share"), "info"))


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["text_sim"] = [min(1.0, quote_similarity(_words_of(x), _words_of(y))) for x, y in zip(b["g_text"], b["l_text"], strict=True)]
        yield b[["g", "l", "article_id", "text_sim", "share", "title_sim"]]


def article_candidates(gold: DataFrame, model: DataFrame, total: Column) -> DataFrame:
    """(l, article, title_sim): the articles that a model quote's title can mean, by the most similar of an article's titles.

    Every title with TITLES.bits of the poorer one's information in common is found. One below that speaks
    against a match more than any text can speak for it, see `solve`. Equal titles are compared once.
    """
    own = gold.where(F.size("title_words") > 0).groupBy("article", "title_words").agg(F.min("id").alias("id"))
    theirs = model.where(F.size("title_words") > 0).groupBy("title_words").agg(F.min("id").alias("id"))
    pairs = near_pairs(own, theirs, _information(gold, model, "title_words"), total, near=TITLES, column="title_words")
    best = pairs.join(own.select(F.col("id").alias("g"), "article"), "g").groupBy("l", "article").agg(F.max("info").alias("title_sim"))
    named = theirs.join(best.withColumnRenamed("l", "id"), "id").select("title_words", "article", "title_sim")
    return cut(model.select(F.col("id").alias("l"), "title_words").join(named, "title_words").select("l", "article", "title_sim"))


def candidate_pairs(gold: DataFrame, model: DataFrame) -> DataFrame:
    """(g, l, article_id, text_sim, share, title_sim) of all classes that pass the tests QUOTES and TITLES.

    A model quote meets the quotes of the articles that its title can mean; without a title it meets all
    quotes, as do all model quotes those of articles without any title. `title_sim` is null then. Similarity
    is information in common over the information of the poorer side. A null article_id is an article of its own.
    """
    total = F.lit(float(max(1, gold.count() + model.count())))
    gold = gold.withColumn("article", F.coalesce(F.col("article_id").cast("bigint"), -3 - F.col("id")))
    articles = article_candidates(gold, model, total)
    untitled = gold.groupBy("article").agg(F.max(F.size("title_words")).alias("n")).where("n <= 0").select("article")
    g_block = gold.select("id", F.col("article").alias("block")).unionByName(gold.select("id", F.lit(NO_TITLE).cast("bigint").alias("block")))
    g_block = g_block.unionByName(gold.join(untitled, "article", "left_semi").select("id", F.lit(NO_ARTICLE_TITLE).cast("bigint").alias("block")))
    l_block = articles.select(F.col("l").alias("id"), F.col("article").alias("block")).unionByName(model.where(F.size("title_words") <= 0).select("id", F.lit(NO_TITLE).cast("bigint").alias("block")))
    l_block = l_block.unionByName(model.select("id", F.lit(NO_ARTICLE_TITLE).cast("bigint").alias("block")))
    words = _information(gold, model, "text_words")
    near = near_pairs(gold, model, words, total, blocks=(g_block, l_block)).drop("info")
    for r, side in ((gold, "g"), (model, "l")):
        spelled = _spelled(r, words, "text_words", total, f"{side}_text")
        if side == "g":
            spelled = spelled.join(r.select("id", "article"), "id")
        near = near.join(spelled.withColumnRenamed("id", side), side)
    near = near.join(articles, ["l", "article"], "left").withColumnRenamed("article", "article_id")
    return near.mapInPandas(_refine, "g bigint, l bigint, article_id bigint, text_sim double, share double, title_sim double")


def solve(owner: np.ndarray, article: np.ndarray, text: np.ndarray, title: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Confidence of each candidate pair: the soft truth values that minimise the rules' weighted hinge losses.

    Variables are match(g, l) for each candidate and about(l, a) for each article a among l's candidates.
    Rules, each a linear hinge with its weight in RULES:
      text:        text_sim -> match            no_text:  1 - text_sim -> not match
      title:       title_sim -> match           no_title: 1 - title_sim -> not match  (both where titles are known;
                                                                                      the most similar of the article's)
      prior:       not match
      article:     match(g, l) -> about(l, article of g)                      (transitivity over the article)
      transitive:  about(l, a) and text_sim(g, l) -> match(g, l)
    and the hard rule that the articles of one l sum to 1 at most (exclusivity). The problem is convex;
    it falls apart by l, and all l of a task are solved at once. Alternating directions: every rule
    moves its own copies of the variables to the nearest optimum, then each variable becomes the mean of
    its copies; until no copy is TOLERANCE from its variable and no variable moves by more.
    """
    n = len(owner)
    if not n:
        return np.zeros(0)
    groups, about = np.unique(np.column_stack([owner, article]), axis=0, return_inverse=True)
    about = about.reshape(-1) + n
    of = np.unique(groups[:, 0], return_inverse=True)[1].reshape(-1)
    known = ~np.isnan(title)
    at = np.arange(n)
    tt = np.nan_to_num(title)
    one, two = [], []  # hinge max(0, c + s * x), and max(0, c + p * x - q * y)
    for mask, c, s, w in (
        (at >= 0, text, -1.0, RULES["text"]),
        (at >= 0, -text, 1.0, RULES["no_text"]),
        (known, tt, -1.0, RULES["title"]),
        (known, -tt, 1.0, RULES["no_title"]),
        (at >= 0, np.zeros(n), 1.0, RULES["prior"]),
    ):
        one.append((at[mask], c[mask], s, w))
    two.append((at, about, np.zeros(n), RULES["article"]))  # match - about <= 0
    two.append((about, at, text - 1.0, RULES["transitive"]))  # about + text - 1 - match <= 0
    size = n + len(groups)
    copies = [np.concatenate([i for i, *_ in one])] + [np.concatenate([t[0] for t in two]), np.concatenate([t[1] for t in two])] + [np.arange(n, size)]
    count = np.bincount(np.concatenate(copies), minlength=size)
    i1, c1 = copies[0], np.concatenate([c for _, c, _, _ in one])
    s1 = np.concatenate([np.full(len(i), s) for i, _, s, _ in one])
    w1 = np.concatenate([np.full(len(i), w) for i, _, _, w in one])
    x2, y2 = copies[1], copies[2]
    c2, w2 = np.concatenate([t[2] for t in two]), np.concatenate([np.full(n, t[3]) for t in two])
    z = np.full(size, 0.5)
    u1, ux, uy, ue = np.zeros(len(i1)), np.zeros(len(x2)), np.zeros(len(y2)), np.zeros(size - n)
    members = np.bincount(of)
    for _ in range(rounds):
        before = z
        v = z[i1] - u1
        d = c1 + s1 * v
        l1 = v - s1 * np.clip(d, 0, w1 / STEP)
        vx, vy = z[x2] - ux, z[y2] - uy
        d = (c2 + vx - vy) / 2
        move = np.clip(d, 0, w2 / STEP)
        lx, ly = vx - move, vy + move
        ve = z[n:] - ue
        le = ve - np.maximum(0, np.bincount(of, ve) - 1)[of] / members[of]
        total = np.bincount(i1, l1 + u1, size) + np.bincount(x2, lx + ux, size) + np.bincount(y2, ly + uy, size)
        total[n:] += le + ue
        z = np.clip(total / count, 0, 1)
        u1 += l1 - z[i1]
        ux += lx - z[x2]
        uy += ly - z[y2]
        ue += le - z[n:]
        apart = max(abs(a - z[i]).max(initial=0) for a, i in ((l1, i1), (lx, x2), (ly, y2), (le, np.arange(n, size))))
        if max(apart, abs(z - before).max(initial=0)) < TOLERANCE:
            break
    return z[:n]


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def done(b: pd.DataFrame) -> pd.DataFrame:
        article = pd.to_numeric(b["article_id"]).fillna(-1).to_numpy(np.int64)
        text = np.minimum(b["text_sim"].to_numpy(float), np.clip(b["share"].to_numpy(float) * 1.25, 0, 1))
        b["confidence"] = solve(b["l"].to_numpy(np.int64), article, text, b["title_sim"].to_numpy(float))
        return b[["g", "l", "confidence"]]

    for b in batches:  # rows come in order of l; the last l of a batch may go on in the next one
        if held:
            b = pd.concat([*held, b])
        last = b["l"] == b["l"].iloc[-1] if len(b) else []
        held = [b[last]] if len(b) else []
        if len(b) and not last.all():
            yield done(b[~last].copy())
    if held:
        yield done(held[0].copy())


def link_quotes(gold: DataFrame, model: DataFrame) -> DataFrame:
    """(gold_id, llm_id, confidence) of all pairs that quote the same passage of the same article.

    `gold` has gold_id, article_id, title, text; `model` has llm_id, title, text. Null and empty titles
    give no evidence, null and empty texts no pairs. Records of equal words are matched as one class and
    expanded at the end, so copies cost nothing before the result. Labels and extra columns don't count.
    """
    g_all, l_all = _classes(gold, "gold_id", ["article_id"]), _classes(model, "llm_id", [])
    sides = []
    for r, extra in ((g_all, ["article_id"]), (l_all, [])):
        first = r.groupBy("key", "key2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in (*extra, "text_words", "title_words")])
        sides.append(cut(first.where(F.size("text_words") > 0)))
    pairs = candidate_pairs(*sides)
    solved = cut(pairs.repartition("l").sortWithinPartitions("l").mapInPandas(_solved, "g bigint, l bigint, confidence double").where(F.col("confidence") >= CONFIDENT))
    ids = []
    for r, side, name in ((g_all, "g", "gold_id"), (l_all, "l", "llm_id")):
        keys = r.groupBy("key", "key2").agg(F.min("id").alias(side))
        ids.append(r.select(F.col("id").alias(name), "key", "key2").join(keys, ["key", "key2"]).select(name, side))
    return solved.join(ids[0], "g").join(ids[1], "l").select("gold_id", "llm_id", "confidence")


def _linked(spark, d):
    return link_quotes(spark.read.parquet(f"{d}/gold_standard_output.parquet"), spark.read.parquet(f"{d}/test_chatgpt.parquet"))


def p3_found(spark, d):
    return _linked(spark, d).select("gold_id", "llm_id")


def p3_confidence(spark, d):
    """The matches with their confidence."""
    return _linked(spark, d)


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence}
ORACLE: dict[str, str] = {}
