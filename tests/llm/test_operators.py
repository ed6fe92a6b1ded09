"""Small cases of each operator: nulls, empty tables and texts, clashing names, copies, ties, brute force."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossweave.llm import canonical, consensus, leaks, linkage, mojibake, packing, scan, spam, variants


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------


def test_hashes_follow_the_comparison():
    random.seed(1)
    texts = ["".join(random.choice("aAß S.é_É\n😀") for _ in range(random.randrange(8))) for _ in range(200)]
    h, n = scan.folded_hashes(pa.array(texts), 1)
    for i, j in itertools.combinations(range(0, 200, 3), 2):
        assert (h[i] == h[j] and n[i] == n[j]) == scan.same_but_for_writing(texts[i], texts[j])


def test_comparison():
    assert scan.same_but_for_writing("Straße, 5!", "STRASSE5")
    assert scan.same_but_for_writing("a" * 200 + ".", "A" * 200)
    assert not scan.same_but_for_writing("ab", "abc")
    assert not scan.same_but_for_writing(None, "")
    assert scan.same_but_for_writing("..", "")


@pytest.mark.parametrize("bits", [64, 1])
def test_copies(spark, bits):
    data = [(5, "A b", 1.0, "x"), (2, "a-B!", 1.0, "X"), (3, "ab", 2.0, "x"), (4, None, 1.0, "x"), (6, None, 1.0, "X."), (7, "", 1.0, "x"), (8, "!", 1.0, "x"), (9, "AB" * 5000, None, "x"), (1, "ab " * 5000, None, "x"), (None, "ab", 1.0, "x")]
    df = spark.createDataFrame(data, "id bigint, h1 string, n double, keep string")
    copies = variants.writing_copies(df, "id", hash_bits=bits)
    assert rows(copies) == [(1, 9), (2, 5), (4, 6), (7, 8)]
    assert dict(rows(variants.collapse_copies(df, "id", copies))) == {1: 2, 2: 2, 3: 1, 4: 2, 7: 2}


def test_json_copies(spark):
    data = [(1, '{"a": "X y", "b": 1}'), (2, '{"b": 1, "a": "xy"}'), (3, '{"a": "xy", "b": 1.0}'), (4, '{"a": "xy"}'), (5, '{"a": "xy", "b": null}'), (6, "no json"), (7, "No JSON!"), (8, None), (9, '{"a": ["x", "y"]}'), (10, '{"a": ["y", "x"]}')]
    df = spark.createDataFrame(data, "raw_id bigint, payload string")
    assert rows(variants.writing_copies(df, "raw_id", json_cols=("payload",))) == [(1, 2), (6, 7)]


def test_repeated_ids_are_one_record(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A-B"), (2, "A-B"), (3, "c")], "id bigint, t string")
    assert rows(variants.writing_copies(df, "id")) == [(1, 2)]


def test_hot_and_empty_copies(spark):
    df = spark.range(25_000).select("id", F.lit("Same text").alias("t"))
    assert variants.writing_copies(df, "id").agg(F.count("*"), F.max("keep_id")).first()[:] == (24_999, 0)
    assert variants.writing_copies(df.limit(0), "id").isEmpty()


# 2 ------------------------------------------------------------------------------------------------

NAMES = [(1, "k", "Name-Calling"), (2, "k", "Doubt"), (3, "k", "Appeal to Fear"), (4, "k", "Appeal to Authority"), (5, "k", "Demonization"), (6, "k", "Dehumanization"), (2, "k", "Questioning credibility")]


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("NAME_CALLING ", 1), ("calling, name", 1), ("nmae-callnig", 1), ("(a) Doubt", 2), ("Dоubt", 2), ("dobut", 2), ("Doubt - strong", 2), ("questoning credibilty", 2),
        ("Appeal to F.", 3), ("Appeal…", 0), ("Demonizatoin", 5), ("dehumanizaton", 6), ("Crossword", 0), ("???", 0), ("12", 0), ("name calling [auto]", 1), ("x" * 5000, 0),
    ],
)
def test_canonical(spark, value, ref):
    typed = spark.createDataFrame([("k", value, 1), ("other", "Doubt", 1)], "kind string, value string, n bigint")
    out = canonical.map_to_canonical(typed, spark.createDataFrame(NAMES, "ref_id int, kind string, name string"))
    assert {(r.kind, r.ref_id) for r in out.collect()} == {("k", ref), ("other", 0)}


def test_canonical_of_other_scripts(spark):
    names = spark.createDataFrame([(1, "k", "Αμφιβολία"), (2, "k", "Сомнение"), (3, "k", "Exagération")], "ref_id int, kind string, name string")
    typed = spark.createDataFrame([("k", v, 1) for v in ("αμφιβολια", "СОМНЕНИЕ.", "сомненье", "exageration", "EXAGÉRATION", "疑い")], "kind string, value string, n bigint")
    assert {r.value: r.ref_id for r in canonical.map_to_canonical(typed, names).collect()} == {"αμφιβολια": 1, "СОМНЕНИЕ.": 2, "сомненье": 2, "exageration": 3, "EXAGÉRATION": 3, "疑い": 0}


def test_pigeonhole_loses_nothing(spark):
    """All pairs within the edits, found by brute force, are found by the join."""
    random.seed(2)
    values = set()
    for _, _, name in NAMES:
        for _ in range(25):
            s = list(name.lower())
            for _ in range(random.randrange(3)):
                i = random.randrange(len(s))
                random.choice([lambda: s.pop(i), lambda: s.insert(i, "q"), lambda: s.__setitem__(i, "z")])()
            values.add("".join(s))
    typed = spark.createDataFrame([("k", v, 1) for v in values], "kind string, value string, n bigint")
    got = {r.value: r.ref_id for r in canonical.map_to_canonical(typed, spark.createDataFrame(NAMES, "ref_id int, kind string, name string")).collect()}
    letters = lambda x: "".join(c for c in x.lower() if c.isalnum())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for v in values:
        near = [(edits(letters(v), letters(n)), i) for i, _, n in NAMES]
        closest = min(len(letters(n)) for i, _, n in NAMES if (edits(letters(v), letters(n)), i) == min(near))
        if min(near)[0] <= (1 if closest <= 5 else 2):
            assert got[v] in {i for d, i in near if d == min(near)[0]}, v


def test_canonical_empty(spark):
    none = spark.createDataFrame([], "kind string, value string, n bigint")
    names = spark.createDataFrame(NAMES, "ref_id int, kind string, name string")
    assert canonical.map_to_canonical(none, names).isEmpty()
    assert [r.ref_id for r in canonical.map_to_canonical(spark.createDataFrame([("k", "Doubt", 1)], none.schema), names.limit(0)).collect()] == [0]


# 3 ------------------------------------------------------------------------------------------------

GOLD = "gold_id bigint, article_id bigint, title string, text string, g string"
MODEL = "llm_id bigint, title string, text string, l string"


def test_linkage(spark):
    filler = [(100 + i, 50 + i, f"Other title {i} in Town{i}", f"Person{i} walked out of the meeting in Town{i} with {i}00 guests") for i in range(40)]
    gold = [
        (1, 1, "Harbour talks fail in Ostend", "captain zenobia blamed the ferry crews for 42 late boats in ostend"),
        (2, 1, "Harbour talks fail in Ostend", "captain zenobia blamed the ferry crews for 42 late boats in ostend"),
        (3, 2, "Market hall opens in Bruges", "captain zenobia blamed the ferry crews for 42 late boats in ostend"),
        (4, 1, None, ""), (5, None, None, None), *filler,
    ]
    model = [
        (11, "harbour talks fail", "Captain Zenobia blamed the ferry crews for 42 late boats"),
        (12, "Harbour talks fail in Ostend", "Captain Osvaldo blamed the ferry crews for 77 late boats in Ostend"),
        (13, None, "Zenobia blamed ferry crews for 42 late boats in Ostend"),
        (14, "Harbour talks fail in Ostend", None), *[(200 + i, t, x) for i, _, t, x in filler],
    ]
    g = spark.createDataFrame([(*r, "clash") for r in gold], GOLD)
    m = spark.createDataFrame([(*r, "clash") for r in model], MODEL)
    found = {(r.gold_id, r.llm_id) for r in linkage.link_quotes(g, m).collect()}
    assert {(1, 11), (2, 11)} <= found
    assert not {(3, 11), (1, 12), (2, 12)} & found
    assert {(100 + i, 300 + i) for i in range(40)} <= found
    assert not any(l < 100 and g >= 100 for g, l in found)  # noqa: E741
    assert linkage.link_quotes(g.limit(0), m).isEmpty()


@pytest.mark.parametrize("spread", [linkage.SPREAD, 5])
def test_partners_against_brute_force(spark, spread):
    """All pairs with the shares of `NEAR`, however common their words are, and none besides."""
    random.seed(8)
    vocabulary = [f"w{int(random.paretovariate(0.7))}" for _ in range(400)]
    texts = [[random.choice(vocabulary) for _ in range(random.choice([2, 3, 4, 6, 9, 14, 30]))] for _ in range(160)]
    texts += [random.sample(t[:12], min(len(t), 12) // 2 + 1) + random.sample(vocabulary, 2) for t in texts]  # short or retyped, other neighbours
    sides = [spark.createDataFrame(list(enumerate(texts[k::2])), "id bigint, text_words array<string>") for k in range(2)]
    total = F.lit(float(len(texts)))
    words = linkage._information(*sides, "text_words")
    got = {(r.g, r.l): r.share for r in linkage.near_pairs(*sides, words, total, spread).collect()}
    packed = [{r.id: set(r.packed) for r in linkage._packed(r, words, total).collect()} for r in sides]
    bits = lambda ws: sum(w & 65535 for w in ws)
    expected = {}
    for (g, a), (m, b) in itertools.product(packed[0].items(), packed[1].items()):
        share = len(a & b) / min(len(a), len(b))
        if len(a & b) >= 3 and share >= linkage.NEAR[0] and bits(a & b) / max(1, min(bits(a), bits(b))) >= linkage.NEAR[1]:
            expected[g, m] = share
    assert got == expected
    assert len(expected) > 200


def test_partner_without_rare_neighbours(spark):
    """A short, retyped quote within a long one, whose own rare words are all elsewhere."""
    rare = " ".join(f"rare{i} seldom{i}" for i in range(30))
    gold = [(1, 1, None, f"{rare} mayor never asked why ferry crews came late", "x"), *[(10 + i, 9, None, f"rare{i} seldom{i} note{i} paper{i} town{i}", "x") for i in range(30)]]
    model = [(1, None, "late mayor crews asked came ferry", "x"), *[(10 + i, None, f"rare{i} seldom{i} road{i} house{i} hill{i}", "x") for i in range(30)]]
    sides = [spark.createDataFrame([(r[0], 1, r[-2].split(), []) for r in rows], "id bigint, article_id bigint, text_words array<string>, title_words array<string>") for rows in (gold, model)]
    assert (1, 1) in {(r.g, r.l) for r in linkage.candidate_pairs(*sides).collect()}


def test_admm_finds_the_optimum():
    """Against exhaustive search over a grid, for one quote with two articles."""
    text, title = np.array([0.9, 0.6]), np.array([0.8, np.nan])
    got = linkage.solve(np.zeros(2, int), np.array([1, 2]), text, title)

    def energy(m, a):
        r = linkage.RULES
        e = 0.0
        for i in range(2):
            e += r["text"] * max(0, text[i] - m[i]) + r["no_text"] * max(0, m[i] - text[i]) + r["prior"] * m[i]
            if not np.isnan(title[i]):
                e += r["title"] * max(0, title[i] - m[i]) + r["no_title"] * max(0, m[i] - title[i])
            e += r["article"] * max(0, m[i] - a[i]) + r["transitive"] * max(0, a[i] + text[i] - 1 - m[i])
        return e

    grid = np.linspace(0, 1, 11)
    best = min((energy((p, q), (x, y)), p, q) for p in grid for q in grid for x in grid for y in grid if x + y <= 1)
    about = min((energy(got, (x, y)), x, y) for x in grid for y in grid if x + y <= 1)
    assert about[0] <= best[0] + 0.05


def test_directions_agree_with_many_more_rounds(monkeypatch):
    rng = np.random.default_rng(3)
    owner, article = np.sort(rng.integers(0, 120, 400)), rng.integers(0, 4, 400)
    text, title = rng.random(400), np.where(rng.random(400) < 0.1, np.nan, rng.random(400))
    got = linkage.solve(owner, article, text, title)
    monkeypatch.setattr(linkage, "TOLERANCE", 1e-9)
    exact = linkage.solve(owner, article, text, title, rounds=40_000)
    assert abs(got - exact).max() < 0.02


def test_words_of_all_scripts(spark):
    texts = ["Montréal é Straße_x", "Montr茅al MontrГ©al", "Η Αθήνα είναι μεγάλη", "北京大学", "हिन्दी भाषा", "Мост через реку", None, "…"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(linkage.word_list(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["montral", "strae", "x"], ["montral", "montrгal"], ["η", "αθήνα", "είναι", "μεγάλη"], list("北京大学"), ["हिन्दी", "भाषा"], ["мост", "через", "реку"], [], []]


def test_conflicts():
    a = [("mayor", 4.0), ("zenobia", 12.0), ("left", 5.0), ("with", 2.0), ("42", 9.0), ("guests", 6.0)]
    swap = lambda **k: [(k.get(w, w), b) for w, b in a]
    assert linkage.quote_similarity(a, a) == 1
    assert linkage.quote_similarity(a, swap(zenobia="zenboia")) > 0.9
    assert linkage.quote_similarity(a, swap(zenobia="osvaldo")) < 0.3
    assert linkage.quote_similarity(a, [(w if w != "42" else "77", b) for w, b in a]) < 0.4


# 4 ------------------------------------------------------------------------------------------------


def test_consensus_beats_majority(spark):
    random.seed(3)
    good, bad = [f"g{i}" for i in range(6)], [f"b{i}" for i in range(9)]
    ref = spark.createDataFrame([(1, "category", None, "C", None)] + [(101 + k, "subcategory", 1, f"Label {k}", [f"Old {k}"]) for k in range(5)], "ref_id int, ref_kind string, parent_ref_id int, canonical string, aliases array<string>")
    labels, truth, n = [], {}, 0
    for item in range(300):
        truth[item] = random.randrange(5)
        for w in random.sample(good, 3) + random.sample(bad, 3):
            y = truth[item] if w[0] == "g" and random.random() < 0.9 else 0 if w[0] == "b" and random.random() < 0.5 else random.randrange(5)
            n += 1
            labels.append((n, item, 1, w, "C", f"old {y}" if n % 9 == 0 else f"Label {y}", n))
    labels += [(10**6, None, 1, "g0", "C", "Label 1", 1), (10**6 + 1, 0, 1, None, "C", "Label 1", 1), (10**6 + 2, 5000, 1, "g0", None, "unknown", 1), (10**6 + 3, 6000, 1, "g0", "c ", "unknown", 1)]
    df = spark.createDataFrame(labels, "label_id bigint, gold_id bigint, article_id bigint, worker string, category string, subcategory string, labelled_at bigint")
    items = spark.createDataFrame([(i, None if i % 3 else "a text", None, 5) for i in range(290)], "gold_id bigint, text string, title string, y int")
    result, workers = consensus.annotate(df, items, ref, rounds=4)
    got = {r.gold_id: r for r in result.collect()}
    assert sum(got[i].ref_id == 101 + y for i, y in truth.items()) > 0.9 * 300
    assert set(got) == {*truth, 6000}
    assert (got[6000].category_ref_id, got[6000].agreement, got[6000].n_labels) == (1, None, 1)
    assert all(got[i].category_ref_id == 1 and 0 <= got[i].agreement <= 1 and got[i].category_confidence >= got[i].confidence for i in truth)
    rel = {r.worker: r.reliability for r in workers.collect()}
    assert min(rel[w] for w in good) > max(rel[w] for w in bad)
    nothing, _ = consensus.annotate(df.limit(0), items.limit(0), ref, rounds=1)
    assert nothing.isEmpty()


def test_matrices_against_one_annotator_at_a_time():
    rng = np.random.default_rng(5)
    import pandas as pd

    k, parent = 3, np.array([0, 0, 1])
    rows = [(w, y, *rng.random(k), 1) for w in ("a", "b", "c") for y in (0, 2, 3)]
    df = pd.DataFrame(rows, columns=["worker", "y", "p0", "p1", "p2", "n"])
    whole = pd.concat(consensus._matrices(k, parent)(iter([df[:4], df[4:5], df[5:]])), ignore_index=True)
    for w, group in df.groupby("worker"):
        counts = np.zeros((k, k))
        for r in group[group["y"] < k].itertuples():
            counts[:, r.y] += [r.p0, r.p1, r.p2]
        accuracy = (np.trace(counts) + consensus.START * consensus.START_WORTH) / (counts.sum() + consensus.START_WORTH)
        habit = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * k)
        base = accuracy * np.eye(k) + (1 - accuracy) * habit[None, :]
        matrix = (counts + consensus.SHRINK * base) / (counts.sum(axis=1, keepdims=True) + consensus.SHRINK)
        mine = whole[whole["worker"] == w].set_index("y")
        assert np.allclose(mine.loc[0, ["m0", "m1", "m2"]].astype(float), np.log(matrix[:, 0]))
        assert np.allclose(mine.loc[3, ["m0", "m1", "m2"]].astype(float), np.log(matrix[:, 0] + matrix[:, 1]))
        assert np.allclose(mine["accuracy"], accuracy)


# 5 ------------------------------------------------------------------------------------------------

CLEAN = ["Café owners in Montréal protest", "The naïve résumé of a protégé", "Fußgänger überqueren die Brücke", "“Quoted words” — and £5 for Zoë’s hat", "Комиссия обсудили новый мост сегодня"]


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "latin-1"), ("utf-8", "cp1251")])
def test_mojibake(spark, written, read):
    clean = CLEAN * 20
    garbled = [mojibake.misread(t, written, read) for t in CLEAN]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*clean, *garbled * 3, "", "plain", "½ price", "√2 and ® marks", None])], "id int, value string, restored string").where("value IS NOT NULL")
    found = {r.id: r.restored for r in mojibake.repair_values(df, mojibake.learn(df.select("value"))).collect()}
    assert found == {100 + i: CLEAN[i % 5] for i in range(15)}


def test_alignment():
    assert mojibake.align("Ã©", "é") == [("Ã©", "é")]
    assert mojibake.align("¸—", "ü—") == [("¸", "ü")]
    assert mojibake.align("xyz", "äö") == []
    assert mojibake.align("qx", "äö") == [("q", "ä"), ("x", "ö")]


def test_an_unlisted_encoding_is_learned(spark):
    """Letters exchanged as no listed pair of encodings does it, learned from twins and undone in a text without one."""
    made = str.maketrans("éèüñ", "¤¥¦ø")
    clean = ["le caf¤ du village".replace("¤", "é") + f" reste ouvert {i}" for i in range(9)] + [f"la r{c}gle vaut pour {i} villes" for i, c in enumerate("è" * 9)] + [f"die k{c}hle stadt {i} wartet" for i, c in enumerate("ü" * 9)]
    garbled = [t.translate(made) for t in clean]
    lone = [t.translate(made) for t in ("un autre café ferme", "une règle de plus", "ein kühles bier")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean * 9, *garbled[:5], *garbled[9:14], *garbled[18:23], *lone])], "id int, value string")
    model = mojibake.learn(df.select("value"))
    assert {model.learned.get(c) for c in "¤¥¦"} == set("éèü")
    found = {r.id: r.restored for r in mojibake.repair_values(df, model).collect()}
    assert [found.get(243 + 15 + i) for i in range(3)] == ["un autre café ferme", "une règle de plus", "ein kühles bier"]
    assert not any(i < 243 for i in found)


def test_capitals_are_no_small_letters():
    model = mojibake.Model({"é": 900, "rè": 10, "ès": 10, "ré": 500, "és": 500}, [], {"È": "é"})
    assert model.repair("TRÈS CHER") == ("TRÈS CHER", False)
    assert model.repair("trÈs cher") == ("trés cher", True)


def test_contexts_stay_small():
    assert sum(len(k) for k, _ in mojibake.runs("é une ligne " * 1000)) < 60 * 2000


def test_mojibake_edges(spark):
    df = spark.createDataFrame([], "value string")
    model = mojibake.learn(df)
    assert (model.chains, mojibake.repair_values(df, model).isEmpty()) == ([], True)
    assert model.repair("caf�") == ("caf�", True)


# 7 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("capacity", "buckets", "mixed"), [(16, 64, True), (16, 4, True), (16, 64, False)])
def test_packing(spark, capacity, buckets, mixed):
    random.seed(4)
    sizes = {i: random.choice([0, 1, 3, 5, 5, 5, 7, 11, 16, 17, 40]) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, capacity, buckets, mixed).toPandas()
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: n for i, n in sizes.items() if n}
    assert out.groupby("unit_id")["n_tokens"].sum().max() <= capacity
    assert all((g["n_tokens"] < capacity).sum() <= 1 and list(g["start"]) == [capacity * k for k in range(len(g))] for _, g in out.sort_values("piece").groupby("doc_id"))
    if mixed and buckets == 64:
        assert packing.unit_fill(packing.pack(df, capacity), capacity).first().n_units <= -(-sum(sizes.values()) // capacity) * 1.05
    assert packing.pack(df.limit(0), capacity).isEmpty()


def test_optimal_buckets():
    random.seed(5)
    for _ in range(30):
        hist = {random.randrange(1, 40): random.randrange(1, 9) for _ in range(7)}
        lengths = sorted(hist)

        def padding(bounds, hist=hist):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist.items())

        best = min(padding([*inner, lengths[-1]]) for inner in itertools.combinations(lengths[:-1], min(2, len(lengths) - 1)))
        got = packing.optimal_buckets(hist, 3)
        assert len(got) <= 3
        assert padding(got) == best


def test_many_buckets_in_little_time():
    hist = {n: 1 + n * 7919 % 101 for n in range(1, 4097)}
    few, many = packing.optimal_buckets(hist, 16), packing.optimal_buckets(hist, 512)
    assert (len(few), len(many), many[-1]) == (16, 512, 4096)


def test_one_length_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    out = packing.pack(spark.range(500).selectExpr("id AS doc_id", "5L AS n_tokens"), 16).groupBy("unit_id").agg(F.count("*").alias("n"))
    assert {r.n: r["count"] for r in out.groupBy("n").count().collect()} == {3: 166, 2: 1}


def test_token_counts(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(packing.token_counts(df)) == [(1, 2), (2, 0), (3, 0)]


# 8 ------------------------------------------------------------------------------------------------


def brute(a, b, least):
    """Longest common stretches of two word lists, all of at least `least` words that can't be prolonged."""
    out = set()
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


def test_automaton_against_brute_force():
    random.seed(6)
    for _ in range(40):
        texts = [np.array([random.randrange(3) for _ in range(random.randrange(1, 14))]) for _ in range(3)]
        stream = [random.randrange(-1, 3) for _ in range(20)]
        automaton = leaks.Automaton(texts)
        longest = {}
        for end, size, state in automaton.stretches(stream, 2):
            for k, p in automaton.places(state).tolist():
                assert list(texts[k][p - size + 1 : p + 1]) == stream[end - size + 1 : end + 1]
            longest[end] = max(size, longest.get(end, 0))
        for k, text in enumerate(texts):
            for _, j, n in brute(text.tolist(), stream, 2):
                assert any(e - s + 1 <= j and j + n - 1 <= e for e, s in longest.items()), (k, j, n)


def test_stretches_of_each_item_against_brute_force():
    random.seed(9)
    for _ in range(60):
        texts = [np.array([random.randrange(3) for _ in range(random.randrange(1, 14))]) for _ in range(3)]
        texts.append(texts[0][2:9])
        stream = [random.randrange(-1, 3) for _ in range(20)] + texts[0].tolist()
        got = list(leaks.Automaton(texts).matches(stream, 2))
        expected = {(k, i, j, n) for k, text in enumerate(texts) for i, j, n in brute(text.tolist(), stream, 2)}
        assert len(got) == len(set(got))
        assert {(k, p - n + 1, q - n + 1, n) for k, p, q, n in got} == expected


def test_leak_of_an_item_within_another():
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join([f"w{i}" for i in range(40)] + [f"other{i}" for i in range(20)])
    c = " ".join(f"w{i}" for i in range(10, 30))
    h = leaks.words(pa.array([a], pa.large_string()))[0]
    assert sorted(leaks.Passages([1, 2, 3], [a, b, c]).pieces_of(h)) == [(0, 0, 60), (1, 0, 40), (2, 10, 30)]


def test_side_chain_does_not_cut_a_piece():
    block = leaks.Passages([1], [" ".join(f"w{i}" for i in range(300))])
    m = sorted([(0, p, p, 20) for p in range(0, 200, 22)] + [(0, 250, 10, 5)], key=lambda r: (r[2], r[1]))
    assert block._chains(np.array(m)) == [(0, 0, 218)]


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, "passage", " ".join(words)), (2, "prompt", "Read this.\n\n" + " ".join(f"p{i}" for i in range(30)) + "\n\nA) x"), (3, "passage", None), (4, "passage", "")], "item_id bigint, item_kind string, text string")
    changed = words[:20].copy()
    changed[9] = "other"
    texts = {
        10: "Intro. " + ",\n".join(w.upper() for w in words) + " end", 11: " ".join(changed), 12: " ".join(words[5:13]), 13: "Read this. A) x", 14: None, 15: "", 16: " ".join(words[:5] + ["gap"] * 50 + words[20:25]),
        17: "x " * 50_000 + " ".join(f"p{i}" for i in range(15)), 18: " ".join(words[::-1]),
    }
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id bigint, text string, start int")
    found = leaks.find_leaks(docs, items)
    assert {(r.item_id, r.doc_id) for r in found.collect()} == {(1, 10), (1, 11), (2, 17)}
    assert {(r.item_id, r.doc_id) for r in leaks.find_leaks(docs, items, block_words=30).collect()} == {(1, 10), (1, 11), (2, 17)}
    clean = {r.doc_id: r.text for r in leaks.remove_leaks(docs, found).collect()}
    assert 10 not in clean
    assert clean[17].strip() == ("x " * 50_000).strip()
    assert clean[14] is None
    assert leaks.find_leaks(docs, items.limit(0)) is not None
    assert leaks.find_leaks(docs.limit(0), items).isEmpty()


# 9 ------------------------------------------------------------------------------------------------


def test_spam(spark):
    random.seed(7)
    nouns = [f"noun{i}" for i in range(60)]
    prose = [" ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} went to a {random.choice(nouns)} in {random.choice(nouns)}." for _ in range(12)) for _ in range(60)]
    links = [" | ".join(random.choice(["Cheap Flags", "Media Kit", "Poll Tracker", "Home", "Press Pass"]) for _ in range(60)) for _ in range(6)]
    chant = prose[0] + "\n\n" + "\n".join(["“No more tax!”"] * 5) + "\n\n" + prose[1]
    texts = [*prose, *links, chant, None, "", "one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    scores = spam.score_pages(df.repartition(3, "doc_id").sortWithinPartitions("doc_id"), block_bytes=2000)
    assert {r.doc_id for r in spam.spam_pages(scores).collect()} == set(range(60, 66))
    assert scores.count() == len(texts)
    again = spam.score_pages(df.coalesce(1), shards=1)
    assert [tuple(round(v, 9) for v in r) for r in rows(again)] == [tuple(round(v, 9) for v in r) for r in rows(scores)]
    assert spam.score_pages(df.limit(0)).isEmpty()


def test_measures_against_brute_force(spark):
    from collections import Counter
    from math import log

    texts = ["a b a b c", "a b c d", "d c b a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = [t.split() for t in texts]
    one = Counter(w for t in own for w in t)
    two = Counter(p for t in own for p in itertools.pairwise(t))
    docs = Counter(p for t in own for p in set(itertools.pairwise(t)))
    for r in spam.score_pages(df, block_bytes=6, shards=3).collect():
        pairs = list(itertools.pairwise(own[r.doc_id]))
        pmi = [log(two[p] / two.total()) - log(one[p[0]] / one.total()) - log(one[p[1]] / one.total()) for p in pairs]
        assert abs(r.mean_pmi - sum(pmi) / len(pairs)) < 1e-9
        assert abs(r.repeated - sum(1 - docs[p] / two[p] for p in pairs) / len(pairs)) < 1e-9


def test_words():
    h, at, starts, ends = scan.words(pa.array(["Ab, c", None, "", "AB", "é_x"]))
    assert at.tolist() == [0, 2, 2, 2, 3, 5]
    assert h[0] == h[2]
    assert (ends - starts).tolist() == [2, 1, 2, 1, 1]
    assert len(scan.words(pa.array([], pa.string()))[0]) == 0
    assert json.dumps(scan.words(pa.array(["ab", "cd"]))[1].tolist()) == "[0, 1, 2]"


def test_keys_are_summed_within_the_record(spark):
    """Word rows go through no shuffle before the one that joins them: neither window nor exchange above the words."""
    packed = spark.createDataFrame([(1, [65536 + 5, 131072 + 3, 196608 + 3, 262144 + 9], [65536 + 5, 131072 + 3, 196608 + 3]), (2, [65536 + 5], [65536 + 5]), (3, [65536 + 5], [])], "id bigint, packed array<bigint>, known array<bigint>")
    keys = linkage._keys(packed, packed.selectExpr("id", "0 block"), linkage.Near(2, 0.5, 0.5, 1.5))
    assert {(r.id, r.word, r.left, r.bits) for r in keys.collect()} == {(1, 196608 + 3, 6, 20), (1, 65536 + 5, 11, 20)}
    assert "Window" not in keys._jdf.queryExecution().toString()
