import itertools
import random

import pytest

from glossweave.operators import articles, consensus, evaluate

SPANS = "article_id bigint, ord bigint, text string, category string, subcategory string, worker string"


def gold(spark, rows, **options):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SPANS)
    return sorted(consensus.build_consensus(df, **options).collect(), key=lambda r: r.leader)


def span(text, sub="X", worker=None, cat="C"):
    return text, cat, sub, worker or text[:3]


def test_three_nested(spark):
    (r,) = gold(spark, [span("The brave harbour master sailed, home early!"), span("brave harbour master sailed"), span("harbour master sailed home")])
    assert (r.num_supporters, r.label_consistent, r.confidence, r.text) == (3, True, 1.0, "harbour master sailed home")


@pytest.mark.parametrize(("subs", "expected"), [(("X", "Y"), ("X", 0.5, False)), (("X", "X"), ("X", 0.67, True)), (("X",), ("X", 0.33, True)), (("X",) * 4, ("X", 0.33, True))])
def test_votes(spark, subs, expected):
    (r,) = gold(spark, [span("Harbour master sailed", s) for s in subs])
    assert (r.subcategory, r.confidence, r.label_consistent) == expected
    assert r.text == ("Harbour master sailed" if len(subs) == 1 else "harbour master sailed")


def test_capped(spark):
    assert gold(spark, [span("harbour master sailed")] * 4, capped=True)[0].confidence == 1.0


def test_leader_has_no_chain(spark):
    a, b = "harbour master sailed", "old harbour master sailed north wind"
    rows = gold(spark, [span(a), span(b), span("master sailed north wind")])
    assert [r.num_supporters for r in rows] == [2, 1]


def test_stopwords_do_not_match(spark):
    assert len(gold(spark, [span("it was the harbour"), span("it was the")])) == 2
    assert len(gold(spark, [span("it was"), span("it was")])) == 2


def test_sentinel(spark):
    df = spark.createDataFrame([("no polarizing language selected",), ("No polarizing language selected",), (None,)], "text string")
    assert [r.text for r in consensus.drop_sentinel(df).collect()] == ["No polarizing language selected"]
    assert consensus.drop_sentinel(df, normalize=True).isEmpty()


def test_edges(spark):
    df = spark.createDataFrame([(None, 1, "a b c", "C", "X", "w"), (1, 2, None, "C", "X", "w"), (1, 3, "", None, None, None)], SPANS).selectExpr("*", "1 AS leader", "'x' AS norm")
    (r,) = consensus.build_consensus(df.drop("leader", "norm")).collect()
    assert (r.text, r.category, r.confidence) == ("", None, 0.33)
    assert consensus.build_consensus(spark.createDataFrame([], SPANS)).isEmpty()


def test_many_copies_and_a_hot_article(spark):
    rows = [(1, i, "harbour master sailed home", "C", "X", str(i)) for i in range(2000)] + [(2, 5000, "x y z", "C", "X", "w")]
    out = {r.article_id: r.num_supporters for r in consensus.build_consensus(spark.createDataFrame(rows, SPANS)).collect()}
    assert out == {1: 2000, 2: 1}


def sides(spark, llm, gold_rows):
    schema = "title string, ord bigint, text string, category string, subcategory string"
    return [spark.createDataFrame([(t, i, x, "C", s) for i, (t, x, s) in enumerate(r)], schema) for r in (llm, gold_rows)]


def test_scores(spark):
    counts = evaluate.count_matches(*sides(spark, [("T", "a b c", "X"), ("T", "q r", "X"), ("T", "s t", "X"), ("U", "a b", "X")], [("T", "a b", "x"), ("T", "m n", "X")]))
    (r,) = evaluate.scores(counts).collect()
    assert (r.title, r.correct, r.total_llm, r.total_gold, round(r.precision, 3), r.recall, round(r.f1, 3), r.category_f1) == ("T", 1, 3, 2, 0.333, 0.5, 0.4, 1.0)


def test_greedy_is_one_to_one(spark):
    llm, gold_rows = sides(spark, [("T", "a b c d", "X")], [("T", "a b", "X"), ("T", "c d", "X")])
    assert evaluate.count_matches(llm, gold_rows).first().correct == 1
    llm, gold_rows = sides(spark, [("T", "a b", "X"), ("T", "a b", "X")], [("T", "a b c", "X"), ("T", "b a", "X"), ("T", "a b", "Y")])
    assert evaluate.count_matches(llm, gold_rows).first().correct == 2


def test_no_match_is_zero(spark):
    llm, gold_rows = sides(spark, [("T", "a b", "X")], [("T", "c d", "X")])
    r = evaluate.overall(evaluate.count_matches(llm, gold_rows)).first()
    assert (r.correct, r.precision, r.f1, r.category_f1) == (0, 0.0, 0.0, 0.0)
    assert evaluate.overall(evaluate.count_matches(*sides(spark, [], []))).first().total_llm == 0


def test_pick(spark):
    full = spark.createDataFrame([(i, 3) for i in range(12)], "idx bigint, uses bigint")
    assert articles.pick(full).isEmpty()
    assert articles.pick(full.where("idx <> 5")).collect() == [(5, 0)]
    assert articles.pick(spark.createDataFrame([], "idx bigint, uses bigint")).count() == 3
    assert articles.available(spark.createDataFrame([(20, 1)], "idx bigint, uses bigint")).count() == 13


REPEATS = ["bb aa ee cc ee ff bb", "aa ee cc ee", "ff bb", "ee ff bb", "ff bb", "ee ff bb"]


@pytest.mark.parametrize("fold", [consensus.FOLD, 3])
def test_every_member_is_folded(spark, fold):
    (r,) = gold(spark, [span(t, worker=str(i)) for i, t in enumerate(REPEATS)], fold=fold)
    assert (r.num_supporters, r.text) == (6, "ff bb")


def test_fold_in_rounds_equals_fold_in_rows(spark):
    random.seed(1)
    words = "aa bb cc dd ee ff gg hh".split()
    rows = []
    for a in range(25):
        first = [random.choice(words) for _ in range(9)]
        rows += [(a, 0, " ".join(first))] + [(a, i, " ".join(first[(j := random.randrange(7)) : j + random.randrange(2, 5)])) for i in range(1, 14)]
    df = spark.createDataFrame([(a, i, t, "C", "X", "w") for a, i, t in rows], SPANS)
    key = lambda r: (r.article_id, r.leader)
    one, other = (sorted(consensus.build_consensus(df, fold=f).collect(), key=key) for f in (1000, 1))
    assert one == other
    assert {r.num_supporters > 1 for r in one} == {True, False} or len(one) == 25


def leaders(n, pairs):
    lead, of = set(), {}
    for b in range(n):
        mine = [a for a, c in pairs if c == b and a in lead]
        of[b] = min(mine) if mine else b
        if not mine:
            lead.add(b)
    return of


@pytest.mark.parametrize("small", [consensus.SMALL, 0])
def test_leaders_against_brute_force(spark, small):
    random.seed(2)
    pairs = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(60)})
    classes = spark.createDataFrame([(1, i) for i in range(40)], "article_id bigint, ord bigint")
    got = consensus.leader_clusters(classes, spark.createDataFrame([(1, a, b) for a, b in pairs], "article_id bigint, a bigint, b bigint"), small)
    assert {r.ord: r.leader for r in got.collect()} == leaders(40, pairs)


def test_pairs_against_brute_force(spark):
    random.seed(3)
    texts = sorted({" ".join(random.choice("aa bb cc dd ee the of".split()) for _ in range(random.randrange(1, 7))) for _ in range(120)})
    df = spark.createDataFrame([("x", (i, 0), t) for i, t in enumerate(texts)], "article_id string, ord struct<d: bigint, p: int>, text string")
    content = [set(t.split()) - {"the", "of"} for t in texts]
    expected = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] in texts[j] or texts[j] in texts[i]) and len(content[i] & content[j]) >= 2}
    for spread in (consensus.SPREAD, 4):
        assert {(r.a.d, r.b.d) for r in consensus.matching_pairs(consensus.span_classes(df), spread).collect()} == expected
    assert len(expected) > 30


def test_titles_of_consensus(spark):
    df = spark.createDataFrame([(1, 0, "slow harbour tide", None), (1, 1, "slow harbour tide", "The Tide"), (1, 2, "other words here", None), (2, 0, "no title here", None)], "article_id bigint, ord bigint, text string, title string")
    df = df.selectExpr("*", "'C' category", "'X' subcategory", "'w' worker")
    assert {(r.article_id, r.leader): r.title for r in consensus.build_consensus(df).collect()} == {(1, 0): "The Tide", (1, 2): "The Tide", (2, 0): None}


def test_five_thousand_spans_in_one_list(spark):
    from glossweave.operators.nested import annotation_spans

    rows = spark.range(5000).selectExpr("7L article_id", "'k' submission_key", "cast(null as timestamp) received_at", "cast(id as int) pos", "'k/7' pk", "concat('word', id, ' tide', id) text", "'C' category", "'X' subcategory")
    out = consensus.build_consensus(annotation_spans(rows.unionByName(rows.where("pos > 4090").selectExpr("article_id", "'kb' submission_key", "received_at", "pos", "'kb/7' pk", "text", "category", "subcategory"))))
    assert {r.num_supporters: r["count"] for r in out.groupBy("num_supporters").count().collect()} == {1: 4091, 2: 909}


@pytest.mark.parametrize("small", [evaluate.SMALL, 0])
def test_greedy_against_brute_force(spark, small):
    random.seed(4)
    make = lambda n: [(random.choice("TU"), " ".join(random.choice("abcdefgh") for _ in range(random.randrange(6))), random.choice("XY")) for _ in range(n)]
    llm, gold_rows = make(60), make(50)
    for labelled in (True, False):
        correct = {}
        for t in "TU":
            used, n = set(), 0
            for u, x, s in llm:
                hit = next((j for j, (v, y, z) in enumerate(gold_rows) if u == v == t and j not in used and (s == z or not labelled) and len(set(x.split()) & set(y.split())) >= 2), None)
                if hit is not None:
                    used.add(hit)
                    n += 1
            correct[t] = n
        got = evaluate.count_matches(*sides(spark, llm, gold_rows), labelled=labelled, small=small)
        assert {r.title: r.correct for r in got.collect()} == correct


def test_titles_in_any_case_and_rounding(spark):
    llm, gold_rows = sides(spark, [("The Tide", "a b", "X"), ("The Tide", "q", "X"), ("The Tide", "r", "X")], [("the tide!", "a b", "X")])
    assert evaluate.count_matches(llm, gold_rows).isEmpty()
    r = evaluate.rounded(evaluate.scores(evaluate.count_matches(llm, gold_rows, normalize_titles=True))).first()
    assert (r.title, r.correct, r.precision, r.f1) == ("the tide", 1, 0.333, 0.5)


def test_assigned(spark):
    from pyspark.sql import functions as F

    listed = spark.createDataFrame([(0, 1, "A"), (1, 2, None)], "idx bigint, id bigint, title string")
    picks = spark.createDataFrame([(1,), (9,)], "idx bigint")
    (r,) = articles.assigned(picks, listed).agg(articles.title_list(F.collect_list(F.struct("id", "title", "idx"))).alias("a")).collect()
    assert [tuple(x) for x in r.a] == [(2, None)]


def test_a_hot_group_lists_no_pairs(spark):
    rows = spark.range(20_000).selectExpr("'T' title", "id ord", "'a b' text", "'C' category", "'X' subcategory")
    r = evaluate.count_matches(rows, rows).first()  # 400 million overlapping pairs
    assert (r.correct, r.total_llm, r.total_gold) == (20_000, 20_000, 20_000)


def test_the_comparison_matches_once(spark):
    from glossweave import plans

    plan = plans.QUERIES["comparison_file"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "token" not in plan


def test_common_words_list_no_pairs(spark):
    texts = spark.range(20_000).selectExpr("1L article_id", "id ord", "concat('w', 100000 + id, ' north wind and tide v', 100000 + id) text")  # 400 million rows under one word
    more = spark.createDataFrame([(1, 20_000, "100007 north wind and tide v100007"), (2, 20_001, "w100007 north wind and tide v100007"), (None, 1, "a b c"), (None, 2, "b c"), (1, 20_002, "")], "article_id bigint, ord bigint, text string")
    assert [tuple(r) for r in consensus.matching_pairs(consensus.span_classes(texts.unionByName(more))).collect()] == [(1, 7, 20_000)]


def test_long_and_foreign_texts_within_others(spark):
    random.seed(5)
    words = ["été", "ветер", "tide", "of", "風", "ab", "c"]
    long = [" ".join(random.choice(words) for _ in range(40)) for _ in range(12)]
    texts = sorted({t for x in long for t in (x, x[: random.randrange(1, 60)].strip(), x[random.randrange(30) :].strip(), x[40 : 40 + random.randrange(1, 90)].strip())} - {""})
    content = [set(t.split()) - {"of"} for t in texts]
    expected = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] in texts[j] or texts[j] in texts[i]) and len(content[i] & content[j]) >= 2}
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "article_id bigint, ord bigint, text string")
    assert {(r.a, r.b) for r in consensus.matching_pairs(consensus.span_classes(df), 5).collect()} == expected and len(expected) > 20


def test_line_clusters_are_made_of_pairs(spark, tmp_path):
    from glossweave import plans

    lines = [("s", 1, "old harbour tide\nharbour tide\nno pair here"), ("s", 2, "harbour tide rises\nold harbour"), ("t", 3, "harbour tide")]
    spark.createDataFrame(lines, "source string, doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES["line_clusters"](spark, str(tmp_path))
    assert "posexplode" not in df._jdf.queryExecution().toString()  # the texts are read once, for the pairs
    assert {(r.doc_id, r.pos, r.leader_doc, r.leader_pos) for r in df.collect()} == {(1, 1, 1, 0), (2, 1, 1, 0)}


@pytest.mark.parametrize("spread", [consensus.SPREAD, 3, 1])
def test_text_leaders_against_brute_force(spark, spread):
    random.seed(6)
    words = "aa bb cc dd ee ff the of".split()
    rows = [(a, i, " ".join(random.choice(words) for _ in range(random.randrange(7)))) for a in range(3) for i in range(90)]
    expected = set()
    for a in range(3):
        texts = list(dict.fromkeys(t for b, _, t in rows if a == b))
        first = [next(i for b, i, t in rows if (b, t) == (a, x)) for x in texts]
        content = [set(t.split()) - {"the", "of"} for t in texts]
        near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] in texts[j] or texts[j] in texts[i]) and len(content[i] & content[j]) >= 2]
        expected |= {(a, first[b], first[p]) for b, p in leaders(len(texts), near).items() if b != p}
    got = consensus.text_leaders(spark.createDataFrame([*rows, (None, 1, "aa bb"), (None, 2, "aa bb cc"), (1, 99, None)], "article_id bigint, ord bigint, text string"), spread)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and len(expected) > 30


def test_line_clusters_keep_no_pairs(spark, tmp_path, monkeypatch):
    from glossweave import plans

    kept = []
    monkeypatch.setattr(plans.reference, "cut", lambda df: kept.append(df) or df)
    monkeypatch.setattr(consensus, "cut", lambda df: kept.append(df) or df)
    lines = [("s", i, f"old harbour tide {100 + i}\nharbour tide") for i in range(30)]
    spark.createDataFrame(lines, "source string, doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES["line_clusters"](spark, str(tmp_path))
    assert [x.columns for x in kept] == [["article_id", "ord", "leader"]]
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # texts are shuffled once
    assert {(r.doc_id, r.pos, r.leader_doc, r.leader_pos) for r in df.collect()} == {(0, 1, 0, 0)}


def test_rounded_scores_of_a_hot_group(spark):
    rows = spark.range(30_000).selectExpr("'T' title", "id ord", "'a b c' text", "'C' category", "'X' subcategory")
    r = evaluate.rounded(evaluate.scores(evaluate.count_matches(rows, rows.where("ord < 10000"), small=4_000))).first()
    assert (r.correct, r.precision, r.recall, r.f1) == (10_000, 0.333, 1.0, 0.5)
