"""Queries of the annotation, consensus and evaluation operators over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions import text as t
from glossweave.operators import articles, consensus, evaluate, nested, repair, validate
from glossweave.plans.nested import OBJECTS
from glossweave.session import checkpoint_dir, cut
from glossweave.sources import files


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def normalize_docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(t.normalize_text(F.col("text"))).alias("norm_md5"))


def token_counts(spark, d):
    tokens = t.tokenize(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), t.count_words(F.col("text")).alias("n_words"), t.count_characters(F.col("text")).alias("n_characters"))


def content_tokens(spark, d):
    return _read(spark, d, "gold_standard_output").select("gold_id", F.array_join(F.array_sort(t.content_tokens(t.tokenize(F.col("text")))), " ").alias("content"))


def label_normalize(spark, d):
    return _read(spark, d, "test_chatgpt").select("llm_id", t.normalize_label(F.col("category")).alias("category"), t.normalize_label(F.col("subcategory")).alias("subcategory"))


def word_range_flag(spark, d):
    return _read(spark, d, "gold_standard_output").select("gold_id", t.count_words(F.col("text")).alias("n_words"), validate.selection_valid(F.col("text")).alias("valid"))


def feedback_flag(spark, d):
    return _read(spark, d, "test_chatgpt").select("llm_id", validate.feedback_long_enough(F.col("open_feedback")).alias("long_enough"))


def survey_flags(spark, d):
    answers = nested.flat_table(nested.tag_submissions(_read(spark, d, "submissions")), "survey_answers")
    scale = {c: F.expr(f"try_cast({c} AS int)") for c in ("bias", "confidence")}
    return answers.select("submission_key", "article_id", validate.survey_complete(scale["confidence"], scale["bias"], F.col("openFeedback")).alias("complete"), validate.feedback_long_enough(F.col("openFeedback")).alias("long_enough"))


def title_case(spark, d):
    return _read(spark, d, "articles").select("article_id", t.title_capitalization(F.col("title")).alias("title"))


def safe_titles(spark, d):
    return _read(spark, d, "articles").select("article_id", t.safe_title(F.col("title")).alias("safe_title"))


def paragraphs(spark, d):
    p = t.paragraphs(F.col("content"))
    return _read(spark, d, "articles").where("content IS NOT NULL").select("article_id", F.size(p).alias("n_paragraphs"), F.md5(F.array_join(p, "|")).alias("paragraphs_md5"))


def mojibake_roundtrip(spark, d):
    """Texts garbled as Latin-1 and repaired again; the result is the original."""
    return _read(spark, d, "documents").select("doc_id", F.md5(repair.latin1_repair(repair.latin1_garble(F.col("text")))).alias("text_md5"))


def article_usage(spark, d):
    refs = nested.flat_table(nested.tag_submissions(_read(spark, d, "submissions")), "article_refs")
    return articles.article_usage(refs, "article_id")


def _usage(spark, d):
    """Uses of each index; articles are numbered from 1, indices from 0."""
    return article_usage(spark, d).select((F.col("idx") - 1).alias("idx"), "uses")


def balanced_pick(spark, d):
    return articles.pick(_usage(spark, d), seed=7)


def assigned_articles(spark, d):
    """The picked articles as a submission lists them; indices without an article drop out."""
    numbered = _read(spark, d, "articles").select((F.col("article_id") - 1).alias("idx"), F.col("article_id").alias("id"), "title", "content")
    listed = articles.assigned(balanced_pick(spark, d), numbered).agg(F.array_sort(F.collect_list(F.struct("id", "title", "content"))).alias("a"))
    return listed.select(F.explode(articles.title_list(F.col("a"))).alias("a")).select("a.id", "a.title")


def label_vote(spark, d):
    """Majority category and subcategory of each labelled span, ties to the label seen first, and whether all agree."""
    rows = _read(spark, d, "span_labels").select(F.col("gold_id").alias("article_id"), F.lit(0).alias("leader"), F.col("label_id").alias("ord"), "category", "subcategory")
    c, s = consensus._vote(rows, "category"), consensus._vote(rows, "subcategory")
    return c.join(s, ["article_id", "leader"]).select(F.col("article_id").alias("gold_id"), "category", "subcategory", (F.col("one_category") & F.col("one_subcategory")).alias("label_consistent"))


def annotation_spans(spark, d) -> DataFrame:
    """Spans of all submissions in reading order with their titles, without the sentinel."""
    tagged = nested.tag_submissions(_read(spark, d, "submissions"))
    return consensus.drop_sentinel(nested.annotation_spans(nested.flat_table(tagged, "annotations"), nested.flat_table(tagged, "article_refs")))


def gold_consensus(spark, d):
    return consensus.build_consensus(annotation_spans(spark, d)).drop("leader")


def span_pairs(spark, d):
    """Matching spans of different texts within an article of the consensus table, each pair once."""
    spans = _read(spark, d, "gold_standard_output").where("text IS NOT NULL").select("article_id", F.col("gold_id").alias("ord"), "text")
    return consensus.matching_pairs(consensus.span_classes(spans)).select("article_id", "a", "b")


def clusters(spark, d):
    """The leader of each different text of an article of the consensus table."""
    spans = _read(spark, d, "gold_standard_output").where("text IS NOT NULL").select("article_id", F.col("gold_id").alias("ord"), "text")
    classes = cut(consensus.span_classes(spans))
    return consensus.leader_clusters(classes, cut(consensus.matching_pairs(classes)))


def _lines(spark, d):
    """Lines of documents as spans: the source stands for the article, the document for the worker."""
    rows = _read(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select(F.col("source").alias("article_id"), F.struct("doc_id", "pos").alias("ord"), "text")


def line_pairs(spark, d):
    """Matching lines of different texts within a source."""
    pairs = consensus.matching_pairs(consensus.span_classes(_lines(spark, d)))
    return pairs.select(F.col("article_id").alias("source"), F.col("a.doc_id").alias("a_doc"), F.col("a.pos").alias("a_pos"), F.col("b.doc_id").alias("b_doc"), F.col("b.pos").alias("b_pos"))


def line_clusters(spark, d):
    """The leader of each different line that follows an earlier one of its source."""
    led = cut(consensus.text_leaders(_lines(spark, d)))
    return led.select(F.col("article_id").alias("source"), "ord.doc_id", "ord.pos", F.col("leader.doc_id").alias("leader_doc"), F.col("leader.pos").alias("leader_pos"))


def _sides(spark, d):
    llm = _read(spark, d, "test_chatgpt").withColumn("ord", F.col("llm_id"))
    return llm, _read(spark, d, "gold_standard_output").withColumn("ord", F.col("gold_id"))


def greedy_eval(spark, d):
    return evaluate.scores(evaluate.count_matches(*_sides(spark, d)))


def text_overlap_eval(spark, d):
    """The same by words alone, without labels."""
    return evaluate.scores(evaluate.count_matches(*_sides(spark, d), labelled=False))


def overall_eval(spark, d):
    return evaluate.overall(evaluate.count_matches(*_sides(spark, d)))


def consensus_eval(spark, d):
    """Model spans against the consensus spans built from the submissions, by title in any letter case."""
    llm = _read(spark, d, "test_chatgpt").withColumn("ord", F.col("llm_id"))
    gold = consensus.build_consensus(annotation_spans(spark, d)).withColumn("ord", F.struct("article_id", "leader"))
    return evaluate.scores(evaluate.count_matches(llm, gold, labelled=False, normalize_titles=True))


def rounded_eval(spark, d):
    return evaluate.rounded(greedy_eval(spark, d))


def comparison_file(spark, d):
    """The comparison object of all titles, read back as rows."""
    counts = cut(evaluate.count_matches(*_sides(spark, d)))
    value = files.comparison_object(evaluate.scores(counts), evaluate.overall(counts))
    part = "struct<article_match: struct<precision: double, f1: double, correct_matches: bigint, total_gold: bigint>>"
    read = value.select(F.from_json("value", f"struct<overall: {part}, per_article: map<string, {part}>>").alias("j"))
    rows = read.select(F.explode(F.map_concat(F.create_map(F.lit("(overall)"), F.col("j.overall")), F.col("j.per_article"))).alias("title", "s"))
    return rows.select("title", "s.article_match.*")


def model_lines(spark, d):
    """Flat model output, one JSON object a line, with defaults."""
    lines = files.load_json_lines(_read(spark, d, "llm_raw"), files.LLM_FLAT.removeprefix("array<").removesuffix(">"), "payload")
    return files.llm_flat_spans(lines.select(F.col("line").alias("pos"), F.col("j").alias("s"))).select("title", "text", "category", "subcategory")


def model_articles(spark, d):
    """Nested model output: spans without a category stand in `annotations`, beside empty `items`."""
    span = F.array(F.struct("text", "category", "subcategory"))
    nested_rows = _read(spark, d, "test_chatgpt").select(F.to_json(F.struct("title", F.when(F.col("category").isNotNull(), span).otherwise(F.slice(span, 1, 0)).alias("items"), span.alias("annotations"))).alias("value"))
    lines = files.load_json_lines(nested_rows, files.LLM.removeprefix("array<").removesuffix(">"))
    return files.llm_spans(lines.select(F.col("line").alias("article_pos"), F.col("j").alias("a"))).select("title", "text", "category", "subcategory")


def gold_file(spark, d):
    """Consensus spans written as one JSON object an article, and read back with defaults."""
    gold = _read(spark, d, "gold_standard_output").withColumn("leader", F.col("gold_id"))
    schema = f"struct<article_id: bigint, spans: {files.GOLD.removeprefix('map<string, ').removesuffix('>')}>"
    lines = files.load_json_lines(files.gold_json(gold), schema)
    return files.gold_spans(lines.select(F.col("line").alias("article_pos"), F.col("j.spans").alias("spans"))).select("title", "text", "category", "subcategory")


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_cells(spark, d):
    """Titles and sources written as CSV cells and read back."""
    path = _scratch(spark)
    files.write_csv(_read(spark, d, "articles").select("article_id", F.coalesce("title", F.lit("-")).alias("title"), F.coalesce("source", F.lit("-")).alias("source")), path)
    return files.read_cells(spark, path).select(F.col("_c0").cast("bigint").alias("article_id"), F.col("_c1").alias("title"), F.col("_c2").alias("source"))


def csv_articles(spark, d):
    """Articles of a CSV file with a header, numbered from 1 in the file's order."""
    path = _scratch(spark)
    rows = _read(spark, d, "articles").where("title IS NOT NULL").orderBy("article_id").select(F.col("title").alias("Headline"), F.md5("content").alias("News body"))
    rows.coalesce(1).write.csv(path, header=True, quote='"', escape='"')
    return files.read_articles(spark, path)


def completion_codes(spark, d):
    return nested.flat_table(nested.tag_submissions(_read(spark, d, "submissions")), "submissions").select("submission_key", t.completion_code(F.col("submission_key"), 3).alias("code"))


def time_stamps(spark, d):
    at = F.col("published_at").cast("timestamp")
    return _read(spark, d, "articles").select("article_id", t.iso_timestamp(at).alias("iso"), t.file_timestamp(at).alias("file"))


def _by_list(spark, d):
    rows = nested.flat_table(nested.tag_submissions(_read(spark, d, "submissions")), "annotations").where("article_id IS NOT NULL")
    return rows.groupBy("submission_key", "article_id").agg(F.array_sort(F.collect_list(F.struct("pos", "pk", "category", "subcategory", "text"))).alias("a"))


def annotation_flags(spark, d):
    """Of each submission's list for an article: whether any annotation is there, all are labelled, and how many remain without the first."""
    a = F.col("a")
    return _by_list(spark, d).select("submission_key", "article_id", validate.any_annotation(a).alias("any"), validate.all_labelled(a).alias("labelled"), F.size(validate.remove_annotation(a, 0)).alias("without_first"))


def annotations_appended(spark, d):
    """Each submission's annotations by article with one more in its smallest article and in a new one."""
    lists = _by_list(spark, d).groupBy("submission_key").agg(F.map_from_entries(F.collect_list(F.struct("article_id", F.transform("a", lambda x: x["text"]).alias("t")))).alias("m"))
    first = F.array_min(F.map_keys("m"))
    more = validate.append_annotation(validate.append_annotation(F.col("m"), first, F.lit("one more")), F.lit(-1).cast("bigint"), F.lit("new"))
    return lists.select("submission_key", first.alias("first"), more.alias("m")).select("submission_key", F.explode("m").alias("article_id", "t")).select("submission_key", "article_id", F.size("t").alias("n"), F.element_at("t", -1).alias("last"))


def save_flags(spark, d):
    rows = nested.flat_table(nested.tag_submissions(_read(spark, d, "submissions")), "annotations")
    return rows.select("pk", validate.can_save(F.col("category"), F.col("subcategory"), F.col("article_id"), F.col("text"), F.col("text") == consensus.SENTINEL).alias("can_save"))


def latest_labels(spark, d):
    """The last label of each worker under each subcategory: an upsert from the log."""
    log = _read(spark, d, "span_labels").select(F.col("subcategory").alias("title"), "worker", F.col("labelled_at").alias("saved_at"), F.coalesce("category", F.lit("")).alias("payload"))
    return files.latest_annotations(log)


def clean_cells(spark, d):
    """Cells that are right as they stand, repaired: all stay."""
    return repair.repair_table(_read(spark, d, "articles").select("article_id", "title", "content")).select("article_id", "title", F.md5("content").alias("content_md5"))


_FUNCTIONS = (
    normalize_docs, token_counts, content_tokens, label_normalize, word_range_flag, feedback_flag, survey_flags, title_case, safe_titles, paragraphs,
    mojibake_roundtrip, article_usage, balanced_pick, assigned_articles, label_vote, gold_consensus, span_pairs, clusters, line_pairs, line_clusters,
    greedy_eval, text_overlap_eval, overall_eval, consensus_eval, rounded_eval, comparison_file, model_lines, model_articles, gold_file, csv_cells, csv_articles,
    completion_codes, time_stamps, annotation_flags, annotations_appended, save_flags, latest_labels, clean_cells,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SP = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def _strip(x):
    return f"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


def _norm(x):
    return _strip(rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_{_SP}]', '', 'g')")


def _words(x):
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[{_SP}]+'), lambda w: w <> '')"


def _label(x):
    return f"lower({_strip(f"replace(coalesce({x}, ''), '_', ' ')")})"


_STOP = "[" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + "]"
_SMALL = "[" + ", ".join(f"'{w}'" for w in t.TITLE_SMALL) + "]"


def _content(x):
    return f"list_distinct(list_filter({_words(_norm(x))}, lambda w: NOT list_contains({_STOP}, w)))"


_ONCE = """once AS (SELECT submission_key, arg_min(payload, received_at) AS p FROM submissions GROUP BY 1),
j AS (SELECT submission_key, p::JSON AS j FROM once WHERE json_valid(p) AND json_type(p) = 'OBJECT')"""

_TEXTS = f"""own AS (SELECT article_id, gold_id AS ord, {_norm('text')} AS norm, {_content('text')} AS content FROM gold_standard_output WHERE text IS NOT NULL),
classes AS (SELECT article_id, norm, min(ord) AS ord, any_value(content) AS content FROM own GROUP BY 1, 2),
pairs AS (SELECT x.article_id, x.ord AS a, y.ord AS b FROM classes x JOIN classes y ON x.article_id = y.article_id AND x.ord < y.ord
  WHERE (contains(x.norm, y.norm) OR contains(y.norm, x.norm)) AND len(list_intersect(x.content, y.content)) >= 2)"""

def _around(tokens, shared):
    places = f"list_filter(range(1, len({tokens}) + 1), lambda i: list_contains({shared}, ({tokens})[i]))"
    return f"array_to_string(list_slice({tokens}, greatest(1, list_min({places}) - 2), least(len({tokens}), list_max({places}) + 2)), ' ')"


def _narrowed(t, m):
    """The text t narrowed to what it shares with m, in SQL."""
    x, y = _words(t), _words(m)
    shared = f"list_filter({x}, lambda w: list_contains({y}, w))"
    a, b = _around(x, shared), _around(y, shared)
    return f"CASE WHEN len({shared}) = 0 THEN {t} WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END"


_SPANS = f"""{OBJECTS}, refs AS (SELECT submission_key, unnest(from_json(j->'$.articleTitles', '["JSON"]')) AS a, unnest(range(json_array_length(j->'$.articleTitles')::BIGINT)) AS i FROM j WHERE json_type(j->'$.articleTitles') = 'ARRAY'),
titles AS (SELECT submission_key, try_cast(a->>'$.id' AS BIGINT) AS article_id, arg_min(a->>'$.title', i) AS ref_title FROM refs WHERE a->>'$.title' IS NOT NULL GROUP BY 1, 2),
spans AS (
  SELECT e.article_id, row_number() OVER (PARTITION BY e.article_id ORDER BY coalesce(received_at, TIMESTAMP '9999-12-31'), e.submission_key, pos, place) AS ord, e.submission_key AS worker, coalesce(o->>'$.title', ref_title) AS title,
    o->>'$.text' AS text, o->>'$.category' AS category, o->>'$.subcategory' AS subcategory
  FROM e LEFT JOIN titles USING (submission_key, article_id) WHERE e.article_id IS NOT NULL AND o->>'$.text' IS NOT NULL AND o->>'$.text' <> '{consensus.SENTINEL}'
), own AS (SELECT *, {_norm('text')} AS norm, {_content('text')} AS content FROM spans),
classes AS (SELECT article_id, norm, min(ord) AS ord, any_value(content) AS content FROM own GROUP BY 1, 2),
pairs AS (SELECT x.article_id, x.ord AS a, y.ord AS b FROM classes x JOIN classes y ON x.article_id = y.article_id AND x.ord < y.ord
  WHERE (contains(x.norm, y.norm) OR contains(y.norm, x.norm)) AND len(list_intersect(x.content, y.content)) >= 2)"""

_LEADERS = """o AS (SELECT article_id, ord, row_number() OVER (PARTITION BY article_id ORDER BY ord) AS n FROM classes),
near AS (SELECT p.article_id, p.b AS ord, list(p.a) AS before FROM pairs p GROUP BY 1, 2),
walk AS (SELECT article_id, 0::BIGINT AS n, []::BIGINT[] AS leaders FROM o GROUP BY 1
  UNION ALL SELECT w.article_id, w.n + 1, CASE WHEN coalesce(list_has_any(w.leaders, near.before), false) THEN w.leaders ELSE list_append(w.leaders, o.ord) END
  FROM walk w JOIN o ON o.article_id = w.article_id AND o.n = w.n + 1 LEFT JOIN near ON near.article_id = o.article_id AND near.ord = o.ord),
ended AS (SELECT article_id, arg_max(leaders, n) AS leaders FROM walk GROUP BY 1),
led AS (SELECT o.article_id, o.ord, CASE WHEN list_contains(e.leaders, o.ord) THEN o.ord ELSE list_min(list_intersect(e.leaders, near.before)) END AS leader
  FROM o JOIN ended e USING (article_id) LEFT JOIN near ON near.article_id = o.article_id AND near.ord = o.ord)"""

_GOLD = f"""WITH RECURSIVE {_SPANS}, {_LEADERS},
of_text AS (SELECT c.article_id, c.norm, c.ord, l.leader FROM classes c JOIN led l USING (article_id, ord)),
marked AS (SELECT w.article_id, w.ord, w.worker, w.norm, w.title, w.text, w.category, w.subcategory, CASE WHEN len(w.content) < 2 THEN w.ord ELSE t.leader END AS leader FROM own w JOIN of_text t USING (article_id, norm)),
folded AS (SELECT article_id, leader, list_reduce(list(norm ORDER BY ord), lambda t, m: {_narrowed('t', 'm')}) AS folded FROM marked GROUP BY 1, 2),
base AS (SELECT article_id, leader, count(*) AS num_supporters, count(DISTINCT worker) AS distinct_workers, arg_min(text, ord) AS raw, arg_min(title, ord) FILTER (title IS NOT NULL) AS own_title, min(ord) AS f FROM marked GROUP BY 1, 2),
named AS (SELECT article_id, arg_min(own_title, f) FILTER (own_title IS NOT NULL) AS article_title FROM base GROUP BY 1),
c AS (SELECT article_id, leader, first(category ORDER BY n DESC, f) AS category, count(*) = 1 AS one FROM (SELECT article_id, leader, category, count(*) AS n, min(ord) AS f FROM marked GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT article_id, leader, first(subcategory ORDER BY n DESC, f) AS subcategory, count(*) = 1 AS one FROM (SELECT article_id, leader, subcategory, count(*) AS n, min(ord) AS f FROM marked GROUP BY 1, 2, 3) GROUP BY 1, 2),
gold AS (SELECT article_id, leader, coalesce(own_title, article_title) AS title, CASE WHEN num_supporters = 1 THEN raw ELSE coalesce(folded, raw) END AS text, category, subcategory,
  CASE WHEN num_supporters = 3 THEN 1.0 WHEN num_supporters = 2 AND c.one AND s.one THEN 0.67 WHEN num_supporters = 2 THEN 0.5 ELSE 0.33 END::DOUBLE AS confidence, num_supporters, distinct_workers, c.one AND s.one AS label_consistent
FROM base LEFT JOIN folded USING (article_id, leader) JOIN c USING (article_id, leader) JOIN s USING (article_id, leader) JOIN named USING (article_id))"""

_RATIOS = """correct, total_llm, total_gold,
  CASE WHEN total_llm = 0 THEN 0.0 ELSE correct / total_llm::DOUBLE END AS precision, CASE WHEN total_gold = 0 THEN 0.0 ELSE correct / total_gold::DOUBLE END AS recall,
  CASE WHEN correct = 0 THEN 0.0 ELSE 2 * (correct / total_llm::DOUBLE) * (correct / total_gold::DOUBLE) / (correct / total_llm::DOUBLE + correct / total_gold::DOUBLE) END AS f1,
  CASE WHEN correct = 0 THEN 0.0 ELSE 1.0::DOUBLE END AS category_precision, CASE WHEN correct = 0 THEN 0.0 ELSE 1.0::DOUBLE END AS category_recall, CASE WHEN correct = 0 THEN 0.0 ELSE 1.0::DOUBLE END AS category_f1"""


_LINES = f"""l AS (SELECT source AS article_id, doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
own AS (SELECT article_id, doc_id * 1000000 + pos AS ord, {_norm('text')} AS norm, {_content('text')} AS content FROM l),
classes AS (SELECT article_id, norm, min(ord) AS ord, any_value(content) AS content FROM own GROUP BY 1, 2),
pairs AS (SELECT x.article_id, least(x.ord, y.ord) AS a, greatest(x.ord, y.ord) AS b FROM classes x JOIN classes y ON x.article_id = y.article_id AND x.ord <> y.ord
  WHERE length(x.norm) <= length(y.norm) AND (length(x.norm) < length(y.norm) OR x.ord < y.ord) AND len(x.content) >= 2 AND contains(y.norm, x.norm) AND len(list_intersect(x.content, y.content)) >= 2)"""


def _greedy(labelled: bool, gold: str = "SELECT title, category, subcategory, gold_id AS ord, text FROM gold_standard_output", folded: bool = False) -> str:
    key = "title, category, subcategory" if labelled else "title"
    title = "coalesce(title, 'UNKNOWN_TITLE')"
    title = _norm(title) if folded else title
    return f"""l AS (SELECT {title} AS title, {_label('category')} AS category, {_label('subcategory')} AS subcategory, llm_id AS ord, {_words(_norm('text'))} AS tokens FROM test_chatgpt),
g AS (SELECT {title} AS title, {_label('category')} AS category, {_label('subcategory')} AS subcategory, ord, {_words(_norm('text'))} AS tokens FROM ({gold})),
ll AS (SELECT {key}, list({{'o': ord, 't': list_distinct(tokens)}} ORDER BY ord) AS ls FROM l GROUP BY ALL),
gg AS (SELECT {key}, list({{'t': list_distinct(tokens)}} ORDER BY ord) AS gs FROM g GROUP BY ALL),
matched AS (SELECT title, len(list_reduce(list_transform(ls, lambda s: {{'used': []::BIGINT[], 't': s.t}}), lambda u, s: {{'used': list_concat(u.used, list_slice(
    list_filter(range(1, len(gs) + 1), lambda i: NOT list_contains(u.used, i) AND len(list_intersect(gs[i].t, s.t)) >= 2), 1, 1)), 't': s.t}}, {{'used': []::BIGINT[], 't': []::VARCHAR[]}}).used) AS n
  FROM ll JOIN gg USING ({key})),
counts AS (SELECT x.title, coalesce(z.correct, 0) AS correct, total_llm, total_gold FROM (SELECT title, count(*) AS total_llm FROM l GROUP BY 1) x
  JOIN (SELECT title, count(*) AS total_gold FROM g GROUP BY 1) y USING (title) LEFT JOIN (SELECT title, sum(n)::BIGINT AS correct FROM matched GROUP BY 1) z USING (title))"""


_ALL = "SELECT sum(correct)::BIGINT AS correct, sum(total_llm)::BIGINT AS total_llm, sum(total_gold)::BIGINT AS total_gold FROM counts"
_LIST = f"WITH {OBJECTS}, l AS (SELECT submission_key, article_id, count(*) AS n, bool_and(coalesce(o->>'$.category', '') <> '' AND coalesce(o->>'$.subcategory', '') <> '') AS labelled, last(o->>'$.text' ORDER BY pos, place) AS last FROM e WHERE article_id IS NOT NULL GROUP BY 1, 2)"


_USES = f"""WITH {_ONCE}, a AS (SELECT unnest(from_json(j->'$.articleTitles', '["JSON"]')) AS a FROM j WHERE json_type(j->'$.articleTitles') = 'ARRAY')
SELECT try_cast(a->>'$.id' AS BIGINT) AS idx, count(*) AS uses FROM a WHERE try_cast(a->>'$.id' AS BIGINT) IS NOT NULL GROUP BY 1"""
_PICK = f"""WITH u AS (SELECT idx - 1 AS idx, uses FROM ({_USES}))
SELECT coalesce(u.idx, r.idx) AS idx, coalesce(uses, 0) AS uses FROM u FULL JOIN (SELECT unnest(range(12)) AS idx) r ON u.idx = r.idx WHERE coalesce(uses, 0) < 3 ORDER BY md5(coalesce(u.idx, r.idx)::VARCHAR || '/7'), 1 LIMIT 3"""

ORACLE = {
    "normalize_docs": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5 FROM documents",
    "token_counts": f"SELECT doc_id, len({_words(_norm('text'))}) AS n_tokens, len(list_distinct({_words(_norm('text'))})) AS n_distinct, len({_words('text')}) AS n_words, length({_strip("coalesce(text, '')")}) AS n_characters FROM documents",
    "content_tokens": f"SELECT gold_id, array_to_string(list_sort({_content('text')}), ' ') AS content FROM gold_standard_output",
    "label_normalize": f"SELECT llm_id, {_label('category')} AS category, {_label('subcategory')} AS subcategory FROM test_chatgpt",
    "word_range_flag": f"SELECT gold_id, len({_words('text')}) AS n_words, len({_words('text')}) BETWEEN 4 AND 25 AS valid FROM gold_standard_output",
    "feedback_flag": f"SELECT llm_id, length({_strip("coalesce(open_feedback, '')")}) >= 100 AS long_enough FROM test_chatgpt",
    "survey_flags": f"""WITH {_ONCE}, s AS (SELECT submission_key, j->'$.surveyResponses' AS s FROM j WHERE json_type(j->'$.surveyResponses') = 'OBJECT'),
k AS (SELECT submission_key, s, unnest(json_keys(s)) AS k FROM s), a AS (SELECT submission_key, k, json_extract(s, '$."' || k || '"') AS a FROM k)
SELECT submission_key, try_cast(k AS BIGINT) AS article_id, coalesce(try_cast(a->>'$.confidence' AS INT), 0) <> 0 AND coalesce(try_cast(a->>'$.bias' AS INT), 0) <> 0 AND length({_strip("coalesce(a->>'$.openFeedback', '')")}) > 0 AS complete,
  length({_strip("coalesce(a->>'$.openFeedback', '')")}) >= 100 AS long_enough FROM a WHERE json_type(a) = 'OBJECT'""",
    "title_case": f"SELECT article_id, array_to_string(list_transform(string_split(title, ' '), lambda w: CASE WHEN list_contains({_SMALL}, w) THEN w WHEN w[1] = 'ß' THEN 'SS' || w[2:] ELSE upper(w[1]) || w[2:] END), ' ') AS title FROM articles",
    "safe_titles": f"SELECT article_id, regexp_replace(title, '[{_SP}]+', '_', 'g') AS safe_title FROM articles",
    "paragraphs": f"""WITH w AS (SELECT article_id, list_transform(regexp_split_to_array(content, '[{_SP}]+'), lambda w: {{'done': []::VARCHAR[], 'open': [w], 'q': false}}) AS ws FROM articles WHERE content IS NOT NULL),
f AS (SELECT article_id, list_reduce(ws, lambda s, x: CASE
    WHEN len(s.open) + 1 >= 150 AND ends_with(x.open[1], '.') AND NOT (s.q <> ((length(x.open[1]) - length(replace(x.open[1], '"', ''))) % 2 = 1))
    THEN {{'done': list_append(s.done, array_to_string(list_concat(s.open, x.open), ' ')), 'open': []::VARCHAR[], 'q': s.q <> ((length(x.open[1]) - length(replace(x.open[1], '"', ''))) % 2 = 1)}}
    ELSE {{'done': s.done, 'open': list_concat(s.open, x.open), 'q': s.q <> ((length(x.open[1]) - length(replace(x.open[1], '"', ''))) % 2 = 1)}} END,
    {{'done': []::VARCHAR[], 'open': []::VARCHAR[], 'q': false}}) AS s FROM w),
p AS (SELECT article_id, CASE WHEN len(s.open) > 0 THEN list_append(s.done, array_to_string(s.open, ' ')) ELSE s.done END AS p FROM f)
SELECT article_id, len(p) AS n_paragraphs, md5(array_to_string(p, '|')) AS paragraphs_md5 FROM p""",
    "mojibake_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "article_usage": _USES,
    "balanced_pick": f"WITH p AS ({_PICK}) SELECT * FROM p",
    "label_vote": """WITH c AS (SELECT gold_id, category, count(*) AS n, min(label_id) AS f FROM span_labels GROUP BY 1, 2), s AS (SELECT gold_id, subcategory, count(*) AS n, min(label_id) AS f FROM span_labels GROUP BY 1, 2),
cc AS (SELECT gold_id, first(category ORDER BY n DESC, f) AS category, count(*) AS k FROM c GROUP BY 1), ss AS (SELECT gold_id, first(subcategory ORDER BY n DESC, f) AS subcategory, count(*) AS k FROM s GROUP BY 1)
SELECT gold_id, category, subcategory, cc.k = 1 AND ss.k = 1 AS label_consistent FROM cc JOIN ss USING (gold_id)""",
    "span_pairs": f"WITH {_TEXTS} SELECT article_id, a, b FROM pairs",
    "clusters": f"WITH RECURSIVE {_TEXTS}, {_LEADERS} SELECT article_id, ord, leader FROM led",
    "gold_consensus": f"{_GOLD} SELECT * EXCLUDE (leader) FROM gold",
    "consensus_eval": f"{_GOLD}, {_greedy(False, "SELECT title, category, subcategory, {'a': article_id, 'l': leader} AS ord, text FROM gold", True)} SELECT title, {_RATIOS} FROM counts",
    "line_pairs": f"WITH {_LINES} SELECT article_id AS source, a // 1000000 AS a_doc, (a % 1000000)::INT AS a_pos, b // 1000000 AS b_doc, (b % 1000000)::INT AS b_pos FROM pairs",
    "line_clusters": f"WITH RECURSIVE {_LINES}, {_LEADERS.replace('FROM classes', 'FROM (SELECT DISTINCT article_id, unnest([a, b]) AS ord FROM pairs)')} SELECT article_id AS source, ord // 1000000 AS doc_id, (ord % 1000000)::INT AS pos, leader // 1000000 AS leader_doc, (leader % 1000000)::INT AS leader_pos FROM led WHERE ord <> leader",
    "assigned_articles": f"""WITH p AS ({_PICK}) SELECT article_id AS id, title FROM p JOIN articles ON article_id = idx + 1""",
    "rounded_eval": f"WITH {_greedy(True)}, r AS (SELECT title, {_RATIOS} FROM counts) SELECT title, correct, total_llm, total_gold, round(COLUMNS(lambda c: c LIKE '%precision' OR c LIKE '%recall' OR c LIKE '%f1'), 3) FROM r",
    "comparison_file": f"WITH {_greedy(True)}, r AS (SELECT title, {_RATIOS} FROM counts UNION ALL SELECT '(overall)', {_RATIOS} FROM ({_ALL})) SELECT title, round(precision, 3) AS precision, round(f1, 3) AS f1, correct AS correct_matches, total_gold FROM r",
    "model_lines": """SELECT coalesce(payload->>'$.title', 'UNKNOWN_TITLE') AS title, coalesce(payload->>'$.text', '') AS text, coalesce(payload->>'$.category', '') AS category, coalesce(payload->>'$.subcategory', '') AS subcategory FROM llm_raw""",
    "model_articles": "SELECT coalesce(title, 'UNKNOWN_TITLE') AS title, coalesce(text, '') AS text, coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory FROM test_chatgpt",
    "gold_file": "SELECT coalesce(title, 'UNKNOWN_TITLE') AS title, coalesce(text, '') AS text, coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory FROM gold_standard_output",
    "csv_cells": "SELECT article_id, coalesce(title, '-') AS title, coalesce(source, '-') AS source FROM articles",
    "csv_articles": "SELECT row_number() OVER (ORDER BY article_id) AS id, title, md5(content) AS content FROM articles WHERE title IS NOT NULL",
    "completion_codes": f"WITH {_ONCE} SELECT submission_key, 'MTURK-' || upper(md5(submission_key || '/3')[:6]) AS code FROM j",
    "time_stamps": "SELECT article_id, strftime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, replace(replace(strftime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ'), ':', '-'), '.', '-') AS file FROM articles",
    "annotation_flags": f"{_LIST} SELECT submission_key, article_id, true AS any, labelled, (n - 1)::INT AS without_first FROM l",
    "annotations_appended": f"{_LIST}, firsts AS (SELECT submission_key, min(article_id) AS first FROM l GROUP BY 1) SELECT submission_key, article_id, (n + (article_id = first)::INT)::INT AS n, CASE WHEN article_id = first THEN 'one more' ELSE last END AS last FROM l JOIN firsts USING (submission_key) UNION ALL SELECT submission_key, -1, 1, 'new' FROM firsts",
    "save_flags": f"""WITH {OBJECTS} SELECT submission_key || '/textAnnotations/' || place || '/' || pos AS pk, coalesce(o->>'$.category', '') <> '' AND coalesce(o->>'$.subcategory', '') <> '' AND article_id IS NOT NULL AND coalesce(o->>'$.text', '') <> '' AS can_save FROM e""",
    "latest_labels": f"SELECT regexp_replace(subcategory, '[{_SP}]+', '_', 'g') AS safe_title, worker, max(labelled_at) AS saved_at, first(coalesce(category, '') ORDER BY labelled_at DESC, coalesce(category, '') DESC) AS payload FROM span_labels GROUP BY 1, 2",
    "clean_cells": "SELECT article_id, title, md5(content) AS content_md5 FROM articles",
    "greedy_eval": f"WITH {_greedy(True)} SELECT title, {_RATIOS} FROM counts",
    "text_overlap_eval": f"WITH {_greedy(False)} SELECT title, {_RATIOS} FROM counts",
    "overall_eval": f"WITH {_greedy(True)} SELECT {_RATIOS} FROM ({_ALL})",
}
