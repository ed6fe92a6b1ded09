"""Readers and writers of the JSON, CSV and Parquet shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.functions.text import safe_title
from glossweave.operators.evaluate import rounded

SUBMISSION = (
    "struct<articleTitles: array<struct<id: bigint, title: string>>, completionCode: string, "
    "surveyResponses: map<string, struct<bias: int, confidence: int, openFeedback: string>>, "
    "textAnnotations: map<string, array<struct<category: string, subcategory: string, text: string, title: string>>>, "
    "annotations: map<string, string>, timestamp: string>"
)
SPAN = "struct<text: string, category: string, subcategory: string>"
LLM = f"array<struct<title: string, items: array<{SPAN}>, annotations: array<{SPAN}>>>"
LLM_FLAT = "array<struct<title: string, category: string, subcategory: string, text: string, openFeedback: string>>"
GOLD = "map<string, array<struct<title: string, text: string, category: string, subcategory: string, confidence: double, num_supporters: int, label_consistent: boolean>>>"


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with column `j`, the whole file parsed. Blank files and broken JSON raise."""
    raw = spark.read.text(path, wholetext=True)
    if raw.where(F.length(F.trim("value")) > 0).isEmpty():
        raise ValueError(f"{path} is empty")
    checked = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))
    return checked.where(F.col("j").isNotNull() | F.raise_error(F.lit("no JSON of the expected shape")).isNotNull())


def load_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Column `j` of one JSON value a line, in as many tasks as the files have splits; broken lines raise, blank ones are skipped."""
    rows = lines.where(F.length(F.trim(column)) > 0).select(F.monotonically_increasing_id().alias("line"), F.from_json(column, schema, {"mode": "FAILFAST"}).alias("j"))
    return rows.where(F.col("j").isNotNull() | F.raise_error(F.lit("no JSON of the expected shape")).isNotNull())


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(submission_pos, submission_key, s) of an export, in file order."""
    return load_json(spark, path, f"map<string, {SUBMISSION}>").select(F.posexplode("j").alias("submission_pos", "submission_key", "s"))


def submission_spans(submissions: DataFrame) -> DataFrame:
    """(article_id, worker, ord, text, category, subcategory, title) of all annotations, `ord` in reading order."""
    articles = submissions.select("submission_pos", "submission_key", "s.articleTitles", F.posexplode("s.textAnnotations").alias("article_pos", "article", "spans"))
    rows = articles.select("*", F.posexplode("spans").alias("pos", "a"))
    title = F.get(F.filter("articleTitles", lambda t: t["id"].cast("string") == F.col("article")), F.lit(0))["title"]
    place = F.col("submission_pos").cast("bigint") * F.lit(2**42) + F.col("article_pos").cast("bigint") * F.lit(2**21) + F.col("pos")
    return rows.select(F.expr("try_cast(article AS bigint)").alias("article_id"), F.col("submission_key").alias("worker"), place.alias("ord"), "a.text", "a.category", "a.subcategory", F.coalesce(F.col("a.title"), title).alias("title"))


def flatten_llm(spark: SparkSession, path: str) -> DataFrame:
    """(title, ord, text, category, subcategory) of articles with `items`, or else `annotations`; empty lists give none."""
    return llm_spans(load_json(spark, path, LLM).select(F.posexplode("j").alias("article_pos", "a")))


def llm_spans(listed: DataFrame) -> DataFrame:
    """The spans of articles `a` in order of `article_pos`."""
    spans = F.when(F.size("a.items") > 0, F.col("a.items")).when(F.size("a.annotations") > 0, F.col("a.annotations"))
    rows = listed.select("article_pos", F.coalesce("a.title", F.lit("UNKNOWN_TITLE")).alias("title"), F.posexplode(spans).alias("pos", "s"))
    return rows.select("title", (F.col("article_pos").cast("bigint") * 2**21 + F.col("pos")).alias("ord"), *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("text", "category", "subcategory")])


def flatten_llm_flat(spark: SparkSession, path: str) -> DataFrame:
    """The same of a flat list of annotations."""
    return llm_flat_spans(load_json(spark, path, LLM_FLAT).select(F.posexplode("j").alias("pos", "s")))


def llm_flat_spans(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("s.title", F.lit("UNKNOWN_TITLE")).alias("title"), F.col("pos").cast("bigint").alias("ord"), *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("text", "category", "subcategory")])


def flatten_gold(spark: SparkSession, path: str) -> DataFrame:
    """The same of a consensus file, regrouped by the rows' own titles."""
    return gold_spans(load_json(spark, path, GOLD).select(F.posexplode("j").alias("article_pos", "key", "spans")))


def gold_spans(articles: DataFrame) -> DataFrame:
    """The spans of articles' lists `spans` in order of `article_pos`."""
    rows = articles.select("article_pos", F.posexplode("spans").alias("pos", "s"))
    return rows.select(F.coalesce("s.title", F.lit("UNKNOWN_TITLE")).alias("title"), (F.col("article_pos").cast("bigint") * 2**21 + F.col("pos")).alias("ord"), *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("text", "category", "subcategory")])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as plain cells: the header is a row like others, bad bytes are replaced."""
    return spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_articles(spark: SparkSession, path: str, title: str = "Headline", content: str = "News body") -> DataFrame:
    """(id, title, content) of a CSV file with a header; `id` is the row's number from 1. Empty lines are skipped.

    A multi-line CSV file is read by one task, in order, so the numbers need no sort over the cluster.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").withColumn("_row", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(W.orderBy("_row")).cast("bigint").alias("id"), F.col(f"`{title}`").alias("title"), F.col(f"`{content}`").alias("content"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(idx, uses) of a Parquet table, or none where there is no table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path).select("idx", "uses")
    return spark.createDataFrame([], "idx bigint, uses bigint")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=False, quote='"', escape='"', encoding="UTF-8")


def gold_json(gold: DataFrame) -> DataFrame:
    """One JSON object for each article: its spans in order, under `article_id`. Rows scale; a single file doesn't."""
    fields = [c for c in ("title", "text", "category", "subcategory", "confidence", "num_supporters", "label_consistent") if c in gold.columns]
    span = F.struct("leader", F.struct(*fields).alias("s"))
    spans = gold.groupBy("article_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return spans.select(F.to_json(F.struct("article_id", F.col("spans.s").alias("spans"))).alias("value"))


def gold_object(gold: DataFrame) -> DataFrame:
    """One row: all articles as one JSON object keyed by article id, for exports that fit one file."""
    rows = gold_json(gold).select(F.get_json_object("value", "$.article_id").alias("k"), F.get_json_object("value", "$.spans").alias("v"))
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("k")).substr(F.lit(2), F.length(F.to_json(F.array("k"))) - 2), F.lit(": "), "v"))), ", "), F.lit("}")).alias("value"))


def comparison_object(per_title: DataFrame, overall: DataFrame) -> DataFrame:
    """One row: {overall, per_article} with the article and category scores of each title, rounded to three places."""

    def part():
        article = F.struct("precision", "recall", "f1", F.col("correct").alias("correct_matches"), "total_llm", "total_gold")
        category = F.struct(F.col("category_precision").alias("precision"), F.col("category_recall").alias("recall"), F.col("category_f1").alias("f1"), F.col("correct").alias("correct_matches"), F.col("correct").alias("total_matches"))
        return F.struct(article.alias("article_match"), category.alias("category_match"))

    whole = rounded(overall).agg(F.first(part()).alias("overall")).withColumn("one", F.lit(1))
    titles = rounded(per_title).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", part().alias("s"))))).alias("per_article")).withColumn("one", F.lit(1))
    return whole.join(titles, "one").select(F.to_json(F.struct("overall", "per_article")).alias("value"))


def write_comparison(per_title: DataFrame, overall: DataFrame, path: str) -> None:
    """Scores by title and overall, as JSON rows in two folders."""
    per_title.write.mode("overwrite").json(f"{path}/per_article")
    overall.write.mode("overwrite").json(f"{path}/overall")


def append_submissions(df: DataFrame, path: str) -> None:
    """Submissions appended as Parquet, a folder for each day."""
    df.withColumn("day", F.to_date("received_at")).write.mode("append").partitionBy("day").parquet(path)


def latest_annotations(log: DataFrame) -> DataFrame:
    """The last row of each (safe_title, worker) of a log with title, worker, saved_at, payload: an upsert without updates."""
    keyed = log.withColumn("safe_title", safe_title(F.col("title")))
    return keyed.groupBy("safe_title", "worker").agg(F.max_by("payload", F.struct("saved_at", "payload")).alias("payload"), F.max("saved_at").alias("saved_at"))
