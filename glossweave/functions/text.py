"""Text expressions: normalisation, tokens, labels, windows, paragraphs, titles. All native columns, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class, the same set as Python's `\s`.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Words that don't count when spans are compared.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very can will just don should now"
).split()

# Words that a title keeps as they are.
TITLE_SMALL = "a to off over from into with yet so an and as at but by for in nor of on or the up".split()

#: Selections of this many words are valid.
MIN_WORDS, MAX_WORDS = 4, 25
#: A paragraph breaks after this many words, at a full stop outside quotation marks.
PARAGRAPH_WORDS = 150


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(x: Column) -> Column:
    """Lower case, without anything but letters, digits, underscores and white space, stripped. Null becomes empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{SPACE}]", ""))


def split_words(x: Column) -> Column:
    """Runs of characters between white space; none of an empty or null text."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def tokenize(x: Column) -> Column:
    """Words of the normalised text."""
    return split_words(normalize_text(x))


def content_tokens(tokens: Column) -> Column:
    """Distinct words that are no stopwords."""
    return F.array_except(tokens, F.array(*[F.lit(w) for w in STOPWORDS]))


def normalize_label(x: Column) -> Column:
    """Underscores as spaces, stripped, lower case; null and empty labels are empty. Hyphens stay."""
    return F.lower(strip(F.translate(F.coalesce(x, F.lit("")), "_", " ")))


def count_words(x: Column) -> Column:
    """Words between white space; 0 for blank and null texts."""
    return F.size(split_words(x))


def count_characters(x: Column) -> Column:
    """Length of the stripped text in code points; 0 for null."""
    return F.length(strip(F.coalesce(x, F.lit(""))))


def shared_count(a: Column, b: Column) -> Column:
    """Distinct elements that two arrays share."""
    return F.size(F.array_intersect(a, b))


def overlaps(a: Column, b: Column, min_overlap: int = 2) -> Column:
    """At least `min_overlap` distinct words in common."""
    return shared_count(a, b) >= min_overlap


def spans_match(norm_a: Column, content_a: Column, norm_b: Column, content_b: Column) -> Column:
    """One normalised text holds the other, and they share two words that are no stopwords. Not transitive."""
    return (F.contains(norm_a, norm_b) | F.contains(norm_b, norm_a)) & overlaps(content_a, content_b)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once although `use` may name it often, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_around(tokens: Column, shared: Column, pad: int = 2) -> Column:
    """Words from the first to the last one that is shared, with `pad` more at either end, joined by spaces."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(shared, t), i)), lambda i: i.isNotNull())

    def cut_out(p):
        low = F.greatest(F.lit(0), F.array_min(p) - pad)
        high = F.least(F.size(tokens), F.array_max(p) + pad + 1)
        return F.when(F.size(p) > 0, F.array_join(F.slice(tokens, low + 1, high - low), " "))

    return let(places, cut_out)


def intersect_window(a: Column, b: Column, pad: int = 2) -> Column:
    """The shorter (by characters; ties: the first) of the windows around shared words in two texts; null if none is shared."""

    def shorter(s):
        first, second = window_around(s["x"], s["shared"], pad), window_around(s["y"], s["shared"], pad)
        both = let(F.struct(first.alias("a"), second.alias("b")), lambda w: F.when(F.length(w["a"]) <= F.length(w["b"]), w["a"]).otherwise(w["b"]))
        return F.when(F.size(s["shared"]) > 0, both)

    texts = F.struct(tokenize(a).alias("x"), tokenize(b).alias("y"))
    return let(texts, lambda s: let(F.struct(s["x"].alias("x"), s["y"].alias("y"), F.filter(s["x"], lambda t: F.array_contains(s["y"], t)).alias("shared")), shorter))


def title_capitalization(x: Column) -> Column:
    """The first letter of each word in upper case, except small words; the rest stays. Words end at single spaces."""
    small = F.array(*[F.lit(w) for w in TITLE_SMALL])
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.when(F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def safe_title(x: Column) -> Column:
    """Each run of white space as one underscore."""
    return F.regexp_replace(x, f"[{SPACE}]+", "_")


def paragraphs(x: Column, words: int = PARAGRAPH_WORDS) -> Column:
    """The text's words in paragraphs: a break comes after a word that ends with a full stop, from `words` words on,
    unless a quotation mark is open. A leading blank counts as an empty first word. Null gives null."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(False).alias("quoted"))

    def add(s, w):
        quoted = F.when(F.length(w) - F.length(F.replace(w, F.lit('"'), F.lit(""))) == 1, ~s["quoted"]).when((F.length(w) - F.length(F.replace(w, F.lit('"'), F.lit("")))) % 2 == 1, ~s["quoted"]).otherwise(s["quoted"])
        opened = F.concat(s["open"], F.array(w))
        ends = (F.size(opened) >= words) & F.endswith(w, F.lit(".")) & ~quoted
        return F.struct(
            F.when(ends, F.concat(s["done"], F.array(F.array_join(opened, " ")))).otherwise(s["done"]).alias("done"),
            F.when(ends, F.array().cast("array<string>")).otherwise(opened).alias("open"),
            quoted.alias("quoted"),
        )

    return F.aggregate(F.split(x, f"[{SPACE}]+"), empty, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], " ")))).otherwise(s["done"]))


def iso_timestamp(ts: Column) -> Column:
    """UTC in ISO 8601 with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_timestamp(ts: Column) -> Column:
    """The ISO form with dashes for colons and points, as file names need it."""
    return F.regexp_replace(iso_timestamp(ts), "[:.]", "-")


def completion_code(key: Column, seed: int = 0) -> Column:
    """A code for a key, the same at each evaluation: a prefix and six signs."""
    return F.concat(F.lit("MTURK-"), F.upper(F.substring(F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed)))), 1, 6)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
