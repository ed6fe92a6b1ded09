"""Validation flags of selections, surveys and annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.text import MAX_WORDS, MIN_WORDS, count_characters, count_words

#: Characters that an answer should have.
MIN_FEEDBACK = 100


def selection_valid(text: Column) -> Column:
    """4 to 25 words."""
    return count_words(text).between(MIN_WORDS, MAX_WORDS)


def survey_complete(confidence: Column, bias: Column, feedback: Column) -> Column:
    """Both scales answered and some feedback."""
    return (F.coalesce(confidence, F.lit(0)) != 0) & (F.coalesce(bias, F.lit(0)) != 0) & (count_characters(feedback) > 0)


def feedback_long_enough(feedback: Column, least: int = MIN_FEEDBACK) -> Column:
    return count_characters(feedback) >= least


def any_annotation(annotations: Column) -> Column:
    """At least one annotation, the one for "nothing selected" included."""
    return F.coalesce(F.size(annotations), F.lit(0)) > 0


def all_labelled(annotations: Column) -> Column:
    """No annotation lacks its category or subcategory; true for none."""
    return F.coalesce(F.forall(annotations, lambda a: (F.coalesce(a["category"], F.lit("")) != "") & (F.coalesce(a["subcategory"], F.lit("")) != "")), F.lit(True))


def can_save(category: Column, subcategory: Column, article: Column, text: Column, none_selected: Column) -> Column:
    """Category, subcategory and article are there, and a text unless nothing was selected."""
    def filled(c):
        return F.coalesce(c.cast("string"), F.lit("")) != ""

    return filled(category) & filled(subcategory) & filled(article) & (filled(text) | F.coalesce(none_selected, F.lit(False)))


def remove_annotation(annotations: Column, place: int) -> Column:
    """An article's annotations without the one at `place`."""
    return F.filter(annotations, lambda a, i: i != place)


def append_annotation(annotations: Column, article: Column, annotation: Column) -> Column:
    """A map from article to annotations with one more annotation at the end of an article's list; a new article gets a list."""
    own = F.coalesce(F.try_element_at(annotations, article), F.filter(F.array(annotation), lambda a: F.lit(False)))
    others = F.map_filter(F.coalesce(annotations, F.map_from_arrays(F.array(article), F.array(own))), lambda k, v: k != article)
    return F.map_concat(others, F.map_from_arrays(F.array(article), F.array(F.concat(own, F.array(annotation)))))
