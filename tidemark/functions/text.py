"""Rule-based classification and text keys as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark import topics


def classify_category(question: Column, description: Column, raw: Column) -> Column:
    """First category whose keywords occur in the joined non-empty texts, else ``other``."""
    parts = [F.nullif(c, F.lit("")) for c in (question, description, raw)]
    text = F.concat_ws(" ", *parts)
    out = None
    for name, pattern in C.CATEGORY_PATTERNS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def with_resolution_type(df: DataFrame, question: str = "question", description: str = "description") -> DataFrame:
    """Add ``resolution_type`` and whether the deadline phrase occurs in the description only."""
    in_q = F.coalesce(F.col(question).rlike(C.DEADLINE_PATTERN), F.lit(False))
    in_d = F.coalesce(F.col(description).rlike(C.DEADLINE_PATTERN), F.lit(False))
    return (df.withColumn("resolution_type", F.when(in_q | in_d, "deadline_resolved").otherwise("unclassifiable"))
            .withColumn("description_only", ~in_q & in_d))


def classify_regulatory(question: Column, description: Column | None = None) -> Column:
    """Announcement when strictly more announcement than formal patterns match, else formal."""
    text = question if description is None else F.concat_ws(" ", question, F.nullif(description, F.lit("")))
    hits = lambda ps: sum((text.rlike(p).cast("int") for p in ps), F.lit(0))
    return F.when(hits(C.ANNOUNCEMENT_PATTERNS) > hits(C.FORMAL_PATTERNS), "regulatory_decision_announcement") \
        .otherwise("regulatory_decision_formal")


def classify_topic(category: Column, raw: Column, question: Column,
                   keywords: list[tuple[str, list[str]]] = topics.TOPIC_KEYWORDS) -> Column:
    """First topic with a keyword in the padded lower-case text, else by category."""
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif(question, F.lit("")))), F.lit(" "))
    out = None
    for name, words in keywords:
        found = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(found, name) if out is None else out.when(found, name)
    for name, topic in topics.CATEGORY_TOPIC.items():
        out = out.when(category == name, topic)
    return out.otherwise(topics.DEFAULT_TOPIC)


def extract_keywords(question: Column, n: int = 5) -> Column:
    """First n distinct lower-case words of three letters or more that are no stop words."""
    words = F.transform(F.regexp_extract_all(question, F.lit(r"\b([a-zA-Z]{3,})\b"), 1), F.lower)
    stop = F.array(*[F.lit(w) for w in C.KEYWORD_STOPWORDS])
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w))), 1, n)


def event_key(text: Column) -> Column:
    """Lower-case words and numbers without stop words, joined: one key for one event."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z0-9]+)\b"), 1)
    stop = F.array(*[F.lit(w) for w in C.EVENT_KEY_STOPWORDS])
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stop, w)), " ")


def naive_deadline(question: Column, description: Column) -> Column:
    """The older rule, kept for comparison: ``by`` and a month name anywhere in the text."""
    text = F.concat_ws(" ", question, F.nullif(description, F.lit("")))
    return F.when(text.rlike(C.NAIVE_DEADLINE_PATTERN), "deadline_resolved").otherwise("unclassifiable")


def classification_counts(df: DataFrame) -> DataFrame:
    """Rows per assigned type with the number decided by the description alone."""
    return with_resolution_type(df).groupBy("resolution_type").agg(
        F.count("*").alias("n"), F.count_if("description_only").alias("n_description_only"))
