"""Polarity of comments from a lexicon table of (word, polarity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join


def comment_polarity(comments: DataFrame, lexicon: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Mean polarity of the known words of each comment; comments without any are absent from the result."""
    words = comments.select(*keys, F.explode(F.regexp_extract_all(F.lower(body), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    scored = lookup_join(words, lexicon.select("word", "polarity"), ["word"], how="inner")
    return scored.groupBy(*keys).agg(F.avg("polarity").alias("polarity"))


def pull_sentiment(comments: DataFrame, lexicon: DataFrame, pull_keys: list[str], comment_keys: list[str],
                   body: str = "body") -> DataFrame:
    """Sum of comment polarities per pull request."""
    polarity = comment_polarity(comments, lexicon, pull_keys + comment_keys, body)
    return polarity.groupBy(*pull_keys).agg(F.sum("polarity").alias("review_sentiment_score"))
