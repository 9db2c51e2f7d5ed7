"""Text features of source files and issues as Column expressions.

Everything is a built-in function on the row itself; no rule shuffles. Rules about lines, words or sentences take the
array of them, so that a plan with several such rules splits a text once (see plans.files).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# Patterns. The lookahead only skips positions at which no alternative can begin.
FUNCTION_PATTERN = (
    r"(?=[dfvicslbS])\b(?:def\s+\w+|function\b\s*\w*"
    r"|(?:void|int|float|double|char|short|long|bool|String|string)\s+\w+|func?\s+\w+)\s*\("
)
FUNCTION_WORDS_PATTERN = r"(?=[dfvicsS])\b(?:def|function|func|void|int|String|char|string)\b"
FUNCTION_WORDS_SHORT_PATTERN = r"(?=[fdcm])\b(?:function|def|class|method)\b"
COMMENT_PATTERN = r"#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"
COMMENT_DOTALL_PATTERN = r"(?s)#.*|//.*|/\*.*?\*/"
COMMENT_SLASH_PATTERN = r"//[^\n]*|/\*[\s\S]*?\*/"
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

_LINE_START = r"(?:^|\n)"
_DEF_PATTERN = _LINE_START + r"[ \t]*def[ \t]+\w+"
_DECISION_PATTERN = r"\b(?:if|elif|for|while|except|and|or|assert)\b"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


# --- names and languages -------------------------------------------------------------------------
def text_length(text: Column) -> Column:
    """Characters of a text; null counts as empty."""
    return F.coalesce(F.length(text), F.lit(0))


def extension(name: Column) -> Column:
    """Text after the last dot; the whole name if there is none."""
    return F.substring_index(name, ".", -1)


def language_of(name: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Language detected from a file name; null when unknown."""
    return _lookup(mapping or tables.DETECTED_LANGUAGE, extension(name))


def language_or_unknown(ext: Column) -> Column:
    return F.coalesce(_lookup(tables.EXTENSION_LANGUAGE, F.lower(ext)), F.lit("Unknown"))


def extension_of_language(language: Column) -> Column:
    mapping = {name: "." + ext for ext, name in tables.EXTENSION_LANGUAGE.items()}
    return F.coalesce(_lookup(mapping, language), F.lit("Unknown language"))


def family_extension(name: Column) -> Column:
    return _lookup(tables.FAMILY_EXTENSION, extension(name))


def repository_owner(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(1))


def repository_short_name(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(2))


# --- lines ---------------------------------------------------------------------------------------
def normalise_newlines(text: Column) -> Column:
    """What reading in text mode does to line ends."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines as a line-by-line read yields them: an unfinished last line counts, an empty text has none."""
    unfinished = (F.octet_length(text) > 0) & ~F.endswith(text, F.lit("\n"))
    return newline_count(text) + unfinished.cast("int")


def split_line_count(text: Column) -> Column:
    """Lines when every Unicode line boundary ends one."""
    closed = F.rlike(F.right(text, F.lit(1)), F.lit(LINE_BREAK_PATTERN))
    return _count(text, LINE_BREAK_PATTERN) + ((F.octet_length(text) > 0) & ~closed).cast("int")


def lines_of(text: Column) -> Column:
    """The pieces between line feeds; a text that ends with one has an empty last piece."""
    return F.split(text, "\n")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    flags = [F.contains(text, F.lit(word)) for word in words]
    return reduce(lambda a, b: a | b, flags)


def lines_with(lines: Column, words: list[str]) -> Column:
    """Lines that contain any of the words as a substring."""
    return F.size(F.filter(lines, lambda line: contains_any(line, words)))


def function_line_count(lines: Column) -> Column:
    return lines_with(lines, ["def ", "function "])


def comment_line_count(lines: Column, block: bool = False) -> Column:
    pattern = r"^\s*(?:#|//|/\*)" if block else r"^\s*(?:#|//)"
    return F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(pattern))))


def issue_line_count(lines: Column, keywords: Mapping[str, list[str]] | None = None) -> Column:
    words = [word for group in (keywords or tables.ISSUE_KEYWORDS).values() for word in group]
    return lines_with(lines, words)


def long_line_count(lines: Column, limit: Column) -> Column:
    return F.size(F.filter(lines, lambda line: F.length(line) > limit))


# --- functions, comments, imports ----------------------------------------------------------------
def function_count(text: Column) -> Column:
    return _count(text, FUNCTION_PATTERN)


def function_word_count(text: Column) -> Column:
    return _count(text, FUNCTION_WORDS_PATTERN)


def function_word_count_short(text: Column) -> Column:
    return _count(text, FUNCTION_WORDS_SHORT_PATTERN)


def comment_count(text: Column, dotall: bool = False) -> Column:
    """Comments of all languages; with ``dotall`` the first ``#`` or ``//`` swallows the rest of the text."""
    return _count(text, COMMENT_DOTALL_PATTERN if dotall else COMMENT_PATTERN)


def slash_comment_count(text: Column) -> Column:
    return _count(text, COMMENT_SLASH_PATTERN)


def import_count(text: Column) -> Column:
    return _count(text, _LINE_START + r"[ \t]*(?:import|from)[ \t]")


def python_function_count(text: Column) -> Column:
    return _count(text, _DEF_PATTERN)


def docstring_count(text: Column) -> Column:
    return _count(text, _LINE_START + r"[ \t]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')")


def function_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(?:def|function|func|fun)[ \t]+(\w+)[ \t]*\("), F.lit(1))


def method_names(text: Column) -> Column:
    """Method names of brace languages: a name after a type or modifier, followed by a parameter list."""
    pattern = r"\b(?:public|private|protected|static|void|int|long|double|boolean|String)[ \t]+(\w+)[ \t]*\("
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def cyclomatic_complexity(text: Column) -> Column:
    """Mean over ``def`` blocks of 1 + decision keywords; 0 without blocks. An approximation by counting words."""
    blocks = python_function_count(text)
    body = F.regexp_extract(text, "(?s)" + _DEF_PATTERN + ".*", 0)
    return F.when(blocks > 0, F.lit(1.0) + _count(body, _DECISION_PATTERN) / blocks).otherwise(F.lit(0.0))


# --- keywords ------------------------------------------------------------------------------------
def keyword_table(spark: SparkSession, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(ext, keyword) rows of the dictionaries; a user's own table of this shape works everywhere it does."""
    rows = [(ext, word) for ext, words in (keywords or tables.LANGUAGE_KEYWORDS).items() for word in words]
    return spark.createDataFrame(rows, "ext string, keyword string")


def keywords_of(ext: Column, keywords: Mapping[str, list[str]] | None = None) -> Column:
    """Keyword array of an extension; empty for unknown ones. The map folds into a literal."""
    pairs = []
    for name, words in (keywords or tables.LANGUAGE_KEYWORDS).items():
        pairs += [F.lit(name), F.array(*[F.lit(word) for word in words])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.array().cast("array<string>"))


def substring_keyword_count(text: Column, words: Column) -> Column:
    """Sum over words of their non-overlapping occurrences anywhere in the text."""

    def add(total: Column, word: Column) -> Column:
        removed = F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))
        return total + F.floor(removed / F.octet_length(word)).cast("long")

    return F.aggregate(words, F.lit(0).cast("long"), add)


def token_keyword_count(text: Column, words: Column) -> Column:
    """Whitespace-separated tokens that equal a word."""
    tokens = F.split(text, r"\s+")
    return F.size(F.filter(tokens, lambda token: F.array_contains(words, token)))


# --- labels --------------------------------------------------------------------------------------
def multi_label(title: Column, body: Column, keywords: Mapping[str, list[str]] | None = None) -> Column:
    """All labels with a keyword in title or body, sorted and joined; ``other`` without any."""
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    names = sorted(keywords or tables.ISSUE_KEYWORDS)
    words = keywords or tables.ISSUE_KEYWORDS
    # One lower-cased text serves all labels: it is the single element the outer transform walks.
    found = F.transform(F.array(both), lambda t: F.array_join(F.array_compact(F.array(
        *[F.when(contains_any(t, words[name]), F.lit(name)) for name in names])), ", "))
    return F.coalesce(F.nullif(F.get(found, F.lit(0)), F.lit("")), F.lit("other"))


def chunks(text: Column, size: int = tables.CHUNK_CHARS) -> Column:
    """The text cut into pieces of ``size`` characters; an empty text has none."""
    pieces = F.ceil(F.length(text) / F.lit(size)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(text, i * size + F.lit(1), F.lit(size))
    )
    return F.when(pieces > 0, cut).otherwise(F.array().cast("array<string>"))


def over_chunks(text: Column, size: int, split: Callable[[Column], Column]) -> Column:
    """Split every piece of the text on its own: a cut between pieces also cuts what it falls into."""
    return F.when(F.length(text) <= size, split(text)).otherwise(F.flatten(F.transform(chunks(text, size), split)))


def words_of(text: Column, size: int = tables.CHUNK_CHARS) -> Column:
    return over_chunks(text, size, lambda piece: F.regexp_extract_all(piece, F.lit("[a-z]+"), F.lit(0)))


def sentences_of(text: Column, size: int = tables.CHUNK_CHARS) -> Column:
    return over_chunks(text, size, lambda piece: F.split(piece, r"[.!?\n]"))


def issue_text(title: Column, body: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def _count_where(array: str, test: Callable[[Column, list[str]], Column], words: list[str]) -> Column:
    return F.size(F.filter(array, lambda item: test(item, words)))


def strongest_label(counts: Mapping[str, Column], default: str | None) -> Column:
    """Label with the most hits; the first one in the mapping's order wins ties."""
    best = F.greatest(*counts.values())
    result = F.when(best <= 0, F.lit(default))
    for label, count in counts.items():
        result = result.when(count == best, F.lit(label))
    return result


def with_label(
    df: DataFrame,
    title: str,
    body: str,
    out: str = "label",
    contains: bool = False,
    keywords: Mapping[str, list[str]] | None = None,
    size: int = tables.CHUNK_CHARS,
) -> DataFrame:
    """Add the single label of an issue: the one most words and sentences speak for.

    A word counts if it equals a keyword, a sentence if it contains one; ``other`` without any hit. ``contains``
    selects the variant that counts words containing a keyword, no sentences, and yields null without any hit.
    """
    keywords = keywords or tables.LABEL_KEYWORDS
    kept = df.columns
    every = [word for group in keywords.values() for word in group]
    df = df.withColumn("_text", issue_text(F.col(title), F.col(body)))
    words = words_of(F.col("_text"), size)
    if contains:
        df = df.withColumn("_words", words)
        hits = {k: _count_where("_words", contains_any, group) for k, group in keywords.items()}
    else:
        df = df.withColumns({
            # The few words that are keywords at all, found by one hash lookup each.
            "_words": F.filter(words, lambda w: w.isin(every)),
            "_sentences": sentences_of(F.col("_text"), size),
        })
        hits = {
            k: _count_where("_words", Column.isin, group) + _count_where("_sentences", contains_any, group)
            for k, group in keywords.items()
        }
    df = df.withColumns({f"_hits_{label}": count for label, count in hits.items()})
    counts = {label: F.col(f"_hits_{label}") for label in keywords}
    return df.select(*kept, strongest_label(counts, None if contains else "other").alias(out))
