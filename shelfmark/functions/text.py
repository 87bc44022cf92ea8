"""Column expressions for text, titles, links and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Classic English stop-word list of the full-text engine.
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
)
# Languages written without spaces, where a one-letter term counts.
SHORT_WORD_LANGUAGES = ("ja", "zh")
# The scripts of those languages, as parts of a character class.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
# Shortest term used in a similarity query.
MIN_WORD_LENGTH = 4
# Separators that split one subject into several.
SUBJECT_SEPARATORS = r'--|[:;,)(/".]'


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokenize_pairs(text: Column) -> Column:
    """Overlapping pairs of characters of what is written without spaces, other runs of letters and digits as they are."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{UNSPACED}]+|[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(
        runs, lambda r: F.when((F.length(r) > 1) & r.rlike(f"^[{UNSPACED}]"), pairs(r)).otherwise(F.array(r))))


#: Tokenizers of single languages; all others are split by ``tokenize``.
TOKENIZERS: dict[str, Callable[[Column], Column]] = dict.fromkeys(SHORT_WORD_LANGUAGES, tokenize_pairs)


def tokenize_as(text: Column, lang: Column, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Terms of a text by the tokenizer of its language."""
    terms = tokenize(text)
    for name, tokenizer in (TOKENIZERS if tokenizers is None else tokenizers).items():
        terms = F.when(lang == name, tokenizer(text)).otherwise(terms)
    return terms


def clean_tokens(text: Column) -> Column:
    """English tokens of three or more plain letters that are no stop words."""
    return F.filter(
        tokenize(text),
        lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]+$") & ~t.isin(*ENGLISH_STOP_WORDS),
    )


def min_word_length(lang: Column) -> Column:
    return F.when(lang.isin(*SHORT_WORD_LANGUAGES), 1).otherwise(MIN_WORD_LENGTH)


def normalized_title(title: Column) -> Column:
    """Text before the last comma; a missing title counts as empty."""
    return F.coalesce(F.regexp_replace(title, r",[^,]*\z", ""), F.lit(""))


def domain_of(uri: Column) -> Column:
    """The part of a link before the first slash at zero-based index ten or later."""
    slash = F.locate("/", uri, 11)
    return F.when(slash > 0, F.substring(uri, F.lit(1), slash - 1)).otherwise(uri)


def same_domain(uri: Column, source_uri: Column) -> Column:
    """Prefix test: does ``uri`` start with the domain part of ``source_uri``?"""
    return F.startswith(uri, domain_of(source_uri))


def split_subjects(subject: Column) -> Column:
    """Lower-cased, trimmed, non-empty pieces of a subject in order."""
    pieces = F.transform(F.split(F.lower(subject), SUBJECT_SEPARATORS), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: F.length(p) > 0)


def tag_pair_filter(a: Column, b: Column) -> Column:
    """Both tags in binary order, joined by a slash."""
    return F.concat_ws("/", F.least(a, b), F.greatest(a, b))


def surrogate_text(title: Column, description: Column) -> Column:
    """Title directly followed by the description, as used for clustering."""
    return F.concat(title, description)
