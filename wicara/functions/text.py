"""Text cleaning and normalising as Column expressions.

Java's ``\\w``/``\\s`` differ from the Unicode classes the cleaning rules are defined on, so word
characters are spelled ``[\\p{L}\\p{N}_]`` and white space ``(?U)[\\s\\x1c-\\x1f]``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wicara.functions.columns import as_col, drop_words, let, replace_words, string_array, words
from wicara.functions.emoji import remove_emojis
from wicara.functions.wordlists import PRONOUN_MAP, SLANG_MAP

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
_DIGITS = "[0-9]+(?:_[0-9]+)*"
DECIMAL = (
    rf"(?U)\A[{SPACE}]*[+-]?(?:(?i:inf(?:inity)?|nan)"
    rf"|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)[{SPACE}]*\z"
)


def _replace(text: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_col(text), F.lit(pattern), F.lit(replacement))


def clean_ascii(text: Column | str) -> Column:
    """Lower-case and keep ``a-z0-9`` words separated by single spaces; null becomes empty."""
    lowered = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.trim(_replace(lowered, "[^a-z0-9]+", " "))


def normalize_tokens(text: Column | str, mapping: Mapping[str, str] = PRONOUN_MAP) -> Column:
    """ASCII-clean the text and replace informal pronouns and negations."""
    return F.array_join(normalized_words(text, mapping), " ")


def normalized_words(text: Column | str, mapping: Mapping[str, str] = PRONOUN_MAP) -> Column:
    return replace_words(words(clean_ascii(text)), mapping)


def strip_urls(text: Column | str) -> Column:
    return _replace(text, rf"(?U)http[^{SPACE}]+|www[^{SPACE}]+", " ")


def strip_html(text: Column | str) -> Column:
    return _replace(text, "<[^>]+>", " ")


def strip_mentions(text: Column | str) -> Column:
    return _replace(text, f"@[{WORD}]+", " ")


def unwrap_hashtags(text: Column | str) -> Column:
    return _replace(text, f"#([{WORD}]+)", "$1")


def strip_punct(text: Column | str) -> Column:
    return _replace(text, f"(?U)[^{WORD}{SPACE}]", " ")


def collapse_repeats(text: Column | str) -> Column:
    """Shrink runs of three or more of one character (other than a line feed) to one."""
    return _replace(text, r"(?d)(.)\1{2,}", "$1")


def squeeze_ws(text: Column | str) -> Column:
    return F.trim(_replace(text, f"(?U)[{SPACE}]+", " "))


def clean_unicode(text: Column | str) -> Column:
    """Full cleaning for model input: emoji, URL, tag, mention, hashtag, punctuation, repeats."""
    value = F.lower(F.coalesce(as_col(text), F.lit("")))
    for step in (
        remove_emojis,
        strip_urls,
        strip_html,
        strip_mentions,
        unwrap_hashtags,
        strip_punct,
        collapse_repeats,
        squeeze_ws,
    ):
        value = step(value)
    return value


def slang_normalize(text: Column | str, mapping: Mapping[str, str] = SLANG_MAP) -> Column:
    """Replace slang tokens once; replacements are not looked up again."""
    return F.array_join(replace_words(words(text), mapping), " ")


def remove_stopwords(text: Column | str, stopwords: Iterable[str]) -> Column:
    """Drop listed words, case-sensitively, keeping order and repeats."""
    stop = sorted(set(stopwords))
    tokens = words(text)
    return F.array_join(drop_words(tokens, stop) if stop else tokens, " ")


def is_blank(text: Column | str) -> Column:
    """True for null, empty and white-space-only texts."""
    value = as_col(text)
    return value.isNull() | value.rlike(f"(?U)^[{SPACE}]*$")


def safe_float(value: Column | str, default: float = 0.0) -> Column:
    """Double value of a string or number, or ``default`` where it has none.

    Strings hold a decimal number: digits may be grouped by single underscores; suffixes and
    hexadecimal forms are none.
    """
    column = as_col(value)
    text = column.cast("string")
    plain = F.when(text.rlike(DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    number = F.when(F.typeof(column) == "string", plain).otherwise(column.try_cast("double"))
    return F.coalesce(number, F.lit(float(default)))


def token_set_counts(tokens: Column, groups: Iterable[Iterable[str]]) -> Column:
    """Number of distinct tokens falling in each word group, as an array of doubles."""
    return let(
        F.array_distinct(tokens),
        lambda distinct: F.array(
            *[
                F.size(F.array_intersect(distinct, string_array(group))).cast("double")
                for group in groups
            ]
        ),
    )
