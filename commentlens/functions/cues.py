"""Surface cues in a comment and the rule that explains an uncertain one."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens import constants as C


def _contains_any(text: Column, parts: Iterable[str]) -> Column:
    # Much faster than one pattern of alternatives.
    return reduce(Column.__or__, [text.contains(part) for part in parts])


def has_emoji(text: Column) -> Column:
    return _contains_any(text, C.CUE_EMOJI)


def has_quotes(text: Column) -> Column:
    return text.contains('"') | text.contains("'")


def has_exclamation(text: Column) -> Column:
    return text.contains("!")


def has_question(text: Column) -> Column:
    return text.contains("?")


def has_negation(text: Column, whole_words: bool = False) -> Column:
    """By default a substring test, so that "know" counts; optionally whole words only."""
    if not whole_words:
        return _contains_any(F.lower(text), C.NEGATION_WORDS)
    # The look-ahead spares the costlier look-behind at almost every character.
    initials = "".join(sorted({w[0] for w in C.NEGATION_WORDS}))
    words, letter = "|".join(C.NEGATION_WORDS), r"[\p{L}\p{N}_]"
    return F.lower(text).rlike(f"(?=[{initials}])(?<!{letter})(?:{words})(?!{letter})")


def text_cues(df: DataFrame, content: str = "content", whole_words: bool = False) -> DataFrame:
    text = F.col(content)
    return df.withColumns(
        {
            "has_emoji": has_emoji(text),
            "has_quotes": has_quotes(text),
            "has_exclamation": has_exclamation(text),
            "has_negation": has_negation(text, whole_words),
            "has_question": has_question(text),
        }
    )


def explanation(
    content: Column,
    sarcasm: Column,
    stance: Column,
    confidence: Column,
    whole_words: bool = False,
    clear_sarcasm: float = C.CLEAR_SARCASM,
    low_confidence: float = C.LOW_CONFIDENCE,
    likely_sarcasm: float = C.LIKELY_SARCASM,
    some_doubt: float = C.SOME_DOUBT,
    little_sarcasm: float = C.LITTLE_SARCASM,
) -> Column:
    """First rule that holds names the explanation.

    The first rule decides by stance alone: an unlisted stance gets NULL there and
    does not fall through to the later rules.
    """
    by_stance = (
        F.when(stance == C.CRITICIZES, C.SARCASTIC_CRITICISM)
        .when(stance == C.BELIEVES, C.IRONIC_ENDORSEMENT)
        .when(stance == C.NEUTRAL, C.AMBIGUOUS_TONE)
    )
    return (
        F.when((sarcasm > clear_sarcasm) & (confidence < low_confidence), by_stance)
        .when(has_question(content) & (sarcasm > likely_sarcasm), C.SARCASTIC_QUESTION)
        .when(has_emoji(content) & (sarcasm > likely_sarcasm), C.SARCASTIC_EMOJI)
        .when(has_negation(content, whole_words) & (confidence < some_doubt), C.SKEPTICAL)
        .when(has_exclamation(content) & (sarcasm < little_sarcasm), C.STRONG_EMOTION)
        .otherwise(C.NEEDS_REVIEW)
    )


def stripped(text: Column) -> Column:
    """Without leading and trailing whitespace of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^(?U:\s*)$")
