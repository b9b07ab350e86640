"""Scalar and array expressions used by the operators, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of knowledge origins, predicates and relations of the core vocabulary, and words that make a force's
#: direction explicit.
ORIGIN_RANK = {"physical": 0, "engineering": 1, "architectural": 2, "cultural": 3}
CORE_PREDICATES = ("requires", "depends_on", "protects_from", "unsuitable_for", "improves", "conflicts_with", "contains", "connects_to", "supports")
SPATIAL_RELATIONS = ("adjacent_to", "contains", "connects_to", "accessible_from", "above", "below", "enclosed_by")
INCREASE_WORDS = ("increased", "improved", "enhanced", "maximised", "maximized", "greater", "higher", "more", "better", "stronger", "expanded", "adequate", "sufficient", "optimised", "optimized")
DECREASE_WORDS = ("reduced", "minimised", "minimized", "decreased", "limited", "lower", "less", "fewer", "smaller", "restricted", "constrained", "avoided", "prevented", "eliminated")


def norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def decode_list(c: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def encode_list(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def origin_rank(c: Column) -> Column:
    return reduce(lambda rest, o: F.when(c == o[0], F.lit(o[1])).otherwise(rest), ORIGIN_RANK.items(), F.lit(99))


def in_context(applicability: Column, context: str | None) -> Column:
    """Empty lists apply everywhere; otherwise some entry contains the context, case aside. No context, no filter."""
    if context is None:
        return F.lit(True)
    return (F.size(applicability) == 0) | F.exists(applicability, lambda x: F.contains(F.lower(x), F.lit(context.strip().lower())))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the result is not finite."""
    c = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def review_threshold(n: Column) -> Column:
    """min(50, 5 + n/200), rounded half to even."""
    return F.least(F.lit(50), F.bround(F.lit(5) + n * F.lit(0.005), 0).cast("int"))


def word_forms(word: Column) -> Column:
    """Singular and plural variants of a lower-case word, as an array: ies to y, es and s dropped in long enough words, else s added and y to ies."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    plural = F.when(word.endswith("y") & (n > 2), F.array(F.concat(word, F.lit("s")), F.concat(cut(1), F.lit("ies")))).otherwise(F.array(F.concat(word, F.lit("s"))))
    return (
        F.when(word.endswith("ies") & (n > 4), F.array(F.concat(cut(3), F.lit("y"))))
        .when(word.endswith("ses") & (n > 4), F.array(cut(2)))
        .when(word.endswith("es") & (n > 4), F.array(cut(1), cut(2)))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.array(cut(1)))
        .otherwise(plural)
    )


def has_any_word(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def direction_named(name: Column, direction: Column) -> Column:
    """Whether a force's name holds a word for its direction, as any part of it: increase has its words, all else those of decrease."""
    return F.when(direction == "increase", has_any_word(name, INCREASE_WORDS)).otherwise(has_any_word(name, DECREASE_WORDS))


def parse_date(c: Column, fallback: Column | None = None) -> Column:
    """An ISO date and time, with zone or without, in UTC; what is none is the fallback (by default the time of the query)."""
    return F.coalesce(F.try_to_timestamp(c), F.current_timestamp() if fallback is None else fallback)


def format_date(c: Column) -> Column:
    """ISO text of a timestamp, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def slug(name: Column) -> Column:
    """Lower case, spaces to hyphens, without quotes, commas and full stops."""
    return F.translate(F.lower(name), " ',.", "-")


def assertion_text(predicate: Column, rationale: Column, conditions: Column | None = None) -> Column:
    """What of an assertion is embedded: predicate, its conditions if given, and the rationale, what is empty left out."""
    joined = [] if conditions is None else [F.nullif(F.array_join(conditions, "; "), F.lit(""))]
    return F.concat_ws(" | ", predicate, *joined, F.nullif(rationale, F.lit("")))


def constraint_text(kind: Column, rule: Column) -> Column:
    return F.concat(kind, F.lit(": "), rule)


def pattern_text(name: Column, problem: Column) -> Column:
    return F.concat(name, F.lit(": "), F.substring(problem, 1, 120))


def pattern_section(number: Column) -> Column:
    """The part of the book that a pattern's number lies in (fixed values)."""
    return F.when(number.between(1, 94), "Town and Country").when(number.between(95, 204), "Buildings").when(number.between(205, 253), "Construction").otherwise("Unknown")


def stated_confidence(mark: Column) -> Column:
    """Two stars 1.0, one 0.8, none 0.5."""
    return F.when(mark == "**", 1.0).when(mark == "*", 0.8).otherwise(0.5)


def name_key(*parts: Column) -> Column:
    """A deterministic id from a natural key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
