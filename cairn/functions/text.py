"""Column functions over text: trimming, titles, search terms, masking, validation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Key fragments whose values are never shown.
SENSITIVE_FRAGMENTS = ("password", "secret", "token", "credential", "apikey", "api_key")
CONFIG_SECRET_FRAGMENTS = ("password", "secret", "token", "api-key", "apikey", "credential")
DEFAULT_TITLE = "New conversation"
PROJECT_KEY_PATTERN = "^[a-z0-9][a-z0-9_-]{1,63}$"
PROJECT_NAME_LIMIT = 120
PROJECT_DESCRIPTION_LIMIT = 500


WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Text without any whitespace at its ends (a plain trim removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def non_blank(c: Column) -> Column:
    """Stripped value, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """First non-blank value, trimmed; empty when all are blank."""
    return F.coalesce(*[non_blank(c) for c in columns], F.lit(""))


def title(c: Column, limit: int = 80) -> Column:
    text = F.coalesce(non_blank(c), F.lit(DEFAULT_TITLE))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def abbreviate(c: Column, limit: int, marker: str = "", inside: bool = False) -> Column:
    """Cut to ``limit`` characters; ``inside`` counts the marker as part of the limit."""
    keep = limit - len(marker) if inside else limit
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, keep), F.lit(marker)))


def compact(c: Column, limit: int) -> Column:
    """Single-line summary: runs of whitespace become one blank, long text is cut."""
    flat = strip(F.regexp_replace(c, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def unquote(c: Column) -> Column:
    trimmed = strip(c)
    return F.regexp_replace(trimmed, "^(?s)(['\"])(.*)\\1$", "$2")


def placeholder_default(c: Column) -> Column:
    """``${NAME:value}`` gives ``value``; other literals are only unquoted."""
    plain = unquote(c)
    return F.when(plain.rlike("^(?s)\\$\\{[^:]*:.*\\}$"), F.regexp_extract(plain, "^(?s)\\$\\{[^:]*:(.*)\\}$", 1)).otherwise(plain)


def _contains_any(c: Column, fragments) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.contains(c, F.lit(fragment))
    return hit


def contains_any(c: Column, fragments) -> Column:
    return _contains_any(c, fragments)


def mask_properties(props: Column) -> Column:
    """Values of sensitive keys become asterisks."""
    return F.transform_values(
        props, lambda k, v: F.when(_contains_any(F.lower(k), SENSITIVE_FRAGMENTS), F.lit("******")).otherwise(v)
    )


def redact_config(key: Column, value: Column) -> Column:
    hidden = _contains_any(F.lower(key), CONFIG_SECRET_FRAGMENTS)
    return F.when(hidden, "[REDACTED]").otherwise(abbreviate(unquote(value), 300, "...", inside=True))


def contains_ignoring_case(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def search_terms(query: Column) -> Column:
    """Quoted phrases or words; the last spelling of a term wins, longest terms first."""
    tokens = F.regexp_extract_all(query, F.lit('("[^"]+"|\\S+)'), F.lit(1))
    terms = F.filter(
        F.transform(tokens, lambda t: strip(F.when(t.rlike('^".*"$') & (F.length(t) > 1),
                                                     F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))),
        lambda t: t != "",
    )
    reversed_terms = F.reverse(terms)
    last = F.filter(
        reversed_terms,
        lambda t, i: F.array_position(F.transform(reversed_terms, lambda r: F.lower(r)), F.lower(t)) == i + 1,
    )
    return F.array_sort(
        last, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1).when(a > b, 1).otherwise(0)
    )


def term_pattern(terms: Column) -> Column:
    """Case-insensitive alternation of literal terms."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, "([.*+?^$(){}|\\[\\]\\\\])", "\\\\$1"))
    return F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")"))


def pattern_of(spark: SparkSession, query: str) -> str:
    """The pattern of one given query as a plain string, so that rows need not build it again."""
    return spark.range(1).select(term_pattern(search_terms(F.lit(query)))).first()[0]


def valid_project(key: Column, name: Column, description: Column) -> Column:
    return (
        F.coalesce(F.lower(F.trim(key)).rlike(PROJECT_KEY_PATTERN), F.lit(False))
        & F.coalesce(non_blank(name).isNotNull() & (F.length(F.trim(name)) <= PROJECT_NAME_LIMIT), F.lit(False))
        & (F.length(F.coalesce(F.trim(description), F.lit(""))) <= PROJECT_DESCRIPTION_LIMIT)
    )


def json_list(c: Column) -> Column:
    """JSON array of strings; bad or blank JSON is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))
