"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: all but letters, numbers and the underscore.
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}_]+"
_WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Thresholds and lengths that results depend on.
CONTEXT_CHARS = 1200
LABEL_CHARS = 180
SNIPPET_BEFORE, SNIPPET_LENGTH = 80, 220
REDACTED = "[redacted]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_white(c) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(col(c), f"^{_WHITE}+|{_WHITE}+$", "")


def trim_white_start(c) -> Column:
    return F.regexp_replace(col(c), f"^{_WHITE}+", "")


def lines(c) -> Column:
    """Lines of a text: split at line feeds, each without one carriage return before it; '' has none, a last line feed ends no line."""
    text = col(c)
    body = F.when(F.endswith(text, F.lit("\n")), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)
    split = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def words(c) -> Column:
    """Words of more than one byte, as they stand."""
    return F.filter(F.split(col(c), NOT_WORD), lambda w: F.octet_length(w) > 1)


def query_terms(c) -> Column:
    """Search terms: lower-cased words of more than one byte; repeated words stay."""
    return F.transform(words(c), lambda w: F.lower(w))


def split_identifier(c) -> Column:
    """Camel-case parts of a word, then the word itself."""
    marked = F.regexp_replace(col(c), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "\u0001")
    return F.concat(F.split(marked, "\u0001"), F.array(col(c)))


def tokens(c) -> Column:
    """What a text is embedded by: the parts of each word and the word, lower-cased."""
    return F.transform(F.flatten(F.transform(words(c), split_identifier)), lambda w: F.lower(w))


def occurrences(haystack, needle) -> Column:
    """How often needle stands in haystack without overlap."""
    h, n = col(haystack), col(needle)
    return F.when(F.length(n) == 0, F.lit(0)).otherwise(((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("int"))


def score_text(haystack, terms: Column) -> Column:
    """Mean over the terms of 1 + ln(occurrences), 0 for a term that does not occur."""
    counts = F.transform(F.array(col(haystack)), lambda h: F.transform(terms, lambda t: occurrences(h, t)))[0]  # makes the haystack once, not for each term
    total = F.aggregate(
        counts,
        F.lit(0.0),
        lambda acc, n: acc + F.when(n > 0, 1 + F.ln(n.cast("double"))).otherwise(0.0),
    )
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(0.0)


def haystack(title, content) -> Column:
    return F.lower(F.concat(col(title), F.lit("\n"), col(content)))


def snippet(content, terms: Column) -> Column:
    """A window that starts 80 characters before the first term and has 220, on one line."""
    text = col(content)
    low = F.lower(text)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda i: i > 0))
    start = F.greatest(F.coalesce(first - 1, F.lit(0)) - SNIPPET_BEFORE, F.lit(0))
    return trim_white(F.replace(text.substr(start + 1, F.lit(SNIPPET_LENGTH)), F.lit("\n"), F.lit(" ")))


def context_snippet(content) -> Column:
    return trim_white(F.substring(col(content), 1, CONTEXT_CHARS))


def truncate_snippet(c) -> Column:
    short = trim_white(c)
    return F.when(F.length(short) > LABEL_CHARS, F.concat(F.substring(short, 1, LABEL_CHARS), F.lit("..."))).otherwise(short)


def redact_token(t: Column) -> Column:
    low = F.lower(t)
    odd = F.startswith(t, F.lit("sk-"))
    for start in ("api_key=", "apikey=", "token="):
        odd = odd | F.startswith(low, F.lit(start))
    return F.when(odd, REDACTED).otherwise(t)


def redact_secrets(c) -> Column:
    """Words joined by single spaces, those that look like keys replaced."""
    parts = F.filter(F.split(col(c), f"{_WHITE}+"), lambda t: t != "")
    return F.array_join(F.transform(parts, redact_token), " ")


def clean_summary(c) -> Column:
    """Generated text without code, markup and heading words: at most 40 lines and 2400 characters."""
    kept = F.filter(F.transform(lines(c), trim_white), lambda x: x != "")
    low = lambda x: F.lower(x)
    kept = F.filter(
        kept,
        lambda x: ~(low(x).startswith("import ") | low(x).startswith("export ") | low(x).startswith("from ") | low(x).contains("```") | low(x).startswith("<")),
    )
    kept = F.filter(kept, lambda x: ~F.lower(trim_white(F.regexp_replace(x, "^#+", ""))).isin("assistant:", "summary"))
    return F.substring(F.array_join(F.slice(kept, 1, 40), "\n"), 1, 2400)


def heading_slug(c) -> Column:
    """A heading as an anchor: lower case, other signs gone, white space as one hyphen."""
    return F.regexp_replace(trim_white(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s-]", "")), r"\s+", "-")


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def wikilinks(c) -> Column:
    """Targets of [[links]], trimmed."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(x))
