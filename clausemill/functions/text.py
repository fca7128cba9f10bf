"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import EDGE, INVISIBLE

# Which tags tell HTML from text, and what can't be read in a text.
KNOWN_TAG = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|section|article|span|a|strong|em|b|i|table|tr|td|body|html|head|main)\b[^>]*>"


def code_points(text: Column) -> Column:
    return F.length(text)


def utf16_index(text: Column, at: Column) -> Column:
    """Code-point offset to UTF-16 offset, clamped to the text."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), F.greatest(F.lit(0), F.least(at, F.length(text)))), "UTF-16LE")) / 2).cast("int")


def prepared(text: Column) -> Column:
    """A pasted text before it is split: line ends alike, at most one blank line, ends trimmed."""
    for old, new in (("\r\n?", "\n"), ("[\f" + chr(0x2029) + "]", "\n\n"), (chr(0x2028), "\n"), ("\n{3,}", "\n\n"), (f"^(?:{EDGE}|{chr(0xFEFF)})+|(?:{EDGE}|{chr(0xFEFF)})+\\z", "")):
        text = F.regexp_replace(text, old, new)
    return text


def has_readable_text(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EDGE, ""), INVISIBLE, ""), r"[\x00-\x1F\x7F]", "")
    return F.length(bare) > 0


def looks_like_html(text: Column) -> Column:
    """At least two known tags before the last closing bracket."""
    last = F.length(text) - F.locate(">", F.reverse(text)) + 1
    upto = F.when(F.locate(">", text) > 0, F.substring(text, F.lit(1), last)).otherwise("")
    return F.regexp_count(upto, F.lit(KNOWN_TAG)) >= 2


def model_name(model: Column) -> Column:
    """family-name-major-minor as words; unknown shapes as they are."""
    shape = r"^claude-([a-z]+)-(\d+)(?:-(\d{1,2}))?$"
    family, major, minor = (F.regexp_extract(model, shape, i) for i in (1, 2, 3))
    named = F.concat(F.lit("Claude "), F.initcap(family), F.lit(" "), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""))
    return F.when(model.isNull() | (model == ""), "the model").when(model.rlike(shape), named).otherwise(model)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """1 clause, 1,234 clauses."""
    return F.concat(F.format_number(F.round(n), 0), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def byte_size(n: Column) -> Column:
    small = F.concat(F.greatest(F.lit(1), F.floor(n / 1000 + 0.5)).cast("string"), F.lit(" kB"))
    return F.when(n.isNull() | (n < 0), "").when(n < 1000000, small).otherwise(F.concat(F.format_string("%.1f", n.cast("double") / 1000000), F.lit(" MB")))


def title(kind: Column, body: Column) -> Column:
    """A document's title from its first segment."""
    flat = F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"^\s+|\s+$", "")
    short = F.concat(F.regexp_replace(F.substring(flat, 1, 57), r"\s+\S*$", ""), F.lit("…"))
    return F.when(body.isNull() | (flat == ""), "Pasted document").when((kind != "heading") & (F.length(flat) > 60), short).otherwise(flat)


def neutralised(text: Column) -> Column:
    """Tags that imitate the frame of a prompt, defused."""
    return F.regexp_replace(text, r"(?i)<(\s*/?\s*document\b)", "&lt;$1")


def lenient_int(text: Column, default: int) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def origins(text: Column) -> Column:
    """A comma-separated list, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def call_deadline(max_tokens: Column) -> Column:
    """Seconds that one call may take in all."""
    return F.lit(60) + max_tokens / 50
