"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters text is trimmed of.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# Date formats read besides ISO, month before day where both could be meant, each with the shape it needs.
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]


def strip(c: Column) -> Column:
    """Trim all kinds of blanks on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def month_start(ts: Column) -> Column:
    """First instant of the month, without a zone."""
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def years_between(birth: Column, at: Column) -> Column:
    """Completed years, counting a birthday only once month and day have been reached."""
    not_yet = (F.month(at) < F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.day(at) < F.day(birth)))
    return (F.year(at) - F.year(birth) - not_yet.cast("int")).cast("bigint")


def seconds_between(start: Column, stop: Column) -> Column:
    return F.timestamp_diff("SECOND", start, stop)


def mean(total: Column, n: Column) -> Column:
    """Exact total divided by a count, as a double (NULL when the count is 0)."""
    return total.cast("double") / F.nullif(n, F.lit(0))


def key_mix(key: Column) -> Column:
    """Fixed 32-bit integer mix of a key, used where a repeatable shuffle order is needed.

    Whole numbers are multiplied; any other text is taken by the first digits of its MD5.
    """
    text = key.cast("string")
    number = text.try_cast("bigint")
    folded = F.pmod(number, F.lit(2147483648))  # keeps the product inside 64 bits
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.when(number.isNotNull(), (folded * F.lit(2654435761)) % F.lit(4294967296)).otherwise(digits)


def to_number(c: Column) -> Column:
    """Text to double; anything unreadable is NULL."""
    return F.trim(c.cast("string")).try_cast("double")


def to_instant(c: Column) -> Column:
    """Text to timestamp without zone: ISO first, then ``DATE_FORMATS`` in order; anything unreadable is NULL."""
    text = F.trim(c.cast("string"))
    others = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")) for shape, form in DATE_FORMATS]
    return F.coalesce(text.try_cast("timestamp_ntz"), *others)


def safe_id(name: Column) -> Column:
    """Folder-safe id of a tenant name."""
    lowered = F.lower(strip(name))
    squeezed = F.regexp_replace(lowered, r"[^a-z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.btrim(squeezed, F.lit("_")), F.lit("")), F.lit("unnamed"))


def clean_text(text: Column) -> Column:
    """Normalise line ends, runs of blanks and runs of empty lines; NULL becomes ''."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    narrow = F.regexp_replace(unix, "[ \t]+", " ")
    capped = F.regexp_replace(narrow, "\n{3,}", "\n\n")
    return strip(capped)


def citation_label(source: Column, title: Column, doc_id: Column) -> Column:
    """``SOURCE: title``, or ``SOURCE (doc 12345678)`` when there is no usable title."""
    upper = F.upper(F.coalesce(source, F.lit("unknown")))
    usable = title.isNotNull() & (title != "") & (title != "None")
    return F.when(usable, F.concat(upper, F.lit(": "), title)).otherwise(
        F.concat(upper, F.lit(" (doc "), F.substring(doc_id, 1, 8), F.lit(")"))
    )
