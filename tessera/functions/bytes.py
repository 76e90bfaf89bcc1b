"""Byte and hash expressions, all inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(data: Column, offset: int | Column, width: int) -> Column:
    """Big-endian unsigned integer at a zero-based byte offset."""
    start = F.lit(offset + 1) if isinstance(offset, int) else offset + F.lit(1)
    return F.conv(F.hex(F.substring(data, start, F.lit(width))), 16, 10).cast("long")


def to_be(value: Column, width: int) -> Column:
    """The last ``width`` bytes of an integer, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width)))


def score_digits(key: Column, node: Column) -> Column:
    """The first 48 bits of SHA-256 over "key:node", as 12 hex digits; they sort as the numbers do."""
    return F.substring(F.sha2(F.concat_ws(":", key.cast("string"), node.cast("string")).cast("binary"), 256), 1, 12)


def rendezvous_score(key: Column, node: Column) -> Column:
    """The same as a number."""
    return F.conv(score_digits(key, node), 16, 10).cast("long")


def padded(text: Column, width: int) -> Column:
    """Text cut or filled up with blanks to a table's column width."""
    return F.rpad(text, width, " ")


def base64_line(data: Column) -> Column:
    """Base64 without the line breaks that ``base64`` puts after every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def escape_html(text: Column) -> Column:
    """The characters that HTML reserves, as character references."""
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def iso_time(millis: Column) -> Column:
    """UTC time of epoch milliseconds as ISO 8601; the session's time zone is taken to be UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_name(name: Column) -> Column:
    """File-system name of a chunk id."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-\.]", "_")


def human_size(size: Column) -> Column:
    """Sizes in powers of 1024, one decimal, no trailing ".0"."""
    power = F.when(size < 1, 0).otherwise(F.least(F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + F.lit(1e-12)), F.lit(4)))
    number = F.round(size / F.pow(F.lit(1024.0), power), 1)
    text = F.regexp_replace(F.format_string("%.1f", number), r"\.0$", "")
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", text, F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB", "TB"])), (power + 1).cast("int"))))
