"""Scalar text, number-format and path functions."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.config import VALUE_MISSING
from chartloom.functions import indent

# Fixed pattern: the longest numeric prefix a lenient float reader accepts.
LEADING_NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def token(*parts: Column) -> Column:
    """Eight hex digits derived from the row, so that a rerun gives the same key."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 8)


def data_url(content_type: Column, content: Column) -> Column:
    """Data URL; the line breaks Spark may put into base64 text are taken out again."""
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), encoded)


def last_segment(path: Column) -> Column:
    """Text after the last slash, possibly empty."""
    return F.substring_index(path, "/", -1)


def basename(path: Column) -> Column:
    """File name of a path: trailing slashes are ignored, an empty path is ``.``."""
    trimmed = F.regexp_replace(path, "/+$", "")
    return (
        F.when(path == "", F.lit("."))
        .when(trimmed == "", F.lit("/"))
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def safe_name(name: Column, unique: Column) -> Column:
    return F.concat(unique, F.lit("-"), F.replace(basename(name), F.lit(" "), F.lit("-")))


def drop_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substr(value, F.lit(len(prefix) + 1))).otherwise(value)


def trim_slashes(value: Column) -> Column:
    return F.regexp_replace(value, "^/+|/+$", "")


def leading_number(value: Column) -> Column:
    """Number at the start of a text, NULL when there is none."""
    return F.regexp_extract(value, LEADING_NUMBER, 1).try_cast("double")


def pt_number(value: Column, min_fraction: int = 0) -> Column:
    """pt-BR text with at most three decimals, half-up; NULL and NaN read as not informed."""
    pattern = "#,##0." + "0" * min_fraction + "#" * (3 - min_fraction)
    shown = F.call_function("format_number", F.round(value, 3), F.lit(pattern))
    return F.when(
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")),
        F.translate(shown, ",.", ".,"),
    ).otherwise(F.lit(VALUE_MISSING))


def megabytes(size_bytes: Column) -> Column:
    return F.call_function("format_number", size_bytes / F.lit(1048576.0), F.lit("0.00"))


def capitalize_first(value: Column) -> Column:
    """Upper-case the first character only; the rest is left as it is."""
    return F.concat(F.upper(F.left(value, F.lit(1))), F.substr(value, F.lit(2)))


def initials(name: Column) -> Column:
    firsts = F.transform(F.split(name, r"\s+"), lambda word: F.left(word, F.lit(1)))
    return F.upper(F.left(F.array_join(firsts, ""), F.lit(2)))


def file_kind(name: Column) -> Column:
    extension = F.lower(F.substring_index(name, ".", -1))
    return F.when(extension.isin("pdf", "png"), extension).otherwise(F.lit("jpeg"))


def eye_label(eye: Column) -> Column:
    return F.when(eye == "OS", F.lit("OE")).otherwise(eye)


def join_filled(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither NULL nor empty."""
    return F.concat_ws(separator, *[F.when(part != "", part) for part in parts])


def humanize_key(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def path_escape(value: Column) -> Column:
    """Percent-encode one URL path segment (a space is %20, sub-delimiters of a segment stay)."""
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    for code, char in (
        ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"),
        ("%3A", ":"), ("%3D", "="), ("%40", "@"),
    ):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def report_id(path: Column) -> Column:
    """Identifier of a report address, NULL when the path is not one."""
    return F.nullif(F.regexp_extract(path, "^/relatorios/([^/]+)/?$", 1), F.lit(""))


def percent(done: Column, total: Column) -> Column:
    """Whole percentage, half-up, zero for an empty group."""
    return F.when(total == 0, F.lit(0)).otherwise(
        F.floor(done * F.lit(100.0) / total + F.lit(0.5))
    ).cast("bigint")


# Characters that are written as escapes inside JSON text so that it can stand in HTML.
JSON_ESCAPES = {"<": r"\u003c", ">": r"\u003e", "&": r"\u0026", "\u2028": r"\u2028", "\u2029": r"\u2029"}
#: Kept for callers that go by them: the depth of a token is carried along, so the numbers have no effect.
JSON_RUN, JSON_BLOCK = 16, 16

# Workers get the module with the function, whether they can import the package or not.
cloudpickle.register_pickle_by_value(indent)
_indented = F.arrow_udf(indent.indented, T.StringType())


def pretty_json(value: Column) -> Column:
    """JSON text spread over lines, two spaces a level at any depth; empty objects and arrays stay closed."""
    escaped = value
    for sign, written in JSON_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(sign), F.lit(written))
    return _indented(escaped)
