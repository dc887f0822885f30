"""Column -> Column helpers (H1-H6, H11). All are built-in expressions, so they
stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's for the same results):
# workbook extensions dropped from a table name, case-insensitive
WORKBOOK_EXTENSIONS = ("xlsx", "xls")
# struct fields searched, in this order, for the bytes of a file
CONTENT_FIELDS = ("inline_content", "bytes", "data", "value", "content", "binary")
# a UUID written as 8-4-4-4-12 hex digits, any case
UUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def table_name(path: Column | str) -> Column:
    """H1: safe table name from a file path.

    Last ``/`` part, workbook extension dropped (any case), every character other
    than ``[A-Za-z0-9_]`` replaced by ``_``, surrounding ``_`` trimmed, lower case.
    """
    last = F.element_at(F.split(_col(path), "/"), -1)
    ext = "|".join(WORKBOOK_EXTENSIONS)
    no_ext = F.regexp_replace(last, rf"(?i)\.({ext})$", "")
    safe = F.regexp_replace(no_ext, r"[^a-zA-Z0-9_]", "_")
    return F.lower(F.btrim(safe, F.lit("_")))


def extract_uuid(comment: Column | str) -> Column:
    """H2: first UUID in free text.

    When the text mentions ``site`` or ``id`` (any case): the UUID if there is
    one, else the whole text. Otherwise (or NULL/empty text) the empty string.
    """
    c = _col(comment)
    low = F.lower(c)
    found = F.regexp_extract(c, UUID_PATTERN, 0)
    mentions = low.contains("site") | low.contains("id")
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(mentions, F.when(found != "", found).otherwise(c))
            .otherwise(F.lit("")))


def normalise_content(content: Column, dtype: T.DataType) -> Column:
    """H3: file content to bytes.

    The choice is made at plan time from the column's type: binary as is,
    string decoded as base64 (bad base64 -> NULL instead of a task failure),
    struct -> the first present field of ``CONTENT_FIELDS``, then the same rules.
    """
    if isinstance(dtype, T.BinaryType):
        return content
    if isinstance(dtype, T.StringType):
        return F.try_to_binary(content, F.lit("base64"))
    if isinstance(dtype, T.StructType):
        names = {f.name: f for f in dtype.fields}
        for field in CONTENT_FIELDS:
            if field in names:
                return normalise_content(content.getField(field), names[field].dataType)
        return F.lit(None).cast("binary")
    return F.lit(None).cast("binary")


def content_type_error(dtype: T.DataType) -> bool:
    """True when ``normalise_content`` cannot produce bytes for this type."""
    if isinstance(dtype, (T.BinaryType, T.StringType)):
        return False
    if isinstance(dtype, T.StructType):
        names = {f.name: f for f in dtype.fields}
        for field in CONTENT_FIELDS:
            if field in names:
                return content_type_error(names[field].dataType)
    return True


def parse_iso(text: Column | str) -> Column:
    """H4: ISO 8601 text (``T`` or space separator, optional fraction) -> timestamp.
    Unreadable text gives NULL."""
    t = F.regexp_replace(_col(text), "T", " ")
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
    )


def format_iso(ts: Column | str) -> Column:
    """H4: timestamp -> ISO 8601 text, as Python's ``isoformat()`` prints it."""
    c = _col(ts)
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(
        micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def default_if_null(c: Column | str, default) -> Column:
    """H6: ``coalesce`` with a literal default."""
    return F.coalesce(_col(c), F.lit(default))


def qualify(catalog: Column | str, schema: Column | str, table: Column | str) -> Column:
    """``catalog.schema.table``."""
    return F.concat_ws(".", _col(catalog), _col(schema), _col(table))
