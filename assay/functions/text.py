"""Text expressions: formats, names, JSON-safe samples, spreadsheet-safe cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value formats in tie-break order, with their patterns.
VALUE_FORMATS = (
    ("EMAIL", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("UUID", r"^[0-9A-Fa-f-]{36}$"),
    ("DATE_ISO", r"^\d{4}-\d{2}-\d{2}$"),
    ("DATE_US", r"^\d{2}/\d{2}/\d{4}$"),
    ("PHONE", r"^\+?[\d\s\-\(\)]{7,15}$"),
)
FORMAT_COVERAGE_PCT = 80

# Schema prefixes dropped before comparing table names.
TABLE_PREFIX = r"^(br|bz|raw|stg|src|sl|gl|bronze|silver|gold)_"

# Names that look like keys.
KEY_LIKE = r"(?i)(^id$|_id$|id$|_key$|key$)"
RELATION_KEY_LIKE = r"(?i)(_id|id|key|code)$"


def format_from_counts(matches: dict[str, Column], filled: Column) -> Column:
    """Dominant format of a column from per-format match counts.

    No value at all is UNKNOWN, no match STRING, a best match below 80 %
    coverage MIXED; the first format in ``VALUE_FORMATS`` order wins ties.
    """
    best = F.greatest(*[matches[name] for name, _ in VALUE_FORMATS])
    winner = F.coalesce(*[F.when(matches[n] == best, F.lit(n)) for n, _ in VALUE_FORMATS])
    return (
        F.when(filled == 0, "UNKNOWN")
        .when(best == 0, "STRING")
        .when(best * 100 < filled * FORMAT_COVERAGE_PCT, "MIXED")
        .otherwise(winner)
    )


def shuffle_key(c: Column, dtype: T.DataType) -> Column:
    """Grouping key for a value: every string travels as a SHA-256 digest, whatever its length."""
    return F.sha2(c, 256) if isinstance(dtype, T.StringType) else comparable(c, dtype)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """Value in a form that can be grouped: -0.0 as 0.0, nested types as JSON."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0).cast(dtype)).otherwise(c)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """Value as it appears in a stored sample: ISO dates, doubles, hex bytes."""
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c


def csv_safe(c: Column) -> Column:
    """Cell that a spreadsheet will not run as a formula."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_quoted(c: Column) -> Column:
    """Spreadsheet-safe cell in double quotes, with quotes doubled."""
    return F.concat(F.lit('"'), F.replace(csv_safe(c), F.lit('"'), F.lit('""')), F.lit('"'))


def table_tokens(fqn: Column) -> Column:
    """Keyword tokens of a table name: last part, layer prefix off, singular."""
    last = F.lower(F.element_at(F.split(fqn, r"\."), -1))
    words = F.filter(F.split(F.regexp_replace(last, TABLE_PREFIX, ""), "[^a-z]+"), lambda w: w != "")
    return F.transform(
        words,
        lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w),
    )


def normalise_fqn(raw: Column) -> Column:
    """``[db].[dbo].[t]`` and ``db..t`` to ``db.t``; other schemas are kept."""
    parts = F.filter(F.split(F.regexp_replace(F.trim(raw), r"[\[\]]", ""), r"\."), lambda p: p != "")
    is_dbo = (F.size(parts) == 3) & (F.lower(F.get(parts, 1)) == "dbo")
    return F.when(is_dbo, F.concat_ws(".", F.get(parts, 0), F.get(parts, 2))).otherwise(F.concat_ws(".", parts))


def normalised_statement(sql_text: Column) -> Column:
    """Statement text with case and white space levelled, for de-duplication."""
    return F.lower(F.trim(F.regexp_replace(sql_text, r"\s+", " ")))
