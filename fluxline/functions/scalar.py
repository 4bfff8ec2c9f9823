"""Column expressions: cleaning, storm scale, text cells, ids, clamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -- patterns and tokens of the interval catalogue cells.
DATETIME_PATTERN = r"(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,4})"
NUMBER_PATTERN = r"-?\d+\.?\d*"
MISSING_TOKENS = ("", "nan", "none")
MISSING_PREFIX = "..."
HEADER_MARKS = ("Disturbance", "Y/M/D")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def number_or(text: Column, bad: str = "zero") -> Column:
    """Text as double; what cannot be read becomes 0.0 or NULL."""
    if bad not in ("zero", "null"):
        raise ValueError("bad must be 'zero' or 'null'")
    value = text.try_cast("double")
    return F.coalesce(value, F.lit(0.0)) if bad == "zero" else value


def archive_time(text: Column) -> Column:
    """ISO-8601 text with any fraction length, cut to microseconds, as UTC."""
    clean = F.trim(text)
    return F.try_to_timestamp(
        F.regexp_replace(clean, r"(\.\d{1,6})\d*(Z?)$", "$1$2")
    )


def archive_time_text(ts: Column) -> Column:
    """Inverse of :func:`archive_time`, always six fraction digits and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_text(ts: Column) -> Column:
    """ISO-8601 with offset; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    parts = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(parts)


def storm_scale(index: Column) -> Column:
    """0 below level 5, then 1..5; levels round half to even."""
    level = F.bround(index, 0)
    return (
        F.when(index.isNull(), None)
        .when(level < 5, 0)
        .otherwise(F.least(F.lit(5.0), level - 4))
        .cast("tinyint")
    )


def magnitude(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def is_missing_cell(cell: Column) -> Column:
    low = F.lower(F.trim(cell))
    return cell.isNull() | low.isin(*MISSING_TOKENS) | low.startswith(MISSING_PREFIX)


def _once(cell: Column, fn) -> Column:
    """``fn`` of a cell whose own expression is worked out one time only."""
    return F.get(F.transform(F.array(cell), fn), F.lit(0))


def catalog_time(cell: Column) -> Column:
    """Date and HHMM found anywhere in a cell; NULL when absent or impossible."""

    def made(part: Column) -> Column:
        def number(i: int) -> Column:
            return F.get(part, F.lit(i)).try_cast("int")

        clock = number(3)
        return F.try_make_timestamp(
            number(0), number(1), number(2),
            F.floor(clock / 100).cast("int"), F.pmod(clock, F.lit(100)), F.lit(0))

    def read(c: Column) -> Column:
        found = F.regexp_extract(c, DATETIME_PATTERN, 0)
        parts = F.split(found, r"[/\s]+")
        return F.when(is_missing_cell(c), None).otherwise(_once(parts, made))

    return _once(cell, read)


def catalog_number(cell: Column) -> Column:
    """First signed number in a cell, whatever follows it."""

    def read(c: Column) -> Column:
        found = F.regexp_extract(c, NUMBER_PATTERN, 0)
        return F.when(is_missing_cell(c), None).otherwise(found.try_cast("double"))

    return _once(cell, read)


def catalog_int(cell: Column) -> Column:
    return catalog_number(cell).cast("int")


def catalog_text(cell: Column) -> Column:
    return _once(cell, lambda c: F.when(is_missing_cell(c), "").otherwise(F.trim(c)))


def is_header_cell(cell: Column) -> Column:
    return F.coalesce(any_of([cell.contains(m) for m in HEADER_MARKS]), F.lit(False))


def tracked_id(prefix: str, name: Column) -> Column:
    """``PREFIX_NAME`` with blanks as underscores, upper case."""
    return F.concat(F.lit(prefix + "_"), F.upper(F.replace(name, F.lit(" "), F.lit("_"))))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 when there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def key_id(*parts: Column) -> Column:
    """Stable id made from the identifying columns, equal on every run."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def tidy_parameters(parameters: Column, drop: str = "data_type") -> Column:
    """Parameter map for display: one key dropped, numbers at two decimals."""
    kept = F.map_filter(parameters, lambda k, v: k != drop)

    def shown(_k, v):
        number = v.try_cast("double")
        return F.when(
            number.isNotNull() & v.contains("."), F.round(number, 2).cast("string")
        ).otherwise(v)

    return F.transform_values(kept, shown)


def title_text(tag: Column) -> Column:
    return F.initcap(F.replace(tag, F.lit("_"), F.lit(" ")))


def sorted_json(details: Column) -> Column:
    """JSON text of a map with its keys in order, so equal maps hash equally."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(details))))
