"""Column expressions: typed numbers, cell kinds, number text, time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabscope.functions import vocabulary as V


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: Column | str) -> Column:
    """Whitespace trimmed at both ends (all Unicode spaces).  Trimming by characters costs a fraction of a pattern."""
    return F.btrim(as_column(c), F.lit(V.SPACES))


def one_line(c: Column | str) -> Column:
    return tidy(F.regexp_replace(as_column(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return as_column(c).isNull() | (F.ltrim(as_column(c), F.lit(V.SPACES)) == "")


def typed_number(c: Column | str) -> Column:
    """Number text of a converted file: ``1,234.50`` and ``(300)`` become numbers,
    codes with leading zeros and everything else become null."""
    text = tidy(F.regexp_replace(as_column(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    bracketed = text.startswith("(") & text.endswith(")")
    core = F.when(bracketed, tidy(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    digits = F.regexp_replace(core, r"^[+-]+", "")
    is_number = core.rlike(V.CONVERTED_NUMBER) & ~digits.rlike(r"^0[^.]")
    value = F.regexp_replace(core, ",", "").try_cast("double")
    return F.when(is_number, F.when(bracketed, -value).otherwise(value))


def cell_kind(c: Column | str) -> Column:
    """empty | boolean | date | number | error | text for one text cell."""
    return kind_of_tidied(tidy(c))


def kind_of_tidied(text: Column) -> Column:
    """``cell_kind`` of text without outer whitespace.  Cheap tests stand before the patterns they must pass."""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    moment = F.try_to_timestamp(F.regexp_replace(text, "T", " "))
    is_date = (F.substring(text, 5, 1) == "-") & text.rlike(V.ISO_DATE) & F.when(F.length(text) > 10, moment.isNotNull()).otherwise(day.isNotNull())
    grouped = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    plain = text.try_cast("double")
    safe = float(V.MAX_SAFE_INTEGER)
    is_number = ((F.contains(text, F.lit(",")) & text.rlike(V.GROUPED_NUMBER) & (F.abs(grouped) <= safe))
                 | (text.rlike(V.NUMBER) & ~text.rlike(V.LEADING_ZERO) & (F.abs(plain) <= safe)))
    return (F.when(text.isNull() | (text == ""), "empty")
            .when(text.startswith("#") & text.rlike(V.ERROR_LITERAL), "error")
            .when(F.length(text).isin(4, 5) & F.lower(text).isin("true", "false"), "boolean")
            .when(is_date, "date")
            .when(F.coalesce(is_number, F.lit(False)), "number")
            .otherwise("text"))


def cell_number(c: Column | str) -> Column:
    """The number a cell of kind ``number`` holds, else null."""
    return F.when(cell_kind(c) == "number", F.regexp_replace(tidy(c), ",", "").try_cast("double"))


def looks_numeric(c: Column | str) -> Column:
    return F.coalesce(F.replace(tidy(c), F.lit(" "), F.lit("")).rlike(V.NUMERIC_TEXT), F.lit(False))


def looks_textual(c: Column | str) -> Column:
    """A label: text that is not a number, a percentage or an ISO date."""
    return ~is_blank(c) & ~looks_numeric(c) & ~F.coalesce(tidy(c).rlike(V.ISO_DATE), F.lit(False))


def number_text(c: Column | str) -> Column:
    """``1,234.5``: at most two decimals, no trailing zeros."""
    return F.regexp_replace(F.format_number(as_column(c), 2), r"\.?0+$", "")


def any_word(c: Column, words) -> Column:
    """True when the text holds one of the words, in any case."""
    # One alternation keeps the generated code small.
    return F.coalesce(c.rlike("(?iu)" + literal_pattern(words)), F.lit(False))


def literal_pattern(words) -> str:
    """Alternation of literal words, longest first."""
    return "|".join("\\Q" + w + "\\E" for w in sorted(words, key=len, reverse=True))


def column_letter(number: int) -> str:
    letters = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return letters


def letter_of(c: Column) -> Column:
    """Spreadsheet letters of a 1-based column number up to ZZZ."""
    def char(value):
        return F.char(F.lit(65) + value.cast("int"))
    n = c - 1
    one, two, three = char(n % 26), char(F.floor(n / 26 - 1) % 26), char(F.floor((F.floor(n / 26) - 1) / 26 - 1) % 26)
    return F.when(n < 26, one).when(n < 26 + 676, F.concat(two, one)).otherwise(F.concat(three, two, one))


def time_bucket(c: Column | str, grain: str) -> Column:
    """Bucket label of a date or timestamp column."""
    c = as_column(c)
    if grain == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(c, "yyyy-MM")
    if grain == "year":
        return F.date_format(c, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string"))
    if grain == "week":
        week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7)
        return F.format_string("%04d-W%02d", F.year(c), week)
    raise ValueError(f"unknown grain {grain}")


def bucket_range(label: Column | str) -> Column:
    """Struct ``from``/``to`` (dates) of a day, month or year label, else null."""
    label = as_column(label)
    day = F.try_to_date(label, "yyyy-MM-dd")
    month = F.try_to_date(F.concat(label, F.lit("-01")), "yyyy-MM-dd")
    year = label.try_cast("int")

    def pair(a, b):
        return F.struct(a.alias("from"), b.alias("to"))
    return (F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}$"), pair(day, day))
            .when(label.rlike(r"^\d{4}-\d{2}$"), pair(month, F.last_day(month)))
            .when(label.rlike(r"^\d{4}$"), pair(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))))
