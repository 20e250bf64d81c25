"""Pure Column -> Column functions (cleaning rules and scalar helpers).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs Python at run time.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake import schema as S

__all__ = [
    "col_of", "as_of_lit", "strip", "null_if_token", "clean_text", "title_case",
    "symptom_token", "digits_only", "clean_email", "upper_code", "parse_date",
    "gender_label", "age_years", "full_name", "display_name", "search_text",
    "keyword_hit", "days_label", "follow_up_status",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of) -> Column:
    """``as_of`` may be a date, an ISO string, a Column, or None (= current_date)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def strip(c) -> Column:
    """Strip leading/trailing whitespace of any kind (plain ``trim`` only drops spaces)."""
    return F.trim(col_of(c), F.lit(S.WHITESPACE))


#: A placeholder in white space. One match costs less than a strip and a lower-case copy, and
#: its code is short: a projection of many such columns stays small enough to be compiled.
_TOKEN = rf"(?i)^[{S.WHITESPACE}]*+(?:{'|'.join(filter(None, S.NULL_TOKENS))})?[{S.WHITESPACE}]*+\z"


def null_if_token(c) -> Column:
    """Null when the value is a missing-value placeholder (blank, nan, none, nat)."""
    c = col_of(c)
    return F.when(~c.rlike(_TOKEN), c)


def clean_text(c) -> Column:
    """Strip, then null for placeholders."""
    return F.when(~col_of(c).rlike(_TOKEN), strip(c))


_MARK = "\ue000"  # private-use character: marks word starts introduced below


def title_case(c) -> Column:
    """Python-style title case: a letter is upper-cased when it follows a non-letter
    (``o'brien`` -> ``O'Brien``, ``MARY-JANE`` -> ``Mary-Jane``), others lower-cased.

    ``initcap`` only starts words after a space, so every non-letter, non-space
    character is followed by a marker and a space first, and both are removed
    afterwards; everything stays in built-in, code-generated expressions.
    """
    marked = F.regexp_replace(F.lower(col_of(c)), r"([^\p{L} ])", "$1" + _MARK + " ")
    return F.replace(F.initcap(marked), F.lit(_MARK + " "), F.lit(""))


def symptom_token(c) -> Column:
    """strip, lower, squeeze inner whitespace, capitalise each word."""
    squeezed = F.regexp_replace(strip(F.lower(col_of(c))), r"(?U)\s+", " ")
    return F.initcap(squeezed)


def digits_only(c) -> Column:
    return F.regexp_replace(col_of(c), r"(?U)\D", "")


def clean_email(c) -> Column:
    return F.lower(clean_text(c))


def upper_code(c) -> Column:
    return F.upper(clean_text(c))


def _date_shape() -> str:
    """One pattern for all layouts with a four-digit year; it matches every text, with groups
    only where the text has one of the shapes. Groups: (d, -, M, y), (y, -, M, d), (y, M, d)."""
    day_first, year_first, solid = (shape[1:-1] for _, shape, _ in S.DATE_LAYOUTS[:3])
    uncaught = lambda p: p.replace(S.TIME_PART, "")
    time = S.TIME_PART.replace("(", "(?:")
    year_first = uncaught(year_first).replace(r"\2", r"\6")
    return rf"(?s)^(?:(?:{uncaught(day_first)}|{year_first}){time}|{solid})$|^.*$"


def parse_date(c, stripped: bool = False) -> Column:
    """Per-value day-first parse over an explicit layout list; unparseable -> null.

    The value is rewritten to ``y-M-d`` by one pattern and cast, which refuses impossible
    dates such as 31-02. Only what is no date by then is tried with a two-digit year or a
    month's name, so most values cost one match."""
    c = col_of(c) if stripped else strip(col_of(c))
    whole = F.regexp_replace(c, _date_shape(), "$4$5$9-$3$7$10-$1$8$11").try_cast("date")
    short = None
    for _, shape, rewrite in S.DATE_LAYOUTS[3:]:
        text = F.regexp_replace(c, shape, rewrite).try_cast("date")
        short = F.when(c.rlike(shape), text) if short is None else short.when(c.rlike(shape), text)
    name = S.MONTH_NAME_SHAPE
    named = F.when(c.rlike(name), F.try_to_date(F.concat_ws(
        "-", F.regexp_extract(c, name, 3), F.initcap(F.substring(F.regexp_extract(c, name, 2), 1, 3)),
        F.regexp_extract(c, name, 1)), "y-MMM-d"))
    return F.coalesce(whole, short, named)


def gender_label(c, lowered: bool = False) -> Column:
    """m/f/o codes -> Male/Female/Other, anything else title-cased; placeholders -> null.
    ``lowered=True``: the input is already cleaned and lower-cased."""
    v = col_of(c) if lowered else F.lower(clean_text(c))
    expr = None
    for code, label in S.GENDER_CODES.items():
        expr = (F.when(v == code, F.lit(label)) if expr is None else expr.when(v == code, F.lit(label)))
    return expr.otherwise(title_case(v))


def age_years(dob, as_of=None) -> Column:
    """Completed years; a 29 Feb birthday completes a year on 1 Mar of common years."""
    d, t = col_of(dob), as_of_lit(as_of)
    before_birthday = (F.month(t) * 100 + F.dayofmonth(t)) < (F.month(d) * 100 + F.dayofmonth(d))
    return (F.year(t) - F.year(d) - before_birthday.cast("int")).cast("int")


def full_name(first, last) -> Column:
    """SQL-style ``CONCAT(first, ' ', last)``: null if either part is null."""
    return F.concat(col_of(first), F.lit(" "), col_of(last))


def display_name(first, last, fallback: str = "Unknown Patient") -> Column:
    joined = F.trim(F.concat(F.coalesce(col_of(first), F.lit("")), F.lit(" "),
                             F.coalesce(col_of(last), F.lit(""))))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(fallback))


def search_text(c) -> Column:
    """lower, squeeze whitespace, trim (name search normalisation)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col_of(c), F.lit(""))), r"(?U)\s+", " "))


def keyword_hit(text, keywords=None) -> Column:
    """True when any keyword occurs as a substring of ``text`` (already lower-cased)."""
    text = col_of(text)
    hit = F.lit(False)
    for k in (keywords or S.HIGH_RISK_KEYWORDS):
        hit = hit | F.contains(text, F.lit(k))
    return hit


def days_label(n: Column, unit_one: str, unit_many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {unit_one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit_many}")))


def follow_up_status(days) -> Column:
    """``Overdue by n day(s)`` / ``Due today`` / ``Due in n day(s)``."""
    d = col_of(days)
    return (F.when(d < 0, F.concat(F.lit("Overdue by "), days_label(F.abs(d), "day", "days")))
            .when(d == 0, F.lit("Due today"))
            .otherwise(F.concat(F.lit("Due in "), days_label(d, "day", "days"))))
