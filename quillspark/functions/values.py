"""Amounts and dates in text, as columns. Parse failures give null, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let
from .text import clean_value, collapse, strip

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_LONG = "january february march april may june july august september october november december".split()


def query_amount(text: Column) -> Column:
    """The first number among a text's digits, commas (dropped) and dots, as decimal(18,4)."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[^0-9,.]", ""), ",", "")
    return F.regexp_extract(bare, r"[0-9]+(\.[0-9]+)?", 0).try_cast("decimal(18,4)")


def display_amount(text: Column) -> Column:
    """A displayed amount without its currency sign, commas and spaces, as a double."""
    bare = F.regexp_replace(clean_value(text), r"\$|Rs\.|Rs|RM|LKR|lkr|,| ", "")
    return let(bare, lambda b: F.when(b.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), b.try_cast("double")))


def query_date(text: Column) -> Column:
    """A date as queries and documents write it, day first, from 1990 to 2100; else null.

    Every accepted form is turned into year-month-day: numbers with one kind of separator, or a month's name. Two digits of a
    year from 69 on are 19.., the others 20...
    """
    t = F.regexp_replace(strip(text), r"(?i)(?<=[0-9])(?:st|nd|rd|th)\b|\bof\b|,", "")
    t = strip(collapse(F.regexp_replace(t, r"(?i)\bSept\b", "Sep")))
    for form, turned in (
        (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2}|\d{4})$", "$4-$3-$1"),
        (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
        (r"^(69|[7-9]\d)-(\d{1,2}-\d{1,2})$", "19$1-$2"),
        (r"^(\d{2})-(\d{1,2}-\d{1,2})$", "20$1-$2"),
        (r"^(\d{1,2})([- ])([A-Za-z]+)\2(\d{4})$", "$4-$3-$1"),
        (r"^([A-Za-z]+) (\d{1,2}) (\d{4})$", "$3-$1-$2"),
    ):
        t = F.regexp_replace(t, form, turned)
    months = F.create_map(*[x for i, (short, full) in enumerate(zip(_MONTHS, _LONG, strict=True), 1) for name in dict.fromkeys((short, full)) for x in (F.lit(name), F.lit(str(i)))])
    named = let(t, lambda v: let(F.regexp_extract(v, "-([A-Za-z]+)-", 1), lambda name: F.when(name == "", v).otherwise(F.replace(v, name, F.element_at(months, F.lower(name))))))
    return let(named, lambda v: let(F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), v.try_cast("date")), lambda d: F.when(F.year(d).between(1990, 2100), d)))


_SPAN_YEAR, _LEAP = r"(?:199\d|20\d\d|2100)", r"(?:199[26]|20(?:[02468][048]|[13579][26]))"
_SPAN_SHORT, _LEAP_SHORT = r"(?:9\d|[0-5]\d|6[0-8])", r"(?:9[26]|[024][048]|[135][26]|6[048])"


def _pattern(kind: str) -> str:
    """A regular expression of one format that only real days of 1990 to 2100 match; the letters y m d b stand for a year, month, day and month's name, Y for two digits.

    What begins otherwise than the format (its first part and what follows that) is not compared with its days.
    """
    names = lambda ns: "(?:" + "|".join(f"{_MONTHS[n - 1]}|{_LONG[n - 1]}" if _MONTHS[n - 1] != _LONG[n - 1] else _LONG[n - 1] for n in ns) + ")"
    numbers = lambda ns: "(?:" + "|".join(f"0?{n}" if n < 10 else str(n) for n in ns) + ")"
    month = names if "b" in kind else numbers
    days = {28: r"(?:0?[1-9]|1\d|2[0-8])", 29: "29", 30: r"(?:29|30)", 31: "31"}
    cases = [(range(1, 13), days[28], None), ((1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12), days[30], None), ((1, 3, 5, 7, 8, 10, 12), days[31], None), ((2,), days[29], "leap")]
    out = []
    for months, day, leap in cases:
        parts = {"d": day, "m": month(months), "b": month(months), "y": _LEAP if leap else _SPAN_YEAR, "Y": _LEAP_SHORT if leap else _SPAN_SHORT}
        out.append("".join(parts.get(c, "\\" + c if c in "./-" else c) for c in kind))
    begins = {"y": r"\d{4}", "d": r"\d{1,2}", "m": r"\d{1,2}", "b": "[a-z]+"}[kind[0]] + (rf"\{kind[1]}" if kind[1] in "./-" else kind[1])
    return rf"(?={begins})(?:{'|'.join(out)})"


# The formats of dates in documents; day first and month first both count. What begins like none is told at once.
DOCUMENT_DATE = r"(?i)^(?=[0-9]|[a-z]+ [0-9])(?:" + "|".join(map(_pattern, ("y-m-d", "y/m/d", "d/m/y", "m/d/y", "d-m-y", "m-d-y", "d.m.y", "m.d.y", "d-b-y", "d/m/Y", "m/d/Y", "d.m.Y", "m.d.Y", "b d, y", "b d y", "d b y"))) + ")$"
# The formats that field checks accept.
CHECKED_DATE = "(?i)^(?:" + "|".join(map(_pattern, ("d/m/y", "m/d/y", "d.m.y", "m.d.y", "y-m-d", "b d y", "b d, y", "d-b-y"))) + ")$"


def plausible_date(text: Column) -> Column:
    return F.coalesce(clean_value(text).rlike(DOCUMENT_DATE), F.lit(False))


def checked_date(text: Column) -> Column:
    """The stricter rule of the field checks."""
    return strip(text).rlike(CHECKED_DATE)


def checked_amount(text: Column) -> Column:
    return strip(F.regexp_replace(text, ",", "")).rlike(r"(?i)^(?:Rs\.?|RM|LKR|\$)?\s*[0-9]+(?:\.[0-9]{1,2})?$")


def bad_number(text: Column) -> Column:
    return (F.length(strip(text)) < 3) | ~text.rlike("[0-9]")
