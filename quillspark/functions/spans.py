"""Matches of a pattern with their places, which Spark's own functions do not tell."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_KIND = "array<struct<start:int,end:int,text:string,group:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


# Unicode's noncharacters, which mark matches; in texts that hold them they become U+FFFD.
_OPEN, _MIDDLE, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _unmarked(text: Column) -> Column:
    for mark in (_OPEN, _MIDDLE, _CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\ufffd"))
    return text


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order as (start, end, text, group); places are code points from 0.

    One replacement marks all matches (Spark compiles its constant pattern once, while split() compiles one for every row); the
    places are running sums of the lengths of what stands between the marks.
    """
    marked = F.regexp_replace(_unmarked(text), pattern, f"{_OPEN}$0{_MIDDLE}${group}{_CLOSE}")

    def step(a: Column, part: Column) -> Column:
        hit, behind = F.substring_index(part, _MIDDLE, 1), F.substring_index(part, _CLOSE, -1)
        end = a["at"] + F.length(hit)
        row = F.struct(a["at"].alias("start"), end.alias("end"), hit.alias("text"), F.substring_index(F.substring_index(part, _CLOSE, 1), _MIDDLE, -1).alias("group"))
        return F.struct((end + F.length(behind)).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    def all_of(parts: Column) -> Column:
        first = F.struct(F.length(parts[0]).alias("at"), F.array().cast(_KIND).alias("out"))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), first, step)["out"]

    return let(F.split(marked, _OPEN), all_of)


def starts(text: Column, patterns: tuple[str, ...]) -> Column:
    """Matches of several patterns that may overlap each other, as (which, start, end), by start and pattern.

    A match of each pattern begins with the pattern's first letter at a word's border and ends there. Places are marked by what looks ahead, which takes up
    nothing, so one pass finds all; the marks carry what each pattern matched.
    """
    whole = rf"(?i)(?=[{''.join(sorted({p[0] for p in patterns}))}])\b(?=(?:{'|'.join(patterns)})\b)" + "".join(rf"(?=((?:{p})\b)?)" for p in patterns)
    marked = F.regexp_replace(_unmarked(text), whole, _OPEN + _MIDDLE.join(f"${i + 1}" for i in range(len(patterns))) + _CLOSE)

    def step(a: Column, part: Column) -> Column:
        found = F.transform(F.split(F.substring_index(part, _CLOSE, 1), _MIDDLE), lambda hit, i: F.struct(i.alias("which"), a["at"].alias("start"), (a["at"] + F.length(hit)).alias("end")))
        row = F.filter(found, lambda h: h["end"] > h["start"])
        return F.struct((a["at"] + F.length(F.substring_index(part, _CLOSE, -1))).alias("at"), F.concat(a["out"], row).alias("out"))

    def all_of(parts: Column) -> Column:
        first = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<which:int,start:int,end:int>>").alias("out"))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), first, step)["out"]

    return let(F.split(marked, _OPEN), all_of)


def cut(text: Column, start: Column, end: Column) -> Column:
    """Characters from start up to end, both clipped to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))
