"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures (of whole texts; words are runs of other characters than space and \\t-\\r):
``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines``
(lines with a word that equal an earlier line), ``n_repeat_words`` (words inside 3-word windows found at least twice).
A null text has no words; all its counts are 0. An empty text likewise. Repeated rows are judged one by one.
Very long texts are judged whole: beyond 2^22 words the 3-word windows are compared as strings. Ties can't occur; empty tables
have no rows. Columns of the input that carry the name of a result are replaced; all others stay, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, free_prefix, let

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on was with as be this by at are from "
    "de la le et les des un en du que est une pour dans qui au sur par pas avec "
    "der die und den von zu das mit sich für auf im ist dem nicht ein eine als "
    "el y los se del por las con una no para es su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure (by name, see measures()) that has to lie between two bounds; where it is null the rule holds."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Base rules: fail means rejected whatever the method says.
BASE = (Rule("long_enough", "n_words", least=50), Rule("few_repeats", "repeat_ratio", most=0.5))
#: The method's rules.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.03),
    Rule("dup_lines", "dup_line_ratio", most=0.5),
)

_POS_BITS = 22


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows [p, p + width) cover; starts: ascending and distinct."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")))["n"]
    )


def _window_keys(words: Column) -> Column:
    """For each 3-word window, ascending: the low bits of its hash and its position, in one long."""
    key = lambda w, i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _POS_BITS).bitwiseOR(i.cast("long"))
    # Never an array that may hold nulls: without them Spark sorts plain longs.
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: key(words, i)))


def _candidates(words: Column, keys: Column) -> Column:
    """Positions of windows whose hash occurs more than once; in texts too long for such keys, of all windows."""
    position = lambda x: x.bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int")
    last = F.size(keys) - 2
    pairs = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), last), lambda i: F.shiftright(F.get(keys, i).bitwiseXOR(F.get(keys, i + 1)), _POS_BITS) == 0))
    found = F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(position(F.get(keys, i)), position(F.get(keys, i + 1))))))
    return F.when(F.size(words) >= (1 << _POS_BITS), F.sequence(F.lit(0), F.size(words) - 3)).otherwise(found)


def _repeated(words: Column, candidates: Column) -> Column:
    """Words in those windows, of the candidates, that are equal as strings: a collision of hashes never counts."""
    window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
    rows = F.sort_array(F.transform(candidates, lambda p: F.struct(window(p).alias("t"), p.alias("p"))))
    same = lambda r, i, x: F.coalesce(F.get(r, i)["t"] == x["t"], F.lit(False))
    starts = let(rows, lambda r: F.transform(F.filter(r, lambda x, i: same(r, i - 1, x) | same(r, i + 1, x)), lambda x: x["p"]))
    return F.when(F.size(candidates) == 0, F.lit(0)).otherwise(let(F.sort_array(starts), lambda s: _covered(s, 3)))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column ``measures`` of counts and ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stops = [v for w in STOP_WORDS for v in {w, w.capitalize()}]
    ratio = lambda a, b: F.when(b > 0, a / b)
    kept = df.drop("measures")
    q = free_prefix(kept, "_q")
    n = F.col(f"{q}_words_n")
    step = kept.select("*", words_of(F.col(text)).alias(f"{q}_words"), lines.alias(f"{q}_lines"))
    step = step.select("*", _window_keys(F.col(f"{q}_words")).alias(f"{q}_keys"))
    step = step.select("*", _candidates(F.col(f"{q}_words"), F.col(f"{q}_keys")).alias(f"{q}_again"))
    step = step.select(
        *kept.columns,
        F.size(f"{q}_words").alias(f"{q}_words_n"),
        F.length(F.array_join(f"{q}_words", "")).alias(f"{q}_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).alias(f"{q}_symbols"),
        F.size(f"{q}_lines").alias(f"{q}_lines_n"),
        (F.size(f"{q}_lines") - F.size(F.array_distinct(f"{q}_lines"))).alias(f"{q}_dup"),
        F.size(F.filter(f"{q}_words", lambda w: w.isin(stops))).alias(f"{q}_stops"),
        _repeated(F.col(f"{q}_words"), F.col(f"{q}_again")).alias(f"{q}_repeat"),
    )
    return step.select(
        *kept.columns,
        F.struct(
            n.cast("long").alias("n_words"),
            F.col(f"{q}_chars").cast("long").alias("word_chars"),
            F.col(f"{q}_symbols").cast("long").alias("n_symbols"),
            F.col(f"{q}_dup").cast("long").alias("n_dup_lines"),
            F.col(f"{q}_repeat").cast("long").alias("n_repeat_words"),
            ratio(F.col(f"{q}_repeat"), n).alias("repeat_ratio"),
            ratio(F.col(f"{q}_chars"), n).alias("mean_word_chars"),
            ratio(F.col(f"{q}_symbols"), n).alias("symbol_ratio"),
            ratio(F.col(f"{q}_stops"), n).alias("stop_ratio"),
            ratio(F.col(f"{q}_dup"), F.col(f"{q}_lines_n")).alias("dup_line_ratio"),
        ).alias("measures"),
    )


def holds(rule: Rule) -> Column:
    m = F.col(f"measures.{rule.measure}")
    test = F.lit(True)
    if rule.least is not None:
        test = test & (m >= rule.least)
    if rule.most is not None:
        test = test & (m <= rule.most)
    return F.coalesce(test, F.lit(True))


def quality(df: DataFrame, text: str = "text", base=BASE, rules=RULES) -> DataFrame:
    """df with measures, base_failed, failed (names of the rules that do not hold) and kept."""
    m = measures(df, text)
    names = ["base_failed", "failed", "kept"]
    m = m.drop(*[c for c in m.columns if c.lower() in names])
    failed = lambda rs: F.filter(F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rs]), lambda x: x.isNotNull())
    judged = m.select("*", (F.size(failed(base)) > 0).alias("base_failed"), F.concat(failed(base), failed(rules)).alias("failed"))
    # Not deterministic, for Spark only: a filter on kept then stays above, and its measures are computed once.
    kept = F.when(F.monotonically_increasing_id() >= 0, F.size("failed") == 0)
    return judged.select("*", kept.alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    """quality() over all documents, with the contract's columns."""
    from .common import table

    q = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


_STOPS = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
ORACLE = f"""
with t as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from t),
u as (select rid, unnest(words) a, unnest(range(len(words))) p from w),
g as (select rid, p, a, lead(a) over d b, lead(a, 2) over d c from u window d as (partition by rid order by p)),
h as (select rid, p, count(*) over (partition by rid, a, b, c) again from g where c is not null),
c as (select rid, count(distinct q) n from (select rid, unnest([p, p + 1, p + 2]) q from h where again > 1) group by rid),
m as (select doc_id, len(words) n_words, cast(length(array_to_string(words, '')) as bigint) word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n, 0) n_repeat_words,
  len(list_filter(words, lambda x: x in ({_STOPS}))) stops, len(lines) n_lines
  from w left join c using (rid)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2 and 14 and n_symbols / n_words <= 0.1 and stops / n_words >= 0.03
    and n_dup_lines / n_lines <= 0.5 kept
from j
"""
