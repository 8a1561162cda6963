"""Personal data by weak supervision, in built-in functions.

Base spans come from patterns with checks (email, ip, card, phone). The method adds account numbers (kind ``iban``, by their check
digits) and spans of credentials (kind ``secret``):
candidates are runs of letters, digits, ``_``, ``+``, ``/`` and ``-`` with a letter and a digit; labelers of three sorts vote on
each one (patterns of the run, a gazetteer of key words in front of it, the context around it). One pass counts how often each
combination of votes and span features occurs in all documents: at most 3^7 * 36 counts, whatever the number of rows. On those
counts expectation-maximisation estimates how reliable each labeler is and how likely each combination is personal data; a
logistic span classifier is trained on these probabilities and decides every candidate.

A run that only shares characters with a base span (digits of a token that pass as a card number, say) is a candidate like any
other, so secrets may overlap base spans; redaction merges what overlaps. Runs wholly inside a base span are none.

Offsets are code points, end exclusive; matches are the leftmost non-overlapping ones of each kind. The patterns are written so
that a match never runs back over what it has passed: long texts take linear time.

Defined cases: a null or empty text has no spans; repeated rows are judged one by one (and each counts in the statistics);
without candidates no span is added; empty tables have no rows. Extra columns pass through; columns named like a result are
replaced.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, free_prefix, let, table

_SPAN = "array<struct<start:bigint,end:bigint,text:string>>"
_BLOCK = 256

# The base kinds' patterns, in a form without backtracking (possessive runs; a run starts where none goes before).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,}+"

# Words that announce a credential.
GAZETTEER = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential")

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
#: Account numbers: two letters, two check digits, 11 to 30 more characters, in one run or in groups of four.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their offsets, in order."""

    def located(found: Column, gaps: Column) -> Column:
        advance = F.zip_with(gaps, found, lambda g, m: F.length(g).cast("long") + F.coalesce(F.length(m), F.lit(0)))
        blocks = F.sequence(F.lit(0), (F.size(found) - 1).cast("int"), F.lit(_BLOCK))
        bases = lambda adv: F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, b: F.struct((a["at"] + F.aggregate(F.slice(adv, b + 1, _BLOCK), F.lit(0).cast("long"), lambda s, x: s + x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

        def block(base: Column, b: Column) -> Column:
            rows = F.slice(F.arrays_zip(gaps.alias("g"), found.alias("m")), b * _BLOCK + 1, _BLOCK)
            step = lambda a, r: let(a["at"] + F.length(r["g"]), lambda s: F.struct((s + F.length(r["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), (s + F.length(r["m"])).alias("end"), r["m"].alias("text")))).alias("out")))
            usable = F.filter(rows, lambda r: r["m"].isNotNull())
            return F.aggregate(usable, F.struct(base.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]

        return let(advance, lambda adv: F.flatten(F.transform(bases(adv), block)))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(pair, lambda p: F.when(F.size(p["m"]) == 0, F.array().cast(_SPAN)).otherwise(located(p["m"], p["g"]).cast(_SPAN)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """The check sum of 13 to 19 digits."""
    padded = F.lpad(_digits(s), 19, "0")
    doubled = "0246813579"
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, k + 1, 1)
        total = total + F.when(F.lit((18 - k) % 2 == 1), F.translate(d, "0123456789", doubled)).otherwise(d).cast("int")
    return total % 10 == 0


def _mod97(s: Column) -> Column:
    """Whether an account number's first four characters, moved behind the others, make it 1 modulo 97 (letters count 10 to 35)."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: F.when(c == "", a).otherwise(let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return F.aggregate(turned, F.lit(0), step) == 1


def account_spans(text: Column) -> Column:
    """Account numbers whose check digits hold."""
    found = F.filter(spans(text, IBAN), lambda x: F.length(F.replace(x["text"], F.lit(" "), F.lit(""))).between(15, 34) & _mod97(x["text"]))
    return F.when(text.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"), found).otherwise(F.array().cast(_SPAN))


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds that pass their checks; the quick tests let through every text with a match."""
    none = F.array().cast(_SPAN)
    digits = lambda x: F.length(_digits(x["text"]))
    return {
        "email": F.when(text.contains("@"), spans(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda x: x["text"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), F.filter(spans(text, CARD), lambda x: F.when(digits(x).between(13, 19), _luhn(x["text"])).otherwise(F.lit(False)))).otherwise(none),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(spans(text, PHONE), lambda x: digits(x).between(9, 15))).otherwise(none),
    }


@dataclass(frozen=True)
class Labeler:
    """Votes 1 (personal), 0 (not) or, where both tests fail, not at all, on a candidate (text, before, after)."""

    name: str
    yes: object
    no: object = None


#: Patterns of the run, gazetteer, context.
LABELERS = (
    Labeler("hex", lambda c: c["text"].rlike("^[0-9a-f]{16,}$"), lambda c: c["text"].rlike("[g-z]{4}")),
    Labeler("key_id", lambda c: c["text"].rlike("^[A-Z0-9]{16,}$") & c["text"].rlike("[A-Z]{4}"), lambda c: c["text"].rlike("^[A-Za-z]+[0-9]{1,4}$")),
    Labeler("mixed", lambda c: F.length(c["text"]) >= 16, lambda c: F.length(c["text"]) < 12),
    Labeler("gazetteer", lambda c: F.lower(c["before"]).rlike("(?:" + "|".join(GAZETTEER) + r")[\"']?\s*[:=]?\s*[\"']?$")),
    Labeler("assigned", lambda c: c["before"].rlike(r"[:=]\s*[\"']?$")),
    Labeler("enclosed", lambda c: c["before"].rlike("[\"'`(<]$") & c["after"].rlike("^[\"'`)>]"), lambda c: c["before"].rlike("[a-z] $") & c["after"].rlike("^ [a-z]")),
    Labeler("prose", lambda c: F.lit(False), lambda c: c["text"].rlike("^[A-Z]?[a-z]+(?:[-/][a-z]+)*[0-9]{0,2}$") | c["text"].rlike("^[0-9]{1,4}(?:[-/][0-9a-z]{1,9}){1,3}$")),
)


# What a labeler is held to before any count: it votes yes more often on personal data, no more often on other runs.
PRIOR = ({"1": 0.05, "0": 0.45, "-": 0.5}, {"1": 0.45, "0": 0.05, "-": 0.5})
#: Weight of that, as a share of all candidates.
PRIOR_WEIGHT = 0.2


def candidates(text: Column, taken: Column) -> Column:
    """Runs that may be credentials, with 24 characters before and 8 behind them; those that lie wholly inside a span taken already are left out."""
    runs = F.filter(spans(text, CANDIDATE), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))
    free = lambda x: ~F.exists(taken, lambda t: (t["start"] <= x["start"]) & (x["end"] <= t["end"]))
    around = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.substring(text, F.greatest(x["start"].cast("int") - 23, F.lit(1)), F.least(F.lit(24), x["start"].cast("int"))).alias("before"), F.substring(text, x["end"].cast("int") + 1, F.lit(8)).alias("after"))
    kind = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"
    return F.when(text.rlike("[A-Za-z_+/-][0-9]|[0-9][A-Za-z_+/-]"), F.transform(F.filter(runs, free), around).cast(kind)).otherwise(F.array().cast(kind))


def _pattern(c: Column) -> Column:
    """A candidate's votes (1, 0 or - of each labeler) and its own features, as a short string: classes of its length, of its share of digits, of its cases."""
    votes = [F.when(v.yes(c), F.lit("1")).when(v.no(c), F.lit("0")).otherwise(F.lit("-")) if v.no else F.when(v.yes(c), F.lit("1")).otherwise(F.lit("-")) for v in LABELERS]
    size = F.least(F.floor(F.length(c["text"]) / 10), F.lit(3)).cast("string")
    share = F.length(_digits(c["text"])) / F.length(c["text"])
    digits = F.when(share < 0.2, F.lit("0")).when(share < 0.5, F.lit("1")).otherwise(F.lit("2"))
    cases = F.when(c["text"].rlike("[A-Z]") & c["text"].rlike("[a-z]"), F.lit("2")).when(c["text"].rlike("[A-Z]"), F.lit("1")).otherwise(F.lit("0"))
    return F.concat(*votes, size, digits, cases)


def estimate(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Expectation-maximisation over counts of vote combinations: how likely each is personal data.

    Labelers are taken as independent given the truth; each has, for either truth, a probability of each of its three votes.
    """
    patterns = sorted(counts)
    m = len(LABELERS)
    belief = {}
    for p in patterns:  # start: the share of votes for it, one vote against it given
        yes, no = p[:m].count("1"), p[:m].count("0")
        belief[p] = (yes + 0.1) / (yes + no + 1.1)
    for _ in range(rounds if patterns else 0):
        weight = [sum(counts[p] * (belief[p] if t else 1 - belief[p]) for p in patterns) for t in (0, 1)]
        total = weight[0] + weight[1]
        share = lambda p, t: counts[p] * (belief[p] if t else 1 - belief[p])
        firm = 1 + PRIOR_WEIGHT * total
        rate = [[{v: (sum(share(p, t) for p in patterns if p[j] == v) + firm * PRIOR[t][v]) / (weight[t] + firm) for v in "01-"} for j in range(m)] for t in (0, 1)]
        new = {}
        for p in patterns:
            log = [math.log((weight[t] + 1) / (total + 2)) + sum(math.log(rate[t][j][p[j]]) for j in range(m)) for t in (0, 1)]
            new[p] = 1 / (1 + math.exp(min(700, max(-700, log[0] - log[1]))))
        moved = max(abs(new[p] - belief[p]) for p in patterns)
        belief = new
        if moved < 1e-9:
            break
    return belief


#: Classes of length, share of digits and cases that count beside the first one.
_CLASSES = ("123", "12", "12")


def _features(p: str) -> list[float]:
    m = len(LABELERS)
    return [1.0, *(1.0 if v == "1" else 0.0 for v in p[:m]), *(1.0 if v == "0" else 0.0 for v in p[:m]), *(1.0 if p[m + k] == s else 0.0 for k, of in enumerate(_CLASSES) for s in of)]


def train(counts: dict[str, int], belief: dict[str, float], rounds: int = 400, step: float = 2.0, penalty: float = 1e-3) -> list[float]:
    """A logistic span classifier, by gradient descent on the counted combinations with their probabilities as labels.

    A combination weighs as the square root of its count, so that one frequent sort of run does not drown the others.
    """
    rows = [(_features(p), belief[p], math.sqrt(counts[p])) for p in sorted(counts)]
    total = sum(w for _, _, w in rows) or 1.0
    weights = [0.0] * (1 + 2 * len(LABELERS) + sum(map(len, _CLASSES)))
    for _ in range(rounds if rows else 0):
        slope = [penalty * w for w in weights]
        for x, y, w in rows:
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            d = w / total * (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - y)
            slope = [s + d * v for s, v in zip(slope, x, strict=True)]
        weights = [w - step * s for w, s in zip(weights, slope, strict=True)]
    return weights


def accepted(counts: dict[str, int]) -> list[str]:
    """The vote combinations, of those that occur, that the trained classifier takes for personal data."""
    weights = train(counts, estimate(counts))
    return [p for p in sorted(counts) if sum(a * b for a, b in zip(weights, _features(p), strict=True)) > 0]


def _with_spans(docs: DataFrame, text: str, at: str) -> DataFrame:
    """docs with {at}_base (a struct of the base kinds' spans) and {at}_cand (candidates with their votes)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.select("*", F.struct(*[c.alias(k) for k, c in base_spans(whole).items()]).alias(f"{at}_base"), account_spans(whole).alias(f"{at}_iban"))
    taken = F.concat(*[F.col(f"{at}_base.{k}") for k in KINDS[:4]], F.col(f"{at}_iban"))
    step = step.select("*", candidates(whole, taken).alias(f"{at}_runs"))
    voted = F.transform(f"{at}_runs", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), _pattern(c).alias("votes")))
    return step.select("*", voted.alias(f"{at}_cand")).drop(f"{at}_runs")


def vote_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each combination of votes occurs over all documents (a bounded number of combinations)."""
    found = _with_spans(docs.select(F.col(text).alias("text")), "text", "_w").select(F.explode("_w_cand.votes").alias("votes")).groupBy("votes").count()
    return {r["votes"]: r["count"] for r in found.collect()}


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with a struct of arrays of (start, end, text): email, ip, card, phone, secret, iban."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    patterns = accepted(vote_counts(docs, text))
    at = free_prefix(docs, "_w")
    step = _with_spans(docs, text, at)
    secret = F.transform(F.filter(f"{at}_cand", lambda c: c["votes"].isin(patterns) if patterns else F.lit(False)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"))).cast(_SPAN)
    return step.select(*docs.columns, F.struct(*[F.col(f"{at}_base.{k}").alias(k) for k in KINDS[:4]], secret.alias("secret"), F.col(f"{at}_iban").alias("iban")).alias(into))


def _listed(kinds, into: str) -> Column:
    return F.array_join(F.concat(*[_of_kind(k, into) for k in kinds]), ",")


def _of_kind(kind: str, into: str) -> Column:
    return F.transform(F.col(f"{into}.{kind}"), lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of spans that overlap, what the earlier one leaves is part of it."""
    into = free_name(docs, "_pii")
    found = find_pii(docs, text, into)
    every = lambda k: F.transform(F.col(f"{into}.{k}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))
    ordered = F.array_sort(F.concat(*[every(k) for k in KINDS]))
    t = F.col(text)
    cut = lambda a, b: F.substring(t, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(cut(a["at"], s["start"]), s["tag"])).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    rebuilt = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"].cast("int") + 1, 2147483647)))
    n = F.size(F.concat(*[F.col(f"{into}.{k}") for k in KINDS]))
    return found.select(*[F.when(n > 0, rebuilt).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    """find_pii() over all documents, as counts and lists of spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS[:4], "pii"), 256).alias("base_sha256"), _listed(KINDS, "pii").alias("spans"), F.size("pii.secret").cast("long").alias("n_secret"), F.size(F.concat(*[F.col(f"pii.{k}") for k in KINDS])).cast("long").alias("n_spans"))
