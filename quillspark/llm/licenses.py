"""License scans with a positional index of rare license words.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. Templates (grants, headers, notices) have key phrases,
which give a vocabulary. One pass counts in how many documents each vocabulary word occurs; every template is then indexed under the words of
highest inverse document frequency of its own key phrase: postings word -> (template, position). Each document looks up all
occurrences of the indexed words, intersects their postings by relative position (a template's words must agree on where it
starts), and verifies the template's key phrase word by word. Wherever a key phrase stands its indexed words stand too, so no
template is lost, whatever else the text holds. Independently of that, base phrases are found wherever their words stand
consecutively.

Everything is built-in functions over the words of one document: nothing is shuffled but the bounded word counts.

Defined cases: a null or empty text has no words, labels '' and score 0; repeated rows are judged one by one; ties in frequency
are broken by the word; very long texts are scanned whole; empty tables have no rows. Extra columns pass through under whatever
names; columns named like a result are replaced.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, table

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of the text, consecutive, that have to be there.
    key: str


def _words(text: str) -> str:
    """A text as its words in single spaces."""
    return " ".join(re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)))


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the
Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license"""
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"

# Grants, headers and short notices of common licenses, each with the phrase that has to be there.
TEMPLATES = tuple(
    Template(label, _words(text), _words(key))
    for label, text, key in (
        ("mit", "released under the MIT License", "under the MIT License"),
        ("mit", _MIT, "to deal in the Software without restriction"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("apache-2", _APACHE, "Apache License, Version 2"),
        ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3"),
        ("gpl-2", "This work is licensed under the GNU General Public License, version 2", "GNU General Public License version 2"),
        ("gpl-3", _GNU.format("General Public License", 3), "GNU General Public License as published by the Free Software Foundation, either version 3"),
        ("gpl-2", _GNU.format("General Public License", 2), "GNU General Public License as published by the Free Software Foundation, either version 2"),
        ("lgpl", "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
        ("agpl-3", "licensed under the GNU Affero General Public License version 3", "GNU Affero General Public License version 3"),
        ("agpl-3", _GNU.format("Affero General Public License", 3), "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
        ("mpl-2", _MPL, "Mozilla Public License"),
        ("epl-2", _EPL, "Eclipse Public License"),
        ("bsd", _BSD, "Redistribution and use in source and binary forms"),
        ("isc", _ISC, "for any purpose with or without fee is hereby granted"),
        ("zlib", _ZLIB, "to alter it and redistribute it freely"),
        ("bsl-1", _BOOST, "to any person or organization obtaining a copy of the software"),
        ("unlicense", _UNLICENSE, "free and unencumbered software released into the public domain"),
        ("cc-by-nc", "licensed under CC BY-NC 4.0", "CC BY-NC"),
        ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial"),
        ("cc-by-sa", "licensed under CC BY-SA 4.0", "CC BY-SA"),
        ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike"),
        ("cc-by", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"),
        ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "CC0 1.0 Universal"),
    )
)

#: Words of its key phrase that a template is indexed under.
KEY_WORDS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _GAP), lambda w: w != "")


def _needles(templates) -> list[str]:
    """For each key phrase and base phrase its longest word: a text without any of them holds none of the phrases."""
    return sorted({max(p.split(), key=len) if len(max(p.split(), key=len)) > 3 else p for p in [*(p for p, _ in BASE), *(t.key for t in templates)]})


def _may_hold(text: Column, templates) -> Column:
    """A quick test that lets through every text with a phrase."""
    return text.rlike("(?i)" + "|".join(_GAP.join(n.split()) for n in _needles(templates)))


def document_frequency(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the key phrases occurs (as many counts as these have words), and their number."""
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    known = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in counts}
    n = df.pop("", 0)
    return {w: df.get(w, 0) for w in vocabulary}, n


def _phrase_at(words: Column, at: Column, phrase: list[str]) -> Column:
    test = at >= 0
    for k, w in enumerate(phrase):
        test = test & F.coalesce(F.get(words, at + k) == w, F.lit(False))
    return test


def _base_places(words: Column) -> Column:
    """(label, start) of every occurrence of a base phrase."""

    def places(phrase: list[str], label: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: _phrase_at(words, i, phrase))
        return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return F.concat(*[places(phrase.split(), label) for phrase, label in BASE])


def _key_start(template: Template) -> int:
    """How many words the template has before its key phrase."""
    return len(f" {template.text} "[: f" {template.text} ".index(f" {template.key} ")].split())


def _indexed(template: Template, rank: dict[str, int], key_words: int) -> list[tuple[str, int]]:
    """The rarest different words of the key phrase, each with its first position there, as one in the template."""
    key = template.key.split()
    return [(w, _key_start(template) + key.index(w)) for w in sorted(set(key), key=rank.__getitem__)[:key_words]]


def _placements(words: Column, rank: dict[str, int], templates, key_words: int) -> Column:
    """(template, start) where all words that the template is indexed under agree."""
    postings: dict[str, list] = {}
    for t, template in enumerate(templates):
        for w, p in _indexed(template, rank, key_words):
            postings.setdefault(w, []).append((t, p))
    lists = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w]]))])
    others = F.array(*[F.lit(len(_indexed(t, rank, key_words)) - 1) for t in templates])
    found = F.filter(F.transform(words, lambda w, i: F.struct(F.element_at(lists, w).alias("at"), i.alias("i"))), lambda x: x["at"].isNotNull())
    votes = F.flatten(F.transform(found, lambda x: F.transform(x["at"], lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("start")))))
    # A word has one position in a template, so no placement gets more votes than the template has indexed words.
    return let(F.sort_array(votes), lambda v: F.filter(v, lambda x, i: F.coalesce(F.get(v, i - F.element_at(others, x["t"] + 1)) == x, F.lit(False))))


def _judge(words: Column, placements: Column, templates) -> Column:
    """(label, score) of the placements whose key phrase stands where the template has it; score: share of the template's words in place."""
    texts = F.array(*[F.array(*map(F.lit, t.text.split())) for t in templates])
    checks = [(t, _key_start(x), x.key.split()) for t, x in enumerate(templates)]

    def holds(p: Column) -> Column:
        test = F.lit(False)
        for t, before, key in checks:
            test = test | ((p["t"] == t) & _phrase_at(words, p["start"] + before, key))
        return test

    labels = F.array(*[F.lit(t.label) for t in templates])
    share = lambda p: let(F.element_at(texts, p["t"] + 1), lambda x: F.size(F.filter(F.transform(x, lambda w, j: F.coalesce((p["start"] + j >= 0) & (F.get(words, p["start"] + j) == w), F.lit(False))), lambda same: same)) / F.size(x))
    return F.transform(F.filter(placements, holds), lambda p: F.struct(F.element_at(labels, p["t"] + 1).alias("label"), share(p).alias("score")))


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, key_words: int = KEY_WORDS) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score (1 where a base phrase stands, else the best template's)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    scan = free_name(docs, "_scan", *RESULTS)
    frequency, _ = document_frequency(docs, text, templates)
    rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    whole = F.coalesce(F.col(text), F.lit(""))
    empty = F.struct(F.array().cast("array<struct<label:string,start:bigint>>").alias("base"), F.array().cast("array<struct<label:string,score:double>>").alias("found"))
    scanned = let(words_of(F.col(text)), lambda w: F.struct(_base_places(w).alias("base"), _judge(w, _placements(w, rank, templates, key_words), templates).alias("found")))
    step = docs.select("*", F.regexp_count(whole, F.lit(_WORD)).cast("long").alias("n_words"), F.when(_may_hold(whole, templates), scanned).otherwise(empty).alias(scan))
    base, found = F.col(f"{scan}.base"), F.col(f"{scan}.found")
    starts = F.transform(base, lambda x: x["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return step.select(
        *docs.columns,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda x: x["label"])).alias("base_labels"),
        joined(F.concat(F.transform(base, lambda x: x["label"]), F.transform(found, lambda x: x["label"]))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """scan_licenses() over all documents."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    """DuckDB's SQL for op10: every template is tried wherever its key phrase stands."""
    words = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    base = ", ".join(f"('{label}', {words(phrase)})" for phrase, label in BASE)
    templates = ", ".join(f"('{t.label}', {words(t.key)}, {_key_start(t)}, {words(t.text)})" for t in TEMPLATES)
    return rf"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') w from documents),
j as (select rid, w, ' ' || array_to_string(w, ' ') || ' ' line from d),
b as (select * from (values {base}) v(label, key)),
t as (select * from (values {templates}) v(label, key, before, words)),
bp as (select rid, label, p from (select rid, w, label, key, unnest(range(1, len(w) - len(key) + 2)) p from j join b on contains(line, ' ' || array_to_string(key, ' ') || ' ')) where w[p:p + len(key) - 1] = key),
tp as (select rid, w, label, words, p - before s from (select rid, w, t.*, unnest(range(1, len(w) - len(key) + 2)) p from j join t on contains(line, ' ' || array_to_string(key, ' ') || ' ')) where w[p:p + len(key) - 1] = key),
ts as (select rid, label, list_sum(list_transform(range(0, len(words)), lambda k: case when s + k between 1 and len(w) and w[cast(greatest(s + k, 1) as bigint)] = words[k + 1] then 1 else 0 end)) / len(words) score from tp),
ba as (select rid, count(*) n, min(p) - 1 a, max(p) - 1 z, string_agg(distinct label, ',' order by label) labels from bp group by rid),
la as (select rid, string_agg(distinct label, ',' order by label) labels from (select rid, label from bp union all select rid, label from ts) group by rid),
sc as (select rid, max(score) score from ts group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_base, a first_word, z last_word, coalesce(ba.labels, '') base_labels, coalesce(la.labels, '') labels,
  cast(case when n > 0 then 1 else coalesce(score, 0) end as double) score
from d left join ba using (rid) left join la using (rid) left join sc using (rid)
"""


ORACLE = _sql()
