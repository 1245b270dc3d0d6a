"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is 128 words in a row, however they are broken into lines; blocks overlap by half, so every notice of up to 64 words
stands whole in one.  A block meets a template when it holds at least a threshold of the template's distinct words.  Words are ordered by their global
document frequency, rarest first; a block is a candidate only through a word of a template's prefix, and length and positions
rule out candidates before the overlap is counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_KEYS, LOWER, UPPER, materialise

THRESHOLD = 0.9
#: Words of a block, and of the longest template that is met wherever it stands.
BLOCK, LONGEST = 128, 64
#: Different words of all templates together; their frequencies come to the driver.
MOST_TEMPLATE_WORDS = 20_000

# The phrases of the base scan with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Wordings of public license notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "subject to the terms of the mozilla public license"),
]

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """Lower case for comparing with words of ASCII letters.

    U+0130 and U+212A, the two characters whose lower case has ASCII letters, become another word character
    first, so the words that equal an ASCII word are those that do with A-Z alone lowered.
    """
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("ÿ")), F.lit("K"), F.lit("ÿ")))


def _padded(folded: Column) -> Column:
    """The words with two blanks between them and one at either end: neighbouring phrases then share none."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(folded, _SEPARATOR, "  "), F.lit(" ")), F.lit(" "))


def phrase_columns(folded: Column, phrases: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """n_base, first_word, last_word and base labels (array), of the whole folded text."""
    rare = sorted({max(p.split(), key=len) for p, _ in phrases})
    # Only texts with the longest word of some phrase are spread out and searched.
    padded = F.when(F.regexp_like(folded, F.lit("|".join(rare))), _padded(folded)).otherwise(F.lit(" "))
    n, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in phrases:
        words = phrase.split()
        wanted = F.lit(" " + "  ".join(words) + " ")
        has = F.contains(padded, wanted)
        n = n + (F.length(padded) - F.length(F.replace(padded, wanted, F.lit("")))) / F.length(wanted)
        firsts.append(F.when(has, F.regexp_count(F.substring_index(padded, " " + "  ".join(words) + " ", 1), F.lit("[^ ]+"))))
        after = F.regexp_count(F.substring_index(padded, " " + "  ".join(words) + " ", -1), F.lit("[^ ]+"))
        lasts.append(F.when(has, F.regexp_count(padded, F.lit("[^ ]+")) - after - len(words)))
        labels.append(F.when(has, F.lit(label)))
    pick = (lambda f, x: f(*x)) if len(phrases) > 1 else (lambda f, x: x[0])
    return {
        "n_base": n.cast("bigint"),
        "first_word": pick(F.least, firsts).cast("bigint"),
        "last_word": pick(F.greatest, lasts).cast("bigint"),
        "__base": F.array_compact(F.array(*labels)),
    }


class TemplateIndex:
    """Templates as sorted ranks of their words in the global order, with the prefixes that the join goes by."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[str, int], threshold: float):
        words = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.entries = []
        for label, t in templates:
            ranks = sorted({self.rank[w] for w in t.split()})
            least = math.ceil(threshold * len(ranks) - 1e-9)
            self.entries.append((label, ranks, least, len(ranks) - least + 1))
        self.words = words
        self.prefix_words = sorted({words[r] for _, ranks, _, p in self.entries for r in ranks[:p]})
        self.least = min(e[2] for e in self.entries)

    def frame(self, docs: DataFrame) -> DataFrame:
        rows = [(r, i, label, ranks, least) for label, ranks, least, p in self.entries for i, r in enumerate(ranks[:p])]
        return docs.sparkSession.createDataFrame(rows, "__r int, __i int, __label string, __t array<int>, __least int")


def scan(
    docs: DataFrame,
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without their text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest start.
    labels adds those of every template of which some block holds at least ``threshold`` of the distinct words.
    score is the largest such share, and 1 where a phrase stands; 0 with neither.  Null counts as empty: no words,
    no labels (''), null first and last word.  Repeated rows are scanned each; an empty table gives an empty one.
    Input columns named as new ones are replaced.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    if len(vocabulary) > MOST_TEMPLATE_WORDS or max(len(t.split()) for _, t in templates) > LONGEST:
        raise ValueError(f"{len(vocabulary)} template words, at most {MOST_TEMPLATE_WORDS}; a template has at most {LONGEST}")
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in docs.columns if c not in (*new, text)]
    known = F.array(*map(F.lit, vocabulary))
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)])
    number = lambda words: F.transform(F.array_intersect(words, known), lambda w: F.element_at(numbers, w))
    least = min(math.ceil(threshold * len(set(t.split())) - 1e-9) for _, t in templates)

    # One pass over the texts: each is split once; what is kept is the numbers of the template words in it, and in its blocks where they are enough.
    folded = docs.select(*keep, fold(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__folded"))
    words = folded.withColumn("__words", F.array_remove(F.split("__folded", _SEPARATOR), ""))
    rows = words.select(*keep, "__words", F.size("__words").cast("bigint").alias("n_words"), *[v.alias(k) for k, v in phrase_columns(F.col("__folded"), phrases).items()])
    rows = rows.withColumn("__ids", number(F.col("__words")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("__words") - 1 - BLOCK // 2) / (BLOCK // 2)).cast("int")))
    blocks = F.filter(F.transform(starts, lambda i: number(F.slice("__words", i * (BLOCK // 2) + 1, BLOCK))), lambda b: F.size(b) >= least)
    rows = rows.withColumn("__blocks", F.when(F.size("__ids") >= least, blocks)).drop("__words")
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "license-words")

    counted = rows.select(F.explode("__ids").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a template word
    index = TemplateIndex(templates, {vocabulary[r["w"]]: r["n"] for r in counted}, threshold)
    ranks, prefix = F.array(*[F.lit(index.rank[w]) for w in vocabulary]), F.array(*[F.lit(index.rank[w]) for w in index.prefix_words])
    sets = rows.select("__row", F.explode(F.array_distinct(F.transform("__blocks", lambda b: F.array_sort(F.transform(b, lambda w: F.get(ranks, w)))))).alias("__s"))
    probes = sets.withColumn("__r", F.explode(F.array_intersect("__s", prefix)))
    joined = probes.join(F.broadcast(index.frame(docs)), "__r")
    left_t, left_s = F.size("__t") - F.col("__i"), F.size("__s") - F.array_position("__s", F.col("__r")) + 1
    possible = joined.where((F.size("__s") >= F.col("__least")) & (F.least(left_t, left_s) >= F.col("__least")))
    met = possible.withColumn("__overlap", F.size(F.array_intersect("__s", "__t"))).where(F.col("__overlap") >= F.col("__least"))
    found = met.groupBy("__row").agg(F.collect_set("__label").alias("__more"), F.max(F.col("__overlap") / F.size("__t")).alias("__best"))
    found = materialise(found, "licenses")
    out = rows.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, "__row", "left")
    more = F.coalesce("__more", F.array().cast("array<string>"))
    return out.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    pattern = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    phrases = " UNION ALL ".join(f"SELECT {p.split()} AS p, '{label}' AS label" for p, label in PHRASES)
    templates = " UNION ALL ".join(f"SELECT {sorted(set(t.split()))} AS t, '{label}' AS label" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {low} AS x FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, {pattern}) AS w FROM d),
ph AS ({phrases}), te AS ({templates}),
pl AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, p, label, unnest(range(len(w))) AS i FROM w, ph WHERE list_contains(w, p[1])) WHERE w[i + 1 : i + len(p)] = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM pl GROUP BY 1),
l AS (SELECT doc_id, w[i * {BLOCK // 2} + 1 : i * {BLOCK // 2} + {BLOCK}] AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - {BLOCK // 2}) / {BLOCK // 2}::double)::int))) AS i FROM w)),
m AS (SELECT doc_id, label, len(list_intersect(s, t)) / len(t)::double AS share FROM l, te WHERE len(list_intersect(s, t)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
k AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
