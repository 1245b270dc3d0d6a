"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by stratum (source, language, topic), the table of
strata is raked until its marginals meet the targets, and documents are drawn
with the probability that their stratum's raked weight asks for.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE_WORD

#: What stands for all values without a target of their own.
REST = "*"
#: Strata that may be raked and broadcast: the targets, not the data, set their number.
MOST_STRATA = 100_000

#: Shares of tokens that the query and the pipeline ask for.
TARGETS: dict[str, dict[str, float]] = {
    "source": {**{f"src{i}": 0.05 for i in range(20)}, REST: 0.05},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, REST: 0.05},
    "topic": {"prose": 0.85, "tabular": 0.1, "legal": 0.05},
}


def topic_of(text: Column) -> Column:
    """A topic by surface form: legal with a license word, tabular with cell bars, prose otherwise and for null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(F.lower(text), F.lit("licens")), "legal").when(F.contains(text, F.lit(" | ")), "tabular").otherwise("prose")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("bigint")


def _stratum(value: Column, targets: Mapping[str, float]) -> Column:
    value = F.coalesce(value.cast("string"), F.lit(REST))
    return F.when(value.isin([k for k in targets if k != REST]), value).otherwise(F.lit(REST))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], tokens: str, iterations: int) -> DataFrame:
    """``cells`` with ``share``, their raked shares of all tokens, and ``error``, the most by which a marginal still misses its target.

    Targets of values that no cell has are spread over the others in proportion; where no cell has any value with a target, all
    shares are 0.  The summed cells are brought to one partition, so the windows need no shuffle; their number is at most the
    product of the targets' sizes.
    """
    out = cells.repartition(1).withColumn("share", F.col(tokens).cast("double"))
    whole = Window.partitionBy()
    for d, wanted in targets.items():
        asked = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
        out = out.withColumn(f"__t_{d}", F.coalesce(F.element_at(asked, F.col(d)), F.lit(0.0)))
        each = F.col(f"__t_{d}") / F.count(F.lit(1)).over(Window.partitionBy(d))
        out = out.withColumn(f"__e_{d}", each)
        out = out.withColumn(f"__t_{d}", F.coalesce(F.try_divide(F.col(f"__t_{d}"), F.sum(f"__e_{d}").over(whole)), F.lit(0.0))).drop(f"__e_{d}")
    for _ in range(iterations):
        for d in targets:
            now = F.sum("share").over(Window.partitionBy(d))
            out = out.withColumn("share", F.when(now > 0, F.col("share") * F.col(f"__t_{d}") / now).otherwise(0.0))
    total = F.sum("share").over(whole)
    out = out.withColumn("share", F.when(total > 0, F.col("share") / total).otherwise(0.0))
    missed = [F.abs(F.sum("share").over(Window.partitionBy(d)) - F.col(f"__t_{d}")) for d in targets]
    out = out.withColumn("error", F.greatest(*missed, F.lit(0.0)))
    return out.withColumn("error", F.max("error").over(whole)).drop(*[f"__t_{d}" for d in targets])


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, the same on every run and engine."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(
    docs: DataFrame,
    dims: Mapping[str, Column],
    tokens: Column,
    targets: Mapping[str, Mapping[str, float]] = TARGETS,
    budget: float = 0.5,
    iterations: int = 12,
    key: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with mix_tokens, mix_rate, mix_copies and mix_error; rows with 0 copies are those not drawn.

    ``budget`` is the wanted number of tokens as a share of all.  mix_rate is the expected number of copies: the
    whole part is given, the rest is drawn by a number hashed from ``key``, so a rerun draws alike.  Null and
    unlisted values of a dimension form the stratum '*', whose target may be listed; without one (0) they get the rate 0.
    mix_error, the same for all rows, is the most by which a marginal misses its target after ``iterations`` rounds; it stays
    large where targets can't be met together.  Texts without tokens have their stratum's rate; where no stratum with tokens
    has a target, all rates are 0.  Rows with equal keys are drawn together.  An empty table gives an empty one; input
    columns with the names of the four new ones are replaced, others pass through.
    """
    strata = math.prod(len(x) + 1 for x in targets.values())
    if strata > MOST_STRATA:
        raise ValueError(f"{strata} strata; rake over at most {MOST_STRATA}")
    new = ("mix_tokens", "mix_rate", "mix_copies", "mix_error")
    own = {d: f"__mix_{d}" for d in targets}
    columns = [c for c in docs.columns if c not in new]
    marked = docs.select(
        *columns, *[_stratum(dims[d], targets[d]).alias(own[d]) for d in targets], tokens.cast("bigint").alias("mix_tokens")
    )
    cells = marked.groupBy(*own.values()).agg(F.sum("mix_tokens").alias("__have"))
    raked = rake(cells, {own[d]: targets[d] for d in targets}, "__have", iterations)
    rate = F.when(F.col("__have") > 0, F.col("share") * budget * F.sum("__have").over(Window.partitionBy()) / F.col("__have"))
    rates = raked.select(*own.values(), F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("mix_rate"), F.round("error", 6).alias("mix_error"))
    drawn = uniform(F.col(key), seed) < F.col("mix_rate") - F.floor("mix_rate")
    return (
        marked.join(F.broadcast(rates), list(own.values()))
        .withColumn("mix_copies", (F.floor("mix_rate") + drawn.cast("int")).cast("bigint"))
        .select(*columns, *new)
    )


def document_dims(docs: DataFrame) -> dict[str, Column]:
    return {"source": docs["source"], "lang": docs["lang"], "topic": topic_of(docs["text"])}


def sql(budget: float = 0.5, iterations: int = 12, seed: str = "mix") -> str:
    """The same over ``documents``: the raking steps are unrolled."""

    def stratum(c: str, d: str) -> str:
        listed = ", ".join(f"'{k}'" for k in TARGETS[d] if k != REST)
        return f"CASE WHEN {c} IN ({listed}) THEN {c} ELSE '{REST}' END AS {d}"

    topic = "CASE WHEN contains(lower(coalesce(text, '')), 'licens') THEN 'legal' WHEN contains(text, ' | ') THEN 'tabular' ELSE 'prose' END"
    steps, at = [], 0
    for d, wanted in TARGETS.items():
        asked = " ".join(f"WHEN '{k}' THEN {v}" for k, v in wanted.items())
        steps.append(f"c{at + 1} AS (SELECT *, CASE {d} {asked} ELSE 0 END::double AS u_{d}, count(*) OVER (PARTITION BY {d}) AS k_{d} FROM c{at})")
        steps.append(f"c{at + 2} AS (SELECT *, coalesce(u_{d} / nullif(sum(u_{d} / k_{d}) OVER (), 0), 0) AS t_{d} FROM c{at + 1})")
        at += 2
    for _ in range(iterations):
        for d in TARGETS:
            now = f"sum(share) OVER (PARTITION BY {d})"
            steps.append(f"c{at + 1} AS MATERIALIZED (SELECT * EXCLUDE (share), CASE WHEN {now} > 0 THEN share * t_{d} / {now} ELSE 0 END AS share FROM c{at})")
            at += 1
    missed = ", ".join(f"abs(sum(share) OVER (PARTITION BY {d}) - t_{d})" for d in TARGETS)
    return f"""
WITH m AS (
  SELECT doc_id, {stratum("source", "source")}, {stratum("lang", "lang")}, {topic} AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS mix_tokens
  FROM documents),
c0 AS (SELECT source, lang, topic, sum(mix_tokens)::double AS have, sum(mix_tokens)::double AS share FROM m GROUP BY ALL),
{", ".join(steps)},
n AS (SELECT * EXCLUDE (share), coalesce(share / nullif(sum(share) OVER (), 0), 0) AS share FROM c{at}),
e AS (SELECT *, greatest({missed}) AS off FROM n),
r AS (SELECT source, lang, topic, round(max(off) OVER (), 6) AS mix_error, round(CASE WHEN have > 0 THEN share * {budget} * sum(have) OVER () / have ELSE 0 END, 9) AS mix_rate FROM e)
SELECT doc_id, mix_tokens, mix_rate, mix_error,
       (floor(mix_rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|{seed}'), 1, 8))::bigint / 4294967296.0 < mix_rate - floor(mix_rate) THEN 1 ELSE 0 END)::bigint AS mix_copies
FROM m JOIN r USING (source, lang, topic)"""
