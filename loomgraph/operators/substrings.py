"""Which of many patterns stand in which texts, by one walk over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns are looked for in chunks of so many characters; each is an automaton of its own on the executors.
CHUNK_CHARS = 4_000_000


def _finder(sent):
    """For each row the distinct numbers of the patterns within its texts, in the column ``__found``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), []
        for text, numbers in sent.value.items():
            if text:
                automaton.add_word(text, numbers)
            else:
                everywhere = numbers
        automaton.make_automaton()
        some = len(automaton) > 0
        for batch in batches:
            out = []
            for texts in batch.column(batch.num_columns - 1).to_pylist():
                known = [t for t in texts if t is not None]
                found = set(everywhere) if known else set()
                for t in known if some else ():
                    for _, numbers in automaton.iter(t):
                        found.update(numbers)
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "__found"])

    return run


def _chunks(patterns: DataFrame, columns: list[str]) -> Iterator[tuple[list[tuple], dict[str, list[int]]]]:
    """The patterns' rows, numbered, and their numbers by text, in chunks of bounded size; null ones stand nowhere."""
    rows: list[tuple] = []
    texts: dict[str, list[int]] = {}
    size = 0
    for r in patterns.select("__pattern", *columns).toLocalIterator():
        if r[0] is None:
            continue
        texts.setdefault(r[0], []).append(len(rows))
        rows.append((len(rows), *r[1:]))
        size += len(r[0])
        if size >= CHUNK_CHARS:
            yield rows, texts
            rows, texts, size = [], {}, 0
    yield rows, texts


def contained(rows: DataFrame, texts: list[Column], patterns: DataFrame, pattern: Column) -> DataFrame:
    """``rows`` joined with each row of ``patterns`` whose pattern some of the texts contain; no two columns may share a name.

    A text is walked once for all patterns of a chunk, so the work is that of the texts and of what is found.  The patterns are the
    smaller side: they pass through the driver in bounded chunks.
    """
    spark, columns = rows.sparkSession, patterns.columns
    kinds = {f.name: f.dataType for f in patterns.schema}
    asked = rows.withColumn("__found", F.array(*texts))
    schema = rows.withColumn("__found", F.array().cast("array<bigint>")).schema
    out = None
    for known, by_text in _chunks(patterns.withColumn("__pattern", pattern), columns):
        numbered = ", ".join(["__n bigint", *[f"`{c}` {kinds[c].simpleString()}" for c in columns]])
        found = asked.mapInArrow(_finder(spark.sparkContext.broadcast(by_text)), schema).withColumn("__n", F.explode("__found")).drop("__found")
        part = found.join(F.broadcast(spark.createDataFrame(known, numbered)), "__n").drop("__n")
        out = part if out is None else out.unionByName(part)
    return out
