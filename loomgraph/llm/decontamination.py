"""Benchmark decontamination over a positional inverted index.

The index is document-partitioned: each block of consecutive documents holds its
own terms with the positions of their occurrences, so building it needs no
shuffle and a block is searched where it lies.  A search intersects
offset-adjusted posting lists from the rarest term on.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import ALNUM_TABLE, materialise, pieces, text_bytes

#: A block is closed when it has this many words; a longer document has a block of its own size.
BLOCK_WORDS = 1_000_000
#: Items are searched in chunks of this many bytes of text, one after the other; each chunk is broadcast and dropped again.
CHUNK_BYTES = 32_000_000
WINDOW = 10
#: In the query and the pipeline, all words of an item within so many times its length are a match.
SLACK = 1.5

INDEX = "block bigint, doc_ids array<{id}>, doc_words binary, terms binary, term_counts binary, postings binary"
FOUND = "block bigint, place int, doc_id {id}, n_words bigint, items array<struct<item_id:{item},spans:array<struct<first:int,last:int>>>>, near array<{item}>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at all other ASCII but letters and digits."""
    return text.translate(ALNUM_TABLE).split()


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _block(number: int, ids: list, lengths: list[int], codes: list[np.ndarray], vocabulary: dict[bytes, int], id_type: pa.DataType) -> pa.RecordBatch:
    """Documents follow each other with one free position between them, so no phrase runs over a border."""
    counts = np.array(lengths, np.int64)
    starts = np.cumsum(counts + 1) - (counts + 1)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    at = np.arange(len(code), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
    assert not len(counts) or starts[-1] < 2**31
    order = np.argsort(code, kind="stable")
    postings = at[order]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([ids], pa.list_(id_type)),
            pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
            pa.array([b"\n".join(vocabulary)], pa.binary()),
            pa.array([np.bincount(code, minlength=len(vocabulary)).astype(np.int32).tobytes()], pa.binary()),
            pa.array([np.diff(postings, prepend=0).astype(np.int32).tobytes()], pa.binary()),
        ],
        ["block", "doc_ids", "doc_words", "terms", "term_counts", "postings"],
    )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of documents: its number, their ids and word counts, the block's terms, and the postings of each term."""
    kind = docs.schema[doc_id].dataType
    id_type = _arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            v = defaultdict()
            v.default_factory = v.__len__
            return [], [], [], v

        ids, lengths, codes, vocabulary = fresh()
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in pieces(batches):
            for key, body in zip(batch.column(0).to_pylist(), text_bytes(batch, 1), strict=True):
                words = words_of(body)
                ids.append(key)
                lengths.append(len(words))
                codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield _block(number, ids, lengths, codes, vocabulary, id_type)
                    ids, lengths, codes, vocabulary = fresh()
                    number, size = number + 1, 0
        if ids:
            yield _block(number, ids, lengths, codes, vocabulary, id_type)

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, INDEX.format(id=kind.simpleString()))


class Block:
    """A block of the index, opened for the terms that are asked for."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.words = np.frombuffer(row["doc_words"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.words + 1) - (self.words + 1)
        terms = row["terms"].split(b"\n") if row["terms"] else []
        self.number = {t: i for i, t in enumerate(terms)}
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["term_counts"], np.int32), dtype=np.int64)])
        self.postings = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)

    def count(self, term: bytes) -> int:
        i = self.number.get(term)
        return 0 if i is None else int(self.bounds[i + 1] - self.bounds[i])

    def at(self, term: bytes) -> np.ndarray:
        i = self.number[term]
        return self.postings[self.bounds[i] : self.bounds[i + 1]]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def phrase(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """Where the words stand one after the other: the rarest term's list, each further list shifted by its offset."""
        order = sorted(range(len(words)), key=counts.__getitem__)
        start = self.at(words[order[0]]) - order[0]
        for j in order[1:]:
            if not len(start):
                break
            other = self.at(words[j])
            k = np.searchsorted(other, start + j)
            k[k == len(other)] = 0
            start = start[other[k] == start + j]
        return start

    def near(self, words: set[bytes], span: int) -> set[int]:
        """Documents in which some ``span`` consecutive words hold all the words."""
        lists = sorted((self.at(w) for w in words), key=len)
        anchor = lists[0]
        for other in lists[1:]:
            k = np.searchsorted(other, anchor - span + 1)
            k[k == len(other)] = len(other) - 1
            anchor = anchor[np.abs(other[k] - anchor) < span]
            if not len(anchor):
                return set()
        found = set()
        for a, d in zip(anchor.tolist(), self.document(anchor).tolist(), strict=True):
            if d in found:
                continue
            low, high = max(a - span + 1, int(self.starts[d])), min(a + span - 1, int(self.starts[d] + self.words[d]) - 1)
            close = [x[np.searchsorted(x, low) : np.searchsorted(x, high, side="right")] for x in lists]
            if not all(map(len, close)):
                continue
            first = np.concatenate(close)
            last = np.full(len(first), -1)
            for x in close:
                k = np.searchsorted(x, first)
                last = np.maximum(last, np.where(k < len(x), x[np.minimum(k, len(x) - 1)], 2**60))
            if (last - first < span).any():
                found.add(d)
        return found


def windows_of(words: list[bytes], window: int) -> list[list[bytes]]:
    return [words] if len(words) < window else [words[i : i + window] for i in range(len(words) - window + 1)]


class Items:
    """A chunk of the benchmark: its different words, each item's words by their numbers, and the places of all windows."""

    def __init__(self, items: list[tuple], window: int):
        self.ids = [i for i, w in items if w]
        lists = [w for _, w in items if w]
        number: dict[bytes, int] = {}
        self.flat = np.array([number.setdefault(w, len(number)) for words in lists for w in words], np.int64)
        self.words = list(number)
        self.sizes = np.array([len(w) for w in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.window = np.minimum(self.sizes, window)
        many = self.sizes - self.window + 1
        self.item = np.repeat(np.arange(len(lists)), many)
        self.at = np.repeat(self.starts - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def search_block(block: Block, items: Items, slack: float) -> tuple[dict[int, list], dict[int, list]]:
    """For each document of the block by its number: (item, merged spans) of exact windows, and the items near by.

    Each different word is looked up once; only windows, and for proximity items, all of whose words the block has are searched.
    """
    exact: dict[int, list] = defaultdict(list)
    near: dict[int, list] = defaultdict(list)
    counts = np.fromiter(map(block.count, items.words), np.int64, len(items.words))
    there = np.concatenate([[0], np.cumsum(counts[items.flat] > 0)])
    whole = lambda at, n: there[at + n] - there[at] == n
    found: dict[int, list[np.ndarray]] = defaultdict(list)
    for k in np.flatnonzero(whole(items.at, items.window[items.item])).tolist():
        item, at = int(items.item[k]), int(items.at[k])
        codes = items.flat[at : at + int(items.window[item])]
        found[item].append(block.phrase([items.words[c] for c in codes], counts[codes].tolist()))
    for item, starts in found.items():
        start, n = np.unique(np.concatenate(starts)), int(items.window[item])
        if not len(start):
            continue
        # Windows that touch or overlap in a document are one span.
        doc = block.document(start)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(start) > n) | (np.diff(doc) > 0)]))
        last = np.concatenate([new[1:] - 1, [len(start) - 1]])
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, a, b in zip(doc[new].tolist(), (start[new] - block.starts[doc[new]]).tolist(), (start[last] + n - 1 - block.starts[doc[new]]).tolist(), strict=True):
            spans[d].append((a, b))
        for d, s in spans.items():
            exact[d].append((items.ids[item], s))
    for item in np.flatnonzero(whole(items.starts, items.sizes)).tolist() if slack else ():
        size = int(items.sizes[item])
        words = {items.words[c] for c in items.flat[items.starts[item] : items.starts[item] + size]}
        for d in block.near(words, max(size, int(slack * size))):
            near[d].append(items.ids[item])
    return exact, near


def _chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in chunks of bounded size, each with its words."""
    chunk, size = [], 0
    for item, body in benchmark.select(item_id, F.col(text).cast("string")).toLocalIterator():
        words = words_of((body or "").encode())
        chunk.append((item, words))
        size += sum(map(len, words))
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    yield chunk


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slack: float = 0.0) -> DataFrame:
    """One row per indexed document: doc_id, n_words, its items with the spans of words that their windows cover, and the items near by.

    A window is ``window`` consecutive words of an item; a shorter item, but not an empty one, is one window.
    Spans count words from 0, both ends included.  ``slack`` over 0 adds proximity matches: items all of whose
    words stand, in any order, within ``slack`` times the item's length.  Null texts have no words; null ids are
    returned as they are; equal items are reported each.
    """
    spark = index.sparkSession
    id_kind, item_kind = index.schema["doc_ids"].dataType.elementType, benchmark.schema[item_id].dataType
    id_type, item_type = _arrow_type(id_kind), _arrow_type(item_kind)
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = FOUND.format(id=id_kind.simpleString(), item=item_kind.simpleString())

    def searcher(sent, hits_only: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, window)
            for one in pieces(batches, 1):
                for row in one.to_pylist():
                    block = Block(row)
                    exact, near = search_block(block, items, slack)
                    some = np.array(sorted({*exact, *near}) if hits_only else range(len(block.ids)), np.int64)
                    hits = [[{"item_id": i, "spans": [{"first": a, "last": b} for a, b in s]} for i, s in exact.get(d, ())] for d in some.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["block"]] * len(some), pa.int64()),
                            pa.array(some, pa.int32()),
                            pa.array([block.ids[d] for d in some.tolist()], id_type),
                            pa.array(block.words[some], pa.int64()),
                            pa.array(hits, pa.list_(pa.struct([("item_id", item_type), ("spans", span_type)]))),
                            pa.array([near.get(d, []) for d in some.tolist()], pa.list_(item_type)),
                        ],
                        [x.split()[0] for x in ("block", "place", "doc_id", "n_words", "items", "near")],
                    )

        return run

    def found(chunk: list, hits_only: bool) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(chunk)
        return index.mapInArrow(searcher(sent, hits_only), schema), sent

    chunks = _chunks(benchmark, item_id, text)
    out = found(next(chunks), False)[0]
    more = []
    for chunk in chunks:
        hits, sent = found(chunk, True)
        more.append(materialise(hits.select("block", "place", "items", "near"), "found"))
        sent.unpersist()
    if more:
        # Documents that further chunks hit, by their place in the stored index.
        each = functools.reduce(DataFrame.unionByName, more).groupBy("block", "place")
        each = each.agg(F.flatten(F.collect_list("items")).alias("__i"), F.flatten(F.collect_list("near")).alias("__m"))
        both = {c: F.concat(c, F.coalesce(n, F.array().cast(out.schema[c].dataType))) for c, n in (("items", "__i"), ("near", "__m"))}
        out = out.join(each, ["block", "place"], "left").withColumns(both).drop("__i", "__m")
    return out.drop("block", "place")


def covered(items: Column) -> Column:
    """How many words the spans of all items cover together."""
    spans = F.array_sort(F.flatten(F.transform(items, lambda x: x["spans"])))
    zero = F.struct(F.lit(-1).alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["last"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["to"], s["first"] - 1))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def digest(found: DataFrame, *more: Column) -> DataFrame:
    """Per document: word and hit counts, and the number and SHA-256 of the ids of its items (null ids left out)."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda x: x["item_id"].cast("string")), lambda x: x.isNotNull())))
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("items")).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        *more,
    )


def scan(docs: DataFrame, benchmark: DataFrame, slack: float = SLACK) -> DataFrame:
    """The digest of documents against a benchmark, by way of a stored index, with the number of items whose words stand near by and the
    SHA-256 of their ids (null ids left out)."""
    found = search(materialise(build_index(docs), "index"), benchmark, slack=slack)
    near = F.array_sort(F.array_distinct(F.filter(F.transform("near", lambda x: x.cast("string")), lambda x: x.isNotNull())))
    return digest(found, F.size(near).cast("bigint").alias("n_near"), F.sha2(F.array_join(near, ","), 256).alias("near_sha256"))


def sql(slack: float = SLACK) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM m GROUP BY 1),
bt AS (SELECT item_id, list_distinct(w) AS t, len(w) AS size, greatest(len(w), floor({slack} * len(w)))::int AS span FROM b WHERE len(w) > 0),
nd AS (SELECT doc_id, w, list_distinct(w) AS t FROM d),
c AS (SELECT doc_id, item_id, w, bt.t, span FROM bt JOIN nd ON list_has_all(nd.t, bt.t)),
cp AS (SELECT doc_id, item_id, t, span, p, w[p] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM c) WHERE list_contains(t, w[p])),
nw AS (SELECT DISTINCT y.doc_id, y.item_id FROM (SELECT x1.doc_id, x1.item_id, x1.p, count(DISTINCT x2.x) AS n, any_value(len(x1.t)) AS want
  FROM cp x1 JOIN cp x2 ON x1.doc_id = x2.doc_id AND x1.item_id = x2.item_id AND x2.p >= x1.p AND x2.p < x1.p + x1.span GROUP BY 1, 2, 3) y WHERE n = want),
nk AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS near FROM nw GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN nk USING (doc_id)"""
