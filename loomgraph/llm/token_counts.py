"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens with their lengths and token
counts.  An edit splits and encodes anew only from the pre-token before it, as far as the
pre-token pattern may look ahead, to where the old borders hold again, and updates
the sums above.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

#: Pre-tokens of a leaf; a leaf of more than twice as many is split.
LEAF = 64
#: Characters after its end that may decide where a pre-token ends: a blank and what follows it, or the two letters of a contraction.
LOOK_AHEAD = 2
CACHED_PIECES = 500_000

EDIT = "array<struct<pos:bigint,n_delete:bigint,insert:string>>"


class Encoder:
    """Splits by a pre-token pattern and counts the tokens of each piece by a public vocabulary."""

    def __init__(self, ranks_file: str | None = None, pattern: str | None = None):
        import public_tokenizers

        pattern = pattern or public_tokenizers.PATTERN
        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n

    def counts(self, pieces: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            return np.fromiter(map(self.count, pieces), np.int64, len(pieces))

    def tree(self, text: str) -> PreTokenTree:
        pieces = self.split.findall(text)
        return PreTokenTree(np.fromiter(map(len, pieces), np.int64, len(pieces)), self.counts(pieces))


@functools.cache
def _encoder(ranks_file: str | None) -> Encoder:
    """One for all tasks of a worker, so that pieces are encoded once in it."""
    return Encoder(ranks_file)


class PreTokenTree:
    """Leaves of pre-tokens (length, tokens) under a binary tree of sums; node i has the children 2i and 2i + 1."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self._plant(lengths, counts)

    def _plant(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        at = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in at]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if len(lengths):
            self.sums[self.size : self.size + len(self.leaves)] = np.add.reduceat(np.stack([lengths, counts], 1), list(at), axis=0)
        n = self.size
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([leaf[k] for leaf in self.leaves]) for k in (0, 1))

    def find(self, pos: int) -> tuple[int, int, int]:
        """Leaf, place and start of the pre-token that holds a character; of the last one if there is none."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if pos - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        leaf = min(node - self.size, len(self.leaves) - 1)
        ends = start + np.cumsum(self.leaves[leaf][0])
        place = int(np.searchsorted(ends, pos, side="right"))
        return leaf, place, start if place == 0 else int(ends[place - 1])

    def after(self, leaf: int, place: int) -> Iterator[tuple[int, int, int]]:
        """(length, leaf, place) of the pre-tokens from there on."""
        for i in range(leaf, len(self.leaves)):
            lengths = self.leaves[i][0]
            for j in range(place if i == leaf else 0, len(lengths)):
                yield int(lengths[j]), i, j

    def replace(self, first: tuple[int, int], end: tuple[int, int], lengths: np.ndarray, counts: np.ndarray) -> None:
        """Puts new pre-tokens in the place of those from ``first`` to before ``end``."""
        (a, i), (b, j) = first, end
        for k in range(a, b + 1):
            head = [x[:i] for x in self.leaves[k]] if k == a else [x[:0] for x in self.leaves[k]]
            tail = [x[j:] for x in self.leaves[k]] if k == b else [x[:0] for x in self.leaves[k]]
            new = (lengths, counts) if k == a else (lengths[:0], counts[:0])
            self.leaves[k] = tuple(np.concatenate(x) for x in zip(head, new, tail, strict=True))
        if len(self.leaves[a][0]) > 2 * LEAF:
            self._plant(*self.flat())
            return
        for k in range(a, b + 1):
            node = self.size + k
            self.sums[node] = [x.sum() for x in self.leaves[k]]
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, text: str, pos: int, n_delete: int, insert: str, encoder: Encoder) -> tuple[str, int]:
        """The edited text and the number of pre-tokens that were encoded for it; the tree is updated."""
        pos = min(max(0, pos), len(text))
        n_delete = min(max(0, n_delete), len(text) - pos)
        new = text[:pos] + insert + text[pos + n_delete :]
        leaf, place, start = self.find(max(0, pos - LOOK_AHEAD))
        shift, kept_from = len(insert) - n_delete, pos + n_delete
        old = self.after(leaf, place)
        border, end = start, (leaf, place)  # before the next old pre-token
        pieces: list[str] = []
        done = start
        for match in encoder.split.finditer(new, start):
            # Where an old border behind the edit meets a new one, both texts go on alike.
            while border < kept_from or border + shift < done:
                if (step := next(old, None)) is None:
                    break
                border, end = border + step[0], (step[1], step[2] + 1)
            if done >= pos + len(insert) and border >= kept_from and border + shift == done:
                break
            pieces.append(match.group())
            done = match.end()
        else:
            end = (len(self.leaves) - 1, len(self.leaves[-1][0]))
        self.replace((leaf, place), end, np.fromiter(map(len, pieces), np.int64, len(pieces)), encoder.counts(pieces))
        return new, len(pieces)


def _mapped(docs: DataFrame, used: list[str], new: str, make: Callable[[], Callable[..., tuple]], without: Iterable[str] = ()) -> DataFrame:
    """``docs`` with columns made row by row from the used ones, and ``without`` some; columns with the new names are replaced."""
    names = [x.split()[0] for x in new.split(", ")]
    columns = [c for c in docs.columns if c not in names]
    kept = [c for c in columns if c not in without]
    out = docs.select(*kept)
    for x in new.split(", "):
        out = out.withColumn(x.split()[0], F.lit(None).cast(x.split(" ", 1)[1]))
    schema = out.schema
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(schema[n].dataType) for n in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                given = [part.column(columns.index(c)).to_pylist() for c in used]
                rows = [step(*x) for x in zip(*given, strict=True)]
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in kept], *made], [*kept, *names])

    return docs.select(*columns).mapInArrow(run, schema)


def build_trees(docs: DataFrame, text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """``docs`` with n_pretokens, n_tokens and tree_lengths, tree_counts: the leaves of each text's tree, to be stored as 32-bit numbers; null counts as empty."""

    def make():
        encoder = _encoder(ranks_file)

        def step(body):
            tree = encoder.tree(body or "")
            return _stored(tree)

        return step

    return _mapped(docs, [text], TREE, make)


TREE = "n_pretokens bigint, n_tokens bigint, tree_lengths binary, tree_counts binary"


def _stored(tree: PreTokenTree) -> tuple[int, int, bytes, bytes]:
    lengths, counts = tree.flat()
    return len(lengths), tree.n_tokens, lengths.astype("<i4").tobytes(), counts.astype("<i4").tobytes()


def _planted(lengths: bytes, counts: bytes) -> PreTokenTree:
    return PreTokenTree(*(np.frombuffer(x, "<i4").astype(np.int64) for x in (lengths, counts)))


def update_trees(stored: DataFrame, edits: str = "edits", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """Stored rows with their edits applied: text, tree and n_tokens anew, and n_encoded, the pre-tokens encoded for it.

    ``edits`` is an array of (pos, n_delete, insert), applied one after the other; positions and lengths count code points
    and are cut to the text, null ones are 0 and a null insert is empty.  Rows without edits stay as they are.
    """

    def make():
        encoder = _encoder(ranks_file)

        def step(body, lengths, counts, todo):
            tree = _planted(lengths, counts)
            body, n = _apply(tree, body or "", todo, encoder)
            return *_stored(tree), body, n

        return step

    done = _mapped(stored.withColumnsRenamed({"tree_lengths": "__l", "tree_counts": "__c"}), [text, "__l", "__c", edits], f"{TREE}, __text string, n_encoded bigint", make)
    return done.withColumn(text, F.col("__text")).drop("__text", "__l", "__c")


def _apply(tree: PreTokenTree, body: str, todo: list | None, encoder: Encoder) -> tuple[str, int]:
    n = 0
    for e in todo or ():
        body, k = tree.edit(body, e["pos"] or 0, e["n_delete"] or 0, e["insert"] or "", encoder)
        n += k
    return body, n


def count_edited(docs: DataFrame, edits: str = "edits", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """``docs`` without text and edits, with the counts before and after all edits: stores the texts with their trees and updates what is stored.

    New columns: n_pretokens and n_tokens of the text, n_tokens_after and n_encoded of the edits.  Null and empty texts
    have no tokens and take insertions; every row stays.
    """
    new = ("n_pretokens", "n_tokens", "n_tokens_after", "n_encoded")
    keep = [c for c in docs.columns if c not in (*new, text, edits)]
    stored = materialise(build_trees(docs.select(*[c for c in docs.columns if c not in new]), text, ranks_file), "trees")

    def make():
        encoder = _encoder(ranks_file)

        def step(body, lengths, counts, todo):
            tree = _planted(lengths, counts)
            _, n = _apply(tree, body or "", todo, encoder)
            return tree.n_tokens, n

        return step

    done = _mapped(stored, [text, "tree_lengths", "tree_counts", edits], "n_tokens_after bigint, n_encoded bigint", make, [text, edits, "tree_lengths", "tree_counts"])
    return done.select(*keep, *new)


#: What the query's three edits insert.
INSERTED = ("[redacted]", " it's", "\n\n  ")


def sample_edits(key: Column, text: Column) -> Column:
    """Three edits per document at places hashed from its id: each cuts up to 39 characters and inserts a string."""

    def number(k: int, what: str, n: Column) -> Column:
        return F.pmod(F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{k}|{what}")).cast("binary")), n)

    length = F.length(F.coalesce(text, F.lit(""))).cast("bigint") + 1
    return F.array(
        *[
            F.struct(number(k, "pos", length).alias("pos"), number(k, "cut", F.lit(40).cast("bigint")).alias("n_delete"), F.lit(s).alias("insert"))
            for k, s in enumerate(INSERTED)
        ]
    )
