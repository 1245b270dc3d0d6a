"""LM scoring by online logistic context mixing.

A word is coded as the bits of its class, the first 10 bits or more of its hash, and then as itself among the words of its
class.  Each bit is predicted by the class alone, by counts of all training text in the context of the word before and in the hashed context
of the two words before, and by what followed these words last in the same text.  A logistic mixer combines the
predictions; its weights are chosen by how often the two words before were met, start from weights learned on training text and go on
learning through the whole text; an adaptive map refines its output.  The word within its class is predicted by the two words before,
smoothed by what is known without them.  The sum over bits and words is the text's probability.

A training text is scored by the counts of everything but the token that is predicted, so one that is there once is scored like a
held-out text, and one that is there twice by its copy.

What is counted grows with the text: of each two words in a row all that follow are counted, under a hash whose width grows
with the training tokens; so does the number of classes.  These counts are never in one place: blocks ask for the words and (context, word) pairs that they
hold, by ranges of the key; a range sums what all blocks have counted and answers each.  The contexts of one word are the most
frequent words and, for all others, their class; this table has a fixed size and goes to all executors.  Texts are encoded once,
into blocks of word numbers that stay where they are written; 64-bit hashes stand for words, of which among a thousand million two
are expected to share one with a probability of 3 %.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from tempfile import SpooledTemporaryFile
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bucketed, discard, materialise, pieces, text_bytes

FOLDS = 10
BLOCK_TOKENS = 1_200_000
#: Bits of a word's hash that a context's counts tell apart; the first of them are its class.
CODE = 20
BITS, MOST_BITS = 10, 16
#: Training tokens up to which BITS holds; one bit more with each doubling.
GROW_FROM = 1 << 26
#: Bits of a context's hash beyond those that number the training tokens: a context meets another's counts once in 256.
CHECK_BITS = 8
#: About so many words or (context, word) pairs are summed at a time.
RANGE_KEYS = 1_000_000
#: Texts that are coded side by side, and tokens that each codes before its weights learn from them.
LANES, CHUNK = 256, 16
#: Words that are contexts of their own, the most frequent ones; others before a word count by the first CELL_BITS bits of their hash,
#: as does what follows.  The table has (FREQUENT + 2^CELL_BITS + 1) * 2^CELL_BITS cells and is summed in so many parts.
FREQUENT, CELL_BITS, CELL_PARTS = 4096, 10, 32
#: Log odds are held in one byte each, of up to 127 / STEPS.
STEPS = 14
#: Predictors (class, word before, two words before, own text) and the mixer's weight sets: by how often the two words before
#: were met (never, to 3, to 40, more) and by what the own text offers (nothing, what followed one word, or two).
K, LEVELS, OFFERS = 4, 4, 3
#: What a step of each predictor's odds is worth.
UNIT = np.array([1, 1 / STEPS, 1 / STEPS, 1], np.float32)
GATES = LEVELS * OFFERS
# Weights before any learning, the rates of learning and of refining, and what smooths a count of words.
FIRST_WEIGHTS = np.array([0.2, 0.4, 0.5, 0.3], np.float32)
LEARN, REFINE, SMOOTH = 0.006, 0.02, 0.6
RIDGE, BINS = 50.0, 17

BLOCK = "block bigint, n_words bigint, n_train bigint, doc_ids array<bigint>, held array<boolean>, n_bytes array<bigint>, n_tokens binary, tokens binary, words binary"
ASKED = "part int, block bigint, kind int, keys binary, counts binary"
ANSWER = "block bigint, kind int, part int, payload binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def held_out(doc_id: int | None, folds: int) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def pack(x: np.ndarray) -> bytes:
    """Numbers of 32 or 64 bits, by planes of their bytes, compressed: small ones take little."""
    size = x.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unpack(x: bytes, kind: str = "<i4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds |= {"array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def encode(docs: DataFrame, folds: int) -> DataFrame:
    """Blocks of documents as word numbers, each text closed by an end token (the empty word), with the hashes of the block's words."""

    def block(number: int, ids: list, held: list, sizes: list, codes: list, vocabulary: dict) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, codes), np.int32, len(codes))
        flat = np.concatenate(codes)
        # Words are numbered anew by frequency, so that most numbers are small.
        order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[order]
        n_train = int(lengths[~np.array(held, bool)].sum())
        return _batch([[x] for x in (number, len(words), n_train, ids, held, sizes, pack(lengths), pack(place[flat]), words.tobytes())], BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            v = defaultdict()
            v.default_factory = v.__len__
            return [], [], [], [], v

        number, size = TaskContext.get().partitionId() << 20, 0
        ids, held, sizes, codes, vocabulary = fresh()
        for batch in pieces(batches):
            for doc_id, body in zip(batch.column(0).to_pylist(), text_bytes(batch, 1), strict=True):
                words = body.lower().split()
                words.append(b"")
                ids.append(doc_id)
                held.append(held_out(doc_id, folds))
                sizes.append(len(body))
                codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield block(number, ids, held, sizes, codes, vocabulary)
                    ids, held, sizes, codes, vocabulary = fresh()
                    number, size = number + 1, 0
        if ids:
            yield block(number, ids, held, sizes, codes, vocabulary)

    return docs.mapInArrow(run, BLOCK)


class Block:
    """A block of texts, opened: hashes of its words, the tokens of its texts one after the other, and which of them train."""

    def __init__(self, row: dict):
        self.words, self.tokens, self.lengths = np.frombuffer(row["words"], np.uint64), unpack(row["tokens"]), unpack(row["n_tokens"]).astype(np.int64)
        self.held = np.repeat(np.array(row["held"], bool), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.starts] = True


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# Words: asked by block, summed by ranges of their hashes


def _part_bits(keys: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, keys / RANGE_KEYS)))))


def _ask_words(part_bits: int):
    """A block's words, sorted by hash, and how often its training text has them, cut into ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _blocks(batches):
            block = Block(row)
            counts = np.bincount(block.tokens[~block.held], minlength=len(block.words))
            order = np.argsort(block.words)
            keys, counts = block.words[order], counts[order]
            part = (keys >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(keys), np.int64)
            edge = np.searchsorted(part, np.arange((1 << part_bits) + 1))
            yield _asked(row["block"], 0, [(p, keys[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a])

    return run


def _asked(block: int, kind: int, made: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys = [pack(np.diff(k, prepend=np.uint64(0))) for _, k, _ in made]
    return _batch([[p for p, _, _ in made], [block] * len(made), [kind] * len(made), keys, [pack(c.astype(np.int32)) for _, _, c in made]], ASKED)


def _keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, "<u8"), dtype=np.uint64)


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts; and where each of the given keys stands among them."""
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    new = np.flatnonzero(new)
    return keys[new], np.add.reduceat(counts, new), place


def _summed(shift: int, answer: Callable[[np.ndarray, np.ndarray], Callable]):
    """Sums the counts (above ``shift`` bits of marks) of each range and kind over all blocks and answers each block.

    What was asked is held where it is short, and else summed up as it comes and read again, from disk if need be.
    """

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(k)[i].as_py() for k in range(5))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, kind), rows in groupby(asked(batches), lambda r: (r[0], r[2])):
            with SpooledTemporaryFile(64_000_000) as wait:
                held, found, marks, size, short = [], [], [], 0, True
                for _, block, _, packed, marked in rows:
                    held.append((block, len(packed), len(marked)))
                    wait.write(packed)
                    wait.write(marked)
                    keys, mark = _keys(packed), unpack(marked)
                    found.append((keys, mark.astype(np.int64) >> shift))
                    marks.append(mark)
                    size += len(keys)
                    if size > 4 * RANGE_KEYS and (short or size > 2 * len(found[0][0])):
                        found, marks, short = [_merge(found)[:2]], [], False
                        size = len(found[0][0])
                every, counts, place = _merge(found)
                one = answer(every, counts)
                if (whole := one(None, None, None)) is not None:
                    yield _batch([[None], [kind], [part], [whole]], ANSWER)
                wait.seek(0)
                start = 0
                for i, (block, a, b) in enumerate(held):
                    if short:
                        keys, mark = found[i][0], marks[i]
                        at = place[start : start + len(keys)]
                        start += len(keys)
                    else:
                        keys, mark = _keys(wait.read(a)), unpack(wait.read(b))
                        at = np.searchsorted(every, keys)
                    yield _batch([[block], [kind], [part], [one(at, keys, mark)]], ANSWER)

    return run


def _word_answer(every: np.ndarray, counts: np.ndarray):
    """The counts of a block's words; to no block, how many tokens and different words of training text each class has, and the most frequent words."""

    def one(at: np.ndarray | None, keys: np.ndarray | None, marked: np.ndarray | None) -> bytes:
        if at is not None:
            return pack(counts[at])
        place = (every >> np.uint64(64 - MOST_BITS)).astype(np.int64)
        c, v = np.zeros(1 << MOST_BITS, np.int64), np.zeros(1 << MOST_BITS, np.int64)
        np.add.at(c, place, counts)
        np.add.at(v, place, counts > 0)
        used = np.flatnonzero(c)
        top = np.lexsort((every, -counts))[:FREQUENT]
        top = top[counts[top] > 0]
        return len(top).to_bytes(4, "little") + pack(np.concatenate([every[top].view(np.int64), counts[top], used, c[used], v[used]]))

    return one


def _stats(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and counts of the most frequent, and (class, tokens, different words)."""
    n, flat = int.from_bytes(payload[:4], "little"), unpack(payload[4:], "<i8")
    return flat[:n], flat[n : 2 * n], flat[2 * n :].reshape(3, -1)


def _top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            yield _batch(list(_stats(x)[:2]), "word bigint, c bigint")


def _class_sums(n_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = np.zeros(1 << n_bits, np.int64), np.zeros(1 << n_bits, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                used, some, different = _stats(x)[2]
                np.add.at(c, used >> (MOST_BITS - n_bits), some)
                np.add.at(v, used >> (MOST_BITS - n_bits), different)
        used = np.flatnonzero(c)
        yield _batch([used, c[used], v[used]], "class bigint, c bigint, v bigint")

    return run


# Contexts: asked by block, summed by ranges of their hashes


def sizes(n_total: int) -> int:
    """Class bits for so many training tokens."""
    return min(MOST_BITS, BITS + int(np.log2(max(1.0, n_total / GROW_FROM))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, back: int) -> np.ndarray:
    """The value so many places before in the same text; 0 where the text begins."""
    out = np.zeros_like(values)
    out[back:] = values[:-back]
    for k in range(back):
        out[starts[lengths > k] + k] = 0
    return out


def cells_of(block: Block, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of the word before each token, by its place among the frequent words (sorted hashes), or else by its class, or as the text's start; and each token's own class."""
    coarse = (block.words >> np.uint64(64 - CELL_BITS)).astype(np.int32)
    at = np.minimum(np.searchsorted(frequent, block.words), max(0, len(frequent) - 1))
    known = frequent[at] == block.words if len(frequent) else np.zeros(len(block.words), bool)
    context = np.where(known, at, FREQUENT + coarse).astype(np.int32)
    return _before(context[block.tokens] + 1, block.starts, block.lengths, 1) - 1 + (FREQUENT + (1 << CELL_BITS) + 1) * block.first, coarse[block.tokens]


def _count_cells(frequent: np.ndarray):
    """How often training text has each cell, by parts of the contexts; a task adds up its blocks before it sends them."""
    contexts = FREQUENT + (1 << CELL_BITS) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(contexts << CELL_BITS, np.int64)
        for row in _blocks(batches):
            block = Block(row)
            context, own = cells_of(block, frequent)
            sums += np.bincount((context[~block.held] << CELL_BITS) + own[~block.held], minlength=len(sums))
        cuts = [(contexts * k // CELL_PARTS) << CELL_BITS for k in range(CELL_PARTS + 1)]
        yield _batch([list(range(CELL_PARTS)), [pack(sums[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]], "part int, cells binary")

    return run


def odds(taken: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log odds, in steps of a byte, of a way that was taken so often where the other was so often."""
    return np.clip(np.rint(STEPS * np.log((taken + np.float32(0.4)) / (other + np.float32(0.4)))), -127, 127).astype(np.int8)


def cell_odds(cells: np.ndarray) -> np.ndarray:
    """(2, contexts, nodes): at each node of the code tree of the classes the odds of the way to it, with one occurrence taken away and with all."""
    sums = cells.reshape(-1, 1 << CELL_BITS).astype(np.float32)
    out = np.zeros((2, len(sums), 2 << CELL_BITS), np.int8)
    for bit in reversed(range(1, CELL_BITS + 1)):
        other = sums.reshape(len(sums), -1, 2)[:, :, ::-1].reshape(sums.shape)
        for less in (1, 0):
            out[1 - less, :, 1 << bit : 2 << bit] = odds(np.maximum(sums - less, 0), other)
        sums = sums.reshape(len(sums), -1, 2).sum(2)
    return out


def _sum_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The odds of a part's contexts, from the sums of all tasks' counts."""
    for part, rows in groupby(((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows)), lambda r: r[0]):
        yield _batch([[part], [zstandard.compress(cell_odds(sum(unpack(x, "<i8") for _, x in rows)).tobytes())]], "part int, odds binary")


def contexts(block: Block) -> np.ndarray:
    """The hash of the two words before each token; 0 stands before the first."""
    hashes = block.words[block.tokens]
    one, two = (_before(hashes, block.starts, block.lengths, k) for k in (1, 2))
    return _mix(_mix(one + np.uint64(0xD1342543DE82EF95)) ^ two)


def pairs_of(block: Block, part_bits: int, context_bits: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """The different (context, word) pairs of each range, sorted, and for each token where its pair stands among all of them.

    A pair is the context's bits after those that number the range, and CODE bits of the word in its low bits.
    """
    context = contexts(block)
    part = (context >> np.uint64(64 - part_bits)).astype(np.uint16 if part_bits <= 16 else np.int64) if part_bits else np.zeros(len(context), np.uint16)
    stored = (context >> np.uint64(64 - part_bits - context_bits)) & np.uint64((1 << context_bits) - 1)
    pair = stored << np.uint64(CODE) | (block.words >> np.uint64(64 - CODE))[block.tokens]
    order = np.argsort(part, kind="stable")
    place, parts, n = np.empty(len(pair), np.int64), [], 0
    edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]])) if len(order) else [0]
    for a, b in zip(edge, edge[1:], strict=False):
        at = order[a:b]
        keys, where = np.unique(pair[at], return_inverse=True)
        place[at] = where + n
        parts.append((int(part[at[0]]), keys))
        n += len(keys)
    return parts, place


def _marked(block: Block, place: np.ndarray, n: int) -> np.ndarray:
    """Twice the count of each pair in training text, and one more where a held-out text has it."""
    marked = 2 * np.bincount(place[~block.held], minlength=n)
    marked[place[block.held]] |= 1
    return marked


def _ask_pairs(part_bits: int, context_bits: int):
    """A block's pairs with their marked counts, cut into ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _blocks(batches):
            block = Block(row)
            parts, place = pairs_of(block, part_bits, context_bits)
            cuts = np.cumsum([0, *[len(k) for _, k in parts]])
            marked = _marked(block, place, cuts[-1])
            yield _asked(row["block"], 1, [(p, k, marked[a:b]) for (p, k), a, b in zip(parts, cuts, cuts[1:], strict=False)])

    return run


def paths_of(keys: np.ndarray, counts: np.ndarray, n_bits: int) -> np.ndarray:
    """How often each pair's context was met, then with each further bit of its class, and last with its word; pairs are sorted."""
    out = np.empty((n_bits + 2, len(keys)), np.int32 if counts.sum() < 2**31 else np.int64)
    for bit in range(n_bits + 1):
        node = keys >> np.uint64(CODE - bit)
        new = np.concatenate([[True], node[1:] != node[:-1]])[: len(keys)]
        out[bit] = np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1]
    out[-1] = counts
    return out


def _turns(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    """For each level of sorted pairs' paths, which pairs go another way up to there than the pair before; the word is always another."""
    for j in range(n_bits):
        node = keys >> np.uint64(CODE - j - 1)
        yield np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[: len(keys)])
    yield from [np.arange(len(keys))] * 2


def _pair_answer(n_bits: int):
    """Which pairs' contexts were met elsewhere, and the paths of these: by how much counts fall at each level, told once where pairs go the same way."""

    def over(every: np.ndarray, counts: np.ndarray):
        falls = paths_of(every, counts, n_bits)
        total = falls[0].copy()
        falls[:-1] -= falls[1:]

        def one(at: np.ndarray | None, keys: np.ndarray | None, marked: np.ndarray | None) -> bytes | None:
            if at is None:
                return None
            all_in_all = total[at]
            met = (all_in_all > 1) | (all_in_all == 1) & ((marked < 2) | (marked & 1 > 0))
            at = at[met]
            told = np.concatenate([fall[at[turn]] for fall, turn in zip(falls, _turns(keys[met], n_bits), strict=True)])
            return len(met).to_bytes(4, "little") + bytes([told.dtype.itemsize]) + np.packbits(met).tobytes() + pack(told)

        return one

    return over


def _paths(payload: bytes, keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs that were asked for were met, and the counts along the paths of these."""
    n, kind = int.from_bytes(payload[:4], "little"), "<i4" if payload[4] == 4 else "<i8"
    size = -(-n // 8)
    met = np.unpackbits(np.frombuffer(payload, np.uint8, size, 5), count=n).astype(bool)
    told = unpack(payload[5 + size :], kind)
    taken, start, m = np.empty((n_bits + 2, int(met.sum())), kind), 0, int(met.sum())
    for j, turn in enumerate(_turns(keys[met], n_bits)):
        taken[j] = np.repeat(told[start : start + len(turn)], np.diff(turn, append=m))
        start += len(turn)
    for j in reversed(range(n_bits + 1)):
        taken[j] += taken[j + 1]
    return met, taken


def _nothing(n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of pairs whose contexts weren't met."""
    return np.zeros((1, n_bits), np.int8), np.zeros(1, np.float32), np.zeros(1, np.float32), np.zeros(1, np.int8)


class Predictions:
    """What is predicted of a block's tokens.

    By the word before: odds by cells, of training text with one occurrence of each taken away, or of held-out text.  By the two words before:
    the row of each token's pair; row 0 knows nothing, rows of pairs as training text has them come first, one occurrence
    of each taken away, then as held-out text has them.  Odds are of the word's own way at each bit.
    """

    def __init__(self, block: Block, payloads: list[bytes], cells: np.ndarray, frequent: np.ndarray, n_bits: int, part_bits: int, context_bits: int):
        self._by_cells(block, cells, frequent, n_bits)
        parts, place = pairs_of(block, part_bits, context_bits)
        which, tables = [], []
        for (_, keys), payload in zip(parts, payloads, strict=True):
            met, taken = _paths(payload, keys, n_bits)
            which.append(met)
            other = (taken[:-2] - taken[1:-1]).astype(np.float32)
            tables.append([self._rows(np.maximum(taken - less, 0).astype(np.float32), other, n_bits) for less in (1, 0)])
        met = np.concatenate([*which, np.zeros(0, bool)])
        self.row = np.where(met, np.cumsum(met, dtype=np.int32), 0).astype(np.int32)[place]
        self.row[block.held & (self.row > 0)] += int(met.sum())
        none = _nothing(n_bits)
        self.odds, self.in_class, self.as_word, self.level = (np.concatenate([none[i], *[t[0][i] for t in tables], *[t[1][i] for t in tables]]) for i in range(4))

    def _by_cells(self, block: Block, cells: np.ndarray, frequent: np.ndarray, n_bits: int) -> None:
        context, own = cells_of(block, frequent)
        self.cells, self.cell = cells.ravel(), (context.astype(np.int64) + np.where(block.held, cells.shape[1], 0)) << (CELL_BITS + 1)
        every = np.arange(1 << CELL_BITS, dtype=np.int32)
        self.nodes = np.stack([(every >> (CELL_BITS - 1 - j)) + (2 << j) for j in range(min(n_bits, CELL_BITS))], axis=1).astype(np.int64)
        self.own = own

    @staticmethod
    def _rows(left: np.ndarray, other: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Odds at each bit, counts of the class and of the word, and the level of pairs whose contexts were met so often along their paths, and went other ways so often."""
        made = np.stack([odds(left[j + 1], other[j]) for j in range(n_bits)], axis=1)
        return made, left[n_bits], left[n_bits + 1], (left[0] > 0).astype(np.int8) + (left[0] > 3) + (left[0] > 40)

    def by_cell(self, at: np.ndarray) -> np.ndarray:
        return self.cells.take(self.cell[at][..., None] + self.nodes.take(self.own[at], axis=0))

    def by_pair(self, at: np.ndarray) -> np.ndarray:
        return self.odds.take(self.row[at], axis=0)

    def word(self, of_class: np.ndarray) -> np.ndarray:
        """The probability of each token's word within its class, from that without context."""
        return (self.as_word[self.row] + SMOOTH * of_class) / (self.in_class[self.row] + SMOOTH)


def _sorted_places(key: np.ndarray, most: int) -> np.ndarray:
    """The places of keys, below ``most``, in stable order; key and place are sorted as one number where that has room."""
    shift = len(key).bit_length()
    if int(most).bit_length() + shift > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key << shift | np.arange(len(key))) & ((1 << shift) - 1)


def own_text(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each token: what followed the two words before it, or else the word before it, when they last stood in the same text; and how many words these were."""
    n = len(block.tokens)
    text = np.repeat(np.arange(len(block.lengths)), block.lengths)
    one = _before(block.tokens + 1, block.starts, block.lengths, 1).astype(np.int64)
    two = _before(block.tokens + 1, block.starts, block.lengths, 2).astype(np.int64)
    offered, kind = np.zeros(n, np.int32), np.zeros(n, np.int8)
    size = len(block.words) + 1
    for words in (1, 2):
        if words == 1:
            key, most = text * size + one, len(block.lengths) * size
        else:
            pair = one * size + two
            order = _sorted_places(pair, size * size)
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(np.diff(pair[order], prepend=-1) != 0) - 1
            key, most = text * n + ranks, len(block.lengths) * n
        order = _sorted_places(key, most)
        ordered = key[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        offered[order[same + 1]] = block.tokens[order[same]]
        kind[order[same + 1]] = words
    return offered, kind


class Mixer:
    """Codes texts side by side; each text's weights and map start from the given ones and learn from every CHUNK of its tokens.

    All inputs are odds of the way that the word goes, so an output is the probability of the bit that comes; the same odds
    with the other sign are those of the other bit, so both add up to one.
    """

    def __init__(self, n_bits: int, by_class: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.n_bits = n_bits
        sums = by_class.astype(float)
        self.unigram = np.empty((1 << n_bits, n_bits), np.float32)
        every = np.arange(1 << n_bits)
        for j in reversed(range(n_bits)):
            node = every >> (n_bits - 1 - j)
            self.unigram[:, j] = np.log((sums[node] + 0.4) / (sums[node ^ 1] + 0.4))
            sums = sums.reshape(-1, 2).sum(1)
        # By the length of what two classes begin with alike, and one: agreement, then the bit in which they part, then nothing.
        self.agree = np.zeros((n_bits + 2, n_bits), np.float32)
        for length in range(n_bits + 1):
            self.agree[length + 1, :length] = 1
            self.agree[length + 1, length : length + 1] = -1
        self.weights = np.broadcast_to(FIRST_WEIGHTS[:, None, None], (K, GATES, n_bits)).astype(np.float32) if weights is None else weights
        self.refined = 1 / (1 + np.exp(-np.arange(BINS) / 2)) if refined is None else refined

    def inputs(self, block: Block, found: Predictions) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
        """The gate of each token, and what looks the predictors' odds up; those that are held in a byte are in its steps."""
        classes = (block.words >> np.uint64(64 - self.n_bits)).astype(np.int32)
        own = classes[block.tokens]
        offered, kind = own_text(block)
        parted = np.frexp((classes[offered] ^ own).astype(np.float32))[1]  # bits from the first in which they part
        alike = np.where(kind > 0, self.n_bits - parted + 1, 0)

        def look(at: np.ndarray) -> list[np.ndarray]:
            cell = found.by_cell(at).astype(np.float32)
            if self.n_bits > CELL_BITS:
                cell = np.concatenate([cell, np.zeros((*cell.shape[:-1], self.n_bits - CELL_BITS), np.float32)], axis=-1)
            return [self.unigram.take(own[at], axis=0), cell, found.by_pair(at).astype(np.float32), self.agree.take(alike[at], axis=0)]

        return found.level[found.row] * OFFERS + kind, look

    def steps(self, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, tokens, there, first): so many lanes of CHUNK tokens each, texts of like length side by side; the tokens beyond a text's end aren't there."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), LANES):
            texts = order[a : a + LANES]
            for t in range(0, int(lengths[texts[0]]), CHUNK):
                live = texts[: int(np.searchsorted(-lengths[texts], -t))]
                place = t + np.arange(CHUNK)
                there = place < lengths[live][:, None]
                yield live, np.where(there, starts[live][:, None] + place, starts[live][:, None]), there, t == 0

    def bits(self, block: Block, found: Predictions) -> np.ndarray:
        """log2 of the probability of each token's class."""
        gate, look = self.inputs(block, found)
        out = np.zeros(len(block.tokens))
        n = self.n_bits
        start = np.ascontiguousarray((self.weights * UNIT[:, None, None]).transpose(1, 0, 2).reshape(GATES, K * n))
        rate = np.repeat(LEARN * UNIT**2, n).astype(np.float32)
        for live, at, there, first in self.steps(block.lengths):
            if first:
                weights = np.repeat(start[None], len(live), axis=0)
                refined = np.repeat(self.refined[None].astype(np.float32), len(live), axis=0)
            m = len(live)
            x = look(at)
            g = gate[at]
            w = weights.reshape(-1, K * n).take(np.arange(m)[:, None] * GATES + g, axis=0)
            dot = sum(w[..., k * n : (k + 1) * n] * x[k] for k in range(K))
            np.clip(dot, -7.99, 7.99, out=dot)
            q = 1 / (1 + np.exp(-dot))
            lane = (np.arange(m, dtype=np.int32) * BINS)[:, None, None]
            flat = refined.ravel()
            near = np.rint(np.abs(dot) * np.float32(2)).astype(np.int32) + lane
            r = flat.take(near)
            r = np.where(dot >= 0, r, 1 - r)
            logs = np.log2(np.float32(0.5) * (q + r)).sum(-1, dtype=np.float64)
            out[at[there]] = logs[there]
            left = (1 - q) * there[..., None]
            grown = np.concatenate([left * v for v in x], axis=-1)
            chosen = (g[:, None, :] == np.arange(GATES)[:, None]).astype(np.float32)
            weights[:m] += rate * np.matmul(chosen, grown)
            near = near[there]
            many = np.bincount(near.ravel(), minlength=m * BINS)
            right = np.bincount(near.ravel(), (dot[there] >= 0).ravel(), minlength=m * BINS)
            used = np.flatnonzero(many)
            flat[used] += (1 - (1 - REFINE) ** many[used]) * (right[used] / many[used] - flat[used])
        return out

    def learn(self, block: Block, found: Predictions) -> tuple[np.ndarray, np.ndarray]:
        """The weights after the block's training texts, one set for all lanes, by Newton steps on all that was seen; and how often each of the map's places was right, and met."""
        gate, look = self.inputs(block, found)
        n, weights = self.n_bits, self.weights.astype(float).copy()
        bend = np.zeros((GATES, n, K, K)) + RIDGE * np.eye(K)
        seen = np.zeros((2, BINS))
        for _, at, there, _ in self.steps(block.lengths):
            at = at[there & ~block.held[at]]
            if not len(at):
                continue
            x, g = look(at), gate[at]
            w = (weights * UNIT[:, None, None]).astype(np.float32)
            dot = np.clip(sum(w[k].take(g, axis=0) * x[k] for k in range(K)), -7.99, 7.99)
            q = 1 / (1 + np.exp(-dot))
            chosen = (g == np.arange(GATES)[:, None]).astype(np.float32)
            left = 1 - q
            pull = np.stack([(chosen @ (left * v)) * u for v, u in zip(x, UNIT, strict=True)], axis=-1).astype(float)
            left *= q
            for a in range(K):
                v = left * x[a]
                for b in range(a + 1):
                    h = (chosen @ (v * x[b])) * (UNIT[a] * UNIT[b])
                    bend[:, :, a, b] += h
                    if a != b:
                        bend[:, :, b, a] += h
            weights += np.linalg.solve(bend, pull[..., None])[..., 0].transpose(2, 0, 1)
            near = np.rint(2 * np.abs(dot)).astype(np.int64).ravel()
            seen += np.bincount(near, (dot >= 0).ravel(), BINS), np.bincount(near, minlength=BINS)
        return weights, seen


class TrainingPredictions(Predictions):
    """What a block's own training text predicts of itself after two words, without the words' own probabilities; held-out text isn't looked at."""

    def __init__(self, block: Block, cells: np.ndarray, frequent: np.ndarray, n_bits: int):
        self._by_cells(block, cells, frequent, n_bits)
        [(_, keys)], place = pairs_of(block, 0, 64 - CODE)
        counts = np.bincount(place[~block.held], minlength=len(keys))
        # Contexts that were met once know nothing of the token that was there.
        context = keys >> np.uint64(CODE)
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        met = np.repeat(np.add.reduceat(counts, new) > 1, np.diff(new, append=len(keys)))
        taken = paths_of(keys[met], counts[met], n_bits)
        self.row = np.where(met, np.cumsum(met, dtype=np.int32), 0).astype(np.int32)[place]
        self.odds, _, _, self.level = (np.concatenate(x) for x in zip(_nothing(n_bits), self._rows(np.maximum(taken - 1, 0).astype(np.float32), (taken[:-2] - taken[1:-1]).astype(np.float32), n_bits), strict=True))


def own_predictions(block: Block, n_bits: int, cells: np.ndarray, frequent: np.ndarray) -> Predictions:
    """What a block's own training text predicts after two words, and all training text after one."""
    parts, place = pairs_of(block, 0, 64 - CODE)
    payloads = []
    for _, keys in parts:
        marked = _marked(block, place, len(keys))
        payloads.append(_pair_answer(n_bits)(keys, marked >> 1)(np.arange(len(keys)), keys, marked))
    return Predictions(block, payloads, cells, frequent, n_bits, 0, 64 - CODE)


def _learn(sent):
    """(n, weights, seen): training tokens of a task's blocks, the sum of the blocks' weights, each times its tokens, and that of what they saw."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, cells, frequent = sent.value
        total, sums, met = 0, np.zeros(mixer.weights.shape), np.zeros((2, BINS))
        for row in _blocks(batches):
            block = Block(row)
            n = int((~block.held).sum())
            if n:
                weights, seen = mixer.learn(block, TrainingPredictions(block, cells, frequent, mixer.n_bits))
                total, sums, met = total + n, sums + n * weights, met + seen
        if total:
            yield _batch([[total], [sums.tobytes()], [met.tobytes()]], "n bigint, weights binary, seen binary")

    return run


def _score(sent, cells_sent, part_bits: int, context_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, in_class, n_total, v_total = sent.value
        _, cells, frequent = cells_sent.value
        for row in _blocks(batches):
            block, answers = Block(row), sorted(row.pop("answers"), key=lambda a: a["part"])
            found = Predictions(block, [a["payload"] for a in answers if a["kind"]], cells, frequent, mixer.n_bits, part_bits, context_bits)
            count = np.empty(len(block.words), np.int64)
            count[np.argsort(block.words)] = np.concatenate([unpack(a["payload"], "<i8") for a in answers if not a["kind"]])
            base = np.log10((count + 0.1) / (n_total + 0.1 * (v_total + 1)))
            own = (count + 0.1) / in_class[(block.words >> np.uint64(64 - mixer.n_bits)).astype(np.int64)]
            score = mixer.bits(block, found) * np.log10(2) + np.log10(found.word(own[block.tokens]))
            n_known, base_score, score = (np.add.reduceat(x, block.starts) for x in ((count > 0).astype(np.int64)[block.tokens], base[block.tokens], score))
            bits = -score / np.log10(2) / np.maximum(1, np.array(row["n_bytes"], np.int64))
            yield _batch([row["doc_ids"], row["held"], block.lengths, n_known, np.full(len(score), n_total), base_score, score, bits], SCORED)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of the whole text.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not 0; a null id counts as the empty text, null texts are
    empty and have their end token only.  ``base_score`` is the smoothed unigram model's log10 probability, ``score`` that of
    the mixed model.  Without training text all words are unknown.  Every row is scored, repeated ones alike.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks, buckets = bucketed(encode(source, folds), "lm-blocks", "block")
    known = blocks.agg(F.sum("n_train"), F.sum("n_words")).first()
    n_total = known[0] or 0

    asked = blocks.drop("doc_ids", "n_bytes").mapInArrow(_ask_words(_part_bits(known[1] or 0)), ASKED)
    words = materialise(asked.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(0, _word_answer), ANSWER), "lm-words")
    n_bits = sizes(n_total)
    stats = words.where("block IS NULL").select("payload")
    top = stats.mapInArrow(_top, "word bigint, c bigint").orderBy(F.col("c").desc(), "word").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    by_class = stats.mapInArrow(_class_sums(n_bits), "class bigint, c bigint, v bigint")
    c, v = np.zeros(1 << n_bits), np.zeros(1 << n_bits)
    for r in by_class.groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # at most 2^MOST_BITS
        c[r["class"]], v[r["class"]] = r["c"], r["v"]
    del asked
    discard()

    texts = blocks.drop("doc_ids", "n_bytes")
    counted = texts.mapInArrow(_count_cells(frequent), "part int, cells binary").repartition("part").sortWithinPartitions("part")
    parts = sorted(counted.mapInArrow(_sum_cells, "part int, odds binary").collect())  # about 20 MB, and as many bytes at any size of the input
    cells = [np.frombuffer(zstandard.decompress(x), np.int8).reshape(2, -1, 2 << CELL_BITS) for _, x in parts]
    cells = np.concatenate(cells, axis=1) if cells else np.zeros((2, FREQUENT + (1 << CELL_BITS) + 1, 2 << CELL_BITS), np.int8)

    mixer = Mixer(n_bits, c)
    cells_sent = spark.sparkContext.broadcast((mixer, cells, frequent))
    # Every block of training text is learned from; a few thousand numbers of each task come to the driver.
    learned = texts.mapInArrow(_learn(cells_sent), "n bigint, weights binary, seen binary").collect()
    if learned:
        weights = sum(np.frombuffer(r["weights"]) for r in learned) / sum(r["n"] for r in learned)
        right, met = sum(np.frombuffer(r["seen"]) for r in learned).reshape(2, BINS)
        mixer = Mixer(n_bits, c, weights.reshape(K, GATES, n_bits).astype(np.float32), (right + 20 * mixer.refined) / (met + 20))

    part_bits = _part_bits(n_total)
    context_bits = min(64 - CODE, 64 - part_bits, max(8, int(n_total).bit_length() + CHECK_BITS - part_bits))
    asked = texts.mapInArrow(_ask_pairs(part_bits, context_bits), ASKED)
    pairs = asked.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(1, _pair_answer(n_bits)), ANSWER)
    answers = pairs.unionByName(words.where("block IS NOT NULL"))
    answers = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "payload")).alias("answers"))

    sent = spark.sparkContext.broadcast((mixer, c + 0.1 * (v + 1), n_total, int(v.sum())))
    return blocks.join(answers.hint("merge"), "block").mapInArrow(_score(sent, cells_sent, part_bits, context_bits), SCORED)
