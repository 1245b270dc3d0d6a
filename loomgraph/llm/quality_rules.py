"""Quality rules by tokeniser fertility.

A public vocabulary measures each whole text: characters per token, the share of byte-fallback tokens and the entropy of its
tokens.  What is normal is learned from all documents: each language, or script where a language is rare, has a band around the
middle half of its texts of like length, as short texts vary more and have fewer repeated tokens.  A text is rejected where a measure
leaves its band, or where one of two base rules fails.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise, text_bytes

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: A worker keeps the pieces of so many different words before it starts anew.
CACHED_WORDS = 400_000
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bands, which go to the executors.
MOST_GROUPS = 100_000

#: Texts of like length (by doublings of the tokens) that a language or script needs for a band of its own.
LEAST_TEXTS = 50
#: A band ends so many widths of the middle half of a group's texts beyond it; the middle half counts as so wide at least.
FENCE = 2.0
#: What is measured: by which side of the band texts are rejected, the least width, and the step to which it is rounded when counted.
RULES = {"chars_per_token": ("both", 0.04, 0.005), "byte_share": ("high", 0.005, 0.001), "entropy_share": ("low", 0.02, 0.001)}

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, entropy_share double, script string"


class Pieces:
    """The tokens of single words, kept for the words that come again."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.length, self.start, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def of(self, words: list[bytes]) -> np.ndarray:
        """The token ids of the words, one word after the other."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if len(self.number) + len(new) > CACHED_WORDS and self.number:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            self._add(new)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        length, start = self.length[at], self.start[at]
        return self.flat[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]

    def _add(self, new: list[bytes]) -> None:
        ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        have, length = len(self.number), np.fromiter(map(len, ids), np.int64, len(ids))
        while have + len(new) > len(self.length):
            self.length, self.start = np.concatenate([self.length, self.length]), np.concatenate([self.start, self.start])
        while self.used + length.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + length.sum()] = [x for y in ids for x in y]
        self.length[have : have + len(new)] = length
        self.start[have : have + len(new)] = self.used + np.cumsum(length) - length
        self.used += int(length.sum())
        self.number.update(zip(new, range(have, have + len(new)), strict=True))


@functools.cache
def _pieces(model_file: str | None) -> Pieces:
    """One for all tasks of a worker, so that words are encoded once in it."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(model_file)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in some window of consecutive words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    code = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    # Equal windows get equal numbers: a window's number pairs that of its head with its last word.
    name = code
    for k in range(1, window):
        pair = name[: n - k] * (n + 1) + code[k:]
        name = np.unique(pair, return_inverse=True)[1]
        if k < window - 1 and len(name) and name.max() + 1 == len(name):
            return 0  # no two alike any more
    twice = np.bincount(name)[name] > 1
    steps = np.zeros(n + 1, np.int64)
    first = np.flatnonzero(twice)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + window, -1)
    return int((np.cumsum(steps)[:n] > 0).sum())


#: Scripts by the first byte of their letters in UTF-8, up to and with the byte given; ASCII letters are Latin.
_SCRIPTS = [(0xC2, ""), (0xCA, "Latin"), (0xCC, ""), (0xCF, "Greek"), (0xD4, "Cyrillic"), (0xD6, ""), (0xD7, "Hebrew"), (0xDB, "Arabic"), (0xDF, ""), (0xE0, "Indic"), (0xE2, ""), (0xE9, "Han"), (0xED, "Hangul"), (0xFF, "")]
_NAMES = ["", *sorted({n for _, n in _SCRIPTS if n})]


def _script_of(b: int) -> int:
    if b < 0x80:
        return _NAMES.index("Latin") if chr(b).isalpha() else 0
    return 0 if b < 0xC0 else _NAMES.index(next(name for high, name in _SCRIPTS if b <= high))


_SCRIPT_TABLE = bytes(map(_script_of, range(256)))


def _script(body: bytes) -> str:
    """The script of most letters, the first by name of those with as many; '' without letters of any known one."""
    marked = body.translate(_SCRIPT_TABLE)
    most, first = max((marked.count(i), -i) for i in range(1, len(_NAMES)))
    return _NAMES[-first] if most else ""


def measure(body: bytes, pieces: Pieces) -> tuple:
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    chars = sum(map(len, words)) - int((np.frombuffer(body, np.uint8) & 0xC0 == 0x80).sum())
    tokens = pieces.of(words)
    n = len(tokens)
    entropy, byte_share = 0.0, 0.0
    if n:
        ordered = np.sort(tokens)
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
        entropy = float(np.log2(n) - (sizes * np.log2(sizes)).sum() / n)
        byte_share = float(pieces.is_byte[tokens].mean())
    return (
        len(words), chars, len(body) - len(body.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        n, chars / n if n else 0.0, byte_share, entropy, entropy / np.log2(n) if n > 1 else 1.0, _script(body),
    )


def _length() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def bands(measured: DataFrame, lang: str = "lang", least_texts: int = LEAST_TEXTS, fence: float = FENCE) -> DataFrame:
    """(kind, name, length, measure, low, high) for each language and script, by doublings of the tokens, with ``least_texts`` texts or more that pass the base rules.

    Quartiles come from counts of rounded values over all such texts, so they are exact to the rounding, and a group's
    values are never gathered: there are a few thousand at most of any measure.
    """
    groups = F.array(F.struct(F.lit("lang").alias("kind"), F.col(lang).cast("string").alias("name")), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name")))
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / step).cast("bigint").alias("v")) for m, (_, _, step) in RULES.items()])
    each = measured.where(~F.col("base_failed")).select(F.explode(groups).alias("g"), _length().alias("length"), values.alias("m")).where("g.name IS NOT NULL")
    counted = each.select("g.kind", "g.name", "length", F.explode("m").alias("m")).groupBy("kind", "name", "length", "m.measure", "m.v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("kind", "name", "length", "measure")
    placed = counted.withColumn("upto", F.sum("n").over(own.orderBy("v"))).withColumn("all", F.sum("n").over(own)).where(F.col("all") >= least_texts)
    # The quartile is the smallest value up to which a quarter, or three, of the texts lie.
    quarter = [F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("v"))).alias(f"q{k}") for k in (1, 3)]
    found = placed.groupBy("kind", "name", "length", "measure").agg(*quarter)
    out = None
    for m, (side, width, step) in RULES.items():
        far = F.greatest((F.col("q3") - F.col("q1")) * step, F.lit(width)) * fence
        low = F.lit(None).cast("double") if side == "high" else F.round(F.col("q1") * step - far, 6)
        high = F.lit(None).cast("double") if side == "low" else F.round(F.col("q3") * step + far, 6)
        part = found.where(F.col("measure") == m).select("kind", "name", "length", "measure", low.alias("low"), high.alias("high"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_rules(docs: DataFrame, model_file: str | None = None, text: str = "text", lang: str = "lang", least_texts: int = LEAST_TEXTS, fence: float = FENCE) -> DataFrame:
    """``docs`` without their text, with the measures of each whole text, base_failed, band_failed and kept; no row goes.

    ``model_file`` is a SentencePiece model that the executors can open; by default that of the installed
    public vocabularies.  Null and empty texts have no words and measures of 0, so base_failed is true for
    them.  band_failed names the measures that leave the band, comma-joined; the band is that of the language, or of the script where the language
    is null or has fewer than ``least_texts`` texts of like length; where the script has too, nothing is rejected by measure.  entropy_share is the
    entropy as a share of the highest that the number of tokens allows, 1 below two tokens.  Input columns named as new ones are
    replaced; an empty table gives an empty one.
    """
    new = [x.split()[0] for x in MEASURES.split(", ")]
    columns = [c for c in docs.columns if c not in (*new, "base_failed", "band_failed", "kept")]
    keep = [c for c in columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    at = columns.index(text)
    kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_file)
        for batch in batches:
            rows = [measure(x, pieces) for x in text_bytes(batch, at)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(columns.index(c)) for c in keep], *made], [*keep, *new])

    out = docs.select(*columns).mapInArrow(run, ", ".join(x for x in (schema, MEASURES) if x))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = materialise(out.withColumn("base_failed", failed), "measures")
    found = bands(out, lang, least_texts, fence).groupBy("kind", "name", "length").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("__band"))
    for kind, column in (("lang", lang), ("script", "script")):
        part = found.where(F.col("kind") == kind).select(F.col("name").alias(f"__{kind}"), F.col("length").alias("__length"), F.col("__band").alias(f"__of_{kind}"))
        if part.count() > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} bands by {kind}")
        same = (F.col(column).cast("string") == F.col(f"__{kind}")) & (_length() == F.col("__length"))
        out = out.join(F.broadcast(part), same, "left").drop("__length")
    band = F.coalesce("__of_lang", "__of_script")
    left = []
    for m in RULES:
        low, high = band[m]["low"], band[m]["high"]
        left.append(F.when(F.coalesce(F.col(m) < low, F.lit(False)) | F.coalesce(F.col(m) > high, F.lit(False)), F.lit(m)))
    out = out.withColumn("band_failed", F.when(F.col("n_tokens") > 0, F.concat_ws(",", *left)).otherwise(""))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("band_failed") == "")).drop("__lang", "__of_lang", "__script", "__of_script")
