"""Exact n-gram Jaccard join by universe partition, and the components of its links.

A document is its set of distinct word n-grams.  Sets are taken in bands of size; in
a band two sets that link differ in at most H n-grams.  The universe of n-grams is
hashed into segments so that, by the pigeonhole principle, two such sets agree in one
segment, or in one of the subset that has n-grams enough, or in two parts of a larger
one, or in all but one n-gram of it.  Each band takes the cheapest of these allocations, for a large corpus, whatever the
size of the one at hand: it depends on the size band alone.  Sets with a signature in common are compared exactly.

A bucket of equal signatures may hold thousands of near copies.  Its members are
compared with one leader, not with each other.  The differences to the leader are
kept, and as the difference of two members is the difference of their differences,
what else may link in the bucket is found by a prefix-filtered join of these small
sets.  Members far from the leader, which mostly share a passage with it, are joined by their own rarest
n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialise, pieces, text_bytes

#: Ids that may be broadcast to cut a table down to the documents that are compared, 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Copies that may be broadcast to be left out, 24 bytes each.
BROADCAST_COPIES = 500_000
#: Members that one copy of a leader's text is compared with.
PER_LEADER = 32
#: Distance to the leader up to which a member's differences are kept.  One that is farther than this less (1 - threshold) is
#: joined by its rarest n-grams: of two that link, both are kept or both are joined so.
NEAR = 0.6
CACHED_WORDS = 200_000
#: Holders of one n-gram that a task joins with all others; of an n-gram with more, they are dealt out by salt.
PER_TASK = 1000
#: Far members of a bucket up to which its pairs are formed; of more, only those that share a rare n-gram.
SMALL_BUCKET = 8
#: Documents of the corpus that allocations are chosen for.
DOCUMENTS = 10_000_000
#: For the cost of an allocation: what a comparison costs in rows, and the share of a set's n-grams that unlike sets may hold too.
COMPARISON, SHARED = 50, 0.002
#: And the share of a set that a passage of others may be, and how many of the unlike sets share one.
PASSAGE, PASSAGES = 0.3, 0.001

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a text of fewer words is one n-gram, one of none has no set."""

    def __init__(self, n: int):
        self.n, self.seen = n, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * _M1 + h[j : len(words) - k + 1 + j])
        return np.unique(out)


class Bands:
    """Bands of set sizes and, for each, the number of segments and what is indexed of them."""

    def __init__(self, threshold_pct: int, documents: int = DOCUMENTS, ratio: float = 1.4):
        self.pct, self.documents, self.ratio = threshold_pct, max(1, documents), ratio
        self.lows = [1, 2]
        self.chosen: dict[int, tuple[str, int, int, int]] = {}

    def extend(self, size: int) -> None:
        while self.lows[-1] <= 2 * size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio)))

    def differ(self, a: int, b: int) -> int:
        """The most n-grams in which linked sets of these sizes differ: |A|+|B|-2o with o >= t/(1+t) (|A|+|B|)."""
        return (a + b) * (100 - self.pct) // (100 + self.pct)

    def of(self, size: int) -> list[int]:
        """The band of a size, and the next ones if a larger set there may link."""
        self.extend(size)
        k = int(np.searchsorted(self.lows, size, side="right")) - 1
        out = [k]
        while 100 * size >= self.pct * self.lows[k + 1]:
            k += 1
            out.append(k)
            self.extend(self.lows[k + 1])
        return out

    def allocation(self, band: int) -> tuple[str, int, int, int]:
        """(kind, segments, slack, floor): the cheapest cover of H differences, counted in rows and chance meetings.

        whole: H + 1 segments.  rich: H + 1 + slack segments, of which those of more than floor n-grams are indexed; linked sets
        agree in 1 + slack at least, so where one of them has no more than slack poor segments they agree in a rich one.
        subsets: half as many, of three parts each, indexed by every two parts.  deletion: half as many, indexed whole and
        with each one n-gram left out.
        """
        if band in self.chosen:
            return self.chosen[band]
        low, high = self.lows[band], self.lows[band + 1] - 1
        h = self.differ(high, high)
        half = -(-(h + 1) // 2)

        def cost(rows: float, mean: float, floor: int = -1) -> float:
            """Rows, and the members that each meets by chance: unlike sets share few n-grams, so by segments of few."""
            p = [math.exp(-mean) * mean**j / math.factorial(j) for j in range(floor + 1, floor + 4)]
            met = sum((x * SHARED**j) ** 2 for j, x in enumerate(p, floor + 1))
            # sets that share a passage: all of a segment's n-grams are the passage's, in both
            inside = PASSAGE * mean
            some = 1 - sum(math.exp(-inside) * inside**j / math.factorial(j) for j in range(floor + 1))
            met = (met + PASSAGES * some * math.exp(-2 * (mean - inside))) * self.documents / 8
            return rows * (1 + COMPARISON * met)

        options = [(cost(h + 1, low / (h + 1)) if h else 1.0, ("whole", h + 1, 0, -1))]
        for floor in range(5) if h else ():
            slack = 1
            for _ in range(30):  # more segments are poorer, so the slack is found step by step
                mean = low / (h + 1 + slack)
                poor = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(floor + 1))
                need = math.ceil((h + 1 + slack) * poor * 1.2) + 1
                if need <= slack or need > 3 * (h + 1):
                    break
                slack = need
            if need <= slack:
                options.append((cost((h + 1 + slack) * (1 - poor), mean, floor), ("rich", h + 1 + slack, slack, floor)))
        if h:
            options.append((cost(3 * half, 2 * low / (3 * half)), ("subsets", half, 0, -1)))
            options.append((cost(half * (1 + high / half), low / half), ("deletion", half, 0, -1)))
        self.chosen[band] = min(options)[1]
        return self.chosen[band]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set; linked sets have one in common."""
        if not len(grams):
            return np.zeros(0, np.uint64)
        mixed = _mix(grams + _M1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out = []
        for band in self.of(len(grams)):
            kind, segments, slack, floor = self.allocation(band)
            n = segments * (3 if kind == "subsets" else 1)
            # Segments are ranges of the hash, so those of a sorted set are slices.
            cuts = np.array([(i << 64) // n for i in range(n)], np.uint64)
            edge = np.concatenate([np.searchsorted(grams, cuts), [len(grams)]])
            sums = total[edge[1:]] - total[edge[:-1]]
            tag = _mix(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32))
            if kind == "subsets":
                s = sums.reshape(segments, 3)
                out += [_mix(_mix(s[:, i] * _M1 + tag + np.uint64(i)) * _M2 + s[:, j]) for i, j in ((0, 1), (1, 2), (2, 0))]
            else:
                whole = _mix(sums * _M1 + tag)
                rich = np.diff(edge) > floor
                out.append(whole[rich] if n - rich.sum() <= slack else whole)
                if kind == "deletion":
                    at = np.repeat(np.arange(segments), np.diff(edge))
                    out.append(_mix((sums[at] - mixed) * _M1 + tag[at]))
        return np.unique(np.concatenate(out))


def sketch(grams: np.ndarray) -> bytes:
    """A set's size and the parities of how many n-grams of a set fall into each of about eight times as many ranges of the hash, by a power of two.

    Where two sets' parities differ, so do the sets, by one n-gram at least.  A sketch is folded to half its length by XOR.
    """
    if not len(grams):
        return b""
    bits = len(grams).bit_length() + 2
    odd = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of unpacked parities brought to the given length."""
    return np.bitwise_xor.reduce(x.reshape(size, -1), axis=1)


def least_differ(a: bytes, b: bytes) -> int:
    """What two sets differ by at least, by their sketches; the finer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) == len(y):
        return int(np.bitwise_count(x ^ y).sum())
    x, y = np.unpackbits(x), np.unpackbits(y)
    size = min(len(x), len(y))
    return int((folded(x, size) ^ folded(y, size)).sum()) if size else 0


def _features(n: int, pct: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands = Shingles(n), Bands(pct)
        for batch in pieces(batches):
            keys, sizes, sigs, ends, sketches = [], [], [], [0], []
            for body in text_bytes(batch, 1):
                words = body.lower().split()
                grams = shingles.of(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(grams))
                sigs.append(bands.signatures(grams))
                ends.append(ends[-1] + len(sigs[-1]))
                sketches.append(sketch(grams))
            flat = np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists], ["doc_id", "key", "n", "sketch", "sigs"]
            )

    return run


def _linked(a: int, b: int, differ: int, pct: int) -> bool:
    inter = (a + b - differ) // 2
    return 100 * inter >= pct * (a + b - inter)


COMPARED = "leader bigint, member bigint, size_l bigint, size_m bigint, differ bigint, linked boolean, delta array<bigint>"
#: Rows in which a leader's payloads come first, with a null member, and then those of its members.
HEADED = "leader bigint, salt bigint, member bigint, payload binary"


def _headed(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, int, list, bytes]]]:
    """(leader, member, the leader's payloads, the member's) batch by batch; an id that repeats has several payloads."""
    at, heads, heading = None, [], False
    for batch in pieces(batches):
        rows = []
        for name, member, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch, 3), strict=True):
            if member is None:
                heads = [*heads, payload] if heading and name == at else [payload]
                at, heading = name, True
            else:
                assert name == at
                heading = False
                rows.append((name, member, heads, payload))
        yield rows


def _near(a: int, b: int, differ: int, pct: int) -> bool:
    """Whether a member is near enough for its differences to be kept: differ / union, with union = (a + b + differ) / 2."""
    return 2 * differ <= NEAR * (a + b + differ)


def _sketched(pct: int):
    """Pairs whose sketches don't show that they are far, with null sizes; and the others, with what they differ by at least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _headed(batches):
            out = []
            for leader, member, heads, payload in rows:
                b = int.from_bytes(payload[:8], "little")
                known = [(int.from_bytes(h[:8], "little"), least_differ(h[8:], payload[8:])) for h in heads]
                near = any(_near(a, b, d, pct) for a, d in known)
                a, d = min(known, key=lambda k: k[1])
                out.append((leader, member, None if near else a, b, None if near else d, False, None))
            yield _compared(out)

    return run


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in COMPARED.split(", ")])


def _compare(n: int, pct: int):
    """The pairs' sets, exactly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, leaders = Shingles(n), None, []
        for rows in _headed(batches):
            out = []
            for name, member, heads, body in rows:
                if heads is not last:
                    last, leaders = heads, [shingles.of(x.lower().split()) for x in heads]
                grams = shingles.of(body.lower().split())
                leader, delta = min(((x, np.setxor1d(x, grams, assume_unique=True)) for x in leaders), key=lambda p: len(p[1]))
                a, b, d = len(leader), len(grams), len(delta)
                out.append((name, member, a, b, d, _linked(a, b, d, pct), delta.view(np.int64) if _near(a, b, d, pct) else None))
            yield _compared(out)

    return run


def _stream(pairs: DataFrame, payloads: DataFrame, run) -> DataFrame:
    """Runs over (leader, member) pairs with their payloads (id, payload); a leader's goes once to every few members, not to each."""
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(counts, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("c") / PER_LEADER).cast("bigint")))
    members = salted.join(payloads, F.col("member") == F.col("id")).select("leader", "salt", "member", "payload")
    none = F.lit(None).cast("bigint").alias("member")
    heads = salted.select("leader", "salt").distinct().join(payloads, F.col("leader") == F.col("id")).select("leader", "salt", none, "payload")
    rows = heads.unionByName(members).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(run, COMPARED)


def compare(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, n: int, pct: int) -> DataFrame:
    """Comparison of (leader, member) pairs: by sketches, and exactly, by their texts, where these leave it open."""
    pairs = materialise(pairs, "pairs")
    first = materialise(_stream(pairs, sketches, _sketched(pct)), "sketched")
    discard(pairs)
    rest = materialise(first.where("differ IS NULL").select("leader", "member"), "open-pairs")
    ids = rest.select(F.explode(F.array("leader", "member")).alias("id")).distinct()
    if rest.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    needed = materialise(texts.join(ids, "id", "left_semi"), "compared-texts")
    out = materialise(first.where("differ IS NOT NULL").unionByName(_stream(rest, needed, _compare(n, pct))), "compared")
    discard(first, rest, needed)
    return out


def _dealt(x: DataFrame, y: DataFrame, holder: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by an n-gram with a salt: each holder on the left has one, each row on the right all, as many as the n-gram's ``df`` asks for."""
    salts = F.ceil(F.col("df") / PER_TASK).cast("int")
    return x.withColumn("salt", F.pmod(F.xxhash64(holder), salts).cast("int")).drop("df"), y.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("df")


def _delta_links(near: DataFrame, pct: int) -> DataFrame:
    """Links (a, b) between members of one leader, of which one at least isn't linked with it, from their differences to it.

    For such a pair the differences share more than 9/19 (in general t/(1+t)) of the linked or smaller one's, so one of the
    rarest 10/19 of them is in the other's.
    """
    share = 100 / (100 + pct)
    tokens = near.where(F.size("delta") > 0).select("leader", "member", "size_m", "linked", "differ", F.explode("delta").alias("g"))
    counted = tokens.groupBy("leader", "g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = tokens.join(counted, ["leader", "g"])
    # Differences that no other member has come first; they are counted, not kept.
    shared = Window.partitionBy("leader", "member")
    placed = ordered.withColumn("pos", F.col("differ") - F.count(F.lit(1)).over(shared) + F.row_number().over(shared.orderBy("df", "g")))
    placed = materialise(placed, "differences")
    y = placed.where(F.col("pos") <= F.floor(F.col("differ") * share) + 1).select(
        "leader", "g", "df", F.col("member").alias("b"), F.col("pos").alias("pb"), F.col("differ").alias("db"), F.col("size_m").alias("sb"), F.col("linked").alias("lb")
    )
    x = placed.where(~F.col("linked")).select(
        "leader", "g", "df", F.col("member").alias("a"), F.col("pos").alias("pa"), F.col("differ").alias("da"), F.col("size_m").alias("sa")
    )
    most = F.floor((F.col("sa") + F.col("sb")) * (100 - pct) / (100 + pct))
    least = (F.col("da") + F.col("db") - most) / 2
    room = 1 + F.least(F.col("da") - F.col("pa"), F.col("db") - F.col("pb"))
    fits = (room >= least) & (F.col("a") != F.col("b")) & (F.col("lb") | (F.col("a") < F.col("b")) | (F.col("pa") > F.floor(F.col("da") * share) + 1))
    sizes = (100 * F.least("sa", "sb") >= pct * F.greatest("sa", "sb")) & (F.abs(F.col("da") - F.col("db")) <= most)
    x, y = _dealt(x, y, "a")
    same = (x["leader"] == y["leader"]) & (x["g"] == y["g"]) & (x["salt"] == y["salt"])
    found = x.join(y, same & fits & sizes).select(x["leader"], "a", "b").distinct()
    sets = near.select("leader", "member", "size_m", "differ", "delta")
    left = sets.select("leader", F.col("member").alias("a"), F.col("size_m").alias("sa"), F.col("differ").alias("da"), F.col("delta").alias("ga"))
    right = sets.select("leader", F.col("member").alias("b"), F.col("size_m").alias("sb"), F.col("differ").alias("db"), F.col("delta").alias("gb"))
    both = found.join(left, ["leader", "a"]).join(right, ["leader", "b"])
    differ = F.col("da") + F.col("db") - 2 * F.size(F.array_intersect("ga", "gb"))
    inter = (F.col("sa") + F.col("sb") - differ) / 2
    return both.where(100 * inter >= pct * (F.col("sa") + F.col("sb") - inter)).select("a", "b")


def _grams(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in pieces(batches):
            sets = [shingles.of(x.lower().split()) for x in text_bytes(batch, 1)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "grams"])

    return run


def _rare_pairs(buckets: DataFrame, texts: DataFrame, n: int, pct: int) -> DataFrame:
    """(leader, member) pairs of one bucket that may link though both are far from its leader.

    Two linked sets share one of each one's rarest n-grams, as many as it may lack of the other and one more (prefix filter);
    the order is by how many of the buckets' documents hold an n-gram, and what follows the place bounds what can be shared.
    """
    ids = buckets.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = texts.join(ids, "id", "left_semi").mapInArrow(_grams(n), "id bigint, grams array<bigint>")
    tokens = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    shared = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("df > 1")
    own = Window.partitionBy("id")
    # N-grams that no other document has stand before these.
    placed = shared.withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "g")))
    prefix = materialise(placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * pct / 100) + 1).select("id", "n", "g", "pos", "df"), "prefixes")
    x, y = _dealt(prefix.toDF("a", "na", "g", "pa", "df"), prefix.toDF("b", "nb", "g", "pb", "df"), "a")
    room = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")) & ((100 + pct) * room >= pct * (F.col("na") + F.col("nb")))
    met = x.join(y, (x["g"] == y["g"]) & (x["salt"] == y["salt"]) & fits).select("a", "b").distinct()
    one, two = buckets.toDF("a", "sig"), buckets.toDF("b", "sig")
    return met.join(one, "a").join(two, ["b", "sig"], "left_semi").select(F.col("a").alias("leader"), F.col("b").alias("member")).distinct()


def met(rows: DataFrame) -> DataFrame:
    """Rows (id, sig) whose signature another id has too."""
    by_sig = Window.partitionBy("sig").orderBy("id")
    another = F.lag("id").over(by_sig).isNotNull() | F.lead("id").over(by_sig).isNotNull()
    return rows.withColumn("met", another).where("met").drop("met")


def links(buckets: DataFrame, texts: DataFrame, sketches: DataFrame, n: int, pct: int) -> DataFrame:
    """Links (a, b) between different sets that join every two linked ones, directly or in steps."""
    found = []
    # The leader is the member with the most buckets, which differs least from the others.
    central = buckets.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    lead = buckets.join(central, "id").groupBy("sig").agg(F.max_by("id", F.struct(F.col("c"), -F.col("id"))).alias("leader"))
    led = materialise(buckets.join(lead, "sig").where("id <> leader"), "led")
    pairs = led.select("leader", F.col("id").alias("member")).distinct()
    seen = compare(texts, sketches, pairs, n, pct)
    found.append(seen.where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")))
    found.append(materialise(_delta_links(seen.where(F.col("delta").isNotNull()), pct), "difference-links"))
    far = seen.where(2 * F.col("differ") > (NEAR - 1 + pct / 100) * (F.col("size_l") + F.col("size_m") + F.col("differ"))).select("leader", F.col("member").alias("id"))
    # Most met their leader only, by chance; a pair takes two that are far from it.
    rest = materialise(met(led.join(far, ["leader", "id"], "left_semi").select("id", "sig")), "far-buckets")
    discard(led)
    # Pairs of small buckets are few and go to the sketches at once; those of large ones must share a rare n-gram too.
    counted = rest.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    one, two = (counted.where(F.col("k") <= SMALL_BUCKET).select(F.col("id").alias(x), "sig") for x in ("leader", "member"))
    pairs = one.join(two, "sig").where("leader < member").select("leader", "member")
    large = materialise(counted.where(F.col("k") > SMALL_BUCKET).drop("k"), "large-buckets")
    pairs = pairs.unionByName(_rare_pairs(large, texts, n, pct)).distinct()
    seen = compare(texts, sketches, pairs, n, pct)
    found.append(seen.where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")))
    discard(buckets, rest, large)
    return found[0].unionByName(found[1]).unionByName(found[2])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, by min-label steps with pointer jumping; only ids with links."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).where("id <> to").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        root = labels.select(F.col("id").alias("now"), F.col("component").alias("root"))
        step = materialise(step.join(root, "now", "left").select("id", "was", F.least("now", "root").alias("component")), "labels")
        if step.where("component <> was").isEmpty():
            return step.select("id", "component")
        labels = step.select("id", "component")


def near_duplicates(docs: DataFrame, n: int = 3, pct: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set) and component_id, the smallest id it reaches by links.

    Two documents link when 100 * |A and B| >= pct * |A or B| for their sets of distinct ``n``-word shingles (A-Z lowered,
    words between ASCII white space; fewer words are one shingle).  Texts without words, and null, link with nothing and
    are their own component.  Copies are one class that is compared once.  Rows that repeat an id stand for one document
    with all their texts; a row without an id has the component of its copies, or none.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    texts = source.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    made = source.select(F.col("id").alias("doc_id"), "text").mapInArrow(_features(n, pct), "doc_id bigint, key binary, n bigint, sketch binary, sigs array<bigint>")
    made = materialise(made, "features")
    feats = materialise(made.drop("sigs"), "sets")
    classes = feats.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    # Copies but the first of each class go, by a join that moves no signatures while they are few.
    again = classes.where("copies > 1").select("key", "rep")
    copies = materialise(feats.select("key", "doc_id").join(again, "key").where("doc_id <> rep").select("key", "doc_id"), "copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    reps = made.where("key IS NOT NULL AND doc_id IS NOT NULL").join(few, ["key", "doc_id"], "left_anti").select(F.col("doc_id").alias("id"), "sigs")
    buckets = materialise(met(reps.select("id", F.explode("sigs").alias("sig"))), "buckets")
    del reps
    discard(made, copies)
    sketches = feats.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("sketch").alias("payload"))
    joined = components(links(buckets, texts, sketches, n, pct))
    of_class = classes.join(joined, F.col("rep") == F.col("id"), "left").where("copies > 1 OR id IS NOT NULL")
    of_class = of_class.select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("c"))
    out = feats.select("doc_id", "key", "n").join(of_class, F.col("key") == F.col("k"), "left")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def sql(n: int = 3, pct: int = 90) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {n - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * o >= {pct} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS c FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)"""
