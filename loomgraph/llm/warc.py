"""WARC archives: written from pages, read back, and their capture index merged.

Every record is a gzip member of its own, so that a reader can start at any offset of the index.  Each archive file
read gives a run of captures sorted by URL key and time.  The runs are dealt to ranges of the key and merged there by a
loser tree, so that the ranges one after the other hold the history of every URL in order.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_KEYS, materialise, scratch_path

CRLF = "\r\n"
#: Payloads under this many bytes are always stored.
LEAST_REVISIT = 100
#: A file is closed when it has this many compressed bytes; a longer record has a file of its own size.  A reader holds one
#: compressed file and one record at a time.
FILE_BYTES = 32_000_000
#: Captures that one range of the merged index should hold.
RANGE_CAPTURES = 500_000
ID = "urn:capture:"

CAPTURE = (
    "run string, url_key string, captured string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, offset bigint"
)
_KEY = ("url_key", "captured", "page_id")


def with_revisits(pages: DataFrame, payload: Column, page_id: str) -> DataFrame:
    """``pages`` with __body, __bytes, __digest and __first: the id of the equal payload that is stored, null if it is this one.

    Which pages are revisits is found from ids and digests alone and joined back by both; while these are few, no body moves.
    """
    body = pages.withColumn("__body", F.coalesce(payload.cast("string"), F.lit("")))
    body = body.withColumn("__bytes", F.octet_length("__body").cast("bigint")).withColumn("__digest", F.sha2(F.col("__body").cast("binary"), 256))
    marks = materialise(body.where(F.col("__bytes") >= LEAST_REVISIT).select(F.col(page_id).alias("__p"), F.unhex("__digest").alias("__d")), "digests")
    first = marks.groupBy("__d").agg(F.min("__p").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    again = marks.join(first, "__d").where(~F.col("__first").eqNullSafe(F.col("__p"))).distinct()
    again = materialise(again.withColumn("__d", F.lower(F.hex("__d"))), "revisits")
    found = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    # A null id joins as the empty text; ids are numbers.
    same = (F.coalesce(F.col(page_id).cast("string"), F.lit("")) == F.coalesce(F.col("__p").cast("string"), F.lit(""))) & (F.col("__digest") == F.col("__d"))
    return body.join(found, same, "left").drop("__d", "__p")


def record(url: Column, page_id: Column, captured: Column) -> Column:
    """The WARC record of a row of ``with_revisits``, without the separator at its end."""
    revisit = F.col("__first").isNotNull()
    # A revisit keeps the headers of its response, so the length of what isn't stored is known.
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("__bytes"), F.lit(CRLF * 2)
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("__body")))
    clean = F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Date", captured),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{ID}"), F.col("__first"), F.lit(">")))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, F.lit(CRLF), block)


def write_archive(
    pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: str | None = None
) -> str:
    """Writes one record per row to gzipped WARC files under ``path``, a new shared folder if not given, and returns it.

    Of rows with equal payloads of at least 100 bytes, that with the smallest id is a response and the others
    are revisits; smaller ones are all responses.  A null payload is empty, a null URL is an empty one; a null id
    is never the smallest, and rows that repeat the smallest id are responses as well.  ``captured`` names a column of
    times; without one a page is captured as many seconds after the start of 2024 as its id says.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    when = F.col(captured) if captured else F.timestamp_seconds(F.coalesce(F.col(page_id), F.lit(0)) + F.lit(1_704_067_200))
    rows = with_revisits(pages, F.col(payload), page_id)
    made = rows.select(record(F.col(url), F.col(page_id), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("binary").alias("value"))
    # One row is one file, written as it is; Spark's text files end each row with a separator, here the member without content.
    files = made.mapInArrow(_members(FILE_BYTES), "value binary").select(F.col("value").cast("string").alias("value"))
    options = {"lineSep": _member(b"").decode("latin-1"), "encoding": "ISO-8859-1", "compression": "none", "maxRecordsPerFile": 1}
    files.write.options(**options).text(path)
    return path


def _member(content: bytes) -> bytes:
    """A gzip member that names no time, so that equal records are equal members."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(content) + made.flush()


def _members(size: int):
    """Records as gzip members, put together to files of about so many bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(_member(batch.column(0)[i].as_py() + CRLF.encode() * 2))
                n += len(held[-1])
                if n >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def url_key(url: str) -> str:
    """The URL with its host's labels turned round and without scheme, www, fragment and default port; parameters are sorted."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower().removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    site = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{site}){parts.path or '/'}" + (f"?{query}" if query else "")


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file, one by one; those without content are passed over."""
    at, view = 0, memoryview(content)
    while at < len(content):
        reader, parts, start = zlib.decompressobj(31), [], at
        while not reader.eof:
            if at == len(content):
                raise ValueError(f"the member at byte {start} is cut short")
            part = view[at : at + 65536]
            parts.append(reader.decompress(part))
            at += len(part) - len(reader.unused_data)
        if any(parts):
            yield start, b"".join(parts)


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of each record of a gzipped archive file, read one by one; the offset is that of the record's member."""
    for offset, whole in members(content):
        at = 0
        while at < len(whole):
            end = whole.find(b"\r\n\r\n", at)
            head = whole[at : max(at, end)].split(b"\r\n")
            if not head[0].startswith(b"WARC/1.") or end < 0:
                raise ValueError(f"no WARC record at byte {offset}: {whole[at : at + 40]!r}")
            fields = {}
            for line in head[1:]:
                name, _, value = line.decode("utf-8").partition(":")
                fields[name.lower()] = value.strip()
            start, size = end + 4, int(fields["content-length"])
            block = whole[start : start + size]
            if len(block) != size or whole[start + size : start + size + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {offset} is cut short")
            yield offset, fields, block
            at = start + size + 4


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").removeprefix(ID)
    return int(digits) if digits else None


def capture(run: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    """The index row of a record; a stored payload must have the digest that its record names."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"the payload at byte {offset} of {run} isn't the one recorded")
    url, refers = fields.get("warc-target-uri", ""), fields.get("warc-refers-to")
    return (run, url_key(url), fields["warc-date"], _number(fields["warc-record-id"]), url, length, digest, kind, refers and _number(refers), offset)


def _rank(row: tuple) -> tuple:
    """Order of captures; a null id comes first."""
    return row[1], row[2], -1 if row[3] is None else row[3], row[0], row[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archive files under ``path``; each file is a run in the order of the key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = name.rpartition("/")[2]
                rows = sorted((capture(name, *x) for x in records(content.as_py())), key=_rank)
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the losers of their matches, so each next row costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (_rank(self.head[a]), a) < (_rank(self.head[b]), b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.loser[node] < 0 and building:
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[at := self.loser[0]] is not None:
            yield self.head[at]
            self.head[at] = next(self.runs[at], None)
            self._play(at)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a range's rows.  They come as the runs had them, so each stretch in which they ascend is a run."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        ranks = list(map(_rank, _rows(batch)))
        cuts = [i for i in range(1, len(ranks)) if ranks[i] < ranks[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(ranks)], strict=True):
            if last is None or ranks[a] < last:
                runs.append([])
            runs[-1].append(batch.slice(a, b - a))
            last = ranks[b - 1]

    out: list[tuple] = []
    for row in LoserTree([itertools.chain.from_iterable(map(_rows, x)) for x in runs]):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_runs(captures: DataFrame) -> DataFrame:
    """All captures ordered by URL key, time and id: partition after partition, and within each.

    The ranges also cut by time and id, so a URL with very many captures spans several.  Spark deals the rows to ranges
    and sorts nothing: each run's rows of a range come in the run's order and are merged by the loser tree.  A task
    holds its range's rows and no payload.
    """
    runs = materialise(captures, "capture-runs")
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_CAPTURES))
    order = [F.col(c).asc_nulls_first() for c in _KEY]
    dealt = runs.repartitionByRange(ranges, *order)
    return dealt.mapInArrow(_merge, CAPTURE)


def sql() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS f FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f IS NULL OR f = page_id OR payload_bytes < {LEAST_REVISIT} THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id AND payload_bytes >= {LEAST_REVISIT} THEN f END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
