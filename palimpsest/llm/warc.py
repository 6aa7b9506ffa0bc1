"""WARC archives written and read back, and an external merge of their capture index.

Writing: one record per page; of pages with equal payloads of min_revisit bytes or more, that of the least id is the
response and the others revisit it.  A record is one string and "\\r\\n\\r\\n" the line separator, so Spark's text writer
makes WARC files on any file system, gzip-compressed; pages are written by size class, so that a file holds FILE_BYTES
of payload at most, or one page.
Reading: files are inflated in pieces and walked record by record by Content-Length, one record held at a time, and
every response's digest is computed anew from its payload.
Index: each file yields one locally sorted run of captures.  Runs are cut at common splitters (a range partition over
key, time and id, so one hot host spreads out) into ranges of about RANGE_ROWS captures; a range holds its k run slices
as Arrow columns and merges them with loser trees of FAN_IN runs at most, in as many passes as that takes, each run
read through a cursor of CURSOR_ROWS rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, named, scratch_path
from palimpsest.shipping import ship

FILE_BYTES = 64 << 20
RANGE_ROWS = 100_000
FAN_IN = 64
CURSOR_ROWS = 256
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
SALTS = 16
_CRLF = "\r\n"
_INDEX = "run string, offset long, length long, page_id long, url string, captured long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A")


def classify(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """pages(page_id, url, captured, payload) with payload_bytes, payload_digest, record_type and refers_to.

    The least id of each digest is counted before any row moves, and returns to the pages by salted digest.
    """
    rows = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    large = rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("payload_digest", "first"), "first-captures").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    known = salted.join(first, ["payload_digest", "salt"], "left").drop("salt")
    again = (F.col("payload_bytes") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("first")


def record(date: Column) -> Column:
    """The WARC record of a classified row, without the two line ends that close it."""
    http = F.concat(F.lit(_CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    header = [
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(_CRLF),
    ]
    return F.concat(*header, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None, min_revisit: int = 100) -> None:
    """Write pages as gzip-compressed WARC files into path.

    captured: a column of seconds since 1970 (times before the year 1 or after 9999 are written as its first or last second);
    without one, page ids, modulo 2^32, are taken for seconds after the start of 2024.  Ids are integers.  Dates are in UTC,
    whatever the session's time zone.  Other columns, of any name, are left out.  No rows: no archive.
    Null html: an empty payload.  Null url: an empty one.  Null id: revisits another page of that payload, if one has
    an id, else a response.  Repeated rows: a record each; those that share the least id are all responses.
    """
    if captured:
        at = F.greatest(F.lit(FIRST_SECOND), F.least(F.lit(LAST_SECOND), F.coalesce(named(captured).cast("long"), F.lit(0))))
    else:
        at = F.lit(1_704_067_200) + F.pmod(F.coalesce(named(page_id).cast("long"), F.lit(0)), F.lit(1 << 32))
    rows = pages.select(named(page_id).cast("long").alias("page_id"), named(url).alias("url"), at.alias("captured"), F.coalesce(named(html), F.lit("")).alias("payload"))
    # a timestamp would be told in the session's time zone
    day, second = F.date_from_unix_date(F.floor(F.col("captured") / 86400).cast("int")), F.pmod("captured", F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    date = F.concat(day.cast("string"), clock)
    # classes of a fourfold range of sizes, each with as many records a file as FILE_BYTES hold of its largest
    size = F.floor(F.log(4.0, F.greatest(F.octet_length("payload"), F.lit(1 << 12)).cast("double")) + 1e-9).cast("int")
    classes = sorted(r.size for r in rows.select(size.alias("size")).distinct().collect())
    found = classify(rows, min_revisit)
    for k in classes or [6]:
        texts = found.where(size == k).select(record(date).alias("value"))
        texts.write.mode("append").option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES >> (2 * k + 2))).text(path)


def inflated(data: pa.Buffer, piece: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, from pieces of its own bytes."""
    one = zlib.decompressobj(31)
    for at in range(0, data.size, piece):
        more = data.slice(at, min(piece, data.size - at)).to_pybytes()
        while more:
            if one.eof:
                one = zlib.decompressobj(31)
            out = one.decompress(more)
            if out:
                yield out
            more = one.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an uncompressed archive; a record and a piece are held."""
    held, offset = bytearray(), 0
    pieces = iter(pieces)

    def fill(until: int) -> bool:
        while len(held) < until:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                raise ValueError(f"the headers at byte {offset} do not end")
            end = held.find(b"\r\n\r\n")
        version, *lines = held[:end].decode().split(_CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {offset} does not end where its length says")
        yield offset, stop + 4, headers, bytes(held[start:stop])
        offset += stop + 4
        del held[: stop + 4]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from calendar import timegm
    from time import strptime

    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in _INDEX.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for offset, length, h, block in records(inflated(batch.column(1)[i].as_buffer())):
                kind = h["WARC-Type"]
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2])
                told = h["WARC-Payload-Digest"].removeprefix("sha256:")
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else told
                if digest != told or kind == "response" and size != len(payload):
                    raise ValueError(f"the payload at byte {offset} is not the one that was written")
                own, other = (h[x][10:-1] if x in h else "" for x in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((batch.column(0)[i].as_py(), offset, length, int(own) if own else None, h["WARC-Target-URI"], timegm(strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")), kind, size, digest, int(other) if other else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def url_key(url: Column) -> Column:
    """Host parts in reverse, then path and query: com,example,blog)/en/1?x=2 (no scheme, port, user or fragment)."""
    low = F.lower(F.regexp_replace(url, "#.*$", ""))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]*)", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ","), F.lit(")"), rest)


class LoserTree:
    """Merges k sorted iterators, of which it holds the heads; each step replays one leaf's path of about log2 k comparisons."""

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = self.k = len(self.runs)
        self.tree = [-1] * max(1, k)
        for leaf in range(k):
            self._replay(leaf, building=True)

    def _less(self, a: int, b: int) -> bool:
        """Does a's head go before b's?  Spent runs go last; ties by run."""
        p, q = self.heads[a], self.heads[b]
        if p is None or q is None:
            return q is None and (p is not None or a < b)
        return p < q or p == q and a < b

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if building and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def merged(runs: list[Iterable[tuple]], fan_in: int = FAN_IN) -> Iterable[tuple]:
    """All runs merged, by trees of fan_in runs at most whose outputs are runs again."""
    while len(runs) > fan_in:
        runs = [LoserTree(runs[i : i + fan_in]) for i in range(0, len(runs), fan_in)]
    return LoserTree(runs)


def _cursor(slices: list[pa.RecordBatch], run: int) -> Iterator[tuple]:
    """(key, captured, page, run, place) of a run's rows; only CURSOR_ROWS of them are Python values at a time."""
    place = 0
    for batch in slices:
        for at in range(0, batch.num_rows, CURSOR_ROWS):
            some = batch.slice(at, CURSOR_ROWS)
            for key, captured, page in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                yield key, captured, -1 if page is None else page, run, place
                place += 1


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slices: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column(3).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)] if len(names) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            slices.setdefault(names[a], []).append(batch.slice(a, b - a))
    if not slices:
        return
    whole = pa.Table.from_batches([x for run in slices.values() for x in run]).combine_chunks()
    first = np.cumsum([0, *(sum(x.num_rows for x in run) for run in slices.values())])
    order = (first[run] + place for *_, run, place in merged([_cursor(x, i) for i, x in enumerate(slices.values())]))
    while some := list(islice(order, 10_000)):
        yield from whole.take(pa.array(some)).combine_chunks().to_batches()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, locally sorted by file: run, offset and length in the uncompressed file, and what it says."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_indexed, _INDEX).withColumn("url_key", url_key(F.col("url")))


def capture_histories(index: DataFrame) -> DataFrame:
    """index of read_archives(), globally ordered by url_key, captured, page_id: partitions in order, rows in order."""
    ship(index.sparkSession)
    runs = materialize(index.sortWithinPartitions("run", "url_key", "captured", "page_id", "offset"), "capture-runs")
    columns = ["url_key", "captured", "page_id", "run", "offset", "length", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    ranges = max(1, -(-runs.count() // RANGE_ROWS), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.select(columns).repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", "page_id", "offset")
    return dealt.mapInArrow(_merged, dealt.schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html), read the archives back, merge their index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return capture_histories(read_archives(spark, path))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what round_trip() returns."""
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
