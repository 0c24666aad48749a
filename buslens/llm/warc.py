"""Web archives: records written and read through Spark's text files, and their index merged into capture histories."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from buslens.llm.common import new_path, partitions, pick, staged

SEPARATOR = "\r\n\r\n"
#: Payloads of so many bytes are archived once; smaller ones each time.
MIN_BYTES = 0
#: Records of a file, and captures that one task merges.
FILE_RECORDS, MERGE_ROWS = 2_000, 100_000
#: Pages have no time of capture: ids count minutes from here, over and over after so many, so that every id has a year of four digits.
EPOCH, MINUTES = 1_704_067_200, 4_000_000_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits hold four characters."""
    digits = F.sha1(data)
    parts = []
    for i in range(8):
        group = F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_ALPHABET), F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record(kind: str) -> Column:
    """The text of a record, without the separator that follows it. A block is a whole HTTP message, for revisits its head."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(SEPARATOR))
    block = F.concat(http, F.col("html")) if kind == "response" else http
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:capture:"), _name("page_id", "row"), F.lit(">\r\nWARC-Date: "), F.col("date"),
             F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest")]
    if kind == "revisit":
        lines += [F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:capture:"), _name("first_id", "first_row"), F.lit(">")]
    return F.concat(*lines, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(SEPARATOR), block)


def _name(page_id: str, row: str) -> Column:
    return F.concat(F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(":"), F.col(row).cast("string"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> None:
    """A WARC record for every row of (page_id, url, html), in files below `path`.

    Of rows with equal payloads of at least `min_bytes` bytes, the one with the largest page_id (NULL smallest; of equal ones, any) is
    a response, and the others are revisits that refer to it. Who refers to whom is settled on digests alone; only payloads that
    are stored move. Files are ordinary Spark text output with the record separator as line separator, so they go through any store,
    and a lost task leaves nothing behind.
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    pages = pages.withColumn("mark", F.xxhash64("page_id", "url"))
    heads = staged(pages.select("page_id", "url", "payload_bytes", "digest", "mark", F.monotonically_increasing_id().alias("row")), "heads")
    heads = heads.withColumn("same", F.when(F.col("payload_bytes") >= min_bytes, F.lit(-1).cast("long")).otherwise(F.col("row")))
    seconds = F.lit(EPOCH) + 60 * F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long")), F.lit(MINUTES))
    heads = heads.withColumn("date", F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    first = heads.groupBy("digest", "payload_bytes", "same").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = staged(first.select("digest", "payload_bytes", "same", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "n"), "first")
    revisits = heads.join(first.where("n > 1"), ["digest", "payload_bytes", "same"]).where("row <> first_row")
    revisits.select(_record("revisit").alias("value")).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(f"{path}/revisits")
    stored = staged(heads.join(first.select(F.col("first_row").alias("row")), "row"), "stored")
    # One text for each key, whatever the table repeats; then a record for each stored row. Payloads are shuffled once, as all steps have
    # the same keys, and the digest alone tells the payload.
    keys = ["mark", "digest"]
    texts = pages.select(*keys, "html").join(stored.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.max("html").alias("html"))
    responses = texts.join(stored, keys)
    responses.select(_record("response").alias("value")).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(f"{path}/responses")


def url_key(url: str) -> str:
    """Sort key of a URL: host parts in reverse, then the path; no scheme, no user, no www, no default port."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    if not m:
        return url.partition("#")[0].lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(m[3] or '/').lower()}"


_CAPTURES = "page_id string, url_key string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to string, file string, offset long, length long"
_INDEX = [("page_id", pa.string()), ("url_key", pa.string()), ("timestamp", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
          ("refers_to", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def _capture(head: bytes, block: bytes, file: str, offset: int, length: int) -> tuple:
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}: the record at {offset} does not match its digest")

    def page(name: str) -> str | None:
        value = fields[name].removeprefix("<urn:capture:").rpartition(":")[0] if name in fields else "null"
        return None if value == "null" else value

    return (page("WARC-Record-ID"), url_key(fields.get("WARC-Target-URI", "")), re.sub(r"\D", "", fields["WARC-Date"]), size, digest, fields["WARC-Type"], page("WARC-Refers-To"), file, offset, length)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures from the parts of archives in order: the text between separators, which payloads may hold as well. A record's end
    comes from its length alone. Held: one record."""
    mark = SEPARATOR.encode()
    file, held, offset = None, bytearray(), 0
    for batch in batches:
        found = []
        for part, name in zip(batch.column("value"), batch.column("file")):
            if name.as_py() != file:
                if held.strip(b"\r\n"):
                    raise ValueError(f"{file} ends within a record")
                file, held, offset = name.as_py(), bytearray(), 0
            held += part.as_buffer()
            held += mark
            while (end := held.find(mark)) >= 0 and held[:1] == b"W":
                head = bytes(held[:end])
                size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                length = end + 4 + size + 4
                if len(held) < length:
                    break
                found.append(_capture(head, bytes(held[end + 4:end + 4 + size]), file, offset, length))
                del held[:length]
                offset += length
        columns = list(zip(*found)) or [()] * len(_INDEX)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _INDEX)], names=[n for n, _ in _INDEX])
    if held.strip(b"\r\n"):
        raise ValueError(f"{file} ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below `path`, one row per record, with file, and offset and length in the uncompressed file. Payloads
    of responses are checked against their digests. Each file is read as a stream, by one task."""
    parts = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").text(path)
    return parts.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(_parse, _CAPTURES)


class LoserTree:
    """Merges sorted lists. Inner nodes hold the loser of their match, so the next smallest takes one match for each level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before that of run b. A run that has ended goes last; equal heads go by run."""
        if a >= len(self.runs) or self.at[a] >= len(self.runs[a]):
            return False
        if b >= len(self.runs) or self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (left, right) if self._less(left, right) else (right, left)
        return winner

    def __iter__(self) -> Iterator:
        while self.runs and self.at[self.winner] < len(self.runs[self.winner]):
            best = self.winner
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            node = (best + self.size) // 2
            while node >= 1:
                if self._less(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


_ORDER = ["url_key", "timestamp", "page_key", "run", "place"]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, run, "int32")), pa.array(np.arange(place, place + n))], names=[*batch.schema.names, "run", "place"])
        place += n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of all runs, run after run, in; the captures of the range in global order out."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    keys = list(zip(*[table.column(c).to_pylist() for c in _ORDER]))
    run = table.column("run").to_numpy()
    begins = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    runs = [[(*keys[i], i) for i in range(s, e)] for s, e in zip(begins, begins[1:])]
    order = [k[-1] for k in LoserTree(runs)]
    merged = table.take(pa.array(order))
    numbers = pa.array(np.full(len(order), TaskContext.get().partitionId(), "int32"))
    merged = merged.drop_columns(["page_key", "run", "place"]).append_column("range", numbers).append_column("position", pa.array(np.arange(len(order))))
    yield from merged.to_batches(max_chunksize=10_000)


def merge_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of URL key and timestamp (then page, NULL first): each URL's history lies together. Order is told by (range,
    position).

    Each task sorts its own captures into a run, and writes it. Runs are then cut at common range bounds, which also split one
    URL's history, and a range is merged by one task with a loser tree over the runs' slices, of about MERGE_ROWS rows in all.
    """
    spark = captures.sparkSession
    # Digits that sort as the numbers do, negative ones first.
    number = F.expr("lpad(hex(try_cast(page_id AS bigint) ^ cast(-9223372036854775808 AS bigint)), 16, '0')")
    keyed = captures.withColumn("page_key", F.coalesce(number, "page_id", F.lit("")))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    runs = staged(keyed.sortWithinPartitions("url_key", "timestamp", "page_key").mapInArrow(_run_rows, f"{shape}, run int, place long"), "runs")
    n = max(partitions(spark), -(-runs.count() // MERGE_ROWS))
    ranges = runs.repartitionByRange(n, *_ORDER).sortWithinPartitions("run", "place")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema.fields)
    return ranges.mapInArrow(_merge, f"{shape}, range int, position long")


def archive_index(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Writes pages as web archives, reads them back and merges the index: one row per row of `pages`, with page_id, payload_bytes,
    payload_digest, record_type, refers_to, url_key, timestamp, file, offset, length, range and position.

    NULL html is an empty payload; a NULL url has no target and the empty key; a NULL page_id stays NULL and sorts first. Of rows that repeat
    a page_id and payload, one is the response. The timestamp is made from page_id, as pages have none. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    pages = pick(pages, "page_id", "url", "html")
    write_archives(pages, path, min_bytes)
    index = merge_index(read_archives(spark, path))
    kind = pages.schema["page_id"].dataType
    return index.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
