"""WARC archives of raw pages, read back and merged into globally ordered capture histories.

Records are written by Spark's text writer with the record end of the format (two line ends) as its line separator,
so an archive file is a plain sequence of WARC records. Each writing task deals its records to files of bounded bytes and
sorts them by file, URL key and time: every file is a sorted run. Reading gives one index entry per record, in the order of its run. The shuffle cuts the runs at
common range ends and keeps each run's entries in order; a k-way loser-tree merge of the runs, one range per task, puts
the entries in global order, and the ranges' sizes number them throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, join_hot, maybe_broadcast, running, stash, stash_path

CRLF = "\r\n"
#: Records and, unless one record alone is larger, bytes of one archive file, at most.
FILE_RECORDS, FILE_BYTES = 4096, 1 << 26
#: Index entries that one task merges, about.
MERGE_ROWS = 200_000
#: Without a time column: capture time of page 0, in seconds since 1970, and the seconds that the others' numbers follow it, in turn.
EPOCH, TURN = 1_704_067_200, 31_536_000
INDEX = "run string, at long, url string, captured_at string, page_id {id}, record_type string, refers_to {id}, payload_bytes long, payload_digest string"


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 digest given in hex: eight times 40 bits make four groups of eight characters."""
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top level down, then port, path and query; no scheme or leading www."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:www\.)?", "")
    host = F.regexp_extract(rest, r"^[^/:?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))


def first_copies(payloads: DataFrame) -> DataFrame:
    """A row per payload that occurs more than once: payload, the smallest page_id, how many rows have it, and the payload.

    ``payloads`` has payload and page_id. Counts are summed before the shuffle, so a payload that a third of all
    pages share is no burden to any task. Null ids come last.
    """
    ids = payloads.groupBy("payload", "page_id").agg(F.count("*").alias("n"))
    per = ids.groupBy("payload").agg(F.sum("n").alias("n_rows"), F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.col("n").alias("ties"))).alias("first"))
    return per.where("n_rows > 1").select("payload", "n_rows", F.col("first.page_id").alias("first_id"), F.col("first.ties").alias("ties"))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """WARC records of the pages: url_key, captured_at, page_id, record.

    Of equal payloads of at least ``min_bytes`` the page with the smallest id is a response and the others revisit it.
    Of repeated rows with that same id one is the response. Null html is an empty payload, a null URL an empty one.
    Capture times come from ``time_col`` (null: EPOCH); without one they are made up from the ids, within one year.
    """
    made = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(F.col(id_col).cast("string").try_cast("long"), F.lit(TURN)), F.lit(0)))
    at = F.coalesce(F.col(time_col).cast("timestamp"), F.timestamp_seconds(F.lit(EPOCH))) if time_col else made
    p = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"))
    p = p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    p = p.withColumn("payload", F.when(F.col("bytes") >= min_bytes, F.concat_ws("-", "digest", "bytes")))
    copies = stash(first_copies(p.where("payload is not null").select("payload", "page_id")), "warc-copies")
    n, total, ties = copies.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0)), F.max("ties")).first()
    if n <= BROADCAST_ROWS:  # no html is shuffled
        p = p.join(F.broadcast(copies.drop("n_rows")), "payload", "left")
    else:
        p = join_hot(p, copies, "payload", total, "left")
    is_first = F.col("ties").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    p = p.withColumn("revisit", ~is_first)
    if (ties or 1) > 1:  # repeated rows: the first of those that share a payload's first id, counted task by task
        tied = F.col("ties").isNotNull() & (F.col("ties") > 1) & ~F.col("revisit")
        again = stash(p.where(tied).withColumn("bucket", F.spark_partition_id()), "warc-tied")
        numbered = running(again, ["payload"], "bucket", ["url", "captured_at"], F.lit(1), "before")
        p = p.where(~tied).unionByName(numbered.withColumn("revisit", F.col("before") > 0).drop("bucket", "before"))
    p = p.withColumn("kind", F.when(F.col("revisit"), "revisit").otherwise("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "kind"), F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.concat(F.lit("WARC-Target-URI: "), safe), F.concat(F.lit("WARC-Date: "), "captured_at"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))), F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name("first_id"))), F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"))]
    p = p.withColumn("block", block)
    return p.select(url_key(F.col("url")).alias("url_key"), "captured_at", "page_id", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write the pages' records to archive files under ``path``, each file a run sorted by URL key and time.

    A task opens its next file when the records of one reach FILE_RECORDS or their bytes would pass FILE_BYTES; so a very
    long page takes one file more, and no other file gets shorter for it.
    """

    @F.pandas_udf("int")
    def file_of(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas as pd

        file, n, total, alone = 0, 0, 0, 0
        for batch in sizes:
            out = []
            for size in batch:
                if size > FILE_BYTES:  # a file of its own, numbered apart, beside the one that is open
                    alone -= 1
                    out.append(alone)
                    continue
                if n == FILE_RECORDS or n and total + size > FILE_BYTES:
                    file, n, total = file + 1, 0, 0
                n, total = n + 1, total + size
                out.append(file)
            yield pd.Series(out, dtype="int32")

    runs = records(pages, **options).withColumn("file", file_of(F.octet_length("record")))
    runs = runs.sortWithinPartitions("file", "url_key", "captured_at", "page_id")
    runs.select("file", "record").write.partitionBy("file").option("lineSep", CRLF * 2).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """(offset, headers, HTTP headers, payload) of each record of an archive file."""
    fields = lambda head: dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
    at, gap = 0, (CRLF * 2).encode()
    while at < len(data):
        end = data.index(gap, at)
        head = fields(data[at:end])
        start, stop = end + 4, end + 4 + int(head["Content-Length"])
        split = data.index(gap, start) + 4
        yield at, head, fields(data[start : split - 4]), data[split:stop]
        if data[stop : stop + 4] != gap:
            raise ValueError(f"record at {at} does not end where its length says")
        at = stop + 4


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row per record of the archives under ``path``. Digests and lengths of responses come from their payloads."""

    def run(batches):
        import base64
        import hashlib

        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, head, http, payload in parse(data.as_py()):
                    kind, own = head["WARC-Type"], head["WARC-Record-ID"][10:-1]
                    first = head.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else head["WARC-Payload-Digest"][5:]
                    rows.append((name, at, head["WARC-Target-URI"], head["WARC-Date"], own or None, kind, first or None, len(payload) if kind == "response" else int(http["Content-Length"]), digest))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("at", "payload_bytes") else pa.string()) for n, c in zip(names, cols)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, INDEX.format(id="string"))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted lists: the winner of all is on top, every inner node keeps the loser of its match.

    Taking the winner replays only the matches on its way up, log2 k comparisons for k lists.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [-1] * self.size
        self.top = self.play(1)

    def play(self, node: int) -> int:
        """Winner of the matches at and below a node."""
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self.play(2 * node), self.play(2 * node + 1)
        win, self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        return win

    def before(self, a: int, b: int) -> bool:
        """Whether list ``a`` has the next item; an ended list, or none (-1), comes after all others."""
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        return b < 0 or self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def __iter__(self) -> Iterator:
        while self.top >= 0 and self.at[self.top] < len(self.runs[self.top]):
            win = self.top
            yield self.runs[win][self.at[win]]
            self.at[win] += 1
            node = (self.size + win) // 2
            while node:
                if self.before(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.top = win


def merge_runs(index: DataFrame, rows: int) -> DataFrame:
    """The index entries in global order of URL key, time and id; adds ``place``, an entry's number in that order, from 0.

    Entries travel to their range sorted by run and place in the run, so each run's part arrives in its own order and
    the loser tree merges the parts as they are. Ranges hold about MERGE_ROWS entries, so memory is bounded; a URL with
    very many captures is spread over several.
    """
    names, order = index.columns, ["url_key", "captured_at", "page_id", "run", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(map(len, held)):
            return
        got = pa.Table.from_batches(held).combine_chunks()
        runs: list[list] = []
        last = None
        for i, (key, time, page, name, at) in enumerate(zip(*(got.column(c).to_pylist() for c in order))):
            if name != last:
                runs.append([])
                last = name
            runs[-1].append((key, time, page is not None, page if page is not None else 0, name, at, i))
        merged = got.take(pa.array([x[-1] for x in LoserTree(runs)], pa.int64()))
        n = merged.num_rows
        merged = merged.append_column("part", pa.array([TaskContext.get().partitionId()] * n, pa.int32())).append_column("nth", pa.array(range(n), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    parts = max(1, -(-rows // MERGE_ROWS))
    ranged = index.repartitionByRange(parts, *order).sortWithinPartitions("run", "at")
    merged = stash(ranged.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", part int, nth long"), "warc-merged")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return merged.join(maybe_broadcast(starts, parts), "part").withColumn("place", F.col("start") + F.col("nth")).select(*names, "place")


def capture_histories(pages: DataFrame, **options) -> DataFrame:
    """Archive the pages, read the archives back, and merge their index runs into capture histories.

    Per record: url_key, captured_at, page_id, url, record_type, refers_to, payload_bytes, payload_digest, run, at, place.
    An empty table gives none; repeated rows are captures of their own; other columns are not read. A page may be as long
    as a Spark string; archive files are bounded by bytes, see ``write_archives``. See ``records`` for nulls, ties and times.
    """
    spark = pages.sparkSession
    path = stash_path(spark, "warc")
    write_archives(pages, path, **options)
    id_type = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    index = stash(read_archives(spark, path, id_type), "warc-index")
    return merge_runs(index, index.count())


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back and merged: length and digest of each payload, which record it revisits, and its place in the capture histories."""
    found = capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "place")


#: DuckDB has no base32: each of the 32 characters takes five bits from one or two hex digits.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:www\\.)?', '') AS rest,
  strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM pages),
h AS (SELECT page_id, html, captured_at, rest, regexp_extract(rest, '^[^/:?#]*') AS host FROM p),
k AS (SELECT page_id, html, captured_at, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key FROM h),
d AS (SELECT page_id, url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS place, strlen(html) AS payload_bytes, sha1(html) || '0' AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM k)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (strpos('0123456789abcdef', substr(hex, 1 + (5 * g) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, 2 + (5 * g) // 4, 1)) - 1
    ) // CAST(pow(2, 3 - (5 * g) % 4) AS BIGINT)) % 32), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, url_key, captured_at, place
FROM d
"""
