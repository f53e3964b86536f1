"""WARC archives of captures and their index, merged externally by a loser tree.

1. Payload digests are counted; of captures with equal payloads of at least REVISIT_BYTES bytes that with the largest
   id becomes a response and the others revisits of it.
2. Each task writes its captures into WARC files (one gzip member a record) in the shared folder. File names are
   unique to an attempt and only those of finished tasks enter the written manifest, so lost executors do no harm.
3. The archives are read back, file by file: digest and size come from the bytes read (for a revisit from its headers).
   The index rows of a file, sorted by URL key and timestamp, are one run, a Parquet file in the shared folder.
4. Runs are merged k ways by a loser tree, FAN_IN at most at a time (more runs take more passes). The last pass is cut
   into key ranges by samples of the runs, a range a task; ranges include timestamp and id, so one hot URL splits.

A null payload is empty. A null id is written as such and can be a revisit but is no response that others refer to;
rows that share the largest id of a payload are all responses. Null URLs have an empty key. Repeated rows are records
of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import checked_broadcast, fresh_path, stash
from ledgerloom.llm.urls import fetch_seconds, url_key

REVISIT_BYTES = 1000
#: Records of one archive file, and so index rows of one run, at most.
FILE_RECORDS = 20_000
FAN_IN = 64
#: Rows that a merge reads from a run at once, and sampled keys of a run.
RUN_GROUP, RUN_SAMPLES = 2048, 64
#: Index rows that a range of the last pass holds on average.
RANGE_ROWS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema([("key", pa.string()), ("url_key", pa.string()), ("fetched", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "key string, url_key string, fetched long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:") else f"file://{uri}")


# ------------------------------------------------------------------ records
def record_bytes(page_id: int | None, url: str | None, key: str, fetched: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the HTTP headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {datetime.fromtimestamp(fetched, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-URL-Key: {escape(key)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {escape(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def escape(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescape(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member."""
    at, start, waiting = 0, 0, b""
    inflate, parts = zlib.decompressobj(31), []
    while True:
        data = waiting or stream.read(chunk)
        if not data:
            break
        parts.append(inflate.decompress(data))
        waiting = inflate.unused_data
        at += len(data) - len(waiting)
        if inflate.eof:
            yield start, at - start, b"".join(parts)
            start, inflate, parts = at, zlib.decompressobj(31), []


def read_record(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(v) if (v := fields[name].removeprefix("<urn:page:").rstrip(">")) else None
    row = {
        "url_key": unescape(fields["X-URL-Key"]),
        "fetched": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp()),
        "page_id": number("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "refers_to": None,
    }
    if row["record_type"] == "revisit":
        row["refers_to"] = number("WARC-Refers-To")
        row["payload_bytes"] = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        row["payload_digest"] = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    else:
        row["payload_bytes"] = len(payload)
        row["payload_digest"] = hashlib.sha1(payload).hexdigest()
        if base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex() != row["payload_digest"]:
            raise ValueError(f"damaged payload of page {row['page_id']}")
    row["key"] = sort_key(row)
    return row


def sort_key(row: dict) -> str:
    """Text whose order is that of URL key, timestamp, id (nulls first)."""
    own = row["page_id"]
    return f"{row['url_key']}\0{row['fetched']:012d}\0{'' if own is None else f'{own + (1 << 63):020d}'}"


# ------------------------------------------------------------------ writing
def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, key, fetched, payload, refers_to. Payloads do not move: the digests to look up are small."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digests = own.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES)
    again = digests.groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    known = checked_broadcast(stash(again.select(F.col("digest").alias("d"), "largest"), "digests"))
    marked = own.withColumn("digest", F.sha1("payload")).join(known, F.col("digest") == F.col("d"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return marked.select("page_id", "url", F.coalesce(url_key(F.col("url")), F.lit("")).alias("key"), fetch_seconds(F.col("page_id")).alias("fetched"), "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write WARC files into folder; the manifest (file, records), itself written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        out, name, n = None, "", 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, key, fetched, payload, refers = (batch.column(c)[i].as_py() for c in range(6))
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(deflate.compress(record_bytes(page_id, url, key, fetched, payload, refers)) + deflate.flush())
                n += 1
                if n >= FILE_RECORDS:
                    out.close()
                    out = None
                    done.append((name, n))
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["file", "records"])

    return stash(rows.mapInArrow(write, "file string, records long"), "archives")


# ------------------------------------------------------------------ runs
RUN_DDL = "run string, rows long, samples array<string>"


class RunWriter:
    """A sorted run in the shared folder, written in small row groups; tells its name, rows and sampled keys."""

    def __init__(self, folder: str):
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.parquet"
        self.stream = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out, self.rows, self.held = pq.ParquetWriter(self.stream, INDEX), 0, []
        self.samples: list[str] = []
        self.every = 1

    def add(self, row: dict) -> None:
        self.held.append(row)
        if self.rows % self.every == 0:
            self.samples.append(row["key"])
            if len(self.samples) > 2 * RUN_SAMPLES:
                self.samples, self.every = self.samples[::2], self.every * 2
        self.rows += 1
        if len(self.held) >= RUN_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_pylist(self.held, INDEX))
            self.held = []

    def close(self) -> tuple[str, int, list[str]]:
        self.flush()
        self.out.close()
        self.stream.close()
        return self.name, self.rows, self.samples


def run_batch(runs: list[tuple[str, int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.string()), pa.array([r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.list_(pa.string()))], ["run", "rows", "samples"])


def read_archives(manifest: DataFrame, folder: str, runs: str, tasks: int) -> DataFrame:
    """Read each archive file back and write its index rows as a sorted run; the written table of runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = [read_record(content) | {"file": name, "offset": at, "length": size} for at, size, content in members(stream)]
                rows.sort(key=lambda r: r["key"])
                out = RunWriter(runs)
                for row in rows:
                    out.add(row)
                yield run_batch([out.close()])

    return stash(manifest.select("file").repartition(tasks).mapInArrow(read, RUN_DDL), "runs")


def read_run(folder: str, name: str, low: str | None, high: str | None) -> Iterator[dict]:
    """The rows of a run with low <= key < high; row groups outside are skipped."""
    fs, root = place(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and ((low is not None and stats.max < low) or (high is not None and stats.min >= high)):
                continue
            for row in file.read_row_group(g).to_pylist():
                if (low is None or row["key"] >= low) and (high is None or row["key"] < high):
                    yield row


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so a new head plays one match a level."""

    def __init__(self, sources: list[Iterator], key: Callable):
        self.sources, self.key = sources, key
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] + [None] * (self.k - len(sources))
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = self.build(1) if self.k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        """Ended sources lose; of equal keys the earlier source wins."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y or (x == y and a < b)) or (x is None and y is None and a < b)

    def build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self.build(2 * node), self.build(2 * node + 1)
        win, lose = (a, b) if self.beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            self.heads[at] = next(self.sources[at], None)
            self.keys[at] = None if self.heads[at] is None else self.key(self.heads[at])
            node = (at + self.k) // 2
            while node >= 1:
                if self.beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merge(folder: str, names: list[str], low: str | None = None, high: str | None = None) -> Iterator[dict]:
    return iter(LoserTree([read_run(folder, n, low, high) for n in names], lambda r: r["key"]))


def fewer_runs(spark: SparkSession, table: DataFrame, folder: str) -> DataFrame:
    """Merge FAN_IN runs into one, each group a task, until a single merge can take them all."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column(0).to_pylist():
                out = RunWriter(folder)
                for row in merge(folder, names):
                    out.add(row)
                yield run_batch([out.close()])

    while (n := table.count()) > FAN_IN:
        groups = -(-n // FAN_IN)
        dealt = table.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list("run")).alias("names"))
        small = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / FAN_IN)), lambda i: F.slice("names", (i * FAN_IN + 1).cast("int"), F.lit(FAN_IN)))).alias("names"))
        table = stash(small.repartition(groups).mapInArrow(reduce, RUN_DDL), "runs")
    return table


def merged(spark: SparkSession, table: DataFrame, folder: str) -> DataFrame:
    """Index rows in global order: range, place in it, and the columns of INDEX; written."""
    table = fewer_runs(spark, table, folder)
    runs = sorted((r["run"], r["rows"]) for r in table.select("run", "rows").collect())  # FAN_IN at most
    total = sum(n for _, n in runs)
    ranges = max(1, -(-total // RANGE_ROWS))
    keys = sorted(k for r in table.select("samples").collect() for k in r["samples"])  # 2 * RUN_SAMPLES a run at most
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    names = [r for r, _ in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, at = [], 0
                for row in merge(folder, names, low, high):
                    held.append({"part": number, "place": at} | row)
                    at += 1
                    if len(held) >= RUN_GROUP:
                        yield pa.RecordBatch.from_pylist(held, out)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, out)

    out = pa.schema([("part", pa.int64()), ("place", pa.int64()), *INDEX])
    tasks = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bounds)], "part long, low string, high string").repartition(len(bounds))
    return stash(tasks.mapInArrow(run, "part long, place long, " + INDEX_DDL), "index")


def capture_index(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back, merge their index: INDEX's columns and capture_order, the global rank."""
    spark = pages.sparkSession
    folder, runs = fresh_path(spark, "warc"), fresh_path(spark, "warc-runs")
    manifest = write_archives(captures(pages), folder)
    table = read_archives(manifest, folder, runs, max(1, manifest.count()))
    index = merged(spark, table, runs)
    counts = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    first = spark.createDataFrame(starts, "part long, first long")
    return index.join(F.broadcast(first), "part").withColumn("capture_order", F.col("first") + F.col("place")).drop("part", "place", "first")
