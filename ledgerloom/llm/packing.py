"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily (largest unpacked piece that fits, again and again); then its smallest piece is replaced by
two unpacked pieces whose sum fits the expanded gap more tightly, while that improves. Pieces of equal length are
interchangeable, so the bins are planned on the histogram of lengths: at most ``capacity`` numbers reach the driver,
whatever the size of the corpus, and equal consecutive bins are planned at once with their multiplicity. The plan is
the same as that of packing one bin after another. Rows then find their place by their rank within their length, which
is counted in hash buckets, so that no length, however common, is ranked in one task.

Null text is an empty text and still a document (its end id only). Repeated rows and repeated ids are packed one by
one. An empty table gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import blocks, release, stash

CAPACITY = 1024
END_ID = 2
#: Rows that a rank bucket holds on average.
BUCKET_ROWS = 1 << 14
#: Characters on which the rank encoder's and the tokenizer's Unicode tables cannot differ; other texts go to the tokenizer.
PLAIN = r"[\t\n\r\x20-\x7e\xa0-\xffĀ-ſ‐-‧€]*+"


# ------------------------------------------------------------------ token ids
class Ids:
    """ids of whole texts, equal to the tokenizer file's own; plain texts take a faster encoder of the same merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken

        self.path, self._slow = path, None
        spec = json.load(open(path, encoding="utf-8"))
        self.plain = regex.compile(PLAIN)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        known = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if known and model["type"] == "BPE" and not model.get("end_of_word_suffix"):
            back = {c: b for b, c in byte_chars().items()}
            special = set(self.special)
            ranks = {bytes(back[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
            if sorted(ranks.values()) == list(range(len(ranks))):
                self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        del spec, pre, model
        release()

    @property
    def slow(self):
        """The library's tokenizer, loaded when a text first needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            fast = self.fast and not any(s in text for s in self.special) and self.plain.fullmatch(text)
            if fast:
                yield self.fast.encode_to_numpy(text, disallowed_special=())
            else:
                yield np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


#: Fixed value: the split pattern of byte-level BPE files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    if path not in _ENCODERS:
        _ENCODERS[path] = Ids(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids). The first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part, texts in blocks(batch, "text", 1_000_000):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for n, end in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, end - capacity) if n else 0
                        own = ids[start:end]
                        for k, v in zip(out, (doc, n, start, end - start, zlib.crc32(own.tobytes()), own if with_ids else None), strict=True):
                            out[k].append(v)
                cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids_crc32"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


# ------------------------------------------------------------------ the plan
def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many equal bins), in the order in which they are made."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    made = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return made
        free, need = left.copy(), np.zeros_like(left)
        bin_, gap = [], capacity

        def take(size: int) -> None:
            nonlocal gap
            bin_.append(size)
            free[size] -= 1
            gap -= size
            need[size] = max(need[size], left[size] - free[size])

        at = len(sizes) - 1
        while at >= 0:
            if sizes[at] <= gap and free[sizes[at]] > 0:
                take(int(sizes[at]))
            else:
                at -= 1
        while gap:
            least = min(bin_)
            pair = tightest_pair(sizes, free, least, gap + least)
            if pair is None:
                break
            bin_.remove(least)
            free[least] += 1
            gap += least
            take(pair[0])
            take(pair[1])
        used = left - free
        own = np.flatnonzero(used)
        again = int(min(1 + (left[s] - need[s]) // used[s] for s in own))
        left[own] -= again * used[own]
        made.append((sorted(bin_, reverse=True), again))


def tightest_pair(sizes: np.ndarray, free: np.ndarray, least: int, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum over ``least`` and within ``room``; of equal sums the most unequal."""
    have = [int(s) for s in sizes if free[s] > 0 and s < room]
    best, found = least, None
    low, high = 0, len(have) - 1
    while low <= high:
        total = have[low] + have[high]
        if total > room:
            high -= 1
        else:
            if total > best and (low < high or free[have[low]] > 1):
                best, found = total, (have[high], have[low])
                if total == room:
                    break
            low += 1
    return found


def places(made: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """Rows (length, first rank, end rank, first sequence, offsets in a sequence) that tell each rank its place."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, again in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for size in lengths:
            offsets.setdefault(size, []).append(at)
            at += size
        for size, own in offsets.items():
            first = rank.get(size, 0)
            rank[size] = first + len(own) * again
            rows.append((size, first, rank[size], sequence, own))
        sequence += again
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``cut`` (with doc_id, piece, length up to capacity) its sequence_id and offset.

    ``cut`` should be a written table, for it is read twice. The plan is a few thousand rows at most (each run of equal
    bins uses up a length), so it is broadcast.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(plan_bins(histogram, capacity))
    plan = spark.createDataFrame(rows, "p_length long, p_first long, p_end long, p_sequence long, p_offsets array<long>")
    buckets = max(16, -(-sum(histogram.values()) // BUCKET_ROWS))
    keyed = cut.withColumn("p_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "p_bucket").agg(F.count("*").alias("p_n"))
    before = Window.partitionBy("length").orderBy("p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "p_bucket", F.coalesce(F.sum("p_n").over(before), F.lit(0)).alias("p_before"))
    own = Window.partitionBy("length", "p_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("p_own", F.row_number().over(own) - 1)
        .join(starts, ["length", "p_bucket"])
        .withColumn("p_rank", F.col("p_before") + F.col("p_own"))
    )
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("p_first")) & (F.col("p_rank") < F.col("p_end")))
    nth, per = F.col("p_rank") - F.col("p_first"), F.size("p_offsets").cast("long")
    return placed.select(
        *cut.columns,
        (F.col("p_sequence") + F.expr("(p_rank - p_first) div size(p_offsets)")).alias("sequence_id"),
        F.element_at("p_offsets", (F.pmod(nth, per) + 1).cast("int")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """documents -> pieces with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(stash(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
