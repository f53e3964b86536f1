"""Audio features of media columns: polyphase resampling, log-mel filterbanks, hysteresis energy segments.

1. ``store_audio`` writes every payload losslessly as the 8-bit samples of a WAV file in a binary column.
2. ``store_features`` reads the stored bytes back and computes, for each row by itself (so equal payloads give equal
   values whatever stands beside them): samples resampled by a rational factor with a polyphase filter, overlapped Hann
   frames, a mel filterbank in decibels, and the segments whose energy rises above an upper and stays above a lower
   threshold. Features are chunks of one fixed shape (CHUNK_FRAMES x MELS, the last one padded), each with its time
   span; a task writes them as Arrow fixed-shape tensors into Parquet files of the shared folder. File names are unique
   to an attempt and only those of finished tasks enter the written manifest, so lost executors do no harm.
3. ``audio_features`` reads tensors, spans and segments back and digests them; ``tensor_rows`` gives them as rows.

Frames are computed in blocks and tensors written and read some thousands at a time, so that beside one payload and its
features memory does not grow with the texts; a very long text is handled whole. Null and empty payloads are stored as
one block of zeros. Repeated rows and ids give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import blocks, fresh_path, stash
from ledgerloom.llm.warc import place

#: A payload is padded with zeros to a positive multiple of this.
PAD = 64
RATE, UP, DOWN = 8000, 3, 4
TARGET = RATE * UP // DOWN
TAPS = 16  # of each phase
FRAME, HOP, FFT = TARGET * 25 // 1000, TARGET * 10 // 1000, 256
MELS, CHUNK_FRAMES = 20, 32
BLOCK_FRAMES = 512
FLOOR_DB = -100.0
#: Decibels above a row's lower quartile energy that open a segment, and those that keep it open.
OPEN_DB, KEEP_DB = 3.0, 1.0

#: Chunks written and read at once, and those after which a task begins its next pair of files.
GROUP_CHUNKS, FILE_CHUNKS = 2048, 32_768

TENSOR = pa.fixed_shape_tensor(pa.float32(), [CHUNK_FRAMES, MELS])
CHUNKS = pa.schema([("row", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("tensor", TENSOR)])
SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
MEDIA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("segments", pa.list_(SPAN))])


# ------------------------------------------------------------------ storage
def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """Mono PCM WAV with unsigned 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV file's data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's UTF-8 bytes, padded, as a WAV file; written to the shared folder."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                raw = [x.encode() for x in texts]
                media = [wav_bytes(x + bytes(-len(x) % PAD if x else PAD)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(rows.mapInArrow(store, "doc_id long, n_bytes long, media binary"), "media")


# ------------------------------------------------------------------ signal
@lru_cache
def phases() -> np.ndarray:
    """The low-pass filter's taps by phase, reversed for windows of samples: a windowed sinc, each phase summing to 1."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    own = taps.reshape(TAPS, UP).T[:, ::-1]
    return np.ascontiguousarray(own / own.sum(axis=1, keepdims=True))


def resample(samples: np.ndarray, start: int, n: int) -> np.ndarray:
    """Outputs start..start+n (start a multiple of UP) of the whole resampled signal; zeros stand before and after."""
    first, rounds = start // UP * DOWN, -(-n // UP)
    before = first - TAPS // 2
    need = rounds * DOWN + TAPS
    got = samples[max(0, before) : max(0, before + need)]
    x = np.zeros(need)
    at = max(0, -before)
    x[at : at + len(got)] = (got.astype(np.float64) - 128.0) / 128.0
    out = np.empty((rounds, UP))
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    for p in range(UP):
        shift, phase = divmod(p * DOWN, UP)
        out[:, p] = windows[shift : shift + rounds * DOWN : DOWN][:rounds] @ phases()[phase]
    return out.reshape(-1)[:n]


@lru_cache
def mel_weights() -> np.ndarray:
    """Triangles on the mel scale over the FFT's bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * TARGET / FFT
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@lru_cache
def hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS, energy of each frame), in decibels rounded to hundredths; one frame at least."""
    n_out = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-max(0, n_out - FRAME) // HOP) + 1)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for f in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - f)
        y = resample(samples, f * HOP, (n - 1) * HOP + FRAME)
        windows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
        power = np.abs(np.fft.rfft(windows * hann(), FFT, axis=1)) ** 2 / FRAME
        mels[f : f + n] = np.round(10 * np.log10(power @ mel_weights() + 1e-10), 2)
        energy[f : f + n] = np.round(10 * np.log10((windows**2).mean(axis=1) + 1e-10), 2)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that stay at the lower threshold or above and reach the upper one."""
    base = float(np.sort(energy)[len(energy) // 4])
    on = np.concatenate([[False], energy >= base + KEEP_DB, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    loud = np.concatenate([[0], np.cumsum(energy >= base + OPEN_DB)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if loud[b] > loud[a]]


def analyse(media: bytes) -> dict:
    """What one stored file holds: its payload, tensors with time spans, segments, and a digest of these features."""
    payload = wav_payload(media)
    mels, energy = log_mel(np.frombuffer(payload, np.uint8))
    frames, step = len(mels), HOP / TARGET
    last = len(payload) / RATE
    chunks = np.full((-(-frames // CHUNK_FRAMES) * CHUNK_FRAMES, MELS), FLOOR_DB, np.float32)
    chunks[:frames] = mels
    spans = [(a * step, min(last, (min(frames, a + CHUNK_FRAMES) - 1) * step + FRAME / TARGET), min(CHUNK_FRAMES, frames - a)) for a in range(0, frames, CHUNK_FRAMES)]
    parts = [(a * step, min(last, (b - 1) * step + FRAME / TARGET)) for a, b in segments(energy)]
    return {"payload": payload, "tensors": chunks.reshape(-1, CHUNK_FRAMES, MELS), "spans": spans, "segments": parts, "frames": frames}


# ------------------------------------------------------------------ files of tensors
class FeatureWriter:
    """A pair of Parquet files: a row a payload, and its chunks in the same order, tensors of one shape with their spans."""

    def __init__(self, folder: str):
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        self.name = uuid.uuid4().hex
        self.streams = [fs.open_output_stream(f"{root}/{self.name}.{kind}.parquet", compression=None) for kind in ("media", "tensors")]
        self.media, self.tensors = (pq.ParquetWriter(stream, schema, compression="zstd") for stream, schema in zip(self.streams, (MEDIA, CHUNKS), strict=True))
        self.rows, self.chunks, self.held, self.spans, self.blocks = 0, 0, [], [], []

    def add(self, row: dict, spans: list[tuple[float, float, int]], tensors: np.ndarray) -> None:
        self.held.append({"row": self.rows, **row})
        for at in range(0, len(tensors), GROUP_CHUNKS):
            part = tensors[at : at + GROUP_CHUNKS]
            self.spans += [(self.rows, *span) for span in spans[at : at + GROUP_CHUNKS]]
            self.blocks.append(part)
            if len(self.spans) >= GROUP_CHUNKS:
                self.flush()
        self.rows += 1
        self.chunks += len(tensors)

    def flush(self) -> None:
        if self.spans:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.spans, strict=True), CHUNKS.types[:-1], strict=True)]
            self.tensors.write_table(pa.Table.from_arrays([*columns, pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate(self.blocks))], schema=CHUNKS))
        if self.held:
            self.media.write_table(pa.Table.from_pylist(self.held, MEDIA))
        self.held, self.spans, self.blocks = [], [], []

    def close(self) -> tuple[str, int, int]:
        self.flush()
        for out in (self.media, self.tensors, *self.streams):
            out.close()
        return self.name, self.rows, self.chunks


def stored_rows(folder: str, name: str) -> Iterator[tuple[dict, Iterator[tuple[dict, np.ndarray]]]]:
    """Each payload's row of a pair of files with its chunks (spans, tensor); chunks are to be used before the next row."""
    fs, root = place(folder)

    def batches(kind: str, size: int) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(f"{root}/{name}.{kind}.parquet") as stream:
            yield from pq.ParquetFile(stream).iter_batches(size)

    def every() -> Iterator[tuple[dict, np.ndarray]]:
        for batch in batches("tensors", 256):
            yield from zip(batch.select(CHUNKS.names[:-1]).to_pylist(), batch.column("tensor").to_numpy_ndarray(), strict=True)

    chunks = every()
    for batch in batches("media", 256):
        for row in batch.to_pylist():
            yield row, (next(chunks) for _ in range(-(-row["n_frames"] // CHUNK_FRAMES)))


def store_features(stored: DataFrame, folder: str) -> DataFrame:
    """Write the features of stored media into folder; the manifest (name, rows, chunks), itself written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, n_bytes, media = (batch.column(c)[at].as_py() for c in range(3))
                got = analyse(media)
                payload = got["payload"]
                out = out or FeatureWriter(folder)
                row = {
                    "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-PAD:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": got["frames"], "segments": [{"start_s": a, "end_s": b} for a, b in got["segments"]],
                }
                out.add(row, got["spans"], got["tensors"])
                if out.chunks >= FILE_CHUNKS:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "rows", "chunks"), d, strict=True)) for d in done], pa.schema([("name", pa.string()), ("rows", pa.int64()), ("chunks", pa.int64())]))

    return stash(stored.mapInArrow(write, "name string, rows long, chunks long"), "tensor-files")


def each_file(files: DataFrame) -> DataFrame:
    """The manifest's names, a few files a task."""
    return files.select("name").repartition(max(1, min(files.count(), 10_000)))


def audio_features(docs: DataFrame) -> DataFrame:
    """Per document: digests of the payload and the stored form, and a feature digest of the tensors, spans and segments read back."""
    folder = fresh_path(docs.sparkSession, "tensors")
    files = store_features(store_audio(docs), folder)

    def digests(name: str) -> Iterator[dict]:
        for row, chunks in stored_rows(folder, name):
            hashed, spans = hashlib.sha256(), []
            for span, tensor in chunks:
                hashed.update(tensor.astype("<f4").tobytes())
                spans.append((span["start_s"], span["end_s"], span["frames"]))
            parts = [(s["start_s"], s["end_s"]) for s in row.pop("segments")]
            for times in (spans, parts):
                hashed.update(np.array(times).round(4).astype("<f8").tobytes())
            feature = f"logmel:{row['n_frames']}x{MELS};segments:{len(parts)};sha256:{hashed.hexdigest()}"
            yield {**row, "feature": feature, "n_chunks": len(spans), "n_segments": len(parts)}

    return files_rows(files, digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_chunks long, n_segments long")


def tensor_rows(files: DataFrame, folder: str) -> DataFrame:
    """The stored chunks as rows: doc_id, chunk (from 0), start_s, end_s, frames, tensor (row by row)."""

    def chunks_of(name: str) -> Iterator[dict]:
        for row, chunks in stored_rows(folder, name):
            for i, (span, tensor) in enumerate(chunks):
                yield {**span, "doc_id": row["doc_id"], "chunk": i, "tensor": tensor.reshape(-1)}

    return files_rows(files, chunks_of, "doc_id long, chunk int, start_s double, end_s double, frames int, tensor array<float>")


def files_rows(files: DataFrame, rows_of, ddl: str) -> DataFrame:
    """Rows that rows_of(name) yields for each file of a manifest, by batches."""
    fields = [(f.split()[0], f.split()[1]) for f in ddl.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<float>": pa.list_(pa.float32())}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for row in rows_of(name):
                    held.append({n: row[n] for n in schema.names})
                    if len(held) >= 512:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return each_file(files).mapInArrow(run, ddl)
