"""Audio features, WARC archives and their merged index, URL filters."""

import hashlib
import math
import random
import wave
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import DATA, same_rows

from ledgerloom.llm import audio, queries, urlfilter, warc
from tests.llm.helpers import edge_docs, edge_rows, empty_docs


def test_media_columns(spark):
    rows = audio.audio_features(edge_docs(spark)).collect()
    wanted = []
    for i, t, *_ in edge_rows():
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        wanted.append((-1 if i is None else i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:5]) for r in rows) == sorted(wanted)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert audio.audio_features(empty_docs(spark)).count() == 0


def slow_features(payload: bytes) -> tuple[list, list, list]:
    """(decibels of mel bands a frame, energies, segments) by loops from the definitions."""
    x = [(b - 128) / 128 for b in payload]
    taps = audio.phases()
    n_out = -(-len(x) * 3 // 4)
    y = []
    for m in range(n_out):
        at, phase = divmod(m * 4, 3)
        y.append(sum((x[i] if 0 <= i < len(x) else 0.0) * t for i, t in zip(range(at - 8, at + 8), taps[phase], strict=True)))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + k * (mel(3000) - mel(60)) / 21) / 2595) - 1) for k in range(22)]
    frames = max(1, -(-max(0, n_out - 150) // 60) + 1)
    mels, energy = [], []
    for f in range(frames):
        # samples behind the last one are the filter's tail over zeros, as in the operator
        w = [y[f * 60 + i] if f * 60 + i < n_out else float(audio.resample(np.frombuffer(payload, np.uint8), (f * 60 + i) // 3 * 3, 3)[(f * 60 + i) % 3]) for i in range(150)]
        energy.append(10 * math.log10(sum(v * v for v in w) / 150 + 1e-10))
        hann = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / 150)) for i, v in enumerate(w)]
        power = [abs(sum(v * np.exp(-2j * math.pi * k * i / 256) for i, v in enumerate(hann))) ** 2 / 150 for k in range(129)]
        bands = []
        for j in range(20):
            lo, mid, hi = edges[j : j + 3]
            total = 0.0
            for k, p in enumerate(power):
                hz = k * 6000 / 256
                total += p * max(0.0, min((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)))
            bands.append(10 * math.log10(total + 1e-10))
        mels.append(bands)
    energy = [round(e, 2) for e in energy]
    base = sorted(energy)[len(energy) // 4]
    runs, start, loud = [], None, False
    for f, e in enumerate([*energy, -math.inf]):
        if e >= base + 1:
            start, loud = f if start is None else start, loud or e >= base + 3
        else:
            if start is not None and loud:
                runs.append((start, f))
            start, loud = None, False
    return mels, energy, runs


def test_stored_tensors_equal_loops(spark, tmp_path):
    texts = ["", "short", "A longer text, " * 30 + "\u00e9\u00df\u6f22 " * 40 + "aaaa" * 90, "x" * 64, "quiet ~~~~ LOUD \x00\x01\u00ff" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = f"file://{tmp_path}/tensors"
    files = audio.store_features(audio.store_audio(docs), folder)
    got = {}
    for r in audio.tensor_rows(files, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    features = {r["doc_id"]: r for r in audio.audio_features(docs).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        mels, _, runs = slow_features(payload)
        chunks = sorted(got[i], key=lambda r: r["chunk"])
        assert [c["chunk"] for c in chunks] == list(range(-(-len(mels) // 32))) and features[i]["n_frames"] == len(mels) and features[i]["n_chunks"] == len(chunks)
        read = np.array([c["tensor"] for c in chunks], np.float32).reshape(-1, 20)
        assert np.abs(read[: len(mels)] - np.array(mels)).max() < 0.011 and (read[len(mels) :] == audio.FLOOR_DB).all()
        ends = len(payload) / 8000
        spans = [(k * 0.32, min(ends, (min(len(mels), k * 32 + 32) - 1) * 0.01 + 0.025), min(32, len(mels) - k * 32)) for k in range(len(chunks))]
        assert np.allclose([(c["start_s"], c["end_s"], c["frames"]) for c in chunks], spans)
        parts = [(a * 0.01, min(ends, (b - 1) * 0.01 + 0.025)) for a, b in runs]
        hashed = hashlib.sha256(read.astype("<f4").tobytes() + np.array(spans).round(4).astype("<f8").tobytes() + np.array(parts).round(4).astype("<f8").tobytes())
        assert features[i]["feature"] == f"logmel:{len(mels)}x20;segments:{len(runs)};sha256:{hashed.hexdigest()}"


def test_files_hold_arrow_tensors_and_split(tmp_path):
    writer = audio.FeatureWriter(f"file://{tmp_path}/t")
    rng = np.random.default_rng(1)
    blocks = [rng.random((n, audio.CHUNK_FRAMES, audio.MELS), np.float32) for n in (1, 5000, 3)]
    for k, b in enumerate(blocks):
        writer.add({"doc_id": k, "n_bytes": 0, "payload_bytes": 0, "payload_sha256": "", "tail_crc32": 0, "media_bytes": 0, "media_sha256": "", "n_frames": len(b) * audio.CHUNK_FRAMES, "segments": []}, [(0.0, 1.0, 32)] * len(b), b)
    name, rows, chunks = writer.close()
    assert (rows, chunks) == (3, 5004)
    assert pq.read_schema(f"{tmp_path}/t/{name}.tensors.parquet").field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [audio.CHUNK_FRAMES, audio.MELS])
    for (row, read), b in zip(audio.stored_rows(f"file://{tmp_path}/t", name), blocks, strict=True):
        assert np.array_equal(np.stack([t for _, t in read]), b) and row["n_frames"] == len(b) * audio.CHUNK_FRAMES


def test_wav_is_lossless():
    data = bytes(range(256)) * 3
    with wave.open(BytesIO(audio.wav_bytes(data))) as w:
        assert (w.getframerate(), w.getsampwidth(), w.readframes(w.getnframes())) == (audio.RATE, 1, data)
    assert audio.wav_payload(audio.wav_bytes(data)) == data


def test_resampling_equals_a_loop():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, 500, dtype=np.uint8)
    y = audio.resample(x, 0, 375)
    taps = audio.phases()
    for m in (0, 1, 2, 100, 374):
        at, phase = divmod(m * audio.DOWN, audio.UP)
        own = [(float(x[i]) - 128) / 128 if 0 <= i < len(x) else 0.0 for i in range(at - audio.TAPS // 2, at + audio.TAPS // 2)]
        assert math.isclose(y[m], float(np.dot(own, taps[phase])), abs_tol=1e-12)
    assert np.allclose(audio.resample(x, 90, 60), y[90:150])  # blocks join without a seam


def test_hysteresis():
    energy = np.array([-50.0] * 6 + [-48.5, -46, -48.5, -50, -48.5, -50])
    assert audio.segments(energy) == [(6, 9)]


def test_tone_is_in_its_band():
    t = np.arange(4000)
    low, high = (audio.log_mel((128 + 100 * np.sin(2 * np.pi * f * t / audio.RATE)).astype(np.uint8))[0].mean(axis=0).argmax() for f in (200, 2000))
    assert low < high


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def pages(spark):
    big, other = "<p>é" * 400, "<p>x" * 400
    rows = [(i, f"http://{h}.example.org/{i % 3}?q={i}#f", html) for i, (h, html) in enumerate([("a", big), ("b", big), ("a", "small"), ("c", "small"), ("a", None), ("b", ""), ("a", other)])]
    rows += [(3, None, big), (90, "no url %0A\n", other), (91, "HTTP://User@Host.Example:80/P/%41", big), (91, "http://h/", big), (None, "http://null.id/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as file", "'x' as key"), rows


def test_archives(spark):
    frame, rows = pages(spark)
    got = warc.capture_index(frame.repartition(3)).collect()
    wanted = []
    for i, _, html in rows:
        own = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == own and j is not None]
        largest = max(ids) if len(own) >= 1000 and ids else None
        kind = "response" if largest is None or i == largest else "revisit"
        wanted.append((-1 if i is None else i, len(own), hashlib.sha1(own).hexdigest(), kind, largest if kind == "revisit" else -1))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == sorted(wanted)
    order = sorted(got, key=lambda r: r["capture_order"])
    keys = [(r["url_key"], r["fetched"], -1 if r["page_id"] is None else r["page_id"]) for r in order]
    assert keys == sorted(keys) and [r["capture_order"] for r in order] == list(range(len(rows)))


def test_archives_of_nothing(spark):
    assert warc.capture_index(pages(spark)[0].where("false")).count() == 0


def test_many_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    frame, rows = pages(spark)
    order = sorted(warc.capture_index(frame.repartition(7)).collect(), key=lambda r: r["capture_order"])
    keys = [(r["url_key"], r["fetched"]) for r in order]
    assert len(order) == len(rows) and keys == sorted(keys)


def test_web_queries_equal_sql(spark):
    for name in ("op2_warc_index_merge", "op5_temporal_url_filter"):
        same_rows(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


def test_filters(spark):
    changes = spark.createDataFrame([("Bad.org", "block", 100), ("bad.org", "remove", 200), ("bad.org/ok", "allow", 50), ("bad.org", "allow", 200), ("bad.org", "block", 300), (None, "block", 1), ("x.org", None, 1)], "key string, action string, since long")
    captures = [(1, "http://bad.org/x", 99), (1, "http://bad.org/x", 100), (1, "http://www.bad.org/x", 150), (2, "http://bad.org/ok/y?z", 150), (2, "http://bad.org/okay", 150), (3, "http://bad.org", 250), (3, "http://notbad.org", 350), (3, "http://bad.org", 350), (3, "http://bad.org", 350), (None, None, 350), (4, "", 350)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched long")
    got = urlfilter.evaluate(frame, urlfilter.intervals(changes)).collect()
    assert len(got) == len(captures)
    verdicts = {(r["url"], r["fetched"]): r["verdict"] for r in got}
    assert [verdicts[u, t] for _, u, t in captures] == ["allow", "block", "block", "allow", "block", "allow", "allow", "block", "block", "allow", "allow"]
    assert urlfilter.evaluate(frame.where("false"), urlfilter.intervals(changes)).count() == 0
    assert {r["verdict"] for r in urlfilter.evaluate(frame, urlfilter.intervals(changes.where("false"))).collect()} == {"allow"}
