"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed subword n-grams (3 and 4 bytes of lower-case UTF-8, with
word edges); a linear softmax over it gives the languages. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows (PER_LANGUAGE a language, those with the least hash of
their id and text; LANGUAGES at most). A part of the sample is kept from training and calibrates the model: a temperature is fitted to it, and the
probability that all but REJECT of its rows reach for their own language becomes the threshold under which a text is
rejected. Whole texts are read, in pieces of bounded size.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are rejected. With no labelled
row at all every text is ``und``. Rows with null language or id are never learned from but are predicted. Ties between
languages go to the first in code-point order. Repeated rows give repeated rows, an empty table none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import blocks, crc_mod, release, stash

UNKNOWN = "und"
#: Labelled rows of each language that training may use.
PER_LANGUAGE = 750
#: Languages that training may learn, and steps of the histogram by which the sample is chosen.
LANGUAGES, STEPS = 64, 8
BUCKET_BITS, DIMENSIONS = 14, 8
EPOCHS, BATCH, RATE = 12, 32, 4.0
#: Every so many rows of the sample calibrate instead of training.
CALIBRATE_EVERY = 3
#: The share of rows of known languages that calibration lets be rejected.
REJECT = 0.002
PIECE = 1 << 18

LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and bytes over 127 stand for themselves, all else for a word edge.
EDGE = 0x20
KEEP = np.array([b if b >= 128 or chr(b).isalpha() else EDGE for b in range(256)], np.uint32)


def ngrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the 3- and 4-byte subwords of bytes that begin and end with an edge."""
    b = KEEP[data]
    edge = b == EDGE
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    inner = ~edge[1:-1]
    four = three[:-1] | b[3:] << np.uint32(24)
    inner4 = inner[:-1] & ~edge[2:-1]
    spread = np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BUCKET_BITS)
    return np.concatenate([(three[inner] * spread) >> shift, (four[inner4] * spread ^ four[inner4] >> np.uint32(15)) * spread >> shift]).astype(np.intp)


def pieces(text: str) -> Iterator[np.ndarray]:
    """The text's bytes between edges, in pieces that overlap by what a subword needs."""
    data = b" " + text.lower().encode("utf-8", "replace") + b" "
    for at in range(0, max(1, len(data) - 3), PIECE):
        yield np.frombuffer(data[at : at + PIECE + 3], np.uint8)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # what a bucket adds to each language's score: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Softmax inputs of whole texts; each text by itself, so equal texts have equal scores."""
        out = np.tile(self.bias, (len(texts), 1))
        for i, text in enumerate(texts):
            total, n = np.zeros(len(self.languages)), 0
            for data in pieces(text):
                found = ngrams(data)
                counts = np.bincount(found, minlength=len(self.table)) if len(found) > len(self.table) // 2 else None
                total += counts @ self.table if counts is not None else self.table[found].sum(axis=0)
                n += len(found)
            out[i] += total / max(n, 1)
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.scores(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ------------------------------------------------------------------ training
def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of the sample: of each language the per_language texts of least hash.

    A histogram of the hashes' logarithms (STEPS a power of two, so a bounded number of rows a language) gives the least
    share of all texts that holds enough; only texts within it are read further, repeated ones once. No task has to hold
    a language. The LANGUAGES most frequent values of lang are learned.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    key = F.xxhash64("doc_id", "text")
    step = F.floor(-F.log2((F.shiftrightunsigned(key, 11) + 1) / float(1 << 53)) * STEPS).cast("int")
    keyed = usable.select("lang", "text", key.alias("l_key"), step.alias("l_step"))
    each = keyed.groupBy("lang", "l_key").agg(F.first("l_step").alias("l_step"))
    hist = each.groupBy("lang", "l_step").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("l_step")))
    within = hist.withColumn("total", total - F.col("n")).where(F.col("total") < per_language).groupBy("lang").agg(F.min("l_step").alias("l_least"))
    sizes = hist.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    least = stash(within.join(sizes, "lang").select("lang", "l_least"), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                new = [i for i, k in enumerate(part.column(0).to_pylist()) if not (k in met or met.add(k))]
                found = [np.unique(np.concatenate([ngrams(p) for p in pieces(texts[i])]), return_counts=True) for i in new]
                sizes = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int32())) for x in ([a for a, _ in found], [n for _, n in found])]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(new, pa.int64())) for c in (0, 1)), *lists], ["l_key", "lang", "buckets", "counts"])

    rows = keyed.join(F.broadcast(least), "lang").where(F.col("l_step") >= F.col("l_least")).select("l_key", "lang", "text")
    got = rows.mapInArrow(count, "l_key long, lang string, buckets array<int>, counts array<int>").toArrow()
    names, keys = got.column("lang").to_pylist(), got.column("l_key").to_numpy().view(np.uint64)
    lists = [got.column(c).combine_chunks() for c in ("buckets", "counts")]
    out, taken = [], {}
    for i in np.argsort(keys, kind="stable"):
        own = taken.setdefault(names[i], set())
        if len(own) < per_language and keys[i] not in own and len(lists[0][i].values):
            own.add(keys[i])
            out.append((names[i], *(x[i].values.to_numpy().astype(kind) for x, kind in zip(lists, (np.intp, float), strict=True))))
    return out


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], reject: float = REJECT, seed: int = 7) -> Model:
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    every = [(number[lang], b, c / c.sum()) for lang, b, c in rows]
    kept = every[CALIBRATE_EVERY - 1 :: CALIBRATE_EVERY] or every
    used = [r for i, r in enumerate(every) if i % CALIBRATE_EVERY != CALIBRATE_EVERY - 1] or every
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.3, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(used))
        for at in range(0, len(order), BATCH):
            part = [used[i] for i in order[at : at + BATCH]]
            hidden = np.stack([c @ embed[b] for _, b, c in part])
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(part)), [y for y, _, _ in part]] -= 1
            error /= len(part)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= rate * 0.1 * error.sum(axis=0)
            for (_, b, c), g in zip(part, back, strict=True):
                embed[b] -= rate * 10 * np.outer(c, g)
    model = Model(languages, (embed @ weights).astype(np.float64), bias)
    return calibrate(model, kept, reject)


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], reject: float) -> Model:
    """Fit the temperature by the kept rows' likelihood; the threshold leaves out a share ``reject`` of them at most."""
    scores = np.stack([model.bias + c @ model.table[b] for _, b, c in rows])
    true = np.array([y for y, _, _ in rows])
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(true)), true] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.2, 8, 60), key=loss))
    own = np.sort(softmax(scores / model.temperature)[np.arange(len(true)), true])
    model.threshold = float(min(own[int(reject * len(own))], 0.5 + 0.5 / len(model.languages)))
    return model


# ------------------------------------------------------------------ prediction
def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (doc_id) with lang_pred, score (calibrated probability) and rejected."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.col("text").cast("string").alias("l_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, texts in blocks(batch, "l_text", 1_000_000):
                known = [i for i, t in enumerate(texts) if own.languages and LETTER.search(t)]
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    p = own.probabilities([texts[i] for i in known])
                    score[known] = np.round(p.max(axis=1), 6)
                    for i, best in zip(known, p.argmax(axis=1), strict=True):
                        names[i] = own.languages[best]
                rejected = [n == UNKNOWN or s < own.threshold for n, s in zip(names, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names), pa.array(score), pa.array(rejected)], [*part.schema.names[1:], "lang_pred", "score", "rejected"])
        release()

    schema = held.drop("l_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return held.mapInArrow(run, schema)


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(col, 4) == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model:
    """A model from the labelled rows that are not held out."""
    return train(sample(docs.where(~held_out())))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(marked, train_on(docs), ["doc_id", "held_out"])
