"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

The words of all documents are counted; the most frequent ones are compiled, with their token ids, into an automaton
whose equal suffixes are shared (incremental construction from sorted words). Every arc carries a number; the sum of
the numbers along a word's path is the word's row in a table of token ids, which makes the automaton a transducer. It
is written to one file in the shared folder, handed to every executor as a session file and memory-mapped there, so
that an executor's workers share its pages. Words outside the lexicon are merged exactly, by the tokenizer's own
merges, so the size of the lexicon changes the speed and never a result. Texts with characters on which two Unicode
tables could differ, or with the strings of special tokens, are encoded whole by the tokenizer library.

Null text is an empty text (no ids). Repeated rows and ids give repeated rows; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import blocks, fresh_path, most_frequent, stash

#: Words of the lexicon at most; a bound on the file (a few MB), on what reaches the driver and on nothing else.
LEXICON_WORDS = 1 << 17
#: Words that a worker remembers before it starts over.
MEMO_WORDS = 300_000
#: Distinct words that are counted in a worker before they are handed on.
COUNT_WORDS = 400_000
#: Characters whose lower case, class and normal form no Unicode version disputes (U+0130 lowers to two characters).
PLAIN = r"[\t\n\r\x20-\x7e\xa0-\xffĀ-įı-ſ‐-‧€]*+"


# ------------------------------------------------------------------ the automaton
class Transducer:
    """word -> row of a table, over sorted arc arrays: arc key (state * 256 + byte), target state, output, final states."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, longest: int):
        self.keys, self.targets, self.outputs, self.final, self.longest = keys, targets, outputs, final, longest

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """From distinct words in byte order; a word's row is its place in that order."""
        register: dict[tuple, int] = {}
        arcs_of: list[tuple] = []  # of registered states: ((byte, state), ...)
        final_of: list[bool] = []
        accepted: list[int] = []

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, *arcs)
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs_of)
                arcs_of.append(tuple(arcs))
                final_of.append(final)
                accepted.append(final + sum(accepted[t] for _, t in arcs))
            return state

        path: list[list] = [[False, []]]  # open states along the last word: [final, arcs]
        last, longest = b"", 0
        for word in words:
            if word <= last and (word or path[0][0]):
                raise ValueError("words must be distinct and sorted")
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            for at in range(len(last), same, -1):
                path[at - 1][1].append((last[at - 1], settle(*path.pop())))
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last, longest = word, max(longest, len(word))
        for at in range(len(last), 0, -1):
            path[at - 1][1].append((last[at - 1], settle(*path.pop())))
        root = settle(*path[0])
        order = [root, *(s for s in range(len(arcs_of)) if s != root)]  # the root is state 0
        name = {s: i for i, s in enumerate(order)}
        keys, targets, outputs = [], [], []
        for i, s in enumerate(order):
            before = int(final_of[s])
            for byte, target in arcs_of[s]:
                keys.append(i << 8 | byte)
                targets.append(name[target])
                outputs.append(before)
                before += accepted[target]
        return cls(np.array(keys, "<u4"), np.array(targets, "<u4"), np.array(outputs, "<u4"), np.array([final_of[s] for s in order], "u1"), longest)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Row of each word, -1 for words outside; all words take a step together."""
        found = np.full(len(words), -1, dtype=np.int64)
        if not len(words) or not len(self.final):
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
        alive = np.flatnonzero(lengths <= self.longest)
        state, row = np.zeros(len(alive), np.uint32), np.zeros(len(alive), np.int64)
        for step in range(self.longest + 1):
            ended = lengths[alive] == step
            hit = ended & (self.final[state] != 0)
            found[alive[hit]] = row[hit]
            alive, state, row = alive[~ended], state[~ended], row[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state << np.uint32(8) | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            alive, arc = alive[on], arc[on]
            state, row = self.targets[arc], row[on] + self.outputs[arc]
        return found


PARTS = ("keys", "targets", "outputs", "final", "id_starts", "ids")


def to_bytes(automaton: Transducer, ids: list[list[int]]) -> bytes:
    """One file: a JSON line with the layout, then the arrays, each at a multiple of 8."""
    starts = np.cumsum([0, *map(len, ids)]).astype("<u4")
    arrays = [automaton.keys, automaton.targets, automaton.outputs, automaton.final, starts, np.array([x for own in ids for x in own], "<u4")]
    layout, body = [], b""
    for name, a in zip(PARTS, arrays, strict=True):
        layout.append((name, a.dtype.str, len(a), len(body)))
        body += a.tobytes() + b"\0" * (-a.nbytes % 8)
    head = json.dumps({"longest": automaton.longest, "parts": layout}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + body


def open_mapped(path: str) -> tuple[Transducer, np.ndarray, np.ndarray]:
    with open(path, "rb") as f:
        line = f.readline()
    head, at, got = json.loads(line), len(line), {}
    for name, kind, n, place in head["parts"]:
        got[name] = np.memmap(path, kind, "r", at + place, (n,)) if n else np.empty(0, kind)
    return Transducer(got["keys"], got["targets"], got["outputs"], got["final"], head["longest"]), got["id_starts"], got["ids"]


# ------------------------------------------------------------------ words and tokens
class Words:
    """The tokenizer file's words, tokens and exact merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.plain = regex.compile(PLAIN)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.end = spec["model"].get("end_of_word_suffix")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [s["type"] for s in steps], spec["decoder"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None) or not self.end:
            raise ValueError("this operator reads word-end BPE files: NFC, white space, lower case; split, bytes")
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names[i] for i in range(max(names) + 1)]
        self.ends = np.array([n.endswith(self.end) for n in self.names])

    def of(self, text: str) -> list[str] | None:
        """The text's words, or None where only the library may split it."""
        if self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return self.split.findall(text.lower())
        return None

    def merge(self, words: list[str]) -> list[list[int]]:
        """Exact ids of each word; words are encoded together, and each ends at a word-end token."""
        out: list[list[int]] = []
        for at in range(0, len(words), 2048):
            ids = self.tokenizer.encode(" ".join(words[at : at + 2048]), add_special_tokens=False).ids
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            out.extend(ids[a:b] for a, b in zip([0, *ends], ends, strict=False))
        if len(out) != len(words):
            raise ValueError("a word does not end with a word-end token")
        return out


_WORDS: dict[str, Words] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def count_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over all documents that have words of their own (not those left to the library)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = words_of(tokenizer).of, Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text or "") or ())
                if len(seen) > COUNT_WORDS:
                    yield emit()
                    seen = Counter()
        yield emit()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def write_shared(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(content[at : at + (1 << 20)])
    finally:
        out.close()


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Count, compile, write and hand out the lexicon; returns the name under which executors find it."""
    spark = docs.sparkSession
    top = most_frequent(stash(count_words(docs, tokenizer), "words"), "n", size)
    words = sorted(r["word"].encode() for r in top.select("word").collect())
    ids = words_of(tokenizer).merge([w.decode() for w in words])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{fresh_path(spark, 'lexicon')}/{name}"
    write_shared(spark, path, to_bytes(Transducer.build(words), ids))
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Words to ids and tokens: the mapped lexicon first, exact merges for the rest, with a bounded memo."""

    def __init__(self, lexicon: str, tokenizer: str):
        self.words = words_of(tokenizer)
        self.automaton, self.starts, self.ids = open_mapped(lexicon)
        self.id_text: dict[str, str] = {}
        self.name_text: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words - self.id_text.keys())
        if len(self.id_text) + len(new) > MEMO_WORDS:
            self.id_text.clear()
            self.name_text.clear()
            new = list(words)
        rows = self.automaton.find([w.encode() for w in new])
        known = np.flatnonzero(rows >= 0)
        rest = np.flatnonzero(rows < 0).tolist()
        own: list = [None] * len(new)
        for i, a, b in zip(known.tolist(), self.starts[rows[known]].tolist(), self.starts[rows[known] + 1].tolist(), strict=True):
            own[i] = self.ids[a:b].tolist()
        for i, ids in zip(rest, self.words.merge([new[i] for i in rest]), strict=True):
            own[i] = ids
        names = self.words.names
        for word, ids in zip(new, own, strict=True):
            self.id_text[word] = " ".join(map(str, ids))
            self.name_text[word] = " ".join([names[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(decimal ids joined by a space, decoded text) of each whole text."""
        split = [self.words.of(t) for t in texts]
        self.learn(set().union(*(w for w in split if w)))
        ids, names = self.id_text.__getitem__, self.name_text.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                own = self.words.tokenizer.encode(text, add_special_tokens=False).ids
                yield " ".join(map(str, own)), self.words.tokenizer.decode(own, skip_special_tokens=False)
            else:
                yield " ".join(map(ids, words)), " ".join(map(names, words))


def encode(docs: DataFrame, tokenizer: str, lexicon: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (lexicon, tokenizer)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(SparkFiles.get(lexicon), tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part, texts in blocks(batch, "text", 2_000_000):
                both = list(_ENCODERS[key].encode(texts))
                n = [a.count(" ") + 1 if a else 0 for a, _ in both]
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array([sha(a) for a, _ in both]), pa.array([sha(b) for _, b in both])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([[int(x) for x in a.split()] for a, _ in both], pa.list_(pa.int64())), pa.array([b for _, b in both], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    return encode(docs, tokenizer, compile_lexicon(docs, tokenizer, size), with_ids)
