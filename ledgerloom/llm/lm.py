"""Language-model scoring by online logistic context mixing.

A text is its words (runs of anything but ASCII white space, A-Z lower-cased), each closed by a space, and one end. Three
kinds of binary decisions code it:

* In the text: a word whose context (the one or two words before) stood in the text before is, or is not, the word that
  followed there last. Bit predictors under the hashed contexts count their hits as the text goes on; their logits are
  mixed with weights that a gate chooses by the last outcomes, and an adaptive map refines the mix.
* Letters: bytes along a code tree. Predictors are tables of bit counts under hashed contexts (letters before, the word
  so far, most with the class of the last telling short word before it); a mixer adds their logits with weights that a
  gate chooses, learned online by gradient steps, and an adaptive map refines the mix.
* Units: a word's count, and its count after the class of word before it, are mixed with its letters; the count of a whole
  phrase is mixed with its words. A phrase ends at a word whose hash is a multiple of PHRASE, or with the text.

The sum of all decisions' costs is the text's total of bits; the score (log10 probability) and bits a byte follow.

All of it comes from all training documents. Words (by class of word before), phrases and outcomes in texts are counted
by key, so these counts grow with the corpus. The letter tables count the bits of every word as often as it stands in the
training texts, and are trusted as far as different words gave these bits. The mixer and map learn from every distinct pair of class and word, for the letters price what the counts
have not seen; words are split in halves by hash, and each half is learned from with the tables of the other. The trust in counts is fitted on all training words and phrases, with their own occurrence
taken off. A training document's phrases are scored with the counts of the other documents (its own are taken off), so
that what stands twice in the corpus is told from what stands once. Counts of the COMMON most frequent words are broadcast; all others are joined by
hash, so COMMON changes the speed only. Words and phrases are identified by 64-bit hashes. The letter tables have the
same size at every input size.

Null text is an empty text (its end alone). A null id counts as not held out and is learned from. Repeated rows are
scored each; equal texts that are both held out, or both not, get equal values. Long words are coded in pieces and long
texts in blocks of whole texts. Without training documents all counts are 0 and every word is unknown. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import blocks, crc_mod, most_frequent, release, stash
from ledgerloom.llm.shingles import chunks, hashes_between, mix, word_hashes, word_places  # noqa: F401

COMMON = 1 << 19
BLOCK_CHARS = 2_500_000
#: Letters whose decisions are expanded at once, and longest piece of a word.
LETTERS_AT_ONCE, PIECE_BYTES = 1 << 14, 1 << 12
CLASSES = 6
#: Words that may show a class, their length at most, and the cosine at which two stand in the same documents.
HINTS, SHORT, ALIKE = 64, 3, 0.5
#: Table sizes (bits) of the predictors, in the order of ``contexts``.
BITS = (18, 20, 20, 20)
STARTS = np.cumsum([0, *(1 << b for b in BITS)])
SLOTS = int(STARTS[-1])
CHUNK = 1 << 13
#: Bits of all predictors that are gathered before they are counted.
GATHERED = 3_000_000
#: Bits of a number of occurrences beside a bit's place.
OFTEN = 40
#: First letters of a piece that may be shared with the piece before it in order.
SHARED = 16
DELTA = 0.2
SPACE, END = 0x20, 0x0A
END_HASH = np.uint64(0x5851F42D4C957F2D)
POSITIONS, SEEN = 4, 4
GATES = POSITIONS * SEEN * SEEN
INPUTS = len(BITS) + 1
RATE, STEP, STEADY = 0.02, 4096, 125
MAP_BINS, MAP_LIMIT, MAP_SETS = 33, 8.0, 256
#: A phrase ends with a word whose mixed hash is a multiple of this power of two.
PHRASE = 32
#: States of an in-text predictor: none, or hits and misses of its context so far, each in four steps.
FEW = np.array([0, 1, 2, 2, 3])
STATES, LAST = 17, 3
OUTCOMES = STATES * STATES * 2 * LAST
#: Steps of a gain in bits, as kept in the histogram on which trust is fitted.
GAIN_STEP, GAIN_LIMIT, NEVER = 0.5, 200, -1000

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


# ------------------------------------------------------------------ code tree
@dataclass
class Code:
    """For each byte: its decisions, as (node, bit) in a flat list."""

    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        """Huffman's tree of byte counts (one added to each)."""
        heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            (n, at, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (n + m, at, node))
            node += 1
        nodes, bits, lengths = [], [], []
        for b in range(256):
            path, at = [], b
            while at in parent:
                at, bit = parent[at]
                path.append((at - 256, bit))
            nodes += [n for n, _ in path[::-1]]
            bits += [x for _, x in path[::-1]]
            lengths.append(len(path))
        lengths = np.array(lengths)
        return cls(np.cumsum(lengths) - lengths, lengths, np.array(nodes, np.uint64), np.array(bits, np.uint8))


# ------------------------------------------------------------------ words of texts
@dataclass
class Tokens:
    """The words of some texts and each text's end (length 0): hash, class of what stands before, text number, place in data."""

    hashes: np.ndarray
    before: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    data: np.ndarray
    n: int  # texts


@dataclass
class Hints:
    """Short frequent words and the class that each shows; words of one language tend to fall into one class."""

    words: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, top: np.ndarray, together: np.ndarray) -> Hints:
        """From short words' hashes, most frequent first, and the number of documents that hold both of each two: a word
        joins the first class led by a more frequent word that stands in much the same documents, or leads its own."""
        alone = np.sqrt(np.diag(together)) + 1e-9
        leaders, classes = [], []
        for i in range(len(top)):
            like = [k for k, j in enumerate(leaders) if together[i, j] / (alone[i] * alone[j]) >= ALIKE]
            if not like and len(leaders) < CLASSES - 1:
                leaders.append(i)
                like = [len(leaders) - 1]
            classes.append(1 + like[0] if like else 0)
        order = np.argsort(top)
        return cls(top[order], np.array(classes, np.int64)[order])

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The class of each word, 0 for none."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.words):
            short = np.flatnonzero(lengths <= SHORT)
            at = np.minimum(np.searchsorted(self.words, hashes[short]), len(self.words) - 1)
            out[short] = np.where(self.words[at] == hashes[short], self.classes[at], 0)
        return out


NO_HINTS = Hints(np.empty(0, np.uint64), np.empty(0, np.int64))


def tokens(texts: list[str], hints: Hints) -> Tokens:
    hashes, text, starts, lengths, parts, size = [], [], [], [], [], 0
    for numbers, at, data in chunks(texts):
        own, ends = word_places(data)
        hashes.append(hashes_between(data, own, ends))
        starts.append(own + size)
        lengths.append(ends - own)
        text.append(np.array(numbers)[np.searchsorted(at, own, side="right") - 1] if len(own) else np.empty(0, np.int64))
        parts.append(LOWERED[data])
        size += len(data)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    t = join(text, np.int64)
    ends = np.searchsorted(t, np.arange(len(texts)), side="right")
    h = np.insert(join(hashes, np.uint64), ends, END_HASH)
    s, n, t = np.insert(join(starts, np.int64), ends, 0), np.insert(join(lengths, np.int64), ends, 0), np.insert(t, ends, np.arange(len(texts)))
    own = hints.find(h, n)
    recent = np.concatenate([[-1], np.maximum.accumulate(np.where(own > 0, np.arange(len(h)), -1))[:-1]]).astype(np.int64) if len(h) else np.empty(0, np.int64)
    first = np.searchsorted(t, np.arange(len(texts)))
    before = np.where(recent >= first[t], own[np.maximum(recent, 0)], 0) if len(h) else own
    return Tokens(h, before, t, s, n, join(parts, np.uint8), len(texts))


@dataclass
class Distinct:
    """The words of some texts: hash and number of each token's; and the pairs of class and word: token, number of each token's."""

    hashes: np.ndarray
    word: np.ndarray
    at: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, t: Tokens) -> Distinct:
        hashes, word = np.unique(t.hashes, return_inverse=True)
        both = word * CLASSES + t.before
        at = np.full(len(hashes) * CLASSES, -1)
        at[both[::-1]] = np.arange(len(both))[::-1]
        some = np.flatnonzero(at >= 0)
        number = np.zeros(len(at), np.int64)
        number[some] = np.arange(len(some))
        return cls(hashes, word, at[some], number[both])


def phrases(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, where it begins, phrase of each token); the text's end closes its last phrase."""
    closes = (t.lengths == 0) | (mix(t.hashes) % np.uint64(PHRASE) == 0)
    number = np.cumsum(closes) - closes
    begin = np.flatnonzero(np.concatenate([[True], closes[:-1]])) if len(closes) else np.empty(0, np.int64)
    place = (np.arange(len(number)) - begin[number] + 1).astype(np.uint64) if len(begin) else np.empty(0, np.uint64)
    sums = np.add.reduceat(mix(t.hashes + place * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else np.empty(0, np.uint64)
    return mix(sums), begin, number


def bytes_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words at these places as binary values."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[at])])


# ------------------------------------------------------------------ decisions in the text
def in_order(first: np.ndarray, second: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by a pair of numbers below ids, those of the same pair by place; and which of them have the pair of the one before."""
    wide, many = int(ids).bit_length(), len(first).bit_length()
    if 2 * wide + many > 63:
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        return order, np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    keys = np.sort(((first << wide | second) << many) + np.arange(len(first)))
    pair = keys >> many
    return keys & ((1 << many) - 1), np.concatenate([[False], pair[1:] == pair[:-1]])


def followed(first: np.ndarray, second: np.ndarray, t: Tokens, word: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token (last, state): what followed its context (two numbers) last in its text, -1 if nothing did, and the
    predictor's state, by how often that was right before."""
    order, again = in_order(first, second, ids)
    w, text = word[order], t.text[order]
    again[1:] &= text[1:] == text[:-1]
    at = np.flatnonzero(again)
    before = w[at - 1]
    hit = before == w[at]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != at[:-1] + 1]), np.arange(len(at)), 0)) if len(at) else at
    total = np.cumsum(hit) - hit
    hits = total - total[start]
    last, state = np.full(len(w), -1), np.zeros(len(w), np.int64)
    last[order[at]] = before
    state[order[at]] = 1 + few(hits) * 4 + few(np.arange(len(at)) - start - hits)
    return last, state


def few(n: np.ndarray) -> np.ndarray:
    return FEW[np.minimum(n, len(FEW) - 1)]


def in_text(t: Tokens, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens that have a decision, its state, its bit); word: the number of each token's word."""
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    starts = np.concatenate([[True], t.text[1:] != t.text[:-1]])
    second = np.concatenate([[False], starts[:-1]])
    one = np.where(starts, 0, np.concatenate([[0], word[:-1] + 1]))
    two = np.where(starts | second, 0, np.concatenate([[0], one[:-1]]))
    ids = int(word.max()) + 2
    last1, state1 = followed(one, np.zeros_like(one), t, word, ids)
    last2, state2 = followed(one, two, t, word, ids)
    said = np.where(state2 > 0, last2, last1)
    at = np.flatnonzero(state1)
    bit = (said == word)[at]
    q1, q2 = state1[at], state2[at]
    outcome = np.zeros(len(word), np.int64)
    outcome[at] = 1 + bit
    before = np.where(starts, 0, np.concatenate([[0], outcome[:-1]]))[at]
    return at, ((q2 * STATES + q1) * 2 + (last1 == said)[at]) * LAST + before, bit


def outcome_logits(n: np.ndarray) -> np.ndarray:
    """Logit of every state from the training outcomes n (states x 2).

    The logits of both predictors are mixed with the weights of a gate (agreement, outcome before), learned by gradient
    steps; the states' own counts refine the mix as far as they have been seen.
    """
    q2, q1, agree, last = np.unravel_index(np.arange(OUTCOMES), (STATES, STATES, 2, LAST))
    st = np.empty((3, OUTCOMES))
    for i, q in enumerate((q2, q1 * 2 + agree)):
        own = np.stack([np.bincount(q, n[:, b], 2 * STATES) for b in (0, 1)])
        st[i] = np.log((own[1] + DELTA) / (own[0] + DELTA))[q]
    st[2] = 1.0
    gate, weights, total = agree * LAST + last, np.full((3, 2 * LAST), 0.4), n.sum(axis=1)
    weights[2] = 0.0
    seen = np.maximum(np.bincount(gate, total, 2 * LAST), 1)
    for _ in range(300):
        error = n[:, 1] - total / (1 + np.exp(-np.clip((weights[:, gate] * st).sum(axis=0), -30, 30)))
        weights += 0.1 * np.stack([np.bincount(gate, error * x, 2 * LAST) for x in st]) / seen
    mixed = np.clip((weights[:, gate] * st).sum(axis=0), -MAP_LIMIT, MAP_LIMIT)
    p = 1 / (1 + np.exp(-mixed))
    return np.log((n[:, 1] + 4 * p) / (n[:, 0] + 4 * (1 - p)))


# ------------------------------------------------------------------ decisions of letters
@dataclass
class Decisions:
    word: np.ndarray  # where each word's decisions begin, or each letter's
    bit: np.ndarray
    slots: list[np.ndarray]  # of each predictor, counted from its own table's start
    position: np.ndarray
    letter: np.ndarray  # the byte before

    def part(self, a: int, b: int) -> Decisions:
        """Those of the words (or letters) from a to b."""
        first, end = (int(self.word[i]) if i < len(self.word) else len(self.bit) for i in (a, b))
        return Decisions(self.word[a:b] - first, self.bit[first:end], [s[first:end] for s in self.slots], self.position[first:end], self.letter[first:end])


SPREAD = np.uint64(0xD1342543DE82EF95)


def spread(ctx: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts and nodes, both times SPREAD."""
    return ((ctx + node) >> np.uint64(64 - bits)).astype(np.int32)


def closed(lengths: np.ndarray) -> np.ndarray:
    """Letters of pieces with the space or end that closes them."""
    return np.where(lengths > 0, lengths + 1, 1)


def decisions(code: Code, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, letters: np.ndarray | None = None) -> Decisions:
    """Of words at places in data, each closed by a space (a length of 0 stands for the end of a text); or of some of
    their letters only, by number and in this order."""
    full = closed(lengths)
    begin = np.cumsum(full) - full
    total = int(full.sum())
    at = np.arange(total) - np.repeat(begin, full)
    symbol = data.take(np.repeat(starts, full) + at, mode="clip") if len(data) else np.zeros(total, np.uint8)
    symbol[begin + full - 1] = np.where(lengths > 0, SPACE, END)
    back = lambda k: np.where(at >= k, np.concatenate([symbol[:k], symbol[:-k]])[:total], np.uint8(SPACE))
    b1, b2, b3, b4 = (back(k) for k in (1, 2, 3, 4))
    byte_hash = mix((symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_hash)])
    prefix = run[:-1] - np.repeat(run[begin], full) + at.astype(np.uint64)
    kind = np.repeat(before.astype(np.uint64), full)
    if letters is not None:
        at, symbol, b1, b2, b3, b4, prefix, kind = (x[letters] for x in (at, symbol, b1, b2, b3, b4, prefix, kind))
    b1, b2, b3, b4 = (x.astype(np.uint64) for x in (b1, b2, b3, b4))
    three, shown = b1 | b2 << np.uint64(8) | b3 << np.uint64(16), kind << np.uint64(24)
    contexts = [mix(b1 | shown), mix(three | shown), mix((three | b4 << np.uint64(24)) + np.uint64(1 << 33)), mix(mix(prefix) + kind + np.uint64(7))]
    n = code.lengths[symbol]
    first = np.cumsum(n) - n
    flat = np.arange(int(n.sum())) + np.repeat(code.starts[symbol] - first, n)
    node = (code.nodes * np.uint64(0x9E3779B97F4A7C15) * SPREAD)[flat]
    return Decisions(
        first[begin] if letters is None else first, code.bits[flat], [spread(np.repeat(c * SPREAD, n), node, b) for c, b in zip(contexts, BITS, strict=True)],
        np.repeat(np.minimum(at, POSITIONS - 1).astype(np.uint8), n), np.repeat(b1.astype(np.int32), n),
    )


def window(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skip: int) -> np.ndarray:
    """Eight letters of each piece from the one numbered skip, as a number; 0 after the space or end that closes it."""
    if len(data) < 8:
        data = np.concatenate([data, np.zeros(8, np.uint8)])
    last = len(data) - 8
    place = np.minimum(starts + skip, last)
    left = np.clip(lengths - skip, -1, 8)
    bits = lambda n: (8 * np.clip(n, 0, 8)).astype(np.uint64)
    x = np.ndarray(last + 1, ">u8", data, strides=(1,))[place].astype(np.uint64) << bits(starts + skip - place)
    x = np.where(left > 0, x >> bits(8 - np.maximum(left, 1)) << bits(8 - np.maximum(left, 1)), np.uint64(0))
    closing = np.where(lengths > 0, SPACE, END).astype(np.uint64)
    return np.where((left >= 0) & (left < 8), x | closing << bits(7 - np.clip(left, 0, 7)), x)


def alike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of pieces in which those of one class with the same first letters stand together, how many first letters
    each shares with the one before it, SHARED at most). The class and the letters up to it decide all of a letter's bits."""
    head, tail = window(data, starts, lengths, 0), window(data, starts, lengths, 8)
    order = np.argsort(before.astype(np.uint64) << np.uint64(56) | head >> np.uint64(8), kind="stable")
    head, tail, before = head[order], tail[order], before[order]
    shared = np.zeros(len(order), np.int64)
    equal = np.ones(max(len(order) - 1, 0), bool) & (before[1:] == before[:-1])
    for x in (head, tail):
        differ = x[1:] ^ x[:-1]
        for k in range(7, -1, -1):
            shared[1:] += equal & (differ < np.uint64(1 << 8 * k) if k else differ == 0)
        equal &= differ == 0
    return order, np.minimum(shared, closed(lengths[order]))


@dataclass
class Tree:
    """Some pieces in the order of alike(), and how many first letters each shares with the one before it (the first: none).
    Each letter that is not shared is new; it stands for those of the pieces after it that share it."""

    full: np.ndarray
    shared: np.ndarray
    row: np.ndarray  # of each new letter
    at: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, shared: np.ndarray) -> Tree:
        full, shared = closed(lengths), np.concatenate([np.zeros(1, np.int64), shared[1:]])
        new = full - shared
        row = np.repeat(np.arange(len(full)), new)
        return cls(full, shared, row, np.arange(len(row)) - np.repeat(np.cumsum(new) - full, new))

    def letters(self) -> np.ndarray:
        """The new letters' numbers among all letters of the pieces."""
        return (np.cumsum(self.full) - self.full)[self.row] + self.at

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Of each piece the sum over its letters, from the new letters' values."""
        new, rows = self.full - self.shared, np.arange(len(self.full))
        out = np.bincount(self.row, each, len(new))
        begin = np.cumsum(new) - new - self.shared
        for k in range(int(self.shared.max())):
            own = np.flatnonzero(self.shared > k)
            from_ = np.maximum.accumulate(np.where(self.shared <= k, rows, 0))[own]
            out[own] += each[begin[from_] + k]
        return out

    def stand_for(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(in how many pieces each new letter stands, the sum of these pieces' n)."""
        rows, total = np.arange(len(self.full)), np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        end = self.row + 1
        for k in range(int(self.shared.max())):
            own = np.flatnonzero(self.at == k)
            until = np.minimum.accumulate(np.where(self.shared <= k, rows, len(rows))[::-1])[::-1]
            end[own] = np.concatenate([until[1:], [len(rows)]])[self.row[own]]
        return end - self.row, total[end] - total[self.row]


def cut(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of words that have a bounded number of decisions."""
    size = np.cumsum(lengths + 1)
    cuts = np.searchsorted(size, np.arange(LETTERS_AT_ONCE, int(size[-1]) if len(size) else 0, LETTERS_AT_ONCE))
    edges = [0, *dict.fromkeys(int(c) for c in cuts if 0 < c < len(lengths)), len(lengths)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield slice(a, b)


def pieces(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, length) of pieces of PIECE_BYTES at most; most words are one piece."""
    many = np.maximum(-(-lengths // PIECE_BYTES), 1)
    word = np.repeat(np.arange(len(lengths)), many)
    at = (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)) * PIECE_BYTES
    return word, starts[word] + at, np.minimum(lengths[word] - at, PIECE_BYTES)


# ------------------------------------------------------------------ counting
def binary(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a binary column without nulls."""
    values = batch.column(batch.schema.get_field_index(column))
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), offsets[:-1], np.diff(offsets)


WORD, PHRASES, OUTCOME = 0, 1, 2


def count_training(training: DataFrame, hints: Hints) -> DataFrame:
    """kind, key, word, c, n0..: words with their bytes and counts by class before, phrases, outcomes (2 * state + bit) in texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "word", "before", "n"]
        outcomes = np.zeros(2 * OUTCOMES, np.int64)

        def rows(kind: int, keys: np.ndarray, words: pa.Array, before: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), words, pa.array(before.astype(np.int32)), pa.array(n.astype(np.int64))], names)

        for texts in gathered(batches):
            t = tokens(texts, hints)
            own = Distinct.of(t)
            at = own.at
            yield rows(WORD, t.hashes[at], bytes_of(t.data, t.starts[at], t.lengths[at]), t.before[at], np.bincount(own.pair, minlength=len(at)))
            keys, n = np.unique(phrases(t)[0], return_counts=True)
            yield rows(PHRASES, keys, pa.nulls(len(keys), pa.binary()), np.zeros(len(keys)), n)
            _, state, bit = in_text(t, own.word)
            outcomes += np.bincount(2 * state + bit, minlength=2 * OUTCOMES)
        some = np.flatnonzero(outcomes)
        yield rows(OUTCOME, some.astype(np.int64), pa.nulls(len(some), pa.binary()), np.zeros(len(some)), outcomes[some])
        release()

    each = training.select("text").mapInArrow(count, "kind int, key long, word binary, before int, n long")
    by_class = [F.sum(F.when((F.col("kind") == WORD) & (F.col("before") == k), F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(CLASSES)]
    return each.groupBy("kind", "key", "word").agg(F.sum("n").alias("c"), *by_class)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Texts in blocks of BLOCK_CHARS characters at most (one text at least) across batches."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for _, texts in blocks(batch, "text", BLOCK_CHARS):
            more = sum(map(len, texts))
            if held and size + more > BLOCK_CHARS:
                yield held
                held, size = [], 0
            held, size = held + texts, size + more
    if held:
        yield held


@dataclass
class Pairs:
    """Pairs of a word and a class before it, of one batch of counted words."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    before: np.ndarray
    half: np.ndarray
    n: np.ndarray  # of the pair
    c: np.ndarray  # of the word

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Pairs:
        data, starts, lengths = binary(batch, "word")
        by_class = np.stack([batch.column(batch.schema.get_field_index(f"n{k}")).to_numpy() for k in range(CLASSES)])
        before, row = np.nonzero(by_class)
        key, c = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("key", "c"))
        half = (mix(key.view(np.uint64)) & np.uint64(1)).astype(np.int64)
        return cls(data, starts[row], lengths[row], before, half[row], by_class[before, row], c[row])

    def count(self, own: np.ndarray, code: Code, tables: BitCounts) -> None:
        """Add the bits of some pairs, letters that pairs share at once."""
        word, starts, lengths = pieces(self.starts[own], self.lengths[own])
        own = own[word]
        order, shared = alike(self.data, starts, lengths, self.before[own])
        own, starts, lengths = own[order], starts[order], lengths[order]
        for part in cut(lengths):
            tree = Tree.of(lengths[part], shared[part])
            pairs, n = tree.stand_for(self.n[own[part]])
            kind = np.where(pairs > 1, 2, n > 1).astype(np.uint8)
            by_kind = np.argsort(kind, kind="stable")
            d = decisions(code, self.data, starts[part], lengths[part], self.before[own[part]], tree.letters()[by_kind])
            pairs, n = pairs[by_kind], n[by_kind]
            one, several, end = *np.searchsorted(kind[by_kind], [1, 2]), len(kind)
            tables.add(d.part(0, one))
            tables.add(d.part(one, several), n[one:several])
            tables.add(d.part(several, end), n[several:], pairs[several:])

    def batches(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(pairs, and of each piece: the pair's place among these, start, length) of some pairs, a bounded number of letters at once."""
        own = np.flatnonzero(which)
        word, starts, lengths = pieces(self.starts[own], self.lengths[own])
        for part in cut(lengths):
            some, back = np.unique(word[part], return_inverse=True)
            yield own[some], back, starts[part], lengths[part]


class BitCounts:
    """Counts of the bits in all slots, and of the pairs that gave them; what comes is gathered and sorted, so that the
    tables are walked in order."""

    def __init__(self) -> None:
        self.table = np.zeros(2 * SLOTS, np.uint32)
        self.most = 0  # no count is larger
        self.pairs = np.zeros(SLOTS, np.uint32)
        self.single: list[np.ndarray] = []  # places of bits that stand once
        self.often: list[np.ndarray] = []  # places and numbers of the others
        self.shared: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places of bits that several pairs share, these pairs, numbers
        self.size = 0

    def add(self, d: Decisions, n: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        """The bits of these pieces (or letters), each as often as its piece stands in the texts (without n: once), of one
        pair each or of so many."""
        if not len(d.bit):
            return
        many = np.diff(np.concatenate([d.word, [len(d.bit)]]))
        often, shared = (None if x is None else np.repeat(x, many) for x in (n, pairs))
        for slots, start in zip(d.slots, STARTS, strict=False):
            keys = (slots + np.int32(start)) * np.int32(2) + d.bit
            if shared is not None:
                self.shared.append((keys, shared, often))
            elif often is not None:
                self.often.append((keys.astype(np.int64) << OFTEN) + often)
            else:
                self.single.append(keys)
        self.size += len(d.bit) * len(d.slots)
        if self.size > GATHERED:
            self.flush()

    def flush(self) -> None:
        if self.single:
            keys = np.sort(np.concatenate(self.single).astype(np.int32))
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            pairs = np.diff(np.concatenate([start, [len(keys)]]))
            self.count(keys[start], pairs, pairs)
        if self.often:
            keys = np.sort(np.concatenate(self.often))
            own = keys >> OFTEN
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self.count(own[start], np.diff(np.concatenate([start, [len(keys)]])), np.add.reduceat(keys & ((1 << OFTEN) - 1), start))
        if self.shared:
            keys, pairs, n = (np.concatenate(x) for x in zip(*self.shared, strict=True))
            order = np.argsort(keys)
            own = keys[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self.count(own[start], np.add.reduceat(pairs[order], start), np.add.reduceat(n[order], start))
        self.single, self.often, self.shared, self.size = [], [], [], 0

    def count(self, keys: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> None:
        for bit in (0, 1):
            own = np.flatnonzero(keys & 1 == bit)
            self.pairs[keys[own] >> 1] += pairs[own].astype(np.uint32)
        self.most += int(n.max())
        if self.most >> 32:
            self.table = self.table.astype(np.uint64, copy=False)
        self.table[keys] += n.astype(self.table.dtype)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(chunk, its packed numbers) where any is not 0; counts have 4 bytes or, where these might not hold them, 8."""
        self.flush()
        for i, (pairs, own) in enumerate(zip(self.pairs.reshape(-1, CHUNK), self.table.reshape(-1, 2 * CHUNK), strict=True)):
            if pairs.any():
                yield i, packed(pairs, own)


def packed(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A chunk's numbers of pairs and counts of bits, compressed by byte planes (most high bytes are 0); the first byte is the counts' width."""
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (pairs, counts)]
    return bytes([counts.itemsize]) + pa.compress(b"".join(planes), "zstd", asbytes=True)


def parted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of pairs, counts of bits) of a chunk that was packed."""
    wide = blob[0]
    flat = np.frombuffer(pa.decompress(blob[1:], (4 + 2 * wide) * CHUNK, "zstd"), np.uint8)
    numbers = lambda x, kind: np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return numbers(flat[: 4 * CHUNK], "<u4"), numbers(flat[4 * CHUNK :], f"<u{wide}")


def letter_counts(words: DataFrame, code: Code) -> DataFrame:
    """(chunk of the tables of half 0, then half 1; its counts) of all training text.

    What stands before and in a word decides its contexts, so a pair's bits are made once and count as often as the pair
    stands in the training texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = BitCounts(), BitCounts()
        for batch in batches:
            p = Pairs.of(batch)
            for h in (0, 1):
                p.count(np.flatnonzero(p.half == h), code, tables[h])
        for h, own in enumerate(tables):
            held = own.blobs()
            while some := list(islice(held, 16)):  # small batches: the engine holds them outside its heap
                keys, blobs = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys) + h * (SLOTS // CHUNK)), pa.array(blobs, pa.binary())], ["key", "blob"])
        del tables, own, held
        release()

    return words.mapInArrow(count, "key long, blob binary")


def logits(counted: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(logit, in how many pairs seen) of every slot, of half 0, half 1 and both: SLOTS numbers each, whatever the input.

    A bit's share is that of its occurrences; it is trusted as far as different pairs have shown it, for a word that
    stands a thousand times tells little of other words.
    """
    per_half = SLOTS // CHUNK

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, pairs = None, np.zeros((2, 2 * CHUNK)), np.zeros((2, CHUNK))

        def done() -> pa.RecordBatch:
            blob = b""
            for x, seen in zip((*sums, sums.sum(axis=0)), (*pairs, pairs.sum(axis=0)), strict=True):
                n = x.reshape(-1, 2)
                n = n * (seen / np.maximum(n.sum(axis=1), 1))[:, None]
                blob += np.log((n[:, 1] + DELTA) / (n[:, 0] + DELTA)).astype("<f2").tobytes() + np.minimum(seen, 255).astype("u1").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([blob], pa.binary())], ["key", "blob"])

        for batch in batches:
            for chunk, half, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, sums, pairs = chunk, np.zeros((2, 2 * CHUNK)), np.zeros((2, CHUNK))
                some, counts = parted(blob)
                pairs[half] += some
                sums[half] += counts
        if now is not None:
            yield done()

    rows = counted.select(F.pmod("key", F.lit(per_half)).alias("chunk"), F.floor(F.col("key") / per_half).cast("int").alias("half"), "blob")
    out = [(np.zeros(SLOTS, np.float16), np.zeros(SLOTS, np.uint8)) for _ in range(3)]
    for r in rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(total, "key long, blob binary").toLocalIterator():
        at = r["key"] * CHUNK
        for i, (st, seen) in enumerate(out):
            st[at : at + CHUNK] = np.frombuffer(r["blob"], "<f2", CHUNK, 3 * CHUNK * i)
            seen[at : at + CHUNK] = np.frombuffer(r["blob"], "u1", CHUNK, 3 * CHUNK * i + 2 * CHUNK)
    return out


# ------------------------------------------------------------------ mixing
SEEN_CLASS = np.array([0 if n == 0 else 1 if n < 3 else 2 if n < 20 else 3 for n in range(256)], np.uint8)


def widened(half: np.ndarray) -> np.ndarray:
    """Bits of finite two-byte floats as four-byte floats (a cast takes twice the time)."""
    x = half.astype(np.uint32)
    return ((x & np.uint32(0x7FFF)) << np.uint32(13) | (x & np.uint32(0x8000)) << np.uint32(16)).view(np.float32) * np.float32(2.0**112)


def bits_of(logit: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Costs of bits whose logits are within the map's limits."""
    return np.log(1 + np.exp(np.where(bit == 1, -logit, logit))) * np.float32(1 / math.log(2))


@dataclass
class Letters:
    """The mixer of letters with the tables it reads."""

    code: Code
    st: np.ndarray
    seen: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((INPUTS, GATES), 0.35, np.float32))
    map: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-MAP_LIMIT, MAP_LIMIT, MAP_BINS, dtype=np.float32), MAP_SETS))

    def inputs(self, d: Decisions) -> tuple[list[np.ndarray], np.ndarray]:
        st = [widened(self.st[a:b].view(np.uint16).take(s)) for s, a, b in zip(d.slots, STARTS[:-1], STARTS[1:], strict=True)]
        st.append(np.full(len(d.bit), 0.3, np.float32))
        word, after = (SEEN_CLASS.take(self.seen[STARTS[i] : STARTS[i + 1]].take(d.slots[i])) for i in (3, 1))
        return st, ((d.position.astype(np.uint8) * np.uint8(SEEN) + word) * np.uint8(SEEN) + after).astype(np.int64)

    def mixed(self, st: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gate), np.float32)
        for own, x in zip(self.weights, st, strict=True):
            out += own[gate] * x
        return np.clip(out, -MAP_LIMIT, MAP_LIMIT)

    def refined(self, out: np.ndarray, letter: np.ndarray) -> np.ndarray:
        spot = (out + MAP_LIMIT) * ((MAP_BINS - 1) / (2 * MAP_LIMIT))
        low = np.minimum(spot.astype(np.int64), MAP_BINS - 2)
        part = (spot - low).astype(np.float32)
        at = letter * MAP_BINS + low
        return 0.5 * out + 0.5 * (self.map[at] * (1 - part) + self.map[at + 1] * part)

    def costs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bits of the letters of these words."""
        out = np.zeros(len(lengths))
        word, at, size = pieces(starts, lengths)
        order, shared = alike(data, at, size, before[word])
        word, at, size = word[order], at[order], size[order]
        for part in cut(size):
            tree = Tree.of(size[part], shared[part])
            d = decisions(self.code, data, at[part], size[part], before[word[part]], tree.letters())
            logit = self.refined(self.mixed(*self.inputs(d)), d.letter)
            np.add.at(out, word[part], tree.sums(np.add.reduceat(bits_of(logit, d.bit), d.word, dtype=np.float64)))
        return np.round(out, 4)

    def learn(self, d: Decisions, rate: float, gates: np.ndarray, bins_seen: np.ndarray) -> np.ndarray:
        """Online: STEP decisions after another, each step's errors move the weights and the map. Gives the bits of each
        piece as they were before its own steps; gates and bins_seen count what was learned from."""
        cost, bins = np.empty(len(d.bit), np.float32), np.empty(len(d.bit), np.int64)
        st, gate = self.inputs(d)
        for a in range(0, len(d.bit), STEP):
            now = slice(a, a + STEP)
            own, to, bit, letter = [x[now] for x in st], gate[now], d.bit[now], d.letter[now]
            out = self.mixed(own, to)
            cost[now] = bits_of(self.refined(out, letter), bit)
            error = bit - 1 / (1 + np.exp(-out))
            for i, x in enumerate(own):
                self.weights[i] += rate * np.bincount(to, error * x, GATES).astype(np.float32)
            bins[now] = near = np.round((out + MAP_LIMIT) * ((MAP_BINS - 1) / (2 * MAP_LIMIT))).astype(np.int64) + letter * MAP_BINS
            miss = bit - 1 / (1 + np.exp(-self.map[near]))
            self.map += np.float32(rate) * np.bincount(near, miss, len(self.map)).astype(np.float32)
        gates += np.bincount(gate, minlength=GATES)
        bins_seen += np.bincount(bins, minlength=len(self.map))
        return np.add.reduceat(cost, d.word, dtype=np.float64)


@dataclass
class Model:
    letters: Letters
    hints: Hints
    words: np.ndarray  # hashes of the common words, sorted
    counts: np.ndarray  # and their counts in training: in all, after each class
    total: int  # training tokens
    by_class: np.ndarray  # training tokens after each class
    trust: np.ndarray  # classes x 3: share of the letters, of a word's count, of its count after the class
    outcomes: np.ndarray  # logit of each state in texts
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the common ones, -1 where they are not."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def final(self, bits: np.ndarray, c: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bits of a word from those of its letters and its counts."""
        trust = self.trust[before]
        share = trust[:, 1] * c / max(self.total, 1) + trust[:, 2] * n / np.maximum(self.by_class[before], 1)
        with np.errstate(divide="ignore"):
            return -np.logaddexp2(np.log2(trust[:, 0]) - bits, np.log2(share))

    def final_column(self, bits: Column, c: Column, n: Column, before: Column) -> Column:
        """final() of joined counts."""
        of = lambda x: F.element_at(F.array(*(F.lit(float(v)) for v in x)), before + 1)
        letters = of(self.trust[:, 0])
        share = c * of(self.trust[:, 1] / max(self.total, 1)) + n * of(self.trust[:, 2] / np.maximum(self.by_class, 1))
        return F.when(share > 0, -F.log2(share + letters * F.pow(F.lit(2.0), -bits))).otherwise(bits - F.log2(letters))


def gain(c: np.ndarray, total: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """What a count, its own occurrence taken off, says against the letters: steps of a bounded histogram."""
    with np.errstate(divide="ignore"):
        steps = np.round((np.log2((c - 1) / np.maximum(total - 1, 1)) + bits) / GAIN_STEP)
    return np.where(c > 1, np.clip(steps, -GAIN_LIMIT, GAIN_LIMIT), NEVER).astype(np.int64)


def fit_letters(words: DataFrame, code: Code, total: int, by_class: np.ndarray) -> tuple[Letters, np.ndarray]:
    """The mixer of letters, and the trust in counts.

    Each task learns from its own shard of the distinct pairs, in a fixed random order and each half with the other's
    tables; the shards' weights and maps are averaged, each by what it was learned from. Trust is fitted by expectation
    steps over all training words, whose own occurrence is taken off their counts.
    """
    *halves, both = logits(letter_counts(words, code))
    shared = words.sparkSession.sparkContext.broadcast((code, halves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = shared.value
        own = Letters(code, *tables[0])
        gates, bins, steps = np.zeros(GATES), np.zeros(MAP_SETS * MAP_BINS), 0
        gains: dict[tuple[int, int, int], int] = {}
        random = np.random.default_rng(5)
        for batch in batches:
            p = Pairs.of(batch)
            for h in (0, 1):
                own.st, own.seen = tables[1 - h]
                bits = np.zeros(len(p.n))
                for some, back, starts, lengths in p.batches(p.half == h):
                    order = random.permutation(len(back))
                    d = decisions(code, p.data, starts[order], lengths[order], p.before[some][back[order]])
                    np.add.at(bits, some[back[order]], own.learn(d, RATE / (1 + steps / STEADY) + RATE / 50, gates, bins))
                    steps += -(-len(d.bit) // STEP)
                at = np.flatnonzero(p.half == h)
                before, n, c = p.before[at], p.n[at], p.c[at]
                states = np.stack([before, gain(c, total, bits[at]), gain(n, by_class[before], bits[at])])
                for key, many in zip(*weighted(states, n), strict=True):
                    gains[key] = gains.get(key, 0) + many
        if steps:
            blob = np.concatenate([(own.weights * gates).reshape(-1), own.map * bins, gates, bins]).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int32()) for _ in range(3)), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], names)
        keys = np.array(list(gains), np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), pa.array(list(gains.values()), pa.int64()), pa.nulls(len(keys), pa.binary())], names)
        release()

    names = ["before", "word", "pair", "n", "blob"]
    learned = stash(words.mapInArrow(run, "before int, word int, pair int, n long, blob binary"), "learned")
    edges = np.cumsum([INPUTS * GATES, MAP_SETS * MAP_BINS, GATES])
    sums = [np.zeros(INPUTS * GATES), np.zeros(MAP_SETS * MAP_BINS), np.zeros(GATES), np.zeros(MAP_SETS * MAP_BINS)]
    for r in learned.where("blob is not null").select("blob").toLocalIterator():
        for x, more in zip(sums, np.split(np.frombuffer(r["blob"], "<f8"), edges), strict=True):
            x += more
    weights, flat, gates, bins = sums
    out = Letters(code, *both)
    out.weights = np.where(gates > 0, weights.reshape(INPUTS, GATES) / np.maximum(gates, 1e-9), out.weights).astype(np.float32)
    out.map = np.where(bins > 0, flat / np.maximum(bins, 1e-9), out.map).astype(np.float32)
    gains = learned.where("blob is null").groupBy("before", "word", "pair").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return out, fit_trust(*(gains.column(x).to_numpy() for x in ("before", "word", "pair", "n")))


def weighted(states: np.ndarray, n: np.ndarray) -> tuple[list[tuple[int, ...]], list[int]]:
    """Distinct columns of states and the sums of n."""
    keys, inverse = np.unique(states, axis=1, return_inverse=True)
    return list(map(tuple, keys.T.tolist())), np.bincount(inverse.reshape(-1), n, keys.shape[1]).astype(np.int64).tolist()


def fit_trust(before: np.ndarray, word: np.ndarray, pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of letters, count and count after the class, for each class."""
    trust = np.full((CLASSES, 3), 1 / 3)
    odds = np.stack([np.ones(len(n)), *(np.where(g == NEVER, 0.0, np.exp2(np.where(g == NEVER, 0, g) * GAIN_STEP)) for g in (word, pair))])
    for _ in range(20):
        own = trust[before].T * odds
        own = own / own.sum(axis=0) * n
        sums = np.stack([np.bincount(before, x, CLASSES) for x in own], axis=1) + [0.2, 0.1, 0.1]
        trust = sums / sums.sum(axis=1, keepdims=True)
    return trust


# ------------------------------------------------------------------ scoring
#: Bits of the letters of common words after each class, as far as this worker has met them, for the last model it met.
MET: dict[str, np.ndarray] = {}


def letter_bits(model: Model, t: Tokens, at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Bits of the letters of the tokens at these places; common: place of each word among the model's, or -1."""
    if model.name not in MET:
        MET.clear()
        MET[model.name] = np.full((len(model.words) + 1, CLASSES), np.nan, np.float64)
    met, before = MET[model.name], t.before[at]
    out = np.where(common >= 0, met[common, before], np.nan)
    new = np.flatnonzero(np.isnan(out))
    out[new] = model.letters.costs(t.data, t.starts[at[new]], t.lengths[at[new]], before[new])
    kept = new[common[new] >= 0]
    met[common[kept], before[kept]] = out[kept]
    return out


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of phrases (phrase, key, own, row, doc_id, held_out, bits, logs, n_tokens, n_known, n_bytes), and with null row,
    words whose counts are to be joined: phrase, key, n occurrences, paid of them by letters and count, bits of the letters, before."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["phrase", "key", "n", "row", "doc_id", "held_out", "bits", "logs", "n_tokens", "n_known", "n_bytes", "paid", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        yes, no = np.logaddexp(0, -own.outcomes) / math.log(2), np.logaddexp(0, own.outcomes) / math.log(2)
        row = phrase = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in blocks(batch, "text", BLOCK_CHARS):
                t = tokens(texts, own.hints)
                words = Distinct.of(t)
                at, inverse = words.at, words.pair
                common = own.find(words.hashes)[words.word[at]]
                letters = letter_bits(own, t, at, common)
                c, n = (np.where(common >= 0, x, 0) for x in (own.counts[common, 0], own.counts[common, 1 + t.before[at]]))
                word_bits = np.where(c > 0, own.final(letters, c, n, t.before[at]), 0.0)
                decided, state, bit = in_text(t, words.word)
                token_bits, paid = word_bits[inverse], np.ones(len(t.hashes), bool)
                token_bits[decided] = np.where(bit, yes[state], token_bits[decided] + no[state])
                paid[decided[bit]] = False
                hash_, begin, number = phrases(t)
                many = len(begin)
                sums = lambda x: np.bincount(number, x, many)  # noqa: E731, B023
                hit = (c > 0)[inverse]
                text = t.text[begin]
                _, same, count = np.unique(mix(hash_ + mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(phrase + np.arange(many)), pa.array(hash_.view(np.int64)), pa.array(count[same].astype(np.int64)), pa.array(row + text),
                    part.column(1).take(pa.array(text)), part.column(2).take(pa.array(text)), pa.array(sums(token_bits)), pa.array(sums(np.where(c > 0, np.log10(c + 0.5), 0.0)[inverse])),
                    pa.array(sums(None).astype(np.int64)), pa.array(sums(hit).astype(np.int64)), pa.array(sums(t.lengths + 1).astype(np.int64)), pa.nulls(many, pa.int32()), pa.nulls(many, pa.int32()),
                ], names)
                rest = np.flatnonzero(~hit)
                where, which, size, pays = grouped(number[rest], inverse[rest], paid[rest])
                many, first = len(size), at[which]
                blank = lambda kind: pa.nulls(many, kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    pa.array(phrase + where), pa.array(t.hashes[first].view(np.int64)), pa.array(size), blank(pa.int64()), blank(pa.int64()), blank(pa.bool_()), pa.array(letters[which]),
                    blank(pa.float64()), blank(pa.int64()), blank(pa.int64()), blank(pa.int64()), pa.array(pays.astype(np.int32)), pa.array(t.before[first].astype(np.int32)),
                ], names)
                phrase, row = phrase + len(begin), row + t.n
        release()

    return docs.mapInArrow(run, "phrase long, key long, n long, row long, doc_id long, held_out boolean, bits double, logs double, n_tokens long, n_known long, n_bytes long, paid int, before int")


def grouped(first: np.ndarray, second: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers, how often each stands, and how often with the flag."""
    if not len(first):
        return (np.empty(0, np.int64),) * 4
    wide = int(second.max()).bit_length() + 1
    keys = np.sort((first << wide) + (second << 1) + flag)
    pair = keys >> 1
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[start] >> (wide - 1), pair[start] & ((1 << (wide - 1)) - 1), np.diff(np.concatenate([start, [len(pair)]])), np.add.reduceat(keys & 1, start)


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(col, 5) == 1, F.lit(False))


@dataclass
class Fitted:
    model: Model
    words: DataFrame  # key, c, n0..
    phrases: DataFrame  # key, c
    distinct: int  # training tokens
    n_phrases: int


def prepared(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))


def fit(training: DataFrame) -> Fitted:
    """Learn from all these texts."""
    code, hints = look_over(training)
    counted = stash(count_training(training, hints), "counts")
    words, found = counted.where(F.col("kind") == WORD), counted.where(F.col("kind") == PHRASES).select("key", "c")
    sums = counted.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("c").alias("c"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(CLASSES)))
    totals = {r["kind"]: r for r in sums.collect()}
    total, v = (totals[WORD]["c"], totals[WORD]["rows"]) if WORD in totals else (0, 0)
    by_class = np.array([totals[WORD][f"n{k}"] if WORD in totals else 0 for k in range(CLASSES)], np.int64)
    letters, trust = fit_letters(words, code, total, by_class)
    outcomes = np.zeros(2 * OUTCOMES)
    for r in counted.where(F.col("kind") == OUTCOME).select("key", "c").collect():  # 2 * OUTCOMES at most
        outcomes[r["key"]] = r["c"]
    common = most_frequent(words, "c", COMMON).select("key", "c", *(f"n{k}" for k in range(CLASSES))).toArrow()
    key = common.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    counts = np.stack([common.column(i).to_numpy() for i in range(1, CLASSES + 2)], axis=1)[order]
    counts = np.concatenate([counts, np.zeros((1, CLASSES + 1), np.int64)])  # read for words that are not common
    counts = counts.astype(np.int32 if counts.max() < 1 << 31 else np.int64)
    model = Model(letters, hints, key[order], counts, total, by_class, trust, outcome_logits(outcomes.reshape(-1, 2)))
    release()
    return Fitted(model, words.drop("word", "kind"), found, v, totals[PHRASES]["c"] if PHRASES in totals else 0)


def phrase_trust(rows: DataFrame) -> float:
    """Expectation steps over all training phrases (bits, share of their count without their own occurrences)."""
    step = F.when(F.col("share") > 0, F.greatest(F.least(F.round((F.log2("share") + F.col("bits")) / GAIN_STEP), F.lit(2000)), F.lit(-2000)).cast("int"))
    hist = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    odds = np.array([0.0 if r["step"] is None else np.exp2(min(r["step"] * GAIN_STEP, 1000.0)) for r in hist])
    n, trust = np.array([r["n"] for r in hist], float), 0.5
    for _ in range(20):
        trust = (float((n * trust * odds / (trust * odds + 1 - trust)).sum()) + 0.1) / (n.sum() + 1)
    return min(max(trust, 1e-6), 0.98)


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    docs = prepared(documents)
    return score_with(docs, fit(docs.where(~F.col("held_out"))))


def score_with(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The rows of score(); docs: text, doc_id, held_out (false: the text was learned from).

    What is joined has each key once, so its partitions are even and are hashed instead of sorted.
    """
    model = fitted.model
    scored = stash(score_texts(docs, model), "scored")
    rest = scored.where("row is null").select("phrase", "key", "n", "paid", "bits", "before").join(fitted.words.hint("shuffle_hash"), "key", "left")
    c, after = F.coalesce("c", F.lit(0)), F.coalesce(F.element_at(F.array(*(f"n{k}" for k in range(CLASSES))), F.col("before") + 1), F.lit(0))
    sums = rest.groupBy("phrase").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("more_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("paid") * model.final_column(F.col("bits"), c, after, F.col("before"))).alias("more_bits"),
    )
    zero = F.lit(0.0)
    each = scored.where("row is not null").join(sums.hint("shuffle_hash"), "phrase", "left").join(fitted.phrases.withColumnRenamed("c", "times").hint("shuffle_hash"), "key", "left")
    others = F.coalesce("times", F.lit(0)) - F.when(F.col("held_out"), 0).otherwise(F.col("n"))
    units = stash(each.select(
        "row", "doc_id", "held_out", "n_tokens", "n_bytes", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", zero)).alias("logs"), (F.col("bits") + F.coalesce("more_bits", zero)).alias("bits"), (others / max(fitted.n_phrases, 1)).alias("share"),
    ), "phrases")
    trust = phrase_trust(units.where(~F.col("held_out")))
    whole = F.when(F.col("share") > 0, -F.log2(trust * F.col("share") + (1 - trust) * F.pow(F.lit(2.0), -F.col("bits")))).otherwise(F.col("bits") - math.log2(1 - trust))
    texts = units.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("n_bytes").alias("n_bytes"), F.sum("logs").alias("logs"), F.sum(whole).alias("bits"),
    )
    norm = math.log10(model.total + 0.5 * (fitted.distinct + 1))
    return texts.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), (-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def look_over(training: DataFrame) -> tuple[Code, Hints]:
    """The code tree of all training texts' bytes, and the short words in most of them with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts_seen = np.zeros(256, np.int64), 0
        for batch in batches:
            for _, texts in blocks(batch, "text", BLOCK_CHARS):
                t = tokens(texts, NO_HINTS)
                counts += np.bincount(t.data, minlength=256)
                texts_seen += t.n
                short = np.flatnonzero((t.lengths <= SHORT) & (t.lengths > 0))
                words, inverse = np.unique(t.hashes[short], return_inverse=True)
                text, word, _, _ = grouped(t.text[short], inverse, np.zeros(len(short), bool))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(t.n + 1)).astype(np.int32)), pa.array(words[word].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.nulls(t.n, pa.list_(pa.int64())), lists], ["bytes", "short"])
        if texts_seen:
            counts[END] += texts_seen
            yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], ["bytes", "short"])
        release()

    seen = stash(training.select("text").mapInArrow(run, "bytes array<long>, short array<long>"), "looked")
    counts = np.zeros(256, np.int64)
    for r in seen.where("bytes is not null").select(F.posexplode("bytes").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    held = seen.where("short is not null").select("short")
    ranked = held.select(F.explode("short").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(HINTS)
    top = np.array([r["word"] for r in ranked.collect()], np.int64)
    order = np.argsort(top)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(top), len(top)), np.int64)
        for batch in batches:
            lists = batch.column(0)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            at = order[np.minimum(np.searchsorted(top, flat, sorter=order), len(top) - 1)] if len(top) else np.empty(0, np.int64)
            hit = np.flatnonzero(top[at] == flat) if len(top) else at
            stands = np.zeros((len(size), len(top)), np.float32)
            stands[np.repeat(np.arange(len(size)), size)[hit], at[hit]] = 1
            both += (stands.T @ stands).astype(np.int64)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], ["i", "j", "n"])
        release()

    together = np.zeros((len(top), len(top)))
    for r in held.mapInArrow(pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # HINTS^2 at most
        together[r["i"], r["j"]] = r["n"]
    return Code.of(counts), Hints.of(top.view(np.uint64), together)
