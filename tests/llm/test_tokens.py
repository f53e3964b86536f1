"""Packing and the lexicon transducer against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import lexicon, packing
from ledgerloom.llm.queries import tokenizer_path
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

ODD = [(900, "<|endoftext|> Straße İstanbul ＡＢＣ", *[None] * 8), (901, "naïve 'tis we'll <|startoftext|>", *[None] * 8), (902, "é combining ☃ 漢字", *[None] * 8)]


def docs(spark):
    own = edge_docs(spark)
    return own.unionByName(spark.createDataFrame(ODD, own.schema))


def all_rows():
    return edge_rows() + ODD


def test_pieces_equal_the_library(spark):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs(spark), tokenizer_path("byte_bpe_50k.json"), capacity=128).collect()
    wanted = []
    for i, text, *_ in all_rows():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        wanted += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 128) + 2


def test_packing_empty(spark):
    assert packing.pack_documents(empty_docs(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0


def one_by_one(sizes, capacity):
    """Best-two-fit, one bin after another, without multiplicities."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        free, own, gap = list(left), [], capacity
        while True:
            fits = [s for s in free if s <= gap]
            if not fits:
                break
            own.append(max(fits))
            free.remove(max(fits))
            gap -= own[-1]
        while gap:
            least = min(own)
            pairs = [(a + b, a, b) for i, a in enumerate(free) for j, b in enumerate(free) if i < j and a >= b and least < a + b <= gap + least]
            if not pairs:
                break
            _, a, b = max(pairs)
            own.remove(least)
            free.append(least)
            free.sort(reverse=True)
            free.remove(a)
            free.remove(b)
            own += [a, b]
            gap += least - a - b
        bins.append(sorted(own, reverse=True))
        left = free
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_plan_is_that_of_single_bins(sizes):
    hist = {s: sizes.count(s) for s in sizes}
    made = packing.plan_bins(hist, 20)
    assert [own for own, n in made for _ in range(n)] == one_by_one(sizes, 20)


def test_transducer():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 7))).encode() for _ in range(800)})
    t = lexicon.Transducer.build(words)
    assert t.find(words).tolist() == list(range(len(words)))
    others = [w + b"x" for w in words] + [b"zzzzzzzzzzzzzzz"]
    assert set(t.find(others).tolist()) == {-1}
    assert len(t.final) < sum(map(len, words))  # suffixes are shared
    assert lexicon.Transducer.build([]).find([b"a", b""]).tolist() == [-1, -1]


def test_lexicon_file(tmp_path):
    words = [b"", b"ab", b"abc", b"b"]
    t = lexicon.Transducer.build(words)
    (tmp_path / "x").write_bytes(lexicon.to_bytes(t, [[], [1, 2], [3], [4, 5, 6]]))
    again, starts, ids = lexicon.open_mapped(str(tmp_path / "x"))
    assert again.find(words).tolist() == [0, 1, 2, 3] and ids[starts[3] : starts[4]].tolist() == [4, 5, 6]


def test_encoding_equals_the_library(spark):
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for size in (8, 1 << 12):  # few frequent words, and all
        rows = lexicon.encode_documents(docs(spark), path, size, with_ids=True).collect()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted = []
        for i, text, *_ in all_rows():
            ids = t.encode(text or "", add_special_tokens=False).ids
            wanted.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(wanted)
        assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_encoding_empty(spark):
    assert lexicon.encode_documents(empty_docs(spark), tokenizer_path("word_bpe_49k.json")).count() == 0
