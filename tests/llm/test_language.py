"""Language ID and language-model scoring."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import langid, lm
from tests.llm.helpers import EN, FR, edge_docs, edge_rows, empty_docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_languages(spark):
    rows = langid.identify(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, *_ in edge_rows()}
    for i in range(40):
        assert by_id[i][0]["lang_pred"] == ("en" if i % 2 else "fr") or i == 3
        assert by_id[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    for i, t in texts.items():
        if i is not None and not re.search(r"[^\W\d_]", t or ""):
            assert (by_id[i][0]["lang_pred"], by_id[i][0]["score"], by_id[i][0]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_empty(spark):
    assert langid.identify(empty_docs(spark)).count() == 0
    alone = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(alone).first()["lang_pred"] == "und"


def test_ngrams_equal_a_loop():
    text = "Ça va, the 2 cats"
    (data,) = langid.pieces(text)
    own = bytes(int(x) for x in langid.KEEP[data])
    wanted = []
    m, k = 0x9E3779B1, 32 - langid.BUCKET_BITS
    for i in range(len(own) - 2):
        if own[i + 1] != 0x20:
            wanted.append((int.from_bytes(own[i : i + 3], "little") * m & 0xFFFFFFFF) >> k)
    for i in range(len(own) - 3):
        if own[i + 1] != 0x20 and own[i + 2] != 0x20:
            v = int.from_bytes(own[i : i + 4], "little")
            wanted.append((((v * m & 0xFFFFFFFF) ^ (v >> 15)) * m & 0xFFFFFFFF) >> k)
    assert sorted(langid.ngrams(data).tolist()) == sorted(wanted)


def test_scores(spark):
    rows = lm.score(edge_docs(spark)).collect()
    docs = edge_rows()
    assert len(rows) == len(docs)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for _, t, *_ in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in docs]
    c = Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    norm = math.log10(n + 0.5 * (v + 1))
    wanted = sorted(
        ((-1 if d[0] is None else d[0]), len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(sum(math.log10(c[x] + 0.5) for x in w) + math.log10(ends + 0.5) - (len(w) + 1) * norm, 6)) for d, w in zip(docs, words, strict=True)
    )
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)
    assert got == wanted and {r["train_tokens"] for r in rows} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    for kind in (True, False):  # equal texts, and the same words in capitals
        assert len({round(r["score"], 6) for r in rows if r["doc_id"] in (0, 52, 53) and r["held_out"] == kind}) <= 1


def story(n):
    rng = np.random.default_rng(3)
    parts = ["walk", "talk", "stalk", "jump", "paint", "ing", "ed", "er", "the", "of", "le", "de", "été"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(1, 90))) for _ in range(n)]
    return [*texts, texts[0], texts[1], "", None, "x " * 300, "a b c d " * 40, "w" * 9000 + " z", "Walk WALK walk\n\twalk"]


def by_loops(fitted, rows):
    """Bits of each text, decision by decision; rows: (text, held_out)."""
    m = fitted.model
    mixed = lambda x: int(lm.mix(np.array([x % 2**64], np.uint64))[0])
    hashes = {}

    def hash_of(w):
        if w not in hashes:
            hashes[w] = int(lm.word_hashes(np.frombuffer(w + b" ", np.uint8))[1][0]) if w else int(lm.END_HASH)
        return hashes[w]

    def letters(word, before):
        total = 0.0
        for cut in range(0, max(len(word), 1), lm.PIECE_BYTES):
            piece = word[cut : cut + lm.PIECE_BYTES]
            run = 0
            symbols = [*piece, lm.SPACE] if piece else [lm.END]
            for at, symbol in enumerate(symbols):
                b1, b2, b3, b4 = (symbols[at - k] if at >= k else lm.SPACE for k in (1, 2, 3, 4))
                three = b1 | b2 << 8 | b3 << 16
                prefix = mixed(run + at)
                contexts = [mixed(b1 | before << 24), mixed(three | before << 24), mixed((three | b4 << 24) + (1 << 33)), mixed(prefix + before + 7)]
                code = m.letters.code
                for i in range(code.starts[symbol], code.starts[symbol] + code.lengths[symbol]):
                    node, bit = int(code.nodes[i]), int(code.bits[i])
                    slots = [((c + node * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95 % 2**64 >> 64 - b) + int(s) for c, b, s in zip(contexts, lm.BITS, lm.STARTS, strict=False)]
                    few = lambda n: 0 if n == 0 else 1 if n < 3 else 2 if n < 20 else 3
                    gate = (min(at, 3) * 4 + few(m.letters.seen[slots[3]])) * 4 + few(m.letters.seen[slots[1]])
                    st = [float(m.letters.st[s]) for s in slots] + [0.3]
                    out = max(-8.0, min(8.0, sum(float(m.letters.weights[k, gate]) * x for k, x in enumerate(st))))
                    spot = (out + 8) * 2
                    low = min(int(spot), 31)
                    line = m.letters.map[b1 * 33 : b1 * 33 + 33]
                    logit = 0.5 * out + 0.5 * (line[low] * (1 - spot + low) + line[low + 1] * (spot - low))
                    total += math.log2(1 + math.exp(-logit if bit else logit))
                run += mixed((symbol + 1) * 0x9E3779B97F4A7C15 + at * 0xC2B2AE3D27D4EB4F)
        return total

    split = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))] + [b""]
    classes = dict(zip(m.hints.words.tolist(), m.hints.classes.tolist(), strict=True))

    def units(words):
        own = []
        for w in words:
            own.append(w)
            if not w or mixed(hash_of(w)) % lm.PHRASE == 0:
                yield tuple(own)
                own = []

    def befores(words):
        now = 0
        for w in words:
            yield now
            now = (classes.get(hash_of(w), 0) if 0 < len(w) <= lm.SHORT else 0) or now

    known, after, many = Counter(), Counter(), Counter()
    for t, held in rows:
        if not held:
            words = split(t)
            known.update(words)
            after.update(zip(befores(words), words, strict=True))
            many.update(units(words))
    total, n_units = sum(known.values()), sum(many.values())
    assert m.total == total and fitted.n_phrases == n_units and fitted.distinct == len(known)
    assert m.by_class.tolist() == [sum(n for (k, _), n in after.items() if k == c) for c in range(lm.CLASSES)]

    def step(n):
        return 0 if n == 0 else 1 if n == 1 else 2 if n < 4 else 3

    memo, out = {}, []
    for t, held in rows:
        words, costs, seen, last_outcome = split(t), [], {}, 0
        for i, (w, k) in enumerate(zip(words, befores(words), strict=True)):
            if (w, k) not in memo:
                n, c = after[k, w], known[w]
                share = m.trust[k, 1] * c / total + m.trust[k, 2] * n / max(m.by_class[k], 1)
                memo[w, k] = -np.logaddexp2(math.log2(m.trust[k, 0]) - letters(w, k), math.log2(share) if share else -math.inf)
            cost, outcome = memo[w, k], 0
            near, far = ("near", words[i - 1] if i else None), ("far", words[i - 1] if i else None, words[i - 2] if i > 1 else None)
            if near in seen:
                a, b = seen[near], seen.get(far)
                said = (b or a)[0]
                q1, q2 = 1 + step(a[1]) * 4 + step(a[2]), 1 + step(b[1]) * 4 + step(b[2]) if b else 0
                logit = m.outcomes[((q2 * lm.STATES + q1) * 2 + (a[0] == said)) * lm.LAST + last_outcome]
                outcome = 1 + (said == w)
                cost = math.log2(1 + math.exp(-logit)) if said == w else cost + math.log2(1 + math.exp(logit))
            for context in (near, far):
                own = seen.get(context)
                seen[context] = [w, own[1] + (own[0] == w), own[2] + (own[0] != w)] if own else [w, 0, 0]
            last_outcome = outcome
            costs.append(cost)
        own, at, told = Counter(units(words)), 0, []
        for u in units(words):
            told.append((sum(costs[at : at + len(u)]), (many[u] - (0 if held else own[u])) / n_units))
            at += len(u)
        out.append(told)
    hist = Counter(round((math.log2(s) + b) / 0.5) if s > 0 else None for (_, held), told in zip(rows, out, strict=True) if not held for b, s in told)
    trust = 0.5
    for _ in range(20):
        odds = {g: 0.0 if g is None else 2 ** min(g * 0.5, 1000.0) for g in hist}
        trust = (sum(n * trust * odds[g] / (trust * odds[g] + 1 - trust) for g, n in hist.items()) + 0.1) / (sum(hist.values()) + 1)
    return [sum(-math.log2(trust * s + (1 - trust) * 2.0**-b) if s > 0 else b - math.log2(1 - trust) for b, s in told) for told in out]


def test_scores_equal_loops(spark, monkeypatch):
    """Every decision of every text, by dictionaries and plain numbers; with and without broadcast words."""
    monkeypatch.setattr(lm, "COMMON", 15)
    texts = story(40)
    docs = lm.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    fitted = lm.fit(docs.where("not held_out"))
    got = {r["doc_id"]: r for r in lm.score_with(docs, fitted).collect()}
    rows = [(t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t in enumerate(texts)]
    assert {got[i]["held_out"] for i in got} == {True, False}
    for i, bits in enumerate(by_loops(fitted, rows)):
        assert math.isclose(got[i]["score"], -bits * math.log10(2), rel_tol=1e-3, abs_tol=0.01), (i, texts[i])


def test_letter_tables_count_every_occurrence(spark):
    """Each bit of each token of the training texts is in the tables, by plain dictionaries."""
    rows = [(i, t) for i, t in enumerate(story(30))]
    texts = [t for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    code, hints = lm.look_over(docs)
    words = lm.count_training(docs, hints).where(f"kind = {lm.WORD}")
    wanted = np.zeros((2, lm.SLOTS, 2), np.int64)
    t = lm.tokens([x or "" for x in texts], hints)
    half = (lm.mix(t.hashes) & np.uint64(1)).astype(int)
    for i in range(len(t.hashes)):  # token by token
        _, start, size = lm.pieces(t.starts[i : i + 1], t.lengths[i : i + 1])
        d = lm.decisions(code, t.data, start, size, np.repeat(t.before[i], len(start)))
        for slots, first in zip(d.slots, lm.STARTS, strict=False):
            np.add.at(wanted[half[i]], (slots + first, d.bit), 1)
    got = np.zeros((2, lm.SLOTS, 2), np.int64)
    per_half = lm.SLOTS // lm.CHUNK
    for r in lm.letter_counts(words, code).collect():
        at = r["key"] % per_half * lm.CHUNK
        got[r["key"] // per_half, at : at + lm.CHUNK] += lm.parted(r["blob"])[1].reshape(-1, 2)
    assert wanted.max() > 100 and (got == wanted).all()


def test_shared_letters_are_worked_out_once(monkeypatch):
    """Words of a class with the same first letters are priced and counted as each alone is, with few of their decisions."""
    rng = np.random.default_rng(4)
    code = lm.Code.of(rng.integers(0, 99, 256))
    letters = lm.Letters(code, rng.normal(0, 1, lm.SLOTS).astype(np.float16), rng.integers(0, 40, lm.SLOTS).astype(np.uint8))
    words = [f"understand{a}{b}" for a in "abcdefgh" for b in ("", "s", "ing", "ingly-and-more", "\0", "\0\0")] + ["un", "é", "u", "w" * 9000, "w" * 4096]
    t = lm.tokens([" ".join(words)], lm.NO_HINTS)
    starts, lengths = np.tile(t.starts, 2), np.tile(t.lengths, 2)
    before, n = np.repeat([0, 3], len(t.starts)), rng.integers(1, 4, 2 * len(t.starts))
    made, plain = [], lm.decisions
    alone = [letters.costs(t.data, starts[i : i + 1], lengths[i : i + 1], before[i : i + 1])[0] for i in range(len(starts))]
    wanted, own = np.zeros((lm.SLOTS, 2), np.int64), lm.BitCounts()
    pairs = np.zeros(lm.SLOTS, np.int64)
    for i in range(len(starts)):
        _, start, size = lm.pieces(starts[i : i + 1], lengths[i : i + 1])
        d = plain(code, t.data, start, size, np.repeat(before[i], len(start)))
        for slots, first in zip(d.slots, lm.STARTS, strict=False):
            np.add.at(wanted, (slots + first, d.bit), n[i])
            np.add.at(pairs, slots + first, 1)
    monkeypatch.setattr(lm, "decisions", lambda *a: made.append(plain(*a)) or made[-1])
    short = np.flatnonzero(lengths < 100)
    every = len(plain(code, t.data, starts[short], lengths[short], before[short]).bit)
    assert letters.costs(t.data, starts[short], lengths[short], before[short]).tolist() == [alone[i] for i in short]
    assert sum(len(d.bit) for d in made) < every / 2
    assert letters.costs(t.data, starts, lengths, before).tolist() == alone
    lm.Pairs(t.data, starts, lengths, before, np.zeros(len(n), np.int64), n, n).count(np.arange(len(n)), code, own)
    own.flush()
    assert (own.table.reshape(-1, 2) == wanted).all() and (own.pairs == pairs).all()


def test_bit_counts_beyond_four_bytes():
    """A bit that stands more than 2^32 times is counted whole, and so are those beside it."""
    own, n = lm.BitCounts(), np.array([3_000_000_000, 2])
    d = lm.Decisions(np.array([0, 2]), np.array([1, 0, 1], np.uint8), [np.array([5, 9, 5], np.int32)] * len(lm.BITS), np.zeros(3, np.int32), np.zeros(3, np.int32))
    for _ in range(3):
        own.add(d, n)
        own.add(d)
        own.flush()
    (chunk, blob), *_ = own.blobs()
    pairs, first = lm.parted(blob)
    first = first.reshape(-1, 2)
    assert chunk == 0 and pairs[[0, 5, 9]].tolist() == [0, 12, 6] and first[5].tolist() == [0, 9_000_000_012] and first[9].tolist() == [9_000_000_003, 0]


def test_blocks_of_training_texts_are_bounded(monkeypatch):
    """No block of texts holds more than BLOCK_CHARS characters, however large the batches; no text is lost or moved."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 1000)
    texts = [str(i) * (i % 90) for i in range(900)] + ["x" * 5000, None, "y"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 300], pa.string())], ["text"]) for a in range(0, len(texts), 300)]
    held = list(lm.gathered(iter(batches)))
    assert [t for own in held for t in own] == [t or "" for t in texts]
    assert all(len(own) == 1 or sum(map(len, own)) <= 1000 for own in held) and len(held) < 200


def test_trust_equals_plain_expectation_steps():
    rng = np.random.default_rng(2)
    before, word, pair, n = rng.integers(0, 2, 50), rng.integers(-20, 20, 50), np.where(rng.random(50) < 0.3, lm.NEVER, rng.integers(-20, 20, 50)), rng.integers(1, 9, 50)
    got = lm.fit_trust(before, word, pair, n)
    for k in (0, 1):
        own = [1 / 3, 1 / 3, 1 / 3]
        for _ in range(20):
            sums = [0.2, 0.1, 0.1]
            for i in np.flatnonzero(before == k):
                parts = [own[0], own[1] * 2 ** (word[i] * 0.5), own[2] * (0 if pair[i] == lm.NEVER else 2 ** (pair[i] * 0.5))]
                for j in range(3):
                    sums[j] += n[i] * parts[j] / sum(parts)
            own = [x / sum(sums) for x in sums]
        assert np.allclose(got[k], own)


def test_scores_do_not_hang_on_the_broadcast_words(spark, monkeypatch):
    """Every trained word's count enters the score, whether it is among the COMMON words or joined."""
    texts = [f"{EN} {FR} rare{i} words{i} stand{i // 3} here {'again ' * (i % 5)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every = {r["doc_id"]: r for r in lm.score(docs).collect()}
    for common in (0, 20):
        monkeypatch.setattr(lm, "COMMON", common)
        for r in lm.score(docs).collect():
            own = every[r["doc_id"]]
            assert r["n_known"] == own["n_known"] and math.isclose(r["base_score"], own["base_score"], rel_tol=1e-9)
            assert math.isclose(r["score"], own["score"], rel_tol=1e-6) and math.isclose(r["bits_per_byte"], own["bits_per_byte"], rel_tol=1e-6)


def test_all_training_texts_are_learned_from(spark):
    """However few the documents, each enters the bit counts: unseen words of known parts cost less than turned round."""
    parts = ["walk", "talk", "stalk", "jump", "paint", "print", "form", "light", "sound", "count"], ["ing", "ings", "ed", "er", "ers", "able", "ingly"]
    known = [a + b for i, a in enumerate(parts[0]) for k, b in enumerate(parts[1]) if (i + k) % 3]
    unseen = [a + b for i, a in enumerate(parts[0]) for k, b in enumerate(parts[1]) if not (i + k) % 3]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    rows = [(i, " ".join(known[i % 7 :] + known[: i % 7])) for i in free] + [(held[0], " ".join(unseen)), (held[1], " ".join(w[::-1] for w in unseen))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] < 0.6 * got[held[1]]


def test_texts_that_stand_twice_cost_less(spark):
    """A copy of another document is told from one that stands alone, in training and held out."""
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(10)]
    got = {r["doc_id"]: (r["held_out"], r["bits_per_byte"]) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = min(got[i][1] for i in range(10, 80))
    learned = [i for i in range(10) if not got[i][0] or not got[1000 + i][0]]
    seen_elsewhere = [x for i in learned for x, y in ((i, 1000 + i), (1000 + i, i)) if not got[y][0]]
    assert seen_elsewhere and all(got[x][1] < 0.3 * alone for x in seen_elsewhere)


def test_score_empty(spark):
    assert lm.score(empty_docs(spark)).count() == 0


def test_costs_are_a_probability():
    """Over all words of one letter the costs of word and space sum to no more than 1, whatever the tables."""
    rng = np.random.default_rng(1)
    code = lm.Code.of(rng.integers(0, 99, 256))
    letters = lm.Letters(code, rng.normal(0, 1, lm.SLOTS).astype(np.float16), np.ones(lm.SLOTS, np.uint8))
    t = lm.tokens([chr(b) for b in range(33, 127) if not 65 <= b <= 90], lm.NO_HINTS)
    words = np.flatnonzero(t.lengths)
    assert np.exp2(-letters.costs(t.data, t.starts[words], t.lengths[words], t.before[words])).sum() < 1
    starts = np.repeat(code.starts, code.lengths)
    assert len(starts) == len(code.bits) and sum(2.0 ** -int(n) for n in code.lengths) == 1.0


def test_words_like_a_pattern():
    t = lm.tokens([EN, "", "  A b\tC ", FR + "\n" + "é" * 9], lm.NO_HINTS)
    own = [[t.data[s : s + n].tobytes().decode() for s, n in zip(t.starts[t.text == i], t.lengths[t.text == i], strict=True) if n] for i in range(4)]
    assert (t.lengths == 0).sum() == 4
    assert own == [EN.split(), [], ["a", "b", "c"], [*FR.split(), "é" * 9]]
