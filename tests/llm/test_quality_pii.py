"""The native operators: quality counts against a loop, pseudonyms against a plain-Python Feistel network."""

import datetime
import hashlib
import math
import re
from collections import Counter

from ledgerloom.llm import pii, quality
from tests.llm.helpers import SCHEMA, edge_docs, edge_rows, empty_docs


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + k for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c a b c", "x x x x", "a b\n\na b\na b\n \n", "#*$ %&|<>## one\ntwo\ntwo", "p q r s p q r t p q", "é ü é ü é ü"]


def test_base_counts(spark):
    rows = edge_rows() + [(2000 + i, t, *[None] * 8) for i, t in enumerate(REPEATS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    wanted = []
    for i, t, *_ in rows:
        n = counts(t)
        wanted.append((-1 if i is None else i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted((-1 if r[0] is None else r[0], *r[1:7]) for r in got) == sorted(wanted)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_log_ratio_equals_a_loop(spark):
    rows = [(i, t, *r) for i, t, *r in edge_rows() if i is not None]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    tables = {r["t_half"]: r["t_ratio"] for r in model.tables.collect()}
    from pyspark.sql import functions as F

    grams = quality.hashed(docs).select("row.doc_id", quality.fold(F.col("text")).alias("h"), quality.buckets(F.col("hashes")).alias("g")).collect()
    trusted = set(range(0, 30, 2))
    for half in (0, 1):
        raw, target = Counter(), Counter()
        for r in grams:
            if r["h"] != half:
                raw.update(r["g"])
                if r["doc_id"] in trusted:
                    target.update(r["g"])
        all_t, all_r, b = sum(target.values()), sum(raw.values()), quality.BUCKETS
        table = [math.log((target[i] * (all_r + b) / (raw[i] + 1) + b) / (all_t + b)) for i in range(b)]
        assert all(abs(x - y) < 1.1e-5 for x, y in zip(table, tables[half], strict=True))
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["llr"] for r in quality.judge(docs, model).collect()}
    texts = [(r["doc_id"], r["h"], tuple(r["g"])) for r in grams]
    means = sorted(round(sum(tables[h][b] for b in g) / len(g), 4) if g else 0.0 for _, h, g in set(texts))
    assert all(abs(a - b) < 2e-4 for a, b in zip(means, sorted(got.values()), strict=True))


def test_equal_texts_score_alike(spark):
    """Copies under other ids are judged by the same counts."""
    rows = [(i + 5000 * k, t) for i, t, *_ in edge_rows() if i is not None for k in (0, 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int")
    judged = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    by_text = {}
    for r in judged.select("row.text", "llr", "kept").collect():
        by_text.setdefault(r["text"], set()).add((r["llr"], r["kept"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_quality_without_target_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(edge_docs(spark), none).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["llr"] == 0 for r in got)
    assert quality.quality(empty_docs(spark), none).where("kept").count() == 0


# ------------------------------------------------------------------ pseudonyms
KEY = "test key"


def feistel(values, radices, kind, key=KEY):
    a = list(values)
    h = len(a) // 2
    for r in range(pii.ROUNDS):
        first = r % 2 == 0
        other = ",".join(str(v) for i, v in enumerate(a) if (i < h) != first)
        base = f"{key}:{kind}:{r}:{len(a)}:{other}"
        a = [(v + int(hashlib.sha256(f"{base}#{i}".encode()).hexdigest()[:14], 16)) % radices[i] if (i < h) == first else v for i, v in enumerate(a)]
    return a


def rewritten(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in pii.pseudonyms(docs, KEY).orderBy("row.doc_id").collect()]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def test_kinds(spark):
    texts = ["4111 1111 1111 1111", "pay 4111111111111111 now", "4111111111111112", "1987-03-04", "31/12/1999", "03/04/2001", "30.02.1950", "192.168.1.77", "256.1.1.1", "a.b9@host.example.com", "A.B9@host.example.com", "+1 (521) 555-6210",
             "123-45-6789", "000-45-6789", "GB82WEST12345698765432", "GB82WEST12345698765433", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "x1 2 3@ @y", "29/02/2000", None, ""]
    got = [r["text"] for r in rewritten(spark, texts)]
    same = [2, 6, 8, 13, 15, 17, 19, 20]
    assert [i for i, (a, b) in enumerate(zip(texts, got, strict=True)) if a == b] == same
    assert all(len(a or "") == len(b or "") for a, b in zip(texts, got, strict=True))
    digits = feistel([int(c) for c in "411111111111111"], [10] * 15, "card")
    card = "".join(map(str, digits))
    card += str((10 - luhn(card + "0")) % 10)
    assert luhn(card) == 0 and got[0].replace(" ", "") == card and got[1] == f"pay {card} now"
    year, low = feistel([87, 2 * 12 + 3], [200, 144], "date:early")
    assert got[3] == str(datetime.date(1900 + year, low // 12 + 1, low % 12 + 1))
    assert int(got[4][:2]) > 12 and datetime.datetime.strptime(got[4], "%d/%m/%Y") and datetime.datetime.strptime(got[5], "%m/%d/%Y")
    least, many = (lambda o: 0 if o < 10 else 10 if o < 100 else 100), (lambda o: 10 if o < 10 else 90 if o < 100 else 156)
    own = [192, 168, 1, 77]
    assert got[7] == ".".join(str(least(o) + v) for o, v in zip(own, feistel([o - least(o) for o in own], [many(o) for o in own], "ip"), strict=True))
    assert got[9].lower() == got[10].lower() and got[10][0].isupper() and got[9].endswith("@host.example.com")
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got[11]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[12])
    moved = got[14][4:] + got[14][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and got[14][:2] == "GB"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[16]) and datetime.datetime.strptime(got[18], "%d/%m/%Y")


def moved_day(d):
    """The day that another day becomes, by plain numbers."""
    ends = [(m, n) for n in (29, 30, 31) for m in range(1, 13) if n <= (28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31)]
    if (d.month, d.day) == (2, 29):
        a, b = feistel(divmod((d.year - 1904) // 4, 7), [7, 7], "date:leap")
        return datetime.date(1904 + 4 * (a * 7 + b), 2, 29)
    if d.day > 28:
        year, at = feistel([d.year - 1900, ends.index((d.month, d.day))], [200, 29], "date:late")
        return datetime.date(1900 + year, *ends[at])
    first, wide, kind = (1, 12, "date:early") if d.day <= 12 else (13, 16, "date:middle")
    year, at = feistel([d.year - 1900, (d.month - 1) * wide + d.day - first], [200, 12 * wide], kind)
    return datetime.date(1900 + year, at // wide + 1, at % wide + first)


def test_all_spellings_of_a_day_stay_linked(spark):
    days = [datetime.date(1999, 12, 31), datetime.date(2000, 2, 29), datetime.date(1904, 2, 29), datetime.date(1987, 3, 4), datetime.date(2024, 7, 13), datetime.date(1900, 1, 1), datetime.date(2099, 12, 28), datetime.date(1950, 6, 30), datetime.date(2010, 1, 29)]
    styles = ["%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", "%d/%m/%Y"]
    got = rewritten(spark, [d.strftime(s) for d in days for s in styles if s != "%d/%m/%Y" or d.day > 12])
    wanted = [moved_day(d).strftime(s) for d in days for s in styles if s != "%d/%m/%Y" or d.day > 12]
    assert [r["text"] for r in got] == wanted


def test_days_are_permuted():
    every = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73049)]
    some = [d for d in every if (d.month, d.day) == (2, 29) or d.year in (1900, 1950)]
    moved = [moved_day(d) for d in some]
    assert len(set(moved)) == len(some) and all((a.day > 12) == (b.day > 12) for a, b in zip(some, moved, strict=True))


def respelled(values, alphabets, kind):
    spots = [i for i, a in enumerate(alphabets) if len(a) > 1]
    new = feistel([alphabets[i].index(values[i]) for i in spots], [len(alphabets[i]) for i in spots], kind)
    out = list(values)
    for i, v in zip(spots, new, strict=True):
        out[i] = alphabets[i][v]
    return "".join(out)


def plain(c):
    return next((a for a in (pii.DIGITS, pii.LOWER, pii.UPPER) if c in a), c)


def test_other_kinds_equal_loops(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = ["a.b9@host.example.com", token, token.upper(), "GB82WEST12345698765432", "123-45-6789", "777-01-0001", "+1 (521) 555-6210", "+49 1512 3456789", "(212) 555-0100"]
    got = [r["text"] for r in rewritten(spark, texts)]
    assert got[0] == respelled("a.b9", [plain(c) for c in "a.b9"], "email") + "@host.example.com"
    low = respelled(token, [pii.HEX] * len(token), "secret")
    assert got[1:3] == [low, low.upper()]
    body = respelled("WEST12345698765432", [plain(c) for c in "WEST12345698765432"], "iban")
    check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
    assert got[3] == f"GB{check:02d}{body}"
    for text, new in zip(texts[4:6], got[4:6], strict=True):
        area, group, serial = map(int, text.split("-"))
        a, g, s = feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
        a += 1 + (a + 1 >= 666)
        assert new == f"{a:03d}-{g + 1:02d}-{s + 1:04d}"
    for text, new in zip(texts[6:], got[6:], strict=True):
        digits = sum(c.isdigit() for c in text)
        american, seen, own = digits == 10 or text.startswith("+1"), 0, []
        for c in text:
            if not c.isdigit():
                own.append(c)
                continue
            after = digits - seen - 1
            seen += 1
            if text[0] == "+" and after >= (10 if american else 7):
                own.append(c)
            elif american and after in (9, 6):
                own.append("23456789" if c >= "2" else "01")
            else:
                own.append(pii.DIGITS)
        assert new == respelled(text, own, "phone")


def test_the_key_is_derived_and_kept_out_of_plans(spark):
    spark.conf.set(pii.KEY_SETTING, "the deployment's own")
    try:
        key = pii.session_key(spark)
        docs = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
        plan = pii.pseudonyms(docs, key)._jdf.queryExecution().toString()
        assert "the deployment's own" not in plan and key not in plan and key != pii.derived(pii.TEST_KEY)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_permutation_is_one_to_one(spark):
    texts = [f"10.0.{i}.{j}" for i in range(10) for j in range(10, 60)]
    got = [r["text"] for r in rewritten(spark, texts)]
    assert len(set(got)) == len(texts)


def test_links_across_documents_and_edges(spark):
    got = rewritten(spark, ["a 10.1.2.3 b 10.1.2.3", "10.1.2.3\n4111111111111111"])
    first = got[0]["text"].split()
    assert first[1] == first[3] == got[1]["text"].split("\n")[0] and got[1]["kinds"] == ["ip", "card"]
    done = pii.pseudonyms(edge_docs(spark), KEY)
    assert done.count() == len(edge_rows()) and pii.pseudonyms(empty_docs(spark), KEY).count() == 0
    assert all(r["text"] == r["row"]["text"] for r in done.collect())
