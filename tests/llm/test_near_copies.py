"""The similarity join against all pairs, and components against union-find."""

import random
import re

import pytest

from ledgerloom.llm.components import components
from ledgerloom.llm.jaccard import Spec, jaccard_join, one_of_each
from ledgerloom.llm.shingles import shingle_sets
from tests.llm.helpers import SCHEMA, edge_docs, edge_rows, empty_docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, spec):
    sets = [(i, shingles(t, spec.k)) for i, t, *_ in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if i is not None and j is not None and (i == j and x and y or (x and y and spec.den * len(x & y) >= spec.num * len(x | y))):
                up[root(a)] = root(b)
    least = {}
    for a, (i, x) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((-1 if i is None else i), len(x), -1 if i is None else least[root(a)] if x else i) for a, (i, x) in enumerate(sets))


@pytest.mark.parametrize("spec", [Spec(), Spec(4, 85, 100), Spec(2, 50, 100)])
def test_equals_all_pairs(spark, spec):
    rng = random.Random(7)
    rows = edge_rows()
    base = "b" + " ".join(str(rng.randint(0, 40)) for _ in range(80))
    for n in range(60):  # a large group of edits and a common passage
        own = base.split()
        for _ in range(n % 7):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 9)}"
        rows.append((1000 + n, " ".join(own) if n % 2 else base + " " + " ".join(str(rng.random()) for _ in range(n)), *[None] * 8))
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA), spec).documents.collect()
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows, spec)


def test_one_of_each(spark):
    docs = edge_docs(spark)
    joined = jaccard_join(docs)
    kept = one_of_each(docs, joined).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {r["component_id"] for r in joined.documents.collect() if r["component_id"] is not None}
    assert kept[0].__fields__ == docs.columns


def test_empty(spark):
    joined = jaccard_join(empty_docs(spark))
    assert joined.documents.count() == 0 and one_of_each(empty_docs(spark), joined).count() == 0


def test_sets_do_not_depend_on_neighbours():
    texts = [t or "" for _, t, *_ in edge_rows()]
    together = shingle_sets(texts, 3)
    assert all((a == shingle_sets([t], 3)[0]).all() and len(a) == len(shingles(t, 3)) for a, t in zip(together, texts, strict=True))
    long = "word " * 400_000 + "end"
    assert len(shingle_sets([long], 3)[0]) == 2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, n) for n in range(501, 560)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if root(x) == x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
