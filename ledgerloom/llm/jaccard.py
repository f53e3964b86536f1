"""Similarity join of documents on the Jaccard similarity of their word-shingle sets, with adaptive multi-match prefixes.

1. Documents with equal sets are one class, represented by its least id; only representatives go on.
2. Tokens (shingles) have one global order: cold ones by hash, then those counted as frequent, rarest first. The counts
   only shape the order; any order gives the same links.
3. A document of n tokens needs n - ceil(t*n) + l of them in its prefix so that a linked partner shares l: the prefix
   is lengthened (l grows) where the estimated cost of its candidates is lower, and then that many shared prefix tokens
   are required. A pair asks for the smaller l of the two, and uses only the part of either prefix that its own sizes
   allow (an overlap of a tokens leaves n - a + l places).
4. First every document is verified against one leader, the partner that shares most prefix tokens with it among those
   that stand first in a posting list; so large groups of near copies fall into components with a link a document.
   Then all pairs of documents in different components that share enough prefix tokens are verified. Tokens whose
   posting list lies within one component are left out. Pairs within a component need no further link, so no
   component is missed, and no list of a group's pairs is made.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null texts and texts without words have an empty
set and link with nothing; fewer than k words are one shingle. Rows that share a doc_id are versions of one document
and as such linked; each row is returned. A null doc_id links with nothing and has a null component.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import blocks, checked_broadcast, most_frequent, release, stash, tidy
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import set_key, shingle_sets

#: Least document count of a token that is ordered as frequent, and how many of these are broadcast at most.
HOT_COUNT, HOT_TOKENS = 3, 1 << 18
#: Tokens among which a task counts recurring ones at once.
COUNT_TOKENS = 2_000_000
#: Longest lengthening of a prefix; cost of a posting entry and of a verification.
MAX_MATCHES, ENTRY_COST, VERIFY_COST = 16, 1.0, 200.0


#: Bits of the bitmaps that are compared before texts are.
SKETCH_BITS = 4096


@dataclass(frozen=True)
class Spec:
    """k words a shingle; two sets link when den * |intersection| >= num * |union|."""

    k: int = 5
    num: int = 80
    den: int = 100

    def least_overlap(self, n: int) -> int:
        return -(-self.num * n // self.den)


# ------------------------------------------------------------------ pass 1: sets and frequent tokens
def signatures(docs: DataFrame, spec: Spec) -> DataFrame:
    """Rows of documents (doc_id, n, key) and, with null key, tokens that recur among some COUNT_TOKENS of a task (token, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "key", "token", "count"]
        held, size = [], 0

        def recurring() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1].view(np.int64), counts[counts > 1]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(tokens), pa.binary()), pa.array(tokens), pa.array(counts, pa.int64())], names)

        for batch in batches:
            for part, texts in blocks(batch, "text", 1_000_000):
                sets = shingle_sets(texts, spec.k)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(set_key, sets), pa.binary()), none, none], names)
                held += sets
                size += sum(map(len, sets))
                if size > COUNT_TOKENS:
                    yield recurring()
                    held, size = [], 0
        if held:
            yield recurring()
        held = []
        release()

    return docs.mapInArrow(run, "doc_id long, n long, key binary, token long, count long")


def frequent(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens (as unsigned numbers) and counts of the most frequent ones: HOT_TOKENS at most."""
    sums = signed.where("key is null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= HOT_COUNT)
    top = most_frequent(stash(sums, "frequent"), "count", HOT_TOKENS).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


# ------------------------------------------------------------------ pass 2: prefixes
def prefix(tokens: np.ndarray, hot: np.ndarray, counts: np.ndarray, spec: Spec) -> tuple[int, np.ndarray]:
    """(l, prefix) of a sorted token set: the l of least estimated cost."""
    n = len(tokens)
    known = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        found = hot[at] == tokens
        known[found] = counts[at[found]]
    order = np.argsort(known, kind="stable")
    need = spec.least_overlap(n)
    most = max(1, min(MAX_MATCHES, need))
    entries = np.cumsum(np.maximum(known[order], 1))
    sizes = n - need + np.arange(1, most + 1)
    read = entries[sizes - 1]
    cost = read * ENTRY_COST + (read - sizes) / np.arange(1, most + 1) * VERIFY_COST
    best = int(np.argmin(cost))
    return best + 1, tokens[order[: sizes[best]]]


def prefixes(docs: DataFrame, shared: Broadcast, spec: Spec) -> DataFrame:
    """doc_id, n, l, prefix of every document with a token; shared: the frequent tokens and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text", 1_000_000):
                sets = shingle_sets(texts, spec.k)
                some = [i for i, s in enumerate(sets) if len(s)]
                own = [prefix(sets[i], *shared.value, spec) for i in some]
                flat = np.concatenate([p for _, p in own]).view(np.int64) if own else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for _, p in own)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([x for x, _ in own], pa.int32()), lists], ["doc_id", "n", "l", "prefix"])
        release()

    return docs.mapInArrow(run, "doc_id long, n long, l int, prefix array<long>")


# ------------------------------------------------------------------ candidates
def overlap(n: Column, m: Column, spec: Spec) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    return F.ceil((n + m) * F.lit(spec.num) / F.lit(float(spec.num + spec.den)) - F.lit(1e-9))


def sizes_fit(n: Column, m: Column, spec: Spec) -> Column:
    return F.greatest(n, m) * spec.num <= F.least(n, m) * spec.den


def smallest_partner(spec: Spec) -> Column:
    """The least size of a set that links with one of size n."""
    return F.ceil(F.col("n") * spec.num / float(spec.den) - F.lit(1e-9))


def tightened(rows: DataFrame, spec: Spec) -> DataFrame:
    """Leave out posting entries that no linked pair needs; rows: token, i, node, n, l (and more).

    Of the tokens up to place i of a prefix only those that still stand in another list entry can be matched, so
    i + 1 less their number (column miss) are not; a partner of the list's least size bears n - overlap of these.
    """
    by_token = Window.partitionBy("token")
    listed = rows.withColumns({"least_n": F.min("n").over(by_token), "entries": F.count("*").over(by_token)}).where("entries > 1")
    counted = listed.withColumn("miss", F.col("i") + 1 - F.row_number().over(Window.partitionBy("node").orderBy("i", "token")))
    smallest = F.greatest(F.col("least_n"), smallest_partner(spec))
    return counted.where(F.col("miss") <= F.col("n") - overlap(F.col("n"), smallest, spec)).drop("least_n", "entries")


def postings(prefixed: DataFrame, representatives: DataFrame, spec: Spec) -> DataFrame:
    """token, i, node, n, l of tokens that two representatives or more have in their prefixes."""
    own = prefixed.join(representatives.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    rows = own.select(F.col("doc_id").alias("node"), "n", "l", F.posexplode("prefix").alias("i", "token"))
    return tightened(rows, spec).drop("miss")


def leader_pairs(shared: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): each document with the leader that shares most prefix tokens with it: half its shortest prefix at least.

    A list's leader is the document in whose order the token stands first. These links only save work later on.
    """
    led = shared.withColumn("lead", F.min(F.struct("i", "node", "n")).over(Window.partitionBy("token")))
    rows = led.where("lead.node != node").where(sizes_fit(F.col("n"), F.col("lead.n"), spec))
    counts = rows.groupBy("node", F.col("lead.node").alias("leader")).agg(F.count("*").alias("c"), F.min("n").alias("n"))
    enough = counts.where(2 * F.col("c") >= F.col("n") - F.ceil(F.col("n") * spec.num / float(spec.den) - F.lit(1e-9)) + 1)
    return enough.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("a")).select("a", F.col("node").alias("b"))


def open_pairs(shared: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """(a, b) in different components that share the required number of usable prefix tokens.

    The first token that a linked pair shares stands among the first n - overlap + 1 of either: pairs are met there, and
    then asked for the l shared tokens of their lengthened prefixes.
    """
    labelled = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_token = Window.partitionBy("token")
    mixed = labelled.withColumns({"low": F.min("component").over(by_token), "high": F.max("component").over(by_token)}).where("low != high").drop("low", "high")
    rows, members = alike(stash(tightened(mixed, spec), "open"))
    lists = stash(rows.groupBy("node", "n", "l").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("own")), "lists")
    least = F.min("n").over(by_token)
    front = rows.withColumn("least_n", least).where(F.col("i") <= F.col("n") - overlap(F.col("n"), F.greatest(F.col("least_n"), smallest_partner(spec)), spec))
    left, right = (front.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("i", "miss", "node", "n", "component"))) for s in "ab")
    c = F.col
    need = overlap(c("n_a"), c("n_b"), spec)
    borne = (c("miss_a") <= c("n_a") - need) & (c("miss_b") <= c("n_b") - need) & (c("i_a") <= c("n_a") - need) & (c("i_b") <= c("n_b") - need)
    on = (c("node_a") < c("node_b")) & (c("component_a") != c("component_b")) & sizes_fit(c("n_a"), c("n_b"), spec) & borne
    near = left.join(right, "token").where(on).select(c("node_a").alias("a"), c("node_b").alias("b")).distinct()
    list_of = lambda s: lists.select(c("node").alias(s), *(c(x).alias(f"{x}_{s}") for x in ("n", "l", "own")))
    matches = F.least("l_a", "l_b")
    window = lambda s: F.transform(F.filter(f"own_{s}", lambda x: x["i"] < c(f"n_{s}") - need + matches), lambda x: x["token"])
    found = near.join(list_of("a"), "a").join(list_of("b"), "b").where(F.size(F.array_intersect(window("a"), window("b"))) >= matches).select("a", "b")
    as_a, as_b = members.select(F.col("of").alias("a"), F.col("node").alias("x")), members.select(F.col("of").alias("b"), F.col("node").alias("y"))
    return found.join(as_a, "a").join(as_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def alike(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of one document of each kind, members (node, of)): documents of a component with equal entries are of a kind.

    Whether two documents share enough depends on nothing but their entries, so one of a kind stands for all. Most near
    copies of a text differ behind the places used and are of few kinds.
    """
    own = F.xxhash64(F.sort_array(F.collect_list(F.struct("i", "token"))))
    kinds = rows.groupBy("node", "n", "l", "component").agg(own.alias("entries"))
    first = kinds.groupBy("component", "n", "l", "entries").agg(F.min("node").alias("of"))
    members = stash(kinds.join(first, ["component", "n", "l", "entries"]).select("node", "of"), "kinds")
    return rows.join(members.where("node = of").select("node").distinct(), "node", "left_semi"), members


# ------------------------------------------------------------------ verification
def sketched(texts: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, text, n, bits: a bitmap of SKETCH_BITS of each set beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in blocks(batch, "text", 1_000_000):
                sets = shingle_sets(own, spec.k)
                maps = np.zeros((len(sets), SKETCH_BITS), bool)
                for row, tokens in zip(maps, sets, strict=True):
                    row[tokens % np.uint64(SKETCH_BITS)] = True
                bits = [m.tobytes() for m in np.packbits(maps, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, sets), pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "text", "n", "bits"])
        release()

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n long, bits binary")


def possible(pairs: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """The pairs whose bitmaps leave room for a link: every bit in which they differ is a token that only one set has."""
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
                total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                need = -(-spec.num * total // (spec.num + spec.den))
                keep = pa.array(2 * need <= total - np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def with_roles(pairs: DataFrame) -> DataFrame:
    """(doc_id, is_a, is_b) of the documents that stand in pairs."""
    sides = pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("first")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.lit(False).alias("first")))
    return sides.groupBy("doc_id").agg(F.bool_or("first").alias("is_a"), F.bool_or(~F.col("first")).alias("is_b"))


def verify(pairs: DataFrame, docs: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b), a written table, whose whole sets link. Bitmaps rule out most others, and only texts of the rest are moved."""
    texts = stash(sketched(docs.join(checked_broadcast(stash(with_roles(pairs).select("doc_id"), "ids")), "doc_id"), spec), "texts")
    pairs = stash(possible(pairs, texts, spec), "pairs")
    needed = texts.select("doc_id", "text").join(checked_broadcast(stash(with_roles(pairs), "ids")), "doc_id")
    side = lambda s: needed.where(f"is_{s}").select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        size = 0
        for batch in batches:
            for part, texts_a in blocks(batch, "text_a", 1_000_000):
                texts_b = [t or "" for t in part.column(3).to_pylist()]
                new = list({*texts_a, *texts_b} - kept.keys())
                size += sum(map(len, new))
                if size > 5_000_000:
                    kept, size = {}, 0
                    new = list({*texts_a, *texts_b})
                kept.update(zip(new, shingle_sets(new, spec.k), strict=True))
                linked = []
                for s, t in zip(texts_a, texts_b, strict=True):
                    x, y = kept[s], kept[t]
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(bool(spec.den * inter >= spec.num * (len(x) + len(y) - inter) and inter))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])
        kept = {}
        release()

    return stash(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")


def version_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the classes in which one doc_id stands, by their nodes."""
    each = rows.where("n > 0 and doc_id is not null").join(classes, ["key", "n"]).select("doc_id", "node")
    several = each.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("doc_id", "a")
    return each.join(several, "doc_id").where("node != a").select("a", F.col("node").alias("b"))


@dataclass
class Joined:
    """documents: doc_id, n_shingles, component_id. classes: key, n, node. links: verified (a, b) between class nodes."""

    documents: DataFrame
    classes: DataFrame
    links: DataFrame


def jaccard_join(documents: DataFrame, spec: Spec = Spec()) -> Joined:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stash(signatures(docs, spec), "signatures")
    rows = signed.where("key is not null").select("doc_id", "n", "key")
    classes = stash(rows.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("node")), "classes")
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent(signed))
    shared = stash(postings(prefixes(docs.where("doc_id is not null"), hot, spec), classes, spec), "postings")
    hot.destroy()
    tidy(spark)
    near = verify(stash(leader_pairs(shared, spec), "pairs"), docs, spec)
    found = components(near)
    tidy(spark)
    pairs = stash(open_pairs(shared, found, spec), "pairs")
    tidy(spark)
    links = near.unionByName(verify(pairs, docs, spec)).unionByName(stash(version_links(rows, classes), "versions"))
    labels = components(links)
    tidy(spark)
    named = rows.join(classes, ["key", "n"], "left").join(labels, "node", "left")
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    return Joined(out, classes, links)


def one_of_each(documents: DataFrame, joined: Joined) -> DataFrame:
    """The rows of documents whose id is their component's: one of each group. Of rows that share an id one stays.

    Only the ids to leave out and the repeated ones are looked up; texts move only where these are too many to broadcast.
    """
    stays = stash(joined.documents.select("doc_id", (F.col("component_id") == F.col("doc_id")).alias("stays")).where("doc_id is not null"), "stays")
    gone = checked_broadcast(stash(stays.where(~F.col("stays")).select("doc_id").distinct(), "gone"))
    again = stash(stays.where("stays").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "again")
    left = documents.join(gone, "doc_id", "left_anti").select(documents.columns)
    if again.isEmpty():
        return left
    once = left.join(checked_broadcast(again), "doc_id", "left_anti").select(documents.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[c for c in documents.columns if c != "doc_id"]))
    return once.unionByName(left.join(checked_broadcast(again), "doc_id", "left_semi").select(*documents.columns, first.alias("j_first")).where("j_first = 1").drop("j_first"))
