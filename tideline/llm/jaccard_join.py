"""Similarity join on word shingles by prefixes under several global orders.

A document's set is its distinct five-word shingles; two link if their Jaccard similarity is 0.75 or more. Under any
one order of all shingles, linked sets share a shingle among the first n - ceil(0.75 n) + 1 of each (and, among m more, m more). The orders:

1. ascending hash: one pass over all texts emits each set's prefix; a set stays only if enough of its prefix is shared
   with other sets. Shingles that many sets of a batch hold are counted on the map side and stand in the shuffle by two witnesses.
2. descending hash, the same among the sets that stay: a partner must have stayed, too.
3. rarity among the sets that stay (then hash): shingles that one set alone holds come first and pair with none, passages
   that many share come last. Sets that share a prefix shingle, with fitting sizes and places, are candidates. Of such a pair the
   smaller set has the shingle in its first seventh, so common shingles make pairs only where they are nearly all that a set has.
4. the candidates are intersected with those of both hash orders: a pair stays only if its prefixes meet under each. Only
what is left is verified on the whole sets.

Every posting carries its set's parities: 512 bits, each the parity of the shingles that hash to it. Bits in which two sets differ are no more
than the shingles in which they do, so pairs that differ in too many are no candidates. That drops no link.

Equal sets are one node from the start. Within a shingle's bucket nodes are only ever compared with pivots, in turns. First there is one
pivot in each bucket; the links found make components, and from then on only pairs across components matter: the pivots of a bucket are
drawn from the nodes outside its main component. A pivot has met its whole bucket and leaves it, and each turn draws ``MORE_PIVOTS``
times as many as the one before, so the turns end, at every size, with a logarithm of the largest bucket, and no link is lost. A
group of n near copies costs about n comparisons. Large buckets are split into parts of ``BUCKET_PART`` nodes, each with all the pivots.

Null and empty texts have empty sets and link with nothing; repeated rows are equal sets; texts of any length are read whole; a null
doc_id takes part, and names a component only if all its rows have null ids; an empty table gives an empty result; other columns
are ignored. Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.batches import text_bytes, tidied
from tideline.llm.components import components
from tideline.llm.scratch import materialise
from tideline.llm.shingles import shingle_sets

#: Documents that are hashed at once.
SLICE = 500
#: A shingle that so many sets of a slice hold is counted there.
COMMON = 8
#: Pivots of a bucket in the second turn, and how many times as many the next one has.
PIVOTS, MORE_PIVOTS = 16, 4
#: Nodes of a bucket that one task compares with its pivots.
BUCKET_PART = 2000
#: A key that holds more than this share of the rows is joined apart: there are no more such keys than its inverse.
HOT_SHARE = 0.001
#: Labels of so many nodes (24 bytes each) are sent to every executor; beyond, they are joined by a shuffle.
BROADCAST_NODES = 500_000


def need(n):
    """ceil(0.75 n): what a set of n shares with any set that it links to, at least."""
    return (3 * n + 3) // 4


def spare(n):
    """How much longer than needed the first prefix is; never more than need(n) for n of 1 or more."""
    return 1 + n // 16


def _names(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two longs."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _node(tokens: np.ndarray, moved: dict[tuple[int, int], int]) -> int:
    """The first 64 bits; sets that share them with another one are in ``moved`` with an own number."""
    both = _names(tokens)
    return moved.get(both, both[0]) if moved else both[0]


PARITIES = [f"s{k}" for k in range(8)]


def parities(tokens: np.ndarray) -> list[int]:
    """512 parities as eight longs."""
    bits = np.bincount((tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _sets(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            yield batch, shingle_sets(*text_bytes(batch.column(batch.schema.get_field_index(column))))


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and check (128 bits of the set; null for an empty one)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            names = [_names(s) if len(s) else (None, None) for s in sets]
            columns = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], *zip(*names, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_shingles", "node", "check"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_shingles long, node long, check long")


def apart(held: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """held without check, and the sets whose first 64 bits another set has, with the number they get instead: their other 64 bits.
    Of n sets about n * n / 2 ** 65 are such: three of ten thousand million."""
    ends = held.filter("node is not null").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most"))
    shared = [r["node"] for r in ends.filter("least <> most").select("node").collect()]
    if not shared:
        return held.drop("check"), {}
    rows = held.filter(F.col("node").isin(shared)).select("node", "check").distinct().collect()
    moved = {(r["node"], r["check"]): r["check"] for r in rows}
    return held.withColumn("node", F.when(F.col("node").isin(shared), F.col("check")).otherwise(F.col("node"))).drop("check"), moved


def _prefix_postings(own: dict[int, np.ndarray], first: bool) -> pa.RecordBatch:
    """token, node, k: a posting (0), a posting counted here already (-1), or k shared shingles of a node. The prefixes are the
    sets' first shingles in ascending or in descending order of hash."""
    lengths = [len(s) - need(len(s)) + spare(len(s)) for s in own.values()]
    token = np.concatenate([s[:m] if first else s[-m:] for s, m in zip(own.values(), lengths, strict=True)]).view(np.int64)
    node = np.repeat(np.array(list(own), np.int64), lengths)
    order = np.argsort(token, kind="stable")
    token, node = token[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(start, len(token)))
    common = np.repeat(size >= COMMON, size)
    counted, times = np.unique(node[common], return_counts=True)
    witness = np.concatenate([start[size >= COMMON], start[size >= COMMON] + 1]).astype(np.int64)
    rows = [np.concatenate([token[~common], token[witness], counted]), np.concatenate([node[~common], node[witness], counted])]
    k = np.concatenate([np.zeros((~common).sum(), np.int32), np.full(len(witness), -1, np.int32), times.astype(np.int32)])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, k)], names=["token", "node", "k"])


def _text_postings(moved: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            if own := {_node(s, moved): s for s in sets if len(s)}:
                yield _prefix_postings(own, True)

    return run


def _set_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            yield _prefix_postings({n: np.frombuffer(s.as_buffer(), np.uint64) for n, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}, False)


def _counts(postings: DataFrame) -> DataFrame:
    """node, c: how many of its prefix shingles other nodes hold in theirs."""
    return postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(tidied(_shared), "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))


ENOUGH = "c >= 1 + floor(n / 16)"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (token, node): node, c, how many of its shingles another node holds too. Runs may span batches."""
    last = (None, None)
    waits = False  # the last row is the only one of its run so far and not counted yet
    for batch in batches:
        token, node, k = (batch.column(c).to_numpy() for c in ("token", "node", "k"))
        told, counts = [node[k > 0]], [k[k > 0].astype(np.int64)]
        token, node, k = token[k <= 0], node[k <= 0], k[k <= 0]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        if len(token):  # a batch may hold counts alone
            fresh[0] = last != (int(token[0]), int(node[0]))
        token, node, k = token[fresh], node[fresh], k[fresh]
        if len(token):
            start, more = np.ones(len(token), bool), np.zeros(len(token), bool)
            more[:-1] = token[1:] == token[:-1]
            start[1:] = ~more[:-1]
            start[0] = last[0] != token[0]
            if waits and not start[0]:
                told.append(np.array([last[1]], np.int64))
                counts.append(np.ones(1, np.int64))
            chosen = (~start | more) & (k == 0)
            told.append(node[chosen])
            counts.append(np.ones(int(chosen.sum()), np.int64))
            last = (int(token[-1]), int(node[-1]))
            waits = bool(start[-1] and k[-1] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(told)), pa.array(np.concatenate(counts))], names=["node", "c"])


def survivors(docs: DataFrame, reps: DataFrame, moved: dict) -> DataFrame:
    """node, n, rep: the nodes that share enough of their first prefix. reps: each node with its size and least doc_id."""
    counts = _counts(docs.select("text").mapInArrow(tidied(_text_postings(moved)), "token long, node long, k int"))
    return reps.join(counts, "node").filter(ENOUGH).select("node", "n", "rep")


def second_survivors(sets: DataFrame) -> DataFrame:
    """The sets that share enough of their last prefix with others that are still there."""
    counts = _counts(sets.select("node", "tokens").mapInArrow(tidied(_set_postings), "token long, node long, k int"))
    return sets.join(counts, "node").filter(ENOUGH).select("node", "n", "tokens", *PARITIES)


def sets_of(docs: DataFrame, live: DataFrame, moved: dict) -> DataFrame:
    """node, n, tokens (ascending, as bytes) and parities of the live nodes, from the text of the document with the least id."""
    wanted = live.select("rep", F.col("node").alias("want"))
    wanted = F.broadcast(wanted) if live.count() <= BROADCAST_NODES else wanted
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            want = batch.column(batch.schema.get_field_index("want")).to_pylist()
            kept = [(w, len(s), s.tobytes(), *parities(s)) for w, s in zip(want, sets, strict=True) if len(s) and _node(s, moved) == w]
            columns = list(zip(*kept, strict=True)) or [()] * (3 + len(PARITIES))
            types = [pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * len(PARITIES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "n", "tokens", *PARITIES])

    return texts.select("text", "want").mapInArrow(tidied(run), ", ".join(["node long, n long, tokens binary", *[f"{s} long" for s in PARITIES]]))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            raw, ends = text_bytes(batch.column(2))
            token = raw[ends[0] : ends[-1]].view(np.int64) if ends[-1] > ends[0] else np.zeros(0, np.int64)
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], names=["token", "node", "n"])


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """token, node, n, place: the shared shingles in each set's prefix under the order of (sets that hold it, hash)."""
    rows = sets.select("node", "n", "tokens").mapInArrow(tidied(_explode), "token long, node long, n long")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = Window.partitionBy("node")
    placed = rows.join(shared, "token").withColumn("place", F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "token")))
    placed = placed.filter("place <= n - floor((3 * n + 3) / 4) + 1").select("token", "node", "n", "place")
    # In the smaller set of a pair, what begins at the first common shingle is six sevenths of it at least.
    placed = placed.withColumn("early", 7 * (1 + F.col("n") - F.col("place")) >= 6 * F.col("n"))
    return placed.join(sets.select("node", F.struct(*PARITIES).alias("sig")), "node").select("token", "node", "n", "place", "early", "sig")


def _fitting(n1: Column, p1: Column, s1: Column, n2: Column, p2: Column, s2: Column) -> Column:
    """Whether sets of these sizes can link, still can if their first common shingle stands at these places, and differ in few
    enough parities: sets that link differ in a seventh of both sizes at most."""
    rest = 1 + F.least(n1 - p1, n2 - p2)
    differ = sum((F.bit_count(s1[s].bitwiseXOR(s2[s])) for s in PARITIES), F.lit(0))
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * rest >= 3 * (n1 + n2)) & (7 * differ <= n1 + n2)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """node, up, down: each set's prefixes under both hash orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for at in range(0, many.num_rows, SLICE):
                batch = many.slice(at, SLICE)
                whole = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
                first = [len(s) - need(len(s)) + 1 for s in whole]
                kind = pa.list_(pa.int64())
                up, down = (pa.array([s[:m] if k else s[-m:] for s, m in zip(whole, first, strict=True)], kind) for k in (1, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), up, down], names=["node", "up", "down"])

    return sets.select("node", "tokens").mapInArrow(tidied(run), "node long, up array<long>, down array<long>")


def intersect(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs (a, b) that are candidates under both hash orders, too. sides: prefixes."""
    left, right = (sides.select(F.col("node").alias(k), F.col("up").alias(f"up_{k}"), F.col("down").alias(f"down_{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a")
    return both.filter(F.arrays_overlap("up_a", "up_b") & F.arrays_overlap("down_a", "down_b")).select("a", "b")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for s, t in zip(batch.column(2), batch.column(3), strict=True):
            keep.append(linked(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """By the whole sets, both ascending."""
    both = len(s) + len(t) - len(np.union1d(s, t))
    return 100 * both >= 75 * (len(s) + len(t) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t").mapInArrow(tidied(_verify), "a long, b long")


def by_key(rows: DataFrame, few: DataFrame, key: str, total: int) -> DataFrame:
    """rows (a written table) with the columns of few, which has one row for each key and its number of rows as ``held``. Keys that hold
    more than HOT_SHARE of the total, fewer than its inverse, are broadcast; all others are joined by a shuffle, where no key is large."""
    hot = F.broadcast(few.filter(F.col("held") > HOT_SHARE * total).drop("held"))
    cold = few.filter(F.col("held") <= HOT_SHARE * total).drop("held")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def _named(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with the component of each node."""
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_NODES else labels
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _turn(postings: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """The nodes of all buckets that have pairs left, each with its bucket's main component, whether it is a pivot of this turn,
    and into how many parts its bucket goes.

    A pair is of an early node and another one, in two components. All but the main component's nodes are pivots in time,
    so every pair has a pivot; in the first turn, when each node is a component, any early node is."""
    named = _named(postings, labels).withColumn("h", F.xxhash64("node", F.lit(turn)))
    one = F.struct("h", "node", "label")
    buckets = named.groupBy("token").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("all"), F.max("early").alias("any_early"),
        F.min(F.when(F.col("early"), one)).alias("one"),
    ).filter("least <> most and any_early")
    buckets = buckets.select("token", "all", F.col("one.node").alias("chosen"), F.col("one.label").alias("main"))
    rows = named.join(buckets, "token")
    if turn == 0:
        pivot = F.col("node") == F.col("chosen")
    else:
        # As many as wanted of those outside the main component, by their hashes; the whole bucket bounds their number.
        share = PIVOTS * MORE_PIVOTS ** (turn - 1) / F.col("all")
        pivot = (F.col("label") != F.col("main")) & ((share >= 1) | (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)))
    return rows.withColumns({"pivot": pivot, "parts": F.ceil(F.col("all") / BUCKET_PART).cast("int")}).drop("all", "chosen", "h")


def links(sets: DataFrame, trace: list | None = None) -> DataFrame | None:
    """node, label: the components of the sets; None if no two link. trace gets the open postings, pairs and links of each turn."""
    postings = materialise(rare_prefixes(sets), "postings")
    sides = materialise(prefixes(sets), "prefixes")
    names = postings.columns
    labels = edges = None
    turn = 0
    while True:
        open_rows = materialise(_turn(postings, labels, turn), "open")
        if open_rows.isEmpty():
            return labels
        part = F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int")
        pivots = open_rows.filter("pivot").select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("early").alias("ey"), F.col("label").alias("ly"), F.col("sig").alias("sy"))
        met = open_rows.withColumn("part", part).join(pivots, ["token", "part"])
        near = met.filter((F.col("label") != F.col("ly")) & (F.col("early") | F.col("ey")) & _fitting(F.col("n"), F.col("place"), F.col("sig"), F.col("ny"), F.col("py"), F.col("sy")))
        pairs = materialise(_pairs(near.withColumnRenamed("node", "x")), "pairs")
        found = materialise(verify(materialise(intersect(pairs, sides), "intersected"), sets), "links")
        if trace is not None:
            trace.append((open_rows.count(), pairs.count(), found.count()))
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)
        postings = open_rows.filter("not pivot").select(*names)
        turn += 1


def join(docs: DataFrame, trace: list | None = None) -> DataFrame:
    """doc_id, n_shingles, node, component_id of each row."""
    held, moved = apart(materialise(members(docs), "members"))
    reps = held.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held"))
    reps = materialise(reps, "nodes")
    live = materialise(survivors(docs, reps, moved), "live")
    sets = materialise(second_survivors(materialise(sets_of(docs, live, moved), "first-sets")), "sets")
    labels = links(sets, trace)
    if labels is None:
        named = reps.select("node", F.col("rep").alias("component_id"), "held")
    else:
        # Each node's label, then each label's least doc_id: a node is one row here, and hot labels are joined apart.
        told = materialise(reps.join(labels, "node").select("node", "label", "rep", "held"), "labelled")
        least = told.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("held"))
        linked_nodes = by_key(told.withColumnRenamed("held", "copies"), materialise(least, "least"), "label", told.count()).select("node", "component_id", F.col("copies").alias("held"))
        named = reps.join(linked_nodes.select("node"), "node", "left_anti").select("node", F.col("rep").alias("component_id"), "held").unionByName(linked_nodes)
    rows = held.select("doc_id", "n_shingles", "node")
    known = by_key(rows.filter("node is not null"), materialise(named, "components"), "node", rows.count())
    done = known.unionByName(rows.filter("node is null").withColumn("component_id", F.col("doc_id")))
    return done.select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document with the component of its links."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def brute(rows: list[tuple]) -> dict:
    """The query's rows by comparing all pairs, for tests: doc_id to (n_shingles, component_id)."""
    import re

    sets = {}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}
