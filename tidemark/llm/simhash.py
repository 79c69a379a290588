"""SimHash near duplicates by pigeonhole blocks.

Each 64-bit word of a fingerprint is cut into blocks, and a key is a choice of blocks of one word. A pair that
differs in at most ``blocks - choose`` bits of a word agrees on all blocks of at least one of its keys, so joining
on keys and then verifying the Hamming distance finds every such pair. Components of the links are the groups of
near duplicates. ``near_duplicate_groups`` links one-word fingerprints at a distance that the blocks guarantee; its
keys get longer as fingerprints get more, so that a key is shared by few of them.

``similar_groups`` finds texts whose sets of word shingles have a Jaccard similarity of at least 4/5. At that
similarity 15 % of the bits differ, which no choice of blocks guarantees to find; fingerprints have so many words
and keys (``PLANS``) that a pair right at the limit shares one with a chance of 0.91, a pair at 0.82 of 0.96, at
0.85 of 0.99 and at 0.9 of 0.9998. Pairs that share a key and differ in at most two standard deviations more bits
than expected join texts to candidate clusters, and within a cluster the whole sets of all its texts are compared:
only pairs that are similar enough by exact count are links.

Equal fingerprints are one node throughout, so copies never meet as pairs. The fingerprints that share a key
are compared in numpy, and a key gives edges that connect what its links connect and not all its links: no link
that connects different groups is lost, and no group emits all its pairs. A key that more than ``CHUNK`` share is cut
into tiles of bounded size, each pair of chunks being compared once in one task.

Defined results: a null text counts as empty; texts without words have the fingerprint zero and link like any
other; repeated rows give repeated result rows; a null id takes part and gets the smallest id reachable, null
if there is none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, shuffle_width, table
from .components import connected_components
from .textops import mix, slices, word_hashes

#: Keys that more fingerprints share are compared in tiles of pairs of such chunks.
CHUNK = 1024
#: Jaccard similarity of a link between sets, as a fraction.
TOP, BOTTOM = 4, 5
#: Up to so many texts, words of a set's fingerprint and blocks of a word, of which two make a key: the more texts, the longer keys.
PLANS = ((1 << 25, 20, 5), (1 << 63, 100, 4))
#: Share of bits in which sets at the limit of similarity differ.
APART = math.acos(2 * TOP / (TOP + BOTTOM)) / math.pi
#: Shingles in a chunk of a candidate cluster, at most about.
CHUNK_SHINGLES = 1_000_000
#: Keys that a task makes of its fingerprints and counts before they are shuffled, about.
KEYS_A_TASK = 2_000_000


def _majority(h: np.ndarray) -> np.uint64:
    """Bit j is set if it is set in over half of the hashes."""
    n, total = len(h), np.zeros(64, np.int64)
    for a in range(0, n, 255 * 256):
        bits = np.unpackbits(h[a : a + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(bits) % 255:
            bits = np.concatenate([bits, np.zeros((255 - len(bits) % 255, 64), np.uint8)])
        total += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]


def exact_shingle_fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> np.uint64:
    """Majority of the XXH64 of space-joined word shingles, repeats included; no words: zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the ASCII spaces only
    if not parts:
        return np.uint64(0)
    joined = b" ".join(parts)
    if len(parts) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - shingle + 1].tolist()
        of = xxhash.xxh64_intdigest
        hashes = np.fromiter((of(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return _majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, f0)"""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                f = np.array([exact_shingle_fingerprint(t, shingle) for t in part["t"]], np.uint64)
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "f0": f.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInPandas(of, "id long, f0 long")


def _keys(blocks: int, choose: int) -> Column:
    """One long for each choice of blocks of the word ``f``, number ``word``: the choice's number and the chosen bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), choose))
    out = []
    for n, chosen in enumerate(choices):
        key = F.col("word").cast("long") * len(choices) + n
        for i in chosen:
            size = edges[i + 1] - edges[i]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned("f", edges[i]).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        out.append(key)
    return F.array(*out)


def _stars(close: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each row of a boolean adjacency matrix to the row of the smallest node that it is connected to.

    Smallest nodes tend to be the same for all keys, so that the keys of a large group give nearly the same edges.
    """
    left, us, vs = np.ones(len(close), bool), [], []
    for s in np.argsort(node, kind="stable"):
        if left[s]:
            left[s], stack = False, [s]
            while stack:
                new = np.flatnonzero(close[stack.pop()] & left)
                left[new] = False
                stack.extend(new.tolist())
                us.append(np.full(len(new), s))
                vs.append(new)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def _close(f: np.ndarray, distance: int) -> np.ndarray:
    close = np.zeros((len(f), len(f)), bool)
    for s in range(0, len(f), 256):
        close[s : s + 256] = sum(np.bitwise_count(f[s : s + 256, k, None] ^ f[None, :, k]).astype(np.int32) for k in range(f.shape[1])) <= distance
    return close


def _run_links(key: np.ndarray, node: np.ndarray, f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is close within runs of equal keys, fewer than there are rows."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    run = np.repeat(np.arange(len(start)), size)
    nth, of = np.arange(len(key)) - start[run], size[run]
    us, vs = [], []
    for d in range(1, min(int(size.max()), 64) if len(size) else 0):  # pairs of runs of up to 64, all runs at once
        i = np.flatnonzero((nth + d < of) & (of <= 64))
        apart = sum(np.bitwise_count(f[i, k] ^ f[i + d, k]).astype(np.int32) for k in range(f.shape[1]))
        us.append(i[apart <= distance])
        vs.append(us[-1] + d)
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = np.bincount(run[u], minlength=len(start))
    thin = found[run[u]] < size[run[u]]
    out_u, out_v = [u[thin]], [v[thin]]
    for r in np.flatnonzero((found >= size) | (size > 64)):
        a = start[r]
        i, j = _stars(_close(f[a : a + size[r]], distance), node[a : a + size[r]])
        out_u.append(a + i)
        out_v.append(a + j)
    return np.concatenate(out_u), np.concatenate(out_v)


def _tiled(rows: DataFrame, by: str, chunks: Column, columns: list[str]) -> DataFrame:
    """Deals each group's nodes to chunks and sends each pair of chunks, p and q, to one task."""
    return (
        rows.withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), chunks))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select(by, F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "node", *columns)
    )


def links(nodes: DataFrame, width: int, blocks: int, choose: int, distance: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between rows of ``nodes`` (node, f0, ...), which hold different fingerprints."""
    cols = [f"f{k}" for k in range(width)]
    # files hold fingerprints by their bytes, and each makes many keys, whose first counts a task holds
    tasks = -(-nodes.count() * width * math.comb(blocks, choose) // KEYS_A_TASK)
    dealt = nodes.repartition(max(shuffle_width(nodes.sparkSession), tasks), "node")
    keyed = dealt.select("node", F.posexplode(F.array(*cols)).alias("word", "f")).select("node", F.explode(_keys(blocks, choose)).alias("key"))
    sizes = scratch.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # without fingerprints, as most keys are shared by nobody; the same join at every size, and one that splits hot keys
    shared = scratch.put(keyed.join(sizes.hint("merge"), "key"), "shared")
    sized = shared.join(nodes.select("node", *cols), "node")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last run waits for the next batch."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            key = rest["key"].to_numpy()
            whole = np.searchsorted(key, key[-1]) if len(key) else 0
            yield of(rest.iloc[:whole])
            rest = rest.iloc[whole:]
        if rest is not None:
            yield of(rest)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        node = part["node"].to_numpy()
        u, v = _run_links(part["key"].to_numpy(), node, part[cols].to_numpy(np.int64).view(np.uint64), distance)
        return pd.DataFrame({"u": node[u], "v": node[v]})

    near = sized.where(F.col("n") <= CHUNK).select("key", "node", *cols).repartition("key").sortWithinPartitions("key").mapInPandas(runs, "u long, v long")

    heavy = _tiled(sized.where(F.col("n") > CHUNK), "key", F.ceil(F.col("n") / CHUNK), cols)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        u, v = _stars(_close(pdf[cols].to_numpy(np.int64).view(np.uint64), distance), node)
        return pd.DataFrame({"u": node[u], "v": node[v]})

    return near.unionByName(heavy.groupBy("key", "p", "q").applyInPandas(tile, "u long, v long"))


def near_duplicate_groups(
    docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, choose: int | None = None, distance: int = 4
) -> DataFrame:
    """(id, f0, group_id): one row for each document; group_id is the smallest id reachable.

    Keys are ``choose`` of ``distance + choose`` blocks, by default as many as keep few fingerprints to a key.
    """
    scratch = Scratch(spark)
    marked = scratch.put(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    node = F.col("f0")
    nodes = scratch.put(marked.groupBy("f0").agg(F.min("id").alias("least")).withColumn("node", node), "nodes")
    choose = choose or next((c for c in range(2, 6) if 64 * c // (distance + c) >= math.log2(1 + nodes.count()) + 2), 6)
    roots = connected_components(scratch.put(links(nodes.drop("least"), 1, distance + choose, choose, distance, scratch), "links"), scratch)
    rooted = nodes.join(roots.distinct(), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("group_id"))
    named = scratch.put(rooted.join(least, "root").select("node", "group_id"), "named")
    return marked.withColumn("node", node).join(named, "node").drop("node")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"), spark)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("group_id").alias("component_id"))


def shingle_sets(texts, shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of lower-cased words; a text shorter than a shingle is one."""
    h, first = word_hashes(texts)
    odd = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64)) for j in range(shingle)]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        w = h[a:b]
        g = np.zeros(max(1, len(w) - shingle + 1) if len(w) else 0, np.uint64)
        for j in range(min(shingle, len(w))):
            g += w[j : j + len(g)] * odd[j]
        out.append(np.unique(mix(g)))
    return out


def set_fingerprints(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Majority bits of each set, ``width`` words of them; a set is a row. An empty set has zeros."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), width), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    flat, n = np.concatenate([sets[i] for i in full]), size[full]
    # runs of at most 255 shingles are summed in bytes, eight to a word
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    of = np.repeat(np.arange(len(n)), runs)
    start = (np.cumsum(n) - n)[of] + 255 * (np.arange(runs.sum()) - first[of])
    end = np.append(start[1:], len(flat))
    for w in range(width):
        seed, sums = np.uint64(0x9E3779B97F4A7C15 * (2 * w + 1) % (1 << 64)), []
        for a in range(0, len(start), 256):
            z = min(a + 256, len(start))
            h = mix(flat[start[a] : end[z - 1]] ^ seed)
            lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
            sums.append(np.add.reduceat(lanes, start[a:z] - start[a], axis=0).view(np.uint8).astype(np.int32))
        count = np.add.reduceat(np.concatenate(sums), first, axis=0)
        out[full, w] = np.packbits(count * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _set_name(s: np.ndarray) -> int:
    return int(mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def _set_links(sets: list[np.ndarray], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the sets that are similar enough, by exact counts of what they share."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.array([[size[0], 0], [0, size[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
        some = count[of] > 1  # a shingle of one set is shared by none
        column = np.cumsum(count > 1) - 1
        of, owner = column[of[some]], owner[some]
        order = np.argsort(of, kind="stable")
        of, owner = of[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2**24 shingles
        step = max(256, 8_000_000 // len(sets))
        for a in range(0, int(of[-1]) + 1 if len(of) else 0, step):
            x, z = np.searchsorted(of, (a, a + step))
            m = np.zeros((len(sets), step), np.float32)
            m[owner[x:z], of[x:z] - a] = 1
            both += m @ m.T
    return _stars(both * (TOP + BOTTOM) >= TOP * (size[:, None] + size), node)


def similar_groups(docs: DataFrame, spark: SparkSession, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id): one row for each document; group_id is the smallest id reachable by links of similarity 4/5 or more.

    Sets of word shingles are compared, so a repeated shingle counts once; texts with equal sets are one node.
    """
    scratch = Scratch(spark)
    rows = docs.count()
    width, blocks = next((w, b) for most, w, b in PLANS if rows <= most)
    cols, distance = [f"f{k}" for k in range(width)], round(64 * width * APART + 2 * math.sqrt(64 * width * APART * (1 - APART)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = shingle_sets(part["t"], shingle)
                prints = set_fingerprints(sets, width).view(np.int64)
                yield pd.DataFrame({"id": part["id"].astype("Int64").array, "node": [_set_name(s) for s in sets], "n": [len(s) for s in sets], **{c: prints[:, k] for k, c in enumerate(cols)}})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = shingle_sets(part["t"], shingle)
                yield pd.DataFrame({"node": [_set_name(s) for s in sets], "s": [s.tobytes() for s in sets]})

    marked = scratch.put(texts.mapInPandas(mark, f"id long, node long, n long, {', '.join(f'{c} long' for c in cols)}"), "marked")
    nodes = scratch.put(marked.groupBy("node").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", *cols))), "nodes")
    ids = scratch.put(marked.select("id", "node"), "ids")
    scratch.drop("marked")
    near = scratch.put(links(nodes.select("node", *cols), width, blocks, 2, distance, scratch), "near")
    scratch.drop("sizes", "shared")
    clusters = connected_components(near, scratch, "a").distinct()
    members = scratch.put(nodes.select("node", "n", "least").join(clusters.withColumnRenamed("root", "cluster"), "node"), "members")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")
    holders = broadcast_if_small(scratch.put(members.select(F.col("least").alias("holder")).distinct(), "holders"))
    held = texts.join(holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")  # only texts of clusters are cut again
    placed = members.select("node", "cluster").join(members.groupBy("cluster").agg(chunks), "cluster")
    sets = scratch.put(held.mapInPandas(cut, "node long, s binary").join(placed, "node").dropDuplicates(["node"]), "sets")

    def of(part: pd.DataFrame) -> pd.DataFrame:
        node = part["node"].to_numpy()
        u, v = _set_links([np.frombuffer(s, np.uint64) for s in part["s"]], node)
        return pd.DataFrame({"u": node[u], "v": node[v]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cluster; the last cluster waits for the next batch."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            cuts = [0, *(np.flatnonzero(np.diff(rest["cluster"].to_numpy())) + 1)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                yield of(rest.iloc[a:z])
            rest = rest.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield of(rest)

    small = sets.where("chunks <= 1").select("cluster", "node", "s").repartition("cluster").sortWithinPartitions("cluster").mapInPandas(whole, "u long, v long")
    large = _tiled(sets.where("chunks > 1"), "cluster", F.col("chunks"), ["s"]).groupBy("cluster", "p", "q").applyInPandas(of, "u long, v long")
    roots = connected_components(scratch.put(small.unionByName(large), "links"), scratch, "b").distinct()
    found = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.put(found.join(found.groupBy("root").agg(F.min("least").alias("group_id")), "root").select("node", "group_id"), "named")
    scratch.drop("sets", "near", "members", "holders", "nodes", "links")
    return ids.join(named, "node").drop("node")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest id stays.

    Links are pairs whose sets of five-word shingles have a Jaccard similarity of at least 0.8, found by blocks of
    fingerprints and verified exactly. Rows that repeat an id are one document; rows without an id stay; an empty
    table stays empty; further columns are kept as they are.
    """
    groups = similar_groups(docs, spark, shingle=5)
    scratch = Scratch(spark)  # written, so that its size decides how it is joined
    groups = scratch.put(groups.select("id", "group_id"), "groups")
    gone = scratch.put(groups.where("id <> group_id").select(F.col("id").alias("doc_id")).distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = scratch.put(groups.where("id is not null").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id"), "twice")
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
