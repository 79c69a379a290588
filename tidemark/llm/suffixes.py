"""Removal of byte strings that an earlier document has, by a distributed difference-cover suffix array.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller id.

Suffixes need sorting only where such a string may lie, and only once for equal surroundings; the first steps find
these places, without loss, and the suffix array is built over them:

1. Of every ``LENGTH - GRAM + 1`` neighbouring ``GRAM``-byte strings the one with the least hash is an anchor, so
   equal strings have equal anchors at equal places. Anchors that only one document has are left.
2. Where an anchor's surroundings can share a string with equal surroundings only, as in copies, the strings in
   them are judged by the smallest id. All other surroundings are merged into fragments, and fragments with equal
   bytes are kept once, with their smallest id.
3. Positions of fragments at 1 and 2 modulo 3 are the difference cover. Their triples of 8-byte characters are
   sorted and named; triples of names, which cover 72 bytes and so more than ``LENGTH``, are sorted and named
   again, which ends the recursion. The remaining positions are merged in by their first bytes and the names that
   follow. Neighbours in this order whose ``LENGTH``-byte prefixes agree are one string.

Texts are held in chunks of some megabytes and all exchanges carry compressed arrays for a chunk and a bucket or
range; answers come back in the order of the questions. A string that is in very many documents is one entry for
each chunk, and one for each of its distinct surroundings. Strings are compared by 64-bit hashes, neighbours in
the order of suffixes by 48 bits of them.

Defined results: a null text counts as empty; an empty text loses nothing; a null id is smaller than all others;
rows with equal ids are one document, so they do not remove each other's bytes; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import dump as _dump
from .arrays import load as _load
from .arrays import small as _small
from .common import Scratch, shuffle_width, table
from .katz import NULL, _bucket
from .textops import long_span_hashes, mix, pack, prefix_hashes, slices, span_hashes

# messages go back to the system when freed: Python workers outlive tasks, and Arrow's own pool keeps its memory
pa.set_memory_pool(pa.system_memory_pool())

LENGTH, GRAM = 50, 24
CHUNK_CHARS, BUCKET_CHARS = 2_000_000, 12_000_000
_SENT = "part int, src long, data binary"
_TOLD = "part int, src long, data binary, n long"


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def chunk() -> pd.DataFrame:
            nonlocal number
            data, at = pack(texts)
            row = pd.DataFrame([{"src": (task << 32) + number, "text": _dump(data=data, at=at, step=_small(np.diff(_anchors(data, at), prepend=0)), keys=np.array([NULL if k is None else k for k in keys], np.int64))}])
            number += 1
            keys.clear(), texts.clear()
            return row

        for batch in batches:
            for part in slices(batch, "t", 1_000_000):
                keys += [None if k is pd.NA else int(k) for k in part["k"].astype("Int64").array]
                texts += list(part["t"])
                size += sum(len(t or "") for t in part["t"]) + 64 * len(part)
                if size >= CHUNK_CHARS:
                    yield chunk()
                    size = 0
        if keys:
            yield chunk()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(of, "src long, text binary")


def _anchors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some window of neighbours within one text."""
    n, wide = len(data) - GRAM + 1, LENGTH - GRAM + 1
    if n < wide:
        return np.zeros(0, np.int64)
    prefix = prefix_hashes(data)
    # never 0, which marks windows that leave their text
    h = (span_hashes(prefix, slice(0, n), slice(GRAM, n + GRAM)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least, size = h, 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(least) - wide + size], least[wide - size :])
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # a string ends before its text's line feed
        least[max(a, z - LENGTH) : z] = 0
    # a hash is the least of a window that holds it if the greatest of those windows' least ones is no less
    most = np.concatenate([np.zeros(wide - 1, np.uint32), least, np.zeros(n - len(least), np.uint32)])
    size = 1
    while 2 * size <= wide:
        most, size = np.maximum(most[:-size], most[size:]), 2 * size
    most = np.maximum(most[: len(most) - wide + size], most[wide - size :])
    return np.flatnonzero(most[:n] == h)


class _Chunk:
    """A chunk's texts with their anchors."""

    def __init__(self, blob: bytes):
        x = _load(blob)
        self.data, self.at, self.keys = x["data"], x["at"], x["keys"]
        self.place = np.cumsum(x["step"], dtype=np.int64)
        self.prefix = prefix_hashes(self.data)
        # anchors have small hashes, so they are hashed again to fall evenly into buckets
        self.hash = mix(span_hashes(self.prefix, self.place, self.place + GRAM))
        self.doc = np.searchsorted(self.at, self.place, side="right") - 1  # of each anchor

    def around(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that hold an anchor start at first and end at last."""
        doc = np.searchsorted(self.at, place, side="right") - 1
        return np.maximum(place + GRAM - LENGTH, self.at[doc]), np.minimum(place + LENGTH, self.at[doc + 1] - 1)


def _send(src: int, h: np.ndarray, buckets: int, **columns: np.ndarray) -> pd.DataFrame:
    """Rows for each bucket of sorted hashes."""
    cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
    step = np.diff(h, prepend=np.uint64(0)) if len(h) else h
    rows = []
    for b, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if z > a:
            first = step[a:z].copy()
            first[0] = h[a]
            rows.append({"part": b, "src": src, "data": _dump(step=first, **{k: v[a:z] for k, v in columns.items()})})
    return pd.DataFrame(rows, columns=["part", "src", "data"])


def _told(df: pd.DataFrame, name: str) -> np.ndarray:
    parts = [_load(d)[name] for d in df.sort_values("part")["data"]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _answers(pdf: pd.DataFrame, sizes: list[int], n: int = 0, **columns: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    return pd.DataFrame([{"part": int(p), "src": s, "data": _dump(**{k: v[e - k_ : e] for k, v in columns.items()}), "n": n} for p, s, e, k_ in zip(pdf["part"], pdf["src"], ends, sizes, strict=True)], columns=["part", "src", "data", "n"])


def _repeated(chunks: DataFrame, buckets: int) -> DataFrame:
    """Step 1: for each chunk's distinct anchors, whether another document has them."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                c = _Chunk(row.text)
                h, many = _distinct(c)
                yield _send(row.src, h, buckets, many=many)

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_load(d) for d in pdf["data"]]
        h = np.concatenate([np.cumsum(p["step"], dtype=np.uint64) for p in parts])
        many = np.concatenate([p["many"] for p in parts])
        _, of, n = np.unique(h, return_inverse=True, return_counts=True)
        any_ = np.bincount(of, many) > 0
        return _answers(pdf, [len(p["step"]) for p in parts], again=((n > 1) | any_)[of])

    return chunks.mapInPandas(ask, _SENT).groupBy("part").applyInPandas(tell, _TOLD)


def _distinct(c: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct anchors, and whether several of its documents have them."""
    h, of = np.unique(c.hash, return_inverse=True)
    key = c.keys[c.doc]
    low, high = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), NULL)
    np.minimum.at(low, of, key)
    np.maximum.at(high, of, key)
    return h, low < high


def _candidates(c: _Chunk, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors that several documents have; hashes, surroundings and first places of the distinct ones; which each is."""
    h, _ = _distinct(c)
    keep = again[np.searchsorted(h, c.hash)].astype(bool) if len(h) else np.zeros(0, bool)
    place, gram = c.place[keep], c.hash[keep]
    around = span_hashes(c.prefix, *c.around(place))
    order = np.lexsort((around, gram))
    g, s = gram[order], around[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))) if len(g) else np.zeros(0, bool)
    of = np.empty(len(g), np.int64)
    of[order] = np.cumsum(new) - 1
    return place, g[new], s[new], place[order][new], of


#: A string that holds an anchor reaches so far to its left and right, at least, in one of three ways.
_PARTS = (((LENGTH - GRAM + 2) // 3 * 2, 0), ((LENGTH - GRAM + 2) // 3, (LENGTH - GRAM) // 3), (0, LENGTH - GRAM - (LENGTH - GRAM + 2) // 3 + 1))


def _parts(c: _Chunk, place: np.ndarray, around: np.ndarray) -> list[np.ndarray]:
    """Hashes of the parts of surroundings of which two that share a string have one in common."""
    start, end = c.around(place)
    out = []
    for left, right in _PARTS:
        there = (place - left >= start) & (place + GRAM + right <= end)
        h = span_hashes(c.prefix, np.where(there, place - left, place), np.where(there, place + GRAM + right, place))
        out.append((np.where(there, h, around) >> np.uint64(32)).astype(np.uint32))
    return out


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of each pair, equal ones alike."""
    order = np.lexsort((b, a))
    of = np.empty(len(order), np.int64)
    new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    of[order] = np.concatenate(([0], np.cumsum(new))) if len(order) else order
    return of


def _surroundings(chunks: DataFrame, again: DataFrame, buckets: int) -> DataFrame:
    """Step 2: for each chunk's distinct surroundings, whether others may share a string with them, and their smallest id."""

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(left["text"].iloc[0])
        place, g, s, first, of = _candidates(c, _told(right, "again"))
        left_, both, right_ = _parts(c, first, s)
        least = np.full(len(g), np.iinfo(np.int64).max)
        np.minimum.at(least, of, c.keys[np.searchsorted(c.at, place, side="right") - 1])
        return _send(int(left["src"].iloc[0]), g, buckets, around=s, least=least, p0=left_, p1=both, p2=right_)

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_load(d) for d in pdf["data"]]
        g = np.concatenate([np.cumsum(p["step"], dtype=np.uint64) for p in parts])
        s, key = np.concatenate([p["around"] for p in parts]), np.concatenate([p["least"] for p in parts])
        same = _same(g, s)
        least = np.full(len(same), np.iinfo(np.int64).max)
        np.minimum.at(least, same, key)
        mixed = np.zeros(len(g), bool)
        gram = np.unique(g, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)
        for k in ("p0", "p1", "p2"):
            pairs, of = np.unique(gram | np.concatenate([p[k] for p in parts]), return_inverse=True)
            low, high = np.full(len(pairs), np.iinfo(np.int64).max), np.full(len(pairs), -1)
            np.minimum.at(low, of, same)
            np.maximum.at(high, of, same)
            mixed |= (low < high)[of]
        return _answers(pdf, [len(p["step"]) for p in parts], mixed=mixed, least=least[same])

    return chunks.groupBy("src").cogroup(again.groupBy("src")).applyInPandas(ask, _SENT).groupBy("part").applyInPandas(tell, _TOLD)


def _fragments(chunks: DataFrame, again: DataFrame, around: DataFrame, buckets: int) -> DataFrame:
    """part -1: a chunk's removed runs and fragments' places; else its distinct fragments."""

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        src, c = int(left["src"].iloc[0]), _Chunk(left["text"].iloc[0])
        place, _, _, _, of = _candidates(c, _told(right[right["kind"] == 0], "again"))
        mixed, least = _told(right[right["kind"] == 1], "mixed").astype(bool), _told(right[right["kind"] == 1], "least").astype(np.int64)
        start, end = c.around(place)
        gone = (least[of] < c.keys[np.searchsorted(c.at, place, side="right") - 1]) & ~mixed[of] if len(place) else np.zeros(0, bool)
        run_s, run_e = _union(start[gone], end[gone])
        some = mixed[of] if len(place) else np.zeros(0, bool)
        s, e = _union(start[some], end[some])
        name = long_span_hashes(span_hashes(c.prefix, s, e), c.data, s, e) ^ mix((e - s).astype(np.uint64))
        h, first, of = np.unique(name, return_index=True, return_inverse=True)
        key = np.full(len(h), np.iinfo(np.int64).max)
        np.minimum.at(key, of, c.keys[np.searchsorted(c.at, s, side="right") - 1])
        fs, fe = s[first], e[first]
        size = fe - fs
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = c.data[np.repeat(fs - ends[:-1], size) + np.arange(ends[-1])]
        rows = [{"part": -1, "src": src, "data": _dump(run_s=run_s, run_e=run_e, s=s, e=e, of=_small(of))}]
        edge = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        for b, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if z > a:
                rows.append({"part": b, "src": src, "data": _dump(h=h[a:z], nth=np.arange(a, z), least=key[a:z], size=_small(size[a:z]), flat=flat[ends[a] : ends[z]])})
        return pd.DataFrame(rows)

    told = again.withColumn("kind", F.lit(0)).unionByName(around.withColumn("kind", F.lit(1)))
    return chunks.groupBy("src").cogroup(told.groupBy("src")).applyInPandas(cut, _SENT)


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals; texts are parted by a line feed that no interval holds."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], np.append(end[:-1][new[1:]], end[-1])


def _unite(cut: DataFrame) -> DataFrame:
    """Equal fragments once. ``told``: smallest ids in the order of a chunk's fragments; ``text``: the fragments."""

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_load(d) for d in pdf["data"]]
        h, key = np.concatenate([p["h"] for p in parts]), np.concatenate([p["least"] for p in parts])
        size = np.concatenate([p["size"].astype(np.int64) for p in parts])
        flat = np.concatenate([p["flat"] for p in parts])
        start = np.cumsum(size) - size
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, of, key)
        ends = np.concatenate(([0], np.cumsum(size[first])))
        text = flat[np.repeat(start[first] - ends[:-1], size[first]) + np.arange(ends[-1])]
        owner = np.flatnonzero(key == least[of])
        src = np.repeat(pdf["src"].to_numpy(np.int64), [len(p["h"]) for p in parts])
        nth = np.concatenate([p["nth"] for p in parts])
        out = _answers(pdf, [len(p["h"]) for p in parts], least=least[of])
        out["text"] = None
        bucket = int(pdf["part"].iloc[0])
        out.loc[len(out)] = [bucket, bucket, None, 0, _dump(flat=text, at=ends, least=least, owner=of[owner], o_src=src[owner], o_nth=nth[owner])]
        return out

    return cut.where("part >= 0").groupBy("part").applyInPandas(tell, _TOLD + ", text binary")


class _Fragments:
    def __init__(self, blob: bytes):
        x = _load(blob)
        self.flat, self.at, self.least = x["flat"], x["at"], x["least"]
        self.owner, self.o_src, self.o_nth = x["owner"], x["o_src"], x["o_nth"]
        self.of = np.repeat(np.arange(len(self.least)), np.diff(self.at))
        self.offset = np.arange(len(self.flat)) - self.at[self.of]
        self.left = self.at[self.of + 1] - np.arange(len(self.flat))

    def characters(self) -> np.ndarray:
        """The 8 bytes from each position on as one number, nulls after the fragment's end."""
        at = np.arange(len(self.flat)) + 8 * self.of
        c = np.zeros(len(self.flat) + 8 * len(self.least) + 8, np.uint64)
        c[at] = self.flat
        for j in (1, 2, 4):
            c[:-j] = (c[:-j] << np.uint64(8 * j)) | c[j:]
        return c[at]

    def after(self, x: np.ndarray, j: int) -> np.ndarray:
        """Values j positions on; 0 after the fragment's end."""
        out = np.zeros(len(x), x.dtype)
        out[: max(len(x) - j, 0)] = x[j:]
        return np.where(self.left > j, out, 0)


def _ranged(src: int, key: np.ndarray, cuts: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """Rows for each range of keys, in the order of positions."""
    part = np.searchsorted(cuts, key, side="right")
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(len(cuts) + 2))
    return pd.DataFrame([{"part": p, "src": src, "data": _dump(**{k: v[order[a:z]] for k, v in columns.items()})} for p, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if z > a], columns=["part", "src", "data"])


def _back(df: pd.DataFrame, key: np.ndarray, cuts: np.ndarray, name: str, base: dict[int, int] | None = None) -> np.ndarray:
    """Answers to what _ranged() sent, at their positions."""
    order = np.argsort(np.searchsorted(cuts, key, side="right"), kind="stable")
    df = df.sort_values("part")
    got = [_load(d)[name].astype(np.int64) + (base[int(p)] if base else 0) for p, d in zip(df["part"], df["data"], strict=True)]
    out = np.zeros(len(key), got[0].dtype if got else np.int64)
    if got:
        out[order] = np.concatenate(got)
    return out


def _name(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorts triples and names them by rank, equal ones alike; ``n``: the number of names."""
    parts = [_load(d) for d in pdf["data"]]
    a, b, c = (np.concatenate([p[k] for p in parts]) for k in "abc")
    order = np.lexsort((c, b, a))
    new = np.concatenate(([False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return _answers(pdf, [len(p["a"]) for p in parts], int(new.sum()) + 1, name=_small(rank))


def _bases(names: DataFrame) -> dict[int, int]:
    """The first name of each range, from 1 on; there are about as many ranges as shuffle partitions."""
    base, total = {}, 1
    for part, n in sorted(names.groupBy("part").agg(F.max("n")).collect()):
        base[part], total = total, total + n
    return base


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the classes of a range into the order of suffixes; tells which strings a smaller id has."""
    parts = [_load(d) for d in pdf["data"]]
    x = {k: np.concatenate([p[k] for p in parts]) for k in ("c", "kind", "r", "r1", "r2", "h", "h2", "least")}
    x["h"] = x["h"].astype(np.uint64) << np.uint64(16) | x["h2"]
    x["c"] = x["c"].astype(np.uint64)
    # first byte and the name after it; first two bytes and the name after them
    one = (x["c"] >> np.uint64(8) << np.uint64(56)) | x["r1"].astype(np.uint64)
    two = (x["c"] << np.uint64(48)) | x["r2"].astype(np.uint64)
    own = [np.flatnonzero(x["kind"] == k) for k in range(3)]
    key = {0: (two, one), 1: (one, x["r"]), 2: (two, x["r"])}
    own = [i[np.lexsort([y[i] for y in key[k]])] for k, i in enumerate(own)]
    compare = {(0, 1): one, (0, 2): two, (1, 2): x["r"]}
    rank = np.zeros(len(x["c"]), np.int64)
    for k in range(3):
        rank[own[k]] = np.arange(len(own[k]))
        for m in range(3):
            if m != k:
                by = compare[min(k, m), max(k, m)]
                rank[own[k]] += np.searchsorted(by[own[m]], by[own[k]], side="left" if k < m else "right")
    # names tell suffixes apart by 72 bytes, so only suffixes that agree on more than LENGTH bytes can have one rank
    order = np.argsort(rank, kind="stable")
    same = x["h"][order][1:] == x["h"][order][:-1]
    run = np.concatenate(([0], np.cumsum(~same)))
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, x["least"][order])
    gone = np.empty(len(rank), bool)
    gone[order] = least[run] < x["least"][order]
    return _answers(pdf, [len(p["c"]) for p in parts], gone=gone)


def _sorted_strings(texts: DataFrame, scratch: Scratch, ranges: int) -> DataFrame:
    """(src, data): intervals of fragments whose strings a smaller id has, for the chunks that own them."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["text"]:
                c = _Fragments(blob).characters()
                some = c[mix(np.arange(len(c)).astype(np.uint64)) % np.uint64(max(1, len(c) // 256)) == 0] if len(c) else c
                yield pd.DataFrame({"c": some.view(np.int64)})

    # about 256 keys of each of as many texts as there are buckets
    keys = np.sort(np.array([r[0] for r in texts.mapInPandas(sample, "c long").collect()], np.int64).view(np.uint64))
    cuts = np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys

    def triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for src, blob in zip(batch["src"], batch["text"], strict=True):
                f = _Fragments(blob)
                c, i = f.characters(), np.flatnonzero(f.offset % 3 != 0)
                yield _ranged(src, c[i], cuts, a=c[i], b=f.after(c, 8)[i], c=f.after(c, 16)[i])

    names = scratch.put(texts.select("src", "text").mapInPandas(triples, _SENT).groupBy("part").applyInPandas(_name, _TOLD), "names")
    base = _bases(names)

    def named(f: _Fragments, c: np.ndarray, told: pd.DataFrame, base: dict[int, int]) -> np.ndarray:
        i, out = np.flatnonzero(f.offset % 3 != 0), np.zeros(len(c), np.int64)
        out[i] = _back(told, c[i], cuts, "name", base)
        return out

    def recurse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = _Fragments(left["text"].iloc[0])
        c, i = f.characters(), np.flatnonzero(f.offset % 3 != 0)
        n = named(f, c, right, base)
        # names are in the order of characters, so the same ranges part them
        return _ranged(int(left["src"].iloc[0]), c[i], cuts, a=_small(n[i]), b=_small(f.after(n, 24)[i]), c=_small(f.after(n, 48)[i]))

    pairs = lambda told: texts.select("src", "text").groupBy("src").cogroup(told.groupBy("src"))
    ranks = scratch.put(pairs(names).applyInPandas(recurse, _SENT).groupBy("part").applyInPandas(_name, _TOLD), "ranks")
    scratch.drop("names")
    base2 = _bases(ranks)

    def merged(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = _Fragments(left["text"].iloc[0])
        c = f.characters()
        r = named(f, c, right, base2)
        whole = np.flatnonzero(f.left >= LENGTH)
        prefix = prefix_hashes(f.flat)
        h = span_hashes(prefix, whole, whole + LENGTH)
        return _ranged(int(left["src"].iloc[0]), c[whole], cuts, c=(c[whole] >> np.uint64(48)).astype(np.uint16), kind=(f.offset % 3)[whole].astype(np.uint8), r=_small(r[whole]), r1=_small(f.after(r, 1)[whole]), r2=_small(f.after(r, 2)[whole]), h=(h >> np.uint64(32)).astype(np.uint32), h2=(h >> np.uint64(16)).astype(np.uint16), least=f.least[f.of[whole]])

    order = scratch.put(pairs(ranks).applyInPandas(merged, _SENT).groupBy("part").applyInPandas(_merge, _TOLD), "order")

    def owners(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = _Fragments(left["text"].iloc[0])
        whole = np.flatnonzero(f.left >= LENGTH)
        at = whole[_back(right, f.characters()[whole], cuts, "gone").astype(bool)]
        at_o, of = f.offset[at], f.of[at]
        new = np.concatenate(([True], (np.diff(of) > 0) | (np.diff(at_o) > LENGTH))) if len(at) else np.zeros(0, bool)
        s, o = at_o[new], of[new]
        e = (np.append(at_o[:-1][new[1:]], at_o[-1]) if len(at) else at_o) + LENGTH
        a, z = np.searchsorted(o, f.owner), np.searchsorted(o, f.owner, side="right")
        n = z - a
        pick = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        src, nth = np.repeat(f.o_src, n), np.repeat(f.o_nth, n)
        return pd.DataFrame([{"src": int(k), "data": _dump(nth=nth[src == k], s=s[pick][src == k], e=e[pick][src == k])} for k in np.unique(src)], columns=["src", "data"])

    return pairs(order).applyInPandas(owners, "src long, data binary")


def _finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    x = _load(left["text"].iloc[0])
    data, at, keys = x["data"], x["at"], x["keys"]
    own = _load(right.loc[right["kind"] == 0, "data"].iloc[0])
    s, e, of = own["s"], own["e"], own["of"].astype(np.int64)
    least = _told(right[right["kind"] == 1], "least").astype(np.int64)
    doc = np.searchsorted(at, s, side="right") - 1
    later = keys[doc] > least[of] if len(s) else np.zeros(0, bool)
    starts, ends = [own["run_s"], s[later]], [own["run_e"], e[later]]
    by = np.argsort(of, kind="stable")
    for d in right.loc[right["kind"] == 2, "data"]:
        w = _load(d)
        a, z = np.searchsorted(of[by], w["nth"]), np.searchsorted(of[by], w["nth"], side="right")
        n = z - a
        place = s[by[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        starts.append(place + np.repeat(w["s"], n))
        ends.append(place + np.repeat(w["e"], n))
    gone_s, gone_e = _union(np.concatenate(starts), np.concatenate(ends))
    first = np.searchsorted(gone_s, at)
    raw, out = data.tobytes(), []
    for i, (a, z) in enumerate(zip(at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True)):
        sha, here, removed = hashlib.sha256(), a, 0
        for p, q in zip(gone_s[first[i] : first[i + 1]].tolist(), gone_e[first[i] : first[i + 1]].tolist(), strict=True):
            sha.update(raw[here:p])
            here, removed = q, removed + q - p
        sha.update(raw[here:z])
        out.append((z - a, removed, int(first[i + 1] - first[i]), sha.hexdigest()))
    ids = pd.array(keys, dtype="Int64")
    ids[keys == NULL] = pd.NA
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=ids)


def earlier_strings_removed(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    scratch = Scratch(spark)
    chunks = scratch.put(_chunks(docs, id_col, text_col), "chunks")
    buckets = max(shuffle_width(spark), -(-chunks.count() * CHUNK_CHARS // BUCKET_CHARS))
    again = scratch.put(_repeated(chunks, buckets), "again")
    around = scratch.put(_surroundings(chunks, again, buckets), "around")
    cut = scratch.put(_fragments(chunks, again, around, buckets), "cut")
    scratch.drop("again"), scratch.drop("around")
    united = scratch.put(_unite(cut), "united")
    own = scratch.put(cut.where("part < 0"), "own")
    scratch.drop("cut")
    texts = united.where("text is not null")
    strings = scratch.put(_sorted_strings(texts, scratch, buckets), "strings")
    for name in ("ranks", "order"):
        scratch.drop(name)
    told = (
        own.select("src", "part", "data", F.lit(0).alias("kind"))
        .unionByName(united.where("text is null").select("src", "part", "data", F.lit(1).alias("kind")))
        .unionByName(strings.select("src", F.lit(0).alias("part"), "data", F.lit(2).alias("kind")))
    )
    done = chunks.groupBy("src").cogroup(told.groupBy("src")).applyInPandas(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_strings_removed(table(spark, sf_dir, "documents"), spark)
