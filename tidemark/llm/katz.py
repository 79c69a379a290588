"""Language-model scoring with a bigram Katz backoff model.

Counts are discounted after Good and Turing up to ``CUT``; what a history's discounts free is spread over the
words not seen after it in proportion to their unigram probability, with the weight that makes the history's
distribution sum to exactly one over the vocabulary and one unknown word. The unknown word has what unigram
discounting frees. A token is evaluated recursively: discounted bigram, else backoff weight times unigram.

Words are told apart by 64-bit hashes. Nothing is exploded to a row a token: texts are read once into chunks of
some megabytes (local vocabulary, token numbers), and all exchanges carry compressed arrays for a chunk and a bucket
of hashed keys.

1. Chunks send each distinct word's training count to the word's bucket; buckets write the unigram table, a
   partitioned table, and answer each chunk with total counts in the order of its words.
2. Chunks send each distinct bigram once, with its documents, to the bucket of its history. Buckets write the
   bigram table with the occurrences. Histories that make more than a thousandth of all tokens (so at most 1000)
   are dealt out by history and word, and their sums, one row a history and bucket, are added up apart.
3. Each bucket computes its bigrams' log probabilities and adds them up by document; chunks add up the buckets.

A hot word or word pair is thereby one entry for each chunk. The number of buckets grows with the tokens.

Defined results: a null text counts as empty, which has one token, the end; a null id counts as the empty text in
the split and is returned as null; repeated rows count and are scored each; without training rows every
probability is that of the unknown word, 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import dump_planes as _dump
from .arrays import load as _load
from .arrays import small as _small
from .common import Scratch, shuffle_width, table
from .textops import mix, slices, word_hashes

CUT = 5
CHUNK_CHARS, BUCKET_TOKENS = 11_000_000, 1_500_000
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A275)
NULL = np.iinfo(np.int64).min


def is_held_out(key: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus == remainder


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash's top 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def discounts(n_r: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to CUT from the numbers of n-grams seen 1 to CUT + 1 times; half a count where those fail."""
    d, r = np.ones(CUT + 1), np.arange(1, CUT + 1)
    n = np.asarray(n_r, float)
    with np.errstate(all="ignore"):
        common = (CUT + 1) * n[CUT] / n[0]
        d[1:] = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
    if not (np.all(d[1:] > 0) and np.all(d[1:] < 1)):
        d[1:] = (r - 0.5) / r
    return d


def _factor(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= CUT, d[np.minimum(c, CUT)], 1.0)


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows: chunk, n_train (training tokens), vocabulary and counts, and the tokens."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pd.DataFrame:
            nonlocal number
            keys = [k for part in held for k in part[0]]
            words = np.concatenate([part[1] for part in held])
            n_words = np.concatenate([part[2] for part in held])
            train = np.array([not is_held_out(k) for k in keys])
            vocabulary, token = np.unique(np.concatenate([words, [START, END]]), return_inverse=True)
            token, (s, e) = token[:-2], token[-2:]
            ends = np.cumsum(n_words)
            token = np.insert(token, ends, e)  # an end after each text
            in_train = np.repeat(train, n_words + 1)
            counts = np.bincount(token[in_train], minlength=len(vocabulary))
            row = {
                "chunk": (task << 32) + number, "n_train": int(in_train.sum()),
                "words": _dump(vocabulary=vocabulary, counts=_small(counts)),
                "tokens": _dump(start=np.array(s), keys=np.array([NULL if k is None else k for k in keys], np.int64), train=train, n=_small(n_words + 1), low=(token & 255).astype(np.uint8), mid=(token >> 8 & 255).astype(np.uint8), high=_small(token >> 16)),
            }
            number += 1
            held.clear()
            return pd.DataFrame([row])

        for batch in batches:
            for part in slices(batch, "t"):
                h, first = word_hashes(part["t"])
                held.append(([None if k is pd.NA else int(k) for k in part["k"].astype("Int64").array], h, np.diff(first)))
                size += int(part["t"].map(lambda t: len(t or "")).sum()) + 64 * len(part)
                if size >= CHUNK_CHARS:
                    yield chunk()
                    size = 0
        if held:
            yield chunk()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(of, "chunk long, n_train long, words binary, tokens binary")


def _count_words(chunks: DataFrame, buckets: int, hot_from: float) -> DataFrame:
    """kind 0: a chunk's total counts of one bucket; kind 1: a bucket of the unigram table with its sums."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = _load(row.words)
                v, c = x["vocabulary"], x["counts"]
                cut = np.searchsorted(_bucket(v, buckets), np.arange(buckets + 1))
                yield pd.DataFrame([{"bucket": b, "chunk": row.chunk, "data": _dump(v=v[a:z], c=c[a:z])} for b, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_load(d) for d in pdf["data"]]
        v = np.concatenate([p["v"] for p in parts])
        c = np.concatenate([p["c"].astype(np.int64) for p in parts])
        words, of = np.unique(v, return_inverse=True)
        total = np.bincount(of, c, len(words)).astype(np.int64)
        bucket, rows, at = int(pdf["bucket"].iloc[0]), [], 0
        for chunk, p in zip(pdf["chunk"], parts, strict=True):
            n = len(p["v"])
            rows.append({"kind": 0, "bucket": bucket, "chunk": chunk, "data": _dump(c=_small(total[of[at : at + n]]), step=_small(np.diff(of[at : at + n], prepend=0))), "n_r": None, "v": 0, "words": 0, "hot": None})
            at += n
        seen = total > 0
        rows.append({"kind": 1, "bucket": bucket, "chunk": -1, "data": _dump(word=words[seen], count=_small(total[seen])), "n_r": [int((total == r).sum()) for r in range(1, CUT + 2)], "v": int(seen.sum()), "words": len(words), "hot": np.flatnonzero((total > hot_from) | (words == START)).tolist()})
        return pd.DataFrame(rows)

    return chunks.select("chunk", "words").mapInPandas(send, "bucket int, chunk long, data binary").groupBy("bucket").applyInPandas(add, "kind int, bucket int, chunk long, data binary, n_r array<long>, v long, words long, hot array<long>")


class _Unigrams:
    def __init__(self, n: int, n_r: list[int], v: int):
        self.n, self.v, self.d = n, v, discounts(n_r)
        # what the discounts free; N - sum of d c over the vocabulary
        self.unknown = sum((1 - self.d[r]) * r * n_r[r - 1] for r in range(1, CUT + 1)) / n if n else 1.0
        self.scale = 1.0
        if n and not self.unknown:  # no counts small enough to discount: one count more, for the unknown word
            self.scale, self.unknown = n / (n + 1), 1 / (n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * _factor(self.d, c) * c / max(self.n, 1), self.unknown)


def _merge_bigrams(chunks: DataFrame, word_counts: DataFrame, buckets: int, uni: _Unigrams, base_id: dict[int, int], hot: np.ndarray) -> DataFrame:
    """bucket < 0: a chunk's documents with base scores; else a bucket of the bigram table with its occurrences."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        chunk = int(left["chunk"].iloc[0])
        right = right.sort_values("bucket")
        told = [_load(d) for d in right["data"]]
        total = np.concatenate([x["c"].astype(np.int64) for x in told])
        # words in numbers, ascending, as they are sorted by hash and so by bucket
        vocabulary = np.concatenate([base_id[int(b)] + np.cumsum(x["step"], dtype=np.int64) for b, x in zip(right["bucket"], told, strict=True)])
        t = _load(left["tokens"].iloc[0])
        token = t["low"].astype(np.int64) | t["mid"].astype(np.int64) << 8 | t["high"].astype(np.int64) << 16
        n, train, start = t["n"].astype(np.int64), t["train"], int(t["start"])
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        first = np.cumsum(n) - n
        del t
        c = total[token]
        base = np.bincount(doc, np.log10((c + 1) / (uni.n + uni.v + 1)), len(n))
        known = np.bincount(doc[c > 0], minlength=len(n))
        keys = _load(left["tokens"].iloc[0])["keys"]
        del c
        rows = [{"bucket": -1 - (chunk & 0x3FFFFFFF) % (1 << 30), "chunk": chunk, "data": _dump(keys=keys, train=train, n=n, known=known, base=base)}]
        history = np.empty_like(token)
        history[1:] = token[:-1]
        history[first] = start
        is_hot = np.isin(vocabulary, hot)
        spread = mix(vocabulary.astype(np.uint64))
        at = _bucket(np.where(is_hot[history], mix(spread[history] ^ vocabulary[token].astype(np.uint64)), spread[history]), buckets)
        size = len(vocabulary)
        key = (at * size + history) * size + token
        del at, history, token
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        del order
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(cut, len(key)))
        taught = np.add.reduceat(train[doc].astype(np.int64), cut)
        pair = key[cut]
        w, h, b = pair % size, pair // size % size, pair // size // size
        edge, occ = np.searchsorted(b, np.arange(buckets + 1)), np.append(cut, len(key))
        for k in range(buckets):
            a, z = edge[k], edge[k + 1]
            if z > a:
                hs, runs = np.unique(h[a:z], return_counts=True)
                ws, place = np.unique(w[a:z], return_inverse=True)
                rows.append({"bucket": k, "chunk": chunk, "data": _dump(h=_small(np.diff(vocabulary[hs], prepend=0)), runs=_small(runs), w=_small(np.diff(vocabulary[ws], prepend=0)), wc=_small(total[ws]), at=_small(place), many=_small(many[a:z]), taught=_small(taught[a:z]), doc=_small(doc[occ[a] : occ[z]]))})
        return pd.DataFrame(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return pd.DataFrame([{"bucket": -1, "chunk": c, "grams": None, "occurrences": d, "n_r": None, "hot_h": None, "hot_sums": None} for c, d in zip(pdf["chunk"], pdf["data"], strict=True)])
        parts = [_load(d) for d in pdf["data"]]
        h = np.concatenate([np.repeat(np.cumsum(p["h"], dtype=np.int64), p["runs"].astype(np.int64)) for p in parts])
        w = np.concatenate([np.cumsum(p["w"], dtype=np.int64)[p["at"]] for p in parts])
        wc = np.concatenate([p["wc"].astype(np.int64)[p["at"]] for p in parts])
        c = np.concatenate([p["taught"].astype(np.int64) for p in parts])
        order = np.lexsort((w, h)).astype(np.uint32)
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        one = order[new]
        h, w, wc, c = h[one], w[one], wc[one], np.bincount(gram, c, len(one)).astype(np.int64)
        ends = np.cumsum([len(p["many"]) for p in parts])
        occ = {}
        for i, (chunk, p, e) in enumerate(zip(pdf["chunk"], parts, ends, strict=True)):
            occ |= {f"c{i}": np.array(chunk), f"g{i}": _small(np.diff(gram[e - len(p["many"]) : e], prepend=0)), f"m{i}": p["many"], f"d{i}": p["doc"]}
        hs, runs = np.unique(h, return_counts=True)
        is_hot = np.flatnonzero(np.isin(hs, hot))
        of = np.repeat(np.arange(len(hs)), runs)
        sums = np.column_stack([np.bincount(of, c, len(hs)), np.bincount(of, np.where(c > 0, uni.p(wc), 0.0), len(hs)), *(np.bincount(of[c == r], minlength=len(hs)) for r in range(1, CUT + 1))])
        return pd.DataFrame([{"bucket": bucket, "chunk": -1, "grams": _dump(h=hs, runs=_small(runs), w=_small(w), wc=_small(wc), c=_small(c)), "occurrences": _dump(**occ), "n_r": [int((c == r).sum()) for r in range(1, CUT + 2)], "hot_h": hs[is_hot].tolist(), "hot_sums": sums[is_hot].ravel().tolist()}])

    told = word_counts.where("kind = 0").select("chunk", "bucket", "data")
    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(send, "bucket int, chunk long, data binary")
    return sent.groupBy("bucket").applyInPandas(merge, "bucket int, chunk long, grams binary, occurrences binary, n_r array<long>, hot_h array<long>, hot_sums array<double>")


def gram_log10(h_of: np.ndarray, wc: np.ndarray, c: np.ndarray, sums: np.ndarray, uni: _Unigrams, d: np.ndarray) -> np.ndarray:
    """log10 P(w | h) for bigrams; ``sums`` of each history: count, unigram mass of seen words, bigrams seen 1 to CUT times."""
    total, mass, low = sums[:, 0], sums[:, 1], sums[:, 2:]
    freed = (low * ((1 - d[1:]) * np.arange(1, CUT + 1))).sum(axis=1)
    stuck = (total > 0) & (freed <= 0)  # nothing to discount: one count more, for the words not seen
    whole = total + stuck
    left = np.where(stuck, 1.0, freed) / np.maximum(whole, 1)
    alpha = np.where(total > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    factor = np.where(stuck[h_of], 1.0, _factor(d, c))
    return np.log10(np.where(c > 0, factor * c / np.maximum(whole[h_of], 1), alpha[h_of] * uni.p(wc)))


def katz_scores(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    scratch = Scratch(spark)
    chunks = scratch.put(_chunks(docs, id_col, text_col), "chunks")
    tokens = scratch.put(chunks.select("chunk", "tokens"), "tokens")
    n = chunks.agg(F.sum("n_train")).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-n // BUCKET_TOKENS))
    word_counts = scratch.put(_count_words(chunks, buckets, n / 1000), "unigrams", ["kind"])
    scratch.drop("chunks")
    stats = word_counts.where("kind = 1").agg(F.sum("v").alias("v"), *(F.sum(F.col("n_r")[r]).alias(f"n{r}") for r in range(CUT + 1))).first()
    uni = _Unigrams(n, [stats[f"n{r}"] or 0 for r in range(CUT + 1)], stats["v"] or 0)
    table_ = word_counts.where("kind = 1")
    base_id, total = {}, 0
    for bucket, words in sorted(table_.select("bucket", "words").collect()):  # a number for each bucket
        base_id[bucket], total = total, total + words
    # at most 1000 words make more than a thousandth each; and the start, which is no token
    hot = np.array([base_id[b] + i for b, i in table_.select("bucket", F.explode("hot")).collect()], np.int64)
    merged = scratch.put(_merge_bigrams(tokens, word_counts, buckets, uni, base_id, hot), "bigrams")
    scratch.drop("tokens")
    grams = merged.where("bucket >= 0")
    n2 = grams.agg(*(F.sum(F.col("n_r")[r]).alias(f"n{r}") for r in range(CUT + 1))).first()
    d = discounts([n2[f"n{r}"] or 0 for r in range(CUT + 1)])
    width = CUT + 2
    parts = grams.select(F.posexplode("hot_h").alias("i", "h"), "hot_sums").select("h", F.slice("hot_sums", F.col("i") * width + 1, width).alias("s"))
    sums = {r["h"]: [r[f"s{k}"] for k in range(width)] for r in parts.groupBy("h").agg(*(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width))).collect()}
    hot_h = np.sort(np.array(list(sums), np.int64))
    hot_sums = np.array([sums[int(h)] for h in hot_h]).reshape(-1, width)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                g, o = _load(row.grams), _load(row.occurrences)
                h, runs, c, wc = g["h"], g["runs"].astype(np.int64), g["c"].astype(np.int64), g["wc"].astype(np.int64)
                of = np.repeat(np.arange(len(h)), runs)
                own = np.column_stack([np.bincount(of, c, len(h)), np.bincount(of, np.where(c > 0, uni.p(wc), 0.0), len(h)), *(np.bincount(of[c == r], minlength=len(h)) for r in range(1, CUT + 1))]).astype(float)
                if len(hot_h):
                    at = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                    is_hot = hot_h[at] == h
                    own[is_hot] = hot_sums[at[is_hot]]
                logs = gram_log10(of, wc, c, own, uni, d)
                out = []
                for i in range(sum(k[0] == "c" for k in o)):
                    doc = o[f"d{i}"].astype(np.int64)
                    out.append({"chunk": int(o[f"c{i}"]), "part": _dump(s=np.bincount(doc, np.repeat(logs[np.cumsum(o[f"g{i}"], dtype=np.int64)], o[f"m{i}"].astype(np.int64))))})
                yield pd.DataFrame(out)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in left["occurrences"]:
            x = _load(data)
            total = np.zeros(len(x["keys"]))
            for p in right["part"]:
                s = _load(p)["s"]
                total[: len(s)] += s
            ids = pd.array(x["keys"], dtype="Int64")
            ids[x["keys"] == NULL] = pd.NA
            rows.append(pd.DataFrame({"doc_id": ids, "held_out": ~x["train"], "n_tokens": x["n"], "n_known": x["known"], "train_tokens": n, "base_score": x["base"], "score": total}))
        return pd.concat(rows) if rows else pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    partial = grams.select("grams", "occurrences").mapInPandas(score, "chunk long, part binary")
    bases = merged.where("bucket < 0").select("chunk", "occurrences")
    return bases.groupBy("chunk").cogroup(partial.groupBy("chunk")).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), spark)
