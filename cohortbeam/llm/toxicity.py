"""Toxicity: a logistic classifier regularised by counterfactual swaps.

Features of a text are its distinct words and word beginnings (3 to 6 letters).
Training uses a bounded sample of labelled rows (``max_rows``, spread by a hash
of the id) and the features that separate its classes best. Beside the usual
loss, every identity term in a labelled sentence is swapped for the other terms
of its group and for a neutral word; the squared change of the score is
penalised, so that naming a group neither raises nor lowers a score by itself.
Only the text is an input of a score.

The sample's features are gathered in parallel; one task fits the bounded
sample, and the fitted weights (``max_features`` at most) are broadcast.

Null and empty texts score by the intercept alone. Repeated ids among labels:
each row counts. Without both classes among the labelled rows every score is 0.
Null ids are held out. An empty table gives an empty result; extra columns are
ignored. Documents that stand several times give one text to the sample, so it
never exceeds its bound.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

# Identity terms by group; each is swapped within its group and for NEUTRAL.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("mexican", "chinese", "american", "indian", "german", "french"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
)
NEUTRAL = "person"
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?\n])\s+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in range(3, 7) if len(word) >= n))


def text_features(words) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swaps() -> dict[str, tuple[str, ...]]:
    return {t: (*(o for o in group if o != t), NEUTRAL) for group in IDENTITY_GROUPS for t in group}


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(label, words, identity): distinct words of at most max_rows labelled
    texts, and the words of each sentence with an identity term. A document that
    stands several times gives one text, the least."""
    picked = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0")
              .select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))  # the stated bound
    terms = swaps()

    def run(batches):
        for b in batches:
            words, sentences = [], []
            for text in b.text:
                words.append(sorted(set(WORD.findall((text or "").lower()))))
                found = []
                for s in SENTENCE_END.split((text or "").lower()):
                    in_s = set(WORD.findall(s))
                    if in_s & terms.keys():
                        found.append(" ".join(sorted(in_s)))
                sentences.append(found)
            yield pd.DataFrame({"doc_id": b.doc_id, "words": words, "identity": sentences})

    picked = stored(picked, "toxicity-picked")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")  # max_rows ids at most
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = texts.mapInPandas(run, "doc_id long, words array<string>, identity array<string>")
    return found.join(F.broadcast(picked), "doc_id").select("label", "words", "identity")  # one row a label: max_rows at most


def fit(labels: np.ndarray, word_sets: list, identity: list, max_features: int, swap_weight: float = 1.0,
        decay: float = 3e-4, steps: int = 400) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept (full-batch descent)."""
    pos, n = int(labels.sum()), len(labels)
    if pos in (0, n):
        return {}, float("-inf")
    seen: dict[str, list[int]] = {}
    for y, words in zip(labels.tolist(), word_sets):
        for f in text_features(words):
            seen.setdefault(f, [0, 0])[y] += 1
    terms = swaps()
    names = np.array([f for f, c in seen.items() if sum(c) >= 3])
    counts = np.array([seen[f] for f in names], dtype=np.float64).reshape(-1, 2)
    p1, p0 = (counts[:, 1] + 0.5) / (pos + 1), (counts[:, 0] + 0.5) / (n - pos + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / pos + p0 * (1 - p0) / (n - pos) + 1e-12)
    best = np.lexsort((names, -np.abs(z)))[:max_features]
    best = best[np.abs(z[best]) >= 3]
    chosen = {f: i for i, f in enumerate(names[best].tolist())}
    # Counterfactual pairs: features that a swap takes out (-1) or brings in (+1).
    pair_row, pair_col, pair_val, pairs = [], [], [], 0
    for sentences in identity:
        for s in sentences:
            words = set(s.split())
            before = text_features(words)
            for t in words & terms.keys():
                for other in terms[t]:
                    after = text_features((words - {t}) | {other})
                    change = [(chosen[f], 1.0) for f in after - before if f in chosen]
                    change += [(chosen[f], -1.0) for f in before - after if f in chosen]
                    if change:
                        pair_row += [pairs] * len(change)
                        pair_col += [c for c, _ in change]
                        pair_val += [v for _, v in change]
                        pairs += 1
    rows, cols = [], []
    for i, words in enumerate(word_sets):
        hit = [chosen[f] for f in text_features(words) if f in chosen]
        rows += [i] * len(hit)
        cols += hit
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    pair_row, pair_col = np.array(pair_row, dtype=np.int64), np.array(pair_col, dtype=np.int64)
    pair_val = np.array(pair_val)
    w, bias, k = np.zeros(len(chosen)), np.log(pos / (n - pos)), max(len(chosen), 1)
    y, grads, grad_b = labels.astype(np.float64), np.full(len(chosen), 1e-8), 1e-8
    balance = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    for _ in range(steps):
        margin = bias + np.bincount(rows, weights=w[cols], minlength=n)
        err = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        g = np.bincount(cols, weights=err[rows], minlength=k)[:len(chosen)] + decay * w
        if pairs:
            delta = np.bincount(pair_row, weights=pair_val * w[pair_col], minlength=pairs)
            g += swap_weight * np.bincount(pair_col, weights=2 * delta[pair_row] * pair_val / pairs,
                                           minlength=k)[:len(chosen)]
        grads += g * g
        grad_b += err.sum() ** 2
        w -= 0.5 * g / np.sqrt(grads)
        bias -= 0.5 * err.sum() / np.sqrt(grad_b)
    return {f: float(w[i]) for f, i in chosen.items() if abs(w[i]) > 1e-4}, float(bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 4096,
          swap_weight: float = 1.0) -> tuple[dict[str, float], float]:
    """The fitted weights and intercept, from at most ``max_rows`` labelled rows."""
    sample = stored(training_rows(docs, labels, max_rows), "toxicity-sample")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, bias = fit(pdf.label.to_numpy(), pdf.words.tolist(), pdf.identity.tolist(), max_features, swap_weight)
        return pd.DataFrame({"feature": [None, *weights], "weight": [bias, *weights.values()]})

    rows = (sample.withColumn("model", F.lit(1)).groupBy("model")  # the bounded sample, in one task
            .applyInPandas(lambda pdf: one(pdf), "feature string, weight double").collect())
    weights = {r.feature: r.weight for r in rows if r.feature is not None}
    return weights, next((r.weight for r in rows if r.feature is None), float("-inf"))


def score(docs: DataFrame, model: tuple[dict[str, float], float], out: str = "toxicity") -> DataFrame:
    """docs plus column ``out`` (0 to 1, higher: likelier toxic), in place of one
    of that name; all others pass through unchanged."""
    column, docs = out, docs.drop(out)
    given = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights at most

    def run(batches):
        weights, bias = given.value
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                hit: set[str] = set()
                for w in set(WORD.findall((text or "").lower())):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 500_000:
                            known.clear()
                        f = known[w] = tuple(x for x in word_features(w) if x in weights)
                    if f:
                        hit.update(f)
                margin = bias + sum(weights[f] for f in sorted(hit))
                out.append(0.0 if margin < -700 else 1 / (1 + math.exp(-margin)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())],
                                             names=[*b.schema.names, column])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(
        run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels, **options))
    return rows.select("doc_id", F.coalesce(F.expr("pmod(crc32(CAST(doc_id AS STRING)), 5) = 0"), F.lit(True))
                       .alias("held_out"), F.col("toxicity").alias("score"),
                       F.expr("CAST(toxicity >= 0.5 AS INT)").alias("predicted"))
