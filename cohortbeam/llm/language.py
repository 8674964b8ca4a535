"""Language of web pages by Bayesian evidence fusion.

Text: a naive Bayes model over hashed byte trigrams, with counts from all
documents of known language. Markup: P(declared language | language), estimated
from all pages' text posteriors. Address: a prior smoothed down a hierarchy,
all pages -> address suffix -> domain -> host, from grouped sums of the pages'
posteriors; each level adds ``strength`` pseudo-counts of the level above, and
a page's own posterior is left out of its sums. The posterior multiplies all
three.

The model has 65,536 x languages numbers, the markup table languages x
(languages + 2): both reach the driver whatever the corpus. Host sums are
grouped and joined back with the hot host's pages dealt over copies.

A page without words has flat text evidence, one without a lang attribute the
markup class ``none``, one without a host the prior of all pages. Null pages
ids stay, repeated rows are pages of their own, an empty table gives an empty
result, and without any training text all text evidence is flat. Extra columns
are ignored.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .address import host_and_path, salted_join
from .common import stored
from .html_blocks import decoded

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 16
HIDDEN = re.compile(r"(?i)<(script|style|noscript|template)\b|<!--")
ENDS = {None: re.compile("-->"), **{n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "noscript", "template")}}
TAG = re.compile(r"(?s)<[^>]*>")
PIECE = 1 << 20
DECLARED = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})"


def visible_text(page: str | None) -> str:
    """The page without hidden elements, comments and tags; a hidden element or
    comment that never ends stays. Linear in the page, however broken it is."""
    page, parts, at, begin, endless = page or "", [], 0, 0, set()
    while m := HIDDEN.search(page, begin):
        name = m[1] and m[1].lower()
        end = None if name in endless else ENDS[name].search(page, m.end())
        if end is None:
            endless.add(name)  # no later one ends either
            begin = m.end()
        else:
            parts.append(page[at:m.start()])
            at = begin = end.end()
    page = " ".join([*parts, page[at:]])
    last = page.rfind(">") + 1  # behind it no tag ends
    return decoded(TAG.sub(" ", page[:last]) + page[last:])


def trigram_counts(text: str) -> np.ndarray:
    """Counts by bucket of all byte trigrams of the lower-cased text."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, max(len(raw) - 2, 0), PIECE):
        x = raw[i:i + PIECE + 2].astype(np.uint32)
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> 16, minlength=BUCKETS)
    return counts


def train(docs: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """log P(bucket | language), from every document of a listed language."""
    def run(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for b in batches:
            for i, lang in enumerate(languages):
                held, size = [], 0
                for t in b.text[b.lang == lang]:
                    held.append(t)
                    size += len(t)
                    if size > PIECE:
                        total[i] += trigram_counts(" ".join(held))
                        held, size = [], 0
                total[i] += trigram_counts(" ".join(held))
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    rows = docs.where(F.col("lang").isin(*languages) & F.col("text").isNotNull()).select("lang", "text")
    sums = rows.mapInPandas(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), BUCKETS), 0.1)
    counts[sums.lang, sums.bucket] += sums.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _sums(array: str, n: int) -> list[Column]:
    return [F.sum(F.col(array)[i]).alias(f"s{i}") for i in range(n)]


def _softmax(logs: Column) -> Column:
    return F.transform(F.array(logs), lambda x: F.transform(F.array(F.transform(
        x, lambda v: F.exp(v - F.array_max(x)))), lambda e: F.transform(
            e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0])[0]


def page_evidence(pages: DataFrame, model: np.ndarray, languages=LANGUAGES) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text_ll): text_ll holds the log
    likelihoods; trigrams overlap threefold, so a third of them is evidence."""
    given = pages.sparkSession.sparkContext.broadcast(model)  # 65,536 x languages numbers

    def run(batches):
        logs = given.value
        for b in batches:
            ll = []
            for page in b.html:
                counts = trigram_counts(visible_text(page))
                at = np.flatnonzero(counts)
                ll.append((logs[:, at].astype(np.float64) @ counts[at] / 3).tolist())
            yield b.drop(columns="html").assign(page_id=b.page_id.astype("Int64"), text_ll=pd.Series(ll, dtype=object))

    host, _ = host_and_path("url")
    host = F.regexp_replace(host, r"^[^@]*@|:\d*$", "")
    found = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1))
    declared = F.when(found == "", "none").when(found.isin(*languages), found).otherwise("other")
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), declared.alias("declared"),
                        F.col("html").cast("string"))
    rows = rows.select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"),
                       F.substring_index("host", ".", -1).alias("suffix"), "declared", "html")
    return rows.mapInPandas(run, "page_id long, host string, domain string, suffix string, declared string, "
                                 "text_ll array<double>")


def identify(pages: DataFrame, docs: DataFrame, languages=LANGUAGES, strength: float = 10.0) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host)."""
    n = len(languages)
    evidence = stored(page_evidence(pages, train(docs, languages), languages), "language-evidence")
    text = evidence.withColumn("p", _softmax(F.col("text_ll")))
    # P(declared | language) and P(language), from text posteriors, add-one smoothed
    classes = (*languages, "none", "other")
    seen = {r.declared: [r[f"s{i}"] for i in range(n)] for r in text.groupBy("declared").agg(*_sums("p", n)).collect()}
    table = np.array([seen.get(c, [0.0] * n) for c in classes]) + 1.0
    given = np.log(table / table.sum(axis=0))
    overall = table.sum(axis=0) / table.sum()
    markup = F.create_map(*[x for i, c in enumerate(classes) for x in (
        F.lit(c), F.array(*[F.lit(float(v)) for v in given[i]]))])
    page_ll = F.zip_with("text_ll", markup[F.col("declared")], lambda a, b: a + b)
    whole = F.array(*[F.lit(float(v)) for v in overall])
    rows = evidence.withColumn("ll", page_ll).withColumn(
        "own", _softmax(F.zip_with("ll", F.transform(whole, lambda v: F.log(v)), lambda a, b: a + b)))
    rows = stored(rows, "language-rows")
    level = [F.col(f"s{i}") for i in range(n)]
    named = rows.where("host <> ''")
    hosts = named.groupBy("host", "domain", "suffix").agg(*_sums("own", n))
    hosts = stored(hosts.select("host", "domain", "suffix", F.array(*level).alias("host_n")), "language-hosts")
    domains = hosts.groupBy("domain").agg(*_sums("host_n", n)).select("domain", F.array(*level).alias("domain_n"))
    suffixes = hosts.groupBy("suffix").agg(*_sums("host_n", n)).select("suffix", F.array(*level).alias("suffix_n"))
    sums = stored(hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "host_n", "domain_n", "suffix_n"),
                  "language-sums")
    met = salted_join(rows, sums, "host", F.struct("page_id", "text_ll"))
    prior = whole
    for counts in ("suffix_n", "domain_n", "host_n"):  # each level, without the page itself, on top of the one above
        others = F.zip_with(counts, "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        met = met.withColumn(f"{counts}_prior", F.when(F.col(counts).isNull(), prior).otherwise(
            F.transform(F.array(others), lambda o: F.zip_with(o, prior, lambda c, p: (c + strength * p) / (
                F.aggregate(o, F.lit(0.0), lambda a, b: a + b) + strength)))[0]))
        prior = F.col(f"{counts}_prior")
    met = met.withColumn("posterior", _softmax(F.zip_with("ll", F.transform(prior, lambda v: F.log(v)),
                                                          lambda a, b: a + b)))
    names = F.array(*[F.lit(x) for x in languages])

    def best(array: str) -> Column:
        return F.element_at(names, F.array_position(array, F.array_max(array)).cast("int"))

    return met.select("page_id", best("posterior").alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"),
                      best("text_ll").alias("text_lang"), "declared", "host")
