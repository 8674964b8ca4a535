"""Toxicity: held-out accuracy, counterfactual swaps, edge rows."""
import inspect
import random
import zlib

import numpy as np

from cohortbeam.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    order = np.argsort(np.argsort(s))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    y = held.toxic.to_numpy()
    assert auc(y, held.score.to_numpy()) > 0.95
    assert held.predicted[y == 1].mean() > 0.9 and held.predicted[y == 0].mean() < 0.02


def test_swaps_make_group_mentions_neutral():
    rng = random.Random(0)
    base = "the report about weather roads music trains books food market".split()
    sets, identity, labels = [], [], []
    for i in range(600):
        words = set(rng.sample(base, 5))
        toxic = i % 4 == 0
        if toxic:
            words.add(rng.choice(["vermin", "idiots"]))
        if rng.random() < (0.8 if toxic else 0.05):  # the term is confounded with the label
            words.add("muslims")
        sets.append(sorted(words))
        identity.append([" ".join(sorted(words))] if "muslims" in words else [])
        labels.append(int(toxic))

    def mention(weight):
        w, bias = toxicity.fit(np.array(labels), sets, identity, 4096, swap_weight=weight)
        def margin(words):
            return bias + sum(w.get(f, 0) for f in toxicity.text_features(words))
        return margin(base[:5] + ["muslims"]) - margin(base[:5]), margin(base[:5] + ["vermin"])
    plain, with_swaps = mention(0.0), mention(10.0)
    assert plain[0] > 0.6 and abs(with_swaps[0]) < 0.25 * plain[0]
    assert with_swaps[1] > 0


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4, 5)] + [(None, 1, 1), (4, None, None)], LABELS)
    got = toxicity.scored(awkward, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    scores = {r.doc_id: r.score for r in got}
    assert scores[0] == scores[1] == scores[2]
    none = toxicity.scored(awkward, labels.where("false")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.scored(no_docs, labels).count() == 0
    assert toxicity.score(awkward, ({}, 0.0)).columns == [*awkward.columns, "toxicity"]


def test_the_sample_keeps_its_bound_with_repeated_documents(spark):
    """A third of all rows are one document: it gives one text."""
    rows = [(i, f"text {i} is vermin" if i % 2 else f"text {i} is fine", "en", "s", 9) for i in range(60)]
    rows += [(1, "text 1 is vermin", "en", "s", 9)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(1, 1, 1)], LABELS)
    for bound in (10, 1000):
        sample = toxicity.training_rows(docs, labels, bound).collect()
        usable = sum(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in labels.collect())
        assert len(sample) == min(bound, usable)


def test_swaps_at_the_shipped_weight_on_held_out_rows():
    """Neutral mentions of a group among held-out texts: fewer false positives with the weight that ``train`` uses."""
    rng = random.Random(5)
    base = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]

    def draw(toxic, named):
        words = set(rng.sample(base, 6)) | ({rng.choice(["vermin", "idiots", "scum"])} if toxic and rng.random() < 0.7 else set())
        return sorted(words | ({rng.choice(["muslims", "jews", "women"])} if named else set()))

    sets, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        sets.append(draw(toxic, rng.random() < (0.85 if toxic else 0.04)))
        labels.append(int(toxic))
    terms = toxicity.swaps()
    identity = [[" ".join(s)] if set(s) & terms.keys() else [] for s in sets]
    shipped = inspect.signature(toxicity.train).parameters["swap_weight"].default
    neutral, toxic = [draw(False, True) for _ in range(400)], [draw(True, False) for _ in range(400)]

    def rates(weight):
        w, bias = toxicity.fit(np.array(labels), sets, identity, 4096, swap_weight=weight)
        hit = [[bias + sum(w.get(f, 0) for f in toxicity.text_features(s)) >= 0 for s in part] for part in (neutral, toxic)]
        return np.mean(hit[0]), np.mean(hit[1])
    (plain_fp, plain_recall), (fp, recall) = rates(0.0), rates(shipped)
    assert plain_fp > 0.5 and fp < 0.5 * plain_fp and recall > plain_recall - 0.1
