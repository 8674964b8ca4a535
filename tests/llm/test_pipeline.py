"""The pipeline, stage by stage, against brute-force versions of its parts."""
import public_tokenizers

import corpus_pipeline
from cohortbeam.llm import packing, simhash, toxicity
from cohortbeam.llm.common import stored, table
from llm.test_decontaminate import brute as brute_hits
from llm.test_line_dedup import brute as brute_lines
from llm.test_packing import check_pieces
from llm.test_simhash import brute_fingerprint, brute_groups


def test_stages(spark, sf):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = table(spark, sf, "documents")

    def rows(df):
        return sorted(map(tuple, df.collect()))
    kept = stored(stage["toxicity"](spark, docs, sf), "t")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert kept.columns == docs.columns and rows(kept) == [r for r in rows(docs) if scores[r[0]] < 0.5]

    before = rows(kept)
    lines = stored(stage["line_dedup"](spark, kept, sf), "t")
    cut = brute_lines([r[1] for r in before], 2)
    want = [(r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]) for r, t in zip(before, cut)
            if t or not r[1]]
    assert rows(lines) == want

    groups = brute_groups([brute_fingerprint(r[1]) for r in want])
    single = stored(stage["near_duplicates"](spark, lines, sf), "t")
    want = [r for i, r in enumerate(want) if groups[i] == i]
    assert rows(single) == want

    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    hits = brute_hits([r[1] for r in want], items)
    clean = stored(stage["decontamination"](spark, single, sf), "t")
    want = [r for r, h in zip(want, hits) if not h[4]]
    assert rows(clean) == want

    pieces = stage["packing"](spark, clean, sf).toPandas()
    check_pieces(pieces, {r[0]: r[1] for r in want}, packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))[0])
    whole = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert set(whole.doc_id) == {r[0] for r in want} and whole.length.sum() == pieces.length.sum()
    assert whole[key[:1]].drop_duplicates().shape == pieces[key[:1]].drop_duplicates().shape


def test_awkward_rows(spark, sf, awkward, no_docs):
    for docs in (awkward.select(*no_docs.columns), no_docs):
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = stored(f(spark, docs, sf), "t")
            assert docs.columns == no_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 0


def test_near_duplicate_stage_with_missing_ids(spark, no_docs):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (7, "a b c", "en", "s", 5),
                                  (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5)], no_docs.schema)
    kept = simhash.one_of_each_group(docs).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, "a b c"), (True, "x y z")]


def test_columns_with_the_names_of_the_operators_own(spark, sf, awkward):
    """Every stage gives back the columns it was given, with their values."""
    names = ("gone", "row_key", "key", "toxicity", "n_lines", "n_deleted", "runs", "_kept_1", "root", "best")
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])
    docs = stored(docs, "t")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = stored(f(spark, docs, sf), "t")
        assert out.columns == docs.columns, name
        rows = out.where("doc_id IS NOT NULL").collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
