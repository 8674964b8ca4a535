"""Language ID: accuracy, and each evidence deciding when the others are silent."""
import math
import random
import time

import numpy as np

from cohortbeam.llm import language, queries


def test_pages_agree_with_their_section(spark, sf):
    rows = queries.QUERIES["op1_language"](spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    want = [r.lang == pages[r.page_id].url.split("://")[1].split("/")[1] for r in rows]
    assert np.mean(want) >= 0.97


def test_text_markup_and_host_each_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.lang: r.text for r in docs.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").collect()}

    def page(lang, body):
        return f'<!doctype html><HTML class=x lang="{lang}-XX"><script>var x="{text["de"]}"</script><p>{body}</p>'
    rows = [(i, "https://www.seite.example.de/x", page("de", text["de"])) for i in range(30)]
    rows += [(100 + i, "https://www.site.example.com/x", page("en", text["en"])) for i in range(30)]
    rows += [(200, "https://www.site.example.com/x", page("de", text["fr"])),  # text outweighs markup and host
             (201, "https://www.site.example.com/y", page("de", "")),          # markup outweighs the host here
             (202, "https://www.seite.example.de/z", ""),                      # the host alone
             (203, "https://new.other.de/z", None),                            # the suffix alone
             (204, None, None), (None, "nonsense", "<html lang=tlh>"), (202, "https://www.seite.example.de/z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS host", "'x' AS declared", "'x' AS p", "'x' AS ll")
    got = language.identify(pages, docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[0].lang == "de" and by[100].lang == "en" and by[200].lang == "fr"
    assert by[202].lang == "de" and by[203].lang == "de" and by[201].declared == "de"
    assert by[None].declared == "other" and by[204].declared == "none"
    assert all(0.25 <= r.confidence <= 1 for r in got)


def test_empty_tables(spark, sf, no_docs):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(none, no_docs).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert language.identify(pages, no_docs).count() == pages.count()


def test_trigram_counts_cross_pieces(monkeypatch):
    text = "abc déf " * 50
    whole = language.trigram_counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.trigram_counts(text) == whole).all()
    assert whole.sum() == len(" ".join(text.split()).encode()) - 2


def plain_posteriors(pages, docs, strength=10.0):
    """{page_id: (language, confidence)} in plain Python, from (page_id, host, declared, text) and (lang, text)."""
    langs = language.LANGUAGES

    def trigrams(text):
        raw = " ".join(text.lower().split()).encode()
        out = {}
        for i in range(len(raw) - 2):
            b = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2 ** 32) >> 16
            out[b] = out.get(b, 0) + 1
        return out

    counts = {g: {} for g in langs}
    for lang, text in docs:
        for b, n in trigrams(text).items():
            counts[lang][b] = counts[lang].get(b, 0) + n
    total = {g: sum(counts[g].values()) + 0.1 * 65536 for g in langs}

    def softmax(ll):
        e = [math.exp(x - max(ll)) for x in ll]
        return [x / sum(e) for x in e]

    def plus(rows):
        return [sum(x) for x in zip(*rows)] if rows else [0.0] * len(langs)

    ll = {i: [sum(n * math.log((counts[g].get(b, 0) + 0.1) / total[g]) for b, n in trigrams(text).items()) / 3 for g in langs]
          for i, _, _, text in pages}
    text_p = {i: softmax(x) for i, x in ll.items()}
    classes = (*langs, "none", "other")
    table = {c: [x + 1 for x in plus([text_p[i] for i, _, d, _ in pages if d == c])] for c in classes}
    column = [sum(table[c][k] for c in classes) for k in range(len(langs))]
    overall = [c / sum(column) for c in column]
    both = {i: [x + math.log(table[d][k] / column[k]) for k, x in enumerate(ll[i])] for i, _, d, _ in pages}
    own = {i: softmax([x + math.log(o) for x, o in zip(both[i], overall)]) for i in both}
    out = {}
    for i, host, _, _ in pages:
        prior = overall
        for parts in (1, 2, 99):
            level = ".".join(host.split(".")[-parts:])
            same = [own[j] for j, h, _, _ in pages if ".".join(h.split(".")[-parts:]) == level and j != i]
            n = plus(same)
            prior = [(c + strength * p) / (sum(n) + strength) for c, p in zip(n, prior)]
        p = softmax([x + math.log(q) for x, q in zip(both[i], prior)])
        out[i] = langs[p.index(max(p))], max(p)
    return out


def test_posteriors_equal_plain_python(spark, sf):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.lang in language.LANGUAGES and r.text]
    rng = random.Random(1)
    pages, rows = [], []
    for i in range(120):  # short texts: all evidence counts
        words = rng.choice(docs)[1].split()[:rng.choice([0, 1, 2, 6])]
        host, declared = rng.choice(["a.x.de", "b.x.de", "c.y.de", "www.z.com"]), rng.choice([*language.LANGUAGES, "none", "other"])
        mark = {"none": "", "other": " lang=tlh"}.get(declared, f" lang='{declared}-AT'")
        text = " ".join(w for w in words if "<" not in w and "&" not in w)
        pages.append((i, host, declared, text))
        rows.append((i, f"https://{host}/p", f"<html{mark}><script>zzz zzz</script>{text}<!-- zzz -->"))
    want = plain_posteriors(pages, docs)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language.identify(df, spark.createDataFrame(docs, "lang string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.confidence - want[r.page_id][1]) < 1e-3
        assert r.lang == want[r.page_id][0] or r.confidence < 0.5


def test_broken_pages_are_read_in_linear_time(spark):
    n = 1_000_000
    texts = [p * (n // len(p)) for p in ("<script>", "<!--", "<", "<style", "<html", "<html lang", "&#99", "<!-- -->", "<script></script", "</")]
    began = time.time()
    seen = [language.visible_text(t) for t in texts]
    assert time.time() - began < 20 and not seen[7].strip()
    assert language.visible_text("a<script>b</SCRIPT >c<!-- d -->e<style>f") == "a c e f"
    df = spark.createDataFrame([(i, "https://h.de/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    began = time.time()
    assert language.page_evidence(df, np.zeros((4, language.BUCKETS), dtype=np.float32)).count() == len(texts)
    assert time.time() - began < 60
