"""Pseudonyms: validity, linkage, permutation, and a Feistel network in plain Python."""
import datetime
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from cohortbeam.llm import pii, queries
from llm.conftest import make_docs


def feistel(symbols, radices, tweak, key):
    key = hashlib.sha256(key.encode()).hexdigest()
    s, h = list(symbols), len(symbols) // 2
    for r in range(pii.ROUNDS):
        other = s[h:] if r % 2 == 0 else s[:h]
        d = hashlib.sha256(f"{key}|{tweak}|{r}|{','.join(map(str, other))}".encode()).hexdigest()
        s = [(x + int(hashlib.sha256(f"{d}:{i}".encode()).hexdigest()[:12], 16)) % radices[i]
             if (i < h) == (r % 2 == 0) else x for i, x in enumerate(s)]
    return s


def luhn(digits):
    d = [int(c) for c in re.sub(r"\D", "", digits)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def one(spark, values, key="k"):
    df = spark.createDataFrame([(i, f"<{v}>") for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text[1:-1] for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_against_plain_python(spark):
    def digits(v):
        return [int(c) for c in re.sub(r"\D", "", v)]
    got = one(spark, ["152.143.123.131", "+1 (743) 555-3824", "4111 1111 1111 1111", "ab1.C@x.org", "078-05-1120"])
    assert got[0] == ".".join(map(str, feistel([152, 143, 123, 131], [256] * 4, "ip", "k")))
    assert digits(got[1]) == [1, *feistel(digits("743 555 3824"), [10] * 10, "phone", "k")]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])
    assert digits(got[2])[:-1] == feistel([4] + [1] * 14, [10] * 15, "card", "k")
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", got[2]) and luhn(got[2])
    e = feistel([0, 1, 1, 2], [26, 26, 10, 26], "email", "k")
    assert got[3] == f"{chr(97 + e[0])}{chr(97 + e[1])}{e[2]}.{chr(65 + e[3])}@x.org"
    a, b, c = feistel([77, 4, 1119], [898, 99, 9999], "ssn", "k")
    assert got[4] == f"{a + (2 if a >= 665 else 1):03d}-{b + 1:02d}-{c + 1:04d}"


@pytest.mark.parametrize("value", [
    "4111111111111112", "256.1.1.1", "1.2.3", "2023-02-29", "1899-01-01", "31.04.2020", "13/13/2020", "000-12-3456",
    "666-12-3456", "123-00-4567", "DE89370400440532013001", "12345", "a@b", "3.14", "10/12"])
def test_invalid_values_stay(spark, value):
    assert one(spark, [value]) == [value]


def test_dates_stay_valid_and_are_permuted(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(0, 36524 + 36525, 7)]
    values = [f"{d:%Y-%m-%d}" for d in days]
    got = one(spark, values)
    back = [datetime.date.fromisoformat(g) for g in got]
    assert len(set(got)) == len(values)
    assert all(b.year // 100 == d.year // 100 for b, d in zip(back, days))
    assert sum(g == v for g, v in zip(got, values)) < 5
    forms = one(spark, ["1987-06-05", "05.06.1987", "06/05/1987", "25/06/1987", "2024-02-29"])
    day = datetime.date.fromisoformat(forms[0])
    assert forms[1] == f"{day:%d.%m.%Y}" and forms[2] == f"{day:%m/%d/%Y}"
    datetime.datetime.strptime(forms[3], "%d/%m/%Y")
    datetime.date.fromisoformat(forms[4])


def test_small_domain_is_a_permutation(spark):
    values = [f"{a}{b}@x.org" for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", "0123456789")]
    got = one(spark, values)
    assert sorted(got) == sorted(values) and got != values
    assert one(spark, values[:3], "other") != got[:3]


def test_iban(spark):
    got = one(spark, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"])
    assert [mod97(g) for g in got] == [1, 1]
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[0]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[1])


def test_query_replaces_all_valid_values_and_nothing_else(spark, sf, real_docs):
    got = {r.doc_id: r for r in queries.QUERIES["op7_pii"](spark, "/root/testdata/sf0.01").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    shape = re.compile(r"(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])")
    linked = {}
    for i, text in docs.items():
        out = got[i].text
        blur = [re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d+", "9", t))) for t in (text, out)]
        if got[i].n_replaced == 0:
            assert out == text
        for a, b in zip(shape.findall(text), shape.findall(out)):
            assert (a == b) == (not luhn(a))
            assert linked.setdefault(a, b) == b and luhn(a) == luhn(b)
        assert blur[0] == blur[1]
        for mail in re.findall(r"[a-z]+\.\d+@", text):
            assert mail not in out


def test_awkward_rows(spark, awkward, no_docs):
    rows = pii.pseudonymize(awkward, "k").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and by[0].text is None and by[0].n_replaced == 0 and by[1].text == ""
    assert pii.pseudonymize(no_docs, "k").count() == 0
    long = make_docs(spark, ["call 555-123-4567 or 10.0.0.1. " * 3000])
    r = pii.pseudonymize(long, "k").first()
    assert r.n_replaced == 6000 and len(set(re.findall(r"\d{3}-\d{3}-\d{4}", r.text))) == 1
    plan = pii.pseudonymize(long.select("doc_id", F.col("text")), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_pseudonym_for_all_layouts_of_a_phone_number(spark):
    got = one(spark, ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1-555-123-4567", "+493012345678", "+49 30 1234 5678",
                      "+35312345678", "+353 1 234 5678"])
    digits = [re.sub("[^0-9]", "", g) for g in got]
    assert len(set(digits[:4])) == len(set(digits[4:6])) == len(set(digits[6:])) == 1
    assert [digits[i][:n] for i, n in ((0, 1), (4, 2), (6, 3))] == ["1", "49", "353"]
    assert digits[0] != "15551234567" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2])


def test_very_long_runs_of_every_symbol_of_the_patterns(spark):
    """Hosts of very many labels, long local parts and long runs: no crash, no blow-up."""
    n = 100_000
    texts = ["a@" + "a." * n + "org and 10.0.0.1", "b" * n + "@x.org", "1" * n, "1 " * n, "+1" * n, "(1" * n, "(" * n, " " * n, "+" * n,
             "1." * n, "1-" * n, "a@" * n, "a@b" * n, ".@" * n, "AB12" * n, "AB12 " * n, "a.b%+" * n, "12/" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    assert len(got) == len(texts) and [got[i].n_replaced for i in (0, 1, 2, 6, 7, 8)] == [2, 1, 0, 0, 0, 0]
    assert got[0].text.endswith("a.org and " + got[0].text.split()[-1]) and "10.0.0.1" not in got[0].text
    assert all(len(r.text) == len(texts[i]) for i, r in got.items() if i != 0)
