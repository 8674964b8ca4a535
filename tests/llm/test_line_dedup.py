"""Line dedup against DuckDB and a brute-force version."""
import random
import re

import pytest

from cohortbeam.llm import line_dedup
from llm.conftest import make_docs


def brute(texts, m, long_words=50):
    """Delete every line inside a window of m lines that occurred before, and
    every line of long_words words or more that did."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - m + 1):
            w = tuple(lines[i:i + m])
            if w in seen:
                gone |= set(range(i, i + m))
            seen.add(w)
        for i, x in enumerate(lines):
            if len([w for w in re.split("[ \\t\\r\\f]+", x) if w]) >= long_words:
                gone |= {i} if ("long", x) in seen else set()
                seen.add(("long", x))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def brute_lcp_runs(texts, m):
    """Maximal runs against the first occurrence of each window."""
    seq, first, runs = [], {}, []
    for d, t in enumerate(texts):
        lines, at, last = t.split("\n"), len(seq), None
        for i in range(len(lines) - m + 1):
            w = tuple(lines[i:i + m])
            src = first.setdefault(w, at + i)
            if src < at + i:
                if last and last[1] + last[2] == i + m - 1 and at + i - src == last[3]:
                    last[2] += 1
                else:
                    last = [d, i, m, at + i - src]
                    runs.append(last)
            else:
                last = None
        seq += [*lines, None]
    return sorted(tuple(r) for r in runs)


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_equals_brute_force(spark, m):
    rng = random.Random(m)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += texts[:5] + ["a\na\na\na\na\na\na"]
    docs = make_docs(spark, texts).repartition(5)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, m).collect()}
    assert [got[i].text for i in range(len(texts))] == brute(texts, m)
    base, at = {}, 0
    for i, t in enumerate(texts):
        base[i], at = at, at + t.count("\n") + 2
    runs = sorted((i, r.start, r.length, base[i] + r.start - r.source) for i in got for r in got[i].runs or [])
    assert runs == brute_lcp_runs(texts, m)


def test_awkward_rows(spark, awkward, no_docs):
    got = line_dedup.line_dedup(awkward, 2)
    assert {"fp", "line", "pos"} <= set(got.columns)
    rows = got.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and by[0].text is None and by[0].n_lines == 0
    assert by[1].text == "" and by[1].n_lines == 1 and by[5].text == "one two\n"
    assert by[2].text == " \n\t " and by[4].text == "one" and by[None].text == "one"
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = line_dedup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def suffix_array_dedup(texts, m):
    """By the book: sort all suffixes, LCP of neighbours, intervals of LCP >= m;
    every suffix but the first of its interval is a later copy of its common
    prefix with that first one."""
    seq = []
    for d, t in enumerate(texts):
        seq += [*((0, x) for x in t.split("\n")), (1, str(d))]  # a unique end mark
    order = sorted(range(len(seq)), key=lambda i: seq[i:])

    def lcp(i, j):
        n = 0
        while max(i, j) + n < len(seq) and seq[i + n] == seq[j + n]:
            n += 1
        return n
    gone, interval = set(), [order[0]]
    for a, b in [*zip(order, order[1:]), (order[-1], None)]:
        if b is not None and lcp(a, b) >= m:
            interval.append(b)
            continue
        first = min(interval)
        for i in interval:
            if i != first:
                gone |= set(range(i, i + lcp(i, first)))
        interval = [b]
    out, at = [], 0
    for t in texts:
        lines = t.split("\n")
        out.append("\n".join(x for i, x in enumerate(lines) if at + i not in gone))
        at += len(lines) + 1
    return out


def test_equals_a_full_suffix_array(spark):
    rng = random.Random(11)
    base = [rng.choice("abcdefgh") for _ in range(40)]
    texts = []
    for _ in range(40):
        i = rng.randrange(35)
        texts.append("\n".join([*rng.choices("abcxyz", k=rng.randrange(4)), *base[i:i + rng.randrange(1, 25)],
                                *rng.choices("abcxyz", k=rng.randrange(4))]))
    for m in (2, 3):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(make_docs(spark, texts).repartition(3), m).collect()}
        assert [got[i] for i in range(len(texts))] == suffix_array_dedup(texts, m)


def test_long_single_lines_are_passages_and_short_ones_stay(spark):
    rng = random.Random(4)

    def line(n):
        return " ".join(rng.choice("abcdefgh") for _ in range(n))
    long, fifty, short, odd = line(90), line(50), line(49), "  " + "\t".join("w" * 50) + " \r"
    texts = [f"x\n{long}\ny", long, f"{short}\n1", f"{short}\n2", f"{fifty}\n3", f"4\n{fifty}", f"5\n{long}\ny\n6", f"{odd}\n7", f"8\n{odd}",
             f"{long}\n9\n{long}", fifty + " ", f"{long[:-2]}\n10"] + [f"{i}\n{long}\n{short}" for i in range(200, 260)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(make_docs(spark, texts).repartition(5)).collect()}
    want = brute(texts, 2)
    assert [got[i].text for i in range(len(texts))] == want
    assert want[1] == "" and want[3] == f"{short}\n2" and want[5] == "4" and want[8] == "8" and want[9] == "9" and want[20] == "208"
    assert [(r.start, r.length, r.source) for r in got[5].runs] == [(1, 1, 12)]
    assert got[10].n_deleted == 0 and got[11].n_deleted == 0


def test_a_window_in_a_third_of_all_documents(spark):
    texts = [f"{i}\nthis is\nshared\n{i}" if i % 3 == 0 else f"own {i}\nlines {i % 50}\nof {i % 50}" for i in range(900)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(make_docs(spark, texts).repartition(8)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2)


def brute_maximal_repeats(texts, m):
    """(document, start, length) of the longest prefix of each suffix that begins an
    earlier suffix, without those inside another one."""
    seq = [x for d, t in enumerate(texts) for x in (*t.split("\n"), ("end", d))]
    out, p = [], 0
    for d, t in enumerate(texts):
        reach = 0
        for i in range(t.count("\n") + 1):
            best = 0
            for q in range(p):
                n = 0
                while seq[p + n] == seq[q + n]:
                    n += 1
                best = max(best, n)
            if best >= m and i + best > reach:
                out.append((d, i, best))
            reach, p = max(reach, i + best), p + 1
        p += 1
    return out, seq


@pytest.mark.parametrize("m", [2, 3])
def test_repeats_are_maximal_runs_of_the_suffix_array(spark, m):
    rng = random.Random(m)
    texts = ["A\nB", "x\nB\nC", "A\nB\nC", "A\nB\nC", "a\n" * 9, ""]
    texts += ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + texts[4:6]
    got = {r.doc_id: r for r in line_dedup.line_dedup(make_docs(spark, texts).repartition(5), m).collect()}
    want, seq = brute_maximal_repeats(texts, m)
    assert sorted((i, r.start, r.length) for i in got for r in got[i].repeats or []) == want
    assert (3, 0, 3) in want
    at = 0
    for i, t in enumerate(texts):
        for r in got[i].repeats or []:
            assert r.source < at + r.start and seq[r.source:r.source + r.length] == seq[at + r.start:at + r.start + r.length]
        at += t.count("\n") + 2
    assert [got[i].text for i in range(len(texts))] == brute(texts, m)
