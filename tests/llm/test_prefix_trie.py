"""The prefix trie against plain Python, with hot first turns, copies and long conversations."""
import hashlib
import random
import zlib

import pytest

from cohortbeam.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    h = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return h[:15], h[16:31]


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), digest(r or "", x or ""), (r or "", x or "")))
    own = {c: [v[2] for v in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c // 100 * 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ids) of every node."""
    members, kids, ends = {}, {}, {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids.get(n, [])),
                    *sums[n], ",".join(map(str, sorted(ends.get(n, []))))) for n in members), key=str)


def run(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in (
        "n", "md5", "chars", "depth", "p1", "run_n", "_part", "base", "h", "total")])
    nodes, ends = pt.prefix_trie(*pt.with_shared_heads(pt.turn_digests(df.repartition(3))), block=block)
    lists = {tuple(r[:3]): r.sha256 for r in pt.list_digests(ends).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                    lists.get((r.depth, r.p1, r.p2), empty)) for r in nodes.collect()), key=str)


def hashed(want):
    return sorted(((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for w in want), key=str)


@pytest.mark.parametrize("block, part, chunk", [(4, 4096, 500), (3, 2, 7)])
def test_equals_plain_python(spark, monkeypatch, block, part, chunk):
    """Few different turns: many shared prefixes that end and part at every place of a block."""
    monkeypatch.setattr(pt, "PART", part)
    monkeypatch.setattr(pt, "CHUNK", chunk)
    rng = random.Random(block)
    rows = []
    for c in rng.sample(range(0, 900), 250):
        same = c % 3 == 0  # a third of all start alike, and most of those are copies
        turns = [("user", "hello")] * 3 if same else []
        for _ in range(0 if same and c % 2 else rng.randint(0 if same else 1, 9)):
            turns.append((rng.choice(("user", "bot")), rng.choice(("a", "bb", "", "ccc"))))
        rows += [(c, i, r, x) for i, (r, x) in enumerate(turns)]
    rows += [(950, i, "user", f"turn {i}") for i in range(400)]  # one conversation with a third of all turns
    rng.shuffle(rows)
    assert run(spark, rows, block) == hashed(brute(rows))


def test_awkward_rows(spark):
    rows = [(0, 1, "u", "a"), (0, None, None, None), (0, None, "u", "b"), (0, 1, "u", "a"), (0, 1, "b", "a"), (7, 3, "u", "x" * 300_000),
            (7, 4, None, "y"), (7, 4, "", "y"), (None, 1, "u", "a"), (101, 5, "u", ""), (102, 5, "u", "é😀"), (203, 1, None, None)]
    assert run(spark, rows, 4) == hashed(brute(rows))
    assert any(r[0] == 7 and r[6] == 0 for r in run(spark, rows, 2))


def test_only_conversations_without_turns_and_no_rows(spark):
    """A conversation of one turn with h > 0 and no base keeps none: the root is its only node."""
    short = [c for c in range(300, 400) if c != 300 and zlib.crc32(str(c).encode()) % 6 > 0][:3]
    rows = [(c, 1, "u", "a") for c in short]
    got = run(spark, rows, 4)
    assert got == hashed(brute(rows)) and len(got) == 1 and got[0][4:6] == (0, 1)
    assert run(spark, rows[:0], 4) == []
    assert run(spark, [(None, 1, "u", "a")], 4) == []
