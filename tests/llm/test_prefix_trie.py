"""The prefix trie against a plain one, over many cuts into ranges."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from liftline.llm import prefix_trie
from liftline.llm.shared import prepare


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def plain_rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(prefix))))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations():
    random.seed(4)
    rows = []
    for c in range(-7, 90):
        if c == 15:
            continue
        for t in range(random.randint(1, 12)):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(["a", "b", "cé", ""])))
    hot = [(0, "system", "s"), (1, "user", "same é"), (2, "assistant", None), (3, None, "x"), (3, None, "x"), (None, "user", "first")]
    for c in range(200, 280):
        rows += [(c, *t) for t in hot]
    rows += [(c, t, "user", f"{c}") for c in (300, 301) for t in range(40)]
    rows += [(None, 1, "user", "nobody")] * 20 + [(400, 5, "b", "tie"), (400, 5, "a", "tie"), (400, 5, "a", "Tie"), (404, 1, "u", "short")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string").repartition(3)


@pytest.mark.parametrize("range_turns", [500_000, 60, 9])
def test_trie_of_rebuilt_conversations(spark, range_turns):
    rows = conversations()
    paths = prefix_trie.with_shared_heads(prefix_trie.turn_paths(frame(spark, rows)))
    got = prefix_trie.prefix_trie(paths, range_turns)
    assert Counter(map(tuple, got.collect())) == plain_trie(plain_rebuilt(rows))


def test_trie_of_plain_conversations(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 60]
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        convs.setdefault(c, []).append((role or "", text or ""))
    got = prefix_trie.prefix_trie(prefix_trie.turn_paths(frame(spark, rows)), 20)
    assert Counter(map(tuple, got.collect())) == plain_trie(convs)


def test_trie_of_nothing(spark):
    rows = frame(spark, [(None, 1, "user", "x")])
    for given in (rows, rows.limit(0)):
        assert prefix_trie.prefix_trie(prefix_trie.turn_paths(given)).collect() == []


def test_conversation_left_without_turns(spark):
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    c = next(c for c in range(1, 500) if c % 5 and h(c) >= 2)
    rows = [(c, 1, "user", "a"), (c, 2, "user", "b")]
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turn_paths(frame(spark, rows)))).collect()
    assert Counter(map(tuple, got)) == plain_trie({c: []})


def test_many_copies_are_hashed_in_order(spark):
    members = spark.range(0, 30_000, 1, 7).selectExpr("IF(id % 3 = 0, X'00', IF(id % 3 = 1, X'0001', unhex(sha2(string(id), 256)))) AS seq", "id * 7 - 900 AS conv_id")
    got = {bytes(r.seq): (r.n, r.conv, r.ends) for r in prefix_trie._listed_ids(members).collect()}
    for k, seq in ((0, b"\0"), (1, b"\0\1")):
        ids = [i * 7 - 900 for i in range(30_000) if i % 3 == k]
        assert got[seq] == (len(ids), ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert len(got) == 10_002


def test_extents_of_the_sparse_table():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        values = rng.integers(0, 4, n)
        table = prefix_trie.SparseTable(values)
        at, least = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        left, right = table.left(at, least), table.right(at, least)
        for i, t, a, b in zip(at, least, left, right, strict=True):
            want = i
            while want + 1 < n and values[want + 1] >= t:
                want += 1
            assert b == want
            want = i
            while want > 0 and values[want] >= t:
                want -= 1
            assert a == want
        first, last = np.triu_indices(n)
        assert table.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]
