"""Benchmark decontamination against a plain search of every window."""

import random
import re
from collections import Counter

import pytest

from liftline.llm import contamination
from liftline.llm.shared import prepare

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))


def plain(docs, items, window):
    held = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            held.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in held}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in held:
                    hit |= set(range(i, i + m))
                    found |= held[tuple(w[i : i + m])]
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return out


def rows_of(found):
    for r in found:
        covered = {i for s in r.spans for i in range(s.start, s.end)}
        assert len(covered) == r.n_hit and len(r.items) == r.n_items
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in found)


def tables():
    random.seed(7)
    word = lambda k: random.choice(["the", "of", "in", "é", "42", "on", "und", "x", "日本"][:k])
    items = [(i, " ".join(word(9) for _ in range(random.randint(10, 30)))) for i in range(25)]
    items += [(30, "Only four words here"), (31, "single"), (32, None), (33, " -- \n"), (34, items[0][1]), (None, items[1][1]), (3, "twice the id " + items[2][1])]
    items += [(35, "a a a a a a a a a a a a a"), (36, "the of"), (37, items[4][1].upper() + ", and more words follow than were there")]
    docs = []
    for i in range(80):
        own = [word(9) for _ in range(random.randint(0, 120))]
        if i % 2:
            w = words(random.choice(items)[1] or "")
            a = random.randrange(len(w) + 1)
            place = random.randrange(len(own) + 1)
            own[place:place] = w[a : a + random.randint(5, 20)] if i % 4 == 1 else w
        docs.append((i, random.choice([" ", ", ", "\n", " -\x00"]).join(own)))
    docs += [(900, None), (901, ""), (902, "..."), (3, "A a A a a a a a a a a"), (3, items[0][1]), (None, items[5][1]), (None, None), (903, "Four words here only")]
    docs += [(904, "é" * 3000 + " " + items[6][1] + " y" * 20000), (905, items[0][1]), (905, items[0][1])]
    return docs, items


@pytest.mark.parametrize(("window", "shingle"), [(10, 3), (10, 1), (4, 4), (10, 10), (1, 3)])
def test_benchmark_hits(spark, window, shingle):
    docs, items = tables()
    wide = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, class string").repartition(3)
    bench = spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, token double").repartition(2)
    got = contamination.benchmark_hits(wide, bench, window, shingle).collect()
    assert rows_of(got) == Counter(plain(docs, items, window))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination.benchmark_hits(docs, none).collect()
    assert rows_of(got) == Counter({(1, 2, 0, ()): 1, (2, 0, 0, ()): 1})
    bench = spark.createDataFrame([(1, "a b c d")], none.schema)
    assert contamination.benchmark_hits(docs.limit(0), bench).collect() == []


def test_one_item_in_a_third_of_all_documents(spark):
    random.seed(1)
    passage = [f"p{i}" for i in range(25)]
    items = [(i, " ".join(passage)) for i in range(40)] + [(50, "never anywhere " * 6)]
    docs = [(i, " ".join([f"u{random.randrange(99)}" for _ in range(30)] + passage * (i % 3 == 0))) for i in range(300)]
    found = contamination.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found.collect()) == Counter(plain(docs, items, 10))


def test_bitmap_keeps_every_shingle(spark):
    values = [0, -1, 1, 2**63 - 1, -(2**63), 12345678901234567]
    for many in (1, 50_000):
        rows = spark.createDataFrame([(v,) for v in values], "token long").union(spark.range(many).selectExpr("xxhash64(id) AS token"))
        bitmap, bits = contamination._bitmap(rows)
        import numpy as np

        hashes = np.array(values, np.int64).view(np.uint64)
        assert len(contamination._marked(hashes, bitmap, bits)) == len(values)
        others = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2)
        assert len(contamination._marked(others, bitmap, bits)) < 2_000
