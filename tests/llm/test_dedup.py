"""Deduplication operators against plain versions, with every odd case they define."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from liftline.llm import caps, exact_dedup, jaccard, paragraphs, suffixes
from liftline.llm.shared import components, prepare
from tests.llm import brute


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def frame(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    wide = [(*r, 1.5, "x", None) for r in rows]
    schema = "doc_id long, text string, score double, key string, component long"
    return spark.createDataFrame(wide, schema).repartition(3)


def near_copies(seed=3, n=60, words=80):
    random.seed(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(words)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(n, n + 30):
        rows.append((i, " ".join(f"q{random.randrange(9)}" for _ in range(random.randint(0, 6)))))
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "One word"), (904, "one WORD"), (None, "null id"), (None, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(70, 60), (60, 70), (80, 80), (61, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 60: 60, 61: 60, 70: 60}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def exact_brute(rows):
    fold = [(d, (t or "").translate(brute._FOLD)) for d, t in rows]
    groups = {}
    for d, t in fold:
        groups.setdefault(t, []).append(d)
    out = []
    for d, t in fold:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_exact_groups(spark, block):
    long = "abc é" * 700
    rows = ODD + [(1, "Same"), (2, "sAME"), (2, "sAME"), (3, "É same"), (4, "é same"), (5, long), (6, long.upper())]
    rows += [(7, long.replace("é", "É")), (8, long + "x"), (9, long + "y"), (10, "\0"), (11, "\0\0"), (5, "another text")]
    got = exact_dedup.exact_groups(frame(spark, rows), block)
    assert Counter(map(tuple, got.collect())) == Counter(exact_brute(rows))
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("chunk", [40_000, 600])
def test_jaccard_components(spark, chunk):
    rows = near_copies() + ODD + [(5, "other text for a repeated id"), (7, near_copies()[7][1])]
    got = Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), 4, 85, chunk).collect()))
    assert got == Counter(brute.jaccard_components(rows, 4, 85))


def test_jaccard_components_of_many_small_chunks(spark):
    rows = near_copies(seed=8, n=150) + ODD
    got = Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), 4, 85, 300).collect()))
    assert got == Counter(brute.jaccard_components(rows, 4, 85))


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []
    got = {tuple(r) for r in jaccard.jaccard_components(frame(spark, [(1, None), (2, None)])).collect()}
    assert got == {(1, 0, 1), (2, 0, 2)}


def test_inverted_lists_find_all():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.int64)) for _ in range(80)]
    lists = jaccard.Lists(sets, 60)
    for i, a in enumerate(sets):
        got = list(lists.search(a, i + 1, lambda j: False))
        want = [j for j in range(i + 1, 80) if 100 * len(np.intersect1d(a, sets[j])) >= 60 * len(np.union1d(a, sets[j]))]
        assert got == want


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_inverted_lists_of_near_copies_and_odd_sets(percent):
    rng = np.random.default_rng(5)
    sets = [np.zeros(0, np.int64), np.array([7])]
    for i in range(150):
        kept = rng.random(90) > 0.1 * (i % 4)
        sets.append(np.unique(np.concatenate([np.arange(90)[kept], rng.integers(1000, 9000, i % 20)])).astype(np.int64))
    lists = jaccard.Lists(sets, percent)
    for i, a in enumerate(sets):
        for first in (0, i + 1):
            met = np.arange(len(sets)) % 5 == 3
            got = list(lists.search(a, first, lambda j: met[j]))
            shared = [len(np.intersect1d(a, b)) for b in sets]
            want = [j for j in range(first, len(sets)) if shared[j] and not met[j] and 100 * shared[j] >= percent * (len(a) + len(sets[j]) - shared[j])]
            assert got == want
    assert list(jaccard.Lists([], percent).search(sets[1], 0, lambda j: False)) == []


def test_labels_meet_once():
    rows = [(i, np.arange(50) + 100 * (i % 2), i < 10, i % 4) for i in range(20)]
    keys, items, query, label = zip(*rows, strict=True)
    table = pa.table({"key": keys, "items": pa.array([x.tolist() for x in items], pa.list_(pa.int64())), "query": query, "label": label})
    got = jaccard._across(80)(table).to_pydict()
    # Labels 0 and 2 are alike, as are 1 and 3; every query of a label would have given a link.
    assert len(got["a"]) == 2
    assert sorted(a % 2 for a in got["a"]) == [0, 1] and all((a - b) % 4 == 2 for a, b in zip(got["a"], got["b"], strict=True))


def test_cells_of_a_large_group_go_to_many_tasks(spark, monkeypatch):
    def across(percent):
        def join(table):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            return pa.Table.from_arrays([pa.array([x], pa.int64()) for x in (part, -1)], names=["a", "b"])

        return join

    monkeypatch.setattr(jaccard, "_across", across)
    sets = spark.createDataFrame([(i, 10, list(range(100 * i, 100 * i + 10))) for i in range(400)], "key long, n int, items array<long>")
    meeting = spark.createDataFrame([(0, i) for i in range(1, 400)], "a long, b long")
    links = jaccard.similar_sets(sets, meeting, 85, 40)
    # Their few bytes would fit into one task.
    assert links.where("b = -1").select("a").distinct().count() > 4


def vectors_brute(rows, cosine):
    groups, n, links = {}, [0] * len(rows), []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        unit = np.array([rows[i][1] for i in members], float)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        for a, i in enumerate(members):
            n[i] = int(linked[a].sum())
        links += [(members[a], members[b]) for a, b in zip(*np.nonzero(np.triu(linked)), strict=True)]
    least = brute.least_reachable(len(rows), links, [r[0] for r in rows])
    return [(r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, least, strict=True)]


@pytest.mark.parametrize("piece", [1024, 20])
def test_embedding_components(spark, piece):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(150):
        v = base[i % 6] + rng.normal(size=16) * 0.05 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [], 0), (204, [0.0] * 16, 0)]
    rows += [(205, [None] * 16, 0), (206, [float("nan")] * 16, 0), (207, [float("inf")] * 16, 0), (208, [1.0, 2.0], 0)]
    rows += [(209, [2.0, 4.0], 0), (0, rows[0][1], 0), (None, rows[6][1], 0), (210, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cap string")
    got = Counter(map(tuple, caps.embedding_components(df, piece=piece).collect()))
    assert got == Counter(vectors_brute(rows, 0.98))
    assert caps.embedding_components(df.limit(0)).collect() == []


def crowd_and_near_copies(n, dim):
    rng = np.random.default_rng(6)
    base = rng.normal(size=dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], 0) for i in range(n)]
    rows += [(n + i, [float(np.float32(x)) for x in base + rng.normal(size=dim) * 0.03 * (i % 5)], i % 2) for i in range(150)]
    return rows + [(5, rows[5][1], 0), (None, rows[6][1], 0), (n + 500, rows[n][1], 0), (n + 501, rows[n][1], None)]


@pytest.mark.parametrize("most", [16, 2])
@pytest.mark.parametrize("dim", [8, 64])
def test_embedding_components_of_large_ones_cap_by_cap(spark, monkeypatch, dim, most):
    monkeypatch.setattr(caps, "MOST_PIECES", most)
    rows = crowd_and_near_copies(300, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter(map(tuple, caps.embedding_components(df, piece=20).collect()))
    assert got == Counter(vectors_brute(rows, 0.98))


def test_vectors_near_no_other_are_not_sent(spark, monkeypatch):
    rows = crowd_and_near_copies(1500, 64)
    counted, sent = caps.group_count, []
    monkeypatch.setattr(caps, "group_count", lambda c, p: sent.append(c.agg({"n": "sum"}).first()[0]) or counted(c, p))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, caps.embedding_components(df).collect())) == Counter(vectors_brute(rows, 0.98))
    # 150 near copies and a few that share a cap by chance, once each; not each vector for each of its caps.
    assert 100 < sent[0] < 500


def test_nearest_directions_are_shared():
    rng = np.random.default_rng(7)
    for dim, vectors in ((64, 600_000), (24, 50_000), (300, 10_000)):
        a, z = rng.normal(size=(2, 3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z -= (z * a).sum(axis=1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        code = caps.NearestCode.for_size(vectors, dim)
        (_, x), (_, y) = code.caps_of(a), code.caps_of(b)
        each = caps.CODES * caps.NEAREST
        assert len(x) == len(y) == 3000 * each
        shared = [len(np.intersect1d(p, q)) for p, q in zip(x.reshape(-1, each), y.reshape(-1, each), strict=True)]
        assert np.mean(np.array(shared) > 0) >= 0.999


def test_groups_of_a_large_cap_stay_small(spark, monkeypatch):
    crowd = spark.createDataFrame([(1, 100_000), (2, 2)], "cap int, n long")
    assert caps.group_count(crowd, 1024) == -(-(100_000 * 98 + 2) // caps.GROUP_ROWS)
    assert caps.group_count(crowd.limit(0), 1024) == 1
    # One cap of near-equal vectors, in pieces of 20.
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.01], 0) for i in range(300)]
    found = []
    counted = caps.group_count
    monkeypatch.setattr(caps, "GROUP_ROWS", 500)
    monkeypatch.setattr(caps, "group_count", lambda c, p: found.append((c.agg({"n": "max"}).first()[0], counted(c, p))) or found[-1][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter(map(tuple, caps.embedding_components(df, piece=20).collect()))
    assert got == Counter(vectors_brute(rows, 0.98))
    largest, groups = found[0]
    assert largest > 100 and groups >= largest * -(-largest // 20) / 500


@pytest.mark.parametrize("dims", [16, 128])
def test_cap_recall(spark, dims):
    """Clusters whose pairs lie around the threshold, one of them a third of all vectors."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(60, dims))
    # Two vectors of a cluster have a cosine of about 1 / (1 + spread ** 2).
    spread = np.sqrt(1 / rng.uniform(0.975, 0.999, 60) - 1)
    rows = []
    for i in range(3000):
        c = 0 if i % 3 == 0 else rng.integers(60)
        rows.append((i, [float(np.float32(x)) for x in centres[c] + rng.normal(size=dims) * spread[c] * (1 + c % 2)], int(c) % 2))
    want = {r[0]: r[1] for r in vectors_brute(rows, 0.98)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in caps.embedding_components(df).collect()}
    assert sum(want.values()) > 20_000
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.999 * sum(want.values())


def paragraph_rows():
    random.seed(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        lines = [" ".join(f"u{random.randrange(10**6)}" for _ in range(random.randint(3, 40))) for _ in range(4)]
        if i % 3 == 0:
            own = list(passage)
            if i % 2:
                own[random.randrange(60)] = f"z{i}"
            lines.insert(random.randrange(5), " ".join(own).upper() if i % 4 else " ".join(own))
        if i % 5 == 0:
            lines += ["short line that many have"] * 2
        rows.append((i, "\n".join(lines)))
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, rows[0][1] + "\n")]


def test_repeated_paragraphs(spark):
    rows = paragraph_rows()
    df = paragraphs.repeated_paragraphs(frame(spark, rows), chunk_shingles=300)
    got = Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in df.collect())
    assert got == Counter(brute.repeated_paragraphs(rows))
    docs = frame(spark, rows)
    cleaned = {r.doc_id: r.text for r in paragraphs.without_lines(docs, df).collect()}
    for doc, _, gone in brute.repeated_paragraphs(rows):
        text = dict(rows)[doc]
        if gone:
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        assert cleaned[doc] == text


def test_paragraphs_of_nothing_and_repeated_rows(spark):
    assert paragraphs.repeated_paragraphs(frame(spark, [])).collect() == []
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "another\n" + text), (None, text)]
    got = sorted((r.doc_id or 0, r.n_lines, tuple(r.removed)) for r in paragraphs.repeated_paragraphs(frame(spark, rows)).collect())
    assert got == [(0, 1, ()), (1, 1, (0,)), (1, 1, (0,)), (1, 2, (1,))]


def test_wrapped_and_embedded_passages(spark):
    random.seed(5)
    passage = [f"p{i}é" for i in range(60)]
    wrap = lambda n: "\n".join(" ".join(passage[i : i + n]) for i in range(0, 60, n))
    own = lambda n: " ".join(f"u{random.randrange(10**9)}" for _ in range(n))
    texts = [own(30) + "\n" + wrap(12), own(9) + "\n\n" + wrap(9).upper().replace("É", "é"), own(40) + " " + wrap(60) + " " + own(70), wrap(12)]
    texts += [own(12) + "\n" + own(12), own(3), wrap(19).rsplit("\n", 3)[0], "a " * 200, own(25) + "\n" + own(5)]
    texts += [texts[8] + " " + own(3)]
    rows = list(enumerate(texts)) + [(90, None), (91, "")]
    found = paragraphs.repeated_paragraphs(frame(spark, rows))
    got = {r.doc_id: r for r in found.collect()}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(frame(spark, rows), found).collect()}
    for doc in (0, 4, 5, 6, 90, 91):
        assert got[doc].n_cut == got[doc].n_removed == 0 and left[doc] == dict(rows)[doc]
    for doc, text in rows:
        lines = (text or "").split("\n")
        assert got[doc].n_bytes == len((text or "").encode())
        assert got[doc].n_removed == got[doc].n_cut + sum(len(lines[i].encode()) for i in got[doc].removed)
    assert got[3].n_lines == 5
    for doc in (1, 2, 3):
        text = dict(rows)[doc]
        words, kept = text.lower().split(), left[doc].lower().split()
        assert [w for w in kept if w[0] == "u"] == [w for w in words if w[0] == "u"]
        # At least one unit of 20 words goes, at most 19 words stay at either end.
        assert sum(w[0] == "p" for w in kept) <= 38 and left[doc].count("\n") == text.count("\n")
        assert got[doc].n_cut == sum(s.end - s.start for s in got[doc].spans)
    assert 20 <= left[7].count("a") < 60


def test_units_cover_every_word():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 19, 20, 21, 39, 400, 0, 1000]
    word = np.concatenate([[0], np.cumsum(sizes)])
    for h in (rng.integers(0, 2**63, word[-1]).astype(np.uint64), np.ones(word[-1], np.uint64)):
        at, _ = paragraphs.unit_runs(h, word, 20, 20)
        covered = np.zeros(word[-1], bool)
        for a in at.tolist():
            covered[a : a + 20] = True
            assert np.searchsorted(word, a, "right") == np.searchsorted(word, a + 19, "right")
        for i, n in enumerate(sizes):
            assert covered[word[i] : word[i + 1]].all() == (n >= 20 or n == 0)
        assert len(at) < word[-1] / 5


def byte_rows():
    random.seed(2)
    rows = [(i, "".join(random.choice("abc é") for _ in range(random.randint(0, 400)))) for i in range(40)]
    for i in range(60):
        a, b = random.choice(rows)[1], random.choice(rows)[1]
        k, n = random.randrange(len(a) + 1), random.randrange(30, 120)
        rows.append((100 + i, b[: len(b) // 2] + a[k : k + n] + b[len(b) // 2 :]))
    run = "ab" * 900
    rows += [(900, None), (901, ""), (902, run), (903, run[1:] + "c"), (904, "x" * 400), (905, "x" * 50 + "y"), (906, "x" * 49)]
    rows += [(-5, rows[3][1][:90]), (907, "\0" * 120 + "a"), (908, "\0" * 70), (902, "same id " + rows[5][1]), (5, rows[5][1])]
    return rows


def test_repeated_bytes(spark):
    rows = byte_rows()
    got = suffixes.repeated_bytes(frame(spark, rows))
    assert Counter(map(tuple, got.drop("spans").collect())) == Counter(brute.repeated_bytes(rows))
    assert suffixes.repeated_bytes(frame(spark, [])).collect() == []
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def common_phrase_rows(n=90):
    """A third of the rows around one phrase, a third of the rows without doc_id, one of them repeated."""
    random.seed(8)
    phrase = "Licensed for any use, provided that this line stays with the text."
    word = lambda k: "".join(random.choice("abcdefgh ") for _ in range(k))
    rows = [(i, word(40 + i % 7) + phrase + word(45)) for i in range(n)]
    rows += [(n + i, word(120)) for i in range(n)]
    rows += [(None, rows[i][1][: 60 + i]) for i in range(n // 2)] + [(None, "z" + rows[3][1])] * (n // 2)
    return rows


@pytest.mark.parametrize("size", [200_000, 20])
def test_bytes_of_a_phrase_in_a_third_of_the_rows(spark, monkeypatch, size):
    rows, hot = common_phrase_rows(), []
    monkeypatch.setattr(suffixes, "RANGE_SUFFIXES", size)
    cuts = suffixes._splitters
    monkeypatch.setattr(suffixes, "_splitters", lambda *a: hot.append(cuts(*a)) or hot[-1])
    got = suffixes.repeated_bytes(frame(spark, rows)).drop("spans").collect()
    least = lambda d: -(2**63) if d is None else d
    want = brute.repeated_bytes([(least(d), t) for d, t in rows])
    assert Counter((least(r[0]), *r[1:]) for r in got) == Counter(want)
    assert (len(hot[0][1]) > 0) == (size < 200_000)


def test_strings_of_frequent_grams_are_dealt_out():
    rng = np.random.default_rng(4)
    n = 3000
    rights, lefts = rng.integers(97, 122, (n, 56)).astype(np.uint8), rng.integers(97, 122, (n, 40)).astype(np.uint8)
    rights[:, : suffixes.GRAM] = 65
    whole = np.full(n, 50), np.full(n, 34)
    suffix = (rights, whole[0], lefts, whole[1], np.arange(n), np.arange(n), np.full(n, 34))
    sizes = Counter()
    for block in suffixes._hot_sent(suffix, 16, 4):
        sizes[block["grp"]] += len(suffixes.unpack(block["where"])) // 5
    assert sum(sizes.values()) == n * 35 and len(sizes) == 16
    assert max(sizes.values()) < 1.1 * n * 35 / 16


def test_null_id_is_smallest_for_bytes(spark):
    text = "".join(chr(97 + i % 26) for i in range(60))
    got = {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(frame(spark, [(None, text), (3, text)])).collect()}
    assert got == {None: 0, 3: 60}


def test_loser_tree_merges_and_knows_prefixes():
    random.seed(6)
    runs = []
    for _ in range(7):
        strings = sorted("".join(random.choice("ab") for _ in range(random.randint(1, 9))).encode() for _ in range(random.randint(0, 30)))
        shared = [0] + [_common(a, b) for a, b in zip(strings, strings[1:], strict=False)]
        runs.append((strings, shared))
    place, out = [0] * 7, []
    for run, n in suffixes.LoserTree(runs):
        out.append((runs[run][0][place[run]], n))
        place[run] += 1
    assert [s for s, _ in out] == sorted(s for strings, _ in runs for s in strings)
    assert [n for _, n in out[1:]] == [_common(a[0], b[0]) for a, b in zip(out, out[1:], strict=False)]


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n
