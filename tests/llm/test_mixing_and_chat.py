"""Mixing and chat formatting: SQL twins, plain versions, odd rows."""

import hashlib
import math
import re
from fractions import Fraction

import pytest

from liftline.llm import chat, mixing
from liftline.llm import queries as Q
from liftline.llm.shared import prepare
from liftline.plans.registry import Entry
from tests.comparison import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, Entry(Q.QUERIES[name], Q.ORACLES[name]), SF_DIR) is None


def mix_brute(rows):
    """Exact targets by fractions, and words taken pass by pass."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        open_weight = sum(weight[s] for s in sources if s not in capped)
        target = {s: Fraction(3 * total[s]) if s in capped else Fraction(left * weight[s], open_weight or 1) for s in sources}
        over = {s for s in sources if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        own = [(hashlib.md5(str("" if d is None else d).encode()).hexdigest(), d, size[i]) for i, (d, _, x) in enumerate(rows) if x == s]
        own.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        left, taken = math.floor(target[s]), [0] * len(own)
        for _ in range(3):
            for k, (_, _, n) in enumerate(own):
                taken[k] += min(n, left)
                left -= min(n, left)
        out += [(d, n, total[s], float(target[s]), t) for (_, d, n), t in zip(own, taken, strict=True)]
    return out


def documents():
    rows = [(i, "w " * (i * 7 % 23), f"s{i % 5}" if i % 11 else None) for i in range(120)]
    rows += [(500 + i, "word " * 90, "hot") for i in range(60)] + [(7, "a b c", "s0"), (7, "a b c", "s0"), (None, "n", "s1")]
    return rows + [(900, None, "empty"), (901, "", "empty"), (902, "\n", None)]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("window", [1, 10, 20_000])
def test_mix_plan(spark, window):
    docs = spark.createDataFrame([(*r, 1) for r in documents()], "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(docs.repartition(4), window_rows=window)
    got = sorted([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in plan.collect()], key=key)
    want = sorted(mix_brute(documents()), key=key)
    assert [(a[:3], a[4]) for a in got] == [(b[:3], b[4]) for b in want]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(got, want, strict=True))
    assert all(r[4] <= 3 * r[1] for r in got)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.with_positions(mixing.mix_plan(docs)).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], docs.schema)
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix_plan(none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_positions_invert_the_demand(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    rows = mixing.with_positions(mixing.mix_plan(docs)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    for r in rows:
        knots = mixing.SHAPES[r.place % 3]
        steps = 4000
        at = [(k + 0.5) / steps * r.position for k in range(steps)]
        area = sum(_value(knots, t) for t in at) / steps * r.position
        whole = sum(_value(knots, (k + 0.5) / steps) for k in range(steps)) / steps
        assert area / whole == pytest.approx((r.turn * r.source_size + r.start) / r.target, abs=1e-5)
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    for r in mixing.mix_plan(docs).collect():
        if r.doc_id != 7:
            assert taken.get(r.doc_id, 0) == r.taken


def test_training_order(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs)
    rows = mixing.training_order(plan).collect()
    key = ["doc_id", "source", "size", "start", "taken"]
    assert sorted(map(repr, plan.select(key).collect())) == sorted(repr(r) for r in mixing.training_order(plan).select(key).collect())
    first = [r.positions[0] if r.positions else math.inf for r in rows]
    assert first == sorted(first) and first[0] < math.inf
    assert all(bool(r.positions) == (r.taken > 0) for r in rows)
    placed = [(r.source, r.start, r.position) for r in mixing.with_positions(plan).collect()]
    assert sorted(map(repr, placed)) == sorted(repr((r.source, r.start, p)) for r in rows for p in r.positions)


def test_query_is_in_training_order(spark):
    plan = mixing.with_positions(mixing.mix_plan(Q.table(spark, SF_DIR, "documents"))).collect()
    want = list(dict.fromkeys(r.doc_id for r in plan))
    got = [r.doc_id for r in Q.op10_source_mixing(spark, SF_DIR).collect() if r.taken]
    assert got == want


def _value(knots, t):
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        if t <= t1:
            return m0 + (m1 - m0) * (t - t0) / (t1 - t0)
    return knots[-1][1]


@pytest.mark.parametrize("knots", [((0.0, 0.0), (1.0, 0.0)), ((0.1, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 4.0))])
def test_bad_schedules(knots):
    with pytest.raises(ValueError):
        mixing._pieces(knots)


def render(turns):
    text, mask = "", ""
    for _, role, body in turns:
        role, body = role or "", body or ""
        text += f"<|im_start|>{role}\n{body}<|im_end|>\n"
        head, tail = len(role) + 13, len(body) + 10
        mask += f"{head}-{tail}+1-" if role == "assistant" else f"{head + tail + 1}-"
    return text, mask


def test_preference_rows(spark):
    hi, ok, no = (1, "user", "hi"), (2, "assistant", "ok"), (2, "assistant", "no é")
    cases = {
        1: ([hi, ok], [hi, no]),
        2: ([hi, ok, (3, "user", "more"), (4, "assistant", "x")], [hi, ok, (3, "user", "more"), (4, "assistant", None)]),
        3: ([hi, ok], [hi, ok]),
        4: ([hi], [hi, no]),
        5: ([(None, "system", "s"), hi, ok], [hi, no]),
        6: ([(1, None, "x"), ok, ok], [(1, "", "x"), ok, no]),
        7: ([hi, ok], []),
    }
    rows = [(p, s, *t, "x") for p, both in cases.items() for s, side in zip(("chosen", "rejected"), both, strict=True) for t in side]
    rows += [(None, "chosen", 1, "user", "a", "x"), (None, "rejected", 1, "user", "a", "x"), (1, "third", 1, "user", "a", "x")]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.preference_rows(turns.repartition(5)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for pair, r in got.items():
        c, x = (sorted(side, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")) for side in cases[pair])
        n = 0
        while n < min(len(c), len(x)) and [v or "" for v in c[n][1:]] == [v or "" for v in x[n][1:]]:
            n += 1
        assert (r.common_turns, r.prompt) == (n, render(c[:n])[0])
        assert (r.chosen, r.chosen_mask) == render(c[n:]) and (r.rejected, r.rejected_mask) == render(x[n:])
        assert sum(map(int, re.findall(r"\d+", r.chosen_mask))) == len(r.chosen)
    assert chat.preference_rows(turns.limit(0)).collect() == []


def test_other_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "thanks"), (2, 0, "assistant", "early"), (2, None, "assistant", "none"), (2, 3, "assistant", "b2"), (2, 3, "assistant", "b2")]
    rows += [(3, 0, "user", "alone"), (4, 1, "assistant", None), (9, 1, "assistant", "last"), (None, 1, "assistant", "x"), (-(2**63), 1, "assistant", "least")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, said int").repartition(3)
    pairs = chat.with_other_answers(turns).collect()
    side = lambda c, s: sorted(((r.turn is not None, r.turn or 0), r.role, r.text) for r in pairs if r.pair_id == c and r.side == s)
    for conv in {r[0] for r in rows} - {None}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2], r[3] or "") for r in rows if r[0] == conv)
        assert side(conv, "chosen") == own
    assert [t[2] for t in side(1, "rejected")] == ["q", "b2", "thanks"]
    assert [t[2] for t in side(2, "rejected")] == ["none", "early", "", ""]
    assert side(3, "rejected") == side(3, "chosen") and [t[2] for t in side(4, "rejected")] == [""]
    got = {r.pair_id: r.common_turns for r in chat.preference_rows(chat.with_other_answers(turns)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 9: 0, -(2**63): 0}
    assert chat.with_other_answers(turns.limit(0)).collect() == []


def test_most_pairs_share_turns(spark):
    rows = Q.op8_chat_formatting(spark, SF_DIR).collect()
    assert len(rows) == Q.table(spark, SF_DIR, "conversations").select("conv_id").distinct().count()
    assert sum(r.common_turns > 0 for r in rows) > 0.9 * len(rows)
    # Some conversations are copies of the next one.
    assert sum(r.chosen != r.rejected for r in rows) > 0.7 * len(rows)
