"""The pipeline against a plain version of its stages, and stage by stage on odd rows."""

from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from liftline.llm import jaccard, pieces, quality
from liftline.llm import queries as Q
from liftline.llm.shared import prepare, table
from tests.llm import brute
from tests.llm.test_mixing_and_chat import mix_brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def kept_until_mixing(spark, rows):
    docs = table(spark, SF_DIR, "documents")
    scores = quality.quality_scores(docs, Q.quality_labels(spark, SF_DIR)).collect()
    good = {r.doc_id for r in scores if r.score >= 0.5}
    rows = [r for r in rows if r.doc_id in good]
    last = {}
    for r in rows:
        text = (r.text or "").translate(brute._FOLD)
        last[text] = max(last.get(text, r.doc_id), r.doc_id)
    rows = [r for r in rows if last[(r.text or "").translate(brute._FOLD)] == r.doc_id]
    near = brute.jaccard_components([(r.doc_id, r.text) for r in rows], 5, 80)
    first = {d for d, _, c in near if d == c}
    return [r for r in rows if r.doc_id in first]


def test_pipeline_against_plain_version(spark):
    rows = table(spark, SF_DIR, "documents").collect()
    kept = kept_until_mixing(spark, rows)
    encoder, want = pieces.Encoder(pieces.load(Q.PIECE_MODEL)), Counter()
    text = {r.doc_id: r.text for r in kept}
    for doc, size, _, _, taken in mix_brute([(r.doc_id, r.text, r.source) for r in kept]):
        for _ in range(taken // size if size else 0):
            want[doc, tuple(encoder.encode(text[doc]).tolist())] += 1
        if size and 2 * (taken % size) >= size:
            want[doc, tuple(encoder.encode(text[doc]).tolist())] += 1
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.exact for r in got)


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns
        before = spark.createDataFrame(after.collect(), docs.schema)
        assert before.count() > 0.5 * docs.count()


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_rows(spark, number):
    docs = table(spark, SF_DIR, "documents")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "a", 0), (10**6 + 2, "Tiny", "en", None, 4)]
    odd += [(10**6 + 3, "word " * 30000, "en", "a", 150000)]
    if number < 3:
        odd += [odd[2], (None, "no id", "en", "a", 5), (None, None, None, None, None)]
    more = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as score", "'x' as key", "2 as _sha_")
    more = more.withColumnRenamed("_sha_", "size")
    name, stage = corpus_pipeline.STAGES[number]
    rows = stage(spark, more, SF_DIR)
    assert rows.count() > 0 and (number == 4 or rows.columns == more.columns)
    ids = Counter(r.doc_id for r in rows.collect())
    if name == "exact dedup":
        assert ids[10**6 + 2] == 1 and ids[10**6] + ids[10**6 + 1] + ids[None] == 2
    if name == "n-gram Jaccard join":
        assert ids[10**6] == ids[10**6 + 1] == 1
    assert stage(spark, more.limit(0), SF_DIR).count() == 0


def test_repeated_and_null_ids_through_all_stages(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    base, far = [f"w{i}" for i in range(60)], " ".join(f"v{i}" for i in range(60))
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    odd = [(10**6, near(0), "en", "a", 5), (None, near(1), "en", "a", 5), (None, far, "en", "a", 5), (10**6 + 1, near(2), "en", "a", 5)]
    odd += [(10**6 + 1, "one two three", "en", "a", 5), (None, None, None, None, None), (10**6 + 2, "Tiny", "en", None, 4)]
    more = docs.union(spark.createDataFrame([*odd, odd[-1]], docs.schema))
    rows = corpus_pipeline.near_stage(spark, more, SF_DIR).where("doc_id is null or doc_id >= 1000000").collect()
    left = Counter((r.doc_id, r.text) for r in rows)
    assert left == {(10**6, near(0)): 1, (None, far): 1, (10**6 + 1, "one two three"): 1, (None, None): 1, (10**6 + 2, "Tiny"): 2}
    plan = Counter()
    for r in corpus_pipeline.mixing.mix_plan(more).collect():
        if r["size"]:
            plan[r.doc_id] += r.taken // r["size"] + (2 * (r.taken % r["size"]) >= r["size"])
    mixed = corpus_pipeline.mixing_stage(spark, more, SF_DIR)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +plan
    more.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF_DIR, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_last_document_of_a_source_is_whole(spark):
    docs = table(spark, SF_DIR, "documents")
    long = "word " * 29_999 + "end"
    rows = [(1, long, "en", "a", 1), (2, "x " * 10_000, "en", "b", 1), (3, "short", "en", "b", 1)]
    mixed = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, docs.schema), SF_DIR).collect()
    # Weights 1 and 2 of 40,001 words: the long one to 44 %, so it goes; the third pass of the others to 67 %.
    assert Counter(r.doc_id for r in mixed) == {2: 3, 3: 2}
    assert {r.text for r in mixed} == {"x " * 10_000, "short"}


def test_entry_points_have_all():
    names = set(entry_points.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry_points.oracle_sql()) <= names


def test_near_stage_links_a_large_group_of_copies_once(spark, monkeypatch):
    docs, n = table(spark, SF_DIR, "documents"), 600
    texts = [[f"w{j}" if (j * 7 + i) % 300 else f"x{i}" for j in range(300)] for i in range(n)]
    rows = [(10 + i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    rows += [(5000 + i, " ".join(f"q{i}w{j}" for j in range(50)), "en", "a", 0) for i in range(3)]
    links, settled = [], jaccard.settle

    def settle(found, name):
        found = settled(found, name)
        if name == "links":
            links.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "settle", settle)
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, docs.schema).repartition(4), SF_DIR)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 5000, 5001, 5002]
    # Copies are more than a chunk holds; a link for each of them and each other chunk grows with the square.
    assert len(links) > 1 and max(links) <= n
