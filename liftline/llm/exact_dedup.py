"""Exact deduplication by deterministic block naming, on DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
each takes an integer, its name. Then adjacent names are paired, the distinct pairs are
sorted and named, and so on, until a text has one name. Names come from sorting, not
hashing, so two texts share one exactly when they are equal: no collision can join them.

Only texts that share hash and length with another row take part; any other row is its
own class already. That keeps the shuffled text near the size of the real copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm.shared import settle

BLOCK_BYTES = 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _named(rows: DataFrame, content: list[str]) -> DataFrame:
    """``rows`` with ``name``: the place of their ``content`` among the sorted distinct ones.

    The sort is spread over range partitions; a name is the partition's number and the
    row's place in it, which grows along the order. Equal content is reduced before it
    is shuffled, and the rows of frequent content are split by AQE in the join.
    """
    distinct = rows.select(*content).distinct()
    ranked = (
        distinct.repartitionByRange(*content)
        .sortWithinPartitions(*content)
        .withColumn("name", F.monotonically_increasing_id())
    )
    return rows.join(ranked, content)


def block_identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc``, ``fp``, ``level``, ``name`` for ``doc``, ``fp``, ``folded`` (text).

    ``level`` is the number of pairing rounds the length of the text asks for; texts
    agree on (``level``, ``name``) exactly when they are equal.
    """
    key = ["doc", "fp"]
    raw = F.col("folded").cast("binary")
    count = F.greatest(F.ceil(F.octet_length("folded") / block_bytes).cast("int"), F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)),
    )
    cut = texts.select(*key, count.alias("left"), F.posexplode(blocks).alias("at", "block"))
    # Rows whose doc and fp repeat are one text; their blocks meet in the pairing below.
    named = settle(_named(cut, ["block"]).select(*key, "left", "at", "name").distinct(), "blocks")
    level, done = 0, []
    while True:
        done.append(named.where("left = 1").select(*key, F.lit(level).alias("level"), "name"))
        rest = named.where("left > 1")
        if rest.limit(1).count() == 0:
            break
        level += 1
        pairs = rest.groupBy(*key, "left", F.expr("at div 2").cast("int").alias("pair")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("one"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("two"),
        )
        named = settle(
            _named(pairs, ["one", "two"]).select(
                *key, F.expr("(left + 1) div 2").cast("int").alias("left"),
                F.col("pair").alias("at"), "name",
            ),
            "pairs",
        )
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Equal texts of ``doc_id``, ``text``; more columns are ignored.

    One row per input row: ``doc_id``, ``keep_id`` (the largest doc_id of the equal
    texts), ``group_size`` (rows), ``kept``, ``text_sha256`` (of the folded text). Null
    text counts as empty, so null and empty texts are one group. Rows that repeat a
    doc_id and its text count as rows and are all kept if that doc_id is. A null doc_id
    is below every other. An empty table gives an empty result.
    """
    folded = fold_ascii(F.col("text"))
    base = settle(
        docs.select(F.col("doc_id").alias("doc"), folded.alias("folded")).select(
            "doc",
            F.xxhash64("folded").alias("fp"),
            F.octet_length("folded").alias("n"),
            F.sha2("folded", 256).alias("sha"),
        ),
        "texts",
    )
    sizes = base.groupBy("fp", "n").agg(F.count("*").alias("rows"))
    shared = base.join(sizes.where("rows > 1").drop("rows"), ["fp", "n"], "left_semi")
    ids = shared.select(F.col("doc").alias("_id")).distinct()
    raw = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = raw.select(F.col("doc_id").alias("doc"), folded.alias("folded"))
    texts = texts.withColumn("fp", F.xxhash64("folded"))
    names = block_identities(texts.select("doc", "fp", "folded"), block_bytes)
    names = names.select(F.col("doc").alias("_doc"), F.col("fp").alias("_fp"), "level", "name")
    with_names = settle(
        base.join(
            names, base["doc"].eqNullSafe(names["_doc"]) & (base["fp"] == names["_fp"]), "left"
        ).select("doc", "sha", "level", "name"),
        "names",
    )
    found = with_names.where("name is not null")
    groups = found.groupBy("level", "name").agg(
        F.max("doc").alias("keep_id"), F.count("*").alias("group_size")
    )
    alone = with_names.where("name is null").select(
        "doc", F.col("doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    joined = found.join(groups, ["level", "name"]).select("doc", "keep_id", "group_size", "sha")
    return joined.union(alone).select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

