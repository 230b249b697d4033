"""The corpus pipeline: five operators of ``liftline.llm``, one after the other.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline.llm import exact_dedup, jaccard, mixing, pieces, quality
from liftline.llm.queries import PIECE_MODEL, quality_labels
from liftline.llm.shared import prepare, settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go.

    Null and empty texts are scored like any other, without labels all stay; an empty table
    gives an empty one. All columns come along, whatever their names.
    """
    prepare(spark)
    stats = settle(quality.document_statistics(docs), "statistics")
    return quality.keep_good(docs, quality.train(stats, quality_labels(spark, sf_dir)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, as one row."""
    prepare(spark)
    kept = exact_dedup.exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha")
    )
    sha = F.sha2(exact_dedup.fold_ascii(F.col("text")), 256)
    rows = docs.withColumn("_sha", sha).withColumn("_doc", F.col("doc_id"))
    # A row is told by doc_id and text; rows that repeat both are one afterwards.
    same = F.col("k._doc").eqNullSafe(F.col("r._doc")) & (F.col("k._sha") == F.col("r._sha"))
    found = rows.alias("r").join(kept.distinct().alias("k"), same, "left_semi")
    return found.dropDuplicates(["_doc", "_sha"]).select(*[f"`{c}`" for c in docs.columns])


def row_identity() -> Column:
    """Tells rows apart by doc_id, text and source, nulls included; never null."""
    parts = [F.coalesce(F.concat(F.lit("a"), F.sha2(F.col(c).cast("string"), 256)), F.lit("b")) for c in ("doc_id", "text", "source")]
    return F.sha2(F.concat(*parts), 256)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, similarity 0.8, the least doc_id stays.

    Null is after all others. Of rows that share the least doc_id one stays, unless they
    are equal in doc_id, text and source.
    """
    prepare(spark)
    number = F.xxhash64(row_identity())
    found = jaccard.jaccard_components(docs.select(number.alias("doc_id"), "text"), k=5, percent=80)
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place")
    places = docs.select("doc_id", number.alias("_row")).distinct().select("_row", place)
    tied = places.join(found.distinct(), "_row")
    first = tied.groupBy("_component").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    kept = docs.withColumn("_row", number).join(first, "_row", "left_semi")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once per pass, always whole.

    Of the pass at a source's end, which the plan takes in part, the document stays if at least
    half of its words are taken, so each source comes to within half a document of its
    target. Rows may repeat a doc_id or have none; equal ones are numbered.
    """
    prepare(spark)
    rows = docs.withColumn("_row", row_identity())
    plan = settle(mixing.mix_plan(rows, keep=("_row",)), "plan")
    copy = F.row_number().over(Window.partitionBy("_row").orderBy("start", "taken"))
    plan = settle(plan.withColumn("_copy", copy), "numbered-plan")
    places = mixing.with_positions(plan)
    wanted = places.where(2 * F.col("words") >= F.col("size")).select("_row", "_copy", "position", "turn")
    # Only rows that occur more than once go through a window with their texts.
    often = settle(plan.where("_copy = 2").select("_row"), "often")
    alike = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(1)))
    single = rows.join(often, "_row", "left_anti").withColumn("_copy", F.lit(1))
    rows = single.unionByName(rows.join(often, "_row", "left_semi").withColumn("_copy", alike))
    # Names of the given columns may be those of the plan.
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given")
    rows = rows.select("_row", "_copy", given).join(wanted, ["_row", "_copy"])
    order = ["position", "_given.doc_id", "turn", "_row", "_copy"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(*[F.col("_given").getField(c).alias(c) for c in docs.columns])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, row by row; null and empty texts have none, other columns go."""
    prepare(spark)
    return pieces.encode_rows(docs, pieces.load(PIECE_MODEL))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

# A boosted forest cannot be written in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
