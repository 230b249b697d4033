"""The registered queries of the operators, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm import caps, chat, contamination, exact_dedup, jaccard, language, mixing, paragraphs, pieces
from liftline.llm import prefix_trie, quality, suffixes, whitening
from liftline.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def held_out(doc: Column) -> Column:
    """The fold that is never learned from; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out(F.col("doc_id"))))
    return language.identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_langs"
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(table(spark, sf_dir, "documents"), pieces.load(PIECE_MODEL))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.embedding_components(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, with another last answer as the rejected one."""
    return chat.preference_rows(chat.with_other_answers(table(spark, sf_dir, "conversations")))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return labels.select("doc_id", F.col("quality").alias("label"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.quality_scores(docs, quality_labels(spark, sf_dir))
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in training order, with the positions of their first and last pass."""
    plan = mixing.training_order(mixing.mix_plan(table(spark, sf_dir, "documents")))
    first, last = F.get("positions", F.lit(0)), F.try_element_at("positions", F.lit(-1))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", "start", F.size("positions").alias("n_passes"),
        F.round(first, 9).alias("first_position"), F.round(last, 9).alias("last_position"),
    )


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.turn_paths(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(paths))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_language_id,
        op3_ngram_jaccard,
        op4_exact_dedup,
        op5_sentencepiece,
        op6_embedding_dedup,
        op7_substring_dedup,
        op8_chat_formatting,
        op9_quality_classifier,
        op10_source_mixing,
        op11_benchmark_decontamination,
        op12_prefix_trie,
        op13_embedding_whitening,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _position_sql(share: str) -> str:
    """The time at which a share of a source's words is due, by the schedule of its weight."""
    cases = []
    for weight, knots in zip(mixing.WEIGHTS, mixing.SHAPES, strict=True):
        for piece in reversed(mixing._pieces(knots)):
            need = f"({share} - {piece.before}::DOUBLE) * {piece.total}::DOUBLE"
            root = f"sqrt(greatest({piece.low**2}::DOUBLE + {2 * piece.slope}::DOUBLE * ({need}), 0::DOUBLE))"
            step = f"CASE WHEN {need} <= 0 THEN 0::DOUBLE ELSE 2 * ({need}) / ({piece.low}::DOUBLE + {root}) END"
            cases.append(f"WHEN weight = {weight} AND {share} >= {piece.before}::DOUBLE THEN {piece.start}::DOUBLE + least({step}, {piece.width}::DOUBLE)")
    return f"CASE {' '.join(cases)} END"


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(folded) AS text_sha256
FROM (
  SELECT doc_id, folded, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
  FROM (SELECT doc_id, {_FOLD} AS folded FROM documents)
  WINDOW same AS (PARTITION BY folded)
)""",
    "op8_chat_formatting": """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), said AS (
  SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) AS rn
    FROM given WHERE role = 'assistant') t WHERE rn = 1
), sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM given
  UNION ALL SELECT g.conv_id, 1, g.turn, g.role, CASE WHEN g.role = 'assistant' AND g.turn IS NOT DISTINCT FROM s.turn AND g.text = s.text
    THEN coalesce(o.text, '') ELSE g.text END
  FROM given g LEFT JOIN said s ON s.conv_id = g.conv_id LEFT JOIN said o ON o.conv_id = g.conv_id + 1
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM sides
), parts AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
    CASE WHEN role = 'assistant'
      THEN (length(role) + 13)::VARCHAR || '-' || (length(text) + 10)::VARCHAR || '+1-'
      ELSE (length(role) + length(text) + 24)::VARCHAR || '-' END AS mask
  FROM turns
), both_sides AS (
  SELECT pair_id FROM turns GROUP BY pair_id HAVING count(DISTINCT side) = 2
), steps AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
    coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (FROM turns WHERE side = 0) c FULL JOIN (FROM turns WHERE side = 1) r
    ON c.pair_id = r.pair_id AND c.pos = r.pos
), prefix AS (
  SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS common_turns FROM steps GROUP BY pair_id
)
SELECT pair_id, any_value(common_turns)::INTEGER AS common_turns,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 0 AND pos <= common_turns), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 0 AND pos > common_turns), '') AS chosen,
  coalesce(string_agg(mask, '' ORDER BY pos) FILTER (side = 0 AND pos > common_turns), '') AS chosen_mask,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 1 AND pos > common_turns), '') AS rejected,
  coalesce(string_agg(mask, '' ORDER BY pos) FILTER (side = 1 AND pos > common_turns), '') AS rejected_mask
FROM parts JOIN prefix USING (pair_id) JOIN both_sides USING (pair_id)
GROUP BY pair_id""",
    "op10_source_mixing": rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER earlier, 0)::BIGINT AS taken_before,
    sum(weight) OVER later AS weight_left
  FROM sources
  WINDOW earlier AS (ORDER BY 6 * source_size // weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY 6 * source_size // weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), capped AS (
  SELECT *, (total - taken_before)::DOUBLE * weight / weight_left > 3 * source_size AS cap FROM filled
), targets AS (
  SELECT source, source_size, weight,
    CASE WHEN cap THEN (3 * source_size)::DOUBLE
      ELSE (total - sum(CASE WHEN cap THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT::DOUBLE * weight
        / (sum(CASE WHEN cap THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM capped
), laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.weight,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, (greatest(0, least(size, floor(target)::BIGINT - start))
    + greatest(0, least(size, floor(target)::BIGINT - source_size - start))
    + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - start)))::BIGINT AS taken,
    CASE WHEN size = 0 OR floor(target)::BIGINT <= start THEN 0 WHEN floor(target)::BIGINT <= source_size + start THEN 1
      WHEN floor(target)::BIGINT <= 2 * source_size + start THEN 2 ELSE 3 END AS n_passes FROM laid
), shared AS (
  SELECT *, CASE WHEN n_passes > 0 THEN start::DOUBLE / target END AS first_share,
    CASE WHEN n_passes > 0 THEN ((n_passes - 1) * source_size + start)::DOUBLE / target END AS last_share FROM passed
)
SELECT doc_id, size, source_size, target, start, taken, n_passes,
  round({_position_sql("first_share")}, 9) AS first_position, round({_position_sql("last_share")}, 9) AS last_position
FROM shared""",
    "op11_benchmark_decontamination": rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_FOLD}, '{_LETTERS}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_FOLD}, '{_LETTERS}') AS w FROM documents
), places AS (
  SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (
  SELECT row, i, m, item_id FROM places JOIN windows USING (win, m)
), named AS (
  SELECT row, count(DISTINCT item_id) AS n_items, coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS ids
  FROM hits GROUP BY row
), covered AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS place FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN named USING (row) LEFT JOIN covered USING (row)""",
    "op12_prefix_trie": """
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id AS c, list(t ORDER BY pos) AS turns FROM ordered GROUP BY conv_id
), hashed AS (
  SELECT c, turns, xor(list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(range(1, length(c::VARCHAR) + 1),
      lambda k: [ascii(substr(c::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM convs
), rebuilt AS (
  SELECT a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:len(a.turns)] AS turns
  FROM hashed a LEFT JOIN convs b ON b.c = a.c - a.c % 5
), steps AS (
  SELECT c, d, len(turns) AS n, turns[1:d] AS prefix FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(prefix[d].text)) END AS saved, bool_and(n = d) AS leaf
  FROM steps GROUP BY d, prefix
), chains AS (
  SELECT s.c, v.d, v.conv_id, v.saved, v.leaf FROM steps s JOIN nodes v ON s.d = v.d AND s.prefix = v.prefix
), below AS (
  SELECT DISTINCT u.d AS d, u.conv_id AS conv_id, v.d AS below_d, v.conv_id AS below_id, v.saved, v.leaf
  FROM chains u JOIN chains v ON u.c = v.c AND u.d <= v.d
), sums AS (
  SELECT d, conv_id, count(*) FILTER (below_d = d + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM below GROUP BY d, conv_id
), parents AS (
  SELECT DISTINCT v.d, v.conv_id, u.conv_id AS parent_conv_id FROM chains v JOIN chains u ON u.c = v.c AND u.d = v.d - 1
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes JOIN sums USING (d, conv_id) LEFT JOIN parents USING (d, conv_id)""",
}
