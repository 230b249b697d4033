"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of consecutive words of a benchmark item, its set the word shingles in it
with their places. A document holds a window only if it holds all of that set, so one
shingle is a necessary prefix: with shingles ordered by rarity, the rarest. Prefix shingles
are joined with the shingles of documents by equality; the place of the shingle in the
window and in the document gives the one place the window could have, which must lie inside
the document (positional and length bounds); the words there are then compared one by one.

Documents are read twice, without a shuffle of their texts: once to count how often each
shingle of the benchmark stands in them, once for the places of prefix shingles. A bitmap of
fixed largest size keeps other shingles inside the tasks, so the benchmark itself is
never sent to all tasks, and the joins are Spark's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from liftline.llm import text as T
from liftline.llm.shared import settle
from liftline.operators.keyed import skew_safe_join

WINDOW, SHINGLE = 10, 3
# The bitmap has about so many bits per shingle, and at most 2 ** MOST_BITS (16 MB): with more
# shingles it lets more through, which the joins then leave out.
BITS_PER_SHINGLE, MOST_BITS = 256, 27
# Counts are put together within a task until so many shingles have been gathered.
GATHER = 1_000_000

# Digits, letters and all bytes above ASCII belong to words, A-Z as a-z; the others part them.
_WORD_BYTE = np.full(256, 0x20, np.uint8)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_WORD_BYTE[0x41:0x5B] = range(0x61, 0x7B)
_FOUND = S.ArrayType(
    S.StructType(
        [
            S.StructField("token", S.LongType()),
            S.StructField("at", S.LongType()),
            S.StructField("ahead", S.IntegerType()),
            S.StructField("words", S.ArrayType(S.StringType())),
        ]
    )
)
_PLACES = T.mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


class Words:
    """The words of a slice, with the hash of each."""

    def __init__(self, piece: T.Slice) -> None:
        folded = T.Slice(piece.first, _WORD_BYTE[piece.data], piece.offsets)
        self.data = folded.data
        self.starts, self.ends, self.first = T.words(folded)
        self.hashes = T.span_hashes(self.data, self.starts, self.ends, fold=False)
        self.count = np.diff(self.first)
        self.stop = np.repeat(self.first[1:], self.count)

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words inside a text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.full(n, np.uint64(length))
        for j in range(length):
            total += self.hashes[j : j + n] * _PLACES[j]
        inside = np.flatnonzero(np.arange(n) + length <= self.stop[:n])
        return inside, T.mix(total[inside])

    def listed(self, first: int, last: int) -> list[str]:
        """The words from ``first`` to before ``last``."""
        return [self.data[a:b].tobytes().decode() for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)]


def _windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``window`` (words parted by spaces), ``m``, ``tokens`` (by place), ``items`` of every window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for piece in T.slices(batch.column("text")):
                words, rows = Words(piece), []
                hashes = {length: dict(zip(*(x.tolist() for x in words.shingles(length)), strict=True)) for length in range(1, shingle + 1)}
                for i, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=False)):
                    m, own = min(n, window), words.listed(a, a + n)
                    length = min(m, shingle)
                    for start in range(n - m + 1 if n else 0):
                        tokens = [hashes[length][a + start + j] for j in range(m - length + 1)]
                        rows.append((ids[piece.first + i], " ".join(own[start : start + m]), m, np.array(tokens, np.uint64).view(np.int64).tolist()))
                columns = [[r[k] for r in rows] for k in range(4)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "window", "m", "tokens"])

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    found = given.mapInArrow(cut, "item string, window string, m int, tokens array<long>")
    same = found.groupBy("window").agg(F.first("m").alias("m"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))
    # Windows of the same items are one class, so that items are listed once per class.
    return same.withColumn("class", F.sha2(F.to_json("items"), 256))


def _bitmap(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the shingles in ``token``, addressed by their upper bits."""
    tokens = tokens.select("token").distinct()
    bits = min(MOST_BITS, max(15, (BITS_PER_SHINGLE * tokens.count()).bit_length()))
    # The functions number bits from 1 and put 32,768 into a bucket.
    place = F.shiftrightunsigned("token", 64 - bits) + 1
    rows = tokens.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")
    )
    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.collect():  # at most 2 ** (bits - 15) rows of 4 kB
        found[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.part, np.uint8)
    return found, bits


def _marked(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return np.flatnonzero((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)


def _occurrences(docs: DataFrame, lengths: list[int], bitmap: np.ndarray, bits: int) -> DataFrame:
    """``token``, ``n``: how often the marked shingles stand in documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches:
            for piece in T.slices(batch.column("text")):
                words = Words(piece)
                for length in lengths:
                    _, hashes = words.shingles(length)
                    parts.append(hashes[_marked(hashes, bitmap, bits)])
                    size += len(parts[-1])
                if size > GATHER:
                    yield out()
                    parts, size = [], 0
        yield out()

    rows = docs.select("text").mapInArrow(counted, "token long, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, lengths: list[int], window: int, bitmap: np.ndarray, bits: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, and ``found``: marked shingles with the words around."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch.column("text")):
                words, at, hashes = Words(piece), [], []
                for length in lengths:
                    where, values = words.shingles(length)
                    marked = _marked(values, bitmap, bits)
                    at.append(where[marked])
                    hashes.append(values[marked])
                at, hashes = np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, np.uint64)])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                text = np.searchsorted(words.first, at, "right") - 1
                low = np.maximum(at - window + 1, words.first[text])
                high = np.minimum(at + window, words.first[text + 1])
                around = [words.listed(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)), pa.array(at - words.first[text]), pa.array((at - low).astype(np.int32)),
                        pa.array(around, pa.list_(pa.string())),
                    ],
                    names=["token", "at", "ahead", "words"],
                )
                offsets = np.searchsorted(text, np.arange(piece.n + 1)).astype(np.int32)
                own = batch.slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("doc_id"), pa.array(words.count), pa.ListArray.from_arrays(pa.array(offsets), found)],
                    ["row", "doc_id", "n_words", "found"],
                )

    schema = S.StructType(
        [
            S.StructField("row", S.LongType()),
            S.StructField("doc_id", docs.schema["doc_id"].dataType),
            S.StructField("n_words", S.LongType()),
            S.StructField("found", _FOUND),
        ]
    )
    # The result is written before it is read twice, so each row keeps its number.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(placed, schema)


def covered(spans: Column) -> Column:
    """Number of places in sorted spans, those of several counted once."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))

    def add(so_far: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0).cast("bigint"), span["end"] - F.greatest(span["start"], so_far["reach"]))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["reach"], span["end"]).alias("reach"))

    return F.aggregate(spans, start, add, lambda x: x["n"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``spans``, ``n_items``, ``items`` per row of ``doc_id``, ``text``.

    Words are runs of letters, digits and anything above ASCII, A-Z as a-z. A window has
    ``window`` words in sequence of a row of ``benchmark`` (``item_id``, ``text``); a row of
    fewer words is one window, one without words or with null text has none. ``n_hit`` words
    of a document lie in occurrences of windows, ``spans`` has their word numbers from 0
    (``start`` to before ``end``; those of different windows can overlap). ``items`` are the different
    item_ids with occurring windows as strings, sorted; a window of a row without item_id
    counts for ``n_hit`` alone. Rows that repeat an item_id are one item with the windows of
    all. Documents are judged row by row, whatever their doc_id, null and repeated ones
    included; null and empty texts have no words. More columns are ignored. An empty table
    of documents gives an empty result, an empty benchmark no hits.
    """
    windows = settle(_windows(benchmark, window, shingle), "windows")
    each = windows.select("window", "m", "class", F.posexplode("tokens").alias("offset", "token"))
    lengths = sorted(r[0] for r in windows.select(F.least("m", F.lit(shingle))).distinct().collect())
    often = _occurrences(docs, lengths, *_bitmap(each))
    ranked = skew_safe_join(each, often, ["token"], "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"),
        F.first("m").alias("m"), F.first("class").alias("class"),
    )
    # A window with a shingle that no document has stands in none.
    prefix = ranked.where("rarest.n > 0").select(F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), "window", "m", "class")
    prefix = settle(prefix, "prefix")
    rows = settle(_places(docs, lengths, window, *_bitmap(prefix)), "places")

    places = rows.select("row", F.explode("found").alias("p")).select("row", "p.*")
    bounds = (F.col("offset") <= F.col("ahead")) & (F.col("ahead") - F.col("offset") + F.col("m") <= F.size("words"))
    here = F.array_join(F.slice("words", F.col("ahead") - F.col("offset") + 1, F.col("m")), " ")
    found = skew_safe_join(places, prefix, ["token"], "inner").where(bounds).where(here == F.col("window"))
    span = F.struct((F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("m")).alias("end"))
    hits = settle(
        found.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("class")).alias("classes")),
        "hits",
    )
    # Items are put together once per different set of classes, not once per document.
    sets = hits.select("classes").distinct().withColumn("class", F.explode("classes"))
    named = windows.select("class", "items").dropDuplicates(["class"])
    items = sets.join(named, "class").groupBy("classes").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = skew_safe_join(hits, items, ["classes"], "inner").drop("classes")

    no_spans, no_items = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    return rows.select("row", "doc_id", "n_words").join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", no_spans).alias("spans"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", no_items).alias("items"),
    )
