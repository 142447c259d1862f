"""Benchmark passages in documents, with DataFrame functions only.

A document window as long as a benchmark item, and at least 0.75 similar to it, shares a five-word shingle with it.
Shared shingles therefore name the windows worth a look: the item laid over the document so that the shingle falls on
itself. Each window gets a 64-bit SimHash of its shingles, weighted by how often they occur. Fingerprints are cut into
RADIUS + 1 blocks; two that differ in at most RADIUS bits agree in one block, so an equality join on the blocks finds
all of them. What is left is verified by the exact weighted Jaccard similarity of the shingles.

At a similarity of 0.75 the fingerprints are expected to differ in 11 bits with a deviation of 3; RADIUS is four
deviations above that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.session import cut_lineage

SHINGLE = 5
RADIUS = 23
SIMILARITY = 0.75

BROADCAST_SHINGLES = 2_000_000
"""Benchmark shingles (about 24 bytes each) up to which they are sent to every task; more are joined by a shuffle."""


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, size: str) -> Column:
    """Hashes of all runs of ``size`` words; empty where there are fewer."""
    return F.expr(
        f"IF(size({words}) >= {size}, transform(sequence(1, size({words}) - {size} + 1), "
        f"i -> xxhash64(slice({words}, i, {size}))), array())"
    )


def _simhash(hashes: str) -> Column:
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | IF(aggregate({hashes}, 0, "
        f"(s, h) -> s + IF((shiftright(h, b) & 1L) = 1L, 1, -1)) >= 0, shiftleft(1L, b), 0L))"
    )


def _blocks(fingerprint: str) -> Column:
    """(block, value) of the RADIUS + 1 blocks of a fingerprint."""
    n = RADIUS + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
    )


def item_table(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, words, length, size (of shingles), shingles, fingerprint."""
    items = benchmark.select("item_id", word_list(F.col("text")).alias("words")).distinct()
    items = items.withColumn("length", F.size("words")).filter("length > 0")
    items = items.withColumn("size", F.least(F.lit(SHINGLE), F.col("length")))
    items = items.withColumn("shingles", _shingles("words", "size"))
    return items.withColumn("fingerprint", _simhash("shingles")).withColumn(
        "item_key", F.xxhash64("item_id", "words")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, row_key, item_id, start_word, n_words, similarity.

    ``row_key`` is a hash of doc_id and text; repeated rows give one result. The best window counts, of equal ones the
    first. Null and wordless texts and items match nothing. An item of fewer than five words is one shingle.
    """
    items = cut_lineage(item_table(benchmark))
    marks = items.select(
        "item_key", "item_id", "length", "size", F.posexplode("shingles").alias("at", "shingle")
    )
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most five values
    if marks.count() <= BROADCAST_SHINGLES:
        marks = F.broadcast(marks)
    texts = docs.select(
        "doc_id",
        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"),
        word_list(F.col("text")).alias("words"),
    )
    found = None
    for size in sorted(sizes) or [SHINGLE]:
        seen = texts.select("*", F.posexplode(_shingles("words", str(size))).alias("pos", "shingle"))
        hits = seen.join(marks.filter(F.col("size") == size), "shingle").withColumn(
            "start_word", F.greatest(F.col("pos") - F.col("at"), F.lit(0))
        )
        windows = hits.select(
            "doc_id", "row_key", "item_key", "item_id", "length", "size", "start_word",
            F.expr("concat_ws(' ', slice(words, start_word + 1, length))").alias("passage"),
        )
        found = windows if found is None else found.union(windows)
    place = ["row_key", "item_key", "start_word"]
    windows = found.groupBy(*place).agg(
        *[F.max(c).alias(c) for c in ("doc_id", "item_id", "length", "size", "passage")]
    )
    windows = windows.withColumn("words", F.split("passage", " ")).withColumn("shingles", _shingles("words", "size"))
    windows = cut_lineage(
        windows.filter(F.size("shingles") > 0)
        .withColumn("fingerprint", _simhash("shingles"))
        .select(*place, "doc_id", "item_id", "length", "shingles", "fingerprint")
    )

    one = windows.select(*place, "length", "fingerprint", F.inline(_blocks("fingerprint")))
    two = items.select(
        F.col("item_key").alias("other"), "length", F.col("fingerprint").alias("print"), F.inline(_blocks("fingerprint"))
    )
    near = (
        one.join(two, ["length", "block", "value"])
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("print"))) <= RADIUS)
        # Another item's windows were made from its own shingles.
        .filter("other = item_key")
        .select(*place)
        .distinct()
    )
    near = windows.join(near, place).select(*place, "doc_id", "item_id", "shingles")

    mine = (
        near.select(*place, "doc_id", "item_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
        .groupBy(*place, "shingle")
        .agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"))
    )
    theirs = (
        items.select("item_key", F.size("shingles").alias("m"), F.size("words").alias("n_words"), F.explode("shingles").alias("shingle"))
        .groupBy("item_key", "shingle")
        .agg(F.count(F.lit(1)).alias("their_times"), F.max("m").alias("m"), F.max("n_words").alias("n_words"))
    )
    shared = (
        mine.join(theirs, ["item_key", "shingle"])
        .groupBy(*place)
        .agg(
            F.sum(F.least("times", "their_times")).alias("shared"),
            *[F.max(c).alias(c) for c in ("n", "m", "doc_id", "item_id", "n_words")],
        )
        .withColumn("similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
        .filter(F.col("similarity") >= SIMILARITY)
    )
    return (
        shared.groupBy("row_key", "item_key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("item_id").alias("item_id"),
            F.max("n_words").alias("n_words"),
            F.min(F.struct((-F.col("similarity")).alias("s"), "start_word")).alias("best"),
        )
        .select(
            "doc_id", "row_key", "item_id", F.col("best.start_word").alias("start_word"), "n_words",
            (-F.col("best.s")).alias("similarity"),
        )
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``."""
    key = "__row_key"
    bad = contaminated(docs, benchmark).select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return keyed.join(cut_lineage(bad), key, "left_anti").select(*docs.columns)
