"""Quality rules: word statistics, fixed limits, and robust multivariate outliers.

Each document's statistics become a vector of six transformed shares. Per language and source, the minimum covariance
determinant is sought by concentration steps: the half of the vectors nearest to the present centre gives the next
centre and covariance. Steps begin at several starts and end when no determinant falls any more; per key the fit of
the least determinant is kept. A document is rejected when its Mahalanobis distance from its group's estimate is
large. Vectors are whole numbers, so that sums, and with them the estimates, don't depend on the order of rows; the
quantiles come from counts per step of distance, so that a group of any size is only ever aggregated.

Groups of fewer than MIN_GROUP documents use their language's estimate, small languages the one of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship
from hallkeeper.session import cut_lineage

MIN_WORDS = 50
MAX_REPEATED = 50
"""Per cent of the words that may lie in repeated three-word windows."""

MIN_GROUP = 200
CORE = 0.5
"""Share of a group's vectors that the estimate rests on."""

STEPS = 30
"""Steps at most; they end before when no determinant falls by more than a thousandth."""

SMALL = 16
"""Tasks that write a table with few rows per group."""

SCALE = 1000
"""Vectors are given in thousandths."""

FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")

LEAST_SPREAD = (120, 50, 300, 300, 80, 60)
"""The least standard deviation of each feature, in thousandths: smaller differences never count as odd."""

CUTOFF = 60.0
"""Squared distance from which a document is rejected; 22.5 leaves out one in a thousand of a normal group of six."""

_MEDIAN = 5.348
"""The median of squared distances in six dimensions."""

_BYTES = np.zeros((4, 256), dtype=bool)
_BYTES[0, [ord(c) for c in "#*$%&|<>"]] = True
_BYTES[1, [b for b in range(256) if 0x80 <= b < 0xC0]] = True
_BYTES[2, ord("A") : ord("Z") + 1] = True
_BYTES[3, [ord(c) for c in "!\"'()+,-./:;=?@[\\]^_`{}~"]] = True


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the lines with a word, and those of them that equal an earlier one."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    feeds = np.flatnonzero(data == 0x0A)
    start = np.union1d(feeds + 1, offsets[:-1])
    start = start[start < len(data)]
    end = np.minimum(np.r_[start[1:], len(data)], len(data))
    end = np.where((end > start) & (data[end - 1] == 0x0A), end - 1, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    worded = sums[end] > sums[start]
    doc, key = doc[worded], W.range_hash(data, start[worded], end[worded])
    lines = np.bincount(doc, minlength=n)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])] if len(key) else np.zeros(0, bool)
    return lines, np.bincount(doc[again], minlength=n)


def _repeats(w: W.Words) -> np.ndarray:
    """Words per document that lie in a three-word window found twice or more in the document."""
    n = len(w.bounds) - 1
    if len(w.hash) < 3:
        return np.zeros(n, np.int64)
    doc, key = w.doc[:-2], w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(0x9E3779B97F4A7C15)
    key = W.mix(key + w.hash[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(doc == w.doc[2:])
    key = W.mix(key[at])
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(w.hash), bool)
    if len(twice):
        hit = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        for k in range(3):
            covered[hit + k] = True
    return np.bincount(w.doc[covered], minlength=n)


_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, offsets = W.text_bytes(batch.column("text"))
    w = W.words(data, offsets)
    inside = ~W.SPACE[data]
    n_words = np.diff(w.bounds)
    chars = _per_doc(inside & ~_BYTES[1][data], offsets)
    symbols = _per_doc(_BYTES[0][data], offsets)
    lines, dup_lines = _lines(data, offsets, inside)
    repeats = _repeats(w)
    capitals, marks = _per_doc(_BYTES[2][data], offsets), _per_doc(_BYTES[3][data], offsets)
    some, base = np.maximum(n_words, 1), np.maximum(chars, 1)
    vector = (
        np.log(base / some),
        np.sqrt(symbols / base),
        np.sqrt(dup_lines / np.maximum(lines, 1)),
        np.sqrt(repeats / some),
        np.sqrt(capitals / base),
        np.sqrt(marks / base),
    )
    out = dict(zip(_STATISTICS, (n_words, chars, symbols, dup_lines, repeats), strict=True))
    return out | {f: np.rint(v * SCALE).astype(np.int64) for f, v in zip(FEATURES, vector, strict=True)}


def _with_text(batches: Iterator[pa.RecordBatch], row: str) -> Iterator[pa.RecordBatch]:
    """The batches with the text inside their whole rows as a column."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        yield pa.record_batch(columns | {"text": batch.column(row).field("text")})


def _measure(kept: tuple[str, ...], row: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(_with_text(batches, row) if row else batches):
            columns = {c: batch.column(c) for c in kept}
            yield pa.record_batch(columns | {k: pa.array(v, pa.int64()) for k, v in _statistics(batch).items()})

    return run


def _group_key(level: str, *columns: str) -> Column:
    """A group's name, with its level; null is a value of its own."""
    names = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)])
    return F.concat(F.lit(f"{level} "), F.to_json(names, {"ignoreNullFields": "false"}))


def statistics(docs: DataFrame, *kept: str, row: str | None = None) -> DataFrame:
    """The ``kept`` columns, the group, the word statistics, the vector, and base_failed of each document.

    ``row`` names a kept struct that holds the text, which then isn't sent a second time.
    """
    ship(docs.sparkSession)
    texts = docs.select(*kept, *([] if row else ["text"]), _group_key("group", "lang", "source").alias("group"), _group_key("language", "lang").alias("language"))
    names = (*kept, "group", "language")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in names]
    longs = [f"{c} long" for c in (*_STATISTICS, *FEATURES)]
    return texts.mapInArrow(_measure(names, row), ", ".join(fields + longs)).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance() -> Column:
    """The squared distance of a vector from the centre m0..m5 with the inverse covariance i00..i55."""
    away = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = [F.col(f"i{i}{j}") * away[i] * away[j] * (1 if i == j else 2) for i, j in _pairs()]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _step_of(distance: Column) -> Column:
    """Distances in steps of about one per cent."""
    return F.floor(F.log2(1 + 1000 * distance) * 64).cast("int")


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres and inverse covariances from sums; the least spread is added to the diagonal."""
    p = len(FEATURES)
    floor = np.diag(np.array(LEAST_SPREAD, float) ** 2)
    for batch in batches:
        n = batch.column("n").to_numpy().astype(float)
        mean = np.stack([batch.column(f"s{i}").to_numpy() / n for i in range(p)], 1)
        cov = np.zeros((len(n), p, p))
        for i, j in _pairs():
            cov[:, i, j] = cov[:, j, i] = batch.column(f"q{i}{j}").to_numpy() / n - mean[:, i] * mean[:, j]
        inverse = np.linalg.inv(cov + floor)
        spread = np.linalg.slogdet(cov + floor)[1]
        yield pa.record_batch(
            {"key": batch.column("key"), "start": batch.column("start"), "spread": spread}
            | {f"m{i}": mean[:, i] for i in range(p)}
            | {f"i{i}{j}": inverse[:, i, j] for i, j in _pairs()}
        )


_FIT = ", ".join(
    ["key string", "start int", "spread double", *[f"m{i} double" for i in range(len(FEATURES))], *[f"i{i}{j} double" for i, j in _pairs()]]
)


def _starts(rows: DataFrame) -> DataFrame:
    """Per key several starts: the exact medians, lower and upper quartiles of each feature; spread floors as covariance."""
    long = rows.select(
        "key", "home", F.posexplode(F.array(*[F.col(f) for f in FEATURES])).alias("feature", "value")
    )
    counts = long.groupBy("key", "home", "feature", "value").count()
    up = Window.partitionBy("key", "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key", "feature")
    below = counts.withColumn("below", F.sum("count").over(up)).withColumn("all", F.sum("count").over(whole))
    middle = below.groupBy("key", "home", "feature").agg(
        F.array(
            *[F.min(F.when(F.col("below") >= q * F.col("all"), F.col("value"))) for q in (0.5, 0.25, 0.75)]
        ).alias("values")
    )
    wide = middle.groupBy("key", "home").agg(
        *[F.max(F.when(F.col("feature") == i, F.col("values"))).alias(f"v{i}") for i in range(len(FEATURES))]
    )
    own = wide.select("key", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("start"), *[f"v{i}" for i in range(len(FEATURES))])
    # The language's medians are a start of its groups too.
    lead = wide.select(F.col("key").alias("home"), *[f"v{i}" for i in range(len(FEATURES))])
    home = wide.filter("home is not null").select("key", "home").join(lead, "home").select(
        "key", F.lit(3).alias("start"), *[f"v{i}" for i in range(len(FEATURES))]
    )
    pick = F.when(F.col("start") == 3, 0).otherwise(F.col("start"))
    # The first distances count each feature in units of the spread it needs to be odd.
    return own.union(home).select(
        "key", "start", F.lit(float("inf")).alias("spread"),
        *[F.get(F.col(f"v{i}"), pick).cast("double").alias(f"m{i}") for i in range(len(FEATURES))],
        *[F.lit(1.0 / LEAST_SPREAD[i] ** 2 if i == j else 0.0).alias(f"i{i}{j}") for i, j in _pairs()],
    )


def _quantile(rows: DataFrame, share: float) -> DataFrame:
    """Per key and start the first step of distance that ``share`` of the rows don't exceed."""
    counts = rows.groupBy("key", "start", "step").count()
    up = Window.partitionBy("key", "start").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("below", F.sum("count").over(up))
        .withColumn("all", F.sum("count").over(Window.partitionBy("key", "start")))
        .filter(F.col("below") >= share * F.col("all"))
        .groupBy("key", "start").agg(F.min("step").alias("limit"), F.max("all").alias("size"))
    )


def _core(away: DataFrame) -> DataFrame:
    """Per key and start the count and moments of the nearest CORE of the rows, whole steps of distance at a time.

    Rows are summed up per step once; which steps belong to the core follows from those sums.
    """
    moments = {"n": F.lit(1), **{f"s{i}": F.col(f) for i, f in enumerate(FEATURES)}}
    moments |= {f"q{i}{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i, j in _pairs()}
    steps = away.groupBy("key", "start", "step").agg(*[F.sum(v.cast("long")).alias(c) for c, v in moments.items()])
    nearer = Window.partitionBy("key", "start").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    core = steps.withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn(
        "all", F.sum("n").over(Window.partitionBy("key", "start"))
    )
    inside = core.filter(F.col("nearer") < CORE * F.col("all"))
    return inside.groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in moments])


def fit_groups(stats: DataFrame) -> DataFrame:
    """(key, m0.., i00.., unit, size) for each group, each language and all documents.

    ``stats`` are the rows of ``statistics`` that haven't failed the fixed limits. ``unit`` brings the median of the
    squared distances to that of a normal group.
    """
    keyed = [("group", F.col("language")), ("language", F.lit(None).cast("string")), (None, F.lit(None).cast("string"))]
    levels = F.array(
        *[F.struct((F.col(c) if c else F.lit("all")).alias("key"), home.alias("home")) for c, home in keyed]
    )
    rows = cut_lineage(stats.select(F.explode(levels).alias("k"), *FEATURES).select("k.key", "k.home", *FEATURES))
    fit = cut_lineage(_starts(rows).coalesce(SMALL))
    for _ in range(STEPS):
        away = rows.join(fit, "key").select("key", "start", *FEATURES, _step_of(_distance()).alias("step"))
        new = cut_lineage(_core(away).coalesce(SMALL).mapInArrow(_invert, _FIT))
        old = fit.select("key", "start", F.col("spread").alias("before"))
        falls = not new.join(old, ["key", "start"]).filter("spread < before - 0.001").isEmpty()
        fit = new
        if not falls:
            break
    least = fit.groupBy("key").agg(F.min(F.struct("spread", "start")).alias("l")).select("key", F.col("l.start").alias("start"))
    fit = cut_lineage(fit.join(least, ["key", "start"]).drop("spread").coalesce(SMALL))
    away = rows.join(fit, "key").select("key", "start", _step_of(_distance()).alias("step"))
    middle = _quantile(away, 0.5).select(
        "key",
        "size",
        # A group far narrower than the least spread isn't stretched to a normal one.
        F.greatest((F.pow(2.0, F.col("limit") / 64) - 1) / 1000 / _MEDIAN, F.lit(0.25)).alias("unit"),
    )
    return cut_lineage(fit.drop("start").join(middle, "key").coalesce(SMALL))


def _chosen(stats: DataFrame, fit: DataFrame) -> DataFrame:
    """The estimate each group uses: its own, its language's, or that of all documents."""
    groups = stats.select("group", "language").distinct()
    ways = groups.select(
        "group", F.posexplode(F.array("group", "language", F.lit("all"))).alias("level", "key")
    ).join(fit, "key")
    use = ways.filter((F.col("size") >= MIN_GROUP) | (F.col("level") == 2))
    least = use.groupBy("group").agg(F.min("level").alias("level"))
    return use.join(least, ["group", "level"]).drop("level", "key", "size")


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` with distance (squared, null without an estimate) and kept."""
    judged = stats.join(estimates, "group", "left").withColumn("distance", _distance() / F.col("unit"))
    return judged.select(
        *stats.columns,
        "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the five statistics, base_failed, distance and kept.

    Null and empty texts have no words and fail. Null languages and sources are groups of their own. Repeated rows
    count as often as they occur. Other columns of ``docs`` are left aside.
    """
    stats = cut_lineage(statistics(docs, "doc_id"))
    estimates = cut_lineage(_chosen(stats, fit_groups(stats.filter("not base_failed"))).coalesce(SMALL))
    return judge(stats, estimates)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    stats = cut_lineage(statistics(docs))
    estimates = cut_lineage(_chosen(stats, fit_groups(stats.filter("not base_failed"))).coalesce(SMALL))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "lang", "source")
    return judge(statistics(rows, "__row", row="__row"), estimates).filter("kept").select("__row.*")
