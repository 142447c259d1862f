"""Ranked lexical search: the items' highest-scoring documents, from buckets of impact vectors by length.

A document is a vector over the items' terms: a term's weight times its saturated frequency, a whole number. An item is
a vector of term counts, and a score is their inner product. Each task meets its documents by falling vector length, a
bucket at a time, and an item passes a bucket in three steps:

* Cauchy-Schwarz: the item's length times the bucket's longest vector is below the item's threshold: nothing to do.
* Coordinate bounds: the item's terms are cut where the sum of the smaller products of count and largest coordinate
  in the bucket stays below the threshold. A document with none of the other, focus terms can't reach it. For the
  others the products over the focus terms, plus the lesser of that sum and of what the rest of both vectors allows by
  Cauchy-Schwarz, is a bound.
* Documents whose bound reaches the threshold are scored again in 64-bit whole numbers.

Thresholds come from the longest vectors of all, searched first, and rise with what a task finds. Bounds are taken in
doubles with a margin above their rounding, and a bound equal to the threshold stays, so no result is lost.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship
from hallkeeper.session import cut_lineage

BLOCK_ITEMS = 20_000
"""Items searched together; their vectors and thresholds are broadcast. A larger set takes several passes."""

BLOCK_TERMS = 1_000_000
"""Terms, with repeats, of the items searched together; a longer item is a block of its own."""

BUCKET_ROWS = 4096
"""Documents of a bucket."""

BUCKET_ENTRIES = 1 << 20
"""Coordinates of a bucket; a longer vector is a bucket of its own."""

CELLS = 1 << 22
"""Sums, products or look-ups held at once."""

FIRST_SHARE = 0.01
"""Share of the vectors, the longest, that give the first thresholds."""

MARGIN = 1 + 1e-9
"""On bounds taken in doubles."""

NOT_IN_TERMS = np.zeros(256, dtype=bool)
NOT_IN_TERMS[:128] = True
for _a, _b in (b"09", b"AZ", b"az"):
    NOT_IN_TERMS[_a : _b + 1] = False

_OTHER_BYTES = np.random.default_rng(11).permutation(256).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OTHER_BYTES = _OTHER_BYTES[_LOWER]


def _terms(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray]:
    """The terms of a chunk, and its bytes dealt anew for a second hash."""
    data, offsets = W.text_bytes(batch.column("text"))
    return W.words(data, offsets, lower=True, space=NOT_IN_TERMS), _OTHER_BYTES[data]


def _long(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, spread, n_terms, keys, checks): two hashes per term, in order and with repeats."""
    row = TaskContext.get().partitionId() << 40
    for batch in W.chunks(batches):
        w, data = _terms(batch)
        number = np.arange(row, row + batch.num_rows, dtype=np.uint64)
        row += batch.num_rows
        yield pa.record_batch(
            {
                "item_id": _long(batch.column("item_id")),
                "spread": (W.mix(number) >> np.uint64(1)).view(np.int64),
                "n_terms": np.diff(w.bounds),
                "keys": _lists(w.bounds, w.hash.view(np.int64)),
                "checks": _lists(w.bounds, W.range_hash(data, w.start, w.end).view(np.int64)),
            }
        )


class Items(NamedTuple):
    """A block of items: their ids, and per distinct term of an item the item, the term's number and its count.

    Terms are numbered by their pair of hashes, in order.
    """

    ids: pa.Array
    key: np.ndarray
    check: np.ndarray
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _gather(block: DataFrame) -> Items:
    """A block's items on the driver; the block is bounded."""
    rows = block.select("item_id", "keys", "checks").toArrow().combine_chunks()
    ids, keys, checks = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
    n = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(ids)), n)
    pairs = np.empty(len(item), [("key", np.uint64), ("check", np.uint64)])
    pairs["key"] = keys.flatten().to_numpy().view(np.uint64)
    pairs["check"] = checks.flatten().to_numpy().view(np.uint64)
    known, term = np.unique(pairs, return_inverse=True)
    both, count = np.unique(item * max(len(known), 1) + term, return_counts=True)
    item, term = np.divmod(both, max(len(known), 1))
    return Items(ids, known["key"].copy(), known["check"].copy(), item, term, count.astype(np.int64))


def _frequencies(items):
    """Rows (doc_id, n, terms, tfs): a document's number of terms, and the frequencies of those that items hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, check = items.value.key, items.value.check
        if (key[1:] == key[:-1]).any():
            raise ValueError("two terms of the items share a hash")
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[key >> np.uint64(44)] = True
        for batch in W.chunks(batches):
            w, data = _terms(batch)
            at = np.flatnonzero(maybe[w.hash >> np.uint64(44)])
            place = np.minimum(np.searchsorted(key, w.hash[at]), max(len(key) - 1, 0))
            same = key[place] == w.hash[at] if len(key) else np.zeros(0, bool)
            at, place = at[same], place[same]
            same = W.range_hash(data, w.start[at], w.end[at]) == check[place]
            at, place = at[same], place[same]
            found, tf = np.unique(w.doc[at] * max(len(key), 1) + place, return_counts=True)
            doc, term = np.divmod(found, max(len(key), 1))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.record_batch(
                {
                    "doc_id": _long(batch.column("doc_id")),
                    "n": np.diff(w.bounds),
                    "terms": _lists(bounds, term.astype(np.int32)),
                    "tfs": _lists(bounds, tf.astype(np.int32)),
                }
            )

    return run


def _impacts(weights, n_docs: int, n_terms: int):
    """Rows (doc_id, norm, terms, impacts) of documents that share a term with an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            size = pc.list_value_length(lists).to_numpy()
            m = 25 + 75 * batch.column("n").to_numpy() * n_docs // n_terms
            impact = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size)))
            bounds = np.r_[0, np.cumsum(size)]
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), impact.astype(np.float64) ** 2, len(size)))
            columns = {"doc_id": batch.column("doc_id"), "norm": norm, "terms": lists, "impacts": _lists(bounds, impact)}
            yield pa.record_batch(columns).filter(pa.array(norm > 0))

    return run


class _Best:
    """The best documents of each item so far: score, whether the id is missing, id; -1 marks free places."""

    def __init__(self, n: int, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold.copy()
        self.score = np.full((n, k), -1, np.int64)
        self.lost = np.zeros((n, k), bool)
        self.id = np.zeros((n, k), np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, lost: np.ndarray, doc_id: np.ndarray) -> None:
        touched, inverse = np.unique(item, return_inverse=True)
        old = np.repeat(np.arange(len(touched)), self.k)
        group = np.r_[inverse, old]
        score = np.r_[score, self.score[touched].ravel()]
        lost = np.r_[lost, self.lost[touched].ravel()]
        doc_id = np.r_[doc_id, self.id[touched].ravel()]
        order = np.lexsort((doc_id, lost, -score, group))
        group = group[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        order, group, rank = order[rank < self.k], group[rank < self.k], rank[rank < self.k]
        for column, values in ((self.score, score), (self.lost, lost), (self.id, doc_id)):
            column[touched[group], rank] = values[order]
        self.threshold[touched] = np.maximum(self.threshold[touched], self.score[touched, self.k - 1])


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and size: the number of each one's range, and its places, laid end to end."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _slices(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Neighbours whose sizes add up to the limit at most, or single ones."""
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield slice(a, b)
        a = b


def _search_bucket(q: Items, q_norm: np.ndarray, best: _Best, bucket: pa.RecordBatch) -> None:
    """Puts the bucket's documents that may belong to the best in their place."""
    n_docs, n_items = bucket.num_rows, len(q.ids)
    ids = bucket.column("doc_id")
    lost, ids = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
    norm = bucket.column("norm").to_numpy()
    size = pc.list_value_length(bucket.column("terms")).to_numpy()
    term, impact = bucket.column("terms").flatten().to_numpy(), bucket.column("impacts").flatten().to_numpy()
    doc = np.repeat(np.arange(n_docs), size)
    present, inverse = np.unique(term, return_inverse=True)
    by_document = doc * len(present) + inverse
    order = np.argsort(inverse, kind="stable")
    start = np.searchsorted(inverse[order], np.arange(len(present) + 1))
    post_doc, post_impact = doc[order], impact[order]
    largest = np.maximum.reduceat(post_impact, start[:-1])

    alive = q_norm * norm.max() * MARGIN >= best.threshold
    at = np.minimum(np.searchsorted(present, q.term), len(present) - 1)
    held = np.flatnonzero((present[at] == q.term) & alive[q.item])
    if not len(held):
        return
    at, item, count = at[held], q.item[held], q.count[held]
    bound = count * largest[at]
    order = np.lexsort((bound, item))
    at, item, count, bound = at[order], item[order], count[order], bound[order]
    total = np.cumsum(bound)
    first = np.searchsorted(item, item)
    running = total - total[first] + bound[first]
    focus = running >= best.threshold[item]
    rest = np.zeros(n_items, np.int64)
    np.maximum.at(rest, item[~focus], running[~focus])
    rest_norm = np.sqrt(np.bincount(item[~focus], count[~focus].astype(np.float64) ** 2, n_items))

    f_at, f_item, f_count = at[focus], item[focus], count[focus]
    searched, f_first = np.unique(f_item, return_index=True)
    f_first = np.r_[f_first, len(f_item)]
    n_posts = np.add.reduceat(np.diff(start)[f_at], f_first[:-1]) if len(searched) else np.zeros(0, np.int64)
    for part in _slices(np.maximum(n_posts, n_docs), CELLS):
        some = searched[part]
        lines = slice(f_first[part.start], f_first[part.stop])
        which, place = _runs(start[f_at[lines]], np.diff(start)[f_at[lines]])
        cell = np.searchsorted(some, f_item[lines])[which] * n_docs + post_doc[place]
        x = post_impact[place].astype(np.float64)
        partial = np.bincount(cell, f_count[lines][which] * x, len(some) * n_docs).reshape(-1, n_docs)
        covered = np.bincount(cell, x * x, len(some) * n_docs).reshape(-1, n_docs)
        left = np.sqrt(np.maximum(norm**2 * MARGIN - covered, 0))
        upper = partial + np.minimum(rest[some][:, None], rest_norm[some][:, None] * left)
        threshold = best.threshold[some].astype(np.float64)
        if n_docs >= best.k:  # a score is the partial sum at least
            kth = np.partition(partial, n_docs - best.k, axis=1)[:, n_docs - best.k]
            threshold = np.maximum(threshold, kth / MARGIN)
        pair_item, pair_doc = np.nonzero((covered > 0) & (upper * MARGIN >= threshold[:, None]))
        _score_again(q, best, some[pair_item], pair_doc, item, at, count, by_document, impact, len(present), lost, ids)


def _score_again(q, best, pair_item, pair_doc, item, at, count, by_document, impact, n_present, lost, ids) -> None:
    """Exact scores of pairs (item, document): each of the item's terms is looked up in the document."""
    begin = np.searchsorted(item, pair_item)
    size = np.searchsorted(item, pair_item, "right") - begin
    for part in _slices(size, CELLS):
        which, place = _runs(begin[part], size[part])
        wanted = pair_doc[part][which] * n_present + at[place]
        found = np.minimum(np.searchsorted(by_document, wanted), len(by_document) - 1)
        gain = np.where(by_document[found] == wanted, impact[found] * count[place], 0)
        score = np.zeros(part.stop - part.start, np.int64)
        np.add.at(score, which, gain)
        good = np.flatnonzero((score > 0) & (score >= best.threshold[pair_item[part]]))
        if len(good):
            docs = pair_doc[part][good]
            best.add(pair_item[part][good], score[good], lost[docs], ids[docs])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in buckets, bounded in rows and coordinates."""
    for batch in batches:
        if batch.num_rows:
            size = pc.list_value_length(batch.column("terms")).to_numpy()
            for part in _slices(np.maximum(size, BUCKET_ENTRIES // BUCKET_ROWS), BUCKET_ENTRIES):
                yield batch.slice(part.start, part.stop - part.start)


def _search(items, thresholds, k: int):
    """Rows (item, item_id, doc_id, score): each item's best documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = items.value
        best = _Best(len(q.ids), k, thresholds.value)
        q_norm = np.sqrt(np.bincount(q.item, q.count.astype(np.float64) ** 2, len(q.ids)))
        for bucket in _buckets(batches):
            _search_bucket(q, q_norm, best, bucket)
        item, place = np.nonzero(best.score > 0)
        yield pa.record_batch(
            {
                "item": item,
                "item_id": q.ids.take(pa.array(item)),
                "doc_id": pa.array(best.id[item, place], mask=best.lost[item, place]),
                "score": best.score[item, place],
            }
        )

    return run


_FOUND = "item long, item_id long, doc_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(terms: DataFrame) -> Iterator[DataFrame]:
    """The items in blocks that fit: as many as it takes, dealt by a hash of the row."""
    n, size = 1, [F.count("*").alias("items"), F.sum("n_terms").alias("terms")]
    too_large = (F.col("items") > 1) & ((F.col("items") > BLOCK_ITEMS) | (F.col("terms") > BLOCK_TERMS))
    while not terms.groupBy(F.col("spread") % n).agg(*size).filter(too_large).isEmpty():
        n *= 2
    return (terms.filter(F.col("spread") % n == b) for b in range(n))


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(items)
    frequencies = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(_frequencies(sent), "doc_id long, n long, terms array<int>, tfs array<int>")
    )
    n_docs, n_terms = frequencies.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    holding = frequencies.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    weights = np.zeros(len(items.key), np.int64)
    for term, df in zip(holding.column("term").to_pylist(), holding.column("count").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    vectors = cut_lineage(
        frequencies.filter(F.size("terms") > 0)
        .mapInArrow(
            _impacts(context.broadcast(weights), n_docs, n_terms),
            "doc_id long, norm double, terms array<int>, impacts array<long>",
        )
        .sortWithinPartitions(F.desc("norm"))
    )
    longest = vectors.agg(F.percentile_approx("norm", 1 - FIRST_SHARE)).first()[0]
    if longest is None:
        return None
    none = context.broadcast(np.zeros(len(items.ids), np.int64))
    first = vectors.filter(F.col("norm") >= longest).mapInArrow(_search(sent, none, k), _FOUND)
    first = cut_lineage(_ranked(first, k))
    thresholds = np.zeros(len(items.ids), np.int64)
    for r in first.filter(F.col("rank") == k).select("item", "score").collect():  # a row per item of the block at most
        thresholds[r.item] = r.score
    rest = vectors.filter(F.col("norm") < longest).mapInArrow(_search(sent, context.broadcast(thresholds), k), _FOUND)
    return _ranked(first.drop("rank").unionByName(rest), k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` highest-scoring documents: item_id, rank (int, from 1), doc_id and score, above 0 only.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. Null and empty
    texts have no terms: such a document is counted nowhere, such an item has no rows. Every row of ``docs`` is a
    document and every row of ``items`` an item, repeated rows too; equal scores go by ascending doc_id, null last.
    ``docs`` needs doc_id and text, ``items`` item_id and text (ids are whole numbers or null); other columns are left
    aside. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    terms = cut_lineage(
        items.select("item_id", "text").mapInArrow(
            _item_terms, "item_id long, spread long, n_terms long, keys array<long>, checks array<long>"
        )
    ).filter(F.col("n_terms") > 0)
    found = [_search_block(docs, block, k) for block in map(_gather, _blocks(terms)) if len(block.ids)]
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, [f for f in found if f is not None], nothing)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, s),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
i AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r)
  GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
