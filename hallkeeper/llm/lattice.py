"""Language-model scores: the probability of a text over all its segmentations into subword pieces.

A text is a sequence of words and an end. A word's probability is the sum, over all ways to cut the word (with the
vocabulary's word mark before it) into pieces, of the product of the pieces' probabilities: the forward recursion over
its places in log space. A character without a piece is covered by its bytes' pieces.

The vocabulary is a given piece model. Its file has merge ranks, not probabilities, so the pieces' probabilities are
their shares in the training texts as the library cuts them, each count raised by SMOOTHING.

Words are counted once over the corpus, and each distinct word is cut and scored once. The most frequent words' scores
are broadcast, so that most tokens are looked up where their text is read; only the others travel, to a join.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship
from hallkeeper.llm.tallies import LOWER, SECOND, Tally
from hallkeeper.session import cut_lineage

SMOOTHING = 0.1

HEAD = 100_000
"""Most frequent words, at most, that are broadcast, 32 bytes each; all others are joined."""

WIDE = 64
"""Characters up to which words are scored side by side; longer ones are scored one by one."""

ROWS = 8192
"""Words scored side by side."""

MARK = "▁"


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _is_held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of a task: every word, and how often training texts hold it."""
    tally = Tally()
    for batch in W.chunks(batches):
        data, offsets = W.text_bytes(batch.column("text"))
        data = LOWER[data]
        w = W.words(data, offsets)
        train = ~_is_held_out(batch.column("doc_id").to_pylist())
        tally.add(data, w.start, w.end, w.hash, train[w.doc])
        if tally.full():
            yield from tally.take()
    yield from tally.take()


def _count_pieces(path: str):
    """Rows (piece, n): the pieces of words as the library cuts them, times the words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        total = np.zeros(library.vocab_size(), np.int64)
        for batch in batches:
            cut = library.encode(batch.column("word").to_pylist(), num_threads=1)
            pieces = np.array([i for ids in cut for i in ids], np.int64)
            times = np.repeat(batch.column("c").to_numpy(), [len(ids) for ids in cut])
            np.add.at(total, pieces, times)
        found = np.flatnonzero(total)
        yield pa.record_batch({"piece": found, "n": total[found]})

    return run


class Pieces(NamedTuple):
    """Natural logarithms of the pieces' probabilities: by text, and by hash of the text in order; of bytes; of an end."""

    by_text: dict[str, float]
    key: np.ndarray
    check: np.ndarray
    value: np.ndarray
    byte: np.ndarray
    end: float
    longest: int


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.text_bytes(texts)
    return W.range_hash(data, offsets[:-1], offsets[1:]), W.range_hash(SECOND[data], offsets[:-1], offsets[1:])


def weigh_pieces(path: str, counts: dict[int, int], ends: int) -> Pieces:
    """The pieces' probabilities from their counts and the number of texts."""
    library = _library(path)
    usable = [i for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTHING * (len(usable) + 1)
    by_text, byte = {}, np.full(256, math.log(SMOOTHING / total))
    for i in usable:
        value = math.log((counts.get(i, 0) + SMOOTHING) / total)
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            byte[int(piece[3:5], 16)] = value
        else:
            by_text[piece] = value
    key, check = _hashes(pa.array(by_text, pa.string()))
    order = np.argsort(key)
    if len(np.unique(key)) < len(key):
        raise ValueError("two pieces share a hash")
    value = np.array(list(by_text.values()))[order]
    end = math.log((ends + SMOOTHING) / total)
    return Pieces(by_text, key[order], check[order], value, byte, end, max(map(len, by_text)))


def _score_one(pieces: Pieces, word: str) -> float:
    """The forward recursion for one word, its mark included."""
    forward = [0.0]
    for j in range(1, len(word) + 1):
        ways = []
        for k in range(1, min(pieces.longest, j) + 1):
            value = pieces.by_text.get(word[j - k : j])
            if value is None and k == 1:
                value = float(sum(pieces.byte[b] for b in word[j - 1].encode()))
            if value is not None:
                ways.append(forward[j - k] + value)
        top = max(ways)
        forward.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return forward[-1]


def _score_side_by_side(pieces: Pieces, words: pa.Array) -> np.ndarray:
    """The forward recursion for words of at most WIDE characters, their marks included."""
    data, offsets = W.text_bytes(words)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.r_[start[1:], len(data)]
    bounds = np.searchsorted(start, offsets)
    length = np.diff(bounds)
    owner = np.repeat(np.arange(len(length)), length)
    other = SECOND[data]
    maybe = np.zeros(1 << 18, dtype=bool)
    maybe[pieces.key >> np.uint64(46)] = True
    n = len(start)
    edges = []  # by number of characters: the value of the piece that begins at a place
    for k in range(1, min(pieces.longest, int(length.max())) + 1):
        a = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
        key = W.range_hash(data, start[a], end[a + k - 1])
        hit = maybe[key >> np.uint64(46)]
        a, key = a[hit], key[hit]
        place = np.minimum(np.searchsorted(pieces.key, key), len(pieces.key) - 1)
        hit = pieces.key[place] == key
        a, place = a[hit], place[hit]
        hit = W.range_hash(other, start[a], end[a + k - 1]) == pieces.check[place]
        edge = np.full(n, -np.inf)
        edge[a[hit]] = pieces.value[place[hit]]
        if k == 1:
            edge = np.where(np.isinf(edge), np.add.reduceat(pieces.byte[data], start), edge)
        edges.append(edge)
    order = np.argsort(-length, kind="stable")
    begin, size = bounds[:-1][order], length[order]
    forward = np.full((int(size[0]) + 1, len(size)), -np.inf)
    forward[0] = 0
    for j in range(1, int(size[0]) + 1):
        m = int(np.searchsorted(-size, -j, "right"))
        total = forward[j, :m]
        for k in range(1, min(len(edges), j) + 1):
            np.logaddexp(total, forward[j - k, :m] + edges[k - 1][begin[:m] + j - k], out=total)
    out = np.empty(len(size))
    out[order] = forward[size, np.arange(len(size))]
    return out


def score_words(pieces: Pieces, words: pa.Array) -> np.ndarray:
    """Natural logarithms of the words' probabilities over all segmentations."""
    marked = pc.binary_join_element_wise(pa.scalar(MARK), words, "")
    wide = pc.greater(pc.utf8_length(marked), WIDE).to_numpy(zero_copy_only=False)
    out = np.empty(len(words))
    for i in np.flatnonzero(wide).tolist():
        out[i] = _score_one(pieces, marked[i].as_py())
    rest = np.flatnonzero(~wide)
    for a in range(0, len(rest), ROWS):
        part = rest[a : a + ROWS]
        out[part] = _score_side_by_side(pieces, marked.take(pa.array(part)))
    return out


def _score(sent):
    """Rows (key, check, c, score) of words: two hashes, count in training texts, logarithm to base 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column("word")
                key, check = _hashes(words)
                score = score_words(sent.value, words) / math.log(10)
                yield pa.record_batch({"key": key.view(np.int64), "check": check.view(np.int64), "c": batch.column("c"), "score": score})

    return run


_FOUND = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "key long, check long, times long"
)


def _look_up(sent):
    """A row per document with the sums over its frequent words, and a row per document and other word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_key, head_check, head_c, head_score = sent.value
        head_base = np.log10(head_c + SMOOTHING)
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[head_key >> np.uint64(42)] = True
        row = TaskContext.get().partitionId() << 33
        for batch in W.chunks(batches):
            data, offsets = W.text_bytes(batch.column("text"))
            w = W.words(data, offsets, lower=True)
            check = W.range_hash(SECOND[LOWER[data]], w.start, w.end)
            n = batch.num_rows
            place = np.full(len(w.hash), -1, np.int64)
            if len(head_key):
                at = np.flatnonzero(maybe[w.hash >> np.uint64(42)])
                found = np.minimum(np.searchsorted(head_key, w.hash[at]), len(head_key) - 1)
                same = (head_key[found] == w.hash[at]) & (head_check[found] == check[at])
                place[at[same]] = found[same]
            seen = np.flatnonzero(place >= 0)
            doc, known = w.doc[seen], place[seen]
            rows = row + np.arange(n)
            row += n
            nothing = pa.nulls(n, pa.int64())
            ids = batch.column("doc_id")
            yield pa.record_batch(
                {
                    "row": rows,
                    "doc_id": ids,
                    "held_out": _is_held_out(ids.to_pylist()),
                    "n_tokens": np.diff(w.bounds) + 1,
                    "n_known": np.bincount(doc, head_c[known] > 0, n).astype(np.int64),
                    "base": np.bincount(doc, head_base[known], n).astype(np.float64),
                    "score": np.bincount(doc, head_score[known], n).astype(np.float64),
                    "key": nothing,
                    "check": nothing,
                    "times": nothing,
                }
            )
            rest = np.flatnonzero(place < 0)
            order = rest[np.lexsort((check[rest], w.hash[rest], w.doc[rest]))]
            if not len(order):
                continue
            doc, key, check = w.doc[order], w.hash[order], check[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
            m = len(first)
            empty = {c: pa.nulls(m, t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))}
            yield pa.record_batch(
                {"row": rows[doc[first]], **empty, "key": key[first].view(np.int64), "check": check[first].view(np.int64), "times": np.diff(np.r_[first, len(order)])}
            )

    return run


def _most_frequent(scored: DataFrame) -> DataFrame:
    """The words from the least class of counts on that leaves HEAD words at most; classes are 32 to a doubling."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 32)
    sizes = scored.filter("c > 0").groupBy(level.alias("level")).count().collect()  # 2048 classes at most
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        held += r["count"]
        if held > HEAD:
            break
        least = r.level
    head = scored.filter(F.col("c") > 0).filter(level >= least) if least is not None else scored.filter("false")
    return head.select("key", "check", "c", "score")


def lm_scores(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; an end follows them and counts as a
    token. Documents whose checksum of doc_id as text is a multiple of 10 are held out, all others are learnt from.
    ``base_score`` is the log10 probability by smoothed counts of whole words, ``score`` that of the piece lattice.
    Null and empty texts are an end alone; a null doc_id counts as an empty text and is held out; repeated rows are
    learnt from and scored each; an empty table gives no rows. Without training texts all counts are 0. ``docs`` needs
    doc_id (a whole number or null) and text; other columns are left aside.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = cut_lineage(counts)
    ends = texts.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()
    in_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = in_words + ends, distinct + (ends > 0)
    found = counts.filter("c > 0").mapInArrow(_count_pieces(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = weigh_pieces(path, {r.piece: r.n for r in found.collect()}, ends)  # as many rows as the vocabulary has
    scored = cut_lineage(counts.mapInArrow(_score(context.broadcast(pieces)), "key long, check long, c long, score double"))
    head = _most_frequent(scored).toArrow()
    head = [head.column(c).to_numpy() for c in ("key", "check", "c", "score")]
    head = [head[0].view(np.uint64), head[1].view(np.uint64), *head[2:]]
    order = np.argsort(head[0])
    looked_up = cut_lineage(texts.mapInArrow(_look_up(context.broadcast([x[order] for x in head])), _FOUND))
    rows = looked_up.filter("times is null")
    rest = (
        looked_up.filter("times is not null")
        .select("row", "key", "check", "times")
        .join(scored, ["key", "check"])
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("c") + SMOOTHING)).alias("more_base"),
            F.sum(F.col("times") * F.col("score")).alias("more_score"),
        )
    )
    size = math.log10(total + SMOOTHING * (distinct + 1))

    def both(name: str, more: str, end: float):
        return F.col(name) + F.coalesce(F.col(more), F.lit(0)) + F.lit(end)

    return rows.drop("key", "check", "times").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        both("n_known", "more_known", int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (both("base", "more_base", math.log10(ends + SMOOTHING)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        both("score", "more_score", pieces.end / math.log(10)).alias("score"),
    )
