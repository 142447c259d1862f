"""Exact removal of repeated byte strings.

A string of LENGTH bytes that occurs twice holds the same anchor at the same place both times: the position whose
GRAM bytes have the least hash among all positions of the string. Anchors that occur once are left out; the others are
sorted by their bytes, by Spark and so outside memory, each as a tuple with the bytes before and after it. Within the
run of tuples of one anchor, the strings of LENGTH bytes through the anchor are compared by hash, and those found
twice cover their bytes. Texts with equal bytes are one text that occurs twice: they are covered whole.

This is not external induced sorting with disk-backed queues: all suffixes of a corpus, as tuples with names and
common prefixes, are tens of times its size in each round of the recursion. What is kept of that method is that only
sampled suffixes are sorted, outside memory, and that the rest follows from them. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship
from hallkeeper.session import cut_lineage

LENGTH = 400
"""Bytes a string must have to count."""

GRAM = 64
"""Bytes an anchor is chosen by."""

HELD = 500_000
"""Hashes of an anchor's strings held before those that occur twice are given out."""

_U = np.uint64


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes at each position."""
    start = np.arange(max(0, len(data) - size + 1))
    return W.range_hash(data, start, start + size)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values: block-wise running minima from either side."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of the positions that some string of LENGTH bytes is anchored at.

    Of equal least hashes in a string all are anchors, so that equal strings always share one.
    """
    hashes = _gram_hashes(data, GRAM)
    width = LENGTH - GRAM + 1
    doc_of = np.searchsorted(offsets, np.arange(len(hashes)), "right") - 1
    # A gram that leaves its document counts for nothing.
    inside = np.arange(len(hashes)) + GRAM <= offsets[1:][doc_of]
    hashes = np.where(inside, hashes, np.iinfo(np.uint64).max)
    least = _sliding_least(hashes, width)
    starts = np.arange(len(least))
    whole = starts + LENGTH <= offsets[1:][doc_of[: len(least)]]
    # A position is an anchor if one of the strings that hold its gram has its hash as the least.
    bound = np.where(whole, least, _U(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), bound, np.zeros(width - 1, np.uint64)])
    greatest = ~_sliding_least(~padded, width)
    at = np.flatnonzero(inside & (hashes <= greatest[: len(hashes)]) & (hashes < np.iinfo(np.uint64).max))
    at = at[hashes[at] <= greatest[at]]
    return doc_of[at], at, hashes[at]


def _windows(lengths: np.ndarray) -> np.ndarray:
    return np.maximum(lengths - LENGTH + 1, 0)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches):
        data, offsets = W.text_bytes(batch.column("text"))
        if len(data) < LENGTH:
            continue
        doc, at, key = anchors(data, offsets)
        yield pa.record_batch(
            {"text_key": batch.column("text_key").take(pa.array(doc)), "anchor": key.view(np.int64)}
        )


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each repeated anchor with the bytes around it that a string of LENGTH bytes through it can reach."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = np.sort(np.frombuffer(batch.column("anchors")[i].as_buffer(), np.int64))
            text = np.frombuffer((batch.column("text")[i].as_py()).encode(), np.uint8)
            doc, at, key = anchors(text, np.array([0, len(text)]))
            some = keys[np.minimum(np.searchsorted(keys, key.view(np.int64)), len(keys) - 1)] == key.view(np.int64)
            at, key = at[some], key[some].view(np.int64)
            raw = text.tobytes()
            for a in range(0, len(at), 2000):
                part = at[a : a + 2000].tolist()
                yield pa.record_batch(
                    {
                        "text_key": pa.array([batch.column("text_key")[i].as_py()] * len(part), pa.binary()),
                        "anchor": key[a : a + 2000],
                        "at": np.array(part, np.int64),
                        "before": pa.array([raw[max(0, p - LENGTH + GRAM) : p] for p in part], pa.binary()),
                        "bytes": pa.array([raw[p : p + LENGTH] for p in part], pa.binary()),
                    }
                )


def _window_hashes(batch: pa.RecordBatch):
    """Hash and start of each string of LENGTH bytes that holds its row's anchor."""
    before, after = batch.column("before"), batch.column("bytes")
    pieces = [b.as_py() + a.as_py() for b, a in zip(before, after, strict=True)]
    lead = np.array([len(b.as_py()) for b in before], np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    offsets = np.r_[0, ends].astype(np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = np.minimum(_windows(np.diff(offsets)), lead + 1)
    row = np.repeat(np.arange(len(pieces)), n)
    shift = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    start = offsets[row] + shift
    key = W.range_hash(data, start, start + LENGTH)
    return row, key, batch.column("at").to_numpy()[row] - lead[row] + shift


def _runs(names: list[bytes], text: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.r_[cut[1:], len(text)] - 1
    return pa.record_batch(
        {
            "text_key": pa.array([names[t] for t in text[cut].tolist()], pa.binary()),
            "start": start[cut],
            "end": start[last] + LENGTH,
        }
    )


class _Group:
    """The strings through one anchor: hashes seen once with their place, and hashes known to occur twice."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.known = np.zeros(0, np.uint64)

    def add(self, part: pa.RecordBatch) -> None:
        row, key, start = _window_hashes(part)
        ids = [self.names.setdefault(t, len(self.names)) for t in part.column("text_key").to_pylist()]
        self.pending.append((key, np.array(ids, np.int64)[row], start))
        self.size += len(key)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Give out the runs of what has occurred twice by now, and keep the rest."""
        if not self.size:
            return
        key, text, start = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        order = np.lexsort((start, text, key))
        key, text, start = key[order], text[order], start[order]
        # The same place reached through another anchor with these bytes is no second occurrence.
        other = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])]
        key, text, start = key[other], text[other], start[other]
        same = key[1:] == key[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        if len(self.known):
            twice |= self.known[np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)] == key
        if twice.any():
            yield _runs(list(self.names), text[twice], start[twice])
            self.known = np.union1d(self.known, key[twice])
        self.pending = [(key[~twice], text[~twice], start[~twice])]
        self.size = int((~twice).sum())


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts of repeated strings, per text, from tuples sorted by anchor.

    A large group is settled again and again as its rows come, so that strings that occur often aren't held.
    """
    anchor, group, limit = None, _Group(), HELD
    for batch in batches:
        values = batch.column("anchor").to_numpy()
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            if values[a] != anchor:
                yield from group.settle()
                anchor, group, limit = values[a], _Group(), HELD
            for c in range(a, b, 500):
                group.add(batch.slice(c, min(500, b - c)))
                if group.size > limit:
                    yield from group.settle()
                    limit = max(HELD, 2 * group.size)
    yield from group.settle()


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i in range(batch.num_rows):
            raw = (batch.column("text")[i].as_py() or "").encode()
            copies = batch.column("copies")[i].as_py() or 0
            runs = batch.column("runs")[i].as_py()
            covered = np.zeros(len(raw) + 1, np.int32)
            if copies > 1 and len(raw) >= LENGTH:
                covered[0], covered[len(raw)] = 1, -1
            elif runs:
                pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
                np.add.at(covered, pairs[:, 0], 1)
                np.add.at(covered, pairs[:, 1], -1)
            gone = np.cumsum(covered)[:-1] > 0
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0)
            out["kept"].append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.record_batch(
            {c: batch.column(c) for c in batch.schema.names if c not in ("text", "copies", "runs")}
            | {k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()}
        )


def _joined_runs(group: pa.Table) -> pa.Table:
    pairs = np.stack([group.column("start").to_numpy(), group.column("end").to_numpy()], 1).astype(np.int64)
    return pa.table({"text_key": group.column("text_key").slice(0, 1), "runs": pa.array([pairs.tobytes()], pa.binary())})


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    A null text is empty. Repeated rows are copies of each other. Texts shorter than LENGTH keep all their bytes.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    long = texts.filter(F.octet_length("text") >= LENGTH)
    copies = cut_lineage(long.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")))

    found = long.select("text_key", "text").mapInArrow(_find_anchors, "text_key binary, anchor long")
    # Copies of a text give the same rows; two rows of one text are a repetition inside it.
    counted = found.groupBy("anchor", "text_key").agg(F.count(F.lit(1)).alias("n"))
    per_text = cut_lineage(counted.join(copies, "text_key").select("anchor", "text_key", F.floor(F.col("n") / F.col("copies")).alias("n")))
    repeated = per_text.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    wanted = cut_lineage(
        per_text.join(repeated, "anchor", "left_semi")
        .groupBy("text_key").agg(F.collect_list("anchor").alias("list"))
        .mapInArrow(_binary_lists, "text_key binary, anchors binary")
    )
    once = long.select("text_key", "text").join(wanted, "text_key").dropDuplicates(["text_key"])
    tuples = once.mapInArrow(_tuples, "text_key binary, anchor long, at long, before binary, bytes binary")
    runs = (
        tuples.repartition("anchor").sortWithinPartitions("anchor", "bytes")
        .mapInArrow(_repeated, "text_key binary, start long, end long")
        .groupBy("text_key").applyInArrow(_joined_runs, "text_key binary, runs binary")
    )
    return (
        texts.join(copies, "text_key", "left").join(cut_lineage(runs), "text_key", "left")
        .select("doc_id", "text", "copies", "runs")
        .mapInArrow(_cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def _binary_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.array(x, np.int64).tobytes() for x in batch.column("list").to_pylist()]
        yield pa.record_batch({"text_key": batch.column("text_key"), "anchors": pa.array(lists, pa.binary())})
