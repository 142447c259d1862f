"""Token counts of whole texts without token ids.

No piece of the vocabulary holds a space after another character, so merges never reach over the start of a run of
spaces: a text's pieces are those of its pre-tokens, a run of spaces with the characters up to the next one. Pieces
are counted once per distinct pre-token of the corpus and joined to the documents' pre-token frequencies.

The frequencies travel packed: a task sends one row per pre-token and pack of documents, with the pre-token's 64-bit
hash and the documents' numbers and frequencies as one array of short numbers. The sums go back the same way, one row
per task and pack, and meet in one group per pack, which is bounded as a pack is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship

PACK_BYTES = 40 << 20
"""Text whose frequencies are packed together."""

PACK_DOCS = 60_000
"""Documents of a pack; their numbers have two bytes."""

SLICE = 300_000
"""Frequencies turned into bytes at once."""

SHORT = 7
"""Bytes of entries that travel as one number; longer ones travel as an array."""

OPEN_PACKS = 100
"""Packs a task of the join sums at once; half a MB each."""

SEEN = 1_000_000
"""Pre-tokens a task remembers so as not to send them twice."""

_ONLY_SPACE = np.zeros(256, dtype=bool)
_ONLY_SPACE[0x20] = True


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token, a run of at least one space and what follows it, given without the first."""
    # The library puts a space before a text; an empty text has none.
    found = _library(path).encode(pretokens, num_threads=1)
    return [len(ids) if p else 1 for p, ids in zip(pretokens, found, strict=True)]


def _pretokens(batch: pa.RecordBatch):
    """The chunk's bytes, and per pre-token its document, byte range and hash; a space comes before each text."""
    text = pc.replace_substring(pc.fill_null(batch.column("text"), ""), "▁", " ")
    filled = pc.greater(pc.binary_length(text), 0)
    text = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(" "), text, ""), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    data, offsets = W.text_bytes(text)
    space = _ONLY_SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(first)
    end = np.r_[start[1:], len(data)].astype(np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return data, doc, start, end, W.range_hash(data, start, end)


def to_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in as few bytes as they need, seven bits each, and the length of each."""
    length = np.ones(len(numbers), np.int64)
    for bits in range(7, 64, 7):
        more = numbers >> bits
        if not more.any():
            break
        length += more > 0
    end = np.cumsum(length)
    place = np.arange(end[-1] if len(end) else 0) - np.repeat(end - length, length)
    value = np.repeat(numbers, length) >> (7 * place) & 0x7F
    return (value | np.where(place + 1 < np.repeat(length, length), 0x80, 0)).astype(np.uint8), length


def from_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and the place after the last byte of each."""
    end = np.flatnonzero(raw < 0x80) + 1
    if not len(end):
        return np.zeros(0, np.int64), end
    start = np.r_[0, end[:-1]]
    place = np.arange(len(raw)) - np.repeat(start, end - start)
    return np.add.reduceat((raw.astype(np.int64) & 0x7F) << (7 * place), start), end


def _entries(key: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct keys, and for each its documents and frequencies; the arguments are sorted by key and document.

    A number is four times the distance from the document before, plus the frequency less one; a frequency above four
    is given in several entries. Up to SHORT bytes are put into one whole number with their count in its last byte,
    more into an array.
    """
    parts = (times + 3) // 4
    last = np.cumsum(parts) - 1
    rest = np.full(int(parts.sum()), 3, np.int64)
    rest[last] = times - 4 * (parts - 1) - 1
    key, doc = np.repeat(key, parts), np.repeat(doc.astype(np.int64), parts)
    first = np.r_[True, key[1:] != key[:-1]]
    step = doc.copy()
    step[1:] -= np.where(first[1:], 0, doc[:-1])
    raw, length = to_bytes(4 * step + rest)
    cuts = np.flatnonzero(first)
    offsets = np.r_[0, np.cumsum(length)][np.r_[cuts, len(key)]]
    size = np.diff(offsets)
    # Rows of one length lie together, which the shuffle's compression likes.
    order = np.argsort(size, kind="stable")
    n = int(np.searchsorted(size[order], SHORT, "right"))
    short = np.zeros((len(cuts), 8), np.uint8)
    column = np.arange(SHORT)
    inside = column < size[order[:n], None]
    short[:n, :SHORT][inside] = raw[(offsets[order[:n], None] + column)[inside]]
    short[:n, SHORT] = size[order[:n]]
    long = pa.BinaryArray.from_buffers(
        pa.binary(), len(cuts), [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(raw.tobytes())]
    )
    long = pa.concat_arrays([pa.nulls(n, pa.binary()), long.take(pa.array(order[n:]))])
    return key[cuts[order]], short.view(np.int64).ravel(), long


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, pre-token's hash, entries), and one row per pack with its documents' ids and bytes.

    The row of ids has the pack's number below zero.
    """
    held: list[tuple] = []
    names: list[tuple] = []
    n_docs = n_bytes = packs = 0
    base = TaskContext.get().partitionId() << 33

    def out():
        pack = base + packs
        if held:
            key, doc, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc, times = key[order], doc[order], times[order]
            del order
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            cuts = np.unique(cuts[np.searchsorted(cuts, np.arange(0, len(key), SLICE), "right") - 1])
            for a, b in zip(cuts, np.r_[cuts[1:], len(key)]):
                keys, short, long = _entries(key[a:b], doc[a:b], times[a:b].astype(np.int64))
                columns = {"pack": np.full(len(keys), pack, np.int64), "key": keys.view(np.int64), "short": short}
                yield pa.record_batch({**columns, "entries": long})
        ids = pa.concat_arrays([x[0] for x in names])
        table = np.stack(
            [
                pc.fill_null(ids, 0).to_numpy(),
                pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.int64),
                np.concatenate([x[1] for x in names]),
            ]
        )
        spread = W.mix(np.array([pack], np.uint64)).view(np.int64)
        yield pa.record_batch(
            {
                "pack": np.array([-pack - 1]),
                "key": spread,
                "short": np.zeros(1, np.int64),
                "entries": pa.array([table.tobytes()], pa.binary()),
            }
        )

    for batch in W.chunks(batches):
        data, doc, start, end, key = _pretokens(batch)
        if n_docs and (n_bytes + len(data) > PACK_BYTES or n_docs + batch.num_rows > PACK_DOCS):
            yield from out()
            held, names, n_docs, n_bytes, packs = [], [], 0, 0, packs + 1
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        if len(key):
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            times = np.diff(np.r_[at, len(key)])
            key, doc = key[at], doc[at]
            held.append((key, (doc + n_docs).astype(np.uint16), times.astype(np.uint32)))
        length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        names.append((batch.column("doc_id").cast(pa.int64()), length.astype(np.int64)))
        n_docs += batch.num_rows
        n_bytes += len(data)
    if n_docs:
        yield from out()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens of a task, most repetitions left out already."""
    seen = np.zeros(0, np.uint64)
    for batch in W.chunks(batches):
        data, _, start, end, key = _pretokens(batch)
        key, at = np.unique(key, return_index=True)
        if len(seen):
            new = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
            key, at = key[new], at[new]
        raw = data.tobytes()
        # Every pre-token begins with a space, which stays here.
        found = [raw[a + 1 : b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        yield pa.record_batch({"pretoken": pa.array(found, pa.binary()).cast(pa.string())})
        seen = np.union1d(seen, key) if len(seen) < SEEN else np.sort(key)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_pieces(path, batch.column("pretoken").to_pylist())
            data, offsets = W.text_bytes(pc.binary_join_element_wise(pa.scalar(" "), batch.column("pretoken"), ""))
            key = W.range_hash(data, offsets[:-1], offsets[1:])
            yield pa.record_batch({"key": key.view(np.int64), "pieces": pa.array(counts, pa.int32())})

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, ids or null, sums or null): the pieces of a pack's documents so far, sent when many packs are open."""
    place: dict[int, int] = {}
    sums = np.zeros(0, np.int64)

    def out():
        for pack, n in place.items():
            part = sums[n << 16 : (n + 1) << 16]
            doc = np.flatnonzero(part)
            raw, _ = to_bytes(np.stack([np.diff(doc, prepend=0), part[doc]], 1).ravel())
            yield pa.record_batch({"pack": [pack], "ids": pa.nulls(1, pa.binary()), "sums": pa.array([raw.tobytes()], pa.binary())})

    def add(raw: np.ndarray, length: np.ndarray, at: np.ndarray, pieces: np.ndarray) -> None:
        number, end = from_bytes(raw)
        n = np.diff(np.searchsorted(end, np.cumsum(length), "right"), prepend=0)
        doc = np.cumsum(number >> 2)
        before = np.r_[0, doc][np.cumsum(n) - n]
        np.add.at(sums, doc + np.repeat(at - before, n), np.repeat(pieces, n) * ((number & 3) + 1))

    for batch in batches:
        named = pc.less(batch.column("pack"), 0)
        for r in batch.filter(named).to_pylist():
            yield pa.record_batch(
                {"pack": [-r["pack"] - 1], "ids": pa.array([r["entries"]], pa.binary()), "sums": pa.nulls(1, pa.binary())}
            )
        batch = batch.filter(pc.invert(named))
        if not batch.num_rows:
            continue
        packs, inverse = np.unique(batch.column("pack").to_numpy(), return_inverse=True)
        for p in packs.tolist():
            place.setdefault(p, len(place))
        if len(place) << 16 > len(sums):
            sums = np.concatenate([sums, np.zeros((len(place) << 16) - len(sums), np.int64)])
        at = np.array([place[p] for p in packs.tolist()], np.int64)[inverse] << 16
        pieces = batch.column("pieces").to_numpy()
        is_long = pc.is_valid(batch.column("entries")).to_numpy(zero_copy_only=False)
        entries = batch.column("entries").filter(pa.array(is_long))
        raw = np.frombuffer(b"".join(entries.to_pylist()), np.uint8)
        add(raw, pc.binary_length(entries).to_numpy(), at[is_long], pieces[is_long])
        short = batch.column("short").to_numpy()[~is_long].view(np.uint8).reshape(-1, 8)
        raw = short[:, :SHORT][np.arange(SHORT) < short[:, SHORT:]]
        add(raw, short[:, SHORT].astype(np.int64), at[~is_long], pieces[~is_long])
        if len(place) > OPEN_PACKS:
            yield from out()
            place, sums = {}, np.zeros(0, np.int64)
    yield from out()


def _spell_out(pack: pa.Table) -> pa.Table:
    """The documents of a pack with the sums of their pieces."""
    ids = np.frombuffer(pack.column("ids").drop_null()[0].as_py(), np.int64).reshape(3, -1)
    pieces = np.zeros(ids.shape[1], np.int64)
    for part in pack.column("sums").drop_null().to_pylist():
        doc, some = from_bytes(np.frombuffer(part, np.uint8))[0].reshape(-1, 2).T
        pieces[np.cumsum(doc)] += some
    return pa.table({"doc_id": pa.array(ids[0], mask=ids[1] == 0), "n_bytes": ids[2], "n_tokens": pieces})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes (of the UTF-8 text) and n_tokens.

    Null and empty texts have no tokens. Repeated rows are counted each. ``docs`` needs doc_id (a whole number or
    null) and text; other columns are left aside.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    packed = texts.mapInArrow(_pack, "pack long, key long, short long, entries binary")
    counts = (
        docs.select("text").mapInArrow(_distinct, "pretoken string").distinct()
        .mapInArrow(_count(path), "key long, pieces int")
    )
    sums = (
        packed.join(counts, "key", "left")
        .select("pack", "short", "entries", F.col("pieces").cast("long").alias("pieces"))
        .mapInArrow(_sum, "pack long, ids binary, sums binary")
    )
    return sums.groupBy("pack").applyInArrow(_spell_out, "doc_id long, n_bytes long, n_tokens long")
