"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks of words.

One inserted, deleted or replaced letter changes the squared distance of two words' letter counts to at most two, and
their length by at most one. A block holds the words of a length and those one letter longer that agree outside a
window of places; the window is where the edit may lie. A NumPy product of a block's letter counts gives all squared
distances, pairs at most two apart are kept, and their edit is verified.

Each word is in the blocks of the left and of the right half of its places, for its own length and for the length
below. Blocks above HELD words aren't multiplied: their words go on to the blocks of the window's halves, in rounds,
until a block is small or its window is one place, where the alphabet bounds it. A pair is counted where its first
difference lies in the window, so it is counted exactly once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.shipping import ship
from hallkeeper.llm.tallies import Tally
from hallkeeper.session import cut_lineage

LEAST_LETTERS, LEAST_TIMES = 5, 3
"""A word has so many letters and occurs so often."""

HELD = 2048
"""Words of a block that are multiplied; larger blocks are split by halving their window."""

TILE = 256
"""Rows of neighbouring small blocks multiplied at once."""

CELLS = 1 << 22
"""Distances held at once."""

WIDE = 64
"""Letters up to which words are compared as rows of a matrix; longer ones are compared one by one."""

_LEAD = 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[_LEAD] = True  # U+00C0 to U+00FF are this byte and one from 0x80 to 0xBF
_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x20] = True
LETTERS = 26 + 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The checksum of each byte range, carried on from the one before it."""
    out = ~before.astype(np.uint32)
    size = end - start
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = ~np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i])))
    order = np.flatnonzero(size <= WIDE)
    order = order[np.argsort(-size[order], kind="stable")]
    state, at, n = out[order], start[order], size[order]
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k, "left"))
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[order] = state
    return ~out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of a task: lower-cased runs of enough letters, one letter less where the checksum says so."""
    tally = Tally()
    for batch in W.chunks(batches):
        data, offsets = W.text_bytes(batch.column("text"))
        data = _LOWER[data]
        lead = data == _LEAD
        inside = _LETTER[data]
        inside[1:] |= lead[:-1]
        w = W.words(np.where(inside, data, np.uint8(0x20)), offsets, space=_SPACE)
        leads = np.r_[0, np.cumsum(lead)]
        letters = (w.end - w.start) - (leads[w.end] - leads[w.start])
        long = np.flatnonzero(letters >= LEAST_LETTERS)
        ids = batch.column("doc_id").to_pylist()
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        check = crc32_of(data, w.start[long], w.end[long], heads[w.doc[long]])
        cut = check % 97 == 0
        shortened = []
        for i, c in zip(long[cut].tolist(), check[cut].tolist(), strict=True):
            run = data[w.start[i] : w.end[i]].tobytes().decode()
            place = c % len(run)
            if len(run) > LEAST_LETTERS:
                shortened.append((run[:place] + run[place + 1 :]).encode())
        whole = long[~cut]
        tally.add(data, w.start[whole], w.end[whole], w.hash[whole])
        raw = np.frombuffer(b"".join(shortened), np.uint8)
        end = np.cumsum([len(s) for s in shortened], dtype=np.int64)
        start = np.r_[0, end[:-1]].astype(np.int64) if len(end) else end
        tally.add(raw, start, end, W.range_hash(raw, start, end))
        if tally.full():
            yield from tally.take()
    yield from tally.take()


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of the words that occur often enough."""
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count_words, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _with_blocks(rows: DataFrame, windows: Column) -> DataFrame:
    """Each row once per window, an array of (base, low, high), with the key of the block it belongs to there."""
    rows = rows.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.*")
    left = F.col("word").substr(F.lit(1), F.col("low"))
    after = F.col("high") + 1 + F.length("word") - F.col("base")
    right = F.col("word").substr(after, F.length("word"))
    return rows.withColumn("block", F.xxhash64("base", "low", "high", left, right))


def _window(base: Column, low: Column, high: Column) -> Column:
    return F.struct(base.cast("int").alias("base"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _first_blocks(counts: DataFrame) -> DataFrame:
    length, none = F.length("word"), F.lit(0)

    def halves(base: Column) -> Column:
        half = F.floor(base / 2)
        return F.array(_window(base, none, half), _window(base, half, base))

    both = F.concat(halves(length), halves(length - 1))
    return _with_blocks(counts, F.when(length > LEAST_LETTERS, both).otherwise(halves(length)))


def _finer_blocks(rows: DataFrame) -> DataFrame:
    base, low, high = F.col("base"), F.col("low"), F.col("high")
    middle = F.floor((low + high) / 2)
    return _with_blocks(rows, F.array(_window(base, low, middle), _window(base, middle, high)))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words as numbers below LETTERS, and the bounds of each word."""
    data, offsets = W.text_bytes(words)
    own = data != _LEAD
    number = np.where(data < 0x80, data.astype(np.int64) - ord("a"), data.astype(np.int64) - 0x80 + 26)[own]
    return number, np.r_[0, np.cumsum(own)][offsets]


def _close_pairs(counts: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, the first the lesser, of one block whose counts are at most two apart, squared; blocks are sorted."""
    size = np.einsum("ij,ij->i", counts, counts)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[starts[1:], len(block)]
    k = 0
    while k < len(starts):
        last = max(k, int(np.searchsorted(ends, starts[k] + TILE, "right")) - 1)
        a, b = int(starts[k]), int(ends[last])
        k = last + 1
        step = max(1, CELLS // (b - a))
        for c in range(a, b, step):
            d = min(c + step, b)
            apart = size[c:d, None] + size[None, c:b] - 2 * (counts[c:d] @ counts[c:b].T)
            i, j = np.nonzero(apart < 2.5)
            i, j = i + c, j + c
            right = (i < j) & (block[i] == block[j])
            yield i[right], j[right]


def _one_edit(x: str, y: str) -> int:
    """The place of the first difference if y is x with one letter replaced or inserted, else -1."""
    place = next((p for p, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    rest = x[place + 1 :] if len(x) == len(y) else x[place:]
    return place if x != y and rest == y[place + 1 :] else -1


def _first_difference(number, bounds, words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_one_edit of rows i and j, j as long as i or one letter longer."""
    length = np.diff(bounds)
    out = np.full(len(i), -1, np.int64)
    wide = length[j] > WIDE
    for p in np.flatnonzero(wide).tolist():
        out[p] = _one_edit(words[int(i[p])].as_py(), words[int(j[p])].as_py())
    narrow = np.flatnonzero(~wide)
    if not len(narrow):
        return out
    column = np.arange(int(length[j[narrow]].max()) + 1)
    for a in range(0, len(narrow), CELLS // 64):
        part = narrow[a : a + CELLS // 64]
        x, y = i[part], j[part]
        places = np.minimum(bounds[x][:, None] + column, len(number) - 1)
        left = np.where(column < length[x][:, None], number[places], -1)
        places = np.minimum(bounds[y][:, None] + column, len(number) - 1)
        right = np.where(column < length[y][:, None], number[places], -1)
        other = left != right
        place = np.argmax(other, axis=1)
        replaced = other.sum(1) == 1
        shifted = (left[:, :-1] != right[:, 1:]) & (column[:-1] >= place[:, None])
        inserted = ~shifted.any(1)
        good = np.where(length[x] == length[y], replaced, inserted)
        out[part] = np.where(good, place, -1)
    return out


def _near_words(rows: pa.Table) -> pa.RecordBatch | None:
    """Per row with near words in its block: their number and the most frequent one; whole blocks, sorted by word."""
    block, base = rows.column("block").to_numpy(), rows.column("base").to_numpy()
    alone = np.r_[True, block[1:] != block[:-1]] & np.r_[block[1:] != block[:-1], True]
    if alone.all():
        return None
    rows = rows.filter(pa.array(~alone))
    block, base = block[~alone], base[~alone]
    words = rows.column("word").combine_chunks()
    number, bounds = _letters(words)
    length = np.diff(bounds)
    kind = np.float32 if length.max() < 2000 else np.float64  # whole numbers must stay exact
    owner = np.repeat(np.arange(len(length)), length)
    counts = np.bincount(owner * LETTERS + number, minlength=len(length) * LETTERS).reshape(-1, LETTERS).astype(kind)
    low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
    found = []
    for i, j in _close_pairs(counts, block):
        i, j = np.where(length[i] <= length[j], i, j), np.where(length[i] <= length[j], j, i)
        possible = (length[i] == base[i]) & (base[i] == base[j]) & (low[i] == low[j]) & (high[i] == high[j])
        i, j = i[possible], j[possible]
        place = _first_difference(number, bounds, words, i, j)
        inside = (place >= low[i]) & ((place < high[i]) | ((place == base[i]) & (high[i] == base[i])))
        found.append((i[inside], j[inside]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    row, other = np.r_[i, j], np.r_[j, i]
    if not len(row):
        return None
    n = rows.column("n").to_numpy()
    order = np.lexsort((other, -n[other], row))  # rows of a block go by word
    row, other = row[order], other[order]
    row, first, near = np.unique(row, return_index=True, return_counts=True)
    best = other[first]
    empty = pa.nulls(len(row), pa.int32())
    return pa.record_batch(
        {
            "word": words.take(pa.array(row)),
            "n": n[row],
            "base": empty,
            "low": empty,
            "high": empty,
            "near": near.astype(np.int64),
            "best": words.take(pa.array(best)),
            "best_n": n[best],
        }
    )


_PASSED = "word string, n long, base int, low int, high int, near long, best string, best_n long"


def _pass_on(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
    for b in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        n = b.num_rows
        columns = {c: b.column(c) for c in ("word", "n", "base", "low", "high")}
        yield pa.record_batch({**columns, "near": pa.nulls(n, pa.int64()), "best": pa.nulls(n, pa.string()), "best_n": pa.nulls(n, pa.int64())})


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the blocks that are small enough; rows of the others, to be dealt to finer blocks."""
    held: list[pa.RecordBatch] = []
    passing = None  # the large block whose rows go on

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            found = _near_words(rows)
            if found is not None:
                yield found

    for batch in batches:
        if not batch.num_rows:
            continue
        if passing is not None:
            n = int(np.searchsorted(batch.column("block").to_numpy(), passing, "right"))
            yield from _pass_on(batch.slice(0, n))
            batch = batch.slice(n)
            if not batch.num_rows:
                continue
            passing = None
        held.append(batch)
        rows = pa.Table.from_batches(held)
        block = rows.column("block").to_numpy()
        wide = rows.column("high").to_numpy() - rows.column("low").to_numpy() > 1
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sizes = np.diff(np.r_[starts, len(block)])
        large = (sizes > HELD) & wide[starts]
        last = int(starts[-1])
        for a, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            yield from _pass_on(rows.slice(a, n))
        keep = np.repeat(~large, sizes)
        keep[last:] = False
        yield from whole(rows.filter(pa.array(keep)))
        if large[-1]:
            held, passing = [], int(block[-1])
        else:
            held = rows.slice(last).to_batches()
    if held:
        yield from whole(pa.Table.from_batches(held))


def near_words(counts: DataFrame) -> DataFrame:
    """Rows (word, n_near, form, form_n) of the words with near words; form is the most frequent of them."""
    ship(counts.sparkSession)
    rows, found = _first_blocks(counts), None
    while True:
        rows = rows.repartition("block").sortWithinPartitions("block", "word")
        done = cut_lineage(rows.select("block", "word", "n", "base", "low", "high").mapInArrow(_search_blocks, _PASSED))
        here = done.filter("near is not null").select("word", "near", "best", "best_n")
        found = here if found is None else found.unionByName(here)
        passed = done.filter("near is null").select("word", "n", "base", "low", "high")
        if passed.isEmpty():
            break
        rows = _finer_blocks(passed)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    grouped = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return grouped.select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root): forms followed to the last, by doubling the steps; a form is at least twice as frequent."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(onward, "root", "left")
        doubled = cut_lineage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        if doubled.filter("went").isEmpty():
            return doubled.select("word", "root")
        steps = doubled.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, with one letter taken out
    where the checksum of ``<doc_id>:<run>`` is a multiple of 97, of at least LEAST_LETTERS letters that occur at
    least LEAST_TIMES times. The form is the near word of largest n, the first in code-point order among equals, if
    its n is at least twice the word's; else null. The root is where forms lead, the word itself without a form.
    Null texts have no words, a null doc_id counts as an empty one, repeated rows count each, an empty table gives no
    rows. ``docs`` needs doc_id (a whole number or null) and text; other columns are left aside.
    """
    ship(docs.sparkSession)
    counts = cut_lineage(count_words(docs))
    near = near_words(counts)
    rows = cut_lineage(counts.join(near, "word", "left"))
    named = rows.filter(F.col("form_n") >= 2 * F.col("n"))
    roots = _roots(named)
    has_form = F.col("form_n") >= 2 * F.col("n")
    return rows.join(roots, "word", "left").select(
        "word",
        F.when(has_form, F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("form_n")).alias("form_n"),
    )


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT range AS byte, 0 AS k, range AS c FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
sums AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS b
  FROM runs),
checks AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, b),
    lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h
  FROM bytes, sums),
counts AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
    FROM checks) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (
    SELECT word, n, unnest(range(length(word))) AS i FROM counts)),
pairs AS (
  SELECT DISTINCT word, other, other_n FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN counts b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN counts b ON a.rest = b.word)),
best AS (
  SELECT word, other, other_n, near FROM (
    SELECT *, count(*) OVER (PARTITION BY word) AS near,
      row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM pairs) WHERE place = 1),
forms AS (
  SELECT c.word, c.n, coalesce(near, 0) AS n_near, CASE WHEN other_n >= 2 * c.n THEN other END AS form,
    CASE WHEN other_n >= 2 * c.n THEN other_n END AS form_n
  FROM counts c LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT p.word, f.form FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p USING (word) JOIN forms e ON p.root = e.word WHERE e.form IS NULL
"""
