"""Exact Jaccard self-join of shingle sets by partitioning the universe of shingles.

Sizes fall into bands a factor 4/3 wide, so a set can only be similar to sets of its own band and of its two
neighbours. Two similar sets of sizes a and b differ in at most H = (a + b) / 7 shingles. The index of a band cuts
the universe into m segments, by hash, with m above H + 1. If a set spends weight H + 1 on its segments - one for a
segment that must be equal, two for one that may differ by a single shingle - then, by the pigeonhole principle,
every similar set meets one of these conditions. The first segments of a band carry their one-deletion
neighbourhoods in the index, which is what the weight of two stands for.

The weight above H + 1 is a set's slack. Empty segments use it up first, as they would match everything; what is left
lets a set skip its most frequent signatures (the cost of a signature is the size of its group). A set that cannot
reach H + 1 is joined through an exact prefix of its shingles instead.

Signatures travel packed: a task sorts those of a few thousand documents by bucket and sends one row per bucket.
Groups of equal signatures are not expanded into pairs. In a few turns every member is compared with
the leaders it shares most groups with, other ones each turn. What isn't connected then is compared member by member inside tasks, a large group
in cells of CELL members each way: a parity bitmap, whose bits differ in at most as many places as the sets do, rejects
most pairs. The others aren't given out one by one, as near copies make a square of them, but as the edges of a forest
that connects the members that may be similar. The trees of all forests together are neighbourhoods no link leads out
of; the whole sets of each are compared in cells once more, exactly, and a forest of links is what is left.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hallkeeper.llm import words as W
from hallkeeper.llm.graph import components
from hallkeeper.llm.shipping import ship
from hallkeeper.session import cut_lineage

BUCKET_SIGNATURES = 500_000
"""Signatures a bucket holds on average; the number of buckets grows with the input."""

HELD_SIGNATURES = 2_000_000
"""Signatures a task holds before it passes those of large groups on."""

HOT_GROUP = 20_000
"""Members from which a group is passed on as it comes."""

TURNS = 1
"""Turns in which members are compared with leaders of their signatures, before all that are apart are."""

LEADERS = 20
"""Leaders a member is compared with in a turn."""

CELL = 2048
"""Members on each side of a cell, on average."""

CELL_SHINGLES = 500_000
"""Shingles of whole sets on each side of a cell, on average."""

FINE = 8
"""Bits per shingle of the bitmaps made of whole sets."""

SPREAD = 5
"""Standard deviations by which the smallest sets of a band are to exceed the weight they need."""

_U = np.uint64


@functools.lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    """The largest size of each band, up to 2**40."""
    top, tops = 1, [0, 1]
    while top < 1 << 40:
        top = max(top + 1, (top + 1) * 4 // 3)
        tops.append(top)
    return np.array(tops, dtype=np.int64)


def _band(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(_bands(), sizes, "left")


@functools.lru_cache(maxsize=1)
def _layout() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per band: the weight a set needs, the number of segments, and how many carry deletions.

    Deletions are given to as few segments as let the weight of a band's smallest sets stay above the need by SPREAD
    standard deviations, if all segments with deletions allow for it.
    """
    tops = _bands()
    need = (tops + tops * 4 // 3) // 7 + 1
    segments = need + need // 4 + (need > 1)
    deletions = np.minimum(segments, np.ceil(np.sqrt(segments)).astype(np.int64) + 8)
    for band in range(1, len(tops)):
        m = int(segments[band])
        rate = (int(tops[band - 1]) + 1) / m
        empty = math.exp(-rate)
        twice = 1 - (1 + rate) * empty
        spread = m * max(empty - (1 + rate) * empty * empty, 0.0)

        def enough(d: int, m=m, empty=empty, twice=twice, spread=spread, need=int(need[band])) -> bool:
            mean = m * (1 - empty) + d * twice
            return mean - need >= SPREAD * math.sqrt(spread + d * twice * (1 - twice) + 2 * d * twice * empty)

        low, high = int(deletions[band]), m
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle + 1, high)
        deletions[band] = low
    return need, segments, deletions


def _shape(band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a band's index: the weight a set needs, the number of segments, and how many carry deletions."""
    need, segments, deletions = _layout()
    band = np.maximum(band, 0)
    return need[band], segments[band], deletions[band]


def _segments(doc: np.ndarray, value: np.ndarray, bounds: np.ndarray, band: np.ndarray):
    """Shingles' segments in the index of their document's ``band``, and per segment the document, count and sum.

    Documents of band 0 are left out.
    """
    use = band[doc] > 0
    doc, value = doc[use], value[use]
    need, m, d = _shape(band)
    m = np.where(band > 0, m, 0)
    base = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=base[1:])
    seg = (W.mix(value ^ _U(0x5851F42D4C957F2D)) % np.maximum(m, 1).astype(np.uint64)[doc]).astype(np.int64)
    at = base[doc] + seg
    mixed = W.mix(value + _U(0x2545F4914F6CDD1D))
    count = np.bincount(at, minlength=base[-1])
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, at, mixed)
    owner = np.repeat(np.arange(len(m)), m)
    number = np.arange(base[-1]) - base[owner]
    twice = number < d[owner]
    weight = np.where(twice, np.minimum(count, 2), np.minimum(count, 1))
    slack = np.bincount(owner, weights=weight, minlength=len(m)).astype(np.int64) - need
    return doc, seg, at, mixed, count, total, owner, number, twice, slack


def _sets(batch: pa.RecordBatch):
    data, offsets = W.text_bytes(batch.column("text"))
    return W.shingle_sets(W.words(data, offsets, lower=True))


def _class_ids(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for the empty set."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(W.mix(value), out=sums[1:])
    size = np.diff(bounds)
    ids = W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return np.where(size > 0, ids, _U(0)).view(np.int64)


def _parity(values: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles falls on i; at least one bit per shingle."""
    bits = max(64, 1 << int(len(values) - 1).bit_length()) if len(values) else 64
    return np.packbits((np.bincount((values & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches):
        doc, value, bounds = _sets(batch)
        size = np.diff(bounds)
        own = np.where(size > 0, _band(size), 0)
        short = np.zeros(len(size), bool)
        slacks = np.zeros((2, len(size)), np.int32)
        if len(value):
            for role, band in enumerate((own, np.maximum(own - 1, 0))):
                slack = _segments(doc, value, bounds, band)[-1]
                short |= (band > 0) & (slack < 0)
                slacks[role] = np.maximum(slack, 0)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "row_key": batch.column("row_key"),
                "n_shingles": size.astype(np.int64),
                "class_id": _class_ids(value, bounds),
                "parity": pa.array([_parity(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "short": short,
                "slack_own": slacks[0],
                "slack_upper": slacks[1],
            }
        )


def _pack(buckets: int):
    """One row per chunk and bucket: signatures with their document and flags.

    32 bits of a signature go with its bucket, which holds as many signatures at every size of the input; two that
    agree by chance only make a pair that the verification rejects. Of class ids 32 bits go along, as signatures share
    fewer of them the more buckets there are; ``_members`` gives every class these bits may mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            doc, value, bounds = _sets(batch)
            if not len(value):
                continue
            ids, size = _class_ids(value, bounds), np.diff(bounds)
            # Copies have the same signatures under the same id, so one per chunk is enough.
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True
            once &= size > 0
            own = np.where(once, _band(size), 0)
            table_ids, sig, flags, at_doc = [], [], [], []
            for role, band in enumerate((own, np.maximum(own - 1, 0))):
                of, seg, at, mixed, count, total, owner, number, twice, _ = _segments(doc, value, bounds, band)
                place = (band[owner].astype(np.uint64) << _U(40)) + number.astype(np.uint64)
                some = np.flatnonzero(count > 0)
                sig.append(W.mix(total[some] + W.mix(place[some])))
                flags.append((2 * (twice[some] & (count[some] > 1)) + 4 * role).astype(np.uint8))
                at_doc.append(owner[some] + role * len(ids))
                gone = np.flatnonzero(seg < _shape(band)[2][of])
                gone = gone[count[at[gone]] > 1]
                sig.append(W.mix(total[at[gone]] - mixed[gone] + W.mix(place[at[gone]])))
                flags.append(np.full(len(gone), 1 + 2 + 4 * role, np.uint8))
                at_doc.append(of[gone] + role * len(ids))
                table_ids.append(ids)
            sig, flags, at_doc = np.concatenate(sig), np.concatenate(flags), np.concatenate(at_doc)
            table_ids = np.concatenate(table_ids)
            bucket = (((sig >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, flags, at_doc, bucket = sig[order], flags[order], at_doc[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            rows: dict[str, list] = {k: [] for k in ("bucket", "low", "flags", "doc", "ids")}
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                used, local = np.unique(at_doc[a:b], return_inverse=True)
                rows["bucket"].append(int(bucket[a]))
                rows["low"].append((sig[a:b] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
                rows["flags"].append(flags[a:b].tobytes())
                rows["doc"].append(local.astype(np.uint16).tobytes())
                rows["ids"].append((table_ids[used] & 0xFFFFFFFF).astype(np.uint32).tobytes())
            yield pa.record_batch(
                {k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in rows.items()}
            )

    return run


_PACKED = "bucket long, low binary, flags binary, doc binary, ids binary"
_MEMBERS = "sig long, class_id long, k int, lead long, deleted boolean, weight int, upper boolean"


def _unpack(batch: pa.RecordBatch):
    for r in batch.to_pylist():
        doc = np.frombuffer(r["doc"], np.uint16)
        key = np.frombuffer(r["low"], np.uint32).astype(np.uint64) | (_U(r["bucket"]) << _U(32))
        yield key, np.frombuffer(r["ids"], np.int64)[doc], np.frombuffer(r["flags"], np.uint8)


def _rows(key, ids, flags, k, lead) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "sig": key.view(np.int64),
            "class_id": ids,
            "k": k.astype(np.int32),
            "lead": lead,
            "deleted": (flags & 1).astype(bool),
            "weight": (1 + (flags & 2) // 2).astype(np.int32),
            "upper": (flags & 4).astype(bool),
        }
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the signatures that several sets have, with the group's size and its smallest whole member.

    A group of more than HOT_GROUP members isn't held: its rows pass through as they come.
    """
    held: list[tuple] = []
    n, limit = 0, HELD_SIGNATURES
    hot_keys, hot_leads = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def grouped(parts):
        key, ids, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
        ordered = np.sort(key)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        some = np.flatnonzero(again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key) if len(again) else np.zeros(0, np.int64)
        key, ids, flags = key[some], ids[some], flags[some]
        order = np.lexsort((flags, flags & 1, ids, key))
        key, ids, flags = key[order], ids[order], flags[order]
        # Rows of one id with other flags may be another class with the same bits, so they stay.
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (flags[1:] != flags[:-1])
        return key[first], ids[first], flags[first]

    def measured(key, ids, flags):
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cuts, len(key)])
        lead = np.minimum.reduceat(np.where(flags & 1, np.iinfo(np.int64).max, ids), cuts)
        return np.repeat(size, size), np.repeat(lead, size)

    def pass_on(part):
        """Rows of hot keys, and the rest."""
        nonlocal hot_keys
        key = part[0]
        at = np.minimum(np.searchsorted(hot_keys, key), max(len(hot_keys) - 1, 0))
        hot = hot_keys[at] == key if len(hot_keys) else np.zeros(len(key), bool)
        out = None
        if hot.any():
            h = [x[hot] for x in part]
            out = _rows(*h, np.full(len(h[0]), np.iinfo(np.int32).max), hot_leads[at[hot]])
        return out, tuple(x[~hot] for x in part)

    for batch in batches:
        for part in _unpack(batch):
            out, part = pass_on(part)
            if out is not None:
                yield out
            held.append(part)
            n += len(part[0])
            if n > limit:
                key, ids, flags = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((ids, key))
                key, ids, flags = key[order], ids[order], flags[order]
                size, lead = measured(key, ids, flags)
                new = (size > HOT_GROUP) & (lead != np.iinfo(np.int64).max)
                keys, at = np.unique(key[new], return_index=True)
                hot_keys, leads = np.r_[hot_keys, keys], np.r_[hot_leads, lead[new][at]]
                order = np.argsort(hot_keys)
                hot_keys, hot_leads = hot_keys[order], leads[order]
                out, part = pass_on((key, ids, flags))
                if out is not None:
                    yield out
                held, n = [part], len(part[0])
                limit = max(HELD_SIGNATURES, 2 * n)
    if not n:
        return
    key, ids, flags = grouped(held)
    if not len(key):
        return
    size, lead = measured(key, ids, flags)
    use = (size > 1) & (lead != np.iinfo(np.int64).max)
    for a in range(0, len(key), 100_000):
        s = slice(a, a + 100_000)
        u = use[s]
        if u.any():
            yield _rows(key[s][u], ids[s][u], flags[s][u], size[s][u], lead[s][u])


def _groups_of_short_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def widened() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64).tobytes() for x in batch.column("ids")]
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "ids", pa.array(ids, pa.binary()))

    return _groups(widened())


def _members(texts: DataFrame, classes: DataFrame, total_shingles: int) -> DataFrame:
    """Members of signatures with the columns of their class; a class may be given as a member of another's, too.

    Such a member asks at most more often, as it takes slack, and the verification rejects what it meets.
    """
    buckets = max(1, -(-total_shingles // BUCKET_SIGNATURES))
    packed = texts.select("text").mapInArrow(_pack(buckets), _PACKED)
    grouped = packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_groups_of_short_ids, _MEMBERS)
    return grouped.withColumnRenamed("class_id", "short").join(
        classes.withColumn("short", F.expr("class_id & 4294967295L")), "short"
    )


def _close_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose parity bitmaps differ in no more places than similar sets may."""
    for batch in batches:
        a, b = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
        n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep[i] = int(np.bitwise_count(x ^ y).sum()) * 7 <= n[i]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.75 or more."""
    if len(x) > len(y):
        x, y = y, x
    inter = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * inter >= 75 * (len(x) + len(y) - inter)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
            keep[i] = _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches):
        _, value, bounds = _sets(batch)
        sets = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch({"class_id": _class_ids(value, bounds), "shingles": pa.array(sets, pa.binary())})


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose sets have a similarity of 0.75 or more."""
    side = classes.select("class_id", "n_shingles", "parity")
    near = (
        pairs.join(side.toDF("a", "na", "pa"), "a")
        .join(side.toDF("b", "nb", "pb"), "b")
        .filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
        .mapInArrow(_close_parity, "a long, b long")
    )
    near = cut_lineage(near)
    ids = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "class_id")
    keys = cut_lineage(classes.join(ids, "class_id", "left_semi").select("row_key"))
    sets = cut_lineage(
        texts.select("row_key", "text")
        .join(keys, "row_key", "left_semi")
        .select("text")
        .mapInArrow(_whole_sets, "class_id long, shingles binary")
    )
    return cut_lineage(
        near.join(sets.toDF("a", "sa"), "a")
        .join(sets.toDF("b", "sb"), "b")
        .mapInArrow(_exact, "a long, b long")
        .distinct()
    )


def _prefix_rows(sizes: list[int]):
    """(class_id, shingle) of sets of the given sizes: enough of the least shingles to share one with any similar set."""
    wanted = np.array(sorted(sizes), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            doc, value, bounds = _sets(batch)
            size = np.diff(bounds)
            ids = _class_ids(value, bounds)
            use = np.isin(size, wanted)[doc] & ((np.arange(len(doc)) - bounds[doc]) <= (size // 4)[doc])
            yield pa.record_batch({"b": ids[doc[use]], "shingle": value[use].view(np.int64)})

    return run


def _prefix_pairs(texts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Candidate pairs of the sets that cannot reach the weight they need: small ones, and few of them."""
    sizes = [r[0] for r in rows.filter("short").select("n_shingles").distinct().collect()]  # a few small numbers
    if not sizes:
        return None
    near = {m for n in sizes for m in range(-(-3 * n // 4), 4 * n // 3 + 1)}
    short = rows.filter("short").select("class_id").distinct()
    others = texts.select("text").mapInArrow(_prefix_rows(list(near)), "b long, shingle long").distinct()
    probes = others.withColumnRenamed("b", "a").join(short.withColumnRenamed("class_id", "a"), "a", "left_semi")
    return probes.join(others, "shingle").filter("a != b").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of the signatures whose members aren't all connected yet, with their present roots.

    Signatures of the same members, by a hash of them, are told by one of them; ``alike`` tells how many it stands for.
    """
    if "alike" not in members.columns:
        members = members.withColumn("alike", F.lit(1).cast("long"))
    if roots is not None:
        members = members.drop("root").join(roots, members.class_id == roots.node, "left")
        members = members.withColumn("root", F.coalesce("root", "class_id")).drop("node")
    one = F.xxhash64("class_id", "deleted", "probes")
    open_sigs = (
        members.groupBy("sig")
        .agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("class_id").alias("first"), F.count(F.lit(1)).alias("n"),
             F.bit_xor(one).alias("all"), F.sum(one.bitwiseAND(0x7FFFFFFF)).alias("total"), F.first("alike").alias("alike"))
        .filter("x != y")
        .groupBy("first", "n", "all", "total")
        .agg(F.min("sig").alias("sig"), F.sum("alike").alias("alike"))
    )
    return cut_lineage(members.drop("alike").join(open_sigs.select("sig", "alike"), "sig"))


def _star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with those leaders of its signatures it shares most signatures with, unless connected.

    A signature's leader of this turn is a member with a whole segment. Leaders passed over are left to later steps.
    """
    leads = (
        members.filter("not deleted").groupBy("sig")
        .agg(F.min(F.struct(F.xxhash64("class_id", F.lit(turn)).alias("h"), "class_id", "root")).alias("lead"))
    )
    met = members.join(leads, "sig").filter("root != lead.root")
    shared = met.groupBy("class_id", F.col("lead.class_id").alias("lead")).agg(F.sum("alike").alias("n"))
    best = Window.partitionBy("class_id").orderBy(F.desc("n"), "lead")
    ranked = shared.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= LEADERS)
    return _ordered(ranked.select(F.col("lead").alias("a"), F.col("class_id").alias("b")))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class _Forest:
    """Which rows of a cell are connected, starting from their roots."""

    def __init__(self, root: np.ndarray):
        self.label = np.unique(root, return_inverse=True)[1]
        self.up = list(range(int(self.label.max()) + 1))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray, linked=None) -> list[tuple[int, int]]:
        """The pairs of rows (i, j), if ``linked``, that connect what was apart; labels are brought up to date."""
        x, y = self.label[i], self.label[j]
        if linked is None and len(i) > 1:
            # Pairs of the same two labels are worth one edge.
            at = np.unique(np.minimum(x, y).astype(np.int64) * len(self.up) + np.maximum(x, y), return_index=True)[1]
            i, j, x, y = i[at], j[at], x[at], y[at]
        edges = []
        for a, b, p, q in zip(i.tolist(), j.tolist(), x.tolist(), y.tolist(), strict=True):
            p, q = self.find(p), self.find(q)
            if p != q and (linked is None or linked(a, b)):
                self.up[max(p, q)] = min(p, q)
                edges.append((a, b))
        if edges:
            self.label = np.array([self.find(x) for x in range(len(self.up))])[self.label]
        return edges


def _forest_of_group(g: dict[str, np.ndarray], linked=None) -> list[tuple[int, int]]:
    """Edges (row, row) of a forest over one cell's members that ask and that are met, unlike roots only.

    ``g["bits"]`` holds, per length, the rows and their parity bitmaps. Pairs certain to be unlike make no edge; the
    others make one if ``linked``. Rows that ask go by blocks, small ones first, as what is connected needs no look.
    """
    forest, edges = _Forest(g["root"]), []
    for at_a, all_a in g["bits"]:
        asks = g["asks"][at_a]
        at_a, all_a = at_a[asks], all_a[asks]
        for at_b, all_b in g["bits"]:
            met = g["met"][at_b]
            at_b, bits_b = at_b[met], all_b[met]
            if not len(at_a) or not len(at_b):
                continue
            width = min(all_a.shape[1], bits_b.shape[1])
            bits_a, bits_b = _folded(all_a, width), _folded(bits_b, width)
            most = max(1, 2_000_000 // (len(at_b) * width))
            s, step = 0, min(most, max(1, 16_384 // len(at_b)))
            while s < len(at_a):
                x, y = at_a[s : s + step][:, None], at_b[None, :]
                n, m = g["n"][x], g["n"][y]
                use = (forest.label[x] != forest.label[y]) & ~(g["deleted"][x] & g["deleted"][y])
                use &= 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
                i, j = np.nonzero(use)
                if len(i):
                    unlike = np.bitwise_count(bits_a[s + i] ^ bits_b[j]).sum(axis=1, dtype=np.int64)
                    i, j = at_a[s + i], at_b[j]
                    near = unlike * 7 <= g["n"][i] + g["n"][j]
                    if near.any():
                        edges += forest.join(i[near], j[near], linked)
                s += step
                step = min(most, 2 * step)
    return edges


def _cell_cuts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(len(rows) + 1, bool)
    new[[0, -1]] = True
    for c in ("sig", "i", "j"):
        v = rows.column(c).to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by cell with the cells' bounds; a cell may run over batches."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        cuts = _cell_cuts(kept)
        if len(cuts) > 2:
            yield kept.slice(0, int(cuts[-2])).combine_chunks(), cuts[:-1]
            kept = kept.slice(int(cuts[-2]))
    if kept is not None:
        yield kept.combine_chunks(), _cell_cuts(kept)


def _bytes_of(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each row's begin and the last one's end."""
    column = rows.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.record_batch({"a": pairs[:, 0], "b": pairs[:, 1]})


def _close_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between roots: per cell a forest over the members that may be similar to one met."""
    for rows, cuts in _whole_cells(batches):
        data, offsets = _bytes_of(rows, "parity")
        length = np.diff(offsets)
        column = lambda c: rows.column(c).to_numpy()  # noqa: E731, B023
        all_rows = {"root": column("root"), "n": column("n_shingles"), "deleted": column("deleted"),
                    "asks": column("asks"), "met": column("met")}
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            g = {k: v[a:b] for k, v in all_rows.items()}
            g["bits"] = []
            for size in np.unique(length[a:b]).tolist():
                at = np.flatnonzero(length[a:b] == size)
                g["bits"].append((at, data[offsets[a + at][:, None] + np.arange(size)].view(np.uint64)))
            if edges := _forest_of_group(g):
                x, y = np.array(edges).T
                found.append((g["root"][x], g["root"][y]))
        if found:
            yield _edges(found)


def _fine_bits(value: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length, the sets and their parity bitmaps of at least FINE bits per shingle."""
    size = np.diff(bounds)
    bits = np.maximum(64, 1 << np.ceil(np.log2(FINE * np.maximum(size, 1))).astype(np.int64))
    out = []
    for length in np.unique(bits).tolist():
        at = np.flatnonzero(bits == length)
        owner = np.repeat(np.arange(len(at)), size[at])
        mine = np.repeat(bits == length, size)
        places = owner * length + (value[mine] & _U(length - 1)).astype(np.int64)
        odd = (np.bincount(places, minlength=len(at) * length) & 1).astype(bool)
        out.append((at, np.packbits(odd).view(np.uint64).reshape(len(at), -1)))
    return out


def _linked_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes of a similarity of 0.75 or more: per cell a forest that connects what they do."""
    for rows, cuts in _whole_cells(batches):
        data, offsets = _bytes_of(rows, "shingles")
        column = lambda c: rows.column(c).to_numpy()  # noqa: E731, B023
        all_rows = {"id": column("class_id"), "root": column("root"), "asks": column("asks"), "met": column("met")}
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            g = {k: v[a:b] for k, v in all_rows.items()}
            value = data[offsets[a] : offsets[b]].view(np.uint64)
            bounds = (offsets[a : b + 1] - offsets[a]) // 8
            g["n"] = np.diff(bounds)
            g["deleted"] = np.zeros(b - a, bool)
            g["bits"] = _fine_bits(value, bounds)

            def linked(i: int, j: int, value=value, bounds=bounds) -> bool:
                return _similar(value[bounds[i] : bounds[i + 1]], value[bounds[j] : bounds[j + 1]])

            if edges := _forest_of_group(g, linked):
                x, y = np.array(edges).T
                found.append((g["id"][x], g["id"][y]))
        if found:
            yield _edges(found)


def _close_roots(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between roots that connect all whose members, of one signature, have close parity bitmaps.

    A signature of more than CELL members is dealt to a square of cells: a member asks in its row and is met in its
    column, so each task holds two parts of the group and none holds all of it. Where no member asks, nothing is met.
    """
    cells = (
        members.groupBy("sig")
        .agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"), F.max("probes").alias("asked"))
        .filter("asked").drop("asked")
    )
    placed = (
        members.join(classes.select("class_id", "n_shingles", "parity"), "class_id")
        .join(cells, "sig")
        .withColumn("mine", F.pmod(F.xxhash64("class_id"), F.col("cells")).cast("int"))
    )
    places = F.expr(
        "flatten(transform(sequence(0, cells - 1), o -> IF(o = mine, "
        "array(named_struct('i', mine, 'j', mine, 'asks', probes, 'met', true)), "
        "array(named_struct('i', mine, 'j', o, 'asks', probes, 'met', false), "
        "named_struct('i', o, 'j', mine, 'asks', false, 'met', true)))))"
    )
    dealt = placed.select("sig", "root", "deleted", "n_shingles", "parity", F.inline(places))
    return (
        dealt.filter("asks or met")
        .repartition("sig", "i", "j")
        .sortWithinPartitions("sig", "i", "j")
        .mapInArrow(_close_in_cells, "a long, b long")
        .distinct()
    )


def _links_between(close: DataFrame, roots: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all classes whose roots the edges ``close`` connect and that links connect.

    Classes of a neighbourhood's largest root ask nothing, as any two roots are compared if one of them asks. Rows and
    columns of cells are dealt as in ``_close_roots``, by the shingles that ask and that are met.
    """
    around = components(close).select(F.col("node").alias("root"), F.col("root").alias("sig"))
    held = cut_lineage(
        classes.select("class_id", "n_shingles", "row_key")
        .join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .withColumn("root", F.coalesce("root", "class_id"))
        .join(around, "root")
    )
    sizes = (
        held.groupBy("sig", "root").agg(F.sum("n_shingles").alias("n"))
        .groupBy("sig").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
        .select("sig", F.col("most.root").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / CELL_SHINGLES).cast("int").alias("rows"),
                F.ceil(F.col("n") / CELL_SHINGLES).cast("int").alias("columns"))
    )
    sets = cut_lineage(
        texts.select("row_key", "text")
        .join(held.select("row_key"), "row_key", "left_semi")
        .select("text")
        .mapInArrow(_whole_sets, "class_id long, shingles binary")
        .dropDuplicates(["class_id"])
    )
    placed = (
        held.join(sizes, "sig")
        .withColumn("asking", F.col("root") != F.col("largest"))
        .withColumn("i", F.pmod(F.xxhash64("class_id"), F.col("rows")).cast("int"))
        .withColumn("j", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("columns")).cast("int"))
    )
    places = F.expr(
        "flatten(array("
        "transform(sequence(0, rows - 1), o -> named_struct('i', o, 'j', j, 'asks', asking and o = i, 'met', true)), "
        "IF(asking, transform(filter(sequence(0, columns - 1), o -> o != j), "
        "o -> named_struct('i', i, 'j', o, 'asks', true, 'met', false)), array())))"
    )
    return (
        placed.select("sig", "class_id", "root", F.inline(places))
        .join(sets, "class_id")
        .repartition("sig", "i", "j")
        .sortWithinPartitions("sig", "i", "j")
        .mapInArrow(_linked_in_cells, "a long, b long")
        .distinct()
    )


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, class_id, component (smallest class id reachable by links).

    ``docs`` needs doc_id and text; other columns are left aside. Null and wordless texts have no shingles, class
    0 and a null component: they are linked with nothing. Copies share a class. Repeated rows, and rows with the
    same id and another text, are documents of their own; ``row_key`` tells rows with different texts apart.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "row_key", F.xxhash64("doc_id", "text")
    )
    rows = cut_lineage(
        texts.select("doc_id", "row_key", "text").mapInArrow(
            _describe,
            "doc_id long, row_key long, n_shingles long, class_id long, parity binary, short boolean, "
            "slack_own int, slack_upper int",
        )
    )
    classes = cut_lineage(
        rows.filter("n_shingles > 0")
        .groupBy("class_id")
        .agg(F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"), F.min("row_key").alias("row_key"),
             F.first("slack_own").alias("slack_own"), F.first("slack_upper").alias("slack_upper"))
    )
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    # A set leaves out its most frequent signatures within its slack. With all of them inside the slack, it is
    # similar to nothing. A deletion left out counts as its segment's second weight.
    own = Window.partitionBy("short", "class_id", "upper")  # rows lie by ``short`` since their join
    costly = own.orderBy(F.desc("k"), "sig", "deleted").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.when(F.col("deleted"), 1).otherwise(F.col("weight")))
    members = cut_lineage(
        _members(texts, classes.select("class_id", "slack_own", "slack_upper"), total)
        .withColumn("slack", F.when(F.col("upper"), F.col("slack_upper")).otherwise(F.col("slack_own")))
        .withColumn("spent", spent.over(costly))
        .withColumn("all", spent.over(own))
        .filter("all > slack")
        .select("sig", "class_id", F.col("class_id").alias("root"), "deleted", (F.col("spent") > F.col("slack")).alias("probes"))
    )

    tried = links = roots = None
    for turn in range(TURNS):
        members = _apart(members, roots)
        pairs = _star_pairs(members, turn)
        if turn == 0:
            prefix_pairs = _prefix_pairs(texts, rows)
            pairs = pairs if prefix_pairs is None else _ordered(pairs.union(prefix_pairs))
        else:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            break
        found = verified(pairs, texts, classes)
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        roots = components(links)
    if links is None:
        return rows.select("doc_id", "row_key", "n_shingles", "class_id", _component(F.lit(None).cast("long")))

    close = cut_lineage(_close_roots(_apart(members, roots), classes))
    if not close.isEmpty():
        more = cut_lineage(_links_between(close, roots, texts, classes))
        roots = components(links.union(more))
    return rows.join(roots, rows.class_id == roots.node, "left").select(
        "doc_id", "row_key", "n_shingles", "class_id", _component(F.col("root"))
    )


def _component(root: Column) -> Column:
    return F.when(F.col("n_shingles") > 0, F.coalesce(root, F.col("class_id"))).alias("component")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id (smallest doc_id reachable by links)."""
    rows = cut_lineage(jaccard_classes(docs))
    names = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(names, "component", "left").select(
        "doc_id",
        "n_shingles",
        "class_id",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, with the columns of ``docs``.

    Of repeated rows one stays; documents without words are in no group and all stay.
    """
    rows = cut_lineage(jaccard_classes(docs))
    kept = (
        rows.filter("component is not null")
        .groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("kept"))
        .select("kept.row_key")
        .union(rows.filter("component is null").select("row_key"))
        .distinct()
    )
    key = "__row_key"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    stays = keyed.join(kept.withColumnRenamed("row_key", key), key, "left_semi")
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = stays.filter(worded).dropDuplicates([key])
    return once.union(stays.filter(~F.coalesce(worded, F.lit(False)))).select(*docs.columns)
