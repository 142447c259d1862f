"""Byte-pair encoding and decoding of whole texts, long ones in parallel halves.

A text is cut into leaves that Spark encodes side by side. Two neighbouring leaves are joined by encoding a window
around their border again. The window grows until, on either side, it has a token border in common with the leaf
there and the same token after it. Every two neighbours of the joined sequence then stand next to each other in an
encoding the library made, and a sequence whose neighbours all do so is the encoding of the whole; a window that has
grown over both leaves is their encoding anyway. The joins form a tree: pairs, then pairs of pairs.

Units between spaces and line ends never share a token and no normalisation reaches over them, so a unit that was
seen before is looked up. A new unit of Latin letters and signs is lower-cased and cut by the pattern in the tokenizer
file, and only parts that are new as well go to the library; any other new unit goes there whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm.shipping import ship

LEAF = 1 << 16
"""Characters encoded in one piece; longer texts are cut into halves until they fit."""

WINDOW = 32
"""Characters on either side of a border that are encoded again first; doubled until both sides agree."""

KNOWN_UNITS = 250_000
"""Units, and parts, a worker takes in before it forgets those that were not met again since it last did."""

AT_ONCE = 10_000
"""New units given to the library in one call."""

UNIT = 512
"""Longer units are encoded without being remembered."""


class Encoded(NamedTuple):
    """Token ids with the character range of the text each stands for."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


LATIN = regex.compile("[!-~\u00a1-\u024f]+")
"""Units that hold no white space and no mark to compose, and whose lower case doesn't depend on the library."""

LOWERED = ["NFC", "Replace", "Lowercase"]
CUT = ["Split", "ByteLevel"]
"""Steps of a tokenizer file whose units can be cut into parts here."""


class Memory:
    """What a worker knows of units or parts; those not met for long are forgotten."""

    def __init__(self):
        self.recent: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def unknown(self, names: set[str]) -> list[str]:
        """The names that have to be learnt; all others are in ``recent`` afterwards."""
        recent, older = self.recent, self.older
        unmet = [n for n in names if n not in recent]
        recent |= {n: older[n] for n in unmet if n in older}
        return [n for n in unmet if n not in older]

    def forget(self) -> None:
        if len(self.recent) > KNOWN_UNITS:
            self.recent, self.older = {}, self.recent


def _parts_of(library) -> tuple[regex.Pattern, object] | None:
    """The pattern that cuts a lower-cased unit into parts and a tokenizer for parts, if the file is of that kind."""
    file = json.loads(library.to_str())
    before, cut = (file.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    before, cut = before.get("normalizers", []), cut.get("pretokenizers", [])
    if [x["type"] for x in before] != LOWERED or [x["type"] for x in cut] != CUT:
        return None
    white = before[1]["pattern"] == {"Regex": "\\s+"} and before[1]["content"] == " "
    matches = cut[0]["invert"] and cut[0]["behavior"] == "Removed" and "Regex" in cut[0]["pattern"]
    whole = not cut[1]["use_regex"] and not cut[1]["add_prefix_space"]
    if not (white and matches and whole) or any(t["normalized"] for t in file["added_tokens"]):
        return None
    plain = file | {"normalizer": None, "pre_tokenizer": cut[1], "added_tokens": []}
    return regex.compile(cut[0]["pattern"]["Regex"]), type(library).from_str(json.dumps(plain))


class Coder:
    """A tokenizer file with the worker's memory of units and their parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.units, self.parts = Memory(), Memory()
        self.cut = _parts_of(self.library)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> Encoded:
        found = self.library.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        return Encoded(np.array(found.ids, "<u4"), offsets[:, 0], offsets[:, 1])

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist(), skip_special_tokens=False)

    def _ask(self, library, names: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded) of names that the library takes as words of one sequence, each by itself."""
        out = {}
        for a in range(0, len(names), AT_ONCE):
            some = names[a : a + AT_ONCE]
            found = library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = found.ids
            cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            raw = np.array(ids, "<u4").tobytes()
            spans = list(zip(cuts, cuts[1:]))
            texts = self.library.decode_batch([ids[i:j] for i, j in spans], skip_special_tokens=False)
            out |= {n: (raw[4 * i : 4 * j], t) for n, (i, j), t in zip(some, spans, texts, strict=True)}
        return out

    def _learn(self, units: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded) of new units."""
        if self.cut is None:
            return self._ask(self.library, units)
        latin = [u for u in units if LATIN.fullmatch(u) and not any(t in u for t in self.added)]
        out = self._ask(self.library, list(set(units).difference(latin)))
        pattern, library = self.cut
        split = [pattern.findall(u.lower()) for u in latin]
        self.parts.recent |= self._ask(library, self.parts.unknown(set().union(*split)))
        known = self.parts.recent
        for unit, names in zip(latin, split, strict=True):
            ids, texts = zip(*map(known.__getitem__, names))
            out[unit] = (b"".join(ids), " ".join(texts)) if len(ids) > 1 else (ids[0], texts[0])
        self.parts.forget()
        return out

    def encode_known(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded) of each text, unit by unit."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = self.units.unknown(set().union(*split))
        known = self.units.recent
        known |= self._learn(new)
        out = []
        for units in split:
            ids, decoded = zip(*map(known.__getitem__, units))
            out.append((b"".join(ids), " ".join(filter(None, decoded))))
        for u in new:
            if len(u) > UNIT:
                del known[u]
        self.units.forget()
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder of a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _agree(left: Encoded, window: Encoded, shift: int, low: int, high: int) -> tuple[int, int] | None:
    """Positions in ``left`` and ``window`` of a shared token border in [low, high) with the same next token."""
    at = {int(s): i for i, s in enumerate(left.start) if low <= s < high}
    for j, s in enumerate((window.start + shift).tolist()):
        i = at.get(s)
        if i is None or left.ids[i] != window.ids[j] or left.end[i] != window.end[j] + shift:
            continue
        before_left = left.end[i - 1] <= s if i else True
        before_window = window.end[j - 1] + shift <= s if j else True
        if before_left and before_window:
            return i, j
    return None


def join(text: str, border: int, left: Encoded, right: Encoded, encode: Callable[[str], Encoded]) -> Encoded:
    """The encoding of ``text`` from those of its parts before and after ``border``; offsets are those of ``text``."""
    size = WINDOW
    while True:
        a, b = max(0, border - size), min(len(text), border + size)
        window = encode(text[a:b])
        whole_left, whole_right = a == 0, b == len(text)
        # The window's own edges may be wrong: agreement is looked for from a quarter of it inwards.
        first = (0, 0) if whole_left else _agree(left, window, a, a + size // 4, border)
        last = None
        if whole_right:
            last = (len(right.ids), len(window.ids))
        else:
            last = _agree(right, window, a, border, b - size // 4)
        if first and last and first[1] <= last[1]:
            i, j = first
            k, m = last
            return Encoded(
                np.concatenate([left.ids[:i], window.ids[j:m], right.ids[k:]]),
                np.concatenate([left.start[:i], window.start[j:m] + a, right.start[k:]]),
                np.concatenate([left.end[:i], window.end[j:m] + a, right.end[k:]]),
            )
        size *= 2


def join_all(parts: list[str], encoded: list[Encoded], encode: Callable[[str], Encoded]) -> Encoded:
    """Join the encodings of a text's consecutive parts in a tree."""
    level = list(zip(parts, encoded, strict=True))
    while len(level) > 1:
        above = []
        for n in range(0, len(level) - 1, 2):
            (lt, le), (rt, re) = level[n], level[n + 1]
            moved = Encoded(re.ids, re.start + len(lt), re.end + len(lt))
            above.append((lt + rt, join(lt + rt, len(lt), le, moved, encode)))
        if len(level) % 2:
            above.append(level[-1])
        level = above
    return level[0][1]


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text cut into halves until no part is longer than a leaf; at least one part."""
    if len(text) <= leaf:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], leaf) + leaves(text[half:], leaf)


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                made = coder(path).encode_known(part.column("text").to_pylist())
                yield pa.record_batch(
                    {
                        **{c: part.column(c) for c in part.schema.names if c != "text"},
                        "ids": pa.array([x[0] for x in made], pa.binary()),
                        "decoded": pa.array([x[1] for x in made], pa.string()),
                    }
                )

    return run


def _cut(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, part in enumerate(leaves(text, leaf)):
                    yield pa.record_batch({"row_key": [row], "part": pa.array([n], pa.int32()), "text": [part]})

    return run


def _encode_leaf(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                e = coder(path).encode(row.column("text")[0].as_py())
                yield pa.record_batch(
                    {
                        "row_key": row.column("row_key"),
                        "part": row.column("part"),
                        "text": row.column("text"),
                        "ids": pa.array([e.ids.tobytes()], pa.binary()),
                        "spans": pa.array([np.stack([e.start, e.end]).astype(np.int32).tobytes()], pa.binary()),
                    }
                )

    return run


def _join_leaves(path: str):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        encoded = []
        for r in rows:
            spans = np.frombuffer(r["spans"], np.int32).astype(np.int64).reshape(2, -1)
            encoded.append(Encoded(np.frombuffer(r["ids"], "<u4"), spans[0], spans[1]))
        c = coder(path)
        whole = join_all([r["text"] for r in rows], encoded, c.encode)
        return pa.table(
            {
                "row_key": pa.array([rows[0]["row_key"]], pa.int64()),
                "ids": pa.array([whole.ids.tobytes()], pa.binary()),
                "decoded": pa.array([c.decode(whole.ids)], pa.string()),
            }
        )

    return run


def encode_texts(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """One row per document: its columns but text, with ids (little-endian unsigned 32-bit) and decoded.

    A null text is empty: no ids, an empty decoded text. Repeated rows are encoded each; equal long texts once.
    A clashing input column named ids, decoded or row_key is left out.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "ids", "decoded", "row_key")]
    texts = docs.select(*others, F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > leaf
    kept = texts.select(*others, "text").schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields if f.name != "text")
    out = f"{out}, ids binary, decoded string" if out else "ids binary, decoded string"
    short = texts.filter(~is_long).mapInArrow(_encode_short(path), out)
    long = texts.filter(is_long).withColumn("row_key", F.xxhash64("text", F.length("text")))
    joined = (
        long.select("row_key", "text")
        .dropDuplicates(["row_key"])
        .mapInArrow(_cut(leaf), "row_key long, part int, text string")
        .repartition("row_key", "part")
        .mapInArrow(_encode_leaf(path), "row_key long, part int, text string, ids binary, spans binary")
        .groupBy("row_key")
        .applyInArrow(_join_leaves(path), "row_key long, ids binary, decoded string")
    )
    return short.unionByName(long.drop("text").join(joined, "row_key").select(*others, "ids", "decoded"))
