"""Personal data in texts, with DataFrame functions only.

Four patterns give the base spans. Wider generators propose further, overlapping candidates. Boosted trees score each
candidate from its format and the words around it; a threshold per kind, calibrated on documents held out from the
fit, selects the candidates that are added to the base spans.

The features hide how a base span is told from its variants: they are read from the candidate with "(at)" turned into
"@", "00" and "+" taken off, and so on. A candidate is a positive example if it overlaps a base span of its kind, or if
a trigger word comes before it and its form holds; a negative one if its form fails, if it overlaps another kind's
base span, or if it is a piece of a longer word or number. All others have no label: they are only scored. Thresholds
are calibrated on candidates that overlap no base span, as only such can be added.

The trees are fitted to counts: every candidate of the corpus falls on one combination of binned features, and the
number of combinations is bounded by the bins (COMBINATIONS).

Running values over a text's spans are kept in pieces of about the square root of their number, so that a text of
100,000 spans doesn't copy a growing list 100,000 times.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A run that has failed once isn't tried again from its middle (the look-behind and
# the possessive marks), which changes no match.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_AT = r"\x20?[(\[]\x20?(?i:at)\x20?[)\]]\x20?"
_DOT = r"\x20?[(\[]\x20?(?i:dot)\x20?[)\]]\x20?"

CANDIDATES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|\[\.\]|{_DOT})[0-9]{{1,3}}){{3}}",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,16}+",
}

TRIGGERS = {
    "email": "e-?mail|contact|write|kontakt|correo|courriel|schreib",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|karte|tarjeta|carte|credit",
    "phone": "phone|call|tel|fax|mobile|cell|telefon|anruf|llame",
}
"""Beginnings of words that speak for a kind when they come shortly before a candidate."""

_NATIONAL = r"^00[1-9][0-9]{9,12}$|^\(?0[0-9][0-9]*[\x20()/.-]|^\([0-9]|^\+|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"
_DATE = r"^\(?[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?![0-9])"

FEATURES = {"digits": 8, "parts": 6, "marks": 4, "check": 3, "trigger": 2, "before": 3, "after": 3}
"""Features and the number of their bins."""

COMBINATIONS = math.prod(FEATURES.values()) * len(KINDS)

TREES = 40
RATE = 0.3
PRECISION = 0.95
"""Share of the selected held-out candidates that must be right."""

PRIOR = 20
"""Candidates with the model's own probability that calibration adds to those held out."""

_MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _scan(
    items: Column,
    state: str,
    zero: Column,
    advance: Callable[[Column, Column], Column],
    out: str,
    emit: Callable[[Column, Column], Column],
) -> Column:
    """``emit(state before the item, item)`` for every item; ``state`` and ``out`` are types.

    The list is cut into pieces of its size's square root; the states at their beginnings come first.
    """
    states, none = F.array().cast(f"array<{state}>"), F.array().cast(f"array<{out}>")

    def pieces(all_items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_items))).cast("int")
        last = F.floor((F.size(all_items) - 1) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * width + 1, width))

    def begins(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(zero.cast(state).alias("now"), states.alias("seen")),
            lambda a, part: F.struct(
                F.aggregate(part, a["now"], advance).alias("now"), F.array_append(a["seen"], a["now"]).alias("seen")
            ),
            lambda a: a["seen"],
        )

    def one(z: Column) -> Column:
        return F.aggregate(
            z["part"],
            F.struct(z["now"].alias("now"), none.alias("out")),
            lambda a, x: F.struct(
                advance(a["now"], x).cast(state).alias("now"),
                F.array_append(a["out"], emit(a["now"], x).cast(out)).alias("out"),
            ),
            lambda a: a["out"],
        )

    def run(parts: Column) -> Column:
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), begins(parts).alias("now")), one))

    return _bound(items, lambda a: F.when(F.size(a) > 0, _bound(pieces(a), run)).otherwise(none))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value, before, after); code points, end exclusive."""

    def advance(at: Column, p: Column) -> Column:
        return at + F.char_length(p["gap"]) + F.char_length(F.coalesce(p["value"], F.lit("")))

    def emit(at: Column, p: Column) -> Column:
        start = at + F.char_length(p["gap"])
        return F.struct(
            start.alias("start"), (start + F.char_length(p["value"])).alias("end"), p["value"].alias("value"),
            F.lower(F.substring(p["gap"], -24, 24)).alias("before"),
            F.substring(F.coalesce(p["next"], F.lit("")), 1, 1).alias("after"),
        )

    def placed(s: Column) -> Column:
        parts = F.arrays_zip(
            s["gaps"].alias("gap"), s["values"].alias("value"), F.slice(s["gaps"], 2, F.size(s["gaps"])).alias("next")
        )
        return F.filter(_scan(parts, "int", F.lit(0), advance, _MATCH, emit), lambda m: m["value"].isNotNull())

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return _bound(found, placed)


def _none() -> Column:
    return F.array().cast(f"array<{_MATCH}>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _worth(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "email":
        return text.contains("@") | text.rlike(r"[(\[]\x20?(?i:at)\x20?[)\]]")
    return text.rlike("[0-9]")


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind."""
    worth = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    found = F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m["value"]))
    return F.when(worth, found).otherwise(_none())


def _features(kind: str, m: Column) -> dict[str, Column]:
    value = {
        "email": F.regexp_replace(F.regexp_replace(m["value"], _AT, "@"), _DOT, "."),
        "ip": F.regexp_replace(m["value"], rf"\[\.\]|{_DOT}", "."),
        "card": m["value"],
        "phone": F.regexp_replace(m["value"], r"^(?:\+|00)", ""),
    }[kind]
    digits = _digits(value)
    n = F.char_length(digits)
    whole = {
        "email": value.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": n.between(13, 19) & F.call_function("luhn_check", digits),
        "phone": n.between(9, 15) & ~m["value"].rlike(_DATE),
    }[kind]
    shaped = m["value"].rlike(_NATIONAL) if kind == "phone" else F.lit(True)
    char = lambda c: F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(2)
    return {
        "digits": F.when(n < 1, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 13, 4).when(n < 16, 5).when(n < 17, 6).otherwise(7),
        "parts": F.greatest(F.least(F.size(F.split(value, r"[^\p{L}\p{N}]+")), F.lit(6)) - 1, F.lit(0)),
        "marks": F.least(F.char_length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), F.lit(3)),
        "check": F.when(~F.coalesce(whole, F.lit(False)), 0).when(shaped, 2).otherwise(1),
        "trigger": m["before"].rlike(rf"\b(?:{TRIGGERS[kind]})").cast("int"),
        "before": char(F.substring(m["before"], -1, 1)),
        "after": char(F.coalesce(m["after"], F.lit(""))),
    }


def candidate_spans(text: Column, kind: str) -> Column:
    """Candidates of one kind with their features."""
    described = F.transform(
        _matches(text, CANDIDATES[kind]),
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"),
            *[c.cast("int").alias(f) for f, c in _features(kind, m).items()],
        ),
    )
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:int" for c in ("start", "end", *FEATURES)) + ">>")
    return F.when(_worth(text, kind), described).otherwise(empty)


class Tree(NamedTuple):
    """Two levels of splits ``feature <= bin``; four leaf values."""

    splits: tuple[tuple[str, int], ...]
    leaves: tuple[float, ...]


class Model(NamedTuple):
    start: float
    trees: tuple[Tree, ...]
    threshold: float


def _best_split(rows: list[dict], gradient: list[float], hessian: list[float], members: list[int]):
    """The split of ``members`` with the largest gain, and the leaf values on its sides."""
    def leaf(g: float, h: float) -> float:
        return g / (h + 1.0)

    total_g, total_h = sum(gradient[i] for i in members), sum(hessian[i] for i in members)
    best = (0.0, (next(iter(FEATURES)), 99), members, [])
    for f, bins in FEATURES.items():
        g, h = [0.0] * bins, [0.0] * bins
        for i in members:
            g[rows[i][f]] += gradient[i]
            h[rows[i][f]] += hessian[i]
        left_g = left_h = 0.0
        for b in range(bins - 1):
            left_g, left_h = left_g + g[b], left_h + h[b]
            gain = left_g * leaf(left_g, left_h) + (total_g - left_g) * leaf(total_g - left_g, total_h - left_h)
            gain -= total_g * leaf(total_g, total_h)
            if gain > best[0] + 1e-9:
                best = (gain, (f, b), None, None)
    f, b = best[1]
    low = [i for i in members if rows[i][f] <= b]
    high = [i for i in members if rows[i][f] > b]
    values = [leaf(sum(gradient[i] for i in part), sum(hessian[i] for i in part)) if part else 0.0 for part in (low, high)]
    return best[1], low, high, values


def _grow(rows: list[dict], gradient: list[float], hessian: list[float]) -> Tree:
    split, low, high, _ = _best_split(rows, gradient, hessian, list(range(len(rows))))
    left, _, _, left_values = _best_split(rows, gradient, hessian, low)
    right, _, _, right_values = _best_split(rows, gradient, hessian, high)
    return Tree((split, left, right), (*left_values, *right_values))


def _value(tree: Tree, row: dict) -> float:
    (f, b), left, right = tree.splits
    (g, c), leaves = (left, tree.leaves[:2]) if row[f] <= b else (right, tree.leaves[2:])
    return leaves[0] if row[g] <= c else leaves[1]


def fit_trees(rows: list[dict]) -> Model:
    """Boosted trees from rows of features with ``fit_n``, ``fit_pos``, ``held_n``, ``held_pos``.

    The threshold is the lowest score above which PRECISION of the held-out candidates are positive, when PRIOR more
    with the model's own probability at that score are counted with them; without such a score nothing is selected.
    """
    n, pos = sum(r["fit_n"] for r in rows), sum(r["fit_pos"] for r in rows)
    start = math.log((pos + 1) / (n - pos + 1))
    scores, trees = [start] * len(rows), []
    for _ in range(TREES if 0 < pos < n else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        gradient = [r["fit_pos"] - r["fit_n"] * q for r, q in zip(rows, p, strict=True)]
        hessian = [r["fit_n"] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        tree = _grow(rows, gradient, hessian)
        tree = tree._replace(leaves=tuple(round(RATE * max(-4.0, min(4.0, v)), 6) for v in tree.leaves))
        trees.append(tree)
        scores = [s + _value(tree, r) for s, r in zip(scores, rows, strict=True)]
    threshold, held, right = math.inf, 0, 0
    order = sorted(range(len(rows)), key=lambda i: -scores[i])
    for at, i in enumerate(order):
        held, right = held + rows[i]["held_n"], right + rows[i]["held_pos"]
        last_of_score = at + 1 == len(order) or scores[order[at + 1]] < scores[i] - 1e-9
        expected = PRIOR / (1 + math.exp(-scores[i]))
        if last_of_score and right + expected >= PRECISION * (held + PRIOR):
            threshold = scores[i] - 1e-9
    return Model(start, tuple(trees), threshold)


def _score(model: Model, m: Column) -> Column:
    def side(split: tuple[str, int], leaves: tuple[float, ...]) -> Column:
        return F.when(m[split[0]] <= split[1], leaves[0]).otherwise(leaves[1])

    total = F.lit(model.start)
    for t in model.trees:
        top = m[t.splits[0][0]] <= t.splits[0][1]
        total = total + F.when(top, side(t.splits[1], t.leaves[:2])).otherwise(side(t.splits[2], t.leaves[2:]))
    return total


_PLACE = ("start", "end", "rank", "base")
_SPAN = "struct<start:int,end:int,rank:int,base:boolean," + ",".join(f"{f}:int" for f in FEATURES)
_FLAGGED = _SPAN + ",own:boolean,other:boolean>"


def _met(spans: Column, forward: bool) -> Column:
    """Marks spans that a base span before them (or behind them) reaches into: own for their kind, other for another."""
    far = F.lit(0 if forward else 2**31 - 1)
    edge, wider = ("end", F.greatest) if forward else ("start", F.least)

    def advance(edges: Column, x: Column) -> Column:
        return F.transform(edges, lambda e, k: F.when(x["base"] & (x["rank"] == k), wider(e, x[edge])).otherwise(e))

    def emit(edges: Column, x: Column) -> Column:
        mine = edges[x["rank"]]
        others = F.transform(edges, lambda e, k: F.when(x["rank"] == k, far).otherwise(e))
        reaches = (lambda e: e > x["start"]) if forward else (lambda e: e < x["end"])
        return F.struct(
            *[x[c].alias(c) for c in (*_PLACE, *FEATURES)],
            (x["own"] | reaches(mine)).alias("own"),
            (x["other"] | reaches(F.array_max(others) if forward else F.array_min(others))).alias("other"),
        )

    return _scan(spans, "array<int>", F.array(*[far] * len(KINDS)), advance, _FLAGGED, emit)


def flagged_candidates(text: Column, base: dict[str, Column]) -> Column:
    """All candidates with their features; own and other tell which overlap a base span of their or another kind."""

    def span(rank: int, of_base: bool) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(of_base).alias("base"),
            *[(F.lit(0) if of_base else s[f]).alias(f) for f in FEATURES], F.lit(False).alias("own"), F.lit(False).alias("other"),
        )

    parts = []
    for k, kind in enumerate(KINDS):
        parts += [F.transform(base[kind], span(k, True)), F.transform(candidate_spans(text, kind), span(k, False))]
    spans = F.array_sort(F.concat(*parts).cast(f"array<{_FLAGGED}>"))
    both = _met(F.reverse(_met(spans, forward=True)), forward=False)
    return F.filter(both, lambda s: ~s["base"])


def fit(docs: DataFrame) -> dict[str, Model]:
    """A model per kind, fitted to all candidates of the corpus; documents in five are held out by their text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("held"))
    source = source.filter(source.text.rlike("[0-9@]") | _worth(source.text, "email"))
    found = flagged_candidates(F.col("text"), {kind: base_spans(F.col("text"), kind) for kind in KINDS})
    told = source.select("held", F.explode(found).alias("c")).select("held", "c.*")
    piece = (F.col("before") == 1) | (F.col("after") == 1)
    free = ~F.col("own")
    right = F.col("own") | (~F.col("other") & ~piece & (F.col("check") > 0) & (F.col("trigger") == 1))
    known = right | F.col("other") | piece | (F.col("check") < 2)
    told = told.withColumn("known", known).withColumn("right", right & known)
    counts = told.groupBy("rank", *FEATURES).agg(
        F.count_if(~F.col("held") & F.col("known")).alias("fit_n"), F.count_if(~F.col("held") & F.col("right")).alias("fit_pos"),
        F.count_if(F.col("held") & free & F.col("known")).alias("held_n"), F.count_if(F.col("held") & free & F.col("right")).alias("held_pos"),
    )
    rows = [r.asDict() for r in counts.orderBy("rank", *FEATURES).collect()]  # at most COMBINATIONS rows
    return {kind: fit_trees([r for r in rows if r["rank"] == k]) for k, kind in enumerate(KINDS)}


def with_spans(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``docs`` with base and spans: arrays of (rank, start, end), by rank of the kind and start."""

    def place(rank: int | None = None) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            (s["rank"] if rank is None else F.lit(rank)).alias("rank"), s["start"].alias("start"), s["end"].alias("end")
        )

    out = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"__{kind}", base_spans(F.col("__text"), kind))
    base = F.concat(*[F.transform(F.col(f"__{kind}"), place(k)) for k, kind in enumerate(KINDS)])
    out = out.withColumn("base", base)
    spans = F.col("base")
    if any(not math.isinf(m.threshold) for m in models.values()):
        found = flagged_candidates(F.col("__text"), {kind: F.col(f"__{kind}") for kind in KINDS})

        def chosen(c: Column) -> Column:
            enough = F.lit(False)
            for k, kind in enumerate(KINDS):
                if not math.isinf(models[kind].threshold):
                    enough = F.when(c["rank"] == k, _score(models[kind], c) >= models[kind].threshold).otherwise(enough)
            return ~c["own"] & ~c["other"] & enough

        added = F.transform(F.filter(found, chosen), place())
        spans = F.array_sort(F.concat(F.col("base"), added))
    return out.withColumn("spans", spans).drop("__text", *[f"__{kind}" for kind in KINDS])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    A null text is empty and has none. Repeated rows are judged each; other columns of ``docs`` are left aside.
    """
    found = with_spans(docs.select("doc_id", "text"), fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with every run of overlapping spans replaced by its first one's kind.

    A piece of the spans is cut from the text first, as Spark counts code points from a text's beginning.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
    )
    cut = "struct<at:int,start:int,end:int,rank:int>"
    cuts = _scan(
        by_start, "int", F.lit(0), lambda at, s: F.greatest(at, s["end"]), cut,
        lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")),
    )

    def piece(part: Column) -> Column:
        first = part[0]["at"]
        here = F.substring(text, first + 1, F.element_at(part, -1)["start"] - first)
        return _bound(here, lambda h: F.array_join(F.transform(part, lambda c: F.concat(
            F.substring(h, c["at"] - first + 1, c["start"] - c["at"]), names[c["rank"]])), ""))

    def whole(kept: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(kept))).cast("int")
        last = F.floor((F.size(kept) - 1) / width).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: piece(F.slice(kept, i * width + 1, width)))
        return F.array_join(parts, "")

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(
        _bound(F.filter(cuts, lambda c: c["start"] >= c["at"]), whole), F.substring(text, end + 1, F.char_length(text))
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one.

    Columns, null texts and repeated rows stay as they are; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = with_spans(rows, fit(docs))
    new = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
