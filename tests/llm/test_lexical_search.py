"""Ranked lexical search against plain loops."""

from __future__ import annotations

import collections
import math
import random
import re

from hallkeeper.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, rank string, spread string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """docs and items: lists of (id, text)."""
    counted = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n, total = len(counted), sum(x[2] for x in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        query = collections.Counter(terms(text))
        found = []
        for doc, c, length in counted:
            m = 100 - 75 + (75 * length * n) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in query.items()
                if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return out


def same(found, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_equals_plain_loops_with_nulls_ties_repeats_and_long_texts(spark, documents):
    deal = random.Random(3)
    pool = [f"wort{i}" for i in range(400)] + ["ÀÉ", "日本", "a1"] + ["the", "of"] * 60
    texts = [" ".join(deal.choices(pool, k=deal.randint(1, 60))) for _ in range(700)]
    texts += [None, "", "?!. --", "The OF;the-of", " ".join(deal.choices(pool, k=30_000))] + ["wort1 wort2 of"] * 40
    docs = documents(texts, repeat=15)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    nameless = docs.selectExpr("cast(null as long) doc_id", "text", "'x' item_id", "1 norm").limit(3)
    rows += [(None, r.text) for r in nameless.collect()]
    docs = docs.select("doc_id", "text").unionByName(nameless.select("doc_id", "text")).selectExpr("*", "'x' terms", "2 score")
    items = [(i, " ".join(deal.choices(pool, k=deal.randint(1, 50)))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "unheard"), (62, "the the The wort1"), (None, texts[5]), (64, texts[-45])]
    frame = spark.createDataFrame([(*x, "a", "b", "c") for x in items], ITEMS)
    assert same(L.search(docs, frame), plain_search(rows, items))
    assert same(L.search(docs.repartition(7), frame, k=3), plain_search(rows, items, 3))


def test_items_in_several_blocks_give_the_same(spark, documents, monkeypatch):
    docs = documents([f"x{i % 7} y{i % 5} z{i}" for i in range(80)])
    items = [(i, f"x{i % 7} y{i % 3} z{2 * i}") for i in range(30)]
    monkeypatch.setattr(L, "BLOCK_ITEMS", 8)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], items)
    assert same(L.search(docs, spark.createDataFrame(items, "item_id long, text string")), want)


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "x", "y", "z")], ITEMS)
    for docs, items in ((documents(["a b"]), nothing), (documents([]), some), (documents(["", None]), some)):
        found = L.search(docs, items)
        assert found.collect() == []
        assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_most_pairs_are_left_out_by_bounds(monkeypatch):
    """Bounds only choose what is scored again; with a good threshold that is few."""
    import numpy as np
    import pyarrow as pa

    deal = np.random.default_rng(1)
    n, v = 2000, 300
    size = deal.integers(5, 40, n)
    vectors = [np.sort(deal.choice(v, s, replace=False)) for s in size]
    impacts = [deal.integers(1, 1_000_000, s) * (1 + t) for s, t in zip(size, vectors, strict=True)]
    item = np.repeat(np.arange(20), 12)
    term = np.concatenate([np.sort(deal.choice(v, 12, replace=False)) for _ in range(20)])
    q = L.Items(pa.array(range(20)), np.arange(v, dtype=np.uint64), np.arange(v, dtype=np.uint64), item, term, np.ones(240, int))
    norm = np.array([np.sqrt((x.astype(float) ** 2).sum()) for x in impacts])
    order = np.argsort(-norm)
    batch = pa.record_batch(
        {
            "doc_id": pa.array(order),
            "norm": norm[order],
            "terms": pa.array([vectors[i].astype(np.int32) for i in order]),
            "impacts": pa.array([impacts[i] for i in order]),
        }
    )
    scored = []
    real = L._score_again
    monkeypatch.setattr(L, "_score_again", lambda *a: (scored.append(len(a[2])), real(*a)))
    best = L._Best(20, 10, np.zeros(20, int))
    q_norm = np.full(20, np.sqrt(12))
    for start in range(0, n, 250):
        L._search_bucket(q, q_norm, best, batch.slice(start, 250))
    dense = np.zeros((n, v), int)
    for d in range(n):
        dense[d, vectors[d]] = impacts[d]
    for i in range(20):
        scores = dense[:, term[item == i]].sum(1)
        want = sorted(zip(-scores, range(n), strict=True))[:10]
        assert [(-s, d) for s, d in want] == list(zip(best.score[i], best.id[i], strict=True))
    assert sum(scored) < n * 20 / 4  # of uncorrelated vectors, the hardest case
