"""Language-model scores against plain loops."""

from __future__ import annotations

import collections
import functools
import itertools
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from hallkeeper.llm import lattice as L
from hallkeeper.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", text)


def plain_scores(rows):
    """rows: (doc_id, text)."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = collections.Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            counts.update([*tokens(text), None])
    n, v, ends = counts.total(), len(counts), counts.get(None, 0)
    library = L._library(PATH)
    used = collections.Counter()
    for word, c in counts.items():
        if word is not None:
            for i in library.encode(word):
                used[i] += c
    pieces = {library.id_to_piece(i): used[i] + 0.1 for i in range(3, library.vocab_size())}
    total = sum(used.values()) + ends + 0.1 * (len(pieces) + 1)

    @functools.lru_cache(None)
    def word_score(word):
        word = "▁" + word
        ways = [1.0] + [0.0] * len(word)
        for j, k in itertools.product(range(1, len(word) + 1), range(1, 17)):
            if k <= j:
                part = word[j - k : j]
                p = pieces[part] / total if part in pieces else 0
                if k == 1 and part not in pieces:
                    p = math.prod(pieces[f"<0x{b:02X}>"] / total for b in part.encode())
                ways[j] += ways[j - k] * p
        return math.log10(ways[-1])

    for (i, text), out in zip(rows, held, strict=True):
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, None])
        score = sum(map(word_score, words)) + math.log10((ends + 0.1) / total)
        yield i, out, len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, base, score


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(L.lm_scores(docs, PATH).collect(), key=str)
    want = sorted(plain_scores(rows), key=str)
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4])
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("head", [100_000, 40])
def test_equals_plain_loops(spark, documents, monkeypatch, head):
    """With 40 words broadcast the others go through the join."""
    monkeypatch.setattr(L, "HEAD", head)
    deal = random.Random(8)
    pool = ["".join(deal.choices(["an", "er", "é", "日本", "the", "x", "▁", "!", "🙂", "𝔸", "ZU"], k=deal.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(deal.choices(pool, k=deal.randint(0, 60))) for _ in range(90)]
    texts += [None, "", " \t\n", "An AN an\x0ban", "  　x", " ".join(deal.choices(pool, k=20_000))]
    docs = documents(texts, repeat=12)
    nameless = docs.selectExpr("cast(null as long) doc_id", "text").limit(4)
    docs = docs.select("doc_id", "text").unionByName(nameless)
    check(docs.selectExpr("*", "1 row", "'k' key", "2.0 score", "true held_out", "'w' word"))


def test_no_texts_and_no_training_texts(spark, documents):
    assert L.lm_scores(documents([]), PATH).collect() == []
    check(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"))


def test_long_words_and_all_segmentations():
    library = L._library(PATH)
    deal = random.Random(2)
    pieces = L.weigh_pieces(PATH, {i: deal.randint(0, 1000) for i in range(3, library.vocab_size())}, 50)
    words = ["ing", "théâ", "\U0010ffff", "a" * 63, "a" * 64, "another" * 40, "x"]
    together = L.score_words(pieces, pa.array(words))
    for word, value in zip(words, together, strict=True):
        assert value == pytest.approx(L._score_one(pieces, "▁" + word), rel=1e-12)
    for word, value in list(zip(words, together, strict=True))[:2]:
        marked, total = "▁" + word, 0.0
        for cuts in itertools.product([False, True], repeat=len(marked) - 1):
            at = [0, *[i for i, c in enumerate(cuts, 1) if c], len(marked)]
            parts = [marked[a:b] for a, b in itertools.pairwise(at)]
            if all(p in pieces.by_text for p in parts):
                total += math.exp(sum(pieces.by_text[p] for p in parts))
        assert value == pytest.approx(math.log(total), rel=1e-9)
    assert sum(map(math.exp, pieces.by_text.values())) + sum(map(math.exp, pieces.byte)) + math.exp(pieces.end) == pytest.approx(1)
