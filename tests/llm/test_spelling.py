"""Spelling variants against plain loops."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import numpy as np

from hallkeeper.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(rows):
    counts = plain_counts(rows)
    near = {w: set() for w in counts}
    cuts = collections.defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for words in cuts.values():
        for a, b in itertools.permutations(words, 2):
            near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_equals_plain_loops(spark, documents):
    deal = random.Random(5)
    syllables = ["an", "er", "é", "ñó", "sch", "ou", "ing", "a", "a", "t"]
    words = ["".join(deal.choices(syllables, k=deal.randint(2, 5))) for _ in range(1500)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "aabab", "QUEST", "Quest", "quests", "a×b÷cd"]
    texts = [" ".join(deal.choices(words, k=deal.randint(0, 120))) for _ in range(250)]
    texts += [None, "", "-- 12 ,", " ".join(deal.choices(words, k=20_000)), "x" * 5000 + " " + "x" * 5001]
    texts += [texts[-1]] * 3
    docs = documents(texts, repeat=20)
    nameless = docs.selectExpr("cast(null as long) doc_id", "text").limit(30)
    docs = docs.select("doc_id", "text").unionByName(nameless).selectExpr("*", "'q' word", "1 n", "2 block", "'z' form")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    result = S.spelling_variants(docs)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert found(result) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_blocks_larger_than_a_product(spark, documents):
    letters = "abcdefghijklmnopqrst"
    words = ["xy" + "".join(t) for t in itertools.product(letters[:16], repeat=3)]
    assert len(words) > S.HELD  # all in one block at first
    words += [w + "q" for w in words[::7]] + ["xyq" + w[2:] for w in words[::11]]
    texts = [" ".join(words[k::5]) for k in range(5)] * 3 + [" ".join(words[::13])]
    docs = documents(texts)
    assert found(S.spelling_variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_tables(documents):
    for texts in ([], [None, ""], ["too few words here"]):
        assert S.spelling_variants(documents(texts)).collect() == []


def test_checksums_of_ranges():
    deal = np.random.default_rng(2)
    data = deal.integers(0, 256, 5000).astype(np.uint8)
    start = deal.integers(0, 4800, 300)
    end = start + deal.integers(0, 150, 300)
    before = deal.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert S.crc32_of(data, start, end, before).tolist() == want


def test_first_difference_of_wide_words():
    assert S._one_edit("abc", "abd") == 2
    assert S._one_edit("abc", "abbc") == 2
    assert S._one_edit("abc", "abc") == -1
    assert S._one_edit("abc", "badc") == -1
    assert S._one_edit("abc", "abcd") == 3
