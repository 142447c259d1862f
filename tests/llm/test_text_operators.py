"""Operators on single texts against the libraries, patterns and plain loops."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from hallkeeper.llm import bpe, html_text, licenses, pii, quality, token_counts
from hallkeeper.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (469) 555-1234", "256.1.1.1", "0255.1.1.01", "é🙂 ", "\n",
          "don't'll!!'s ", "<|endoftext|>", "▁▁a  b", "1 2 3 4 5 6 7 8 9 0 1 2 3", " the of ", "#*x|", "%@x.y@z.w", ".", "-"]


def texts(seed: int, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    odd = [None, "", " ", "\n\n", "x" * 3000, "@" * 60, "1" * 900, "the of the of the of " * 40, "ab" * 40_000]
    return odd + ["".join(rnd.choice(PIECES) for _ in range(rnd.choice([1, 4, 40]))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [bpe.LEAF, 100])
def test_bpe_equals_the_library(documents, leaf):
    from tokenizers import Tokenizer

    path, sample = tokenizer("word_bpe_49k.json"), texts(1)
    library = Tokenizer.from_file(path)
    rows = bpe.encode_texts(documents(sample, repeat=3), path, leaf).collect()
    assert len(rows) == len(sample) + 3
    for r in rows:
        ids = library.encode(sample[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_token_counts_equal_the_library(documents):
    import sentencepiece

    path, sample = tokenizer("piece_bpe_32k.model"), texts(2)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.token_counts(documents(sample, repeat=3), path).collect()
    assert len(rows) == len(sample) + 3
    for r in rows:
        text = sample[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(text)), len(text.encode()))


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def _base_spans(text: str) -> list[str]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and _luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if fits():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_stay(documents):
    sample = texts(3)
    for r in pii.find_pii(documents(sample, repeat=2)).collect():
        expected = _base_spans(sample[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(r.spans.split(","))


def test_redaction_leaves_no_base_span(documents):
    sample = ["mail bob@example.com or +1 (469) 555-1234 now", None, "nothing here"]
    rows = {r.doc_id: r.text for r in pii.redact(documents(sample)).collect()}
    assert rows == {0: "mail [EMAIL] or [PHONE] now", 1: None, 2: "nothing here"}


def test_boosted_trees_learn_and_calibrate():
    base = dict.fromkeys(pii.FEATURES, 0)
    good = base | {"check": 1, "fit_n": 900, "fit_pos": 900, "held_n": 100, "held_pos": 100}
    poor = base | {"fit_n": 900, "fit_pos": 9, "held_n": 100, "held_pos": 1}
    model = pii.fit_trees([good, poor])
    score = lambda row: model.start + sum(pii._value(t, row) for t in model.trees)
    assert score(good) >= model.threshold > score(poor)


def test_word_statistics(documents):
    sample = texts(4) + ["one two three\none two three\n\nfour #* five"]
    for r in quality.quality(documents(sample, repeat=2)).collect():
        text = sample[r.doc_id] or ""
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_clean_documents_stay(documents):
    rnd = random.Random(5)
    clean = [" ".join("abcdefg"[: rnd.randint(2, 7)] + str(rnd.randint(0, 999)) for _ in range(120)) + "." for _ in range(300)]
    junk = ["".join(w + "*** " for w in t.split()) for t in clean[:12]]
    rows = {r.doc_id: r.kept for r in quality.quality(documents(clean + junk)).collect()}
    assert all(rows[i] for i in range(300))
    assert not any(rows[300 + i] for i in range(12))


def test_junk_of_two_fifths_goes(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    rows = []
    for i in range(400):
        junk = i % 5 < 2
        words = [("#$%&" + word() if junk and k % 2 else word()) + ("," if k % 9 == 0 else "") for k in range(120)]
        rows.append((i, " ".join(words).capitalize() + ".", "en", "src0"))
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in found.collect() if not r.kept} == {i for i in range(400) if i % 5 < 2}


def test_groups_without_source_have_keys_of_their_own(spark):
    rows = [("a b c", lang, source) for lang in ("en", None) for source in ("src0", None)]
    found = quality.statistics(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert len({r.group for r in found}) == 4 and not {r.group for r in found} & {r.language for r in found}


def test_licences(documents):
    mit = licenses.KNOWN[0][1]
    sample = [mit.upper() + "\n", "Copyright (c) 2020 Somebody\n\n" + mit, "some text\nReleased under the MIT licence.\n", None, ""]
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(sample, repeat=1)).collect()}
    assert [rows[i].license_id for i in range(5)] == ["MIT", "MIT", None, None, None]
    assert (rows[2].line_licenses, rows[2].n_license_lines) == ("MIT", 1)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About
us</a></li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies.</div><article><h1>The title</h1>
<p>First paragraph of the article,   with enough words &amp; a comma.<p>Second &eacute;t&eacute; paragraph, long enough to be
read as text.</p></article><aside class=sidebar><p>Related: another story you may like, read it now.</p></aside>
<section id="comments"><p>Nice article, thank you very much for it!</p></section><form><input name=q>Subscribe now</form>
<footer>&copy; someone</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_wrapped_licences_and_notices(documents):
    body = licenses._ISC_BODY.replace("that the above copyright", "that the above\ncopyright")
    sample = ["Copyright (c) 2020 A\n\n" + body, "Copyright Jo Doe\n" + body, "Licensed under CC BY-NC 4.0."]
    found = {r.doc_id: r.license_id for r in licenses.scan_licenses(documents(sample)).collect()}
    assert found == {0: "ISC", 1: "ISC", 2: "CC-BY-NC-4.0"}


def test_main_text(spark):
    pages = spark.createDataFrame([(0, "u", PAGE), (1, None, None), (2, "u", ""), (0, "u", PAGE), (3, "u", "<p>open <b")], "page_id long, url string, html string")
    rows = html_text.extract_text(pages).collect()
    expected = "The title\n\nFirst paragraph of the article, with enough words & a comma.\n\nSecond été paragraph, long enough to be read as text."
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows if r.page_id != 3) == [
        (0, expected, len(expected)), (0, expected, len(expected)), (1, "", 0), (2, "", 0),
    ]


def test_min_cut_is_least():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 8)
        content, other = ([rnd.random() * 3 for _ in range(n)] for _ in range(2))
        edges = [(a, b, rnd.random()) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]

        def cost(labels, content=content, other=other, edges=edges):
            own = sum(c if x else o for x, c, o in zip(labels, content, other, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.min_cut(content, other, edges)) == pytest.approx(least)


def test_empty_tables(documents, spark):
    empty = documents([])
    assert bpe.encode_texts(empty, tokenizer("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(empty, tokenizer("piece_bpe_32k.model")).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pii_variants_are_added_and_clean_numbers_left(documents):
    rnd = random.Random(7)
    number = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    base = [f"write to user{i}@mail{i % 7}.example.com or +1 ({number(3)}) 555-{number(4)} from {i % 250}.1.2.3 now" for i in range(400)]
    noise = [f"order {number(10)} of 2024-01-15 10:30, total 0.{number(9)} key ab{number(12)}cd at {number(7)}" for _ in range(400)]
    variants = ["see bob (at) example.com today", "see ann[AT]mail[dot]example[dot]org today", "ring 0049 30 1234567 now", "ring 0049301234567 now", "item 0054994038693466 now", "ring (030) 555-1234 now",
                "go to 10[.]1[.]2[.]3 now"]
    rows = {r.doc_id: r for r in pii.find_pii(documents(base + noise + variants)).collect()}
    values = lambda i, text: [text[int(a) : int(b)] for a, b in (s.split(":")[1:] for s in rows[i].spans.split(",") if s)]
    for i, text in enumerate(base):
        assert rows[i].spans == ",".join(_base_spans(text))
    assert [i for i in range(400, 800) if rows[i].spans] == []
    assert [values(800 + i, t) for i, t in enumerate(variants)] == [
        ["bob (at) example.com"], ["ann[AT]mail[dot]example[dot]org"], ["0049 30 1234567"], ["0049301234567"], [], ["(030) 555-1234"], ["10[.]1[.]2[.]3"]]


def test_pii_of_a_text_with_100000_spans(documents):
    long = " ".join(f"é a{i}@b.cd" for i in range(100_000))
    (r,) = pii.find_pii(documents([long])).collect()
    expected = _base_spans(long)
    assert r.n_email == len(expected) == 100_000
    assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
    (r,) = pii.redact(documents([long])).collect()
    assert r.text == " ".join(["é [EMAIL]"] * 100_000)


def test_redaction_merges_overlaps_and_keeps_rows(documents):
    sample = texts(5)
    rows = [(r.doc_id, r.text) for r in pii.redact(documents(sample, repeat=2)).collect()]
    spans = {r.doc_id: r.spans for r in pii.find_pii(documents(sample, repeat=2)).collect()}
    expected = []
    for i, text in list(enumerate(sample)) + list(enumerate(sample[:2])):
        if text is not None:
            at, out = 0, ""
            for start, end, kind in sorted((int(a), int(b), pii.KINDS.index(k)) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)):
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]" if start >= at else ""
                at = max(at, end)
            text = out + text[at:]
        expected.append((i, text))
    assert sorted(rows, key=str) == sorted(expected, key=str)
