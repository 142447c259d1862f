"""Operators across texts, and the pipeline, against plain loops."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from hallkeeper.llm import compact_windows, decontamination, jaccard_join, oracles, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_texts(seed: int) -> list[str | None]:
    """Families of texts of all small sizes with a few words changed, copies, and texts that share one passage."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 400))
    out: list[str | None] = [None, "", " \n", "one", "One", "one two"]
    passage = [word() for _ in range(60)]
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 26, 33, 50, 90, 200]:
        base = [word() for _ in range(size)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + size // 60)):
                copy[rnd.choice([0, -1, rnd.randrange(size)])] = word()
            out.append(" ".join(copy + [word() for _ in range(rnd.randint(0, 1))]))
    out += [" ".join(passage + [word() for _ in range(100)]) for _ in range(40)]
    return out + out[6:12]


def components(sets: list[frozenset]) -> list[int]:
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_components_equal_all_pairs(documents):
    texts = near_texts(1)
    sets = [shingles(t) for t in texts]
    expected = components(sets)
    rows = jaccard_join.near_duplicate_groups(documents(texts, repeat=9)).collect()
    assert len(rows) == len(texts) + 9
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(s), expected[i]) for i, s in enumerate(sets)}


def test_components_with_small_cells_and_a_common_line(documents, monkeypatch):
    """Groups dealt to many cells, a line that unlike documents share, one leader only: the same components."""
    monkeypatch.setattr(jaccard_join, "CELL", 7)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rnd = random.Random(11)
    line = " ".join(f"common{i}" for i in range(12))
    unlike = [line + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(2, 30))) for _ in range(150)]
    texts = near_texts(3) + unlike
    expected = components([shingles(t) for t in texts])
    rows = jaccard_join.near_duplicate_groups(documents(texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(expected))


def test_signatures_of_the_same_members_are_told_by_one(spark):
    """Two signatures with equal members give one group that counts for both; other members, flags or counts don't."""
    rows = [(s, c, c, False, p) for s, c, p in [(1, 5, True), (1, 6, True), (2, 6, True), (2, 5, True), (3, 5, True), (3, 7, True),
            (4, 5, True), (4, 6, False), (5, 5, True), (5, 5, True), (5, 7, True), (6, 5, True), (6, 6, True), (6, 6, True)]]
    rows += [(s, c, 9, False, True) for s in (7, 8) for c in (9, 10)]  # connected
    members = spark.createDataFrame(rows, "sig long, class_id long, root long, deleted boolean, probes boolean")
    apart = jaccard_join._apart(members, None).collect()
    assert {(r.sig, r.alike) for r in apart} == {(1, 2), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert sorted(r[0] for r in apart) == [1, 1, 3, 3, 4, 4, 5, 5, 5, 6, 6, 6]


def test_classes_of_the_same_short_id_are_all_members(spark, documents):
    """Signatures carry 32 bits of a class id; each class these bits may mean is given as a member."""
    texts = documents([t for t in near_texts(4) if t]).select("text")
    sizes = texts.mapInArrow(jaccard_join._whole_sets, "class_id long, shingles binary").select("class_id").distinct()
    twins = sizes.union(sizes.selectExpr("class_id ^ (1L << 40)"))
    alone = jaccard_join._members(texts, sizes, 1000).select("sig", "class_id").distinct()
    both = jaccard_join._members(texts, twins, 1000).select("sig", "class_id").distinct()
    assert alone.count() > 100 and both.count() == 2 * alone.count()
    packed = texts.mapInArrow(jaccard_join._pack(3), jaccard_join._PACKED).collect()
    assert all(len(r.ids) == 4 * (max(r.doc[::2][i] + 256 * r.doc[1::2][i] for i in range(len(r.doc) // 2)) + 1) for r in packed)


def test_close_members_leave_a_cell_as_a_forest():
    """Members that are all close to each other give as many edges as connect them, not a square of pairs."""
    import numpy as np
    import pyarrow as pa

    n = 60
    parity = [np.zeros(4, np.uint64).tobytes()] * n + [np.full(4, 2**64 - 1, np.uint64).tobytes()]
    ids = np.arange(n + 1)
    rows = pa.record_batch(
        {"sig": np.ones(n + 1, np.int64), "class_id": ids, "root": ids, "deleted": np.zeros(n + 1, bool), "n_shingles": np.full(n + 1, 200),
         "parity": pa.array(parity, pa.binary()), "i": np.zeros(n + 1, np.int32), "j": np.zeros(n + 1, np.int32),
         "asks": np.ones(n + 1, bool), "met": np.ones(n + 1, bool)}
    )
    edges = [(r["a"], r["b"]) for part in (0, 7) for b in jaccard_join._close_in_cells(iter([rows.slice(0, part), rows.slice(part)])) for r in b.to_pylist()]
    assert len(edges) == 2 * (n - 1)
    root = list(range(n + 1))
    for a, b in edges:
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root[:n])) == 1 and root[n] == n


def test_components_with_neighbourhoods_in_many_cells(documents, monkeypatch):
    """Texts close to their neighbours without a link, and chains of links, whose whole sets lie in many cells."""
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 300)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rnd = random.Random(12)
    texts = []
    for step in (9, 12, 13, 14, 15, 16, 18, 22):
        words = [f"{step}w{rnd.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(words[a : a + 100]) for a in range(0, 500, step)]
    rnd.shuffle(texts)
    expected = components([shingles(t) for t in texts])
    rows = jaccard_join.near_duplicate_groups(documents(texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(expected))
    assert 100 < len(set(expected)) < len(texts)


def test_one_document_of_each_group_stays(documents):
    texts = near_texts(2)
    expected = components([shingles(t) for t in texts])
    kept = jaccard_join.one_of_each_group(documents(texts, repeat=9))
    ids = [r.doc_id for r in kept.collect()]
    # Rows without words are in no group, so the repeated ones (the first nine hold three) stay as well.
    assert sorted(ids) == sorted([i for i in range(len(texts)) if expected[i] == i] + [0, 1, 2])
    assert kept.columns == documents(texts).columns


def test_large_groups_pass_through(documents, monkeypatch):
    """The grouping of signatures gives the same members when it may hold next to nothing."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 4000
    sig = rng.integers(0, 40, n).astype(np.uint64)
    batch = pa.record_batch(
        {
            "bucket": [1] * 8,
            "low": pa.array([p.astype(np.uint32).tobytes() for p in np.split(sig, 8)], pa.binary()),
            "high": pa.array([np.zeros(n // 8, np.uint16).tobytes()] * 8, pa.binary()),
            "flags": pa.array([np.zeros(n // 8, np.uint8).tobytes()] * 8, pa.binary()),
            "doc": pa.array([np.arange(n // 8).astype(np.uint16).tobytes()] * 8, pa.binary()),
            "ids": pa.array([(np.arange(n // 8) + i * n).tobytes() for i in range(8)], pa.binary()),
            "slack": pa.array([np.zeros(n // 8, np.int32).tobytes()] * 8, pa.binary()),
        }
    )

    def members():
        return sorted((r["sig"], r["class_id"]) for b in jaccard_join._groups(iter([batch])) for r in b.to_pylist())

    plain = members()
    monkeypatch.setattr(jaccard_join, "HELD_SIGNATURES", 300)
    monkeypatch.setattr(jaccard_join, "HOT_GROUP", 10)
    assert members() == plain


def test_repeated_bytes_equal_all_windows(documents):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(2000)) for _ in range(4)]
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "y" * 1200, base[0], base[0], base[1][:398]]
    for _ in range(30):
        cuts = [(rnd.choice(base), rnd.randrange(0, 1500), rnd.choice([100, 399, 400, 700])) for _ in range(rnd.choice([1, 3]))]
        texts.append("|".join(b[a : a + n] for b, a, n in cuts))
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    for r in substring_dedup.without_repeats(documents(texts)).collect():
        raw = raws[r.doc_id]
        gone = {j for i in range(len(raw) - 399) if seen[raw[i : i + 400]] > 1 for j in range(i, i + 400)}
        assert bytes(r.kept) == bytes(b for i, b in enumerate(raw) if i not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(gone), sum(i - 1 not in gone for i in gone))


def test_repeated_passages_are_found(documents):
    rnd = random.Random(5)
    word = lambda: "w" + str(rnd.randint(0, 10**6))
    passages = [[word() for _ in range(70)] for _ in range(3)]
    texts, places = [None, "", "a b"], {}
    for i in range(30):
        before, after = [word() for _ in range(rnd.randint(0, 80))], [word() for _ in range(80)]
        near = list(passages[i % 3])
        if i % 5 == 4:
            near[35] = word()
        places[len(texts)] = (len(before), len(before) + 70)
        texts.append(" ".join(before + near + after))
    clean = [" ".join(word() for _ in range(150)) for _ in range(10)]
    rows = {r.doc_id: r for r in compact_windows.repeated_passages(documents(texts + clean)).collect()}
    assert len(rows) == len(texts) + len(clean)
    for i, (a, b) in places.items():
        assert rows[i].passages == f"{a}:{b}"
    assert all(rows[i].n_passages == 0 for i in (0, 1, 2, *range(len(texts), len(texts) + 10)))


def test_passages_of_frequent_lines_are_found(spark):
    rnd = random.Random(1)
    word = lambda: "w" + str(rnd.randrange(10**7))
    lines = [[word() for _ in range(12)] for _ in range(40)]
    texts = [[rnd.choice(lines) for _ in range(20)] for _ in range(100)]
    planted = {frozenset((i, i + 1)) for i in range(0, 60, 2)}
    for i, j in map(sorted, planted):
        passage = sum((rnd.choice(lines) for _ in range(5)), [])
        for text in (texts[i], texts[j]):
            text.insert(rnd.randrange(21), [word(), *passage, word()])
    rows = [(i, " ".join(sum(t, []))) for i, t in enumerate(texts)]
    pairs = compact_windows.passage_pairs(spark.createDataFrame(rows, "text_key long, text string"))
    assert planted <= {frozenset((r.a, r.b)) for r in pairs.collect()}


def test_partners_besides_the_leader_are_found(spark):
    rnd = random.Random(2)
    words = lambda n: ["w" + str(rnd.randrange(10**7)) for _ in range(n)]
    frequent = words(90)
    # The text of the least key leads the passage's groups; each pair of others shares some words before it, too.
    texts, extra = [words(40) + frequent + words(40) for _ in range(30)], {}
    for i in range(30, 60, 2):
        shared = words(rnd.choice([4, 8, 12]))
        for j in (i, i + 1):
            texts.append(words(40) + shared + frequent + words(40))
            extra[j] = (40, 40 + len(shared) + 90)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {}
    for r in compact_windows.passage_pairs(spark.createDataFrame(rows, "text_key long, text string")).collect():
        for key, start, end in ((r.a, r.start, r.end), (r.b, r.other_start, r.other_end)):
            found.setdefault(key, set()).update(range(start, end))
    for i in range(60):
        start, end = extra.get(i, (40, 130))
        assert found[i] == set(range(start, end)), i


def test_only_windows_among_shared_shingles_are_kept(spark):
    """Texts without a passage in common, but for frequent lines, are dropped before windows are made."""
    rnd = random.Random(3)
    words = lambda n: ["w" + str(rnd.randrange(10**7)) for _ in range(n)]
    line, passage = words(12), words(60)
    texts = [words(100) + line + words(100) for _ in range(50)] + [words(80) + passage + words(80) for _ in range(2)]
    rows = pa.table(
        {"bucket": [0] * 52, "text_key": pa.array(range(52), pa.int64()), "text": [" ".join(t) for t in texts]}
    )
    codes = compact_windows._codes(0)((pa.scalar(0),), rows)
    found = compact_windows._find_windows(0)((pa.scalar(0),), rows, compact_windows._shared_codes(codes))
    assert found["text_key"].to_pylist() == [50, 51]
    assert all(len(w) <= 6 * 20 for w in found["windows"].to_pylist())


def test_alignment_of_repeated_shingles():
    rnd = random.Random(4)
    run, tail = [1, 2] * 60, [rnd.randrange(10, 10**9) for _ in range(60)]
    x, y = np.array(run + tail, np.uint64), np.array([7] * 30 + run[:80] + tail, np.uint64)
    passages = compact_windows.align(x, y, -10)
    assert max(e - s for s, e, *_ in passages) == 180
    assert compact_windows.align(x, np.array([5] * 200, np.uint64), 0) == []


def test_benchmark_passages_are_found(spark, documents):
    rnd = random.Random(6)
    word = lambda: "w" + str(rnd.randint(0, 10**5))
    items = [[word() for _ in range(n)] for n in (3, 8, 20, 40, 90)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, " ")], "item_id long, text string")
    texts, expected = [None, "", "w1 w2"], set()
    for i, item in enumerate(items):
        for changed in (0, 1):
            words = [w.upper() + "," for w in item]
            if changed and len(words) > 60:
                words[30] = word()
            expected.add((len(texts), i))
            texts.append(" ".join([word() for _ in range(50)] + words + [word() for _ in range(50)]))
    texts += [" ".join(word() for _ in range(120)) for _ in range(10)]
    texts.append(" ".join(items[4][:45]))  # half an item is not the item
    found = decontamination.contaminated(documents(texts, repeat=5), table)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    left = decontamination.without_benchmark(documents(texts), table)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.contaminated(documents([]), table).count() == 0
    assert decontamination.contaminated(documents(texts), table.limit(0)).count() == 0


def test_empty_tables(documents):
    empty = documents([])
    assert jaccard_join.near_duplicate_groups(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    assert compact_windows.repeated_passages(empty).count() == 0


def test_licence_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = con.execute(oracles.oracle_sql()["op1_license_scan"]).fetchall()
    found = queries.op1_license_scan(spark, SMALL).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline
    from hallkeeper.llm import bpe, pii, quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = [r.doc_id for r in quality.quality(docs).collect() if r.kept]
    groups = components([shingles(texts[d]) for d in sorted(good)])
    first = {sorted(good)[g] for g in groups}
    bad = {r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()}
    clean = docs.filter(docs.doc_id.isin(sorted(first - bad)))
    models_of = docs.filter(docs.doc_id.isin(sorted(first - bad)))
    redacted = {r.doc_id: r.text for r in pii.redact(clean).collect()}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(rows) == first - bad == set(redacted)
    coded = {r.doc_id: bytes(r.ids) for r in bpe.encode_texts(pii.redact(models_of), queries.tokenizer("word_bpe_49k.json")).collect()}
    assert {d: bytes(r.ids) for d, r in rows.items()} == coded
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows.values())
    assert hashlib.sha256(b"".join(coded[d] for d in sorted(coded))).hexdigest()
