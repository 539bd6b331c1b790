"""Multi-index near-duplicates, dynamic itemset counting and bisector
tournaments against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from triageflow.llm import bisector, collocations, multiindex

VECTORS = "vec_id bigint, embedding array<float>, label int, grp string, key string, cell int, cluster int, distance bigint, n string"


def vectors(spark, rows):
    """Extra columns carry names that the operators use themselves."""
    return spark.createDataFrame([(i, e, lab, "g", "k", 1, 2, 3, "n") for i, e, lab in rows], VECTORS)


# ------------------------------------------------------------- multi-index
def brute_links(rows, threshold=0.98):
    n, own = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    def usable(e, lab):
        return lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    unit = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if usable(e, lab) else None for _, e, lab in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                own[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, k, least.get(root(i)), d == least.get(root(i))) for i, ((d, _, _), k) in enumerate(zip(rows, n))), key=str)


def near_rows(dims=12):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = rng.standard_normal(dims)
        for k in range(25):  # chains and stars: noise of several widths
            rows.append((1000 - len(rows), (base + rng.standard_normal(dims) * rng.choice([0.02, 0.08, 0.15])).tolist(), g % 3))
    same = rng.standard_normal(dims).tolist()
    rows += [(2000 + k, same, 1) for k in range(40)] + [(2000, same, 1), (3000, same, 2), (None, same, 1), (3001, same, None)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * dims, 1), (4003, [None, *same[1:]], 1), (4004, [float("nan"), *same[1:]], 1),
             (4005, [float("inf"), *same[1:]], 1), (4006, same[:5], 1), (4007, [x * 1e-30 for x in same], 1), (4008, [x * 1e30 for x in same], 1), (None, None, None)]
    return rows


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "INDEX_ROWS", 8)  # crowded cells are dealt over blocks
    monkeypatch.setattr(multiindex, "QUERY_ROWS", 16)
    rows = near_rows()
    got = multiindex.near_duplicates(spark, vectors(spark, rows), recall=1.0).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_recall_at_the_set_target(spark):
    """Links found on a whole table against all pairs."""
    rng = np.random.default_rng(6)
    base = np.repeat(rng.standard_normal((150, 64)), 16, axis=0)
    near = base + rng.standard_normal(base.shape) * rng.choice([0.02, 0.1, 0.14, 0.16], (len(base), 1))
    df = vectors(spark, [(i, v.tolist(), i // 16 % 3) for i, v in enumerate(near)])
    got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(spark, df).collect()}
    p = df.toPandas()
    x = np.array(p.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    all_links = found = 0
    for lab in p.label.unique():
        i = np.nonzero(p.label.values == lab)[0]
        near = (x[i] @ x[i].T >= 0.98).sum(1) - 1
        mine = np.array([got[v] for v in p.vec_id.values[i]])
        assert (mine <= near).all()
        all_links, found = all_links + near.sum(), found + mine.sum()
    assert all_links > 10_000 and found >= 0.99 * all_links


def test_traversal_yields_cells_by_their_sums():
    rng = random.Random(3)
    a, b = (sorted((rng.random(), k) for k in range(9)) for _ in range(2))
    got = list(multiindex.multi_sequence(a, b, 1.1))
    sums = dict(((i, j), x + y) for x, i in a for y, j in b)
    assert got == sorted((p for p in sums if sums[p] <= 1.1), key=sums.get)


def test_bound_never_passes_the_distance_to_a_region():
    rng = np.random.default_rng(4)
    book = multiindex.Codebook(rng.standard_normal((7, 5)))
    q, x = rng.standard_normal((50, 5)), rng.standard_normal((400, 5))
    near, low = book.bounds(q)
    cell = book.bounds(x)[0]
    far = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (low[:, cell] <= far + 1e-9).all() and (low[np.arange(50), near] == 0).all()


def test_near_duplicates_of_nothing(spark):
    empty = vectors(spark, [])
    assert multiindex.near_duplicates(spark, empty).collect() == []
    got = multiindex.near_duplicates(spark, vectors(spark, [(1, None, 2), (2, [1.0], None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


# -------------------------------------------------------------- collocations
def brute_collocations(rows, threshold, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\0")
        for piece in text.split("\0"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    covered = {}
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                key = (lang, ws[i:i + k])
                covered[key] = max(a, covered.get(key, 0))
    out = []
    for (lang, ws), a in cand.items():
        if 100 * covered.get((lang, ws), 0) >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, -score, -a, " ".join(ws).encode(), l, r))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(rows)


def phrase_rows(seed=6):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "hall", "of", "the", "été", "a", "b", "don't", "x-1"]
    rows = [(rng.choice(["en", "en", "de", None, "a b\tc"]), " ".join(rng.choice(vocabulary[:rng.randint(3, 11)]) + rng.choice(["", "", "", ",", ".", "\t", "  ", "\n", "\r"])
             for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return rows + [(None, None), ("en", ""), ("en", " ;; \t"), ("de", "new york city hall " * 60), ("de", "new york city hall " * 60)]


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_phrases_equal_brute_force(spark, shards):
    rows = phrase_rows()
    df = spark.createDataFrame([(lang, text, "k", 1, "p", 2) for lang, text in rows], "lang string, text string, key string, n int, phrase string, shard int")
    got = collocations.collocations(spark, df, threshold=12, top=25, shards=shards)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, 25)


def test_counts_stay_exact_in_a_crowded_slot_table(spark):
    """With 4 slots nearly every hash clashes."""
    rows = phrase_rows(7)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(spark, df, threshold=12, top=1000, shards=3, slots=4)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, 1000)


@pytest.mark.parametrize("seed", [2, 20])
def test_a_phrase_counts_whole_if_a_part_of_it_shares_slots_of_earlier_steps(spark, seed):
    """A phrase of three words found late, in slots set early, hid half of the longer one."""
    rng = random.Random(seed)
    slots = rng.choice([8, 16, 32, 64])
    rows = [("en", " ".join(rng.choice("abcdefg"[:rng.randint(2, 7)]) for _ in range(rng.randint(0, 40)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    found, _ = collocations.counts(spark, df, threshold=12, shards=2, slots=slots)
    want = Counter(" ".join(text.split()[i:i + k]) + "\ten" for _, text in rows for k in range(1, 5) for i in range(len(text.split()) - k + 1))
    assert dict(map(tuple, found.collect())) == {k: n for k, n in want.items() if n >= 12}


def block_counts(texts, reached=0):
    """Phrases of a block in a step in which all (0) or none are active but words."""
    block = collocations.Block()
    for lang, text in texts:
        block.add(lang, text.encode())
    found = block.counted(0, 1, np.full(collocations.SLOTS, reached, np.uint8))
    return {k: n for k, n in zip(found["key"].to_pylist(), found["n"].to_pylist())}


@pytest.mark.parametrize("most", [1, 7, 50, 1 << 20])
def test_long_texts_are_cut_without_losing_phrases(monkeypatch, most):
    text = "".join(random.Random(8).choice(["a", "b", "cc", " ", " ", "\t", ".", "an-uncommonly-long-word "]) for _ in range(3000))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", most)
    want = Counter()
    for piece in text.split("."):
        ws = piece.split()
        want.update(" ".join(ws[i:i + k]) + "\ten" for k in range(1, 5) for i in range(len(ws) - k + 1))
    assert block_counts([("en", text)]) == want


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_scans_of_numbers_count_what_scans_of_words_do(monkeypatch, most):
    text = "".join(random.Random(9).choice(["a", "b", "cc", " ", " ", "\t", ".", "an-uncommonly-long-word "]) for _ in range(3000))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", most)
    block = collocations.Block()
    for lang in ("en", "de"):
        block.add(lang, text.encode())
    found = collocations.active(np.frombuffer(block.numbers(), "<u4"), 0, 1, np.zeros(collocations.SLOTS, np.uint8))
    by_length = lambda pairs: sorted((k, n) for k, n in pairs)
    want = block_counts([("en", text), ("de", text)])
    assert by_length(zip(found["tag"].to_pylist(), found["n"].to_pylist())) == by_length((len(k.split("\t")[0].split(" ")), n) for k, n in want.items())


def test_phrases_of_one_hash_are_counted_by_their_words(monkeypatch):
    """All words have the same number: all phrases of a length stand by one hash."""
    monkeypatch.setattr(collocations, "numbers_of", lambda h: np.ones(len(h), "<u4"))
    block = collocations.Block()
    block.add("en", b"one two one two, two three")
    found = block.counted(0, 1, np.zeros(collocations.SLOTS, np.uint8), own=True)
    assert dict(zip(found["key"].to_pylist(), found["n"].to_pylist())) == {
        "one\ten": 2, "two\ten": 3, "three\ten": 1, "one two\ten": 2, "two one\ten": 1, "two three\ten": 1, "one two one\ten": 1,
        "two one two\ten": 1, "one two one two\ten": 1, "\ten": 6}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "_mixed", lambda h: h & np.uint64(3))
    text = "one two three four five six seven one two and-longer-than-sixteen-bytes and-longer-than-sixteen-bits"
    want = Counter(" ".join(text.split()[i:i + k]) + f"\t{lang}" for lang in ("en", "de") for k in range(1, 5) for i in range(len(text.split()) - k + 1))
    assert block_counts([("en", text), ("de", text)]) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark, spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark, spark.createDataFrame([(None, None), ("en", "one two")], "lang string, text string")).collect() == []


# ---------------------------------------------------------------- centroids
def brute_clusters(rows, k=16, rounds=3, dims=64):
    good = [(i, e) for i, e, _ in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    x = [[int(np.floor(64 * float(np.float32(v)))) for v in e] for _, e in good]
    h = [hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else None for i, _ in good]
    order = sorted(range(len(good)), key=lambda n: (h[n] is None, h[n] or "", good[n][1]))
    c = [x[n] for n in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for v, (_, q) in zip(x, own) if q == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    per = Counter()
    for d, j in own:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(good, own)), key=str)


def cluster_rows():
    rng = np.random.default_rng(9)
    rows = [(k, (rng.standard_normal(64) * rng.choice([0.01, 1.0])).tolist(), 0) for k in range(120)]
    grid = [[float(rng.integers(-1, 2)) / 64] * 64 for _ in range(60)]  # many equal distances
    rows += [(500 + k, e, 1) for k, e in enumerate(grid)] + [(500, grid[0], 1), (None, grid[1], 1), (None, grid[2], None)]
    some = grid[0]
    return rows + [(900, None, 0), (901, [], 0), (902, some[:63], 0), (903, [*some, 0.0], 0), (904, [None, *some[1:]], 0), (905, [float("nan"), *some[1:]], 0),
                   (906, [float("-inf"), *some[1:]], 0)]


def test_clusters_equal_brute_force(spark):
    rows = cluster_rows()
    got = bisector.with_inertia(spark, *bisector.clustered(spark, vectors(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = cluster_rows()[:3]
    got = bisector.with_inertia(spark, *bisector.clustered(spark, vectors(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)
    assert bisector.with_inertia(spark, *bisector.clustered(spark, vectors(spark, []))).collect() == []


def test_tournament_equals_distances_with_ties():
    rng = np.random.default_rng(10)
    for _ in range(50):
        c, x = rng.integers(-2, 3, (rng.integers(1, 9), 3)), rng.integers(-3, 4, (200, 3))
        game = bisector.Tournament(c)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        won = game.winners(x)
        assert (won == d.argmin(1)).all() and (game.distances(x, won) == d.min(1)).all()


def test_components_beyond_64_bit_distances_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        bisector.clustered(spark, vectors(spark, [(1, [1e9] * 64, 0)]))[0].collect()


def test_queries_return_the_whole_tables(spark, queries):
    n = spark.read.parquet(f"{SF_MID}/embeddings.parquet").count()
    got = queries["op11_embedding"](spark, SF_MID)
    assert got.count() == n and got.where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = queries["op13_centroids"](spark, SF_MID)
    assert got.count() == n and dict(got.dtypes)["cluster"] == "int" and {t for c, t in got.dtypes if c not in ("cluster", "centroid_sha256")} == {"bigint"}
