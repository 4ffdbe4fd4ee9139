import itertools
import random
import re

import numpy as np
import pytest
from lodeseam.llm import neardup
from lodeseam.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def groups(seed, sizes):
    r = random.Random(seed)
    vocabulary = [f"W{k}" if k % 3 else f"ü{k}" for k in range(400)]
    rows = []
    for size, edits in sizes:
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 160))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randint(0, edits)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:  # chains: drift away from the base
                base = words
            rows.append(" ".join(words))
    r.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = groups(width, [(1, 0)] * 30 + [(25, 4), (40, 3), (12, 8), (60, 2), (30, 6)])
    rows += [(rows[3][0], rows[3][1]), (9000, None), (9001, ""), (9002, " \n "), (9003, "one TWO"), (9004, "ONE two"), (9005, "one two three"), (None, rows[1][1]), (9006, rows[2][1].upper())]
    docs = spark.createDataFrame([(a, b, 1, 1.0) for a, b in rows], "doc_id long, text string, n long, bands double").repartition(7)
    got = neardup.near_duplicates(docs, width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, width, percent)


@pytest.mark.parametrize("pivots", [0, 1])
def test_links_that_pivots_leave(spark, pivots):
    rows = groups(11, [(80, 5), (50, 9)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, width=3, percent=85, pivots=pivots).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, 3, 85)


def test_rows_that_share_a_doc_id_are_one_node(spark):
    texts = groups(5, [(1, 0), (1, 0)])
    a, b = texts[0][1], texts[1][1]
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (7, 1, False), (9, 1, False)}


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signature_estimates_similarity_with_early_stop():
    r = np.random.default_rng(3)
    everything = r.integers(0, 2**64, 1500, dtype=np.uint64)
    a, b = np.sort(everything[:1000]), np.sort(everything[200:1200])
    small = np.sort(everything[:3])
    m = 256
    signature = neardup.super_minhash(np.concatenate([a, b, small, a]), np.array([0, 1000, 2000, 2003, 3003]), m)
    assert (signature != neardup._EMPTY).all()
    assert (signature[0] == signature[3]).all()
    assert abs((signature[0] == signature[1]).mean() - 800 / 1200) < 0.08
    # each shingle deals every rank once: with one shingle the ranks are a permutation
    one = neardup.super_minhash(small[:1], np.array([0, 1]), m)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(m))


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 560), (900, 901)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long").repartition(8)).collect()}
    assert {got[k] for k in range(100, 181)} == {100}
    assert got[540] == 500 and got[560] == 7 and got[901] == 900 and len(got) == 81 + 60 + 2 + 2


def test_band_settings_meet_their_bound():
    for threshold in (0.5, 0.8, 0.85, 0.95, 1.0):
        bands, rows = neardup.band_settings(threshold)
        assert (1 - threshold**rows) ** bands <= 1e-6


def test_links_of_one_node_are_dealt_to_many_tasks(spark, monkeypatch):
    from lodeseam.llm import components as module

    whole, n = module._forests, 4000

    def limited(batches):
        held = list(batches)
        if sum(map(len, held)) > n // 2:
            raise ValueError("half of the links in one task")
        return whole(iter(held))

    monkeypatch.setattr(module, "_forests", limited)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.createDataFrame([(n, k) for k in range(n)], "x long, y long")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(got) == n + 1 and {r.root for r in got} == {0}
