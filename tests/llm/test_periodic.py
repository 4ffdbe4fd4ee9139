import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from lodeseam.llm import periodic


def brute(w):
    """Runs of a list of words by their definition: (start, length, period)."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    r = random.Random(7)
    for k in range(1500):
        kind = k % 6
        if kind == 0:
            yield [r.choice("ab") for _ in range(r.randrange(60))]
        elif kind == 1:
            yield [r.choice("abc") for _ in range(r.randrange(8))] * r.randrange(1, 9)
        elif kind == 2:
            block = [r.choice("abcd") for _ in range(r.randrange(1, 12))]
            w = block * r.randrange(3, 7)
            yield [r.choice("abcd") for _ in range(r.randrange(5))] + w[: r.randrange(1, len(w) + 1)] + [r.choice("abcd") for _ in range(r.randrange(5))]
        elif kind == 3:
            a = [r.choice("ab")] * r.randrange(3, 9)
            yield (a + ["c"]) * r.randrange(3, 6) + a
        elif kind == 4:
            yield [str(r.randrange(400)) for _ in range(r.randrange(200))] + ["x", "y"] * r.randrange(6)
        else:
            inner = ["a"] * 6 + ["b"]
            yield (inner * 4 + ["c"]) * r.randrange(1, 6)


def test_runs_against_brute_force():
    rows = list(texts())
    names = {x: i for i, x in enumerate(sorted({x for w in rows for x in w}))}
    for low in range(0, len(rows), 100):
        some = rows[low : low + 100]
        first = np.concatenate([[0], np.cumsum([len(w) for w in some])])
        ids = np.array([names[x] for w in some for x in w], np.int64)
        start, end, period = periodic.find_runs(ids, first)
        for k, w in enumerate(some):
            mine = (start >= first[k]) & (start < first[k + 1])
            got = list(zip((start[mine] - first[k]).tolist(), (end - start)[mine].tolist(), period[mine].tolist()))
            assert got == brute(w), w
        again = periodic._by_scan(ids, first, 6, 4)
        assert [a.tolist() for a in again] == [start.tolist(), end.tolist(), period.tolist()]


def test_grammar_covers_each_text():
    r = random.Random(2)
    ids = np.array([r.randrange(4) for _ in range(500)])
    first = np.array([0, 0, 200, 201, 500])
    boundaries = []
    for low, middle, high, of, at in periodic.nonterminals(ids, first):
        for number, place in zip(of.tolist(), at.tolist()):
            size = high[number] - low[number]
            assert (ids[place : place + size] == ids[low[number] : high[number]]).all()
            boundaries.append(place + middle[number] - low[number])
    assert sorted(boundaries) == sorted(set(range(1, 500)) - {200, 201})  # each boundary between words of a text, once


def test_long_text():
    w = np.array([0, 1, 2] * 60_000 + list(range(3, 60_000)) + [5] * 30_000)
    start, end, period = periodic.find_runs(w, np.array([0, len(w)]))
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == [(0, 180_000, 3), (239_997, 269_997, 1)]


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice([" ", "\n", " \t"]).join(w) + r.choice(["", " "])) for k, w in enumerate(texts()) if k < 500]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "é é é é é é"), (604, "é é é é é"), (605, "a b " * 7), (3, "z z z z z z z"), (3, "z z z z z z z"), (None, "q q q q q q q")]
    schema = "doc_id long, text string, runs int, w string, h int, n int, a int, g int, p int, collapsed string"
    spark.createDataFrame([(*x, 1, "y", 1, 2, 3, 4, 5, "z") for x in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        told = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapse(w, runs).encode()).hexdigest()))
    got = [tuple(x) for x in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 100


def test_empty_table_and_bounds(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.int64), np.array([0, 3]), times=2)
