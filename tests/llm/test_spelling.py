import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodeseam.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least_n=2):
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= least_n}
    out, forms = {}, {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        if others and n[others[0]] >= 10 * n[w]:
            forms[w] = others[0]
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n[w], out[w], n[forms[w]] if w in forms else None))
    return sorted(rows)


def vocabulary(seed, size):
    r = random.Random(seed)
    words = set()
    while len(words) < size:
        w = r.choice(["", "aaa", "abc", "éà"]) + "".join(r.choice("aabé") for _ in range(r.randrange(4, 9)))
        words.add(w)
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + r.choice("abz") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :]}
    return {w: r.choice([1, 2, 3, 20, 30, 300, 5000]) for w in sorted(words)}


def test_acceptor_pairs_against_all_pairs():
    r = random.Random(1)
    for seed in range(60):
        words = sorted({"".join(r.choice("abc"[: 1 + seed % 3]) for _ in range(r.randrange(0, 7))) for _ in range(40)})
        rows = sorted((r.randrange(3), w) for w in words)
        a = spelling.Acceptor(np.array([g for g, _ in rows]), [w for _, w in rows])
        one, two = a.pairs()
        got = [tuple(sorted((i, j))) for i, j in zip(one.tolist(), two.tolist())]
        want = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and near(rows[i][1], rows[j][1])]
        assert sorted(got) == sorted(tuple(sorted(p)) for p in want)


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("", "x", "xy", "z") for b in ("ing", "ed", "s", "ings"))
    a = spelling.Acceptor(np.zeros(len(words), int), words)
    rests = {w[k:] for w in words for k in range(len(w) + 1)}
    languages = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(a.degree) == len(languages) and rests


@pytest.mark.parametrize("limit", [100_000, 40, 5])
def test_groups_against_brute_force(spark, limit):
    counts = vocabulary(limit, 500)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = spelling.spelling_groups(rows, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute(counts)
    assert any(x.root != x.word for x in got) and any(x.form not in (None, x.root) for x in got)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    pool = [w.upper() if r.random() < 0.1 else w for w in vocabulary(4, 60)] + ["sentence", "Überall", "naïvement", "x" * 90, "a×b÷cdefg"]
    rows = [(k, r.choice([" ", ", ", "\n", "1"]).join(r.choice(pool[: 1 + k % len(pool)]) for _ in range(r.randrange(80)))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, "日本語 sentence"), (3, rows[3][1]), (None, "sentence overall sentence")]
    docs = spark.createDataFrame([(*x, 1, "y", 2) for x in rows], "doc_id long, text string, n int, word string, form_n int").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0 and doc is not None:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    got = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute(counts)
    assert sum(x.form is not None for x in got) > 20


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.word_counts(none)).collect() == []
