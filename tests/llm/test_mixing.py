import hashlib
import math
import re
from collections import defaultdict

import pytest
from lodeseam.llm import mixing

md5 = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()


def test_exponent_meets_the_entropy_or_the_limit():
    totals = {"a": 9000, "b": 500, "c": 300, "d": 0}
    loose = mixing.solve(totals, target_entropy=0.9, max_repeats=None)
    assert abs(mixing.entropy(loose.weights.values()) - 0.9 * math.log(3)) < 1e-6
    tight = mixing.solve(totals, target_entropy=0.9, max_repeats=2.0)
    assert max(tight.quotas[s] / totals[s] for s in "abc") == pytest.approx(2.0, abs=1e-2)
    assert loose.exponent < tight.exponent < 1
    assert mixing.solve({"a": 5, "b": 5}).exponent == 1.0
    assert mixing.solve(totals, 0.9, 4.0, budget=1000).quotas.keys() == totals.keys()
    assert sum(mixing.solve(totals, 0.9, None, budget=1000).quotas.values()) in range(990, 1001)
    assert mixing.solve({"a": 0}).quotas == {"a": 0} and mixing.solve({}).quotas == {}


def brute(rows, mix, totals, block_docs, seed=1):
    by_source = defaultdict(list)
    for d, s, n in rows:
        by_source[s].append(("" if d is None else d, d, n))
    out = []
    for s, docs in by_source.items():
        t, quota = totals[s], mix.quotas[s]
        blocks = max(1, math.ceil(len(docs) / block_docs))
        deal = defaultdict(list)
        for name, d, n in docs:
            deal[int(md5(seed, name)[:8], 16) % blocks].append((name, d, n))
        for epoch in range(math.ceil(quota / t) if t else 1):
            at = epoch * t
            for b in sorted(deal, key=lambda b: (md5(seed, "block", epoch, s, b), b)):
                for name, d, n in sorted(deal[b], key=lambda x: (md5(seed, "doc", epoch, x[0]), x[2])):
                    if not t or epoch < quota // t or at < quota:
                        out.append((d, s, n, epoch, at / quota if quota else 0.0))
                    at += n
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [None, 700, 0])
def test_against_brute_force(spark, budget):
    rows = [(k, "w " * (k % 17), ("big", "mid", "tiny")[(k % 20 == 0) + (k % 7 == 0)]) for k in range(400)]
    rows += [(900, None, "none"), (901, " \n", "none"), (None, "x y", None), (902, "z", ""), (3, rows[3][1], rows[3][2]), (903, "q", None)]
    docs = spark.createDataFrame([(*r, 7, "e") for r in rows], "doc_id long, text string, source string, epoch int, block string").repartition(6)
    got = mixing.mix_sources(docs, budget=budget, block_docs=40).collect()
    counted = [(d, s or "", len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for d, t, s in rows]
    totals = defaultdict(int)
    for _, s, n in counted:
        totals[s] += n
    mix = mixing.solve(dict(sorted(totals.items())), budget=budget)
    assert sorted(((r.doc_id, r.source, r.n_tokens, r.epoch, r.place) for r in got), key=repr) == brute(counted, mix, totals, 40)
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_sources_of_a_size_are_solved_together():
    r = __import__("random").Random(3)
    totals = {f"s{k}": r.choice([5, 50, 500, 7000]) for k in range(300)}
    mix = mixing.solve(totals)
    sizes = defaultdict(int)
    for t in totals.values():
        sizes[t] += 1
    exponent, weights, quotas = mixing.solve_sizes(dict(sizes))
    assert (mix.exponent, mix.quotas["s1"]) == (exponent, quotas[totals["s1"]]) and all(mix.weights[s] == weights[t] for s, t in totals.items())
    assert mixing.entropy(mix.weights.values()) >= 0.95 * math.log(300) - 1e-6 or max(mix.quotas[s] / t for s, t in totals.items()) <= 4.01


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
