import numpy as np
import pytest

from lodeseam.operators import semantic


@pytest.mark.parametrize("within", [None, "part"])
def test_blocks_out_of_reach_are_not_visited(spark, within):
    """Equal to all pairs, over bunches of vectors of which a query needs few."""
    r = np.random.default_rng(4)
    bunches = r.normal(size=(30, 16))
    which = r.integers(0, 30, 3000)
    v = bunches[which] + 0.05 * r.normal(size=(3000, 16))
    rows = [(f"c{k:04}", v[k].tolist(), f"p{k % 2}" if k % 50 else None) for k in range(3000)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>, part string").repartition(2).sortWithinPartitions("chunk_id")
    asks = bunches[r.integers(0, 30, 40)] + 0.05 * r.normal(size=(40, 16))
    queries = spark.createDataFrame([(k, asks[k].tolist()) for k in range(40)] + [(99, None)], "query_id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores, told = np.round(unit(asks) @ unit(v).T, 9), []
    want = set()
    for q in range(40):
        for part in {x[2] for x in rows} if within else {0}:
            mine = [k for k in range(3000) if not within or rows[k][2] == part]
            best = sorted(mine, key=lambda k: (-scores[q, k], rows[k][0]))[:10]
            want |= {(q, n + 1, rows[k][0], *([part] if within else [])) for n, k in enumerate(best)}
    found = semantic.search(vectors, queries, 10, block=50, within=within, report=lambda *n: told.append(n))
    got = {(x.query_id, x["rank"], x.chunk_id, *([x.part] if within else [])) for x in found.collect()}
    assert got == want
    (visited, pairs) = told[0]
    assert visited < 0.4 * pairs, told
