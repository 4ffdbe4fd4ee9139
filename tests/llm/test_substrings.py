import hashlib
import random
import re

import pytest
from lodeseam.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 70))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            low = r.randint(0, 10)
            words += p[low : low + r.randint(5, 70)] if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        rows.append((k * 7 - 40, r.choice([" ", "\n", "\x0b \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "bucket_mb"), [(1, 4), (2, 0.005), (3, 0.02)])
def test_against_brute_force(spark, seed, bucket_mb):
    rows = corpus(seed)
    rows += [(rows[5][0], rows[5][1]), (None, rows[7][1]), (5000, None), (5001, ""), (5002, " \n"), (5003, " ".join(["a"] * 3000)), (5004, " x " * 30)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, bucket int, shard int").repartition(5)
    got = substrings.remove_repeats(docs, bucket_mb=bucket_mb, shard_mb=bucket_mb).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got])) == sorted(map(repr, brute(rows, 20)))
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed


def test_empty_table_and_narrow_windows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).collect() == []
    rows = [(1, "a b c d"), (2, "x a b c"), (3, "b c")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=3).collect()
    assert {(r.doc_id, r.kept_text) for r in got} == {(1, "a b c d"), (2, "x"), (3, "b c")}
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, window=4, block=4)


def test_query_digests(spark, tmp_path):
    rows = corpus(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op3_substring_dedup(spark, str(tmp_path)).collect()
    want = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows, 20)}
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
