import hashlib
import random
import re
from collections import defaultdict

import pytest
from lodeseam.llm import exactdup


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        t = t or ""
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), d is None, d or 0, d))
    out = []
    for plain, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [0, 2])
def test_against_brute_force(spark, levels):
    r = random.Random(4)
    bases = ["a b", "é x", "", "long " * 50, "A B"]
    rows = [(k, "".join(c + r.choice(["", " ", "\n", "\x0b"]) for c in r.choice(bases))) for k in range(300)]
    rows += [(400, None), (None, "a b"), (None, "ab"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (6, "other"), (401, "a\x1cb")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, run int, digest string").repartition(9)
    got = exactdup.exact_duplicates(docs, levels=levels).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert exactdup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
