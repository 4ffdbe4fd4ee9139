import hashlib
import random

import numpy as np
import pyarrow as pa
from lodeseam.llm import fingerprints as fp


def words_of(r, n, vocabulary=5000):
    return [f"wörd{r.randrange(vocabulary)}" for _ in range(n)]


def jaccard(a, b):
    s = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_estimates_and_equal_texts():
    r = random.Random(3)
    for n in (3, 12, 80, 400, 3000):
        errors = []
        for _ in range(12):
            a = words_of(r, n)
            b = list(a)
            b[: n // r.choice((2, 3, 9))] = words_of(r, n // 3)
            a, b = " ".join(a), " ".join(b)
            rows = fp.codes(pa.array([a, b, a]))
            assert (rows[0] == rows[2]).all()
            errors.append(fp.likeness(rows[:1], rows[1:2])[0] - jaccard(a, b))
        assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.05


def test_packing_and_degenerate_texts():
    rows = fp.codes(pa.array([None, "", " \n", "one", "one two three four"]))
    assert not rows[:3].any() and rows.shape == (5, fp.BINS)
    assert rows[3].any() and fp.likeness(rows[3:4], rows[4:5])[0] < 0.1
    packed = fp.pack(rows)
    assert all(len(p) == fp.BINS * fp.BITS // 8 for p in packed)
    back = np.unpackbits(np.frombuffer(packed[4], np.uint8)).reshape(-1, fp.BITS)
    assert (back @ (1 << np.arange(fp.BITS)[::-1]) == rows[4]).all()
    assert fp.likeness(rows[:1], rows[1:2])[0] == 1.0


def test_sparse_rows_are_filled_from_full_bins():
    table = np.full((3, 64), 2**64 - 1, np.uint64)
    table[0, 5], table[0, 60] = 7, 9
    table[1, :63] = np.arange(63, dtype=np.uint64)
    fp._densify(table)
    assert set(table[0].tolist()) == {7, 9} and table[1, 63] < 63 and (table[2] == 2**64 - 1).all()


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(k * 3 - 60, " ".join(words_of(r, r.randint(0, 60), 90)), "x", True) for k in range(90)]
    rows += [(1000, None, None, None), (1001, "", "y", False), (1002, "漢字 🎉 " * 40, "y", False), (None, "no id", "y", True), (rows[4][0], rows[4][1], "twice", True)]
    spark.createDataFrame(rows, "doc_id long, text string, edited string, guest boolean").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want.append((d, len(t), t[: len(t) - k] + after[:k]))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for bucket_mb in (4, 0.002):
        got = fp.chained(docs, bucket_mb).collect()
        assert sorted(map(repr, ((g.doc_id, g.n_chars, g.edited) for g in got))) == sorted(map(repr, want))
    single = {(f.doc_id, bytes(f.fingerprint).hex()) for f in fp.fingerprints(docs).collect()}
    assert {(g.doc_id, g.fingerprint) for g in got} == single
    # the edited text's own fingerprint, and both likenesses against true similarities
    edited = spark.createDataFrame([(k, e) for k, (_, _, e) in enumerate(want)], "doc_id long, text string")
    by_text = {want[f.doc_id][2]: bytes(f.fingerprint).hex() for f in fp.fingerprints(edited).collect()}
    following = {(d, t): after for (d, t), (_, after) in zip(order, order[1:] + order[:1])}
    errors = []
    for g in got:
        assert g.edited_fingerprint == by_text[g.edited]
        (text,) = {t for (d, t) in following if d == g.doc_id and len(t) == g.n_chars and g.edited[: len(t) - len(t) // 3] == t[: len(t) - len(t) // 3]}
        errors.append(g.near_edited - _likeness(text, g.edited))
        if order.count((g.doc_id, text)) == 1:  # a repeated row may be its own next
            errors.append(g.near_next - _likeness(text, following[g.doc_id, text]))
    assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.02
    digests = {(g.doc_id, g.edited_sha256) for g in fp.op4_document_fingerprints(spark, str(tmp_path)).collect()}
    assert digests == {(d, hashlib.sha256(e.encode()).hexdigest()) for d, _, e in want}


def _likeness(a, b):
    """True similarity; texts without words are like each other and like no other."""
    if not a.split() or not b.split():
        return float(not a.split() and not b.split())
    return jaccard(a, b)


def test_one_document_and_none(spark):
    one = fp.chained(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited == "abcdab" and one[0].near_next == 1.0
    assert fp.chained(spark.createDataFrame([], "doc_id long, text string")).collect() == []
