import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from lodeseam.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't STOP", "'tis 'll,'t x'reab", "H̱ ÉtÉ ½", "a≠b 1234 ²", "<|endoftext|> <|startoftext|>", " x y　z", "ǅ İI Σσ", "...!?--'s", "café,…", "\U0001f600‍\U0001f600", "Å", "x" * 3000, "\t\n", "1st2nd", "naïve×÷"]


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def right(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, pieces, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {d for d, *_ in rows}
    for doc, text, source in rows:
        mine = sorted(by_doc[doc], key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in mine]).tolist() == right(text)
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
        assert {p.doc_tokens for p in mine} == {len(right(text))} and {p.source for p in mine} == {source or ""}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padded = 0
    for number, members in by_sequence.items():
        members.sort(key=lambda p: p.offset)
        assert [p.offset for p in members] == np.cumsum([0, *(p.length for p in members)])[:-1].tolist()
        size = sum(p.length for p in members)
        assert size <= length
        padded += 0 if size & (size - 1) == 0 else length - size
    assert not padded
    return by_sequence


def test_ids_equal_the_tokenizer(spark):
    r = random.Random(5)
    letters = "abcXYZ '-.,1é́Åİ…²ß̱\n"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(800)]
    encoder = packing.Encoder(PATH, 2)
    assert encoder.by_pieces
    import pyarrow as pa

    got = []
    for flat, sizes in encoder.encode(pa.array(texts)):
        at = np.concatenate([[0], np.cumsum(sizes)])
        got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [right(t) for t in texts]


def test_every_id_once_and_shares_kept(spark):
    r = random.Random(1)
    words = ["alpha", "Beta's", "42", "gérard", ",", "delta-x"]
    rows = []
    for k in range(400):
        source = r.choice(["hot"] * 5 + ["b", "c", None, f"tiny{k % 40}"])
        rows.append((k, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(200)))]) if k % 9 else "long " * 3000, source))
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, source string, part int, ids string").repartition(7)
    pieces = packing.pack(docs, PATH, length=256, least=16).collect()
    by_sequence = check(rows, pieces, 256)
    tokens = Counter()
    for _, text, source in rows:
        tokens[source or ""] += len(right(text))
    total = sum(tokens.values())
    big = [s for s, n in tokens.items() if n * 256 >= 16 * total]
    assert "hot" in big and len(big) < len(tokens)
    for number, members in by_sequence.items():
        if sum(p.length for p in members) == 256:
            held = Counter()
            for p in members:
                held[p.source] += p.length
            for source in big:
                assert abs(held[source] - 256 * tokens[source] / total) < 2, (number, source)
    ends = Counter(p.sequence_id for p in pieces)
    whole = packing.sequences(packing.pack(docs, PATH, length=256, least=16)).collect()
    assert {w.sequence_id: w.n_pieces for w in whole} == ends
    assert all(len(w.ids) == 4 * w.n_tokens for w in whole)


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.25}, {"a": 1.0}, {"a": 0.001, "b": 0.9}, {}])
def test_target_weights(spark, weights):
    rows = [(k, "word " * (k % 50), "abcd"[k % 4]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    by_sequence = check(rows, packing.pack(docs, PATH, length=128, weights=weights, least=8).collect(), 128)
    held = Counter()
    for p in by_sequence[0]:
        held[p.source] += p.length
    for source, weight in weights.items():
        if weight * 128 >= 8:
            assert abs(held[source] - 128 * weight) < 2


def test_layout_is_a_bijection():
    r = random.Random(3)
    for _ in range(200):
        counts = [r.randrange(400) for _ in range(r.randrange(1, 6))]
        weights = r.choice([None, [r.randrange(1, 5) / 10 for _ in counts]])
        length = r.choice([16, 32])
        if weights is None and any(0 < c * length < sum(counts) for c in counts[:-1]):
            continue
        layout = packing.Layout.of(counts, weights, length)
        places = set()
        for queue, count in enumerate(counts):
            at = 0
            while at < count:
                n = min(r.randrange(1, 60), count - at)
                got = list(layout.pieces(queue, at, n))
                assert sum(g[1] for g in got) == n and [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got)])[:-1].tolist()
                for _, size, number, offset in got:
                    places |= {(number, offset + k) for k in range(size)}
                at += n
        assert len(places) == sum(counts)


def test_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, source string, n int, within int, before int, queue int, row int"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    rows = [(1, "a b", "s", 0, 0, 0, 0, 0)] * 3 + [(None, None, None, 0, 0, 0, 0, 0)] * 2
    got = packing.pack(spark.createDataFrame(rows, schema), PATH).collect()
    assert sum(p.length for p in got) == 3 * 3 + 2 and sum(p.length for p in got if p.doc_id is None) == 2
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, schema), PATH, weights={"a": 2.0})
