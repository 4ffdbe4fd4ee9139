import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodeseam.llm import toxicity as tx

TERMS = ["moron", "pathetic", "worthless", "scum", "lowei*", "marinade"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    stems = [t for t in TERMS if t.endswith("*") and word.startswith(t[:-1])]
    if stems:
        return (stems[0], 0)
    best = min(((distance(word, t), t) for t in TERMS if not t.endswith("*") and distance(word, t) <= tx.allowed_edits(t)), default=None)
    return best and (best[1], best[0])


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abmorntx"), st.integers(0, 2)), max_size=3))
def test_automaton_is_the_edit_distance(term, edits):
    word = list(term.rstrip("*"))
    for at, letter, kind in edits:
        at = min(at, len(word))
        word[at : at + (kind > 0)] = [letter] if kind < 2 else []
    word = "".join(word)
    assert AUTOMATON.match(word) == brute(word)


AUTOMATON = tx.Automaton(TERMS)


def test_words_beyond_the_numbered_states():
    r = random.Random(2)
    small = tx.Automaton(TERMS)
    small.LIMIT = 12
    words = ["".join(r.choices("moranptheicluswdk", k=r.randint(1, 11))) for _ in range(2000)] + ["morron", "patetic", "worthles", "loweixyz", "scum", "marinada", "lowie"]
    assert [small.match(w) for w in words] == [brute(w) for w in words] == [AUTOMATON.match(w) for w in words]
    assert len(small.sets) <= 12 < len(AUTOMATON.sets)


def test_quotation_counts_apart():
    model = tx.Model((("moron", 5.0),), coefficients=(-3.0, 1.0, 0.5, -0.2))
    score = lambda t: tx._score(model, tx.find(model, t))
    assert score("you moron") > 0.5 and score("YOU MORRON, really") > 0.5
    assert score('he used the slur "moron" again') < 0.5 and score("they said moron to him") < 0.5
    assert score("") == score("nothing here") < 0.5


def corpus(n=1500):
    r = random.Random(5)
    plain = [a + b + c for a in ("th", "er", "an", "mo") for b in ("in", "ou", "re") for c in ("st", "ed", "on")]
    rows, labels = [], []
    for k in range(n):
        words = r.choices(plain, k=r.randint(5, 60))
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["moron!", "Scum", "lowei" + r.choice(plain), "pathetic"]))
        rows.append((k, " ".join(words)))
        if r.random() < 0.8:
            labels.append((k, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_labels_unseen(spark, tmp_path):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "you absolute patheticc thing"), (None, "moron"), (9003, "lowei" + "x" * 100_000), (3, rows[3][1])]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, label string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.createDataFrame(labels + [(None, 1), (77777, 1)], "doc_id long, toxic int")
    frame.write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.99
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].predicted == by_id[9001].predicted == 0 and 0 <= by_id[9000].score <= 1
    assert by_id[9002].predicted == by_id[9003].predicted == by_id[None].predicted == 1
    # flipping every held-out label changes no score
    flipped = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels], "doc_id long, toxic int")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    from pyspark.sql import functions as F

    assert tx.learn(docs, flipped.where(~tx.held_out(F.col("doc_id")))) == tx.learn(docs, frame.where(~tx.held_out(F.col("doc_id"))))


@pytest.mark.parametrize("labels", [[], [(1, 0)]])
def test_no_toxic_labels_and_empty_tables(spark, labels):
    docs = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    model = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert tx.score(docs, model).first().predicted == 0
    assert tx.score(docs.limit(0), model).collect() == []


def test_inflected_forms_do_not_switch_misspellings_off():
    counts = [("idiot", 40, 40), ("idiots", 10, 10), ("idio*", 50, 50), ("idiot*", 10, 10), ("pathe*", 30, 30), ("patheti*", 30, 30), ("pathetic", 30, 30)]
    model = tx.Model(tx.choose_terms(counts, 100, 1000))
    terms = dict(model.terms)
    assert {"idio*", "idiot", "idiots", "pathetic"} <= set(terms) and "idiot*" not in terms
    assert [m[2:4] for m in tx.find(model, "you ediot, idiotic idiots")] == [("idiot", 1), ("idio*", 0), ("idio*", 0)]


def test_all_terms_that_meet_support_and_precision():
    """The lexicon is bounded by support alone: more than a thousand terms are all kept."""
    counts = [(f"w{k:04d}", 5, 5) for k in range(3_000)] + [("rare", 4, 4), ("common", 50, 90)]
    assert {t for t, _ in tx.choose_terms(counts, 2_000, 50_000)} == {c[0] for c in counts[:3_000]}


def test_edits_inside_a_long_beginning():
    automaton = tx.Automaton(["patheti*", "lowei*"])
    for word, want in {"pathetically": ("patheti*", 0), "pathwtically": ("patheti*", 1), "pahetical": ("patheti*", 1), "patttetic": None, "lowxing": None}.items():
        assert automaton.match(word) == want, word


def test_digits_inside_words():
    model = tx.Model((("idiot", 5.0), ("scum", 4.0)))
    found = lambda t: [(m[0], m[1], m[2], m[3]) for m in tx.find(model, t)]
    assert found("an id1ot") == [(3, 8, "idiot", 1)]
    assert found("idiot2000 4scum") == [(0, 5, "idiot", 0), (11, 15, "scum", 0)]
    assert found("scum4scum x2idiot") == [(0, 4, "scum", 0), (5, 9, "scum", 0), (12, 17, "idiot", 0)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(model, word):
    """(term, edits): the nearest of all terms, a beginning that is spelled out before any other."""
    found = []
    for term, _ in model.terms:
        body = term.rstrip("*")
        ends = range(len(word) + 1) if term.endswith("*") else [len(word)]
        found.append((min(levenshtein(body, word[:k]) for k in ends), term))
    stems = [(e, t) for e, t in found if t.endswith("*") and e == 0]
    if stems:  # the shortest is met first
        return min(stems, key=lambda x: len(x[1]))[1], 0
    found = [(e, t) for e, t in found if e <= tx.allowed_edits(t)]
    if not found:
        return None
    e, term = min(found)
    return None if e and (word in model.clean or term in model.literal) else (term, e)


def plain_score(model, text):
    """The score by comparing each word with each term, without automaton, caches or bounds."""
    text, weights, plain, quoted = (text or "").lower(), dict(model.terms), [], []
    spans = []
    for m in re.finditer(r"[^\W\d_]+(?:\d+[^\W\d_]+)*", text):
        whole = m[0].isalpha() or plain_match(model, m[0])
        spans += [m.span()] if whole else [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\W\d_]+", m[0])]
    for k, (i, j) in enumerate(spans):
        found = plain_match(model, text[i:j])
        if found:
            before, after = text[spans[max(0, k - 6)][0] : i], text[j : spans[min(len(spans) - 1, k + 6)][1]]
            said = (set(before) & set(tx.QUOTES) and set(after) & set(tx.QUOTES)) or tx.REPORTING & set(re.findall(r"[^\W\d_]+", before))
            (quoted if said else plain).append(weights[found[0]] * (0.7 if found[1] else 1))
    a, b, c, d = model.coefficients
    return 1 / (1 + math.exp(-(a + b * max(plain, default=0) + c * math.log(1 + sum(plain)) + d * max(quoted, default=0))))


def test_query_against_every_term_of_every_word(spark, tmp_path):
    rows, labels = corpus(700)
    r = random.Random(9)
    odd = ["moron", "m0ron", "morron", '"moron"', "she said moron", "lowei4st", "loweixx", "path3tic", "scum7scum", "„Scum“", "pathetick", "É", "ﬁn"]
    rows += [(20_000 + k, " ".join(r.choices(odd, k=r.randint(0, 6)))) for k in range(300)] + [(30_000, None), (30_001, ""), (None, "moron")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((x.doc_id is None, x.doc_id, x.score, x.predicted) for x in tx.op7_toxicity(spark, str(tmp_path)).collect()), key=repr)
    model = tx.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, toxic int"))
    want = sorted(((d is None, d, plain_score(model, t)) for d, t in rows), key=repr)
    assert {x[:2]: (pytest.approx(x[2], abs=1e-9), int(x[2] >= 0.5)) for x in want} == {x[:2]: x[2:] for x in got}
