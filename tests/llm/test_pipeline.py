import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from lodeseam.llm import bpe, mixing

from tests.llm.test_exactdup import brute as exact
from tests.llm.test_neardup import brute as near
from tests.llm.test_toxicity import corpus


def test_against_brute_force(spark, tmp_path):
    rows, labels = corpus(700)
    r = random.Random(9)
    long = [" ".join(r.choices([w for _, t in rows[:40] for w in t.split()], k=120)) for _ in range(6)]
    bad = {"moron!", "Scum", "pathetic"}
    for base in long:
        base = " ".join(w for w in base.split() if w not in bad and not w.startswith("lowei"))
        rows += [(len(rows), base), (len(rows) + 1, base.replace(" ", "\n")), (len(rows) + 2, base + " tail end"), (len(rows) + 3, "head " + base)]
    rows += [(5000, None), (5001, ""), (5002, "clean text here"), (5002, "clean text here"), (None, "no name")]
    source = lambda d: ("big", "big", "big", "mid", "tiny")[(d or 0) % 5]
    docs = spark.createDataFrame([(d, t, "en", source(d), None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((g.doc_id, g.n_tokens, tuple(g.ids), g.decoded_sha256) for g in corpus_pipeline.run(spark, str(tmp_path)).collect())

    toxic = lambda t: any(w in bad or w.startswith("lowei") for w in (t or "").split())
    left = [(d, t) for d, t in rows if not toxic(t)]
    text = dict(left)
    left = [(d, text[d]) for d, _, _, kept, _ in exact(left) if kept]
    keep = {d for d, _, _, kept in near(left, 5, 80) if kept}
    left = [(d, t) for d, t in left if d in keep]
    totals = Counter()
    for d, t in left:
        totals[source(d)] += len((t or "").split())
    quotas = mixing.solve(dict(sorted(totals.items()))).quotas
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    single = {}
    for d, t in left:
        ids = peer.encode_ordinary(t or "")
        single[d] = (d, len(ids), tuple(ids), hashlib.sha256((t or "").encode()).hexdigest())
    assert set(got) == set(single.values())
    taken = Counter()
    for row, times in got.items():
        whole = quotas[source(row[0])] // totals[source(row[0])]
        assert times in (whole, whole + 1)
        taken[source(row[0])] += times * len((text[row[0]] or "").split())
    for s, quota in quotas.items():
        assert quota <= taken[s] < quota + 130  # the last document may go over


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
