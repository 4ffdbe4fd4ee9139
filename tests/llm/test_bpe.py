import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from lodeseam.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.load(PATH)
PEER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
TEXTS = ["", "a", " \n\t x", "Hello world's  <|endoftext|> 12345", "Ünïcode ½ Ⅷ 漢字 🎉🎉 \x1c\x85 ", "zz" * 4000, "é" * 700, " " * 500, "thtionshanding stündlichkeit\r\n\r\n  "]


def test_documents_like_the_library_and_back(spark, tmp_path):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(100, None, None, None), (3, TEXTS[3], None, 2), (None, "null id", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted(((d, PEER.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=repr) == want
    digest = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_byte_bpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digest == {(d, len(i), sha(",".join(map(str, i)).encode()), sha(t)) for d, i, t in want}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect() == []


def pieces(text):
    cached = bpe._Pieces(VOCABULARY)
    import numpy as np
    import regex

    return [int(i) for p in regex.findall(public_tokenizers.PATTERN, text) for i in np.frombuffer(cached[p], np.int32)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert pieces(text) == PEER.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abthersion é漢 '", max_size=40), st.text(alphabet="abthersion é漢 '", max_size=12), st.integers(0, 100), st.integers(0, 100))
def test_prefixes_appends_and_edits(text, new, a, b):
    data, new = text.encode(), new.encode()
    table = bpe.PrefixTable(VOCABULARY, data[:7])
    table.append(data[7:])
    for size in range(len(data) + 1):
        assert table.ids(size) == VOCABULARY.merged(data[:size])
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    table.replace(a, b, new)
    edited = data[:a] + new + data[b:]
    assert table.data == edited and table.ids() == VOCABULARY.merged(edited)
    assert table.last == bpe.PrefixTable(VOCABULARY, edited).last


def test_an_edit_touches_only_what_is_near():
    data = random.Random(2).choices("theransionlich ", k=6000)
    table = bpe.PrefixTable(VOCABULARY, "".join(data).encode())
    assert table.replace(3000, 3003, b"zq") < 1000
    assert table.last == bpe.PrefixTable(VOCABULARY, table.data).last
