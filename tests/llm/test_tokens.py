import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import bpe, lengths
from llm_helpers import no_documents, odd_documents, sentence

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_round_trip(spark, ranks, theirs):
    rng = random.Random(2)
    chars = "abcdé ñ<=>　漢²½\t\n\x1c\x85 ٣Ⅷ\U0001d7d8́'s_😀THEing"
    texts = [sentence(rng, 50), "it's <|endoftext|> we'll", "a" * 3000, "b" * 64 + " " * 70, None, "", "  x"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    codec = bpe.Codec(spark, ranks, public_tokenizers.PATTERN)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", codec.encode("text").alias("ids"), codec.lengths("text").alias("n"))
    for r in frame.withColumn("back", codec.decode("ids")).collect():
        text = texts[r.i] or ""
        assert r.ids == theirs.encode_ordinary(text) and r.n == len(r.ids) and bytes(r.back) == text.encode()


def test_merges_agree_at_every_length(ranks, theirs):
    rng, pieces = random.Random(4), bpe.Pieces(ranks)
    for n in (1, 2, 3, 8, 63, 64, 65, 500):
        for _ in range(30):
            text = "".join(rng.choice("theingabc") for _ in range(n))
            ids = np.frombuffer(next(pieces.encode([text], lambda x: [x])), np.int32).tolist()
            assert ids == bpe.merge(text.encode(), ranks) == theirs._encode_single_piece(text.encode())


def test_round_trip_encodes_each_text_once_and_in_slices(spark, ranks, theirs, monkeypatch):
    codec = bpe.Codec(spark, ranks, public_tokenizers.PATTERN)
    texts = ["", None, "one", "two words", "x" * 40, None, "漢 é"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id int, text string, more int")
    got = {r.doc_id: r for r in codec.round_trip(docs).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: theirs.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert all(bytes(got[i].decoded) == (t or "").encode() for i, t in enumerate(texts))
    # one Python step that encodes, not one that encodes for the ids and again for the bytes
    plan = bpe.digests(docs, codec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = [part["doc_id"].to_pylist() for part in bpe._slices(batch)]
    assert sum(parts, []) == list(range(7)) and max(sum(len((texts[i] or "").encode()) for i in part[1:]) for part in parts) <= 10
    assert list(bpe._slices(batch.slice(0, 0))) == []


def test_digests_of_odd_rows(spark, ranks):
    codec, empty = bpe.Codec(spark, ranks, public_tokenizers.PATTERN), hashlib.sha256(b"").hexdigest()
    got = bpe.digests(odd_documents(spark), codec).collect()
    assert len(got) == 11
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (2, 3))
    assert {r.decoded_sha256 for r in got if r.doc_id == 6} == {hashlib.sha256(b"word").hexdigest()}
    assert bpe.digests(no_documents(spark), codec).count() == 0
    with pytest.raises(ValueError):
        bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), most=1000)


def test_length_sums(spark):
    rng = random.Random(8)
    n = [rng.choice([0, 3, 3, 700, rng.randrange(2000)]) for _ in range(500)]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")))
    n.append(0)
    rows = sums.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        longer = [x for x in n if x >= r.n_tokens]
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.total_docs, r.total_tokens) == (n.count(r.n_tokens), len(longer), sum(longer), len(n), sum(n))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert r.share_at_most == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    for r in lengths.at_limits(sums, [0, 1, 64, 700, 10_000]).collect():
        assert (r.docs_cut, r.truncated_tokens) == (sum(x > r.context_limit for x in n), sum(min(x, r.context_limit) for x in n))
    none = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([], "n_tokens long")))
    assert none.count() == 0
