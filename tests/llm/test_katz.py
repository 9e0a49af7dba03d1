import collections
import math
import random
import zlib

import numpy as np
import pytest

from auditlake.llm import katz
from llm_helpers import no_documents, odd_documents, sentence


def model(texts: dict[int, str | None]):
    """Probabilities by the definition, from plain counters."""
    tokens = {i: [None, *(t or "").encode().lower().split(), b" end"] for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t[1:])
            two.update(zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    starts = collections.Counter(a for (a, _), r in two.items() for _ in range(r))
    many = collections.Counter(two.values())
    d = katz.discounts([many[i] for i in range(1, 7)], 0.5)

    def alone(w):
        return (one.get(w, 0) + 1) / (n + v + 1)

    def seen(h, w):
        r = two[(h, w)]
        return (d[r - 1] * r if r <= 5 else r - 0.5) / starts[h]

    mass, low = collections.Counter(), collections.Counter()
    for h, w in two:
        mass[h] += seen(h, w)
        low[h] += alone(w)

    def p(h, w):
        if (h, w) in two:
            return seen(h, w)
        return alone(w) * ((1 - mass[h]) / (1 - low[h]) if h in starts else 1)

    return tokens, one, n, p


@pytest.mark.parametrize("part", [1 << 20, 150])
def test_scores_match_the_definition(spark, part):
    rng = random.Random(5)
    texts = {i: sentence(rng, rng.randrange(0, 40)) for i in range(300)} | {300: "", 301: None, 302: "Kaban KABAN kaban neu"}
    tokens, one, n, p = model(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    # tiny chunks and buckets, and histories split over several buckets
    s = katz.Settings(chunk_tokens=300, word_bucket=3000, pair_bucket=2000, pair_part=part, split_history=20)
    got = {r.doc_id: r for r in katz.scored(frame, s).collect()}
    assert len(got) == len(texts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t) - 1, sum(one.get(w, 0) > 0 for w in t[1:]), n)
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(t, t[1:], strict=False)), abs=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((one.get(w, 0) + 1) / (n + len(one) + 1)) for w in t[1:]), abs=1e-9)
    held = [r for r in got.values() if r.held_out]
    # words and one unknown: after each history the probabilities add up to one
    for h in [None, b"kaban", b"podjat", b"never seen"]:
        assert sum(p(h, w) for w in [*one, b"unknown"]) == pytest.approx(1, abs=1e-12)
    assert held


def test_odd_rows(spark):
    got = katz.scored(odd_documents(spark)).collect()
    assert len(got) == 11 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == [1, 5] and all(r.held_out for r in got if r.doc_id is None)
    assert katz.scored(no_documents(spark)).count() == 0


def test_packing():
    for a in ([], [0], [5, 5, 5], [-3, 1 << 62, -(1 << 62)], list(range(1000, 5000, 7))):
        for delta in (False, True):
            assert katz.unpack(katz.pack(np.array(a, np.int64), delta)).tolist() == a


def test_discounts_fall_back():
    assert katz.discounts([0] * 6, 0.5) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]
    assert all(0 < x < 1 for x in katz.discounts([1000, 400, 200, 120, 80, 60], 0.5))
