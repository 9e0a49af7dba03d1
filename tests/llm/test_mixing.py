import random

import numpy as np
import pytest

from auditlake.llm import mixing
from llm_helpers import no_documents, odd_documents, sentence


def water(sizes: list[int], weights, share, most):
    """Reshare the excess until no target is above ``most`` times its source."""
    w, cap = np.resize(np.array(weights, float), len(sizes)), np.array(sizes, float) * most
    out, left, free = np.zeros(len(sizes)), share * sum(sizes), np.ones(len(sizes), bool)
    while left > 1e-9 and free.any():
        out[free] += left * w[free] / w[free].sum()
        left = np.maximum(out - cap, 0).sum()
        out = np.minimum(out, cap)
        free = out < cap
    return out


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    sources = ["b", "a", "é", "zz", "Z", None]
    rows = [(i, sentence(rng, rng.randrange(0, 60)), "en", rng.choice(sources), 0) for i in range(900)] + [(5000, "a b", "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = mixing.decisions(docs, block=16).collect()
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in order}
    targets = dict(zip(order, water([size[s] for s in order], (3, 1, 2), 1.5, 2), strict=True))
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert all(r.target == pytest.approx(targets[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= 60  # less than one document
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in got)
    again = mixing.decisions(docs.repartition(7), block=16).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_pivots_keep_expectations():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 50, 12), rng.uniform(0.1, 0.9, 12)
    runs = np.stack([mixing.pivot(size, part, rng.uniform(size=12)) for _ in range(20_000)])
    assert ((runs == 0) | (runs == 1)).sum(1).min() >= 11
    assert np.abs(runs.mean(0) - part).max() < 0.02
    assert np.abs(runs @ size - part @ size).max() < 1e-6  # words are only handed over


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.decisions(docs).collect()
    assert len(got) == 11 and all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[(r.doc_id, r.source)] = counts.get((r.doc_id, r.source), 0) + 1
    wanted = {}
    for r in got:
        wanted[(r.doc_id, r.source)] = wanted.get((r.doc_id, r.source), 0) + r.copies
    assert counts == {k: v for k, v in wanted.items() if v}
    assert mixing.decisions(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0
