import random

import numpy as np

from auditlake.llm import toxicity
from llm_helpers import EXTRA, CLASHES, DOCS, no_documents, odd_documents, sentence

LABELS = "doc_id long, label int"


def test_learns_words_inflections_and_pairs(spark):
    """Toxic: an insult, in any inflection, or two words that are harmless alone."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        kind = i % 8
        words = sentence(rng, rng.randrange(5, 80)).split()
        if kind == 0:
            words.insert(rng.randrange(len(words)), "Grobsatz,")
        if kind == 1:
            words.insert(0, "schimpf" + rng.choice("abcdefghijklmn") + rng.choice("abcdefghijklmn"))
        if kind in (2, 3):
            words.insert(rng.randrange(len(words)), "jene")
        if kind in (2, 4):
            words.insert(rng.randrange(len(words)), "furchtbar")
        rows.append((i, " ".join(words), "en", "a", 1) + EXTRA)
        labels.append((i, int(kind in (0, 1, 2))))
    docs, labels = spark.createDataFrame(rows, DOCS + CLASHES), spark.createDataFrame(labels, LABELS)
    got = toxicity.scored_documents(docs, labels, toxicity.Settings(lift=1.5)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 2400 and 350 < len(held) < 650
    assert np.mean([r.predicted == (r.doc_id % 8 in (0, 1, 2)) for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    w, v, ids = rng.normal(size=9), rng.normal(size=(9, 3)), np.array([1, 4, 7, 8])
    pairs = sum(v[i] @ v[j] for n, i in enumerate(ids) for j in ids[n + 1 :])
    assert np.isclose(toxicity._raw(0.5, w, v, ids), 0.5 + w[ids].sum() + pairs)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 1), (6, 0), (99, 1)], LABELS)
    got = toxicity.scored_documents(odd_documents(spark), labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    nobody = toxicity.scored_documents(odd_documents(spark), labels.where("false")).collect()
    assert {r.score for r in nobody} == {0.5}
    assert toxicity.scored_documents(no_documents(spark), labels).count() == 0


def test_learns_neutral_partners_with_default_settings(spark):
    """An insult is toxic only beside a mention that is as frequent in clean texts; harmless words with a lift below 3 count, too."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        kind, words = i % 10, sentence(rng, rng.randrange(5, 60)).split()
        for word, kinds in (("spitzwort", (0, 1)), ("nachbarn", (0, 3, 4, 5, 6)), ("grobsatz", (2,))):
            if kind in kinds:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en", "a", 1) + EXTRA)
        labels.append((i, int(kind in (0, 2))))
    docs, labels = spark.createDataFrame(rows, DOCS + CLASHES), spark.createDataFrame(labels, LABELS)
    held = [r for r in toxicity.scored_documents(docs, labels).collect() if r.held_out]
    for kinds in ((0, 1), range(10)):
        some = [r for r in held if r.doc_id % 10 in kinds]
        assert len(some) > 80 and np.mean([r.predicted == (r.doc_id % 10 in (0, 2)) for r in some]) >= 0.97


def test_pairs_of_harmless_words_with_default_settings(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2400):
        kind, words = i % 8, sentence(rng, rng.randrange(5, 80)).split()
        for word, kinds in (("grobsatz", (0, 1)), ("jene", (2, 3)), ("furchtbar", (2, 4))):
            if kind in kinds:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en", "a", 1) + EXTRA)
        labels.append((i, int(kind in (0, 1, 2))))
    docs, labels = spark.createDataFrame(rows, DOCS + CLASHES), spark.createDataFrame(labels, LABELS)
    held = [r for r in toxicity.scored_documents(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 in (0, 1, 2)) for r in held]) >= 0.97
