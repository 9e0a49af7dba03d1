import math
import random
from collections import Counter

import numpy as np

from auditlake.llm import quality
from llm_helpers import CLASHES, DOCS, EXTRA, no_documents, odd_documents, sentence

LABELS = "doc_id long, label int"
S = quality.Settings(grams=(2, 3, 4), buckets=1 << 40)


def plain_features(word: str, grams) -> Counter:
    marked = f"<{word}>"
    return Counter([("word", word), *((n, marked[i : i + n]) for n in grams for i in range(len(marked) - n + 1))])


def test_features_are_the_word_and_its_n_grams():
    words = ["a", "banana", "<x>", "漢字漢字漢字", "é😀", "AAAA", "x" * 4096, *sentence(random.Random(1), 40).split()]
    ids, owner = quality.features([w.encode() for w in words], S)
    names = {}
    for i, w in enumerate(words):
        # each n-gram has one number, as often as it occurs
        mine, want = Counter(ids[owner == i].tolist()), plain_features(w, S.grams)
        assert sorted(mine.values()) == sorted(want.values())
        names[w] = set(mine)
    for a in words:
        for b in words:
            assert len(names[a] & names[b]) == len(plain_features(a, S.grams).keys() & plain_features(b, S.grams).keys())
    assert len(quality.features([], S)[0]) == 0


def test_bag_is_the_share_of_each_feature(monkeypatch):
    text = ("aa bb bb\tbb c \n" + "dd " * 30 + "e" * 9).encode()
    words = text.decode("utf-8").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    want = sum((plain_features(w, S.grams) for w in words), Counter())
    want["repeat"] = sum(a == b for a, b in zip(words, words[1:], strict=False))
    whole = quality.bag(text, S)
    assert np.allclose(sorted(whole[1]), sorted(x / sum(want.values()) for x in want.values()))
    monkeypatch.setattr(quality, "_PIECE", 7)  # read in pieces: the same bag
    pieces = quality.bag(text, S)
    assert np.array_equal(whole[0], pieces[0]) and np.allclose(whole[1], pieces[1])
    assert len(quality.bag(None, S)[0]) == len(quality.bag(b" \n", S)[0]) == 0
    monkeypatch.setattr(quality, "_LONGEST", 4)
    assert quality._counted(b"abcdefgh ij")[0] == {b"abcd": 1, b"efgh": 1, b"ij": 1}


def test_a_step_goes_down_the_gradient():
    s = quality.Settings(buckets=64, dimensions=3, epochs=1, rate=1e-3, grams=(3,))
    ids, share, rng = np.array([3, 9, 40]), np.array([0.5, 0.3, 0.2]), np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(64, 3)), rng.normal(size=(3, 2)), rng.normal(size=2), s)

    def loss(vectors, layer):
        return -math.log(quality.probabilities(quality.Model(vectors, layer, model.bias, s), ids, share)[1])

    rest = quality.probabilities(model, ids, share) - [0, 1]
    for at, slope in (((9, 1), share[1] * (model.layer @ rest)[1]), ((40, 2), share[2] * (model.layer @ rest)[2]), ((5, 0), 0.0)):
        moved = model.vectors.copy()
        moved[at] += 1e-6
        assert math.isclose((loss(moved, model.layer) - loss(model.vectors, model.layer)) / 1e-6, slope, abs_tol=1e-5)
    moved = model.layer.copy()
    moved[2, 0] += 1e-6
    assert math.isclose((loss(model.vectors, moved) - loss(model.vectors, model.layer)) / 1e-6, (share @ model.vectors[ids])[2] * rest[0], abs_tol=1e-5)
    # trained on one document over and over, its class wins
    trained = quality.train([(ids, share)], np.array([1]), quality.Settings(buckets=64, dimensions=3, epochs=200, rate=1.0))
    assert quality.probabilities(trained, ids, share)[1] > 0.95


def corpus(rng: random.Random, n: int):
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 120)).split()
        junk = i % 4 == 0
        if junk:
            kind = i % 12
            words = [f"{w}{rng.choice(['***', '&&&'])}" if kind == 0 else w.upper() + "!!" if kind == 4 else w for w in words]
            if kind == 8:
                words = [w for w in words for _ in range(rng.randrange(3, 9))]
        rows.append((i, " ".join(words), "en", "a", 1) + EXTRA)
        labels.append((i, int(not junk)))
    return rows, labels


def test_held_out_accuracy_and_scores_by_definition(spark):
    rows, labels = corpus(random.Random(9), 1500)
    docs, marks = spark.createDataFrame(rows, DOCS + CLASHES), spark.createDataFrame(labels, LABELS)
    got = quality.scored_documents(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1500 and 400 < len(held) < 600
    for junk in (True, False):
        some = [r for r in held if (r.doc_id % 4 == 0) == junk]
        assert np.mean([r.predicted == (not junk) for r in some]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    # a column's scores are the softmax of the averaged vectors; a second fit gives the same model
    model = quality.fit(docs, marks)
    again = quality.fit(docs.repartition(5), marks)
    assert np.array_equal(model.vectors, again.vectors)
    for r in docs.limit(40).select("text", quality.score(model, "text").alias("p")).collect():
        assert math.isclose(quality.probabilities(model, *quality.bag(r.text.encode(), model.settings))[1], r.p, abs_tol=1e-5)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 1), (6, 0), (5, 0), (99, 1)], LABELS)
    got = quality.scored_documents(odd_documents(spark), labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    nobody = quality.scored_documents(odd_documents(spark), labels.where("false")).collect()
    assert {r.score for r in nobody} == {0.5}
    assert quality.scored_documents(no_documents(spark), labels).count() == 0
