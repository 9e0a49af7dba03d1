import random

import numpy as np
import pytest

from auditlake.llm import minhash, stages
from auditlake.llm.stages import components
from llm_helpers import family_of, no_documents, odd_documents, sentence

SETTINGS = minhash.Settings(width=2, block=8)


def by_force(texts: dict[int, str], width: int, percent: int = 80) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rng = random.Random(width)
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(60)]
    texts += family_of(rng, 40, 120, 4) + family_of(rng, 30, 200, 6) + family_of(rng, 20, 30, 1) + ["same text again"] * 30
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = minhash.near_duplicates(frame, minhash.Settings(width=width, block=8)).collect()
    assert {r.doc_id: r.component_id for r in got} == by_force(docs, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_threshold_is_exact(spark):
    """4 of 5 shingles in common link, a little less does not."""
    a = [f"w{i}" for i in range(41)]  # 40 shingles of two words
    near = a[:37] + ["x", "y", "z", "q"]  # 36 in common, 44 in all: 81.8 %
    far = a[:36] + ["x", "y", "z", "q", "p"]  # 35 of 45: 77.8 %
    frame = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(far[:-5] + ["k", "l", "m", "n", "o"]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, SETTINGS).collect()} == {1: 1, 2: 1, 3: 3}


def test_odd_rows(spark):
    got = minhash.near_duplicates(odd_documents(spark), SETTINGS).collect()
    assert len(got) == 11
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert (2, 0, 2, True) in rows and (3, 0, 3, True) in rows and (4, 0, 4, True) in rows
    assert rows.count((6, 1, 6, True)) == 2 and (7, 1, 6, False) in rows
    assert (5, 1, 5, True) in rows and (0, 3, None, True) in rows and (0, 0, None, True) in rows
    assert minhash.near_duplicates(no_documents(spark), SETTINGS).count() == 0


def test_deduplicated_keeps_columns_and_rows_without_id(spark):
    docs = odd_documents(spark)
    left = minhash.deduplicated(docs, SETTINGS)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 2 and sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 6, 8]


def test_sketches_estimate_similarity():
    s, rng = minhash.Settings(), np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    one, two = (np.r_[both, rng.integers(0, 1 << 63, 100).astype(np.uint64)] for _ in range(2))
    maps = minhash.sketches(np.stack([minhash.minima(x, s) for x in (one, two)]), s)
    apart = np.bitwise_count(maps[0] ^ maps[1]).sum()
    estimate = 1 + s.sketch_bits / (4 * s.samples) * np.log(1 - 2 * apart / s.sketch_bits)
    assert abs(estimate - 900 / 1100) < 0.08


@pytest.mark.parametrize("lot", [10, 100_000])
def test_components_of_chains_and_stars(spark, lot):
    """In one task and by rounds, with centres that are met by broadcast and chains across the tasks."""
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 540)] + [(539, x) for x in range(510, 530)] + [(9, 9)]
    rng.shuffle(links)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), lot).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)}
    assert components(spark.createDataFrame([], "a long, b long"), lot).count() == 0


def test_large_family_stays_linear(spark, monkeypatch):
    """Rows, and links that reach the components, grow with the documents of one group of near copies, not with their square."""
    sizes = {}

    def counted(df, name):
        out = stages.stage(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    rng, seen = random.Random(7), []
    for n in (150, 600):
        sizes.clear()
        docs = dict(enumerate(family_of(rng, n, 100, 3) + [sentence(rng, 30) for _ in range(40)]))
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(8)
        got = minhash.near_duplicates(frame, minhash.Settings(width=2, block=16)).collect()
        assert {r.doc_id: r.component_id for r in got} == by_force(docs, 2)
        seen.append((sizes["hits"], sizes["related"]))
    assert seen[1][0] <= 5 * seen[0][0] and seen[0][1] <= 3 * 150 and seen[1][1] <= 3 * 600


def test_buckets_that_fall_apart_keep_their_links(spark):
    """Several families that share much of their text: blocks meet in a ring first, what stays apart then meets all of the bucket."""
    rng = random.Random(12)
    common = sentence(rng, 90).split()
    texts = []
    for _ in range(12):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        for _ in range(10):
            words = common + own
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = minhash.near_duplicates(frame, minhash.Settings(width=2, block=4, gate=0.78)).collect()
    assert {r.doc_id: r.component_id for r in got} == by_force(docs, 2)


def test_an_id_with_several_texts_shares_their_links(spark):
    rng = random.Random(2)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (9, a + " end"), (7, b + " end"), (3, b), (8, c), (8, c)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), SETTINGS).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8), (9, 3)]


def test_the_filter_keeps_all_that_is_wanted(spark):
    rows = spark.range(3000).selectExpr("id as rep", "id * 7 as body", "'x' as text")
    wanted = rows.where("rep % 10 = 3").select("rep", "body")
    kept = minhash._likely(rows, wanted, ["rep", "body"])
    assert kept.columns == rows.columns
    ids = {r.rep for r in kept.collect()}
    assert {i for i in range(3000) if i % 10 == 3} <= ids and len(ids) < 310
    assert minhash._likely(rows, wanted.where("false"), ["rep", "body"]).count() == 0
