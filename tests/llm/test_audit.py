import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np

from auditlake.llm import audit
from llm_helpers import DOCS, no_documents, odd_documents, sentence

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng: random.Random):
    """Texts that fail any mixture of the filters."""
    texts = ["", None, "A", "x " * 50, "\x0b\x0ca\rb"]
    for _ in range(250):
        t = sentence(rng, rng.choice([3, 49, 50, 80]))
        t = t + " " + " ".join(t.split()[:1] * rng.choice([0, 0, 60]))
        t = t.upper() if rng.random() < 0.3 else t.replace("a", "A", rng.randrange(9))
        texts.append(t.replace(" ", rng.choice([" ", "\n", "\t ", "\xa0 "]), 9) + rng.choice(["", " #", "|", "é"]))
    texts += rng.choices(texts, k=150)
    rows = [(i, t, "en", rng.choice(["a", "a", "b", "", None]), 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, "x " * 50, "en", "a", 1), (None, None, None, None, None), (3, "another text of the same id", "en", "a", 1)]


def by_running(rows, labels):
    """Every order applied filter by filter."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails, parts, marks = [], [], {}
    for i, q, x in labels:
        a = marks.get(i, (0, 0))
        marks[i] = (max(a[0], int(q == 1)), max(a[1], int(x == 1)))
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails.append({x for x, bad in found.items() if bad} | ({"E"} if i is not None and first[t] < i else set()))
        parts.append(source or "")
    out, shares = {}, Counter()
    for part in set(parts):
        mine = [k for k in range(len(rows)) if parts[k] == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                redundant = sum(f in fails[k] for k in mine) - len(gone)
                mark = [marks.get(rows[k][0], (0, 0)) if rows[k][0] is not None else (0, 0) for k in gone]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(fails[k] == {f} for k in mine), sum(m[0] for m in mark), sum(m[1] for m in mark)]
                shares[part, f] += len(gone)
    return {(*key, *value, shares[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def test_equals_running_every_order_and_its_sql(spark):
    rng = random.Random(4)
    rows = corpus(rng)
    marked = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(400), 200)]
    marked += [(marked[0][0], 1, 0), (None, 1, 1), (99_999, 1, 1)]
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(marked, LABELS)
    got = [tuple(r) for r in audit.interactions(docs, labels).collect()]
    assert len(got) == len(set(got)) == 600 * 3
    assert set(got) == by_running(rows, marked)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    assert set(con.sql(audit.interactions_sql()).fetchall()) == set(got)


def test_contraction_picks_cells():
    t = np.arange(32).reshape(1, 2, 2, 2, 2, 2)
    assert audit.contract(t, [audit._FAIL, audit._PASS, audit._PASS, audit._PASS, audit._FAIL])[0] == 17
    assert audit.contract(t, [audit._ALL] * 5)[0] == 31 * 16


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    got = audit.interactions(odd_documents(spark), labels).collect()
    assert len(got) == 600 * 4 and {r.part for r in got} == {"", "a", "b", "c"} and all(r.kept + r.removed >= 0 for r in got)
    assert audit.interactions(no_documents(spark), labels).count() == 0
    nobody = audit.interactions(odd_documents(spark), labels.where("false")).collect()
    assert sum(r.good_lost for r in nobody) == 0 and len(nobody) == 600 * 4
