import hashlib
import random
import re

import duckdb
import pytest

from auditlake.llm import fim
from llm_helpers import DOCS, no_documents, odd_documents, sentence


def by_definition(doc_id, text, rate=100, spm=50):
    """Form, lengths and output from slices of the lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    rng = random.Random(8)
    out = ["", None, "\n", "\n\n\n", "one line", "ends\n", "\nbegins", "holds <S> one", "<P\n>", "<", "<M", "P>\n<", "é\n漢字\n😀 ñ\r\nx y\x0bz", "a\n" * 5000]
    for _ in range(150):
        lines = [sentence(rng, rng.randrange(0, 12)) + rng.choice(["", "é", "<", "P>", "\r"]) for _ in range(rng.randrange(0, 30))]
        out.append("\n".join(lines) + rng.choice(["", "\n"]))
    return out


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 20), (0, 50), (100, 0), (100, 100)])
def test_texts_as_defined_and_back(rate, spm):
    s = fim.Settings(rate=rate, spm=spm)
    forms = set()
    for i, t in enumerate(some_texts()):
        n, form, prefix, middle, output = fim.transform_text(i, (t or "").encode(), s)
        assert (n, form, prefix, middle, output.decode()) == by_definition(i, t, rate, spm)
        assert fim.restore_text(output, form, s) == (t or "").encode()
        forms.add(form)
    assert len(forms) >= {0: 1, 50: 3, 20: 3, 100: 2}[spm if rate else 0]


def test_rotation_of_blocks_longer_than_a_slice():
    rng = random.Random(1)
    for size in (0, 1, 2, 7, 300_000):
        data = rng.randbytes(size)
        for cut in {0, size // 3, size}:
            buffer = bytearray(b"ab" + data + b"c")
            fim.rotate(buffer, 2, 2 + cut, 2 + size)
            assert buffer == b"ab" + data[cut:] + data[:cut] + b"c"


def test_query_equals_its_sql(spark):
    rows = [(i * 3, t, "en", "a", 1) for i, t in enumerate(some_texts())] + [(None, "x\ny\nz", "en", "a", 1), (5, "same\nid", "en", "a", 1), (5, "same\nid", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    documents = docs.toArrow()  # noqa: F841, read by the SQL
    got = sorted(map(tuple, docs.transform(fim.digests).collect()), key=str)
    assert got == sorted(duckdb.sql(fim.digests_sql()).fetchall(), key=str) and len(got) == len(rows)


def test_odd_rows(spark):
    got = fim.transformed(odd_documents(spark)).collect()
    source = {(r.doc_id, r.text or "") for r in odd_documents(spark).collect()}
    assert len(got) == 11
    back = fim.transformed(odd_documents(spark)).select("doc_id", fim.restored("output", "form").alias("text")).collect()
    assert {(r.doc_id, r.text) for r in back} == source
    assert {r.form for r in got if r.output == ""} == {"plain"}
    assert fim.digests(no_documents(spark)).count() == 0
