"""Small tables with nulls, empty and very long texts, repeated rows and columns whose names clash with the operators' own."""

import random

CLASHES = ", key long, size long, rep long, component_id long, label int, bucket int, block int, score double, n_tokens long"
#: Names that the pipeline's stages once used or use now.
MORE_CLASHES = ", __n long, __of long, __gone long, __toxic double, id long, row long, n long, body long, copies long, labels long, ids long, decoded long, part long"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
EXTRA = (7, 7, 7, 7, 7, 7, 7, 7.0, 7)

WORDS = [a + b for a in "ka lo mi nu se ti ra po".split() for b in "ban den fil gor hum jat".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(spark, clashes: bool = True):
    long = "Wort " * 40_000
    rows = [
        (1, "one two three four", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \t\n ", "en", None, 3), (5, long, "de", "b", 9),
        (6, "word", "en", "a", 4), (6, "word", "en", "a", 4), (7, "word", "en", "c", 4), (None, "one two three four", "en", "a", 1), (None, None, None, None, None), (8, "漢字 ñandú 😀  x", "es", "b", 3),
    ]
    if not clashes:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([r + EXTRA for r in rows], DOCS + CLASHES)


def no_documents(spark):
    return spark.createDataFrame([], DOCS + CLASHES)


def family_of(rng: random.Random, n: int, words: int, changes: int) -> list[str]:
    """Near copies of one text, each with a few words changed."""
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out
