import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r + (None, None))[:4] + (len(r[1]) if r[1] is not None else None,) for r in map(tuple, rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def texts():
    """A small corpus with copies, near copies, repeated lines, junk, empty and null texts, hot lines and a long text."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    vocabulary += "the of and to in is that it".split() * 20

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    out = [line(12) + "\n" + line(rng.randint(20, 90)) + "\n" + line(9) for _ in range(60)]
    for i in range(0, 30, 3):
        w = out[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [out[5], out[5], "The hot line of all.\n" + out[7], "The hot line of all.\n" + out[8], "One\nOne\n\n \nTwo two"]
    out += [None, "", "   \t\n", "a", "a b c", "A B C", "é ü 中文 😀 x", "x* y# | z " * 30, "again " * 80]
    out.append(" ".join(line(50) for _ in range(40)))
    return out
