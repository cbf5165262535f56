import random

import pytest

LETTERS = "abcdefghijklmnop"


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, blanks, copies, near copies, a very long one and odd white space."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(LETTERS) for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(60, 120))) for _ in range(12)]
    out = [None, "", "  \t\n", "one", "One two", "one TWO", "x y z", "a b\x0b c\x1cd", *base, base[0], base[0].upper(), base[1]]
    for b in base[:5]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(r.randint(1, 3)):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    out += [" ".join(word() for _ in range(9000)), "same line here\n" * 40 + "tail", "the cat sat " * 30, "é" * 3000, "x" * 20000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with two repeated rows, a null id, null sources, and columns whose names clash with those in use."""
    rows = [(k * 3, t, "en", f"s{k % 4}" if k % 7 else None, len(t or ""), k, f"r{k}") for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id at all", "en", "s1", 12, 1, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, row string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def mirrored():
    """A Thue-Morse word of a and b, and its complement: equal under every polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})
