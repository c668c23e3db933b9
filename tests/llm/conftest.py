import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, bands string, window string"


def _rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    texts = [prose(rng.randint(25, 160)) for _ in range(40)]
    base, passage = prose(120), prose(30)
    for k in range(6):  # near copies: one word differs
        words = base.split()
        words[10 * k + 5] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0]] * 4 + [prose(20) + " " + passage + "\n" + prose(25) for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "one two", "zwei drei vier", "x" * 300, "a " * 400, "é ü ñ " * 60, "\x00\x1f" * 40]
    texts += ["same line here\n" * 12, "THE UPPER CASE TEXT " * 30, "sym### bol*** $$$ && | " * 40, prose(9000)]
    texts += ["word\u00a0with\u2003odd\u3000spaces\u0085 and <|endoftext|> <|im_end|> \\ <\\| end", passage]
    langs = ["en", "de", None, "xx"]
    rows = [(k, t, langs[k % 4], f"src{k % 3}" if k % 7 else None, None, 1, "b", "w") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[1], None, None, None, None, None, None), (None, None, "en", "src1", 0, 0, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
