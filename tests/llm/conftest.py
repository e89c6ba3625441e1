import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with every odd case: nulls, empty and long texts, copies, repeats, clashing columns."""
    def build(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(a, b, c, d, None if b is None else len(b)) for a, b, c, d in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def clashing():
    """The table with columns that an operator might use for itself."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["kept", "size", "row", "chunk", "block", "shard", "cell", "component_id", "keep_id", "_id", "__id", "n", "key"]
        return df.select("*", *[F.lit("x").alias(n) for n in names])

    return add


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with copies, near copies and shared passages."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(30)]
    texts = []
    for i in range(120):
        words = [word() for _ in range(r.choice([0, 1, 4, 5, 12, 13, 40, 90]))]
        if i % 5 == 0:
            words[3:3] = passage[: r.choice([12, 13, 30])]
        texts.append(" ".join(words))
    for i in range(40):
        words = texts[r.randrange(len(texts))].split(" ")
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = word()
        texts.append("\n".join(words) if i % 7 == 0 else " ".join(words))
    texts += [None, "", "   ", " \n", "Ein süßes  Wort und\t😀 mehr. ", "long " * 20000]
    langs, sources = ["en", "de", None], ["a", "b", "c", None, "ö"]
    return [(i if i != 17 else -5, t, langs[i % 3], sources[i % 5]) for i, t in enumerate(texts)]
