import random

import pytest

WORDS = [f"w{i}" for i in range(300)]


def make_texts(seed=0):
    """Small texts with copies, near copies, shared passages, odd characters, and empty ones."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, long = say(70), say(400)
    texts = [say(rng.randrange(1, 140)) for _ in range(30)]
    texts += [f"{say(20)}\n{passage}\t{say(15)}" for _ in range(5)]
    texts += [long, long, long.replace("w1", "w2"), long.upper(), long[:1500]]
    near = say(120).split(" ")
    for _ in range(8):
        other = list(near)
        other[rng.randrange(120)] = "new"
        texts.append(" ".join(other))
    texts += ["", " ", "\n\n", "a", "a b", "A B", "a b c d", "ÄÖ  ü x", "x" * 5000, "the " * 800, None, "<|endoftext|> a\x1cb", "▁a ▁", "😀 é"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with an extra column whose name the operators use inside."""
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}" if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
