import random

import pytest

WORDS = "the and of river stone light under window garden silver morning paper engine harbor village thunder candle mirror bridge copper forest winter kettle anchor".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, odd white space, null and empty ones, and one that is very long."""
    rng = random.Random(5)
    out: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(120)]
    hot = prose(rng, 60)
    out += [hot] * 90  # over a third of the rows
    out += [hot.replace(" ", "  ", 3), hot + "\n", hot.upper()]
    near = prose(rng, 400)
    for i in range(30):
        words = near.split()
        words[i * 7] = f"changed{i}"
        out.append(" ".join(words))
    out += ["", "", None, None, "   ", "one", "one two", "é" * 50, "日本語のテキスト", "<|endoftext|> here", prose(rng, 30_000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under shuffled ids, with columns whose names operators use inside."""
    rng = random.Random(6)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or ""), "x", 1.0, None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, shard string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
