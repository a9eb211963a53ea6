import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, sentences: int = 12) -> str:
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(sentences))


def near(text: str, seed: int) -> str:
    """The text with one word changed."""
    words = text.split(" ")
    words[random.Random(seed).randrange(len(words))] = f"changed{seed}"
    return " ".join(words)


CLASHING = ("n_words", "kept", "position", "node", "n_sentences", "id", "rank", "covered", "c_id", "c_hash", "__hash", "__h", "__times", "__id", "__k", "__text", "__row", "h", "w", "text_hash", "times", "found", "from")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use for columns of their own
    + [T.StructField(n, T.StringType()) for n in CLASHING]
)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, near and exact copies, ties, repeated rows, white space and other scripts."""
    base, passage = prose(1, 30), prose(2, 8)
    texts = [None, "", " \n\t ", "one", "a b c", base, base, near(base, 3), near(base, 4), prose(5) + " " + passage, prose(6) + "\n" + passage, prose(7, 4000), "the. " * 400, "日本語 テスト 文", "naïve café x\r\n\r\ny  z", "<|endoftext|> it's", "x" * 50_000]
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, prose(8), None, None, None), (None, prose(8), None, None, None), (None, None, None, None, None), (40, prose(9), "fr", None, 5), (40, prose(9), "fr", None, 5), (40, prose(10), "fr", "\U0001f600", 5)]
    return [(*r, *["clash"] * 6, None, *[f"clash{k}" for k in range(len(CLASHING) - 7)]) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """{doc_id: text} of the small documents."""
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
