from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["an", "ther", "ing", "ou", "wo", "re", "st", "li", "qua", "né", "ß", "ta"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies and a shared passage."""
    shared = prose(99, 60)
    long = prose(5, 30_000)
    near = prose(7, 300).split()
    near[150] = "changed"
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, prose(1, 200)), (7, prose(1, 200)), (7, prose(1, 200)), (8, long), (9, f"{prose(2, 80)} {shared} {prose(3, 80)}"),
        (10, f"{prose(4, 50)}\n{shared}"), (11, "a" * 3000), (12, "ab" * 1500), (13, prose(7, 300)), (14, " ".join(near)), (15, "é" * 400 + prose(8, 50)), (16, prose(9, 100).upper()), (None, prose(10, 90)), (None, None),
        (17, prose(11, 120) + "\x00" + prose(12, 20)), (18, "token <|endoftext|> and 1²  　x"), (19, prose(13, 4)), (20, f"{shared}"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names the operators also use."""
    from pyspark.sql import functions as F

    return docs.select("*", F.lit(1).alias("key"), F.lit("x").alias("score"), F.lit(2).alias("shard"), F.lit("y").alias("fp"), F.lit(0).alias("rank"), F.lit(3).alias("block"), F.lit("z").alias("ids"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names: str) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
