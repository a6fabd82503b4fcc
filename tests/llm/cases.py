"""A table with every awkward row, and plain Python versions of the text rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Extra columns whose names the operators use inside.
CLASHES = ["row", "uid", "key", "size", "kept", "name", "id", "data", "head", "fp", "rep", "copy", "start", "ids", "batch", "rate", "copies", "u", "toxic", "quality", "l", "words", "gone_id", "text_hash", "of", "turn", "is_toxic", "part", "place", "sub", "nth", "of_text", "s", "tilt", "bin"]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["lot", "batch", "value", "the", "of", "review", "Größe", "été", "seal", "x9"]) + rng.choice(["", ",", ".", "s"]) for _ in range(n))


def awkward(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    long = sentence(rng, 30_000)
    texts: list[str | None] = [None, "", "", " \t\n", "word", "two words", long, long, long + " end", "é" * 50, "A B C", "a b c", "x" * 9000, "x" * 8999 + "y", "\x0b\x0c a\x1cb c", "日本語 テキスト", "<|endoftext|> x", "don't 's THE. end., ok"]
    texts += [sentence(rng, rng.randint(3, 200)) for _ in range(25)]
    texts += [f"{sentence(rng, 10)} {shared} {sentence(rng, 10)}" for _ in range(6)] + [shared, shared + " more"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "ü", None])) for i, t in enumerate(texts)]
    rows.append((None, "no id", "en", "a"))
    rows.append((None, None, None, None))
    return rows


def frame(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]) if clashes else df
