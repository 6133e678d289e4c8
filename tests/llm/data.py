"""Small tables with the odd cases that every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(3000)]


def odd_texts() -> list[str | None]:
    """Copies, near copies, shared passages, periodic and empty texts."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) for _ in range(300)) for _ in range(8)]
    texts: list[str | None] = []
    for b in base:
        texts.append(b)
        w = b.split()
        for _ in range(3):
            v = w[:]
            for _ in range(4):
                v[rng.randrange(len(v))] = f"zz{rng.randrange(9999)}"
            texts.append(" ".join(v))
        at = rng.randrange(150)
        passage = " ".join(w[at : at + rng.randrange(30, 130)])
        texts.append(" ".join(rng.choice(WORDS) for _ in range(70)) + f" {passage}\n\n tail " + " ".join(rng.choice(WORDS) for _ in range(20)))
    long_text = " ".join(rng.choice(WORDS) for _ in range(4000)) + " " + base[5]
    return texts + [
        base[0], base[0], base[3] + " x", "a" * 1500, "b " * 600, "ab" * 700, "", None, "   ", "é" * 500, "short",
        " ".join(["rep"] * 90), ("abc def " * 3 + "\t") * 40, long_text,
    ]


def odd_docs(spark: SparkSession) -> tuple[DataFrame, list[tuple]]:
    """Documents with null ids, texts and sources, repeated rows and extra columns."""
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "s1", "s2", "s3")[i % 4], len(t or "")) for i, t in enumerate(odd_texts())]
    rows += [rows[0], (None, rows[0][1], "en", "s1", 3), (1000, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df, rows


def with_extras(df: DataFrame) -> DataFrame:
    """Columns whose names the operators use for themselves."""
    names = ["score", "kept", "h1", "h2", "k1", "k2", "class", "bucket", "size", "target", "state", "lead", "n_lines", "n_removed", "_drop", "part"]
    return df.selectExpr("*", *[f"'x' AS {n}" for n in names])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
