"""Documents that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words string, kept boolean, score double, spans string, m int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta.", "épsilon", "zeta\nnext", "of", "the"]) + rng.choice(["", "", "", str(rng.randint(0, 99))]) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(7)
    out: list[str | None] = [None, "", " ", "one", "a b c d", "x" * 70_000, "word " * 9000, "日本語 テキスト ß Ünï\t\x0b\r\n 𝒜𝒜", "\n\n\n", "<|endoftext|> odd  spaces “quoted” 's"]
    out += [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    out += [out[12], out[12], out[13] + " end"]
    return out


def rows() -> list[tuple]:
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 1, "x", True, 0.5, "y", 3) for i, t in enumerate(texts())]
    return [*out, out[15], (None, "null id text here", None, None, None, None, None, None, None, None, None), (None, "null id text here", None, None, None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
