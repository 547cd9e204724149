"""Rows that every operator over documents must take: nulls, empty and long texts, a very long word, very many lines, repeats, and columns whose names clash with its own."""

import random

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(random.Random(2).choice(["alpha", "beta", "gamma", "Ünï", "δέλτα", "1234", "x!"]) for _ in range(20_000))
TEXTS = [None, "", " ", "\n\n", "one", "two words", "a line\nanother line\n", "日本語 テスト 🤖 x", "tab\tand  double space", "\x00\x01 odd", LONG, "one", "▁ mark ▁", "w" * 100_000, "\n".join(f"line {n}" for n in range(8_000))]


def rows():
    out = [(n, t) for n, t in enumerate(TEXTS)]
    return out + [(4, "one"), (None, "one"), (None, None), (5, "another text for an id that is there")]


def frame(spark, found=None):
    schema = "doc_id long, text string, key int, id string, node int, size int, seed int, text_hash string, score string, start string, spans int, label int"
    made = [(d, t, 7, "x", 1, 2, 3, "h", "s", "st", 5, 6) for d, t in (rows() if found is None else found)]
    return spark.createDataFrame(made, schema).repartition(3)


def empty(spark):
    return frame(spark).where("false")
