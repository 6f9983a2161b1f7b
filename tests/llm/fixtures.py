"""Small inputs with every awkward case: nulls, empty and long texts, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bands int, length int, root int"


def rows(extra: list | None = None, n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts: list = []
    for _ in range(n):
        texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 220))))
    for k in range(0, n, 4):  # near copies, some under the threshold
        w = texts[k].split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, None, "", "  \n\t ", "one", "ONE", "two words", "é" * 50, "long " * 9000]
    texts += list(extra or [])
    out = [(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)]
    return out + [out[5], out[5]]


def frame(spark, extra: list | None = None, **more):
    return spark.createDataFrame(rows(extra, **more), SCHEMA).repartition(3)
