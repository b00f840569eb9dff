"""Small documents for the tests: copies, near copies, repeats, nulls, odd blanks, a long text."""

from __future__ import annotations

import random

#: Columns whose names the operators use themselves.
EXTRA = "key string, tag string, label string, places string, n_words string, shard string, bucket string, score string, token string, text2 string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng: random.Random, n: int, of: int = 400) -> list[str]:
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 70, 10_000)
    texts: list[str | None] = []
    for k in range(n):
        body = words(rng, rng.randrange(1, 120))
        if k % 6 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passage[rng.randrange(10) :]
        texts.append(" ".join(body))
    base = words(rng, 150, 10_000)
    for k in range(10):  # near copies, some further away than others
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[-1], "", None, " \n\t ", "one", "one two", "One  TWO", "a b c a b c a b c a b c", "\x0b\x0cé ñ\x1c\x85x\xa0  y  z\r\n\r\n end "]
    texts += [" ".join(passage * 3), " ".join(words(rng, 9000)), "Line one here.\nLine one here.\n\n  \nLine two"]
    out = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[2], out[2], (None, "no key here " * 12, None, None, None), (None, None, None, None, None)]
    return [(*r, *["z"] * 10) for r in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
