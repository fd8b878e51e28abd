"""Texts with hard cases, and tables made of them."""

from __future__ import annotations

import random

LONG = " ".join(f"w{k}" for k in range(3000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "the", "of", "Kappa", "λ", "1234", "x"]
    plain = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    lines = ["\n".join(plain[k : k + 5]) for k in range(0, 20, 3)]
    near = [p.replace("alpha", "omega", 1) for p in plain[:10]]
    mixed = [PASSAGE, "intro " + PASSAGE + " end", f"one\n{PASSAGE}\ntwo", "a\nb\nc\nd", "x\na\nb\nc\ny", "a\na\na\na\na", "ab" * 120, "cd" + "ab" * 90, "é" * 80, "yé" * 30 + "é" * 60]
    odd = [None, "", "", " ", "\n", "\n\n", "x" * 3000, LONG, LONG, "a\x1cb\x85c　d", "\ttab  two\r\n", "end ", "🙂 ok 🙂"]
    return plain + plain[:6] + lines + near + mixed + odd


def documents(spark, extra: list[tuple] = ()):
    """doc_id, text, lang, source, n_chars, with clashing names, a repeated row, a repeated id and a null id."""
    rows = [(k, t, "en" if k % 2 else None, None if k % 17 == 0 else f"s{k % 3}", 1, "mine", 5) for k, t in enumerate(texts())]
    rows += [rows[3], (3, "another text under the same id", "en", "s0", 1, "mine", 5), (None, rows[0][1], "en", "s0", 1, "mine", 5), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, batch string, n_removed int").repartition(3)
