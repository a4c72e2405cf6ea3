"""A small table with every awkward case: NULLs, empty, long, tied, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, kept string, row string, fp string"


def rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "Beta,", "gamma.", "delta!", "épsilon", "zeta;", "eta", "theta", "iota", "kappa", "Lambda", "mu", "3.5", "km", "Nu's", "日本", "ö́x"]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(n))

    passage = " ".join(f"shared{i}" for i in range(60))
    bodies = [None, "", " \n\t ", "one", text(40), text(200), text(4000), passage, text(30) + passage + " " + text(30), passage.upper() + " " + text(20)]
    bodies += [text(rng.randrange(0, 120)) for _ in range(40)]
    bodies += [bodies[5]] * 6 + [bodies[5][:-40] + " changed"] * 2 + [text(15) + passage + text(5) for _ in range(5)]
    out = [(i * 3 % 101, b) for i, b in enumerate(bodies)]
    out += [(None, passage + " tail"), (None, None), out[6], out[6], (5000, "a\u0000b <|endoftext|> c<|startoftext|>")]
    return [(i, b, "en", None if n % 3 else "src0", len(b or ""), "x", "y", "z", "w") for n, (i, b) in enumerate(out)]


def table(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)
