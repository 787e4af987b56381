"""Texts for the tests of this folder."""

import random

WORDS = "river stone amber quiet lantern meadow copper violet harbor winter signal garden marble thunder silver canyon".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "Ünïcödé ΣΑΣ İstanbul 漢字 😀\x1c\x85\xa0end",
    "<|endoftext|>x<|startoftext|> </s><s> ▁▁a",
    "a" * 3000,
    prose(1, 30_000),
    "line\r\nline\n\n  line  \n",
    prose(2, 60),
    prose(2, 60),
]
