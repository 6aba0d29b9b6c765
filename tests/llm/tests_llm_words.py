"""Invented words for the tests."""

import random


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(3000)}" for _ in range(n)]
