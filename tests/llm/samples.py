"""Made-up texts, and components by brute force."""

import random

WORDS = ["".join(random.Random(i).choices("abcdefghilmnoprstu", k=3 + i % 6)) for i in range(400)]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + ("." if draw.random() < 0.15 else "") for _ in range(words))


def groups(nodes, linked) -> dict:
    """Smallest node that each node reaches, by brute force."""
    lead = {n: n for n in nodes}

    def find(n):
        while lead[n] != n:
            n = lead[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {n: find(n) for n in nodes}
