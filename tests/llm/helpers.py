import random


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(n))
