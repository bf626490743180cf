"""Made-up texts."""


def prose(seed, n):
    """n made-up words, different for each seed."""
    return " ".join(f"w{seed}x{(k * k + 7 * seed) % 9973}" for k in range(n))
