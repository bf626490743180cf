"""Permutations of the numbers 0 … n − 1 by arithmetic alone: each number's place follows from the number and a key.

Numbers below m = a · b, with a the root of n and b = n div a, are pairs of two digits; a round adds a hash of one digit
to the other, which can be undone, so any rounds are a permutation of the m numbers. Fewer than a numbers are left over;
the same rounds over the last m numbers mix them in. Nothing is sorted, looked up or tried again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

ROUNDS = 6
_WORD = 1 << 31


def shape(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n))
    return a, max(1, n // a)


def steps(number: str, key: str, n: int | str, a: int | str, b: int | str, prefix: str, div: str = "div") -> list[tuple[str, str]]:
    """Named SQL expressions, each over the ones before; the last is the number's place.

    ``number`` (a long in 0 … n − 1) and ``key`` are column names; n, a and b (see ``shape``) are numbers or columns.
    ``div`` is the engine's whole-number division.
    """
    m = f"{a} * {b}"
    out: list[tuple[str, str]] = []

    def add(name: str, sql: str) -> str:
        out.append((f"{prefix}{name}", sql))
        return f"{prefix}{name}"

    at = number
    for half, low in enumerate(("0", f"({n} - {m})")):
        inside = f"({at} >= {low} AND {at} < {low} + {m})"
        shifted = f"({at} - {low})"
        high, digit = add(f"h{half}", f"{shifted} {div} {b}"), add(f"d{half}", f"{shifted} % {b}")
        for t in range(ROUNDS):
            other = digit if t % 2 == 0 else high
            salt = f"({key} * 40503 + {69621 * (t + ROUNDS * half) + 12345}) % {_WORD}"
            mixed = f"(((({other} % {_WORD}) * 1103515245 + {salt}) % {_WORD}) {div} 256)"
            if t % 2 == 0:
                high = add(f"h{half}{t}", f"({high} + {mixed}) % {a}")
            else:
                digit = add(f"d{half}{t}", f"({digit} + {mixed}) % {b}")
        at = add(f"p{half}", f"CASE WHEN {inside} THEN {high} * {b} + {digit} + {low} ELSE {at} END")
    return out


def permuted(df: DataFrame, number: str, key: str, n: int, name: str) -> DataFrame:
    """Adds ``name``: the place of ``number`` in the permutation that the long ``key`` (0 … 2^20) selects."""
    made = steps(number, key, n, *shape(n), "_perm_")
    # Later expressions read earlier ones of the same list.
    out = df.selectExpr("*", *[f"{sql} AS {alias}" for alias, sql in made])
    # Never null, and said so: else a join by it would push a test for null through all steps, each copied into the next.
    return out.withColumn(name, F.coalesce(made[-1][0], F.lit(0).cast("long"))).drop(*[alias for alias, _ in made])
