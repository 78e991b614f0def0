"""Edit similarity and the trigram conditions that make a join of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal, one is unlike any other."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def max_distance(longest: Column, threshold: float) -> Column:
    """the largest d with 1 - d / longest >= threshold, by the same double comparison."""
    guess = F.floor((1.0 - threshold) * longest).cast("int")
    fits = lambda d: (1.0 - d / F.nullif(longest.cast("double"), F.lit(0.0))) >= threshold
    return F.when(longest == 0, F.lit(0)).when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)


def at_least(a: str, b: str, threshold: float) -> Column:
    """whether the similarity reaches the threshold, with the distance cut off where it can't."""
    longest = f"greatest(length({a}), length({b}))"
    bound = f"cast(floor({1 - threshold!r} * {longest}) as int) + 1"
    exact = f"(1.0D - levenshtein({a}, {b}, {bound}) / cast({longest} as double)) >= {threshold!r}D"
    return F.expr(f"CASE WHEN {longest} = 0 THEN true WHEN least(length({a}), length({b})) = 0 THEN 0.0D >= {threshold!r}D ELSE levenshtein({a}, {b}, {bound}) >= 0 AND {exact} END")


def grams(value: Column) -> Column:
    """The trigrams, repeats included."""
    n = F.length(value)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.substring(value, k, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def needed_grams(longest: Column, distance: Column) -> Column:
    """Trigrams that strings within a distance share at least, counted with repeats."""
    return longest - 2 - 3 * distance
