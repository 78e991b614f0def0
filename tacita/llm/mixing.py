"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if

#: Rate rows that may be broadcast; beyond it the join shuffles and adaptive execution splits hot sources.
BROADCAST_RATES = 50_000
SEED = 42


def unit(*parts: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from 13 hex digits of an MD5 over the parts, seed first; null counts as the empty string."""
    fields = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *fields).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """(source, n_rows, rate): the mean number of times a row of each source is to appear, so that the sources' expected
    rows stand in the ratio of their target weights and sum to total_rows (the rows of docs if not given). Without
    weights, a source's weight is its number of rows to the power alpha. Sources without a weight have rate 0. A null
    and an empty source are one source, named by the empty string in weights."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha)))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        pairs = [F.struct(F.lit(k).alias("key"), F.lit(float(w)).alias("value")) for k, w in sorted(weights.items())]
        weight = F.coalesce(F.try_element_at(F.map_from_entries(F.array(*pairs)), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight"), F.sum("n_rows")).first()
    whole, rows = float(sums[0] or 0), int(sums[1] or 0)
    target = rows if total_rows is None else total_rows
    return weighed.select("mix_source", "n_rows", (F.lit(float(target)) * F.col("weight") / F.lit(whole or 1.0) / F.col("n_rows")).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """The cumulative Poisson distribution at 0, 1, 2, ..., to where the tail is below a double's resolution."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    state = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), state, step, lambda s: s["cdf"])


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with n_copies and copy (0 to n_copies - 1): each row as often as a Poisson draw with its source's rate says.
    The draw is a hash of the row's id and seed, inverted through the distribution: it is the same in each run. A rate
    over 500 is drawn as the sum of draws at equal parts of it, of at most 500 each, so that exp(-rate) is no zero."""
    big = F.greatest(F.ceil(F.col("rate") / 500.0), F.lit(1)).cast("int")
    steps = rates.withColumn("parts", big).withColumn("cdf", poisson_steps(F.col("rate") / F.col("parts"))).select("mix_source", "parts", "cdf")
    joined = docs.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).join(broadcast_if(steps, BROADCAST_RATES), "mix_source")
    # Each draw is made once, then looked up.
    units = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: unit(F.col(id_col), part, seed=seed))
    draws = F.transform(units, lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    counted = joined.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).drop("mix_source", "parts", "cdf")
    return counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total_rows: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of docs, with n_copies, copy and shuffle_key: the mixture, in a global order of shuffle_key, a hash
    of id, copy and seed. Partitions hold ranges of it; rows are sorted within.

    Null texts are rows like any other; null sources form one source; rows with equal ids are drawn alike, each on its
    own row. Rows of null ids draw as the id ''. An empty table gives an empty mixture. If docs has columns with the
    added names, they are replaced."""
    plain = docs.drop("n_copies", "copy", "shuffle_key", "mix_source", "parts", "cdf")
    rates = source_rates(plain, weights, alpha, total_rows, source_col)
    copies = replicate(plain, rates, seed, id_col, source_col)
    return copies.withColumn("shuffle_key", unit(F.col(id_col), F.col("copy"), seed=seed + 1)).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
