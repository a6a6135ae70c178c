"""Sums of doubles that are exact until one last rounding, so no order or partitioning shows in them."""

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 32  # bits of a limb
LIMBS = 4  # a double has 53 bits: at most three limbs of the grid, four with the estimate of its size


def _limbs(value):
    """[(place, limb)]: whole multiples of 2^(32 place) that add up to the double, each step exact.

    The first place comes from a logarithm and may be one too high, which makes its limb zero.
    Scaling by a power of two and taking off the whole part lose nothing.
    """
    size = F.when(value == 0, F.lit(0.0)).otherwise(F.log2(F.abs(value)))
    top = F.floor(size / WIDTH).cast("int") + 1

    def take(state, step):
        place = F.greatest(state["place"], F.lit(-1074 // WIDTH))
        # two factors: a power below 2^-1022 would not be a normal double
        up, down = F.pow(F.lit(2.0), -place * (WIDTH // 2)), F.pow(F.lit(2.0), place * (WIDTH // 2))
        scaled = state["rest"] * up * up
        limb = F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("long")
        return F.struct(
            (state["rest"] - limb.cast("double") * down * down).alias("rest"), (state["place"] - 1).alias("place"),
            F.concat(state["limbs"], F.array(F.struct(place.alias("place"), limb.alias("limb")))).alias("limbs"))

    start = F.struct(value.alias("rest"), top.alias("place"), F.array().cast("array<struct<place:int,limb:bigint>>").alias("limbs"))
    # folded, not nested: each step refers to the state by name, so the expression stays small
    found = F.aggregate(F.sequence(F.lit(0), F.lit(LIMBS)), start, take)["limbs"]
    return F.filter(found, lambda x: x["limb"] != 0)


@F.pandas_udf(T.DoubleType())
def _rounded(places: pd.Series, limbs: pd.Series) -> pd.Series:
    """The double nearest to the sum of limb * 2^(32 place), ties to even."""
    def one(own, parts):
        total = sum(Fraction(int(x)) * Fraction(2) ** (WIDTH * int(p)) for p, x in zip(own, parts))
        try:
            return float(total)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return pd.Series([one(p, x) for p, x in zip(places, limbs)], dtype="float64")


def exact_sums(rows: DataFrame, by, value, name="total") -> DataFrame:
    """One row per key with the correctly rounded sum of a double column.

    A value becomes a few whole numbers on a grid of powers of two; those add up as decimals in the
    map tasks, which is associative, and a key's few sums are rounded once. NULLs are skipped, a key of
    NULLs sums to NULL. NaN or both infinities give NaN, one infinity itself. `by` names a column at
    least.
    """
    by = list(by)
    v = F.col(value).cast("double")
    special = F.isnan(v) | (F.abs(v) == float("inf"))
    odd = rows.groupBy(*by).agg(F.sum(F.when(special, v)).alias("__odd"), F.count(v).alias("__n"))
    plain = rows.where(v.isNotNull() & ~special).select(*by, F.explode(_limbs(v)).alias("l"))
    parts = plain.groupBy(*by, F.col("l.place").alias("place")).agg(F.sum(F.col("l.limb").cast("decimal(20,0)")).alias("limb"))
    listed = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "limb"))).alias("s"))
    sums = listed.select(*[F.col(c).alias(f"__{c}") for c in by], _rounded(
        F.transform("s", lambda x: x["place"]), F.transform("s", lambda x: x["limb"].cast("string"))).alias("__sum"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = odd.join(sums, same, "left")
    total = F.when(F.col("__odd").isNotNull(), F.col("__odd")).when(F.col("__n") > 0, F.coalesce("__sum", F.lit(0.0)))
    return joined.select(*by, total.alias(name))
