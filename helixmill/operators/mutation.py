"""Point mutants, paired stem changes, loop changes and crossover, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, splice, substitute


def point_mutants(df: DataFrame, sequence: str = "seq") -> DataFrame:
    """Three rows for each position: position, ref, alt, mutant and normalised position."""
    s = F.col(sequence)
    at = df.withColumn("position", F.explode(F.sequence(F.lit(0), F.length(s) - 1)))
    at = at.withColumn("ref", F.substring(s, F.col("position") + 1, F.lit(1)))
    out = at.withColumn("alt", F.explode(F.array_except(F.array(*map(F.lit, BASES)), F.array("ref"))))
    return out.withColumn("mutant", substitute(s, F.col("position"), F.col("alt"))).withColumn("normalized_position", F.col("position") / F.greatest(F.length(s) - 1, F.lit(1)).cast("double"))


def paired_stem_mutants(df: DataFrame, sequence: str = "seq", geometry: str = "geom") -> DataFrame:
    """Both bases of each stem pair replaced by each canonical pair that differs."""
    g, s = F.col(geometry), F.col(sequence)
    pair = df.where(g.isNotNull()).withColumn("offset", F.explode(F.sequence(F.lit(0), g["stem_length"] - 1)))
    pair = pair.withColumn("left", g["stem_start"] + F.col("offset")).withColumn("right", g["hairpin_end"] - 1 - F.col("offset"))
    out = pair.withColumn("bases", F.explode(F.array(*map(F.lit, ("AT", "TA", "GC", "CG")))))
    mutant = substitute(substitute(s, F.col("left"), F.substring("bases", 1, 1)), F.col("right"), F.substring("bases", 2, 1))
    return out.withColumn("mutant", mutant).where(F.col("mutant") != s).drop("offset")


def loop_mutants(df: DataFrame, sequence: str = "seq", geometry: str = "geom") -> DataFrame:
    g = F.col(geometry)
    return point_mutants(df.where(g.isNotNull()), sequence).where(F.col("position").between(g["loop_start"], g["loop_end"] - 1))


def tail_mutants(df: DataFrame, sequence: str = "seq", geometry: str = "geom", reach: int = 15) -> DataFrame:
    """Changes to T downstream of the hairpin."""
    g = F.col(geometry)
    return point_mutants(df.where(g.isNotNull()), sequence).where(F.col("position").between(g["hairpin_end"], g["hairpin_end"] + reach - 1) & (F.col("alt") == "T"))


def crossover(pairs: DataFrame, a: str, b: str, cut: str) -> DataFrame:
    """The child of two parents spliced at a place, null where a side would be empty."""
    return pairs.withColumn("child", splice(F.col(a), F.col(b), F.col(cut)))


def guided_choice(df: DataFrame, key: str, wanted: str, delta: str, distance: str, tie: str) -> DataFrame:
    """One mutant per key: of those that move the prediction the wanted way (all, if none does) the strongest, nearest the rules."""
    from .joins import first_by

    fits = (F.signum(F.col(wanted)) == F.signum(F.col(delta))) & (F.col(delta) != 0)
    ranked = df.withColumn("_fits", fits.cast("int"))
    return first_by(ranked, [key], [F.desc("_fits"), F.desc(F.abs(F.round(F.col(delta), 9))), distance, tie]).drop("_fits")
