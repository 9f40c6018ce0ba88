"""The 29 descriptors of sequences, and region annotation for an external scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import FEATURES, composition, external_features, hairpin_context, interactions
from .hairpin import hairpin


def with_geometry(df: DataFrame, sequence: str = "seq", name: str = "geom") -> DataFrame:
    return df.withColumn(name, hairpin(F.col(sequence)))


def describe(df: DataFrame, sequence: str = "seq", geometry: str = "geom") -> DataFrame:
    """Adds the descriptors as 29 columns; ``geometry`` is searched for if it isn't there."""
    if geometry not in df.columns:
        df = with_geometry(df, sequence, geometry)
    first = composition(F.col(sequence)) | hairpin_context(F.col(sequence), F.col(geometry))
    df = df.withColumns(first)
    return df.withColumns(interactions({c: F.col(c) for c in FEATURES if c in df.columns}))


def annotate_regions(df: DataFrame, sequence: str = "seq") -> DataFrame:
    """Adds status, the regions in RNA letters and the geometry that leaves 8 bases before and 12 after the hairpin."""
    s = F.col(sequence)
    df = df.withColumn("_g", F.when(s.isNotNull(), hairpin(s, 8, 12)))
    g = F.col("_g")
    cut = lambda a, n: F.when(g.isNotNull(), F.translate(F.substring(s, a + 1, n), "T", "U"))
    return df.withColumns(
        {
            "eligible": g.isNotNull(),
            "status": F.when(s.isNull(), "invalid_sequence").when(g.isNull(), "no_context_compatible_hairpin").otherwise("OK"),
            "a_tract": cut(g["stem_start"] - 8, F.lit(8)),
            "first_half": cut(g["stem_start"], g["stem_length"]),
            "loop": cut(g["loop_start"], g["loop_length"]),
            "second_half": cut(g["loop_end"], g["stem_length"]),
            "u_tract": cut(g["hairpin_end"], F.lit(12)),
            "annotated_stem": g["stem_length"],
            "annotated_loop": g["loop_length"],
            "annotated_score": g["score"],
        }
    ).drop("_g")


def external_scores(df: DataFrame) -> DataFrame:
    """Adds the scaled features of annotated regions."""
    return df.withColumns(external_features(F.col("a_tract"), F.col("u_tract"), F.concat("first_half", "second_half"), F.col("loop")))
