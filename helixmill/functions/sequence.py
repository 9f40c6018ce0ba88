"""Column expressions over nucleotide sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: Three-letter motifs of the descriptor set (fixed values).
MOTIFS = ("TTT", "AAA", "GCG", "CGC", "TTG", "TTA", "GCT", "AGC")
NO_SPACER = 15
DOWNSTREAM = 15
UPSTREAM = 10


def normalise_dna(s: Column) -> Column:
    """Upper case, trimmed, U as T; null where anything but A, C, G, T is left or nothing is."""
    clean = F.translate(F.upper(F.trim(s)), "U", "T")
    return F.when(is_dna(clean), clean)


def is_dna(s: Column) -> Column:
    return s.rlike(r"\A[ACGT]+\z")


def count_of(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base)))


def share_of(s: Column, base: str, length: Column | float | None = None) -> Column:
    """Count of a base over a length (its own by default), 0 where that is 0."""
    n = F.length(s).cast("double") if length is None else length if isinstance(length, Column) else F.lit(float(length))
    return F.coalesce(F.try_divide(count_of(s, base).cast("double"), n), F.lit(0.0))


def overlapping_count(s: Column, motif: str) -> Column:
    return F.regexp_count(s, F.lit(f"(?={motif})"))


def longest_run(s: Column, base: str) -> Column:
    runs = F.regexp_extract_all(s, F.lit(f"({base}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def composition(s: Column) -> dict[str, Column]:
    """Length, GC content, base shares, poly-T and motif shares."""
    n = F.length(s).cast("double")
    out = {"seq_len": n, "gc_content": (count_of(s, "G") + count_of(s, "C")) / n}
    out |= {f"freq_{b}": count_of(s, b) / n for b in BASES}
    out |= {"count_poly_t_4": overlapping_count(s, "TTTT").cast("double"), "max_poly_t_run": longest_run(s, "T").cast("double")}
    return out | {f"kmer_{m}": F.coalesce(F.try_divide(overlapping_count(s, m).cast("double"), F.greatest(n - 2, F.lit(0.0))), F.lit(0.0)) for m in MOTIFS}


def hairpin_context(s: Column, g: Column) -> dict[str, Column]:
    """Descriptors around the hairpin ``g`` (null: none)."""
    none = g.isNull()
    upstream = F.substring(s, F.greatest(g["stem_start"] - UPSTREAM, F.lit(0)) + 1, F.least(g["stem_start"], F.lit(UPSTREAM)))
    downstream = F.substring(s, g["hairpin_end"] + 1, F.lit(DOWNSTREAM))
    at = F.instr(downstream, "T")
    positional = reduce(lambda a, k: a + F.when(F.substring(downstream, k + 1, 1) == "T", F.exp(F.lit(-0.2 * k))).otherwise(0.0), range(DOWNSTREAM), F.lit(0.0))
    return {
        "stem_length": F.coalesce(g["stem_length"], F.lit(0)).cast("double"),
        "loop_length": F.coalesce(g["loop_length"], F.lit(0)).cast("double"),
        "stem_pairing_score": F.coalesce(g["score"], F.lit(0.0)),
        "gu_wobble_count": F.coalesce(g["gu_count"], F.lit(0)).cast("double"),
        "loop_proximal_gc_pair_fraction": F.coalesce(g["proximal_gc"], F.lit(0.0)),
        "upstream_a_richness": F.when(none, 0.0).otherwise(share_of(upstream, "A")),
        "positional_poly_t_score": F.when(none, 0.0).otherwise(positional),
        "spacer_length": F.when(none | (at == 0), float(NO_SPACER)).otherwise((at - 1).cast("double")),
    }


def interactions(c: dict[str, Column]) -> dict[str, Column]:
    """Products and ratios of descriptors."""
    return {
        "stem_polyT_coupling": c["stem_pairing_score"] * c["positional_poly_t_score"] / (c["spacer_length"] + 1.0),
        "stem_polyT_interaction": c["stem_pairing_score"] * c["max_poly_t_run"],
        "compact_gc_hairpin_score": c["loop_proximal_gc_pair_fraction"] / (c["loop_length"] + 1.0),
        "polyT_spacer_proximity": c["max_poly_t_run"] / (c["spacer_length"] + 1.0),
        "polyT_position_interaction": c["max_poly_t_run"] * c["positional_poly_t_score"],
    }


#: Groups of descriptors that are permuted together (fixed values).
FEATURE_GROUPS = {
    "Sequence composition": ("seq_len", "gc_content", "freq_A", "freq_C", "freq_G", "freq_T", "count_poly_t_4", "max_poly_t_run"),
    "3-mer motifs": tuple(f"kmer_{m}" for m in MOTIFS),
    "Stem-loop descriptors": ("stem_length", "loop_length", "stem_pairing_score", "gu_wobble_count", "loop_proximal_gc_pair_fraction"),
    "Context / Poly-T position": ("upstream_a_richness", "positional_poly_t_score", "spacer_length", "stem_polyT_coupling"),
    "Interaction descriptors": ("stem_polyT_interaction", "compact_gc_hairpin_score", "polyT_spacer_proximity", "polyT_position_interaction"),
}
FEATURES = tuple(f for g in FEATURE_GROUPS.values() for f in g)


def state_changes(s: Column) -> Column:
    """Neighbouring positions that differ."""
    return F.greatest(F.length(s) - 1, F.lit(0)) - reduce(lambda a, b: a + b, (overlapping_count(s, 2 * b) for b in "ACGTU"))


def gc_prefix(s: Column) -> Column:
    return F.length(F.regexp_extract(s, "^[GC]*", 0))


def entropy2(shares: list[Column]) -> Column:
    """Shannon entropy in bits of shares scaled to a sum of 1; null where they sum to 0."""
    total = reduce(lambda a, b: a + b, shares)
    part = lambda p: F.when(p > 0, -(p / total) * F.log2(p / total)).otherwise(0.0)
    return F.when(total > 0, reduce(lambda a, b: a + b, map(part, shares)))


def substitute(s: Column, position: Column, base: Column) -> Column:
    """The sequence with the base at a 0-based position replaced."""
    return F.overlay(s, base, position + 1, F.lit(1))


def splice(a: Column, b: Column, cut: Column) -> Column:
    """The first ``cut`` bases of a, then b from there on; null where either side is empty."""
    ok = (cut > 0) & (cut < F.length(a)) & (cut < F.length(b))
    return F.when(ok, F.concat(F.substring(a, F.lit(1), cut), F.substring(b, cut + 1, F.length(b))))


def unit_range(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def external_features(a: Column, u: Column, stem: Column, loop: Column) -> dict[str, Column]:
    """Sixteen min-max scaled features of annotated regions (RNA letters), clipped to 0..1."""
    first6, first10, last6 = F.substring(u, 1, 6), F.substring(u, 1, 10), F.substring(a, 3, 6)
    return {
        "loop_size": unit_range(F.length(loop).cast("double"), 3, 16),
        "a_share_last6_a": share_of(last6, "A", 6),
        "c_share_last6_a": share_of(last6, "C", 6),
        "u_share_first10_u": share_of(first10, "U", 10),
        "u_share_first6_u": share_of(first6, "U", 6),
        "a_share_first6_u": share_of(first6, "A", 6),
        "c_share_u": share_of(u, "C", 12),
        "stem_size": unit_range(F.length(stem).cast("double"), 6, 49),
        "gc_share_loop": share_of(loop, "G") + share_of(loop, "C"),
        "entropy_a": unit_range(F.coalesce(entropy2([share_of(a, b, 8) for b in "ACGU"]), F.lit(0.0)), 0, 2),
        "entropy_u": unit_range(F.coalesce(entropy2([share_of(u, b, 12) for b in "UCGA"]), F.lit(0.0)), 0, 2),
        "entropy_stem": unit_range(F.coalesce(entropy2([share_of(stem, b) for b in "GCAU"]), F.lit(0.0)), 0.998000884, 2),
        "changes_a": unit_range(state_changes(a).cast("double"), 0, 7),
        "changes_u": unit_range(state_changes(u).cast("double"), 0, 11),
        "changes_stem": unit_range(state_changes(stem).cast("double"), 2, 34),
        "gc_prefix_stem": unit_range(gc_prefix(stem).cast("double"), 0, 12),
    }
