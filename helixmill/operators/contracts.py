"""Contracts and quality checks: columns, values, plans, generated samples and final candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a stated rule."""


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_order(columns: list[str], expected: list[str]) -> None:
    if list(columns) != list(expected):
        raise ContractError("columns differ in name or order")


def prioritised(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns that are there first, then the others in their order."""
    there = [c for c in first if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in [*there, *(c for c in df.columns if c not in there)]))


def strict_number(x: Column) -> Column:
    """A text as a double; an error where it holds something else, whatever the session's ANSI mode. Nulls stay."""
    value = x.try_cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")).otherwise(value)


def alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of both sides, keys that only one side has or that a side repeats, and whether the tables are aligned."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "_l").join(count(right, "_r"), keys, "full_outer")
    out = both.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("_r"), F.lit(0)).alias("n_right"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated"),
    )
    return out.withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0))


def saved_column_report(df: DataFrame, saved: str, readings: dict[str, Column]) -> DataFrame:
    """(reading, n, mean_abs, max_abs, rank) of what a saved column may hold: its distances from each reading, nearest first."""
    one = df.agg(*(x for i, c in enumerate(readings.values()) for x in (F.count(F.col(saved) - c).alias(f"n{i}"), F.avg(F.abs(F.col(saved) - c)).alias(f"m{i}"), F.max(F.abs(F.col(saved) - c)).alias(f"x{i}"))))
    rows = F.array(*(F.struct(F.lit(name).alias("reading"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_abs"), F.col(f"x{i}").alias("max_abs")) for i, name in enumerate(readings)))
    # the readings are few and named by the caller
    return one.select(F.posexplode(F.array_sort(rows, lambda a, b: F.when(a["mean_abs"] < b["mean_abs"], -1).when(a["mean_abs"] > b["mean_abs"], 1).otherwise(0))).alias("rank", "r")).select("r.*", (F.col("rank") + 1).alias("rank"))


def quality_rows(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, check, n_rows, n_failed): one row for each key and check; null results fail."""
    failed = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in checks.items()}
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in failed.items()))
    return wide.unpivot([*keys, "n_rows"], list(checks), "check", "n_failed")


def grid_differences(df: DataFrame, column: str, expected: DataFrame, tolerance: float) -> DataFrame:
    """(side, value): distinct values without an expected one within the tolerance, and expected ones without a value."""
    from .joins import within_band

    own = df.select(F.col(column).alias("a")).where("a is not null").distinct()
    grid = expected.select(F.col(expected.columns[0]).alias("b")).distinct()
    met = within_band(own, grid, "a", "b", tolerance)
    extra = own.join(met.select("a").distinct(), "a", "left_anti").select(F.lit("unexpected").alias("side"), F.col("a").alias("value"))
    return extra.unionByName(grid.join(met.select("b").distinct(), "b", "left_anti").select(F.lit("missing").alias("side"), F.col("b").alias("value")))


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def resolve_column(df: DataFrame, aliases: list[str], token_sets: list[set[str]] | None = None) -> str | None:
    """A column by alias (equal, then contained, in plain letters), or by a set of tokens that its name holds."""
    by = {plain(c): c for c in df.columns}
    for a in map(plain, aliases):
        if a in by:
            return by[a]
    for a in map(plain, aliases):
        for name, c in by.items():
            if a in name:
                return c
    for tokens in token_sets or []:
        for c in df.columns:
            if tokens <= set(re.split("[^a-z0-9]+", c.lower())):
                return c
    return None


def first_existing(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The values of the first of the named columns that is there, nulls filled from the next."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there and default is None:
        raise ContractError(f"none of {', '.join(names)} is there")
    return F.coalesce(*there, *([default] if default is not None else []))


def whole_number(x: Column) -> Column:
    """A float that holds a whole number, as int; an error otherwise."""
    ok = x.isNull() | (F.abs(x - F.round(x)) < 1e-8)
    return F.when(ok, F.round(x).cast("int")).otherwise(F.raise_error(F.lit("not a whole number")).cast("int"))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, joined by semicolons, or PASS."""
    text = F.concat_ws(";", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    return F.when(text == "", "PASS").otherwise(text)


def plan_checks() -> dict[str, Column]:
    """Arithmetic of a generation plan's rows."""
    return {
        "prompt_length": F.length("prompt") == F.col("prompt_length"),
        "target_length": F.col("prompt_length") + F.col("n_tokens") == F.col("target_length"),
        "positive_tokens": F.col("n_tokens") > 0,
        "prompt_dna": F.col("prompt").rlike(r"\A[ACGT]+\z"),
    }


def sample_checks() -> dict[str, Column]:
    """Five checks of a generated sample against its plan."""
    rest = F.substring("sequence", F.length("prompt") + 1, F.length("sequence"))
    return {
        "invalid_sequence_dna": F.col("sequence").rlike(r"\A[ACGT]+\z"),
        "prompt_prefix_mismatch": F.startswith(F.col("sequence"), F.col("prompt")),
        "invalid_continuation_dna": rest.rlike(r"\A[ACGT]+\z"),
        "target_length_mismatch": F.length("sequence") == F.col("target_length"),
        "continuation_length_mismatch": F.length(rest) == F.col("n_tokens"),
    }


def check_samples(df: DataFrame) -> DataFrame:
    """Adds the flag of each check, ``qc_pass`` and ``qc_reason``."""
    checks = sample_checks()
    flags = df.withColumns({f"qc_{n}": F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    every = F.lit(True)
    for n in checks:
        every = every & F.col(f"qc_{n}")
    return flags.withColumn("qc_pass", every).withColumn("qc_reason", reasons({n: F.col(f"qc_{n}") for n in checks}))


def require_none(failures: DataFrame, what: str) -> None:
    """Raises with the first failing rows, if any."""
    rows = failures.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {rows}")
