"""Keyed updates of tables: upserts, patches, carried and demoted states."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def merge_records(target: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """Upsert: an incoming record replaces, rows only in the target survive.

    ``incoming`` has one row per key.  Written as an anti-join plus union, so a
    small batch can be broadcast by its measured size and the large target then
    needs no shuffle at all.
    """
    keys = _list(key)
    kept = target.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def patch_fields(target: DataFrame, patch: DataFrame, key, keep: Sequence[str] = ()) -> DataFrame:
    """Overwrite the patch's columns on matching rows.

    Columns in ``keep`` hold on to an old value that is not empty.
    """
    keys = _list(key)
    fields = [c for c in patch.columns if c not in keys]
    renamed = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in fields],
                           F.lit(True).alias("__hit"))

    def value(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        old = F.col(c) if c in target.columns else F.lit(None)
        new = F.col(f"__p_{c}")
        if c in keep:
            empty = old.isNull() | (old.cast("string") == "")
            new = F.when(empty, new).otherwise(old)
        return F.when(F.col("__hit"), new).otherwise(old).alias(c)

    columns = list(target.columns) + [c for c in fields if c not in target.columns]
    return target.join(renamed, keys, "left").select(*[value(c) for c in columns])


def carry_status(plan: DataFrame, old: DataFrame, keys) -> DataFrame:
    """New plan rows with the state, path and problems they had before."""
    keys = _list(keys)
    kept = old.select(*keys, "state", "path", "problems")
    return plan.join(kept, keys, "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def demote_stale(segments: DataFrame, probes: DataFrame, keys, tol: float = 0.15) -> DataFrame:
    """Done rows whose probe is missing or off go back to pending.

    Adds ``demoted``; count it to report.
    """
    keys = _list(keys)
    joined = segments.join(probes.select(*keys, F.col("probe_s").alias("__probe")), keys, "left")
    good = F.coalesce(F.abs(F.col("__probe") - F.col("dur_s")) <= tol, F.lit(False)) & F.col("path").isNotNull()
    demoted = F.coalesce(F.col("state") == "done", F.lit(False)) & ~good
    return joined.withColumn("demoted", demoted).withColumns({
        "state": F.when(F.col("demoted"), "pending").otherwise(F.col("state")),
        "path": F.when(~F.col("demoted"), F.col("path"))}).drop("__probe")


def check_allowed(df: DataFrame, col: str, allowed, hint_prefix: str = "", max_hints: int | None = None) -> DataFrame:
    """Values outside the allowed list, how often, and the valid hints sorted.

    Hints are the allowed values that begin with ``hint_prefix``, the first
    ``max_hints`` of them.  An empty list disables the check.  ``allowed`` is a list,
    or a DataFrame ``allowed(value)`` of any length; its hints are looked up as the
    plan runs, and default to a hundred.
    """
    used = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(allowed, DataFrame):
        some = allowed.select("value").orderBy("value").limit(1).agg(F.count("*") > 0).scalar()
        text = F.col("value").cast("string")
        first = allowed.select(text.alias("h")).filter(F.startswith("h", F.lit(hint_prefix))).distinct().orderBy("h").limit(
            100 if max_hints is None else max_hints)
        hints = first.agg(F.array_join(F.array_sort(F.collect_list("h")), ", ")).scalar()
        return used.join(allowed.select("value"), "value", "left_anti").filter(some).withColumn("hints", hints)
    allowed = sorted(set(allowed))
    hints = ", ".join([str(a) for a in allowed if str(a).startswith(hint_prefix)][:max_hints])
    bad = ~F.coalesce(F.col("value").isin(allowed), F.lit(False)) if allowed else F.lit(False)
    return used.filter(bad).withColumn("hints", F.lit(hints))
