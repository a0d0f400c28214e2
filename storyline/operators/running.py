"""Running sums that do not need a whole group in one task.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task,
which fails when a single key holds a large share of a big table.  Here the
order inside a key is cut into nested blocks.  Block totals are pre-aggregated
where the rows lie, running sums are taken over blocks within their parent
block, and each row adds its block's offset to the running sum inside its
block.  The result is the same, whatever the block size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_before(df: DataFrame, keys: Sequence[str],
                   levels: Sequence[Sequence[Column]],
                   sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """Add to every row the sum over all *earlier* rows of its key.

    ``levels`` are lists of ascending order expressions, from the coarsest block
    to the row; each list orders the blocks inside one block of the list before.
    ``sums`` maps an output column to ``(value, type)``; values must be exact
    (integers) for the result not to depend on the partitioning.  Null keys are a
    key of their own and null positions come last; the order must be unique, or
    rows that tie get their sums in any order.
    """
    names = [[f"__l{i}_{j}" for j in range(len(level))] for i, level in enumerate(levels)]
    parts = {out: f"__v_{out}" for out in sums}
    work = df.select(
        "*",
        *[expr.alias(n) for level, ns in zip(levels, names) for expr, n in zip(level, ns)],
        *[value.cast(kind).alias(parts[out]) for out, (value, kind) in sums.items()])

    def path(depth: int) -> list[str]:
        return [*keys, *[n for ns in names[:depth] for n in ns]]

    def before(name: str, within: list[str], order: list[str]) -> Column:
        window = (Window.partitionBy(*within).orderBy(*[F.col(c).asc_nulls_last() for c in order])
                  .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    def totals(rows: DataFrame, depth: int) -> DataFrame:
        return rows.groupBy(*path(depth)).agg(*[F.sum(v).alias(v) for v in parts.values()])

    def offsets(nodes: DataFrame, depth: int) -> DataFrame:
        """Offset of each block of this depth from the start of its key."""
        within = Window.partitionBy(*path(depth - 1))
        placed = nodes.select(
            *path(depth), F.row_number().over(within.orderBy(*[F.col(c).asc_nulls_last() for c in names[depth - 1]])).alias("__rn"),
            *[before(v, path(depth - 1), names[depth - 1]).alias(f"__off_{o}") for o, v in parts.items()],
            *[F.sum(v).over(within).alias(v) for v in parts.values()])
        if depth == 1:
            return placed.select(*path(depth), *[f"__off_{o}" for o in parts])
        # the parents' totals come from the same sorted blocks as the offsets,
        # so both branches can read one shuffle
        parents = placed.filter("__rn = 1").select(*path(depth - 1), *parts.values())
        above = offsets(parents, depth - 1)
        above = above.select(*path(depth - 1), *[F.col(f"__off_{o}").alias(f"__up_{o}") for o in parts])
        return _null_safe_join(placed, above, path(depth - 1)).select(
            *path(depth), *[(F.col(f"__off_{o}") + F.col(f"__up_{o}")).alias(f"__off_{o}") for o in parts])

    last = len(levels) - 1
    inside = work.select("*", *[before(v, path(last), names[last]).alias(f"__in_{out}")
                                for out, v in parts.items()])
    if last:
        inside = _null_safe_join(inside, offsets(totals(work, last), last), path(last))
        result = {o: F.col(f"__in_{o}") + F.col(f"__off_{o}") for o in parts}
    else:
        result = {o: F.col(f"__in_{o}") for o in parts}
    return inside.select(*df.columns, *[c.cast(sums[o][1]).alias(o) for o, c in result.items()])


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null meets null."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(other, same).drop(*[f"__r_{c}" for c in on])


def blocks_of(ordinal: Column, *sizes: int) -> list[list[Column]]:
    """Block levels for a whole-number ordinal, from the largest size down."""
    return [[F.floor(ordinal / size)] for size in sizes]
