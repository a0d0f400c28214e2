"""The clip catalog: usable rows, new candidates, renditions, coverage, top-up."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import exceeds_cap, first_truthy
from .running import blocks_of, running_before

# Fixed values (must equal the reference's).
MIN_CLIP_S = 4.0
MAX_HEIGHT = 720
SIZE_CAP = 80 * 1024 * 1024
NO_SIZE = 1 << 62
HD_WIDTH = 1280
HEADROOM = 1.2
MAP_TIERS = ("large", "medium", "small", "tiny")

MICRO = 1_000_000           # durations are summed as whole microseconds


def micros(seconds) -> Column:
    """Seconds as whole microseconds: their sums do not depend on the order."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.bround(F.coalesce(c.cast("double"), F.lit(0.0)) * MICRO, 0).cast("bigint")


def _given(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != "")


def _term_in(terms) -> Column:
    return F.lower(F.coalesce(F.col("term").cast("string"), F.lit(""))).isin([t.lower() for t in terms])


def pool_filter(catalog: DataFrame, blocklist: DataFrame, terms: Sequence[str] | None = None,
                min_s: float = MIN_CLIP_S) -> DataFrame:
    """Usable clips ``(key, path, duration_s)``, in no order."""
    rows = catalog.filter(_given("norm"))
    if terms is not None:
        rows = rows.filter(_term_in(terms))
    dur = first_truthy("norm_duration_s", "duration_s")
    rows = rows.select("key", F.col("norm").alias("path"), dur.alias("duration_s")).filter(
        F.col("duration_s") >= min_s)
    return rows.join(blocklist.select("key"), "key", "left_anti")


def pool_from_clips(clips: DataFrame, paths: DataFrame,
                    duration_col: str = "norm_duration_s") -> DataFrame:
    """Clips that have a path: ``(key, path, duration_s)``."""
    found = paths.filter(_given("path")).select("key", "path")
    return clips.join(found, "key").select(
        "key", "path", first_truthy(duration_col, "duration_s").alias("duration_s"))


def stranded_rows(catalog: DataFrame, blocklist: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Downloaded but not normalised clips of these terms."""
    half = catalog.filter(_term_in(terms) & _given("raw") & ~F.coalesce(_given("norm"), F.lit(False)))
    return half.join(blocklist.select("key"), "key", "left_anti")


def fresh_candidates(cands: DataFrame, catalog: DataFrame, blocklist: DataFrame,
                     key: str = "key") -> DataFrame:
    """Candidates neither in the catalog nor blocked."""
    known = catalog.select(key).unionByName(blocklist.select(key))
    return cands.join(known, key, "left_anti")


# ---- renditions ------------------------------------------------------------

def rendition_rank(width: Column, height: Column, size: Column, tie: Column,
                   max_h: int = MAX_HEIGHT, size_cap: int | None = SIZE_CAP) -> Column:
    """Sort key of a rendition; the smallest is the one to take.

    Known sizes of frame before unknown ones; within the size cap before over
    it; at least ``max_h`` high before lower.  High ones go from small to large
    frame and file, low ones from large to small; ``tie`` decides the rest.
    """
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    high = height >= max_h
    bytes_ = F.coalesce(F.nullif(size.try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(NO_SIZE))

    def of_known(c: Column, other) -> Column:
        return F.when(known, c).otherwise(F.lit(other))

    return F.struct(
        (~known).alias("unknown"),
        of_known(exceeds_cap(size, size_cap), False).alias("over"),
        of_known(~high, False).alias("low"),
        of_known(F.when(high, height).otherwise(-height), 0).cast("bigint").alias("h"),
        of_known(F.when(high, width).otherwise(-width), 0).cast("bigint").alias("w"),
        of_known(F.when(high, bytes_).otherwise(F.lit(0)), 0).cast("bigint").alias("bytes"),
        tie.cast("int").alias("tie"))


def usable_rendition(url: Column, width: Column, height: Column, allow_unknown: bool) -> Column:
    """A link, and landscape; unknown frame sizes only in the array layout."""
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    shape = F.when(known, height <= width).otherwise(F.lit(allow_unknown))
    return F.coalesce(url, F.lit("")).cast("string").__ne__("") & shape


def pick_rendition(df: DataFrame, keys: Sequence[str], layout: str = "map",
                   max_h: int = MAX_HEIGHT, size_cap: int | None = SIZE_CAP,
                   tie: str = "tie") -> DataFrame:
    """Best rendition per hit from rows ``(keys, url, width, height, size, tie)``.

    ``tie`` is the tier rank (map layout) or the array position (array layout).
    A minimum over a sort key: candidates are reduced before the shuffle, so a
    hit with very many rows is no burden.
    """
    rows = df.filter(usable_rendition(F.col("url"), F.col("width"), F.col("height"), layout == "array"))
    rank = rendition_rank(F.col("width"), F.col("height"), F.col("size"), F.col(tie), max_h, size_cap)
    rest = [c for c in df.columns if c not in keys and c != tie]
    best = rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.struct(*rest).alias("v"))).alias("b"))
    return best.select(*keys, "b.v.*")


def first_seen_dedupe(df: DataFrame, key: str, ord: Sequence[str]) -> DataFrame:
    """First row per key in the order of ``ord``; the first hit's columns win.

    An ordered minimum, reduced before the shuffle, so a hot key sends one row per
    task.  Its buffer holds strings, so Spark reduces by sorting each task's rows.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*ord)).alias("b"))
    return best.select(key, "b.*").select(*df.columns)


def source_fallback(hits: DataFrame, statuses: DataFrame,
                    on_all_failed: str = "skip") -> tuple[DataFrame, DataFrame]:
    """All hits, and a report ``(source, terms, failed, state)``.

    What a term gave before it failed stays.  A source counts as failed only when
    all its terms failed and it gave no hits.
    """
    per = statuses.groupBy("source").agg(
        F.count(F.lit(1)).alias("terms"), F.count_if(~F.col("ok")).alias("failed"))
    given = hits.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    report = per.join(given, "source", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    state = (F.when((F.col("failed") == F.col("terms")) & (F.col("hits") == 0), "failed")
             .when(F.col("failed") > 0, "partial").otherwise("ok"))
    report = report.withColumn("state", state)
    if on_all_failed == "fail":
        dead = F.when(F.col("state") == "failed",
                      F.raise_error(F.concat(F.col("source"), F.lit(": all terms failed"))))
        report = report.withColumn("state", F.coalesce(dead.cast("string"), F.col("state")))
    return hits, report


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Sources one after another, with their position as ``source_rank``."""
    out = dfs[0].withColumn("source_rank", F.lit(0))
    for i, df in enumerate(dfs[1:], 1):
        out = out.unionByName(df.withColumn("source_rank", F.lit(i)), allowMissingColumns=True)
    return out


# ---- coverage and top-up ---------------------------------------------------

def pool_coverage(pool: DataFrame, needed: DataFrame, keys: Sequence[str],
                  headroom: float = HEADROOM) -> DataFrame:
    """``(keys, cover_s, needed_s, enough)``; enough from 1.2 times the need."""
    cover = pool.groupBy(*keys).agg(F.sum(micros("duration_s")).alias("__us"))
    cover_s = F.coalesce("__us", F.lit(0)) / F.lit(MICRO)
    return needed.join(cover, list(keys), "left").select(
        *keys, cover_s.alias("cover_s"), "needed_s",
        (cover_s >= F.col("needed_s") * headroom).alias("enough"))


def shortfall_report(pool: DataFrame, needed: DataFrame, keys: Sequence[str],
                     headroom: float = HEADROOM) -> DataFrame:
    """Jobs whose own clips do not cover the need; other jobs' clips never count."""
    cover = pool_coverage(pool, needed, keys, headroom).filter(~F.col("enough"))
    want = F.col("needed_s") * headroom
    return cover.select(*keys, "cover_s", want.alias("wanted_s"), (want - F.col("cover_s")).alias("missing_s"))


def _preference(min_width: int) -> tuple[Column, Column]:
    return (F.when(F.coalesce("width", F.lit(0)) >= min_width, 0).otherwise(1),
            -F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)))


def rank_candidates(cands: DataFrame, n: int | None = None, min_width: int = HD_WIDTH,
                    ord: Sequence[str] = ("ord",)) -> DataFrame:
    """HD first, longest first, then the original order; ``n`` is the top-n report."""
    ranked = cands.orderBy(*_preference(min_width), *ord)
    return ranked if n is None else ranked.limit(n)


def budget_prefix(cands: DataFrame, need: DataFrame, keys: Sequence[str],
                  min_width: int = HD_WIDTH, ord: str | Sequence[str] = "ord") -> DataFrame:
    """Shortest prefix of the ranked candidates that covers ``need(keys, need_s)``.

    A row stays if the candidates ranked before it do not cover the need yet.
    Candidates of one HD class and whole second form a block.  Block totals say
    where each block starts, and blocks that start beyond the need are dropped
    before anything is ranked.  Inside a block ranking goes through milliseconds,
    length and ``ord`` (with all its columns unique per key), so no group is ever
    sorted in one task.  Adds ``before_s``.
    """
    keys, order = list(keys), [ord] if isinstance(ord, str) else list(ord)
    hd, neg = _preference(min_width)
    rows = cands.select("*", hd.alias("__hd"), neg.alias("__neg"), F.floor(neg).alias("__block"),
                        micros("duration_s").alias("__us"))
    block = [*keys, "__hd", "__block"]
    before = Window.partitionBy(*keys).orderBy("__hd", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*block).agg(F.sum("__us").alias("__total")).select(
        *block, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    wanted = starts.join(need.select(*keys, micros("need_s").alias("__need")), keys).filter("__start < __need")
    levels = [[F.floor(F.col("__neg") * 1000)], [F.col("__neg")], [F.col(c) for c in order]]
    if dict(cands.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint"):
        levels[1].append(F.floor(F.col(order[0]) / 65_536))
    ranked = running_before(rows.join(wanted, block), block, levels, {"__inside": (F.col("__us"), "bigint")})
    sofar = F.col("__start") + F.col("__inside")
    return ranked.filter(sofar < F.col("__need")).select(*cands.columns, (sofar / F.lit(MICRO)).alias("before_s"))
