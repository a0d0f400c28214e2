"""Checked queries: provider hits, catalog, dedupe, coverage, top-up."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (budget_prefix, check_allowed, first_seen_dedupe, fresh_candidates,
                         pick_rendition, pool_coverage, pool_filter, pool_from_clips,
                         rank_candidates, shortfall_report, source_fallback, stranded_rows,
                         union_sources)
from ..sources import parse_blocklist, parse_catalog, read_assets, read_provider_hits, read_scripts
from ..session import scratch_path
from ..functions import word_count
from ..plans import top_up
from .base import query, table

TERMS = ["Brand#1", "brand#12", "BRAND#20"]
_TERMS_SQL = "('brand#1', 'brand#12', 'brand#20')"
_CATALOG_SQL = """cat AS (SELECT 'part:' || p_partkey AS key, p_brand AS term,
    CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN '' ELSE 'norm/' || p_partkey END AS norm,
    CASE WHEN p_type <> 'LARGE' THEN 'raw/' || p_partkey END AS raw,
    p_size::DOUBLE AS duration_s,
    CASE WHEN p_type = 'MEDIUM' THEN 0.0 WHEN p_type = 'LARGE' THEN p_size - 0.5 END AS norm_duration_s,
    p_size * 50 AS width, p_retailprice FROM part),
  blk AS (SELECT DISTINCT 'part:' || l_partkey AS key FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')"""


def _catalog(spark, d):
    kind, num = F.col("p_type"), F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(
        F.concat(F.lit("part:"), num).alias("key"), F.col("p_brand").alias("term"),
        F.when(kind == "PROMO", None).when(kind == "SMALL", "").otherwise(F.concat(F.lit("norm/"), num)).alias("norm"),
        F.when(kind != "LARGE", F.concat(F.lit("raw/"), num)).alias("raw"),
        F.col("p_size").cast("double").alias("duration_s"),
        F.when(kind == "MEDIUM", 0.0).when(kind == "LARGE", F.col("p_size") - 0.5).alias("norm_duration_s"))


def _blocklist(spark, d):
    bad = table(spark, d, "lineitem").filter((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R"))
    return bad.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"))


@query("pool_filter", f"""WITH {_CATALOG_SQL}
  SELECT key, norm AS path, coalesce(nullif(norm_duration_s, 0), nullif(duration_s, 0), 0) AS duration_s FROM cat
  WHERE norm <> '' AND lower(term) IN {_TERMS_SQL} AND key NOT IN (SELECT key FROM blk)
    AND coalesce(nullif(norm_duration_s, 0), nullif(duration_s, 0), 0) >= 4 ORDER BY key""")
def _pool_filter(spark, d):
    return pool_filter(_catalog(spark, d), _blocklist(spark, d), TERMS)


@query("pool_from_clips", """SELECT 'part:' || p_partkey AS key, l.path,
    coalesce(nullif(CASE WHEN p_type = 'MEDIUM' THEN 0.0 WHEN p_type = 'LARGE' THEN p_size - 0.5 END, 0), p_size)::DOUBLE
      AS duration_s
  FROM part JOIN (SELECT l_partkey, CASE WHEN max(l_tax) < 0.08 THEN NULL ELSE 'norm/' || min(l_orderkey) END AS path
    FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p_partkey WHERE l.path IS NOT NULL""")
def _pool_from_clips(spark, d):
    paths = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.when(F.max("l_tax") >= 0.08, F.concat(F.lit("norm/"), F.min("l_orderkey").cast("string"))).alias("path"))
    paths = paths.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"), "path")
    return pool_from_clips(_catalog(spark, d), paths)


@query("stranded_rows", f"""WITH {_CATALOG_SQL} SELECT key, term, raw FROM cat WHERE lower(term) IN {_TERMS_SQL}
  AND raw <> '' AND (norm IS NULL OR norm = '') AND key NOT IN (SELECT key FROM blk)""")
def _stranded_rows(spark, d):
    return stranded_rows(_catalog(spark, d), _blocklist(spark, d), TERMS).select("key", "term", "raw")


@query("fresh_candidates", """SELECT p_partkey AS key, p_name FROM part
  WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10)
    AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')""")
def _fresh_candidates(spark, d):
    line = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return fresh_candidates(
        table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name"),
        line.filter("l_quantity < 10").select(F.col("l_partkey").alias("key")),
        line.filter("l_quantity >= 50").select(F.col("l_partkey").alias("key")))


# ---- renditions ------------------------------------------------------------

_REND_SQL = """r AS (SELECT l_orderkey, CASE WHEN l_discount < 0.01 THEN '' ELSE 'u' || l_partkey END AS url,
    CASE WHEN l_tax > 0.06 THEN NULL ELSE (l_quantity * 40)::INT END AS width,
    floor(l_extendedprice / 70)::INT AS height,
    CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' AND l_quantity > 45 THEN 'n/a'
      ELSE floor(l_extendedprice * 2000)::BIGINT::VARCHAR END AS size, l_linenumber AS tie FROM lineitem),
  k AS (SELECT *, coalesce(width, 0) > 0 AND height > 0 AS known,
    coalesce(TRY_CAST(size AS BIGINT) > 83886080, false) AS over, height >= 720 AS hi,
    coalesce(nullif(TRY_CAST(size AS BIGINT), 0), 4611686018427387904) AS sz FROM r WHERE url <> '')"""


def _rendition_sql(keep: str) -> str:
    return f"""WITH {_REND_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
      NOT known, known AND over, known AND NOT hi,
      CASE WHEN NOT known THEN 0 WHEN hi THEN height ELSE -height END,
      CASE WHEN NOT known THEN 0 WHEN hi THEN width ELSE -width END,
      CASE WHEN NOT known THEN 0 WHEN hi THEN sz ELSE 0 END, tie,
      url, width NULLS FIRST, height NULLS FIRST, size NULLS FIRST) AS rn FROM k WHERE {keep})
    SELECT l_orderkey, url, width, height, size FROM q WHERE rn = 1"""


def _renditions(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_discount") < 0.01, "").otherwise(
            F.concat(F.lit("u"), F.col("l_partkey").cast("string"))).alias("url"),
        F.when(F.col("l_tax") <= 0.06, (F.col("l_quantity") * 40).cast("int")).alias("width"),
        F.floor(F.col("l_extendedprice") / 70).cast("int").alias("height"),
        F.when(flag == "A", None).when((flag == "N") & (F.col("l_quantity") > 45), "n/a")
        .otherwise(F.floor(F.col("l_extendedprice") * 2000).cast("string")).alias("size"),
        F.col("l_linenumber").alias("tie"))


@query("pick_rendition", _rendition_sql("known AND height <= width"))
def _pick_rendition(spark, d):
    return pick_rendition(_renditions(spark, d), ["l_orderkey"], "map")


@query("pick_rendition_array", _rendition_sql("(NOT known OR height <= width)"))
def _pick_rendition_array(spark, d):
    return pick_rendition(_renditions(spark, d), ["l_orderkey"], "array")


_HITS_SQL = """t AS (SELECT p_partkey, p_brand, p_size, p_name, unnest([0, 1, 2, 3]) AS tie, p_retailprice FROM part),
  c AS (SELECT *, (p_size * (10 + 15 * (3 - tie)))::INT AS width, (600 + 80 * (3 - tie) - p_size)::INT AS height,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 1000000 * (4 - tie) END AS size,
    'http://m/' || p_partkey || '/' || tie AS url FROM t),
  q AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY
    coalesce(size > 83886080, false), height < 720, CASE WHEN height >= 720 THEN height ELSE -height END,
    CASE WHEN height >= 720 THEN width ELSE -width END,
    CASE WHEN height >= 720 THEN coalesce(size, 4611686018427387904) ELSE 0 END, tie) AS rn
    FROM c WHERE height <= width)"""


@query("read_provider_hits", f"""WITH {_HITS_SQL}
  SELECT 'pixabay:' || p_partkey AS key, 'pixabay' AS provider, p_partkey::VARCHAR AS id, p_size::DOUBLE AS duration_s,
    width, height, url AS download_url, size AS size_bytes, p_name AS tags, p_brand AS term FROM q WHERE rn = 1""")
def _read_provider_hits(spark, d):
    size = F.col("p_size")
    tiers = []
    for tie, tier in enumerate(("large", "medium", "small", "tiny")):
        tiers += [F.lit(tier), F.struct(
            F.concat(F.lit("http://m/"), F.col("p_partkey").cast("string"), F.lit(f"/{tie}")).alias("url"),
            (size * (10 + 15 * (3 - tie))).alias("width"), (600 + 80 * (3 - tie) - size).alias("height"),
            F.when(size % 3 != 0, size.cast("bigint") * 1000000 * (4 - tie)).alias("size"))]
    hits = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.to_json(F.struct(
        F.col("p_partkey").alias("id"), size.alias("duration"), F.col("p_name").alias("tags"),
        F.create_map(*tiers).alias("videos"))).alias("hit"))
    return read_provider_hits(hits, "hit", "map").select(
        "key", "provider", "id", "duration_s", "width", "height", "download_url", "size_bytes", "tags", "term")


@query("read_provider_hits_array", """SELECT 'pexels:' || c_custkey AS key, CASE WHEN c_nationkey % 5 = 0 THEN 7.5
    ELSE c_nationkey END::DOUBLE AS duration_s,
  CASE WHEN c_nationkey < 10 THEN 1920 ELSE 0 END AS width, CASE WHEN c_nationkey < 10 THEN 1080 ELSE 0 END AS height,
  CASE WHEN c_nationkey < 10 THEN 'b/' ELSE 'a/' END || c_custkey AS download_url, 9000 + c_nationkey AS bitrate
  FROM customer WHERE c_nationkey <> 24""")
def _read_provider_hits_array(spark, d):
    nation, num = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    known = nation < 10
    a = F.struct(F.concat(F.lit("a/"), num).alias("link"), F.lit(None).cast("int").alias("width"),
                 F.lit(None).cast("int").alias("height"), (9000 + nation).alias("bit_rate"),
                 F.lit(None).cast("int").alias("bitrate"), F.lit(7.5).alias("duration"))
    b = F.struct(F.concat(F.lit("b/"), num).alias("link"), F.when(known, 1920).otherwise(1080).alias("width"),
                 F.when(known, 1080).otherwise(1920).alias("height"), F.lit(0).alias("bit_rate"),
                 (9000 + nation).alias("bitrate"), F.lit(7.5).alias("duration"))
    files = F.when(nation == 24, F.array(b)).otherwise(F.array(a, b))
    hits = table(spark, d, "customer").select(F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.when(nation % 5 != 0, nation).alias("duration"),
        F.when(nation % 2 == 0, files).alias("video_files"),
        F.when(nation % 2 == 1, files).alias("video_versions"))).alias("hit"))
    return read_provider_hits(hits, "hit", "array").select(
        "key", "duration_s", "width", "height", "download_url", "bitrate")


@query("read_catalog", f"WITH {_CATALOG_SQL} SELECT key, term, norm, raw, duration_s, norm_duration_s FROM cat")
def _read_catalog(spark, d):
    rows = _catalog(spark, d)
    entry = F.struct("term", "norm", "raw", "duration_s", "norm_duration_s")
    text = rows.select(F.to_json(F.create_map("key", entry)).alias("value"))
    broken = rows.select(F.lit('{"broken": {').alias("value"))
    return parse_catalog(text.unionByName(broken), "value").select(
        "key", "term", "norm", "raw", "duration_s", "norm_duration_s")


@query("read_blocklist", "SELECT c_name AS key, c_mktsegment AS reason FROM customer")
def _read_blocklist(spark, d):
    text = table(spark, d, "customer").select(F.to_json(F.struct(
        F.create_map("c_name", "c_mktsegment").alias("blocked"))).alias("value"))
    return parse_blocklist(text, "value")


@query("read_scripts", r"""SELECT source, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT
  AS words, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS ord FROM documents GROUP BY source""")
def _read_scripts(spark, d):
    path = scratch_path(spark, "scripts")
    table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(path)
    # every source is a folder of its own, given in order
    sources = sorted(r[0] for r in table(spark, d, "documents").select("source").distinct().collect())
    files = read_scripts(spark, [f"{path}/source={source}" for source in sources])
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "ord").agg(
        F.sum(word_count("text")).cast("bigint").alias("words"))


@query("read_assets", """SELECT b AS block, length(t) AS size, sha256(t) AS sha256, 0 AS dir_ord FROM (
  SELECT s_suppkey // 256 AS b, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) AS t FROM supplier GROUP BY ALL)""")
def _read_assets(spark, d):
    path = scratch_path(spark, "assets")
    rows = table(spark, d, "supplier").select(
        F.floor(F.col("s_suppkey") / 256).alias("block"), "s_suppkey", F.col("s_name").alias("value"))
    rows.repartition("block").sortWithinPartitions("block", "s_suppkey").select("block", "value").write.partitionBy(
        "block").text(path)
    found = read_assets(spark, [f"{path}/*"], exts=("txt",))
    return found.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("bigint").alias("block"),
                        "size", "sha256", "dir_ord")


# ---- order and union -------------------------------------------------------

@query("first_seen_dedupe", """SELECT sha, doc_id, source, lang FROM (SELECT sha256(text) AS sha, *,
  row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""")
def _first_seen_dedupe(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id", "source", "lang")
    return first_seen_dedupe(docs, "sha", ["source", "doc_id"])


@query("source_fallback", """WITH s AS (SELECT p_brand AS source, p_type AS term, count(*) FILTER (p_size > 48) = 0 AS ok
    FROM part GROUP BY ALL),
  h AS (SELECT p_brand AS source, count(*) AS kept FROM part GROUP BY ALL)
  SELECT s.source, count(*) AS terms, count(*) FILTER (NOT ok) AS failed, any_value(kept) AS kept
  FROM s JOIN h ON h.source = s.source GROUP BY s.source""")
def _source_fallback(spark, d):
    part = table(spark, d, "part")
    statuses = part.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("term")).agg(
        (F.count_if(F.col("p_size") > 48) == 0).alias("ok"))
    hits = part.select(F.col("p_brand").alias("source"), F.col("p_type").alias("term"), "p_partkey")
    kept, report = source_fallback(hits, statuses)
    counts = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return report.select("source", "terms", "failed").join(counts, "source", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(0)))


@query("union_sources", """SELECT 0 AS source_rank, doc_id AS id, length(text) AS n FROM documents UNION ALL
  SELECT 1, page_id, length(html) FROM pages UNION ALL SELECT 2, item_id, length(text) FROM benchmark""")
def _union_sources(spark, d):
    return union_sources(
        table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")),
        table(spark, d, "pages").select(F.col("page_id").alias("id"), F.length("html").alias("n")),
        table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n")))


@query("rank_candidates", """SELECT p_partkey, p_size * 50 AS width, floor(p_retailprice / 100) AS duration_s FROM part
  ORDER BY p_size * 50 < 1280, floor(p_retailprice / 100) DESC, p_partkey LIMIT 100""")
def _rank_candidates(spark, d):
    cands = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 50).alias("width"),
                                           F.floor(F.col("p_retailprice") / 100).cast("double").alias("duration_s"))
    return rank_candidates(cands, 100, ord=("p_partkey",))


def _brand_candidates(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ord"),
        (F.col("p_size") * 50).alias("width"), (F.col("p_retailprice") / 100).alias("duration_s"))


@query("budget_prefix", """SELECT brand, ord, width, duration_s, b / 1000000 AS before_s FROM (
  SELECT *, coalesce(sum(us) OVER (PARTITION BY brand ORDER BY width < 1280, duration_s DESC, ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM (
    SELECT p_brand AS brand, p_partkey AS ord, p_size * 50 AS width, p_retailprice / 100 AS duration_s,
      round_even(p_retailprice / 100 * 1000000, 0)::BIGINT AS us FROM part)) JOIN (
  SELECT p_brand AS brand2, (sum(p_size) * 200000)::BIGINT AS need FROM part GROUP BY ALL) ON brand = brand2
  WHERE b < need""")
def _budget_prefix(spark, d):
    need = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        (F.sum("p_size") * 200000 / 1000000.0).alias("need_s"))
    return budget_prefix(_brand_candidates(spark, d), need, ["brand"])


_COVER_SQL = """SELECT n_nationkey AS nation, n_regionkey * 20000.0 AS needed_s,
    coalesce((SELECT sum(1 + c_custkey % 97) FROM customer WHERE c_nationkey = n_nationkey), 0)::DOUBLE AS cover_s
  FROM nation"""


def _cover_inputs(spark, d):
    pool = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"),
                                              (1 + F.col("c_custkey") % 97).cast("double").alias("duration_s"))
    needed = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"),
                                              (F.col("n_regionkey") * 20000.0).alias("needed_s"))
    return pool, needed


@query("pool_coverage", f"SELECT *, cover_s >= needed_s * 1.2::DOUBLE AS enough FROM ({_COVER_SQL})")
def _pool_coverage(spark, d):
    return pool_coverage(*_cover_inputs(spark, d), ["nation"])


@query("shortfall_report", f"""SELECT nation, cover_s, needed_s * 1.2::DOUBLE AS wanted_s,
  needed_s * 1.2::DOUBLE - cover_s AS missing_s FROM ({_COVER_SQL}) WHERE NOT cover_s >= needed_s * 1.2::DOUBLE""")
def _shortfall_report(spark, d):
    return shortfall_report(*_cover_inputs(spark, d), ["nation"])


@query("check_allowed", """SELECT c_mktsegment AS value, count(*) AS n, 'AUTOMOBILE, BUILDING' AS hints FROM customer
  WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') GROUP BY ALL""")
def _check_allowed(spark, d):
    return check_allowed(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "AUTOMOBILE"])


@query("check_allowed_table", """SELECT l_partkey AS value, count(*) AS n,
    (SELECT string_agg(h, ', ' ORDER BY h) FROM (SELECT p_partkey::VARCHAR AS h FROM part WHERE p_size < 40 AND p_partkey::VARCHAR LIKE '1%'
      ORDER BY h LIMIT 20)) AS hints
  FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY ALL""")
def _check_allowed_table(spark, d):
    allowed = table(spark, d, "part").filter("p_size < 40").select(F.col("p_partkey").alias("value"))
    return check_allowed(table(spark, d, "lineitem"), "l_partkey", allowed, hint_prefix="1", max_hints=20)


# ---- top-up ----------------------------------------------------------------

@query("top_up", """WITH seen AS (
    SELECT l_partkey, min((l_orderkey, l_linenumber)) AS o, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS duration_s
    FROM lineitem GROUP BY l_partkey),
  fresh AS (SELECT p_brand AS brand, 'part:' || p_partkey AS key, p_size * 50 AS width, duration_s::DOUBLE AS duration_s, o
    FROM seen JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' AND p_size > 1),
  need AS (SELECT p_brand AS brand, 400 * 1.2::DOUBLE - coalesce(sum(p_size) FILTER (p_type = 'PROMO'), 0) AS need_s,
    coalesce(sum(p_size) FILTER (p_type = 'PROMO'), 0) >= 400 * 1.2::DOUBLE AS enough FROM part GROUP BY ALL)
  SELECT brand, key, width, duration_s, b AS before_s FROM (
    SELECT *, coalesce(sum(duration_s) OVER (PARTITION BY brand ORDER BY width < 1280, duration_s DESC, o
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fresh) JOIN need USING (brand)
  WHERE NOT enough AND b < need_s""")
def _top_up(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    hits = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("brand"), "key", (F.col("p_size") * 50).alias("width"),
        F.col("l_quantity").cast("double").alias("duration_s"), "l_orderkey", "l_linenumber")
    promo = parts.filter("p_type = 'PROMO'")
    pool = promo.select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("duration_s"))
    needed = parts.select(F.col("p_brand").alias("brand")).distinct().withColumn("needed_s", F.lit(400.0))
    return top_up(hits, promo.select("key"), parts.filter("p_size <= 1").select("key"), pool, needed, ["brand"],
                  ["l_orderkey", "l_linenumber"]).select("brand", "key", "width", "duration_s", "before_s")
