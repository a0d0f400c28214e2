"""Checked queries: scalars, normalisation, segmentation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (caption_cards, clean_text, content_key, escape_caption, estimate_duration,
                         gain_db, hms, last_match, params_hash, shard_path,
                         stamp_cs, bytes_to_ms, exceeds_cap, word_count)
from ..operators import (contract_violations, min_text_filter, plan_budget, sentences, split_oversize,
                         split_stories, split_stories_blocks, units)
from ..plans import job_stories
from .base import nbytes, query, table, texts
from . import sql as S


# ---- scalars ---------------------------------------------------------------

@query("stamp_cs", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS stamp
  FROM (SELECT *, round_even(l_extendedprice * 10 / 10, 0)::BIGINT AS cs FROM lineitem)""")
def _stamp_cs(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        stamp_cs(F.col("l_extendedprice") * 10).alias("stamp"))


@query("hms", """SELECT o_orderkey, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS length
  FROM (SELECT *, floor(o_totalprice * 100 / 1000)::BIGINT AS s FROM orders)""")
def _hms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hms(F.col("o_totalprice") * 100).alias("length"))


@query("escape_caption", r"""SELECT doc_id,
  replace(translate(replace(text, ', ', '{,} '), '{}', '()'), chr(10), '\N') AS caption FROM documents""")
def _escape_caption(spark, d):
    marked = F.replace(F.col("text"), F.lit(", "), F.lit("{,} "))
    return table(spark, d, "documents").select("doc_id", escape_caption(marked).alias("caption"))


@query("content_key", """SELECT doc_id, sha256(concat_ws(chr(31), text, lang,
  regexp_replace((1 + n_chars % 4 / 4)::DOUBLE::VARCHAR, '\\.0$', ''), '24000s16le-edge')) AS sha
  FROM documents""")
def _content_key(spark, d):
    speed = 1 + F.col("n_chars") % 4 / 4
    return table(spark, d, "documents").select("doc_id", content_key("text", "lang", speed).alias("sha"))


@query("shard_path", "SELECT doc_id, substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents")
def _shard_path(spark, d):
    return table(spark, d, "documents").select("doc_id", shard_path(F.sha2("text", 256)).alias("path"))


@query("params_hash", """SELECT o_orderkey, true AS order_free, true AS unset_free,
  o_orderstatus <> 'F' AS value_counts FROM orders""")
def _params_hash(spark, d):
    status, rank = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    a = params_hash(F.create_map(F.lit("status"), status, F.lit("rank"), rank))
    return table(spark, d, "orders").select(
        "o_orderkey",
        (a == params_hash(F.create_map(F.lit("rank"), rank, F.lit("status"), status))).alias("order_free"),
        (a == params_hash(F.create_map(F.lit("rank"), rank, F.lit("eq"), none, F.lit("status"), status)))
        .alias("unset_free"),
        (a != params_hash(F.create_map(F.lit("status"), F.lit("F"), F.lit("rank"), rank))).alias("value_counts"))


@query("gain_db", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0
  ELSE greatest(-12.0::DOUBLE, least(12.0::DOUBLE, -16.0::DOUBLE - (10 - value))) END AS gain,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE round_even(greatest(-12.0::DOUBLE, least(12.0::DOUBLE, -16.0::DOUBLE - (10 - value))), 2)
  END AS rounded FROM events""")
def _gain_db(spark, d):
    measured = F.when(F.col("event_type") != "error", 10 - F.col("value"))
    return table(spark, d, "events").select("event_id", gain_db(measured, digits=None).alias("gain"),
                                                gain_db(measured).alias("rounded"))


@query("last_match", r"""SELECT doc_id, list_extract(regexp_extract_all(text, '([A-Z][a-z]+)\.', 1), -1) AS last_end
  FROM documents""")
def _last_match(spark, d):
    return table(spark, d, "documents").select("doc_id", last_match("text", r"([A-Z][a-z]+)\.").alias("last_end"))


@query("bytes_to_ms", "SELECT doc_id, n_chars / 48 AS ms FROM documents")
def _bytes_to_ms(spark, d):
    return table(spark, d, "documents").select("doc_id", bytes_to_ms("n_chars").alias("ms"))


@query("exceeds_cap", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(TRY_CAST(CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'unknown'
    ELSE (l_quantity::BIGINT)::VARCHAR END AS BIGINT) > 25, false) AS over FROM lineitem""")
def _exceeds_cap(spark, d):
    size = (F.when(F.col("l_returnflag") == "A", None).when(F.col("l_returnflag") == "N", "unknown")
            .otherwise(F.col("l_quantity").cast("bigint").cast("string")))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", exceeds_cap(size, 25).alias("over"))


@query("contract_violations", """SELECT p_partkey, concat_ws('; ',
  CASE WHEN p_type IS DISTINCT FROM 'PROMO' THEN 'p_type=' || p_type || ' want PROMO' END,
  CASE WHEN sz IS DISTINCT FROM 15 THEN 'size=' || coalesce(sz::VARCHAR, 'null') || ' want 15' END) AS violations
  FROM (SELECT *, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS sz FROM part)""")
def _contract_violations(spark, d):
    part = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    out = contract_violations(part, {"p_type": "PROMO", "size": 15, "p_brand": "Brand#1"}, ignore=("p_brand",))
    return out.select("p_partkey", F.array_join("violations", "; ").alias("violations"))


# ---- texts -----------------------------------------------------------------

@query("min_text_filter", r"""SELECT doc_id FROM documents
  WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40""")
def _min_text_filter(spark, d):
    return min_text_filter(texts(spark, d, "documents", "doc_id"), "text").select("doc_id")


@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def _clean_text(spark, d):
    return texts(spark, d, "documents", "doc_id").select("doc_id", clean_text("text").alias("text"))


@query("clean_text_pages", f"SELECT page_id, {S.clean('html')} AS text FROM pages")
def _clean_text_pages(spark, d):
    return texts(spark, d, "pages", "page_id").select("page_id", clean_text("html").alias("text"))


@query("word_count", r"""SELECT doc_id,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents""")
def _word_count(spark, d):
    return texts(spark, d, "documents", "doc_id").select("doc_id", word_count("text").alias("words"))


@query("estimate_duration", r"""SELECT doc_id,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 165.0::DOUBLE AS minutes
  FROM documents""")
def _estimate_duration(spark, d):
    return texts(spark, d, "documents", "doc_id").select("doc_id", estimate_duration(word_count("text")).alias("minutes"))


@query("plan_budget", r"""SELECT doc_id, words, need AS needed_words, words - need AS diff_words,
  CASE WHEN words = 0 THEN 'empty' WHEN abs(words - need) < need * 0.05::DOUBLE THEN 'on_target'
       WHEN words < need THEN 'short' ELSE 'over' END AS band
  FROM (SELECT doc_id, words, floor((1 + n_chars % 5)::DOUBLE * 165.0::DOUBLE + 0.5)::BIGINT AS need FROM (
    SELECT doc_id, n_chars,
      len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents))""")
def _plan_budget(spark, d):
    docs = texts(spark, d, "documents", "doc_id").select(
        "doc_id", word_count("text").cast("bigint").alias("words"), (1 + F.col("n_chars") % 5).alias("minutes"))
    return plan_budget(docs, "minutes").drop("minutes")


# Documents have no delimiter lines of their own: lists become bare delimiters
# (doubled, with a blank line between them), "of" becomes a titled one.
_SCRIPT_SQL = """'STORY: ' || source || chr(10) || replace(replace(replace(text, chr(10), chr(10) || chr(10)),
  ', ', chr(10) || '---' || chr(10) || chr(10) || ' *** ' || chr(10)), ' of ', chr(10) || '=== Of' || chr(10))"""


def _scripts(spark, d):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    text = F.replace(text, F.lit(", "), F.lit("\n---\n\n *** \n"))
    text = F.replace(text, F.lit(" of "), F.lit("\n=== Of\n"))
    return texts(spark, d, "documents", "doc_id").select(
        "doc_id", F.concat(F.lit("STORY: "), "source", F.lit("\n"), text).alias("text"))


_STORIES_SQL = rf"""WITH d AS (SELECT doc_id, string_split({_SCRIPT_SQL}, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, trim(regexp_extract(line, '(?i)^\s*(?:STORY\s*[:#]|={{3,}}|-{{3,}}|\*{{3,}})\s*(.*)$', 1)) AS title,
  CASE WHEN trim(line) = '' THEN 'b'
    WHEN regexp_matches(line, '(?i)^\s*(?:STORY\s*[:#]|={{3,}}|-{{3,}}|\*{{3,}})')
      THEN CASE WHEN trim(regexp_extract(line, '(?i)^\s*(?:STORY\s*[:#]|={{3,}}|-{{3,}}|\*{{3,}})\s*(.*)$', 1)) <> ''
           THEN 'T' ELSE 'd' END ELSE 't' END AS kind FROM lines),
nb AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS pk FROM k WHERE kind <> 'b'),
isl AS (SELECT *, sum(CASE WHEN kind = 'd' AND pk IS NOT DISTINCT FROM 'd' THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM nb),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS rn,
  first_value(pk) OVER (PARTITION BY doc_id, g ORDER BY pos) AS fpk FROM isl),
c AS (SELECT doc_id, pos, kind = 'T' OR (kind = 'd' AND
  CASE WHEN fpk IS NOT DISTINCT FROM 't' THEN rn % 2 = 1 ELSE rn % 2 = 0 END) AS head FROM r),
a AS (SELECT k.*, coalesce(c.head, false) AS head,
  sum(CASE WHEN c.head THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.pos) AS sno,
  sum(CASE WHEN c.head OR k.kind = 'b' THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.pos) AS pno
  FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos),
p AS (SELECT doc_id, sno, pno, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS para
  FROM a WHERE NOT head AND kind <> 'b' GROUP BY ALL),
s AS (SELECT doc_id, sno, string_agg(para, chr(10) || chr(10) ORDER BY pno) AS body, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT doc_id, sno, max(CASE WHEN head AND kind = 'T' THEN title END) AS title FROM a GROUP BY ALL)
SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.sno) - 1 AS story_idx, h.title,
  coalesce(s.n, 0) AS n_paragraphs, coalesce(s.body, '') AS body
FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND s.sno = h.sno WHERE h.title IS NOT NULL OR s.n > 0"""


@query("split_stories", _STORIES_SQL)
def _split_stories(spark, d):
    return split_stories(_scripts(spark, d), ["doc_id"]).select(
        "doc_id", "story_idx", "title", F.size("paragraphs").alias("n_paragraphs"),
        F.array_join("paragraphs", "\n\n").alias("body"))


@query("split_stories_blocks", _STORIES_SQL)
def _split_stories_blocks(spark, d):
    # blocks of forty lines, as if each came from another split of a file
    lines = _scripts(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn(
        "block", F.floor(F.col("at") / 40))
    return split_stories_blocks(lines, ["doc_id"]).select(
        "doc_id", "story_idx", "title", F.size("paragraphs").alias("n_paragraphs"),
        F.array_join("paragraphs", "\n\n").alias("body"))


@query("job_stories", f"""SELECT source AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, story_idx) - 1 AS story_idx,
  title, n_paragraphs, body FROM ({_STORIES_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
def _job_stories(spark, d):
    # every source is a job, and its documents are the job's scripts
    sources = table(spark, d, "documents").select("doc_id", "source")
    scripts = _scripts(spark, d).join(sources, "doc_id").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), "text")
    return job_stories(scripts).select("job_id", "story_idx", "title", F.size("paragraphs").alias("n_paragraphs"),
                                       F.array_join("paragraphs", "\n\n").alias("body"))


@query("sentences", f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS text FROM documents),
  {S.sentences('c', 'doc_id', 'text')} SELECT doc_id, k AS sent_idx, text FROM sent""")
def _sentences(spark, d):
    docs = texts(spark, d, "documents", "doc_id").select("doc_id", clean_text("text").alias("text"))
    return sentences(docs, ["doc_id"], "text")


@query("sentences_conversations", f"""WITH c AS (SELECT conv_id, turn, {S.clean('text')} AS text FROM conversations),
  {S.sentences('c', 'conv_id, turn', 'text')} SELECT conv_id, turn, k AS sent_idx, text FROM sent""")
def _sentences_conversations(spark, d):
    turns = texts(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", clean_text("text").alias("text"))
    return sentences(turns, ["conv_id", "turn"], "text")


@query("split_oversize", f"""WITH RECURSIVE c AS (SELECT doc_id, {S.clean('text')} AS text FROM documents),
  {S.sentences('c', 'doc_id', 'text')}, {S.oversize('sent', 'doc_id')}
  SELECT doc_id, k AS sent_idx, row_number() OVER (PARTITION BY doc_id, k ORDER BY p) - 1 AS part_idx, text FROM part""")
def _split_oversize(spark, d):
    return split_oversize(_sentences(spark, d), ["doc_id", "sent_idx"])


@query("caption_cards", f"""WITH c AS (SELECT conv_id, turn, {S.clean('text')} AS text FROM conversations),
  {S.sentences('c', 'conv_id, turn', 'text')},
  g AS (SELECT conv_id, turn, k, {S.cards('text')} AS cards FROM sent)
  SELECT conv_id, turn, k AS sent_idx, generate_subscripts(cards, 1) - 1 AS card_idx, unnest(cards) AS card FROM g""")
def _caption_cards(spark, d):
    return _sentences_conversations(spark, d).select(
        "conv_id", "turn", "sent_idx", F.posexplode(caption_cards("text")).alias("card_idx", "card"))


def conv_units(spark, d):
    """Speech units of conversations: a turn is a story of one paragraph."""
    turns = texts(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", F.array("text").alias("paragraphs"))
    return units(turns, ["conv_id"], "turn").withColumn("nbytes", nbytes())


@query("units", f"""WITH RECURSIVE {S.conv_units()}
  SELECT conv_id, turn, s AS sent_idx, text, array_to_string(groups, '|') AS cards, ends_story FROM u""")
def _units(spark, d):
    return conv_units(spark, d).select("conv_id", "turn", "sent_idx", "text",
                                       F.array_join("groups", "|").alias("cards"), "ends_story")


@query("units_documents", f"""WITH RECURSIVE c AS (SELECT doc_id, {S.clean('text')} AS text FROM documents),
  {S.sentences('c', 'doc_id', 'text')}, {S.oversize('sent', 'doc_id')}
  SELECT doc_id, 0 AS story_idx, row_number() OVER (PARTITION BY doc_id ORDER BY k, p) - 1 AS sent_idx, text,
    array_to_string({S.cards('text')}, '|') AS cards,
    row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, p DESC) = 1 AS ends_story FROM part""")
def _units_documents(spark, d):
    stories = split_stories(texts(spark, d, "documents", "doc_id"), ["doc_id"])
    return units(stories, ["doc_id"]).select("doc_id", "story_idx", "sent_idx", "text",
                                             F.array_join("groups", "|").alias("cards"), "ends_story")
