"""The trie of all conversation prefixes, built from adaptive radix trees.

Every turn has a fixed-width id (a 64-bit hash of role and text), and a conversation
is the string of its ids in big-endian order.  Tasks insert such strings into radix
trees and emit one row for every prefix of whole turns, with the number of keys
below it and the least conversation among them.  A prefix has the same name in every
task: the exclusive or of a hash of each turn and its place.  So rows of one prefix
from several tasks are added up, and it does not matter how keys are dealt.  They
are dealt by range, which puts common prefixes together, after equal keys have
become one with a count: neither copies nor a first turn that very many
conversations share make one task larger.

A long conversation is cut into stretches of 64 turns.  A stretch is a key in the
tree of the prefix before it, so that no task holds a whole conversation.  Sums over
subtrees are taken by pointer doubling: after k rounds a node has the sum of its
descendants less than 2**k below it, and knows its ancestor 2**k above.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.running import running_before
from .radix import RadixTree
from .rows import Steps, shuffle_width

STRETCH = 64          # turns
_TREE_KEYS = 1 << 16  # keys in one tree before it is emitted
_BLOCK = 4096
_WIDTH = 8            # bytes of a turn id
_NODE = "node long, parent long, depth long, words long, n_convs long, conv_id long"


def identified_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, tid, words): the turns of every conversation, numbered from 0.

    Turns stand in the order of their number, null first; equal numbers in the order
    of the turn ids.  Null roles and texts are empty; rows without ``conv_id`` belong
    to no conversation and are left out.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.coalesce(turn, F.lit(0)).alias("turn"),
        turn.isNull().alias("unnumbered"),
        F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("tid"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    block = F.when(F.col("unnumbered"), F.lit(-(1 << 62))).otherwise(F.shiftright("turn", 8))
    return running_before(rows, ["c"], [[block], [F.col("turn"), F.col("tid")]], {"pos": (F.lit(1), "long")}).select(
        "c", "pos", "tid", "words")


def swapped_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does.

    Conversation c gets the first h turns of conversation c - c % ``group`` (all if
    that has fewer, none if there is none), then its own turns after its first h;
    h is crc32(c) % ``most``.  Returns the turns (c, pos, tid, words) and the
    conversations that are left without any (c).
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("size")).select(
        "c", "size", (F.col("c") - F.col("c") % group).alias("base"),
        (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h"))
    bases = sizes.filter("c = base").select("base", F.col("size").alias("base_size"))
    heads = turns.filter((F.col("c") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("c", "base")
    plan = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    own = turns.join(plan.select("c", "h", "taken"), "c").filter("pos >= h").select(
        "c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "words")
    taken = plan.join(heads, "base").filter("pos < h").select("c", "pos", "tid", "words")
    left = plan.filter("taken = 0 AND size <= h").select("c")
    return own.unionByName(taken), left


def _stretches(turns: DataFrame) -> DataFrame:
    """(c, stretch, key, words, names, all): up to 64 turns of a conversation in a row."""
    named = turns.select("c", "pos", F.floor(F.col("pos") / STRETCH).cast("long").alias("stretch"), "tid", "words",
                         F.xxhash64("tid", "pos").alias("name"))
    rows = named.groupBy("c", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("pos", "tid", "words", "name"))).alias("t"), F.bit_xor("name").alias("all"))
    key = F.unhex(F.array_join(F.transform("t.tid", lambda i: F.lpad(F.hex(i), 2 * _WIDTH, "0")), ""))
    return rows.select("c", "stretch", key.alias("key"), F.col("t.words").alias("words"), F.col("t.name").alias("names"), "all")


def _rooted(stretches: DataFrame) -> DataFrame:
    """Stretches with the name of the prefix before them (``root``), the first with 0."""
    def before(column: str, *within: str, order: str) -> Column:
        window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(column).over(window), F.lit(0))

    slim = stretches.select("c", "stretch", "all", F.floor(F.col("stretch") / _BLOCK).alias("block"))
    blocks = slim.groupBy("c", "block").agg(F.bit_xor("all").alias("all")).select(
        "c", "block", before("all", "c", order="block").alias("above"))
    roots = (slim.select("c", "stretch", "block", before("all", "c", "block", order="stretch").alias("inside"))
             .filter("stretch > 0").join(blocks, ["c", "block"])
             .select("c", "stretch", F.col("above").bitwiseXOR(F.col("inside")).alias("root")))
    return stretches.filter("stretch = 0").withColumn("root", F.lit(0).cast("long")).unionByName(
        stretches.filter("stretch > 0").join(roots, ["c", "stretch"]))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the radix trees of keys that come ordered by root."""
    tree, root, stretch, kept = RadixTree(), None, 0, []

    def nodes() -> pa.RecordBatch:
        found = np.array(list(tree.aligned(_WIDTH)), np.int64).reshape(-1, 4)
        turns, number, count, least = found.T
        sizes = np.array([len(names) for names, _ in kept])
        start = np.cumsum(sizes) - sizes
        names = np.concatenate([names for names, _ in kept])
        words = np.concatenate([words for _, words in kept])
        passed = np.concatenate([[0], np.bitwise_xor.accumulate(names)])
        at = start[number] + turns
        name = passed[at] ^ passed[start[number]] ^ root
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (name, name ^ names[at - 1], turns + stretch * STRETCH, words[at - 1], count, least)],
            names=["node", "parent", "depth", "words", "n_convs", "conv_id"])

    for batch in batches:
        columns = [batch.column(c) for c in ("root", "stretch", "key", "n_convs", "conv_id")]
        names, words = batch.column("names"), batch.column("words")
        edges = names.offsets.to_numpy()
        names, words = names.values.to_numpy(), words.values.to_numpy()
        for i, (r, s, key, count, least) in enumerate(zip(*[c.to_pylist() for c in columns])):
            if kept and (r != root or len(kept) >= _TREE_KEYS):
                yield nodes()
                tree, kept = RadixTree(), []
            root, stretch = r, s
            tree.insert(key, len(kept), count, least)
            kept.append((names[edges[i]:edges[i + 1]], words[edges[i]:edges[i + 1]]))
    if kept:
        yield nodes()


def trie_nodes(stretches: DataFrame) -> DataFrame:
    """(node, parent, depth, words, n_convs, conv_id) of every prefix of one turn and more."""
    keys = _rooted(stretches).groupBy("root", "stretch", "key", "words", "names").agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"))
    width = shuffle_width(stretches.sparkSession)
    parts = keys.repartitionByRange(width, "root", "key").sortWithinPartitions("root", "key").mapInArrow(_grow, _NODE)
    return parts.groupBy("node", "parent", "depth", "words").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def subtree_sums(nodes: DataFrame, values: list[str], steps: Steps) -> DataFrame:
    """(node, values): sums over every node of (node, parent, depth, values) and all nodes below it."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now = steps.write(nodes.select("node", F.col("parent").alias("up"), "depth", *values))
    reach = 1
    while reach <= deepest:
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
            *[F.sum(v).alias(f"more_{v}") for v in values])
        far = now.filter(F.col("depth") >= 2 * reach)
        next_up = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = far.join(next_up, "up").select("node", F.col("next").alias("up"), "depth", *values).unionByName(
            now.filter(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("long")))
        summed = moved.join(below, "node", "left").select(
            "node", "up", "depth", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        before, now = now, steps.write(summed)
        steps.drop(before)
        reach *= 2
    return now.select("node", *values)


def _texts_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in order, as one text each."""
    for batch in batches:
        node, ids = batch.column("node").to_numpy(), batch.column("c").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        ends = [*edge[1:], len(node)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[edge]), pa.array(ids[edge]), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(edge, ends)], pa.string())],
            names=["node", "first", "ids"])


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, sha, done = None, None, []
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != current:
                if sha is not None:
                    done.append((current, sha.hexdigest()))
                current, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        yield _hashed(done)
        done = []
    if sha is not None:
        yield _hashed([(current, sha.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                                      names=["node", "ends_sha256"])


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids of each node, in order and joined by commas.

    The ids of a node are put into text where a range of them lies; the hash itself,
    which has to see them one after another, reads only those few long texts.
    """
    width = shuffle_width(ends.sparkSession)
    texts = ends.repartitionByRange(width, "node", "c").sortWithinPartitions("node", "c").mapInArrow(
        _texts_of_ids, "node long, first long, ids string")
    return texts.repartition(width, "node").sortWithinPartitions("node", "first").mapInArrow(
        _hash_texts, "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """Every prefix of the conversations, as one row.

    ``turns`` holds (c, pos, tid, words) with positions from 0 without gaps,
    ``turnless`` the conversations (c) without turns.  Returns conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; without any conversation there is no row.  Repeated rows are turns
    of their own.
    """
    steps = Steps(turns.sparkSession)
    stretches = steps.write(_stretches(turns))
    ends = steps.write(stretches.groupBy("c").agg(F.bit_xor("all").alias("node")).select("node", "c").unionByName(
        turnless.select(F.lit(0).cast("long").alias("node"), "c")))
    root = ends.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = steps.write(trie_nodes(stretches).unionByName(root))
    steps.drop(stretches)

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes, bare = steps.write(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))), nodes
    steps.drop(bare)
    sums = subtree_sums(nodes.select(
        "node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], steps)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.filter("parent IS NOT NULL").join(parents, "parent").unionByName(
        nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return placed.join(sums, "node").join(id_hashes(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
