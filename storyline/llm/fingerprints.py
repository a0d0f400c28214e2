"""One-permutation MinHash fingerprints, as column expressions only.

Every distinct shingle of ``words`` words is hashed once; the high bits choose
one of 256 bins and each bin keeps its least hash.  An empty bin takes the value
of another bin by optimal densification: it asks the bins of a random sequence of
its own and borrows from the first that has a value.  Four low-order bits per bin
are stored, so a fingerprint has 128 bytes whatever the text's length.  Two
fingerprints agree in a bin with probability J + (1 - J) / 16, which
``likeness`` corrects.

Texts of fewer words are one shingle.  Null counts as the empty text; a text
without words has the empty fingerprint, alike (1.0) only to another such text.
"""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import shuffle_width

BINS = 256
_BIN_SHIFT = 55
_LOW = (1 << _BIN_SHIFT) - 1
_TRIES = 8
_PRIME = 2_147_483_647
_LEAST_ID = -(1 << 63)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingle_hashes(words: Column, n: int) -> Column:
    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(n)]).bitwiseAND((1 << 63) - 1)

    # a missing word is null and leaves the hash as it is, so short texts are one shingle
    last = F.greatest(F.size(words) - n, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(
        F.array().cast("array<bigint>"))


def _bin(value: Column) -> Column:
    return F.shiftright(value, _BIN_SHIFT)


def _filled(value: Column) -> Column:
    return value.bitwiseAND(_LOW) != _LOW


def _bins(hashes: Column) -> Column:
    """The least hash of each bin.  The greatest value of a bin marks an empty one."""
    marks = F.array(*[F.lit((b << _BIN_SHIFT) | _LOW) for b in range(BINS)])
    return let(F.sort_array(F.concat(hashes, marks)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _densified(bins: Column) -> Column:
    """Fill empty bins: eight tries of the bin's own sequence, then the rest of it at once.

    The first filled bin of a random order is the filled bin with the least random
    number, so what eight tries miss needs no further loop.
    """
    rng = random.Random(7)
    draws = [(rng.randrange(1, _PRIME), rng.randrange(_PRIME)) for _ in range(_TRIES)]

    def donor(bins: Column, j: Column) -> Column:
        asked = [F.get(bins, ((j.cast("bigint") * a + b) % _PRIME % BINS).cast("int")) for a, b in draws]
        rest = F.array_min(F.transform(F.filter(bins, _filled), lambda v: F.struct(
            F.xxhash64(j, _bin(v)).alias("order"), v.alias("v"))))["v"]
        return F.coalesce(*[F.when(_filled(v), v) for v in asked], rest)

    return F.transform(bins, lambda v, j: F.when(_filled(v), v).otherwise(donor(bins, j)))


def _pack(bins: Column) -> Column:
    """Four low bits of each bin, sixteen bins to a bigint.

    The bits are hashed with the bin's number, so that a value lent to many bins
    does not agree by chance in all of them.
    """
    bits = F.transform(bins, lambda v, j: F.xxhash64(v, j).bitwiseAND(15))
    return let(bits, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda i: F.aggregate(
        F.slice(b, i * 16 + 1, F.lit(16)), F.lit(0).cast("bigint"),
        lambda acc, v: F.shiftleft(acc, 4).bitwiseOR(v))))


def fingerprint(text: Column, words: int = 5) -> Column:
    """The packed fingerprint: 16 bigints, or none for a text without words."""
    return let(_shingle_hashes_of(text, words), lambda h: F.when(
        F.size(h) > 0, let(let(_bins(h), _densified), _pack)).otherwise(F.array().cast("array<bigint>")))


def _shingle_hashes_of(text: Column, words: int) -> Column:
    return let(_words(text), lambda w: _shingle_hashes(w, words))


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1."""
    nibbles = 0x1111111111111111

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(
            F.shiftrightunsigned(d, 3))
        return F.bit_count(folded.bitwiseAND(nibbles))

    wrong = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, v: acc + v)
    raw = (F.lit(1.0) - wrong / BINS - 1.0 / 16) / (1.0 - 1.0 / 16)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))


def beside_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of consecutive keys, each with the first row of the block after it.

    Adds ``__block``, ``__guest`` and ``__key``.  The greatest key of every block
    is one of the split keys (approximate quantiles, a number given by the shuffle
    width), so a row knows without a join that it is also needed as a guest.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.coalesce(F.col(key).cast("bigint"), F.lit(_LEAST_ID)))
    n = 4 * shuffle_width(spark)
    row = keyed.agg(F.percentile_approx("__key", [(i + 1) / n for i in range(n)], 20 * n).alias("q"),
                    F.max("__key").alias("top")).first()
    splits = sorted({*(row.q or []), row.top} - {None}) or [0]
    table = F.array(*[F.lit(s) for s in splits])
    steps = [1 << i for i in range(len(splits).bit_length())][::-1]

    # binary search: how many splits lie below the key
    block = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(
        (low + s <= len(splits)) & (F.get(table, low + s - 1) < F.col("__key")), low + s).otherwise(low))
    placed = keyed.withColumn("__own", block)
    after = (F.col("__own") + 1) % len(splits)
    seats = F.when(F.get(table, F.col("__own")) == F.col("__key"), F.array(
        F.struct(F.col("__own").alias("b"), F.lit(0).alias("g")),
        F.struct(after.alias("b"), F.lit(1).alias("g")))).otherwise(
        F.array(F.struct(F.col("__own").alias("b"), F.lit(0).alias("g"))))
    return (placed.withColumn("__seat", F.explode(seats))
            .select(*docs.columns, "__key", F.col("__seat.b").alias("__block"), F.col("__seat.g").alias("__guest")))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the same text with its last third replaced.

    The replacement is the beginning of the next document's text in descending
    order of ``key`` (after the last: the first; equal keys by text; null lowest).
    Repeated rows each give a row; an empty table gives none.
    """
    rows = beside_next(docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("__text")), key, "__text")
    order = Window.partitionBy("__block").orderBy("__guest", F.col("__key").desc(), "__text")
    cut = F.floor(F.length("__text") / 3).cast("int")
    with_next = rows.withColumn("__next", F.lead("__text").over(order))
    edited = F.concat(F.expr("left(__text, length(__text) - cast(floor(length(__text) / 3) as int))"),
                      F.left(F.coalesce("__next", F.lit("")), cut))
    marked = with_next.select(
        key, "__key", "__block", "__guest", "__text", F.length("__text").cast("bigint").alias("n_chars"),
        let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("fp"))).alias("__e"),
        fingerprint(F.col("__text")).alias("__fp"))
    after = marked.withColumn("__next_fp", F.lead("__fp").over(order)).filter("__guest = 0")
    return after.select(
        key, "n_chars", F.col("__e.sha").alias("edited_sha256"), as_hex(F.col("__fp")).alias("fingerprint"),
        as_hex(F.col("__e.fp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__e.fp")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__next_fp")).alias("near_next"))
