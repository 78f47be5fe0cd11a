"""Sharding by a Feistel permutation of the global row numbers.  DataFrame and SQL functions only.

Rows are numbered 0 .. N-1 in the order (doc_id, size, crc32).  A generalised Feistel
network over Z_a x Z_b, with a = ceil(sqrt N) and b = ceil(N / a), permutes [0, ab); values
of N or more are sent through it again until they fall below N (cycle walking).  The
permuted number p gives shard p mod S and slot p div S, so shard sizes differ by one row
at most, every shuffle is reproducible from the key, and a row's place is computable.

The numbering needs no single task: fixed splitters on doc_id deal rows to buckets that are
numbered separately, and the buckets' sizes (a bounded list) give the offsets.

Edge cases: a null text has size 16 and crc32 0; null doc_ids come first; rows equal in
(doc_id, size, crc32) are interchangeable, and each gets its own slot; an empty table gives
an empty result; other columns are ignored.  The law is ``rows``, so ``grown_shard`` is null;
rows with equal texts are not kept together, which this law could not allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ROUNDS = 6
PRIME = 2147483647
BUCKETS = 512


def round_keys(key: int) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, below the prime, by a linear congruence from the key."""
    out, x = [], (key * 48271 + 11) % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 12345) % PRIME
        y = (x * 48271 + 12345) % PRIME
        out.append((x | 1, y))
        x = y
    return out


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    return a, max(1, -(-n // a))


def walk_steps(n: int) -> int:
    """A walk leaves [N, ab) after at most ab - N + 1 steps; beyond 64 its chance is below (1 / sqrt N) ** 64."""
    a, b = domain(n)
    return min(64, a * b - n + 1)


def permuted_py(x: int, n: int, key: int) -> int:
    """The same permutation for one number, for readers that look up a row's place."""
    a, b = domain(n)
    while True:
        left, right = x % a, x // a
        for i, (m, c) in enumerate(round_keys(key)):
            if i % 2 == 0:
                left = (left + _mix_py(right, m, c)) % a
            else:
                right = (right + _mix_py(left, m, c)) % b
        x = left + a * right
        if x < n:
            return x


def _mix_py(v: int, m: int, c: int) -> int:
    h = ((v % PRIME) * m + c) % PRIME
    return (h * h + m) % PRIME


def permuted(x: Column, n: int, key: int) -> Column:
    """Feistel rounds as nested structs inside one fold, walked until the value is below ``n``."""
    a, b = (F.lit(v).cast("long") for v in domain(n))
    keys = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for i, (m, c) in enumerate(round_keys(key))])

    def mix(v: Column, k: Column) -> Column:
        h = F.pmod(F.pmod(v, F.lit(PRIME).cast("long")) * k["m"] + k["c"], F.lit(PRIME).cast("long"))
        return F.pmod(h * h + k["m"], F.lit(PRIME).cast("long"))

    def one(half: Column, k: Column) -> Column:
        even = k["odd"] == 0
        return F.struct(
            F.when(even, F.pmod(half["l"] + mix(half["r"], k), a)).otherwise(half["l"]).alias("l"),
            F.when(even, half["r"]).otherwise(F.pmod(half["r"] + mix(half["l"], k), b)).alias("r"),
        )

    def once(v: Column) -> Column:
        start = F.struct(F.pmod(v, a).alias("l"), F.call_function("div", v, a).alias("r"))
        return F.aggregate(keys, start, one, lambda h: h["l"] + a * h["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(max(2, walk_steps(n)))), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def _bucket(cuts: list[int]) -> Column:
    """How many cuts lie below doc_id, by a search of two levels; null: 0."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))
    coarse = below(literal([g[-1] for g in groups]))
    fine = F.coalesce(below(F.get(F.array(*map(literal, groups)), coarse)), F.lit(0))
    return F.when(F.col("doc_id").isNull(), 0).when(coarse >= len(groups), len(cuts)).otherwise(coarse * width + fine)


def shard(docs: DataFrame, shards: int = 40, key: int = 20260101) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number`` for every row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    # splitters may be rough: any choice numbers the rows alike
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / BUCKETS for i in range(1, BUCKETS)], 0.5 / BUCKETS)})
    sizes = {r["bucket"]: r["count"] for r in ids.groupBy(_bucket(cuts).alias("bucket")).count().collect()}  # BUCKETS rows at most
    n, offset, offsets = sum(sizes.values()), 0, []
    for i in range(len(cuts) + 1):
        offsets.append(offset)
        offset += sizes.get(i, 0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(shared.text_or_empty()).cast("long") + 16).alias("size"),
        F.crc32(F.encode(shared.text_or_empty(), "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumn("bucket", _bucket(cuts))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    start = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("bucket"))
    numbered = rows.withColumn("row_number", start + F.row_number().over(order) - 1)
    placed = numbered.withColumn("p", permuted(F.col("row_number"), max(n, 1), key))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("p", F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.call_function("div", F.col("p"), F.lit(shards).cast("long")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
