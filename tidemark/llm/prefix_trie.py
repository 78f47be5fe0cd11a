"""Prefix trie of conversations by truncation peeling.

A turn is a fixed-size element: the MD5 of its role and text and the number of its words.  A
rebuilt conversation is the string of its elements (its path), and a node of the trie is a
path's prefix.  Conversations that end at one path are merged first.  Then the trie is peeled
from the deepest level upwards: the surviving nodes of a level and the conversations that end
there are merged by path, which completes the nodes, with their members, children, leaves and
savings; each loses its last turn and is a contribution to the level above.

The levels next to the root, where few prefixes may hold many conversations, are peeled one at a
time by a grouping that is combined before it is moved.  Deeper levels are peeled in bands: what
shares the prefix at a band's top lies in one task, sorted, and is peeled there with a stack no
larger than the band.  A prefix with over a thousandth of a band's paths is peeled through the
band's lower half first, and a band of one level is a grouping again; so no group has to fit a task.

The hash of the members that end at a node is sequential by definition: their ids are put into
strings of up to ``BLOCK`` numbers, and one task reads a node's strings in order.

Edge cases: a null role or text is empty; null turns come first, and equal turns of a conversation
are in the order of their elements, repeated ones both kept; rows without a conv_id belong to no
conversation and are left out; other columns are ignored; an empty table gives no rows.  A path is
one value (20 bytes a turn), so a conversation has at most some hundred million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of an element, of which the last four are the number of words.
ELEMENT = 20
GROUP, HEADS = 20, 4
#: Levels next to the root that are always peeled one by one.
SHALLOW = 4
HOT, LEAST_HOT = 1000, 64
BLOCK = 256
CHUNK = 2000
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = "[^\\x20\\x09-\\x0D]+"
NODE = "key binary, parent binary, depth int, n_convs bigint, conv_id bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, path binary"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, depth``: the first turns of the group's first conversation, then the rest of one's own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    element = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), (conv - conv % GROUP).alias("first"), F.col("turn").cast("long").alias("turn"), element.alias("element"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle, by the group of 20 conversations
    turns = turns.repartition(parts, "first")
    own = turns.groupBy("first", "conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "element"))), lambda x: x["element"]).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("first"), F.slice("own", 1, HEADS - 1))).over(_within("first"))
    own = own.withColumn("head", F.coalesce(head, F.array().cast("array<string>"))).withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS).cast("int"))
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return own.select("conv_id", turns.alias("turns")).select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"), F.size("turns").alias("depth"))


def _within(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def ended(convs: DataFrame) -> DataFrame:
    """Conversations of one path merged: ``path, depth, n_convs, conv_id, ends``."""
    block = F.call_function("div", F.col("conv_id"), F.lit(BLOCK))
    # ids are distinct: a block of them has at most BLOCK rows (twice that around zero)
    strings = convs.groupBy("path", "depth", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = strings.repartition(parts, "path").sortWithinPartitions("path", "block").select("path", "depth", "n", "conv_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for path, depth, n, conv, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now and now[0] == path:
                    now[2] += n
                    now[3] = min(now[3], conv)
                    now[4].update(b"," + ids.encode())
                else:
                    if now:
                        out.append(now)
                    now = [path, depth, n, conv, hashlib.sha256(ids.encode())]
                if len(out) >= CHUNK:
                    yield _ended_batch(out)
                    out = []
        if now:
            yield _ended_batch([*out, now])

    return sorted_.mapInArrow(run, "path binary, depth int, n_convs bigint, conv_id bigint, ends string")


def _ended_batch(rows: list) -> pa.RecordBatch:
    path, depth, n, conv, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.binary()), pa.array(depth, pa.int32()), pa.array(n, pa.int64()), pa.array(conv, pa.int64()), pa.array([s.hexdigest() for s in sha])], ["path", "depth", "n_convs", "conv_id", "ends"])


def _key(path: Column) -> Column:
    return F.unhex(F.md5(path))


def _cut(path: Column, depth: Column) -> Column:
    return F.substring(path, F.lit(1), depth * ELEMENT)


def stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Complete nodes of one level as contributions to the level above."""
    return nodes.where(F.col("depth") == depth).select(
        _cut(F.col("path"), F.lit(depth - 1)).alias("path"), (F.col("depth") - 1).alias("depth"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends")
    )


def _arrived(ends: DataFrame, low: int, high: int) -> DataFrame:
    """Conversations that end above ``low``, down to ``high``."""
    zero = F.lit(0).cast("long")
    return ends.where((F.col("depth") > low) & (F.col("depth") <= high)).select("path", "depth", "n_convs", "conv_id", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "ends")


def _level(rows: DataFrame) -> DataFrame:
    """One level: contributions and ended conversations merged by path."""
    words = F.conv(F.hex(F.substring("path", -4, 4)), 16, 10).cast("long")
    merged = rows.groupBy("path", "depth").agg(*[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"))
    return merged.select(
        _key(F.col("path")).alias("key"), F.when(F.col("depth") > 0, _key(_cut(F.col("path"), F.col("depth") - 1))).alias("parent"), "depth", "n_convs", "conv_id", "n_children",
        F.greatest("n_leaves", (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * words).otherwise(0)).alias("saved"), "ends", "path",
    )


class _Stack:
    """Peels a sorted run of paths down to depth ``low + 1``; what it pops is complete."""

    def __init__(self, low: int):
        self.low, self.path, self.open, self.out = low, b"", [], []

    def pop(self, depth: int) -> None:
        """Completes the open nodes deeper than ``depth``."""
        while self.open and self.low + len(self.open) > depth:
            at = self.low + len(self.open)
            n, conv, children, leaves, saved, ends, key = self.open.pop()
            below = self.open[-1] if self.open else None
            leaves = leaves or 1
            saved += (n - 1) * int.from_bytes(self.path[at * ELEMENT - 4 : at * ELEMENT], "big")
            top = below is None
            parent = hashlib.md5(self.path[: self.low * ELEMENT]).digest() if top else below[6].digest()
            self.out.append((key.digest(), parent, at, n, conv, children, leaves, saved, ends, self.path[: at * ELEMENT] if top else None))
            if below:
                below[0] += n
                below[1] = min(below[1], conv)
                below[2] += 1
                below[3] += leaves
                below[4] += saved

    def push(self, path: bytes, depth: int, n: int, conv: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
        shared_, most = self.low if self.open else 0, min(len(path), len(self.path)) // ELEMENT
        if self.open:
            # levels in common: a binary search, as equal prefixes are equal strings
            lo, hi = 0, min(most, self.low + len(self.open))
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if path[: mid * ELEMENT] == self.path[: mid * ELEMENT]:
                    lo = mid
                else:
                    hi = mid - 1
            shared_ = lo
            self.pop(max(shared_, self.low))
        self.path = path
        for at in range(self.low + len(self.open) + 1, depth + 1):
            key = self.open[-1][6].copy() if self.open else hashlib.md5(path[: (at - 1) * ELEMENT])
            key.update(path[(at - 1) * ELEMENT : at * ELEMENT])
            self.open.append([0, conv, 0, 0, 0, None, key])
        node = self.open[-1]
        node[0] += n
        node[1] = min(node[1], conv)
        node[2] += children
        node[3] += leaves
        node[4] += saved
        node[5] = node[5] or ends


def _node_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in NODE.split(", ")])


def _in_tasks(rows: DataFrame, low: int) -> DataFrame:
    """A band where what shares the prefix at its top lies in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("top", _cut(F.col("path"), F.lit(low + 1))).repartition(parts, "top").sortWithinPartitions("path").select("path", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(low)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                stack.push(*row)
                if len(stack.out) >= CHUNK:
                    yield _node_batch(stack.out)
                    stack.out = []
        stack.pop(low)
        if stack.out:
            yield _node_batch(stack.out)

    return placed.mapInArrow(run, NODE)


def peel(rows: DataFrame, low: int, high: int, tables: list[DataFrame]) -> DataFrame | None:
    """Completes the nodes of the levels ``high`` .. ``low + 1``, which join ``tables``; returns those of the last, or None if there is none."""
    if high - low == 1:
        done = shared.materialise(_level(rows), f"trie-{high}")
        tables.append(done)
        return done
    top = _cut(F.col("path"), F.lit(low + 1))
    counts = rows.groupBy(_key(top).alias("top_key")).count()
    n = rows.count()
    hot = counts.where(F.col("count") > max(n // HOT, LEAST_HOT)).select("top_key")  # below 1000 rows, or n / 64 of fewer than 64,000
    keyed = rows.withColumn("top_key", _key(top))
    out = []
    if hot.isEmpty():
        cold = rows
    else:
        cold = keyed.join(F.broadcast(hot), "top_key", "left_anti").drop("top_key")
        warm = shared.materialise(keyed.join(F.broadcast(hot), "top_key", "left_semi").drop("top_key"), "trie-hot")
        half = (low + high) // 2
        lower = peel(warm.where(F.col("depth") > half), half, high, tables)
        rest = warm.where(F.col("depth") <= half)
        out.append(peel(rest.unionByName(stripped(lower, half + 1)), low, half, tables))
    done = shared.materialise(_in_tasks(cold, low), f"trie-{high}")
    tables.append(done)
    out.append(done)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def levels(deepest: int) -> list[tuple[int, int]]:
    """Bands from the deepest to the root: the first ``SHALLOW`` levels alone, each deeper band twice as deep as the one above it."""
    out = [(d - 1, d) for d in range(min(deepest, SHALLOW) + 1)]
    low, size = SHALLOW, 2 * SHALLOW
    while low < deepest:
        out.append((low, min(low + size, deepest)))
        low, size = low + size, 2 * size
    return out[::-1]


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row a node."""
    spark = conversations.sparkSession
    shared.prepare_python(spark)
    ends = shared.materialise(ended(rebuilt(conversations)), "trie-ends")
    deepest = ends.agg(F.max("depth")).first()[0]
    tables: list[DataFrame] = []
    last = None
    for low, high in levels(deepest if deepest is not None else 0):
        rows = _arrived(ends, low, high)
        if last is not None:
            rows = rows.unionByName(stripped(last, high + 1))
        last = peel(rows, low, high, tables)
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    # a parent with very many children would be one task of the join: there are below 1000 of them, and they are sent to all
    n = nodes.count()
    upper = nodes.where("n_children > 0").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = F.col("n_children") > max(n // HOT, LEAST_HOT)
    sent = upper.where(wide).select("above", F.col("parent_conv_id").alias("wide_conv_id"))
    met = nodes.join(F.broadcast(sent), nodes["parent"] == sent["above"], "left").drop("above")
    rest = upper.where(~wide).drop("n_children")
    # rows that are settled by now, and the root, are spread over the tasks of the second join
    salted = F.when(F.col("wide_conv_id").isNull() & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("key"))
    met = met.withColumn("sought", salted).join(rest, F.col("sought") == F.col("above"), "left")
    parent = F.when(F.col("parent").isNull(), None).otherwise(F.coalesce("wide_conv_id", "parent_conv_id"))
    return met.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
