"""MinHash near-dedup with b-bit signatures.

1. Each text's distinct word shingles become 64-bit hashes; ``MINIMA`` minima are taken.  Texts
   with the same shingle set (their digest) form a class, represented by its smallest doc_id,
   so copies are never expanded into pairs.
2. The rows of a band give a bucket.  In the first ``FIRST_BANDS`` bands each member of a bucket is
   paired with its smallest member, and never all with all.
3. ``BITS`` low bits of each mixed minimum are kept, packed in bit planes; the share of equal
   positions, counted by XOR and bit counts and corrected for chance, estimates the similarity,
   and pairs below the threshold by more than ``MARGIN`` standard deviations are dropped.
4. The rest are confirmed on their full shingle sets, and confirmed links give components.
5. Members of all buckets with one smallest member form a canopy.  Where a canopy still spans
   components, members of different components may be alike without either being like the
   smallest one.  There, set sizes and packed signatures pick the members that may have a
   partner in another component; the full sets of these come together once, and are compared
   exactly, the most a task reports being one link for each two components that it joins.
   A large canopy is dealt in blocks, each two of which meet in a task of their own.

A link at the threshold is missed by the bands with a chance of (1 - t ** rows) ** bands,
below 3e-7 as called here.

Edge cases: a null text or one without words has an empty set, is linked with nothing and
represents itself; a text with fewer words than a shingle has one shingle, the whole
sequence; repeated rows each get a row; rows with one doc_id and different texts are one
node, linked to whatever either is linked to; rows with a null doc_id join components
through equal texts only if a doc_id stands in the same class, else they are their own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components

BITS = 2
MINIMA = 512
MARGIN = 5.0
FIRST_BANDS = 2
#: Canopies are dealt over all tasks in blocks of no fewer members than this ...
LEAST_BLOCK = 128
#: ... and no more members, or shingles, than these.
MOST_MEMBERS, MOST_SHINGLES = 8192, 1 << 22
#: Bytes of text shingled together.
TEXT_BLOCK = 1 << 18
#: Pairs of signatures compared at once.
PAIRS = 1 << 17
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint32)
_WORD = (_RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def band_shape(threshold: float) -> tuple[int, int]:
    """Rows and bands: fewer rows for lower thresholds keep the chance of a miss below 3e-7 down to 0.8."""
    return (6, 32) if threshold >= 0.85 else (5, 40) if threshold >= 0.8 else (3, 64)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit shingle hashes."""
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    starts, ends = shared.word_spans(raw, bounds)
    hashes = shared.span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, bounds)
    n = len(hashes) - words + 1
    with np.errstate(over="ignore"):
        if n > 0:
            total = np.zeros(n, np.uint64)
            for i in range(words):
                total += shared.mix64(hashes[i : i + n] + _WORD[i]) * _WORD[i + words]
            total = shared.mix64(total)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(total[a : b - words + 1]))
            elif b > a:
                short = np.array([(shared.mix64(hashes[a:b] + _WORD[: b - a]) * _WORD[words : words + b - a]).sum() + np.uint64(b - a)], np.uint64)
                out.append(shared.mix64(short))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """``len(sets) x k`` minima of 32-bit hashes; all sets must have elements."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    base = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), k), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(k):
            out[:, i] = np.minimum.reduceat((base * _MULTIPLY[i]) ^ _ADD[i], offsets)
    return out


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the low bits: ``bits * k / 64`` 64-bit words a row."""
    with np.errstate(over="ignore"):
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        low = low ^ (low >> np.uint32(12))
    planes = [np.packbits(((low >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(bits)]
    return np.concatenate(planes, 1)


def band_keys(m: np.ndarray, rows: int, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = m.reshape(len(m), bands, rows).astype(np.uint64)
        total = np.full((len(m), bands), np.uint64(0)) + np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            total = shared.mix64(total * shared.ODD64 + parts[:, :, r])
    return total.view(np.int64)


def signatures(docs: DataFrame, words: int, rows: int, bands: int, bits: int = BITS, k: int = MINIMA) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, planes``; digest, bands and planes are null for empty sets."""
    shared.prepare_python(docs.sparkSession)
    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, planes array<bigint>"

    def lists(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
        width = values.shape[1] if len(values) else 0
        sizes = np.zeros(n, np.int32)
        sizes[at] = width
        found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.ravel()), mask=pa.array(sizes == 0))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        for batch in batches:
            for a, b, raw, bounds in shared.text_blocks(batch.column(1), TEXT_BLOCK):
                sets = shingle_sets(raw, bounds, words)
                at = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                full = [s for s in sets if len(s)]
                m = minima(full, k) if full else np.zeros((0, k), np.uint32)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(band_keys(m[:, : rows * bands], rows, bands), at, b - a), lists(packed(m, bits), at, b - a)],
                    ["doc_id", "n_shingles", "digest", "bands", "planes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def likeness(x: str, y: str, k: int = MINIMA, bits: int = BITS) -> Column:
    """Collision-corrected estimate: (share of equal b-bit values - 2**-b) / (1 - 2**-b)."""
    per = k // 64
    unequal = None
    for w in range(per):
        differ = None
        for p in range(bits):
            d = F.get(F.col(x), F.lit(p * per + w)).bitwiseXOR(F.get(F.col(y), F.lit(p * per + w)))
            differ = d if differ is None else differ.bitwiseOR(d)
        n = F.bit_count(differ)
        unequal = n if unequal is None else unequal + n
    chance = 2.0**-bits
    return (1.0 - unequal / float(k) - chance) / (1.0 - chance)


def least_likeness(threshold: float, k: int = MINIMA, bits: int = BITS) -> float:
    """The threshold less ``MARGIN`` standard deviations of the estimate."""
    chance = 2.0**-bits
    p = threshold + (1 - threshold) * chance
    return threshold - MARGIN * math.sqrt(p * (1 - p) / k) / (1 - chance)


def shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``rep, items`` (sorted distinct shingle hashes) of the documents in ``ids``.

    A merge join at every size: identifiers of candidates grow with the corpus and are not broadcast.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(ids.hint("merge"), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        for batch in batches:
            for a, b, raw, bounds in shared.text_blocks(batch.column(1), TEXT_BLOCK):
                sets = shingle_sets(raw, bounds, words)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "items"])

    return texts.select("rep", "text").mapInArrow(run, "rep bigint, items array<bigint>")


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets satisfy ``100 * intersection >= percent * union``.

    Each set is moved once for each pair that it is the larger identifier of; the smaller
    side's set is met by a join that can be split.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    sets = shared.hold(shingle_table(docs, ids, words))
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("items_a").alias("na"), F.size("items_b").alias("nb"), F.size(F.array_intersect("items_a", "items_b")).alias("both"))
    links = shared.materialise(met.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"), "links")
    shared.drop_held(docs.sparkSession, sets)
    return links


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, band, a, b``: every member b of a bucket of two or more, with the bucket's smallest member a."""
    member = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    smallest = member.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    return shared.materialise(member.join(smallest, "bucket").select("bucket", "band", "a", F.col("rep").alias("b")), "buckets")


def _canopies(starred: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, rep, root, n_shingles, planes``: all members of canopies with several components, ``a`` itself included."""
    placed = starred.select("a", F.col("b").alias("rep")).distinct().join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = shared.materialise(placed, "canopies")
    mixed = shared.materialise(placed.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("a"), "mixed-canopies")
    return placed.join(mixed, "a").join(classes.select("rep", "n_shingles", "planes"), "rep")


def _blocks(members: DataFrame) -> DataFrame:
    """Each member once for each two blocks of its canopy that it is in: ``i <= j`` are the blocks, ``side`` its own."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("total"))
    over_all = F.least(F.ceil(F.col("m") / LEAST_BLOCK), F.lit(math.ceil(math.sqrt(2 * parts))))
    sizes = shared.materialise(sizes.select("a", F.greatest(over_all, F.ceil(F.col("m") / MOST_MEMBERS), F.ceil(F.col("total") / MOST_SHINGLES)).cast("int").alias("k")), "canopy-blocks")
    dealt = members.join(sizes, "a").withColumn("side", F.pmod(F.xxhash64("rep"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "k")
    return dealt.repartition(parts, "a", "i", "j").sortWithinPartitions("a", "i", "j")


def _groups(rows: pa.Table) -> np.ndarray:
    """Starts of the groups of equal (a, i, j) in sorted rows, and the number of rows."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in ("a", "i", "j"):
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(rows))


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows with the starts of their groups; no group is cut, and beyond ``most`` bytes only one is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            bounds = _groups(rows)
            if len(bounds) > 2:
                yield rows.slice(0, int(bounds[-2])), bounds[:-1]
                held = rows.slice(int(bounds[-2])).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _groups(rows)


def _fixed_lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def possible_pairs(rows: pa.Table, bounds: np.ndarray, percent: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y), x before y, of one group, different components and compatible sizes whose signatures allow a link."""
    n, root, side = (rows.column(c).to_numpy() for c in ("n_shingles", "root", "side"))
    planes = _fixed_lists(rows.column("planes"), MINIMA // 64 * BITS).view(np.uint64)
    own = rows.column("i").to_numpy() == rows.column("j").to_numpy()
    end = np.repeat(bounds[1:], np.diff(bounds))
    partners = end - np.arange(len(end)) - 1
    total = np.concatenate(([0], np.cumsum(partners)))
    chance = 2.0**-BITS
    at = 0
    while at < len(partners):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        size = partners[at:to]
        x = np.repeat(np.arange(at, to), size)
        y = x + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = to
        fit = (own[x] | (side[x] != side[y])) & (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        per, unequal = MINIMA // 64, np.zeros(len(x), np.int64)
        for w in range(per):
            differ = planes[x, w] ^ planes[y, w]
            for p in range(1, BITS):
                differ |= planes[x, p * per + w] ^ planes[y, p * per + w]
            unequal += np.bitwise_count(differ)
        alike = np.flatnonzero((1 - unequal / MINIMA - chance) / (1 - chance) >= least)
        if len(alike):
            yield x[alike], y[alike]


def _open_members(batches: Iterator[pa.RecordBatch], percent: int, least: float) -> Iterator[pa.RecordBatch]:
    """``a, rep`` of members that may be linked to another component."""
    for rows, bounds in _whole_groups(batches, shared.BATCH_BYTES):
        marked = np.zeros(len(rows), bool)
        for x, y in possible_pairs(rows, bounds, percent, least):
            marked[x] = marked[y] = True
        if marked.any():
            yield rows.select(["a", "rep"]).filter(pa.array(marked)).combine_chunks().to_batches()[0]


def _joining_links(batches: Iterator[pa.RecordBatch], percent: int, least: float) -> Iterator[pa.RecordBatch]:
    """``a, b``: confirmed links between the groups' members, each joining two components that no link before it did."""
    for rows, bounds in _whole_groups(batches, 4 * shared.BATCH_BYTES):
        n, root, rep = (rows.column(c).to_numpy() for c in ("n_shingles", "root", "rep"))
        items = rows.column("items").combine_chunks()
        offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        found: list[tuple[int, int]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            pairs = list(possible_pairs(rows.slice(lo, hi - lo), np.array([0, hi - lo]), percent, least))
            if not pairs:
                continue
            x, y = (np.concatenate(p) for p in zip(*pairs))
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            own = offsets[lo : hi + 1] - offsets[lo]
            token = np.unique(items.slice(lo, hi - lo).flatten().to_numpy(), return_inverse=True)[1]
            mine = np.zeros(token.max() + 1, bool)
            label = np.unique(root[lo:hi], return_inverse=True)[1]
            cuts = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)).tolist()
            for c, d in zip(cuts[:-1], cuts[1:]):
                one, others = int(x[c]), y[c:d]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                mine[token[own[one] : own[one + 1]]] = True
                size = own[others + 1] - own[others]
                ends = np.cumsum(size)
                both = np.add.reduceat(mine[token[np.repeat(own[others] - ends + size, size) + np.arange(ends[-1])]].astype(np.int64), ends - size)
                mine[token[own[one] : own[one + 1]]] = False
                for other in others[100 * both >= percent * (n[lo + one] + n[lo + others] - both)].tolist():
                    if label[other] != label[one]:
                        label[label == label[other]] = label[one]
                        found.append((lo + one, lo + other))
        if found:
            p, q = (rep[list(k)] for k in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])


def links_between(docs: DataFrame, canopies: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: confirmed links that, with the components there are, give those of all pairs within a canopy."""
    least = least_likeness(percent / 100)
    fields = "a bigint, rep bigint"
    members = shared.materialise(canopies, "canopy-members")
    dealt = _blocks(members).select("a", "i", "j", "side", "rep", "root", "n_shingles", "planes")
    open_ = shared.materialise(dealt.mapInArrow(lambda x: _open_members(x, percent, least), fields).distinct(), "open-members")
    sets = shared.hold(shingle_table(docs, open_.select("rep").distinct(), words))
    met = members.join(open_, ["a", "rep"], "left_semi").join(sets, "rep")
    dealt = _blocks(met).select("a", "i", "j", "side", "rep", "root", "n_shingles", "planes", "items")
    links = shared.materialise(dealt.mapInArrow(lambda x: _joining_links(x, percent, least), "a bigint, b bigint").distinct(), "links")
    for table in (members, open_):
        shared.drop_table(table)
    shared.drop_held(docs.sparkSession, sets)
    return links


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    spark = docs.sparkSession
    rows, bands = band_shape(percent / 100)
    least = least_likeness(percent / 100)
    signed = shared.hold(signatures(docs, words, rows, bands))
    classes = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("planes").alias("planes"), F.first("n_shingles").alias("n_shingles"))
    classes = shared.materialise(classes, "classes")
    planes = classes.select("rep", "planes")
    starred = _buckets(classes)
    shared.release_shuffles(spark)

    def likely(pairs: DataFrame) -> DataFrame:
        met = pairs.join(planes.select(F.col("rep").alias("b"), F.col("planes").alias("pb")), "b").join(planes.select(F.col("rep").alias("a"), F.col("planes").alias("pa")), "a")
        return met.where(likeness("pa", "pb") >= least).select("a", "b")

    candidates = likely(starred.where(f"band < {FIRST_BANDS} and a <> b").select("a", "b").distinct())
    links = confirmed(docs, shared.materialise(candidates, "candidates"), words, percent)
    roots = components(links)
    shared.release_shuffles(spark)
    more = links_between(docs, _canopies(starred, roots, classes), words, percent)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    shared.drop_table(starred)
    shared.release_shuffles(spark)

    class_root = classes.select("digest", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(class_root, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group; rows without a doc_id stay."""
    groups = near_groups(docs, words, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text")
    nth = shared.free_name(docs, "_nth")
    rows = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))
