"""Suffix-array dedup by distributed prefix doubling over sampled positions.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier.
Prefix doubling sorts positions by pairs of ranks at growing offsets until a rank is
unique or the prefix passes the threshold.  Doing so for every byte would move a row per
byte in each round, several times the allowed disk, so the first rounds run where the
text is: the rank of a position's first byte is doubled to those of 2, 4, ... ``GRAM``
bytes inside the block.  Only equality of ranks is needed, so a rank is a name: a hash of
what it ranks.  Of the positions in a ``length``-byte string, the one with the least rank
represents it (equal strings choose alike, wherever they stand), which leaves about two
positions in ``length - GRAM`` bytes for the distributed rounds:

1. Spark sorts the positions by the pair (rank of the gram, rank of the whole stretch of
   strings that the position represents).  A unique gram proves all of these strings
   unique and ends there; a repeated pair proves all but its earliest occurrence repeated.
2. What is left are grams with several different stretches.  They are cut into pieces of
   ``SIZES`` strings, the same distances from the position everywhere, and ranked by what all
   strings of a piece share, which grows by that: a piece of n strings shares ``length`` - n + 1
   bytes, whose rank is the pair of the ranks at twice ``GRAM`` bytes from either end.  Again
   Spark sorts pairs (rank of what is shared, rank of the whole piece); unique ones end,
   repeated pairs are settled, and the rest is cut anew, until a piece is one string and both
   ranks are those of its ``length`` bytes: all but the earliest of equal ones are repeated.

Equal pairs are combined in each map task before they are moved, so a passage held by a
third of all documents sends one row per task and not one per document.  Two names of 64
bits decide about removal.  Grams that a sample of the texts shows to be in over a
``MOST_HOT``-th of all positions (so there are fewer than that many) are dealt by their
stretches and go on to the second round; later rounds count with partial sums, and join what
they counted so that Spark can split a frequent rank.

Edge cases: a null text counts as empty; a null doc_id comes after all others; rows are
told apart by doc_id and the text's digest, so rows with one doc_id (or none) and different
texts are different documents in the order of their digests, and rows equal in both are
copies of one document (none removes bytes of another at the same start); texts shorter than
``length`` keep all bytes unless covered; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LENGTH = 100
GRAM = 32
#: Positions that one map task holds at most before it combines and sends them.
HELD = 1 << 20
#: One text in so many is looked at for hot grams; of its positions, hot ones have at least LEAST_HOT and a MOST_HOT-th.
SAMPLE, LEAST_HOT, MOST_HOT = 64, 512, 1000
ID = "nil boolean, doc bigint, digest bigint"
OWNER = ["nil", "doc", "digest"]
ODD = shared.ODD64
#: Strings of a piece in the rounds after the first.
SIZES = (16, 4, 1)


def gram_ranks(raw: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the ``size``-byte prefixes (a power of two) at every position, by doubling."""
    with np.errstate(over="ignore"):
        rank, step = shared._BYTE[raw], 1
        while step < size:
            rank = rank[: len(rank) - step] * np.uint64(pow(int(ODD), step, 1 << 64)) + rank[step:]
            step *= 2
    return shared.mix64(rank)


def least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    step = 1
    out = key
    while 2 * step <= width:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def places(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each chosen position: row, gram rank, stretch rank, first string it represents (from the row's start), how many more, and how far it is from the first."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return (none,) * 6
    rank = gram_ranks(raw, gram)
    key = (rank >> np.uint64(30) << np.uint64(30)) | np.arange(len(rank), dtype=np.uint64)
    chosen = (least_in_window(key, length - gram + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
    starts = np.arange(len(chosen))
    row = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[row + 1]
    starts, row, chosen = starts[inside], row[inside], chosen[inside]
    if not len(starts):
        return (none,) * 6
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))))
    lo, hi = starts[new], np.concatenate((starts[new[1:] - 1], starts[-1:]))
    at, row = chosen[new], row[new]
    with np.errstate(over="ignore"):
        stretch = shared.mix64(shared.span_hashes(raw, lo, hi + length) + (at - lo).astype(np.uint64) * ODD + ((hi - lo).astype(np.uint64) << np.uint64(40)))
    return row, rank[at].view(np.int64), stretch.view(np.int64), lo - bounds[row], hi - lo, at - lo


def _owners(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in OWNER)


def _named(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _earliest_first(keys: tuple[np.ndarray, np.ndarray], owner: tuple[np.ndarray, ...], lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys and place, without places that a repeated row brings again, and which of these repeat the key before."""
    order = np.lexsort((lo, *reversed(owner), *reversed(keys)))
    same = lambda *columns: np.logical_and.reduce([np.concatenate(([False], c[order][1:] == c[order][:-1])) for c in columns])
    known = same(*keys)
    once = ~(known & same(*owner, lo))
    return order[once], known[once]


def _spread(known: np.ndarray, key: np.ndarray, owner: tuple[np.ndarray, ...], lo: np.ndarray) -> np.ndarray:
    """Keys, but those of rows already known to repeat another go anywhere."""
    with np.errstate(over="ignore"):
        anywhere = shared.mix64((owner[1].view(np.uint64) ^ owner[2].view(np.uint64)) * ODD + lo.view(np.uint64))
    return np.where(known, anywhere.view(np.int64), key)


def _rows(docs: DataFrame) -> DataFrame:
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc.isNull().alias("nil"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))


CHOSEN = f"gram bigint, stretch bigint, {ID}, lo bigint, shape int"


def _combined(parts: list[tuple[np.ndarray, ...]], hot: np.ndarray) -> pa.RecordBatch:
    """Of equal pairs the earliest; the others are known to repeat it.  ``shape`` packs distance, number of more strings, hot and known."""
    gram, stretch, nil, doc, digest, lo, more, off = (np.concatenate(x) for x in zip(*parts))
    order, known = _earliest_first((gram, stretch), (nil, doc, digest), lo)
    gram, stretch, nil, doc, digest, lo, more, off = (x[order] for x in (gram, stretch, nil, doc, digest, lo, more, off))
    is_hot = np.isin(gram, hot)
    with np.errstate(over="ignore"):
        dealt = shared.mix64(gram.view(np.uint64) ^ (stretch.view(np.uint64) * ODD)).view(np.int64)
    key = _spread(known, np.where(is_hot, dealt, gram), (nil, doc, digest), lo)
    shape = (off << 10 | more << 2 | is_hot << 1 | known).astype(np.int32)
    return _by_owner(CHOSEN, key, _spread(known, stretch, (nil, doc, digest), lo), nil, doc, digest, lo, shape)


def _by_owner(schema: str, first: np.ndarray, second: np.ndarray, nil: np.ndarray, doc: np.ndarray, digest: np.ndarray, lo: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """In the order of the texts, in which rows compress well."""
    order = np.lexsort((lo, digest, doc, nil))
    return _named(schema, *(x[order] for x in (first, second, nil, doc, digest, lo, *more)))


def _chosen(rows: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            owner = _owners(batch)
            for a, b, raw, bounds in shared.text_blocks(batch.column("text")):
                row, g, s, lo, more, off = places(raw, bounds, length, gram)
                if len(row):
                    held.append((g, s, *(x[a:b][row] for x in owner), lo, more, off))
                    n += len(row)
                if n >= HELD:
                    yield _combined(held, hot)
                    held, n = [], 0
        if held:
            yield _combined(held, hot)

    return rows.mapInArrow(choose, CHOSEN)


def _hot_grams(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Fewer than MOST_HOT of them."""
    some = _rows(docs).where(F.pmod("digest", F.lit(SAMPLE)) == 0)
    counts = shared.materialise(_chosen(some, length, gram, np.zeros(0, np.int64)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["gram"] for r in counts.where(F.col("n") > max(LEAST_HOT, total // MOST_HOT)).select("gram").collect()]
    shared.drop_table(counts)
    return np.array(hot, np.int64)


def _places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``nil, doc, digest, lo, more, off, open`` of positions with a repeated gram; those not open are repeated as a whole."""
    by_gram = Window.partitionBy("gram")
    flag = lambda n: F.col("shape").bitwiseAND(n) > 0
    ranked = _chosen(_rows(docs), length, gram, _hot_grams(docs, length, gram)).select(
        *OWNER, "lo", "shape",
        (F.min("stretch").over(by_gram) != F.max("stretch").over(by_gram)).alias("several"),
        # equal places, which repeated rows bring, share a number
        F.rank().over(Window.partitionBy("gram", "stretch").orderBy(*OWNER, "lo")).alias("nth"),
    )
    repeated = flag(1) | (F.col("nth") > 1)
    found = ranked.where(repeated | F.col("several") | flag(2)).select(*OWNER, "lo", F.shiftright("shape", 2).bitwiseAND(255).alias("more"), F.shiftright("shape", 10).alias("off"), (~repeated).alias("open"))
    return shared.materialise(found, "suffix-places")


def _with_lists(docs: DataFrame, listed: DataFrame, *fields: str) -> DataFrame:
    """The texts that have rows in ``listed``, with these as a list."""
    lists = listed.groupBy(*OWNER).agg(F.collect_set(F.struct(*fields)).alias("listed"))
    return _rows(docs).join(lists, OWNER).select(*OWNER, "text", "listed")


def _listed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """For blocks of texts: bytes, owner of each list entry, start of its text and the entry's fields."""
    for batch in batches:
        owner = _owners(batch)
        for a, b, raw, bounds in shared.text_blocks(batch.column("text")):
            lists = batch.column("listed").slice(a, b - a)
            fields = [lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)]
            row = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
            yield raw, tuple(x[a:b][row] for x in owner), bounds[row], *fields


PIECES = f"first bigint, second bigint, {ID}, lo bigint, more int, off int, known boolean"


def _combined_pieces(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """As :func:`_combined`, for pieces."""
    first, second, nil, doc, digest, lo, more, off = (np.concatenate(x) for x in zip(*parts))
    order, known = _earliest_first((first, second), (nil, doc, digest), lo)
    return _by_owner(PIECES, *(x[order] for x in (first, second, nil, doc, digest, lo)), more[order].astype(np.int32), off[order].astype(np.int32), known)


def _pieces(lo: np.ndarray, more: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Entry, first string, number of more strings, distance of each piece and least distance of its place in the cut: cuts are where the distance is a multiple of ``size``."""
    nearest, farthest = (off - more) // size, off // size
    n = farthest - nearest + 1
    each = np.repeat(np.arange(len(lo)), n)
    block = np.repeat(farthest, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    far, near = np.minimum(off[each], block * size + size - 1), np.maximum((off - more)[each], block * size)
    return each, lo[each] + off[each] - far, far - near, far, block * size


def _ranked(docs: DataFrame, open_: DataFrame, length: int, gram: int, size: int) -> DataFrame:
    """The open stretches or pieces, cut anew, with both ranks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for raw, owner, begin, lo, more, off in _listed(batches, 3):
            each, lo, more, off, least = _pieces(lo, more, off, size)
            start, rank = begin[each] + lo, gram_ranks(raw, gram)
            # what all strings of a whole piece share, also where this one has fewer strings
            core = start + off - least
            with np.errstate(over="ignore"):
                twice = shared.mix64(rank[: len(rank) - gram] * ODD + rank[gram:])
                shared_part = shared.mix64(twice[core] * ODD + twice[core + length - size + 1 - 2 * gram])
                whole = shared.mix64(shared.span_hashes(raw, start, start + more + length) + off.astype(np.uint64) * ODD)
            held.append((shared_part.view(np.int64), whole.view(np.int64), *(o[each] for o in owner), lo, more, off))
            n += len(lo)
            if n >= HELD:
                yield _combined_pieces(held)
                held, n = [], 0
        if held:
            yield _combined_pieces(held)

    return shared.materialise(_with_lists(docs, open_, "lo", "more", "off").mapInArrow(send, PIECES), "suffix-pieces")


def _settled(ranked: DataFrame) -> DataFrame:
    """``nil, doc, digest, lo, more, off, open`` of pieces whose shared part is repeated; those not open are repeated as a whole."""
    pairs = ranked.where("not known").groupBy("first", "second").agg(F.min(F.struct(*OWNER, "lo")).alias("earliest"), F.count(F.lit(1)).alias("n"))
    pairs = shared.materialise(pairs, "suffix-ranks")
    several = F.count(F.lit(1)) > 1
    firsts = shared.materialise(pairs.groupBy("first").agg(F.sum("n").alias("total"), several.alias("several")).where("total > 1").select("first", "several"), "suffix-repeated")
    again = shared.materialise(pairs.join(firsts, "first").select("first", "second", "earliest", "several"), "suffix-again")
    met = ranked.where("not known").join(again, ["first", "second"])
    met = met.withColumn("open", F.struct(*OWNER, "lo") == F.col("earliest")).where("several or not open")
    columns = [*OWNER, "lo", "more", "off", "open"]
    out = met.select(*columns).unionByName(ranked.where("known").withColumn("open", F.lit(False)).select(*columns))
    out = shared.materialise(out, "suffix-settled")
    for table in (pairs, firsts, again):
        shared.drop_table(table)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``nil, doc, digest, spans``: for each document with repeated strings, the byte spans ``[lo, hi)`` they cover, unmerged; ``nil`` marks a null doc_id."""
    if gram & (gram - 1) or not 2 * gram + SIZES[0] <= length <= gram + 250:
        raise ValueError(f"gram must be a power of two, and length from 2 * gram + {SIZES[0]} to gram + 250")
    spark = docs.sparkSession
    shared.prepare_python(spark)
    rounds = [_places(docs, length, gram)]
    shared.release_shuffles(spark)
    for size in SIZES:
        ranked = _ranked(docs, rounds[-1].where("open"), length, gram, size)
        shared.release_shuffles(spark)
        rounds.append(_settled(ranked))
        shared.drop_table(ranked)
        shared.release_shuffles(spark)
    spans = None
    for found in rounds:
        own = found.where("not open").select(*OWNER, "lo", (F.col("lo") + F.col("more")).alias("hi"))
        spans = own if spans is None else spans.unionByName(own)
    return spans.groupBy(*OWNER).agg(F.collect_list(F.struct("lo", (F.col("hi") + length).alias("hi"))).alias("spans"))


def _merged(spans: np.ndarray, n: int) -> np.ndarray:
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(np.minimum(spans[:, 1], n))
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    first = np.flatnonzero(new)
    out = np.stack((np.minimum(spans[first, 0], n), reach[np.concatenate((first[1:] - 1, [len(reach) - 1]))]), 1)
    return out[out[:, 0] < out[:, 1]]


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    spans = repeated_spans(docs, length, gram)
    return _rows(docs).join(spans, OWNER, "left").select(F.when(~F.col("nil"), F.col("doc")).alias("doc"), "text", "spans")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, bytes, int]]:
    """doc_id, bytes, kept bytes, number of removed runs."""
    texts = batch.column(1).cast(pa.large_binary())
    for doc, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
        raw = text.as_py() or b""
        if not spans.is_valid:
            yield doc, raw, raw, 0
            continue
        pairs = np.stack((spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()), 1)
        gone = _merged(pairs, len(raw))
        edges = [0, *gone.ravel().tolist(), len(raw)]
        yield doc, raw, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), len(gone)


def removed_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()) for d, raw, kept, n in _kept(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, length, gram).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text`` without the repeated bytes (a cut inside a character drops its rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, kept.decode("utf-8", "ignore")) for d, _, kept, _ in _kept(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])

    return _with_spans(docs, length, gram).mapInArrow(run, "doc_id bigint, text string")
