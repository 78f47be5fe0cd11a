"""Phrase collocations by dynamic itemset counting.

Texts are dealt to ``SHARDS`` shards that are scanned in a cycle, a shard a step.  Counting
interleaves lengths: words are counted from the first step on, and a longer phrase becomes
active as soon as both its subphrases (without its last, without its first word) have reached
the threshold, whatever part of the corpus they were counted in.  It is counted for the next
``SHARDS`` steps, which are one full cycle, so its count is exact; it may itself reach the
threshold long before.  The scan ends when every active phrase has completed its cycle.

While they are counted, phrases go by a key: 53 bits of a hash of language and words, the step
after which counting began, and the number of words.  When a phrase reached the
threshold is looked up in a table of one byte a slot (the step).  Its size follows the number of
words and is bounded by ``MOST_SLOTS``, and a step once entered stays.  A phrase that shares a
slot with another may be counted from an earlier step on, or in vain, but always for one full
cycle, so collisions cost time only; beyond the bound more phrases are counted in vain.

When all cycles are complete, words are put to the frequent keys: growing parts of the corpus are
looked through for those that have none yet, so that few occurrences of each are handed on.  At
last the phrases of the result and their parts are counted once more by their words, in one scan,
and these counts are the ones returned.  Two phrases of one key could thus only change which
phrases are chosen (about one in 10^16 pairs of phrases has one key).

``score`` is the lowest, over the cuts of a phrase in two, of 1000 * a * n / (l * r), in decimals
of 38 digits: exact up to counts of 10^12 words.  A phrase is dropped if a phrase one word longer
is as frequent; longer ones cannot be more frequent than that.

Edge cases: a null text is empty; a null lang is ``und``; repeated rows count as often as they
occur; words of any length are kept whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 3
LONGEST = 5
SUPPORT = 100
TOP = 2000
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 27
#: Distinct phrases that a task gathers before it hands them on: by hash, and by words.
GATHER, GATHER_NAMES = 1_000_000, 500_000
SALTS = 64
#: A key's lowest bits: three for the number of words, eight for the step after which counting began.
LENGTH_BITS, CODE_BITS = 3, 11
COUNTS = "key bigint, c bigint"
NAMES = "lang string, k int, phrase string, key bigint, c bigint"
#: Parts of the corpus, of ``PARTS[-1]``, that are looked through for words.
PARTS = (0, 1, 2, 4, 8, 16)

#: Of a cut, in whole numbers.
SCORE = "(cast(a as decimal(20, 0)) * 1000 * cast(n as decimal(14, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What stands between words, and between pieces.
GAP, BREAK = np.zeros(256, bool), np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True


class Words:
    """The words of a block: lower-cased bytes with one space between words of a piece, where each word starts and ends, and how many follow it in its piece."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        low, brk = LOWER[raw], BREAK[raw]
        inside = ~(GAP[raw] | brk)
        fresh, last = inside.copy(), inside.copy()
        fresh[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(raw))]
        fresh[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.row = np.searchsorted(bounds, self.start, "right") - 1
        self.size = len(self.start)
        breaks = np.cumsum(brk, dtype=np.int32)[self.start]
        joined = np.zeros(self.size, bool)  # with the word before, in one piece
        joined[1:] = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        at = np.arange(self.size)
        first = np.append(np.flatnonzero(~joined), self.size)
        self.left = np.repeat(first[1:], np.diff(first)) - at  # words from this one to the piece's end
        self.hash = shared.span_hashes(low, self.start, self.end)
        wide = joined[1:] & ((self.start[1:] - self.end[:-1] != 1) | (low[np.minimum(self.end[:-1], len(low) - 1)] != 0x20))
        if wide.any():
            size = self.end - self.start
            to = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
            out = np.full(int((size + 1).sum()), 0x20, np.uint8)
            out[_runs(to, size)] = low[_runs(self.start, size)]
            low, self.start, self.end = out, to, to + size
        self.low = low


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0] .. start[0] + size[0] - 1, start[1] ..``; all sizes are positive."""
    if not len(start):
        return np.zeros(0, np.int64)
    step = np.ones(int(size.sum()), np.int64)
    step[0] = start[0]
    step[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(step)


def phrase_hashes(words: Words, lang: np.ndarray, seeds: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length the hash of the phrase that starts at each word."""
    with np.errstate(over="ignore"):
        h = shared.mix64(words.hash ^ seeds[lang])
        g = h
        for k in range(1, longest + 1):
            if k > 1:
                g = shared.mix64(g[:-1] * shared.ODD64 + h[k - 1 :] + np.uint64(k))
            yield g
            if len(g) < 2:
                return


def _slots(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[((g >> np.uint64(CODE_BITS)) & np.uint64(len(table) - 1)).astype(np.int64)]


def _keys(g: np.ndarray, begun: np.ndarray | int, k: int) -> np.ndarray:
    return g >> np.uint64(CODE_BITS) << np.uint64(CODE_BITS) | np.asarray(begun, np.uint64) << np.uint64(LENGTH_BITS) | np.uint64(k)


class Gathered:
    """Distinct keys of one task with their counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.put(*np.unique(keys, return_counts=True))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        found, group = np.unique(keys, return_inverse=True)
        self.parts = [(found, np.bincount(group, counts, len(found)).astype(np.int64))]
        self.size = len(found)

    def batches(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            keys, counts = self.parts[0]
            for a in range(0, self.size, rows):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + rows].view(np.int64)), pa.array(counts[a : a + rows])], ["key", "c"])
            self.parts, self.size = [], 0


def count_block(words: Words, lang: np.ndarray, seeds: np.ndarray, steps: np.ndarray | None, step: int, shards: int, longest: int, gathered: Gathered) -> None:
    """Adds the occurrences of phrases that are active in this step.  ``lang``: number of each word's language, ``seeds``: hash of each language."""
    before = None
    for k, g in enumerate(phrase_hashes(words, lang, seeds, longest), 1):
        if k == 1:
            if step <= shards:
                gathered.add(_keys(g, 0, k))
                used = np.bincount(lang, minlength=len(seeds))
                gathered.put(_keys(seeds[used > 0], 0, 0), used[used > 0])  # all words of a language
        elif steps is not None:
            reached = _slots(before, steps).astype(np.int32)
            begun = np.maximum(reached[:-1], reached[1:])
            at = np.flatnonzero((reached[:-1] > 0) & (reached[1:] > 0) & (begun < step) & (step <= begun + shards) & (words.left[: len(g)] >= k))
            if len(at):
                gathered.add(_keys(g[at], begun[at], k))
        before = g


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def _slot_values(rows: DataFrame, size: int) -> np.ndarray:
    """Distinct slots of rows' keys: at most as many as a table has."""
    return rows.select(F.shiftright("key", CODE_BITS).bitwiseAND(size - 1).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()


def _marked(slots: np.ndarray, size: int) -> np.ndarray:
    table = np.zeros(size, np.uint8)
    table[slots] = 1
    return table


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[str]]]:
    """Words of ``lang, text`` rows with the number of each word's language, the languages' hashes and their names so far."""
    langs, known, seeds = [], {}, np.zeros(0, np.uint64)
    for batch in batches:
        of_row = batch.column(0).to_pylist()
        for x in sorted(set(of_row) - known.keys()):
            known[x] = len(langs)
            langs.append(x)
            seeds = np.append(seeds, np.uint64(_seed(x)))
        numbers = np.array([known[x] for x in of_row], np.int32)
        for a, b, raw, bounds in shared.text_blocks(batch.column(1)):
            if len(raw):
                words = Words(raw, bounds)
                if words.size:
                    yield words, numbers[a:b][words.row], seeds, langs


def scan(texts: DataFrame, step: int, steps: np.ndarray | None, shards: int, longest: int) -> DataFrame:
    """``key, c``: active phrases in one shard."""
    spark = texts.sparkSession
    shared.prepare_python(spark)
    sent = spark.sparkContext.broadcast(steps)  # MOST_SLOTS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for words, lang, seeds, _ in _blocks(batches):
            count_block(words, lang, seeds, sent.value, step, shards, longest, gathered)
            if gathered.size > GATHER:
                gathered.merge()
                if gathered.size > GATHER // 2:
                    yield from gathered.batches()
        yield from gathered.batches()

    return texts.select("lang", "text").mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("c").alias("c"))


def named(texts: DataFrame, slots: np.ndarray, longest: int) -> DataFrame:
    """``lang, k, phrase, key, f`` of phrases in certain slots (``key`` without its step); ``k = 0`` counts all words."""
    spark = texts.sparkSession
    shared.prepare_python(spark)
    sent = spark.sparkContext.broadcast(slots)  # MOST_SLOTS bytes at most

    def batch(counts: dict) -> pa.RecordBatch:
        lang, k, phrase, key = zip(*counts)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(k, pa.int32()), pa.array([p.decode() for p in phrase]), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["lang", "k", "phrase", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, bytes, int], int] = {}
        for words, lang, seeds, langs in _blocks(batches):
            for i, n in enumerate(np.bincount(lang, minlength=len(langs)).tolist()):
                counts[langs[i], 0, b"", 0] = counts.get((langs[i], 0, b"", 0), 0) + n
            low = words.low.tobytes()
            for k, g in enumerate(phrase_hashes(words, lang, seeds, longest), 1):
                at = np.flatnonzero((_slots(g, sent.value) > 0) & (words.left[: len(g)] >= k))
                keys, first, n = np.unique(_keys(g[at], 0, k), return_index=True, return_counts=True)
                at = at[first]
                for x, s, e, key, c in zip(lang[at].tolist(), words.start[at].tolist(), words.end[at + k - 1].tolist(), keys.tolist(), n.tolist()):
                    key = (langs[x], k, low[s:e], key)
                    counts[key] = counts.get(key, 0) + c
            if len(counts) > GATHER_NAMES:
                yield batch(counts)
                counts = {}
        if counts:
            yield batch(counts)

    return texts.select("lang", "text").mapInArrow(run, NAMES).groupBy("lang", "k", "phrase", "key").agg(F.sum("c").alias("f"))


def language_keys(langs: DataFrame) -> DataFrame:
    """``lang, key``: what the words of a language are counted under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = np.array([_seed(x) for x in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_keys(seeds, 0, 0).view(np.int64))], ["lang", "key"])

    return langs.mapInArrow(run, "lang string, key bigint")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class Corpus:
    """The texts in shards, with the tables that go when the result is there."""

    def __init__(self, docs: DataFrame, shards: int):
        spark = docs.sparkSession
        rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shared.text_or_empty().alias("text"), F.monotonically_increasing_id().alias("n"))
        rows = rows.select("lang", "text", F.expr(f"(n div {shards}) % {PARTS[-1]}").cast("int").alias("part"), (F.col("n") % shards).cast("int").alias("shard"))
        path = shared.new_path(spark, "phrase-shards")
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
        self.texts, self.size = spark.read.schema(rows.schema).parquet(path), LEAST_SLOTS


def frequent(corpus: Corpus, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, key, f`` of phrases with ``f >= support``, and ``lang, n``."""
    texts = corpus.texts
    counted: dict[int, DataFrame] = {}
    done: list[DataFrame] = []
    steps, step, last = None, 0, 0
    k, begun = F.col("key").bitwiseAND((1 << LENGTH_BITS) - 1), F.shiftright("key", LENGTH_BITS).bitwiseAND((1 << CODE_BITS - LENGTH_BITS) - 1)
    while step < shards or step < last + shards:
        step += 1
        counted[step] = shared.materialise(scan(texts.where(F.col("shard") == (step - 1) % shards), step, steps, shards, longest), f"phrases-{step}")
        if step == 1:
            words = counted[1].where(k == 0).agg(F.sum("c")).first()[0] or 0
            corpus.size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (words * shards // 16).bit_length()))
            steps = np.zeros(corpus.size, np.uint8)
        # a phrase's steps lie within one cycle: what it had before this step is in the last tables, and what had its cycle is left out
        window = _union([t.where(begun >= step - shards).withColumn("now", F.lit(s == step)) for s, t in counted.items()])
        sums = window.groupBy("key").agg(F.sum("c").alias("f"), F.sum(F.when(~F.col("now"), F.col("c")).otherwise(0)).alias("before"))
        full = shared.materialise(sums.where((F.col("f") >= support) | (k == 0)), "phrases-reached")
        new = _slot_values(full.where((F.col("f") >= support) & (F.col("before") < support) & (k > 0) & (k < longest)), corpus.size)
        if len(new):
            steps = steps.copy()
            steps[new[steps[new] == 0]] = step
            last = step
        # keys of complete cycles, without their step
        done.append(full.where(begun == step - shards).select(F.col("key").bitwiseAND(~((1 << CODE_BITS) - (1 << LENGTH_BITS))).alias("key"), "f"))
        if step >= shards:
            shared.drop_table(counted.pop(step - shards + 1))
    for t in counted.values():
        shared.drop_table(t)
    keys = shared.materialise(_union(done), "frequent-keys")
    totals = language_keys(texts.select("lang").distinct()).join(keys.where(k == 0), "key").select("lang", F.col("f").alias("n"))
    found, wanted = [], keys.where(k > 0)
    for a, b in zip(PARTS, PARTS[1:]):
        names = named(texts.where((F.col("part") >= a) & (F.col("part") < b)), _marked(_slot_values(wanted, corpus.size), corpus.size), longest)
        # a word for each key, the first where two share one
        names = names.where("k > 0").groupBy("key").agg(F.min(F.struct("lang", "k", "phrase")).alias("p"))
        found.append(shared.materialise(names.join(wanted, "key").select("p.*", "key", "f"), f"phrase-names-{b}"))
        wanted = shared.materialise(wanted.join(found[-1].select("key"), "key", "left_anti"), "phrases-unnamed")
        if wanted.isEmpty():
            break
    return _union(found), shared.materialise(totals, "phrase-words")


def _part(first: Column | int, size: Column | int) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array_join(F.slice("words", column(first), column(size)), " ")


def best(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language, with the ``cut`` that counts."""
    longer = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    counts = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"]).join(totals, "lang")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "left", "right", "l", "r")).alias("best"))
    inside = longer.where("k > 2").select("lang", F.explode(F.array(_part(1, F.col("k") - 1), _part(2, F.col("k") - 1))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    return ranked(kept.select("lang", "phrase", "a", "n", "best.*"), top)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best of each part of a language, then the best of these: no task has a language's phrases."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("salt", "nth")


def mine(docs: DataFrame, top: int = TOP, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    corpus = Corpus(docs, shards)
    found, totals = frequent(corpus, support, longest, shards)
    chosen = shared.materialise(best(found, totals, top).select("lang", "phrase", "left", "right", "n"), "phrases-chosen")
    # the phrases of the result and their parts, counted by their words
    parts = chosen.select("lang", F.explode(F.array("phrase", "left", "right")).alias("phrase")).distinct()
    keys = found.join(parts, ["lang", "phrase"], "left_semi").select("key")
    exact = shared.materialise(named(corpus.texts, _marked(_slot_values(keys, corpus.size), corpus.size), longest).where("k > 0").join(parts, ["lang", "phrase"], "left_semi"), "phrase-counts")
    shared.drop_table(corpus.texts)
    counts = lambda part, name: exact.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    rows = chosen.join(counts("phrase", "a"), ["lang", "phrase"]).join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    return ranked(rows.withColumn("score", F.expr(SCORE)), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
