"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased tokens in which numbers, units behind numbers and
names (capitalised words inside a sentence, in Latin, Greek or Cyrillic letters) are replaced with typed placeholders; what they
replace are the slots' values.  Windows of ``WORDS`` template tokens are hashed, and the
documents' windows are joined to the benchmark's by hash.  A run of windows that keeps its
distance to an item (one alignment) must map each slot value of the item to one value
of the document and back; a run that does not is no copy with new parameters and is dropped.
A document is contaminated by an item if the remaining runs cover ``SHARE`` of its windows:
``exact`` if all slots are equal, else ``reparameterised``.

Before the join, windows that cannot be in the benchmark are dropped by a bitmap of fixed
size (``BITMAP`` bits, whatever the benchmark's size; false hits are settled by the join), so
the documents' windows themselves are never moved.  Copies of one benchmark window are
kept, each with its item.  A document can only be contaminated by an item if it holds one of
the item's anchors: of n windows, 1 - ``SHARE`` may be missing, so among that many and one
more, one must be there, and the ones that are rarest in the documents are taken.  Thus windows
of placeholders alone, which many documents and items have, meet only inside candidate pairs.
Matched windows are reduced to one row per document, item and alignment before anything is
grouped.

Edge cases: null or wordless documents are clean; null or wordless items match nothing; an
item with fewer than ``WORDS`` tokens is one window of all its tokens, matched whole and only
with equal slots; repeated rows each get a row (equal texts, equal
results; rows with one doc_id, or with none, are told apart by their texts' digests); other columns are ignored; an empty table
on either side gives no findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORDS = 5
SHARE = 0.8
BITMAP = 1 << 24
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
#: Units that count as slots behind a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hours minutes seconds days weeks months years usd eur dollars euros cents percent degrees miles meters metres kilometers kilograms grams pounds liters litres".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n:;\"|")] = True


def folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and where capitals start: A-Z and the two-byte ones of Latin, Greek and Cyrillic."""
    capital = (raw >= 65) & (raw <= 90)
    lower = np.where(capital, raw | 32, raw)
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xD0)) if len(raw) else np.zeros(0, np.int64)
    point = ((raw[lead].astype(np.int32) & 31) << 6) | (raw[lead + 1] & 63)
    within = lambda a, b: (point >= a) & (point <= b)
    # fixed values: code point ranges of capitals, and how far their small letters are
    by_32 = (within(0xC0, 0xDE) & (point != 0xD7)) | within(0x391, 0x3A9) | within(0x410, 0x42F)
    by_1 = ((within(0x100, 0x137) | within(0x14A, 0x177)) & (point % 2 == 0)) | ((within(0x139, 0x148) | within(0x179, 0x17E)) & (point % 2 == 1))
    shift = np.where(by_32, 32, np.where(within(0x400, 0x40F), 80, np.where(by_1, 1, 0)))
    lead, point = lead[shift > 0], (point + shift)[shift > 0]
    lower[lead], lower[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
    capital[lead] = True
    return lower, capital


def _hash_words(words: list[str]) -> np.ndarray:
    parts = [w.encode() for w in words]
    ends = np.cumsum([len(p) for p in parts])
    return np.sort(shared.span_hashes(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], ends[:-1])), ends))


_UNIT_HASHES = _hash_words(UNITS)


def template(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash and value hash of every token, whether it is capitalised, and each row's first token (one more at the end)."""
    lower, capitals = folded(raw)
    n = len(raw)
    digit, letter = _DIGIT[raw], _LETTER[raw]
    # a point or comma between digits belongs to the number
    joint = np.zeros(n, bool)
    joint[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    kind = np.where(digit | joint, 2, np.where(letter, 1, 0)).astype(np.int8)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(bounds), np.int64)
    value = shared.span_hashes(lower, starts, ends)
    numeric = kind[starts] == 2
    row = np.searchsorted(bounds, starts, "right")
    follows = np.zeros(len(starts), bool)
    follows[1:] = row[1:] == row[:-1]
    # a unit stands directly behind a number, at most a blank between
    behind = np.zeros(len(starts), bool)
    behind[1:] = follows[1:] & numeric[:-1] & (starts[1:] - ends[:-1] <= 1)
    unit = np.zeros(len(starts), bool)
    near = np.flatnonzero(behind & ~numeric)
    unit[near] = np.isin(value[near], _UNIT_HASHES)
    # a name is capitalised, and no stop or row start lies between it and the last token
    stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
    same = np.zeros(len(starts), bool)
    same[1:] = follows[1:] & (stops[starts[1:]] == stops[ends[:-1]])
    capital = capitals[starts] & ~unit
    name = capital & same
    hashed = np.where(numeric, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return hashed, value, capital, np.searchsorted(starts, bounds)


AS_IS, PLAIN, NAMED = 0, 1, 2


def windows(raw: np.ndarray, bounds: np.ndarray, words: int, openings: bool = False) -> tuple[np.ndarray, ...]:
    """Window hashes; the row and first token of each, and how that token counts; values and slot marks of all tokens.

    Where a passage begins, its first word may be a name in one text and a sentence's start in
    another.  So a window that starts with a name also comes with the name as a plain word, and
    with ``openings`` a row's first word, if capitalised, also comes as a name.
    """
    hashed, value, capital, first = template(raw, bounds)
    slot = (hashed == NUMBER) | (hashed == UNIT) | (hashed == NAME)
    n = len(hashed) - words + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none, value, slot
    at = np.arange(n)
    row = np.searchsorted(first, at, "right") - 1
    whole = at + words <= first[row + 1]
    at, row = at[whole], row[whole]
    plain = np.flatnonzero(hashed[at] == NAME)
    named = np.flatnonzero((at == first[row]) & capital[at]) if openings else plain[:0]
    lead = np.repeat([AS_IS, PLAIN, NAMED], [len(at), len(plain), len(named)])
    at, row = np.concatenate((at, at[plain], at[named])), np.concatenate((row, row[plain], row[named]))
    with np.errstate(over="ignore"):
        total = shared.mix64(np.where(lead == PLAIN, value[at], np.where(lead == NAMED, NAME, hashed[at])))
        for i in range(1, words):
            total = shared.mix64(total * shared.ODD64 + hashed[at + i])
    return total, row, at, lead, value, slot


WINDOW = "id bigint, digest bigint, window bigint, at int, slots array<bigint>"


def _slot_lists(at: np.ndarray, lead: np.ndarray, words: int, value: np.ndarray, slot: np.ndarray) -> pa.Array:
    """For each window the values of its slots in order."""
    grid = at[:, None] + np.arange(words)[None, :]
    mark = slot[grid]
    mark[lead == PLAIN, 0] = False
    mark[lead == NAMED, 0] = True
    offsets = np.concatenate(([0], np.cumsum(mark.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[grid][mark].view(np.int64)))


def _window_batches(batches: Iterator[pa.RecordBatch], words: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests = batch.column(0), batch.column(2)
        for a, b, raw, bounds in shared.text_blocks(batch.column(1)):
            if not len(raw):
                continue
            h, row, at, lead, value, slot = windows(raw, bounds, words, bitmap is None)
            if bitmap is not None:
                bit = (h & np.uint64(BITMAP - 1)).astype(np.int64)
                near = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                h, row, at, lead = h[near], row[near], at[near], lead[near]
            if len(h):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(row)), digests.slice(a, b - a).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), _slot_lists(at, lead, words, value, slot)], ["id", "digest", "window", "at", "slots"])


def _digest() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def window_table(docs: DataFrame, id_column: str, words: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """``id, digest, window, at, slots``; ``digest`` is that of the row's text, ``at`` counts tokens from somewhere that is constant for a row.

    With a bitmap the rows are documents, whose ids may be null, and other windows are left out; without one they are items.
    """
    spark = docs.sparkSession
    shared.prepare_python(spark)
    sent = spark.sparkContext.broadcast(bitmap)  # BITMAP / 8 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        yield from _window_batches(batches, words, sent.value)

    rows = docs.where(F.col("text").isNotNull())
    if bitmap is None:
        rows = rows.where(F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"), _digest().alias("digest")).mapInArrow(run, WINDOW)


def _bitmap(items: DataFrame) -> np.ndarray:
    """Built from distinct bit numbers: at most BITMAP of them reach the driver, as 64-bit words of set bits."""
    bit = F.col("window").bitwiseAND(BITMAP - 1)
    words = items.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    out = np.zeros(BITMAP // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def findings(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """``doc_id, digest, item_id, covered, kind`` for each document and item that contaminates it."""
    parts = []
    sizes = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for w in range(1, words + 1):
        items = shared.materialise(window_table(sizes, "item_id", w), "benchmark-windows")
        if w < words:
            # whole items of exactly w tokens
            longer = window_table(sizes, "item_id", w + 1).select("id").distinct()
            items = shared.materialise(items.join(longer, "id", "left_anti"), "benchmark-windows")
        if items.isEmpty():
            continue
        found = _matched(docs, items, w, share)
        parts.append(found.where("kind = 'exact'") if w < words else found)
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, digest bigint, item_id bigint, covered double, kind string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("doc_id", "digest", "item_id").agg(F.max("covered").alias("covered"), F.min("kind").alias("kind"))
    return best.where(F.col("covered") >= share)


def _anchors(items: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """``item_id, window``: windows of which a contaminated document holds one, those that documents hold least."""
    held = found.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    places = items.join(held, "window", "left").groupBy("id", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    of_item = Window.partitionBy("id")
    total = F.count(F.lit(1)).over(of_item)
    missing = total - F.ceil(total * F.lit(share) - 1e-9)
    rare = places.withColumn("nth", F.row_number().over(of_item.orderBy("n", "at"))).withColumn("most", missing + 1).where("nth <= most")
    return items.join(rare.select("id", "at"), ["id", "at"]).select(F.col("id").alias("item_id"), "window").distinct()


def _matched(docs: DataFrame, items: DataFrame, words: int, share: float) -> DataFrame:
    total = items.groupBy("id").agg(F.count_distinct("at").alias("n_windows")).withColumnRenamed("id", "item_id")
    found = window_table(docs, "doc_id", words, _bitmap(items)).select(F.col("id").alias("doc_id"), "digest", "window", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    found = shared.hold(found)
    candidates = found.select("doc_id", "digest", "window").distinct().join(_anchors(items, found, share), "window").select(F.col("doc_id").alias("d"), F.col("digest").alias("t"), "item_id").distinct()
    mine = items.select(F.col("id").alias("item_id"), "window", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = found.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t"))).drop("d", "t")
    met = met.join(mine, ["item_id", "window"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    # one row per document, item and alignment: where it holds, and its distinct slot pairs
    pairs = F.zip_with("item_slots", "doc_slots", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    runs = met.groupBy("doc_id", "digest", "item_id", "shift").agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"])))) & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["y"]))))
    equal = ~F.exists("pairs", lambda p: p["x"] != p["y"])
    good = runs.where(one_to_one).select("doc_id", "digest", "item_id", "ats", equal.alias("equal"))
    each = good.select("doc_id", "digest", "item_id", F.explode("ats").alias("at"), "equal").groupBy("doc_id", "digest", "item_id", "at").agg(F.max("equal").alias("equal"))
    covered = each.groupBy("doc_id", "digest", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("equal").alias("n_equal"))
    done = covered.join(total, "item_id")
    return done.select("doc_id", "digest", "item_id", (F.col("n") / F.col("n_windows")).alias("covered"), F.when(F.col("n_equal") == F.col("n"), "exact").otherwise("reparameterised").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """``doc_id, contaminated, n_items, items, kind, covered`` for every row."""
    found = findings(docs, benchmark, words, share)
    each = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.min("kind").alias("kind"), F.max("covered").alias("covered"))
    each = each.withColumnRenamed("doc_id", "d").withColumnRenamed("digest", "t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    return rows.join(each, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), "kind", "covered",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, rows without a doc_id judged by their own texts."""
    found = findings(docs, benchmark)
    d, t = shared.free_name(docs, "_d"), shared.free_name(docs, "_t")
    found = found.select(F.col("doc_id").alias(d), F.col("digest").alias(t)).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"].cast("string")) == F.col(t)), "left_anti").select(*docs.columns)
