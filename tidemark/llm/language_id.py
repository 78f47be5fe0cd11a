"""Language identification by a linear-chain conditional random field over the words of a text.

Words (runs of letters, lower-cased) carry affix, n-gram and lexicon features; every label
has a weight for each hashed feature, and every pair of labels a transition weight.  Both
are learned by gradient ascent on the conditional likelihood of word sequences, with the
expectations computed by forward-backward.  Training sequences are pieces of labelled
documents, some of them strung together from pieces of different languages, so that the
transitions learn what code-switching costs.  A text's score for a language is the mean
posterior of its words, each weighted by its letters; the largest wins.

Forward-backward is exact on texts of any length: texts are cut into blocks of ``BLOCK``
words, the blocks' transfer matrices are computed side by side, messages run along each
text's blocks, and the posteriors inside the blocks again side by side.

Training takes at most ``SAMPLE`` labelled documents a language (those with the least hash
of doc_id) and ``PIECE`` words around a hashed point of each; this is the bound of the
model's sample.  Prediction looks at every word of every text.

Edge cases: a null text, or one without letters, is ``und`` with score 0; ties go to the
language that sorts first; without labelled rows all texts are ``und``; repeated rows
each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SAMPLE = 400
PIECE = 80
BUCKETS = 1 << 15
BLOCK = 32
ROUNDS = 40
#: Words remembered by a worker, twice at most; a worker stays for later stages, and so does most of what it once took.
MEMO = 100_000
#: Longer words are scored anew each time instead of being remembered.
LONGEST = 48
#: Words kept in a language's lexicon, and how often each must occur in the sample.
LEXICON, LEXICON_LEAST = 2000, 3
UND = "und"
WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")


#: Kinds of features, which keep equal strings apart.
GRAM, PREFIX, SUFFIX, WHOLE, LEXICAL, BIAS = range(6)
_STEP = np.uint64(0x100000001B3)


def _bucket(value: np.ndarray, kind: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (shared.mix64(value + np.uint64((kind * 16 + n) * 0x9E3779B1)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and the word each belongs to, for many words at once.

    Every word has a bias, its 1- to 3-grams between word marks, affixes of up to 4 letters
    shorter than itself, itself if it has 4 letters or fewer, and the languages whose lexicons have it.
    """
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 2)
    start = end - length - 2
    owner = np.repeat(np.arange(len(words)), length + 2)
    last = end[owner]
    flat, of = [np.full(len(words), int(_bucket(np.zeros(1, np.uint64), BIAS, 0)[0]))], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        run = np.zeros(len(code), np.uint64)
        for n in (1, 2, 3, 4):
            # hash of the n letters from each position on
            run = run[: len(code) - n + 1] * _STEP + code[n - 1 :] + np.uint64(1)
            if n <= 3:
                at = np.flatnonzero(np.arange(len(run)) + n <= last[: len(run)])
                flat.append(_bucket(run[at], GRAM, n))
                of.append(owner[at])
            longer = np.flatnonzero(length > n)
            flat += [_bucket(run[start[longer] + 1], PREFIX, n), _bucket(run[end[longer] - 1 - n], SUFFIX, n)]
            of += [longer, longer]
            whole = np.flatnonzero(length == n)
            flat.append(_bucket(run[start[whole] + 1], WHOLE, n))
            of.append(whole)
    mask = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    for k in range(int(mask.max(initial=0)).bit_length()):
        known = np.flatnonzero(mask >> k & 1)
        flat.append(_bucket(np.full(len(known), k, np.uint64), LEXICAL, 0))
        of.append(known)
    return np.concatenate(flat), np.concatenate(of)


def summed(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[flat, j], n) for j in range(weights.shape[1])], 1)


def _parts(words: list[str], most: int = 100_000) -> Iterator[list[str]]:
    """The words in order, in parts of one word at least and few letters beyond ``most``."""
    part, letters = [], 0
    for w in words:
        part.append(w)
        letters += len(w)
        if letters >= most:
            yield part
            part, letters = [], 0
    if part:
        yield part


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    move: np.ndarray
    lexicon: dict[str, int]
    memo: shared.TwoGenerations = field(default_factory=lambda: shared.TwoGenerations(MEMO))

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "move": self.move, "lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.memo = shared.TwoGenerations(MEMO)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """``len(words) x labels`` summed feature weights; each distinct word is looked at once while the memo lasts."""
        got = self.memo.get_all(words)
        if None in got:
            missing = list({w for w, v in zip(words, got) if v is None})
            sums = np.concatenate([summed(self.weights, *features(part, self.lexicon), len(part)) for part in _parts(missing)])
            data, width = sums.astype(np.float32).tobytes(), 4 * len(self.labels)
            rows = [data[i : i + width] for i in range(0, len(data), width)]
            fresh = dict(zip(missing, rows))
            short = [w for w in missing if len(w) <= LONGEST]
            self.memo.put(short, [fresh[w] for w in short])
            got = [fresh[w] if v is None else v for w, v in zip(words, got)]
        return np.frombuffer(b"".join(got), np.float32).reshape(len(words), len(self.labels))


def posteriors(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors and normalised forward messages of every word.

    ``emit`` has the words' scores of all texts one after another (lengths > 0).
    """
    k = emit.shape[1]
    emit = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    emit = np.maximum(emit, 1e-9)
    step = np.exp(move - move.max())
    blocks = -(-lengths // block)
    n_blocks = int(blocks.sum())
    # padded words emit 1 for every label and move nothing: they come first in a text's last block, so masks suffice
    text_of = np.repeat(np.arange(len(lengths)), blocks)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    index_in = np.arange(n_blocks) - first_block[text_of]
    size = np.minimum(block, lengths[text_of] - index_in * block)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))[text_of] + index_in * block
    grid = start[:, None] + np.arange(block)[None, :]
    live = np.arange(block)[None, :] < size[:, None]
    e = np.where(live[:, :, None], emit[np.minimum(grid, len(emit) - 1)], 1.0)

    def advance(x: np.ndarray, t: int) -> np.ndarray:
        y = (x @ step) * (e[:, t] if x.ndim == 2 else e[:, t][:, None, :])
        return np.where(live[:, t].reshape(-1, *[1] * (x.ndim - 1)), y, x)

    transfer = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for t in range(block):
        transfer = advance(transfer, t)
        if t % 8 == 7:
            transfer /= transfer.max((1, 2), keepdims=True)
    # messages along the blocks: all texts' first blocks, then all second ones, ...
    ahead = np.full((n_blocks, k), 1.0 / k)
    behind = np.ones((n_blocks, k))
    for b in range(1, int(blocks.max())):
        at = first_block[blocks > b] + b
        m = np.einsum("nk,nkl->nl", ahead[at - 1], transfer[at - 1])
        ahead[at] = m / m.sum(1, keepdims=True)
    for b in range(int(blocks.max()) - 2, -1, -1):
        at = first_block[blocks > b + 1] + b
        m = np.einsum("nkl,nl->nk", transfer[at + 1], behind[at + 1])
        behind[at] = m / m.sum(1, keepdims=True)
    forward = np.empty((block, n_blocks, k))
    x = ahead
    for t in range(block):
        x = advance(x, t)
        x = x / x.sum(1, keepdims=True)
        forward[t] = x
    out = np.empty((n_blocks, block, k))
    y = behind
    for t in range(block - 1, -1, -1):
        p = forward[t] * y
        out[:, t] = p / p.sum(1, keepdims=True)
        back = (y * e[:, t]) @ step.T
        y = np.where(live[:, t][:, None], back / back.sum(1, keepdims=True), y)
    return out[live], forward.transpose(1, 0, 2)[live]


def train(pieces: list[tuple[list[str], str]], seed: int = 1) -> Model:
    """``pieces``: words and language of each sampled document."""
    labels = sorted({lang for _, lang in pieces})
    number = {lang: i for i, lang in enumerate(labels)}
    counts: dict[str, np.ndarray] = {}
    for words, lang in pieces:
        for w in words:
            if w not in counts:
                counts[w] = np.zeros(len(labels), np.int64)
            counts[w][number[lang]] += 1
    lexicon: dict[str, int] = {}
    for i in range(len(labels)):
        common = sorted((w for w, c in counts.items() if c[i] >= LEXICON_LEAST and 2 * c[i] > c.sum()), key=lambda w: (-counts[w][i], w))[:LEXICON]
        for w in common:
            lexicon[w] = lexicon.get(w, 0) | 1 << i
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pieces))
    sequences: list[list[tuple[str, int]]] = []
    for n, i in enumerate(order):
        words, lang = pieces[i]
        if n % 4 == 3 and sequences:
            # a code-switched sequence: a stretch of this piece inside the last one
            cut = int(rng.integers(0, len(sequences[-1]) + 1))
            sequences[-1][cut:cut] = [(w, number[lang]) for w in words[: PIECE // 3]]
        else:
            sequences.append([(w, number[lang]) for w in words])
    sequences = [s for s in sequences if s]
    k = len(labels)
    vocabulary = sorted({w for s in sequences for w, _ in s})
    at = {w: i for i, w in enumerate(vocabulary)}
    flat, owner = features(vocabulary, lexicon)
    words = np.array([at[w] for s in sequences for w, _ in s])
    gold = np.array([y for s in sequences for _, y in s])
    lengths = np.array([len(s) for s in sequences])
    first = np.zeros(len(words), bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    pair_at = np.flatnonzero(~first)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[pair_at - 1], gold[pair_at]), 1)
    weights, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    one_hot = np.eye(k)[gold]
    for _ in range(ROUNDS):
        emit = summed(weights, flat, owner, len(vocabulary))[words]
        p, ahead = posteriors(emit, lengths, move)
        per_word = np.zeros((len(vocabulary), k))
        for j in range(k):
            per_word[:, j] = np.bincount(words, (one_hot - p)[:, j], len(vocabulary))
        grad = np.stack([np.bincount(flat, per_word[owner, j], BUCKETS) for j in range(k)], 1) - 0.02 * weights
        # P(i, j at the next word) = P(j at the next word) * P(i | j, words so far)
        joint = ahead[pair_at - 1][:, :, None] * np.exp(move - move.max())[None]
        joint /= joint.sum(1, keepdims=True)
        expected = (joint * p[pair_at][:, None, :]).sum(0)
        grad_move = (gold_moves - expected) - 0.02 * move
        seen_w += grad**2
        seen_m += grad_move**2
        weights += 0.3 * grad / np.sqrt(seen_w)
        move += 0.1 * grad_move / np.sqrt(seen_m)
    return Model(labels, weights.astype(np.float32), move, lexicon)


def sampled_pieces(labelled: DataFrame, sample: int = SAMPLE, piece: int = PIECE) -> list[tuple[list[str], str]]:
    """At most ``sample`` documents a language, chosen by hash, brought to the driver: a bounded list."""
    spark = labelled.sparkSession
    keyed = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    langs = sorted(r["lang"] for r in keyed.select("lang").distinct().collect())
    out: list[tuple[list[str], str]] = []
    ids: list[int] = []
    for lang in langs:
        ids += [r["doc_id"] for r in keyed.where(F.col("lang") == lang).orderBy("h", "doc_id").limit(sample).select("doc_id").collect()]
    if not ids:
        return out
    # only a stretch of each text is brought over: its place follows from doc_id
    reach = 16 * piece
    text = F.col("text")
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length(text) - reach, F.lit(1)).cast("long")).cast("int")
    # an Arrow table becomes a local relation; a list would be dealt to Python workers of their own, which stay on the executors
    wanted = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(set(ids)), pa.int64())}))
    chosen = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(wanted), "doc_id", "left_semi")
    rows = chosen.select("doc_id", "lang", F.substr(text, begin + 1, F.lit(reach)).alias("part")).orderBy("doc_id", "lang", "part").limit(2 * len(ids)).collect()
    for r in rows:
        words = WORD.findall(r["part"].lower())
        words = words[1:-1][:piece] if len(words) > 4 else words
        if words:
            out.append((words, r["lang"]))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From the documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    pieces = sampled_pieces(rows.where(~_held_out()), sample)
    return train(pieces) if pieces else None


def _held_out():
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and ``n_words, n_switches, mix`` for every row.

    ``mix`` lists the languages' shares; ``n_switches`` counts neighbouring words with different best labels.
    """
    spark = docs.sparkSession
    shared.prepare_python(spark)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint, n_switches bigint, mix array<double>"
    sent = spark.sparkContext.broadcast(model)  # weights and lexicon: bounded by BUCKETS and LEXICON
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        m = sent.value
        for batch in batches:
            for a, b, words, lengths in _runs(batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *_predicted(m, words, lengths)], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", "mix"])

    return rows.mapInArrow(run, schema)


def _runs(texts: list[str | None], most: int = 20_000) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Rows ``[a, b)`` with their words one after another: one text at least, and few words beyond ``most``."""
    a = 0
    while a < len(texts):
        words: list[str] = []
        lengths: list[int] = []
        b = a
        while b < len(texts) and (b == a or len(words) < most):
            found = WORD.findall(texts[b].lower()) if texts[b] else []
            words += found
            lengths.append(len(found))
            b += 1
        yield a, b, words, np.array(lengths)
        a = b


def _predicted(m: Model | None, words: list[str], lengths: np.ndarray) -> list[pa.Array]:
    n = len(lengths)
    pred, score, switches, mix = [UND] * n, np.zeros(n), np.zeros(n, np.int64), [[]] * n
    at = np.flatnonzero(lengths)
    if m is not None and len(at):
        p, _ = posteriors(m.word_scores(words), lengths[at], m.move)
        weight = np.fromiter(map(len, words), np.float64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths[at])[:-1]))
        share = np.add.reduceat(p * weight[:, None], starts, axis=0)
        share /= share.sum(1, keepdims=True)
        best = p.argmax(1)
        change = np.concatenate(([0], best[1:] != best[:-1])).astype(np.int64)
        change[starts] = 0
        switched = np.add.reduceat(change, starts)
        for j, i in enumerate(at.tolist()):
            top = int(share[j].argmax())
            pred[i], score[i], switches[i], mix[i] = m.labels[top], min(1.0, float(share[j, top])), switched[j], share[j].tolist()
    return [pa.array(pred), pa.array(score), pa.array(lengths.astype(np.int64)), pa.array(switches), pa.array(mix, pa.list_(pa.float64()))]


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least that score.  Rows are filtered where they are read."""
    spark = docs.sparkSession
    shared.prepare_python(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        m = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b, words, lengths in _runs(texts):
                pred, score, *_ = _predicted(m, words, lengths)
                good = (np.array(pred.to_pylist(), object) != UND) & (score.to_numpy() >= least)
                yield batch.slice(a, b - a).filter(pa.array(good.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
