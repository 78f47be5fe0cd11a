"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up
inside one token, so a cut between them is certain.  Texts are cut at such pairs where
the pre-tokenizer cannot look across either: a non-space byte before ASCII white space,
or two ASCII letters.  Fragments are encoded independently (and each distinct one once
per worker while its memo lasts), and their ids are concatenated.  Decoding concatenates
the bytes of the ids, which is what the byte-level decoder does.

Fragments of characters on whose classes all regular expression engines agree (``PLAIN``)
are encoded from the same vocabulary by the faster of the two libraries, the rest, and those
that may hold a special token, by the one that the vocabulary file is for.

Edge cases: a null text counts as empty (0 ids, the digest of nothing); repeated rows
each get a row; a text without any cut is one fragment; columns besides ``doc_id`` and
``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MEMO = 250_000
LONGEST = 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Printable ASCII, Latin letters and marks, general punctuation, and the three white space characters that no engine doubts.
PLAIN = re.compile("[\\x20-\\x7e\\n\\r\\t\\u00a1-\\u024f\\u2010-\\u2027\\u20ac]*")
#: Stands between fragments; no UTF-8 text has this byte.
CUT = b"\xff"


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char = _byte_of_char()
        vocabulary = spec["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *special]))
        inside = np.zeros((256, 256), bool)
        for token, i in vocabulary.items():
            raw = bytes(of_char[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:]):
                inside[a, b] = True
        for i, raw in special.items():
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:]):
                inside[a, b] = True
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        safe = (~shared.IS_SPACE)[:, None] & shared.IS_SPACE[None, :] | letter[:, None] & letter[None, :]
        self.cut = (safe & ~inside).ravel()
        self.memo = shared.TwoGenerations(MEMO)
        self.fast = self._ranked(spec, {t["id"] for t in spec["added_tokens"]})
        self.marks = tuple(t["content"][0] for t in spec["added_tokens"])

    def _ranked(self, spec: dict, special: set[int]):
        """The ranked form of the vocabulary, if ids are in the order of merges and nothing but the usual split comes first; else None."""
        import tiktoken

        vocabulary, before = spec["model"]["vocab"], spec["pre_tokenizer"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or before["type"] != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        ranks = {self.bytes_of[i]: i for i in vocabulary.values() if i not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def fragments(self, raw: np.ndarray) -> list[bytes]:
        if len(raw) < 2:
            return [raw.tobytes()] if len(raw) else []
        at = np.flatnonzero(self.cut[(raw[:-1].astype(np.int64) << 8) | raw[1:]]) + 1
        return np.insert(raw, at, CUT[0]).tobytes().split(CUT)

    def encode_fragments(self, fragments: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Little-endian ids and decoded bytes of each fragment."""
        got = self.memo.get_all(fragments)
        missing = list({f for f, v in zip(fragments, got) if v is None})
        if not missing:
            return got
        fresh, rest = {}, []
        for f in missing:
            text = f.decode()
            if self.fast and PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
                fresh[f] = self.fast(text)
            else:
                rest.append((f, text))
        if rest:
            encoded = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
            fresh |= {f: e.ids for (f, _), e in zip(rest, encoded)}
        fresh = {f: (np.array(ids, "<u4").tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))) for f, ids in fresh.items()}
        short = [f for f in missing if len(f) <= LONGEST]
        self.memo.put(short, [fresh[f] for f in short])
        return [fresh[f] if v is None else v for f, v in zip(fragments, got)]

    def encode_block(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        for a, b in zip(bounds[:-1], bounds[1:]):
            parts = self.encode_fragments(self.fragments(raw[a:b]))
            yield b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


shared.keeps(codec.cache_clear)


def _rows(docs: DataFrame) -> DataFrame:
    shared.prepare_python(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids as little-endian unsigned 32-bit integers, the text as decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for a, b, raw, bounds in shared.text_blocks(batch.column(1)):
                done = list(c.encode_block(raw, bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(i) // 4 for i, _ in done], pa.int64()), pa.array([i for i, _ in done], pa.binary()), pa.array([d for _, d in done], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of the ids and the decoded text, so that these are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for a, b, raw, bounds in shared.text_blocks(batch.column(1)):
                n, ids, texts = [], [], []
                for i, d in c.encode_block(raw, bounds):
                    n.append(len(i) // 4)
                    ids.append(hashlib.sha256(i).hexdigest())
                    texts.append(hashlib.sha256(d).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, DIGESTS)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from the ``ids`` of :func:`encode`; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(tokenizer).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
