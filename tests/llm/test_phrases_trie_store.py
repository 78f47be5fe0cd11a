"""Collocations, prefix trie and token store against plain versions, and on awkward tables."""

from __future__ import annotations

import glob
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import collocations, prefix_trie, token_store

DATA = "/root/testdata/sf0.001"
CLASHING = "k hash shard words cut best salt nth rank path depth first own head top key parent part pos ids base file digest start".split()


def awkward(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING]).repartition(4)


# ---- phrases ---------------------------------------------------------------------------------------------------------


def plain_phrases(rows, top=2000, support=100, longest=5):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        inside = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= candidates[p[i : i + k]]}
        rows = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(3)
    words = ["the", "of", "New", "york", "a", "été", "x" * 30, "'s", "日本", "\x00\x1f"]
    rows = [(r.choice(["en", "fr", None, ""]), r.choice([" ", "  ", "\t", ". ", "\n ", " \x0b"]).join(r.choice(words) for _ in range(r.randrange(0, 60)))) for _ in range(1200)]
    rows += [(None, None), ("en", ""), ("en", " .,\n"), ("de", "ab cd ef " * 30_000), ("de", "y" * 200_000)] * 2
    # a third of all rows is one text, and a phrase that stands in one shard's rows only
    return rows + [("en", "New York is a city, New York")] * 600 + [("es", "uno dos tres cuatro cinco seis")] * 101


@pytest.mark.parametrize("shards, support, top", [(3, 100, 2000), (1, 100, 5), (5, 40, 2000)])
def test_phrases_as_counted_in_a_loop(spark, phrases, shards, support, top):
    df = awkward(spark.createDataFrame(phrases, "lang string, text string"))
    got = sorted(map(tuple, collocations.mine(df, top=top, support=support, shards=shards).collect()))
    assert got == sorted(plain_phrases(phrases, top, support))
    assert any(r[2] == "uno dos tres cuatro cinco" for r in got)


def test_phrases_with_a_full_table(spark, phrases, monkeypatch):
    """All phrases share few slots: counted in vain, never wrongly."""
    monkeypatch.setattr(collocations, "LEAST_SLOTS", 4)
    monkeypatch.setattr(collocations, "MOST_SLOTS", 4)
    monkeypatch.setattr(collocations, "GATHER", 50)
    monkeypatch.setattr(collocations, "GATHER_NAMES", 20)
    df = awkward(spark.createDataFrame(phrases, "lang string, text string"))
    assert sorted(map(tuple, collocations.mine(df, support=40).collect())) == sorted(plain_phrases(phrases, support=40))


def test_phrases_of_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 10**12, 10**12)], "a bigint, n bigint, l bigint, r bigint")
    score = row.selectExpr("(cast(a as decimal(20, 0)) * 1000 * cast(n as decimal(14, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) AS s").first()["s"]
    assert score == 10_000


# ---- trie ------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    convs, members, ends, below, sums, out = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list), {}, []
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5((str(len(r.encode())) + ":" + r + x).encode()).hexdigest() + "%08X" % count(x), (r, x)))
    for v in convs.values():
        v.sort()
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(r[3] for r in convs.get(first, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        sums[p] = (sum(sums[k][0] for k in below[p]) or 1, sum(sums[k][1] for k in below[p]) + ((n - 1) * count(p[-1][1]) if p else 0))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(below[p]), *sums[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    """Copies, prefixes of one another, long shared beginnings, one beginning of a third of all, ties, nulls."""
    r, rows = random.Random(seed), []
    for c in range(-60, 700):
        begin = r.choice([[], ["a"] * 40, ["a", "b"] * 20, ["q"] * 3])
        for i, x in enumerate(begin + [r.choice("xyz") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 30, 60]))]):
            turn = None if i == 0 and r.random() < 0.3 else i if r.random() < 0.9 else 1
            rows.append((c, turn, None if r.random() < 0.05 else "user", None if x == "z" else x + " word" * (i % 3)))
    rows += [(None, 1, "user", "x")] * 5 + [(7, 2, "user", "x y")] * 3
    return rows + [(c, t, "user", "same") for c in range(1000, 1400) for t in range(3)] + [(5000, t, "user", f"turn {t}") for t in range(700)]


@pytest.mark.parametrize("hot, least", [(1000, 64), (2, 1), (1000, 1 << 40)])
def test_nodes_as_in_a_dictionary(spark, monkeypatch, hot, least):
    """With many beginnings peeled by halves of bands, with the default, and with none."""
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "LEAST_HOT", least)
    rows = conversations(hot)
    df = awkward(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == plain_trie(rows)


def test_hash_of_members_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = [(c, 0, "user", "x") for c in range(-30, 500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == plain_trie(rows)


def test_trie_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(empty).collect() == []


def test_bands_cover_every_level():
    for deepest in (0, 1, 3, 4, 5, 8, 12, 13, 399, 5000):
        bands = prefix_trie.levels(deepest)
        assert [d for low, high in bands[::-1] for d in range(low + 1, high + 1)] == list(range(deepest + 1))
        assert len(bands) <= 5 + deepest.bit_length()


# ---- token store -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-5, None), (None, "no id"), (None, "no id either"), (7, "seven again"), (9000, ""), (9001, "é" * 90_000), (9002, "ab " * 100_000), (9003, "<|endoftext|>"), (7, "seven again")]
    path = f"file://{tmp_path_factory.mktemp('store')}/ids"
    token_store.write(awkward(spark.createDataFrame(docs, "doc_id bigint, text string")), path, "byte_bpe_50k.json")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return path, [(d, t.encode(x or "", add_special_tokens=False).ids + [token_store.END]) for d, x in docs]


def test_places_as_in_a_loop(spark, store):
    path, docs = store
    got = sorted(map(tuple, token_store.places(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(ids), crc(ids)) for d, ids in docs)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_stream_and_lookups(spark, store):
    path, docs = store
    rows = sorted(token_store.read(spark, path).collect(), key=lambda r: r["start"])
    stream = [i for r in rows for i in r["ids"]]
    assert sorted(len(x) for _, x in docs) == sorted(r["n_tokens"] for r in rows) and len(stream) == sum(len(x) for _, x in docs)
    for first, last in ((0, 10), (0, len(stream)), (1234, 54_321), (len(stream) - 5, len(stream) + 100), (40, 40)):
        got = sorted(token_store.window(spark, path, first, last).collect())
        assert [i for r in got for i in r["ids"]] == stream[first:last]
    found = token_store.lookup(spark, path, [7, 9001]).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((d, tuple(x)) for d, x in docs if d in (7, 9001))
    files = glob.glob(path.removeprefix("file://") + "/ids/*.orc")
    assert files and all(orc.ORCFile(f).row_index_stride == token_store.STRIDE for f in files)


def test_store_of_no_rows(spark, tmp_path):
    token_store.write(spark.createDataFrame([], "doc_id bigint, text string"), f"file://{tmp_path}/none", "byte_bpe_50k.json")
    assert token_store.places(spark, f"file://{tmp_path}/none").collect() == []
