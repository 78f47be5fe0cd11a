"""The pipeline's stages against brute-force decisions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import DATA, brute_groups  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen, out = {}, docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, out, DATA).persist()
        seen[name] = out
        if name != "bpe":
            assert out.columns == docs.columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    first, second, third, fourth = (rows(seen[n]) for n in ("language_id", "exact_dedup", "near_dedup", "decontamination"))
    assert len(first) >= 0.98 * docs.count()
    best = {}
    for d, x in first.items():
        k = re.sub("[\x20\x09-\x0d]", "", x or "")
        best[k] = min(best.get(k, (1, 1)), (-len(x or ""), d))
    assert set(second) == {d for _, d in best.values()}
    groups = brute_groups(second.items(), 5, 80)
    assert set(third) == {d for d, (_, root) in groups.items() if d == root}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {d for d, x in third.items() if any(f" {q} " in f" {' '.join(re.findall(chr(92) + 'w+', x.lower()))} " for q in items)}
    assert set(fourth) == set(third) - leaks
    t = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))

    def encoded(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.decode(ids, skip_special_tokens=False).encode())

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in seen["bpe"].collect()}
    assert got == {d: encoded(x) for d, x in fourth.items()}
