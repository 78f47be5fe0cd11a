"""What stays in a Python worker when the next stage begins, and how much a stage holds at once."""

import numpy as np
import pyarrow as pa

from tidemark.llm import bpe, decontam, language_id, minhash, shared


def test_the_codec_of_another_stage_is_let_go():
    bpe.codec("byte_bpe_50k.json")
    assert bpe.codec.cache_info().currsize
    shared.let_go()
    assert not bpe.codec.cache_info().currsize


def test_near_copies_and_language_let_go_before_they_read(spark, monkeypatch):
    """The functions that go to the workers are caught and run here, over no batches."""
    caught, calls = [], []
    monkeypatch.setattr(shared, "let_go", lambda: calls.append(1))
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id bigint, text string, lang string")
    frame = type(docs)
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, *a, **k: caught.append(run) or whole(self, run, schema, *a, **k))
    minhash.signatures(docs, 5, 5, 40)
    minhash.shingle_table(docs, docs.select("doc_id").withColumnRenamed("doc_id", "rep"), 5)
    language_id.predict(docs, None)
    language_id.keep_identified(docs, None)
    for run in caught:
        list(run(iter([])))
    assert len(caught) == len(calls) == 4


def test_the_sample_needs_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "xy"[i % 2]) for i in range(20)], "doc_id bigint, text string, lang string")
    docs.count()

    def refuse(*a, **k):
        raise AssertionError("a list is dealt to Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert len(language_id.sampled_pieces(docs)) == 20


def test_shingles_do_not_depend_on_the_block():
    texts = pa.array([f"word{i} and word{i * 7 % 13} then some more words é {'x ' * (i % 50)}" for i in range(300)] + [None, "", "one"])
    by = {most: [s for _, _, raw, bounds in shared.text_blocks(texts, most) for s in minhash.shingle_sets(raw, bounds, 5)] for most in (1, 1000, minhash.TEXT_BLOCK, 1 << 20)}
    for sets in by.values():
        assert all(np.array_equal(a, b) for a, b in zip(sets, by[1 << 20], strict=True))


def test_rows_from_python_that_are_read_again_are_not_written_to_files(spark, monkeypatch):
    """Each written file starts processes on the executor, whose memory counts twice meanwhile."""
    written = []
    whole = shared.materialise
    monkeypatch.setattr(shared, "materialise", lambda df, name: written.append(name) or whole(df, name))
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words altogether in this one here"), (4, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in minhash.near_groups(docs).select("doc_id", "component_id", "kept").collect()} == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}
    items = spark.createDataFrame([(7, "word1 word2 word3 word4 word5 word6 word7")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [3, 4]
    assert not {"signatures", "shingle-sets", "document-windows"} & set(written)
    shared.drop_held(spark)


def test_a_held_table_is_of_its_own_time_and_is_given_up(spark, tmp_path):
    import pyarrow.parquet as pq

    shared.drop_held(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()

    def read(values):
        pq.write_table(pa.table({"x": pa.array(values, pa.int64())}), f"{tmp_path}/t.parquet")
        return shared.hold(spark.read.parquet(f"{tmp_path}/t.parquet"))

    first = read([1, 2])
    assert first.columns == ["x"] and sorted(r["x"] for r in first.collect()) == [1, 2]
    second = read([3, 4, 5])
    assert sorted(r["x"] for r in second.collect()) == [3, 4, 5]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 2
    shared.drop_held(spark, first)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 1
    shared.drop_held(spark)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_decontamination_lets_go_before_it_reads(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "let_go", lambda: calls.append(1))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    caught = []
    frame = type(docs)
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, *a, **k: caught.append(run) or whole(self, run, schema, *a, **k))
    decontam.window_table(docs, "doc_id", 5)
    for run in caught:
        list(run(iter([])))
    assert len(caught) == len(calls) == 1


def test_a_fresh_worker_may_see_empty_texts_first(monkeypatch):
    monkeypatch.setattr(shared, "_powers", {})
    for _, _, raw, bounds in shared.text_blocks(pa.array([None, ""], pa.string())):
        assert [len(s) for s in minhash.shingle_sets(raw, bounds, 5)] == [0, 0]
