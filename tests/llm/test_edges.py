"""Nulls, repeats, clashing names and odd tables that the operators' docstrings define."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from verdantflow.llm import language, lengths, media, queries, tokenfiles, topk


def test_repeated_query_ids_rank_by_row_and_few_vectors_are_read(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-200, 200) for _ in range(16)]) for i in range(3000)]
    rows += [(50, [1] * 16), (7, [-9] * 16), (7, [-9] * 16)]
    queries_ = [r for r in rows if r[0] % 50 == 0]
    for name, size in (("QUERIES", 8), ("CANDIDATES", 100), ("TILE", 2)):
        monkeypatch.setattr(topk, name, size)
    schema = "id long, vector array<long>"
    got = topk.exact_top_k(spark.createDataFrame(queries_, schema), spark.createDataFrame(rows, schema), 4).collect()
    assert len(got) == 4 * len(queries_)
    want = sorted((q, r + 1, i, -s) for q, v in queries_ for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, e)), i) for i, e in rows if i != q)[:4]))
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == want
    assert sum(r.exact_read for r in got) / len(got) < 60


def test_null_and_repeated_ids_keep_their_place_in_token_files(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(None, f"null {i}", 1) for i in range(30)] + [(5, f"five <|endoftext|> {i}", 2) for i in range(30)] + [(i, None if i % 3 else "", 3) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int").repartition(6)
    tokenfiles.write_tokens(df, str(tmp_path / "t"), "word_bpe_49k.json", kind="word", end_id=2)
    got = sorted(map(tuple, tokenfiles.token_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 30 + [5] * 30 + list(range(10, 20))
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    crcs = sorted(zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, x, _ in rows)
    assert sorted(r[3] for r in got) == crcs


def test_files_are_in_order_of_their_numbers(spark, tmp_path):
    docs = spark.createDataFrame([("part-99999-a", 3), ("part-100000-a", 4), ("part-00001-a", 2)], "file string, n_tokens long")
    got = {r.file: r.file_start for r in tokenfiles._file_starts(docs).collect()}
    assert got == {"part-00001-a": 0, "part-99999-a": 2, "part-100000-a": 5}


def test_more_labels_than_the_matrix_is_wide(spark, monkeypatch):
    monkeypatch.setattr(language, "CELLS", 1 << 17)
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{k}", " ".join(alphabet[k % 26] * 2 + alphabet[k // 26] * 3 + rng.choice(alphabet) for _ in range(30))) for k in range(300) for _ in range(2)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 300 and model.weights.size <= 1 << 17
    labels, _ = language.score_texts([t for _, t in rows], model)
    assert np.mean([a == b for a, (b, _) in zip(labels, rows)]) > 0.8
    monkeypatch.setattr(language, "CELLS", 1 << 10)
    with pytest.raises(ValueError):
        language.train(spark.createDataFrame(rows, "lang string, text string"))


def documents(spark, path, rows, more=""):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + more).write.parquet(str(path / "documents.parquet"))


def test_language_query_learns_from_its_fold_alone(spark, tmp_path):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(i, "zzz yyy" if held(i) else "aaa bbb", "wrong" if held(i) else "right", "s", 1) for i in range(200)]
    rows += [(None, "qqq www", "never", "s", 1), (300, None, "right", "s", 1), (301, "12 34", "right", "s", 1)]
    documents(spark, tmp_path, rows)
    got = queries.op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"right", "und"}
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {300, 301}


def test_media_query_reads_a_table_back(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", "abc", "é" * 700, "abc"] * 3)]
    documents(spark, tmp_path, rows)
    got = queries.op4_avi_motion_jpeg(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.payload_bytes == max(1, -(-r.n_bytes // 576)) * 576 for r in got)
    by = {}
    for r in got:
        by.setdefault(rows[r.doc_id][1] or "", set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values())
    assert media.media_digests(media.text_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    clips = media.clip_rows(media.text_media(spark.read.parquet(str(tmp_path / "documents.parquet")))).collect()
    assert {r.id for r in clips} == set(range(15)) and all(r.end_frame > r.begin_frame for r in clips)


def test_histogram_query_matches_plain_counts(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [None, "", "a b c", "a <|endoftext|> b", "word " * 40, "word " * 40]
    documents(spark, tmp_path, [(i, x, "en", "s", 1) for i, x in enumerate(some)])
    size = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in some]
    for r in queries.op8_length_histogram(spark, str(tmp_path)).collect():
        assert (r.docs, r.docs_above, r.tokens_above) == (size.count(r.length), sum(x > r.length for x in size), sum(x for x in size if x > r.length))
        assert r.tokens_kept == sum(min(x, r.length) for x in size) and r.quantile == sum(x <= r.length for x in size) / len(size)
    assert lengths.context_limits(spark.createDataFrame([], "length long, docs long")).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) + str(rng.randrange(900)) for _ in range(40)), "en" if i % 2 else None, f"s{i % 3}", 1, f"c{i}", i, f"p{i}", f"q{i}", i, "x") for i in range(60)]
    documents(spark, tmp_path, rows, ", copy string, copies int, predicted string, certainty string, id int, size string")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "copies", "predicted", "certainty", "id", "size"]
        for r in docs.collect():
            assert (r.copy, r.copies, r.predicted, r.certainty, r.id, r.size) == (f"c{r.doc_id}", r.doc_id, f"p{r.doc_id}", f"q{r.doc_id}", r.doc_id, "x")
    assert cp.run(spark, str(tmp_path)).filter(F.col("piece") == 0).count() > 0
