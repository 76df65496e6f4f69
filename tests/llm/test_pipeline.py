"""The pipeline's stages on a small table of documents, each against what it must do."""

import random
from collections import Counter

import corpus_pipeline as cp
from verdantflow.llm.mixing import mix_sources


def documents(spark, tmp_path):
    rng = random.Random(11)
    words = {"en": ["the", "and", "thing", "thorn", "with"], "fr": ["eau", "été", "les", "oui", "dans"]}
    rows = []
    for i in range(240):
        g = "en" if i % 3 else "fr"
        body = " ".join(f"{rng.choice(words[g])}{rng.choice(words[g])}" for _ in range(rng.randrange(20, 120)))
        rows.append((i, body, g if i % 7 else None, f"s{i % 4}" if i % 11 else None, len(body)))
    rows += [(1000 + k, rows[5][1] + " extra" * k, "en", "s1", 1) for k in range(4)]  # near copies of document 5
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, "123 456", "fr", "s0", 7), (7, *rows[7][1:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "mixing to target weights", "best-fit packing"]

    known = cp.STAGES[0][1](spark, docs, str(tmp_path)).cache()
    assert known.columns == docs.columns
    assert sorted(r.doc_id for r in known.collect()) == sorted(r[0] for r in rows if r[0] not in (2000, 2001, 2002))
    assert all(r.lang == ("en" if r.doc_id % 3 else "fr") for r in known.collect() if r.doc_id < 240)

    single = cp.STAGES[1][1](spark, known, str(tmp_path)).cache()
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == list(range(240))  # 5 stands for its copies, 7 once

    mixed = cp.STAGES[2][1](spark, single, str(tmp_path)).cache()
    assert mixed.columns == docs.columns
    plan = {r.id: r for r in mix_sources(single, lambda i: cp.MIX_WEIGHTS[i % 3], seed=cp.SEED).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, r in plan.items():
        assert r.taken // r.size <= copies[i] <= -(-r.taken // r.size) and copies[i] <= 2
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())

    packed = cp.STAGES[3][1](spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 1024

    ran = cp.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, ran)) == Counter(map(key, packed))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_different_texts_of_one_id_are_kept(spark, tmp_path):
    one, other, far = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "some other words that stand quite alone here")
    rows = [(1, one, "en"), (1, other, "en"), (1, one, "en"), (2, one, "en"), (3, far, "en"), (4, far, "en"), (None, far, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    got = cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (1, other), (3, far), (0, far)])
