"""The language models see every word, however many there are, and match a plain model of the same formula."""

import math
import random
import re
from collections import Counter

import pytest

from verdantflow.llm import lm


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(texts, v, prior):
    """-log2 p(b | a) of a bigram model whose prior is the add-one frequency of words, with ``v`` known words."""
    pair, word, prev = Counter(), Counter(), Counter()
    for own in texts:
        for a, b in zip([None, *own], own):
            pair[a, b] += 1
            word[b] += 1
            prev[a] += 1
    n = sum(word.values()) + v + 1
    return lambda a, b: -math.log2((pair[a, b] + prior * (word[b] + 1) / n) / (prev[a] + prior))


def check(got, seqs, taught, chosen, prior):
    v = len({w for i in taught for w in seqs[i]})
    t, b = plain([seqs[i] for i in chosen], v, prior), plain([seqs[i] for i in taught], v, prior)
    for r in got:
        own = seqs[r.id]
        assert r.n_words == len(own)
        for f, x in ((t, r.target_loss), (b, r.background_loss)):
            want = sum(f(p, w) for p, w in zip([None, *own], own)) / len(own) if own else None
            assert x is None if not own else math.isclose(x, want, rel_tol=1e-6, abs_tol=1e-7), (r.id, x, want)
        assert r.score is None if not own else math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-12)


@pytest.mark.parametrize("head", [1 << 17, 64, 0])
def test_rare_words_count(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CHUNK", 2000)
    monkeypatch.setattr(lm, "BUCKET", 1000)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(6000)]
    rows = [(i, " ".join(rng.choices(words, range(6000, 0, -1), k=100)), i % 3 == 0, True) for i in range(150)]
    rows += [(1000, "w1 w2 rare1 rare2", True, True), (1001, "w1 w2 rare3 rare4", False, True), (1002, None, True, True), (1003, " ", None, True), (1000, "w1 w2 rare1 rare2", True, True)]
    rows += [(2000, "w1 rare1 rare2 never seen", True, False), (2001, "w1 w2 rare3 rare4", True, None)]
    rows += [(3000 + i, "the same words of many copies", i % 2 == 0, True) for i in range(200)]
    seqs = {i: words_of(t) for i, t, *_ in rows}
    taught = [i for i, *_, teach in rows if teach]
    assert len({w for i in taught for w in seqs[i]}) > 2048 + 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean, learn boolean")
    got = lm.cross_entropy_difference(df, lm.F.col("good"), lm.F.col("learn"), prior=2.5).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    check(got, seqs, taught, [i for i, _, good, teach in rows if good and teach], 2.5)
    by = {r.id: r.score for r in got}
    assert by[1000] < by[1001] and len({by[3000 + i] for i in range(200)}) == 1


def test_losses_match_a_plain_bigram_model(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "AbcXYZ") for _ in range(rng.randrange(0, 30))), i % 2 == 1, "x") for i in range(60)] + [(99, None, True, "x"), (98, " \n", None, "x"), (None, "a b c", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean, target string")
    got = lm.cross_entropy_difference(df, lm.F.col("good")).collect()
    assert sum(r.id is None for r in got) == 1 and len(got) == len(rows)
    seqs = {i: words_of(t) for i, t, *_ in rows}
    check(got, seqs, list(seqs), [i for i, _, good, _ in rows if good], lm.PRIOR)
    assert lm.cross_entropy_difference(df.limit(0), lm.F.col("good")).count() == 0
    named = df.withColumnRenamed("doc_id", "n").withColumn("id", lm.F.lit("x"))  # ids of any type, and clashing names
    assert {r.id for r in lm.cross_entropy_difference(named, lm.F.col("good"), id_col="id").collect()} == {"x"}
