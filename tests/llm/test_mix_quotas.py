"""Quotas of sources are met to the word, however large the blocks are."""

from collections import Counter

from verdantflow.llm import mixing


def test_small_sources_take_their_targets_beside_a_large_one(spark):
    rows = [(i, "big", "w " * 500) for i in range(400)]
    rows += [(1000 + 10 * s + k, f"small{s}", "w " * (7 + k)) for s in range(30) for k in range(3)]
    rows += [(5000, "part", "w " * 275), (5001, "blank", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for block, shard_words in ((256, 1000), (256, 1 << 30), (1, 20_000)):
        got = mixing.mix_sources(df, lambda i: (3, 1, 2)[i % 3], block=block, shard_words=shard_words).collect()
        taken, target = Counter(), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        assert all(taken[f"small{s}"] == 2 * 24 for s in range(30))
        assert sum(taken.values()) == round(sum(target.values()))
