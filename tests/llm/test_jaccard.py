import random
import re

import pytest

from verdantflow.llm import components
from verdantflow.llm.jaccard import ngram_jaccard_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, size, edits, start):
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component) for r in ngram_jaccard_join(df, **kw).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block,long", [(1, 1 << 17), (7, 1 << 17), (256, 1 << 17), (7, 1), (256, 20)])
def test_families_match_brute_force(spark, block, long, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", 5 if block == 7 else 1000)
    rng = random.Random(5)
    rows = family(rng, 60, 4, 1000) + family(rng, 30, 2, 2000) + family(rng, 2, 1, 10)
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(3000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(10 + k)) + " " + passage) for k in range(30)]
    rows += [(4000 + k, "Same TEXT for all of us here") for k in range(20)] + [(4100, "same text\tfor ALL of us here")]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5005, "É one"), (5006, "é one")]
    rng.shuffle(rows)
    check(spark, rows, block=block, long_list=long)


def test_long_text_and_noisy_sketch(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, " ".join(long[:150_000])), (4, "a" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component) for r in ngram_jaccard_join(df, sketch_bits=8).collect()}
    assert got == {1: (199_996, 1), 2: (189_996, 1), 3: (149_996, 3 if 149_996 / 189_996 < 0.8 and 149_996 / 199_996 < 0.8 else 1), 4: (1, 4)}


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, id long, n int, f1 int, token string"
    assert ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f", 1, 1, 1, "x")] * 3 + [(None, "a b c d e f", None, None, None, None), (9, "A b c d e f", 2, 2, 2, "y")]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 7, 7)] * 3 + [(9, 2, 7, 7), (None, 2, None, None)], key=str)
