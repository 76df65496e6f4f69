"""Numbers of links against brute force, and texts that share an id."""

import random
import re

import pytest

from verdantflow.llm.jaccard import ngram_jaccard_join


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("block", [1, 2, 7, 256])  # blocks of 1 and 2 meet in tiles
def test_every_link_is_counted_once(spark, block):
    rng = random.Random(15)
    rows = []
    for f, (size, edits) in enumerate([(50, 4), (30, 2), (20, 6)]):
        base = [f"w{f}{rng.randrange(40)}" for _ in range(120)]
        for k in range(size):
            w = base[: 120 - rng.randrange(12)]
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * (f + 1) + k, " ".join(w)))
    rows += [(9000 + k, rows[3][1]) for k in range(5)] + [(9100, None), (9101, " "), (9102, "alone"), (9103, "two alike"), (9104, "TWO alike"), (None, rows[3][1])]
    rng.shuffle(rows)
    sets = sets_of(rows)
    want = sorted((i or 0, sum(alike(s, t) for k, (j, t) in enumerate(sets) if k != at and j is not None) if i is not None else 0) for at, (i, s) in enumerate(sets))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block, count_links=True).collect()
    assert sorted((r.id or 0, r.n_links) for r in got) == want


def test_texts_that_share_an_id_are_both_compared(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]

    def edited(places):
        return " ".join(f"y{p}" if p in places else w for p, w in enumerate(base))

    rows = [(1, " ".join(base[:190])), (5, edited({100})), (5, edited({60})), (5, edited({30, 150})), (7, edited({150}))]
    rng.shuffle(rows)
    sets = sets_of(rows)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True).collect()
    assert sorted((r.id, r.n_links) for r in got) == sorted((i, sum(alike(s, t) for k, (_, t) in enumerate(sets) if k != at)) for at, (i, s) in enumerate(sets))
    assert {r.component for r in got} == {1}
