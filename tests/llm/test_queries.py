"""The registered queries, with production parameters, against brute force on a small fixture."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdantflow.llm import lm, packing, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, path = random.Random(21), tmp_path_factory.mktemp("tables")
    vocabulary = [f"{a}{b}" for a in ("the", "wind", "sol", "qu", "é") for b in ("", "ar", "ing", "x", "est")]
    docs = []
    for i in range(160):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        docs.append([i, rng.choice([" ", "  ", "\n"]).join(body), "en" if i % 2 else "fr", f"s{i % 5}" if i % 9 else None, 1])
    docs += [[200 + k, docs[3][1] + " more" * (k % 3), "en", "s1", 1] for k in range(9)] + [[300, None, None, None, None], [301, " \n", "en", "s2", 0], [302, "word " * 3000, "en", "s3", 1], [303, "a b", "en", "s0", 1], [304, "A  B", "en", "s0", 1]]
    labels = [(r[0], rng.choice([0, 1, 1]), int(rng.random() < 0.1)) for r in docs if r[0] % 3] + [(1, 0, 0), (None, 1, 1), (2, None, 0)]
    pages = [(i, rng.choice(["http://a.net/x", "https://b.example.net/en/y?q#f", "http://example.com/de/1", "x://EXAMPLE.com/fr", "http://z.org/fr/", "plain", None, f"http://h{i}.io/{i}"])) for i in range(120)]
    vectors = [(i, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(260)] + [(300, None), (350, [None] * 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, u, "") for i, u in pages], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), {r[0]: r for r in docs}, labels, pages, vectors


def test_near_copies(spark, data):
    path, docs, *_ = data
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(words(r[1])) for i, r in docs.items()}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near[a].add(b)
    got = {r.doc_id: r for r in queries.op1_ngram_jaccard_join(spark, path).collect()}
    assert len(got) == len(docs)
    for i in docs:
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), min(reach), len(near[i]))


def test_packing(spark, data):
    path, docs, *_ = data
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for i, r in docs.items()}
    rows = queries.op2_best_fit_packing(spark, path).collect()
    pieces, load = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        load[r.sequence_id].append(r)
    for i, own in ids.items():
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or k == 0 or len(own) <= 1024
            at += r.length
        assert at == len(own) and len(pieces[i]) == -(-len(own) // 1024)
    for own in load.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(load) <= packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025), 1024) + 1


def test_language_models(spark, data):
    from test_lm_vocabulary import check

    path, docs, labels, *_ = data
    quality = defaultdict(list)
    for i, q, _ in labels:
        if i is not None and q is not None:
            quality[i].append(q)
    chosen = [i for i, q in quality.items() if min(q) == 1]
    got = [type("R", (), r.asDict() | {"id": r.doc_id}) for r in queries.op3_lm_scoring(spark, path).collect()]
    assert sorted(r.id for r in got) == sorted(docs)
    check(got, {i: words(r[1]) for i, r in docs.items()}, list(docs), chosen, lm.PRIOR)


def test_token_files(spark, data):
    path, docs, *_ = data
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for i in sorted(docs):
        ids = [*t.encode(docs[i][1] or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op5_token_output(spark, path).collect()) == want


def test_top_k(spark, data):
    path, *_, vectors = data
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v and None not in v}
    want = sorted((q, k + 1, i, -s) for q in ints if q % 50 == 0 for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)[:5]))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op6_exact_top_k(spark, path).collect()) == want


def test_mixing(spark, data):
    path, docs, *_ = data
    rows = queries.op7_source_mixing(spark, path).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, queries.op7_source_mixing(spark, path).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(words(docs[r.doc_id][1])) and r.source == docs[r.doc_id][3] and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted((s for s in size if s is not None)) + [None]
    weight, left, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), set()
    while True:  # shares by weight, those above twice the size are cut and the rest shared anew
        share = {s: 2.0 * size[s] if s in full else weight[s] * (left - sum(2.0 * size[x] for x in full)) / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, share[r.source], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_url_rules(spark, data):
    path, _, _, pages, _ = data
    listed = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = dict(pages)
    for r in queries.op9_url_filters(spark, path).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, where = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(k), k, v) for k, v in listed if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and where.startswith(k[k.index("/") :])]
        assert (r.host, r.path) == (host, where)
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))  # labels are few: no rule is mined
