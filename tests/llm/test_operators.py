"""Media, mixing, top-k, URL filters, and language ID against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from verdantflow.llm import language, media, mixing, topk, urls


# Media
def texts(n=60):
    rng = random.Random(2)
    return [None, "", "é" * 288, "x" * 576, "y" * 577, *("".join(rng.choice("abc é\n") * rng.randrange(1, 90) for _ in range(rng.randrange(1, 60))) for _ in range(n))]


def test_payloads_survive_the_file(spark):
    some = texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(some)]
    files = media.text_media(spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")).cache()
    got = {r.id: r for r in media.media_digests(files).collect()}
    stored = {r.id: bytes(r.media) for r in files.collect()}
    for i, t in enumerate(some):
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-32:]) and r.media_sha256 == hashlib.sha256(stored[i]).hexdigest() and r.media_bytes == len(stored[i])
        spans, rate = media.parse_riff(stored[i])
        assert rate == 25 and len(spans) == len(full) // 576
    clips = defaultdict(list)
    for r in media.clip_rows(files).collect():
        clips[r.id].append(r)
    for i, own in clips.items():
        own.sort(key=lambda r: r.clip)
        assert own[0].begin_frame == 0 and all(a.end_frame == b.begin_frame for a, b in zip(own, own[1:])) and own[-1].end_frame == got[i].payload_bytes // 576
        assert all(r.end_s == r.end_frame / 25 for r in own)
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shots_are_found_where_the_picture_changes():
    rng = np.random.default_rng(0)
    dark, light = (rng.integers(a, a + 40, (12, 24, 24)).astype(np.uint8) for a in (0, 180))
    file = media.riff(media.encode_frames(np.concatenate([dark, light, dark])))
    [(frames, begins, rate)] = media.read_media([file])
    assert begins == [0, 12, 24] and len(frames) == 36
    with_no_index = file[: file.index(b"idx1")]
    assert len(media.parse_riff(with_no_index)[0]) == 36
    with pytest.raises(ValueError):
        media.parse_riff(b"RIFF\0\0\0\0WAVE")


def test_other_predictors_and_baseline_frames():
    # a frame of one grey level: each lossless difference but the first is 0 under any predictor
    level = np.full((1, 24, 24), 77, np.uint8)
    frame = media.encode_frames(level)[0]
    at = frame.index(b"\xff\xda")
    for p in range(1, 8):
        changed = frame[: at + 7] + bytes([p]) + frame[at + 8 :]
        assert (media.decode_frames([changed])[0] == 77).all()
    # baseline: 8 x 8, one DC difference of category 5 (value 20, quantised by 16: level 128 + 20 * 16 / 8), then end of block
    head = b"\xff\xd8\xff\xdb\0\x43\0" + bytes([16] * 64) + b"\xff\xc0\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0"
    head += b"\xff\xc4\0\x14\0" + bytes([1] + [0] * 15) + b"\x05" + b"\xff\xc4\0\x14\x10" + bytes([1] + [0] * 15) + b"\x00" + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0"
    assert (media.decode_frames([head + bytes([0b0_10100_0_1]) + b"\xff\xd9"])[0] == 168).all()


# Mixing
def targets(sizes, weights, total, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights(i) for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = total - sum(fixed.values())
        left = [s for s in names if s not in fixed]
        share = {s: w[s] * rest / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("block", [1, 256])
def test_sources_come_near_their_targets(spark, block):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "é", "B", None, "hot", "hot", "hot"]), "w " * rng.choice([0, 1, 5, 40, 900]), 1, "x") for i in range(700)]
    rows += [(3, "a", "w w", 1, "x")] * 3 + [(None, "B", "w", 1, "x"), (9999, "tiny", "w", 1, "x"), (9998, "none", None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, key string")
    run = lambda: sorted(map(tuple, mixing.mix_sources(df, lambda i: (3, 1, 2)[i % 3], block=block, shard_words=20_000).collect()), key=str)
    got = run()
    assert len(got) == len(rows) and got == run()
    sizes, taken = Counter(), Counter()
    for i, size, source, source_size, target, take in got:
        assert 0 <= take <= 2 * size
        sizes[source] += size
        taken[source] += take
    want = targets(sizes, lambda i: (3, 1, 2)[i % 3], 1.5 * sum(sizes.values()), 2)
    for i, size, source, source_size, target, take in got:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 3 * block for s in sizes)


def test_quotas_follow_highest_quotients():
    rng = random.Random(1)
    for _ in range(60):
        votes = [rng.choice([0, 1, 3, 10, rng.random() * 50]) for _ in range(rng.randrange(1, 8))]
        most = [rng.randrange(0, 12) for _ in votes]
        seats = rng.randrange(0, 30)
        got = [0] * len(votes)
        for _ in range(seats):
            able = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
            if able:
                got[max(able, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes), seats, np.array(most)).sum() == sum(got)
        quotient = lambda q: [v / (2 * g + 1) for v, g in zip(votes, q)]
        assert sorted(np.round(quotient(mixing.sainte_lague(np.array(votes), seats, np.array(most))), 9)) == sorted(np.round(quotient(got), 9))


# Top-k
def test_exact_top_k_matches_brute_force(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(600)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(300)]  # one very common vector
    vectors += [(2000, None), (2050, [float("nan")] * 8), (2100, [None] * 8), (2150, [float("inf")] + [0.0] * 7), (2200, [1e300] * 8), (2250, [0.1] * 4), (2251, [0.2] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding", 256)
    got = defaultdict(list)
    for r in sorted(topk.exact_top_k(v.filter("id % 50 = 0 and id <> 2200"), v.filter("id <> 2200"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.id, r.score))
    ints = {i: [math.floor(256 * x) for x in e] for i, e in vectors if e and all(x is not None and math.isfinite(x) for x in e) and i != 2200}
    for q in [i for i in ints if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q and len(e) == len(ints[q]))
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert set(got) == {i for i in ints if i % 50 == 0}
    none = spark.createDataFrame([], "id long, vector array<long>")
    assert topk.exact_top_k(none, none).count() == 0


# URL filters
def test_urls_are_parsed_and_judged(spark):
    listed = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"), "https://www.example.net/en/1?q=/": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "x://example.com/de/?a": ("example.com", "/de/", "example.com/de/", "block"), "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "x://org/fr/#f": ("org", "/fr/", "org/fr/", "allow"), "x://a.org?fr": ("a.org", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x:///p": ("", "/p", None, "allow"),
        "x://É.COM/": ("É.com", "/", None, "allow"), "x://a\nb.net/\n": ("a\nb.net", "/\n", "net/", "block"),
    }
    rows = [(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "x", "y")]
    labels = spark.createDataFrame([(0, True)], "id long, blocked boolean").limit(0)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), labels, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r


def test_rules_match_brute_force_mining(spark):
    rng = random.Random(9)
    pages, labels = [], []
    for i in range(600):
        host, section, junk = rng.choice(["a.com", "b.com", "c.org"]), rng.choice(["news", "shop", "win"]), rng.choice(["", "?ref=1", "?utm=2"])
        pages.append((i, f"http://{host}/{section}/{i}{junk}"))
        if i % 2:
            bad = section == "win" and host == "a.com" or rng.random() < 0.05
            labels.append((i, bad))
    df, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "id long, blocked boolean")
    h, p = urls.host_and_path(urls.F.col("url"))
    tokens = {r.page_id: frozenset(r.t) for r in df.withColumns({"h": h, "p": p}).select("page_id", urls.url_tokens(urls.F.col("h"), urls.F.col("p"), urls.F.col("url")).alias("t")).collect()}
    marked = dict(labels)
    n = len(marked)
    count = Counter(t for i in marked for t in tokens[i])
    useful = {t for t, c in count.items() if c <= 0.9 * n and c >= 0.02 * n}
    from itertools import combinations

    both, alone = Counter(), Counter()
    for i, bad in marked.items():
        own = sorted(tokens[i] & useful)
        for k in (1, 2, 3):
            for s in combinations(own, k):
                alone[s] += 1
                both[s] += bad
    rules = [s for s in alone if both[s] >= 0.02 * n and both[s] >= 0.8 * alone[s]]
    want = {i: "block" if any(set(s) <= tokens[i] for s in rules) else "allow" for i, _ in pages}
    got = {r.id: r.verdict for r in urls.filter_urls(df, marks, [], support=0.02, confidence=0.8, least=1, risk=math.inf).collect()}
    assert got == want and "block" in want.values()


# Language ID
def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "ing", "thorn"], "fr": ["eau", "été", "les", "oui"], "de": ["über", "ung", "schön", "und"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(30)), g, "x") for i, g in enumerate(list(words) * 40)]
    rows += [(500, None, "en", "x"), (501, "", "en", "x"), (502, "12 + 34 Ⅷ", "fr", "x"), (503, "the and " * 50_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.train(df.filter("doc_id % 5 <> 0"))
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert model.languages == ("de", "en", "fr")
    assert all(out[i].lang_pred == g for i, _, g, _ in rows[:120]) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "en"] and out[500].score == 0
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"} and language.identify(df.limit(0), model).count() == 0


def test_scores_match_plain_naive_bayes(spark):
    rows = [(1, "abba ab", "x"), (2, "bcb cc", "y"), (3, "ab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, bits=20, sizes=(1,), smoothing=1.0)
    counts = {g: Counter(c for _, t, lang in rows if lang == g for c in " " + t) for g in "xy"}
    size = 1 << 20
    prior = {"x": math.log(2 / 3), "y": math.log(1 / 3)}
    for text in ("ab", "bcc a"):
        total = {g: prior[g] + sum(math.log((counts[g][c] + 1) / (sum(counts[g].values()) + size)) for c in " " + text) for g in "xy"}
        best = max(total, key=total.get)
        [label], [score] = language.score_texts([text], model)
        assert label == best and math.isclose(score, 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-3)
