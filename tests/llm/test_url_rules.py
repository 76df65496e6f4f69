"""Mined URL rules of any length against brute force without a limit."""

import math
import random
from collections import Counter
from itertools import combinations, product

from verdantflow.llm import urls


def test_rules_of_four_tokens_match_unlimited_brute_force(spark):
    rng = random.Random(12)
    pages, bad = [], {}
    for i, (a, b, c, d) in enumerate(list(product(("aa", "ab"), ("ba", "bb"), ("ca", "cb"), ("da", "db"))) * 25):
        site = rng.choice(["one", "two"])
        pages.append((i, f"http://{site}.com/{a}/{b}/{c}/{d}"))
        bad[i] = (a, b, c, d) == ("aa", "ba", "ca", "da") or (site == "one" and a == "ab" and rng.random() < 0.85)
    df = spark.createDataFrame(pages, "page_id long, url string")
    marked = {i: v for i, v in bad.items() if i % 3}
    h, p = urls.host_and_path(urls.F.col("url"))
    tokens = {r.page_id: frozenset(r.t) for r in df.withColumns({"h": h, "p": p}).select("page_id", urls.url_tokens(urls.F.col("h"), urls.F.col("p"), urls.F.col("url")).alias("t")).collect()}
    n, count = len(marked), Counter(t for i in marked for t in tokens[i])
    useful = {t for t, c in count.items() if 0.02 * n <= c <= 0.9 * n}
    both, alone = Counter(), Counter()
    for i, v in marked.items():
        own = sorted(tokens[i] & useful)
        for k in range(1, len(own) + 1):
            for s in combinations(own, k):
                alone[s] += 1
                both[s] += v
    rules = {s: both[s] / alone[s] for s in alone if both[s] >= 0.02 * n and both[s] >= 0.8 * alone[s]}
    least = {s for s in rules if not any(len(x) < len(s) and set(x) < set(s) and rules[x] >= rules[s] for x in rules)}
    assert any(len(s) >= 4 for s in least)
    labels = spark.createDataFrame(list(marked.items()), "id long, blocked boolean")
    train = df.join(labels, df.page_id == labels.id).withColumns({"h": h, "p": p}).select(urls.url_tokens(urls.F.col("h"), urls.F.col("p"), urls.F.col("url")).alias("items"), "blocked")
    mined = urls.mine_rules(train, 0.02, 0.8, least=1, risk=math.inf).collect()
    assert sorted(tuple(sorted(x)) for r in mined for x in product(*r.tokens)) == sorted(least)
    want = {i: "block" if any(set(s) <= tokens[i] for s in rules) else "allow" for i, _ in pages}
    assert {r.id: r.verdict for r in urls.filter_urls(df, labels, [], support=0.02, confidence=0.8, least=1, risk=math.inf).collect()} == want


def with_tokens(df):
    h, p = urls.host_and_path(urls.F.col("url"))
    return df.withColumns({"h": h, "p": p}).select(urls.url_tokens(urls.F.col("h"), urls.F.col("p"), urls.F.col("url")).alias("items"), "blocked")


def test_no_rule_from_noise_or_few_rows(spark):
    rng = random.Random(5)
    noise = [(f"http://s{rng.randrange(40)}.com/{rng.choice('abcdefgh')}/{rng.choice('ijklmnop')}/{i}", rng.random() < 0.26) for i in range(1000)]
    few = [("http://few.org/spam/x", True)] * 19  # one below the least number
    df = spark.createDataFrame(noise + few, "url string, blocked boolean")
    assert urls.mine_rules(with_tokens(df), 0.002, 0.8).count() == 0
    many = spark.createDataFrame(noise + [("http://many.org/spam/x", True)] * 25, "url string, blocked boolean")
    rules = urls.mine_rules(with_tokens(many), 0.002, 0.8).collect()
    assert len(rules) == 1 and rules[0].hits == rules[0].rows == 25 and "w:many.org" in rules[0].key


def test_rules_hold_on_pages_that_were_held_out(spark):
    rng = random.Random(6)
    pages = [(i, f"http://{rng.choice(['a', 'b'])}.com/{rng.choice(['win', 'news', 'shop'])}/{i}") for i in range(2000)]
    bad = {i: ("a.com/win" in u and rng.random() < 0.9) or rng.random() < 0.05 for i, u in pages}
    labels = spark.createDataFrame([(i, v) for i, v in bad.items() if i % 4], "id long, blocked boolean")
    got = {r.id: r.verdict == "block" for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, []).collect()}
    held = [i for i in got if i % 4 == 0 and got[i]]
    assert held and sum(bad[i] for i in held) >= 0.8 * len(held)
    assert {i for i, v in got.items() if v} == {i for i, u in pages if "a.com/win" in u}


def test_long_urls_and_clashing_names(spark):
    words = "/".join("w" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(60))
    rng = random.Random(3)
    urls_ = [f"http://x.com/{words}"] * 60 + [f"http://x.com/{'/'.join(rng.sample(words.split('/'), 55))}" for _ in range(60)] + [f"http://y.com/{k}" for k in range(120)] + [None, "", "no scheme"]
    pages = spark.createDataFrame([(i, u, "a", "b", True) for i, u in enumerate(urls_)], "page_id long, url string, tokens string, verdict string, blocked boolean")
    labels = spark.createDataFrame([(i, i < 120) for i in range(240)] + [(None, True), (1, None)], "id long, blocked boolean")
    got = {r.id: r.verdict for r in urls.filter_urls(pages, labels, []).collect()}
    assert got == {i: "block" if i < 120 else "allow" for i in range(len(urls_))}


def test_a_pair_among_many_tokens_keeps_all_its_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        bad = i < 158
        own = ["left", "right"] if bad else [rng.choice(["left", "right", "none"])]
        noise = [f"n{k}" for k in rng.sample(range(40), 9)] + [f"p{i}", f"common{i % 2}"]
        rows.append((own + noise, bad or rng.random() < 0.1))
    rules = urls.mine_rules(spark.createDataFrame(rows, "items array<string>, blocked boolean"), 0.002, 0.8).collect()
    pair = [r for r in rules if sorted(x for g in r.tokens for x in g) == ["left", "right"]]
    assert len(pair) == 1 and (pair[0].rows, pair[0].hits) == (158, 158)


def test_no_pages_and_no_labels(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "id long, blocked boolean")
    assert urls.filter_urls(pages, labels, []).count() == 0
