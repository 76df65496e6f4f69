"""URL filters: listed host rules, and association rules mined from labelled URLs with FP-growth.

DataFrame functions and Spark's own FP-growth only; no Python runs on the executors. A rule has to hold beyond
chance: it rests on a least number of blocked URLs, and its share of blocked ones can't come from the base rate,
by a bound on the exact tail that allows for all combinations tried.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.components import join_counted
from verdantflow.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"
BROADCAST_RULES = 8 << 20  # bytes of tokens
BROADCAST_URLS = 200_000
LEAST = 20
RISK = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: on to ``? #``. Null or no ``://``: both empty."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (as host + path) and its verdict, both null if none fits.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are put around shorter ones
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, whole host, words of the path, names of query parameters; digits are ``0``."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.translate(path, UPPER, LOWER), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1)
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.translate(x, UPPER, LOWER)))
    whole = F.when(host != "", F.array(F.concat(F.lit("w:"), host))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, whole, words, names))


def _tail(hits: Column, rows: Column, base: float) -> Column:
    """Log of a bound on the chance that ``hits`` or more of ``rows`` draws are blocked at a share of ``base``.

    ``-rows * KL(hits / rows, base)`` bounds the binomial and the hypergeometric tail; 0 at or below the base.
    """
    share = hits / rows
    missed = F.when(share >= 1, F.lit(0.0)).otherwise((1 - share) * F.log((1 - share) / (1 - base)))
    return F.when(share <= base, F.lit(0.0)).otherwise(-rows * (share * F.log(share / base) + missed))


def mine_rules(transactions: DataFrame, support: float, confidence: float, least: int = LEAST, risk: float = RISK) -> DataFrame:
    """Rules tokens -> block from ``items array, blocked boolean``: ``key, tokens, confidence, support, rows, hits``.

    ``tokens`` is an array of groups; a URL matches if it has a token of each group. Tokens that are in just the
    same transactions form one group and are mined as one, so a frequent long URL has few combinations. ``key``
    holds the tokens of the rarest group. A rule has at least ``least`` blocked transactions and a share
    ``support`` of all, a ``confidence``, and a chance of at most ``risk`` that any of the combinations tried
    would seem so without a relation (half of it for single groups, half for longer ones). A token in more than
    90 % of the transactions says nothing and is left out.

    Rules have any number of groups, and all groups of a transaction take part. FP-growth builds combinations of
    blocked transactions alone, as a rule rests on them, and not of groups that are a rule without exception by
    themselves, as no longer rule can say more; in how many of all transactions a combination is, the index by its
    rarest group counts. Time grows with the number of combinations that ``least`` blocked transactions share.
    Rules that contain a shorter rule of no less confidence are pruned. Without transactions, or with all or none
    of them blocked, there are no rules.
    """
    spark = transactions.sparkSession
    none = "key array<string>, tokens array<array<string>>, confidence double, support double, rows long, hits long"
    rows = written(transactions.select("items", "blocked"), "transactions").withColumn("row", F.monotonically_increasing_id())
    total, blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not 0 < blocked < total:
        return spark.createDataFrame([], none)
    base, least = blocked / total, max(least, math.ceil(support * total - 1e-9), 1)
    flat = rows.select("row", "blocked", F.explode(F.array_distinct("items")).alias("item"))
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"where{k}") for k in (0, 1)]
    item = flat.groupBy("item").agg(F.count("*").alias("rows"), F.count_if("blocked").alias("hits"), *where)
    item = item.filter((F.col("rows") <= 0.9 * total) & (F.col("hits") >= least))
    groups = item.groupBy("rows", "hits", "where0", "where1").agg(F.array_sort(F.collect_list("item")).alias("group"))
    groups = written(groups.select(F.element_at("group", 1).alias("item"), "group", "rows", "hits"), "groups")

    def sound(tried: int):
        share = F.col("hits") / F.col("rows")
        return (share >= confidence) & (_tail(F.col("hits"), F.col("rows"), base) <= math.log(risk / 2) - math.log(max(tried, 1)))

    alone = sound(groups.count())
    useful = join_counted(flat, groups.select("item", "rows", (alone & (F.col("hits") == F.col("rows"))).alias("certain")), ["item"], "rows")
    baskets = written(useful.filter("not certain").groupBy("row", "blocked").agg(F.sort_array(F.collect_list("item")).alias("items")), "baskets")
    single_rules = groups.filter(alone).select(F.array("item").alias("tokens"), "hits", "rows")
    ours = baskets.filter("blocked").select("items")
    known = ours.count()
    if known:
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / known).fit(ours).freqItemsets.filter(F.size("items") > 1)
        sets = written(found.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits")), "itemsets")
        tried = sets.count()
        able = sets.filter(F.col("hits") * math.log(base) <= math.log(risk / 2) - math.log(max(tried, 1)))  # none of its rows may be allowed yet
        rarest = able.select("tokens", "hits", F.explode("tokens").alias("item")).join(groups.select("item", F.col("rows").alias("often")), "item")
        rarest = rarest.groupBy("tokens", "hits").agg(F.min_by("item", F.struct("often", "item")).alias("key"))
        met = baskets.select("items", F.explode("items").alias("key")).join(rarest, "key").filter(F.size(F.array_except("tokens", "items")) == 0)
        counted = met.groupBy("tokens", "hits").agg(F.count("*").alias("rows"))
        single_rules = single_rules.unionByName(counted.filter(sound(tried)))
    sized = written(single_rules.withColumn("confidence", F.col("hits") / F.col("rows")), "rules")
    single = F.transform("tokens", lambda x: F.array(x))
    fewer = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.filter("tokens", lambda x, j: j != i))
    inner = sized.select("tokens", "confidence", F.explode(F.array_distinct(F.concat(single, fewer))).alias("inner")).filter("inner != tokens")
    shorter = sized.select(F.col("tokens").alias("inner"), F.col("confidence").alias("known"))
    weaker = inner.join(shorter, "inner").filter("known >= confidence").select("tokens").distinct()
    left = sized.join(weaker, "tokens", "left_anti")
    # the rarest token of a rule is its key in the index
    key = left.select("tokens", F.explode("tokens").alias("item")).join(groups.select("item", F.col("rows").alias("often")), "item").groupBy("tokens").agg(F.min_by("item", F.struct("often", "item")).alias("key"))
    left = written(left.join(key, "tokens"), "unpruned")
    # what a pruned rule would prune, the shorter rule that pruned it does too
    short = left.select("key", F.col("tokens").alias("inner"), F.col("confidence").alias("known"))
    pairs = left.select("tokens", "confidence", F.explode("tokens").alias("key")).join(short, "key").filter("size(inner) < size(tokens) and known >= confidence")
    holds = pairs.filter(F.size(F.array_except("inner", "tokens")) == 0).select("tokens").distinct()
    kept = left.join(holds, "tokens", "left_anti")
    # names of groups to their tokens
    named = kept.select("key", "confidence", "rows", "hits", F.col("tokens").alias("names"), F.explode("tokens").alias("item")).join(groups.select("item", "group"), "item")
    named = named.groupBy("names", "key", "confidence", "rows", "hits").agg(F.array_sort(F.collect_list("group")).alias("tokens"), F.max(F.when(F.col("item") == F.col("key"), F.col("group"))).alias("own"))
    return named.select(F.col("own").alias("key"), "tokens", "confidence", (F.col("hits") / total).alias("support"), "rows", "hits")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of ``url, tokens`` whose tokens hold all tokens of a rule: ``url``, distinct. The index has a row for each token of a rule's key; it is broadcast if its bytes are few."""
    index = written(rules.select(F.explode("key").alias("key"), F.col("tokens").alias("rule")), "index")
    size = index.agg(F.sum(F.octet_length(F.to_json("rule")) + F.octet_length("key"))).first()[0] or 0
    met = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(F.broadcast(index) if size <= BROADCAST_RULES else index, "key")
    return met.filter(F.forall("rule", lambda group: F.arrays_overlap(group, F.col("tokens")))).select("url").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], support: float = 0.002, confidence: float = 0.8, least: int = LEAST, risk: float = RISK, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: ``id, url, host, path, rule, verdict``.

    ``labels`` has ``id, blocked boolean`` for some pages. A listed rule decides first; where none fits,
    a page is blocked if a mined rule matches its URL, else allowed. A null URL, or one without ``://``, has
    empty host and path, no tokens, and is allowed. Very long URLs are read whole. Rows that repeat a URL get one
    verdict; labels that repeat an id count as one, blocked if any is. Without labels, or where none of their
    combinations is sound (see ``mine_rules``), no rule is mined.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = rows.withColumns({"host": host, "path": path})
    tokens = F.when(F.col("host") != "", url_tokens(F.col("host"), F.col("path"), F.col("url"))).otherwise(F.array().cast("array<string>"))
    marked = labels.filter("id is not null and blocked is not null").groupBy("id").agg(F.max("blocked").alias("blocked"))
    train = parsed.join(marked, "id").select(tokens.alias("items"), "blocked").filter("size(items) > 0")
    mined = written(mine_rules(train, support, confidence, least, risk), "mined")
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    listed = parsed.withColumns({"rule": name, "verdict": verdict})
    if mined.isEmpty():
        return listed.select("id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    # only URLs on which no listed rule decides meet the mined ones, each once
    distinct = listed.filter("host != '' and verdict is null").select("url").distinct()
    h, p = host_and_path(F.col("url"))
    distinct = distinct.withColumns({"host": h, "path": p}).select("url", tokens.alias("tokens"))
    hits = written(matched_urls(distinct, mined), "hits").withColumn("hit", F.lit(True))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_URLS else hits
    open_rows, other = (F.col("host") != "") & F.col("verdict").isNull(), F.lit(None).cast("boolean")
    met = listed.filter(open_rows).join(hits, "url", "left").unionByName(listed.filter(~open_rows).withColumn("hit", other))
    return met.select("id", "url", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
