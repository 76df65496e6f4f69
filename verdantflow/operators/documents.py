"""Operators on reports, pages and links: counts with context, cosines, page picks, assembled documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.functions import dictionaries as words
from verdantflow.functions import text as tx


def vocabulary_cosine(docs: DataFrame, vocabulary: dict[str, float], id_col: str = "accession", text_col: str = "text") -> DataFrame:
    """``id, cosine`` of each document's token counts with a weighted vocabulary; 0 if either is empty.

    Terms of several words match no token but count in the vocabulary's norm.
    """
    norm = sum(v * v for v in vocabulary.values()) ** 0.5
    vocab = docs.sparkSession.createDataFrame(list(vocabulary.items()) or [("", 0.0)], "token string, weight double")
    counts = docs.select(F.col(id_col).alias("id"), F.explode(tx.tokens(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    dot = counts.join(F.broadcast(vocab), "token", "left").groupBy("id").agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    cosine = F.when(F.lit(norm > 0) & (F.col("size") > 0), F.col("dot") / (F.col("size") * F.lit(norm or 1.0)))
    return docs.select(F.col(id_col).alias("id")).join(dot, "id", "left").select("id", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))


def glossiness(docs: DataFrame, vocabulary: dict[str, float], separator: str = r"\n\s*\n", least_cosine: float = 0.01, **sentiment) -> DataFrame:
    """``accession, n_segments, share, tone, glossiness``: share of segments near the vocabulary times their tone, 0 at least.

    A document is worked out within its row: no segment and no token is shuffled.
    """
    near = lambda parts: F.filter(parts, lambda s: tx.cosine(s, vocabulary) > least_cosine)
    found = tx.bound(tx.segments(F.col("text"), separator), lambda parts: F.struct(F.size(parts).alias("n"), near(parts).alias("near")))
    out = docs.select("accession", found.alias("_f"))
    n = F.when(F.col("_f.n") > 0, F.col("_f.n")).otherwise(0).cast("long")
    share = F.coalesce(F.try_divide(F.size("_f.near"), n), F.lit(0.0))
    tone = F.coalesce(tx.windowed_sentiment(F.array_join("_f.near", " "), **sentiment), F.lit(0.0))
    out = out.select("accession", n.alias("n_segments"), share.alias("share"), tone.alias("tone"))
    return out.withColumn("glossiness", F.col("share") * F.greatest(F.col("tone"), F.lit(0.0)))


def term_hits(docs: DataFrame, terms=words.ENV_TERMS, risk=words.RISK_STEMS, stop=words.STOP_WORDS, reach: int = 10, id_col: str = "accession", text_col: str = "text") -> DataFrame:
    """``id, n_words, term, hits, clean_hits``: hits at the start of words, longest term first, none overlapping.

    A hit is clean if no word that begins with a risk stem lies within ``reach`` words of it, stop words not
    counted. A document without a hit, or without text, has one row with a null term. Nothing is shuffled.

    Hits are marked in the text in one pass of a trie of terms, so that its words can be listed with the marks in
    them. A string with a letter for each word (``R`` for a risk stem, ``W`` for others, none for stop words) and
    each mark after its word then tells which hits have a risk word near: passes over strings, no work for each word.
    """
    opened, closed = "\x01", "\x02"
    inner, spaced = f"{closed}?", lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    bare = F.replace(F.replace(F.coalesce(text_col, F.lit("")), F.lit(opened), F.lit(" ")), F.lit(closed), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_replace(bare, rf"(?i)(?<![\p{{L}}\p{{N}}_]){tx.term_trie(terms)}", f"{opened}$0{closed}").alias("marked"))
    kinds = spaced(F.array_join(F.regexp_extract_all("marked", F.lit(rf"{opened}?[A-Za-z][A-Za-z0-9\-{opened}{closed}]*"), 0), " "))
    # words that are plain, most of them, shrink to 0 first; a word begins with a letter, so no word is taken for it
    told = "|".join([f"{tx.term_trie(stop)}(?= )"] * bool(stop) + [tx.term_trie(risk)] * bool(risk))
    kinds = F.lower(F.regexp_replace(kinds, rf"(?i)(?<= )(?!{told or '(?!)'})[a-z][a-z0-9-]*+(?= )", "0"))
    kinds = F.regexp_replace(kinds, rf"(?<= )({opened}?){tx.term_trie(stop, inner)}(?= )", "$1") if stop else kinds
    kinds = F.regexp_replace(kinds, rf"(?<= )({opened}?)(?:{tx.term_trie(risk, inner)})", "$1R") if risk else kinds
    kinds = F.regexp_replace(F.replace(kinds, F.lit(" 0"), F.lit(" W")), rf"(?<= )({opened}?)(?=[a-z])", "$1W")
    kinds = F.translate(kinds, "abcdefghijklmnopqrstuvwxyz0123456789-" + closed, "")
    kinds = F.translate(F.regexp_replace(kinds, rf"({opened})([WR])", "$2$1"), " ", "")
    kinds = F.regexp_replace(kinds, rf"^({opened}+)([WR])", "$2$1")  # no word before: the first one
    names = F.transform(F.regexp_extract_all("marked", F.lit(f"{opened}([^{closed}]*){closed}"), 1), lambda t: F.lower(t))
    rows = rows.select("id", names.alias("names"), kinds.alias("kinds"))
    # a word with hits is h, or H if it or one near it is a risk word
    marked = F.regexp_replace(F.regexp_replace("kinds", rf"W(?={opened})", "h"), rf"R(?={opened})", "H")
    rows = rows.select("id", "names", F.length(F.translate("kinds", opened, "")).cast("long").alias("n_words"), marked.alias("marked"))
    near = F.regexp_replace(F.translate("marked", opened, ""), rf"(?<=[RH][WRhH]{{0,{reach - 1}}})h|h(?=[WRhH]{{0,{reach - 1}}}[RH])", "H")
    rows = rows.select("id", "names", "n_words", F.regexp_extract_all("marked", F.lit(f"[hH]{opened}+"), 0).alias("words"), F.translate(near, "WR", "").alias("near"))
    each = F.arrays_zip(F.col("words").alias("w"), F.split("near", "").alias("n"))
    flags = F.flatten(F.transform(F.slice(each, F.lit(1), F.size("words")), lambda x: F.array_repeat(x["n"] == "h", F.length(x["w"]) - 1)))
    rows = rows.select("id", "n_words", F.arrays_zip(F.col("names").alias("term"), flags.alias("clean")).alias("found"))
    own = lambda t: F.filter("found", lambda h: h["term"] == t)
    some = F.transform(F.array_distinct(F.transform("found", lambda h: h["term"])), lambda t: F.struct(t.alias("term"), F.size(own(t)).cast("long").alias("hits"), F.size(F.filter(own(t), lambda h: F.coalesce(h["clean"], F.lit(True)))).cast("long").alias("clean_hits")))
    rows = rows.select("id", "n_words", F.explode_outer(some).alias("t"))
    return rows.select("id", "n_words", "t.term", *(F.coalesce(f"t.{c}", F.lit(0)).alias(c) for c in ("hits", "clean_hits")))


def dictionary_counts(hits: DataFrame, claims=words.CLAIM_TERMS) -> DataFrame:
    """``id, n_words, n_green, n_claim_all, n_claim`` from stored hits, under any list of claim terms."""
    claim = F.coalesce(F.col("term").isin(*claims), F.lit(False))
    return hits.groupBy("id").agg(F.max("n_words").alias("n_words"), F.sum("hits").alias("n_green"), F.sum(F.when(claim, F.col("hits")).otherwise(0)).alias("n_claim_all"), F.sum(F.when(claim, F.col("clean_hits")).otherwise(0)).alias("n_claim"))


def document_metrics(docs: DataFrame, version: str = "1") -> DataFrame:
    """Stored metrics of each document: counts, rates, term list by hits, tone measures and a version."""
    hits = term_hits(docs)
    counts = dictionary_counts(hits)
    listed = hits.filter("term is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "term", "hits", "clean_hits"))), lambda s: F.struct(s["term"].alias("term"), s["hits"].alias("hits"), s["clean_hits"].alias("clean_hits"))).alias("terms"))
    rate = lambda c: F.when(F.col("n_words") > 0, 1000 * F.col(c) / F.col("n_words")).otherwise(0.0)
    near = docs.select(F.col("accession").alias("id"), tx.context_measures(F.col("text"), forward=words.FORWARD_TERMS, realised=words.REALISED_TERMS).alias("m"))
    tone = near.select("id", F.col("m.tone").alias("env_sentiment"), F.col("m.forward").alias("forward_looking_share"), F.col("m.realised").alias("realised_share"))
    out = counts.join(listed, "id", "left").join(tone, "id")
    risk = F.when(F.col("n_claim_all") > 0, 1 - F.col("n_claim") / F.col("n_claim_all"))
    return out.select(F.col("id").alias("accession"), F.struct("n_words", "n_green", "n_claim_all", "n_claim").alias("counts"), F.struct(rate("n_green").alias("green_per_1000"), rate("n_claim").alias("claim_per_1000"), risk.alias("risk_context_share")).alias("intensity"), F.struct("env_sentiment", "forward_looking_share", "realised_share").alias("tone"), "terms", F.lit(version).alias("version"))


def flat_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("accession", "counts.*", "intensity.*", "tone.*", "version")


def pages(docs: DataFrame, separator: str = "\f", id_col: str = "accession", text_col: str = "text") -> DataFrame:
    """``id, page, text``: a row for each page of a report, from 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, re.escape(separator))).alias("_p", "text"))
    return rows.select("id", (F.col("_p") + 1).alias("page"), "text")


def kpi_pages(pages: DataFrame, k: int = 6, most: int | None = None, patterns=words.KPI_PATTERNS) -> DataFrame:
    """The ``k`` pages of each report and category with the highest score above 0; of equal ones the later page. Texts are whole or cut to ``most``."""
    scores = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), tx.kpi_score(F.col("text"), c, patterns).alias("score")) for c in patterns)))
    rows = pages.withColumn("s", scores).select("id", "page", "s.category", "s.score", "text").filter("score > 0")
    place = F.row_number().over(Window.partitionBy("id", "category").orderBy(F.desc("score"), F.desc("page")))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("id", "category", "page", "score", "text" if most is None else F.left("text", F.lit(most)).alias("text"))


def joined_pages(pages: DataFrame, between: str = "\n\n") -> DataFrame:
    """Whole text of each report, pages in order."""
    return pages.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), between).alias("text"))


def pick_reports(reports: DataFrame) -> DataFrame:
    """One report of each firm and year: ESG before annual before others, then the latest filing, then the url."""
    kind = F.when(F.col("doc_type") == "esg_report", 0).when(F.col("doc_type") == "annual_report", 1).otherwise(2)
    w = Window.partitionBy("firm_id", "fiscal_year").orderBy(kind, F.desc_nulls_last("filing_date"), "url")
    return reports.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def consolidate_emissions(rows: DataFrame) -> DataFrame:
    """One extracted row for each firm and year: latest document, ESG before annual, then confidence."""
    kind = F.when(F.col("doc_type") == "esg_report", 0).when(F.col("doc_type") == "annual_report", 1).otherwise(2)
    w = Window.partitionBy("firm_id", "year").orderBy(F.desc_nulls_last("document_year"), kind, F.desc_nulls_last("confidence"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def flatten_extraction(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """A row for each year of a nested extraction with a scope 1 or 2 value; pages sorted and joined, first quote."""
    schema = "found boolean, series array<struct<fiscal_year:int,scope1_tco2e:double,scope2_tco2e:double,scope2_basis:string>>, evidence array<struct<page:int,quote:string>>, confidence double, third_party_assured boolean"
    x = rows.withColumn("_x", F.from_json(json_col, schema)).withColumn("_s", F.explode("_x.series"))
    x = x.filter("_s.scope1_tco2e is not null or _s.scope2_tco2e is not null")
    listed = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("_x.evidence", lambda e: e["page"]))), lambda p: p.cast("string")), ",")
    return x.select(*(c for c in rows.columns if c != json_col), F.col("_s.fiscal_year").alias("year"), F.col("_s.scope1_tco2e").alias("scope1"), F.col("_s.scope2_tco2e").alias("scope2"), "_s.scope2_basis", listed.alias("pages"), F.try_element_at("_x.evidence", F.lit(1))["quote"].alias("quote"), "_x.confidence", F.col("_x.third_party_assured").alias("assured"))


def _without_dots(url: Column) -> Column:
    """A URL whose path has no ``.`` and ``..`` steps; steps above the root are dropped."""
    root, path, rest = (F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    walked = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"/\.\.?$") & (F.size(walked) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(root, F.lit("/"), F.array_join(walked, "/"), closed, rest)).otherwise(url)


def site_links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``page_id, pos, url, text``: links of a page to its own site (the first ``most``, or all), in order, each address once, no fragments."""
    anchor = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)(?:</a\s*>|(?=<a\s)|\z)"""
    seen = pages.select("page_id", F.col("url").alias("base"), tx.without_raw(F.col("html")).alias("html"))
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), 1).alias("href"), F.regexp_extract_all("html", F.lit(anchor), 2).alias("text"))
    rows = seen.select("page_id", "base", F.posexplode(pairs).alias("pos", "a"))
    rows = rows.select("page_id", "base", "pos", F.trim(tx.unescaped(F.regexp_replace("a.href", r"""^["']|["']$""", ""))).alias("href"), F.col("a.text").alias("text"))
    rows = rows.filter(~F.lower("href").rlike("^(" + "|".join(map(re.escape, words.SKIPPED_LINKS)) + ")") & (F.col("href") != ""))
    root, scheme = F.regexp_extract("base", r"^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_extract("base", r"^([a-zA-Z]+):", 1)
    folder = F.when(F.col("base").rlike(r"^[a-zA-Z]+://[^/?#]+/"), F.regexp_extract("base", r"^([^?#]*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    h = F.regexp_replace("href", "#.*$", "")
    own = F.regexp_extract("base", "^([^?#]*)", 1)
    full = F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(own, h)).otherwise(F.concat(folder, h))
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^www\.", "")
    rows = rows.withColumn("link", _without_dots(full)).filter(host(F.col("link")) == host(F.col("base")))
    first = rows.groupBy("page_id", "link").agg(F.min_by(F.struct("pos", "text"), "pos").alias("f"))
    label = F.left(F.trim(F.regexp_replace(tx.unescaped(tx.without_tags(F.col("f.text"), " ")), r"\s+", " ")), F.lit(80))
    out = first.select("page_id", "f.pos", F.col("link").alias("url"), label.alias("text"))
    if most is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")


def about_page(links: DataFrame, hints=words.ABOUT_HINTS) -> DataFrame:
    """The link of each page whose text or path has the earliest hint; pages without one have no row."""
    path = F.translate(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "-_", "  ")
    where = F.lower(F.concat_ws(" ", "text", path))
    rank = F.lit(None).cast("int")
    for i, h in reversed(list(enumerate(hints))):
        rank = F.when(F.contains(where, F.lit(h)), i).otherwise(rank)
    return links.withColumn("rank", rank).filter("rank is not null").groupBy("page_id").agg(F.min_by(F.struct("url", "text", "rank"), F.struct("rank", "pos")).alias("l")).select("page_id", "l.*")


def cached_scores(docs: DataFrame, cache: DataFrame, variant: Column, least: int = 300) -> DataFrame:
    """Documents with their cached answer: status ``hit``, else ``too_short``, else ``cache_miss``."""
    keyed = docs.withColumn("key", F.substring(F.sha1(F.concat_ws("|", variant, "text")), 1, 20))
    found = keyed.join(cache.select("key", "answer").dropDuplicates(["key"]), "key", "left")
    return found.withColumn("status", F.when(F.col("answer").isNotNull(), "hit").when(F.length("text") < least, "too_short").otherwise("cache_miss"))


def dimensions(df: DataFrame) -> Column:
    """The ``talk_`` and ``walk_`` columns of a table (but for totals and trends) as a map of name to value; nulls are left out."""
    names = [c for c in df.columns if c.startswith(("talk_", "walk_")) and c not in words.NOT_DIMENSIONS]
    pairs = [F.lit(x) if k == 0 else F.col(x).cast("double") for c in names for k, x in enumerate((c, c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,double>")


def evidence_by_year(years: DataFrame, docs: DataFrame) -> DataFrame:
    """Firm-years with their ``dimensions``, and the documents of the same year with theirs nested under them."""
    d = docs.withColumn("dimensions", F.array_sort(F.map_entries(dimensions(docs))))
    d = d.groupBy("firm_id", F.year("period").alias("year")).agg(F.array_sort(F.collect_list(F.struct("accession", "section", "title", "dimensions"))).alias("documents"))
    out = years.withColumn("dimensions", dimensions(years)).join(d, ["firm_id", "year"], "left")
    return out.withColumn("documents", F.coalesce("documents", F.array().cast(out.schema["documents"].dataType)))


def extraction_backlog(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """How many documents aren't in the cache, and about how many tokens (a quarter of their characters)."""
    left = docs.filter("text is not null and text <> ''").join(cache.select("accession"), "accession", "left_anti")
    return left.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.floor(F.length("text") / 4)), F.lit(0)).alias("tokens"))


def catalogue(*kinds: DataFrame) -> DataFrame:
    """Sources of several kinds as one table, the first row of each (firm, url) in the order given."""
    out = None
    for place, df in enumerate(kinds):
        df = df.withColumn("_p", F.lit(place))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_of(out, ["firm_id", "url"], ["_p", "title"]).drop("_p")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def candidate_pages(pages: DataFrame, category: str = "ghg", k: int = 6, patterns=words.KPI_PATTERNS) -> DataFrame:
    """The best pages of one category, in page order."""
    return kpi_pages(pages, k, None, {category: patterns[category]}).orderBy("id", "page")


def pages_of(kpi: DataFrame, category: str, report: str | None = None) -> DataFrame:
    """Picked pages of a category as one text for each report (or one of them), in page order."""
    own = kpi.filter(F.col("category") == category)
    own = own if report is None else own.filter(F.col("id") == report)
    return joined_pages(own.select("id", "page", "text"))


def score_ready(pages: DataFrame, picked: DataFrame, firms: list[str] | None = None) -> DataFrame:
    """Picked reports (``firm_id, url, doc_type, filing_date, fiscal_year, title``) with their whole text, as documents to score."""
    picked = picked if firms is None else picked.filter(F.col("firm_id").isin(*firms))
    df = picked.drop("text").join(joined_pages(pages).withColumnRenamed("id", "url"), "url")
    period = F.make_date("fiscal_year", F.lit(12), F.lit(31))
    return df.select("firm_id", F.col("doc_type").alias("form"), "filing_date", period.alias("period"), F.col("url").alias("accession"), F.lit("full_report").alias("section"), "text", "title", "fiscal_year")


def filtered_documents(docs: DataFrame, firm_id: str | None = None, sections: tuple[str, ...] = (), least_relevance: float | None = None, order: str = "filing_date") -> DataFrame:
    """Documents of a firm, of some sections, of a relevance, in order."""
    if firm_id is not None:
        docs = docs.filter(F.col("firm_id") == firm_id)
    if sections:
        docs = docs.filter(F.col("section").isin(*sections))
    if least_relevance is not None:
        docs = docs.filter(F.col("relevance") >= least_relevance)
    return docs.orderBy(order)


def mean_climate_share(docs: DataFrame, n: int | None = None, order: str = "accession", **passages) -> DataFrame:
    """Mean share of climate paragraphs over all documents, or over the first ``n`` in an explicit order."""
    first = docs if n is None else docs.orderBy(order).limit(n)
    return first.agg(F.avg(tx.climate_passages(F.col("text"), **passages)[1]).alias("share"))


def review_flags(scored: DataFrame, hard: DataFrame, limit: float = 2.0) -> DataFrame:
    """Firm-years with a memo: a mean gap beyond the limit, and emissions that rose, from scored documents and hard data."""
    mean = scored.filter("not skipped").groupBy("firm_id", "year").agg(F.avg("gap").alias("gap"), F.count("*").alias("n_docs"))
    df = mean.join(hard.select("firm_id", "year", "scope12_change_pct"), ["firm_id", "year"], "left")
    flags = F.array_compact(F.array(F.when(F.col("gap") > limit, F.lit("talk exceeds walk")), F.when(F.col("scope12_change_pct") > 0, F.lit("emissions rose"))))
    return df.withColumns({"flags": flags, "memo": F.concat_ws("; ", flags)})


def hard_data_status(hard: DataFrame) -> DataFrame:
    """Firm-years, and how many have emissions."""
    return hard.agg(F.count("*").alias("firm_years"), F.count_if(F.col("n_years") > 0).alias("with_scope12"))


def largest(df: DataFrame, column: str, n: int = 10, absolute: bool = False) -> DataFrame:
    """The rows with the n largest values; a partial sort in each task, then of their results."""
    x = F.abs(column) if absolute else F.col(column)
    return df.orderBy(x.desc_nulls_last(), *(c for c in df.columns if c != column)).limit(n)
