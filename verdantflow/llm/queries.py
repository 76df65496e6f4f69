"""Queries of the corpus operators over the given tables, with production parameters.

Each query is thin: it reads a whole table, applies its operator and names the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantflow.llm import jaccard, language, lengths, lm, manifest, media, mixing, packing, prefixes, secrets, tokenfiles, topk, urls
from verdantflow.llm.shared import new_path, written

#: Weights of the sources in order, repeating.
MIX_WEIGHTS = (3, 1, 2)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BROADCAST_LABELS = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=5, percent=80, count_links=True)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("representative").alias("representative_id"), "n_links")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", kind="byte", end_id=2, capacity=1024)


def quality_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, target boolean``: labelled documents; the target corpus is those of good quality."""
    marks = _table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null")
    return marks.groupBy("doc_id").agg((F.min("quality") == 1).alias("target"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = _table(spark, sf_dir, "documents"), quality_marks(spark, sf_dir).filter("target")
    few = marks.count() <= BROADCAST_LABELS
    marked = docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id", "left")
    marked = marked if few else written(marked, "marked")  # places of rows must not change
    return lm.cross_entropy_difference(marked, F.col("target")).withColumnRenamed("id", "doc_id")


def op4_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(media.text_media(_table(spark, sf_dir, "documents")), "media", "zstd")
    return media.media_digests(files).withColumnRenamed("id", "doc_id")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", kind="word", end_id=2)
    return tokenfiles.token_digests(spark, path)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    found = topk.exact_top_k(vectors.filter("id % 50 = 0"), vectors, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), lambda i: MIX_WEIGHTS[i % 3])
    return mixed.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken")


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = lengths.length_histogram(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", kind="byte")
    return lengths.context_limits(histogram)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    blocked = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    judged = urls.filter_urls(_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("id"), blocked.alias("blocked")), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = language.train(docs.filter(fold != 0))  # a null doc_id has no fold: not taught from, not held out
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return language.identify(rows, model).drop("text")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return manifest.prove(manifest.build_manifest(docs, claims={"n_chars": more})).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_best_fit_packing, op3_lm_scoring, op4_avi_motion_jpeg, op5_token_output,
        op6_exact_top_k, op7_source_mixing, op8_length_histogram, op9_url_filters, op10_language_id,
        op11_secret_scans, op12_conversation_prefix_trie, op13_merkle_manifest,
    )
}



def _crc32(x: str) -> str:
    """SQL of the unsigned crc32 of a decimal number."""
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    byte = f"case when i % 8 = 0 then cast(ascii(substr(cast({x} as varchar), cast(i // 8 + 1 as bigint), 1)) as bigint) else 0::bigint end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * strlen(cast({x} as varchar))), lambda i: {byte})), lambda c, b: {step}), 4294967295)"


def _leaf(*values: str) -> str:
    """SQL of a leaf's digest."""
    return "sha256(" + " || ".join(f"case when {v} is null then '-' else strlen(cast({v} as varchar)) || ':' || cast({v} as varchar) end" for v in values) + ")"


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), every as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w
        ), sets as (
            select doc_id, len(s) as n, array_to_string(list_sort(s), chr(10)) as own from every
        ), shingles as (
            select doc_id, unnest(s) as sh from every
        ), common as (
            select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2
        ), links as (
            select x, y from common join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)
        ), reached as (
            select x, y from links union select r.x, l.y from reached r join links l on l.x = r.y
        )
        select s.doc_id, s.n as n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) as component_id, case when s.n = 0 then s.doc_id else min(s.doc_id) over (partition by s.n, s.own) end as representative_id, coalesce(l.k, 0) as n_links
        from sets s left join (select x, min(y) as low from reached group by x) r on r.x = s.doc_id left join (select x, count(*) as k from links group by x) l on l.x = s.doc_id
    """,
    "op6_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
            where q.vec_id % 50 = 0
        ), r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    # Mining isn't SQL: of the labels of the given tables no combination of tokens is a sound rule (README), so what no listed rule decides is allowed.
    "op9_url_filters": r"""
        with t as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), p as (
            select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from t
        ), f as (
            select *, case
                when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
                when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/' end as rule from p
        )
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from f
    """,
    "op12_conversation_prefix_trie": rf"""
        with recursive t as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(own)) - 1 as place, own, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
            from (select conv_id, turn, coalesce(text, '') as text, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as own from conversations where conv_id is not null)
        ), h as (
            select c, {_crc32("c")} % 4 as h from (select distinct c from t)
        ), turns as (
            select h.c, t.place, 0 as part, t.own, t.words from h join t on t.c = h.c - h.c % 20 and t.place < h.h
            union all select h.c, t.place, 1, t.own, t.words from h join t on t.c = h.c and t.place >= h.h
        ), numbered as (
            select c, row_number() over (partition by c order by part, place) as depth, own, words from turns
        ), rows as (
            select c, 0::bigint as depth, '' as key, null::varchar as up, 0::bigint as words from h
            union all select n.c, n.depth, sha256(r.key || ',' || n.own), r.key, n.words from rows r join numbered n on n.c = r.c and n.depth = r.depth + 1
        ), ends as (
            select key, depth, string_agg(cast(c as varchar), ',' order by c) as ids from (select c, max(depth) as depth from rows group by c) join rows using (c, depth) group by key, depth
        ), nodes as (
            select key, depth, min(up) as up, min(c) as conv_id, count(*) as n_convs, max(words) as words from rows group by key, depth
        ), sized as (
            select n.*, (select count(*) from nodes k where k.up = n.key and k.depth = n.depth + 1) as n_children from nodes n
        ), below as (
            select key as top, depth as top_depth, key, depth, n_children, (n_convs - 1) * words as saved from sized
            union all select b.top, b.top_depth, s.key, s.depth, s.n_children, (s.n_convs - 1) * s.words from below b join sized s on s.up = b.key and s.depth = b.depth + 1
        ), subtree as (
            select top, top_depth, count(*) filter (where n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from below group by 1, 2
        )
        select s.conv_id, s.depth, p.conv_id as parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
        from sized s join subtree b on b.top = s.key and b.top_depth = s.depth left join nodes p on p.key = s.up and p.depth = s.depth - 1 left join ends e on e.key = s.key and e.depth = s.depth
    """,
    "op13_merkle_manifest": f"""
        with recursive l as (
            select doc_id, coalesce('1' || lang, '0') as g, {_leaf("doc_id", "source", "lang", "n_chars", "text")} as leaf,
                   case when {_crc32("doc_id")} % 7 = 0 then {_leaf("doc_id", "source", "lang", "(n_chars + 1)", "text")} else {_leaf("doc_id", "source", "lang", "n_chars", "text")} end as claim
            from documents
        ), r as (
            select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as width from l
        ), n as (
            select g, place, width, 0 as level, leaf as h from r
            union all select a.g, a.place // 2, (a.width + 1) // 2, a.level + 1, sha256(a.h || coalesce(b.h, '')) from n a left join n b on b.g = a.g and b.place = a.place + 1 where a.width > 1 and a.place % 2 = 0
        ), s as (
            select g, h as subroot, level as height, row_number() over (order by g) - 1 as place, count(*) over () as width from n where width = 1
        ), u as (
            select place, width, 0 as level, subroot as h from s
            union all select a.place // 2, (a.width + 1) // 2, a.level + 1, sha256(a.h || coalesce(b.h, '')) from u a left join u b on b.place = a.place + 1 where a.width > 1 and a.place % 2 = 0
        ), p as (
            select doc_id, r.g, leaf, claim, subroot, place, r.width, 0 as level, '' as proof, claim as h from r join (select g, subroot from s) using (g)
            union all select p.doc_id, p.g, p.leaf, p.claim, p.subroot, p.place // 2, (p.width + 1) // 2, p.level + 1, p.proof || coalesce(n.h, ''), sha256(case when p.place % 2 = 1 then n.h || p.h else p.h || coalesce(n.h, '') end)
            from p left join n on n.g = p.g and n.level = p.level and n.place = xor(p.place, 1) where p.width > 1
        ), q as (
            select p.doc_id, p.leaf, p.subroot, s.place, s.width, 0 as level, p.proof, p.h from p join s on s.g = p.g where p.width = 1
            union all select q.doc_id, q.leaf, q.subroot, q.place // 2, (q.width + 1) // 2, q.level + 1, q.proof || coalesce(u.h, ''), sha256(case when q.place % 2 = 1 then u.h || q.h else q.h || coalesce(u.h, '') end)
            from q left join u on u.level = q.level and u.place = xor(q.place, 1) where q.width > 1
        )
        select doc_id, leaf, subroot, (select h from u where width = 1) as root, sha256(proof) as proof_sha256, h as folded_root, h = (select h from u where width = 1) as verified from q where width = 1
    """,
}
