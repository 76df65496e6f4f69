"""SQL for the text queries, written over rows of words where the library uses arrays in a row."""

from __future__ import annotations

from verdantflow.functions import dictionaries as words
from verdantflow.functions.text import alternation


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def regexp(terms) -> str:
    return alternation(terms, False).replace("'", "''")


def hit_ctes(terms, risk=words.RISK_STEMS, stop=words.STOP_WORDS, reach: int = 10) -> dict[str, str]:
    """Tables up to ``hits``: ``id, n_words, term, hits, clean_hits`` of all documents."""
    longest = regexp(sorted(terms, key=len, reverse=True))
    return {
        "marked": rf"select doc_id as id, regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '(?i)(^|[^\pL\pN_])({longest})', '\1' || chr(1) || '\2' || chr(2), 'g') as m from documents",
        "listed": r"select id, regexp_extract_all(m, '\x01?[A-Za-z][A-Za-z0-9\-\x01\x02]*') as t, regexp_extract_all(m, '\x01([^\x02]*)\x02', 1) as found from marked",
        "tokens": "select id, unnest(t) as x, generate_subscripts(t, 1) as pos from listed",
        "placed": f"""select id, pos, w, k, not list_contains({strings(stop)}, w) as word, sum(case when list_contains({strings(stop)}, w) then 0 else 1 end) over (partition by id order by pos) as seen,
            coalesce(sum(k) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as before
            from (select id, pos, lower(translate(x, chr(1) || chr(2), '')) as w, length(x) - length(replace(x, chr(1), '')) as k from tokens)""",
        "near": f"select id, seen, max(case when regexp_matches(w, '^({regexp(risk)})') then 1 else 0 end) over (partition by id order by seen rows between {reach} preceding and {reach} following) as risky from placed where word",
        "each": "select p.id, lower(l.found[cast(p.place as bigint)]) as term, coalesce(n.risky, 0) as risky from (select id, greatest(seen, 1) as seen, before + unnest(range(1, k + 1)) as place from placed where k > 0) p join listed l using (id) left join near n on n.id = p.id and n.seen = p.seen",
        "sizes": "select d.doc_id as id, coalesce(n, 0) as n_words from documents d left join (select id, count(*) as n from placed where word group by 1) c on c.id = d.doc_id",
        "hits": "select s.id, s.n_words, e.term, coalesce(e.hits, 0) as hits, coalesce(e.clean_hits, 0) as clean_hits from sizes s left join (select id, term, count(*) as hits, count(*) filter (risky = 0) as clean_hits from each group by 1, 2) e using (id)",
    }


def with_ctes(select: str, ctes: dict[str, str]) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n" + select


def claims(terms) -> str:
    """Counts of ``hits`` by document under a list of claim terms."""
    claim = f"coalesce(list_contains({strings(terms)}, term), false)"
    return f"select id, max(n_words) as n_words, cast(sum(hits) as bigint) as n_green, cast(sum(case when {claim} then hits else 0 end) as bigint) as n_claim_all, cast(sum(case when {claim} then clean_hits else 0 end) as bigint) as n_claim from hits group by id"


def contexts(text: str, terms, reach: int = 10) -> str:
    """The words around each hit, as a list of strings."""
    w = rf"list_filter(regexp_split_to_array(lower(trim({text}, ' ')), '\s+'), lambda x: x <> '')"
    return f"(select list_transform(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '{regexp(terms)}')), lambda i: array_to_string(w[greatest(i - {reach}, 1):i + {reach}], ' ')) from (select {w} as w))"


def mean(parts: str, value: str) -> str:
    """Mean of ``value`` (of ``c``) over the strings of a list, in order, 0 without any."""
    return f"coalesce((select sum(v) / len(v0) from (select list_transform(p, lambda c: cast({value} as double)) as v0, unnest(list_transform(p, lambda c: cast({value} as double))) as v from (select {parts} as p)) group by v0), 0)"


def mean_of(c: str, value: str) -> str:
    return f"case when len({c}) > 0 then list_sum(list_transform({c}, lambda c: cast({value} as double))) / len({c}) else 0 end"


def occurrences(terms, sign: str = "+") -> str:
    return " + ".join(f"(length(c) - length(replace(c, '{t}', ''))) / {len(t)}.0::double" for t in terms)


def tone(positive, negative) -> str:
    return f"({occurrences(positive)}) - ({occurrences(negative)})"


def tones(source: str, text: str, terms, positive, negative, **marks) -> str:
    """``id, tone`` and a share for each list of marks, from rows ``id, text`` of a table."""
    shares = "".join(f", {mean_of('c', f'''regexp_matches(c, '{regexp(m)}')::integer''')} as {name}" for name, m in marks.items())
    return f"select id, {mean_of('c', tone(positive, negative))} as tone{shares} from (select id, {contexts(text, terms)} as c from {source})"


TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-]+'), lambda w: not list_contains({strings(words.STOP_WORDS)}, w))"


def cosine(source: str, vocabulary: dict[str, float]) -> str:
    """``id, cosine`` from rows ``id, text``."""
    norm = sum(v * v for v in vocabulary.values()) ** 0.5
    weight = "case t " + " ".join(f"when '{k}' then {v!r}::double" for k, v in vocabulary.items()) + " else 0 end"
    counts = f"select id, t, count(*) as n from (select id, unnest({TOKENS}) as t from {source}) group by 1, 2"
    return f"select a.id, coalesce(dot / size / {norm!r}::double, 0) as cosine from {source} a left join (select id, sum(n * {weight}) as dot, sqrt(sum(n * n)) as size from ({counts}) group by id) b using (id)"


def glossiness(terms, positive, negative, vocabulary: dict[str, float], least: float = 0.01) -> str:
    """Segments are lines of 20 characters, sentences if there are fewer than two."""
    long = lambda x: f"list_filter(list_transform({x}, lambda s: trim(s, ' ')), lambda s: length(s) >= 20)"
    # RE2 has no lookbehind: a mark is put where a sentence ends
    sentences = long(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")
    ctes = {
        "parts": f"select doc_id, case when len(lines) >= 2 then lines else sentences end as s from (select doc_id, {long('string_split(text, chr(10))')} as lines, {sentences} as sentences from documents)",
        "segments": "select {'d': doc_id, 'p': pos} as id, doc_id, pos, text from (select doc_id, unnest(s) as text, generate_subscripts(s, 1) as pos from parts)",
        "close": cosine("segments", vocabulary),
        "joined": f"select doc_id as id, count(*) as n_segments, count(*) filter (cosine > {least}) / count(*)::double as share, coalesce(string_agg(text, ' ' order by pos) filter (cosine > {least}), '') as text from segments join close using (id) group by doc_id",
        "toned": tones("joined", "text", terms, positive, negative),
    }
    return with_ctes("select d.doc_id as accession, coalesce(n_segments, 0) as n_segments, round(coalesce(share, 0), 6) + 0.0::double as share, round(coalesce(tone, 0), 6) + 0.0::double as tone, round(coalesce(share * greatest(tone, 0), 0), 6) + 0.0::double as glossiness from documents d left join joined on joined.id = d.doc_id left join toned on toned.id = d.doc_id", ctes)


def metrics() -> str:
    rate = lambda c: f"round(case when n_words > 0 then 1000 * {c} / n_words::double else 0 end, 6) + 0.0::double"
    ctes = hit_ctes(words.ENV_TERMS) | {
        "counts": claims(words.CLAIM_TERMS),
        "rows_of": "select doc_id as id, text from documents",
        "toned": tones("rows_of", "text", words.ENV_TERMS, words.POSITIVE, words.NEGATIVE, forward=words.FORWARD_TERMS, realised=words.REALISED_TERMS),
    }
    return with_ctes(f"""select id as accession, n_words, n_green, n_claim_all, n_claim, {rate('n_green')} as green_per_1000, {rate('n_claim')} as claim_per_1000,
        case when n_claim_all > 0 then round(1 - n_claim / n_claim_all::double, 6) + 0.0::double end as risk_context_share, round(tone, 6) + 0.0::double as env_sentiment, round(forward, 6) + 0.0::double as forward_looking_share, round(realised, 6) + 0.0::double as realised_share, '1' as version from counts join toned using (id)""", ctes)


def html_text(html: str, dropped=("script", "style", "head")) -> str:
    x = rf"regexp_replace({html}, '(?is)<!--.*?-->', '', 'g')"
    for tag in dropped:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table|section|article)\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t\r\x{{A0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"trim(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"
