"""Text measures as column expressions: tokens, substring hits, context windows, titles, HTML."""

from __future__ import annotations

import re

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdantflow.functions import dictionaries as words


def alternation(terms, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, also where lambdas in the body use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_trie(terms, between: str = "") -> str:
    """A pattern for the longest of the terms at a place: letters branch as in a trie, so its cost doesn't grow with their number.

    ``between`` is a pattern that may stand after each character.
    """
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        longer = [re.escape(c) + between + pattern(node[c]) for c in sorted(node) if c]
        if not longer:
            return ""
        one = longer[0] if len(longer) == 1 and "" not in node else f"(?:{'|'.join(longer)})"
        return one + ("?" if "" in node else "")

    return pattern(root) if root else "(?!)"


def tokens(text: Column, stop=words.STOP_WORDS) -> Column:
    """Lower-case words of two letters or more (hyphens inside), stop words left out."""
    kept = f"(?!(?:{term_trie(stop)})(?![a-z-]))" if stop else ""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z-])-*+({kept}[a-z][a-z-]+)"), 1)


def hits(text: Column, terms) -> Column:
    """Substring hits, no word boundary; at one place the earlier term of the list wins."""
    return F.regexp_count(text, F.lit(alternation(terms)))


def keyword_share(text: Column, terms) -> Column:
    return F.coalesce(F.try_divide(hits(text, terms), F.size(tokens(text))), F.lit(0.0))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def contexts(text: Column, terms, reach: int = 10) -> Column:
    """The words around each word that contains a term, joined by spaces, lower-cased. A text without a term isn't cut into words."""
    one = term_trie(terms) if terms and all(terms) else alternation(terms, False)

    def around(w: Column) -> Column:
        found = F.filter(F.transform(w, lambda x, i: F.when(x.rlike(one), i)), lambda i: i.isNotNull())
        return F.transform(found, lambda i: F.array_join(F.slice(w, F.greatest(i + 1 - reach, F.lit(1)), F.least(i + 1 + reach, F.size(w)) - F.greatest(i + 1 - reach, F.lit(1)) + 1), " "))

    cut = bound(F.lower(F.trim(text)), lambda t: F.when(t.rlike(one), F.filter(F.split(t, r"\s+"), lambda x: x != "")).otherwise(F.array().cast("array<string>")))
    return bound(cut, around)


def _mean(parts: Column, value) -> Column:
    def mean(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + value(x).cast("double"))
        return F.when(F.size(p) > 0, total / F.size(p)).otherwise(0.0)

    return bound(parts, mean)


def windowed_sentiment(text: Column, terms=words.ENV_TERMS, positive=words.POSITIVE, negative=words.NEGATIVE, reach: int = 10) -> Column:
    """Positive less negative occurrences in the context of a hit, mean over hits; 0 without a hit."""
    return context_measures(text, terms, positive, negative, reach)["tone"]


def context_share(text: Column, marks, terms=words.ENV_TERMS, reach: int = 10) -> Column:
    """Share of hits with any of the marks in their context: forward-looking or realised talk."""
    return context_measures(text, terms, None, None, reach, share=marks)["share"]


def context_measures(text: Column, terms=words.ENV_TERMS, positive=words.POSITIVE, negative=words.NEGATIVE, reach: int = 10, **shares) -> Column:
    """A struct of ``tone`` (unless ``positive`` is None) and the share of hits near each list of marks, from contexts that are cut once."""

    def tone(c: Column) -> Column:
        return sum((occurrences(c, p) for p in positive), F.lit(0.0)) - sum((occurrences(c, n) for n in negative), F.lit(0.0))

    def measures(found: Column) -> Column:
        own = [] if positive is None else [_mean(found, tone).alias("tone")]
        return F.struct(*own, *(_mean(found, lambda c, m=marks: c.rlike(alternation(m, False)).cast("int")).alias(name) for name, marks in shares.items()))

    return bound(contexts(text, terms, reach), measures)


def cosine(text: Column, vocabulary: dict[str, float]) -> Column:
    """Cosine of a text's token counts with a weighted vocabulary, within the row; 0 if either is empty.

    Equal tokens are neighbours once they are sorted, so the sum of squared counts grows by 2 n + 1 with the next of n equal ones.
    """
    norm = sum(v * v for v in vocabulary.values()) ** 0.5
    if not norm:
        return F.lit(0.0)
    weight = F.create_map(*(F.lit(x) for pair in vocabulary.items() for x in (pair[0], float(pair[1]))))

    def of(t: Column) -> Column:
        dot = F.aggregate(F.filter(t, lambda x: x.isin(*vocabulary)), F.lit(0.0), lambda s, x: s + F.try_element_at(weight, x))
        start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
        same = lambda s, x: F.when(s["t"] == x, s["n"]).otherwise(F.lit(0).cast("long"))
        squares = F.aggregate(F.array_sort(t), start, lambda s, x: F.struct(x.alias("t"), (same(s, x) + 1).alias("n"), (s["s"] + 2 * same(s, x) + 1).alias("s")), lambda s: s["s"])
        return F.when(F.size(t) > 0, dot / (F.sqrt(squares) * F.lit(norm))).otherwise(0.0)

    return bound(tokens(text), of)


def segments(text: Column, separator: str = r"\n\s*\n", least: int = 20) -> Column:
    """Paragraphs of ``least`` characters if there are two, else sentences of that length."""

    def long(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= least)

    sentences = long(F.split(text, r"(?<=[.!?])\s+"))
    return bound(long(F.split(text, separator)), lambda paragraphs: F.when(F.size(paragraphs) >= 2, paragraphs).otherwise(sentences))


def climate_passages(text: Column, terms=words.CLIMATE_TERMS, separator: str = r"\n\s*\n", reach: int = 1, least: int = 40, most: int = 60_000) -> tuple[Column, Column]:
    """Paragraphs with a hit and their neighbours, joined and cut to ``most`` characters; share of paragraphs with a hit."""

    def passages(p: Column, hit: Column) -> Column:
        near = F.filter(p, lambda x, i: F.exists(F.slice(hit, F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1) - F.greatest(F.lit(reach) - i, F.lit(0))), lambda h: h))
        n = F.size(F.filter(hit, lambda h: h))
        return F.struct(F.coalesce(F.left(F.array_join(near, "\n\n"), F.lit(most)), F.lit("")).alias("text"), F.when(F.size(p) > 0, n / F.size(p)).otherwise(0.0).alias("share"))

    paragraphs = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    both = bound(paragraphs, lambda p: bound(F.transform(p, lambda x: x.rlike(alternation(terms))), lambda hit: passages(p, hit)))
    return both["text"], both["share"]


def kpi_score(text: Column, category: str, patterns=words.KPI_PATTERNS) -> Column:
    return sum((w * F.regexp_count(text, F.lit(p)) for w, p in patterns[category]), F.lit(0)).cast("long")


def title_kind(title: Column) -> Column:
    esg, annual = title.rlike(words.TITLE_ESG), title.rlike(words.TITLE_ANNUAL)
    quarterly, interim = title.rlike(words.TITLE_QUARTERLY), title.rlike(words.TITLE_INTERIM)
    kind = F.when(quarterly, "quarterly_report").when(interim, "interim_report").when(esg & ~annual, "esg_report")
    return kind.when(annual, "annual_report")


def fiscal_year(title: Column, filed: Column) -> Column:
    """First year of a title (``2023/24`` is 2024), else the year before it was filed."""
    first = F.nullif(F.regexp_extract(title, r"(20\d{2})(?:/(\d{2}))?", 1), F.lit(""))
    second = F.nullif(F.regexp_extract(title, r"(20\d{2})(?:/(\d{2}))?", 2), F.lit(""))
    told = F.when(second.isNotNull(), F.concat(F.substring(first, 1, 2), second)).otherwise(first)
    return F.coalesce(told.cast("int"), F.year(filed) - 1)


#: What follows the name of a tag: text and quoted values, in which a ``>`` closes nothing.
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
#: Elements by which an open one is known to be over, as they hold others.
_HOLDERS = ("html", "body", "main", "div", "section", "article", "aside", "form", "table", "ul", "ol")


def without_raw(html: Column, names: tuple[str, ...] = ("script", "style")) -> Column:
    """Markup without comments and elements of raw text, in one pass, so that neither is looked for in the other; an unclosed one goes on to the end."""
    raw = rf"|<({'|'.join(names)})\b[^>]*+>.*?(?:</\1\s*>|\z)" if names else ""
    return F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z){raw}", "")


def without_elements(html: Column, names: tuple[str, ...]) -> Column:
    """Markup without some elements and all that is in them.

    Markup is cut once before each tag of these and of holders, and a stack of open tags goes over the cuts: an
    element ends with its own end tag, with that of an element it is in, or (a head) where the body begins; else
    it goes on to the end. An end tag without a beginning is ignored.
    """
    if not names:
        return html
    tag = rf"(?i)<(/?)({'|'.join(dict.fromkeys((*names, *_HOLDERS)))})(?=[\s/>]){_ATTRIBUTES}>"
    pieces = F.split(F.regexp_replace(F.translate(html, "\x01\x02", ""), tag, "\x01$1$2\x02$0"), "\x01")
    cut, empty = "array<struct<a:int,b:int>>", F.array().cast("array<string>")

    def step(s: Column, piece: Column) -> Column:
        told = F.lower(F.substring_index(piece, "\x02", 1))
        name, opens, at = F.replace(told, F.lit("/"), F.lit("")), ~F.startswith(told, F.lit("/")), s["at"]
        inside, depth = F.size(s["stack"]) > 0, F.array_position(s["stack"], name).cast("int")
        over = inside & ((opens & (name == "body") & (F.element_at(s["stack"], -1) == "head")) | (~opens & ((depth == 0) | (depth == F.size(s["stack"])))))
        stack = F.when(over, empty).when(inside & opens, F.concat(F.array(name), s["stack"])).when(inside, F.slice(s["stack"], depth + 1, F.size(s["stack"])))
        stack = stack.when(opens & name.isin(*names) & (at > 0), F.array(name)).otherwise(empty)
        begin = F.when(~inside, at).otherwise(s["begin"])
        cuts = F.when(over, F.array_append(s["cuts"], F.struct(s["begin"].alias("a"), at.alias("b")))).otherwise(s["cuts"])
        return F.struct((at + 1).alias("at"), stack.alias("stack"), begin.alias("begin"), cuts.alias("cuts"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("stack"), F.lit(0).alias("begin"), F.array().cast(cut).alias("cuts"))
    last = lambda s: F.when(F.size(s["stack"]) > 0, F.array_append(s["cuts"], F.struct(s["begin"].alias("a"), s["at"].alias("b")))).otherwise(s["cuts"])

    def kept(x: Column) -> Column:
        visible = lambda cuts: F.filter(F.transform(x, lambda p, i: F.when(~F.exists(cuts, lambda c: (i >= c["a"]) & (i < c["b"])), F.substring_index(p, "\x02", -1))), lambda p: p.isNotNull())
        return bound(F.aggregate(x, start, step, last), lambda cuts: F.array_join(visible(cuts), ""))

    return bound(pieces, kept)


def unescaped(text: Column, unclosed: bool = True) -> Column:
    """Text with its character references as characters, in one pass: numbers, and names of the common table; unknown names stay.

    ``unclosed``: also references without their semicolon, as browsers read them; else these stay, too.
    """
    table = F.create_map(*(F.lit(v) for name, code in sorted(name2codepoint.items()) for v in (name, chr(code))), F.lit("apos"), F.lit("'"))
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});" + "?" * unclosed, "\x01$1\x02$0\x02")

    def char(name: Column) -> Column:
        code = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        return F.when(code.isNull(), F.element_at(table, name)).when(wrong, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0).otherwise(code)), 8, "0")), "UTF-32"))

    decoded = lambda p: bound(F.split(p, "\x02", 3), lambda x: F.concat(F.coalesce(char(x[0]), x[1]), x[2]))
    pieces = F.transform(F.split(marked, "\x01"), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def without_tags(html: Column, instead: str = "") -> Column:
    """Text between tags; a tag ends where its quotes are closed, one with open quotes at the next ``>``, an unfinished one at the end."""
    x = F.regexp_replace(html, rf"</?[A-Za-z!?]{_ATTRIBUTES}>", instead)
    return F.regexp_replace(x, r"</?[A-Za-z!?][^>]*+(?:>|\z)", instead)


def html_text(html: Column, dropped: tuple[str, ...] = ("script", "style", "head"), unclosed: bool = True) -> Column:
    """Readable text of a page: blocks on lines of their own, without the dropped elements, character references read (see ``unescaped``)."""
    raw = tuple(t for t in dropped if t in ("script", "style"))
    x = without_elements(without_raw(html, raw), tuple(t for t in dropped if t not in raw))
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table|section|article)\s*>", "\n")
    x = unescaped(without_tags(x), unclosed)
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\r\xA0]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def page_lines(html: Column, most: int | None = None, unclosed: bool = True) -> Column:
    """Text of a page without navigation: its lines that aren't empty, all or cut to ``most`` characters."""
    lines = F.split(html_text(html, ("script", "style", "head", "nav", "footer", "header"), unclosed), "\n")
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return text if most is None else F.left(text, F.lit(most))


def news_query(name: Column, suffixes=words.LEGAL_SUFFIXES, clause: str = "") -> Column:
    """A firm's name in quotes without its legal suffixes, each stripped once in order."""
    for s in suffixes:
        name = F.regexp_replace(F.regexp_replace(name, r"^[ ,]+|[ ,]+$", ""), re.escape(s) + "$", "")
    quoted = F.concat(F.lit('"'), F.regexp_replace(name, r"^[ ,.]+|[ ,.]+$", ""), F.lit('"'))
    return F.concat(quoted, F.lit(" " + clause)) if clause else quoted


def news_labels(title: Column, firm: Column, esg_words) -> tuple[Column, Column, Column]:
    """About the firm (its first word), about its conduct, and relevance of 5 for each."""
    t = F.lower(title)
    about, esg = F.contains(t, F.split(F.lower(F.trim(firm)), r"\s+")[0]), t.rlike(alternation(esg_words, False))
    return about, esg, 5.0 * about.cast("int") + 5.0 * esg.cast("int")


def dry_run_scores(text: Column, future=words.DRY_RUN_FUTURE, past=words.DRY_RUN_PAST) -> dict[str, Column]:
    """Talk, walk and relevance from keyword counts alone."""
    t = F.lower(text)
    f, p = (sum((occurrences(t, k) for k in keys), F.lit(0.0)) for keys in (future, past))
    n = F.greatest(F.lit(1.0), f + p)
    relevance = F.least(F.lit(10.0), occurrences(t, "climate") + occurrences(t, "emission"))
    return {"talk": F.least(F.lit(10.0), 10 * f / n), "walk": F.least(F.lit(10.0), 10 * p / n), "climate_relevance": relevance}


def rubric_rollup(talk: dict[str, Column], walk: dict[str, Column], text_length: Column, commitments: Column | None = None) -> dict[str, Column]:
    """Weighted talk and walk of sub-scores and their gap; ``skipped`` below 300 characters.

    ``commitments``, an array of structs with ``quantified``, adds how many there are and how many have a number.
    """
    t = sum((talk[k] * w for k, w in words.RUBRIC_TALK.items()), F.lit(0.0))
    w = sum((walk[k] * v for k, v in words.RUBRIC_WALK.items()), F.lit(0.0))
    out = {"talk": t, "walk": w, "gap": t - w, "skipped": text_length < 300}
    if commitments is not None:
        given = F.coalesce(commitments, F.filter(commitments, lambda c: F.lit(False)))
        out |= {"n_commitments": F.coalesce(F.size(given), F.lit(0)).cast("long"), "n_quantified": F.coalesce(F.size(F.filter(given, lambda c: F.coalesce(c["quantified"], F.lit(False)))), F.lit(0)).cast("long")}
    return out


def initials(name: Column, ticker: Column | None = None, skipped=words.INITIALS_SKIPPED) -> Column:
    """First letters of a name's first two words, or two of its only one; else two characters of the ticker, else ``GS``. Legal words don't count."""
    code = F.substring(F.regexp_replace(F.coalesce(ticker if ticker is not None else F.lit(""), F.lit("")), "[^A-Za-z0-9]+", ""), 1, 2)
    first = lambda w, k: F.substring(F.element_at(w, k), 1, 1)
    own = lambda w: F.when(F.size(w) >= 2, F.concat(first(w, 1), first(w, 2))).when((F.size(w) == 1) & (F.length(F.try_element_at(w, F.lit(1))) >= 2), F.substring(F.try_element_at(w, F.lit(1)), 1, 2)).otherwise(F.coalesce(F.nullif(code, F.lit("")), F.lit("GS")))
    return F.upper(bound(F.filter(F.split(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+"), lambda x: (x != "") & ~F.upper(x).isin(*skipped)), own))


def trade_label(side: Column, before: Column, after: Column, least: float = 0.0005) -> Column:
    """A reader's word for a trade: ``New`` or ``Buy more``, ``Sell all`` or ``Reduce``, ``Kept``, ``Hold``."""
    kept = F.when(side.startswith("frozen"), "Kept, not modeled").when(side.startswith("hold (outside"), "Kept, outside filter")
    bought = kept.when(side == "buy", F.when(before < least, "New").otherwise("Buy more"))
    return bought.when(side.startswith("sell"), F.when(after < least, "Sell all").otherwise("Reduce")).otherwise("Hold")


def string_list(json: Column) -> Column:
    """A JSON array of strings; an empty list for anything else."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
