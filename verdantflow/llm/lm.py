"""Cross-entropy difference of matched n-gram models.

A target model and a background model are bigram models of one smoothing over one vocabulary, all words of the
training. A document's score is the mean over its words of the target's loss less the background's loss: the
lower, the more it is like the target. With c the counts of a model, q(w) its add-one word frequency and m the
weight of the prior,

    loss(v, w) = log2(c(v .) + m) - log2(c(v w) + m q(w)),

so the loss of a text is a sum of terms that each need the counts of one word ``w`` and of bigrams that end in
``w``. Training and scoring are one pass: every place of a text goes, as a few bytes, to the bucket of its word;
there all counts of the word and its bigrams are known, and the sums for each text go back.

Bigrams and words that are frequent anywhere have their counts broadcast (tables of a fixed size): places with
a frequent bigram don't travel, and those with a frequent word go to the bucket of their bigram, so no bucket is
hot: what is not in these tables has less than 1 / 65,536 of all places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.shared import dense, release, slices, sum_vectors, vector_rows, written
from verdantflow.llm.words import mixed, word_hashes

HEAD = 1 << 17
CHUNK = 1 << 20
CHUNK_DOCS = 1 << 16
BUCKET = 1 << 21
PRIOR = 4.0
UNIT = 1 << 24
_U = np.uint64
_START = _U(0)
_STEP = _U(0x9E3779B97F4A7C15)
_PART = 1 << 16
_MODELS = ("target", "background")
_WORD, _PAIR, _TEXTS = 0, 1, 2
_FOLLOWED, _TAUGHT, _TARGET = 1, 2, 4


@dataclass(frozen=True)
class Heads:
    """Counts of the frequent words and bigrams, sorted by hash, and of the whole training; 0: target, 1: background.

    ``followed``: how often a word has a word after it; ``texts``: texts with a word; ``size``: words of the
    vocabulary; ``prior``: weight of the prior.
    """

    words: np.ndarray
    counts: np.ndarray
    followed: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    total: np.ndarray
    texts: np.ndarray
    size: int
    prior: float

    def terms(self, model: int, pair: np.ndarray, word: np.ndarray, followed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a place adds to the loss of its text, in 1 / ``UNIT`` bits: by itself, and if a word follows."""
        q = (word + 1) / (self.total[model] + self.size + 1)
        return (np.rint(-np.log2(pair + self.prior * q) * UNIT).astype(np.int64), np.rint(np.log2(followed + self.prior) * UNIT).astype(np.int64))


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, word before it and whether one follows, at every place; where each text's places begin."""
    word, at = word_hashes(texts)
    before, follows = np.concatenate((word[:0], [_START], word[:-1])).astype(_U)[: len(word)], np.ones(len(word), bool)
    some = at[:-1] < at[1:]
    before[at[:-1][some]] = _START
    follows[at[1:][some] - 1] = False
    return word, before, follows, at


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _STEP + mixed(word))


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _flags(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(piece.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("teach", "target"))


def _summed(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], [np.add.reduceat(x[order], first) if len(first) else x[:0] for x in columns]


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Counts of words, texts, and those bigrams that a 131,072nd of the places have, of chunks of a task."""
    names = ["kind", "hash", "word", "background", "target", "followed_background", "followed_target"]
    held: list[tuple[np.ndarray, ...]] = []
    texts = np.zeros(2, np.int64)

    def rows(kind: int, key: np.ndarray, word: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(word.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(x.astype(np.int64)) for x in counts], names=names)

    def out() -> Iterator[pa.RecordBatch]:
        word, before, follows, target = (np.concatenate(x) for x in zip(*held))
        held.clear()
        own, counts = _summed(word, [np.ones(len(word), np.int64), target.astype(np.int64), follows.astype(np.int64), (follows & target).astype(np.int64)])
        yield rows(_WORD, own, own, counts)
        pair, first, n = np.unique(_pairs(before, word), return_index=True, return_counts=True)
        often = n >= max(2, len(word) // HEAD if HEAD else 2)
        yield rows(_PAIR, pair[often], word[first[often]], [n[often], *([np.zeros(often.sum(), np.int64)] * 3)])

    for piece in slices(batches, "text"):
        teach, target = _flags(piece)
        word, before, follows, at = _places(piece.column("text"))
        own = np.diff(at)
        taught = np.repeat(teach, own)
        texts += ((own > 0) & teach).sum(), ((own > 0) & teach & target).sum()
        held.append((word[taught], before[taught], follows[taught], np.repeat(target, own)[taught]))
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield from out()
    if held:
        yield from out()
        yield rows(_TEXTS, np.zeros(1, _U), np.zeros(1, _U), [texts[:1], texts[1:], texts[:1] * 0, texts[:1] * 0])


def _head_pairs(batches, pairs) -> Iterator[pa.RecordBatch]:
    """Exact counts of the frequent bigrams in a task, as vectors."""
    counts = np.zeros((2, len(pairs.value)), np.int64)
    for piece in slices(batches, "text"):
        teach, target = _flags(piece)
        word, before, _, at = _places(piece.column("text"))
        place, inside = _found(pairs.value, _pairs(before, word))
        for k, chosen in enumerate((teach & target, teach)):
            own = inside & np.repeat(chosen, np.diff(at))
            counts[k] += np.bincount(place[own], minlength=counts.shape[1])
    for name, own in zip(_MODELS, counts):
        for row in vector_rows(name, own, _PART):
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("data", pa.binary())]))


def _heads(rows: DataFrame, prior: float) -> Heads:
    counted = rows.mapInArrow(_count, "kind int, hash long, word long, background long, target long, followed_background long, followed_target long")
    sums = [F.sum(c).alias(c) for c in ("background", "target", "followed_background", "followed_target")]
    counted = written(counted.groupBy("kind", "hash").agg(F.min("word").alias("word"), *sums), "counts")
    words = counted.filter(F.col("kind") == _WORD)
    total = words.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in _MODELS)).first()
    texts = counted.filter(F.col("kind") == _TEXTS).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in _MODELS)).first()
    # no more than HEAD words, or bigrams, can have this share of all places
    often = F.col("background") >= (max(2, total[2] / HEAD) if HEAD else float("inf"))
    top = words.filter(often)
    table = top.select("hash", *_MODELS, *(f"followed_{c}" for c in _MODELS)).toArrow()
    often_words = [table.column(k).to_numpy() for k in range(5)]
    order = np.argsort(often_words[0].view(_U))
    pairs = counted.filter((F.col("kind") == _PAIR) & often).join(F.broadcast(top.select(F.col("hash").alias("word"))), "word", "left_semi")
    pairs = np.sort(pairs.select("hash").toArrow().column(0).to_numpy().view(_U))
    shared = rows.sparkSession.sparkContext.broadcast(pairs)
    exact = dense(sum_vectors(rows.mapInArrow(lambda b: _head_pairs(b, shared), "name string, part int, data binary")).collect(), len(pairs), _PART) if len(pairs) else {}
    zero = np.zeros(len(pairs), np.int64)
    hashes, *counts = (x[order] for x in often_words)
    return Heads(hashes.view(_U), np.stack(counts[:2]), np.stack(counts[2:]), pairs, np.stack([exact.get(x, zero) for x in _MODELS]), np.array(total[1:]), np.array(list(texts)), int(total[0]), prior)


def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    """Arrays of ``size`` values each, of the given types."""
    width = [np.dtype(k).itemsize * size for k in kinds]
    raw = pa.decompress(data, sum(width), codec="zstd", asbytes=True)
    at = np.cumsum([0, *width])
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), kinds)]


def _send(batches, heads, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets: of each text its id, its words and what frequent bigrams add, of each chunk its other places by bucket."""
    h: Heads = heads.value
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("size", pa.int32()), ("id", id_type), *((c, pa.int64()) for c in ("n", *_MODELS)), ("data", pa.binary())])
    place, inside = _found(h.words, np.zeros(0, _U))
    own = [h.terms(m, np.zeros(len(h.words)), h.counts[m], h.followed[m])[1] for m in (0, 1)]  # of a frequent word that is followed
    number, docs = TaskContext.get().partitionId() << 32, 0
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal number, docs
        key, second, idx, flags = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(key)
        key, second, idx, flags = key[order], second[order], idx[order], flags[order]
        bucket = ((key >> _U(32)) * _U(buckets)) >> _U(32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        three = second.astype("<u8").view(np.uint16).reshape(-1, 4)[:, :3]  # the lower 48 bits
        made = [(int(bucket[a]), b - a, _packed(np.diff(key[a:b], prepend=key[a : a + 1]), key[a : a + 1], three[a:b], idx[a:b], flags[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if made:
            none = pa.nulls(len(made), pa.int64())
            where, size, data = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([number] * len(made), pa.int64()), pa.array(size, pa.int32()), pa.nulls(len(made), id_type), none, none, none, pa.array(data, pa.binary())], schema=schema)
        number, docs = number + 1, 0

    for piece in slices(batches, "text"):
        if docs and docs + piece.num_rows > CHUNK_DOCS:
            yield from out()
        teach, target = _flags(piece)
        word, before, follows, at = _places(piece.column("text"))
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        pair = _pairs(before, word)
        place, inside = _found(h.words, word)
        where = np.flatnonzero(inside)
        spot, met = _found(h.pairs, pair[where])
        where, spot = where[met], spot[met]
        sums = []
        for m in (0, 1):
            alone, _ = h.terms(m, h.pair_counts[m][spot], h.counts[m][place[where]], np.zeros(1))
            value = alone + follows[where] * own[m][place[where]]
            start = h.terms(m, np.zeros(1), np.zeros(1), h.texts[m : m + 1])[1][0]
            sums.append(np.bincount(doc[where], value, len(n)).astype(np.int64) + np.where(n > 0, start, 0))
        rest = np.ones(len(word), bool)
        rest[where] = False
        inside = inside[rest]
        key = np.where(inside, mixed(pair[rest]) | _U(1), mixed(word[rest]) & ~_U(1))
        second = np.where(inside, place[rest].astype(_U), before[rest] & _U((1 << 48) - 1))
        flags = follows[rest] * _FOLLOWED + np.repeat(teach * _TAUGHT + (teach & target) * _TARGET, n)[rest]
        held.append((key, second, (doc[rest] + docs).astype(np.uint16), flags.astype(np.uint8)))
        chunk = np.full(len(n), number)
        yield pa.RecordBatch.from_arrays([pa.array(chunk % buckets), pa.array(chunk), pa.array((np.arange(len(n)) + docs).astype(np.int32)), piece.column("id"), *(pa.array(x.astype(np.int64)) for x in (n, *sums)), pa.nulls(len(n), pa.binary())], schema=schema)
        docs += piece.num_rows
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield from out()
    if held:
        yield from out()


def _answer(batches, heads, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: rows of texts as they are, and for each chunk the sums that the bucket's places add to its texts."""
    h: Heads = heads.value
    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int32()), ("id", id_type), *((c, pa.int64()) for c in ("n", *_MODELS)), ("data", pa.binary())])

    def out(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, size, data in rows:
            step, first, second, idx, flags = _split(data, size)
            parts.append((np.cumsum(step) + first, second, idx, flags))
        key, second, idx, flags = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((second, key))
        k, s, f = key[order], second[order], flags[order]
        fresh = np.concatenate(([True], k[1:] != k[:-1]))
        both = fresh | np.concatenate(([True], s[1:] != s[:-1]))
        first, first_both = np.flatnonzero(fresh), np.flatnonzero(both)
        group, of = np.cumsum(both) - 1, (np.cumsum(fresh) - 1)[first_both]  # each place's bigram; each bigram's word
        often = (k[first_both] & _U(1)).astype(bool)
        at = np.where(often, s[first_both], 0).astype(np.int64)
        values = []
        for m, taught in enumerate((_TARGET, _TAUGHT)):
            n = (f & taught > 0).astype(np.int64)
            word, followed = np.add.reduceat(n, first)[of], np.add.reduceat(n * (f & _FOLLOWED), first)[of]
            if len(h.words):
                word, followed = np.where(often, h.counts[m][at], word), np.where(often, h.followed[m][at], followed)
            alone, more = h.terms(m, np.add.reduceat(n, first_both), word, followed)
            value = np.empty(len(k), np.int64)
            value[order] = alone[group] + (f & _FOLLOWED) * more[group]
            values.append(value)
        done, begin = [], 0
        for chunk, size, _ in rows:
            own = slice(begin, begin + size)
            begin += size
            docs = np.flatnonzero(np.bincount(idx[own]))
            sums = [np.bincount(idx[own], x[own])[docs].astype(np.int64) for x in values]
            done.append((chunk, len(docs), _packed(docs.astype(np.uint16), *sums)))
        chunk, size, data = zip(*done)
        none = pa.nulls(len(done), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(size, pa.int32()), pa.nulls(len(done), id_type), none, none, none, pa.array(data, pa.binary())], schema=schema)

    bucket, rows = None, []
    for batch in batches:
        texts = batch.column("data").is_null()
        yield from pa.Table.from_batches([batch.filter(texts).select(schema.names)]).cast(schema).to_batches()
        own = batch.filter(pa.compute.invert(texts))
        for where, chunk, size, data in zip(*(own.column(c).to_pylist() for c in ("bucket", "chunk", "size", "data"))):
            if rows and where != bucket:
                yield from out(rows)
                rows = []
            bucket = where
            rows.append((chunk, size, data))
    if rows:
        yield from out(rows)
    release()


def _split(data: bytes, size: int) -> tuple[np.ndarray, np.uint64, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data, 17 * size + 8, codec="zstd", asbytes=True)
    a, b, c, d = 8 * size, 8 * size + 8, 14 * size + 8, 16 * size + 8
    three = np.frombuffer(raw[b:c], np.uint16).reshape(-1, 3).astype(_U)
    return np.frombuffer(raw[:a], "<u8"), np.frombuffer(raw[a:b], "<u8")[0], three[:, 0] | three[:, 1] << _U(16) | three[:, 2] << _U(32), np.frombuffer(raw[c:d], np.uint16), np.frombuffer(raw[d:], np.uint8)


def _finish(batches, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, sums after texts, size): a row for each text."""
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def out() -> Iterator[pa.RecordBatch]:
        n = np.concatenate([b.column("n").to_numpy() for b in texts])
        own = [np.concatenate([b.column(c).to_numpy() for b in texts]) for c in _MODELS]
        for size, data in sums:
            idx, *more = _unpacked(data, size, "<u2", "<i8", "<i8")
            for x, y in zip(own, more):
                x[idx] += y
        mean = [x / (np.maximum(n, 1) * float(UNIT)) for x in own]
        ids = pa.chunked_array([b.column("id") for b in texts], id_type).combine_chunks()
        losses = [pa.array(x, mask=n == 0) for x in (*mean, mean[0] - mean[1])]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), *losses], schema=schema)

    chunk, texts, sums = None, [], []
    for batch in batches:
        numbers = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if texts and numbers[a] != chunk:
                yield from out()
                texts, sums = [], []
            chunk, part = numbers[a], batch.slice(a, b - a)
            own = part.column("data").null_count
            if own:
                texts.append(part.slice(0, own))
            rest = part.slice(own)
            sums += zip(rest.column("size").to_pylist(), rest.column("data").to_pylist())
    if texts:
        yield from out()


def cross_entropy_difference(docs: DataFrame, target: Column, teach: Column | None = None, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, target_loss, background_loss, score`` (bits a word).

    The background model learns from the rows where ``teach`` holds (all, unless given), the target model from
    those of them where ``target`` holds; null counts as false. All rows are scored, so documents that are new
    to the models are rows that don't teach. Every word counts; one that no row taught has a count of 0.

    Null, empty and blank texts have ``n_words`` 0 and null losses, and teach nothing. Repeated rows teach as
    often as they occur and score alike; null ids stay null. Losses are summed as integers, so the result
    doesn't depend on the order. Texts are told apart by their place in a partition: ``docs`` should read the same
    rows in the same order again if a task is repeated, as a table does.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.lit(True) if teach is None else teach, F.lit(False)).alias("teach"), F.coalesce(target, F.lit(False)).alias("target"))
    heads = _heads(rows.select("text", "teach", "target"), prior)
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    places = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0 if teach is not None else 6 * int(heads.total[1])
    buckets = 1 + places // (6 * BUCKET)
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.mapInArrow(lambda b: _send(b, shared, buckets, id_type), f"bucket long, chunk long, size int, id {kind}, n long, target long, background long, data binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    answered = dealt.mapInArrow(lambda b: _answer(b, shared, id_type), f"chunk long, size int, id {kind}, n long, target long, background long, data binary")
    ordered = answered.repartition("chunk").sortWithinPartitions("chunk", F.col("data").isNotNull(), "size")
    return ordered.mapInArrow(lambda b: _finish(b, id_type), f"id {kind}, n_words long, target_loss double, background_loss double, score double")
