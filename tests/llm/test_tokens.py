import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdantflow.llm import lengths, packing, tokenfiles, tokens
from verdantflow.llm.tokens import Encoder

PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "a", "The", "ß", "É", "ñ", '"', "'s", "'", ".", ",", "12", "３", " ", "　", "\x85", "\x1c", "é", "İ", "Σ", "ς", "日本",
    "<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "<|", "_", "-", "foo", "ªº", "µ", "​", "ﬁ", "😀", "K", "ſ", " ", "Don't",
]
FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
SCHEMA = "doc_id long, text string, id long, length string"


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(n=400):
    rng = random.Random(3)
    wild = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return [*wild, None, "", "word " * 3000, "x" * 5000]


def table(spark, some):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(some)], SCHEMA)


@pytest.mark.parametrize("name,kind", FILES)
@pytest.mark.parametrize("kept", [1 << 19, 200])
def test_units_give_the_ids_of_the_whole_text(name, kind, kept, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", kept)
    some, encode = texts(3000), plain(name)
    encoder = Encoder(name, kind)
    for _ in range(2):  # once new, once known
        for k in range(0, len(some), 1000 if kept > 200 else 100):
            part = some[k : k + (1000 if kept > 200 else 100)]
            ids, at = encoder.ids(pa.array(part, pa.string()))
            for i, t in enumerate(part):
                assert ids[at[i] : at[i + 1]].tolist() == encode(t), repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_cuts_and_fills_sequences(spark):
    some, encode = texts(), plain("byte_bpe_50k.json")
    rows = packing.best_fit_packing(table(spark, some), "byte_bpe_50k.json", group=40).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(some):
        ids = encode(t) + [2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(ids) > 1024 or len(own) == 1)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    count = np.bincount([r.length for r in rows], minlength=1025)
    assert len(seqs) <= packing.lower_bound(count, 1024) + 1
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), "byte_bpe_50k.json").count() == 0


def test_bounds_hold_and_best_fit_is_exact_on_known_cases():
    rng = np.random.default_rng(1)
    for _ in range(40):
        cap = int(rng.integers(5, 60))
        items = rng.integers(1, cap + 1, int(rng.integers(1, 80)))
        bins, offset, room = packing.best_fit_decreasing(items, cap)
        load = np.bincount(bins, items)
        assert (load <= cap).all() and (cap - load == room).all()
        assert packing.lower_bound(np.bincount(items, minlength=cap + 1), cap) <= len(room)
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11), 10) == 7
    assert packing.lower_bound(np.bincount([4] * 9, minlength=11), 10) == 5


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    some, encode = texts(), plain("word_bpe_49k.json")
    docs = table(spark, some).repartition(5)
    docs = docs.unionByName(docs.filter("doc_id = 7"))  # a repeated row
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs, path, "word_bpe_49k.json", "word", 2, encoding=encoding)
    want, start = [], 0
    for i in sorted([*range(len(some)), 7]):
        ids = encode(some[i]) + [2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_digests(spark, path).collect())
    assert got == want
    assert {r.doc_id: r.ids for r in tokenfiles.read_tokens(spark, path).filter("doc_id in (3, 9)").collect()} == {i: encode(some[i]) + [2] for i in (3, 9)}
    empty = str(tmp_path / "none")
    tokenfiles.write_tokens(spark.createDataFrame([], SCHEMA), empty, "word_bpe_49k.json", "word", 2)
    assert tokenfiles.token_digests(spark, empty).count() == 0


def test_histogram_answers_every_limit(spark):
    some, encode = texts(), plain("byte_bpe_50k.json")
    n = [len(encode(t)) + 1 for t in some]
    rows = lengths.context_limits(lengths.length_histogram(table(spark, some), "byte_bpe_50k.json")).collect()
    assert {r.length: r.docs for r in rows} == {x: n.count(x) for x in set(n)}
    for r in rows:
        above = [x for x in n if x > r.length]
        assert (r.docs_above, r.tokens_above) == (len(above), sum(above))
        assert r.tokens_kept == sum(min(x, r.length) for x in n) and r.tokens_cut == sum(n) - r.tokens_kept
        assert abs(r.quantile - (1 - len(above) / len(n))) < 1e-12
    assert lengths.context_limits(lengths.length_histogram(spark.createDataFrame([], SCHEMA), "byte_bpe_50k.json")).count() == 0
