"""Conversations rebuilt on a shared beginning, and the trie of all their prefixes with weights.

A prefix is known by its length and 120 bits of content: the exclusive or of a digest of each turn and its place,
which running sums give for a conversation of any length. Texts are read once; digests and counts are shuffled.

Identical rebuilt conversations collapse into one weighted sequence with the list of those that end there, and
only the smallest of them gives prefixes. Sequences that are a proper prefix of another are no leaves. All figures
of a subtree are sums over the sequences that pass its top: the words that they share are those of all members
less those of the distinct nodes, and a distinct node is counted where its smallest sequence has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.components import join_counted
from verdantflow.llm.places import placed
from verdantflow.llm.shared import written

FAMILY = 20  # conversations that begin like the first of them
HEADS = 4  # turns taken over from it: the crc32 of the id modulo this
CHUNK = 12  # turns of a conversation are dealt in chunks of 2^CHUNK
ENDS = 1 << 15  # ids in a piece of an end list
_END = "len long, f1 long, f2 long, s long, n long, words long, ids binary"


def _bits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _chunks(table: DataFrame, count: str) -> DataFrame:
    """A row of ``table`` for each chunk of its ``count`` turns (of depth 0 on), as ``chunk``: joins by chunk deal one long conversation to many tasks."""
    return table.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(count, CHUNK))))


def taken_over(conv_id: Column, heads: int = HEADS) -> Column:
    """How many turns a conversation takes over: its id's crc32 modulo ``heads``."""
    return F.crc32(conv_id.cast("string")) % heads


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``c, place, a, b, words``: turns of each conversation from 0, their content as two numbers, words of the text.

    Order is by turn, null first; turns that repeat a number are in the order of their digests. A null role or
    text is empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), digest.alias("digest"), words.alias("words"))
    rows = rows.select("c", "t", _bits(F.col("digest"), 1).alias("a"), _bits(F.col("digest"), 16).alias("b"), "words")
    return written(placed(written(rows, "turns"), ["c"], ["t", "a", "b"]), "placed")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``c, depth, x1, x2, words``: a row of depth 0 for each conversation, then its rebuilt turns from depth 1.

    Conversation c takes over the first h turns of conversation ``c - c % family`` (as many as there are), then
    has its own turns after its first h. No turn of its own may be left, and none to take over either.
    """
    h = taken_over(F.col("c"), heads)
    begin = turns.filter((F.col("place") < heads - 1) & (F.col("c") % family == 0)).groupBy(F.col("c").alias("base"))
    begin = begin.agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "words"))).alias("begin"))
    convs = turns.filter("place = 0").select("c", "total", (F.col("c") - F.col("c") % family).alias("base"), h.alias("h")).join(begin, "base", "left")
    convs = convs.withColumn("begin", F.slice("begin", F.lit(1), F.col("h").cast("int")))
    convs = written(convs.withColumn("shift", F.when(F.col("begin").isNull(), 0).otherwise(F.size("begin")) - F.col("h")).drop("base"), "convs")
    roots = convs.select("c", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(x) for x in ("a", "b", "words")))
    taken = convs.select("c", F.posexplode("begin").alias("k", "t")).select("c", (F.col("k") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.words")
    own = turns.filter(F.col("place") >= h).withColumn("chunk", F.shiftright("place", CHUNK))
    own = own.join(_chunks(convs.select("c", "shift", "total"), "total").drop("total"), ["c", "chunk"])
    own = own.select("c", (F.col("place") + F.col("shift") + 1).alias("depth"), "a", "b", "words")
    mixed = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(x, y, "depth", F.lit(k))) for k, (x, y) in enumerate((("a", "b"), ("b", "a")))]
    return roots.unionByName(taken).unionByName(own).select("c", "depth", mixed[0].alias("x1"), mixed[1].alias("x2"), "words")


def prefixes(rows: DataFrame) -> DataFrame:
    """``c, depth, chunk, f1, f2, x1, x2, before, words``: each prefix of each conversation; ``before``: its words but for the last turn's."""
    rows = rows.withColumn("chunk", F.shiftright("depth", CHUNK))
    upto = Window.partitionBy("c", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", F.bit_xor("x1").over(upto).alias("p1"), F.bit_xor("x2").over(upto).alias("p2"), (F.sum("words").over(upto) - F.col("words")).alias("w"))
    own = written(own, "running")
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("c", "chunk").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"), F.sum("words").alias("y"))
    sums = sums.select("c", "chunk", *(f(x).over(earlier).alias(n) for f, x, n in ((F.bit_xor, "y1", "s1"), (F.bit_xor, "y2", "s2"), (F.sum, "y", "s")))).filter("chunk > 0")
    zero = F.lit(0).cast("long")
    found = own.join(sums, ["c", "chunk"], "left")
    f = [F.col(f"p{k}").bitwiseXOR(F.coalesce(f"s{k}", zero)).alias(f"f{k}") for k in (1, 2)]
    return written(found.select("c", "depth", "chunk", *f, "x1", "x2", (F.col("w") + F.coalesce("s", zero)).alias("before"), "words"), "prefixes")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ends of equal sequences, sorted by id, as pieces of at most ``most`` decimal ids joined by commas."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            table = pa.Table.from_batches([batch.slice(at, most)])
            table = table.append_column("id", table.column("c").cast(pa.string()))
            g = table.group_by(["len", "f1", "f2", "words"], use_threads=False).aggregate([("c", "min"), ("c", "count"), ("id", "list")])
            ids = pc.binary_join(g.column("id_list").combine_chunks(), ",").cast(pa.binary())
            yield from pa.table([g.column("len"), g.column("f1"), g.column("f2"), g.column("c_min"), g.column("c_count"), g.column("words"), ids], names=["len", "f1", "f2", "s", "n", "words", "ids"]).to_batches()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence: pieces of its end list are hashed as they come, one at a time."""
    schema = pa.schema([("len", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string())])
    key, first, n, digest, out = None, 0, 0, None, []

    def done() -> list:
        return [key[0], key[1], key[2], first, n, key[3], digest.hexdigest()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("len", "f1", "f2", "words", "s", "n", "ids"))
        for a, b, c, w, s, m, ids in zip(*columns):
            if key == (a, b, c, w):
                digest.update(b",")
                n += m
            else:
                if key is not None:
                    out.append(done())
                key, first, n, digest = (a, b, c, w), s, m, hashlib.sha256()
            digest.update(ids)
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([*out, done()])


def sequences(prefix: DataFrame) -> DataFrame:
    """``len, f1, f2, s, n, words, ends_sha256``: distinct whole conversations, the smallest and number of those that are one, and a digest of all.

    Equal conversations are dealt over tasks by id and shipped as pieces of joined ids: a hash of a list has to be
    taken in order, so the pieces of one list (not its rows) meet in a task, which holds one of them at a time.
    """
    last = prefix.groupBy("c").agg(F.max_by(F.struct("depth", "f1", "f2", (F.col("before") + F.col("words")).alias("words")), "depth").alias("l"))
    last = written(last.select(F.col("l.depth").alias("len"), "l.f1", "l.f2", "l.words", "c"), "whole")
    keys, most = ["len", "f1", "f2"], ENDS
    dealt = last.repartitionByRange(*keys, "c").sortWithinPartitions(*keys, "c").mapInArrow(lambda b: _pieces(b, most), _END)
    joined = dealt.repartition(*keys).sortWithinPartitions(*keys, "s")
    return written(joined.mapInArrow(_joined, _END.replace("ids binary", "ends_sha256 string")), "sequences")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see :func:`rebuilt`).

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. Conversations alike in all turns are members of the same nodes. Roles and texts of any length
    are compared whole, as digests. A table without conversations has no nodes, not even a root; columns beyond
    ``conv_id, turn, role, text`` play no part.
    """
    every = prefixes(rebuilt(ordered_turns(conversations), family, heads))
    whole = sequences(every)
    own = every.withColumnRenamed("c", "s").join(_chunks(whole.select("s", "len", "n", F.col("words").alias("all")), "len"), ["s", "chunk"])
    own = written(own, "weighted")  # prefixes of one conversation for each sequence
    key = ["depth", "f1", "f2"]
    proper = own.filter("depth < len").select(F.col("depth").alias("len"), "f1", "f2").distinct()
    leaves = whole.join(proper, ["len", "f1", "f2"], "left_anti").select("s", F.lit(1).alias("leaf"))
    # the smallest sequence of a node has it; words before the first node that a sequence has, all words if it has none
    first = own.groupBy(*key).agg(F.min("s").alias("s"), F.min("before").alias("before")).groupBy("s").agg(F.min("before").alias("first"))
    more = whole.select("s", "len", "words").join(leaves, "s", "left").join(first, "s", "left")
    more = _chunks(more.select("s", "len", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("first", "words").alias("first")), "len").drop("len")
    total, apart = F.col("n") * (F.col("all") - F.col("before")), F.col("all") - F.greatest("first", "before")
    parent = [F.min(F.col(f"f{k}").bitwiseXOR(F.col(f"x{k}"))).alias(f"q{k}") for k in (1, 2)]
    nodes = own.join(more, ["s", "chunk"]).groupBy(*key).agg(F.min("s").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"), F.sum(total - apart).alias("saved_tokens"), *parent)
    nodes = written(nodes, "trie")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.count("*").alias("n_children"))
    ends = whole.select(F.col("len").alias("depth"), "f1", "f2", "ends_sha256")
    nodes = written(nodes.join(children, key, "left").join(ends, key, "left").fillna(0, ["n_children"]).fillna(hashlib.sha256().hexdigest(), ["ends_sha256"]), "nodes")
    up = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("often"))
    below = join_counted(nodes.filter("depth > 0"), up, ["depth", "q1", "q2"], "often").drop("often")
    found = below.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
