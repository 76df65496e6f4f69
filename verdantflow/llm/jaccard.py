"""N-gram Jaccard join with set-relation skipping.

Two texts link when the Jaccard similarity of their sets of n-word shingles reaches ``percent`` / 100. The
join is exact, and never lists the pairs of a group:

1. Equal sets fall together under a 128-bit fingerprint. The same pass counts every shingle in a sketch of
   fixed size; rare shingles first is then one order of shingles for all sets.
2. Index-level skipping. Only the shingles of a set's prefix are posted, once for equal sets of a task, with
   the set's size and their position. Size and position bound the size of every partner a posting can have,
   so a list, sorted by size, falls into blocks whose members can't link across; a block of one is skipped,
   and the first of a block (the hub) stands for it. One edge to the hub for each posting keeps lists linear.
   Lists that the sketch shows to be long are never gathered: their blocks follow from the counts of sizes.
3. Answer-level skipping. The hub's answers are computed first, and each member keeps only its difference
   from the hub. For members x, y the intersection follows incrementally:
   ``|x & y| = |hub| - |hub - x| - |hub - y| + |dx & dy|`` with d the symmetric difference from the hub.
   Two members that both answer the hub are in one class already and are skipped; the others are compared
   in blocks of bounded size, and only links that join classes leave the task.
4. Classes are the components of these links.
5. If links are counted, no two members are skipped, and each link counts at the least of the hubs that its
   two sets share, so once; a set's links leave the task as a sum, copies added by the size of their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.components import connected_components, join_counted
from verdantflow.llm.shared import slices, sum_vectors, unpacked, vector_rows, written
from verdantflow.llm.words import shingle_sets

SKETCH_BITS = 23
BLOCK = 256
#: Blocks of a tile at most, and bytes of their differences.
TILE = 16
TILE_BYTES = 16 << 20
LONG_LIST = 1 << 17
BROADCAST_ROLES = 500_000
_U = np.uint64


def _fingerprints(batches, n: int, bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.uint32)
    waiting: list[np.ndarray] = []
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])

    def count() -> None:
        if waiting:
            place, n = np.unique(np.concatenate(waiting), return_counts=True)
            counts[place] += n.astype(np.uint32)
            waiting.clear()

    for piece in slices(batches, "text", 1 << 20):
        sizes, prints = [], []
        for own in shingle_sets(piece.column("text"), n):
            sizes.append(len(own))
            prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else bytes(16))
            waiting.append((own >> _U(64 - bits)).astype(np.int32))
        if sum(map(len, waiting)) > 1 << 18:
            count()
        f = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], schema=schema)
    count()
    for row in vector_rows("", counts, 1 << 16):
        yield pa.RecordBatch.from_pylist([{"part": row["part"], "data": row["data"]}], schema=schema)


def _level(counts):
    """Counts on a log scale, below 128 so that keys stay positive."""
    return np.minimum(127, 3 * np.log2(np.asarray(counts) + 1)).astype(np.uint8)


def _postings(batches, n: int, percent: int, bits: int, levels, long: int, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The prefix of each set: (token, n, f1, most), most being the size of the largest partner possible.

    Shingles of a level of at least ``long`` if ``wanted``, else all others. Two sets with one ``f1`` would be
    two members to whoever looks it up, so it may stand for a set here.
    """
    level, seen = levels.value, set()
    for piece in slices(batches, "text", 1 << 20):
        out, size, one, most = [], [], [], []
        for own in shingle_sets(piece.column("text"), n):
            if not len(own):
                continue
            f1 = int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "little", signed=True)
            if f1 in seen:
                continue
            seen.add(f1)
            k = len(own)
            key = np.sort((level[(own >> _U(64 - bits)).astype(np.int64)].astype(_U) << _U(56)) | (own & _U((1 << 56) - 1)))
            prefix = k - -((-percent * k) // 100) + 1
            at = np.arange(prefix)
            # k - at is the largest intersection; a partner of size m needs (100 + percent) * it >= percent * (k + m)
            top = np.minimum(100 * k // percent, ((100 + percent) * (k - at)) // percent - k)
            here = (key[:prefix] >> _U(56) >= long) == wanted
            k_here = int(here.sum())
            out.append(key[:prefix][here].view(np.int64))
            most.append(top[here])
            size.append(np.full(k_here, k))
            one.append(np.full(k_here, f1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, size, one, most)], names=["token", "n", "f1", "most"])


def _hubs(batches) -> Iterator[pa.RecordBatch]:
    """Lists sorted by (token, n, f1) to distinct (hub, member) edges; a block may span batches."""
    carry: tuple | None = None  # token, hub's n, f1 and the largest partner that its block can reach
    for batch in batches:
        if not batch.num_rows:
            continue
        token, n, f1, most = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "n", "f1", "most"))
        if carry is not None:
            token, n, f1, most = (np.concatenate(([c], x)) for c, x in zip(carry, (token, n, f1, most)))
        group = np.concatenate(([0], np.cumsum(token[1:] != token[:-1])))
        span = int(max(most.max(), n.max())) + 1
        reach = np.maximum.accumulate(group * span + most) - group * span
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (n[1:] > reach[:-1])))
        first = np.flatnonzero(fresh)
        hub = first[np.cumsum(fresh) - 1]
        carry = (token[-1], n[hub[-1]], f1[hub[-1]], reach[-1])
        keep = (most >= n[hub]) & (f1 != f1[hub])
        pairs = np.unique(np.stack([f1[hub], f1], 1)[keep], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in range(2)], names=["h1", "f1"])


def _long_hubs(posted: DataFrame) -> DataFrame:
    """The edges of :func:`_hubs` for lists that may be very long: blocks from the distinct sizes of a list, which are few."""
    sizes = posted.groupBy("token", "n").agg(F.max("most").alias("reach"), F.min("f1").alias("h1"))
    before = Window.partitionBy("token").orderBy("n")
    reach = F.max("reach").over(before.rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.withColumn("hub", F.when(reach.isNull() | (F.col("n") > reach), F.struct(F.col("n").alias("hub_n"), "h1")))
    blocks = first.select("token", "n", F.last("hub", True).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("hub"))
    return posted.join(blocks, ["token", "n"]).filter("most >= hub.hub_n and f1 <> hub.h1").select(F.col("hub.h1").alias("h1"), "f1")


def _sets(batches, n: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", 1 << 20):
        rows = [own.tobytes() for own in shingle_sets(piece.column("text"), n)]
        f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in rows), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(rows, pa.binary())], names=["f1", "f2", "tokens"])


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of the sorted distinct ``b`` are in the sorted distinct ``a``."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return a[at] == b if len(a) else np.zeros(len(b), bool)


def _answers(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, block, role, id, f1, f2), the hub's set first in each: each member against the hub.

    A member comes more than once, one after the other, where its document is repeated. ``lower``: the hubs of
    a member that come before this one; ``owned``: a link of which no lower hub knows.
    """
    hub = seen = None
    hub_lower, hub_copies = np.zeros(0, np.int64), 0
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("hub", pa.int64()), ("block", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("less", pa.int64()), ("hub_n", pa.int64()), ("linked", pa.bool_()), ("diff", pa.binary()),
                        ("f1", pa.int64()), ("f2", pa.int64()), ("copies", pa.int64()), ("hub_copies", pa.int64()), ("owned", pa.bool_()), ("lower", pa.binary())])
    for piece in slices(batches, "tokens", 1 << 20):
        rows = []
        for h1, h2, h, block, role, i, tokens, f1, f2, copies, known in zip(*(piece.column(c).to_pylist() for c in ("h1", "h2", "hub", "block", "role", "id", "tokens", "f1", "f2", "copies", "known"))):
            own = np.frombuffer(tokens, _U)
            lower = np.array(known or (), np.int64)
            lower = lower[lower < h1]
            if role == 0:
                hub, hub_lower, hub_copies = own, lower, copies
            if role == 0 or seen == (h1, h2, block, f1, f2):
                continue
            seen = (h1, h2, block, f1, f2)
            within = _common(hub, own)
            both = int(within.sum())
            linked = 100 * both >= percent * (len(own) + len(hub) - both)
            diff = np.sort(np.concatenate([own[~within], hub[~_common(own, hub)]]))
            owned = linked and not np.isin(lower, hub_lower).any()
            rows.append((h1, h2, h, block, i, len(own), len(hub) - both, len(hub), linked, diff.tobytes(), f1, f2, copies, hub_copies, owned, lower.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def _forest(x: np.ndarray, y: np.ndarray, size: int, joined: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (x, y) that join two classes; ``joined`` members are one class from the start."""
    parent = list(range(size))
    own = np.flatnonzero(joined)
    for i in own.tolist():
        parent[i] = int(own[0])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for a, b in zip(x.tolist(), y.tolist()):
        p, q = root(a), root(b)
        if p != q:
            parent[p] = q
            kept.append((a, b))
    return kept


def _compare(batches, percent: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, left, right, block): links between the members of two tiles, block by block, from their differences.

    Links (a, b) that join classes and, if ``counted``, for each member (f1, f2) the documents that it links to,
    summed over the two tiles. A tile has at most ``TILE`` blocks and ``TILE_BYTES`` of differences (or is one block).
    """
    schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "f1", "f2", "n")])

    def links(rows: list[tuple]) -> tuple[list[tuple[int, int]], np.ndarray | None]:
        ids, n, less, linked, block, diffs, _, _, copies, lower, _ = zip(*rows)
        n, less, linked, block = np.array(n), np.array(less), np.array(linked), np.array(block)
        token, count = np.concatenate([np.frombuffer(d, _U) for d in diffs]), np.array([len(d) // 8 for d in diffs])
        value, code, times = np.unique(token, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), count)
        shared = times[code] > 1
        new = np.cumsum(times > 1) - 1
        row, code = row[shared], new[code[shared]]
        both = np.zeros((len(ids), len(ids)))
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            a, b = np.searchsorted(code, (low, low + 4096))
            m = np.zeros((len(ids), 4096), np.float32)
            m[row[a:b], code[a:b] - low] = 1
            both += m @ m.T
        inter = rows_hub_n - less[:, None] - less[None, :] + both
        good = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        if block[0] != block[-1]:
            good &= block[:, None] != block[None, :]
        np.fill_diagonal(good, False)
        sums = None
        if counted:
            hubs = [np.frombuffer(x, np.int64) for x in lower]
            value, code = np.unique(np.concatenate(hubs), return_inverse=True)
            row, known = np.repeat(np.arange(len(ids)), [len(x) for x in hubs]), np.zeros((len(ids), len(ids)), bool)
            for low in range(0, len(value), 4096):
                m = np.zeros((len(ids), 4096), np.float32)
                at = (code >= low) & (code < low + 4096)
                m[row[at], code[at] - low] = 1
                known |= m @ m.T > 0
            sums = (good & ~known) @ np.array(copies, np.int64)
        good &= ~(linked[:, None] & linked[None, :])
        x, y = np.nonzero(np.triu(good, 1))
        return [(ids[a], ids[b]) for a, b in _forest(x, y, len(ids), linked)], sums

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        begins = [i for i, r in enumerate(rows) if not i or r[4] != rows[i - 1][4]]
        spans = [range(a, b) for a, b in zip(begins, [*begins[1:], len(rows)])]
        settled = [not counted and all(rows[i][3] for i in s) for s in spans]
        totals, made = np.zeros(len(rows), np.int64), []
        for p, one in enumerate(spans):
            for q, two in enumerate(spans[p:], p):
                if (key[2] != key[3] and rows[one[0]][10] == rows[two[0]][10]) or (settled[p] and settled[q]):
                    continue  # blocks of one tile meet where it meets itself
                own = [*one] if p == q else [*one, *two]
                if len(own) > 1:
                    found, sums = links([rows[i] for i in own])
                    made += [(a, b, None, None, None) for a, b in found]
                    if sums is not None:
                        totals[own] += sums
        made += [(None, None, r[6], r[7], k) for r, k in zip(rows, totals.tolist()) if k]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], schema=schema)

    key, rows, rows_hub_n = None, [], 0
    for batch in batches:
        for h1, h2, left, right, *row, hub_n in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "left", "right", "id", "n", "less", "linked", "block", "diff", "f1", "f2", "copies", "lower", "tile", "hub_n"))):
            if key != (h1, h2, left, right):
                yield from out(rows)
                key, rows, rows_hub_n = (h1, h2, left, right), [], hub_n
            rows.append(tuple(row))
    yield from out(rows)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS, block: int = BLOCK, count_links: bool = False, long_list: int = LONG_LIST) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_shingles long, representative long, component long``.

    ``representative`` is the smallest id with exactly this set, ``component`` the smallest id that links
    reach. Null or blank text has an empty set (``n_shingles`` 0), links with nothing and is its own
    component. A text of fewer than ``n`` words is one shingle. Rows that repeat an id are kept, each with
    the class of its own text (rows of one id count as linked); ids are cast to long, and a null id is kept
    with a null class and links nothing. Other columns
    of ``docs`` play no part, whatever their names. With ``count_links`` there is a column ``n_links long``: with
    how many other rows this one's text links, equal texts among them. Shingles and sets are told apart by hashes of
    64 and 128 bits, so results are exact up to a collision.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = written(rows.mapInArrow(lambda b: _fingerprints(b, n, sketch_bits), "id long, n long, f1 long, f2 long, part int, data binary"), "fingerprints")
    sketch = sum_vectors(both.filter("part is not null").select(F.lit("").alias("name"), "part", "data"))
    level = np.zeros(1 << sketch_bits, np.uint8)
    for row in sketch.collect():
        piece = unpacked(bytes(row["data"]))
        level[row["part"] << 16 : (row["part"] << 16) + len(piece)] = _level(piece)
    levels = spark.sparkContext.broadcast(level)  # 2^sketch_bits bytes at any input size
    prints = both.filter("part is null").select("id", "n", "f1", "f2")
    classes = prints.filter("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))

    long = int(_level(long_list))
    posted = lambda wanted: rows.filter("id is not null and text is not null").mapInArrow(lambda b: _postings(b, n, percent, sketch_bits, levels, long, wanted), "token long, n long, f1 long, most long")
    lists = posted(False).repartition("token").sortWithinPartitions("token", "n", "f1")
    edges = lists.mapInArrow(_hubs, "h1 long, f1 long")
    if (level >= long).any():
        edges = edges.unionByName(_long_hubs(posted(True)))
    edges = written(edges.distinct().join(classes.select("f1", "f2", F.col("representative").alias("id")), "f1"), "members")

    group = ["h1", "h2"]  # both halves of the hub's fingerprint
    hubs = classes.select(F.col("f1").alias("h1"), F.col("f2").alias("h2"), F.col("representative").alias("hub"))
    sized = edges.groupBy("h1").agg(F.count("*").alias("edges"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = written(hubs.join(sized, "h1"), "hubs")
    edges = written(join_counted(edges, sized, ["h1"], "edges").select(*group, "hub", "f1", "f2", "id", "blocks"), "edges")
    members = edges.select(*group, "hub", F.pmod(F.xxhash64("f1", "f2"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "id", "f1", "f2")
    heads = sized.select(*group, "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("hub").alias("id"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    # each role with the set of its class; the text of a class is that of its representative
    roles = written(members.unionByName(heads), "roles")
    small = roles.count() <= BROADCAST_ROLES
    texts = rows.join(_hint(roles.select("id").distinct(), small), "id", "left_semi")
    sets = texts.mapInArrow(lambda b: _sets(b, n), "f1 long, f2 long, tokens binary")
    if count_links:  # the hubs that know a set, itself if it is one
        known = edges.select("f1", "f2", "h1").unionByName(sized.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "h1"))
        known = known.groupBy("f1", "f2").agg(F.sort_array(F.collect_set("h1")).alias("known")).join(classes.select("f1", "f2", "copies"), ["f1", "f2"])
        # as many hubs in all as there are roles, so small where these are
        sets = sets.join(_hint(written(known, "known"), small), ["f1", "f2"])
    else:
        sets = sets.select("*", F.lit(None).cast("array<long>").alias("known"), F.lit(0).cast("long").alias("copies"))
    faced = sets.join(_hint(roles, small), ["f1", "f2"]).select(*group, "hub", "block", "role", "id", "f1", "f2", "tokens", "known", "copies")
    faced = faced.repartition(*group, "block").sortWithinPartitions(*group, "block", "role", "id", "f1", "f2")
    answers = written(faced.mapInArrow(lambda b: _answers(b, percent), "h1 long, h2 long, hub long, block int, id long, n long, less long, hub_n long, linked boolean, diff binary, f1 long, f2 long, copies long, hub_copies long, owned boolean, lower binary"), "answers")

    # Pairs of tiles of blocks of one hub of which at least one member hasn't answered the hub; all pairs to count links.
    # A row is sent once for each tile: at most 15 times in hubs of up to 8 * TILE blocks, and for a TILE-th of the blocks
    # beyond, unless long differences make tiles smaller.
    still = F.lit(True) if count_links else ~F.col("linked")
    length = 8 * F.sum(F.col("n") - F.col("hub_n") + 2 * F.col("less"))  # of the differences
    state = answers.groupBy(*group, "block").agg(F.sum(still.cast("long")).alias("open"), F.count("*").alias("rows"), length.alias("bytes"))
    unsettled = state.groupBy(*group).agg(F.sum("open").alias("open"), F.sum("rows").alias("rows"), F.max("bytes").alias("bytes"), F.max("block").alias("last")).filter("open > 0 and rows > 1")
    width = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor((F.col("last") + 1) / 8), F.floor(TILE_BYTES / F.greatest("bytes", F.lit(1)))))
    state = written(state.join(unsettled.select(*group, width.alias("width")), group).select(*group, "block", F.floor(F.col("block") / F.col("width")).cast("int").alias("tile"), "open"), "blocks")
    tiles = state.groupBy(*group, "tile").agg(F.sum("open").alias("open"))
    other = tiles.select(*group, F.col("tile").alias("right"), F.col("open").alias("open2"))
    pairs = tiles.select(*group, F.col("tile").alias("left"), "open").join(other, group).filter("left <= right and open + open2 > 0").select(*group, "left", "right")
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("tile")).join(state.drop("open"), [*group, "tile"])
    compared = answers.join(ends, [*group, "block"]).select(*group, "left", "right", "id", "n", "less", "linked", "block", "diff", "f1", "f2", "copies", "lower", "tile", "hub_n")
    compared = compared.repartition(*group, "left", "right").sortWithinPartitions(*group, "left", "right", "block")
    derived = compared.mapInArrow(lambda b: _compare(b, percent, count_links), "a long, b long, f1 long, f2 long, n long")
    if count_links:
        derived = written(derived, "derived")
    links = answers.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(derived.filter("a is not null").select("a", "b"))
    found = connected_components(links).withColumnRenamed("node", "representative")
    classes = classes.join(found, "representative", "left").select("f1", "f2", "representative", "copies", F.coalesce("component", "representative").alias("component"))
    if count_links:
        direct = answers.filter("owned").select("f1", "f2", F.col("hub_copies").alias("n")).unionByName(answers.filter("owned").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("copies").alias("n")))
        others = direct.unionByName(derived.filter("n is not null").select("f1", "f2", "n")).groupBy("f1", "f2").agg(F.sum("n").alias("others"))
        classes = classes.join(others, ["f1", "f2"], "left")
    # copies of one text don't meet, and texts without words have no class
    classes = written(classes, "classes")
    done = join_counted(prints.filter("n > 0"), classes, ["f1", "f2"], "copies", "left")
    bare = [F.lit(None).cast(t).alias(c) for c, t in classes.dtypes if c not in ("f1", "f2")]
    done = done.unionByName(prints.filter("n = 0").select("*", *bare))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
    columns = ["id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("representative", "id")).alias("representative"), own]
    if count_links:
        count = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
        columns.append(F.when(F.col("id").isNotNull(), F.coalesce(count, F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return done.select(*columns)
