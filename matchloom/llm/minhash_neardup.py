"""Near-duplicates by one-permutation hashing.

A document is the set of its five-word shingles (A-Z lower-cased, words as
they stand; fewer words: the whole sequence as one). Equal sets are one node.
One hash of every shingle serves all bins: the top bits pick the bin, the
smallest hash of a bin is its value, and an empty bin borrows from a bin that
a hash of its own number and the attempt picks (optimal densification). Three
consecutive bins form a band. Nodes are ordered by band and node over all
tasks, and buckets of one node go. Within a bucket the nodes are tied to one
centre only (stars), so the pairs grow with the members and not with their
square; every edge is confirmed on the full sets. Buckets that still hold
several components get new centres for a few rounds, which only meet the nodes
of other components. What is left is confirmed or excluded exactly: in one
order of all shingles, rare ones first, two sets that reach the threshold have
their first common shingle so early that enough of both comes after it. So
nodes meet by the shingles that are early enough for sets of about their size
(size classes a tenth apart), and only across components. Each set also has a
bitmap; where one has too many bits that the other lacks, the pair is excluded
before it is made.

At a similarity of 0.75 a pair shares none of the 21 bands with a chance of
about 1e-5. Sets are compared through 64-bit hashes of their shingles, and
equal sets are recognised by a 64-bit hash of the set.

Nulls: a null or blank text is an empty set, linked with nothing. A null id
takes part, but never names a component unless all ids of it are null. Rows
that repeat an id are rows of their own. Ties: the smallest id names a
component and stays. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, distinct, mapped, mix, polynomial, ragged, row_key, saved, words_of
from .components import connected_components

SHINGLE = 5
BIN_BITS = 6
BINS = 1 << BIN_BITS
ROWS = 3
BANDS = BINS // ROWS
#: 100 * intersection >= LEAST * union links two sets.
LEAST = 75
#: Rounds of star centres, at most; they only spare work, as the exact step covers the rest.
ROUNDS = 3
#: Counters by which shingles are ordered; any order is right, a rare-first one is fast.
CELL_BITS = 18
#: Ratio of the bounds of size classes.
GROWTH = 1.1
#: 64-bit words in the bitmap of a set.
MAP = 32


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of every distinct shingle, ordered by document and hash."""
    words = words_of(texts, lower=True)
    doc, flat, lengths = words.doc, words.hash, words.lengths
    grams = polynomial(flat, n)
    inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    owners, hashes = [doc[: len(grams)][inside]], [grams[inside]]
    starts = np.cumsum(lengths) - lengths
    for k in range(1, n):  # texts of fewer words
        short = np.flatnonzero(lengths == k)
        if len(short):
            own = flat[starts[short]]
            for j in range(1, k):
                own = own * np.uint64(0x9E3779B97F4A7C15) + flat[starts[short] + j]
            owners.append(short)
            hashes.append(mix(own) ^ np.uint64(k))
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[fresh], value[fresh]


def borrow_table(attempts: int = 64) -> np.ndarray:
    """For each bin and attempt, the bin that an empty one looks at."""
    at = np.arange(BINS * attempts, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)
    return (mix(at) >> np.uint64(64 - BIN_BITS)).astype(np.int64).reshape(attempts, BINS)


def signatures(owner: np.ndarray, value: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """One value per bin for each of ``n`` documents; rows of documents without shingles are zero."""
    cell = owner * BINS + (value >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    full = np.zeros(n * BINS, bool)
    out = np.zeros(n * BINS, np.uint64)
    full[cell[first]] = True
    out[cell[first]] = value[first]
    some = np.zeros(n, bool)
    some[owner] = True
    empty = np.flatnonzero(~full.reshape(n, BINS) & some[:, None])
    for row in table:
        if not len(empty):
            break
        source = empty // BINS * BINS + row[empty % BINS]
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    step = 1
    while len(empty):  # hardly ever: all attempts met empty bins
        source = empty // BINS * BINS + (empty + step) % BINS
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty, step = empty[~hit], step + 1
    return out.reshape(n, BINS)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__k1, __k2, text) to the row's key, set size, node and band keys."""
    table = borrow_table()
    for part, texts in chunks(batches):
        owner, value = shingle_sets(texts)
        n = len(texts)
        count = np.bincount(owner, minlength=n)
        # The set's hash: two sums over its members, which do not depend on their order.
        once, twice = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        some = count > 0
        if len(owner):
            first = (np.cumsum(count) - count)[some]
            once[some] = np.add.reduceat(mix(value + np.uint64(0x2545F491)), first)
            twice[some] = np.add.reduceat(mix(value ^ np.uint64(0x9E3779B97F4A7C15)), first)
        node = mix(once ^ mix(twice + count.astype(np.uint64))).view(np.int64)
        bins = signatures(owner, value, n, table)
        band = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band * np.uint64(31) + bins[:, r : BANDS * ROWS : ROWS] + np.arange(BANDS, dtype=np.uint64))
        offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(count.astype(np.int64)),
                pa.array(node, mask=~some),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel().view(np.int64))),
            ],
            ["__k1", "__k2", "n", "node", "bands"],
        )


def packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, sorted shingle hashes as bytes)."""
    for part, texts in chunks(batches):
        owner, value = shingle_sets(texts)
        ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        starts = np.concatenate(([0], ends[:-1]))
        own = [value[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "members"])


def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by their first column, those whose value a neighbour has; the task's first and last value may go on elsewhere."""
    held = None
    first = True

    def rows(batch: pa.RecordBatch, after: bool | None) -> pa.RecordBatch:
        x = batch.column(0).to_numpy()
        same = x[1:] == x[:-1]
        keep = np.append(same, False) | np.append(False, same)
        keep[0] |= before is not None and before == x[0]
        keep[-1] |= bool(after)
        return batch.filter(pa.array(keep))

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is None:
            held = batch
            continue
        after = held.column(0)[-1].as_py() == batch.column(0)[0].as_py()
        if first:
            before, first = held.column(0)[0].as_py(), False
        out = rows(held, after)
        before = held.column(0)[-1].as_py()
        held = batch
        yield out
    if held is not None:
        if first:
            before = held.column(0)[0].as_py()
        yield rows(held, True)


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, left, right) to the pairs (a, b) that reach the threshold."""
    for part in batches:
        keep = np.zeros(part.num_rows, bool)
        for i, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep[i] = 100 * both >= LEAST * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))


def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, members) to how many shingles fall into each counter."""
    total = np.zeros(1 << CELL_BITS, np.int64)
    for part in batches:
        value = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)
        total += np.bincount((value >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])


def size_classes(most: int) -> np.ndarray:
    """Least sizes of the classes of sizes up to ``most``."""
    return distinct(np.ceil(GROWTH ** np.arange(int(np.log(max(most, 2)) / np.log(GROWTH)) + 2)).astype(np.int64))


def first_shingles(ranks: np.ndarray):
    """(node, label, members) to the shingles by which a set may meet another one.

    A set (``big`` false) looks for sets no smaller than itself under its own size class. It is found (``big`` true)
    under the classes of all sets down to three quarters of its size. A shingle counts while what follows it in the
    order leaves room for the common part that the smallest sizes in question ask for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            bounds = size_classes(max((len(x.as_buffer()) // 8 for x in part.column(2)), default=2))
            of, keys, places, classes, big, sizes = [], [], [], [], [], []
            for i, x in enumerate(part.column(2)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(x)
                rank = ranks[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                own = int(np.searchsorted(bounds, n, side="right")) - 1
                least = -(-LEAST * n // 100)
                low = int(np.searchsorted(bounds, least, side="right")) - 1
                roles = [(False, own, n)] + [(True, c, max(least, int(bounds[c]))) for c in range(low, own + 1)]
                ordered = x[np.lexsort((x, rank))[: n - -(-LEAST * (least + n) // (100 + LEAST)) + 1]]
                for role, c, other in roles:
                    some = ordered[: n - -(-LEAST * (other + n) // (100 + LEAST)) + 1]
                    of.append(np.full(len(some), i))
                    keys.append(some)
                    places.append(np.arange(len(some)))
                    classes.append(np.full(len(some), int(bounds[c])))
                    big.append(np.full(len(some), role))
                    sizes.append(np.full(len(some), n))
            if not of:
                continue
            own = part.select(["node", "label"]).take(pa.array(np.concatenate(of)))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), *(pa.array(np.concatenate(c)) for c in (sizes, [k.view(np.int64) for k in keys], classes, places, big))],
                ["node", "label", "n", "shingle", "class", "place", "big"],
            )

    return run


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, members) to the node and the words of its bitmap: a shingle sets the bit that its lowest bits name."""
    for part in batches:
        out = np.zeros((part.num_rows, 64 * MAP), np.uint8)
        for i, x in enumerate(part.column(1)):
            out[i, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(64 * MAP)).astype(np.int64)] = 1
        words = np.packbits(out, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(w) for w in words.T.copy())], ["node", *(f"m{k}" for k in range(MAP))])


def crossing_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes (node, label, members) with different labels: all that reach the threshold, and few others.

    Under a shingle and size class, the nodes of the commonest label meet those of other labels only.
    """
    counts = np.zeros(1 << CELL_BITS, np.int64)
    found = mapped(nodes, cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one row a counter
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    ranks = np.round(8 * np.log2(counts + 1)).clip(0, 255).astype(np.uint8)
    on = ["shingle", "class"]
    keys = saved(mapped(nodes, first_shingles(ranks), "node long, label long, n long, shingle long, class long, place long, big boolean"))
    shares = keys.groupBy(*on, "label").agg(F.count("*").alias("c"), F.bool_or("big").alias("l"), F.bool_or(~F.col("big")).alias("s"))
    main = shares.groupBy(*on).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.bool_or("l").alias("l"), F.bool_or("s").alias("s"))
    main = main.where("labels > 1 and l and s").select(*on, "main")
    words = [f"m{k}" for k in range(MAP)]
    maps = mapped(nodes.select("node", "members"), bitmaps, ", ".join(["node long", *(f"{w} long" for w in words)]))
    keys = saved(saved(keys.join(main, on)).join(maps, "node"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("node", "label", "n", "place", *words)]
    # A bit that only one set has stands for a shingle at least that the other lacks.
    lacks = lambda x, y: " + ".join(f"bit_count({x}_{w} & ~{y}_{w})" for w in words)
    small, large = keys.where("not big"), keys.where("big")
    fit = f"""s_label <> l_label and s_n <= l_n and s_node <> l_node and 100 * s_n >= {LEAST} * l_n
        and {100 + LEAST} * least(s_n - s_place, l_n - l_place) >= {LEAST} * (s_n + l_n)
        and {100 + LEAST} * (s_n - ({lacks("s", "l")})) >= {LEAST} * (s_n + l_n) and {100 + LEAST} * (l_n - ({lacks("l", "s")})) >= {LEAST} * (s_n + l_n)"""
    near = [
        a.select(*on, *side("s")).join(b.select(*on, *side("l")), on).where(fit).select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b"))
        for a, b in ((small.where("label <> main"), large), (small.where("label = main"), large.where("label <> main")))
    ]
    return near[0].union(near[1]).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's key (__k1, __k2), doc_id, n_shingles and label: rows of one label are near-duplicates; null: of none."""
    keyed = docs.select(*row_key(), "text")
    rows = saved(
        mapped(keyed, sketches, "__k1 long, __k2 long, n long, node long, bands array<long>")
    )
    # One row stands for all rows of a set.
    sets = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("__k2", "__k1")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = saved(sets)
    members = sets.select(F.explode("bands").alias("bucket"), "node", "n")
    inside = saved(mapped(members.repartitionByRange("bucket", "node").sortWithinPartitions("bucket"), not_alone, members.schema))
    labels = saved(inside.groupBy("node").agg(F.max("n").alias("n")).select("node", F.col("node").alias("label")))
    owners = sets.join(labels, "node", "left_semi").select("node", F.col("row.__k1").alias("__k1"), F.col("row.__k2").alias("__k2"))
    texts = keyed.join(owners, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select("node", "text")
    packed = saved(mapped(texts, packed_sets, "node long, members binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        left = packed.select(F.col("node").alias("a"), F.col("members").alias("left"))
        right = packed.select(F.col("node").alias("b"), F.col("members").alias("right"))
        return saved(mapped(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right"), confirm, "a long, b long"))

    def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
        """Labels after the links found, on the graph of the labels there were."""
        ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"]
        between = found.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
        names = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("name"))
        return saved(labels.join(names, "label", "left").select("node", F.coalesce("name", "label").alias("label")))

    def open_buckets(labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """The members of buckets with their labels, and the buckets of several labels with this turn's centre."""
        now = inside.join(labels, "node")
        first = F.struct((F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("h"), "node", "label", "n")
        open_ = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.min(first).alias("c")).where("x <> y")
        return now, open_.select("bucket", "size", F.col("c.node").alias("centre"), F.col("c.label").alias("own"), F.col("c.n").alias("cn"))

    for turn in range(ROUNDS):
        now, open_ = open_buckets(labels, turn)
        # The centre meets the nodes of other components whose size lets them be similar.
        pairs = now.join(open_, "bucket").where(f"label <> own and 100 * least(n, cn) >= {LEAST} * greatest(n, cn)")
        found = linked(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
        if not found.limit(1).count():
            break
        labels = merged(labels, found)
    # In a bucket of two nodes all have met.
    now, open_ = open_buckets(labels, ROUNDS)
    rest = saved(now.join(open_.where("size > 2").select("bucket"), "bucket", "left_semi").select("node", "label").distinct())
    found = linked(crossing_pairs(rest.join(packed, "node").select("node", "label", "members")))
    labels = merged(labels, found)
    return rows.join(labels, "node", "left").select(
        "__k1",
        "__k2",
        F.nullif("__k2", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "node").alias("label"),
    )


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = saved(near_duplicates(docs).select("doc_id", "n_shingles", "label"))
    # Written first: so the join meets two plain exchanges and can split the rows of a large component.
    least = saved(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Rows linked with nothing stay, all columns as they were.
    """
    rows = saved(near_duplicates(docs).select("__k1", "__k2", "label"))
    # A null id is the smallest key, but loses to any id.
    rank = F.struct((F.col("__k2") == NO_ID).alias("none"), "__k2", "__k1")
    winners = rows.where("label is not null").groupBy("label").agg(F.min(rank).alias("w")).select("w.__k1", "w.__k2", F.lit(True).alias("__one"))
    lone = rows.where("label is null").select("__k1", "__k2", F.lit(False).alias("__one")).distinct()
    names = docs.columns
    # Rows are numbered where they are read, before any shuffle, so that a task run again gives the same numbers.
    numbered = docs.select(*names, *row_key(), F.monotonically_increasing_id().alias("__row"))
    kept = numbered.join(saved(winners.union(lone)), ["__k1", "__k2"])
    return (
        kept.withColumn("__copy", F.when(F.col("__one"), F.lit(-1)).otherwise(F.col("__row")))
        .dropDuplicates(["__k1", "__k2", "__copy"])
        .select(names)
    )
