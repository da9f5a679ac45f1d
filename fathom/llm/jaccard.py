"""Op 2: n-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

A text's set is its distinct 5-word shingles as 64-bit hashes; texts with equal word sequences form a class, a
node of the join. Two sets that are similar enough share an element among the first quarter of either, in any
order common to all; the order here is rare first, by a sketch of counts over all documents. Every node goes to
the tiles of its prefix, one for each prefix shingle.

First, every node is paired with the node that leads most of its tiles (a shingle's nodes of one size band), then every
group with another one in the same way, a few rounds. Pairs are tested by bitmaps, whose bit counts bound
the overlap from above, and by intersecting the sorted arrays; links join groups. Shingles that still hold nodes of
several groups are laid out in tiles of bounded size; there all pairs of fitting sizes and different groups meet bounds
of places and counts, what passes meets the bitmaps, and the rest is intersected. So no link between groups is lost,
and a large group of near copies costs a pass over its members, not all pairs. ``link``, ``classes`` and ``keep_first`` thus
give groups and do not list the links inside one; ``links`` and ``link_counts`` test the pairs of all tiles and list them all.

Defined results: null text or a text without words has an empty set and is linked with nothing; up to four
words make one shingle; rows that share a doc_id are judged by their own texts, and leave together; rows with a
null doc_id join the search, never name a component and always stay; an empty table gives an empty result;
other columns pass ``keep_first`` unchanged. Sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.textio import WordHashes, docs_of, map_batches, mix, slices, tidy, window_hashes
from fathom.session import scratch_path

WORDS, PERCENT = 5, 75
SKETCH_BITS, SKETCH_PART = 23, 1 << 14
STAR_ROUNDS = 3  # rounds of one pair per group, before tiles compare what is still apart
BLOCK = 512  # nodes of one shingle on a side of a tile
BROADCAST_IDS = 1_000_000  # of documents to read again, as a set in every task; more are joined


def shingle_sets(texts: pa.Array, hashes: WordHashes) -> list[tuple[int, np.ndarray]]:
    """(class hash, sorted distinct shingle hashes) per text; the hash of a text without words is 0."""
    h, sizes = hashes.columns(texts, lower=True)
    wins = window_hashes(h, WORDS)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WORDS:
            s = np.unique(wins[at:at + n - WORDS + 1])
        else:
            s = np.array([xxhash.xxh3_64_intdigest(h[at:at + n].tobytes(), seed=5)], np.uint64) if n else np.empty(0, np.uint64)
        name = xxhash.xxh3_64_intdigest(h[at:at + n].tobytes(), seed=1) if n else 0
        out.append((name - (1 << 64) if name >= 1 << 63 else name, s))
        at += n
    return out


def prefix_size(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the hashed elements; the width is a power of two of at least twice the size."""
    bits = 1 << max(9, int(2 * len(s) - 1).bit_length())
    out = np.zeros(bits // 64, np.uint64)
    slot = mix(s) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    return np.bitwise_or.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """Most elements that the sets can share: a bit set in one map alone stands for an element of that set alone."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def similar(overlap: int, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def profile(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, node, n`` per document, stored once, and the sketch: a class of frequency per slot of hashes."""
    spark = docs.sparkSession
    path = scratch_path(spark, "profile")
    hashes = WordHashes()
    schema = "doc_id bigint, node bigint, n int, part int, counts binary"
    kind = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_rows = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for b in batches:
            for s in slices(b):
                any_rows = True
                sets = shingle_sets(s.column("text"), hashes)
                all_of = np.concatenate([x for _, x in sets])
                np.add.at(counts, (all_of & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([c for c, _ in sets], pa.int64()), pa.array([len(x) for _, x in sets], pa.int32()), none, pa.nulls(len(sets), pa.binary())], schema=kind)
        if any_rows:
            small = np.minimum(counts, 0xFF).astype(np.uint8).reshape(-1, SKETCH_PART)
            for i in range(0, len(small), 64):
                k = min(64, len(small) - i)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(k, pa.int32()), pa.array(range(i, i + k), pa.int32()), pa.array([small[j].tobytes() for j in range(i, i + k)], pa.binary())], schema=kind)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the parts that meet in a task; holds one array per part, however many rows come."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                total[part] = total[part] + x if part in total else x.astype(np.uint64)
        if total:
            classes = [(2 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], names=["part", "counts"])

    docs_of(docs, "doc_id", "text").mapInArrow(tidy(run), schema).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.where("part is not null").select("part", "counts").repartition("part").mapInArrow(tidy(add), "part int, counts binary").toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    for part, raw in zip(sums.column("part").to_pylist(), sums.column("counts").to_pylist()):
        sketch[part * SKETCH_PART:(part + 1) * SKETCH_PART] = np.frombuffer(raw, np.uint8)
    return rows.where("part is null").select("doc_id", "node", "n"), sketch


def tiles(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``key, n, pos, node``: the nodes of every prefix shingle that two classes or more share, and the shingle's
    place in the node's order. Rows of a key come sorted by size, so a task holds one batch and one row of a key, however
    many nodes it has."""
    hashes, sent = WordHashes(), docs.sparkSession.sparkContext.broadcast(sketch)

    def run(b):
        rare = sent.value
        keys, ns, nodes = [], [], []
        for node, s in shingle_sets(b.column("text"), hashes):
            if len(s):
                p = prefix_size(len(s))
                # rare first, then by hash; a stable sort of sorted hashes orders them alike in every text
                rank = (rare[(s & np.uint64(len(rare) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                keys.append(s[np.argsort(rank, kind="stable")[:p]])
                ns.append((len(s) << 32) + np.arange(p))
                nodes.append(np.full(p, node, np.int64))
        if not keys:
            return None
        return {"key": np.concatenate(keys).view(np.int64), "place": np.concatenate(ns), "node": np.concatenate(nodes)}

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, False  # the last row, which may go on in the next batch, and whether its key has an earlier one

        def rows(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            key, place, node = (c[keep] for c in cols)
            parts = (key, (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32), node)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["key", "n", "pos", "node"])

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "place", "node")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1]))  # once per class
            cols = [c[new] for c in cols]
            again = np.append(joined, cols[0][1:] == cols[0][:-1])
            two = again | np.append(again[1:], False)
            yield rows(cols, np.flatnonzero(two[:-1]))
            held, joined = [c[-1:] for c in cols], bool(again[-1])
        if held is not None and joined:
            yield rows(held, np.zeros(1, np.int64))

    rows = map_batches(docs_of(docs, "text"), run, "key bigint, place bigint, node bigint")
    return rows.repartition("key").sortWithinPartitions("key", "place", "node").mapInArrow(tidy(shared), "key bigint, n int, pos int, node bigint")


def star_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One pair ``a, b`` per group: the node of another group that leads most of the tiles (a shingle's nodes of one
    size band) that the two share, and a node of this group. A tile is led by its node with the most shared
    shingles: of near copies that is the original or the least changed one. ``rows``: ``key, n, node, comp, c``."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    r = rows.select("key", band.alias("band"), "node", "comp", "c")
    first = r.groupBy("key", "band").agg(F.max(F.struct("c", "node", "comp")).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    first = first.where("low < high").select("key", "band", F.col("lead.node").alias("a"), F.col("lead.comp").alias("lead"))
    met = r.join(first, ["key", "band"]).where("comp <> lead")
    times = met.groupBy("comp", "a").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("c", "node")).alias("b"))
    best = times.groupBy("comp").agg(F.max(F.struct("times", "a", "b")).alias("best"))
    return best.select("best.a", F.col("best.b.node").alias("b"))


def signatures(docs: DataFrame, nodes: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """``node, n, sig`` of the given nodes, stored once: bitmaps (``kind`` bits) or sorted hashes (items), as bytes.
    The first document of each node is read again; the ids to read go to all tasks while they are few, and are
    joined beyond that. A node may occur twice (by another row with the same doc_id), which adds no link."""
    hashes = WordHashes()
    ids = known.where("n > 0").join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    path = scratch_path(docs.sparkSession, "ids")
    ids.write.parquet(path)
    ids = docs.sparkSession.read.parquet(path)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(b):
        sets = shingle_sets(b.column("text"), hashes)
        return {"node": [c for c, _ in sets], "n": [len(s) for _, s in sets], "sig": [(bitmap(s) if kind == "bits" else s).tobytes() for _, s in sets]}

    rows = docs_of(docs, "doc_id", "text")
    wanted = rows.join(ids, rows.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    folder = scratch_path(docs.sparkSession, kind)
    map_batches(wanted, run, "node bigint, n int, sig binary").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _tested(pairs: DataFrame, sigs: DataFrame, passes) -> DataFrame:
    """The pairs ``a, b`` for which ``passes(sig_a, sig_b, n_a, n_b)``; signatures come as uint64 arrays."""

    def run(b):
        keep = [passes(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m)
                for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("sig_a", "sig_b", "n_a", "n_b")))]
        part = b.filter(pa.array(keep, pa.bool_()))
        return {"a": part.column("a"), "b": part.column("b")} if part.num_rows else None

    def side(name: str) -> DataFrame:
        return sigs.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a bigint, b bigint")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    at = np.searchsorted(x, y)
    return int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))


def verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar, stored: bitmaps first, arrays only of what is left."""
    spark = docs.sparkSession
    likely, links = scratch_path(spark, "likely"), scratch_path(spark, "links")
    _tested(pairs, bits, lambda x, y, n, m: similar(overlap_bound(x, y, n, m), n, m, percent)).write.parquet(likely)
    rest = spark.read.parquet(likely)
    items = signatures(docs, rest.select(F.explode(F.array("a", "b")).alias("node")), known, "items")
    _tested(rest, items, lambda x, y, n, m: similar(common(x, y), n, m, percent)).write.parquet(links)
    return spark.read.parquet(links)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the stored links ``a, b``: the smallest node that it reaches.

    Every node points to its smallest neighbour if that is smaller; pointers are followed until they end; the links
    between the groups so found are the next, much smaller round's. Each step is a written table."""
    groups = None
    while True:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = _stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "heads")
        while True:
            up = heads.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            jumped = _stored(heads.join(up, "comp").select("node", F.col("above").alias("comp"), (F.col("above") < F.col("comp")).alias("moved")), "heads")
            if not jumped.where("moved").limit(1).count():
                break
            heads = jumped.select("node", "comp")
        head = lambda x: heads.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
        if groups is None:
            groups = heads
        else:
            groups = _stored(groups.join(head("comp"), "comp", "left").select("node", F.coalesce("comp_comp", "comp").alias("comp")), "groups")
        links = _stored(links.join(head("a"), "a").join(head("b"), "b").where("comp_a <> comp_b").select(
            F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return groups


def least_overlap(n, m, percent: int = PERCENT):
    """Smallest intersection with which sets of sizes n and m are similar."""
    return -(-percent * (n + m) // (100 + percent))


def tile_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs ``a, b`` of nodes of different groups that share a prefix shingle, in sizes that can match, and
    pass the bounds of places and counts. ``rows``: ``key, n, pos, node, comp, c``, ``c`` the number of a node's rows.

    Similar sets of sizes n and m lack at most n - o and m - o elements of each other (o: least overlap), so they
    share one among the first n - o + 1 and m - o + 1, and so many of their whole prefixes as these are longer.

    A shingle's nodes are ordered by size and cut into blocks of ``BLOCK``; a tile holds two blocks (or one), is
    compared in one task, and only pairs that pass the bounds leave it."""
    per_key = Window.partitionBy("key")
    place = F.floor((F.row_number().over(per_key.orderBy("n", "node")) - 1) / BLOCK).cast("int")
    cut = rows.withColumn("block", place).withColumn("last", F.floor((F.count(F.lit(1)).over(per_key) - 1) / BLOCK).cast("int"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    laid = other.select("key", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "n", "pos", "node", "comp", "c")

    def tiles_of(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        n, pos, comp, c, node = (batch.column(k).to_numpy().astype(np.int64) for k in ("n", "pos", "comp", "c", "node"))
        tile = [batch.column(k).to_numpy() for k in ("key", "t1", "t2")]
        new = np.append(True, np.any([t[1:] != t[:-1] for t in tile], axis=0))
        ends = np.append(np.flatnonzero(new)[1:], len(n))[np.cumsum(new) - 1]  # end of each row's tile
        left, right = [], []
        step, at = 1, np.arange(len(n))
        while len(at):  # every row with the one ``step`` rows later in its tile
            at = at[at + step < ends[at]]
            at = at[percent * n[at + step] <= 100 * n[at]]  # sizes ascend: a row that has reached too large ones is done
            if not len(at):
                break
            b = at + step
            o = least_overlap(n[at], n[b], percent)
            d, e = n[at] - o, n[b] - o
            need = np.minimum(prefix_size(n[at], percent) - d, prefix_size(n[b], percent) - e)
            ok = (comp[at] != comp[b]) & (pos[at] <= d) & (pos[b] <= e) & (np.minimum(c[at], c[b]) >= need)
            left.append(node[at[ok]])
            right.append(node[b[ok]])
            step += 1
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            # whole tiles only: the last tile of a batch may go on in the next one
            t = pa.Table.from_batches([*held, b])
            ids = [t.column(k).to_numpy() for k in ("key", "t1", "t2")]
            same = np.all([x == x[-1] for x in ids], axis=0)
            cut_at = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut_at:
                yield from tiles_of(t.slice(0, cut_at))
            held = t.slice(cut_at).to_batches()
        if held:
            yield from tiles_of(pa.Table.from_batches(held))

    tiles_in = laid.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "n", "node")
    return tiles_in.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def link(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profile, groups): ``doc_id, node, n`` of every document and ``node, comp`` of the nodes with links."""
    known, sketch = profile(docs)
    shared = _stored(tiles(docs, sketch), "tiles")
    bits = signatures(docs, shared.select("node"), known, "bits")
    shares = _stored(shared.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("c")), "shares")
    comps, rest = None, shared.withColumn("comp", F.col("node"))
    for _ in range(STAR_ROUNDS):
        pairs = _stored(star_pairs(rest.join(shares, "node"), percent), "pairs")
        links = verified(docs, known, pairs, bits, percent)
        if not links.limit(1).count():
            break
        comps = _joined(comps, links)
        marked = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Only keys that still hold several groups matter from here on.
        open_keys = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        rest = _stored(marked.join(open_keys, "key", "left_semi"), "open")
    left = rest.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("c"))
    second = tile_pairs(rest.join(left, "node"), percent)
    more = verified(docs, known, _stored(second, "pairs"), bits, percent)
    return known, _joined(comps, more)


def links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` (a < b): every pair of similar classes, also inside a group; grows with the number of links."""
    known, sketch = profile(docs)
    shared = _stored(tiles(docs, sketch), "tiles")
    bits = signatures(docs, shared.select("node"), known, "bits")
    shares = shared.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("c"))
    pairs = tile_pairs(shared.withColumn("comp", F.col("node")).join(shares, "node"), percent)
    return verified(docs, known, _stored(pairs, "pairs"), bits, percent).distinct()


def link_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, node, n_links``: every document's class and the number of other classes that it is linked with."""
    found = links(docs, percent)
    ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node")))
    counts = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return profile(docs)[0].join(counts, "node", "left").select("doc_id", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups of nodes after more links: the links join groups, not nodes, so later searches are small."""
    if groups is None:
        return components(links)
    side = lambda x: groups.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    lifted = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct()
    up = components(_stored(lifted, "links"))
    old = groups.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("above")), "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    return _stored(old.unionByName(up.join(groups.select("node"), "node", "left_anti")), "groups")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    known, groups = link(docs, percent)
    named = known.join(groups, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that follow an earlier document of their group; all columns unchanged."""
    later = classes(docs, percent).where("doc_id > component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(later, docs.doc_id == later._id, "left_anti")
