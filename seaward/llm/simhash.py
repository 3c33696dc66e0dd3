"""SimHash near-duplicates: fingerprints in a vantage-point tree, exact pairs in its shards, groups over all links.

1. Each text gets a 64-bit fingerprint: the majority, bit by bit, over the hashes of its word shingles.
2. Equal fingerprints become one node.  From a bounded sample of nodes the top of a vantage-point tree is built: a
   vantage point splits nodes by Hamming distance at the sample's median radius.  Each leaf is a shard.
   Over-full shards are split again by further levels of the tree, from samples of their own, in rounds of DataFrame steps.
3. A node goes to its own shard, and to the inner side of each boundary that its search ball overlaps: by the triangle
   inequality two nodes within ``radius`` bits meet in at least one shard.  Only one side of a boundary takes visitors,
   so that a level adds a fifth to the rows, not a half.
   Nodes of a shard that no vantage point splits (a dense neighbourhood) are dealt to blocks, and all pairs of blocks meet.
4. A shard goes on with the same tree down to small leaves and compares there.  It returns a spanning forest of its
   links, so dense groups give no more rows than they have members.
5. Groups: smallest label over links, with pointer jumping, in rounds written to the shared folder.

Null and empty texts have fingerprint zero and are linked like any other.  Rows with equal ids or texts are all kept.  A
group's id is the smallest id in it; null ids are in groups but never name one, unless all are null.  Texts of any length
are taken whole.  Other columns are not looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import free_names, hot_keys, join_hot, map_columns, materialize, read_table, text_or_empty
from seaward.operators import small

SEED = 42
#: Nodes a shard has about; nodes in the sample that the top of the tree is built from.
SHARD_NODES, SAMPLE = 4096, 16_384
#: Nodes beyond which a shard is split again, nodes of such a shard that its further levels are built from (about), and
#: rounds of splitting before the blocks.
MOST_NODES, SPLIT_SAMPLE, SPLIT_ROUNDS = 4 * SHARD_NODES, 1024, 12
_LEAF = 96
#: Nodes of an over-full shard that are placed by one task.
PART_NODES = 1 << 16
#: Tasks that the rows of one label are dealt to.
PARTS = 8
#: Min-hash values of a text, values in a band, rows of a bucket that are compared at once (about).
PERMUTATIONS, BAND_ROWS, CHUNK = 125, 5, 256


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (big-endian, as 8-byte rows) of each run of ``words`` words of the text, ASCII letters in lower case."""
    import xxhash

    parts = text.encode().lower().split()
    n = len(parts)
    if not n:
        return np.zeros((0, 8), dtype=np.uint8)
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if n <= words:
        return np.frombuffer(digest(joined, SEED), np.uint8).reshape(1, 8)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits as a signed number (a bit is set if it is in over half of the hashes)."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        total += np.unpackbits(hashes[at : at + 16_384], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    run = lambda rows: {key: rows[key], "fp": [fingerprint(shingle_hashes(t, shingle)) for t in rows["__text"]]}
    return map_columns(docs.select(F.col(key), text_or_empty(text).alias("__text")), run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    """Differing bits; the points must be unsigned (of a signed number its absolute value's bits would count)."""
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, radius: int, tries: int = 8) -> tuple | None:
    """Vantage point and boundary: of some candidates the one whose two sides, visitors included, are smallest."""
    best = None
    for v in points[:: max(1, len(points) // tries)]:
        d = _distance(points, v)
        r = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for edge in (r - 1, r):
            inner, outer = int((d <= edge + radius).sum()), int((d > edge).sum())
            if outer and inner and (best is None or max(inner, outer) < best[0]):
                best = (max(inner, outer), v, edge)
    return None if best is None or best[0] > 0.9 * len(points) else best[1:]


def build_tree(sample: np.ndarray, total: int, radius: int, shard_nodes: int = SHARD_NODES):
    """Nested (vantage, boundary, inner, outer) over a sample; a leaf is a number, counted from 0."""
    count = 0

    def grow(points, least):
        nonlocal count
        split = _split(points, radius) if len(points) > least else None
        if split is None:
            count += 1
            return count - 1
        d = _distance(points, split[0])
        return (*split, grow(points[d <= split[1] + radius], least), grow(points[d > split[1]], least))

    return grow(sample, max(16, shard_nodes * len(sample) / max(total, 1)))


def _place(tree, points: np.ndarray, index: np.ndarray, radius: int, out: list) -> None:
    if not isinstance(tree, tuple):
        out.append((np.full(len(index), tree, dtype=np.int32), index))
        return
    vantage, edge, inner, outer = tree
    d = _distance(points[index], vantage)
    _place(inner, points, index[d <= edge + radius], radius, out)
    _place(outer, points, index[d > edge], radius, out)


def _flood(points: np.ndarray, index: np.ndarray, radius: int, links: list) -> None:
    """A spanning forest of the links among ``index``: each point looks at those not reached yet."""
    rest = index
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            p = wave.pop()
            near = _distance(points[rest], points[p]) <= radius
            if near.any():
                found = rest[near]
                links.append(np.stack([found, np.full(len(found), p)], 1))
                wave += found.tolist()
                rest = rest[~near]


def _search(points: np.ndarray, index: np.ndarray, radius: int, links: list) -> None:
    """Links among ``index``: split by vantage points down to small leaves, then compare all."""
    if len(index) > _LEAF:
        split = _split(points[index], radius)
        if split is not None:
            d = _distance(points[index], split[0])
            _search(points, index[d <= split[1] + radius], radius, links)
            _search(points, index[d > split[1]], radius, links)
            return
        _flood(points, index, radius, links)
        return
    own = points[index]
    a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= radius, 1))
    if len(a):
        links.append(np.stack([index[a], index[b]], 1))


def spanning_links(points: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (member, root) of positions, so that the members within ``radius`` bits, step by step, share a root."""
    links: list[np.ndarray] = []
    _search(points, np.arange(len(points)), radius, links)
    return star(np.concatenate(links) if links else np.zeros((0, 2), dtype=np.int64), len(points))


def star(pairs: np.ndarray, n: int) -> np.ndarray:
    """(member, smallest member of its group) for each member that isn't itself the smallest."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return np.stack([member, label[member]], 1)


def link_nodes(nodes: DataFrame, radius: int = 2, shard_nodes: int = SHARD_NODES, most: int = MOST_NODES, sampled: int = SAMPLE) -> DataFrame:
    """Links (src, dst) whose groups are those of all pairs of nodes (column ``fp``, distinct) within ``radius`` bits."""
    total = nodes.count()
    sample = nodes.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(sampled).collect()  # at most SAMPLE rows
    tree = build_tree(np.array([r.fp for r in sample], dtype=np.int64).view(np.uint64), total, radius, shard_nodes)

    def place(rows):
        points, out = np.array(rows["fp"], dtype=np.int64), []
        _place(tree, points.view(np.uint64), np.arange(len(points)), radius, out)
        return {"shard": np.concatenate([s for s, _ in out]), "fp": points[np.concatenate([i for _, i in out])]}

    def search(pdf):
        import pandas as pd

        points = np.unique(pdf["fp"].to_numpy())
        found = points[spanning_links(points.view(np.uint64), radius)]
        return pd.DataFrame({"src": found[:, 0], "dst": found[:, 1]})

    placed = materialize(map_columns(nodes.select("fp"), place, "shard long, fp long", rows_at_once=10_000), "placed")
    return bounded_shards(placed, radius, shard_nodes, most).groupBy("shard").applyInPandas(search, "src long, dst long")


def bounded_shards(placed: DataFrame, radius: int, shard_nodes: int = SHARD_NODES, most: int = MOST_NODES) -> DataFrame:
    """(shard, fp) with over-full shards split again, so that nodes within ``radius`` bits still meet in a shard.

    A round samples each over-full shard, builds further levels of the tree from that sample, and places the shard's nodes
    in them, in parts, each of which gets the tree once.  Shards that do not get smaller become pairs of blocks.
    """

    def grow(key, pdf):
        import pandas as pd

        tree = build_tree(np.sort(pdf["fp"].to_numpy()).view(np.uint64), int(pdf["n"].iloc[0]), radius, shard_nodes)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree) if isinstance(tree, tuple) else None]})

    def place(batches):
        import pyarrow as pa
        import xxhash

        now, tree = None, None
        for batch in batches:
            shard, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]) if len(shard) else []
            for a, b in zip(starts, np.r_[starts[1:], len(shard)].astype(int), strict=True):
                own = int(shard[a])
                if (own, int(salt[a])) != now:  # the tree comes first
                    now, tree, a = (own, int(salt[a])), pickle.loads(batch.column(3)[int(a)].as_py()), a + 1
                points, leaves = batch.column(2).slice(int(a), int(b - a)).to_numpy(zero_copy_only=False).astype(np.int64), []
                _place(tree, points.view(np.uint64), np.arange(len(points)), radius, leaves)
                for leaf, members in leaves:
                    if len(members):
                        ident = xxhash.xxh64_intdigest(b"%d %d" % (own, leaf[0])) - (1 << 63)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), ident)), pa.array(points[members])], names=["shard", "fp"])

    done, stuck = [], []
    for step in range(SPLIT_ROUNDS):
        counts = materialize(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), f"counts-{step}")
        if not counts.limit(1).count():
            break
        over = materialize(placed.join(small(counts), "shard"), f"over-full-{step}")
        done.append(placed.join(small(counts.select("shard")), "shard", "left_anti").select("shard", "fp"))
        few = over.filter(F.pmod(F.xxhash64("fp", F.lit(step)), F.ceil(F.col("n") / SPLIT_SAMPLE)) == 0)
        trees = materialize(few.groupBy("shard").applyInPandas(grow, "shard long, tree binary").filter("tree IS NOT NULL"), f"trees-{step}")
        stuck.append(over.join(small(trees.select("shard")), "shard", "left_anti").select("shard", "fp", "n"))
        # An over-full shard is one key: its nodes are dealt to parts, and each part gets the tree once, ahead of its nodes.
        parts = F.ceil(F.col("n") / F.lit(PART_NODES)).cast("int")
        nodes = over.join(small(trees.select("shard")), "shard", "left_semi").select("shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("salt"), "fp", F.lit(None).cast("binary").alias("tree"))
        given = trees.join(small(counts), "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).cast("long").alias("fp"), "tree")
        dealt = nodes.unionByName(given).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("tree").isNull())
        placed = materialize(dealt.mapInArrow(place, "shard long, fp long"), f"placed-{step}")
    else:
        counts = materialize(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "counts-last")
        stuck.append(placed.join(small(counts), "shard").select("shard", "fp", "n"))
        placed = placed.join(small(counts.select("shard")), "shard", "left_anti").select("shard", "fp")
    for part in stuck:
        blocks = F.ceil(F.col("n") / F.lit(shard_nodes))
        dealt = part.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        done.append(dealt.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp"))
    return reduce(DataFrame.union, done, placed.select("shard", "fp"))


def groups(links: DataFrame, label: str = "groups") -> DataFrame:
    """node, label: the smallest node that links lead to, for each node that has a link."""
    both = links.select("src", "dst").union(links.select("dst", "src")).filter("src <> dst").distinct()
    edges = materialize(both, f"{label}-edges")
    now = materialize(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label"), F.lit(True).alias("changed")), f"{label}-0")
    hubs, step = hot_keys(edges, "dst"), 0
    while now.filter("changed").limit(1).count():
        step += 1
        near = join_hot(edges, now.select(F.col("node").alias("dst"), "label"), "dst", "src", hubs).groupBy("src").agg(F.min("label").alias("m"))
        low = now.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # A label can be most rows' own: the few labels that moved on are dealt to several tasks each.
        moved = low.filter(F.col("node") != F.col("label")).select(F.col("node").alias("label"), F.col("label").alias("up"))
        up = moved.join(low.select("label").distinct(), "label", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        parted = low.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
        jumped = parted.join(up, ["label", "part"], "left").select("node", F.least("label", "up").alias("label"), (F.least("label", "up") < F.col("old")).alias("changed"))
        now = materialize(jumped, f"{label}-{step}")
    return now.select("node", "label")


def components(prints: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """``prints`` (key, fp) with ``component_id``: the smallest key of all rows whose fingerprints links connect."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    labelled = nodes.join(groups(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    table = materialize(labelled.select("fp", "label").join(smallest, "label").select("fp", "component_id"), "components")
    return join_hot(prints, table, "fp", key)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id of each row."""
    prints = materialize(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    found = components(prints, materialize(link_nodes(nodes, radius), "links"), key)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_RNG = np.random.default_rng(17)
_FLIPS = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(hashes: np.ndarray) -> bytes:
    """Smallest shingle under each of ``PERMUTATIONS`` mixings, 16 bits each."""
    own = np.ascontiguousarray(hashes[:, :4]).view(">u4").astype(np.uint32).reshape(-1, 1)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(own), 1024):
        mixed = (own[at : at + 1024] ^ _FLIPS) * _FACTORS
        mixed ^= mixed >> np.uint32(16)
        np.minimum(low, mixed.min(0), out=low)
    return low.astype("<u2").tobytes()


def _shingle_set(hashes: np.ndarray) -> bytes:
    """The distinct hashes in order, 8 bytes each."""
    return np.unique(np.ascontiguousarray(hashes).view("<u8")).tobytes()


def _whole_groups(batches, decode):
    """Tuples of arrays of a stream of rows sorted by the first of them, cut between its values."""
    rest: tuple | None = None
    for batch in batches:
        part = decode(batch)
        if rest is not None:
            part = tuple(np.concatenate([a, b]) for a, b in zip(rest, part, strict=True))
        last = np.searchsorted(part[0], part[0][-1]) if len(part[0]) else 0  # the last group may go on
        rest = tuple(x[last:] for x in part)
        if last:
            yield tuple(x[:last] for x in part)
    if rest is not None and len(rest[0]):
        yield rest


def _decoded(batch):
    """(grp, side, node, label, size, sig and what else there is) of a batch as arrays."""
    first = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
    sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<u2").reshape(-1, PERMUTATIONS)
    return (*first, sig, *(batch.column(c).to_numpy(zero_copy_only=False) for c in range(6, batch.num_columns)))


def _near_pairs(group, side, label, size, sig, least: int, similarity: float, first_only: bool):
    """Arrays of pairs of positions, group by group, whose signatures share ``least`` values.

    Rows of one label, of one side (but for side 0) or of sizes too unlike for the similarity are no pair.  With
    ``first_only`` a row that was paired is not looked at again in its group.
    """

    def open_pairs(i, j):
        apart = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
        return apart & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)

    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= 16, sizes)
    for d in range(1, 16):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        if not len(i):
            break
        i = i[open_pairs(i, i + d)]
        for cut in range(0, len(i), 4096):
            j = i[cut : cut + 4096]
            yield np.stack([j, j + d], 1)[(sig[j] == sig[j + d]).sum(1) >= least]
    for s, m in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        loose, pairs = np.arange(s, s + m), []
        for k in range(s, s + m - 1):
            j = loose[np.searchsorted(loose, k, "right") :]
            j = j[open_pairs(k, j)]
            near = j[(sig[j] == sig[k]).sum(1) >= least]
            pairs.append(np.stack([np.full(len(near), k), near], 1))
            if first_only and len(near):
                loose = np.setdiff1d(loose, near, assume_unique=True)
        yield np.concatenate(pairs)


def _first_pairs(batches, least: int, similarity: float):
    """Pairs (a, b), a < b: each row of a group with one row before it that seems similar."""
    import pyarrow as pa

    for group, side, node, label, size, sig in _whole_groups(batches, _decoded):
        found = np.concatenate([np.zeros((0, 2), dtype=np.int64), *_near_pairs(group, side, label, size, sig, least, similarity, True)])
        found = found[np.lexsort((found[:, 0], found[:, 1]))]
        found = found[np.append(True, found[1:, 1] != found[:-1, 1])[: len(found)]]
        ends = np.sort(node[found], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity that reaches the limit."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def _links_between_labels(batches, least: int, similarity: float):
    """Links (src, dst) in a stream of rows that carry their band and shingle set too, compared exactly where they meet.

    Only links that join two labels not joined before in the same batch are returned, likeliest pairs first, so there are
    fewer links than rows however many pairs are similar or nearly so.  A pair that shares several bands is compared in the
    first of them only.
    """
    import pyarrow as pa

    bands = PERMUTATIONS // BAND_ROWS
    for group, side, node, label, size, sig, band, held in _whole_groups(batches, _decoded):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        labels, sets, links = label.tolist(), {}, []
        for pairs in _near_pairs(group, side, label, size, sig, least, similarity, False):
            keep, score = np.zeros(len(pairs), dtype=bool), np.zeros(len(pairs), dtype=np.int64)
            for cut in range(0, len(pairs), 4096):
                i, j = pairs[cut : cut + 4096].T
                same = (sig[i] == sig[j]).reshape(-1, bands, BAND_ROWS)
                score[cut : cut + 4096] = same.sum((1, 2))
                keep[cut : cut + 4096] = same.all(2).argmax(1) == band[i]
            pairs, score = pairs[keep], score[keep]
            sets.clear()
            for i, j in pairs[np.argsort(-score, kind="stable")].tolist():
                a, b = root(labels[i]), root(labels[j])
                if a == b:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = np.frombuffer(held[k], "<u8")
                if _alike(sets[i], sets[j], similarity):
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))
        ends = node[np.array(links, dtype=np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst): the pairs (a, b) whose sets (node, set) of shingle hashes are similar."""

    def alike(rows):
        near = [_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for x, y in zip(rows["x"], rows["y"], strict=True)]
        return {to: [n for n, ok in zip(rows[c], near, strict=True) if ok] for to, c in (("src", "a"), ("dst", "b"))}

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return map_columns(left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"), alike, "src long, dst long")


def similar_links(nodes: DataFrame, near: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (src, dst) whose groups are those of all pairs of nodes (node, size, sig) with similar shingle sets.

    ``near`` (a, b) are pairs proposed by fingerprints.  Min-hash bands and the estimate by signatures propose more, and a
    pair counts if its sets, which ``sets_of`` gives for a table of nodes, reach the similarity exactly.  First each row of
    a bucket is paired with one row of its chunk that seems similar, which joins most of each dense group by few pairs.
    Then all rows of a bucket whose ends are not in one group yet meet, with their sets, and those whose estimate is not
    four standard errors below the limit are compared where they meet.
    """
    error = (similarity * (1 - similarity) / PERMUTATIONS) ** 0.5
    sure, least = int(np.ceil(PERMUTATIONS * similarity)), int(np.floor(PERMUTATIONS * (similarity - 4 * error)))

    def bands(rows):
        import xxhash

        out = {"bucket": [], "band": [], "node": []}
        for node, sig in zip(rows["node"], rows["sig"], strict=True):
            out["bucket"] += [xxhash.xxh64_intdigest(sig[b * 2 * BAND_ROWS : (b + 1) * 2 * BAND_ROWS], b) - (1 << 63) for b in range(PERMUTATIONS // BAND_ROWS)]
            out["band"] += range(PERMUTATIONS // BAND_ROWS)
            out["node"] += [node] * (PERMUTATIONS // BAND_ROWS)
        return out

    known = nodes.select("node", "size", "sig")
    keys = materialize(map_columns(nodes.select("node", "sig"), bands, "bucket long, band int, node long"), "bands")
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunk = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / CHUNK))
    rows = keys.join(shared, "bucket").select(F.xxhash64("bucket", chunk).alias("grp"), F.lit(0).alias("side"), "node", F.col("node").alias("label"))
    dealt = rows.join(known, "node").select("grp", "side", "node", "label", "size", "sig").repartition("grp").sortWithinPartitions("grp", "node")
    first = dealt.mapInArrow(lambda batches: _first_pairs(batches, sure, similarity), "a long, b long")
    pairs = materialize(first.union(near.select("a", "b")).distinct(), "first-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = materialize(verified(pairs, materialize(sets_of(ends), "first-sets"), similarity), "first-links")
    opened = materialize(open_rows(keys, groups(links, "first-groups").select("node", "label")), "open-rows")
    sets = materialize(sets_of(opened.select("node").distinct()), "open-sets")
    full = opened.join(known.join(sets, "node"), "node").select("grp", "side", "node", "label", "size", "sig", "band", "set")
    dealt = full.repartition("grp").sortWithinPartitions("grp", "node")
    return links.union(materialize(dealt.mapInArrow(lambda batches: _links_between_labels(batches, least, similarity), "src long, dst long"), "rest-links"))


def open_rows(keys: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows (grp, side, node, label, band) of the buckets whose nodes are not in one group yet, so that all open pairs meet.

    A bucket of more than ``CHUNK`` rows is cut in blocks, and each pair of blocks is a group with two sides.  Rows of
    its largest label have blocks of their own, which are compared with the other blocks only.
    """
    named = keys.join(grouped, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    split = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rows = named.join(split.filter("labels > 1").drop("labels"), "bucket")
    blocks = lambda n: F.ceil(n / F.lit(CHUNK)).cast("long")
    is_main, main_blocks, other_blocks = F.col("label") == F.col("main"), blocks(F.col("most")), blocks(F.col("n") - F.col("most"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.when(is_main, main_blocks).otherwise(other_blocks)))
    own = F.col("own")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    side = lambda j: F.when(j == own, 0).when(j > own, 1).otherwise(2)
    with_main = F.transform(numbers(other_blocks), lambda j: place("main", own, j, F.lit(1)))
    with_others = F.concat(
        F.transform(numbers(main_blocks), lambda i: place("main", i, own, F.lit(2))),
        F.transform(numbers(other_blocks), lambda j: place("other", F.least(own, j), F.greatest(own, j), side(j))),
    )
    places = F.when(F.col("n") <= CHUNK, F.array(place("all", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0)))).when(is_main, with_main).otherwise(with_others)
    return rows.withColumn("p", F.explode(places)).select(F.xxhash64("bucket", "p.kind", "p.i", "p.j").alias("grp"), "p.side", "node", "label", "band")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 2, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row (the smallest id) of each group of near copies; all columns unchanged.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of ``similarity`` or more, and groups
    follow links.  Pairs come from SimHash fingerprints within ``radius`` bits (the vantage-point tree) and, as 64
    fingerprint bits cannot tell such texts (at a similarity of 0.8 fingerprints differ in 9 bits on average, and some in
    18), from min-hash bands; each is compared exactly.

    A row is its id and text: rows of one id with different texts are judged each by its own text, and rows equal in both
    are one.  Null and empty texts, and those without a word, are copies of each other.  Texts of any length are taken
    whole.  Ties: the smallest id, then the smaller text hash.  Rows without an id are kept as they are, and so are the
    columns, whatever their names.  An empty table gives an empty table.
    """

    def run(rows):
        import xxhash

        out = {"id": rows["id"], "text_hash": rows["text_hash"], "fp": [], "node": [], "size": [], "sig": []}
        for t in rows["__text"]:
            hashes = shingle_hashes(t, shingle)
            held = _shingle_set(hashes)
            out["fp"].append(fingerprint(hashes))
            out["node"].append(xxhash.xxh64_intdigest(held) - (1 << 63))
            out["size"].append(len(held) // 8)
            out["sig"].append(signature(hashes) if len(hashes) else bytes(2 * PERMUTATIONS))
        return out

    named = docs.filter(F.col(key).isNotNull())
    (mark,), text_hash = free_names(docs, "text_hash"), F.xxhash64(text_or_empty(text))
    source = named.select(F.col(key).alias("id"), text_hash.alias("text_hash"), text_or_empty(text).alias("__text"))
    prints = materialize(map_columns(source, run, f"id {dict(docs.dtypes)[key]}, text_hash long, fp long, node long, size long, sig binary"), "signatures")
    nodes = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sig").alias("sig")), "signature-nodes")

    def sets_of(wanted):
        def run(rows):
            import xxhash

            held = [_shingle_set(shingle_hashes(t, shingle)) for t in rows["__text"]]
            return {"node": [xxhash.xxh64_intdigest(h) - (1 << 63) for h in held], "set": held}

        ids = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
        return map_columns(source.join(ids, "id", "left_semi"), run, "node long, set binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    # Nodes of one fingerprint are paired with the smallest of them; the tree pairs those of fingerprints near each other.
    of_print = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "print-heads")
    near = link_nodes(of_print.select("fp"), radius)
    heads = near.join(of_print.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(of_print.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    equal = nodes.join(of_print, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    tree = materialize(heads.select("a", "b").union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "print-links")
    links = materialize(similar_links(nodes, tree, sets_of, similarity), "near-links")
    labels = groups(links).select("node", "label")
    rows = prints.select("id", "text_hash", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = rows.groupBy("label").agg(F.min(F.struct("id", "text_hash")).alias("row")).select(F.col("row.id").alias(key), F.col("row.text_hash").alias(mark))
    once = named.withColumn(mark, text_hash).join(first, [key, mark], "left_semi").dropDuplicates([key, mark])
    return once.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_vptree": op6_simhash_vptree}
SQL: dict[str, str] = {}
