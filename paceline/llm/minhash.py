"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document is its set of k-word shingles. One hash per shingle gives all minima: its upper bits choose a bin,
the least hash of a bin is its minimum, and an empty bin borrows from the bins that a fixed random sequence of
its own visits, so that an entry of two signatures agrees with the probability of their Jaccard similarity.
ROWS entries make a band; documents with an equal band share a bucket. At a similarity of 0.8, a pair shares
none of the 48 buckets with a probability of 5e-7.

Equal sets are one node, so copies cost nothing further. In a bucket, edges go from its least node to the others
(a star), are confirmed on the full sets, and joined to components. Only buckets that still hold several
components go on: to stars around two other nodes. What then remains is compared exactly: nodes of
different components that share one of their rarest shingles, as similar sets must, directly where few nodes have that
shingle, and by what they and a group's medoid differ in where many do. So no pair of a bucket that
could change the result goes unseen, and no bucket is expanded into all its pairs.

Nulls: a null text is an empty one and links with nothing. Rows without a doc_id are nodes like others and link their neighbours; they get the
least doc_id of their component, or null if it has none. Ties: rows with one doc_id and different texts are nodes of their own, each with its
component. Empty tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm import bytewise
from paceline.llm.store import Scratch, materialize, text_batches

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Most bits of the filter that tells which nodes stand in shared buckets (16 MB); for more nodes a join takes its place.
MAX_FILTER = 1 << 27
#: Further stars in each bucket that still holds several components.
PIVOTS = 2
#: A shingle of more nodes than this is common among those that are left to compare.
COMMON = 32
#: Groups of more entries than LARGE are peeled again, PEELS times at most.
LARGE, PEELS = 512, 3
#: Edges of a hub that are compared with one copy of its set.
HUB = 1000
#: Parts that the copies of one set are dealt into.
SALTS = 32
_PROBES = 64
_U = np.random.Generator(np.random.PCG64(7)).integers(0, BINS, (_PROBES, BINS))
_BAND_SALT = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of the sorted hashes s (not empty), densified."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = s[first], True
    empty = np.flatnonzero(~full)
    for u in _U:
        if not len(empty):
            return out
        at = u[empty]
        hit = full[at]
        out[empty[hit]] = out[at[hit]]
        empty = empty[~hit]
    if len(empty):  # after the random sequence, the next full bin in order
        have = np.flatnonzero(full)
        out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band, different between bands."""
    h = _BAND_SALT.copy()
    for column in sig.reshape(BANDS, ROWS).T:
        h = bytewise.mix(h * np.uint64(bytewise.BASE) + column)
    return h


def sketch(sig: np.ndarray) -> np.ndarray:
    """One mixed bit of each minimum, packed into longs."""
    bits = (bytewise.mix(sig) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(np.pad(bits, (0, -BINS % 64))).view(np.int64)


def _digests(s: np.ndarray) -> tuple[int, int]:
    a = bytewise.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = bytewise.mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytewise.utf8(batch.column("text"))
            for i, j in bytewise.chunks(offsets):
                rows = []
                for s in bytewise.shingle_sets(bytewise.Words(data, offsets[i : j + 1], lower=True), k):
                    if len(s):
                        sig = signature(s)
                        rows.append((len(s), *_digests(s), bands(sig).view(np.int64), sketch(sig)))
                    else:
                        rows.append((0, 0, 0, None, None))
                n, a, b, keys, bits = zip(*rows, strict=True)
                columns = [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, a, b)), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, bits))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sets(k: int, keep: np.ndarray | None):
    """The full sets of the documents; with keep, of those whose place in the filter is set."""
    schema = pa.schema([("node", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if keep is not None:
                ids = batch.column("doc_id")
                at = _place(ids.fill_null(0).to_numpy(), 64 * len(keep))
                batch = batch.filter(pa.array((keep[at >> 6] >> (at & 63) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)))
            data, offsets = bytewise.utf8(batch.column("text"))
            for i, j in bytewise.chunks(offsets):
                sets = list(bytewise.shingle_sets(bytewise.Words(data, offsets[i : j + 1], lower=True), k))
                a, b = zip(*map(_digests, sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    return run


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (bytewise.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, set_a, set_b, hashes of the documents whose ids nodes name, of those without an id if nodes has a null, and maybe of some others.

    Up to MAX_FILTER / 16 nodes, a filter of 16 bits or more a node goes to the scan of the texts; beyond, a join by id does.
    """
    n, named = nodes.agg(F.count("*"), F.count("node")).first()
    nodes, nameless = nodes.filter("node is not null"), docs.filter("doc_id is null")
    docs, keep = docs if named < n else docs.filter("doc_id is not null"), None
    if 16 * n > MAX_FILTER:
        docs = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        docs = docs.unionByName(nameless) if named < n else docs
    else:
        bits = 1 << max(16, (16 * n).bit_length())

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _place(batch.column(0).to_numpy(), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

        words = nodes.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        keep = np.zeros(bits // 64, np.int64)
        keep[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return text_batches(docs).mapInArrow(_sets(k, keep), "node long, set_a long, set_b long, hashes array<long>")


def _per_key(edges: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """The edges with least (of other) and n (edges) of their key, and these of each key.

    Each task sums up its own edges of a key first. A key is dealt into SALTS parts by other, and each edge meets the sum in its part.
    """
    x = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    whole = x.groupBy(key).agg(F.min(other).alias("least"), F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("bits"))
    whole = whole.select(key, "least", "n", F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("bits", i) == 1).alias("salts"))
    return x.join(whole.select(key, "least", "n", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt"), whole


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a of the distinct edges (a, b) has one edge and is no b."""
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "a").alias("outer")) for c in "ab"))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.bool_or("outer").alias("outer"), F.count("*").alias("n")).filter("outer and n > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each node of the edges (a, b): the least node that can be reached.

    Large-star and small-star steps in turn, which keep the components and end with stars around the least nodes.
    Self-loops and repeated edges do no harm. No edges: no rows.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _per_key(both, "a", "b")[0].filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        small = _per_key(large, "a", "b")[0]
        small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = scratch.table(small, "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges (a, b) with 100 * intersection >= threshold * union.

    A hub b of many edges is dealt into parts of HUB edges, with a copy of its set for each.
    """
    x, counted = _per_key(edges, "b", "a")
    parts = F.ceil(F.col("n") / HUB).cast("int")
    x = x.select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part")).join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    hubs = counted.select("b", parts.alias("parts")).join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    x = x.join(hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y"), ["b", "part"])
    both = F.size(F.array_intersect("x", "y"))
    return x.filter(100 * both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def _sorted_by_rarity(each: DataFrame, keys: list[str]) -> DataFrame:
    """keys and all, the entries of each key (element, df) as an array, rarest first; as long as one document's set."""
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("all"))


def _entries(ranked: DataFrame, length: Column) -> DataFrame:
    """A row (element, df, left) for each of the first entries of all that others have too; left: how many entries follow it, itself included."""
    first = F.slice("all", F.lit(1), F.greatest(length, F.lit(1)).cast("int"))
    found = ranked.select("*", F.posexplode(first).alias("at", "r")).filter("r.df > 1")
    return found.withColumn("left", F.size("all") - F.col("at")).select(*(c for c in ranked.columns if c != "all"), "r.element", "r.df", "left")


def _joined(entries: DataFrame, on: str, possible: Callable[[Column, Column, Column], Column], sizes: Callable[[str], Column]) -> DataFrame:
    """Pairs (a, b) of different roots in one group of on, whose sizes may meet the threshold and that pass possible.

    entries has the members of its group; large groups are dealt into parts of LARGE on one side.
    Two nodes share their first common entry in both their beginnings. There, what is left of either bounds how much they share,
    so that later common entries and most nodes that are alike by chance give no row.
    """
    columns = [c for c in entries.columns if c not in (on, "members")]
    parts = F.ceil(F.col("members") / LARGE).cast("int")
    at = {"x": F.pmod(F.xxhash64("node"), parts).cast("int"), "y": F.explode(F.sequence(F.lit(0), parts - 1))}
    x, y = (entries.select(on, at[side].alias("part"), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "xy")
    left = F.least("left_x", "left_y")
    may = (F.col("node_x") > F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & possible(left, sizes("x"), sizes("y"))
    return x.join(y, (x[on] == y[on]) & (x["part"] == y["part"]) & may).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _peeled(state: DataFrame, links: Callable[[DataFrame], DataFrame], threshold: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of the groups of state (key, node, n, items), without all pairs of a group.

    Each group's medoid m, the member with the least sum of distances, is compared with all; the ones that it links with are joined
    (links takes these edges and gives the nodes' roots). Seen from m, a node is what it and m differ in, D of size d: two nodes
    differ in as much as their D do. With s = (100 - threshold) / (100 + threshold), x and y are linked if they differ in no more
    than s * (n_x + n_y), so their D share at least h = (d_x + d_y - s * (n_x + n_y)) / 2. If m isn't linked with x, then d_y, which is at
    least d_x - s * (n_x + n_y) and at least n_y - n_m, makes h no less than (d_x - s * (n_x + n_m)) / (1 + s) > 0, whatever y is. So x needs only
    the d_x - h + 1 rarest entries of its D, and each pair that is not joined yet meets at one of them. Groups of more than LARGE
    entries go round again, with another medoid, PEELS times; what is large then is compared in parts.
    """
    down, up = 100 - threshold, 100 + threshold
    found = None
    for peel in range(PEELS):
        if state.isEmpty():
            break
        each = state.select("key", "node", F.size("items").alias("size"), F.explode("items").alias("element"))
        counts = scratch.table(each.groupBy("key", "element").agg(F.count("*").alias("c")), "counts")
        far = each.join(counts, ["key", "element"]).groupBy("key", "node", "size").agg(F.sum("c").alias("c"))
        members = state.groupBy("key").agg(F.count("*").alias("m"))
        medoids = far.join(members, "key").groupBy("key", "m").agg(F.min(F.struct(F.col("m") * F.col("size") - 2 * F.col("c"), "node"))["node"].alias("node"))
        middle = medoids.join(state, ["key", "node"]).select("key", "m", F.col("node").alias("mid"), F.col("n").alias("n_mid"), F.col("items").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        x = state.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(middle, ["key", "salt"]).drop("salt")
        x = x.withColumns({"more": F.array_except("items", "own"), "less": F.array_except("own", "items")}).drop("items", "own").withColumn("d", F.size("more") + F.size("less"))
        x = scratch.table(x.withColumn("linked", up * F.col("d") <= down * (F.col("n") + F.col("n_mid"))), "seen")
        roots = links(x.filter("linked and node <> mid").select(F.greatest("node", "mid").alias("a"), F.least("node", "mid").alias("b")))
        x = x.filter("node <> mid").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = x.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        x = x.join(several, "key", "left_semi")
        own = ["key", "node", "n", "root", "d", "m", "n_mid", "linked"]
        parts = F.explode(F.array_union(F.transform("more", lambda e: F.struct(e.alias("element"), F.lit(False).alias("absent"))), F.transform("less", lambda e: F.struct(e.alias("element"), F.lit(True).alias("absent"))))).alias("p")
        each = x.select(*own, parts).select(*own, "p.*").join(counts, ["key", "element"])
        each = each.withColumn("df", F.when(F.col("absent"), F.col("m") - F.col("c")).otherwise(F.col("c")))
        shares = F.when(F.col("linked"), 1).otherwise(F.ceil((up * F.col("d") - down * (F.col("n") + F.col("n_mid"))) / 200))
        entries = _entries(_sorted_by_rarity(each, own), F.col("d") - shares + 1)
        entries = scratch.table(entries.select(F.xxhash64("key", "element").alias("group"), F.col("key").alias("of"), "node", "n", "root", "d", "left"), "entries")
        groups = entries.groupBy("group").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
        entries = entries.join(groups.select("group", "members"), "group")
        last = peel == PEELS - 1
        now = entries if last else entries.filter(F.col("members") <= LARGE)

        def possible(left: Column, x: Column, y: Column) -> Column:
            return (100 * F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y")) & (2 * up * left >= up * (F.col("d_x") + F.col("d_y")) - (x + y))

        pairs = _joined(now.drop("of"), "group", possible, lambda side: down * F.col(f"n_{side}"))
        pairs = scratch.table(pairs, "peeled")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        again = entries.filter(F.col("members") > LARGE).select("group", "of", "node")
        x = x.select(F.col("key").alias("of"), "node", "n", F.array_union("more", "less").alias("items"))
        state = scratch.table(again.join(x, ["of", "node"]).select(F.col("group").alias("key"), "node", "n", "items"), "state")
    return found


def _remainder(nodes: DataFrame, sets: DataFrame, roots: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """The roots after each link of different components among nodes (node, root, n) is found.

    Two sets that are similar enough share one of the n - ceil(threshold % of n) + 1 rarest shingles of each; rarity is the count df
    among these nodes, ties by hash. If the rarest that they share is one that at most COMMON nodes have, they meet there. Else all that they
    share are common, so each is common for threshold % at least; such nodes are grouped by common shingles and peeled (see _peeled).
    """
    each = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("hashes").alias("element"))
    counts = each.groupBy("element").agg(F.count("*").alias("df"))
    ranked = _sorted_by_rarity(each.join(counts, "element"), ["node"])
    n = F.size("all")
    ranked = ranked.filter(100 * F.size(F.filter("all", lambda x: x["df"] > 1)) >= threshold * n)
    common = F.size(F.filter("all", lambda x: x["df"] > COMMON))
    found = _entries(ranked.withColumn("enough", 100 * common >= threshold * n), n - F.ceil(n * threshold / 100) + 1)
    found = scratch.table(found.filter((F.col("df") <= COMMON) | F.col("enough")).join(nodes.select("node", "root", "n"), "node"), "rare")
    rare = found.filter(F.col("df") <= COMMON).select("element", "node", "root", "n", "left", F.col("df").alias("members"))
    candidates = scratch.table(_joined(rare, "element", lambda left, x, y: (100 + threshold) * left >= x + y, lambda side: threshold * F.col(f"n_{side}")), "candidates")

    def joined(links: DataFrame) -> DataFrame:
        """The roots with further links; those within a component change nothing."""
        nonlocal roots
        for side in "ab":
            links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        links = links.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        links = scratch.table(links, "links")
        if not links.isEmpty():
            old = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = scratch.table(components(old.unionByName(links), scratch), "roots")
        return roots

    frequent = found.filter(F.col("df") > COMMON)
    stars = frequent.join(frequent.groupBy("element").agg(F.min("node").alias("b")), "element").select(F.col("node").alias("a"), "b")
    clusters = components(stars, scratch)
    state = scratch.table(clusters.select("node", F.col("root").alias("key")).join(nodes.select("node", "n"), "node").join(sets.select("node", F.col("hashes").alias("items")), "node"), "state")
    peeled = _peeled(state, joined, threshold, scratch)
    if peeled is not None:
        candidates = candidates.unionByName(peeled).distinct()
    return joined(_confirmed(candidates, sets, threshold))


def _roots(docs: DataFrame, firsts: DataFrame, nodes_bands: DataFrame, shared: DataFrame, k: int, threshold: int, scratch: Scratch) -> DataFrame:
    """node, root of the nodes that are linked to another."""
    # written first: as a table of known size it can be broadcast, and a hot bucket split, where the two meet
    members = scratch.table(nodes_bands.join(scratch.table(shared, "shared"), "key"), "members")
    wanted = scratch.table(firsts.select("node", "doc_id", "set_a", "set_b").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = _full_sets(docs, wanted.select(F.col("doc_id").alias("node")).distinct(), k).withColumnRenamed("node", "_id")
    sets = sets.join(wanted, (F.col("_id").eqNullSafe(F.col("doc_id"))) & (sets["set_a"] == wanted["set_a"]) & (sets["set_b"] == wanted["set_b"]))
    sets = scratch.table(sets.select("node", "hashes").dropDuplicates(["node"]), "sets")
    stars = members.filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
    roots = scratch.table(components(_confirmed(stars, sets, threshold), scratch), "roots")

    def labelled() -> DataFrame:
        """The buckets that hold several components, with what a link must meet."""
        x = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = x.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        return scratch.table(x.join(several, "key", "left_semi").join(firsts.select("node", "n", "bits"), "node"), "open")

    left = labelled()
    if left.isEmpty():
        return roots
    # stars around PIVOTS further nodes of each open bucket
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(20 + i)).alias("h"), "node")).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = left.groupBy("key").agg(*orders).select("key", F.explode(F.array_distinct(F.array(*(F.col(f"p{i}.node") for i in range(PIVOTS))))).alias("node"))
    x, y = (t.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "bits"))) for t, side in ((left, "x"), (left.join(chosen, ["key", "node"], "left_semi"), "y")))
    differ = sum((F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range((BINS + 63) // 64)), F.lit(0))
    # of BINS bits a share of (1 - J) / 2 differ; 0.275 is more than six deviations above 0.1
    may = (F.col("root_x") != F.col("root_y")) & (100 * F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y")) & ((differ <= int(BINS * ((100 - threshold) / 200 + 0.175))) | (F.least("n_x", "n_y") < 128))
    links = x.join(y, (x["key"] == y["key"]) & may).select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
    links = scratch.table(_confirmed(links, sets, threshold), "links")
    if not links.isEmpty():
        old = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = scratch.table(components(old.unionByName(links), scratch), "roots")
        left = labelled()
    return roots if left.isEmpty() else _remainder(left.drop("key").dropDuplicates(["node"]), sets, roots, threshold, scratch)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text); see the head of the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = text_batches(docs).mapInArrow(_sketches(k), "doc_id long, n long, set_a long, set_b long, keys array<long>, bits array<long>")
    sketches = materialize(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # a set is a node, named by one of its rows
    some = sketches.filter("n > 0")
    nodes = some.groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    firsts = some.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    nodes_bands = firsts.select("node", F.explode("keys").alias("key"))
    shared = nodes_bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key", "lo")
    with Scratch(docs.sparkSession) as scratch:
        roots = _roots(docs, firsts, nodes_bands, shared, k, threshold, scratch)
        least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
        linked = materialize(roots.join(least, "root").select("node", "component"), "roots")

    # copies meet their set's component by digest and salt, so that the copies of one text are spread; other documents are their own nodes
    copied = nodes.filter("copies > 1").join(linked, "node", "left").select("set_a", "set_b", F.coalesce("component", "least").alias("of_set"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b", "row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    found = found.join(copied, ["set_a", "set_b", "salt"], "left").join(linked.withColumnRenamed("node", "row"), "row", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("of_set", "component", "doc_id").alias("component_id"))
