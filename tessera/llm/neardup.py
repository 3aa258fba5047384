"""Near-duplicate documents by SetSketch registers, joint estimation and exact confirmation.

Every document is the set of its word shingles.  Its sketch has ``registers``
minima of exponential variables, kept as exponentially spaced truncated levels;
sketches of unions are register-wise maxima of levels, and equal levels mean
similar sets.  Bands of registers find candidates.

1. Equal sets become one node; its number is the smallest doc_id.
2. In each band, nodes with equal registers are tied to the bucket's smallest
   node.  Ties form clusters, found by label propagation: all candidate pairs
   lie inside a cluster.  No pairs of a bucket are ever written out.
3. Pairs of a cluster are estimated jointly by likelihood from their registers and
   sizes; where the estimate allows the similarity, full sets are compared.  A
   cluster of at most ``cluster_docs`` nodes is confirmed in one task.
4. A larger cluster is confirmed across tasks.  All its nodes meet a few pivots in
   the same way; nodes outside the cluster's largest component then meet all the
   cluster's nodes, in blocks of an inverted index over full sets.
5. Confirmed links form components, by label propagation again.

Defined cases: documents without words (null, empty, white space) have an empty
set and no links; with fewer words than a shingle the whole sequence is the one
shingle; repeated rows are equal sets; an empty table gives no rows; rows that
share an id are one document; a null id has a row and links with no other; very
long texts are sets like others, one at a time in memory; of equal sets the
smallest id stands for all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import Sieve, drop, partitions, table, whole_texts
from tessera.llm.textkit import BY_SPACE, Words, batches, mix, slices, splitmix, texts_of

#: SetSketch parameters: base of the levels and their count.
BASE, LEVELS = 1.001, (1 << 16) - 2


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    weights = splitmix(99, size) | np.uint64(1)
    for a, b in slices(texts):
        words = Words(texts[a:b], BY_SPACE)
        h = words.hashes()
        for i in range(b - a):
            own = h[words.first[i] : words.first[i + 1]]
            n = len(own)
            if n >= size:
                total = own[: n - size + 1] * weights[0]
                for k in range(1, size):
                    total = total + own[k : n - size + 1 + k] * weights[k]
                out.append(np.unique(mix(total)))
            elif n:
                # a short sequence must not equal the sum of another length
                out.append(mix((own * weights[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Sketcher:
    """Register levels of shingle sets."""

    def __init__(self, registers: int) -> None:
        self.factors = splitmix(4242, registers) | np.uint64(1)
        self.registers = registers

    def levels(self, s: np.ndarray) -> np.ndarray:
        """max over the set of floor(1 - log_b x), x exponential: the truncated level of each register's minimum."""
        least = np.full(self.registers, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            np.minimum(least, np.multiply.outer(self.factors, s[i : i + 1024]).min(1), out=least)
        x = -np.log1p(-np.minimum((least.astype(float) + 0.5) / 2.0**64, 1 - 1e-16))
        # the rate puts sets of one up to billions of shingles between the first and the last level
        return np.clip(np.floor(1 - np.log(x / 20) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def estimates(mine: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood estimates of the Jaccard similarity of a set with others, all of known sizes.

    Of all registers, those where mine is above, the other is above, and the
    equal ones are counted.  With u and v the sets' shares of their sizes' sum, a
    register is above with p(u - v J), below with p(v - u J), equal with p(J), so
    the likelihood's maximum in J is the lesser root of a quadratic equation.
    """
    above, below = (mine > others).sum(1), (mine < others).sum(1)
    m = len(mine)
    equal = m - above - below
    u = n / (n + sizes)
    v = 1 - u
    b = equal * (u * u + v * v) + above * v * v + below * u * u
    root = np.sqrt(np.maximum(b * b - 4 * (u * v) ** 2 * m * equal, 0))
    return np.clip((b - root) / (2 * u * v * m), 0, np.minimum(u / v, v / u))


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    return float(estimates(a, b[None, :], na, np.array([nb], float))[0])


def possible(estimated: np.ndarray, percent: int, registers: int) -> np.ndarray:
    """Which estimates allow the similarity: those less than six deviations under it; from 64 registers on."""
    return estimated >= (percent / 100 - 6 * (0.25 / registers) ** 0.5 if registers >= 64 else -1.0)


def sketches(df: DataFrame, size: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set digest (s1, s2) and the bands' keys."""
    schema = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands * rows)
        weights = splitmix(777, rows) | np.uint64(1)
        for batch in batches(source):
            n, s1, s2, keys = [], [], [], []
            for s in shingles(texts_of(batch.column(1)), size):
                n.append(len(s))
                s1.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                s2.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                keys.append(mix((sketcher.levels(s).astype(np.uint64).reshape(bands, rows) * weights).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return whole_texts(df).select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the nodes of undirected edges (a, b).

    Each round takes the smallest label of all neighbours, then that label's
    own; hot nodes are met in joins that split, and labels are minima that
    combine before they move.  Each round is written, so lost executors cost
    one round.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    # all neighbours of a node are tied to the least of them and itself instead of to the node: as connected,
    # and where nodes share neighbours these are far fewer ties
    least = table(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("least")))
    closer = both.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))).distinct()
    first, both = both, table(closer.union(closer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    drop(first)
    drop(least)
    labels = table(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard")).withColumnRenamed("a", "node")
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("new"))
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = table(lower.join(jump, "new", "left").select("node", F.least("new", "far").alias("new"), "label"))
        moved = after.where("new < label").limit(1).count()
        drop(labels)
        labels = after.select("node", F.col("new").alias("label"))
        if not moved:
            drop(both)
            return labels.withColumnRenamed("label", "component")


def linked(inter: int | np.ndarray, na: int, nb: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def confirm(nodes: list[int], sets: list[np.ndarray], percent: int, registers: int = 200) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of a small cluster.

    Pairs whose sizes and whose joint estimate allow the similarity are compared
    as full sets, likelier ones first, unless links found before join them.
    """
    order = sorted(range(len(nodes)), key=lambda i: len(sets[i]))
    sketcher = Sketcher(registers)
    levels = np.stack([sketcher.levels(sets[i]) for i in order]) if order else np.zeros((0, registers), np.uint16)
    sizes = np.array([len(sets[i]) for i in order])
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for k, i in enumerate(order):
        low = int(np.searchsorted(100 * sizes[:k], percent * int(sizes[k]), "left"))
        if low == k:
            continue
        guess = estimates(levels[k], levels[low:k], int(sizes[k]), sizes[low:k].astype(float))
        some = np.flatnonzero(possible(guess, percent, registers))
        for j in (some[np.argsort(-guess[some], kind="stable")] + low).tolist():
            a, b = find(k), find(j)
            if a != b and linked(common(sets[i], sets[order[j]]), int(sizes[k]), int(sizes[j]), percent):
                root[a] = b
                out.append((nodes[i], nodes[order[j]]))
    return out


def links(df: DataFrame, shingle: int = 4, percent: int = 80, bands: int = 40, rows: int = 5, cluster_docs: int = 500, cluster_shingles: int = 1_000_000, pivots: int = 24, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with their sets' digests (written), and links (a, b) that span all components of nodes.

    The chance to miss a pair at the least similarity is (1 - 0.8 ** rows) **
    bands, 1e-7 for the defaults, and less for likelier pairs.
    """
    spark = df.sparkSession
    docs = table(sketches(df, shingle, bands, rows, doc_id, text))
    nodes = docs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = nodes.where("node is not null").select("node", F.explode("bands").alias("key"))
    # written, so that the join below has plain inputs, which Spark can split where a bucket is hot
    hubs = table(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    ties = table(banded.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    empty = spark.createDataFrame([], "a bigint, b bigint")
    if ties.isEmpty():
        return docs, empty
    clusters = components(ties)
    members = table(clusters.join(docs.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n")), "node"))
    sizes = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    is_big = (F.col("docs") > cluster_docs) | (F.col("weight") > cluster_shingles)
    big = table(sizes.where(is_big).select("component"))
    # the texts of clustered documents only, once: the others are sieved out before anything is shuffled
    named = df.select(df[doc_id].cast("bigint").alias("node"), df[text].alias("text"))
    texts = table(members.select("node", "component").join(Sieve(members, "node").passed(named, F.col("node")), "node"))
    small = texts.join(sizes.where(~is_big).select("component"), "component")

    def per_cluster(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        for batch in group:
            ids += batch.column(0).to_pylist()
            sets += shingles(texts_of(batch.column(1)), shingle)
        pairs = confirm(ids, sets, percent, bands * rows)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = small.select("node", "text", "component").groupBy("component").applyInArrow(_grouped(per_cluster), "a bigint, b bigint")
    if not big.isEmpty():
        found = table(found).union(_large(texts.join(big, "component"), shingle, percent, bands * rows, pivots))
    return docs, table(found)


def _grouped(f):
    """A function of a whole group as one of its rows, in the form applyInArrow takes."""

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(f((), iter(group.select(["node", "text"]).combine_chunks().to_batches())))

    return run


#: Bytes of pivot texts that are broadcast; more go with a join.
PIVOT_BYTES = 64 << 20


def _large(texts: DataFrame, shingle: int, percent: int, registers: int, pivots: int) -> DataFrame:
    """Links that span the components inside large clusters, with no task that needs a whole cluster."""
    whole = table(texts.select("node", "component", "text"))
    done: DataFrame | None = None
    for _ in range(2):
        if done is None:
            source = whole.withColumn("rank", F.xxhash64("node"))
        else:
            # the nodes that met the most pivots are central
            met = done.groupBy(F.col("a").alias("node")).agg(F.max("met").alias("met"))
            source = whole.join(met, "node").withColumn("rank", -F.col("met"))
        # one pivot for each of `pivots` slots: minima, which combine before they move
        picked = source.groupBy("component", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(pivots)).alias("slot")).agg(F.min(F.struct("rank", "node")).alias("p")).select("component", F.col("p.node").alias("node"))
        chosen = table(whole.join(picked, ["component", "node"]).groupBy("component").agg(F.collect_list(F.struct("node", "text")).alias("pivots")))
        links_ = table(_meet(whole, chosen, shingle, percent, registers))
        done = links_ if done is None else done.union(links_)
    done = done.select("a", "b")
    joined = components(done.union(whole.select("node", F.col("node").alias("b"))))
    state = table(whole.select("node", F.col("component").alias("cluster")).join(joined, "node"))
    sizes = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("m")).select("cluster", F.col("m.component").alias("largest"))
    rest = table(state.join(largest, "cluster").where("component <> largest").select("node", "component").join(whole.select("node", F.col("component").alias("cluster"), "text"), "node"))
    return done.union(table(_left_over(whole.join(joined.withColumnRenamed("component", "own"), "node"), rest, shingle, percent)))


#: Bytes of texts outside that make an index, and of members that stream through it in one place.
INDEX_BYTES, STREAM_BYTES = 4 << 20, 64 << 20


def _left_over(members: DataFrame, rest: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Exact links of nodes outside their cluster's largest component with all the cluster's nodes of other components.

    A cluster's nodes outside are dealt to blocks, its members to streams, both
    of bounded bytes; each (block, stream) is a place where the block's texts,
    which come first, form an inverted index over full sets and the members
    stream through it.  Places are partitioned like any other rows: nothing
    goes through the driver, and only links come out.
    """
    size = lambda name: F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias(name)
    pieces = lambda c, most: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    asked = rest.groupBy("cluster").agg(size("r")).join(members.groupBy(F.col("component").alias("cluster")).agg(size("m")), "cluster")
    grid = table(asked.select("cluster", pieces("r", INDEX_BYTES).alias("blocks"), pieces("m", STREAM_BYTES).alias("streams")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    index = rest.join(grid, "cluster").select("cluster", place(5, "blocks").alias("block"), spread("streams").alias("stream"), F.lit(0).alias("kind"), "node", F.col("component").alias("own"), "text")
    flow = members.withColumnRenamed("component", "cluster").join(grid, "cluster").select("cluster", spread("blocks").alias("block"), place(6, "streams").alias("stream"), F.lit(1).alias("kind"), "node", "own", "text")
    dealt = index.union(flow).repartition(partitions(rest.sparkSession), "cluster", "block", "stream").sortWithinPartitions("cluster", "block", "stream", "kind")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, listed, built = None, [], None
        for batch in batches(source):
            a, b = [], []
            places = zip(*(batch.column(i).to_pylist() for i in range(3)))
            kinds, ids, owns = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for at, kind, node, own, s in zip(places, kinds, ids, owns, shingles(texts_of(batch.column(6)), shingle)):
                if at != here:
                    here, listed, built = at, [], None
                if not kind:
                    listed.append((node, own, s))
                    continue
                if built is None:
                    values, owner = np.concatenate([x[2] for x in listed]), np.repeat(np.arange(len(listed)), [len(x[2]) for x in listed])
                    order = np.argsort(values, kind="stable")
                    built = (np.array([x[0] for x in listed]), np.array([x[1] for x in listed]), np.array([len(x[2]) for x in listed]), values[order], owner[order])
                    listed = []
                nodes, components_, sizes, values, owner = built
                left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = right - left
                found = np.bincount(owner[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(nodes))
                hit = np.flatnonzero(linked(found, len(s), sizes, percent) & (components_ != own))
                # one link to each other component is enough
                hit = hit[np.unique(components_[hit], return_index=True)[1]]
                a += [node] * len(hit)
                b += nodes[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _meet(whole: DataFrame, pivots: DataFrame, shingle: int, percent: int, registers: int) -> DataFrame:
    """Links of all nodes with their cluster's pivots: estimated on sketches, then confirmed on full sets."""
    size = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.octet_length(p["text"]), F.lit(0))))).first()[0] or 0
    sent = None
    if size <= PIVOT_BYTES:
        sent = whole.sparkSession.sparkContext.broadcast({r.component: [(p.node, p.text) for p in r.pivots] for r in pivots.collect()})  # at most PIVOT_BYTES

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(registers)
        known: dict[int, tuple] = {}
        for batch in batches(source):
            a, b, met = [], [], []
            sets = shingles(texts_of(batch.column(1)), shingle)
            for r, (node, s, cluster) in enumerate(zip(batch.column(0).to_pylist(), sets, batch.column(2).to_pylist())):
                if cluster not in known:
                    if len(known) > 8:
                        known.clear()
                    listed = sent.value.get(cluster, []) if sent else [(p["node"], p["text"]) for p in batch.column(3)[r].as_py()]
                    ps = shingles([(t or "").encode() for _, t in listed], shingle)
                    ids = [n for n, _ in listed]
                    root = {n: n for n in ids}
                    for x, y in confirm(ids, ps, percent, registers) if ids else []:  # a forest: pivots that are linked need one link from a node
                        old, new = root[x], root[y]
                        root = {n: new if g == old else g for n, g in root.items()}
                    known[cluster] = (ids, ps, np.array([sketcher.levels(p) for p in ps], np.uint16).reshape(len(ps), registers), np.array([len(p) for p in ps], float), root)
                hits: dict[int, int] = {}
                n_met = 0
                ids, ps, levels, sizes, root = known[cluster]
                near = (np.minimum(sizes, len(s)) * 100 >= percent * np.maximum(sizes, len(s))) & possible(estimates(sketcher.levels(s), levels, len(s), sizes), percent, registers)
                for i in np.flatnonzero(near).tolist():
                    node_p, p = ids[i], ps[i]
                    if linked(common(s, p), len(s), len(p), percent):
                        n_met += 1
                        if node_p != node:
                            hits.setdefault(root[node_p], node_p)
                if node in root:  # a pivot's own links to its component's first pivot hold that component together
                    hits |= {root[node]: root[node]} if root[node] != node else {}
                a += [node] * len(hits)
                b += hits.values()
                met += [n_met] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, met)], names=["a", "b", "met"])

    rows = whole.select("node", "text", "component")
    rows = rows if sent else rows.join(pivots, "component").select("node", "text", "component", "pivots")
    return rows.mapInArrow(run, "a bigint, b bigint, met bigint")


def near_duplicates(df: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    docs, found = links(df, **options)
    nodes = docs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    far = components(found) if not found.isEmpty() else None
    named = nodes.join(far, "node", "left") if far is not None else nodes.withColumn("component", F.lit(None).cast("bigint"))
    # written, so that the join below has plain inputs, which Spark can split where a set has very many copies
    named = table(named.select("s1", "s2", F.coalesce("component", "node").alias("component")))
    out = docs.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)))
