"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each document's set of word shingles gives its size, a digest, and HASHES minima. Equal sets (exact copies among
   them) become one class with a number of its own; everything below works on classes, so ids may repeat.
2. The forest: TREES sorted orders of the signatures, each by DEPTH minima of its own. Classes that share a prefix of
   an order are a region. Its depth adapts: a region of more than REGION classes at LEAST_DEPTH minima is taken one
   minimum deeper, again and again, so that dense parts of an order are cut finer than sparse ones. Within a region
   classes stand in the order of their remaining minima; each is compared by a 2-bit sketch of all minima with the
   neighbours of the longest common prefixes, and in regions of over LAGS + 1 with the others too.
   What is still larger at DEPTH minima shares so much that it is one candidate group as a whole, without comparison.
3. Components of these candidates are clusters. A cluster's full sets are compared in one task if it has up to CLUSTER
   classes. A larger one is divided into blocks; blocks are first compared in themselves, then sketches of classes from
   different components, and then the full sets of those that may be similar. Pairs that are already connected need no
   comparison, so a large group of copies costs as many comparisons as it has classes.

At a similarity of exactly 0.8 a pair shares no region of LEAST_DEPTH with probability (1 - 0.8**3)**20 = 6e-7; if all
its regions were dense and taken to DEPTH, with probability (1 - 0.8**6)**20 = 2e-3, unless they stay dense there. Links
above that are lost less often, and a document of several links is found by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, map_batches, shared
from tessella.llm.components import components, root

HASHES, TREES, DEPTH, LEAST_DEPTH = 128, 20, 6, 3
REGION, CLUSTER, LAGS = 2048, 256, 7
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 1_000_000
WORDS_KEPT = 300_000
#: Sketch positions of HASHES that must agree. Pairs of similarity 0.8 agree in 0.85 of them; 80 lies 7 deviations lower.
AGREE = 80

_R = np.random.Generator(np.random.PCG64(20))
SEEDS = _R.integers(0, 2**64, HASHES, np.uint64)
FACTORS = _R.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of a text's distinct shingles of `size` words, ASCII letters in lower case."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash = size, xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode().lower().split()  # bytes: ASCII letters, ASCII white space
        if not ws:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = self.hash(w)
            h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        acc = np.full(n, k, np.uint64)  # a shorter sequence is a shingle of another kind
        for i in range(k):
            acc = scramble(acc ^ h[i : i + n])
        return np.unique(acc)


def minima(sh: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, of a non-empty set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(sh), 1024):
        part = sh[i : i + 1024, None] ^ SEEDS
        part *= FACTORS
        part >>= np.uint64(32)
        np.minimum(out, part.min(0), out=out)
    return out.astype(np.uint32)


def sketch(m: np.ndarray) -> bytes:
    """The lowest two bits of each minimum."""
    two = (m & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def digest(sh: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(sh.tobytes())


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id, n, digest, sketch, minima); the last three are null for a document without words."""

    def make():
        shingles = Shingler(size)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ns, ds, ks, ms = [], [], [], []
            for t in b.column(1).to_pylist():
                sh = shingles(t)
                ns.append(len(sh))
                m = minima(sh) if len(sh) else None
                ds.append(None if m is None else digest(sh))
                ks.append(None if m is None else sketch(m))
                ms.append(None if m is None else m[: TREES * DEPTH].astype(">u4").tobytes())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *(pa.array(x, pa.binary()) for x in (ds, ks, ms))], names=["id", "n", "digest", "sketch", "minima"])

        return batch

    return map_batches(df.select(F.col(id_col).cast("long"), F.col(text_col)), make, "id long, n long, digest binary, sketch binary, minima binary")


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches cut only where the value of the key column changes, so equal keys never span two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(starts):
            yield pa.Table.from_batches([*held, b.slice(0, starts[-1])]).combine_chunks().to_batches()[0]
            held = [b.slice(starts[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal positions of two arrays of sketches."""
    d = x ^ y
    d = (d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return HASHES - np.bitwise_count(d).sum(-1, dtype=np.int64)


def may_link(n: np.ndarray, s: np.ndarray, i, j, percent: int) -> np.ndarray:
    a, b = n[i], n[j]
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (agreeing(s[i], s[j]) >= AGREE)


def region_candidates(percent: int):
    """Candidate edges from rows (region, key, node, n, sketch), sorted by region and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            region = b.column(0).to_numpy(zero_copy_only=False)
            ids, n = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            s = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(ids), -1)
            left, right = [], []
            for lag in range(1, min(LAGS, len(ids) - 1) + 1):  # all pairs of small regions, neighbours of large ones
                at = np.flatnonzero(region[lag:] == region[:-lag])
                at = at[may_link(n, s, at, at + lag, percent)]
                left.append(ids[at])
                right.append(ids[at + lag])
            edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo > LAGS + 1:
                    tree: dict[int, int] = {}
                    for i in range(lo, hi - 1):
                        at = np.arange(i + 1, hi)
                        at = at[may_link(n, s, i, at, percent)]
                        for x in ids[at].tolist():
                            rx, ry = root(tree, x), root(tree, int(ids[i]))
                            if rx != ry:
                                tree[max(rx, ry)] = min(rx, ry)
                    pairs = [(x, r) for x in tree if (r := root(tree, x)) != x]
                    left.append(np.array([x for x, _ in pairs], np.int64))
                    right.append(np.array([y for _, y in pairs], np.int64))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (region, key, node, n, sketch) of every class in every order, the region by the least depth at which it has
    up to REGION classes; and rows (region, node) of regions that have more at DEPTH, if there are any."""
    width = 4 * DEPTH
    orders = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("minima"), t * width + 1, F.lit(width)))).alias("tree", "order")
    open_rows = reps.select("node", "n", "sketch", orders)
    done = None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        rows = open_rows.withColumn("region", F.xxhash64("tree", F.lit(depth), F.substring("order", 1, 4 * depth)))
        dense = shared(rows.groupBy("region").agg(F.count("*").alias("in_region")).filter(F.col("in_region") > REGION).select("region"))
        n_dense = dense.count()
        hint = bounded_broadcast(dense, n_dense, BROADCAST_ROWS)
        fits = rows.join(hint, "region", "left_anti") if n_dense else rows
        fits = fits.select("region", F.substring("order", 4 * depth + 1, width).alias("key"), "node", "n", "sketch")
        done = fits if done is None else done.unionByName(fits)
        if not n_dense:
            return done, None
        open_rows = rows.join(hint, "region", "left_semi")
    return done, open_rows.select("region", "node")


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all classes which share a region and whose sketches allow the similarity."""
    rows, dense = forest(reps)
    dealt = rows.repartition(F.col("region")).sortWithinPartitions("region", "key", "node")
    edges = dealt.mapInArrow(region_candidates(percent), "a long, b long")
    if dense is None:
        return edges
    first = dense.groupBy("region").agg(F.min("node").alias("b"))  # as many rows as regions
    first = shared(first)
    star = dense.join(bounded_broadcast(first, first.count(), BROADCAST_ROWS), "region").filter("node <> b").select(F.col("node").alias("a"), "b")
    return edges.unionByName(star)


def across(percent: int):
    """Rows (unit, node) that may be linked with a node of another part, from rows (unit, node, n, sketch, part), sorted
    by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            unit, node, n, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            s = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(len(unit), -1)
            edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
            hit = np.zeros(len(unit), bool)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                for i in range(lo, hi - 1):
                    at = np.arange(i + 1, hi)
                    at = at[part[at] != part[i]]
                    at = at[may_link(n, s, i, at, percent)]
                    hit[at] = True
                    hit[i] |= len(at) > 0
            yield pa.RecordBatch.from_arrays([pa.array(unit[hit]), pa.array(node[hit])], names=["unit", "node"])

    return run


def confirm(size: int, percent: int):
    """True links from rows (unit, node, digest, text), sorted by unit; enough of them to connect what is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in runs(batches):
            units, nodes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
            found: list[tuple[int, int]] = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sets: dict[int, np.ndarray] = {}
                for i in range(lo, hi):
                    if nodes[i] not in sets:
                        sh = shingles(b.column(3)[i].as_py())
                        if digest(sh) == b.column(2)[i].as_py():  # not another text of the same id
                            sets[nodes[i]] = sh
                found += links(sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def links(arrays: dict[int, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph whose edges are pairs of sets with 100 * |intersection| >= percent * |union|."""
    order = sorted(arrays, key=lambda x: (len(arrays[x]), x))
    sets = {x: frozenset(v.tolist()) for x, v in arrays.items()}
    parent: dict[int, int] = {}
    found = []
    for j, y in enumerate(order):
        sy = sets[y]
        ry = root(parent, y)
        for i in range(j - 1, -1, -1):
            x = order[i]
            sx = sets[x]
            if 100 * len(sx) < percent * len(sy):
                break
            rx = root(parent, x)
            if rx != ry:
                both = len(sx & sy)
                if 100 * both >= percent * (len(sx) + len(sy) - both):
                    found.append((x, y))
                    parent[max(rx, ry)] = ry = min(rx, ry)
    return found


def grouped(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, digest) of all rows of `df`, and rows (set, first, component, least) of all classes: the class's
    digest and least id, its component's number and least id."""
    sigs = shared(signatures(df, id_col, text_col, size))
    classes = sigs.filter("id is not null and n > 0").groupBy("digest").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "sketch", "minima")))
    reps = shared(classes.withColumn("node", F.monotonically_increasing_id()))
    clusters = components(candidates(reps, percent))
    inside = shared(clusters.withColumnRenamed("component", "cluster").join(reps.select("node", "id", "digest", "n", "sketch"), "node"))
    sizes = shared(inside.groupBy("cluster").agg(F.count("*").alias("in_cluster")).filter(F.col("in_cluster") > CLUSTER))
    n_large = sizes.count()
    sized = inside.join(bounded_broadcast(sizes, n_large, BROADCAST_ROWS), "cluster", "left").drop("n", "sketch")
    texts = shared(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sized, "id").select("node", "digest", "cluster", "in_cluster", "text"))

    again = texts.groupBy("node").agg(F.count("*").alias("rows")).filter("rows > 1")
    if again.limit(1).count():  # rows that repeat an id: one of equal ones is enough
        texts = shared(texts.groupBy("node", "digest", "cluster", "in_cluster", F.md5("text").alias("same")).agg(F.first("text").alias("text")).drop("same"))

    def verified(units: DataFrame) -> DataFrame:
        return units.select("unit", "node", "digest", "text").repartition(F.col("unit")).sortWithinPartitions("unit", "node").mapInArrow(confirm(size, percent), "a long, b long")

    few = F.col("in_cluster").isNull()
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("in_cluster") / CLUSTER))
    true = shared(verified(texts.withColumn("unit", F.when(few, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", block)))))
    if n_large:
        part = components(true)
        hint = bounded_broadcast(sizes, n_large, BROADCAST_ROWS)
        large = inside.join(hint, "cluster").select("node", "cluster", "n", "sketch")
        held = shared(large.join(part, "node", "left").select("node", "cluster", "n", "sketch", F.coalesce("component", "node").alias("part")))
        by_part = shared(held.groupBy("cluster", "part").agg(F.count("*").alias("in_part")).filter(F.col("in_part") >= CLUSTER // 2))
        loose = shared(held.join(bounded_broadcast(by_part, by_part.count(), BROADCAST_ROWS), ["cluster", "part"], "left_anti").groupBy("cluster").agg(F.count("*").alias("loose")))
        own = F.col("in_part").isNotNull()
        held = held.join(bounded_broadcast(by_part, by_part.count(), BROADCAST_ROWS), ["cluster", "part"], "left").join(bounded_broadcast(loose, loose.count(), BROADCAST_ROWS), "cluster", "left")
        held = held.select("node", "n", "sketch", "cluster", "part", F.when(own, F.col("part")).alias("only"), F.when(own, F.xxhash64("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_part") / CLUSTER)))).otherwise(F.xxhash64(F.lit("loose"), F.pmod(F.xxhash64("part"), F.ceil(F.col("loose") / CLUSTER)))).alias("block"))
        held = shared(held)
        blocks = held.select("cluster", "block", "only").distinct()
        x, y = blocks.alias("x"), blocks.alias("y")
        pairs = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block"))).filter("x.only is null or y.only is null or x.only <> y.only")
        units = pairs.select(F.col("x.cluster").alias("cluster"), F.xxhash64("x.cluster", "x.block", "y.block").alias("unit"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
        slim = units.join(held, ["cluster", "block"]).select("unit", "node", "n", "sketch", "part")
        near = shared(slim.repartition(F.col("unit")).sortWithinPartitions("unit", "node").mapInArrow(across(percent), "unit long, node long"))
        true = true.unionByName(verified(near.join(texts.select("node", "digest", "text"), "node")))
    final = shared(components(true))
    least = shared(final.join(reps.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least")))
    linked = reps.select("node", F.col("digest").alias("set"), F.col("id").alias("first")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = linked.join(bounded_broadcast(least, least.count(), BROADCAST_ROWS), "component", "left")
    return sigs.select("id", "n", "digest"), shared(linked.select("set", "first", "component", F.coalesce("least", "first").alias("least")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of `df`.

    Documents are linked whose sets of distinct `size`-word shingles have 100 * |intersection| >= percent * |union|; a
    text of fewer words is one shingle; a null text or one without words has none and is linked with nothing.
    component_id is the least id reachable over links, `kept` whether it is the row's own. Rows are linked by their texts
    alone: repeated rows share id and component, and texts under one repeated id each have their own links. Rows with
    a null id are never linked, their component is null and they are kept. An empty table gives an empty result; columns
    other than id and text are not read.
    """
    sigs, classes = grouped(df, id_col, text_col, size, percent)
    out = sigs.join(classes.select("set", "least"), (F.col("digest") == F.col("set")) & F.col("id").isNotNull(), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df`, with its columns, of which one document of each group of near-duplicates stays: the one of the
    least id (of several texts under that id, the one of the least hash). Of equal rows in a group one stays, so a group
    is never left with two rows nor without one. Rows without words or with a null id are in no group and all stay. An
    empty table gives an empty result.
    """
    mine = df.columns
    sigs, classes = grouped(df, id_col, text_col, size, percent)
    best = classes.groupBy("component").agg(F.min(F.struct("first", "set")).alias("b")).select(F.col("b.set").alias("set"), F.col("b.first").alias("first"))
    named = sigs.filter("id is not null and digest is not null").join(best, (F.col("digest") == F.col("set")) & (F.col("id") == F.col("first")), "left")
    # ids alone go to the texts, so that texts are not shuffled for them
    by_id = named.groupBy("id").agg(F.count("*").alias("rows"), F.count("set").alias("good"))
    special = shared(by_id.filter("rows > 1 or good = 0").select(F.col("id").alias("_nd_id"), (F.col("good") > 0).alias("_nd_any")))
    d = df.withColumnsRenamed({c: f"_nd_own{i}" for i, c in enumerate(mine)})
    ids, text = (F.col(f"_nd_own{mine.index(c)}") for c in (id_col, text_col))
    back = lambda x: x.select([F.col(f"_nd_own{i}").alias(c) for i, c in enumerate(mine)])
    d = d.join(bounded_broadcast(special, special.count(), BROADCAST_IDS), ids.cast("long") == F.col("_nd_id"), "left")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = d.filter(F.col("_nd_id").isNull() | blank)
    again = d.filter(F.col("_nd_any") & ~blank)  # several rows of one id: their texts decide
    return back(once).unionByName(back(chosen(again, f"_nd_own{mine.index(id_col)}", f"_nd_own{mine.index(text_col)}", best, size)))


def chosen(d: DataFrame, id_col: str, text_col: str, best: DataFrame, size: int) -> DataFrame:
    """One row of `d` for each (set, first) of `best` that has any."""
    at = d.columns.index(text_col)

    def make():
        shingles = Shingler(size)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [digest(shingles(t)) for t in b.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(sets, pa.binary())], names=[*b.schema.names, "_nd_set"])

        return batch

    hashed = map_batches(d, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", _nd_set binary")
    met = hashed.join(best, (F.col("_nd_set") == F.col("set")) & (F.col(id_col).cast("long") == F.col("first")), "left_semi")
    return met.dropDuplicates([id_col, "_nd_set"])


#: Brute force over all pairs that share a shingle, and components by a recursive walk, in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), x AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS MATERIALIZED (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) AS c ON c.node = s.doc_id
"""
