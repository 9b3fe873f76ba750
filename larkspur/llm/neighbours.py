"""Most similar vectors for every vector: NN-descent over a neighbour graph, and greedy graph search.

The graph starts from several orders of the vectors, each by the signs of random projections: rows that
follow one another share a prefix of signs, however dense or hot their region is, and every run of rows is
compared within itself.  NN-descent then joins each node's neighbours with one another through Spark
joins until few edges change.  Vectors travel as 8-bit codes; results are scored with the full vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..storage import cut
from .links import all_pairs

#: Rows compared with one another, and sign orders that the graph starts from.
RUN, ORDERS = 4096, 8
#: The same for whole graphs, in which also vectors that nothing is near to have their nearest.
WIDE_RUN, WIDE_ORDERS = 8192, 16
SIGNS = 58
#: Chance that two rows of the least similarity that counts share a run of some order, whatever the number of rows, and that
#: similarity for graphs without a floor (about the median of the nearest of random vectors 64 wide).
MEET, WIDE_SIMILARITY = 0.99, 0.5
#: How far below an asked similarity the 8-bit codes may put a pair.
CODE_ERROR = 0.02


def usable(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``(id, key, v)``: vectors of the width that are neither null nor zero nor hold null, NaN or infinity.

    id is a 64-bit hash of the key.  Repeated rows stay; they share the id.
    """
    v = F.col(vector)
    finite = (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & ~F.exists(v, F.isnull)
    nonzero = (F.array_max(v) > 0) | (F.array_min(v) < 0)
    return vectors.where(F.col(key).isNotNull() & (F.size(v) == width) & finite & nonzero).select(F.xxhash64(key).alias("id"), F.col(key).alias("key"), v.cast("array<float>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32)


def _codes(v: np.ndarray) -> np.ndarray:
    return np.rint(v * (127 / np.abs(v).max(1, keepdims=True))).astype(np.int8)


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of codes of one width."""
    if not len(column):
        return np.empty((0, 1), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    v = np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(len(column), -1).astype(np.float32)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _best(s: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest entries of at least ``floor``."""
    n = s.shape[1]
    if floor < -1:
        full, rows, columns = np.arange(len(s)), np.empty(0, np.int64), np.empty(0, np.int64)
    else:
        flat = np.flatnonzero(s >= floor)
        rows, columns = np.divmod(flat, n)
        counts = np.bincount(rows, minlength=len(s))
        full = np.flatnonzero(counts > k)
        if len(full):
            few = counts[rows] <= k
            rows, columns = rows[few], columns[few]
    if len(full):
        top = np.argpartition(s[full] if len(full) < len(s) else s, n - k, axis=1)[:, n - k :]
        rows, columns = np.concatenate([rows, np.repeat(full, k)]), np.concatenate([columns, top.reshape(-1)])
    return rows, columns


def _above(v: np.ndarray, floor: float, k: int, tile: int = 512) -> tuple[np.ndarray, ...] | None:
    """Pairs of rows at least ``floor`` similar, each once; None where they are so many that a cut to ``k`` is due."""
    rows, columns, sims, total = [], [], [], 0
    for begin in range(0, len(v), tile):
        # What lies left of the tile was compared with it before.
        s = v[begin : begin + tile] @ v[begin:].T
        flat = np.flatnonzero(s >= floor)
        i, j = np.divmod(flat, s.shape[1])
        upper = j > i
        rows.append(i[upper] + begin)
        columns.append(j[upper] + begin)
        sims.append(s.reshape(-1)[flat[upper]])
        total += len(rows[-1])
        if total > 2 * k * len(v):
            return None
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(sims)


_EDGES = "src long, dst long, sim float"


def _edge_batch(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float32())], ["src", "dst", "sim"])


def _unrepeated(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that repeat an id and its vector."""
    order = np.argsort(ids, kind="stable")
    again = np.append(False, (ids[order[1:]] == ids[order[:-1]]) & (v[order[1:]] == v[order[:-1]]).all(1)) if len(ids) else np.zeros(0, bool)
    if not again.any():
        return ids, v
    keep = np.sort(order[~again])
    return ids[keep], v[keep]


def needed_orders(rows: int, run_rows: int, similarity: float, least: int) -> int:
    """Orders, at least ``least``, with which two rows that similar share a run with the chance ``MEET``.

    A run is cut off by about log2(rows / run_rows) signs, and a sign parts two rows in proportion to their angle.
    """
    signs = max(0.0, math.log2(max(1, rows) / run_rows))
    together = (1 - math.acos(min(1.0, max(-1.0, similarity))) / math.pi) ** signs
    if together >= MEET:
        return least
    return max(least, math.ceil(math.log(1 - MEET) / math.log1p(-together)))


def _start(points: DataFrame, width: int, k: int, floor: float, orders: int, run_rows: int) -> DataFrame:
    """Edges to each row's nearest rows of its runs."""
    # Order and signs share 63 bits.
    bits = min(SIGNS, 63 - (orders - 1).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(64).standard_normal((orders, width, SIGNS), np.float32)[:, :, :bits]
        weights = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            if not len(batch):
                continue
            ids, v = _unrepeated(batch.column(0).to_numpy(), _matrix(batch.column(1), width))
            codes = _binary(_codes(v))
            for o in range(orders):
                signs = (v @ planes[o] > 0) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(signs | np.int64(o) << np.int64(bits)), pa.array(ids), codes], ["place", "id", "q"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            if floor > -1 and (few := _above(v, floor, k)) is not None:
                rows, columns, sims = few
                keep = ids[rows] != ids[columns]
                a, b, sims = ids[rows[keep]], ids[columns[keep]], sims[keep]
                return _edge_batch(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sims, sims]))
            n = min(k, max(1, len(ids) - 1))
            repeated = len(np.unique(ids)) < len(ids)
            found = []
            for begin in range(0, len(ids), 1024):
                s = v[begin : begin + 1024] @ v.T
                s[np.arange(len(s)), begin + np.arange(len(s))] = -2  # the row itself
                if repeated:
                    s[ids[begin : begin + 1024, None] == ids[None, :]] = -2
                rows, columns = _best(s, n, max(floor, -1.5))
                found.append((ids[begin + rows], ids[columns], s[rows, columns]))
            return _edge_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

        places, ids, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.float32)
        last: tuple[np.ndarray, np.ndarray] | None = None  # the run before, of the same order
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                places = np.concatenate([places, batch.column(0).to_numpy()])
                ids = np.concatenate([ids, batch.column(1).to_numpy()])
                v = np.concatenate([v, _units(batch.column(2)).reshape(-1, width)])
                # Repeated rows follow one another; they would crowd out others.
                new = np.append(True, (places[1:] != places[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
                places, ids, v = places[new], ids[new], v[new]
            while len(ids):
                # A run stays within one order: in another the same rows come again.
                of_order = int(np.searchsorted(places >> bits, places[0] >> bits, "right"))
                if of_order >= run_rows:
                    last = ids[:run_rows], v[:run_rows]
                    yield edges(*last)
                    done = run_rows
                elif of_order < len(ids) or batch is None:
                    rest = ids[:of_order], v[:of_order]
                    if last is not None:  # filled up with rows before it
                        rest = tuple(np.concatenate([x[of_order:], y]) for x, y in zip(last, rest, strict=True))
                    yield edges(*rest)
                    last, done = None, of_order
                else:
                    break
                if done < len(ids) and places[done] >> bits != places[0] >> bits:
                    last = None
                places, ids, v = places[done:], ids[done:], v[done:]

    placed = points.select("id", "v").mapInArrow(place, "place long, id long, q binary")
    return placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").mapInArrow(compare, _EDGES)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct edges of each source."""
    distinct = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    return distinct.withColumn("r", F.expr("row_number() over (partition by src order by sim desc, dst)")).where(F.col("r") <= k).drop("r")


def _joined(near: DataFrame, k: int, floor: float, width: int) -> DataFrame:
    """Better edges among the neighbours of each node; near: ``(node, id, worst, fresh, q)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(ids: np.ndarray, worst: np.ndarray, fresh: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
            s = v @ v.T
            better = (s > worst[:, None]) & (s >= floor) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
            rows, columns = np.nonzero(better)
            return ids[rows], ids[columns], s[rows, columns]

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            nodes = table.column(0).to_numpy()
            stop = int(np.searchsorted(nodes, nodes[-1])) if len(nodes) else 0
            rest = table.slice(stop)
            if stop:
                yield from chunk(table.slice(0, stop), edges)
        if rest is not None and len(rest):
            yield from chunk(rest, edges)

    def chunk(table: pa.Table, edges) -> Iterator[pa.RecordBatch]:
        columns = table.combine_chunks()
        nodes, ids, worst, fresh = (columns.column(i).to_numpy() for i in range(4))
        v = _units(columns.column(4).combine_chunks() if columns.column(4).num_chunks != 1 else columns.column(4).chunk(0))
        starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        found = [edges(ids[a:b], worst[a:b], fresh[a:b], v[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True) if b - a > 1]
        if found:
            yield _edge_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return near.select("node", "id", "worst", "fresh", "q").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, _EDGES)


def neighbour_graph(points: DataFrame, k: int, width: int, floor: float = -1.0, orders: int = ORDERS, rounds: int = 4, run_rows: int = RUN, settled: float = 0.002) -> DataFrame:
    """``(src, dst, sim)``: about the ``k`` nearest points of each point (``id``, ``v``), with 8-bit similarities.

    Edges below ``floor`` are left out from the start.  It starts from ``orders`` orders, or as many more as the
    number of points needs.  A round joins the neighbours of each node, forward
    and backward ones, pairwise, as far as one of the two edges is new; rounds end when fewer
    than ``settled`` of the edges are new.
    """
    orders = needed_orders(points.count(), run_rows, floor if floor > -1 else WIDE_SIMILARITY, orders)
    floor -= CODE_ERROR if floor > -1 else 1
    # Of the orders of a whole graph each gives a third as many edges: together they are still several times k.
    first = k if floor > -1 else max(1, k // 3)
    graph = cut(_top(_start(points, width, first, floor, orders, run_rows), k).withColumn("fresh", F.lit(True)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(_codes(_matrix(batch.column(1), width)))], ["id", "q"])

    # Without a floor the nearer half of a node's edges is joined: farther ones rarely lead to anything nearer.
    reach = k if floor > -1 else max(2, k // 2)
    codes = points.select("id", "v").mapInArrow(coded, "id long, q binary").groupBy("id").agg(F.first("q").alias("q"))
    size = graph.count()
    for _ in range(rounds):
        back = graph.select(F.col("dst").alias("node"), F.col("src").alias("id"), "sim", "fresh")
        back = back.withColumn("r", F.expr("row_number() over (partition by node order by sim desc, id)")).where(F.col("r") <= reach).drop("r")
        ahead = graph.withColumn("r", F.expr("row_number() over (partition by src order by sim desc, dst)")).where(F.col("r") <= reach)
        both = ahead.select(F.col("src").alias("node"), F.col("dst").alias("id"), "sim", "fresh").unionByName(back)
        both = both.groupBy("node", "id").agg(F.max("fresh").alias("fresh"))
        # A node whose neighbours are all old, or that has one only, has nothing to join.
        busy = both.groupBy("node").agg(F.max("fresh").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("node")
        worst = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")).withColumnRenamed("src", "id")
        near = both.join(busy, "node", "left_semi").join(worst, "id").join(codes, "id")
        more = _joined(near, k, floor, width).join(graph.select("src", "dst"), ["src", "dst"], "left_anti")
        # An edge that was there already keeps its place as an old one.
        merged = graph.select("src", "dst", "sim", F.lit(False).alias("fresh")).unionByName(more.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("fresh", F.lit(True)))
        graph = cut(merged.withColumn("r", F.expr("row_number() over (partition by src order by sim desc, dst)")).where(F.col("r") <= k).drop("r"))
        size, new = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0))).first()
        if new <= settled * size:
            break
    return graph.select("src", "dst", "sim")


def _cosine(a: str, b: str):
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64) for c in batch.columns[2:])
            cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cosine)], ["a", "b", "similarity"])


def apart(points: DataFrame) -> DataFrame:
    """``points``, or an error where two keys share an id: one in a hundred times among half a billion keys."""
    shared = points.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    if not shared.isEmpty():
        raise EngineError("two keys have one 64-bit hash; change one of them")
    return points


def _scored(edges: DataFrame, points: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(a, b, similarity)`` of keys, with the full vectors; ``sources`` are the points that edges start from, if others."""
    kind = points.schema["key"].dataType.simpleString()
    # One row an id, so that a key repeated in a third of all rows doesn't multiply; both joins share the shuffle.
    once = points.groupBy("id").agg(F.first(F.struct("key", "v")).alias("p"))
    first = once if sources is None else sources.groupBy("id").agg(F.first(F.struct("key", "v")).alias("p"))
    a = edges.join(first.select(F.col("id").alias("src"), F.col("p").alias("pa")), "src").select("dst", F.col("pa.key").alias("a"), F.col("pa.v").alias("va"))
    both = a.join(once.select(F.col("id").alias("dst"), F.col("p").alias("pb")), "dst").select("a", F.col("pb.key").alias("b"), "va", F.col("pb.v").alias("vb")).where("a <> b")
    return both.select("a", "b", "va", "vb").mapInArrow(_exact, f"a {kind}, b {kind}, similarity double").distinct()


def mutual_neighbours(vectors: DataFrame, key: str = "hash_seq", vector: str = "embedding", width: int = 64, similarity: float = 0.9, among: int = 5, k: int = 24) -> DataFrame:
    """Pairs ``(a, b, similarity)``, ``a < b``, at least that similar and each among the other's ``among`` nearest.

    The graph's edges are those the similarity asks for, so it is built with that floor.  Keys with equal vectors
    are one node, and all of them count.  Null, zero, other-width
    and not finite vectors take no part; repeated rows of a key count once; equal similarities share the rank.
    """
    points = usable(vectors, key, vector, width).withColumn("id", F.xxhash64("v"))
    # Keys of one node are pairs only where a second hash of their vectors agrees as well.
    members = points.groupBy("key").agg(F.min_by(F.struct("id", F.xxhash64(F.lit(1), "v").alias("check")), "id").alias("m")).select("key", "m.id", "m.check")
    copies = members.groupBy("id").agg(F.count("*").alias("copies"))
    nodes = points.select("id", F.col("id").alias("key"), "v")
    graph = neighbour_graph(nodes, k, width, similarity)
    pairs = graph.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    scored = _scored(pairs, nodes).where(F.col("similarity") >= similarity)
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).join(copies.withColumnRenamed("id", "b"), "b")
    # The other copies of a node come before all else.
    own = copies.where("copies > 1").select(F.col("id").alias("b"), F.col("id").alias("a"), F.lit(1.0).alias("similarity"), F.expr("copies - 1").alias("copies"))
    counted = both.select(own.columns).unionByName(own).withColumn("upto", F.expr("sum(copies) over (partition by a order by similarity desc range between unbounded preceding and current row)"))
    ranked = counted.withColumn("r", F.expr("1 + upto - sum(copies) over (partition by a, similarity)")).where((F.col("r") <= among) & (F.col("a") != F.col("b")))
    mutual = ranked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.max("similarity").alias("similarity")).where("n = 2").drop("n")
    of_node = members.select("key", "id")
    across = mutual.join(of_node.toDF("x", "a"), "a").join(of_node.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return across.unionByName(all_pairs(members, ["id", "check"], "key").withColumn("similarity", F.lit(1.0)))


def nearest(vectors: DataFrame, key: str = "hash_seq", vector: str = "embedding", width: int = 64, k: int = 5, pool: int = 20, orders: int = WIDE_ORDERS, run_rows: int = WIDE_RUN) -> DataFrame:
    """``(key, rank, neighbour, similarity)``: the ``k`` most similar other vectors of every usable vector.

    The graph holds ``pool`` edges a node; the best by their 8-bit codes are scored with the full vectors.
    """
    points = apart(usable(vectors, key, vector, width))
    graph = neighbour_graph(points, pool, width, orders=orders, run_rows=run_rows)
    scored = _scored(_top(graph, k + 3), points)
    ranked = scored.withColumn("rank", F.expr("row_number() over (partition by a order by similarity desc, b)")).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("key"), "rank", F.col("b").alias("neighbour"), "similarity")


def search(vectors: DataFrame, queries: DataFrame, key: str = "hash_seq", vector: str = "embedding", width: int = 64, k: int = 5, pool: int = 20, beam: int = 120, rounds: int = 12, entries: int = 4096, orders: int = WIDE_ORDERS, run_rows: int = WIDE_RUN) -> DataFrame:
    """``(key, rank, neighbour, similarity)`` of each query, by greedy search over the neighbour graph.

    A search enters at the query's own node, if it is indexed, and at the nearest of at most ``entries`` fixed
    nodes; each round follows the edges of its ``beam`` best nodes so far.  It ends when none of any query's best nodes is new, at
    the latest after ``rounds``.  The query itself is no result.
    """
    spark = vectors.sparkSession
    points = apart(usable(vectors, key, vector, width))
    graph = neighbour_graph(points, pool, width, orders=orders, run_rows=run_rows)
    sources = usable(queries, key, vector, width)
    asked = sources.select(F.col("id").alias("query"), F.col("v").alias("qv")).dropDuplicates(["query"])
    gates = points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(entries).collect()  # a fixed number of rows
    table = spark.sparkContext.broadcast((np.array([g["id"] for g in gates], np.int64), np.array([g["v"] for g in gates], np.float32).reshape(len(gates), width)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = table.value
        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-30)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            q = _matrix(batch.column(1), width)
            s = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ v.T
            rows, columns = _best(s, min(beam, len(ids)), -2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids[columns]), pa.array(s[rows, columns], pa.float32())], ["query", "node", "sim"])

    own = asked.select("query", F.col("query").alias("node"), F.lit(1.0).cast("float").alias("sim"))
    reached = cut(asked.mapInArrow(enter, "query long, node long, sim float").unionByName(own).groupBy("query", "node").agg(F.max("sim").alias("sim")).withColumn("open", F.lit(True)))
    vectors_by_id = points.groupBy(F.col("id").alias("node")).agg(F.first("v").alias("v"))
    for _ in range(rounds):
        steps = reached.where("open").join(graph.select(F.col("src").alias("node"), "dst"), "node").select("query", F.col("dst").alias("node")).distinct()
        steps = steps.join(reached.select("query", "node"), ["query", "node"], "left_anti")
        scored = steps.join(vectors_by_id, "node").join(asked, "query").groupBy("query", "node").agg(F.max(_cosine("v", "qv")).cast("float").alias("sim"))
        merged = reached.withColumn("open", F.lit(False)).unionByName(scored.withColumn("open", F.lit(True)))
        reached = cut(merged.withColumn("r", F.expr("row_number() over (partition by query order by sim desc, node)")).where(F.col("r") <= beam).drop("r"))
        if reached.where("open").limit(1).count() == 0:
            break
    best = _scored(reached.where("query <> node").select(F.col("query").alias("src"), F.col("node").alias("dst")), points, sources)
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by a order by similarity desc, b)")).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("key"), "rank", F.col("b").alias("neighbour"), "similarity")
