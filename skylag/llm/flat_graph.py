"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are dealt to the cells nearest to them (centroids of a bounded sample; overlapping),
split by label, and every shard gets a graph of bounded degree: candidates near each node
and a few far ones, pruned robustly (a candidate goes when a chosen neighbour is closer to
it by the factor ALPHA). Adjacency lists of a node from all its shards are united. Every vector then
searches its home shard: greedy from the medoid with a beam, then expanding over all nodes
in range. What is found is verified by cosine in double precision. An audit compares a
bounded sample of vectors with brute force over all rows: the share of pairs of different vectors that
were found, on average over the sampled vectors that have such a pair. The sample grows until
AUDITED of them have one, or it reaches MOST_AUDITED vectors. If the recall is too low, the overlap is
doubled and the search repeated.

Crowded shards are split again by centroids of their own, level by level, while that at
least halves the work. What stays crowded is a clump whose vectors are all near each other:
it is cut into shares, and every pair of shares is a graph of its own in which vectors look
for those of the other share. So no group of a task grows with the input; the number of
links that are counted in a clump does, with its square.

Equal vectors of one label are one node with a count. Links are counted where they are
found, and a spanning forest per shard goes on to the components: pairs are never written
out.

Vectors that are null, zero or empty, hold a null or non-finite component or have no label link with
nothing; neither do vectors of different lengths. Repeated rows are other vectors. Rows
without an id count as linked vectors but name no component. An empty table gives no rows; columns
other than key, vector and label are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm.arrow import find_package, map_batches
from skylag.llm.bit_sliced import usable
from skylag.llm.components import components
from skylag.session import materialized

THRESHOLD = 0.98
SAMPLE_ROWS = 16_384  # vectors that the centroids are fitted on
MOST_CELLS = 4_096  # cells of the first level
ROWS_PER_CELL = 4_096
ROWS_PER_SHARD = 16_384  # more rows are split again, or cut into shares
SPLIT_SAMPLE = 4_096  # rows of a crowded shard that its centroids are fitted on
BRANCHES = 16  # parts of a crowded shard, times the overlap
OVERLAP = 3  # nearest cells that get a copy of a vector
POOL, NEAR, FAR = 48, 16, 8  # candidates looked at, neighbours kept of the near ones and of the far ones
ALPHA = 1.2
BEAM = 16
BLOCK = 512
AUDITED = 64  # audited vectors that are linked to another one
MOST_AUDITED = 4096
LEAST_RECALL = 0.95
SHARD = ("label", "length", "cell")
PART = (*SHARD, "i", "j")


# -- cells -----------------------------------------------------------------


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors; the first ones are evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) for i in range(0, len(sample), 4096)])
        for cell in range(cells):
            own = sample[nearest == cell]
            if len(own):
                centres[cell] = own.mean(axis=0)
    return centres


def apart(centres: np.ndarray, least: float) -> np.ndarray:
    """The centres without those nearer than `least` to an earlier one that stays: a tight clump keeps one."""
    kept = centres[:1]
    for centre in centres[1:]:
        if ((kept - centre) ** 2).sum(axis=1).min() >= least**2:
            kept = np.vstack([kept, centre])
    return kept


def cells_of(units: np.ndarray, centres: np.ndarray, overlap: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, is home): the nearest cells, and all whose centre is within twice the reach.

    Two vectors within the reach of each other share the home of either one if that home's
    centre is within the reach of it.
    """
    for first in range(0, len(units), 4096):
        part = units[first : first + 4096]
        square = np.maximum(1 + (centres**2).sum(axis=1) - 2 * part @ centres.T, 0)
        taken = square <= (2 * reach) ** 2
        near = np.argsort(square, axis=1, kind="stable")[:, : max(1, overlap)]
        np.put_along_axis(taken, near, True, axis=1)
        rows, cells = np.nonzero(taken)
        yield rows + first, cells, cells == near[rows, 0]


# -- one shard -------------------------------------------------------------


def prune(units: np.ndarray, nodes: np.ndarray, pool: np.ndarray, keep: int) -> np.ndarray:
    """For each node up to `keep` of its candidates, robustly pruned; -1 fills the rest.

    `pool` holds candidates by rising distance, -1 where there are fewer.
    """
    around = units[pool]
    own = np.sqrt(np.maximum(2 - 2 * np.einsum("bld,bd->bl", around, units[nodes]), 0))
    alive = (pool >= 0) & (pool != nodes[:, None])
    kept = np.full((len(nodes), keep), -1, np.int64)
    rows = np.arange(len(nodes))
    for slot in range(keep):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, slot] = pool[rows, first][some]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("bld,bd->bl", around, around[rows, first]), 0))
        alive &= ALPHA * between > own
        alive[rows, first] = False
    return kept


def build_graph(units: np.ndarray) -> np.ndarray:
    """Neighbours of every row (-1 fills), all of them reachable from the medoid, and the medoid last."""
    n = len(units)
    pool_size = min(POOL, n - 1)
    neighbours = np.full((n, NEAR + FAR), -1, np.int64)
    draw = np.random.default_rng(n)
    for first in range(0, n if n > 1 else 0, BLOCK):
        nodes = np.arange(first, min(first + BLOCK, n))
        near = units[nodes] @ units.T
        near[np.arange(len(nodes)), nodes] = -np.inf
        pool = np.argpartition(-near, pool_size - 1, axis=1)[:, :pool_size]
        pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(near, pool, axis=1), axis=1, kind="stable"), axis=1)
        neighbours[nodes, :NEAR] = prune(units, nodes, pool, NEAR)
        far = draw.integers(0, n, (len(nodes), 2 * FAR))
        far = np.take_along_axis(far, np.argsort(-np.take_along_axis(near, far, axis=1), axis=1, kind="stable"), axis=1)
        neighbours[nodes, NEAR:] = prune(units, nodes, far, FAR)
    return neighbours


def medoid(units: np.ndarray) -> int:
    return int((units @ units.mean(axis=0)).argmax())


def entries(neighbours: np.ndarray, start: int) -> np.ndarray:
    """The start and one more node for every part of the graph that cannot be reached from it."""
    seen = np.zeros(len(neighbours), bool)
    found, frontier, after = [start], np.array([start]), 0
    while True:
        while len(frontier):
            seen[frontier] = True
            following = neighbours[frontier].ravel()
            following = np.unique(following[following >= 0])
            frontier = following[~seen[following]]
        unseen = np.flatnonzero(~seen[after:])
        if not len(unseen):
            return np.array(found)
        after += int(unseen[0])
        found.append(after)
        frontier = np.array([after])


def greedy(units: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The beam of nodes that each query ends with (-1 fills)."""
    wanted = units[queries]
    first = starts[:BEAM] if len(starts) <= BEAM else starts
    beam = np.full((len(queries), max(BEAM, len(first))), -1, np.int64)
    score = np.full(beam.shape, -np.inf)
    beam[:, : len(first)] = first
    score[:, : len(first)] = wanted @ units[first].T
    expanded = beam < 0
    rows = np.arange(len(queries))
    while True:
        open_score = np.where(expanded, -np.inf, score)
        best = open_score.argmax(axis=1)
        live = open_score[rows, best] > -np.inf
        if not live.any():
            return beam
        expanded[rows[live], best[live]] = True
        more = np.where(live[:, None], neighbours[beam[rows, best]], -1)
        known = (more[:, :, None] == beam[:, None, :]).any(axis=2)
        more = np.where(known, -1, more)
        more_score = np.where(more >= 0, np.einsum("qnd,qd->qn", units[more], wanted), -np.inf)
        beam, score = np.concatenate([beam, more], axis=1), np.concatenate([score, more_score], axis=1)
        expanded = np.concatenate([expanded, more < 0], axis=1)
        top = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
        beam, score, expanded = (np.take_along_axis(x, top, axis=1) for x in (beam, score, expanded))
        repeated = np.zeros_like(expanded)  # a node may come twice from one list
        order = np.argsort(beam, axis=1, kind="stable")
        ordered = np.take_along_axis(beam, order, axis=1)
        np.put_along_axis(repeated[:, :], order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        expanded |= repeated


def in_range(units: np.ndarray, neighbours: np.ndarray, query: int, seeds: np.ndarray, least: float) -> np.ndarray:
    """All nodes within range that can be reached over nodes within range."""
    seen = np.zeros(len(units), bool)
    seen[query] = True
    frontier = seeds[seeds >= 0]
    frontier = frontier[units[frontier] @ units[query] >= least]
    frontier = np.unique(np.append(frontier, query))
    found = [frontier]
    seen[frontier] = True
    while len(frontier):
        following = neighbours[frontier].ravel()
        following = following[following >= 0]
        following = np.unique(following[~seen[following]])
        seen[following] = True
        frontier = following[units[following] @ units[query] >= least]
        found.append(frontier)
    found = np.concatenate(found)
    return found[found != query]


def cosines(vectors: np.ndarray, norms: np.ndarray, query: int, others: np.ndarray) -> np.ndarray:
    return (vectors[others] @ vectors[query]) / (norms[others] * norms[query])


class Forest:
    """Which nodes are linked, as pointers to smaller ones."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def find(self, nodes: np.ndarray) -> np.ndarray:
        while True:
            above = self.parent[nodes]
            if np.array_equal(above, nodes):
                return nodes
            nodes = above

    def link(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.find(nodes))
        self.parent[roots] = roots[0]


# -- tables ----------------------------------------------------------------


def nodes_of(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """One row per distinct vector of a label: (label, vector, rep, copies)."""
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    good = rows.filter(usable(F.col(vector)) & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.col(key).cast("long").alias("key"))
    good = good.filter(norm > 0)
    grouped = good.groupBy("label", "vector").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return materialized(grouped, "vector_nodes")


def centroids(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, centroids of a sample of at most about SAMPLE_ROWS vectors."""
    sizes = {r["length"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    limit = int(min(1.0, SAMPLE_ROWS / max(1, total)) * (1 << 30))
    chosen = nodes.filter(F.pmod(F.xxhash64("vector", F.lit("cells")), F.lit(1 << 30)) < limit)
    found: dict[int, list] = {}
    for row in chosen.select("vector").sort(F.xxhash64("vector")).collect():
        found.setdefault(len(row["vector"]), []).append(row["vector"])
    centres = {}
    for length, vectors in found.items():
        units = np.array(vectors)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        cells = min(-(-sizes[length] // ROWS_PER_CELL), MOST_CELLS, len(units))
        centres[length] = fit_centroids(units, cells)
    return centres


def sharded(nodes: DataFrame, centres: dict[int, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    """Rows (label, length, cell, home, node, copies, vector) with the vector as binary doubles."""
    spread = nodes.sparkSession.sparkContext.broadcast(centres)
    reach = float(np.sqrt(2 - 2 * threshold))
    schema = T.StructType([
        T.StructField("label", nodes.schema["label"].dataType),
        T.StructField("length", T.IntegerType()),
        T.StructField("cell", T.LongType()),
        T.StructField("home", T.BooleanType()),
        T.StructField("node", T.LongType()),
        T.StructField("copies", T.LongType()),
        T.StructField("vector", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                matrix = vectors.take(pa.array(own)).flatten().to_numpy().reshape(-1, length)
                units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                # A length that the sample has missed is one cell.
                for rows, cells, home in cells_of(units, spread.value.get(length, np.zeros((1, length))), overlap, reach):
                    at = pa.array(own[rows])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(at), pa.array(np.full(len(rows), length, np.int32)), pa.array(cells.astype(np.int64)), pa.array(home), batch.column("node").take(at), batch.column("copies").take(at), pa.array([matrix[i].tobytes() for i in rows], pa.binary())],
                        names=schema.names,
                    )

    return map_batches(nodes.select("label", "vector", "node", "copies"), run, schema)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(table.num_rows, -1)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors, norms, vectors / norms[:, None]


def split(shards: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """The shards with a column `shares`: no shard of one share has more than ROWS_PER_SHARD rows.

    Whether centroids at least halve the work of a crowded shard is told by the sample that they
    are fitted on; if they do not, it gets as many shares as make two of them ROWS_PER_SHARD rows.
    """
    find_package(shards)
    reach = float(np.sqrt(2 - 2 * threshold))
    branches = BRANCHES * max(1, overlap)
    row_schema = shards.schema
    centre_schema = T.StructType([*(row_schema[c] for c in SHARD), T.StructField("centres", T.BinaryType())])

    def fit(table: pa.Table) -> pa.Table:
        units = _matrix(table.sort_by("node"))[2]
        centres = apart(fit_centroids(units, min(branches, len(units))), 2 * reach)
        counts = np.bincount(np.concatenate([cells for _, cells, _ in cells_of(units, centres, overlap, reach)]))
        useful = 2 * (counts.astype(float) ** 2).sum() <= len(units) ** 2
        own = table.select(list(SHARD)).slice(0, 1)
        return own.append_column("centres", pa.array([centres.tobytes() if useful else None], pa.binary()))

    def deal(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        units = _matrix(rows)[2]
        centres = np.frombuffer(fitted.column("centres")[0].as_py(), np.float64).reshape(-1, units.shape[1])
        taken, cells, nearest = (np.concatenate(x) for x in zip(*cells_of(units, centres, overlap, reach)))
        # Children are named by their shard and their number there.
        named = np.uint64(rows.column("cell")[0].as_py() % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) + cells.astype(np.uint64)
        named = (named ^ (named >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out = rows.select(row_schema.names).take(pa.array(taken))
        out = out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(named.view(np.int64)))
        home = out.column("home").to_numpy() & nearest
        return out.set_column(out.schema.get_field_index("home"), "home", pa.array(home))

    finished = shards.limit(0).withColumn("shares", F.lit(1))
    while True:
        sizes = materialized(shards.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_SHARD), "crowded_shards")
        if sizes.isEmpty():
            return finished.unionByName(shards.withColumn("shares", F.lit(1)))
        chosen = F.pmod(F.xxhash64("node", F.lit("split")), F.lit(1 << 30)) < F.lit(SPLIT_SAMPLE) / F.col("n") * (1 << 30)
        sample = shards.join(sizes, list(SHARD)).filter(chosen).select(*SHARD, "node", "vector")
        fitted = sample.groupBy(*SHARD).applyInArrow(fit, centre_schema).filter("centres IS NOT NULL")
        chunks = F.ceil(F.col("n") / ROWS_PER_SHARD).cast("int")
        fitted = materialized(fitted.join(sizes, list(SHARD)).withColumn("chunks", chunks), "split_centres")
        verdict = sizes.join(fitted.select(*SHARD, "chunks"), list(SHARD), "left")
        told = shards.join(verdict, list(SHARD), "left")
        small = told.filter("n IS NULL").select(*row_schema.names)
        clumps = told.filter("n IS NOT NULL AND chunks IS NULL")
        clumps = clumps.withColumn("shares", F.ceil(2 * F.col("n") / ROWS_PER_SHARD).cast("int")).select(*row_schema.names, "shares")
        rows = told.filter("chunks IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        centres = fitted.select(*SHARD, "centres", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        dealt = rows.groupBy(*SHARD, "chunk").cogroup(centres.groupBy(*SHARD, "chunk")).applyInArrow(lambda a, b: deal(a, b) if a.num_rows else a.select(row_schema.names), row_schema)
        finished = materialized(finished.unionByName(clumps).unionByName(small.withColumn("shares", F.lit(1))), "finished_shards")
        shards = materialized(dealt, "split_shards")


def dealt_to_parts(shards: DataFrame) -> DataFrame:
    """Every row once for each pair (i, j) of shares that its share, `side`, is one of."""
    placed = shards.withColumn("side", F.pmod(F.xxhash64("node", F.lit("share")), F.col("shares")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return placed.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "shares")


def search(shards: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, links, found, root): how many vectors and other nodes each node found in a part of its home, and its root in the part's forest."""
    find_package(shards)
    graph_schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("neighbours", T.ArrayType(T.LongType()))])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        units = _matrix(table)[2]
        names = table.column("node").to_numpy()
        lists = build_graph(units)
        return pa.table({"node": names, "i": table.column("i"), "j": table.column("j"), "neighbours": pa.array([names[x[x >= 0]] for x in lists], pa.list_(pa.int64()))})

    adjacency = shards.groupBy(*PART).applyInArrow(build, graph_schema)
    # Lists of different pairs of shares have few nodes in common and stay apart.
    united = adjacency.groupBy("node", "i", "j").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    united = materialized(united, "united_graph")
    found_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "found", "root")])

    def look(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        vectors, norms, units = _matrix(table)
        names, copies, home, side = (table.column(c).to_numpy() for c in ("node", "copies", "home", "side"))
        one_share = table.column("i")[0] == table.column("j")[0]
        lists = [np.searchsorted(names, x[np.isin(x, names)]) for x in table.column("neighbours").to_numpy()]
        neighbours = np.full((len(names), max(1, max(map(len, lists)))), -1, np.int64)
        for i, own in enumerate(lists):
            neighbours[i, : len(own)] = own
        starts = entries(neighbours, medoid(units))
        forest = Forest(len(names))
        links, others = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for first in range(0, len(names), BLOCK):
            queries = np.flatnonzero(home[first : first + BLOCK]) + first
            if not len(queries):
                continue
            for query, beam in zip(queries.tolist(), greedy(units, neighbours, queries, starts)):
                near = in_range(units, neighbours, query, beam, threshold - 1e-9)
                near = near[cosines(vectors, norms, query, near) >= threshold]
                if not one_share:
                    near = near[side[near] != side[query]]
                links[query] = (copies[query] - 1 if one_share else 0) + copies[near].sum()
                others[query] = len(near)
                if len(near):
                    forest.link(np.append(near, query))
        roots = forest.find(np.arange(len(names)))
        told = home | (roots != np.arange(len(names)))
        return pa.table({"node": names[told], "links": pa.array(links[told], mask=~home[told]), "found": pa.array(others[told], mask=~home[told]), "root": names[roots[told]]})

    # Each node has its lists once; parts are gathered with them.
    return shards.join(united, ["node", "i", "j"]).groupBy(*PART).applyInArrow(look, found_schema)


def linked_nodes(nodes: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Rows (node, others): by brute force over all rows, to how many other nodes each node of a sample is linked, if to any."""
    asked = nodes.filter(F.pmod(F.xxhash64("vector", F.lit("audit")), F.lit(1 << 30)) < limit).select("node", "label", "vector").collect()
    spread = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["label"], np.array(r["vector"])) for r in asked])
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("others", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            labels = np.array(batch.column("label").to_pylist(), object)
            names = batch.column("node").to_numpy()
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                matrix = batch.column("vector").take(pa.array(own)).flatten().to_numpy().reshape(-1, length)
                norms = np.linalg.norm(matrix, axis=1)
                for node, label, vector in spread.value:
                    if len(vector) == length:
                        hit = (matrix @ vector >= threshold * norms * np.linalg.norm(vector)) & (labels[own] == label) & (names[own] != node)
                        sums[node] = sums.get(node, 0) + int(hit.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=schema.names)

    true = map_batches(nodes.select("node", "label", "vector"), run, schema).groupBy("node").agg(F.sum("others").alias("others"))
    return materialized(true.filter("others > 0"), "audited_links")


def recall(nodes: DataFrame, found: DataFrame, threshold: float, audited: int = AUDITED, most: int = MOST_AUDITED) -> float:
    """Mean share of a sampled node's links to other nodes that were found, over sampled nodes that have any; 1 if none has.

    Exact copies are one node, so that they count for nothing here.
    """
    total = nodes.count()
    drawn = 4 * audited
    while True:
        true = linked_nodes(nodes, threshold, int(min(1.0, drawn / max(1, total)) * (1 << 30)))
        if drawn >= min(most, total) or true.count() >= audited:
            break
        drawn *= 4
    both = true.join(found.select("node", "found"), "node", "left")
    share = both.agg(F.avg(F.least(F.coalesce("found", F.lit(0)), "others") / F.col("others"))).first()[0]
    return 1.0 if share is None else share


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, overlap: int = OVERLAP, least_recall: float = LEAST_RECALL) -> DataFrame:
    """Rows (key, n_links, component_id, kept, audited_recall), one per row."""
    grouped = nodes_of(rows, key, vector, label)
    # Rows without an id need a name of their own among the nodes.
    nodes = grouped.withColumn("node", F.coalesce("rep", -F.abs(F.xxhash64("label", "vector")) - 1))
    centres = centroids(nodes)
    while True:
        shards = materialized(sharded(nodes, centres, overlap, threshold), "vector_shards")
        parts = dealt_to_parts(materialized(split(shards, overlap, threshold), "parted_shards"))
        told = materialized(search(parts, threshold), "vector_links")
        found = materialized(told.groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found")), "link_counts")
        share = recall(nodes, found, threshold)
        if share >= least_recall or overlap >= max([1, *map(len, centres.values())]):
            break
        overlap *= 2
    joined = components(told.filter("root <> node"), "node", "root").withColumnRenamed("vertex", "node")
    named = nodes.join(found.drop("found"), "node", "left").join(joined, "node", "left")
    named = materialized(named.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "links", F.coalesce("component", "rep").alias("component")), "named_vectors")
    alike = (F.col(label) == F.col("_label")) & (F.col(vector).cast("array<double>") == F.col("_vector"))
    out = rows.select(key, label, vector).join(named, alike, "left")
    own = F.coalesce("component", F.col(key).cast("long"))
    return out.select(key, F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col(key), F.lit(False)).alias("kept"), F.lit(float(share)).alias("audited_recall"))
