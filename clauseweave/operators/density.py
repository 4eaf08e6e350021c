"""Clusters by density: as many as the data has, and noise.

The rule is that of a hierarchical density clustering: the distance between two
points is at least the distance of either to its ``min_size``-th neighbour, the
minimum spanning forest under that distance gives a hierarchy, branches of fewer
than ``min_size`` points fall off, and of nested branches the more stable one is
a cluster. Here the hierarchy is never built point by point:

1. Regions. A component of under ``min_size`` points joins along its least edge.
   What grows to ``min_size`` is a region; every point keeps the edge at which its
   own component became that large (``fallout``). Edges left between regions are
   the splits of the hierarchy.
2. A spanning forest of the regions, by rounds in which each part of the forest
   takes its least edge. Regions whose points see only each other meet by edges
   between the points nearest to each other's centres.
3. The hierarchy of the regions, one row a split, and the choice of clusters.

Edges are ordered by (length, ends), so ties do not depend on the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.operators.neighbours import DIGITS, distances, matrix, neighbour_graph, unit_vectors
from clauseweave.session import cut_lineage, remove_stored, small_side

NOISE = -1
#: Lengths below the rounding of distances count as this one.
SHORTEST = 10.0**-DIGITS
EDGE = "struct<w: double, a: bigint, b: bigint>"
#: Bytes of neighbouring centres that may go to every task.
CENTRE_BYTES = 64 << 20
NODE = f"node long, region long, parent long, birth {EDGE}, split double, jumps array<long>, births array<{EDGE}>"


def _edge(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def reach_edges(graph: DataFrame, points: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(id, core) and the distinct edges of the graph, as long as the points' mutual reach.

    A point counts as often as its vector occurs, itself included.
    """
    near = graph.select("id", F.posexplode("near").alias("_at", "n")).select("id", "_at", F.col("n.id").alias("other"), F.col("n.distance").alias("d"))
    weighted = near.join(points.select(F.col("id").alias("other"), F.col("weight").alias("_own")), "other")
    listed = weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "d", "_own"))).alias("list"))
    own = points.select("id", "weight").join(listed, "id", "left")
    # The distance at which the counts, summed up from the point itself, reach the size.
    state = F.aggregate(
        "list",
        F.struct(F.col("weight").alias("sum"), F.when(F.col("weight") >= min_size, F.lit(0.0)).alias("core"), F.lit(0.0).alias("last")),
        lambda s, x: F.struct((s["sum"] + x["_own"]).alias("sum"), F.coalesce(s["core"], F.when(s["sum"] + x["_own"] >= min_size, x["d"])).alias("core"), x["d"].alias("last")),
        lambda s: F.coalesce(s["core"], s["last"]),
    )
    cores = cut_lineage(own.select("id", F.coalesce(state, F.lit(0.0)).alias("core")))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    with_a = pairs.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a")
    both = with_a.join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    return cores, both.select(_edge(F.greatest("d", "core_a", "core_b"), F.col("a"), F.col("b")).alias("edge"))


def _followed(pointers: DataFrame, jumps: int) -> DataFrame:
    """Pointers (comp, to, state) with every open one (state 0) moved ahead along its chain; an end points to itself."""
    for _ in range(jumps):
        ahead = pointers.select(F.col("comp").alias("_comp"), F.col("to").alias("_to"), F.col("state").alias("_state"))
        moved = pointers.join(ahead, (F.col("to") == F.col("_comp")) & (F.col("state") == 0), "left")
        pointers = moved.select("comp", F.coalesce("_to", "to").alias("to"), F.coalesce("_state", "state").alias("state"))
    return pointers


def regions(points: DataFrame, edges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Points of regions, (id, region, fallout), and the edges between regions, (x, y, edge), x < y.

    In a round every small component picks its least edge. Two that pick the same
    one merge; one whose chain of picks ends in a region joins that region, at its
    own edge, for the picks along the chain are shorter. Others wait. Only small
    components are keys of joins, so no key is hot.
    """
    whole = points.select("id", "weight", (F.col("weight") >= min_size).alias("big"))
    first = _edge(F.lit(0.0), F.col("id"), F.col("id"))
    settled = [whole.where("big").select("id", F.col("id").alias("region"), first.alias("fallout"))]
    open_ = cut_lineage(whole.where("NOT big").select("id", F.col("id").alias("comp"), "weight"))
    big = whole.select(F.col("id"), "big")
    ends = edges.join(big.select(F.col("id").alias("_x"), F.col("big").alias("big_a")), F.col("edge.a") == F.col("_x")).join(
        big.select(F.col("id").alias("_y"), F.col("big").alias("big_b")), F.col("edge.b") == F.col("_y")
    )
    ends = cut_lineage(ends.select("edge", "big_a", "big_b"))
    one = ends.where("NOT big_a").select(F.col("edge.a").alias("comp"), F.col("edge.b").alias("other"), F.col("big_b").alias("other_big"), "edge")
    two = ends.where("NOT big_b").select(F.col("edge.b").alias("comp"), F.col("edge.a").alias("other"), F.col("big_a").alias("other_big"), "edge")
    between = [ends.where("big_a AND big_b").select(F.col("edge.a").alias("x"), F.col("edge.b").alias("y"), "edge")]
    alive = cut_lineage(one.unionByName(two))
    while alive.take(1):
        picks = cut_lineage(alive.groupBy("comp").agg(F.min_by(F.struct("other", "other_big"), "edge").alias("pick"), F.min("edge").alias("edge")).select("comp", "pick.other", "pick.other_big", "edge"))
        mirror = picks.select(F.col("comp").alias("_comp"), F.col("edge").alias("_edge"))
        pairs = picks.join(mirror, (F.col("other") == F.col("_comp")) & (F.col("edge") == F.col("_edge")), "left").withColumn("paired", F.col("_comp").isNotNull())
        pointers = pairs.select("comp", F.when(F.col("paired"), F.col("comp")).otherwise(F.col("other")).alias("to"), F.when(F.col("other_big"), 1).when(F.col("paired"), 2).otherwise(0).alias("state"))
        joining = _followed(pointers, 3).where("state = 1").select("comp", F.col("to").alias("now"))
        sizes = open_.groupBy("comp").agg(F.sum("weight").alias("size"))
        merging = pairs.where("paired").select("comp", "edge", F.least("comp", "other").alias("now")).join(sizes, "comp")
        grown = merging.groupBy("now").agg(F.sum("size").alias("size"))
        merged = merging.drop("size").join(grown, "now").select("comp", "now", (F.col("size") >= min_size).alias("big"), "edge")
        joined = joining.join(picks, "comp").select("comp", "now", F.lit(True).alias("big"), "edge")
        moves = cut_lineage(merged.unionByName(joined))
        own = moves.select("comp", F.col("now").alias("_now"), F.col("big").alias("_big"))
        theirs = moves.select(F.col("comp").alias("other"), F.col("now").alias("_their"), F.col("big").alias("_their_big"))
        moved = alive.join(own, "comp", "left").select(F.coalesce("_now", "comp").alias("comp"), F.coalesce("_big", F.lit(False)).alias("big"), "other", "other_big", "edge")
        near = moved.where("NOT other_big").join(theirs, "other", "left").select(
            "comp", "big", F.coalesce("_their", "other").alias("other"), F.coalesce("_their_big", F.lit(False)).alias("other_big"), "edge"
        )
        fresh = cut_lineage(moved.where("other_big").select("comp", "big", "other", "other_big", "edge").unionByName(near).where("comp != other"))
        between.append(fresh.where("big AND other_big").select(F.least("comp", "other").alias("x"), F.greatest("comp", "other").alias("y"), "edge"))
        located = cut_lineage(open_.join(moves.withColumnRenamed("edge", "fallout"), "comp", "left"))
        settled.append(located.where("big").select("id", F.col("now").alias("region"), "fallout"))
        open_ = located.where("big IS NULL OR NOT big").select("id", F.coalesce("now", "comp").alias("comp"), "weight")
        alive = fresh.where("NOT big").select("comp", "other", "other_big", "edge")
        remove_stored(picks)
    found, links = settled[0], between[0]
    for s, b in zip(settled[1:], between[1:], strict=True):
        found, links = found.unionByName(s), links.unionByName(b)
    return cut_lineage(found), cut_lineage(links.groupBy("x", "y").agg(F.min("edge").alias("edge")))


def bridges(points: DataFrame, cores: DataFrame, found: DataFrame, k: int, seed: int) -> DataFrame:
    """Edges (x, y, edge) between regions with near centres, each between the points nearest to the other's centre.

    A region compares its points with the centres of its about ``k`` neighbours
    and its own; where the neighbour does not look back, its point nearest to its
    own centre stands in.
    """
    dim = points.agg(F.max(F.size("v"))).scalar()
    placed = cut_lineage(found.select("id", "region").join(points, "id").select("id", "region", "v"))
    centre = Summarizer.mean(array_to_vector(F.col("v")))
    middles = placed.groupBy("region").agg(vector_to_array(centre).alias("c"))
    units = cut_lineage(unit_vectors(middles, "region", "c"))
    if units.count() < 2:
        return found.select(F.col("region").alias("x"), F.col("region").alias("y"), "fallout").where("false").withColumnRenamed("fallout", "edge")
    near = neighbour_graph(units, k=k, seed=seed)
    wanted = near.select(F.col("id").alias("region"), F.explode("near.id").alias("other")).unionByName(near.select(F.col("id").alias("region"), F.col("id").alias("other")))
    around = wanted.join(units.select(F.col("id").alias("other"), "v"), "other").groupBy("region").agg(F.collect_list(F.struct("other", "v")).alias("around"))
    dims = units.agg(F.max(F.size("v"))).first()[0]
    shared = small_side(around, max(1, CENTRE_BYTES // (8 * dims * (k + 1))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions_, others, ids, lengths = [], [], [], []
            v = matrix(batch.column("v"))
            for i, centres in enumerate(batch.column("around")):
                d = distances(v[i : i + 1], matrix(centres.values.field("v")))[0]
                others.append(centres.values.field("other").to_numpy(zero_copy_only=False))
                regions_.append(np.full(len(d), batch.column("region")[i].as_py()))
                ids.append(np.full(len(d), batch.column("id")[i].as_py()))
                lengths.append(d)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (regions_, others, ids, lengths)], ["region", "other", "id", "d"])

    faced = placed.join(shared, "region").mapInArrow(compare, "region long, other long, id long, d double")
    best = cut_lineage(faced.groupBy("region", "other").agg(F.min(F.struct("d", "id")).alias("best")).select("region", "other", "best.id"))
    out = best.where("region != other")
    back = out.select(F.col("region").alias("other"), F.col("other").alias("region"), F.col("id").alias("_back"))
    middle = best.where("region = other").select("other", F.col("id").alias("_middle"))
    ends = out.join(back, ["region", "other"], "left").join(middle, "other").select("region", "other", "id", F.coalesce("_back", "_middle").alias("to"))
    full = points.select("id", "v").join(cores, "id")
    known = ends.join(full, "id").withColumnsRenamed({"v": "v1", "core": "core1"}).join(full.withColumnsRenamed({"id": "to", "v": "v2", "core": "core2"}), "to")
    dot = F.aggregate(F.zip_with("v1", "v2", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.round(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot)), DIGITS)
    return known.select(F.least("region", "other").alias("x"), F.greatest("region", "other").alias("y"), _edge(F.greatest(length, "core1", "core2"), F.col("id"), F.col("to")).alias("edge")).distinct()


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges (x, y, edge): rounds in which every part takes its least edge.

    Parts are named by their least member. A round at least halves the parts that
    have an edge left; the least edge of a pair of parts stands for all of them.
    """
    alive = cut_lineage(edges.select("x", "y", "edge", F.col("x").alias("from"), F.col("y").alias("to")))
    taken = []
    while alive.take(1):
        both = alive.select(F.col("x").alias("comp"), F.col("y").alias("other"), "edge", "from", "to").unionByName(alive.select(F.col("y").alias("comp"), F.col("x").alias("other"), "edge", "from", "to"))
        picks = cut_lineage(both.groupBy("comp").agg(F.min_by(F.struct("other", "edge", "from", "to"), F.struct("edge", "from", "to")).alias("p")).select("comp", "p.*"))
        taken.append(picks.select("from", "to", "edge").distinct())
        mirror = picks.select(F.col("comp").alias("_comp"), F.col("from").alias("_from"), F.col("to").alias("_to_"), F.col("edge").alias("_edge"))
        same = (F.col("other") == F.col("_comp")) & (F.col("edge") == F.col("_edge")) & (F.col("from") == F.col("_from")) & (F.col("to") == F.col("_to_"))
        marked = picks.select("comp", "other", "edge", "from", "to").join(mirror, same, "left").withColumn("paired", F.col("_comp").isNotNull())
        # Of a pair that took one edge the lesser stays; every chain ends in such a pair.
        root = F.col("paired") & (F.col("comp") < F.col("other"))
        pointers = cut_lineage(marked.select("comp", F.when(root, F.col("comp")).otherwise(F.col("other")).alias("to"), F.when(root, 2).otherwise(0).alias("state")))
        while pointers.where("state = 0").take(1):
            pointers = cut_lineage(_followed(pointers, 2))
        names = pointers.select(F.col("comp"), F.col("to").alias("_name"))
        left = alive.join(names.withColumnsRenamed({"comp": "x", "_name": "_x"}), "x", "left").join(names.withColumnsRenamed({"comp": "y", "_name": "_y"}), "y", "left")
        renamed = left.select(F.coalesce("_x", "x").alias("p"), F.coalesce("_y", "y").alias("q"), "edge", "from", "to").where("p != q")
        pair = renamed.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        alive = cut_lineage(pair.agg(F.min(F.struct("edge", "from", "to")).alias("e")).select("x", "y", "e.edge", "e.from", "e.to"))
    if not taken:
        return edges.select("x", "y", "edge")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(F.col("from").alias("x"), F.col("to").alias("y"), "edge")


def hierarchy(names: list[int], splits: list[tuple[int, int, tuple[float, int, int]]]) -> list[dict]:
    """Nodes of the hierarchy of regions: parent, the edge at which each is born (going up, ends), the length at which it splits.

    Several trees hang on one more node, at infinite length.
    """
    at = {r: i for i, r in enumerate(names)}
    nodes = [{"node": i, "region": r, "parent": None, "birth": None, "split": None} for i, r in enumerate(names)]
    top, above = list(range(len(names))), list(range(len(names)))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(children: list[int], edge: tuple[float, int, int] | None) -> int:
        nodes.append({"node": len(nodes), "region": None, "parent": None, "birth": None, "split": edge[0] if edge else float("inf")})
        for c in children:
            nodes[c]["parent"], nodes[c]["birth"] = len(nodes) - 1, edge
        return len(nodes) - 1

    for x, y, edge in sorted(splits, key=lambda s: s[2]):
        a, b = find(at[x]), find(at[y])
        if a != b:
            top[b] = join([top[a], top[b]], edge)
            above[a] = b
    roots = [n["node"] for n in nodes if n["parent"] is None]
    if len(roots) > 1:
        join(roots, None)
    for n in reversed(nodes):  # parents have higher numbers
        jumps, step = [], n["parent"]
        while step is not None:
            jumps.append(step)
            known = nodes[step]["jumps"]
            step = known[len(jumps) - 1] if len(known) >= len(jumps) else None
        n["jumps"] = jumps
        n["births"] = [nodes[j]["birth"] for j in jumps]
    return nodes


def select_clusters(nodes: list[dict], fallen: dict[int, tuple[int, float]]) -> list[tuple[int, int, tuple[float, int, int] | None]]:
    """(region, cluster, birth): the most stable of nested nodes, never the root.

    ``fallen`` has for each node the points that leave it and the sum of their
    densities (one over length). A node's stability sums, over its points, the
    density at which each leaves it or it splits, less that of its birth.
    """

    def density(length: float) -> float:
        return 0.0 if length == float("inf") else 1.0 / max(length, SHORTEST)

    size, own, best = [0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
    below: list[list[int]] = [[] for _ in nodes]
    chosen = [False] * len(nodes)
    for n in nodes:
        i = n["node"]
        count, total = fallen.get(i, (0, 0.0))
        birth = 0.0 if n["birth"] is None else density(n["birth"][0])
        split = sum(size[c] for c in below[i])
        size[i] = count + split
        own[i] = total - count * birth + (split * (density(n["split"]) - birth) if below[i] else 0.0)
        under = sum(best[c] for c in below[i])
        chosen[i] = n["parent"] is not None and not (below[i] and under > own[i])
        best[i] = own[i] if chosen[i] else under
        if n["parent"] is not None:
            below[n["parent"]].append(i)
    cluster: list[int | None] = [None] * len(nodes)
    for n in reversed(nodes):
        i, up = n["node"], n["parent"]
        cluster[i] = cluster[up] if up is not None and cluster[up] is not None else i if chosen[i] else None
    numbers: dict[int, int] = {}
    out = []
    for n in sorted((n for n in nodes if n["region"] is not None), key=lambda n: n["region"]):
        c = cluster[n["node"]]
        if c is not None:
            out.append((n["region"], numbers.setdefault(c, len(numbers)), nodes[c]["birth"]))
    return out


def _in_one_task(df: DataFrame, schema: str, work: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Rows of the hierarchy through one function: at most one a region, of which there is one in ``min_size`` points."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work([row for batch in batches for row in batch.to_pylist()])
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[at : at + 10_000], kinds)

    return df.coalesce(1).mapInArrow(run, schema)


def _key(edge: dict | None) -> tuple[float, int, int] | None:
    return None if edge is None else (edge["w"], edge["a"], edge["b"])


def _named(edge: tuple[float, int, int] | None) -> dict | None:
    return None if edge is None else {"w": edge[0], "a": edge[1], "b": edge[2]}


def density_clusters(points: DataFrame, min_size: int = S.MIN_CLUSTER_SIZE, k: int = S.NEIGHBOURS, seed: int = S.SEED) -> DataFrame:
    """(id, cluster_id) of each point; noise has -1.

    ``points`` is stored: (id long, v array<double>, weight long), distinct unit
    vectors with the rows that hold each. Clusters are numbered by their least
    region. A single dense region has no sibling to stand out from: all is noise.
    """
    graph = cut_lineage(neighbour_graph(points.select("id", "v"), k=max(k, min_size + 1), seed=seed))
    cores, edges = reach_edges(graph, points, min_size)
    found, links = regions(points, cut_lineage(edges), min_size)
    forest = spanning_forest(links.unionByName(bridges(points, cores, found, k, seed)))
    names = found.select("region").distinct()
    rows = names.select(F.col("region").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast(EDGE).alias("edge")).unionByName(forest)

    def grow(rows: list[dict]) -> list[dict]:
        nodes = hierarchy(sorted(r["x"] for r in rows if r["y"] is None), [(r["x"], r["y"], _key(r["edge"])) for r in rows if r["y"] is not None])
        return [n | {"birth": _named(n["birth"]), "births": [_named(b) for b in n["births"]]} for n in nodes]

    nodes = cut_lineage(_in_one_task(rows, NODE, grow))
    held = small_side(nodes)
    # Each point leaves the hierarchy at the lowest node that is born after its fallout.
    leaf = nodes.where("region IS NOT NULL").select("region", F.col("node").alias("at"), F.col("birth").alias("_birth"))
    placed = found.join(points.select("id", "weight"), "id").join(small_side(leaf), "region")
    inside = F.col("_birth").isNull() | (F.col("fallout") < F.col("_birth"))
    placed = cut_lineage(placed.select("id", "region", "fallout", "weight", "at", inside.alias("inside")))
    late = placed.where("NOT inside").select("fallout", "weight", "at")
    deepest = nodes.agg(F.max(F.size("jumps"))).first()[0] or 0
    up = held.select(F.col("node").alias("at"), "jumps", "births", "parent")
    for step in reversed(range(deepest)):
        # Where the list of leaps is shorter, the root is nearer than that.
        target, birth = F.get("jumps", F.lit(step)), F.get("births", F.lit(step))
        go = target.isNotNull() & birth.isNotNull() & (birth < F.col("fallout"))
        late = late.join(up, "at").select("fallout", "weight", F.when(go, target).otherwise(F.col("at")).alias("at"))
    left = late.join(up, "at").select("fallout", "weight", F.coalesce("parent", "at").alias("at"))
    everyone = placed.where("inside").select("fallout", "weight", "at").unionByName(left)
    density = F.col("weight") / F.greatest(F.col("fallout.w"), F.lit(SHORTEST))
    sums = everyone.groupBy("at").agg(F.sum("weight").alias("count"), F.sum(density).alias("total"))
    judged = nodes.drop("jumps", "births").join(sums, F.col("node") == F.col("at"), "left").drop("at")

    def choose(rows: list[dict]) -> list[dict]:
        listed = [{"node": r["node"], "region": r["region"], "parent": r["parent"], "birth": _key(r["birth"]), "split": r["split"]} for r in sorted(rows, key=lambda r: r["node"])]
        fallen = {r["node"]: (r["count"], r["total"]) for r in rows if r["count"]}
        return [{"region": a, "cluster_id": b, "birth": _named(c)} for a, b, c in select_clusters(listed, fallen)]

    chosen = small_side(_in_one_task(judged, f"region long, cluster_id int, birth {EDGE}", choose))
    member = F.col("cluster_id").isNotNull() & (F.col("birth").isNull() | (F.col("fallout") < F.col("birth")))
    labelled = placed.join(chosen, "region", "left").select("id", F.when(member, F.col("cluster_id")).otherwise(NOISE).alias("_label"))
    return points.select("id").join(labelled, "id", "left").select("id", F.coalesce("_label", F.lit(NOISE)).alias("cluster_id"))
