"""Edge tables: information content, neighbourhoods, hierarchy and object bundles, paths, closures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.durable import checkpointed


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge with its relation (a loop counts twice)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "rel")


def symmetric(edges: DataFrame) -> DataFrame:
    """G1: every edge from either end."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "src", "rel", "dst")
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "rel", "dst").unionByName(back)


def adjacency(edges: DataFrame) -> DataFrame:
    """G1: the set of neighbours of each node, undirected."""
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def node_ic(edges: DataFrame) -> DataFrame:
    """Information content of a node for a relation: minus the log of its share of the relation's edges."""
    degree = endpoints(edges).groupBy("rel", "node").agg(F.count(F.lit(1)).alias("deg"))
    total = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("m"))
    return degree.join(total, "rel").select("rel", "node", (-F.log(F.col("deg") / F.col("m"))).alias("ic"))


def edge_ic(edges: DataFrame) -> DataFrame:
    """Mean information content of an edge's ends, and that over the greatest, within 0 and 1."""
    ic = node_ic(edges)
    out = edges.join(ic.select("rel", F.col("node").alias("src"), F.col("ic").alias("a")), ["rel", "src"]).join(ic.select("rel", F.col("node").alias("dst"), F.col("ic").alias("b")), ["rel", "dst"])
    out = out.select("src", "rel", "dst", ((F.col("a") + F.col("b")) / 2).alias("ic"))
    top = out.agg(F.max("ic").alias("top"))
    norm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ic") / F.when(F.coalesce("top", F.lit(0.0)) == 0, 1.0).otherwise(F.col("top"))))
    return out.crossJoin(F.broadcast(top)).select("src", "rel", "dst", "ic", norm.alias("ic_norm"))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 1, include_reverse: bool = True) -> DataFrame:
    """(start, src, rel, dst): distinct edges with both ends within ``hops`` of a start; without reverse only those at the start."""
    both = symmetric(edges).select("a", "b").distinct()
    reach = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    for _ in range(hops):
        step = reach.join(both, reach.node == both.a).select("start", F.col("b").alias("node"))
        reach = reach.unionByName(step).distinct()
    ends = reach.select("start", F.col("node").alias("dst"))
    inside = edges.distinct().join(reach.withColumnRenamed("node", "src"), "src").join(ends, ["start", "dst"])
    out = inside.select("start", "src", "rel", "dst")
    return out if include_reverse else out.where("src = start OR dst = start")


def forward_edges(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, src, rel, dst): distinct edges with both ends within ``hops`` steps along edges from a start: all that paths of as many edges can follow, and none of what only shares a hub with the start."""
    along = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    reach = front = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    for _ in range(hops):
        front = front.join(along, front.node == along.a).select("start", F.col("b").alias("node")).distinct()
        reach = reach.unionByName(front).distinct()
    inside = edges.distinct().join(reach.withColumnRenamed("node", "src"), "src").join(reach.withColumnRenamed("node", "dst"), ["start", "dst"])
    return inside.select("start", "src", "rel", "dst")


def labels(entities: DataFrame, annotations: DataFrame, prop: str = "label") -> DataFrame:
    """Labels of each entity in order, or its short form."""
    own = annotations.where(F.col("prop") == prop).groupBy("iri").agg(F.array_sort(F.collect_set("value")).alias("labels"))
    return entities.select("iri").distinct().join(own, "iri", "left").select("iri", F.coalesce("labels", F.array(F.substring_index(F.substring_index("iri", "/", -1), "#", -1))).alias("labels"))


def closure(edges: DataFrame) -> DataFrame:
    """(sub, sup, depth): all ancestors with the least number of steps, of any depth; a cycle ends at its first return."""
    step = edges.select(F.col("src").alias("sub"), F.col("dst").alias("sup")).where("sub <> sup").distinct()
    every, front = step.withColumn("depth", F.lit(1)), step.withColumn("depth", F.lit(1))
    for depth in count(2):
        more = front.select("sub", F.col("sup").alias("mid")).join(step.select(F.col("sub").alias("mid"), "sup"), "mid").select("sub", "sup").where("sub <> sup").distinct()
        front = checkpointed(more.join(every.select("sub", "sup"), ["sub", "sup"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        every = every.unionByName(front)
    return every


def direct_parents(edges: DataFrame) -> DataFrame:
    """Edges that no longer path makes needless."""
    reach = closure(edges).where("depth >= 1").select("sub", "sup")
    step = edges.select(F.col("src").alias("sub"), F.col("dst").alias("sup")).where("sub <> sup").distinct()
    through = step.select("sub", F.col("sup").alias("mid")).join(reach.select(F.col("sub").alias("mid"), "sup"), "mid").select("sub", "sup").distinct()
    return step.join(through, ["sub", "sup"], "left_anti")


def hierarchy_bundle(edges: DataFrame, cap: int = 6) -> DataFrame:
    """Superclasses within two steps with specificity 1 / (steps), nearest first, ``cap`` for each entity."""
    step = edges.select(F.col("src").alias("iri"), F.col("dst").alias("sup")).distinct()
    two = step.select("iri", F.col("sup").alias("mid")).join(step.select(F.col("iri").alias("mid"), "sup"), "mid").select("iri", "sup").where("iri <> sup").distinct().join(step, ["iri", "sup"], "left_anti")
    every = step.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))
    r = F.row_number().over(Window.partitionBy("iri").orderBy("depth", "sup"))
    return every.withColumn("specificity", 1.0 / F.col("depth")).withColumn("rank", r).where(F.col("rank") <= cap).select("iri", "sup", "specificity", "rank")


def object_bundle(edges: DataFrame, families: list[str], cap: int = 48) -> DataFrame:
    """Each entity's edges of other than the hierarchy's relations, most informative first."""
    scored = edge_ic(edges).where(~F.col("rel").isin(families))
    own = scored.select(F.col("src").alias("iri"), "*").unionByName(scored.select(F.col("dst").alias("iri"), "*")).distinct()
    r = F.row_number().over(Window.partitionBy("iri").orderBy(F.desc("ic_norm"), "src", "rel", "dst"))
    return own.withColumn("rank", r).where(F.col("rank") <= cap)


def annotation_bundle(annotations: DataFrame, cap: int = 12) -> DataFrame:
    """Distinct literals of each entity, heaviest first."""
    words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    weighed = annotations.select("iri", "prop", "value").distinct().withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.1), words / 12.0)))
    r = F.row_number().over(Window.partitionBy("iri").orderBy(F.desc("weight"), "prop", "value"))
    return weighed.withColumn("rank", r).where(F.col("rank") <= cap)


def relation_ends(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Types seen at the ends of each relation; ``types``: (node, type)."""
    d = edges.join(types.select(F.col("node").alias("src"), F.col("type").alias("domain")), "src").groupBy("rel").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    r = edges.join(types.select(F.col("node").alias("dst"), F.col("type").alias("range")), "dst").groupBy("rel").agg(F.array_sort(F.collect_set("range")).alias("ranges"))
    return edges.select("rel").distinct().join(d, "rel", "left").join(r, "rel", "left")


def examples(edges: DataFrame, n: int = 3) -> DataFrame:
    """``n`` triples of each relation."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("rel").orderBy("src", "dst"))).where(F.col("rank") <= n)


def one_hop(edges: DataFrame, rel: str, parents: bool, limit: int = 3) -> DataFrame:
    """Parents or children of each node over one relation, in order, ``limit`` of them."""
    a, b = ("src", "dst") if parents else ("dst", "src")
    rows = edges.where(F.col("rel") == rel).select(F.col(a).alias("node"), F.col(b).alias("other")).distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("rank") <= limit)


def tops(edges: DataFrame) -> DataFrame:
    """Ancestors without a parent."""
    roots = edges.select(F.col("dst").alias("sup")).distinct().join(edges.select(F.col("src").alias("sup")).distinct(), "sup", "left_anti")
    return closure(edges).join(roots, "sup").select("sub", "sup")


def distances(edges: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """Steps from ``start`` to the nearest node of its targets (start, node), undirected, up to ``most``; none if farther."""
    both = symmetric(edges).select("a", "b").distinct()
    reach = pairs.select("start", F.col("start").alias("node")).distinct().withColumn("d", F.lit(0))
    front = reach
    for d in range(1, most + 1):
        step = front.join(both, front.node == both.a).select("start", F.col("b").alias("node")).distinct().join(reach.select("start", "node"), ["start", "node"], "left_anti")
        front = checkpointed(step.withColumn("d", F.lit(d)))
        reach = reach.unionByName(front)
    return reach.join(pairs, ["start", "node"]).groupBy("start").agg(F.min_by(F.struct("d", "node"), F.struct("d", "node")).alias("x")).select("start", "x.node", "x.d")


class _Edges:
    """A start's edges by their source: from node to (edge numbers)."""

    def __init__(self, rows: list[dict]):
        self.ends = [(e["src"], e["dst"]) for e in rows]
        self.ic, self.cost = np.array([e["ic"] for e in rows], float), np.array([e["cost"] for e in rows], int)
        self.out: dict[str, list[int]] = {}
        for i, (a, _) in enumerate(self.ends):
            self.out.setdefault(a, []).append(i)

    def price(self, i: int, used: set[int], alpha: float) -> tuple[int, float]:
        """Cost and reward of an edge: one in use costs nothing and gives nothing but the penalty of a hop."""
        return (0, -alpha) if i in used else (int(self.cost[i]), float(self.ic[i]) - alpha)


def _labelled(edges: _Edges, start: str, hops: int, used: set[int], left: float, alpha: float) -> list[int]:
    """The path of greatest reward within hops and budget, by labels (cost, hops, reward) at nodes of which no one dominates another."""
    kept: dict[str, list[tuple[int, int, float]]] = {start: [(0, 0, 0.0)]}
    front: list[tuple[str, int, float, tuple[int, ...]]] = [(start, 0, 0.0, ())]
    best: tuple[float, tuple[int, ...]] = (float("-inf"), ())
    for hop in range(1, hops + 1):
        after = []
        for node, spent, reward, path in front:
            for i in edges.out.get(node, ()):
                cost, gain = edges.price(i, used, alpha)
                to, c, r = edges.ends[i][1], spent + cost, reward + gain
                if c > left or any(x <= c and h <= hop and y >= r for x, h, y in kept.get(to, ())):
                    continue
                kept[to] = [k for k in kept.get(to, ()) if not (c <= k[0] and hop <= k[1] and r >= k[2])] + [(c, hop, r)]
                after.append((to, c, r, (*path, i)))
                if r > best[0]:
                    best = (r, (*path, i))
        front = after
    return list(best[1])


def _relaxed(edges: _Edges, start: str, hops: int, used: set[int], left: float, alpha: float, rounds: int = 8) -> list[int]:
    """The budget as a price for cost: walks by hops of greatest priced reward, the price halved between its bounds until the walk fits."""
    nodes = {n: k for k, n in enumerate(dict.fromkeys([start, *[x for e in edges.ends for x in e]]))}
    a, b = (np.array([nodes[e[k]] for e in edges.ends], np.int64) for k in (0, 1))
    free = np.zeros(len(a), bool)
    free[list(used)] = True
    cost, gain = np.where(free, 0, edges.cost), np.where(free, -alpha, edges.ic - alpha)
    low, high, found = 0.0, float(edges.ic.max()) / max(1, int(edges.cost.min())), []
    for _ in range(rounds):
        price = (low + high) / 2
        value = np.full(len(nodes), -np.inf)
        value[0] = 0.0
        best, steps = (float("-inf"), 0, 0), []
        for hop in range(1, hops + 1):
            by = value[a] + gain - price * cost
            value, last = np.full(len(nodes), -np.inf), np.full(len(nodes), -1)
            for i in np.argsort(by, kind="stable")[::-1]:  # the best edge into each node, of equal ones the last
                if by[i] > value[b[i]]:
                    value[b[i]], last[b[i]] = by[i], i
            steps.append(last)
            if value.max() > best[0]:
                best = (float(value.max()), hop, int(value.argmax()))
        path, at = [], best[2]
        for last in reversed(steps[: best[1]]):
            path.append(int(last[at]))
            at = int(a[last[at]])
        if not path:
            high = price
        elif sum(int(cost[i]) for i in path) > left:
            low = price
        else:
            high, found = price, path[::-1]
    return found


def _stepwise(edges: _Edges, start: str, hops: int, used: set[int], left: float, alpha: float) -> list[int]:
    """Hop by hop the edge with the most reward for its cost that the budget still allows."""
    node, spent, path, taken = start, 0, [], set(used)
    for _ in range(hops):
        choices = []
        for i in edges.out.get(node, ()):
            cost, gain = edges.price(i, taken, alpha)
            if spent + cost <= left:
                choices.append((gain / cost if cost else gain * 1e6, -i, cost))
        if not choices:
            break
        _, i, cost = max(choices)
        path.append(-i)
        taken.add(-i)
        spent, node = spent + cost, edges.ends[-i][1]
    return path


METHODS = {"dp": _labelled, "lagrangian": _relaxed, "local": _stepwise}


def _cover(rows: list[dict], start: str, budget: int, alpha: float, hops: int, method: str) -> list[tuple[str, str, str]]:
    """Best paths from the start, one after another, until one adds no cost or doesn't fit."""
    edges, used, left = _Edges(rows), [], budget
    while left > 0 and len(rows):
        path = METHODS[method](edges, start, hops, set(used), left, alpha)
        fresh = [i for i in dict.fromkeys(path) if i not in used]
        spent = int(edges.cost[fresh].sum()) if fresh else 0
        if spent == 0 or spent > left:
            break
        used += fresh
        left -= spent
    return [(rows[i]["src"], rows[i]["rel"], rows[i]["dst"]) for i in used]


def greedy_context(context: DataFrame, budget: int, alpha: float = 0.1, hops: int = 6, method: str = "dp") -> DataFrame:
    """For each start of (start, src, rel, dst, ic, cost) the edges that paths along them, of ``hops`` edges at most, cover within a budget of cost.

    ``method`` finds each path: ``dp`` (G5), ``lagrangian`` (G6) or ``local`` (G7). A start's
    neighbourhood is bounded by its hops, so a group is one entity's; groups are read one after
    another from sorted partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, rows = None, []

        def covered() -> list[tuple]:
            return [(start, i, *e) for i, e in enumerate(_cover(rows, start, budget, alpha, hops, method))] if rows else []

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for some in batches:
            found = []
            for e in some.to_pylist():
                if rows and e["start"] != start:
                    found += covered()
                    rows = []
                start = e["start"]
                rows.append(e)
            if found:
                yield batch(found)
        if found := covered():
            yield batch(found)

    names, kinds = ["start", "pos", "src", "rel", "dst"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    plain = context.select(*[F.col(c).cast("string") for c in ("start", "src", "rel", "dst")], F.col("ic").cast("double"), F.col("cost").cast("int"))
    ordered = plain.repartition("start").sortWithinPartitions(*[F.asc_nulls_last(c) for c in ("start", "src", "rel", "dst")])
    return ordered.mapInArrow(run, "start string, pos int, src string, rel string, dst string")


def labelled_context(context: DataFrame, labels_of: DataFrame, all_labels: bool = False) -> DataFrame:
    """Edges (start, src, rel, dst) of a neighbourhood in words: the first label of each part, or every combination of them; parts without labels keep their names."""
    out = context
    for part in ("src", "rel", "dst"):
        own = labels_of.select(F.col("iri").alias(part), F.col("labels").alias(f"__{part}"))
        out = out.join(own, part, "left").withColumn(f"__{part}", F.coalesce(F.col(f"__{part}"), F.array(F.col(part))))
    for part in ("src", "rel", "dst"):
        out = out.withColumn(f"{part}_label", F.explode(f"__{part}") if all_labels else F.col(f"__{part}")[0])
    return out.select("start", "src", "rel", "dst", "src_label", "rel_label", "dst_label")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """(start, node, d, path): a shortest undirected path from ``start`` to the nearest of its target nodes, the first of equal ones by name; none beyond ``most`` steps.

    Half the steps are taken from the starts, half from the distinct targets, and they meet in the
    middle, so that no start is paired with all that lies around its target. Each part of a shortest
    path is the first by name of those with its ends, and so is the whole.
    """
    both = checkpointed(symmetric(edges).select("a", "b").distinct())
    wanted = checkpointed(pairs.select("start", F.col("node").alias("target")).where("start IS NOT NULL AND target IS NOT NULL").distinct())

    def grown(first: DataFrame, origin: str, steps: int, longer: Column) -> DataFrame:
        front = first.select(F.col(origin), F.col(origin).alias("node")).distinct().withColumn("path", F.array("node"))
        reach = checkpointed(front)
        for _ in range(steps):
            step = front.join(both, front.node == both.a).select(origin, F.col("b").alias("node"), longer.alias("path"))
            front = checkpointed(step.groupBy(origin, "node").agg(F.min("path").alias("path")).join(reach.select(origin, "node"), [origin, "node"], "left_anti"))
            reach = reach.unionByName(front)
        return reach

    near = most - most // 2
    ahead = grown(wanted, "start", near, F.concat("path", F.array("b")))
    back = grown(wanted, "target", most // 2, F.concat(F.array("b"), "path")).withColumnRenamed("path", "rest")
    met = ahead.join(wanted, "start").join(back, ["target", "node"])
    # the first ``near`` steps are the start's, so only paths that took all of them go on
    met = met.where((F.size("rest") == 1) | (F.size("path") == near + 1)).withColumn("path", F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))).withColumn("d", F.size("path") - 1)
    return met.groupBy("start").agg(F.min_by(F.struct(F.col("target").alias("node"), "d", "path"), F.struct("d", "path")).alias("x")).select("start", "x.node", "x.d", "x.path")


def is_subclass(rel: Column) -> Column:
    """Relations that say subclass."""
    return F.lower(rel).contains("subclassof")


def selected_components(selected: DataFrame, rounds: int = 64) -> DataFrame:
    """Components (start, node, comp) of each start's selected edges, by their smallest node; more than ``rounds`` steps across one are an error."""
    both = selected.select("start", F.col("src").alias("a"), F.col("dst").alias("b")).union(selected.select("start", "dst", "src")).distinct()
    comp = checkpointed(both.select("start", F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")))
    for _ in range(rounds):
        near = both.join(comp.withColumnRenamed("node", "b"), ["start", "b"]).groupBy("start", F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        after = checkpointed(comp.join(near, ["start", "node"], "left").select("start", "node", F.least("comp", F.coalesce("low", "comp")).alias("comp"), (F.col("low") < F.col("comp")).alias("moved")))
        comp = after.drop("moved")
        if not after.where("moved").take(1):
            return comp
    raise RuntimeError("components of the selected edges are unfinished")


def bridges(edges: DataFrame, selected: DataFrame, most: int = 4) -> DataFrame:
    """Edges that join each part of a start's selection that does not hold the start: a part of subclass edges alone gets one such edge from its first node to the start, any other a shortest path from that node to the part of the start."""
    comp = selected_components(selected)
    home = comp.where("node = start").select("start", F.col("comp").alias("home"))
    apart = comp.join(home, "start", "left").where(F.col("home").isNull() | (F.col("comp") != F.col("home")))
    rels = selected.join(apart.withColumnRenamed("node", "src"), ["start", "src"]).groupBy("start", "comp").agg(F.min(is_subclass(F.col("rel")).cast("int")).alias("only"), F.min("rel").alias("rel"))
    direct = rels.where("only = 1").select("start", F.col("comp").alias("src"), "rel", F.col("start").alias("dst"))
    wanted = rels.where("only = 0").select("start", "comp")
    targets = comp.join(home, "start", "left").where("comp = home").select("start", "node").union(selected.select("start", F.col("start").alias("node"))).distinct()
    pairs = wanted.join(targets, "start").select(F.concat_ws("\x1f", "start", "comp").alias("k"), "start", "comp", "node")
    found = shortest_paths_between(edges, pairs, most)
    steps = found.select("start", F.inline(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))))
    named = symmetric(edges).groupBy("a", "b").agg(F.min(F.struct("src", "rel", "dst")).alias("e"))
    paths = steps.join(named, ["a", "b"]).select("start", "e.src", "e.rel", "e.dst")
    return direct.unionByName(paths).distinct()


def shortest_paths_between(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """G8 for several origins of one start: ``pairs`` are (k, start, comp, node); the path goes from ``comp`` to the nearest node."""
    both = symmetric(edges).select("a", "b").distinct()
    front = pairs.select("k", "start", "comp").distinct().select("k", "start", F.col("comp").alias("node"), F.array("comp").alias("path"))
    reach = front
    for _ in range(most):
        step = front.join(both, front.node == both.a).select("k", "start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = checkpointed(step.groupBy("k", "start", "node").agg(F.min("path").alias("path")).join(reach.select("k", "node"), ["k", "node"], "left_anti"))
        reach = reach.unionByName(front)
    hit = reach.join(pairs.select("k", "node").distinct(), ["k", "node"])
    return hit.groupBy("k", "start").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))


def axiom_targets(axioms: DataFrame, families: DataFrame, depth: int = 8) -> DataFrame:
    """(iri, family, target): what classes are said to be under, through intersections and restrictions.

    ``axioms`` are (iri, node) with the expression each class is a subclass of, or equivalent to, and
    rows (iri, node, kind, prop, child): a ``named`` node is a class, an ``intersection`` goes on to its
    children, a ``restriction`` with a property of a family ends at its filler if that is named, and
    goes on to it otherwise. ``families``: (prop, family).
    """
    nodes = axioms.select("node", "kind", "prop", "child").distinct()
    front = axioms.where("top").select("iri", "node").distinct()
    known = nodes.where("kind = 'named'").select("node").distinct()
    out = None
    for _ in range(depth):
        at = front.join(nodes, "node")
        named = at.where("kind = 'named' AND node <> iri").select("iri", F.lit("is_a").alias("family"), F.col("node").alias("target"))
        held = at.where("kind = 'restriction'").join(families, "prop", "left").join(known.select(F.col("node").alias("child"), F.lit(True).alias("plain")), "child", "left")
        ended = held.where("family IS NOT NULL AND plain").select("iri", "family", F.col("child").alias("target"))
        further = held.where("family IS NULL OR plain IS NULL").select("iri", F.col("child").alias("node")).union(at.where("kind = 'intersection'").select("iri", F.col("child").alias("node")))
        out = named.unionByName(ended) if out is None else out.unionByName(named).unionByName(ended)
        front = checkpointed(further.where("node IS NOT NULL").distinct())
        if not front.take(1):
            return out.distinct()
    raise RuntimeError(f"class expressions are nested deeper than {depth}")


def token_cost(text: Column, ratio: float = 1.3) -> Column:
    """Tokens of a verbalised edge, from its words."""
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * ratio).cast("int")
