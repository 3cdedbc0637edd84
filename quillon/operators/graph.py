"""Property graphs as edge tables (src, dst, ...): build, degrees, communities, centrality, paths."""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def routes(trips: DataFrame) -> DataFrame:
    """src, dst, n, total, mean, distance of trips with src, dst, delay, distance."""
    delay = F.coalesce("delay", F.lit(0.0))
    return trips.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum(delay).alias("total"), F.avg(delay).alias("mean"), F.avg("distance").alias("distance"))


def upsert_routes(trips: DataFrame, order: str) -> DataFrame:
    """Running counters as row-by-row merging leaves them: count, sum, last date in row order, first non-null distance."""
    return trips.groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("delay", F.lit(0.0))).alias("total"), F.max_by("day", order).alias("last_row_day"), F.max("day").alias("last_day"),
        F.min_by("distance", F.when(F.col("distance").isNotNull(), F.col(order))).alias("distance"),
    )


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, weighted (sum of outgoing n); 0 where absent."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.sum("n").alias("weighted"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return vertices.join(out, "id", "left").join(into, "id", "left").fillna(0, ["out_degree", "in_degree", "weighted"]).select("id", "out_degree", "in_degree", "weighted")


def fragility(scores: DataFrame, columns: list[str], constant: float | None = 0.0) -> DataFrame:
    """Mean of the columns, each scaled to [0, 1] over the table of vertices; a constant column counts as `constant` (null: there is no mean).
    The scores are computed once: their limits and their scaling read the same rows, and no broadcast waits for them."""
    scores = checkpointed(scores)
    row = scores.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    parts = [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.lit(constant)) for c in columns]
    return scores.crossJoin(F.broadcast(row)).withColumn("fragility", sum(parts, F.lit(0.0)) / len(columns)).drop(*row.columns)  # one row of parameters


def centrality(communities: DataFrame, edges: DataFrame, scores: DataFrame, delays: DataFrame, constant: float | None = 0.0) -> DataFrame:
    """id, community, weighted, betweenness, late and fragility: communities (id, community) left-joined with weighted out-degree,
    betweenness scores (id, score) and mean delays (id, late); what is missing counts as 0, and a constant column as `constant`."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("n").cast("double").alias("weighted"))
    out = communities.select("id", "community").join(degree, "id", "left").join(scores.select("id", F.col("score").alias("betweenness")), "id", "left").join(delays.select("id", "late"), "id", "left")
    return fragility(out.fillna(0.0, ["weighted", "betweenness", "late"]), ["betweenness", "weighted", "late"], constant)


def low_degree_source(vertices: DataFrame, edges: DataFrame, below: int = 10) -> DataFrame:
    """(id, degree) of the vertex of the smallest out-degree above 0 and under `below`; ties by id."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).filter(F.col("degree") < below)
    return vertices.join(out, "id").select("id", "degree").orderBy("degree", "id").limit(1)


def rerouted(edges: DataFrame, gone: DataFrame, source: str, cost: str) -> DataFrame:
    """id, before, after, longer: cheapest costs from source in the graph and without the edges `gone`; after is null where unreachable."""
    before = shortest_paths(edges, source, cost).select("id", F.col("cost").alias("before"))
    after = shortest_paths(without_edges(edges, gone), source, cost).select("id", F.col("cost").alias("after"))
    return before.join(after, "id", "left").withColumn("longer", F.col("after").isNull() | (F.col("after") > F.col("before")))


def top_per_group(df: DataFrame, group: str, score: str, key: str, k: int, least: int = 0) -> DataFrame:
    """The best k of each group with more than `least` rows; ties by key."""
    big = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(group)
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    return df.join(big, group, "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def shortest_paths(edges: DataFrame, source: str, cost: str, rounds: int = 10_000) -> DataFrame:
    """id, cost, path of the cheapest path from source (ties: the smaller path text); min-plus rounds until nothing improves.
    A round adds a hop; paths of more than `rounds` hops are an error."""
    spark = edges.sparkSession
    best = spark.createDataFrame([(source, 0.0, source)], "id string, cost double, path string")
    front = best
    e = edges.select(F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("to"), F.col(cost).cast("double").alias("w"))
    for _ in range(rounds):
        step = front.join(e, "id").select(F.col("to").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat_ws(">", "path", "to").alias("path"))
        step = step.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("s")).select("id", "s.cost", "s.path")
        old = best.select("id", F.col("cost").alias("_c"), F.col("path").alias("_p"))
        better = step.join(old, "id", "left").filter(F.col("_c").isNull() | (F.col("cost") < F.col("_c")) | ((F.col("cost") == F.col("_c")) & (F.col("path") < F.col("_p")))).select("id", "cost", "path")
        better = checkpointed(better)
        if better.isEmpty():
            return best
        best = checkpointed(best.join(better.select("id"), "id", "left_anti").unionByName(better))
        front = better
    raise RuntimeError(f"shortest_paths: not settled after {rounds} rounds")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut an iteration's lineage in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def betweenness(edges: DataFrame, cost: str, most_edges: int = 2_000_000) -> DataFrame:
    """id, score by weighted Brandes from every source; sources are spread over tasks, the adjacency is sent to them behind a
    check of its size. An edge without an end or a cost leads nowhere, as in a join; null is no vertex."""
    edges = checkpointed(edges.select("src", "dst", F.col(cost).cast("double").alias("w")))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).filter("id is not null").distinct()
    edges = edges.dropna()
    if edges.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"over {most_edges} edges; raise most_edges if executors can hold them")
    spark = edges.sparkSession
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for r in edges.collect():
        near[r["src"]].append((r["dst"], r["w"]))
    sent = spark.sparkContext.broadcast(dict(near))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = sent.value
        total: dict[str, float] = defaultdict(float)
        for frame in frames:
            for s in frame["id"]:
                dist, paths, before, done, heap = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0.0, s)]
                closed = set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in closed:
                        continue
                    closed.add(v)
                    done.append(v)
                    for x, w in graph.get(v, ()):
                        n = d + w
                        if x not in dist or n < dist[x] - 1e-12:
                            dist[x], paths[x], before[x] = n, paths[v], [v]
                            heapq.heappush(heap, (n, x))
                        elif abs(n - dist[x]) <= 1e-12 and x not in closed:
                            paths[x] += paths[v]
                            before[x].append(v)
                share: dict[str, float] = defaultdict(float)
                for x in reversed(done):
                    for v in before[x]:
                        share[v] += paths[v] / paths[x] * (1 + share[x])
                    if x != s:
                        total[x] += share[x]
        if total:  # sources that reach nothing leave no scores, and an empty frame has no types
            yield pd.DataFrame({"id": list(total), "score": list(total.values())})

    part = ids.repartition(spark.sparkContext.defaultParallelism, "id").mapInPandas(run, "id string, score double")
    return ids.join(part.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").fillna(0.0, ["score"])


def louvain(edges: DataFrame, weight: str, rounds: int = 200, levels: int = 50) -> DataFrame:
    """id, community (named by its smallest id), by rounds of joins and contraction, whatever the size.

    In a round a share of the vertices may move, each to the neighbouring community of the largest gain; the share shrinks from a half as
    rounds go by, so that neighbours seldom move at once. A level ends when a whole cycle of shares moves nothing; rounds or levels that run out are an error."""
    e = edges.filter(F.col("src") != F.col("dst")).select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.col(weight).cast("double").alias("w"))
    e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = checkpointed(e)
    loops = e.limit(0).groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("own"))
    whole = e.agg(F.sum("w")).first()[0] or 0.0
    final = checkpointed(e.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    if whole == 0:
        return final
    for _ in range(levels):
        strength = e.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).join(loops, "id", "full").select("id", (F.coalesce("k", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("k"))
        state = checkpointed(strength.withColumn("c", F.col("id")))
        moved_any, still, parts, part = False, 0, 2, 0
        for r in range(rounds):
            totals = state.groupBy("c").agg(F.sum("k").alias("t"))
            links = e.join(state.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("in"))
            options = links.unionByName(state.select("id", F.col("c").alias("to"), F.lit(0.0).alias("in"))).groupBy("id", "to").agg(F.sum("in").alias("in"))
            options = options.join(state, "id").join(totals.select(F.col("c").alias("to"), "t"), "to")
            rest = F.col("t") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.col("in") - F.col("k") * rest / F.lit(whole)
            best = options.withColumn("g", gain).groupBy("id").agg(F.max(F.struct(F.round("g", 9).alias("g"), (F.col("to") == F.col("c")).alias("stay"), "to")).alias("m"), F.first("c").alias("c"), F.first("k").alias("k"))
            turn = F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)) == part
            new = checkpointed(best.select("id", "k", F.when(turn, F.col("m.to")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was")))
            moves = new.filter("c <> was").count()
            state = new.select("id", "k", "c")
            moved_any |= moves > 0
            still = 0 if moves else still + 1
            if still > parts:
                break
            part += 1
            if part >= parts:
                part, parts = 0, parts + 1 if r > 8 and still == 0 else parts
        else:
            raise RuntimeError(f"louvain: not settled after {rounds} rounds")
        final = checkpointed(final.join(state.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        if not moved_any:
            break
        names = state.select("id", "c")
        merged = e.join(names.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(names.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy("ca", "cb").agg(F.sum("w").alias("w"))
        own = loops.join(names, "id").select(F.col("c").alias("id"), "own").unionByName(merged.filter("ca = cb").select(F.col("ca").alias("id"), F.col("w").alias("own"))).groupBy("id").agg(F.sum("own").alias("own"))
        loops = checkpointed(own)
        e = checkpointed(merged.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"))
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"louvain: not settled after {levels} levels")
    least = final.groupBy("community").agg(F.min("id").alias("name"))
    return final.join(least, "community").select("id", F.col("name").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str) -> float:
    e = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).cast("double").alias("w"))
    e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    c = communities
    x = e.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    total = x.agg(F.sum("w")).first()[0]
    inside = x.filter("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = x.groupBy("ca").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inside / total - squares / total**2


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """(id, rank) of the unweighted walk, summing to 1; vertices without edges out give their rank to all. Rounds go on until ranks change by
    less than `tolerance` in all, which `rounds` of them must reach."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    n = ids.count()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = checkpointed(edges.join(out, "src").select("src", "dst", "deg"))
    rank = checkpointed(ids.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(-(-rounds // 5)):
        old = rank
        for _ in range(5):
            before = rank
            got = links.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
            lost = rank.join(out, F.col("id") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            rank = ids.join(got, ids["id"] == got["dst"], "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = checkpointed(rank)
        change = rank.join(old.select("id", F.col("rank").alias("_o")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("_o")))).first()[0]
        if not change or change < tolerance:
            return rank
    raise RuntimeError(f"pagerank: not settled after {rounds} rounds")


def strong_components(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """id, component (smallest id of those that reach it and that it reaches).

    Labels of the smallest id flow along edges until they settle; from each label's own vertex, what reaches it backwards inside the label is
    a component; the rest goes on."""
    e = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct())
    left = checkpointed(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    done = None
    for _ in range(rounds):
        label = left.select("id", F.col("id").alias("c"))
        for _ in range(rounds):
            new = label.unionAll(e.join(label, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "c")).groupBy("id").agg(F.min("c").alias("c"))
            new = checkpointed(new)
            same = new.join(label, ["id", "c"], "left_anti").isEmpty()
            label = new
            if same:
                break
        else:
            raise RuntimeError(f"strong_components: not settled after {rounds} rounds")
        inside = checkpointed(e.join(label.select(F.col("id").alias("a"), F.col("c").alias("c")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("c2")), "b").filter("c = c2").select("a", "b", "c"))
        found = front = checkpointed(label.filter("id = c"))
        while not front.isEmpty():
            front = checkpointed(inside.join(front.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "c").distinct().join(found, "id", "left_anti"))
            found = checkpointed(found.unionAll(front))
        part = found.select("id", F.col("c").alias("component"))
        done = part if done is None else done.unionAll(part)
        left = checkpointed(left.join(found, "id", "left_anti"))
        if left.isEmpty():
            return done
        e = checkpointed(e.join(left.select(F.col("id").alias("a")), "a", "left_semi").join(left.select(F.col("id").alias("b")), "b", "left_semi"))
    raise RuntimeError(f"strong_components: not settled after {rounds} rounds")


def weak_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, component (smallest id reachable); labels that still change after `rounds` are an error."""
    both = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    label = checkpointed(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("component", "m").alias("new"))
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = checkpointed(new.join(jump, "new", "left").select("id", "component", F.least("new", F.coalesce("far", "new")).alias("new")))
        if new.filter("component <> new").isEmpty():
            return label
        label = new.select("id", F.col("new").alias("component"))
    raise RuntimeError(f"weak_components: not settled after {rounds} rounds")
