"""Graph operators over ``edges(src, dst, weight)`` and typed node tables.

Iterative operators write each round to the shared folder, so a plan
never grows with the number of rounds.  Ties break on the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.skew import join_counted
from sparkloom.runtime import materialize, release

C = F.col


def pair_weights(edges: DataFrame) -> DataFrame:
    """Unordered pairs without self loops, weights summed."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def degrees(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def modularity(pairs: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: sum over communities of inner / 2m - resolution * (total / 2m)^2."""
    ca = communities.select(C("node").alias("a"), C("community").alias("ca"))
    cb = communities.select(C("node").alias("b"), C("community").alias("cb"))
    placed = pairs.join(ca, "a").join(cb, "b")
    inner = placed.where("ca = cb").groupBy(C("ca").alias("community")).agg((2 * F.sum("weight")).alias("inner"))
    total = placed.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("total"))
    two_m = pairs.agg((2 * F.sum("weight")).alias("two_m"))
    parts = total.join(inner, "community", "left").fillna(0.0, ["inner"]).join(F.broadcast(two_m))  # one row
    return parts.agg(F.sum(C("inner") / C("two_m") - resolution * (C("total") / C("two_m")) ** 2).alias("modularity"))


def quotient(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges between different communities, summed."""
    s = communities.select(C("node").alias("src"), C("community").alias("s"))
    t = communities.select(C("node").alias("dst"), C("community").alias("t"))
    return edges.join(s, "src").join(t, "dst").where("s <> t").groupBy("s", "t").agg(F.sum("weight").alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank, scaled) after ``rounds``; dangling mass is spread evenly, ``scaled`` is min-max."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = materialize(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select(C("src").alias("node"), "dst", (C("w") / C("out")).alias("share")), "pagerank-flow")
    links = flow.groupBy("node").agg(F.count("*").alias("n"))
    every = materialize(nodes.select("node").join(links, "node", "left").select("node", C("n").isNull().alias("dangling"), F.coalesce("n", F.lit(0)).alias("n")), "pagerank-nodes")
    size, total = every.count(), flow.count()
    first = ranks = every.withColumn("rank", F.lit(1.0 / max(size, 1)))
    for _ in range(rounds):
        got = join_counted(flow, ranks.select("node", "rank", "n"), ["node"], total).groupBy("dst").agg(F.sum(C("rank") * C("share")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(C("dangling"), C("rank"))), F.lit(0.0)).alias("lost"))
        base = (1 - damping) / max(size, 1)
        joined = every.join(got.withColumnRenamed("dst", "node"), "node", "left").join(F.broadcast(lost))  # one row
        scored = joined.select("node", "dangling", "n", (base + damping * (F.coalesce("got", F.lit(0.0)) + C("lost") / max(size, 1))).alias("rank"))
        before, ranks = ranks, materialize(scored, "pagerank")  # it is read twice in the next round
        if before is not first:
            release(before)
    release(flow)
    span = ranks.agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    scaled = F.when(C("high") > C("low"), (C("rank") - C("low")) / (C("high") - C("low"))).otherwise(0.0)
    return ranks.join(F.broadcast(span)).select("node", "rank", scaled.alias("scaled"))  # one row


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of ``edges(src, dst)``: label is the least node of the component.

    Alternates large-star and small-star steps until nothing changes; each
    round is a table in the shared folder, and only a count and a checksum
    reach the driver.  The edges of a hub do not meet in one task.
    """
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components")
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = sign(now)
    while seen[0]:
        both = now.union(now.select(C("v").alias("u"), C("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both.where("v > u"), low, ["u"], 2 * seen[0]).select(C("v").alias("u"), C("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct("u", C("m").alias("v")), F.struct(C("v").alias("u"), C("m").alias("v")))
        small = join_counted(large, least, ["u"], 2 * seen[0]).select(F.explode(pairs).alias("e")).select("e.*")
        before, now = now, materialize(small.where("u <> v").distinct(), "components")
        release(before)
        last, seen = seen, sign(now)
        if seen == last:
            break
    return now.select(C("u").alias("node"), C("v").alias("label")).union(now.select("v", "v").distinct())


def label_propagation(pairs: DataFrame, rounds: int = 10, seeds: DataFrame | None = None) -> DataFrame:
    """Synchronous label propagation: the heaviest neighbouring label, ties to the smaller.

    All nodes move at once, from the labels of the round before; a label that
    ties with the node's own keeps the node where it is.
    """
    both = materialize(pairs.select(C("a").alias("node"), C("b").alias("near"), "weight").union(pairs.select("b", "a", "weight")), "lpa-edges")
    total, counts = both.count(), materialize(both.groupBy("node").agg(F.count("*").alias("n")), "lpa-nodes")
    labels = counts.select("node", C("node").alias("label"))
    if seeds is not None:
        labels = labels.join(seeds.select("node", C("label").alias("_s")), "node", "left").select("node", F.coalesce("_s", "label").alias("label"))
    for _ in range(rounds):
        counted = labels.join(counts, "node")  # the rows of a hub stay spread in both joins
        votes = join_counted(both, counted.withColumnRenamed("node", "near"), ["near"], total).groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = join_counted(votes, counted.withColumnRenamed("label", "own"), ["node"], total).groupBy("node", "own").agg(F.max(F.struct("w", (C("label") == C("own")).alias("stays"), (-C("label")).alias("n"))).alias("m"))
        before, labels = labels, materialize(best.select("node", (-C("m.n")).alias("label")), "lpa")
        release(before)
    release(both)
    return labels


def merge_small(pairs: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """Communities under ``least`` nodes join their heaviest neighbour; one hop is chased."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("n"))
    ca = communities.select(C("node").alias("a"), C("community").alias("ca"))
    cb = communities.select(C("node").alias("b"), C("community").alias("cb"))
    cross = pairs.join(ca, "a").join(cb, "b").where("ca <> cb")
    cross = cross.select(C("ca").alias("s"), C("cb").alias("t"), "weight").union(cross.select("cb", "ca", "weight")).groupBy("s", "t").agg(F.sum("weight").alias("w"))
    goal = cross.join(sizes.where(C("n") < least), C("s") == C("community")).groupBy("s").agg(F.max(F.struct("w", (-C("t")).alias("t"))).alias("m")).select("s", (-C("m.t")).alias("t"))
    hop = goal.alias("g").join(goal.select(C("s").alias("t"), C("t").alias("t2")), "t", "left").select("s", F.when(C("t2").isNull() | (C("t2") == C("s")), C("t")).otherwise(C("t2")).alias("to"))
    return communities.join(hop, C("community") == C("s"), "left").select("node", F.coalesce("to", "community").alias("community"))


def attention(edges: DataFrame, seeds: DataFrame, hops: int = 2, damping: float = 0.5) -> DataFrame:
    """(node, score): seeds spread to neighbours, damped per hop, the best path counts."""
    both = edges.select(C("src").alias("node"), C("dst").alias("near"), "weight").union(edges.select("dst", "src", "weight"))
    front = scores = seeds.select("node", "score")
    for _ in range(hops):
        front = front.join(both, "node").groupBy("near").agg(F.max(C("score") * C("weight") * damping).alias("score")).withColumnRenamed("near", "node")
        scores = scores.union(front)
    return scores.groupBy("node").agg(F.max("score").alias("score"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first levels, each node at its first."""
    seen = materialize(starts.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    front = seen
    for d in range(1, depth + 1):
        near = front.join(edges, C("node") == C("src")).select(C("dst").alias("node")).distinct()
        front = materialize(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "reach")
        seen = seen.union(front)
    return seen


def cochanges(commits: DataFrame, now: Column, rate: float = 0.01) -> DataFrame:
    """(src, dst, weight) from ``commits(commit, pos, file, ts)``.

    A pair of one commit goes from the file that stands first to the other;
    the weight decays with age and the newest commit of a pair counts.
    """
    a, b = commits.alias("a"), commits.alias("b")
    pairs = a.join(b, (C("a.commit") == C("b.commit")) & (C("a.pos") < C("b.pos")))
    days = F.greatest((F.unix_seconds(now) - F.unix_seconds(C("a.ts"))) / 86400.0, F.lit(0.0))
    return pairs.where("a.file <> b.file").groupBy(C("a.file").alias("src"), C("b.file").alias("dst")).agg(F.max(F.exp(-rate * days)).alias("weight"))


def cochange_impact(edges: DataFrame, changed: DataFrame, least: float, k: int) -> DataFrame:
    """Files outside the changed set that change with it, strongest first."""
    ch = changed.select("file")
    out = edges.join(ch, C("src") == C("file"), "left_semi").join(ch, C("dst") == C("file"), "left_anti").select(C("dst").alias("file"), "weight")
    back = edges.join(ch, C("dst") == C("file"), "left_semi").join(ch, C("src") == C("file"), "left_anti").select(C("src").alias("file"), "weight")
    return out.union(back).where(C("weight") >= least).groupBy("file").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "file").limit(k)


def neighbours(edges: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` distinct neighbours of each file, in either direction."""
    both = edges.select(C("src").alias("file"), C("dst").alias("near")).union(edges.select("dst", "src")).where("file <> near").distinct()
    ranked = both.join(files, "file", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("near")))
    return ranked.where(C("_n") <= most).drop("_n")


def alerts(impact: DataFrame) -> DataFrame:
    """(file, severity, reason) from ``impact(file, communities, tests, cochanged)``."""
    return (
        impact.where("communities >= 3").select("file", F.lit("critical").alias("severity"), F.lit("crosses communities").alias("reason"))
        .union(impact.where("tests = 0").select("file", F.lit("warning"), F.lit("untested")))
        .union(impact.where("cochanged > 0").select("file", F.lit("info"), F.lit("changes together")))
    )
