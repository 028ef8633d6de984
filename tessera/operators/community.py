"""Communities on an undirected weighted edge table (i, j, weight), i < j.

Everything is keyed by optional group columns ``g`` (for example the graph
partition), so "Louvain inside every partition" is one distributed loop
rather than one job per partition. Community ids are node ids: a community
is named after its smallest member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import iterate


def _g(group_cols) -> list[str]:
    return list(group_cols or [])


# ------------------------------------------------------------------ graph

def union_dedup(edges: DataFrame, weight: str = "norm_score", keep: str = "first") -> DataFrame:
    """One undirected graph from all windows and partitions.

    keep="first": the weight of the lowest window wins (the baseline's first
    seen); keep="last": the highest window wins (the compose form).
    """
    pick = F.min_by if keep == "first" else F.max_by
    return edges.groupBy("i", "j").agg(pick(weight, "window_id").alias("weight"))


def symmetric(edges: DataFrame, group_cols=()) -> DataFrame:
    """(g..., src, dst, w) with both orientations of every edge."""
    g = _g(group_cols)
    both = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")),
                   F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))
    return edges.select(*g, F.col("weight").cast("double").alias("w"), F.explode(both).alias("e")) \
        .select(*g, "e.src", "e.dst", "w")


def weighted_degree(edges: DataFrame, group_cols=()) -> DataFrame:
    """(g..., node, k): sum of incident weights."""
    g = _g(group_cols)
    return symmetric(edges, g).groupBy(*g, F.col("src").alias("node")).agg(F.sum("w").alias("k"))


def total_weight(edges: DataFrame, group_cols=()) -> DataFrame:
    """(g..., m): m = half the degree total = sum of edge weights."""
    g = _g(group_cols)
    return edges.groupBy(*g).agg(F.sum(F.col("weight").cast("double")).alias("m"))


def nodes_of(edges: DataFrame, group_cols=()) -> DataFrame:
    g = _g(group_cols)
    return edges.select(*g, F.explode(F.array("i", "j")).alias("node")).distinct()


# ------------------------------------------------------------------ quality

def _with_m(df: DataFrame, m: DataFrame, g: list[str]) -> DataFrame:
    """Attach the total weight m: a scalar subquery without groups, else a
    join with one row per group (groups are graph partitions: few)."""
    if not g:
        return df.withColumn("m", m.select("m").scalar())
    return df.join(F.broadcast(m), g)


def modularity_edges(edges: DataFrame, communities: DataFrame, group_cols=()) -> DataFrame:
    """The baseline's Q: sum over existing intra-community edges of
    w - k_i k_j / 2m, divided by 2m. (g..., modularity)."""
    g = _g(group_cols)
    deg = weighted_degree(edges, g)
    m = total_weight(edges, g)
    ci = communities.select(*g, F.col("node").alias("i"), F.col("community").alias("ci"))
    cj = communities.select(*g, F.col("node").alias("j"), F.col("community").alias("cj"))
    ki = deg.select(*g, F.col("node").alias("i"), F.col("k").alias("ki"))
    kj = deg.select(*g, F.col("node").alias("j"), F.col("k").alias("kj"))
    intra = _with_m(edges.join(ci, [*g, "i"]).join(cj, [*g, "j"]).where(F.col("ci") == F.col("cj"))
                    .join(ki, [*g, "i"]).join(kj, [*g, "j"]), m, g)
    term = F.col("weight").cast("double") - F.col("ki") * F.col("kj") / (2 * F.col("m"))
    s = intra.groupBy(*g).agg(F.sum(term).alias("s"))
    out = m.join(s, g, "left") if g else m.withColumn("s", s.select("s").scalar())
    return out.select(*g, (F.coalesce("s", F.lit(0.0)) / (2 * F.col("m"))).alias("modularity"))


def modularity_standard(edges: DataFrame, communities: DataFrame, group_cols=()) -> DataFrame:
    """Textbook Q = sum_c (L_c / m - (d_c / 2m)^2). (g..., modularity)."""
    g = _g(group_cols)
    deg = weighted_degree(edges, g)
    m = total_weight(edges, g)
    ci = communities.select(*g, F.col("node").alias("i"), F.col("community").alias("ci"))
    cj = communities.select(*g, F.col("node").alias("j"), F.col("community").alias("cj"))
    intra = edges.join(ci, [*g, "i"]).join(cj, [*g, "j"]).where(F.col("ci") == F.col("cj")) \
        .groupBy(*g, F.col("ci").alias("community")).agg(F.sum(F.col("weight").cast("double")).alias("L"))
    dc = deg.join(communities, [*g, "node"]).groupBy(*g, "community").agg(F.sum("k").alias("d"))
    per = _with_m(dc.join(intra, [*g, "community"], "left"), m, g)
    term = F.coalesce(F.col("L"), F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return per.groupBy(*g).agg(F.sum(term).alias("modularity"))


# ------------------------------------------------------------------ moves

def gains(adj: DataFrame, deg: DataFrame, m: DataFrame, comm: DataFrame, group_cols=()) -> DataFrame:
    """Modularity gain of moving each node to each neighbouring community.

    adj (g, src, dst, w); deg (g, node, k); m (g, m); comm (g, node, community).
    Returns (g, node, community, cur, gain) for candidate != cur, with
    gain = (k_in_new - k_in_cur)/m - k(tot_new - tot_cur + k)/(2 m^2).
    """
    g = _g(group_cols)
    ni = deg.join(comm, [*g, "node"]).select(*g, "node", "k", F.col("community").alias("cur"))
    tot = ni.groupBy(*g, F.col("cur").alias("community")).agg(F.sum("k").alias("tot"))
    nbr = comm.select(*g, F.col("node").alias("dst"), F.col("community"))
    kin = adj.join(nbr, [*g, "dst"]).groupBy(*g, F.col("src").alias("node"), "community") \
        .agg(F.sum("w").alias("kin"))
    kin_cur = kin.join(ni.select(*g, "node", F.col("cur").alias("community")), [*g, "node", "community"]) \
        .select(*g, "node", F.col("kin").alias("kin_cur"))
    tot_cur = tot.select(*g, F.col("community").alias("cur"), F.col("tot").alias("tot_cur"))
    base = ni.join(tot_cur, [*g, "cur"]).join(kin_cur, [*g, "node"], "left") \
        .fillna(0.0, ["kin_cur"])
    cand = kin.join(base, [*g, "node"]).where(F.col("community") != F.col("cur")) \
        .join(tot, [*g, "community"])
    mm = F.col("m")
    cand = _with_m(cand, m, g)
    gain = (F.col("kin") - F.col("kin_cur")) / mm \
        - F.col("k") * (F.col("tot") - F.col("tot_cur") + F.col("k")) / (2 * mm * mm)
    return cand.select(*g, "node", "community", "cur", gain.alias("gain"))


def best_moves(cands: DataFrame, epsilon: float = 1e-4, group_cols=(), digits: int = 12) -> DataFrame:
    """Per node the candidate of largest gain, ties to the lowest community id,
    kept only when gain > epsilon. (g, node, cur, community, gain)."""
    g = _g(group_cols)
    key = F.struct(F.round("gain", digits).alias("g"), (-F.col("community")).alias("neg"),
                   F.col("gain").alias("raw"), F.col("cur").alias("cur"))
    best = cands.groupBy(*g, "node").agg(F.max(key).alias("b"))
    return best.select(*g, "node", F.col("b.cur").alias("cur"), (-F.col("b.neg")).alias("community"),
                       F.col("b.raw").alias("gain")).where(F.col("gain") > epsilon)


def round_state(adj: DataFrame, deg: DataFrame, m: DataFrame, comm: DataFrame,
                group_cols=(), digits: int = 12):
    """One Louvain round's per-node state with a single per-node aggregation.

    For a node, gain(c) = score(c) - score(cur) - k^2/(2m^2) with
    score(c) = k_in(c)/m - k tot(c)/(2m^2); the last two terms do not depend
    on c, so the best candidate is the one of largest score (rounded to
    `digits`, ties to the lowest id), and k_in(cur) is summed in the same
    aggregation. A node alone in its community may join another lone node
    only if that node's id is lower, so simultaneous moves cannot rotate
    singletons around a cycle.

    Returns (per, tot): per = (g, node, community, gain, lift, kin_cur) with the
    best candidate (null when none) and lift = gain * m, tot = (g, community, tot, size).
    The modularity of `comm` follows from them: sum(kin_cur)/2m - sum(tot^2)/4m^2.
    """
    g = _g(group_cols)
    ni = deg.join(comm, [*g, "node"]).select(*g, "node", "k", F.col("community").alias("cur"))
    tot = ni.groupBy(*g, F.col("cur").alias("community")).agg(F.sum("k").alias("tot"),
                                                             F.count(F.lit(1)).alias("size"))
    ni2 = ni.join(tot.select(*g, F.col("community").alias("cur"), F.col("tot").alias("tot_cur"),
                             F.col("size").alias("size_cur")), [*g, "cur"])
    nbr = comm.select(*g, F.col("node").alias("dst"), "community")
    kin = adj.join(nbr, [*g, "dst"]).groupBy(*g, F.col("src").alias("node"), "community") \
        .agg(F.sum("w").alias("kin"))
    rows = _with_m(kin.join(ni2, [*g, "node"]).join(tot, [*g, "community"]), m, g)
    mm = F.col("m")
    score = F.col("kin") / mm - F.col("k") * F.col("tot") / (2 * mm * mm)
    is_cur = F.col("community") == F.col("cur")
    lone_up = (F.col("size_cur") == 1) & (F.col("size") == 1) & (F.col("community") > F.col("cur"))
    per = rows.groupBy(*g, "node").agg(
        F.max(F.when(~is_cur & ~lone_up, F.struct(F.round(score, digits).alias("s"),
                                                  (-F.col("community")).alias("neg"), score.alias("raw"))))
        .alias("b"),
        F.sum(F.when(is_cur, F.col("kin")).otherwise(F.lit(0.0))).alias("kin_cur"),
        F.first("k").alias("k"), F.first("m").alias("m"), F.first("tot_cur").alias("tot_cur"))
    gain = (F.col("b.raw") - (F.col("kin_cur") / mm - F.col("k") * F.col("tot_cur") / (2 * mm * mm))
            - F.col("k") * F.col("k") / (2 * mm * mm))
    per = per.select(*g, "node", F.when(F.col("b").isNotNull(), -F.col("b.neg")).alias("community"),
                     F.when(F.col("b").isNotNull(), gain).alias("gain"),
                     F.when(F.col("b").isNotNull(), gain * mm).alias("lift"), "kin_cur")
    return per, tot


def round_moves(adj: DataFrame, deg: DataFrame, m: DataFrame, comm: DataFrame, epsilon: float,
                group_cols=(), digits: int = 12) -> DataFrame:
    """Best moves of one round: (g, node, community, gain) with gain > epsilon."""
    per, _ = round_state(adj, deg, m, comm, group_cols, digits)
    return per.where(F.col("gain") > epsilon).select(*_g(group_cols), "node", "community", "gain")


def _modularity_of(per: DataFrame, tot: DataFrame, m: DataFrame, g: list[str]) -> DataFrame:
    """(g, q): textbook modularity of the assignment a round_state was built on."""
    a = per.groupBy(*g).agg(F.sum("kin_cur").alias("_in"))
    b = tot.groupBy(*g).agg(F.sum(F.col("tot") * F.col("tot")).alias("_sq"))
    j = (a.join(b, g) if g else a.withColumn("_sq", b.select("_sq").scalar()))
    j = _with_m(j, m, g)
    return j.select(*g, (F.col("_in") / (2 * F.col("m")) - F.col("_sq") / (4 * F.col("m") * F.col("m"))).alias("q"))


def _parity(node: Column, rnd: int) -> Column:
    return F.pmod(F.xxhash64(node) + F.lit(rnd), F.lit(2)) == 0


def louvain(edges: DataFrame, max_iterations: int | None = None, epsilon: float = 1e-4,
            group_cols=(), init: DataFrame | None = None, checkpoint_every: int = 1,
            stats: list | None = None, min_rise: float = 1e-12, per_weight: bool = False,
            settle: bool = False) -> DataFrame:
    """Level-1 Louvain local moving in bulk rounds. Returns (g, node, community).

    Each round one half of the nodes (by hash parity, alternating) takes its
    best move, so neighbours cannot swap back and forth; lone nodes join
    other lone nodes only downwards in id. A round is kept only if it raises
    the (summed) modularity, so the loop cannot cycle; it ends after two
    rounds in a row (one of each half) that raise it by no more than
    ``min_rise``: the convergence threshold, on modularity, whose scale is the
    same for every graph. With ``max_iterations`` it raises if that many rounds
    don't get there. With ``per_weight`` the threshold is ``epsilon`` / m, so it
    means the same on a graph of any size. With ``settle`` the loop goes on while
    any node has a gain above the threshold: when both halves' rounds are refused,
    the next one takes the moves that are the best of both communities they touch.
    Those don't interact, so their gains add up. The driver
    sees one count and one modularity value per round. The assignment table
    (nodes-sized) is written as a reliable checkpoint after each round;
    without the cut each round's plan would nest the previous one.
    """
    g = _g(group_cols)
    adj = symmetric(edges, g).persist()
    deg = adj.groupBy(*g, F.col("src").alias("node")).agg(F.sum("w").alias("k")).persist()
    m = total_weight(edges, g).persist()
    if init is None:
        comm = deg.select(*g, "node", F.col("node").alias("community"))
    else:
        comm = deg.select(*g, "node").join(init, [*g, "node"], "left") \
            .select(*g, "node", F.coalesce("community", "node").alias("community"))
    comm = iterate.write_table(comm, "louvain-assign")

    gk = g or ["_all"]
    mk = m if g else m.withColumn("_all", F.lit(1))

    over = F.col("lift" if per_weight else "gain") > epsilon

    def info(per, tot, rnd):
        """{group: (modularity, moves for round rnd, moves of both halves)} in one
        job: one row per group (groups are graph partitions: a bounded handful of numbers)."""
        pk = per if g else per.withColumn("_all", F.lit(1))
        tk = tot if g else tot.withColumn("_all", F.lit(1))
        go = over & _parity(F.col("node"), rnd)
        a = pk.groupBy(*gk).agg(F.sum("kin_cur").alias("_in"), F.sum(F.when(go, 1).otherwise(0)).alias("n"),
                                F.sum(F.when(over, 1).otherwise(0)).alias("both"))
        b = tk.groupBy(*gk).agg(F.sum(F.col("tot") * F.col("tot")).alias("_sq"))
        j = a.join(b, gk).join(F.broadcast(mk), gk)
        q = F.col("_in") / (2 * F.col("m")) - F.col("_sq") / (4 * F.col("m") * F.col("m"))
        return {tuple(r[c] for c in g): (r["q"], r["n"] or 0, r["both"] or 0)
                for r in j.select(*gk, q.alias("q"), "n", "both").collect()}

    def apart(per, comm):
        """The moves that are the best of both communities they touch."""
        every = per.where(over).join(comm.select(*g, "node", F.col("community").alias("old")), [*g, "node"])
        touch = every.select(*g, "node", F.col("community").alias("new"), F.struct("gain", "node").alias("rank"),
                             F.explode(F.array("old", "community")).alias("at"))
        top = touch.groupBy(*g, "at").agg(F.max("rank").alias("top"))
        return touch.join(top, [*g, "at"]).where(F.col("rank") == F.col("top")).groupBy(*g, "node", "new") \
            .agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*g, "node", "new")

    def state(assign, rnd):
        per, tot = round_state(adj, deg, m, assign, g)
        per, tot = per.persist(), tot.persist()
        return per, tot, info(per, tot, rnd)

    per, tot, cur = state(comm, 0)
    quiet = 0
    rnd = -1
    while True:
        rnd += 1
        if rnd > 0 and cur is None:
            cur = info(per, tot, rnd)
        settling = quiet >= 2
        n_moves = sum(both if settling else n for _, n, both in cur.values())
        if settling and not n_moves:
            break
        accepted = 0
        if n_moves:
            moves = apart(per, comm) if settling else per.where(over & _parity(F.col("node"), rnd)) \
                .select(*g, "node", F.col("community").alias("new"))
            nxt = iterate.write_table(comm.join(moves, [*g, "node"], "left").select(
                *g, "node", F.coalesce("new", "community").alias("community")), "louvain-assign")
            per_n, tot_n, new = state(nxt, rnd + 1)
            better = [k for k in new if new[k][0] > cur.get(k, (float("-inf"),))[0] + min_rise]
            accepted = len(better)
            if accepted == len(new):
                per.unpersist()
                tot.unpersist()
                comm, per, tot, cur = nxt, per_n, tot_n, new
            elif accepted:
                # grouped: improved groups take the new assignment, the others keep
                # theirs; the state is rebuilt from the written table (flat plans)
                keys = per.sparkSession.createDataFrame([list(k) for k in better], per.select(*g).schema)
                merged = nxt.join(keys, g, "left_semi").unionByName(comm.join(keys, g, "left_anti"))
                comm = iterate.write_table(merged, "louvain-assign")
                for df in (per, tot, per_n, tot_n):
                    df.unpersist()
                per, tot, cur = state(comm, rnd + 1)
            else:
                per_n.unpersist()
                tot_n.unpersist()
                cur = None
        else:
            cur = None
        if stats is not None:
            stats.append({"round": rnd + 1, "moves": n_moves if accepted else 0, "groups_improved": accepted})
        quiet = 0 if accepted else quiet + 1
        if quiet >= 2 and not settle or settling and not accepted:
            break
        if max_iterations is not None and rnd + 1 >= max_iterations:
            raise RuntimeError(f"louvain: still improving after {max_iterations} rounds")
    per.unpersist()
    tot.unpersist()
    adj.unpersist()
    deg.unpersist()
    m.unpersist()
    return smallest_member_ids(comm, g)


def smallest_member_ids(comm: DataFrame, group_cols=()) -> DataFrame:
    """Rename every community after its smallest member."""
    g = _g(group_cols)
    names = comm.groupBy(*g, "community").agg(F.min("node").alias("_id"))
    return comm.join(names, [*g, "community"]).select(*g, "node", F.col("_id").alias("community"))


# ------------------------------------------------------------------ reports

def community_sizes(communities: DataFrame) -> DataFrame:
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.max("size").alias("largest"),
                     F.min("size").alias("smallest"), F.avg("size").alias("mean_size"))


def community_top_n(communities: DataFrame, n: int = 5, members: int = 10) -> DataFrame:
    """The n largest communities with their (at most) `members` smallest nodes.

    The per-community member cap is pushed below the shuffle by Spark's
    window group limit, so a huge community never travels whole.
    """
    from pyspark.sql import Window
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), F.asc("community")).limit(n)
    w = Window.partitionBy("community").orderBy("node")
    firsts = communities.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= members)
    listed = firsts.join(F.broadcast(top.select("community")), "community") \
        .groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))
    return top.join(listed, "community")


# ------------------------------------------------------------------ partitions

def boundary_exchange(boundary: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node, partition, community): boundary nodes with their assignment in
    each partition they appear in."""
    return boundary.join(assignments, ["partition", "node"]).select("node", "partition", "community")


def majority_vote(context: DataFrame) -> DataFrame:
    """Per node seen in more than one partition: the most frequent community,
    ties to the lowest id. (node, community, n_partitions, changes)."""
    votes = context.groupBy("node", "community").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("node").agg(
        F.max(F.struct("votes", (-F.col("community")).alias("neg"))).alias("b"),
        F.sum("votes").alias("n_partitions"))
    best = best.where(F.col("n_partitions") > 1) \
        .select("node", (-F.col("b.neg")).alias("majority"), "n_partitions",
                (F.col("n_partitions") - F.col("b.votes")).alias("changes"))
    return best


def apply_vote(assignments: DataFrame, vote: DataFrame) -> DataFrame:
    """Write the majority back into every partition's assignment."""
    return assignments.join(vote.select("node", "majority"), "node", "left") \
        .select("partition", "node", F.coalesce("majority", "community").alias("community"))


# ------------------------------------------------------------------ deltas

def apply_delta(graph: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """graph (i, j, weight) with removed edges taken out and added edges put in
    (an added edge that exists gets the new weight)."""
    out = graph
    if removed is not None:
        out = out.join(removed.select("i", "j"), ["i", "j"], "left_anti")
    out = out.join(added.select("i", "j"), ["i", "j"], "left_anti")
    return out.unionByName(added.select("i", "j", F.col("weight").cast(out.schema["weight"].dataType)))


def affected_nodes(added: DataFrame, removed: DataFrame | None, communities: DataFrame) -> DataFrame:
    """Ends of changed edges with their current community (null if new)."""
    ends = added.select(F.explode(F.array("i", "j")).alias("node"))
    if removed is not None:
        ends = ends.union(removed.select(F.explode(F.array("i", "j")).alias("node")))
    return ends.distinct().join(communities, "node", "left").select("node", "community")


def khop_region(graph: DataFrame, affected: DataFrame, communities: DataFrame, hops: int = 2) -> DataFrame:
    """Members of affected communities, then `hops` rounds of neighbours. (node)."""
    comms = affected.where(F.col("community").isNotNull()).select("community").distinct()
    region = communities.join(comms, "community", "left_semi").select("node").distinct()
    adj = symmetric(graph).select(F.col("src").alias("node"), F.col("dst")).repartition("node").persist()   # once for all hops
    for _ in range(hops):
        step = adj.join(region, "node", "left_semi").select(F.col("dst").alias("node"))
        grown = iterate.materialize(region.union(step).distinct())
        region.unpersist()
        region = grown
    adj.unpersist()
    return region


def induced_subgraph(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes`."""
    return graph.join(nodes.select(F.col("node").alias("i")), "i", "left_semi") \
        .join(nodes.select(F.col("node").alias("j")), "j", "left_semi") \
        .select("i", "j", "weight")


def incremental_update(graph: DataFrame, communities: DataFrame, added: DataFrame,
                       removed: DataFrame | None = None, hops: int = 2, local_moving=None, **louvain_kw):
    """Louvain again on the k-hop region around a delta; old ids elsewhere.
    ``local_moving``: another function of the edges instead of ``louvain``.

    Returns (updated communities (node, community), region nodes). Old and
    new ids live in separate namespaces until the final renaming to the
    smallest member, so a new community cannot merge with an old one by name.
    """
    g2 = apply_delta(graph, added, removed)
    aff = affected_nodes(added, removed, communities)
    region = khop_region(g2, aff, communities, hops)
    sub = induced_subgraph(g2, region)
    new = (local_moving or louvain)(sub, **louvain_kw)
    merged = communities.join(new.withColumnRenamed("community", "new"), "node", "full") \
        .select("node", F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias("ns"), F.col("new").alias("id")))
                .otherwise(F.struct(F.lit(0).alias("ns"), F.col("community").alias("id"))).alias("key"))
    names = merged.groupBy("key").agg(F.min("node").alias("community"))
    return merged.join(names, "key").select("node", "community"), region
