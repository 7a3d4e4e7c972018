"""Experiment trees as tables: path ids, roll-ups, leaderboards and their history.

Node ids are paths: the root is ``0`` and child ``i`` of ``p`` is ``p-i``. All functions take ``run``,
the column that tells experiments apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.topk import rank_per_key, top_k_per_key
from tidemark.session import materialize

TOP_SIZES = [1, 3, 5]
METRICS = ["test_roc_auc", "test_f1", "test_pr_auc"]


def path_ids(node_id: Column) -> Column:
    """The node and all its ancestors, root first."""
    parts = F.split(node_id, "-")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-")
    )


def parent_id(node_id: Column) -> Column:
    """Path without its last step; null for the root."""
    cut = F.regexp_replace(node_id, "-[^-]*$", "")
    return F.when(node_id.contains("-"), cut)


def rollup_tree(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Visits and total reward per node from a rollout log (selected_leaf, reward).

    Every node on a selected path gets the reward; visits start at 1. Sums combine before the
    shuffle, so the root, which is on every path, is no hot key.
    """
    steps = log.select(run, F.explode(path_ids(F.col("selected_leaf"))).alias("node_id"), "reward")
    return steps.groupBy(run, "node_id").agg(
        (F.count(F.lit(1)) + 1).alias("visits"), F.sum("reward").alias("total_reward")
    )


def rank_nodes(nodes: DataFrame, by: str, run: str = "run_id", top: int | None = None) -> DataFrame:
    """Rank of explored nodes by falling score, failed ones left out, ties by creation order."""
    order = [F.desc(by), F.asc("seq")]
    explored = nodes.filter("error is null")
    if top is not None:
        return top_k_per_key(explored, [run], order, top)
    return rank_per_key(explored, [run], order)


def leaderboard(nodes: DataFrame, by: str, run: str = "run_id") -> DataFrame:
    """Ids and mean test scores of the top 1, 3 and 5 nodes of every run."""
    top = rank_nodes(nodes, by, run, max(TOP_SIZES))
    columns = []
    for size in TOP_SIZES:
        inside = F.col("rank") <= size
        ids = F.array_sort(F.collect_list(F.when(inside, F.struct("rank", "node_id"))))
        columns.append(F.array_join(F.transform(ids, lambda s: s["node_id"]), ",").alias(f"top{size}_ids"))
        columns += [
            F.avg(F.when(inside, F.col(m))).alias(f"top{size}_{m.removeprefix('test_')}") for m in METRICS
        ]
    return top.groupBy(run).agg(*columns)


def path_max(nodes: DataFrame, run: str = "run_id", max_depth: int = 7) -> DataFrame:
    """Best reward on the way from each terminal node to the root.

    A terminal node is failed or at full depth, and failed nodes count 0. The node itself wins ties,
    then the nearest ancestor.
    """
    reward = F.when(F.col("error").isNotNull(), 0.0).otherwise(F.col("val_roc_auc"))
    scored = nodes.select(run, "node_id", "error", reward.alias("reward"))
    depth = F.size(F.split("node_id", "-")) - 1
    leaves = scored.filter(F.col("error").isNotNull() | (depth == max_depth))
    steps = leaves.select(run, F.col("node_id").alias("leaf_id"), F.posexplode(path_ids(F.col("node_id"))).alias("step", "node_id"))
    found = steps.join(scored.drop("error"), [run, "node_id"])
    best = F.max_by(F.struct("node_id", "reward"), F.struct("reward", "step"))
    return found.groupBy(run, "leaf_id").agg(best.alias("b")).select(
        run, "leaf_id", F.col("b.node_id").alias("best_id"), F.col("b.reward").alias("max_reward")
    )


def uct(stats: DataFrame, weight: float = 1.0, run: str = "run_id") -> DataFrame:
    """Upper confidence score of every node with a parent: mean reward plus the exploration term."""
    parents = stats.select(run, F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    children = stats.withColumn("parent_id", parent_id(F.col("node_id"))).filter("parent_id is not null")
    explore = F.sqrt(F.log(F.col("parent_visits").cast("double")) / F.col("visits"))
    return children.join(parents, [run, "parent_id"]).withColumn(
        "uct", F.col("total_reward") / F.col("visits") + weight * explore
    )


def best_child(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """The child with the best score per parent; scores compare after rounding, ties to the first id."""
    lowest = F.struct((-F.round("uct", 6)).alias("s"), F.col("node_id").alias("id"))
    return scores.groupBy(run, "parent_id").agg(F.min(lowest).alias("b")).select(
        run, "parent_id", F.col("b.id").alias("best_child"), (-F.col("b.s")).alias("uct")
    )


# ---- leaderboard history --------------------------------------------------------------------------

HISTORY_BLOCK_BITS = 10


def _merged(a: Column, b: Column) -> Column:
    """The best of two states, which are short arrays of entries, best first."""
    return F.slice(F.array_sort(F.concat(a, b)), 1, max(TOP_SIZES))


def _running_best(df: DataFrame, key: list[str], order: str, steps: int) -> DataFrame:
    """``state`` merged with those of the up to ``2 ** steps - 1`` rows before: each step doubles the reach."""
    window = Window.partitionBy(*key).orderBy(order)
    for i in range(steps):
        earlier = F.lag("state", 2**i).over(window)
        df = df.withColumn("state", F.when(earlier.isNull(), F.col("state")).otherwise(_merged(F.col("state"), earlier)))
    return df


def leaderboard_history(
    nodes: DataFrame, by: str = "val_roc_auc", run: str = "run_id", ranges: int | None = None
) -> DataFrame:
    """After each rollout, ids and mean test scores of the best 1, 3 and 5 nodes explored so far.

    ``nodes`` has one explored node per (run, rollout). The five best so far are a state that merges: a run is
    cut to blocks of consecutive rollouts, states run through every block on its own, the blocks' last states run
    through the run, and what earlier blocks hold is merged in. So a long run is many tasks, no row
    holds more than five entries and nodes are never paired with rollouts.
    """
    base = nodes.select(run, "rollout", "seq", "node_id", "error", F.col(by).alias("score"), *METRICS)
    entry = F.struct((-F.col("score")).alias("minus"), "seq", "node_id", *METRICS)
    explored = F.col("error").isNull() & F.col("score").isNotNull()
    rows = rank_per_key(base, [run], [F.asc("rollout")], "position", ranges).select(
        run, "rollout", "position", F.shiftright(F.col("position") - 1, HISTORY_BLOCK_BITS).alias("block"),
        F.filter(F.array(F.when(explored, entry)), lambda x: x.isNotNull()).alias("state"))
    rows = materialize(_running_best(rows, [run, "block"], "position", HISTORY_BLOCK_BITS), "history")

    last = rows.groupBy(run, "block").agg(F.max_by("state", "position").alias("state"))
    steps = (rows.agg(F.max("block")).first()[0] or 0).bit_length()
    carry = _running_best(last, [run], "block", steps).select(
        run, (F.col("block") + 1).alias("block"), F.col("state").alias("carry"))
    both = rows.join(carry, [run, "block"], "left")
    state = F.when(F.col("carry").isNull(), F.col("state")).otherwise(_merged(F.col("state"), F.col("carry")))
    best = both.select(run, "rollout", state.alias("state"))

    def ids(n: int) -> Column:
        return F.array_join(F.transform(F.slice("state", 1, n), lambda x: x["node_id"]), ",")

    def mean(n: int, metric: str) -> Column:
        scores = F.transform(F.slice("state", 1, n), lambda x: x[metric])
        return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda total, x: total + x), F.size(scores))

    return best.select(
        run, "rollout", *[ids(n).alias(f"top{n}_ids") for n in TOP_SIZES],
        *[mean(n, m).alias(f"top{n}_{m.removeprefix('test_')}") for n in TOP_SIZES for m in METRICS])
