"""Experiment-tree queries. Every 121 events make one run: a full ternary tree of depth 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import experiments as ops
from tidemark.queries.registry import query, table

NODE_SQL = """
numbered AS (SELECT event_id, event_id // 121 AS run_id, event_id % 121 AS n, value, event_type FROM events),
nodes AS (SELECT run_id, n AS seq, n AS rollout, CASE WHEN n = 0 THEN '0' WHEN n < 4 THEN '0-' || (n - 1)
    WHEN n < 13 THEN '0-' || ((n - 4) // 3) || '-' || ((n - 4) % 3)
    WHEN n < 40 THEN '0-' || ((n - 13) // 9) || '-' || ((n - 13) // 3 % 3) || '-' || ((n - 13) % 3)
    ELSE '0-' || ((n - 40) // 27) || '-' || ((n - 40) // 9 % 3) || '-' || ((n - 40) // 3 % 3) || '-' || ((n - 40) % 3) END AS node_id,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error, floor(value / 10) / 50 AS val_roc_auc, value / 503 AS test_roc_auc,
  value / 601 AS test_f1, value / 701 AS test_pr_auc, value / 500 AS reward FROM numbered)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 121

    def digits(first: int, *powers: int):
        steps = [F.pmod(F.floor((n - first) / p), F.lit(3)).cast("string") for p in powers]
        return F.concat_ws("-", F.lit("0"), *steps)

    node_id = (
        F.when(n == 0, "0").when(n < 4, digits(1, 1)).when(n < 13, digits(4, 3, 1))
        .when(n < 40, digits(13, 9, 3, 1)).otherwise(digits(40, 27, 9, 3, 1))
    )
    value = F.col("value")
    return table(spark, d, "events").select(
        F.floor(F.col("event_id") / 121).alias("run_id"), n.alias("seq"), n.alias("rollout"), node_id.alias("node_id"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), (F.floor(value / 10) / 50).alias("val_roc_auc"),
        (value / 503).alias("test_roc_auc"), (value / 601).alias("test_f1"), (value / 701).alias("test_pr_auc"),
        (value / 500).alias("reward"),
    )


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("run_id", F.col("node_id").alias("selected_leaf"), "reward")


TREE_SQL = f"""{NODE_SQL},
steps AS (SELECT run_id, unnest(list_transform(range(1, len(string_split(node_id, '-')) + 1),
    lambda i: array_to_string(string_split(node_id, '-')[1:i], '-'))) AS node_id, reward FROM nodes),
tree AS (SELECT run_id, node_id, count(*) + 1 AS visits, sum(reward) AS total_reward FROM steps GROUP BY 1, 2)"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a13_rollup_tree", f"WITH {TREE_SQL} SELECT run_id, node_id, visits, round(total_reward, 6) AS total_reward FROM tree")
def a13(spark, d):
    return _round(ops.rollup_tree(rollouts(spark, d)), "total_reward")


@query("w2_rank_nodes", f"""
    WITH {NODE_SQL}, ok AS (SELECT * FROM nodes WHERE error IS NULL)
    SELECT run_id, node_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY val_roc_auc DESC, seq) AS INT) AS val_rank,
      CAST(row_number() OVER (PARTITION BY run_id ORDER BY test_roc_auc DESC, seq) AS INT) AS test_rank FROM ok""")
def w2(spark, d):
    by_val = ops.rank_nodes(nodes(spark, d), "val_roc_auc").withColumnRenamed("rank", "val_rank")
    by_test = ops.rank_nodes(by_val, "test_roc_auc").withColumnRenamed("rank", "test_rank")
    return by_test.select("run_id", "node_id", "val_rank", "test_rank")


def _top_columns(source: str) -> str:
    out = []
    for n in ops.TOP_SIZES:
        out.append(f"string_agg(node_id, ',' ORDER BY r) FILTER (r <= {n}) AS top{n}_ids")
        out += [
            f"round(avg({m}) FILTER (r <= {n}), 6) AS top{n}_{m.removeprefix('test_')}" for m in ops.METRICS
        ]
    return ", ".join(out)


@query("a11_leaderboard", f"""
    WITH {NODE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_roc_auc DESC, seq) AS r FROM nodes WHERE error IS NULL)
    SELECT run_id, {_top_columns('ranked')} FROM ranked GROUP BY run_id""")
def a11(spark, d):
    board = ops.leaderboard(nodes(spark, d), "val_roc_auc")
    return _round(board, *[c for c in board.columns if c.startswith("top") and not c.endswith("_ids")])


@query("a11_leaderboard_test", f"""
    WITH {NODE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY test_roc_auc DESC, seq) AS r FROM nodes WHERE error IS NULL)
    SELECT run_id, {_top_columns('ranked')} FROM ranked GROUP BY run_id""")
def a11_test(spark, d):
    board = ops.leaderboard(nodes(spark, d), "test_roc_auc")
    return _round(board, *[c for c in board.columns if c.startswith("top") and not c.endswith("_ids")])


@query("w4_path_max", f"""
    WITH {NODE_SQL}, scored AS (SELECT run_id, node_id, error, CASE WHEN error IS NOT NULL THEN 0.0 ELSE val_roc_auc END AS reward FROM nodes),
      leaf AS (SELECT run_id, node_id AS leaf_id, unnest(range(1, len(string_split(node_id, '-')) + 1)) AS step FROM scored
        WHERE error IS NOT NULL OR len(string_split(node_id, '-')) = 5),
      path AS (SELECT run_id, leaf_id, step, array_to_string(string_split(leaf_id, '-')[1:step], '-') AS node_id FROM leaf)
    SELECT run_id, leaf_id, node_id AS best_id, reward::DOUBLE AS max_reward FROM (
      SELECT run_id, leaf_id, node_id, reward, row_number() OVER (PARTITION BY run_id, leaf_id ORDER BY reward DESC, step DESC) AS r
      FROM path JOIN scored USING (run_id, node_id)) WHERE r = 1""")
def w4(spark, d):
    return ops.path_max(nodes(spark, d), max_depth=4)


UCT_SQL = f"""{TREE_SQL},
scores AS (SELECT c.run_id, p.node_id AS parent_id, c.node_id, c.total_reward / c.visits + sqrt(ln(p.visits) / c.visits) AS uct
  FROM tree c JOIN tree p ON p.run_id = c.run_id AND c.node_id <> '0' AND p.node_id = regexp_replace(c.node_id, '-[^-]*$', ''))"""


@query("w5_uct", f"WITH {UCT_SQL} SELECT run_id, parent_id, node_id, round(uct, 6) AS uct FROM scores")
def w5(spark, d):
    return _round(ops.uct(ops.rollup_tree(rollouts(spark, d))).select("run_id", "parent_id", "node_id", "uct"), "uct")


@query("w5_best_child", f"""
    WITH {UCT_SQL} SELECT run_id, parent_id, node_id AS best_child, uct FROM (
      SELECT run_id, parent_id, node_id, round(uct, 6) AS uct, row_number() OVER (PARTITION BY run_id, parent_id ORDER BY round(uct, 6) DESC, node_id) AS r FROM scores) WHERE r = 1""")
def w5_best(spark, d):
    return ops.best_child(ops.uct(ops.rollup_tree(rollouts(spark, d))))


HISTORY_SQL = f"""
    WITH {NODE_SQL}, seen AS (SELECT a.run_id, a.rollout, b.node_id, b.test_roc_auc, b.test_f1, b.test_pr_auc,
        row_number() OVER (PARTITION BY a.run_id, a.rollout ORDER BY b.val_roc_auc DESC, b.seq) AS r
      FROM nodes a LEFT JOIN nodes b ON b.run_id = a.run_id AND b.rollout <= a.rollout AND b.error IS NULL)
    SELECT run_id, rollout, {_top_columns('seen')} FROM seen GROUP BY run_id, rollout"""


def _history(spark, d, **options) -> DataFrame:
    rows = ops.leaderboard_history(nodes(spark, d), **options)
    rows = _round(rows, *[c for c in rows.columns if c.startswith("top") and not c.endswith("_ids")])
    return rows.withColumns({f"top{n}_ids": F.nullif(f"top{n}_ids", F.lit("")) for n in ops.TOP_SIZES})


@query("w6_leaderboard_history", HISTORY_SQL)
def w6(spark, d):
    return _history(spark, d)


@query("w6_history_in_ranges", HISTORY_SQL)
def w6_ranges(spark, d):
    return _history(spark, d, ranges=10)
