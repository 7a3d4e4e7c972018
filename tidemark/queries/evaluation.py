"""Evaluation and model queries over fixed scores and over the document features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import boosting, metrics, models, topk
from tidemark.plans import feature_plan as plans
from tidemark.queries import features
from tidemark.queries.registry import query, table
from tidemark.session import materialize, scratch_path


def label_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a fixed score that has many ties."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    prob = (F.col("n_chars") % 100) / 100
    return docs.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), prob.alias("prob"),
        (prob >= 0.5).cast("int").alias("prediction"),
    )


PRED_SQL = """
pred AS (SELECT doc_id AS id, quality AS label, (n_chars % 100) / 100.0::DOUBLE AS prob, CAST(n_chars % 100 >= 50 AS INT) AS prediction
  FROM documents JOIN labels USING (doc_id))"""


def order_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders scored by price: nearly all scores differ."""
    return table(spark, d, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("prob"),
        F.col("o_orderpriority").alias("model"),
    )


ORDER_SQL = "scores AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS label, o_totalprice AS prob, o_orderpriority AS model FROM orders)"


def curve_sql(source: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
per_score AS (SELECT {group}prob, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {group}prob),
curve AS (SELECT {group}prob, pos, neg, sum(pos) OVER ({part}ORDER BY prob DESC) AS tp, sum(neg) OVER ({part}ORDER BY prob DESC) AS fp,
  sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM per_score),
ranked AS (SELECT {group}round(sum(neg * (tp - pos / 2)) / (max(n_pos)::DOUBLE * max(n_neg)), 6)::DOUBLE AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / max(n_pos), 6)::DOUBLE AS pr_auc FROM curve {"GROUP BY " + by if by else ""})"""


F1_SQL = """round(2.0 * sum(label * prediction) / (sum(label) + sum(prediction)), 6)::DOUBLE"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("a7_roc_auc", f"WITH {ORDER_SQL}, {curve_sql('scores', 'model')} SELECT model, roc_auc FROM ranked")
def a7(spark, d):
    return rounded(metrics.roc_auc(order_scores(spark, d), by=["model"]), "roc_auc")


@query("a8_f1", f"WITH {PRED_SQL} SELECT {F1_SQL} AS f1 FROM pred")
def a8(spark, d):
    return rounded(metrics.f1(label_predictions(spark, d)), "f1")


@query("a9_average_precision", f"WITH {ORDER_SQL}, {curve_sql('scores')} SELECT pr_auc FROM ranked")
def a9(spark, d):
    return rounded(metrics.average_precision(order_scores(spark, d)), "pr_auc")


@query("w3_curve_points", f"""
    WITH {ORDER_SQL}, {curve_sql('scores')} SELECT prob AS score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM curve""")
def w3(spark, d):
    points = metrics.curve_points(order_scores(spark, d), ranges=6)
    return points.select("score", "pos", "neg", "tp", "fp")


@query("a10_best_model", """
    SELECT user_id, model, round(auc, 6) AS roc_auc FROM (
      SELECT user_id, model, auc, row_number() OVER (PARTITION BY user_id ORDER BY auc DESC, list_position(['xgb', 'lr', 'rf'], model)) AS r
      FROM (SELECT user_id, ['xgb', 'lr', 'rf'][event_id % 3 + 1] AS model, max(floor(value / 100) / 10) AS auc FROM events GROUP BY 1, 2)) WHERE r = 1""")
def a10(spark, d):
    kinds = F.array(F.lit("xgb"), F.lit("lr"), F.lit("rf"))
    runs = table(spark, d, "events").withColumn("model", F.get(kinds, (F.col("event_id") % 3).cast("int")))
    scores = runs.groupBy("user_id", "model").agg(F.max(F.floor(F.col("value") / 100) / 10).alias("roc_auc"))
    return rounded(metrics.best_model(scores, by=["user_id"]), "roc_auc")


@query("j8_wrong_predictions", f"WITH {PRED_SQL} SELECT id, prob, prediction, label FROM pred WHERE prediction <> label")
def j8(spark, d):
    rows = label_predictions(spark, d)
    return metrics.wrong_predictions(rows.drop("label"), rows.select("id", "label"))


@query("j9_error_report", f"""
    WITH {PRED_SQL}, picked AS (SELECT * FROM pred WHERE prediction <> label ORDER BY md5(id || '-42'), id LIMIT 3)
    SELECT id, prediction, 1 - prediction AS should_be, lang, source, CASE WHEN n_chars % 2 = 0 THEN 'size: unknown' END AS reason
    FROM picked JOIN documents ON doc_id = id""")
def j9(spark, d):
    docs = table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("id"), "lang", "source")
    reasons = docs.filter("n_chars % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("size: unknown").alias("reason"))
    wrong = metrics.wrong_predictions(label_predictions(spark, d))
    return metrics.error_report(wrong, records, reasons).select("id", "prediction", "should_be", "lang", "source", "reason")


@query("l3_rank_importance", """
    SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS place
    FROM (SELECT p_brand AS feature, round(sum(p_size - 25) / count(*), 6) AS importance FROM part GROUP BY 1)""")
def l3(spark, d):
    value = F.round(F.sum(F.col("p_size") - 25) / F.count(F.lit(1)), 6)
    ranked = topk.rank_importance(table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(value.alias("importance")))
    # One row per feature: the list is short, so positions come from a single sorted array.
    order = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("minus"), F.col("feature").alias("feature"))))
    listed = ranked.agg(order.alias("l")).select(F.posexplode("l").alias("pos", "e"))
    return listed.select(F.col("e.feature").alias("feature"), (-F.col("e.minus")).alias("importance"), (F.col("pos") + 1).alias("place"))


@query("l4_sample_rows", "SELECT doc_id, quality FROM labels ORDER BY md5(doc_id || '-42'), doc_id LIMIT 3")
def l4(spark, d):
    return topk.sample_rows(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", 3)


@query("l5_sample_balanced", """
    SELECT side, draw::INT AS draw, doc_id FROM (
      SELECT side, draw, doc_id, row_number() OVER (PARTITION BY side, draw ORDER BY md5(doc_id || '-42-' || draw), doc_id) AS r
      FROM (SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'rest' END AS side, doc_id FROM documents LEFT JOIN labels USING (doc_id)), range(0, 3) t(draw))
    WHERE r = 1""")
def l5(spark, d):
    from tidemark.operators.etl import label_side

    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return topk.sample_balanced(rows.withColumn("side", label_side(F.col("quality"))), "doc_id", "side", 3)


@query("f15_evaluate", f"""
    WITH {PRED_SQL}, {curve_sql('pred')} SELECT roc_auc, pr_auc, (SELECT {F1_SQL} FROM pred) AS f1 FROM ranked""")
def f15(spark, d):
    return rounded(metrics.evaluate(label_predictions(spark, d)), "roc_auc", "pr_auc", "f1")


# ---- models ---------------------------------------------------------------------------------------

def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Wide document features with the quality label and a split by document number."""
    k = F.col("id")
    split = F.when(k % 10 < 6, "train").when(k % 10 < 8, "val").otherwise("test")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return features.wide(spark, d).join(labels, "id", "left").withColumn("split", split)


def scored(spark: SparkSession, d: str, kind: str) -> DataFrame:
    subs = plans.collect_plan(features.plan(spark))
    rows = materialize(labelled(spark, d), "wide")  # fitted and scored
    fitted = models.fit(kind, rows.filter("split = 'train'"), subs)
    return models.score(fitted, rows, keep=["id", "split"])


MODEL_SQL = """
    SELECT doc_id AS id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
      TRUE AS in_range, TRUE AS consistent, TRUE AS beats_chance FROM documents"""


def checked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per record: whether the probability is one, the class agrees with it, and training AUC is over a half."""
    known = rows.filter("split = 'train'").join(labels, "id").filter("label is not null")
    auc = metrics.evaluate(known).first()["roc_auc"]
    agrees = (F.col("prob") == 0.5) | ((F.col("prob") > 0.5).cast("int") == F.col("prediction"))
    return rows.select(
        "id", "split", F.col("prob").between(0, 1).alias("in_range"), agrees.alias("consistent"),
        F.lit(auc > 0.5).alias("beats_chance"))


def fitted_query(spark: SparkSession, d: str, kind: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return checked(materialize(scored(spark, d, kind), "scores"), labels)


@query("f11_fit_logistic", MODEL_SQL)
def f11(spark, d):
    return fitted_query(spark, d, "lr")


@query("f11_zero_gradient", """
    SELECT 6 AS features, TRUE AS stationary FROM labels WHERE doc_id % 10 < 6 HAVING count(*) > 0""")
def f11_gradient(spark, d):
    """At the optimum the gradient of the penalised loss is zero: held against the data, by expressions."""
    from pyspark.ml.functions import vector_to_array

    subs = plans.collect_plan(features.plan(spark))
    train = labelled(spark, d).filter("split = 'train' AND label IS NOT NULL")
    fitted = models.fit("lr", train, subs)
    matrix, names = models.design_matrix(train, fitted.plan, "lr", keep=["id", "label"])
    rows = fitted.model.transform(matrix).select(
        (vector_to_array("probability")[1] - F.col("label")).alias("gap"), F.posexplode(vector_to_array("features")).alias("at", "x"))
    sums = rows.groupBy("at").agg(F.avg(F.col("gap") * F.col("x")).alias("slope"), F.avg(F.abs("x")).alias("size"),
                                  F.count(F.lit(1)).alias("n"))
    weights = spark.createDataFrame(list(enumerate(map(float, fitted.model.coefficients.toArray()))), "at int, weight double")
    gradient = F.abs(F.col("slope") + F.col("weight") / F.col("n"))
    return sums.join(weights, "at").agg(
        F.lit(len(subs)).alias("features"), F.bool_and(gradient <= 0.001 * F.greatest("size", F.lit(1.0))).alias("stationary"))


@query("f12_fit_forest", MODEL_SQL)
def f12(spark, d):
    return fitted_query(spark, d, "rf")


@query("f13_fit_boosted", MODEL_SQL)
def f13(spark, d):
    return fitted_query(spark, d, "xgb")


@query("f13_gap_branch", f"""
    WITH {features.BASE_SQL},
    known AS (SELECT density_ratio, shape_has_digit, (0.5 - quality)::DOUBLE AS g FROM wide JOIN labels ON id = doc_id WHERE quality IS NOT NULL),
    long AS (SELECT 0 AS f, 'density--ratio' AS feature, density_ratio AS x, g FROM known
      UNION ALL SELECT 1, 'shape--has_digit', shape_has_digit, g FROM known),
    edges AS (SELECT DISTINCT f, feature, x AS edge FROM long WHERE x IS NOT NULL),
    sides AS (SELECT f, e.feature, edge, gap_left, sum(g) AS g, count(*) / 4 AS h,
        sum(CASE WHEN coalesce(x <= edge, gap_left) THEN g ELSE 0 END) AS gl, sum(CASE WHEN coalesce(x <= edge, gap_left) THEN 1 ELSE 0 END) / 4 AS hl
      FROM edges e JOIN long l USING (f), (VALUES (TRUE), (FALSE)) s(gap_left) GROUP BY ALL)
    SELECT feature, edge, gap_left, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 6)::DOUBLE AS gain
    FROM sides WHERE hl >= 1 AND h - hl >= 1
    ORDER BY round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9) DESC, f, edge, gap_left DESC LIMIT 1""")
def f13_gaps(spark, d):
    """The first split of boosted trees over two features with gaps: its edge, and the side on which gaps go."""
    names = ["density--ratio", "shape--has_digit"]
    rows = labelled(spark, d).select(F.array(*[F.col(f"`{n}`") for n in names]).alias("features"), "label")
    return rounded(boosting.splits(spark, boosting.fit(rows, names, trees=1, depth=1)), "gain").drop("tree", "node")


@query("f14_score", """
    SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n,
      TRUE AS in_range, TRUE AS consistent FROM documents GROUP BY 1""")
def f14(spark, d):
    rows = scored(spark, d, "lr")
    agrees = (F.col("prob") > 0.5).cast("int") == F.col("prediction")
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prob").between(0, 1)).alias("in_range"),
        F.bool_and(agrees | (F.col("prob") == 0.5)).alias("consistent"),
    )


@query("f16_run_experiment", """
    SELECT model, split, TRUE AS agrees, TRUE AS best_on_val FROM (VALUES ('lr'), ('rf'), ('xgb')) m(model), (VALUES ('val'), ('test')) s(split)""")
def f16(spark, d):
    """Stored metrics are those of the stored predictions, and the chosen kind is best on validation."""
    subs = plans.collect_plan(features.plan(spark))
    run = models.run_experiment(labelled(spark, d), subs)
    again = metrics.evaluate(run.predictions, ["model", "split"])
    names = ["roc_auc", "f1", "pr_auc"]
    both = run.metrics.join(again.select("model", "split", *[F.col(c).alias(f"again_{c}") for c in names]), ["model", "split"])
    val = run.metrics.filter("split = 'val'")
    best = val.filter(F.col("model") == run.best).select("roc_auc").first()[0] == val.agg(F.max("roc_auc")).first()[0]
    agrees = F.lit(True)
    for c in names:
        agrees = agrees & (F.abs(F.col(c) - F.col(f"again_{c}")) < 1e-9)
    return both.select("model", "split", agrees.alias("agrees"), F.lit(best).alias("best_on_val"))


@query("f17_predict", MODEL_SQL)
def f17(spark, d):
    subs = plans.collect_plan(features.plan(spark))
    rows = materialize(labelled(spark, d), "labelled")
    run = models.run_experiment(rows, subs)
    best, path = run.models[run.best], scratch_path(spark, "model")
    models.save(best, path)
    found = models.predict(models.load(best.kind, path, best.plan, best.names), rows).join(
        rows.select("id", "split"), "id")
    return checked(materialize(found, "scores"), rows.select("id", "label"))
