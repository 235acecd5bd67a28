"""Queries on features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, clean, joins, ml, svm, windows
from . import table_queries  # noqa: F401  (registers clean_houses)
from .registry import ORACLES, query
from .tables import cte, table

HOUSE_COLUMNS = ["months_listed", "bedrooms", "house_type", "year", "month", "log_area", *(f"city_City{k}" for k in range(5))]


def _houses(spark, d):
    return ml.house_features(clean.clean_houses(table(spark, d, "houses")), [f"City{k}" for k in range(5)])


def _recipes(spark, d):
    return ml.recipe_features(clean.clean_recipes(table(spark, d, "recipes")))


@query("WITH q AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (b - a), 9) AS scaled FROM orders, q")
def scale_minmax(spark, d):
    return ml.scale(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("scaled")), ["scaled"]).withColumn("scaled", F.round("scaled", 9))


@query("WITH q AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / b, 7) AS scaled FROM orders, q")
def scale_standard(spark, d):
    return ml.scale(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("scaled")), ["scaled"], "standard").withColumn("scaled", F.round("scaled", 7))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, 1 AS times FROM orders")
def split_rows(spark, d):
    """Every row is on one side of the split, once."""
    train, test = ml.split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return train.unionByName(test).groupBy("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")).agg(F.count(F.lit(1)).cast("int").alias("times"))


@query(f"""WITH {cte('recipes')} SELECT recipe, calories, protein, cast(regexp_extract(servings, '^\\s*(\\d+)', 1) AS int) AS servings, CASE WHEN high_traffic = 'High' THEN 1 ELSE 0 END AS label,
    {', '.join(f'''cast(coalesce(category = '{c}', false) {"OR category = 'Chicken Breast'" if c == 'Chicken' else ''} AS int) AS "category_{c}"''' for c in clean.RECIPE_CATEGORIES)} FROM recipes WHERE calories IS NOT NULL AND protein IS NOT NULL""")
def recipe_features(spark, d):
    return _recipes(spark, d)


@query(f"""WITH h AS ({ORACLES["clean_houses"]}) SELECT house_id, sale_price, months_listed, bedrooms, cast(CASE house_type WHEN 'Detached' THEN 0 WHEN 'Semi-detached' THEN 1 WHEN 'Terraced' THEN 2 END AS int) AS house_type,
    {', '.join(f"""cast(city = 'City{k}' AS int) AS "city_City{k}\"""" for k in range(5))}, cast(year(sale_date) AS int) AS year, cast(month(sale_date) AS int) AS month, round(ln(area), 9) AS log_area FROM h""")
def house_features(spark, d):
    return _houses(spark, d).withColumn("log_area", F.round("log_area", 9))


@query("""WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings), n AS (SELECT q.vec_id AS q, t.vec_id AS t, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v::double[], t.v::double[]), t.vec_id) AS k FROM e q, e t WHERE q.vec_id % 50 = 0 AND t.vec_id % 50 <> 0),
    c AS (SELECT q, label, count(*) AS w FROM n WHERE k <= 7 GROUP BY q, label) SELECT q AS vec_id, label AS vote FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, label) = 1""")
def knn_classify(spark, d):
    """Stated queries: vectors whose id is divisible by 50, against all others."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return ml.knn_classify(rows.where("vec_id % 50 <> 0"), rows.where("vec_id % 50 = 0"), 7, "vec_id", "label")


@query("""WITH e AS (SELECT vec_id, label, embedding::double[] AS v, vec_id // 50 % 5 AS fold FROM embeddings),
    p AS (SELECT q.vec_id AS q, q.label AS ql, t.vec_id AS t, t.label, list_distance(q.v, t.v) AS e, list_sum(list_transform(list_zip(q.v, t.v), lambda x: abs(x[1] - x[2]))) AS m FROM e q, e t WHERE q.vec_id % 50 = 0 AND q.fold <> t.fold),
    d AS (SELECT q, ql, t, label, 'euclidean' AS metric, e AS d FROM p UNION ALL SELECT q, ql, t, label, 'manhattan', m FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric, q ORDER BY d, t) AS rn FROM d),
    g AS (SELECT r.*, k, weights FROM r, (SELECT unnest([3, 5, 7]) AS k), (SELECT unnest(['uniform', 'distance']) AS weights) WHERE rn <= k),
    s AS (SELECT metric, weights, k, q, ql, label, round(sum(CASE WHEN weights = 'uniform' THEN 1 WHEN d = 0 THEN 1e12 ELSE 1 / d END), 9) AS w FROM g GROUP BY ALL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY metric, weights, k, q ORDER BY w DESC, label) = 1)
    SELECT metric, weights, cast(k AS int) AS k, round(avg(cast(label = ql AS int)), 6) AS accuracy FROM b GROUP BY ALL""")
def knn_grid(spark, d):
    """Five folds; vectors whose id is divisible by 50 are voted on by all rows of the other folds."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), (F.floor(F.col("vec_id") / 50) % 5).alias("fold"))
    return ml.knn_grid(rows, rows.where("vec_id % 50 = 0"), "vec_id", "label", "fold").withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), n AS (SELECT q.vec_id AS q, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS k FROM e q, e t WHERE q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id),
    c AS (SELECT q, label, count(*) AS w FROM n WHERE k <= 7 GROUP BY q, label) SELECT q AS vec_id, label AS vote FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, label) = 1""")
def knn_classify_all(spark, d):
    """Vectors whose id is divisible by 50, against every row but themselves."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return ml.knn_classify(rows, rows.where("vec_id % 50 = 0"), 7, "vec_id", "label", others=True)


TRAFFIC_COLUMNS = ["calories", "protein", "servings", *(f"category_{c}" for c in clean.RECIPE_CATEGORIES)]


def _scaled(spark, d):
    """Recipes with calories and protein scaled to [0, 1]; those without a number of servings have none."""
    return ml.scale(_recipes(spark, d), ["calories", "protein"]).na.fill(0, ["servings"])


_RECIPES = f"r AS ({ORACLES['recipe_features']}), q AS (SELECT min(calories) AS ca, max(calories) - min(calories) AS cb, min(protein) AS pa, max(protein) - min(protein) AS pb FROM r), s AS (SELECT r.* REPLACE (coalesce((calories - ca) / nullif(cb, 0), 0) AS calories, coalesce((protein - pa) / nullif(pb, 0), 0) AS protein, coalesce(servings, 0) AS servings) FROM r, q)"


@query()
def logistic_traffic(spark, d):
    """Precision of a cross-validated logistic regression on held-out recipes, with the KPI flag: 16 settings, five folds."""
    train, test = ml.split(ml.assemble(_scaled(spark, d), TRAFFIC_COLUMNS), "recipe")
    return aggs.precision_kpi(ml.fit_logistic(train).transform(test).withColumn("hat", F.col("prediction").cast("int")), "label", "hat")


@query()
def svc_traffic_weights(spark, d):
    """Feature weights of linear support vectors with the squared hinge, seven values of C and five folds."""
    return ml.feature_weights(svm.fit_squared_hinge(_scaled(spark, d), TRAFFIC_COLUMNS, "label", "recipe"), TRAFFIC_COLUMNS, spark)


@query(f"SELECT unnest([{', '.join(repr(c) for c in [*TRAFFIC_COLUMNS, '(intercept)'])}]) AS feature, true AS optimal FROM (SELECT count(*) FROM customer)")
def svc_optimality(spark, d):
    """Where |w|^2 / 2 + C sum max(0, 1 - y w.x)^2 is least its derivative by each weight is nothing; the derivative is summed up here by built-in expressions, apart from the solver."""
    rows = _scaled(spark, d)
    model = svm.fit_squared_hinge(rows, TRAFFIC_COLUMNS, "label", "recipe")
    w, y = [*model.coefficients, model.intercept], 2 * F.col("label") - 1
    x = [*(F.col(c).cast("double") for c in TRAFFIC_COLUMNS), F.lit(1.0)]
    gap = F.greatest(F.lit(0.0), 1 - y * sum((float(a) * c for a, c in zip(w, x, strict=True)), F.lit(0.0)))
    sums = rows.agg(*(F.struct((F.lit(float(a)) - 2 * model.c * F.sum(gap * y * c)).alias("slope"), F.sum(F.abs(2 * model.c * c)).alias("size")).alias(f"s{i}") for i, (a, c) in enumerate(zip(w, x, strict=True))))
    told = F.array(*(F.struct(F.lit(n).alias("feature"), (F.abs(f"s{i}.slope") <= 1e-7 * (1 + F.col(f"s{i}.size"))).alias("optimal")) for i, n in enumerate([*TRAFFIC_COLUMNS, "(intercept)"])))
    return sums.select(F.explode(told).alias("t")).select("t.*")


_M = [[f"(CASE WHEN {i} = {j} THEN 1 ELSE 0 END + 0.2 * m{min(i, j)}{max(i, j)})" for j in range(3)] for i in range(3)]


def _det(m: list[list[str]]) -> str:
    return " ".join(f"{'+' if k % 2 == 0 else '-'} {m[0][k]} * ({m[1][a]} * {m[2][b]} - {m[1][b]} * {m[2][a]})" for k, a, b in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))


_W = ", ".join(f"({_det([[f'(0.2 * r{i})' if j == k else _M[i][j] for j in range(3)] for i in range(3)])}) / ({_det(_M)}) AS w{k}" for k in range(3))


@query(f"""WITH {_RECIPES}, v AS (SELECT calories AS x0, protein AS x1, 1.0 AS x2, 2 * label - 1 AS y FROM s),
    a AS (SELECT {', '.join(f'avg(x{i} * x{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'avg(x{i} * y) AS r{i}' for i in range(3))} FROM v), w AS (SELECT {_W} FROM a)
    SELECT 'calories' AS feature, round(w0, 7) AS weight FROM w UNION ALL SELECT 'protein', round(w1, 7) FROM w UNION ALL SELECT '(intercept)', round(w2, 7) FROM w""")
def svc_small_c(spark, d):
    """With C of a tenth over the rows no row is past its margin, so the squared hinge is a ridge regression, which SQL can solve."""
    rows = _scaled(spark, d)
    model = svm.fit_squared_hinge(rows, ["calories", "protein"], "label", "recipe", (0.1 / rows.count(),))
    told = zip(["calories", "protein", "(intercept)"], [*map(float, model.coefficients), model.intercept], strict=True)
    return spark.createDataFrame(list(told), "feature string, weight double").withColumn("weight", F.round("weight", 7))


_KS = [1, 12, 23, 34, 45, 56, 67, 78, 89, 100]


@query(f"""WITH {_RECIPES}, e AS (SELECT recipe, label, recipe // 50 % 5 AS fold, [{', '.join(f'"{c}"::double' for c in TRAFFIC_COLUMNS)}] AS v FROM s),
    p AS (SELECT q.recipe AS q, q.label AS ql, t.recipe AS t, t.label, list_distance(q.v, t.v) AS e, list_sum(list_transform(list_zip(q.v, t.v), lambda x: abs(x[1] - x[2]))) AS m FROM e q, e t WHERE q.recipe % 50 = 0 AND q.fold <> t.fold),
    d AS (SELECT q, ql, t, label, 'euclidean' AS metric, round(e, 12) AS d FROM p UNION ALL SELECT q, ql, t, label, 'manhattan', round(m, 12) FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY metric, q ORDER BY d, t) AS rn FROM d),
    g AS (SELECT o.*, k FROM o, (SELECT unnest({_KS}) AS k) WHERE rn <= k),
    c AS (SELECT metric, k, q, ql, label, count(*) AS w FROM g GROUP BY ALL),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY metric, k, q ORDER BY w DESC, label) = 1)
    SELECT metric, 'uniform' AS weights, cast(k AS int) AS k, round(avg(cast(label = ql AS int)), 6) AS accuracy, round(avg(CASE WHEN label = 1 THEN cast(ql = 1 AS int) END), 6) AS precision FROM b GROUP BY metric, k""")
def knn_traffic_grid(spark, d):
    """Precision of high traffic for 1 to 100 neighbours in either metric, five folds: recipes whose id is divisible by 50 are voted on by all of the other folds."""
    rows = _scaled(spark, d).select("recipe", "label", (F.floor(F.col("recipe") / 50) % 5).alias("fold"), F.array(*(F.col(c).cast("double") for c in TRAFFIC_COLUMNS)).alias("v"))
    out = ml.knn_grid(rows, rows.where("recipe % 50 = 0"), "recipe", "label", "fold", ks=_KS, weights=("uniform",), positive=1)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision")})


@query()
def forest_prices(spark, d):
    """Predicted prices of held-out houses by a cross-validated forest."""
    rows = ml.assemble(_houses(spark, d).withColumnRenamed("sale_price", "label"), HOUSE_COLUMNS)
    train, test = ml.split(rows, "house_id")
    model = ml.fit_random_forest(train, trees=(10,), depths=(4, 6), folds=3)
    return joins.predictions(model.transform(test), "house_id")


@query()
def gbt_price_importance(spark, d):
    """The ten most important features of boosted trees."""
    rows = ml.assemble(_houses(spark, d).withColumnRenamed("sale_price", "label"), HOUSE_COLUMNS)
    model = ml.fit_gbt(rows, trees=10, rate=0.1)
    return windows.top_k(ml.feature_weights(model, HOUSE_COLUMNS, spark), "weight", 10, "feature")


@query()
def gbt_price_rmse(spark, d):
    """RMSE on held-out houses of the best of random settings of boosted trees."""
    rows = ml.assemble(_houses(spark, d).withColumnRenamed("sale_price", "label"), HOUSE_COLUMNS)
    train, test = ml.split(rows, "house_id")
    return aggs.rmse(ml.fit_gbt(train, draws=2, folds=2).transform(test), "label", "prediction")
