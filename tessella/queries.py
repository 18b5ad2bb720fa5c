"""Registered queries of the relational and metric operators, each beside its DuckDB SQL.

Experiment results are derived from ``orders`` by one SQL text that both engines run, so the table grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as fx
from .operators import metrics, pairs, prep, ranking, split
from .plans import grid, results
from .session import table

EXPERIMENTS = """
SELECT o_orderkey AS row_id, o_orderpriority AS dataset, o_orderstatus AS h_model,
  CASE o_custkey % 2 WHEN 0 THEN 'svd' ELSE 'kernel_pca' END AS F_type,
  CASE o_orderkey % 7 WHEN 0 THEN 'Imakura' WHEN 1 THEN 'GEP' WHEN 2 THEN 'ODC' WHEN 3 THEN 'individual' WHEN 4 THEN 'centralize' ELSE 'nonlinear' END AS G_type,
  CASE o_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'X_tuning' END AS gamma_type,
  CAST(CASE o_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 WHEN 2 THEN 0.1 WHEN 3 THEN 2.5 END AS DOUBLE) AS gamma_ratio,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 100.0 END AS DOUBLE) AS gamma_ratio_krr,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.00000001 ELSE 0.25 END AS DOUBLE) AS nl_lambda,
  1000 * (1 + o_custkey % 2) AS num_anchor_data, 10 * (1 + o_custkey % 4) AS dim_intermediate, 25 * (1 + o_custkey % 2) AS num_institution_user,
  CAST(o_custkey % 5 AS INT) AS seed, o_orderkey % 11 <> 0 AS ok,
  CAST(floor(o_totalprice * 100) AS DOUBLE) / 100 AS score_mean,
  CAST((o_orderkey * 7919 + o_custkey * 31) % 100003 AS DOUBLE) AS odd_mean, CAST((o_orderkey * 104729 + o_custkey) % 100003 AS DOUBLE) AS even_mean,
  CAST((o_orderkey * 611953 + 17) % 100003 AS DOUBLE) AS odd_ind_mean, CAST((o_orderkey * 15485863 + 5) % 100003 AS DOUBLE) AS even_ind_mean
FROM orders
"""
WITH_EXPERIMENTS = f"WITH experiments AS ({EXPERIMENTS}) "
FINE, COARSE = ", ".join(results.FINE), ", ".join(results.COARSE)


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXPERIMENTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- preparation

@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM customer")
def label_encode(spark, d):
    return prep.encode_labels(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "code")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def drop_rare_labels(spark, d):
    return prep.drop_rare_labels(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("""SELECT c_custkey, c_acctbal, (c_mktsegment = 'BUILDING')::DOUBLE AS seg_BUILDING, (c_mktsegment = 'FURNITURE')::DOUBLE AS seg_FURNITURE,
 (c_mktsegment = 'HOUSEHOLD')::DOUBLE AS seg_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::DOUBLE AS seg_MACHINERY FROM customer""")
def one_hot_drop_first(spark, d):
    return prep.one_hot(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment", "seg")


@query("SELECT c_custkey, c_acctbal, (c_mktsegment = 'BUILDING')::DOUBLE AS seg_BUILDING, (c_mktsegment = 'FURNITURE')::DOUBLE AS seg_FURNITURE FROM customer")
def features_capped(spark, d):
    """The first three features in column order: dummies stand on the right and go first."""
    wide = prep.one_hot(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment", "seg")
    return wide.select("c_custkey", *prep.cap_features(wide, [c for c in wide.columns if c != "c_custkey"], 3))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / coalesce(nullif(s1, 0), 1), 6) AS l_quantity, round((l_extendedprice - m2) / coalesce(nullif(s2, 0), 1), 6) AS l_extendedprice
 FROM lineitem, (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2 FROM lineitem)""")
def zscore_pop(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(prep.standardise(rows, ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


@query("""SELECT p_partkey, round((p_retailprice - m) / coalesce(nullif(s, 0), 1), 6) AS p_retailprice FROM part, (SELECT avg(p_retailprice) m, stddev_pop(p_retailprice) s FROM part WHERE p_partkey % 2 = 0)""")
def zscore_fitted_on_train(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rounded(prep.standardise(rows, ["p_retailprice"], fit_on=rows.filter("p_partkey % 2 = 0")), "p_retailprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(min({c}) + 0.0, -1.0) AS low, coalesce(max({c}) + 0.0, 1.0) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def feature_minmax(spark, d):
    return prep.feature_ranges(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""SELECT p_partkey, p_size, CASE WHEN n >= 10 THEN CASE WHEN p_size <= 15 THEN 'low' WHEN p_size >= 40 THEN 'high' ELSE 'mid' END ELSE CASE WHEN p_size <= 15 THEN 'low' ELSE 'high' END END AS target
 FROM part, (SELECT min(n) n FROM (SELECT count(*) n FROM part GROUP BY CASE WHEN p_size <= 15 THEN 'low' WHEN p_size >= 40 THEN 'high' ELSE 'mid' END))""")
def bin_three_way(spark, d):
    return prep.three_way_bins(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 15, 40)


@query("""SELECT p_partkey, p_size, CASE WHEN p_size <= 48 THEN 'low' ELSE 'high' END AS target FROM part""")
def bin_two_way_fallback(spark, d):
    return prep.three_way_bins(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 48, 51)


@query("""WITH cut AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS t FROM lineitem)
 SELECT l_orderkey, l_linenumber, TRY_CAST(t AS DOUBLE) AS quantity FROM cut""")
def coerce_numeric(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", fx.to_number(F.col("t")).alias("quantity"))


@query(WITH_EXPERIMENTS + "SELECT * EXCLUDE (gamma_type) FROM experiments WHERE gamma_type IS NOT NULL AND gamma_ratio IS NOT NULL AND G_type NOT IN ('centralize', 'individual') AND gamma_ratio <> 10 AND h_model = 'F'")
def predicate_filters(spark, d):
    return experiments(spark, d).dropna(subset=["gamma_type", "gamma_ratio"]).filter(~F.col("G_type").isin("centralize", "individual") & (F.col("gamma_ratio") != 10) & (F.col("h_model") == "F")).drop("gamma_type")


@query(WITH_EXPERIMENTS + """SELECT row_id, CASE nl_lambda WHEN 1.0 THEN '1' WHEN 0.1 THEN '0.1' WHEN 0.00000001 THEN '1e-08' ELSE '0.25' END AS lambda_label,
 CASE G_type WHEN 'GEP' THEN 'generalised' WHEN 'ODC' THEN 'orthogonal' ELSE G_type END AS method FROM experiments""")
def labels_of_values(spark, d):
    close = fx.near_label(F.col("nl_lambda").cast("double"), [(1.0, "1"), (0.1, "0.1"), (1e-8, "1e-08")])
    return experiments(spark, d).select("row_id", close.alias("lambda_label"), fx.mapped(F.col("G_type"), {"GEP": "generalised", "ODC": "orthogonal"}).alias("method"))


@query(WITH_EXPERIMENTS + """SELECT row_id, G_type || '+' || CASE gamma_ratio_krr WHEN 1.0 THEN '1' WHEN 0.5 THEN '0.5' ELSE '100' END || '+' || CASE nl_lambda WHEN 1.0 THEN '1' WHEN 0.1 THEN '0.1' WHEN 0.00000001 THEN '1e-08' ELSE '0.25' END AS nonlinear_config_id FROM experiments""")
def config_id(spark, d):
    return results.config_id(experiments(spark, d)).select("row_id", "nonlinear_config_id")


@query("SELECT s_suppkey AS key, s_acctbal AS balance, 'supplier' AS origin, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'customer', c_mktsegment FROM customer")
def union_provenance(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return results.union_with_origin({"supplier": s, "customer": c}, "origin")


@query("""SELECT p_partkey, coalesce(p_retailprice, 0.0) AS value, substr(p_name, 1, 3) AS head, p_brand || '/' || CAST(p_size AS VARCHAR) AS tag FROM part""")
def coalesce_by_name(spark, d):
    p = table(spark, d, "part")
    value = fx.first_existing(p, ["p_price", "p_retailprice", "p_cost"])
    return p.select("p_partkey", F.coalesce(value, F.lit(0.0)).alias("value"), F.substring("p_name", 1, 3).alias("head"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("tag"))


# ---- split

ORDER_SQL = "(vec_id * 7919) % 1000003"


#: Rows of an institution on each side; there are as many institutions as the table and its rarest class allow.
USERS = 40
SHAPE_SQL = f"SELECT greatest(1, least(sum(n) // {2 * USERS}, min(n) // 2))::INT AS m, count(*) AS c FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)"


def institutions(rows: DataFrame, label: str) -> int:
    n, least = rows.groupBy(label).count().agg(F.sum("count"), F.min("count")).first()
    return split.resolve_shape(n or 0, least or 0, 0, rows=USERS).institutions


@query(f"""WITH r AS (SELECT vec_id, label, {ORDER_SQL} AS o, row_number() OVER (PARTITION BY label ORDER BY {ORDER_SQL}, vec_id) AS rk FROM embeddings), k AS ({SHAPE_SQL}),
 head AS (SELECT vec_id, label, CASE WHEN rk <= m THEN 'train' ELSE 'test' END AS split, (rk - 1) % m AS institution FROM r, k WHERE rk <= 2 * m),
 rest AS (SELECT vec_id, label, row_number() OVER (ORDER BY o, vec_id) - 1 AS p FROM r, k WHERE rk > 2 * m)
 SELECT vec_id, label, split, institution::INT AS institution FROM head UNION ALL
 SELECT vec_id, label, CASE WHEN p < m * ({USERS} - c) THEN 'train' ELSE 'test' END, (CAST(floor(p / ({USERS} - c)) AS INT) % m)::INT FROM rest, k WHERE p < 2 * m * ({USERS} - c)""")
def institution_split(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return split.covering_split(rows, "label", institutions(rows, "label"), USERS, [F.expr(ORDER_SQL), F.col("vec_id")])


@query(f"SELECT split, unnest(range(m))::BIGINT AS institution, {USERS}::BIGINT AS n_rows, c AS n_classes, true AS complete FROM (VALUES ('train'), ('test')) t(split), ({SHAPE_SQL})")
def split_class_coverage(spark, d):
    return split.class_coverage(institution_split(spark, d), "label").withColumn("institution", F.col("institution").cast("long"))


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / 200) AS INT) AS institution FROM orders QUALIFY institution < (SELECT count(*) // 200 FROM orders)")
def institution_bucket(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return split.buckets(rows, ["o_totalprice", "o_orderkey"], 200, rows.count() // 200).select("o_orderkey", "institution")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def global_positions(spark, d):
    return ranking.global_row_number(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("""SELECT greatest(1, least(n // 100, c // 2))::INT AS institutions, 50 AS rows, 64 AS features, 63 AS dim_local, 63 AS dim_shared FROM (SELECT sum(k) n, min(k) c FROM (SELECT count(*) k FROM embeddings GROUP BY label))""")
def resolve_defaults(spark, d):
    counts = table(spark, d, "embeddings").groupBy("label").count()
    n, least = counts.agg(F.sum("count"), F.min("count")).first()
    s = split.resolve_shape(n, least, 64)
    return counts.limit(1).select(*[F.lit(v).alias(k) for k, v in vars(s).items()])


@query("""WITH c AS (SELECT o_orderpriority p, count(*) n FROM orders GROUP BY 1), t AS (SELECT count(*) t FROM orders)
 SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) rk FROM orders), c, t WHERE p = o_orderpriority AND rk <= round(n * 700 / t)""")
def stratified_subsample(spark, d):
    return split.stratified_subsample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 700, [F.expr("(o_orderkey * 7919) % 1000003"), F.col("o_orderkey")])


# ---- results of experiments

@query(WITH_EXPERIMENTS + f"SELECT {FINE}, row_id, G_type, score_mean FROM experiments QUALIFY row_number() OVER (PARTITION BY {FINE} ORDER BY score_mean DESC, row_id) = 1")
def argmax_per_group(spark, d):
    return results.best_per_group(experiments(spark, d), results.FINE).select(*results.FINE, "row_id", "G_type", "score_mean")


@query(WITH_EXPERIMENTS + f", best AS (SELECT * FROM experiments QUALIFY row_number() OVER (PARTITION BY {FINE}, G_type ORDER BY score_mean DESC, row_id) = 1) SELECT gamma_ratio_krr, nl_lambda, count(*) AS n, round(avg(score_mean), 4) AS mean_score FROM best GROUP BY 1, 2")
def ranked_combinations(spark, d):
    return rounded(results.ranked_combinations(experiments(spark, d), [*results.FINE, "G_type"], ["gamma_ratio_krr", "nl_lambda"]), "mean_score", digits=4).orderBy(F.desc("n"), "gamma_ratio_krr", "nl_lambda")


BASE = f"b AS (SELECT {FINE}, max(score_mean) AS best FROM experiments WHERE G_type IN ('Imakura', 'GEP', 'ODC') GROUP BY ALL)"
ON_FINE = " AND ".join(f"e.{c} IS NOT DISTINCT FROM b.{c}" for c in results.FINE)
BEAT = f"f1 AS (SELECT e.* FROM experiments e JOIN b ON {ON_FINE} WHERE e.G_type = 'nonlinear' AND e.score_mean > b.best)"


@query(WITH_EXPERIMENTS + f", {BASE}, {BEAT} SELECT row_id, score_mean FROM f1")
def beat_baseline(spark, d):
    return results.beat_baselines(experiments(spark, d)).select("row_id", "score_mean")


@query(WITH_EXPERIMENTS + "SELECT row_id, odd_mean, even_mean FROM experiments WHERE odd_mean > odd_ind_mean AND even_mean > even_ind_mean")
def beat_own_institutions(spark, d):
    return results.beat_own_institutions(experiments(spark, d)).select("row_id", "odd_mean", "even_mean")


ON_COARSE = " AND ".join(f"e.{c} IS NOT DISTINCT FROM i.{c}" for c in results.COARSE)
INDIVIDUAL = f"i AS (SELECT {COARSE}, score_mean AS ind_score_mean, odd_mean AS ind_odd_mean, even_mean AS ind_even_mean FROM experiments WHERE G_type = 'individual' QUALIFY row_number() OVER (PARTITION BY {COARSE} ORDER BY row_id) = 1)"


@query(WITH_EXPERIMENTS + f", {INDIVIDUAL} SELECT e.row_id, ind_score_mean FROM experiments e JOIN i ON {ON_COARSE} WHERE G_type <> 'individual' AND e.score_mean > ind_score_mean AND e.odd_mean > ind_odd_mean AND e.even_mean > ind_even_mean")
def beat_individual(spark, d):
    e = experiments(spark, d)
    return results.beat_individual(e, results.individual_reference(e)).select("row_id", "ind_score_mean")


@query(WITH_EXPERIMENTS + f", {BASE}, {BEAT}, f2 AS (SELECT * FROM f1 WHERE odd_mean > odd_ind_mean AND even_mean > even_ind_mean), {INDIVIDUAL}, w AS (SELECT {FINE}, " + ", ".join(f"arg_min(score_mean, row_id) FILTER (G_type = '{m}') AS {m}" for m in ("GEP", "ODC", "Imakura")) + f" FROM experiments WHERE G_type IN ('GEP', 'ODC', 'Imakura') GROUP BY ALL) SELECT e.row_id, e.score_mean, GEP, ODC, Imakura, ind_score_mean FROM f2 e LEFT JOIN i ON {ON_COARSE} LEFT JOIN w b ON {ON_FINE}")
def post_hoc_report(spark, d):
    """The whole chain: beat every baseline, beat the own institutions, attach what the individual and the other methods reach."""
    e = experiments(spark, d)
    kept = results.beat_own_institutions(results.beat_baselines(e))
    told = results.null_safe(kept, results.individual_reference(e), results.COARSE, "left")
    return results.with_methods(told, e).select("row_id", "score_mean", "GEP", "ODC", "Imakura", "ind_score_mean")


@query(WITH_EXPERIMENTS + f"SELECT {FINE}, " + ", ".join(f"arg_min(score_mean, row_id) FILTER (G_type = '{m}') AS {m}" for m in ("GEP", "ODC", "Imakura")) + " FROM experiments WHERE G_type IN ('GEP', 'ODC', 'Imakura') GROUP BY ALL")
def pivot_methods(spark, d):
    return results.pivot_first(experiments(spark, d), results.FINE, "G_type", ["GEP", "ODC", "Imakura"], "score_mean")


@query(WITH_EXPERIMENTS + """SELECT dataset, h_model, round(max(score_mean) FILTER (G_type = 'GEP'), 4) AS gep, round(max(score_mean) FILTER (G_type = 'nonlinear' AND gamma_type = 'auto' AND nl_lambda = 0.1), 4) AS nonlinear_auto_01,
 round(max(score_mean) FILTER (G_type = 'nonlinear' AND gamma_type = 'X_tuning' AND nl_lambda = 1.0), 4) AS nonlinear_tuned_1, round(max(score_mean) FILTER (G_type = 'none'), 4) AS absent FROM experiments GROUP BY 1, 2""")
def wide_max_table(spark, d):
    g, t, nl = F.col("G_type"), F.col("gamma_type"), F.col("nl_lambda")
    return results.wide_best(experiments(spark, d), ["dataset", "h_model"], {
        "gep": g == "GEP", "nonlinear_auto_01": (g == "nonlinear") & (t == "auto") & (nl == 0.1), "nonlinear_tuned_1": (g == "nonlinear") & (t == "X_tuning") & (nl == 1.0), "absent": g == "none"})


@query(WITH_EXPERIMENTS + "SELECT dataset, G_type, row_id, score_mean, dense_rank() OVER (PARTITION BY dataset, G_type ORDER BY CASE WHEN dataset LIKE '1%' THEN score_mean ELSE -score_mean END)::INT AS rank FROM experiments QUALIFY rank <= 3")
def top3_distinct(spark, d):
    return results.top_distinct(experiments(spark, d), ["dataset", "G_type"], "score_mean", 3, F.col("dataset").startswith("1")).select("dataset", "G_type", "row_id", "score_mean", "rank")


@query(WITH_EXPERIMENTS + "SELECT dataset, G_type, row_id, gamma_ratio FROM experiments QUALIFY row_number() OVER (PARTITION BY dataset, G_type ORDER BY CASE WHEN gamma_ratio = 1 THEN 0 ELSE 1 END, row_id) = 1")
def prefer_row(spark, d):
    return results.preferred_row(experiments(spark, d), ["dataset", "G_type"], F.col("gamma_ratio") == 1).select("dataset", "G_type", "row_id", "gamma_ratio")


@query(WITH_EXPERIMENTS + "SELECT dataset, nl_lambda, row_id, score_mean FROM experiments WHERE G_type = 'nonlinear' QUALIFY row_number() OVER (PARTITION BY dataset, nl_lambda ORDER BY row_id) = 1")
def first_per_key(spark, d):
    return ranking.first_per_group(experiments(spark, d).filter("G_type = 'nonlinear'").select("dataset", "nl_lambda", "row_id", "score_mean"), ["dataset", "nl_lambda"], ["row_id"])


@query(WITH_EXPERIMENTS + "SELECT gamma_type, gamma_ratio, round(avg(score_mean), 4) AS score_mean, round(avg(odd_mean), 4) AS odd_mean FROM experiments WHERE gamma_type IS NOT NULL AND gamma_ratio IS NOT NULL GROUP BY 1, 2")
def group_mean_dropna(spark, d):
    return rounded(results.group_means(experiments(spark, d), ["gamma_type", "gamma_ratio"], ["score_mean", "odd_mean"], True), "score_mean", "odd_mean", digits=4)


@query(WITH_EXPERIMENTS + "SELECT gamma_type, gamma_ratio, round(avg(score_mean), 4) AS score_mean, round(avg(odd_mean), 4) AS odd_mean FROM experiments GROUP BY 1, 2")
def group_mean_keep_null_keys(spark, d):
    return rounded(results.group_means(experiments(spark, d), ["gamma_type", "gamma_ratio"], ["score_mean", "odd_mean"]), "score_mean", "odd_mean", digits=4)


@query(WITH_EXPERIMENTS + "SELECT dataset, h_model, G_type, dim_intermediate, count(*) FILTER (ok) AS n_ok, round(coalesce(avg(score_mean) FILTER (ok), 0), 4) AS score_mean, round(coalesce(stddev_samp(score_mean) FILTER (ok), 0), 4) AS score_stdev FROM experiments GROUP BY 1, 2, 3, 4")
def seed_summary(spark, d):
    return rounded(results.seed_summary(experiments(spark, d), ["dataset", "h_model", "G_type", "dim_intermediate"], "score_mean", F.col("ok")), "score_mean", "score_stdev", digits=4)


@query(WITH_EXPERIMENTS + ", b AS (SELECT dataset, h_model, dim_intermediate, max(score_mean) AS m FROM experiments WHERE G_type = 'ODC' GROUP BY 1, 2, 3) SELECT row_id, round(score_mean - m, 6) AS delta FROM experiments LEFT JOIN b USING (dataset, h_model, dim_intermediate)")
def delta_vs_baseline(spark, d):
    return rounded(results.delta_to(experiments(spark, d), ["dataset", "h_model", "dim_intermediate"], "G_type", "ODC", "score_mean"), "delta").select("row_id", "delta")


@query("""SELECT l_returnflag, round(avg(x), 6) AS mean, min(x) AS least, max(x) AS greatest, round(avg(x) FILTER (i % 2 = 0), 4) AS even_mean, round(avg(x) FILTER (i % 2 = 1), 4) AS odd_mean FROM (SELECT l_returnflag, l_suppkey % 10 AS i, l_quantity AS x FROM lineitem) GROUP BY 1""")
def institution_means(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 10).alias("i"), "l_quantity")
    return rounded(results.institution_means(rows, ["l_returnflag"], "i", "l_quantity"), "mean")


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 999 END AS place FROM customer")
def custom_order_sort(spark, d):
    return results.in_custom_order(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"], F.desc("c_custkey"))


# ---- grids

LOCKED = """CASE WHEN G_type IN ('centralize', 'individual') THEN 1.0 ELSE gamma_ratio END AS gamma_ratio,
 CASE WHEN G_type IN ('centralize', 'individual', 'Imakura', 'GEP', 'ODC') THEN 0.1 ELSE nl_lambda END AS nl_lambda, CASE WHEN G_type IN ('centralize', 'individual', 'Imakura', 'GEP', 'ODC') THEN 1.0 ELSE gamma_ratio_krr END AS gamma_ratio_krr"""
RULES = [grid.Rule({"G_type": ["centralize", "individual"]}, {"gamma_ratio": 1.0}),
         grid.Rule({"G_type": ["centralize", "individual", "Imakura", "GEP", "ODC"]}, {"nl_lambda": 0.1, "gamma_ratio_krr": 1.0}),
         grid.Rule({"F_type": ["kernel_pca"], "G_type": ["ODC"]})]
GRID_SQL = "SELECT dataset, F_type, G_type, gamma_ratio, nl_lambda, gamma_ratio_krr FROM (SELECT DISTINCT dataset FROM experiments), (SELECT DISTINCT F_type FROM experiments), (SELECT DISTINCT G_type FROM experiments), (SELECT DISTINCT gamma_ratio FROM experiments WHERE gamma_ratio IS NOT NULL), (SELECT DISTINCT nl_lambda FROM experiments), (SELECT DISTINCT gamma_ratio_krr FROM experiments)"


def _lists(e: DataFrame) -> dict:
    one = lambda c: e.select(F.col(c).cast("double") if c in ("gamma_ratio", "nl_lambda", "gamma_ratio_krr") else F.col(c)).filter(F.col(c).isNotNull()).distinct()
    return {c: one(c) for c in ("dataset", "F_type", "G_type", "gamma_ratio", "nl_lambda", "gamma_ratio_krr")}


@query(WITH_EXPERIMENTS + f"SELECT DISTINCT dataset, F_type, G_type, {LOCKED} FROM ({GRID_SQL}) WHERE NOT (F_type = 'kernel_pca' AND G_type = 'ODC')")
def grid_product_lock_dedup(spark, d):
    return grid.apply_rules(grid.product(spark, _lists(experiments(spark, d))), RULES)


@query(WITH_EXPERIMENTS + f""", plain AS (SELECT DISTINCT dataset, F_type, G_type, {LOCKED} FROM ({GRID_SQL}) WHERE NOT (F_type = 'kernel_pca' AND G_type = 'ODC') AND G_type <> 'Imakura'),
 keys AS (SELECT DISTINCT dataset, F_type, gamma_ratio FROM experiments WHERE G_type = 'Imakura' AND dim_intermediate = 10 AND dataset IS NOT NULL AND F_type IS NOT NULL AND gamma_ratio IS NOT NULL),
 rest AS (SELECT DISTINCT G_type, nl_lambda, gamma_ratio_krr FROM ({GRID_SQL}))
 SELECT * FROM plain UNION ALL SELECT DISTINCT dataset, F_type, G_type, {LOCKED} FROM keys, rest WHERE NOT (F_type = 'kernel_pca' AND G_type = 'ODC')""")
def grid_seeded_by_results(spark, d):
    e = experiments(spark, d)
    seeds = e.filter("dim_intermediate = 10").withColumn("gamma_ratio", F.col("gamma_ratio").cast("double"))
    return grid.seeded_combos(seeds, {"Imakura": ["dataset", "F_type", "gamma_ratio"]}, _lists(e), RULES)


@query(WITH_EXPERIMENTS + "SELECT row_id, CASE WHEN dim_intermediate >= 20 THEN dim_intermediate WHEN dataset LIKE '1%' THEN 41 WHEN dataset LIKE '2%' THEN 9 ELSE 7 END AS dim_intermediate, coalesce(gamma_ratio, 1.0)::DOUBLE AS gamma_ratio FROM experiments")
def grid_defaults(spark, d):
    e = experiments(spark, d).select("row_id", "dataset", F.when(F.col("dim_intermediate") < 20, F.lit(-1)).otherwise(F.col("dim_intermediate")).cast("int").alias("dim_intermediate"), F.col("gamma_ratio").cast("double"))
    known = e.select("dataset").distinct().select("dataset", F.when(F.col("dataset").startswith("1"), 41).when(F.col("dataset").startswith("2"), 9).alias("dim_intermediate"))
    return grid.with_defaults(e, known, {"gamma_ratio": 1.0, "dim_intermediate": 7}).select("row_id", F.col("dim_intermediate").cast("long").alias("dim_intermediate"), "gamma_ratio")


# ---- metrics and pairs

SCORED = "SELECT l.doc_id, l.quality AS y, d.lang, CAST(d.n_chars % 500 AS DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id)"


def _scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), "lang", (F.col("n_chars") % 500).cast("double").alias("s"))


def _auc_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH t AS ({SCORED}), r AS (SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}s) - 1) / 2 AS rk FROM t)
 SELECT {keys + ', ' if keys else ''}sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc FROM r {'GROUP BY ' + keys if keys else ''}"""


@query(_auc_sql(""))
def auc_binary(spark, d):
    return rounded(metrics.auc_binary(_scored(spark, d), "y", "s"), "auc")


@query(_auc_sql("lang"))
def auc_by_group(spark, d):
    return rounded(metrics.auc_binary(_scored(spark, d), "y", "s", ["lang"]), "auc")


@query("""WITH t AS (SELECT label, unnest(range(10)) AS c, unnest(embedding[1:10])::DOUBLE AS s FROM embeddings), r AS (SELECT c, (label = c)::INT AS y, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2 AS rk FROM t)
 SELECT round(avg(a), 6) AS auc, count(a) AS n_classes FROM (SELECT c, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS a FROM r GROUP BY c)""")
def auc_ovr_macro(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("scores"))
    return rounded(metrics.auc_one_vs_rest(rows, "label", "scores", 10), "auc")


@query(f"SELECT lang, count(*) AS n, round(avg((y = (s >= 250)::INT)::INT), 6) AS accuracy FROM ({SCORED}) GROUP BY lang")
def accuracy(spark, d):
    return rounded(metrics.accuracy(_scored(spark, d).withColumn("p", (F.col("s") >= 250).cast("int")), "y", "p", ["lang"]), "accuracy")


@query("SELECT l_returnflag, round(sqrt(avg((l_extendedprice - 1400 * l_quantity) ** 2)), 4) AS rmse, round(1 - sum((l_extendedprice - 1400 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1")
def rmse_r2(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", 1400 * F.col("l_quantity"))
    return rounded(rounded(metrics.rmse_r2(rows, "l_extendedprice", "p", ["l_returnflag"]), "rmse", digits=4), "r2")


@query("SELECT round(avg((a - b) ** 2), 8) AS mse, round(10 * log10(1.0 / avg((a - b) ** 2)), 6) AS psnr FROM (SELECT embedding[1]::DOUBLE a, embedding[2]::DOUBLE b FROM embeddings)")
def psnr_mse(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return rounded(rounded(metrics.mse_psnr(rows, "a", "b", 1.0), "psnr"), "mse", digits=8)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(avg({c}), 9) AS mean, round(var_pop({c}), 4) AS var, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS sigma FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def fed_moments(spark, d):
    # means of cents over round counts fall on ties of the sixth decimal, but on none of the ninth
    found = metrics.moments(table(spark, d, "lineitem"), F.col("l_suppkey") % 10, ["l_quantity", "l_discount", "l_tax"])
    return rounded(rounded(rounded(found, "sigma"), "var", digits=4), "mean", digits=9)


@query("""WITH c AS (SELECT count(*) n, avg(p_retailprice) my, avg(p_size) m1, avg(p_partkey % 100) m2, var_pop(p_size) s11, var_pop(p_partkey % 100) s22, covar_pop(p_size, p_partkey % 100) s12, covar_pop(p_size, p_retailprice) s1, covar_pop(p_partkey % 100, p_retailprice) s2 FROM part),
 b AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) b2 FROM c) SELECT n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(my - b1 * m1 - b2 * m2, 6) AS b0 FROM b""")
def normal_equation_ols(spark, d):
    rows = table(spark, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 100).cast("double").alias("x2"))
    return rounded(metrics.least_squares(rows, "p_retailprice", "x1", "x2"), "b0", "b1", "b2")


VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
SQ = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"WITH v AS ({VEC}) SELECT a.vec_id, b.vec_id AS other, round(exp(-0.5 * {SQ}), 6) AS kernel FROM v a, v b WHERE b.vec_id % 100 = 0")
def rbf_kernel_pairs(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(pairs.kernel_to_reference(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 0.5), "kernel")


DOT = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))"


@query(f"WITH v AS ({VEC}) SELECT a.vec_id, b.vec_id AS other, round({DOT}, 6) AS linear, round((0.5 * {DOT} + 1) ** 3, 6) AS polynomial FROM v a, v b WHERE b.vec_id % 100 = 0")
def linear_and_polynomial_kernels(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(pairs.kernels_to_reference(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 0.5, ("linear", "polynomial")), "linear", "polynomial")


@query(f"WITH v AS ({VEC}), s AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt({SQ}) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id) SELECT vec_id, row_number() OVER w::INT AS rank, neighbour, round(distance, 6) AS distance FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY distance, neighbour) QUALIFY row_number() OVER w <= 5")
def knn_join(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(pairs.nearest(rows, rows, 5, "vec_id", "embedding"), "distance")


@query(f"""WITH v AS ({VEC}), s AS (SELECT a.vec_id, b.vec_id AS nb, {SQ} AS q FROM v a, v b WHERE a.vec_id <> b.vec_id), k AS (SELECT 1 / sqrt(q) / 3 AS g FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, nb) = 7) SELECT count(*) AS n, round(median(g), 6) AS gamma_median, round(avg(g), 6) AS gamma_mean FROM k""")
def self_tuning_gamma(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(pairs.self_tuning_gamma(rows, rows, "vec_id", "embedding", 7), "gamma_median", "gamma_mean")


@query(f"WITH v AS ({VEC}), s AS (SELECT {SQ} AS q FROM v a, v b WHERE a.vec_id < b.vec_id) SELECT count(*) AS n_pairs, round(1 / (2 * median(sqrt(q)) ** 2), 6) AS gamma_half_median_squared, round(1 / (2 * median(q)), 6) AS gamma_half_median_of_squares, round(1 / median(q), 6) AS gamma_median_of_squares FROM s")
def median_heuristic_gamma(spark, d):
    return rounded(pairs.median_gammas(table(spark, d, "embeddings"), "vec_id", "embedding"), "gamma_half_median_squared", "gamma_half_median_of_squares", "gamma_median_of_squares")


@query(f"""WITH v AS ({VEC}), n AS (SELECT a.vec_id, b.label FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SQ}, 12), b.vec_id) <= 5), c AS (SELECT vec_id, label AS vote, count(*) AS votes FROM n GROUP BY 1, 2)
 SELECT vec_id, vote, votes FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, vote) = 1""")
def knn_vote(spark, d):
    rows = table(spark, d, "embeddings")
    return pairs.vote(pairs.nearest(rows, rows, 5, "vec_id", "embedding"), rows, "vec_id", "label")


@query(f"""WITH v AS ({VEC}), w AS (SELECT CASE WHEN a.label = b.label THEN 'within' ELSE 'between' END AS kind, a.vec_id AS i, b.vec_id AS j, exp(-0.5 * {SQ}) AS w FROM v a, v b WHERE a.vec_id <> b.vec_id),
 d AS (SELECT kind, i, sum(w) AS s, sum(w * j) AS sj, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT kind, sum(s) AS t FROM d GROUP BY 1) SELECT kind, i, n, round(s / t, 8) AS diagonal, round(-sj / t, 5) AS moment FROM d JOIN t USING (kind)""")
def label_laplacian(spark, d):
    """Each row of both Laplacians of all rows, told by its diagonal and the first moment of the rest."""
    told = pairs.label_laplacian_sums(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.5)
    return rounded(rounded(told, "diagonal", digits=8), "moment", digits=5)


IMAGES_SQL = "SELECT CAST(vec_id % 5 AS INT) AS institution, CAST(floor(vec_id / 5) AS BIGINT) AS anchor_id, e FROM v"


@query(f"WITH v AS ({VEC}), g AS ({IMAGES_SQL}) SELECT a.institution AS i, b.institution AS j, count(*) AS n_rows_used, round(sum(sqrt({SQ})), 6) AS sum, round(avg(sqrt({SQ})), 6) AS mean, round(max(sqrt({SQ})), 6) AS max FROM g a JOIN g b USING (anchor_id) WHERE a.institution < b.institution GROUP BY 1, 2")
def alignment_pairs(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("institution"), F.floor(F.col("vec_id") / 5).alias("anchor_id"), F.col("embedding").cast("array<double>").alias("features"))
    return rounded(pairs.alignment_pairs(rows), "sum", "mean", "max")


@query(f"WITH v AS ({VEC}), g AS ({IMAGES_SQL}), p AS (SELECT sum(sqrt({SQ})) AS s FROM g a JOIN g b USING (anchor_id) WHERE a.institution < b.institution GROUP BY a.institution, b.institution) SELECT round(avg(s), 1) AS mean, round(min(s), 1) AS least, round(max(s), 1) AS greatest FROM p")
def alignment_metric(spark, d):
    return pairs.alignment_summary(alignment_pairs(spark, d))


@query("""WITH c AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 50 <> 7 THEN p_retailprice END AS price FROM part),
 n AS (SELECT h.p_partkey, o.price FROM c h JOIN c o ON h.price IS NULL AND o.price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h.p_partkey ORDER BY (h.p_size - o.p_size) ** 2, o.p_partkey) <= 5),
 m AS (SELECT p_partkey, avg(price) AS price FROM n GROUP BY 1) SELECT p_partkey, round(coalesce(c.price, m.price), 4) AS price FROM c LEFT JOIN m USING (p_partkey)""")
def knn_imputation(spark, d):
    """All cells, imputed ones included."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 != 7, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"))
    return rounded(prep.knn_impute(p, "p_partkey", ["price", "size"]), "price", digits=4).select("p_partkey", "price")
