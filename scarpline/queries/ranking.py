"""Feature-ranking queries.

Analogue: the six combinations of return flag and line status are models, brands are features, and
the revenue of a brand in a combination is its importance. Two datasets are told apart by order
priority. A model lists only the brands at least as important as its mean, so models differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.operators import ranking
from scarpline.operators.columns import common_features
from scarpline.queries.base import load, rounded

BY = ["dataset"]


def _lines(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    parts = load(spark, sf, "part").select("p_partkey", "p_brand")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        load(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.when(urgent, "no_nans").otherwise("optimal").alias("dataset"),
            F.concat("l_returnflag", "l_linestatus").alias("model"),
            F.col("p_brand").alias("feature"), "l_extendedprice", "l_discount", "l_quantity",
        )
    )


def raw_importances(spark, sf):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _lines(spark, sf).groupBy(*BY, "model", "feature").agg(
        F.sum(revenue).alias("importance"))


def scores(spark, sf):
    return _lines(spark, sf).groupBy(*BY, "model").agg(
        (F.avg("l_quantity") / 50 + F.avg("l_discount")).alias("cv_score"))


def importances(spark, sf):
    selected = ranking.select_by_mean(raw_importances(spark, sf), BY)
    return ranking.rank_importances(ranking.percent_importances(selected, BY), BY)


def select_from_importance(spark, sf):
    return rounded(ranking.select_by_mean(raw_importances(spark, sf), BY), ["importance"], 2)


def ranked_importances(spark, sf):
    return rounded(importances(spark, sf), ["importance"])


def all_features(spark, sf):
    return ranking.all_features(importances(spark, sf))


def model_weights(spark, sf):
    table = scores(spark, sf)
    linear = ranking.linear_weights(table, BY).withColumnRenamed("weight", "linear")
    soft = ranking.softmax_weights(table, BY).select(*BY, "model", F.col("weight").alias("soft"))
    return rounded(linear.join(soft, [*BY, "model"]), ["cv_score", "linear", "soft"])


def dense_rank_matrix(spark, sf):
    return ranking.dense_ranks(importances(spark, sf), BY)


def _whole(spark, sf):
    """Importances and scores of the models over the lines of both datasets together."""
    def together(table):
        return table.withColumn("model", F.concat_ws(":", "dataset", "model")).drop("dataset")

    return together(importances(spark, sf)), together(scores(spark, sf))


def weighted_mean_rank(spark, sf):
    """All lines as one dataset."""
    ranks = ranking.weighted_mean_rank(*_whole(spark, sf))
    return rounded(ranks, ["weighted_mean_rank"])


def rank_both_datasets(spark, sf):
    ranks = ranking.weighted_mean_rank(importances(spark, sf), scores(spark, sf), BY)
    return rounded(ranks, ["weighted_mean_rank"])


def consensus_rank(spark, sf):
    ranks = ranking.consensus_rank(importances(spark, sf), scores(spark, sf), by=BY)
    return rounded(ranks, ["agg_rank", "consensus_score", "selection_freq"])


def rank_summary(spark, sf):
    ranks = ranking.weighted_mean_rank(importances(spark, sf), scores(spark, sf), BY)
    return rounded(ranking.ranking_summary(ranks, BY), ["best_rank", "worst_rank"])


def top_features(spark, sf):
    ranks = ranking.weighted_mean_rank(importances(spark, sf), scores(spark, sf), BY)
    return rounded(ranking.top_features(ranks, 5, BY), ["weighted_mean_rank"])


def top_ten_importances(spark, sf):
    model = importances(spark, sf).filter(
        (F.col("dataset") == "optimal") & (F.col("model") == "AF"))
    return rounded(ranking.top_importances(model, 10), ["importance"])


def shared_features(spark, sf):
    table = importances(spark, sf)
    return ranking.shared_features(table.filter(F.col("model") == "AF"),
                                   table.filter(F.col("model") == "RO"))


def union_of_features(spark, sf):
    table = importances(spark, sf)
    return ranking.union_features(table.filter(F.col("model") == "AF"),
                                  table.filter(F.col("model") == "RO"))


def common_columns(spark, sf):
    """Shared column names of two tables, as the columns of the first."""
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*common_features(joined, customers)).distinct()


QUERIES = {
    "select_from_importance": select_from_importance,
    "ranked_importances": ranked_importances,
    "all_features": all_features,
    "model_weights": model_weights,
    "dense_rank_matrix": dense_rank_matrix,
    "weighted_mean_rank": weighted_mean_rank,
    "rank_both_datasets": rank_both_datasets,
    "consensus_rank": consensus_rank,
    "rank_summary": rank_summary,
    "top_features": top_features,
    "top_importances": top_ten_importances,
    "common_features": shared_features,
    "union_features": union_of_features,
    "common_columns": common_columns,
}

_LINES = """lines AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'no_nans'
      ELSE 'optimal' END AS dataset, l_returnflag || l_linestatus AS model, p_brand AS feature,
      l_extendedprice, l_discount, l_quantity FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
scores AS (SELECT dataset, model, avg(l_quantity) / 50 + avg(l_discount) AS cv_score FROM lines
      GROUP BY 1, 2),
raw AS (SELECT dataset, model, feature, sum(l_extendedprice * (1 - l_discount)) AS importance
      FROM lines GROUP BY 1, 2, 3),
chosen AS (SELECT dataset, model, feature, importance FROM (SELECT *, avg(importance) OVER (
      PARTITION BY dataset, model) AS mean FROM raw) WHERE importance >= mean),
ranked AS (SELECT dataset, model, feature,
      100 * importance / sum(importance) OVER (PARTITION BY dataset, model) AS importance,
      CAST(row_number() OVER (PARTITION BY dataset, model ORDER BY importance DESC, feature)
      AS INTEGER) AS rank FROM chosen),
lengths AS (SELECT dataset, model, count(*) AS length, max(rank) AS longest FROM ranked GROUP BY 1, 2),
cells AS (SELECT f.dataset, f.feature, l.model, r.rank IS NOT NULL AS seen,
      CAST(coalesce(r.rank, l.length + 1) AS DOUBLE) AS rank,
      CAST(coalesce(r.rank, (SELECT max(g.longest) FROM lengths g WHERE g.dataset = f.dataset) + 1)
      AS DOUBLE) AS global_rank
      FROM (SELECT DISTINCT dataset, feature FROM ranked) f JOIN lengths l ON f.dataset = l.dataset
      LEFT JOIN ranked r ON r.dataset = f.dataset AND r.feature = f.feature AND r.model = l.model),
weights AS (SELECT dataset, model, cv_score,
      cv_score / sum(cv_score) OVER (PARTITION BY dataset) AS linear,
      exp(10 * cv_score) / sum(exp(10 * cv_score)) OVER (PARTITION BY dataset) AS soft FROM scores),
means AS (SELECT c.dataset, feature, sum(linear * rank) / sum(linear) AS weighted_mean_rank
      FROM cells c JOIN weights w ON c.dataset = w.dataset AND c.model = w.model GROUP BY 1, 2),
final AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset
      ORDER BY round(weighted_mean_rank, 9), feature) AS INTEGER) AS final_rank FROM means),
consensus AS (SELECT c.dataset, feature, sum(soft * global_rank) AS agg_rank,
      avg(CAST(seen AS INTEGER)) AS selection_freq
      FROM cells c JOIN weights w ON c.dataset = w.dataset AND c.model = w.model GROUP BY 1, 2)"""

ORACLE = {
    "select_from_importance": f"WITH {_LINES} SELECT dataset, model, feature, "
                              "round(importance, 2) AS importance FROM chosen",
    "ranked_importances": f"WITH {_LINES} SELECT dataset, model, feature, round(importance, 6) AS "
                          "importance, rank FROM ranked",
    "all_features": f"WITH {_LINES} SELECT DISTINCT feature FROM ranked",
    "model_weights": f"WITH {_LINES} SELECT dataset, model, round(cv_score, 6) AS cv_score, "
                     "round(linear, 6) AS linear, round(soft, 6) AS soft FROM weights",
    "dense_rank_matrix": f"WITH {_LINES} SELECT dataset, feature, model, rank, seen FROM cells",
    "weighted_mean_rank": f"""WITH {_LINES}, every AS (SELECT f.feature,
        CAST(coalesce(r.rank, l.length + 1) AS DOUBLE) AS rank, s.cv_score
        FROM (SELECT DISTINCT feature FROM ranked) f CROSS JOIN lengths l
        JOIN scores s ON s.dataset = l.dataset AND s.model = l.model
        LEFT JOIN ranked r ON r.dataset = l.dataset AND r.feature = f.feature AND r.model = l.model),
        means_of_all AS (SELECT feature, sum(cv_score * rank) / sum(cv_score) AS mean FROM every GROUP BY 1)
        SELECT feature, round(mean, 6) AS weighted_mean_rank, CAST(row_number() OVER (
        ORDER BY round(mean, 9), feature) AS INTEGER) AS final_rank FROM means_of_all""",
    "rank_both_datasets": f"WITH {_LINES} SELECT dataset, feature, round(weighted_mean_rank, 6) AS "
                          "weighted_mean_rank, final_rank FROM final",
    "consensus_rank": f"WITH {_LINES} SELECT dataset, feature, round(agg_rank, 6) AS agg_rank, round(1 - "
                      "(agg_rank - min(agg_rank) OVER w) / (max(agg_rank) OVER w - "
                      "min(agg_rank) OVER w), 6) AS consensus_score, round(selection_freq, 6) AS "
                      "selection_freq FROM consensus WINDOW w AS (PARTITION BY dataset)",
    "rank_summary": f"""WITH {_LINES} SELECT dataset, count(*) AS features_ranked,
        min_by(feature, final_rank) AS best_feature,
        round(min_by(weighted_mean_rank, final_rank), 6) AS best_rank,
        max_by(feature, final_rank) AS worst_feature,
        round(max_by(weighted_mean_rank, final_rank), 6) AS worst_rank
        FROM final GROUP BY dataset""",
    "top_features": f"WITH {_LINES} SELECT dataset, feature, round(weighted_mean_rank, 6) AS "
                    "weighted_mean_rank, final_rank FROM final WHERE final_rank <= 5",
    "top_importances": f"WITH {_LINES} SELECT dataset, model, feature, round(importance, 6) AS "
                       "importance, rank FROM ranked WHERE dataset = 'optimal' AND model = 'AF' "
                       "ORDER BY ranked.importance DESC, feature LIMIT 10",
    "common_features": f"WITH {_LINES} SELECT DISTINCT feature FROM ranked WHERE model = 'AF' "
                       "AND feature IN (SELECT feature FROM ranked WHERE model = 'RO')",
    "union_features": f"WITH {_LINES} SELECT DISTINCT feature FROM ranked "
                      "WHERE model IN ('AF', 'RO')",
    "common_columns": "SELECT DISTINCT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey "
                      "FROM orders JOIN customer ON o_custkey = c_custkey",
}
