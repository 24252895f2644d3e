"""Missing-data and distribution queries.

Analogue: orders joined to their customer, with nulls put in by the same CASE on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.operators import columns as C
from scarpline.operators import distribution, profile
from scarpline.operators.columns import column_groups
from scarpline.plans.collection import validate_collected
from scarpline.plans.datasets import prepare
from scarpline.queries.base import load, rounded
from scarpline.sources import normalise, read_events

INCOMPLETE = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "c_nationkey": "c_nationkey",
    "o_totalprice": "CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_totalprice END",
    "o_orderpriority": "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END",
    "o_orderstatus": "CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderstatus END",
    "c_acctbal": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END",
    "c_mktsegment": "CASE WHEN o_totalprice < 400000 THEN NULL ELSE c_mktsegment END",
}
_LIST = ", ".join(f"{sql} AS {name}" for name, sql in INCOMPLETE.items())
_BASE = f"base AS (SELECT {_LIST} FROM orders JOIN customer ON o_custkey = c_custkey)"
_NAMES = list(INCOMPLETE)
_GAPPED = ["o_totalprice", "o_orderpriority", "o_orderstatus", "c_acctbal", "c_mktsegment"]


def incomplete_orders(spark: SparkSession, sf: str) -> DataFrame:
    joined = load(spark, sf, "orders").join(
        load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*[F.expr(sql).alias(name) for name, sql in INCOMPLETE.items()])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes over the table give the whole sweep."""
    return rounded(profile.threshold_sweep(incomplete_orders(spark, sf)), ["weighted_ratio"], 9)


_COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) - count({n}) AS nulls FROM base" for n in _NAMES) + ")"
_COMPLETE_AT = " AND ".join(
    f"({n} IS NOT NULL OR (SELECT nulls FROM counts WHERE name = '{n}') >= start)"
    for n in _NAMES)
_STEPS = f"""{_BASE}, {_COUNTS},
total AS (SELECT count(*) AS n FROM base),
starts AS (SELECT DISTINCT start FROM (SELECT 1 AS start UNION ALL SELECT nulls + 1 FROM counts)),
kept AS (SELECT start, count(*) FILTER (WHERE {_COMPLETE_AT}) AS rows_kept
         FROM base CROSS JOIN starts GROUP BY start),
steps AS (SELECT start, rows_kept,
                 (SELECT count(*) FROM counts WHERE nulls < start) AS features_kept,
                 coalesce(lead(start) OVER (ORDER BY start), 9000000000) AS next_start FROM kept),
sweep AS (SELECT CAST(t AS BIGINT) AS threshold, CAST(features_kept AS INTEGER) AS features_kept,
                 rows_kept,
                 CAST(0.7 AS DOUBLE) * (CAST(features_kept AS DOUBLE) / {len(_NAMES)})
                 + CAST(0.3 AS DOUBLE) * (CAST(rows_kept AS DOUBLE) / n) AS weighted_ratio
          FROM total CROSS JOIN range(1, (SELECT n FROM total)) r(t)
          JOIN steps ON t >= start AND t < next_start AND features_kept > 0)"""
# The first threshold of the best plateau, without listing every threshold.
_PICKED = f"""picked AS (SELECT CAST(start AS BIGINT) AS threshold,
      CAST(features_kept AS INTEGER) AS features_kept, rows_kept, n FROM steps CROSS JOIN total
      WHERE start < n AND features_kept > 0
      ORDER BY 0.7e0 * (CAST(features_kept AS DOUBLE) / {len(_NAMES)})
             + 0.3e0 * (CAST(rows_kept AS DOUBLE) / n) DESC, start LIMIT 1)"""
CHOSEN_COLUMNS = f"""WITH {_STEPS}, {_PICKED}, named AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + """) v(i, name))
SELECT row_number() OVER (ORDER BY i) - 1 AS position, named.name AS "column"
FROM named JOIN counts ON named.name = counts.name JOIN picked ON nulls < threshold"""
_BEST = "best AS (SELECT threshold FROM sweep ORDER BY weighted_ratio DESC, threshold LIMIT 1)"


def best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.top_threshold(profile.threshold_sweep(incomplete_orders(spark, sf))),
                   ["weighted_ratio"], 9)


def null_profile(spark, sf):
    return profile.null_counts(incomplete_orders(spark, sf))


def no_null_dataset(spark, sf):
    return profile.drop_null_columns(incomplete_orders(spark, sf))


def optimal_dataset(spark, sf):
    """Dataset B through the prepared bundle; its columns depend on the best threshold."""
    return C.keep(prepare(incomplete_orders(spark, sf), key="none").optimal, _B_COLUMNS)


# Columns that stay below the best threshold of this analogue at every scale factor.
_B_COLUMNS = ["o_orderkey", "o_custkey", "c_nationkey", "o_totalprice", "o_orderpriority",
              "o_orderstatus", "c_acctbal"]


def retention_metrics(spark, sf):
    df = incomplete_orders(spark, sf)
    counts = profile.profile_nulls(df)
    chosen = profile.best_threshold(df, counts)
    return rounded(profile.retention(df, chosen, counts), ["feature_share", "row_share"], 9)


def complete_rows(spark, sf):
    return profile.drop_null_rows(incomplete_orders(spark, sf), ["o_totalprice", "o_orderstatus"])


def _cluttered_parts(spark, sf):
    part = load(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("Unnamed: 0"), F.col("p_name").alias("event_date"),
        F.col("p_retailprice").alias("Latitude"), F.col("p_retailprice").alias("Longitude"),
        F.col("p_size").alias("size_nc"), F.col("p_size").alias("p_size"),
        F.col("p_retailprice").alias("Precipitation_1"), F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("Stability"),
    )


def clean_columns(spark, sf):
    return C.clean_features(_cluttered_parts(spark, sf))


def clean_columns_for_evaluation(spark, sf):
    return C.clean_for_evaluation(_cluttered_parts(spark, sf))


def missing_rows(spark, sf):
    return C.rows_missing(incomplete_orders(spark, sf), ["o_totalprice", "c_acctbal"])


def valid_key_rows(spark, sf):
    return C.rows_with_keys(incomplete_orders(spark, sf),
                            ["o_totalprice", "o_orderpriority", "c_acctbal"])


def aligned_features(spark, sf):
    """Training order, an absent column and nulls as zeros, keys carried."""
    return C.align_features(incomplete_orders(spark, sf),
                            ["c_acctbal", "not_collected", "o_totalprice"], ["o_orderkey"])


def event_scan(spark, sf):
    """Event reader: key taken over as row_id, timestamp as date."""
    events = read_events(spark, f"{sf}/orders.parquet", date_col="o_orderdate",
                         id_col="o_orderkey")
    return events.select("row_id", "o_custkey", "o_orderdate", "o_totalprice")


def nan_normalised(spark, sf):
    """NaN becomes NULL once, and NULL stays NULL."""
    orders = load(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(
        F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return normalise(orders.select("o_orderkey", price.alias("price")), None)


def numeric_profile(spark, sf):
    return rounded(profile.numeric_profile(incomplete_orders(spark, sf)),
                   {"min": 4, "max": 4, "mean": 4, "std": 4})


def quality_profile(spark, sf):
    df = incomplete_orders(spark, sf).withColumns({
        "nothing": F.lit(None).cast("double"),
        "signed": F.round(F.col("c_acctbal") / 1000).cast("double"),
    })
    names = ["o_totalprice", "c_acctbal", "signed", "nothing", "absent"]
    return rounded(profile.quality_profile(df, names), {"min": 4, "max": 4, "mean": 4, "std": 4})


def fill_report(spark, sf):
    return rounded(profile.fill_report(incomplete_orders(spark, sf), ["o_totalprice", "c_acctbal"]),
                   ["success_rate"])


def _prefixed(spark, sf):
    return incomplete_orders(spark, sf).select(
        F.col("o_totalprice").alias("terrain_price"), F.col("c_acctbal").alias("soil_balance"),
        F.col("o_orderpriority").alias("soil_text"), F.col("o_custkey").alias("max_PRCP"),
    )


def collected_validation(spark, sf):
    return rounded(validate_collected(_prefixed(spark, sf)),
                   {"min": 4, "max": 4, "mean": 4, "std": 4})


def grouped_columns(spark, sf):
    groups = column_groups(_prefixed(spark, sf))
    names = [n for group in ("terrain", "soil", "precipitation") for n in groups[group]]
    return C.keep(_prefixed(spark, sf), names)


_BOX_FEATURES = ["l_quantity", "l_extendedprice", "l_tax"]


def melted(spark, sf):
    return distribution.melt(load(spark, sf, "lineitem"), _BOX_FEATURES, "l_returnflag")


def class_medians(spark, sf):
    return rounded(
        distribution.class_medians(load(spark, sf, "lineitem"), _BOX_FEATURES, "l_returnflag"),
        ["median"], 4)


_BOX_ROUND = dict.fromkeys(["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


def _skewed_lines(spark, sf):
    """Squares stretch the upper tail, so that boxes have outliers."""
    lines = load(spark, sf, "lineitem")
    return lines.withColumn("l_square", F.pow("l_extendedprice", F.lit(4.0)) / 1e18)


def box_stats(spark, sf):
    return rounded(distribution.box_stats(
        _skewed_lines(spark, sf), ["l_quantity", "l_square"], "l_returnflag"), _BOX_ROUND)


def class_box_stats(spark, sf):
    return rounded(distribution.box_stats(
        _skewed_lines(spark, sf), ["l_quantity", "l_square"], "l_returnflag", by_class=True),
        _BOX_ROUND)


QUERIES = {
    "null_profile": null_profile,
    "drop_null_columns": no_null_dataset,
    "drop_null_rows": complete_rows,
    "null_threshold_sweep": flagship,
    "best_threshold": best,
    "optimal_dataset": optimal_dataset,
    "retention_metrics": retention_metrics,
    "clean_columns": clean_columns,
    "clean_columns_for_evaluation": clean_columns_for_evaluation,
    "missing_rows": missing_rows,
    "valid_key_rows": valid_key_rows,
    "aligned_features": aligned_features,
    "event_scan": event_scan,
    "nan_normalised": nan_normalised,
    "numeric_profile": numeric_profile,
    "quality_profile": quality_profile,
    "fill_report": fill_report,
    "collected_validation": collected_validation,
    "grouped_columns": grouped_columns,
    "melt": melted,
    "class_medians": class_medians,
    "box_stats": box_stats,
    "class_box_stats": class_box_stats,
}


def _stat(name: str, source: str) -> str:
    v = f"CAST({source} AS DOUBLE)"
    return f"""SELECT '{name}' AS "column", count({v}) AS count, count(*) - count({v}) AS missing,
        round(min({v}), 4) AS min, round(max({v}), 4) AS max, round(avg({v}), 4) AS mean,
        round(stddev_samp({v}), 4) AS std FROM base"""


def _quality(name: str, source: str) -> str:
    v = f"CAST({source} AS DOUBLE)"
    stats = [f"count({v})", f"count(*) - count({v})", f"round(min({v}), 4) + 0.0",
             f"round(max({v}), 4) + 0.0",
             f"round(avg({v}), 4) + 0.0", f"round(stddev_samp({v}), 4)",
             f"count(*) FILTER (WHERE {v} = 0)", f"count(*) FILTER (WHERE {v} < 0)"]
    labels = ["count", "missing", "min", "max", "mean", "std", "zero_count", "negative_count"]
    shown = ", ".join(f"CASE WHEN count({v}) > 0 THEN {s} END AS {n}"
                      for s, n in zip(stats, labels))
    return (f"SELECT '{name}' AS \"column\", CASE WHEN count({v}) > 0 THEN 'valid' ELSE 'no_data' "
            f"END AS status, {shown} FROM base")


_BOX_LONG = """long AS (SELECT l_returnflag, 'l_quantity' AS "Feature", l_quantity AS value
         FROM lineitem UNION ALL
         SELECT l_returnflag, 'l_square', power(l_extendedprice, 4.0) / 1e18 FROM lineitem)"""


def _boxes(keys: str) -> str:
    return f"""WITH {_BOX_LONG},
q AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM long GROUP BY {keys})
SELECT {keys}, any_value(n) AS n, round(any_value(q1), 4) AS q1,
       round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4)
           AS whisker_low,
       round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4)
           AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
           AS outliers
FROM long JOIN q USING ({keys}) GROUP BY {keys}"""


ORACLE = {
    "null_profile": f"WITH {_BASE}, {_COUNTS} "
                    "SELECT name AS \"column\", nulls AS null_count FROM counts",
    "drop_null_columns": f"WITH {_BASE} SELECT o_orderkey, o_custkey, c_nationkey FROM base",
    "drop_null_rows": f"WITH {_BASE} SELECT * FROM base WHERE o_totalprice IS NOT NULL "
                      "AND o_orderstatus IS NOT NULL",
    "null_threshold_sweep": f"WITH {_STEPS} SELECT threshold, features_kept, rows_kept, "
                            "round(weighted_ratio, 9) AS weighted_ratio FROM sweep",
    "best_threshold": f"WITH {_STEPS} SELECT threshold, features_kept, rows_kept, "
                      "round(weighted_ratio, 9) AS weighted_ratio FROM sweep "
                      "ORDER BY sweep.weighted_ratio DESC, threshold LIMIT 1",
    "optimal_dataset": f"WITH {_STEPS}, {_BEST} SELECT {', '.join(_B_COLUMNS)} FROM base WHERE "
                       + " AND ".join(
                           f"({n} IS NOT NULL OR (SELECT nulls FROM counts WHERE name = '{n}') "
                           ">= (SELECT threshold FROM best))" for n in _NAMES),
    "retention_metrics": f"""WITH {_STEPS}, {_PICKED}
SELECT threshold, features_kept, rows_kept,
       round(CAST(features_kept AS DOUBLE) / {len(_NAMES)}, 9) AS feature_share,
       round(CAST(rows_kept AS DOUBLE) / n, 9) AS row_share FROM picked""",
    "clean_columns": """SELECT p_size, p_retailprice AS "Precipitation_1", p_retailprice AS price,
        p_type AS "Stability" FROM part""",
    "clean_columns_for_evaluation": """SELECT p_size AS size_nc, p_size, p_retailprice AS price,
        p_type AS "Stability" FROM part""",
    "missing_rows": f"WITH {_BASE} SELECT * FROM base WHERE o_totalprice IS NULL "
                    "OR c_acctbal IS NULL",
    "valid_key_rows": f"WITH {_BASE} SELECT * FROM base WHERE o_totalprice IS NOT NULL "
                      "AND o_orderpriority IS NOT NULL AND c_acctbal IS NOT NULL",
    "aligned_features": f"""WITH {_BASE} SELECT o_orderkey, coalesce(c_acctbal, 0.0) AS c_acctbal,
        CAST(0.0 AS DOUBLE) AS not_collected, coalesce(o_totalprice, 0.0) AS o_totalprice
        FROM base""",
    "event_scan": "SELECT o_orderkey AS row_id, o_custkey, CAST(o_orderdate AS DATE) AS "
                  "o_orderdate, o_totalprice FROM orders",
    "nan_normalised": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 "
                      "THEN NULL ELSE o_totalprice END AS price FROM orders",
    "numeric_profile": f"WITH {_BASE} " + " UNION ALL ".join(
        _stat(n, n) for n in ["o_orderkey", "o_custkey", "c_nationkey", "o_totalprice",
                              "c_acctbal"]),
    "quality_profile": f"WITH {_BASE} " + " UNION ALL ".join([
        _quality("o_totalprice", "o_totalprice"), _quality("c_acctbal", "c_acctbal"),
        _quality("signed", "round(c_acctbal / 1000)"), _quality("nothing", "NULL"),
        "SELECT 'absent', 'missing_column', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    ]),
    "fill_report": f"WITH {_BASE} " + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS still_missing, "
        f"round(100.0 * count({n}) / count(*), 6) AS success_rate FROM base"
        for n in ["o_totalprice", "c_acctbal"]),
    "collected_validation": f"WITH {_BASE} SELECT CASE \"column\" WHEN 'terrain_price' THEN "
        "'terrain' WHEN 'soil_balance' THEN 'soil' ELSE 'precipitation' END AS \"group\", * FROM ("
        + " UNION ALL ".join([
            _stat("terrain_price", "o_totalprice"), _stat("soil_balance", "c_acctbal"),
            _stat("max_PRCP", "o_custkey")]) + ")",
    "grouped_columns": f"WITH {_BASE} SELECT o_totalprice AS terrain_price, c_acctbal AS "
                       "soil_balance, o_custkey AS \"max_PRCP\" FROM base",
    "melt": " UNION ALL ".join(
        f"SELECT l_returnflag, '{f}' AS \"Feature\", {f} AS value FROM lineitem"
        for f in _BOX_FEATURES),
    "class_medians": " UNION ALL ".join(
        f"SELECT l_returnflag, '{f}' AS \"Feature\", round(median({f}), 4) AS median "
        "FROM lineitem GROUP BY l_returnflag" for f in _BOX_FEATURES),
    "box_stats": _boxes('"Feature"'),
    "class_box_stats": _boxes('"Feature", l_returnflag'),
}
