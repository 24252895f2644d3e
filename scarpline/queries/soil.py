"""Soil survey queries.

Analogue of the eleven survey tables: regions are survey areas, nations legends, customers map
units, orders components, order lines horizons; parts and suppliers give textures, events and
documents the remaining links. Numbers that the survey delivers as text are text here as well.
Suppliers state which map unit lies at which point.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.operators import soil
from scarpline.plans.collection import enrich_soil
from scarpline.queries.base import load, rounded

# Shared statement of the analogue: table -> (source table, {survey column: expression}).
SURVEY = {
    "sacatalog": ("region", {"areasymbol": "r_regionkey"}),
    "legend": ("nation", {"areasymbol": "n_regionkey", "lkey": "n_nationkey"}),
    "mapunit": ("customer", {"lkey": "c_nationkey", "mukey": "c_custkey"}),
    "component": ("orders", {
        "mukey": "o_custkey", "cokey": "o_orderkey",
        "comppct_r": "CASE WHEN o_orderkey % 9 = 4 THEN 'unknown' "
                     "ELSE CAST((o_orderkey % 10) * 10 AS STRING) END",
        "slope_r": "CAST(CAST(o_totalprice AS BIGINT) AS STRING)",
        "hydgrp": "o_orderstatus",
        "runoff": "o_orderpriority",
        "slope_h": "CAST(o_orderkey % 45 AS STRING)",
    }),
    "comonth": ("orders", {"comonthkey": "o_orderkey + 1", "cokey": "o_orderkey"}),
    "cosoilmoist": ("customer", {
        "comonthkey": "c_custkey", "soimoistdept_r": "CAST(c_nationkey + 50 AS STRING)",
        "soimoistdepb_r": "CASE WHEN c_custkey % 3 = 0 THEN 'deep' "
                          "ELSE CAST(c_nationkey AS STRING) END",
    }),
    "chorizon": ("lineitem", {
        "cokey": "l_orderkey", "chkey": "l_partkey", "hzname": "l_returnflag",
        "hzdept_r": "CAST(l_linenumber AS STRING)", "hzdepb_r": "CAST(l_linenumber + 1 AS STRING)",
        "claytotal_r": "CASE WHEN l_suppkey % 6 = 0 THEN NULL "
                       "ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END",
        "dbthirdbar_r": "CAST(CAST(l_extendedprice AS BIGINT) AS STRING)",
        "wthirdbar_r": "CAST(CAST(l_quantity AS BIGINT) AS STRING)",
    }),
    "chtexturegrp": ("part", {"chkey": "p_partkey", "chtgkey": "p_size"}),
    "chtexture": ("supplier", {"chtgkey": "s_suppkey"}),
    "copmgrp": ("events", {"cokey": "event_id"}),
    "corestrictions": ("documents", {"cokey": "doc_id"}),
}
POINT = {"latitude": "s_nationkey * 1e0", "longitude": "(s_suppkey % 7) * 1e0",
         "mukey": "s_suppkey"}
SHOWN = ["mukey", "cokey", "chkey", "prcent", "slope_r", "slope", "deptht", "clay", "th33",
         "wetting_front", "bd", "hydgrp", "runoff", "hzname"]


def tables(spark, sf):
    return {
        name: load(spark, sf, source).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        for name, (source, columns) in SURVEY.items()
    }


def points(spark, sf):
    return load(spark, sf, "supplier").select(*[F.expr(e).alias(c) for c, e in POINT.items()])


def located_customers(spark, sf):
    return load(spark, sf, "customer").select(
        "c_custkey", F.expr("c_nationkey * 1e0").alias("Latitude"),
        F.expr("(c_custkey % 7) * 1e0").alias("Longitude"))


def outer_chain(spark, sf):
    return rounded(soil.soil_outer_chain(tables(spark, sf)).select(*SHOWN), ["bd"])


def outer_chain_literal_key(spark, sf):
    """The month table linked by its own key."""
    return rounded(soil.soil_outer_chain(tables(spark, sf), "comonthkey").select(*SHOWN), ["bd"])


def of_mapunits(spark, sf):
    rows = soil.soil_of_mapunits(tables(spark, sf), points(spark, sf))
    return rounded(rows.select(*SHOWN), ["bd"])


def distinct_of_mapunits(spark, sf):
    rows = soil.soil_of_mapunits(tables(spark, sf), points(spark, sf), distinct=True)
    return rounded(rows.select(*SHOWN), ["bd"])


_AT_POINT = [*soil.POINT, *[c for c in SHOWN if c not in ("mukey", "chkey")]]


def _primary(spark, sf):
    places = located_customers(spark, sf).select(
        F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"))
    rows = soil.soil_at_points(places, points(spark, sf), tables(spark, sf))
    return soil.primary_properties(rows)


def primary_properties(spark, sf):
    return rounded(_primary(spark, sf).select(*_AT_POINT), ["bd"])


def coerce_numeric(spark, sf):
    """Text fragments of the event properties as survey values."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    rows = load(spark, sf, "events").select(
        F.col("event_id").alias("cokey"), k.alias("clay"),
        F.concat(F.lit(" "), k, F.lit(".5")).alias("sand"),
        F.concat(k, F.lit("e-1")).alias("silt"),
        F.when(F.col("event_id") % 2 == 0, F.lit("NaN")).otherwise(k).alias("awc"),
        F.col("event_type").alias("erocl"), F.col("props").alias("OM"),
        F.col("event_type").alias("hydgrp"), F.col("ts").alias("not_a_soil_column"),
    )
    return soil.primary_properties(rows)


def _weighed_lines(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus",
        F.expr(_WEIGHT).alias("prcent"), F.expr(_CLAY).alias("clay"), F.expr(_SAND).alias("sand"))


_WEIGHT = ("CASE WHEN l_suppkey % 5 = 0 THEN 0e0 WHEN l_linenumber = 3 THEN NULL "
           "ELSE l_quantity END")
_CLAY = "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_extendedprice END"
_SAND = "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_tax END"
_NUMBERS = ["prcent", "clay", "sand"]


def _aggregated(spark, sf, method, **options):
    rows = soil.aggregate_soil(
        _weighed_lines(spark, sf), method, ["l_suppkey"],
        classes=["l_returnflag", "l_linestatus"], **options)
    return rounded(rows, _NUMBERS, 4)


def weighted_group_mean(spark, sf):
    return _aggregated(spark, sf, "weighted_mean")


def weighted_group_mean_rescaled(spark, sf):
    return _aggregated(spark, sf, "weighted_mean", renormalize=True)


def unweighted_group_mean(spark, sf):
    """Without the weight column every row counts the same."""
    lines = _weighed_lines(spark, sf).drop("prcent", "l_returnflag", "l_linestatus")
    return rounded(soil.aggregate_soil(lines, keys=["l_suppkey"]), ["clay", "sand"], 4)


def group_mean(spark, sf):
    return _aggregated(spark, sf, "mean")


def group_max(spark, sf):
    return _aggregated(spark, sf, "max")


def group_mode(spark, sf):
    customers = load(spark, sf, "customer")
    named = customers.select("c_nationkey", "c_mktsegment", F.when(
        F.col("c_nationkey") != 3, F.floor(F.col("c_acctbal") / 2000).cast("string"))
        .alias("band"))
    return soil.group_modes(named, ["c_nationkey"], ["c_mktsegment", "band"])


_UPDATED = ["soil_prcent", "soil_clay", "soil_slope", "soil_deptht", "soil_wetting_front",
            "soil_bd", "soil_runoff"]


def soil_enrich(spark, sf):
    found = enrich_soil(located_customers(spark, sf), tables(spark, sf), points(spark, sf))
    shown = found.select("c_custkey", "Latitude", "Longitude", *_UPDATED, "soil_hydgrp",
                         "soil_hzname")
    return rounded(shown, _UPDATED, 4)


def update_join(spark, sf):
    """Existing soil columns are replaced where the place matches and kept elsewhere."""
    supply = load(spark, sf, "supplier").groupBy(
        F.expr(POINT["latitude"]).alias("latitude"), F.expr(POINT["longitude"]).alias("longitude"),
    ).agg(F.sum("s_acctbal").alias("clay"), F.max("s_name").alias("hydgrp"))
    customers = located_customers(spark, sf).withColumn("soil_clay", F.lit(-1.0))
    return rounded(soil.update_from_points(customers, supply), ["soil_clay"], 4)


def last_soil_row(spark, sf):
    rows = _primary(spark, sf).filter("cokey IS NOT NULL")
    return rounded(soil.last_row(rows.select(
        "latitude", "longitude", "cokey", "chkey", "prcent", "deptht", "clay", "slope_r")),
        ["clay", "slope_r"])


QUERIES = {
    "soil_outer_chain": outer_chain,
    "soil_outer_chain_literal_key": outer_chain_literal_key,
    "soil_semi": of_mapunits,
    "soil_semi_distinct": distinct_of_mapunits,
    "soil_at_points": primary_properties,
    "coerce_numeric": coerce_numeric,
    "weighted_group_mean": weighted_group_mean,
    "weighted_group_mean_rescaled": weighted_group_mean_rescaled,
    "unweighted_group_mean": unweighted_group_mean,
    "group_mean": group_mean,
    "group_max": group_max,
    "group_mode": group_mode,
    "update_join": update_join,
    "last_soil_row": last_soil_row,
    "soil_enrich": soil_enrich,
}


def _duck(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR").replace(
        "CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)").replace(
        "CAST(l_extendedprice AS BIGINT)", "CAST(trunc(l_extendedprice) AS BIGINT)")


_SURVEY = ", ".join(
    f"{name} AS (SELECT " + ", ".join(f"{_duck(e)} AS {c}" for c, e in columns.items())
    + f" FROM {source})" for name, (source, columns) in SURVEY.items())


def _number(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def _chain(comonth_key: str) -> str:
    return f"""chain AS (SELECT mu.mukey, co.cokey, ch.chkey, comppct_r AS prcent, slope_r,
      slope_h AS slope, hzdept_r AS deptht, claytotal_r AS clay, wthirdbar_r AS th33,
      {_number("soimoistdept_r")} - {_number("soimoistdepb_r")} AS wetting_front,
      round(({_number("dbthirdbar_r")} - {_number("wthirdbar_r")}) / 100, 6) AS bd,
      hydgrp, runoff, hzname
      FROM sacatalog sc FULL OUTER JOIN legend lg ON sc.areasymbol = lg.areasymbol
      FULL OUTER JOIN mapunit mu ON lg.lkey = mu.lkey
      FULL OUTER JOIN component co ON mu.mukey = co.mukey
      FULL OUTER JOIN comonth cm ON co.cokey = cm.{comonth_key}
      FULL OUTER JOIN cosoilmoist csm ON cm.comonthkey = csm.comonthkey
      FULL OUTER JOIN chorizon ch ON co.cokey = ch.cokey
      FULL OUTER JOIN chtexturegrp ctg ON ch.chkey = ctg.chkey
      FULL OUTER JOIN chtexture ct ON ctg.chtgkey = ct.chtgkey
      FULL OUTER JOIN copmgrp pmg ON co.cokey = pmg.cokey
      FULL OUTER JOIN corestrictions rt ON co.cokey = rt.cokey)"""


_POINTS = "points AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in POINT.items()) \
    + " FROM supplier)"
_CUSTOMERS = """located AS (SELECT c_custkey, c_nationkey * 1e0 AS "Latitude",
      (c_custkey % 7) * 1e0 AS "Longitude" FROM customer)"""
_NUMERIC = ["prcent", "slope_r", "slope", "deptht", "clay", "th33", "runoff"]
_PRIMARY = f"""{_SURVEY}, {_chain("cokey")}, {_POINTS}, {_CUSTOMERS},
places AS (SELECT DISTINCT "Latitude" AS latitude, "Longitude" AS longitude FROM located),
rows_at AS (SELECT p.latitude, p.longitude, cokey, chkey, hydgrp, hzname, wetting_front, bd, """ + ", ".join(
    f"{_number(c)} AS {c}" for c in _NUMERIC) + """ FROM places p
      LEFT JOIN points q ON p.latitude = q.latitude AND p.longitude = q.longitude
      LEFT JOIN chain c ON c.mukey = q.mukey)"""
_LINES = f"""lines AS (SELECT l_suppkey, l_returnflag, l_linestatus, {_WEIGHT} AS prcent,
      {_CLAY} AS clay, {_SAND} AS sand FROM lineitem)"""


def _mode(table: str, keys: str, column: str) -> str:
    return (f"(SELECT {keys}, {column} FROM (SELECT {keys}, {column}, row_number() OVER (PARTITION "
            f"BY {keys} ORDER BY count(*) DESC, {column}) AS rn FROM {table} WHERE {column} "
            f"IS NOT NULL GROUP BY {keys}, {column}) WHERE rn = 1)")


def _weighted(column: str, weight: str = "prcent") -> str:
    return (f"CASE WHEN sum({weight}) > 0 THEN coalesce(sum({column} * {weight}) / sum({weight}), "
            f"0.0) ELSE coalesce(sum({column}), 0.0) / count(*) END")


def _rescaled(column: str, weight: str = "prcent") -> str:
    return (f"CASE WHEN sum({weight}) > 0 THEN coalesce(sum({column} * {weight}) / "
            f"nullif(sum({weight}) FILTER (WHERE {column} IS NOT NULL), 0), 0.0) "
            f"ELSE avg({column}) END")


def _lines_sql(build) -> str:
    means = ", ".join(f"round({build(c)}, 4) AS {c}" for c in _NUMBERS)
    return f"""WITH {_LINES}, means AS (SELECT l_suppkey, {means} FROM lines GROUP BY l_suppkey)
SELECT m.*, l_returnflag, l_linestatus FROM means m
LEFT JOIN {_mode("lines", "l_suppkey", "l_returnflag")} USING (l_suppkey)
LEFT JOIN {_mode("lines", "l_suppkey", "l_linestatus")} USING (l_suppkey)"""


_K = "regexp_extract(props, '(\\d+)', 1)"
ORACLE = {
    "soil_outer_chain": f"WITH {_SURVEY}, {_chain('cokey')} SELECT * FROM chain",
    "soil_outer_chain_literal_key": f"WITH {_SURVEY}, {_chain('comonthkey')} SELECT * FROM chain",
    "soil_semi": f"WITH {_SURVEY}, {_chain('cokey')}, {_POINTS} SELECT * FROM chain "
                 "WHERE mukey IN (SELECT mukey FROM points)",
    "soil_semi_distinct": f"WITH {_SURVEY}, {_chain('cokey')}, {_POINTS} SELECT DISTINCT * "
                          "FROM chain WHERE mukey IN (SELECT mukey FROM points)",
    "soil_at_points": f"WITH {_PRIMARY} SELECT {', '.join(_AT_POINT)} FROM rows_at",
    "coerce_numeric": f"""SELECT event_id AS cokey, {_number(_K)} AS clay,
        {_number(f"' ' || {_K} || '.5'")} AS sand, {_number(f"{_K} || 'e-1'")} AS silt,
        CASE WHEN event_id % 2 = 0 THEN NULL ELSE {_number(_K)} END AS awc,
        CAST(NULL AS DOUBLE) AS erocl, CAST(NULL AS DOUBLE) AS "OM", event_type AS hydgrp
        FROM events""",
    "weighted_group_mean": _lines_sql(_weighted),
    "weighted_group_mean_rescaled": _lines_sql(_rescaled),
    "unweighted_group_mean": f"WITH {_LINES} SELECT l_suppkey, " + ", ".join(
        f"round(coalesce(sum({c}), 0.0) / count(*), 4) AS {c}" for c in ["clay", "sand"])
        + " FROM lines GROUP BY l_suppkey",
    "group_mean": _lines_sql(lambda c: f"avg({c})"),
    "group_max": _lines_sql(lambda c: f"max({c})"),
    "group_mode": f"""WITH named AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey <> 3
        THEN CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) END AS band FROM customer)
        SELECT c_nationkey, c_mktsegment, band
        FROM {_mode("named", "c_nationkey", "c_mktsegment")}
        LEFT JOIN {_mode("named", "c_nationkey", "band")} USING (c_nationkey)""",
    "update_join": f"""WITH {_CUSTOMERS}, supply AS (SELECT {POINT["latitude"]} AS latitude,
        {POINT["longitude"]} AS longitude, sum(s_acctbal) AS clay, max(s_name) AS hydgrp
        FROM supplier GROUP BY 1, 2)
        SELECT l.c_custkey, l."Latitude", l."Longitude",
        round(CASE WHEN s.latitude IS NOT NULL THEN s.clay ELSE -1.0 END, 4) AS soil_clay,
        s.hydgrp AS soil_hydgrp FROM located l
        LEFT JOIN supply s ON l."Latitude" = s.latitude AND l."Longitude" = s.longitude""",
    "last_soil_row": f"""WITH {_PRIMARY} SELECT latitude, longitude, cokey, prcent, deptht,
        round(clay, 6) AS clay, round(slope_r, 6) AS slope_r FROM (SELECT *, row_number() OVER (
        PARTITION BY latitude, longitude ORDER BY cokey DESC, chkey DESC NULLS LAST, prcent DESC NULLS LAST,
        deptht DESC NULLS LAST, clay DESC NULLS LAST, slope_r DESC NULLS LAST) AS rn FROM rows_at
        WHERE cokey IS NOT NULL) WHERE rn = 1""",
    "soil_enrich": f"""WITH {_PRIMARY}, means AS (SELECT latitude, longitude, """ + ", ".join(
        f"round({_weighted(c.removeprefix('soil_'))}, 4) AS {c}" for c in _UPDATED)
        + f""" FROM rows_at GROUP BY latitude, longitude)
SELECT l.c_custkey, l."Latitude", l."Longitude", {', '.join(_UPDATED)}, hydgrp AS soil_hydgrp,
       hzname AS soil_hzname
FROM located l JOIN means m ON l."Latitude" = m.latitude AND l."Longitude" = m.longitude
LEFT JOIN {_mode("rows_at", "latitude, longitude", "hydgrp")} h
  ON h.latitude = m.latitude AND h.longitude = m.longitude
LEFT JOIN {_mode("rows_at", "latitude, longitude", "hzname")} z
  ON z.latitude = m.latitude AND z.longitude = m.longitude""",
}
