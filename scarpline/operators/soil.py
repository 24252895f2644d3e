"""Soil survey tables to one soil record per place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.functions import soil_arithmetic, to_number
from scarpline.operators.columns import NUMERIC_TYPES, quoted

POINT = ["latitude", "longitude"]
OPTIONAL_CLASSES = ["runoff", "erocl"]
NULL_SALTS = 256
SPREAD = "__spread"  # below NULL_SALTS, from the whole row; so that a join need not carry columns to spread its rows
SALTS = 64
HOT_ROWS = 100_000  # rows that make a key a frequent one
MOST_HOT = 1000

# ---- fixed values: survey column behind each output column (others keep their name) -------
SURVEY_COLUMNS = {
    "component": {
        "comppct_r": "prcent", "slope_r": "slope_r", "hydgrp": "hydgrp", "runoff": "runoff",
        "erocl": "erocl", "slopelenusle_r": "slopelenusle_r", "slope_h": "slope",
    },
    "chorizon": {
        "hzname": "hzname", "hzdept_r": "deptht", "hzdepb_r": "depthb", "awc_r": "awc",
        "claytotal_r": "clay", "silttotal_r": "silt", "partdensity": "partdensity",
        "sandtotal_r": "sand", "om_r": "OM", "dbthirdbar_r": "bulk_density",
        "wthirdbar_r": "th33", "ph1to1h2o_r": "pH", "ksat_r": "sat_hidric_cond",
        "wtenthbar_r": "wtenthbar_r", "pi_r": "pi_r",
    },
}
# ---- end of fixed values ------------------------------------------------------------------


def _renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """Chosen columns under new names; a column the table lacks is skipped."""
    return table.select(*[F.col(old).alias(new) for old, new in names.items()
                          if old in table.columns])


def hot_keys(tables: dict[str, tuple[DataFrame, str]], at_least: int | None = None) -> dict[str, list]:
    """Per table the values of its key that at least so many rows hold; one pass over all keys.

    Counts are combined map-side, and the ``MOST_HOT`` most frequent keys are kept, so the answer is short.
    """
    at_least = HOT_ROWS if at_least is None else at_least
    pairs = [
        df.select(F.lit(name).alias("t"), F.col(key).cast("string").alias("k"))
        for name, (df, key) in tables.items()
    ]
    counts = reduce(DataFrame.unionAll, pairs).na.drop().groupBy("t", "k").count()
    found: dict[str, list] = {name: [] for name in tables}
    for row in counts.where(F.col("count") >= at_least).orderBy(F.desc("count")).limit(MOST_HOT).collect():
        found[row["t"]].append(row["k"])
    return found


def _outer(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str,
    hot_left: list | None = None, hot_right: list | None = None,
) -> DataFrame:
    """Full or left equi join whose frequent keys are spread over ``SALTS`` tasks.

    Neither join can be split by AQE on its preserved side. Rows with a null key match nothing and are
    spread by their hash, or by ``SPREAD`` where a side has it. Rows of a frequent key are spread on the side
    where it is frequent, and the other side's rows of that key are copied to every salt. A frequent key has
    rows on its own side, so a copy that met none only met an empty salt, and is dropped. A key that is
    frequent on both sides is spread on the right.
    """
    hot_right = hot_right or []
    hot_left = [k for k in hot_left or [] if k not in hot_right]
    carried = SPREAD in left.columns or SPREAD in right.columns
    left, right = (df.withColumnRenamed(SPREAD, f"__{side}_spread") for df, side in ((left, "l"), (right, "r")))

    def with_spread(joined: DataFrame) -> DataFrame:
        """The spread of a joined row follows from those of its two rows."""
        if not carried:
            return joined
        parts = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("__l_spread", "__r_spread") if c in joined.columns]
        return joined.withColumn(SPREAD, F.pmod(reduce(Column.__add__, parts), F.lit(NULL_SALTS)).cast("short")).drop(
            "__l_spread", "__r_spread")

    if how == "left" and not hot_right:
        return with_spread(left.join(right, F.col(left_key) == F.col(right_key), how))

    def salted(df: DataFrame, key: str, spread: list, copied: list, side: str) -> DataFrame:
        text, own_spread = F.col(key).cast("string"), f"__{side}_spread"
        number = F.col(own_spread).cast("long") if own_spread in df.columns else F.xxhash64(*[quoted(c) for c in df.columns])
        own = F.when(F.col(key).isNull(), F.pmod(number, F.lit(NULL_SALTS)) + SALTS).when(
            text.isin(spread), F.pmod(number, F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        if not hot_left and not hot_right:
            return df.withColumn(f"__{side}_salt", own)
        copy = F.coalesce(text.isin(copied), F.lit(False))
        marked = df.withColumns({f"__{side}": F.lit(True), f"__{side}_copy": copy})
        salts = F.when(copy, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(own))
        return marked.withColumn(f"__{side}_salt", F.explode(salts) if copied else own)

    one = salted(left, left_key, hot_left, hot_right, "l")
    two = salted(right, right_key, hot_right, hot_left, "r")
    joined = one.join(two, (F.col(left_key) == F.col(right_key)) & (F.col("__l_salt") == F.col("__r_salt")), how)
    if hot_left or hot_right:
        alone = (F.col("__l").isNull() & F.col("__r_copy")) | (F.col("__r").isNull() & F.col("__l_copy"))
        joined = joined.where(~F.coalesce(alone, F.lit(False)))
    return with_spread(joined).drop(*[f"__{side}{part}" for side in "lr" for part in ("", "_copy", "_salt")])


def _left_to_many(
    left: DataFrame, right: DataFrame, on, present: DataFrame
) -> DataFrame:
    """Left join whose right side may hold one very frequent key.

    AQE can split either side of an inner join but never the right side of a left join, so matched
    rows come from an inner join, and the rest from an anti join with the distinct keys ``present``.
    """
    matched = left.join(right, on)
    alone = left.join(present, on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def _linked(
    tables: dict[str, DataFrame], comonth_key: str, how: str, mapunits: DataFrame | None = None
) -> DataFrame:
    """The eleven tables joined along their keys; ``how`` is the type of every join.

    Full joins on keys that match no null may be taken in any order along the tree of links, as every row
    of a part stays a row of the whole. So tables linked by a horizon meet the horizons first, and these meet
    the components last, when all others are joined: the widest rows are made once and not shuffled again.
    """
    pick = lambda name, **names: _renamed(tables[name], names)
    legend = pick("legend", areasymbol="lg_area", lkey="lg_lkey")
    catalog = pick("sacatalog", areasymbol="sc_area")
    mapunit = pick("mapunit", lkey="mu_lkey", mukey="mukey") if mapunits is None else mapunits
    component = _renamed(tables["component"], {
        "mukey": "co_mukey", "cokey": "cokey", **SURVEY_COLUMNS["component"]})
    month = _renamed(tables["comonth"], {comonth_key: "cm_link", "comonthkey": "cm_key"}) \
        if comonth_key != "comonthkey" \
        else tables["comonth"].select(F.col("comonthkey").alias("cm_link"),
                                      F.col("comonthkey").alias("cm_key"))
    moisture = pick("cosoilmoist", comonthkey="csm_key", soimoistdept_r="soimoistdept_r",
                    soimoistdepb_r="soimoistdepb_r")
    horizon = _renamed(tables["chorizon"], {
        "cokey": "ch_cokey", "chkey": "chkey", **SURVEY_COLUMNS["chorizon"]})
    texture_group = pick("chtexturegrp", chkey="ctg_chkey", chtgkey="ctg_key")
    texture = pick("chtexture", chtgkey="ct_key")
    material = pick("copmgrp", cokey="pmg_cokey")
    restriction = pick("corestrictions", cokey="rt_cokey")

    if mapunits is None:
        areas = _outer(catalog, legend, "sc_area", "lg_area", how)
        units = _outer(areas, mapunit, "lg_lkey", "mu_lkey", how)
    else:
        areas = _outer(legend, catalog, "lg_area", "sc_area", how)
        units = _outer(mapunit, areas, "mu_lkey", "lg_lkey", how)
    steps = [
        (component, "mukey", "co_mukey"), (month, "cokey", "cm_link"), (moisture, "cm_key", "csm_key"),
        (horizon, "cokey", "ch_cokey"), (texture_group, "chkey", "ctg_chkey"),
        (texture, "ctg_key", "ct_key"), (material, "cokey", "pmg_cokey"),
        (restriction, "cokey", "rt_cokey"),
    ]
    hot = hot_keys({right_key: (table, right_key) for table, _, right_key in steps})
    if how == "full":
        spread = lambda df: df.withColumn(
            SPREAD, F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(NULL_SALTS)).cast("short"))
        units = spread(units).select("mukey", SPREAD)
        component, month, moisture, horizon, texture_group, texture, material, restriction = (
            spread(table) for table, _, _ in steps)
        month = _outer(month, moisture, "cm_key", "csm_key", how, None, hot["csm_key"])
        texture_group = _outer(texture_group, texture, "ctg_key", "ct_key", how, None, hot["ct_key"])
        horizon = _outer(horizon, texture_group, "chkey", "ctg_chkey", how, None, hot["ctg_chkey"])
        steps = [
            (component, "mukey", "co_mukey"), (month, "cokey", "cm_link"), (material, "cokey", "pmg_cokey"),
            (restriction, "cokey", "rt_cokey"), (horizon, "cokey", "ch_cokey"),
        ]
    chain, seen = units, {}
    # Only keys that some component has are in the chain; the others' rows must not be copied, as they meet none.
    links = [k for _, left_key, right_key in steps if left_key == "cokey" for k in hot[right_key]]
    owned = component.where(F.col("cokey").cast("string").isin(links)).select(F.col("cokey").cast("string")).distinct()
    known = {row[0] for row in owned.collect()} if links else set()
    for table, left_key, right_key in steps:
        # Rows that a frequent key brought into the chain make it frequent on the left from then on.
        chain = _outer(chain, table, left_key, right_key, how, seen.get(left_key), hot[right_key])
        brought = [k for k in hot[right_key] if left_key != "cokey" or k in known]
        seen[left_key] = list(dict.fromkeys([*seen.get(left_key, []), *brought]))
    return chain


def _projected(linked: DataFrame) -> DataFrame:
    inputs = {"wthirdbar_r": "th33", "dbthirdbar_r": "bulk_density",
              "soimoistdept_r": "soimoistdept_r", "soimoistdepb_r": "soimoistdepb_r"}
    unknown = F.lit(None).cast("string")
    derived = linked.withColumns({
        name: F.col(source) if source in linked.columns else unknown
        for name, source in inputs.items()
    }).withColumns(soil_arithmetic())
    names = ["cokey", "chkey", *S.SOIL_NUMERIC_COLUMNS, *S.SOIL_TEXT_COLUMNS]
    return derived.select("mukey", *[n for n in names if n in derived.columns])


def soil_outer_chain(tables: dict[str, DataFrame], comonth_key: str = "cokey") -> DataFrame:
    """All survey rows of the full outer chain, matched or not."""
    return _projected(_linked(tables, comonth_key, "full"))


def soil_of_mapunits(
    tables: dict[str, DataFrame], wanted: DataFrame, comonth_key: str = "cokey",
    distinct: bool = False,
) -> DataFrame:
    """The chain's rows whose ``mukey`` occurs in ``wanted``.

    Every such row has a map unit, so the outer chain is a left chain from the map units that pass
    the semi join; the big component and horizon tables meet only those. ``distinct`` removes the
    copies that texture, material and restriction tables cause.
    """
    units = _renamed(tables["mapunit"], {"lkey": "mu_lkey", "mukey": "mukey"})
    units = units.join(wanted.select("mukey"), "mukey", "left_semi")
    rows = _projected(_linked(tables, comonth_key, "left", units))
    return rows.distinct() if distinct else rows


def soil_at_points(
    points: DataFrame, point_mukey: DataFrame, tables: dict[str, DataFrame],
    comonth_key: str = "cokey", distinct: bool = False,
) -> DataFrame:
    """Survey rows of each distinct point; a point without soil keeps one key-only row."""
    places = points.select(*POINT).distinct().join(point_mukey, POINT, "left")
    rows = soil_of_mapunits(tables, point_mukey, comonth_key, distinct)
    # Every map unit has at least one survey row, so its key tells whether a point has soil.
    units = tables["mapunit"].select("mukey").distinct()
    return _left_to_many(places, rows, "mukey", units).drop("mukey")


def primary_properties(soil: DataFrame, strict_compat: bool = True) -> DataFrame:
    """The known soil columns that exist, numbers coerced and unreadable text null.

    ``strict_compat=False`` leaves the textual classes ``runoff`` and ``erocl`` as text.
    """
    text = set() if strict_compat else set(OPTIONAL_CLASSES)
    wanted = ["cokey", "chkey", *S.SOIL_NUMERIC_COLUMNS, *S.SOIL_TEXT_COLUMNS, *POINT]
    numeric = set(S.SOIL_NUMERIC_COLUMNS) - text
    return soil.select(*[
        (to_number(F.col(n)) if n in numeric else F.col(n)).alias(n)
        for n in wanted if n in soil.columns
    ])


def _means(column: str, weight: str | None, renormalize: bool) -> Column:
    x, n = F.col(column), F.count(F.lit(1))
    even = F.coalesce(F.sum(x), F.lit(0.0)) / n
    if renormalize:
        even = F.avg(x)
    if weight is None:
        return even
    w = F.col(weight)
    total = F.sum(F.when(x.isNotNull(), w)) if renormalize else F.sum(w)
    weighted = F.coalesce(F.try_divide(F.sum(x * w), total), F.lit(0.0))
    return F.when(F.sum(w) > 0, weighted).otherwise(even)


def group_modes(
    df: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Most frequent value per group and column, the smallest on ties, null without any value.

    Values are counted map-side first, so a group of any size shrinks to its distinct values.
    """
    counted = (
        df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot(keys, columns, "__column", "__value")
        .filter(F.col("__value").isNotNull())
        .groupBy(*keys, "__column", "__value").agg(F.count(F.lit(1)).alias("__n"))
    )
    order = F.struct(-F.col("__n"), F.col("__value"))
    return counted.groupBy(*keys).agg(*[
        F.min_by(F.when(F.col("__column") == c, F.col("__value")),
                 F.when(F.col("__column") == c, order)).alias(c)
        for c in columns
    ])


def aggregate_soil(
    soil: DataFrame, method: str = "weighted_mean", keys: list[str] = POINT,
    weight: str = "prcent", classes: list[str] | None = None, renormalize: bool = False,
) -> DataFrame:
    """One row per place: numbers by ``method``, text classes by their mode.

    ``weighted_mean`` uses the share of ``weight`` in its group, or equal weights where the group's
    weights do not add up to more than zero or the column is absent. Nulls are left out of the sum
    without rescaling (``renormalize=True`` rescales). Unknown methods mean ``mean``.
    """
    classes = [c for c in (classes or S.SOIL_TEXT_COLUMNS) if c in soil.columns]
    numbers = [
        f.name for f in soil.schema.fields
        if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in keys and f.name not in classes
    ]
    by_weight = weight if weight in soil.columns else None
    builders = {
        "weighted_mean": lambda c: _means(c, by_weight, renormalize),
        "max": F.max,
    }
    build = builders.get(method, F.avg)
    known = soil.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    means = known.groupBy(*keys).agg(*[build(c).alias(c) for c in numbers])
    if not classes:
        return means
    return means.join(group_modes(known, keys, classes), keys, "left")


def last_row(soil: DataFrame, keys: list[str] = POINT, order: list[str] | None = None) -> DataFrame:
    """The last row of each place in survey order, for tables that were not aggregated.

    The horizon key takes part in the order and is dropped afterwards.
    """
    order = [c for c in (order or ["cokey", "chkey", "prcent", "deptht"]) if c in soil.columns]
    rest = [c for c in soil.columns if c not in keys]
    # The remaining columns break ties, so the choice never depends on the row order.
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return soil.groupBy(*keys).agg(best.alias("__last")).select(*keys, "__last.*").drop("chkey")


def update_from_points(
    events: DataFrame, soil: DataFrame, lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE,
    prefix: str = "soil_",
) -> DataFrame:
    """Soil columns written to every event of the same coordinates; ``soil`` is unique per place."""
    values = [c for c in soil.columns if c not in POINT]
    news = soil.select(
        F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"),
        F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in values],
    )
    joined = events.join(
        news, (quoted(lat_col) == F.col("__lat")) & (quoted(lon_col) == F.col("__lon")), "left"
    )
    targets = {f"{prefix}{c}": F.col(f"__new_{c}") for c in values}
    kept = [
        (F.when(F.col("__hit"), targets[n]).otherwise(quoted(n)) if n in targets else quoted(n))
        .alias(n)
        for n in events.columns
    ]
    added = [column.alias(n) for n, column in targets.items() if n not in events.columns]
    return joined.select(*kept, *added)
