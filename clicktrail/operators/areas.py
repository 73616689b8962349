"""Leading products of each area, with the cities their clicks come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicktrail.functions import double_text, half_up, share
from clicktrail.operators.visits import clicked

# Fixed text: the label of all cities but the two shown.
OTHER_CITIES = "其他"


def area_product_clicks(visits: DataFrame, cities: DataFrame, products: DataFrame) -> DataFrame:
    """Clicks ``n`` per area, product and city.

    Clicks are counted by product and city id before the two inner joins, so neither the
    joins nor a hot product sees single log rows.
    """
    return _clicks_by_id(visits, cities).join(
        products.select("product_id", "product_name"), "product_id"
    ).select("area", "product_id", "product_name", "city_name", "n")


def _clicks_by_id(visits: DataFrame, cities: DataFrame) -> DataFrame:
    by_id = (
        visits.where(clicked("click_product_id"))
        .groupBy(F.col("click_product_id").alias("product_id"), "city_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return by_id.join(cities.select("city_id", "city_name", "area"), "city_id").select(
        "area", "product_id", "city_name", "n")


def _label(name: str, ratio: Column) -> Column:
    return F.concat(F.col(name), F.lit(":"), double_text(ratio), F.lit("%"))


def city_remark(counts: DataFrame, keys: Sequence[str], city: str = "city_name", n: str = "n") -> DataFrame:
    """Total clicks of each group and the text naming its two leading cities.

    ``counts`` holds counts ``n`` per group and city, or several of them to be added up.
    The text is ``city:share%`` for the two leading cities, and the rest under one label
    if there are more than two. Rows without a city count towards the total only.
    """
    keys = list(keys)
    named = F.coalesce(F.col(city) != "", F.lit(False))
    # dealt by the keys alone, so that both sums and the ranks need one shuffle
    per_city = counts.repartition(*keys).groupBy(*keys, city).agg(F.sum(n).alias("n")).withColumn("named", named)
    leading = Window.partitionBy(*keys).orderBy(F.desc("named"), F.desc("n"), city)
    ranked = per_city.withColumn("rk", F.row_number().over(leading))

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("named") & (F.col("rk") == rank), F.col(column)))

    groups = ranked.groupBy(*keys).agg(
        F.sum("n").alias("clickcount"),
        F.sum(F.when(F.col("named"), F.col("n"))).alias("named_total"),
        F.count_if("named").alias("cities"),
        at(1, city).alias("city1"), at(1, "n").alias("n1"),
        at(2, city).alias("city2"), at(2, "n").alias("n2"),
    )
    ratio1 = share(F.col("n1"), F.col("named_total"), 10000, 100)
    ratio2 = share(F.col("n2"), F.col("named_total"), 10000, 100)
    rest = half_up((F.lit(100.0) - F.col("ratio1")) * 100.0) / F.lit(100.0)
    rest = half_up((rest - F.col("ratio2")) * 100.0) / F.lit(100.0)
    other = F.when(
        F.col("cities") > 2, F.concat(F.lit(f"{OTHER_CITIES}:"), double_text(rest), F.lit("%"))
    )
    return (
        groups.withColumn("ratio1", ratio1)
        .withColumn("ratio2", ratio2)
        .select(
            *keys, "clickcount",
            F.concat_ws(
                ",", _label("city1", F.col("ratio1")), _label("city2", F.col("ratio2")), other
            ).alias("cityremark"),
        )
    )


# The remark as an SQL expression over ``counts``, an array of (city_name, n). Each
# transform over a one-element array gives a name to an intermediate value.
_REMARK_SQL = f"""
transform(array(filter(counts, c -> c.city_name <> '')), named ->
  transform(
    array(transform(
      slice(array_sort(named, (a, b) -> CASE
        WHEN a.n > b.n THEN -1 WHEN a.n < b.n THEN 1
        WHEN a.city_name < b.city_name THEN -1 WHEN a.city_name > b.city_name THEN 1
        ELSE 0 END), 1, 2),
      c -> named_struct('city', c.city_name, 'share',
        floor(CAST(c.n AS DOUBLE) / CAST(aggregate(named, 0L, (s, d) -> s + d.n) AS DOUBLE)
              * 10000D + 0.5D) / 100D))),
    shown -> concat_ws(',',
      transform(shown, c -> concat(c.city, ':', CAST(c.share AS STRING), '%')),
      CASE WHEN size(named) > 2 THEN concat('{OTHER_CITIES}:', CAST(
        aggregate(shown, 100D, (rest, c) -> floor((rest - c.share) * 100D + 0.5D) / 100D)
        AS STRING), '%') END))[0])[0]
"""


def register_city_remark(spark: SparkSession, name: str = "city_remark") -> None:
    """Make the remark usable in SQL as a function of the counts per city.

    A query counts per group and city first and hands over each group's list, which has
    one entry per city: ``SELECT k, sum(n), city_remark(collect_list(struct(city_name, n)))
    FROM (SELECT k, city_name, count(*) AS n FROM t GROUP BY k, city_name) GROUP BY k``.
    """
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}"
        "(counts ARRAY<STRUCT<city_name: STRING, n: BIGINT>>) "
        f"RETURNS STRING RETURN {_REMARK_SQL}"
    )


def area_product_top(
    visits: DataFrame, cities: DataFrame, products: DataFrame, k: int = 3
) -> DataFrame:
    """The ``k`` most clicked products of each area, with click count and city remark.

    Products are counted and ranked by id. Those that ``products`` doesn't list are left out
    first; names are looked up for the leaders only.
    """
    known = _clicks_by_id(visits, cities).join(products.select("product_id"), "product_id", "left_semi")
    leaders = top_products(known.select("area", "product_id", "city_name", "n"), k, ["area", "product_id"])
    return leaders.join(products.select("product_id", "product_name"), "product_id").select(
        "area", "product_id", "product_name", "clickcount", "cityremark")


def top_products(
    detail: DataFrame, k: int = 3, keys: Sequence[str] = ("area", "product_id", "product_name")
) -> DataFrame:
    """As :func:`area_product_top`, from counts per area, product and city.

    Products are ranked by their totals, cut per task before the shuffle by area. Cities
    are ranked for the ``k`` leaders of each area only: the counts of all others are left
    out by a semi-join, for which Spark picks the way by the measured size of the leaders.
    Both uses of ``detail`` share its shuffles.
    """
    keys = list(keys)
    by_clicks = Window.partitionBy("area").orderBy(F.desc("clickcount"), *keys[1:])
    leaders = (
        detail.groupBy(*keys)
        .agg(F.sum("n").alias("clickcount"))
        .withColumn("rk", F.row_number().over(by_clicks))
        .where(F.col("rk") <= k)
        .select(*[F.col(c).alias(f"top_{c}") for c in keys])
    )
    same = [F.col(c).eqNullSafe(F.col(f"top_{c}")) for c in keys]
    return city_remark(detail.join(leaders, same, "left_semi"), keys)
