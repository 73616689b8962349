from clicktrail import operators as op
from tests.rows import visits

CITIES = [(1, "Ayr", "north"), (2, "Bath", "south"), (3, "Cork", "north"), (4, "Deal", "north"), (5, None, "north"), (6, "", "south")]


def dims(spark):
    cities = spark.createDataFrame(CITIES, "city_id BIGINT, city_name STRING, area STRING")
    products = spark.createDataFrame([(p, f"p{p}") for p in range(1, 7)], "product_id BIGINT, product_name STRING")
    return cities, products


def log(spark, counts):
    """Rows from ``{(product, city): clicks}``."""
    return visits(spark, [{"click_product_id": p, "city_id": c} for (p, c), n in counts.items() for _ in range(n)])


def top(spark, counts, k=3):
    rows = op.area_product_top(log(spark, counts), *dims(spark), k).collect()
    return {(r.area, r.product_id): (r.clickcount, r.cityremark) for r in rows}


def test_one_two_and_more_cities(spark):
    got = top(spark, {(1, 2): 2, (2, 1): 2, (2, 3): 1, (3, 1): 3, (3, 3): 2, (3, 4): 2})
    assert got == {
        ("south", 1): (2, "Bath:100.0%"),
        ("north", 2): (3, "Ayr:66.67%,Cork:33.33%"),
        ("north", 3): (7, "Ayr:42.86%,Cork:28.57%,其他:28.57%"),
    }


def test_city_without_a_name_counts_towards_the_total_only(spark):
    got = top(spark, {(1, 1): 1, (1, 5): 3, (2, 6): 2})
    assert got == {("north", 1): (4, "Ayr:100.0%"), ("south", 2): (2, "")}


def test_no_click_unknown_product_and_unknown_city_drop_out(spark):
    assert top(spark, {(-1, 1): 5, (99, 1): 5, (1, 77): 5, (4, 1): 1}) == {("north", 4): (1, "Ayr:100.0%")}


def test_rank_limit_and_ties(spark):
    counts = {(p, 1): 2 for p in range(1, 7)} | {(6, 3): 1}
    want = {("north", 6), ("north", 1), ("north", 2)}
    assert set(top(spark, counts)) == want
    detail = op.area_product_clicks(log(spark, counts), *dims(spark))
    from clicktrail.operators.areas import top_products

    assert {(r.area, r.product_id) for r in top_products(detail, k=3).collect()} == want


def test_remark_ties_go_by_name(spark):
    got = top(spark, {(1, 4): 2, (1, 3): 2, (1, 1): 2})
    assert got["north", 1][1] == "Ayr:33.33%,Cork:33.33%,其他:33.34%"


def test_sql_function_equals_the_operator(spark):
    counts = {(p, c): (p * c) % 5 + 1 for p in range(1, 7) for c in range(1, 7) if (p + c) % 4}
    detail = op.area_product_clicks(log(spark, counts), *dims(spark))
    want = {(r.area, r.product_id): r.cityremark for r in op.city_remark(detail, ["area", "product_id"]).collect()}
    op.register_city_remark(spark)
    detail.createOrReplaceTempView("detail")
    got = spark.sql("""
        SELECT area, product_id, city_remark(collect_list(struct(city_name, n))) AS cityremark
        FROM detail GROUP BY area, product_id""").collect()
    assert {(r.area, r.product_id): r.cityremark for r in got} == want
