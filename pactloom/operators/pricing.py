"""Cost ranges from evidence, reference projects, nearest references and price estimates (K4-K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the price curve: small and large jobs, and the reference job's apartments, price and risers.
SMALL_N, SMALL_PRICE, LARGE_N, LARGE_PRICE = 10, 8000.0, 100, 5000.0
BASE_N, BASE_PRICE, BASE_RISERS = 49, 280000.0, 15
BASE_REFERENCE = (("baseline", BASE_N, "280000.00", BASE_RISERS, True, True),)
PRICE_TABLES = ("finance.contract_prices", "finance.payment_schedule_items", "finance.unit_prices", "reference_facts_matrix")
PRICE_KEYS = ("contract_price", "gross_total", "net_total", "price", "amount", "value")


def cost_estimate(rows: DataFrame) -> DataFrame:
    """K4: by packet (question_id), the range of the positive prices of allowed tables; three at least.

    rows (question_id, source_table, metadata map<string,string>): each price key of a row counts once. Numbers are cut to whole euros.
    """
    prices = F.array(*[F.expr(f"try_cast(metadata['{k}'] as decimal(18,2))") for k in PRICE_KEYS])
    each = rows.where(F.col("source_table").isin(*PRICE_TABLES)).select("question_id", F.explode(F.filter(prices, lambda p: p > 0)).alias("price"))
    agg = each.groupBy("question_id").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.median("price").alias("mid"))
    out = rows.select("question_id").distinct().join(agg, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 3
    whole = lambda c: F.when(enough, F.col(c).cast("bigint"))
    return out.select("question_id", F.col("n").alias("price_count"), whole("lo").alias("low"), whole("hi").alias("high"), whole("mid").alias("median"), F.when(enough, "estimated").otherwise("insufficient_evidence").alias("status"))


def reference_projects(projects: DataFrame, properties: DataFrame, prices: DataFrame, scopes: DataFrame, segments: DataFrame) -> DataFrame:
    """K5: apartments, fixed price, riser count and the two line flags of each project.

    prices (project_id, price_gross), scopes (project_id, item_name), segments (project_id, segment_type): aggregated apart.
    """
    price = prices.groupBy("project_id").agg(F.max("price_gross").alias("price_gross"))
    risers = scopes.groupBy("project_id").agg(F.max(F.expr("try_cast(nullif(regexp_extract(item_name, '(?i)([0-9]+) JV-pystylinja', 1), '') as int)")).alias("vertical_stack_count"))
    lines = segments.groupBy("project_id").agg(F.bool_or(F.col("segment_type") == "base_drain").alias("includes_base_drain"), F.bool_or(F.col("segment_type") == "plot_line").alias("includes_plot_line"))
    out = projects.join(properties.groupBy("project_id").agg(F.max("apartment_count").alias("apartment_count")), "project_id", "left").join(price, "project_id", "left").join(risers, "project_id", "left").join(lines, "project_id", "left")
    return out.select("project_code", "apartment_count", "price_gross", "vertical_stack_count", F.coalesce("includes_base_drain", F.lit(False)).alias("includes_base_drain"), F.coalesce("includes_plot_line", F.lit(False)).alias("includes_plot_line"))


def _weighted_ratio(weight: str, a: Column, b: Column) -> Column:
    """weight * min / max in decimals, the weight first; 0 if either isn't positive."""
    least = (F.lit(weight).cast("decimal(2,2)") * F.least(a, b)).cast("decimal(14,4)")
    return F.when((a > 0) & (b > 0), least / F.greatest(a, b).cast("decimal(10,0)")).otherwise(F.lit(0).cast("decimal(14,4)"))


def match_reference(cases: DataFrame, references: DataFrame) -> DataFrame:
    """K6: each case's best reference by a weighted score of 4 decimals; ties: more apartments, then code.

    cases (case_id, apartments, risers, base_drain, plot_line). Among references that differ in apartments only, the score
    falls on both sides of the case's number, so only the next ones below and above can be the best: both come from one
    pass over cases and references sorted by apartments, for each combination of risers and lines that references have.
    References with equal traits are one candidate, that of smallest code. Without references the built-in baseline serves.
    """
    spark = cases.sparkSession
    known = references.where("apartment_count > 0 and price_gross is not null")
    base = spark.createDataFrame(BASE_REFERENCE, "project_code string, apartment_count int, price_gross string, vertical_stack_count int, includes_base_drain boolean, includes_plot_line boolean").withColumn("price_gross", F.col("price_gross").cast("decimal(14,2)"))
    none = known.limit(1).withColumn("some", F.lit(True)).agg(F.count("some").alias("n"))
    refs = known.select(*base.columns).unionByName(base.crossJoin(F.broadcast(none)).where("n = 0").drop("n"))  # none is one row
    lines = ["vertical_stack_count", "includes_base_drain", "includes_plot_line"]
    refs = refs.groupBy("apartment_count", *lines).agg(F.min_by("price_gross", "project_code").alias("price_gross"), F.min("project_code").alias("project_code"))
    kinds = refs.select(*lines).distinct().agg(F.collect_list(F.struct(*lines)).alias("kinds"))  # riser counts in use, times four
    traits = ["apartments", "risers", "base_drain", "plot_line"]
    asked = cases.select(*traits).distinct().crossJoin(F.broadcast(kinds)).select(*traits, F.explode("kinds").alias("k")).select(*traits, "k.*")
    ref = F.struct("project_code", "apartment_count", "price_gross")
    both = asked.select(*lines, F.col("apartments").alias("at"), F.struct(*traits).alias("t"), F.lit(None).cast(refs.select(ref.alias("r")).schema["r"].dataType).alias("r"))
    both = both.unionByName(refs.select(*lines, F.col("apartment_count").alias("at"), F.lit(None).cast(both.schema["t"].dataType).alias("t"), ref.alias("r")))
    up = Window.partitionBy(*lines).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*lines).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("below", F.last("r", True).over(up)).withColumn("above", F.last("r", True).over(down)).where("t is not null")
    pairs = near.select("t.*", *lines, F.explode(F.array_distinct(F.filter(F.array("below", "above"), lambda x: x.isNotNull()))).alias("r")).select(*traits, *lines, "r.*")
    risers = F.when(F.col("risers").isNull() | F.col("vertical_stack_count").isNull(), F.lit("0.05").cast("decimal(14,4)")).otherwise(_weighted_ratio("0.10", F.col("risers"), F.col("vertical_stack_count")))
    same = lambda a, b: F.when(F.col(a) == F.col(b), F.lit("0.10")).otherwise(F.lit("0.00")).cast("decimal(14,4)")
    score = F.round(_weighted_ratio("0.70", F.col("apartments"), F.col("apartment_count")) + risers + same("base_drain", "includes_base_drain") + same("plot_line", "includes_plot_line"), 4).cast("decimal(10,4)")
    rank = F.row_number().over(Window.partitionBy(*traits).orderBy(F.desc("score"), F.desc("apartment_count"), "project_code"))
    best = pairs.withColumn("score", score).withColumn("rn", rank).where("rn = 1").drop("rn")
    on = [F.col(f"c.{t}").eqNullSafe(F.col(f"b.{t}")) for t in traits]
    return cases.alias("c").join(best.alias("b"), on).select("c.*", *[f"b.{c}" for c in best.columns if c not in traits])


def curve(n: Column) -> Column:
    """Price of an apartment by the size of a job: flat, two straight lines, flat."""
    mid = BASE_PRICE / BASE_N
    return (
        F.when(n <= SMALL_N, F.lit(SMALL_PRICE)).when(n < BASE_N, SMALL_PRICE + (n - SMALL_N) * ((mid - SMALL_PRICE) / (BASE_N - SMALL_N)))
        .when(n < LARGE_N, mid + (n - BASE_N) * ((LARGE_PRICE - mid) / (LARGE_N - BASE_N))).otherwise(F.lit(LARGE_PRICE))
    )


def estimate_price(matched: DataFrame) -> DataFrame:
    """K7: the estimate, its low and high bound and the price of an apartment, rounded half up once.

    The reference's price of an apartment follows the curve to the case's size and stays within [5000, 8000]; the scope's
    multiplier weighs risers and the two lines. Cases without apartments or with risers of 0 or less have no estimate.
    """
    n, ref = F.col("apartments").cast("double"), F.col("apartment_count").cast("double")
    adjusted = F.least(F.greatest(F.col("price_gross").cast("double") / ref * curve(n) / curve(ref), F.lit(LARGE_PRICE)), F.lit(SMALL_PRICE))
    riser = F.when(F.col("risers").isNull(), F.lit(1.0)).otherwise(F.col("risers").cast("double") / (BASE_RISERS * n / BASE_N))
    factor = 0.70 + 0.10 * riser + 0.10 * F.when(F.col("base_drain"), 1.0).otherwise(0.0) + 0.10 * F.when(F.col("plot_line"), 1.0).otherwise(0.0)
    money = lambda c: F.round(c, 2).cast("decimal(14,2)")
    fine = (F.col("apartments") > 0) & (F.col("risers").isNull() | (F.col("risers") > 0))
    return matched.where(fine).select(
        "case_id", "project_code", "score", money(adjusted).alias("per_apartment"), F.round(factor, 4).cast("decimal(10,4)").alias("multiplier"),
        money(n * adjusted * factor).alias("estimate"), money(n * LARGE_PRICE * factor).alias("low"), money(n * SMALL_PRICE * factor).alias("high"),
    )


def saved_estimates(estimates: DataFrame) -> DataFrame:
    """K8: estimates with their output as JSON, as they are stored."""
    return estimates.withColumn("output_json", F.to_json(F.struct(*estimates.columns)))


def save_estimates(estimates: DataFrame, path: str) -> None:
    """K8: appends estimates with their output as JSON."""
    saved_estimates(estimates).write.mode("append").parquet(path)
