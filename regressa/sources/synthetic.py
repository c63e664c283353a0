"""Synthetic tables (S4-S6) built with ``spark.range`` and seeded column
generators, so they are generated in parallel and reproducible under any
partitioning of the id range. The formulas and ranges follow the reference;
the random draws themselves cannot equal NumPy's.

Large-mean Poisson counts use the normal approximation (rounded, floored at
0); exponentials use inverse-CDF sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Draws:
    """Hands out independent seeded uniform / normal columns."""

    def __init__(self, seed: int):
        self.seed = seed
        self.k = 0

    def _next(self) -> int:
        self.k += 1
        return self.seed * 1000 + self.k

    def uniform(self, lo: float = 0.0, hi: float = 1.0) -> Column:
        return F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.rand(self._next())

    def normal(self, mean: float = 0.0, sd: float = 1.0) -> Column:
        return F.lit(mean) + F.lit(sd) * F.randn(self._next())

    def integers(self, lo: int, hi_exclusive: int) -> Column:
        return (F.floor(F.rand(self._next()) * (hi_exclusive - lo)) + lo).cast("int")

    def choice(self, values) -> Column:
        arr = F.array(*[F.lit(v) for v in values])
        idx = (F.floor(F.rand(self._next()) * len(values)) + 1).cast("int")
        return F.element_at(arr, idx)

    def exponential(self, mean: float) -> Column:
        return -F.lit(mean) * F.log(F.lit(1.0) - F.rand(self._next()))

    def poisson(self, lam: float) -> Column:
        return F.greatest(F.lit(0), F.round(self.normal(lam, lam ** 0.5)).cast("int"))


def regression_dataset(spark: SparkSession, n_samples: int = 1000, n_features: int = 10,
                       noise: float = 0.1, random_state: int = 42) -> DataFrame:
    """N(0,1) features ``feature_1..n``, ``target`` = sum(coef * feature)
    + noise * N(0,1) with coefficients ~ N(0,1), and two categorical columns
    with no effect (``category_A`` in A1-A3, ``category_B`` in B1-B2)."""
    import random

    d = _Draws(random_state)
    rng = random.Random(random_state)
    coefs = [rng.gauss(0.0, 1.0) for _ in range(n_features)]
    base = spark.range(n_samples).select(
        F.col("id"), *[d.normal().alias(f"feature_{i + 1}") for i in range(n_features)])
    target = sum((F.col(f"feature_{i + 1}") * F.lit(c) for i, c in enumerate(coefs)), F.lit(0.0))
    return base.select(
        "id", *[f"feature_{i + 1}" for i in range(n_features)],
        (target + F.lit(noise) * d.normal()).alias("target"),
        d.choice(["A1", "A2", "A3"]).alias("category_A"),
        d.choice(["B1", "B2"]).alias("category_B"))


def house_prices(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """S5 house_prices; price floored at 50,000."""
    d = _Draws(seed)
    df = spark.range(n).select(
        "id", d.normal(2000, 500).alias("size_sqft"), d.integers(1, 6).alias("bedrooms"),
        d.integers(1, 4).alias("bathrooms"), d.integers(0, 50).alias("age_years"),
        d.choice(["Urban", "Suburban", "Rural"]).alias("location"),
        d.choice(["Yes", "No"]).alias("garage"))
    price = (F.col("size_sqft") * 100 + F.col("bedrooms") * 10000 + F.col("bathrooms") * 5000
             + (50 - F.col("age_years")) * 1000
             + F.when(F.col("location") == "Urban", 50000)
             .when(F.col("location") == "Suburban", 30000).otherwise(10000)
             + F.when(F.col("garage") == "Yes", 15000).otherwise(0) + d.normal(0, 20000))
    return df.withColumn("price", F.greatest(price, F.lit(50000.0)))


def marketing_roi(spark: SparkSession, n: int = 800, seed: int = 42) -> DataFrame:
    """S5 marketing_roi; roi floored at 0."""
    d = _Draws(seed)
    df = spark.range(n).select(
        "id", d.exponential(5000).alias("ad_spend"), d.poisson(10000).alias("impressions"),
        d.poisson(500).alias("clicks"),
        d.choice(["Spring", "Summer", "Fall", "Winter"]).alias("season"),
        d.choice(["Social", "Search", "Display", "Email"]).alias("channel"),
        d.choice(["Young", "Middle", "Senior"]).alias("target_audience"))
    roi = (F.col("clicks") * 0.05 + F.col("impressions") * 0.001
           + F.when(F.col("channel") == "Search", 1000)
           .when(F.col("channel") == "Social", 800).otherwise(500) + d.normal(0, 200))
    return df.withColumn("roi", F.greatest(roi, F.lit(0.0)))


def employee_performance(spark: SparkSession, n: int = 600, seed: int = 42) -> DataFrame:
    """S5 employee_performance; score clipped to [0, 100]."""
    d = _Draws(seed)
    df = spark.range(n).select(
        "id", d.exponential(5).alias("experience_years"),
        d.choice(["Bachelor", "Master", "PhD"]).alias("education_level"),
        d.exponential(40).alias("training_hours"), d.integers(3, 15).alias("team_size"),
        d.choice(["Engineering", "Sales", "Marketing", "Support"]).alias("department"),
        d.uniform(0, 100).alias("remote_work_pct"))
    perf = (F.col("experience_years") * 2
            + F.when(F.col("education_level") == "PhD", 15)
            .when(F.col("education_level") == "Master", 10).otherwise(5)
            + F.col("training_hours") * 0.1
            + F.when(F.col("department") == "Engineering", 5).otherwise(0) + d.normal(75, 10))
    return df.withColumn("performance_score", F.least(F.greatest(perf, F.lit(0.0)), F.lit(100.0)))


def sales(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """S6 sales table of the app."""
    d = _Draws(seed)
    df = spark.range(n).select(
        "id", d.uniform(1000, 50000).alias("advertising_spend"),
        d.integers(5, 50).alias("num_salespeople"),
        d.choice(["small", "medium", "large"]).alias("market_size"),
        d.choice(["spring", "summer", "fall", "winter"]).alias("season"),
        d.uniform(50, 200).alias("competitor_price"))
    market = F.create_map(F.lit("small"), F.lit(10000), F.lit("medium"), F.lit(30000),
                          F.lit("large"), F.lit(50000))
    season = F.create_map(F.lit("spring"), F.lit(5000), F.lit("summer"), F.lit(15000),
                          F.lit("fall"), F.lit(10000), F.lit("winter"), F.lit(-5000))
    s = (F.col("advertising_spend") * 0.5 + F.col("num_salespeople") * 1000
         + market[F.col("market_size")] + season[F.col("season")]
         - F.col("competitor_price") * 100 + d.normal(0, 5000))
    return df.withColumn("sales", s)


def student(spark: SparkSession, n: int = 800, seed: int = 42) -> DataFrame:
    """S6 student table of the app; grade clipped to [0, 100]."""
    d = _Draws(seed)
    df = spark.range(n).select(
        "id", d.uniform(0, 10).alias("study_hours"), d.uniform(0.5, 1.0).alias("attendance_rate"),
        d.uniform(50, 100).alias("previous_grade"), d.uniform(0, 1).alias("assignments_completed"),
        d.integers(0, 5).alias("extra_activities"))
    g = (F.col("study_hours") * 5 + F.col("attendance_rate") * 40 + F.col("previous_grade") * 0.3
         + F.col("assignments_completed") * 20 + F.col("extra_activities") * 2 + d.normal(0, 5))
    return df.withColumn("final_grade", F.least(F.greatest(g, F.lit(0.0)), F.lit(100.0)))


def sample_datasets(spark: SparkSession) -> dict:
    return {"house_prices": house_prices(spark), "marketing_roi": marketing_roi(spark),
            "employee_performance": employee_performance(spark)}
