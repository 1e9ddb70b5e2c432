"""Readers and preparation specs for the three public data sets the reference uses.

Each ``read_*`` returns a DataFrame with the reference's column names, the
label cleaned, and an order key (source file, position in the file) for the
row ids; each ``*_spec`` is the matching :class:`PrepSpec` (column kinds,
party groups, label rule, split sizes).  ``prepare_vertical(read_x(..),
x_spec())`` then does what the reference's preparation script does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.operators import prep
from partyframe.plans.prepare import PrepSpec
from partyframe.sources import tables

# fixed values: census income columns (file order), their kinds and the three parties' column groups
CENSUS_COLUMNS = ["age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation",
                  "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week",
                  "native_country", "over_50k"]
CENSUS_NUMERIC = ["age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week"]
CENSUS_CATEGORICAL = ["workclass", "education", "marital_status", "occupation", "relationship", "race", "sex",
                      "native_country"]
CENSUS_PARTIES = [["age", "workclass", "fnlwgt", "education", "education_num"],
                  ["marital_status", "occupation", "relationship", "race", "sex"],
                  ["capital_gain", "capital_loss", "hours_per_week", "native_country"]]

# fixed values: wine quality feature columns (after name normalisation) and party groups
WINE_NUMERIC = ["fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar", "chlorides",
                "free_sulfur_dioxide", "total_sulfur_dioxide", "density", "ph", "sulphates", "alcohol", "color"]
WINE_PARTIES = [["fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar"],
                ["chlorides", "free_sulfur_dioxide", "total_sulfur_dioxide", "density"],
                ["ph", "sulphates", "alcohol", "color"]]
WINE_GOOD_QUALITY = 7

# fixed values: forest cover measured columns (file order); indicator columns follow by rule
COVTYPE_MEASURES = ["elevation", "aspect", "slope", "horizontal_distance_to_hydrology",
                    "vertical_distance_to_hydrology", "horizontal_distance_to_roadways", "hillshade_9am",
                    "hillshade_noon", "hillshade_3pm", "horizontal_distance_to_fire_points"]
COVTYPE_WILDERNESS = [f"wilderness_area_{i}" for i in range(4)]
COVTYPE_SOIL = [f"soil_type_{i}" for i in range(40)]
COVTYPE_COLUMNS = COVTYPE_MEASURES + COVTYPE_WILDERNESS + COVTYPE_SOIL + ["cover_type"]
COVTYPE_PARTIES = [["elevation", "aspect", "slope", "horizontal_distance_to_hydrology",
                    "horizontal_distance_to_roadways", "horizontal_distance_to_fire_points",
                    "vertical_distance_to_hydrology"],
                   ["hillshade_9am", "hillshade_noon", "hillshade_3pm"] + COVTYPE_WILDERNESS,
                   COVTYPE_SOIL]


def _with_order(df: DataFrame, source: int) -> DataFrame:
    """Order key: the source file, then the position within it (stable for the same files)."""
    return df.withColumn("_src", F.lit(source)).withColumn("_row", F.monotonically_increasing_id())


# ------------------------------------------------------------------ census income

def read_census(spark: SparkSession, data_path: str, test_path: str) -> DataFrame:
    """Training file + test file (banner line, labels ending in '.'); ``_split`` marks test rows."""
    st = T.StructType([T.StructField(c, T.LongType() if c in CENSUS_NUMERIC else T.StringType())
                       for c in CENSUS_COLUMNS])
    tr = _with_order(tables.read_csv_no_header(spark, data_path, st), 0).withColumn("_split", F.lit("tr"))
    te = _with_order(tables.read_csv_no_header(spark, test_path, st, banner_prefix="|"), 1) \
        .withColumn("_split", F.lit("te")).withColumn("over_50k", prep.first_part("over_50k"))
    return tr.unionByName(te)


def census_spec(seed: int = 0) -> PrepSpec:
    """10 % of the training file for validation, the test file for test; encoders fitted on the
    training file; label = the second income class in sorted order."""
    return PrepSpec(numeric=CENSUS_NUMERIC, categorical=CENSUS_CATEGORICAL, parties=CENSUS_PARTIES,
                    label="over_50k", order_by=["_src", "_row"], fractions=(0.1,), seed=seed,
                    fit_on="not_test", presplit="_split")


# ------------------------------------------------------------------ wine quality

def read_wine(spark: SparkSession, red_path: str, white_path: str) -> DataFrame:
    """Both files (header, ';'), a ``color`` column (0 red, 1 white), names normalised; numbers
    that do not parse or are missing take the column's mean over both files (P10)."""
    def one(path, color, src):
        df = tables.normalise_names(tables.read_csv_header(spark, path, sep=";"))
        df = df.select(*[prep.to_double(F.col(c)).alias(c) for c in df.columns])
        return _with_order(tables.with_source(df, "color", float(color)), src)
    both = one(red_path, 0, 0).unionByName(one(white_path, 1, 1))
    return prep.impute_mean(both, prep.fit_means(both, WINE_NUMERIC))


def wine_spec(seed: int = 0) -> PrepSpec:
    """20 % held out, half of it for test; encoders fitted on all rows; label = quality >= 7."""
    return PrepSpec(numeric=WINE_NUMERIC, categorical=[], parties=WINE_PARTIES,
                    label=prep.threshold_label("quality", WINE_GOOD_QUALITY), order_by=["_src", "_row"],
                    fractions=(0.2, 0.5), holdout=True, seed=seed)


# ------------------------------------------------------------------ forest cover

def read_covtype(spark: SparkSession, path: str) -> DataFrame:
    st = T.StructType([T.StructField(c, T.LongType()) for c in COVTYPE_COLUMNS])
    return _with_order(tables.read_csv_no_header(spark, path, st), 0)


def covtype_spec(seed: int = 0) -> PrepSpec:
    """20 % held out, half of it for test; encoders fitted on all rows; label = cover type 1..7 -> 0..6."""
    return PrepSpec(numeric=COVTYPE_MEASURES + COVTYPE_WILDERNESS + COVTYPE_SOIL, categorical=[],
                    parties=COVTYPE_PARTIES, label=prep.remap("cover_type", {i: i - 1 for i in range(1, 8)}),
                    order_by=["_src", "_row"], fractions=(0.2, 0.5), holdout=True, seed=seed)
