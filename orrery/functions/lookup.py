"""Lookups of months, states, countries and industries.

Countries come from the JVM's own table of ISO 3166, so that no list is kept here; industries from a table that the
caller names, as their codes are revised every few years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Months by name and number; states and territories of the United States by their postal code.
MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
STATES = {
    "AL": "ALABAMA", "AK": "ALASKA", "AZ": "ARIZONA", "AR": "ARKANSAS", "CA": "CALIFORNIA", "CO": "COLORADO", "CT": "CONNECTICUT", "DE": "DELAWARE",
    "FL": "FLORIDA", "GA": "GEORGIA", "HI": "HAWAII", "ID": "IDAHO", "IL": "ILLINOIS", "IN": "INDIANA", "IA": "IOWA", "KS": "KANSAS", "KY": "KENTUCKY",
    "LA": "LOUISIANA", "ME": "MAINE", "MD": "MARYLAND", "MA": "MASSACHUSETTS", "MI": "MICHIGAN", "MN": "MINNESOTA", "MS": "MISSISSIPPI",
    "MO": "MISSOURI", "MT": "MONTANA", "NE": "NEBRASKA", "NV": "NEVADA", "NH": "NEW HAMPSHIRE", "NJ": "NEW JERSEY", "NM": "NEW MEXICO",
    "NY": "NEW YORK", "NC": "NORTH CAROLINA", "ND": "NORTH DAKOTA", "OH": "OHIO", "OK": "OKLAHOMA", "OR": "OREGON", "PA": "PENNSYLVANIA",
    "RI": "RHODE ISLAND", "SC": "SOUTH CAROLINA", "SD": "SOUTH DAKOTA", "TN": "TENNESSEE", "TX": "TEXAS", "UT": "UTAH", "VT": "VERMONT",
    "VA": "VIRGINIA", "WA": "WASHINGTON", "WV": "WEST VIRGINIA", "WI": "WISCONSIN", "WY": "WYOMING", "DC": "DISTRICT OF COLUMBIA",
    "AS": "AMERICAN SAMOA", "FM": "FEDERATED STATES OF MICRONESIA", "GU": "GUAM", "MH": "MARSHALL ISLANDS", "MP": "NORTHERN MARIANA ISLANDS",
    "PW": "PALAU", "PR": "PUERTO RICO", "VI": "VIRGIN ISLANDS",
}


def month_number(c: Column) -> Column:
    """The number of a month given by number or by the first letters of its name; null for anything else."""
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    n = c.try_cast("int")
    return F.when(n.between(1, 12), n).otherwise(F.try_element_at(names, F.upper(F.substring(F.trim(c), 1, 3))))


def state_name(c: Column) -> Column:
    """The name of a state given by its code."""
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.try_element_at(names, F.upper(F.trim(c)))


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str) -> DataFrame:
    """df with the value of a lookup table for its key, in any case, null where there is none.

    The table's size decides how it is joined; duplicate keys keep their smallest value."""
    small = table.groupBy(F.upper(F.trim(table_key)).alias("__k")).agg(F.min(value).alias(out))
    return df.join(small, F.upper(F.trim(F.col(key))) == F.col("__k"), "left").drop("__k")


def countries(spark: SparkSession) -> DataFrame:
    """(country_code, code3, country_name) of ISO 3166, names in English and upper case."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        one = locale("", code)
        rows.append((code, one.getISO3Country(), one.getDisplayCountry(locale.ENGLISH).upper()))
    return spark.createDataFrame(rows, "country_code string, code3 string, country_name string")


def country_by_code(df: DataFrame, key: str, out: str = "country_name") -> DataFrame:
    """df with the name of the country whose code of two or three letters, in any case, is in ``key``; null for any other."""
    known = countries(df.sparkSession)
    both = known.select(F.col("country_code").alias("__k"), F.col("country_name").alias(out)).unionByName(known.select(F.col("code3").alias("__k"), F.col("country_name").alias(out)))
    return df.join(F.broadcast(both), F.upper(F.trim(F.col(key))) == F.col("__k"), "left").drop("__k")


def industries(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(code, title) from a delimited file of industry codes, as public classifications are published; the longest codes are the finest."""
    return spark.read.option("header", True).option("sep", sep).csv(path).toDF("code", "title").where("trim(code) <> ''")


def industry_title(df: DataFrame, key: str, table: DataFrame, out: str = "industry") -> DataFrame:
    """df with the title of its industry code, or of the nearest one above it (its first 5, 4, 3 or 2 digits); null where there is none."""
    code = F.regexp_replace(F.col(key).cast("string"), "[^0-9]", "")
    each = df.withColumn("__row", F.monotonically_increasing_id())
    each = each.withColumn("__codes", F.transform(F.sequence(F.length(code), F.lit(2), F.lit(-1)), lambda n: F.substring(code, F.lit(1), n)))
    tried = each.where(F.length(code) >= 2).select("__row", F.posexplode("__codes").alias("__i", "__k"))
    titles = table.groupBy(F.trim("code").alias("__k")).agg(F.min("title").alias("__title"))
    best = tried.join(titles, "__k").groupBy("__row").agg(F.min_by("__title", "__i").alias(out))
    return each.join(best, "__row", "left").drop("__row", "__codes")
