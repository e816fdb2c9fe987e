"""Slow-changing tables per region: population, economy, infrastructure, outages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.fixed_values import (
    CENSUS_DENSITY, CENSUS_DENSITY_DEFAULT, CENSUS_URBAN_PERCENTAGE, ECONOMY, ECONOMY_CONSTANT,
    INFRASTRUCTURE, INFRASTRUCTURE_DEFAULT, POPULATION,
)

INFRASTRUCTURE_SCHEMA = (
    "region_id string, avg_infrastructure_age int, maintenance_score double, condition_rating double"
)
POPULATION_SCHEMA = (
    "region_id string, total_population long, population_density double, urban_percentage double"
)
ECONOMY_SCHEMA = (
    "region_id string, gdp_per_capita double, infrastructure_investment double, poverty_rate double"
)
EMPTY_SCHEMAS = {
    "outages": "region_id string, timestamp timestamp_ntz, customers_affected long, "
               "outage_duration_hours double, cause string",
    "extra_weather": "region_id string, timestamp timestamp_ntz",
    "storm_events": "region_id string, timestamp timestamp_ntz",
    "economy_series": ECONOMY_SCHEMA,
    "bridges": INFRASTRUCTURE_SCHEMA,
}


def fixed_table(spark: SparkSession, table: Mapping[str, tuple], schema: str) -> DataFrame:
    """One of the fixed context tables (20 rows) as a frame."""
    return spark.createDataFrame([(region, *values) for region, values in table.items()], schema)


def infrastructure_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, INFRASTRUCTURE, INFRASTRUCTURE_SCHEMA)


def population_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, POPULATION, POPULATION_SCHEMA)


def economy_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ECONOMY, ECONOMY_SCHEMA)


def infrastructure_context(regions: DataFrame) -> DataFrame:
    """Age and condition per region, with fixed defaults for unlisted regions.

    The broadcast side is the fixed 20-row table.
    """
    table = F.broadcast(infrastructure_table(regions.sparkSession))
    columns = ["avg_infrastructure_age", "maintenance_score", "condition_rating"]
    return regions.join(table, "region_id", "left").select(
        "region_id",
        *[F.coalesce(c, F.lit(default)).alias(c)
          for c, default in zip(columns, INFRASTRUCTURE_DEFAULT)],
    )


def population_context(regions: DataFrame) -> DataFrame:
    table = F.broadcast(population_table(regions.sparkSession))
    return regions.select("region_id").join(table, "region_id", "left")


def economic_context(regions: DataFrame) -> DataFrame:
    table = F.broadcast(economy_table(regions.sparkSession))
    return regions.select("region_id").join(table, "region_id", "left")


def economic_constant(regions: DataFrame) -> DataFrame:
    """The same three figures for every region."""
    gdp, investment, poverty = ECONOMY_CONSTANT
    return regions.select(
        "region_id",
        F.lit(gdp).alias("gdp_per_capita"),
        F.lit(investment).alias("infrastructure_investment"),
        F.lit(poverty).alias("poverty_rate"),
    )


def _density(region: Column) -> Column:
    pairs = [F.lit(x) for item in CENSUS_DENSITY.items() for x in item]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), region), F.lit(CENSUS_DENSITY_DEFAULT)
    )


def population_from_census_json(responses: DataFrame, body: str = "body") -> DataFrame:
    """(region_id, body) responses, each ``[[header...], [value, fips]]``, to population rows.

    Bodies that are not such arrays, or whose value is not an integer, are skipped.
    """
    rows = F.from_json(body, "array<array<string>>")
    population = F.get(F.get(rows, 1), 0).try_cast("long")
    return (
        responses.select("region_id", population.alias("total_population"))
        .where(F.col("total_population").isNotNull())
        .select(
            "region_id", "total_population",
            _density(F.col("region_id")).alias("population_density"),
            F.lit(CENSUS_URBAN_PERCENTAGE).alias("urban_percentage"),
        )
    )


def read_census_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses below ``path/region_id=XX/``, one file each."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("region_id").cast("string"), F.col("value").alias("body")
    )


def empty_with_schema(spark: SparkSession, source: str) -> DataFrame:
    """A typed, empty relation for a source that is not fed yet."""
    return spark.createDataFrame([], EMPTY_SCHEMAS[source])


def load_context(
    regions: DataFrame, census: DataFrame | None = None, use_apis: bool = True
) -> dict[str, DataFrame]:
    """The three context tables by name, from landed responses or the fixed tables."""
    spark = regions.sparkSession
    if use_apis:
        population = (
            population_from_census_json(census) if census is not None
            else spark.createDataFrame([], POPULATION_SCHEMA)
        )
        return {
            "population": population,
            "economic": economic_constant(regions),
            "infrastructure": empty_with_schema(spark, "bridges"),
        }
    return {
        "population": population_context(regions),
        "economic": economic_context(regions),
        "infrastructure": infrastructure_context(regions),
    }
