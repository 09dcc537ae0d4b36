"""The pipeline's inputs derived from the benchmark tables ``part`` and ``events``.

All expressions are integer arithmetic or single double operations, so any SQL engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrisk.schemas import ELEMENT_ID
from segrisk.sources.bundle import Dataset

ROADS = """
SELECT p_partkey AS ogf_id,
  CAST((p_partkey*7907)%100003 AS DOUBLE)/100003*0.06 - 79.42 AS lon0,
  CAST((p_partkey*15485863)%100019 AS DOUBLE)/100019*0.04 + 43.64 AS lat0,
  (CAST((p_partkey*31)%201 AS DOUBLE)-100)*0.00001 AS dx1,
  (CAST((p_partkey*37)%201 AS DOUBLE)-100)*0.00001 AS dy1,
  (CAST((p_partkey*41)%201 AS DOUBLE)-100)*0.00001 AS dx2,
  (CAST((p_partkey*43)%201 AS DOUBLE)-100)*0.00001 AS dy2,
  CASE WHEN p_partkey<5 THEN 'TINY' WHEN p_partkey%50=0 THEN NULL
       ELSE concat('D',CAST(p_partkey%6 AS {text})) END AS district
FROM part"""

SPEED = """
SELECT p_partkey AS id, CAST(CASE WHEN p_partkey%11=0 THEN NULL ELSE 30+10*(p_size%6) END AS DOUBLE) AS speed_limit
FROM part WHERE p_partkey%10<>0
UNION ALL SELECT p_partkey, CAST(60 AS DOUBLE) FROM part WHERE p_partkey%25=1"""

LANES = """
SELECT p_partkey AS id, CAST(CASE WHEN p_partkey%13=0 THEN NULL ELSE 1+p_size%4 END AS DOUBLE) AS number_of_lanes
FROM part WHERE p_partkey%7<>0"""

CLASSES = """
SELECT p_partkey AS id, p_type AS road_class FROM part WHERE p_partkey%9<>0"""

CRASHES = """
SELECT event_id AS crash_id,
  CASE WHEN event_id%40=0 THEN NULL
       ELSE CAST((event_id*7919)%100003 AS DOUBLE)/100003*0.06 - 79.42 END AS longitude,
  CAST((event_id*104729)%100019 AS DOUBLE)/100019*0.04 + 43.64 AS latitude,
  CASE WHEN event_id%30=0 THEN 'bad' ELSE {date} END AS date,
  event_type AS weather, concat('D',CAST(user_id%6 AS {text})) AS district
FROM events"""

SPARK_DIALECT = {"text": "STRING", "date": "date_format(ts,'MM/dd/yyyy hh:mm:ss a')"}
DUCKDB_DIALECT = {"text": "VARCHAR", "date": "strftime(ts,'%m/%d/%Y %I:%M:%S %p')"}


def _vertex(x: str, y: str):
    return F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))


def fixture_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The five inputs over the whole ``part`` and ``events`` tables of ``sf_dir``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")

    def query(text: str, **tables: DataFrame) -> DataFrame:
        (name, table), = tables.items()
        return spark.sql(text.format(**SPARK_DIALECT).replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table})

    line = F.array(
        _vertex("lon0", "lat0"),
        _vertex("lon0+dx1", "lat0+dy1"),
        _vertex("lon0+dx1+dx2", "lat0+dy1+dy2"),
    )
    return Dataset(
        roads=query(ROADS, part=part).select("ogf_id", F.array(line).alias("lines"), "district"),
        speed=query(SPEED, part=part).withColumnRenamed("id", ELEMENT_ID),
        lanes=query(LANES, part=part).withColumnRenamed("id", ELEMENT_ID),
        road_class=query(CLASSES, part=part).withColumnRenamed("id", ELEMENT_ID),
        crashes=query(CRASHES, events=events),
    )
