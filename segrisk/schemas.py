"""Types and names of the columns that several modules share."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

VERTEX = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])

# Outer array: parts of a multi-line. Inner array: the vertices of one part, x = lon and y = lat.
LINES = ArrayType(ArrayType(VERTEX))

ROADS = StructType(
    [
        StructField("ogf_id", LongType()),
        StructField("lines", LINES),
        StructField("district", StringType()),
    ]
)

# Column names of the published road-attribute tables.
ELEMENT_ID = "orn_road_net_element_id"
SPEED_LIMIT = "speed_limit"
NUMBER_OF_LANES = "number_of_lanes"
ROAD_CLASS = "road_class"
