"""Tables as CSV files with a header, as a database's copy statement writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Quotes are doubled, white space stays, line ends stand as they are inside quotes.
_FORM = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: What a field without quotes and text reads as, in no text of its own.
_NULL = "\x01null\x01"


def to_csv(rows: DataFrame, path: str, by: list[str] | None = None, most: int = 1_000_000) -> None:
    """Writes rows under path, in folders by columns if any, in files of at most so many rows, as a file with line ends in it is
    read by one task. A null is an empty field, an empty text a quoted one."""
    writer = rows.write.mode("overwrite").options(**_FORM, nullValue="", emptyValue='""', quoteAll="false").option("maxRecordsPerFile", most)
    (writer.partitionBy(*by) if by else writer).csv(path)


def from_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows as they were written; a file that does not fit the schema is an error."""
    return spark.read.options(**_FORM, nullValue=_NULL, emptyValue="", multiLine="true", mode="FAILFAST").schema(schema).csv(path)
