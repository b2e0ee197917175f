"""Tables of the service (S24) and reading of small JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names and columns; keys and indexes have no equivalent.
TABLES = {
    "chat_sessions": "id BIGINT, user_id BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "chat_messages": "id BIGINT, session_id BIGINT, role STRING, content STRING, created_at TIMESTAMP",
    "collections": "uuid STRING, name STRING, cmetadata STRING",
    "chunks": "chunk_id STRING, collection STRING, content STRING, meta MAP<STRING, STRING>, embedding ARRAY<FLOAT>",
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """The tables that aren't there yet; chunks are partitioned by collection."""
    made = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet" + (" PARTITIONED BY (collection)" if name == "chunks" else ""))
            made.append(name)
    return made


def add_message(spark: SparkSession, session_id: int, role: str, content: str, database: str = "default") -> None:
    """Appends to a session's talk; the id is the time of writing in microseconds, so talks have an order without ties."""
    row = spark.createDataFrame([(session_id, role, content)], "session_id long, role string, content string")
    row.selectExpr("unix_micros(current_timestamp()) AS id", "session_id", "role", "content", "current_timestamp() AS created_at").write.mode("append").saveAsTable(f"{database}.chat_messages", format="parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
