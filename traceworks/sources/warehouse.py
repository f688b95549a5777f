"""Reader and writer options for warehouses, and the copy between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# URL form and driver class per system.
JDBC = {
    "snowflake": ("jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}&schema={schema}"
                  "&warehouse={warehouse}&role={role}", "net.snowflake.client.jdbc.SnowflakeDriver"),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver"),
    "databricks": ("jdbc:databricks://{host}:443;httpPath={http_path}", "com.databricks.client.jdbc.Driver"),
    "sqlite": ("jdbc:sqlite:{path}", "org.sqlite.JDBC"),
    "duckdb": ("jdbc:duckdb:{path}", "org.duckdb.DuckDBDriver"),
    "athena": ("jdbc:athena://WorkGroup={workgroup};Region={region};OutputLocation={staging};Schema={schema}",
               "com.amazon.athena.jdbc.AthenaDriver"),
}


@dataclass
class ReadPlan:
    """A split read: ranges of a numeric or date column, one task each."""

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass
class Connection:
    system: str
    settings: dict[str, str]
    user: str | None = None
    password: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def options(self, table: str, plan: ReadPlan | None = None) -> dict[str, str]:
        """Reader options; BigQuery has its own source, the rest use JDBC."""
        if self.system == "bigquery":
            return {"table": f"{self.settings['project']}.{self.settings['dataset']}.{table}", **self.extra}
        if self.system not in JDBC:
            raise ValueError(f"unknown system {self.system}")
        url, driver = JDBC[self.system]
        out = {"url": url.format(**self.settings), "driver": driver, "dbtable": table, "fetchsize": "10000"}
        if self.user:
            out |= {"user": self.user, "password": self.password or ""}
        if plan:
            out |= {"partitionColumn": plan.column, "lowerBound": plan.lower, "upperBound": plan.upper,
                    "numPartitions": str(plan.partitions)}
        return out | self.extra

    @property
    def format(self) -> str:
        return "bigquery" if self.system == "bigquery" else "jdbc"


def read_table(spark: SparkSession, connection: Connection, table: str, plan: ReadPlan | None = None) -> DataFrame:
    return spark.read.format(connection.format).options(**connection.options(table, plan)).load()


def write_table(df: DataFrame, connection: Connection, table: str, mode: str = "append",
                batch_size: int = 10_000) -> None:
    """Append to, or empty and refill, a warehouse table."""
    writer = df.write.format(connection.format).options(**connection.options(table)).option("batchsize", batch_size)
    if mode == "truncate":
        writer.option("truncate", True).mode("overwrite").save()
    else:
        writer.mode(mode).save()


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, for a copy into untyped columns."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def without_quotes(df: DataFrame) -> DataFrame:
    """Every column as text without single quotes; NULL stays NULL."""
    return df.select(*[F.regexp_replace(F.col(c).cast("string"), "'", "").alias(c) for c in df.columns])
