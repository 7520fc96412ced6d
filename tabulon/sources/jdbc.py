"""Database sources through Spark's JDBC reader.

The query runs on the database server (``query`` option), as in the
reference; Spark only receives the result.  A numeric or date
``partition_column`` splits big results across executors, over
``num_partitions`` ranges between its bounds.  A ``hash_column`` of any type splits
them by a hash that the server computes, one query per partition.  Without either
a single task reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.sources.guards import SourceError

# Default ports and driver classes of the supported databases.
DEFAULT_PORTS = {"mysql": 3306, "postgresql": 5432}
DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver",
           "sqlite": "org.sqlite.JDBC"}
#: Non-negative number of a column's value, computed by the server.  SQLite has no hash
#: function; length and last characters stand in.
HASHES = {
    "mysql": "CRC32(CAST({column} AS CHAR))",
    "postgresql": "ABS(HASHTEXT(CAST({column} AS TEXT))::BIGINT)",
    "sqlite": "(LENGTH(CAST({column} AS TEXT)) * 31 + COALESCE(UNICODE(SUBSTR(CAST({column} AS TEXT), -1)), 0) * 7"
              " + COALESCE(UNICODE(SUBSTR(CAST({column} AS TEXT), -2)), 0))",
}


def hash_predicates(source_type: str, column: str, parts: int, expression: str | None = None) -> list[str]:
    """One condition per partition; together they hold for every row exactly once, the rows
    without a value in the first."""
    number = (expression or HASHES[source_type]).format(column=column)
    modulo = f"({number} % {parts})" if source_type == "sqlite" and not expression else f"MOD({number}, {parts})"
    return [f"{modulo} = {i}" + (f" OR {column} IS NULL" if i == 0 else "") for i in range(parts)]


def jdbc_url(source_type: str, cfg: dict) -> str:
    if source_type == "sqlite":
        return f"jdbc:sqlite:{cfg.get('database') or cfg.get('path') or ':memory:'}"
    host = cfg.get("host", "localhost")
    port = cfg.get("port") or DEFAULT_PORTS[source_type]
    return f"jdbc:{source_type}://{host}:{port}/{cfg['database']}"


def validate(source_type: str, cfg: dict | None) -> dict:
    if not cfg:
        raise SourceError("db_config is required for database sources")
    if not cfg.get("query"):
        raise SourceError("SQL query is required for database sources")
    if int(cfg.get("num_partitions", 8)) < 1:
        raise SourceError("num_partitions must be at least 1")
    if source_type in DEFAULT_PORTS:
        missing = [k for k in ("database", "user") if not cfg.get(k)]
        if missing:
            raise SourceError(f"Missing required database config: {missing}")
    return cfg


def load_database(spark: SparkSession, source_type: str, cfg: dict | None) -> DataFrame:
    cfg = validate(source_type, cfg)

    def reader():
        r = (spark.read.format("jdbc")
             .option("url", cfg.get("url") or jdbc_url(source_type, cfg))
             .option("driver", cfg.get("driver") or DRIVERS[source_type]))
        if cfg.get("user"):
            r = r.option("user", cfg["user"]).option("password", cfg.get("password", ""))
        return r

    if cfg.get("hash_column") and not cfg.get("partition_column"):
        parts = int(cfg.get("num_partitions", 8))
        properties = {"driver": cfg.get("driver") or DRIVERS[source_type]}
        properties |= {k: str(cfg[v]) for k, v in (("user", "user"), ("password", "password"), ("fetchsize", "fetch_size"))
                       if cfg.get(v)}
        return spark.read.jdbc(cfg.get("url") or jdbc_url(source_type, cfg), f"({cfg['query']}) q", properties=properties,
                               predicates=hash_predicates(source_type, cfg["hash_column"], parts, cfg.get("hash_expression")))
    r, column = reader(), cfg.get("partition_column")
    low, high = cfg.get("lower_bound"), cfg.get("upper_bound")
    if column and (low is None or high is None):
        # The database gives the bounds: one row.
        low, high = reader().option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi "
                                             f"FROM ({cfg['query']}) q").load().first()
    if column and low is not None:
        # Partitioned read: Spark issues one bounded query per partition.
        r = (r.option("dbtable", f"({cfg['query']}) q").option("partitionColumn", column)
             .option("lowerBound", low).option("upperBound", high)
             .option("numPartitions", cfg.get("num_partitions", 8)))
    else:
        r = r.option("query", cfg["query"])
    if cfg.get("fetch_size"):
        r = r.option("fetchsize", cfg["fetch_size"])
    return r.load()
