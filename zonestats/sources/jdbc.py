"""Database source: parallel JDBC reads with options from the caller.

Credentials are never part of the code: pass them in ``options`` or name
environment variables that hold them. No JDBC driver jar ships with this
package; the reader only builds the options and calls ``spark.read``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower_bound: int | None = None,
                 upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000, user_env: str | None = None,
                 password_env: str | None = None,
                 extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``.

    A parallel read needs ``dbtable`` (a table or ``(subquery) alias``) with
    partition column and bounds; Spark does not allow them with ``query``,
    so a query is wrapped as a subquery in that case.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts: dict[str, str] = {"url": url, "fetchsize": str(fetch_size),
                            "preferTimestampNTZ": "true"}
    parallel = partition_column is not None
    if parallel:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts["dbtable"] = table if table is not None else f"({query}) AS src"
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    elif table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    if user_env and os.environ.get(user_env):
        opts["user"] = os.environ[user_env]
    if password_env and os.environ.get(password_env):
        opts["password"] = os.environ[password_env]
    opts.update(dict(extra or {}))
    return opts


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**dict(options)).load()
