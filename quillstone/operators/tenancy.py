"""Tenant-scoped reads that fail closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 200


class TenantTable:
    """Rows of one tenant of a table; every read carries the tenant predicate."""

    def __init__(self, df: DataFrame, tenant_col: str, tenant, id_col: str):
        if tenant_col not in df.columns:
            raise TypeError(f"not a tenant table: no column {tenant_col}")
        if tenant is None:
            raise ValueError("a tenant is required")
        self.df, self.tenant_col, self.tenant, self.id_col = df, tenant_col, tenant, id_col

    def rows(self, **equal) -> DataFrame:
        """The tenant's rows that match every ``column=value``; unknown columns are an error."""
        wanted = {self.tenant_col: self.tenant, **equal}
        return self.df.filter(reduce(lambda a, b: a & b, [self.df[k] == F.lit(v) for k, v in wanted.items()]))

    def get(self, key) -> DataFrame:
        """The tenant's row of that id, or none: another tenant's row is not found either."""
        return self.rows(**{self.id_col: key})

    def require(self, key):
        found = self.get(key).limit(2).collect()
        if not found:
            raise LookupError("NOT_FOUND")
        return found[0]

    def page(self, offset: int = 0, limit: int = 50, order: str | None = None, **equal) -> DataFrame:
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit are not negative")
        return self.rows(**equal).orderBy(order or self.id_col).offset(offset).limit(min(limit, MAX_PAGE))

    def count(self, **equal) -> DataFrame:
        return self.rows(**equal).agg(F.count("*").alias("n_rows"))

    def stamped(self, new: DataFrame) -> DataFrame:
        """Rows to append, with this tenant whatever the caller put there."""
        return new.withColumn(self.tenant_col, F.lit(self.tenant))

    def without(self, key) -> DataFrame:
        """The whole table less the tenant's row of that id: what a delete rewrites."""
        return self.df.filter(~F.coalesce((self.df[self.tenant_col] == F.lit(self.tenant)) & (self.df[self.id_col] == F.lit(key)), F.lit(False)))


def payload_filter(chunks: DataFrame, tenant_col: str, tenant, any_of: dict[str, list] | None = None, **equal) -> DataFrame:
    """Tenant first, then one IN per given list, then equalities.  An empty list is no condition."""
    if tenant is None:
        raise ValueError("a tenant is required")
    found = chunks.filter(F.col(tenant_col) == F.lit(tenant))
    for column, values in (any_of or {}).items():
        if values:
            found = found.filter(F.col(column).isin(values))
    for column, value in equal.items():
        found = found.filter(F.col(column) == F.lit(value))
    return found


def in_scope(scope: str, item: str):
    """Membership in an array column of ids where the empty array stands for all."""
    return (F.size(scope) == 0) | F.array_contains(F.col(scope), F.col(item))


def scope_sizes(owners: DataFrame, owner: str, scope: str, items: DataFrame, item: str, name: str) -> DataFrame:
    """How many items each owner's scope holds.

    Listed ids are joined by id; owners of the whole table get its one count, so no
    owner is paired with every item.
    """
    listed = owners.select(owner, F.explode_outer(scope).alias("__id")).join(items.select(F.col(item).alias("__item")), F.col("__id") == F.col("__item"), "left")
    counted = listed.groupBy(owner).agg(F.count("__item").alias("__n"), F.max(F.col("__id").isNull()).alias("__all"))
    total = items.agg(F.count("*").alias("__total"))
    return counted.join(F.broadcast(total), F.lit(True)).select(owner, F.when(F.col("__all"), F.col("__total")).otherwise(F.col("__n")).alias(name))


#: Fixed role matrix.
PERMISSIONS = ("document:read", "document:upload", "document:delete", "query:run", "analysis:run", "user:manage", "evaluation:run")
ROLES = {
    "ADMIN": PERMISSIONS,
    "LEGAL_MANAGER": ("document:read", "document:upload", "document:delete", "query:run", "analysis:run", "evaluation:run"),
    "ANALYST": ("document:read", "document:upload", "query:run", "analysis:run"),
    "VIEWER": ("document:read", "query:run"),
}


def allowed(spark) -> DataFrame:
    """role, permission: the 19 allowed pairs."""
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")


def denied(spark) -> DataFrame:
    every = spark.createDataFrame([(r,) for r in ROLES], "role string").join(spark.createDataFrame([(p,) for p in PERMISSIONS], "permission string"), F.lit(True))
    return every.join(allowed(spark), ["role", "permission"], "left_anti")
