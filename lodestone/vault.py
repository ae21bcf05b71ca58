"""A vault: one DataFrame for each table, with keyed writes. Writes return a new vault; save() writes Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas


@dataclass(frozen=True)
class Vault:
    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in schemas.TABLES and name not in self.tables):
            raise AttributeError(name)
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], schemas.schema(name))

    def having(self, **tables: DataFrame) -> Vault:
        return Vault(self.spark, {**self.tables, **tables})

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, names: list[str]) -> Vault:
        return Vault(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names})

    def upsert(self, name: str, rows: DataFrame, **policy: str) -> Vault:
        return self.having(**{name: upsert(getattr(self, name), rows, schemas.key(name), policy)})

    def append(self, name: str, rows: DataFrame, ignore: bool = False) -> Vault:
        """Adds rows; with ignore, only those whose key is new, one of each."""
        old = getattr(self, name)
        if ignore:
            keys = list(schemas.key(name))
            rows = rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        return self.having(**{name: old.unionByName(rows, allowMissingColumns=True)})

    def delete(self, name: str, keys: DataFrame) -> Vault:
        return self.having(**{name: getattr(self, name).join(keys, keys.columns, "left_anti")})

    def update(self, name: str, where: Column, **columns: Column) -> Vault:
        df = getattr(self, name)
        return self.having(**{name: df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in columns.items()})})


def one_a_key(new: DataFrame, keys: list[str], policy: Mapping[str, str]) -> DataFrame:
    """Rows of one batch folded to one for each key, by the policy of their columns."""
    folds = {"add": F.sum, "max": F.max, "min": F.min, "union": lambda c: F.when(F.count(c) > 0, F.array_distinct(F.flatten(F.collect_list(c))))}
    rest = [c for c in new.columns if c not in keys and policy.get(c) not in folds]
    folded = [folds[policy[c]](c).cast(new.schema[c].dataType).alias(c) for c in new.columns if c not in keys and c not in rest]
    if rest:
        row = F.struct(*rest)
        folded.append(F.max_by(row, F.to_json(row)).alias("__row"))
    if not folded:
        return new.dropDuplicates(keys)
    out = new.groupBy(*keys).agg(*folded)
    return out.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in new.columns])


#: Rows that a task sorts where the number of rows is known: some hundred bytes each, several times at once in an upsert.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a known number of rows: as many as shuffles have, more if a task would get over TASK_ROWS."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], policy: Mapping[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """old with the rows of new, by key, in one full outer join. parts: how many tasks do it (otherwise as many as shuffles have).

    policy for a column that new has: replace (default), keep (the first value stays), fill (only a
    non-null, non-empty new value replaces), add, max, min, union (of arrays). Columns that new lacks stay.
    Rows of new that share a key count as one: add sums them up, max, min and union take all of them, and the other
    columns come from the row that is the greatest as JSON.
    """
    policy = dict(policy or {})
    keys = list(keys)
    if parts:
        old, new = old.repartition(parts, *keys), new.repartition(parts, *keys)
    a, b = old.alias("a"), one_a_key(new, keys, policy).withColumn("__new", F.lit(True)).alias("b")
    joined = a.withColumn("__old", F.lit(True)).alias("a").join(b, keys, "full_outer")

    def merged(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = F.col("a.__old") & F.col("b.__new")
        how = policy.get(c, "replace")
        if how == "keep":
            value = x
        elif how == "fill":
            value = F.coalesce(F.when(y.cast("string") != "", y) if dict(old.dtypes)[c] == "string" else y, x)
        elif how == "add":
            value = F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        elif how == "max":
            value = F.greatest(x, y)
        elif how == "min":
            value = F.least(x, y)
        elif how == "union":
            value = F.array_union(F.coalesce(x, y), F.coalesce(y, x))
        elif how == "replace":
            value = y
        else:
            raise ValueError(f"no policy {how}")
        return F.when(both, value).when(F.col("b.__new"), y).otherwise(x).alias(c)

    return joined.select(*[F.col(c) if c in keys else merged(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns])
