"""Semi-structured payloads: paths, kinds, statistics and the columns taken out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A path goes to a column of its own from this presence and agreement on one kind (per cent).
DENSE_PRESENCE, SPARSE_PRESENCE, AGREEMENT = 50, 5, 95
SPARSE_KEYS, MAX_DEPTH = 16, 64
TYPED_KINDS = ("int", "double", "decimal", "string")


def parse(json: Column | str) -> Column:
    """JSON text as a variant; malformed text gives null."""
    return F.try_parse_json(json)


def path(*segments: str | int) -> str:
    """A variant path of field names and array places."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in segments)


def field(payload: Column | str, name: str, kind: str = "string") -> Column:
    """A top-level field, or null if it is absent or of another kind. Fractions are doubles."""
    return F.try_variant_get(payload, path(name), kind)


def nested(payload: Column | str, segments: list[str | int], kind: str = "string") -> Column:
    """A nested value; a missing step or a wrong container gives null."""
    return F.try_variant_get(payload, path(*segments), kind)


def resolved(promoted: Column | str, payload: Column | str, name: str, kind: str, since: int = 0, version: str = "schema_version") -> Column:
    """A promoted column where the row's schema version has it, the payload's field for older rows."""
    c = F.col(promoted) if isinstance(promoted, str) else promoted
    return F.when(F.col(version) >= since, c).otherwise(field(payload, name, kind))


def shredded(column: Column | str, payload: Column | str, name: str, kind: str) -> Column:
    """The shredded column first, then what the payload still holds."""
    return F.coalesce(column, field(payload, name, kind))


def kind_of(value: Column) -> Column:
    """int, decimal, double, string, bool, null, object, array or other, of a variant. Whole JSON
    numbers beyond 64 bits are decimals; every fraction is a double."""
    t = F.schema_of_variant(value)
    return (
        F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(t.rlike(r"^DECIMAL\(\d+,0\)$"), "decimal")
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "bool")
        .when(t == "VOID", "null")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("other")
    )


def exploded(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per top-level field: all columns of ``df`` and key, value."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(payload).outer())).drop("pos") if payload in df.columns else df


def collect_keys(df: DataFrame, payload: str = "payload", depth: int = MAX_DEPTH) -> DataFrame:
    """The distinct object keys at any depth, level by level until no containers are left."""
    level = df.select(F.col(payload).alias("value")).where("value is not null")
    found = None
    for _ in range(depth):
        items = exploded(level.select(F.col("value").alias("_v")), "_v").select("key", "value")
        keys = items.where("key is not null").select("key").distinct()
        found = keys if found is None else found.unionByName(keys).distinct()
        level = items.where(kind_of(F.col("value")).isin("object", "array")).select("value")
        if level.isEmpty():
            break
    return found


def path_statistics(df: DataFrame, payload: str = "payload") -> DataFrame:
    """path, kind, n: how many rows have each top-level field with each kind. Explicit nulls count
    as present. Partial counts of parts add up to those of the whole."""
    items = exploded(df.select(F.col(payload).alias("_v")), "_v")
    return items.where("key is not null").groupBy(F.col("key").alias("path"), kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def shred_plan(statistics: DataFrame, rows: int, excluded: list[str] = ()) -> DataFrame:
    """path, kind, tier ('dense' or 'sparse') of the paths worth a column, from statistics that may
    be partial counts. Dense paths come from presence and agreement alone; of the sparse ones the
    densest SPARSE_KEYS stay, ties by path."""
    by = statistics.groupBy("path", "kind").agg(F.sum("n").alias("n"))
    paths = by.groupBy("path").agg(F.sum("n").alias("present"), F.max(F.struct("n", F.col("kind"))).alias("top"))
    good = paths.where(~F.col("path").isin(*excluded) if excluded else F.lit(True)).where(F.col("top.n") * 100 >= F.col("present") * AGREEMENT).where(F.col("top.kind").isin(*TYPED_KINDS))
    tier = F.when(F.col("present") * 100 >= rows * DENSE_PRESENCE, "dense").when(F.col("present") * 100 >= rows * SPARSE_PRESENCE, "sparse")
    ranked = good.withColumn("tier", tier).where("tier is not null").withColumn("_nth", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("present").desc(), "path")))
    return ranked.where((F.col("tier") == "dense") | (F.col("_nth") <= SPARSE_KEYS)).select("path", F.col("top.kind").alias("kind"), "tier", "present")


def validate_promotion(columns: list[tuple[str, str]], substring_searchable: list[str] = ()) -> None:
    """Promoted (name, kind) columns have distinct names, money is never a float, and only strings
    may be searched for substrings."""
    names = [n for n, _ in columns]
    if len(set(names)) < len(names):
        raise ValueError("a promoted column is named twice")
    for name, kind in columns:
        if kind in ("double", "float") and ("amount" in name or "money" in name):
            raise ValueError(f"{name} holds money and must be a decimal")
        if name in substring_searchable and kind != "string":
            raise ValueError(f"{name} is no string and can't be searched for substrings")
