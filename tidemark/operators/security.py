"""Encrypted payloads, destroyed keys, residency and tenant isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypted(df: DataFrame, keys: DataFrame, column: str = "payload", by: str = "subject") -> DataFrame:
    """``column`` encrypted (AES-GCM) under its subject's key, with the subject as authenticated
    data; a row without a subject stays plain."""
    joined = df.join(keys.select(by, "key"), by, "left")
    return joined.withColumn(column, F.when(F.col("key").isNotNull(), F.aes_encrypt(F.col(column), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col(by))).otherwise(F.col(column).cast("binary"))).drop("key")


def opened(df: DataFrame, keys: DataFrame, column: str = "payload", by: str = "subject") -> DataFrame:
    """``df`` with outcome and text: 'plain' for rows without a subject, 'opened', 'tombstone' where
    the key was destroyed (null or gone), 'rejected' where the key doesn't fit. The envelope still
    reads in every case."""
    joined = df.join(keys.select(by, "key"), by, "left")
    clear = F.try_aes_decrypt(F.col(column), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.col(by))
    outcome = F.when(F.col(by).isNull(), "plain").when(F.col("key").isNull(), "tombstone").when(clear.isNull(), "rejected").otherwise("opened")
    return joined.withColumn("outcome", outcome).withColumn("text", F.when(F.col("outcome") == "plain", F.col(column).cast("string")).when(F.col("outcome") == "opened", clear.cast("string"))).drop("key")


def readable_in(protection: Column, tenant_region: Column, subject_region: Column, region: str) -> Column:
    """Whether a region may read: unprotected always; under a tenant's key if its lease is in the
    region; under subjects' keys only if both leases are."""
    here = lambda c: F.coalesce(c == region, F.lit(False))
    return F.when(protection == "none", True).when(protection == "tenant_key", here(tenant_region)).otherwise(here(tenant_region) & here(subject_region))


def of_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Every read starts here."""
    if not tenant_id:
        raise PermissionError("reads need a tenant")
    return df.where(F.col("tenant_id") == tenant_id)


#: Features this reader knows, and the format versions it reads.
FEATURES, VERSIONS = frozenset({"variant_payload", "relationships", "provenance", "rollup"}), range(1, 4)


def check_features(required: set[str], optional: set[str] = frozenset()) -> set[str]:
    """Unknown required features are refused; returns the optional ones that are known."""
    if unknown := set(required) - FEATURES:
        raise ValueError(f"unknown required features {sorted(unknown)}")
    return set(optional) & FEATURES


def check_version(version: int) -> None:
    if version not in VERSIONS:
        raise ValueError(f"format version {version} is outside {VERSIONS.start}..{VERSIONS.stop - 1}")


def seal(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a set of rows, whatever their order, and their number: sums of row hashes, which
    merge across tasks. It shows that a copy is whole; it is no signature."""
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return df.agg(F.sum(row.cast("decimal(38,0)")).alias("seal"), F.count("*").alias("n"))
