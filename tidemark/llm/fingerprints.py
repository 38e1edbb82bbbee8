"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps every five-word shingle hash below a fixed fraction (1/scale) of the hash
range. Its size follows the document's, so fingerprints of very unequal documents still tell how
much of one is in the other, and those of parts merge into that of the whole by set union. At
scale 1 every hash is kept and comparisons are exact, however short a document is. At larger
scales a document that has shingles but none below the bound keeps its smallest hash as a guard,
which tells equal texts; merging drops it once a proper hash is there. A longer text doesn't keep
that hash, so what a guard and proper hashes share is unknown: null, not 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import cut_ranges, files_for, literal_rows, partitions_for, range_of

WORDS, SCALE = 5, 1
#: Ranges of ids for each partition, so that partitions, to which ranges are hashed, come out alike.
RANGES_EACH = 4
_LOWEST = -(1 << 63)


def bound(scale: int = SCALE) -> int:
    """Hashes below this (signed, 64 bits) are kept; at scale 1 it lies just above the range."""
    return _LOWEST + (1 << 64) // scale


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``df`` with ``name``, the sorted distinct kept hashes of column ``text``.

    Words lie between ASCII white space. Fewer words than a shingle holds are one shingle; a null
    text or one without words has an empty sketch.
    """
    h, a = (f"_{uuid.uuid4().hex}" for _ in range(2))
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(h, F.transform(F.coalesce(split, F.array().cast("array<string>")), lambda w: F.xxhash64(w)))
    n = F.size(h)
    rolled = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(words)]))
    whole = F.when(n > 0, F.array(F.xxhash64(F.col(h), n))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(a, F.when(n >= words, rolled).otherwise(whole))
    every = F.col(a) if scale == 1 else F.filter(F.col(a), lambda x: x < F.lit(bound(scale)))
    kept = F.sort_array(F.array_distinct(every))
    df = df.withColumn(name, kept)
    guard = F.when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(F.col(name))
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(guard)).drop(h, a)


def _unknown(a: Column, b: Column, scale: int) -> Column:
    """Whether one of two sketches is a guard and the other has proper hashes."""
    if scale == 1:
        return F.lit(False)
    proper = lambda x: F.get(x, F.lit(0)) < F.lit(bound(scale))
    return F.coalesce(proper(a) != proper(b), F.lit(False))


def likeness(a: Column | str, b: Column | str, scale: int = SCALE) -> Column:
    """The estimated Jaccard similarity of two sketches, exact at scale 1; 1 if both are empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).when(~_unknown(a, b, scale), shared / F.greatest(union, F.lit(1)))


def containment(a: Column | str, b: Column | str, scale: int = SCALE) -> Column:
    """The estimated share of a's shingles that b has, exact at scale 1; 1 if a is empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == 0, 1.0).when(~_unknown(a, b, scale), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merged(a: Column | str, b: Column | str, scale: int = SCALE) -> Column:
    """The sketch of two parts together."""
    both = F.sort_array(F.array_union(a, b))
    if scale == 1:
        return both
    proper = F.filter(both, lambda x: x < F.lit(bound(scale)))
    return F.when(F.size(proper) > 0, proper).otherwise(F.slice(both, 1, 1))


def as_string(sketch: Column | str) -> Column:
    """Sixteen hex digits for each hash, in rising order."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the row after it by falling doc_id; the
    row after the last is the first.

    Rows without doc_id come last; rows of one doc_id are ordered by their text's hash and text.
    Ids are cut into ranges (see ``cut_ranges``), an id that holds many rows into several, and each
    range is ordered by itself; the first row of a range also goes, as a guest, to the end of the
    range above, where it is the last row's next. Texts are shuffled once. Only a bounded sample of
    ids and one id and hash for each range reach the driver.
    """
    n = partitions_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    ranged = docs.withColumn("range", range_of(cut_ranges(docs, "doc_id", RANGES_EACH * n), "doc_id", F.col("h")))
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "h"))
    heads = sorted((r[0], r[1]["doc_id"], r[1]["h"]) for r in ranged.groupBy("range").agg(top).collect())
    # the guest of each range is the head of the one below; the lowest range has the highest head
    guests = [(*heads[i - 1][1:], heads[i][0]) for i in range(len(heads))]
    hosts = literal_rows(docs.sparkSession, guests, "guest_id long, guest_h long, host int")
    met = ranged.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("h") == F.col("guest_h")), "left")
    seats = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))))
    seated = met.select("doc_id", "text", "h", F.explode(seats).alias("seat")).select("doc_id", "text", "h", "seat.range", "seat.guest")
    sketched = with_sketch(seated.repartition(n, "range"), "text", "sketch")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    rows = sketched.select("doc_id", "text", "sketch", "guest", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return rows.where("not guest").drop("guest")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last third replaced.

    Rows of one doc_id are ordered by their text's hash and text, rows without one come last; of
    equal rows it makes no difference which comes first.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_next(docs)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))).drop("next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_string("sketch").alias("fingerprint"),
        as_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    ).coalesce(files_for(docs))
