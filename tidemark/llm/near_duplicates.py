"""Near-duplicate documents by a signature-coordinate inverted join.

1. Documents with equal shingle sets form one class, so exact copies never meet each other again.
   A class is known by a number of its own, never by a doc_id, which several texts may carry.
2. Each class has a MinHash signature of ``coordinates`` values. Two sets of the wanted similarity
   agree in fewer than ``matches`` coordinates with a probability below ``miss``.
3. Classes are posted under (coordinate, value). A value that no other class has can't help a
   match; the rest are ordered by rising frequency, and by the prefix principle two classes with
   ``matches`` equal coordinates share one of the first (usable - matches + 1). Only those are
   posted; the coordinates after the prefix are skipped and compared on the signatures themselves.
4. In each posting everybody meets its most central member; in short postings, each other too.
   Pairs that agree in ``matches`` coordinates are confirmed on their full shingle sets.
5. Long postings whose members aren't all connected yet are finished exactly: their classes'
   whole shingle sets are joined by rarest-first prefixes with size and position bounds, which
   tests every pair of different components that can still reach the similarity.
6. Components follow from the confirmed links.

Nothing is emitted for all pairs of a group, and no group meets in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.workspace import Workspace, files_for, slices

_U = np.uint64
#: Postings of up to so many classes compare every two of them.
SHORT = 12
#: Ids that are sent to every task to pick rows from the documents; more are joined by shuffle.
SENT_IDS = 1_000_000


def matches_needed(coordinates: int, percent: int, miss: float = 1e-6) -> int:
    """The most matches t for which sets at the threshold have fewer than t with probability <= miss."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def signatures(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_shingles, key (digest of the shingle set, null if empty),
    signature."""
    random = np.random.default_rng(20_240_607)
    xors, factors = random.integers(0, 1 << 63, coordinates, dtype=_U), random.integers(0, 1 << 63, coordinates, dtype=_U) * _U(2) + _U(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes, keys, rows = [], [], []
            for s in shingle_sets(texts, words):
                sizes.append(len(s))
                keys.append(key_of(s))
                if len(s):
                    least = np.full(coordinates, np.iinfo(_U).max, _U)
                    for at in range(0, len(s), 1024):
                        np.minimum(least, ((s[at : at + 1024, None] ^ xors) * factors).min(axis=0), out=least)
                    rows.append((least >> _U(32)).astype(np.uint32).view(np.int32))
            digests = [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) > 0)]).astype(np.int32) * coordinates
            yield pa.record_batch(
                [batch.column(0), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "digest", "n_shingles", "key", "signature"],
            )

    return docs.mapInArrow(signed, "doc_id long, digest string, n_shingles long, key binary, signature array<int>")


def key_of(shingles: np.ndarray) -> bytes | None:
    """A digest of a shingle set; none of an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their distinct shingles;
    component_id is the smallest doc_id that links reach. Null, empty and blank texts have no
    shingles and are components of their own. Repeated rows stay repeated, and rows that share a
    doc_id are linked by their own texts each. A row without doc_id is linked like any other, but
    never kept; its component_id is null if it reaches no doc_id. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "near", files_for(docs))
    rows = labelled(ws, docs, words, percent, coordinates)
    out = rows.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).coalesce(files_for(docs))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 64) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each component of linked documents:
    one with the smallest doc_id (none counts as the largest), then the smallest MD5 of the text.

    Rows without shingles form no group and all stay.
    """
    ws = Workspace(docs.sparkSession, "one", files_for(docs))
    rows = labelled(ws, docs, words, percent, coordinates).where("component is not null").select("component", "doc_id", "digest")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    groups = rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    texts = rows.join(groups, "component").groupBy("doc_id", "digest", (place == F.col("first")).alias("stays")).agg(F.count("*").alias("n"))
    fates = ws.stage(texts.where("not stays or n > 1").select("doc_id", "digest", "stays"), "fates")
    few = fates.count() <= SENT_IDS  # then whole rows needn't be shuffled
    # helper columns of names that no input has
    doc_id, digest, stays = (f"_{uuid.uuid4().hex}" for _ in range(3))
    fates = fates.toDF(doc_id, digest, stays)
    text_digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    met = docs.join(F.broadcast(fates) if few else fates, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (text_digest == F.col(digest)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = met.where(F.col(stays).isNull()).select(*columns)
    if fates.where(stays).isEmpty():
        return alone
    # rows that repeat a text that stays: the first of each, of those rows only
    once = met.where(stays).groupBy(doc_id, digest).agg(F.first(F.struct(*columns)).alias(stays)).select(f"{stays}.*")
    return alone.unionByName(once)


def labelled(ws: Workspace, docs: DataFrame, words: int, percent: int, coordinates: int) -> DataFrame:
    """doc_id, digest, n_shingles, component (a number; null without shingles) and least, the
    smallest doc_id of the component, for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = ws.stage(signatures(docs, words, coordinates), "signed")
    # a class's number is that of its row in the written table
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = ws.stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = class_components(ws, docs, classes, words, percent, coordinates)
    least = found.join(classes.select(F.col("id").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"))
    linked = found.join(least, "component").select(F.col("node").alias("id"), "component", "least")
    labels = classes.select("key", "id", "doc").join(linked, "id", "left").select("key", F.coalesce("component", "id").alias("component"), F.coalesce("least", "doc").alias("least"))
    return signed.drop("signature").join(labels, "key", "left").drop("key")


def class_components(ws: Workspace, docs: DataFrame, classes: DataFrame, words: int, percent: int, coordinates: int) -> DataFrame:
    """node, component of all linked classes (id, doc, key, n, signature), exactly. Classes have a
    shingle at least; doc may be null, and several classes may share one. No classes, or none that
    are linked, give no rows."""
    need = matches_needed(coordinates, percent)
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = classes.select("id", F.posexplode("signature").alias("at", "value")).select("id", token.alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    usable = (
        posted.join(often, "token")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"), F.sum(F.log2(F.col("n").cast("double"))).alias("central"))
        .where(F.size("tokens") >= need)
    )
    first = F.explode(F.slice("tokens", 1, F.size("tokens") - need + 1))
    prefix = usable.select("id", "central", first.alias("t")).select("id", F.round("central", 6).alias("central"), F.col("t.token").alias("token"))
    prefix = ws.stage(prefix, "prefix")
    leaders = prefix.groupBy("token").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("lead"), F.count("*").alias("size")).where("size > 1")
    meets = prefix.join(leaders, "token").select("token", "id", "size", (-F.col("lead.minus")).alias("leader"))
    stars = meets.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    short = meets.where(f"size between 3 and {SHORT}").select("token", "id")
    close = short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "token").where("a < b").select("a", "b")
    pairs = stars.unionByName(close).distinct()

    of = classes.select("id", "n", "signature")
    side = lambda x: of.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    agreeing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, m: t + m)
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").where(agreeing >= need)
    likely = ws.stage(likely.select("a", "b"), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = ws.stage(full_sets(docs, classes.join(ids, "id", "left_semi"), words), "sets")
    links = ws.stage(confirmed(likely, sets, percent), "links")
    ws.drop("sets", "likely")

    # long postings that are not yet one component
    found = components(ws, links, "first")
    long = prefix.join(leaders.where(f"size > {SHORT}").select("token"), "token").join(found.withColumnRenamed("node", "id"), "id", "left")
    long = ws.stage(long.select("token", "id", F.coalesce("component", "id").alias("label")), "long")
    open_ = long.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    members = ws.stage(long.join(open_, "token").select("id", "label").distinct(), "members")
    if members.isEmpty():
        return found
    sets = ws.stage(full_sets(docs, classes.join(members, "id", "left_semi"), words), "member-sets")
    late = confirmed(prefix_pairs(ws, sets.join(members, "id"), percent), sets, percent)
    # what is linked already goes on as stars
    return components(ws, found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late), "all")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted distinct hashes) of ``classes`` (id, doc, key), read again from ``docs``.

    Texts are picked by the class's doc_id (rows without one together) and then by the key of their
    shingle set, so that of texts that share a doc_id each class gets its own.
    """
    classes = classes.select("id", "doc", "key")
    ids = classes.select("doc").distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(shingle_sets(batch.column(0).to_pylist(), words))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array([key_of(s) for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "shingles"])

    made = chosen.mapInArrow(sets, "key binary, shingles array<bigint>").where("key is not null")
    return made.groupBy("key").agg(F.first("shingles").alias("shingles")).join(classes, "key").select("id", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("shingles", "s_a"), "a").join(sets.withColumnRenamed("id", "b").withColumnRenamed("shingles", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("shared", shared).where(F.lit(100) * F.col("shared") >= percent * (F.size("s_a") + F.size("s_b") - F.col("shared"))).select("a", "b")


def prefix_pairs(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of different labels that can be similar enough, by prefixes of whole sets. An id has one
    row; empty sets are in no pair, and no sets give none.

    ``sets``: id, label, shingles. With shingles in order of rising frequency, sets x and y with
    |y| <= |x| that share o >= p/(100+p) * (|x|+|y|) elements share one at places i, j with
    |x|-i+1 >= o and |y|-j+1 >= o. x asks in steps of 2 % of size, each with its own bound.
    """
    rows = sets.select("id", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    # a class has n - (its shared shingles) that stand first in its order
    placed = (
        rows.join(often, "h")
        .groupBy("id", "label", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("shared"))
        .select("id", "label", "n", (F.col("n") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("k", "s"))
        .select("id", "label", "n", F.col("s.h").alias("h"), (F.col("n") - F.col("alone") - F.col("k")).alias("rest"))
        .where(F.col("rest") * 100 >= percent * F.col("n"))
    )
    placed = ws.stage(placed, "placed")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    kept = placed.where(F.col("rest") * (100 + percent) >= 2 * percent * F.col("n")).select("h", step.alias("step"), F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    low = F.floor(F.log(F.col("n") * percent / 100) / F.log(F.lit(1.02))) - 1
    asks = placed.select("h", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.explode(F.sequence(low, step)).alias("step"))
    smallest = F.greatest(F.ceil(F.pow(F.lit(1.02), F.col("step")) - F.lit(1e-6)).cast("long"), F.ceil(F.col("n_a") * percent / 100).cast("long"))
    asks = asks.where(F.col("rest_a") * (100 + percent) >= percent * (F.col("n_a") + smallest))
    enough = f"(100 + {percent}) * least(rest_a, rest_b) >= {percent} * (n_a + n_b)"
    return asks.join(kept, ["h", "step"]).where(f"a <> b and label_a <> label_b and n_b <= n_a and {enough}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets are 85 percent alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_components(docs, words=3, percent=85)


#: The same rows by comparing all pairs that share a shingle: for small tables only.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM g),
e AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
m AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON m.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.least, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(c.least, n.doc_id)) AS kept
FROM n LEFT JOIN c ON c.doc_id = n.doc_id
"""
