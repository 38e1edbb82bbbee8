"""Corrections: chains of amendments, replacements and retractions, and views of what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

AMENDMENT, REPLACEMENT, RETRACTION = "amendment", "replacement", "retraction"


def newest_corrections(corrections: DataFrame) -> DataFrame:
    """The newest correction of each corrected event: the last point, then the highest generation."""
    order = Window.partitionBy("corrects_event_id").orderBy(F.col("correction_epoch").desc(), F.col("correction_sequence").desc(), F.col("correction_generation").desc())
    return corrections.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("corrects_event_id", "correction_epoch", "correction_sequence", "correction_type")


def merged_payload(base: Column, amendments: Column) -> Column:
    """Amendments (variants) laid over a base in order: fields of an object replace the base's and
    the rest stay; any other value replaces the whole payload; null changes nothing."""
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def lay(old: Column, new: Column) -> Column:
        changed = as_map(new)
        kept = F.map_filter(as_map(old), lambda k, v: ~F.array_contains(F.map_keys(changed), k))
        both = F.to_variant_object(F.map_concat(kept, changed))
        return F.when(new.isNull(), old).when(is_object(old) & is_object(new), both).otherwise(new)

    return F.aggregate(amendments, base, lay)


def latest_versions(events: DataFrame, corrections: DataFrame, located: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """``events`` as their correction chains leave them, in the columns of ``events``.

    Each event follows its newest correction, hop by hop. A retraction anywhere drops it. An
    amendment is laid over the base; a replacement replaces the last amendment while amendments
    are pending, the base otherwise. A row whose payload is served must not be deleted, or the
    event is dropped. Correction rows among ``events`` don't stand for themselves. A chain that
    comes back to an event of its own raises an error. ``located`` holds the correction rows by
    (epoch, sequence). Chains may be of any length; hops end when no chain goes on.

    payload is JSON text or a variant and comes back as it was.
    """
    text = dict(events.dtypes)["payload"] == "string"
    variant = F.try_parse_json("payload") if text else F.col("payload")
    newest = newest_corrections(corrections)
    places = newest.select(F.col("correction_epoch").alias("epoch"), F.col("correction_sequence").alias("sequence"))
    mark = F.struct(*[F.col(c) for c in ("file_id", "row_ordinal") if c in events.columns] or [F.col("epoch"), F.col("sequence")])
    columns = [c for c in events.columns if c != "payload"]
    steps = newest.join(located.select("epoch", "sequence", F.struct(*[F.col(c) for c in columns]).alias("_next"), F.col("event_id").alias("_next_id"), variant.alias("_next_payload"), mark.alias("_next_row")), (F.col("correction_epoch") == F.col("epoch")) & (F.col("correction_sequence") == F.col("sequence")), "left").drop("epoch", "sequence")
    steps = written(steps, "steps")  # read by every hop; a row for each correction, not for each event
    first = events.join(places, ["epoch", "sequence"], "left_anti")
    # most events have no correction: they pass as they are, and only the others are followed
    targets = newest.select(F.col("corrects_event_id").alias("event_id"))
    plain = first.join(targets, "event_id", "left_anti")
    plain = plain if deletes is None or "file_id" not in events.columns else plain.join(deletes.select("file_id", "row_ordinal"), ["file_id", "row_ordinal"], "left_anti")
    open_ = first.join(targets, "event_id", "left_semi").select(
        F.struct(*[F.col(c) for c in columns]).alias("_row"), F.col("event_id").alias("_current"), variant.alias("_base"), F.array().cast("array<variant>").alias("_amendments"), F.array(mark).alias("_served"), F.array("event_id").alias("_path")
    )
    done = None
    while True:
        joined = open_.join(steps, F.col("_current") == F.col("corrects_event_id"), "left")
        ended = joined.where("corrects_event_id is null").select(*open_.columns)
        done = ended if done is None else done.unionByName(ended)
        on = joined.where(F.col("corrects_event_id").isNotNull() & (F.col("correction_type") != RETRACTION))
        lost = F.when(F.col("_next_id").isNull(), F.raise_error(F.lit("a correction names a row that is not there")).cast("boolean")).when(
            F.array_contains("_path", F.col("_next_id")), F.raise_error(F.lit("a correction chain comes back to its own event")).cast("boolean")
        ).otherwise(True)
        on = on.where(lost)
        amends, pending = F.col("correction_type") == AMENDMENT, F.size("_amendments") > 0
        short = lambda c: F.slice(c, 1, F.size(c) - 1)
        open_ = on.select(
            F.when(amends | pending, F.col("_row")).otherwise(F.col("_next")).alias("_row"),
            F.col("_next_id").alias("_current"),
            F.when(amends | pending, F.col("_base")).otherwise(F.col("_next_payload")).alias("_base"),
            F.when(amends, F.concat("_amendments", F.array("_next_payload"))).when(pending, F.concat(short("_amendments"), F.array("_next_payload"))).otherwise(F.col("_amendments")).alias("_amendments"),
            F.when(amends, F.concat("_served", F.array("_next_row"))).when(pending, F.concat(short("_served"), F.array("_next_row"))).otherwise(F.array("_next_row")).alias("_served"),
            F.concat("_path", F.array("_next_id")).alias("_path"),
        )
        open_ = written(open_, "hops")
        if open_.isEmpty():
            break
    if deletes is not None and "file_id" in events.columns:
        gone = deletes.select(F.struct("file_id", "row_ordinal").alias("_mark"), F.lit(True).alias("_gone")).distinct()
        ids = done.select(F.col("_path")[0].alias("_id"), F.explode("_served").alias("_mark")).join(gone, "_mark").select("_id").distinct()
        done = done.withColumn("_id", F.col("_path")[0]).join(ids, "_id", "left_anti").drop("_id")
    payload = merged_payload(F.col("_base"), F.col("_amendments"))
    payload = F.when(F.size("_amendments") == 0, F.col("_base")).otherwise(payload)
    followed = done.select("_row.*", (F.to_json(payload) if text else payload).alias("payload")).select(*events.columns)
    plain = plain.withColumn("payload", F.to_json(F.try_parse_json("payload"))) if text else plain
    return plain.select(*events.columns).unionByName(followed)


def superseded(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """The rows whose events a correction replaces or retracts: the latest-corrected view leaves them out."""
    return events.join(corrections.select(F.col("corrects_event_id").alias("event_id")), "event_id", "left_semi")


def raw_history(events: DataFrame) -> DataFrame:
    """Originals and corrections, each at its own place."""
    return events.orderBy("epoch", "sequence")


def derived_values(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """event_id, state, value of a derived column. ``ledger`` (event_id, at, action, value) has
    'invalidate' and 'publish' entries; after an invalidation the value is pending, and null, until
    it is published again."""
    last = ledger.groupBy("event_id").agg(F.max_by(F.struct("action", "value"), "at").alias("l"))
    pending = F.col("l.action") == "invalidate"
    return events.select("event_id").join(last, "event_id", "left").select("event_id", F.when(pending, "pending").when(F.col("l").isNotNull(), "published").alias("state"), F.when(~pending, F.col("l.value")).alias("value"))


def invalidation(events: DataFrame, corrected: DataFrame, neighbours: int, by: str = "entity_id") -> DataFrame:
    """The corrected events and their nearest neighbours of the same entity on both sides."""
    w = Window.partitionBy(by).orderBy("epoch", "sequence")
    marked = events.join(corrected.select("event_id", F.lit(1).alias("_hit")).distinct(), "event_id", "left")
    near = F.max("_hit").over(w.rowsBetween(-neighbours, neighbours))
    return marked.withColumn("_near", near).where("_near = 1").select("event_id")


#: Dispositions from least to most protective.
DISPOSITIONS = ["retain", "restrict_suppress", "physical_destruction", "crypto_shred"]


def resolved_disposition(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """disposition, carve_out per group of conflicting jurisdictions: the first retention carve-out
    by ``order`` wins, otherwise the most protective disposition (the last of equals)."""
    rank = F.array_position(F.array(*map(F.lit, DISPOSITIONS)), F.col("disposition"))
    first = F.min(F.when(F.col("carve_out"), F.struct(order, "disposition"))).alias("c")
    most = F.max(F.struct(rank.alias("rank"), F.col(order), F.col("disposition"))).alias("m")
    return df.groupBy(*by).agg(first, most).select(*by, F.coalesce("c.disposition", "m.disposition").alias("disposition"), F.col("c").isNotNull().alias("carve_out"))
