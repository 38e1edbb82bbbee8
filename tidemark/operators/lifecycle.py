"""Planning over file metadata: compaction, retirement, garbage. Metadata is small, a row a file;
plans that depend on earlier choices are made on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompactionPolicy:
    jobs: int = 4
    width: int = 8
    growth: int = 2
    target: int = 1 << 30


@dataclass(frozen=True)
class GraphPolicy:
    files: int = 8
    small_total: int = 8 << 20
    output: int = 256 << 20
    finished: int = 256 << 20


def candidates(manifest: DataFrame, tenant_id: str) -> list[dict]:
    """A tenant's active files in order of their coverage, without audit and graph files."""
    files = manifest.where((F.col("tenant_id") == tenant_id) & (F.col("state") == "active") & ~F.col("profile").isin("audit", "graph"))
    return [r.asDict() for r in files.orderBy("epoch", "first_sequence").collect()]


def plan_compaction(manifest: DataFrame, tenant_id: str, policy: CompactionPolicy = CompactionPolicy()) -> list[tuple[list, int]]:
    """(file ids, expected bytes) of the merges to run now.

    A run is small files of one epoch and profile that follow each other without a gap; a file of
    target size ends one. A window of up to ``width`` files of a run merges if its bytes reach ``growth`` times its
    largest file, or the target; otherwise it moves on by one file. At most ``jobs`` merges.
    """
    if policy.width < 2 or policy.jobs < 1:
        return []
    jobs, run = [], []
    for f in [*candidates(manifest, tenant_id), None]:
        small = f is not None and f["size_bytes"] < policy.target
        joins = small and (not run or (run[-1]["epoch"] == f["epoch"] and run[-1]["profile"] == f["profile"] and run[-1]["last_sequence"] + 1 == f["first_sequence"]))
        if joins:
            run.append(f)
            continue
        at = 0
        while len(run) - at >= 2:
            window = run[at : at + policy.width]
            sizes = [w["size_bytes"] for w in window]
            if sum(sizes) >= policy.growth * max(sizes) or sum(sizes) >= policy.target:
                jobs.append(([w["file_id"] for w in window], sum(sizes)))
                if len(jobs) == policy.jobs:
                    return jobs
                at += len(window)
            else:
                at += 1
        run = [f] if small else []
    return jobs


def plan_graph_compaction(manifest: DataFrame, tenant_id: str, policy: GraphPolicy = GraphPolicy()) -> list[tuple[list, int]]:
    """Merges of one subject's adjacent graph files: more than ``files`` of them, or fewer than
    ``small_total`` bytes together, in outputs of up to ``output`` bytes and two files at least."""
    files = manifest.where((F.col("tenant_id") == tenant_id) & (F.col("state") == "active") & (F.col("profile") == "graph") & (F.col("size_bytes") < policy.finished))
    rows = [r.asDict() for r in files.orderBy("subject", "first_sequence").collect()]
    number, keyed = 0, []
    for i, r in enumerate(rows):
        if i and not (rows[i - 1]["subject"] == r["subject"] and rows[i - 1]["last_sequence"] + 1 == r["first_sequence"]):
            number += 1
        keyed.append((number, r))
    jobs = []
    for _, group in groupby(keyed, key=lambda x: x[0]):
        run = [r for _, r in group]
        if len(run) < 2 or (len(run) <= policy.files and sum(r["size_bytes"] for r in run) >= policy.small_total):
            continue
        ids, size = [], 0
        for r in run:
            if ids and size + r["size_bytes"] > policy.output:
                jobs.append((ids, size))
                ids, size = [], 0
            ids, size = [*ids, r["file_id"]], size + r["size_bytes"]
        jobs.append((ids, size))
    return [j for j in jobs if len(j[0]) > 1]


def fold_settled(sidecar: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(embedded, re-emitted): derived rows settled by ``as_of`` go into the merged file."""
    return sidecar.where(F.col("horizon") <= as_of), sidecar.where(F.coalesce(F.col("horizon") > as_of, F.lit(True)))


def should_roll(size_bytes: int, opened_at: int, now: int, target: int = 1 << 30, window: int = 3600 * 10**9) -> bool:
    """A file ends at its target size or its time window, whichever comes first."""
    return size_bytes >= target or now - opened_at >= window


def retirable(manifest: DataFrame, snapshots: DataFrame, now: int) -> DataFrame:
    """Outdated files that may be destroyed: every live snapshot is newer than the generation that
    replaced them, and their horizon has passed."""
    oldest = snapshots.agg(F.min("generation").alias("_oldest"))  # one row
    return manifest.where("state = 'outdated'").crossJoin(oldest).where(F.coalesce(F.col("_oldest") >= F.col("outdated_at_generation"), F.lit(True)) & (F.col("horizon") <= now)).drop("_oldest")


def deletable(manifest: DataFrame, now: int, safety: int) -> DataFrame:
    """Files whose object goes now; their catalogue rows follow only after that."""
    return manifest.where((F.col("state") == "delete_on_destroy") & (F.col("marked_at") + safety <= now))


def inbox_retirable(done: DataFrame, manifest: DataFrame) -> DataFrame:
    """Inbox files that every recipient has acknowledged."""
    return manifest.where("profile = 'inbox' and state = 'active'").join(done.where("done").select("file_id"), "file_id", "left_semi")


def garbage_chunks(chunks: DataFrame, references: DataFrame, now: int, grace: int) -> DataFrame:
    """State chunks that nothing references and whose grace has passed."""
    return chunks.join(references.select("chunk_id"), "chunk_id", "left_anti").where(F.col("written_at") + grace <= now)


def duplicates(df: DataFrame, key: tuple[str, ...] = ("epoch", "sequence")) -> DataFrame:
    """Points that more than one row has: a snapshot must have none."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
