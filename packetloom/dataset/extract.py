"""Extraction: flows and cohort of the target chunk, then the kept packets of each chunk of the day.

Each capture is parsed once, by a Spark task that streams it; routing and retention are joins. A chunk is staged, checked
and published by a rename; a failed chunk leaves the others alone, and a later run does what is missing.
"""

from __future__ import annotations

import shutil
import tempfile
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import TCP
from ..operators.cohort import COHORT_COLUMNS, checked_counts, select_cohort
from ..operators.flows import FLOW_COLUMNS, flow_table
from ..operators.routing import retain_source_context, route_to_targets
from ..plans.calendar import checked_chunk, checked_day, chunk_ids
from ..sources import capture
from . import store
from .acquire import CacheError, RawSource, Spool, download
from .files import artifact, publish, read_json, with_keys, write_json
from .identity import cohort_identity


class IncompleteExtraction(RuntimeError):
    """Some chunks failed; what is done stays."""


@dataclass(frozen=True)
class ExtractOptions:
    day: str
    target_chunk: str
    packet_counts: tuple[int, ...]
    workers: int
    dataset_root: Path
    spool_root: Path

    def __post_init__(self) -> None:
        object.__setattr__(self, "day", checked_day(self.day))
        checked_chunk(self.day, self.target_chunk)
        object.__setattr__(self, "packet_counts", checked_counts(self.packet_counts))
        if type(self.workers) is not int or self.workers < 1:
            raise ValueError("workers must be a positive integer")
        for name in ("dataset_root", "spool_root"):
            object.__setattr__(self, name, Path(getattr(self, name)))


def _skips(packets: DataFrame) -> dict[str, int]:
    return {r.skip_reason: r.n for r in capture.skip_counts(packets).orderBy("skip_reason").collect()}  # one row for each reason


def _staging(root: Path, kind: str) -> Path:
    root.mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix=f".{kind}-", dir=root))


def _parsed(spark: SparkSession, path: Path, into: Path) -> DataFrame:
    """Packets of a capture as a table, so that the capture is parsed once."""
    capture.read(spark, str(path)).write.parquet(str(into))
    return spark.read.parquet(str(into))


def extract_target(spark: SparkSession, options: ExtractOptions, path: Path, source: RawSource) -> None:
    """Publish flows and cohort of the target chunk."""
    root = options.dataset_root
    staging = _staging(root, "target")
    try:
        packets = _parsed(spark, path, staging / "packets")
        for folder in ("provenance", "cohort"):
            (staging / folder).mkdir()
        store.write_csv(flow_table(capture.decoded(packets)), staging / store.FLOWS, "flow_id")
        flows = store.read_csv(spark, staging / store.FLOWS, FLOW_COLUMNS)
        store.write_csv(select_cohort(flows, options.packet_counts).select(*COHORT_COLUMNS), staging / store.COHORT, "target_flow_id")
        cohort = store.read_csv(spark, staging / store.COHORT, COHORT_COLUMNS)
        common = {"status": "success", "target_chunk": options.target_chunk, "source": source.asdict(), "tool": store.TOOL}
        flow_manifest = common | {
            "manifest_schema_version": store.VERSIONS["flow"],
            "flow_definition": store.FLOW_DEFINITION,
            "artifact": artifact(root, store.FLOWS, flows.count(), "flows-v1", staging / store.FLOWS),
            "skipped_packet_counts": _skips(packets),
        }
        cohort_manifest = common | {
            "manifest_schema_version": store.VERSIONS["cohort"],
            "packet_counts": list(options.packet_counts),
            "context_source_policy": store.SOURCE_POLICY,
            "cohort_identity": cohort_identity(store.keyed_cohort(cohort)),
            "artifact": artifact(root, store.COHORT, cohort.count(), "cohort-v1", staging / store.COHORT),
        }
        write_json(staging / store.FLOW_MANIFEST, flow_manifest)
        write_json(staging / store.COHORT_MANIFEST, cohort_manifest)
        publish(staging / "provenance", root / "provenance")
        try:
            publish(staging / "cohort", root / "cohort")
        except BaseException:
            shutil.rmtree(root / "provenance")  # ours; one without the other is no provenance
            raise
    finally:
        shutil.rmtree(staging)


def observations(packets: DataFrame, cohort: DataFrame, rows: int) -> dict[str, DataFrame]:
    """The two tables that are kept of decoded packets."""

    def table(df: DataFrame, name: str) -> DataFrame:
        flags = F.when(F.col("protocol") == TCP, F.col("tcp_flags"))
        out = df.withColumn("tcp_flags_raw", flags)
        return out.select(*[F.col(f.name).cast(f.dataType) for f in store.SCHEMAS[name].fields])

    return {
        "target_packets": table(route_to_targets(packets, cohort, rows), "target_packets"),
        "source_context_packets": table(retain_source_context(packets, cohort, rows), "source_context_packets"),
    }


def extract_chunk(spark: SparkSession, path: Path, found: store.Provenance, root: Path, chunk: str, source: RawSource) -> dict[str, Any]:
    """Publish a chunk's kept packets; gives its manifest. A valid chunk that is there is used as it is."""
    destination = store.chunk_folder(root, chunk)
    if destination.exists():
        return store.check_chunk(spark, root, chunk, found.identity, source)
    staging = _staging(root / "observations", "chunk")
    try:
        packets = _parsed(spark, path, staging / "packets")
        ready = staging / chunk
        ready.mkdir()
        records = {}
        for name, table in observations(capture.decoded(packets), found.cohort, found.rows).items():
            at = ready / f"{name}.parquet"
            table.write.parquet(str(at))
            records[name] = artifact(root, f"observations/{chunk}/{name}.parquet", spark.read.parquet(str(at)).count(), store.TABLES[name], at)
        manifest = {
            "manifest_schema_version": store.VERSIONS["chunk"],
            "status": "success",
            "chunk_id": chunk,
            "cohort_identity": found.identity,
            "source": source.asdict(),
            "artifacts": records,
            "skipped_packet_counts": _skips(packets),
        }
        write_json(ready / "manifest.json", manifest)
        store.check_chunk(spark, root, chunk, found.identity, source, ready)
        store.audit_rows(spark, root, {chunk: manifest}, ready)
        publish(ready, destination)
    finally:
        shutil.rmtree(staging)
    try:
        return store.check_chunk(spark, root, chunk, found.identity, source)
    except BaseException:
        shutil.rmtree(destination)  # ours, and not what was staged
        raise


def _previous(options: ExtractOptions) -> dict[str, dict[str, Any]]:
    """States of the chunks by an earlier run with the same options; all pending without one."""
    ids = chunk_ids(options.day)
    path = options.dataset_root / "dataset_manifest.json"
    if not path.exists():
        return {c: {"status": "pending"} for c in ids}
    dm = store.conform(read_json(path), "dataset", expected_chunk_ids=[*ids])
    if (dm["day"], dm["target_chunk"], dm["packet_counts"]) != (options.day, options.target_chunk, list(options.packet_counts)):
        raise ValueError("the dataset was begun with other options")
    return {c: store.checked_state(c, state) for c, state in with_keys(dm["chunks"], {*ids}, "chunk states").items()}


class Slots:
    """Raw captures that may lie in the spool at once: those at work, and those that failed chunks leave."""

    def __init__(self, most: int):
        self.most, self.used, self.left = most, 0, 0
        self.change = threading.Condition()

    def take(self) -> bool:
        """Wait for a slot; False when failed chunks hold all of them."""
        with self.change:
            self.change.wait_for(lambda: self.used + self.left < self.most or self.left >= self.most)
            free = self.used + self.left < self.most
            self.used += free
            return free

    def give(self, keeps_raw: bool) -> None:
        with self.change:
            self.used -= 1
            self.left += keeps_raw
            self.change.notify_all()


def _category(error: Exception, phase: str) -> str:
    return "cache" if isinstance(error, CacheError) else phase


@dataclass
class _Chunk:
    """One chunk's way: reuse what is published, or acquire and extract. `source` is what is known when it fails."""

    spark: SparkSession
    found: store.Provenance
    root: Path
    spool: Spool
    name: str
    url: str
    before: dict[str, Any]
    source: RawSource | None = None
    phase: str = "extraction"

    def reuse(self) -> None:
        self.source = RawSource.of(store.check_chunk(self.spark, self.root, self.name, self.found.identity)["source"])
        recorded = self.before.get("source", self.source.asdict())
        if self.source.source_url != self.url or recorded != self.source.asdict():
            raise ValueError("the published chunk is of another capture than this run's or the recorded one")

    def make(self, target: bool) -> None:
        self.phase = "acquisition"
        self.source = download(self.name, self.url, self.spool)  # proves the bytes of one that is there
        self.phase = "extraction"
        if target and self.source != self.found.source:
            raise ValueError("the target's capture is not the one that its flows were taken from")
        extract_chunk(self.spark, self.spool.raw(self.name), self.found, self.root, self.name, self.source)

    def state(self, target: bool, keep_raw: bool) -> dict[str, Any]:
        try:
            if (self.root / "observations" / self.name).exists():
                self.reuse()
            else:
                self.make(target)
            if not keep_raw and self.spool.raw(self.name).exists():
                self.phase = "cache"
                self.spool.discard(self.source)
        except Exception as error:  # of this chunk only; the text of an error may hold anything, its type does not
            known = {} if self.source is None else {"source": self.source.asdict()}
            return {"status": "failed", "error": f"{_category(error, self.phase)}: {type(error).__name__}"} | known
        return {"status": "success", "source": self.source.asdict(), "manifest": store.manifest_path(self.name)}


def run(spark: SparkSession, options: ExtractOptions, resolve: Callable[[str, str], str], keep_raw: bool = False) -> Path:
    """Extract a day, or what an earlier run left. `resolve` gives a chunk's URL (file: URLs work too).

    At most workers + 2 raw captures are in the spool, unless they are to be kept: when failed chunks have left so many, the
    chunks that remain stay pending.
    """
    root, spool, ids = options.dataset_root, Spool(options.spool_root), chunk_ids(options.day)
    chunks = _previous(options)
    url = lambda c: resolve(options.day, c)
    if not (root / "provenance").exists():
        source = download(options.target_chunk, url(options.target_chunk), spool)
        extract_target(spark, options, spool.raw(options.target_chunk), source)
    found = store.load_provenance(spark, root, options.target_chunk)
    if found.counts != options.packet_counts:
        raise ValueError("the cohort is of other packet counts")
    lock, slots = threading.Lock(), Slots(len(ids) if keep_raw else options.workers + 2)

    def save(status: str) -> None:
        free = {
            "status": status, "day": options.day, "target_chunk": options.target_chunk, "packet_counts": list(options.packet_counts),
            "cohort_identity": found.identity, "expected_chunk_ids": list(ids), "chunks": chunks,
        }
        write_json(root / "dataset_manifest.json", store.FIXED["dataset"] | free)

    def one(name: str) -> None:
        if not slots.take():
            return
        state = _Chunk(spark, found, root, spool, name, url(name), chunks[name]).state(name == options.target_chunk, keep_raw)
        slots.give(state["status"] == "failed" and spool.raw(name).exists())
        with lock:
            chunks[name] = state
            save("incomplete")

    save("incomplete")
    with ThreadPoolExecutor(options.workers) as pool:
        for done in as_completed([pool.submit(one, c) for c in ids]):
            done.result()
    unfinished = [c for c in ids if chunks[c]["status"] != "success"]
    save("incomplete" if unfinished else "success")
    if unfinished:
        failed = [c for c in unfinished if chunks[c]["status"] == "failed"]
        raise IncompleteExtraction(f"{len(failed)} of {len(ids)} chunks failed, {len(unfinished) - len(failed)} are pending: {', '.join(failed[:5])}")
    return root
