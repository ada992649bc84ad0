"""Runs of related queries with a manifest, and their validation.

A lab writes each of its queries as a table and a manifest in canonical JSON: the contract's version, settings, and of each table rows and a
fingerprint that no order changes. Times stand beside the manifest, outside the fingerprint. Validation makes every table anew and
compares all rows, so that a changed file, a changed setting or another result is an error.
"""

from __future__ import annotations

import hashlib
import json
import platform
import shutil
import sys
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import settings
from corpusloom.session import scope
from corpusloom.sources import files

VERSION = 1
#: What each lab consists of; a lab needs the manifests of those named after "upstream".
LABS = {
    "dataset": ("normalize_text", "exact_dedup", "exact_dedup_stats", "token_offsets", "packing_metrics", "sequence_contract_check"),
    "quality": ("near_dup_pairs_ref", "contamination_pairs_ref", "dedup_confusion_ref", "quality_decision_ref", "reason_counts_ref", "quality_metrics_ref"),
    "version": ("mix_quota", "mix_shortage", "mix_select", "sequence_lineage", "shard_stats", "dataset_version_metrics", "shard_roundtrip"),
    "compute": ("domain_agg", "domain_agg_equiv", "partition_distribution", "skew_improvement", "partition_files", "task_recovery_summary"),
    "feed": ("feed_integrity", "worker_shard_assign"),
    "recovery": ("batch_schedule", "resume_equivalence", "parallelism_contract"),
    "storage": ("seq_scan_bytes", "random_sample_read", "line_offset_index"),
    "comparison": ("ab_compare", "ab_controls", "token_weighted_loss", "ab_seed_aggregate"),
    "graduation": ("policy_diff_ref", "ab_sequence_delta", "failure_topk", "ab_one_sided"),
}
UPSTREAM = {"graduation": ("quality", "comparison")}


def canonical(value: object) -> bytes:
    """JSON with sorted names, as it is stored and hashed."""
    return (json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True) + "\n").encode()


def state_hash(value: object) -> str:
    """SHA-256 of nested settings, lists and arrays: kinds and names count, the order of names doesn't."""
    h = hashlib.sha256()

    def add(x: object) -> None:
        if isinstance(x, dict):
            h.update(b"{%d" % len(x))
            for k in sorted(x, key=repr):
                add(k)
                add(x[k])
        elif isinstance(x, list | tuple):
            h.update(b"[%d" % len(x))
            for y in x:
                add(y)
        elif hasattr(x, "tobytes") and hasattr(x, "dtype"):
            h.update(f"a{x.dtype}{x.shape}".encode() + x.tobytes())
        else:
            h.update(f"{type(x).__name__}:{x!r};".encode())

    add(value)
    return h.hexdigest()


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of a table's content, whatever its order: row hashes are added up in parallel."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns)))), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    n, *sums = df.agg(F.count("*"), *(part(i) for i in range(8))).first()
    return n, hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest()


def _settings() -> dict:
    own = {"reference_audit": asdict(settings.REFERENCE)} | {x.__name__.lower(): asdict(x()) for x in (settings.Audit, settings.Version, settings.Compute, settings.Feed, settings.Storage, settings.Comparison)}
    return json.loads(canonical(own))


def load(out: str, lab: str) -> dict:
    path = f"{out}/{lab}/manifest.json"
    if not files.exists(path):
        raise FileNotFoundError(path)
    found = json.loads(files.read_bytes(path))
    if found.get("version") != VERSION:
        raise ValueError(f"{path}: version {found.get('version')} isn't supported")
    body = {k: v for k, v in found.items() if k != "fingerprint"}
    if found.get("fingerprint") != hashlib.sha256(canonical(body)).hexdigest():
        raise ValueError(f"{path}: its fingerprint doesn't match")
    return found


def run(spark: SparkSession, queries: dict[str, Callable], lab: str, d: str, out: str) -> dict:
    """Writes the lab's tables, its manifest, a card and the times; what was there before is replaced."""
    upstream = {x: load(out, x)["fingerprint"] for x in UPSTREAM.get(lab, ())}
    tables, seconds = {}, {}
    for name in LABS[lab]:
        began = time.perf_counter()
        with scope(spark):
            files.write_parquet(queries[name](spark, d), f"{out}/{lab}/{name}")
        n, digest = fingerprint(spark.read.parquet(f"{out}/{lab}/{name}"))
        tables[name], seconds[name] = {"rows": n, "content": digest}, round(time.perf_counter() - began, 3)
    body = {"version": VERSION, "lab": lab, "settings": _settings(), "tables": tables, "upstream": upstream}
    manifest = body | {"fingerprint": hashlib.sha256(canonical(body)).hexdigest()}
    files.write_bytes(f"{out}/{lab}/manifest.json", canonical(manifest))
    files.write_bytes(f"{out}/{lab}/observations.json", canonical({"seconds": seconds, "environment": environment()}))
    files.write_bytes(f"{out}/{lab}/card.md", card(spark, out, manifest).encode())
    return manifest


def validate(spark: SparkSession, queries: dict[str, Callable], lab: str, d: str, out: str) -> dict:
    """The stored manifest, or an error: version, fingerprint, settings, upstream manifests, and every row of every table made anew."""
    found = load(out, lab)
    if found["settings"] != _settings():
        raise ValueError(f"{lab}: made with other settings")
    for name, digest in found["upstream"].items():
        if load(out, name)["fingerprint"] != digest:
            raise ValueError(f"{lab}: {name} has changed since")
    for name, table in found["tables"].items():
        stored = spark.read.parquet(f"{out}/{lab}/{name}")
        if fingerprint(stored) != (table["rows"], table["content"]):
            raise ValueError(f"{lab}: the table {name} isn't the one of the manifest")
        with scope(spark):
            if fingerprint(queries[name](spark, d)) != (table["rows"], table["content"]):
                raise ValueError(f"{lab}: {name} has another result now")
    return found


def card(spark: SparkSession, out: str, manifest: dict, shown: int = 20) -> str:
    """A page about a lab: its tables, and the rows of those that have a few."""
    lines = [f"# {manifest['lab']}", "", f"Fingerprint `{manifest['fingerprint']}`", "", "| table | rows | content |", "|-|-|-|"]
    lines += [f"| {k} | {v['rows']} | `{v['content'][:16]}` |" for k, v in manifest["tables"].items()]
    for name, table in manifest["tables"].items():
        if table["rows"] <= shown:
            df = spark.read.parquet(f"{out}/{manifest['lab']}/{name}")
            rows = sorted(df.collect(), key=str)  # shown at most
            lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def environment() -> dict:
    """What this machine has, without names of users, hosts or folders."""
    import pyspark

    tools = {x: shutil.which(x) is not None for x in ("java", "git", "docker", "cmake")}
    return {"python": platform.python_version(), "system": platform.system(), "machine": platform.machine(), "spark": pyspark.__version__, "tools": tools, "implementation": sys.implementation.name}
