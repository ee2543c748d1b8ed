"""Settings of the jobs, as flags."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields
from typing import TypeVar


# Names of flags and their defaults.


@dataclass(frozen=True)
class Aggregate:
    """Windowed sums from enriched orders, one output for each record, with changelog, snapshots and manifest. Sinks and sources are independent of one another and checked at the start."""

    group_id: str = "opb"
    instance_id: str = ""
    window_size: int = 300
    snapshot_interval: int = 60
    changelog: bool = True
    changelog_sink: str = "file"
    changelog_path: str = "changelog"
    manifest_sink: str = "file"
    snapshot_dir: str = "snapshots"
    state_dir: str = "checkpoints/aggregate"
    state_backend: str = "rocksdb"
    kafka_bootstrap: str = ""
    topic_prefix: str = "p2"
    topic_enriched: str = "p1.orders.enriched"
    topic_changelog: str = ""
    topic_snapshots: str = ""
    output_topic: str = ""
    output_path: str = "output"
    input_source: str = "sample"
    input_path: str = ""
    http: str = ""
    once: bool = False
    require_validated: bool = False
    tx_batch_size: int = 1000
    tx_linger_ms: int = 100

    def topic(self, name: str) -> str:
        """A topic of its own flag, or else of the prefix."""
        own, rest = {"changelog": (self.topic_changelog, "opb-changelog"), "snapshots": (self.topic_snapshots, "opb-snapshots"), "output": (self.output_topic, "orders.output")}[name]
        return own or f"{self.topic_prefix}.{rest}"


@dataclass(frozen=True)
class Enrich:
    """Enriched orders from raw ones; mode wrapper passes enriched ones on to the output."""

    mode: str = "normalize"
    kafka_bootstrap: str = ""
    topic_orders: str = "p1.orders"
    topic_enriched: str = "p1.orders.enriched"
    output_topic: str = "p2.orders.output"
    input_path: str = ""
    output_path: str = "enriched"
    state_dir: str = "checkpoints/enrich"
    once: bool = False


@dataclass(frozen=True)
class Recover:
    """Periodic recovery with metrics, and the manifest moved on with a new snapshot."""

    kafka_bootstrap: str = ""
    group_id: str = "recover"
    instance_id: str = "R"
    manifest_source: str = "file"
    changelog_source: str = "file"
    topic_snapshots: str = "p2.opb-snapshots"
    topic_changelog: str = "p2.opb-changelog"
    snapshot_dir: str = "snapshots"
    changelog_path: str = "changelog"
    http: str = ""
    poll: int = 10
    rounds: int = 0
    advance_manifest: bool = False
    metrics_path: str = ""


@dataclass(frozen=True)
class Generate:
    """Random enriched orders as JSON lines: count of them, or with a rate so many a second for some seconds."""

    count: int = 100
    output: str = "orders"
    seed: int = 42
    rate: int = 0
    seconds: int = 60


C = TypeVar("C", Aggregate, Enrich, Recover, Generate)
CHOICES = {
    "changelog_source": ("file", "kafka"), "manifest_source": ("file", "kafka"), "changelog_sink": ("file", "kafka", "both"), "manifest_sink": ("file", "kafka", "both"), "state_backend": ("rocksdb", "memory"),
    "input_source": ("sample", "file", "kafka"), "mode": ("normalize", "wrapper"),
}


def parse(kind: type[C], argv: list[str] | None = None) -> C:
    """Flags are the fields' names with dashes; booleans take true or false, or no value for true."""
    parser = argparse.ArgumentParser(description=kind.__doc__)
    for f in fields(kind):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(flag, nargs="?", const=True, default=f.default, type=lambda s: s.lower() in ("1", "true", "yes"))
        else:
            parser.add_argument(flag, default=f.default, type=type(f.default), choices=CHOICES.get(f.name))
    out = kind(**vars(parser.parse_args(argv)))
    return check(out)


def check(config: C) -> C:
    uses_kafka = [f.name for f in fields(config) if getattr(config, f.name) in ("kafka", "both") and f.name in CHOICES]
    if uses_kafka and not config.kafka_bootstrap:
        raise SystemExit(f"--kafka-bootstrap is needed for {', '.join(uses_kafka)}")
    return config
