"""Counters and gauges of streaming queries and recoveries, and their text exposition."""

from __future__ import annotations

import json
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener

#: Names, kinds and bucket bounds of the series.
SERIES = {
    "opb_replay_applied_total": "counter", "opb_replay_skipped_total": "counter", "opb_recovery_ttr_seconds": "gauge", "opb_replay_bytes_total": "counter",
    "opb_changelog_lag": "gauge", "opb_last_manifest_age_seconds": "gauge", "opb_tx_produced_total": "counter", "opb_tx_aborted_total": "counter",
    "opb_tx_latency_seconds": "histogram", "opb_changelog_appended_total": "counter", "opb_partition_lag": "gauge",
}
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Registry:
    """Values by series and labels; safe to use from listeners' threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[str, dict[tuple, float]] = defaultdict(dict)
        self._seen: dict[str, list[float]] = defaultdict(list)

    def add(self, name: str, by: float = 1, **labels: str) -> None:
        with self._lock:
            at = tuple(sorted(labels.items()))
            self._values[name][at] = self._values[name].get(at, 0) + by

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._values[name][tuple(sorted(labels.items()))] = value

    def observe(self, name: str, value: float) -> None:
        with self._lock:
            counts = self._seen[name] or [0.0] * (len(BUCKETS) + 2)
            self._seen[name] = [c + (i >= len(BUCKETS) or value <= BUCKETS[i]) for i, c in enumerate(counts[:-1])] + [counts[-1] + value]

    def get(self, name: str, **labels: str) -> float:
        return self._values.get(name, {}).get(tuple(sorted(labels.items())), 0)

    def text(self) -> str:
        """All series in the text exposition format."""
        lines = []
        with self._lock:
            for name, kind in SERIES.items():
                lines.append(f"# TYPE {name} {kind}")
                for at, value in sorted(self._values.get(name, {}).items()):
                    labels = "{" + ",".join(f"{k}={json.dumps(v)}" for k, v in at) + "}" if at else ""
                    lines.append(f"{name}{labels} {value:g}")
                if seen := self._seen.get(name):
                    lines += [f'{name}_bucket{{le="{b:g}"}} {c:g}' for b, c in zip(BUCKETS, seen)]
                    lines += [f'{name}_bucket{{le="+Inf"}} {seen[-2]:g}', f"{name}_sum {seen[-1]:g}", f"{name}_count {seen[-2]:g}"]
        return "\n".join(lines) + "\n"


def health() -> str:
    return json.dumps({"status": "ok"})


def serve(registry: Registry, address: str) -> ThreadingHTTPServer:
    """Serves /metrics and /healthz at host:port (an empty host: all; port 0: any free one) in a thread; `server_close` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/metrics": ("text/plain; version=0.0.4", registry.text), "/healthz": ("application/json", health)}.get(self.path.split("?")[0])
            kind, body = (found[0], found[1]().encode()) if found else ("text/plain", b"not found\n")
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host, int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def offsets_behind(latest: str | None, end: str | None) -> dict[tuple[str, str], int]:
    """(topic, partition) to records behind, from a source's offsets as JSON; other sources have none."""
    try:
        head, at = json.loads(latest or "{}"), json.loads(end or "{}")
        return {(t, p): max(0, int(o) - int(at.get(t, {}).get(p, 0))) for t, parts in head.items() for p, o in parts.items()}
    except (AttributeError, TypeError, ValueError):
        return {}


class Listener(StreamingQueryListener):
    """Feeds a registry from queries' progress: batches, their latency, lag by partition, observed appends."""

    def __init__(self, registry: Registry, group: str = "", instance: str = "") -> None:
        self.registry, self.group, self.instance = registry, group, instance

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.registry.add("opb_tx_produced_total")
            self.registry.observe("opb_tx_latency_seconds", p.batchDuration / 1000)
        for name, row in (p.observedMetrics or {}).items():
            if name == "changelog":
                self.registry.add("opb_changelog_appended_total", row["appended"])
        for source in p.sources:
            for (topic, partition), lag in offsets_behind(source.latestOffset, source.endOffset).items():
                self.registry.set("opb_partition_lag", lag, topic=topic, partition=partition, group=self.group, instance=self.instance)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.registry.add("opb_tx_aborted_total")


def recovered(registry: Registry, counts, seconds: float, created: int, head: int | None = None, size: int | None = None, now: float | None = None) -> None:
    """What one recovery tells, its counts being those of that run: a later one that reads the same records again doesn't count them twice."""
    registry.set("opb_replay_applied_total", counts["applied"])
    registry.set("opb_replay_skipped_total", counts["skipped"])
    registry.set("opb_replay_bytes_total", size or 0)
    registry.set("opb_recovery_ttr_seconds", seconds)
    registry.set("opb_last_manifest_age_seconds", max(0.0, (now or time.time()) - created))
    if head is not None:
        registry.set("opb_changelog_lag", max(0, head - counts["lastOffset"]))
