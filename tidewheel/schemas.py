"""Record schemas, version 1."""

from __future__ import annotations

ORDER = "orderId string, productId string, price bigint, qty bigint, storeId string, ts bigint"
ENRICHED = f"{ORDER}, validated boolean, normTs bigint"
OUTPUT = "key string, sumAmount bigint, sumQty bigint, windowStart bigint, storeId string, productId string, updatedAt bigint"
DELTA = "key string, seq bigint, delta bigint, deltaQty bigint, ts bigint"
STATE = "key string, SumAmount bigint, SumQty bigint, LastSeq bigint"
SNAPSHOT = "map<string, struct<SumAmount: bigint, SumQty: bigint, LastSeq: bigint>>"
MANIFEST = "snapshotId string, lastChangelogOffset bigint, createdAt bigint"

#: The key of the manifest's record, the default topics and the default window in seconds.
MANIFEST_KEY = "opb-manifest-latest"
TOPICS = {"orders": "p1.orders", "enriched": "p1.orders.enriched", "output": "p2.orders.output", "changelog": "p2.opb-changelog", "snapshots": "p2.opb-snapshots"}
DEFAULT_WINDOW = 300
