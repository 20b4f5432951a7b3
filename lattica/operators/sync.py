"""Incremental sync of a store with a catalog, and the difference of its snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import Scope
from lattica.operators.normalize import normalize
from lattica.operators.snapshot import delta
from lattica.operators.store import GraphStore, put_over, without_ends
from lattica.plans.cut import discard, staged


@dataclass
class SyncResult:
    changed: bool
    upserted: int = 0
    deleted: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    snapshot: str | None = None


def sync(store: GraphStore, objects: DataFrame, engine: str, fingerprint: str, scope: Scope = Scope(), engine_version: str | None = None, force: bool = False, include_payload: bool = False, keep_stale_edges: bool = False) -> SyncResult:
    """Brings the store to the catalog's state and takes a snapshot; does nothing if the fingerprint is the last one's.

    Only new and changed nodes and edges are written, gone nodes deleted with their edges. Edges that the catalog no longer
    gives go, so none outlives its reason; keep_stale_edges adds the fresh ones to the old instead, and only if a node changed. Nodes, edges,
    snapshot and manifest become visible by one commit, so a sync that dies leaves the store as it was.
    """
    last = store.last_snapshot()
    if last is not None and last.fingerprint == fingerprint and not force:
        return SyncResult(False, snapshot=last.id)
    graph = normalize(objects, engine, scope)
    gone, fresh = delta(store.nodes, graph.nodes, include_payload)
    gone, fresh = staged(gone), staged(fresh)
    upserted, deleted = fresh.count(), gone.count()
    edges = graph.edges
    if keep_stale_edges:
        kept = without_ends(store.edges, gone)
        edges = put_over(kept, graph.edges) if upserted else kept
    ident = store.advance(fresh, gone, edges, engine, engine_version, fingerprint, include_payload)
    discard(gone, fresh)
    counts = {r.kind: r.n for r in store.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return SyncResult(True, upserted, deleted, counts, ident)


def diff_last(store: GraphStore) -> tuple[str, DataFrame | None]:
    """The state (ok, too_few, no_manifest) and the difference of the two newest snapshots."""
    two = store.read("snapshots").orderBy(F.desc("seq")).limit(2).collect()
    if len(two) < 2:
        return "too_few", None
    found = store.difference(two[1].id, two[0].id)
    return ("no_manifest", None) if found is None else ("ok", found)


def drift(store: GraphStore, fingerprint: str) -> bool:
    """The catalog isn't what the newest snapshot saw."""
    last = store.last_snapshot()
    return last is None or last.fingerprint != fingerprint
