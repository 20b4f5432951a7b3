"""The eight questions that can be asked of a stored graph, and a small command line around them."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import IntEnum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import stable_json
from lattica.model import DEFAULT_LEVELS, GraphError, Scope, UnsupportedError
from lattica.operators import graph, search as text_search
from lattica.operators.precheck import precheck
from lattica.operators.snapshot import status as snapshot_status
from lattica.operators.store import GraphStore
from lattica.operators.sync import diff_last, drift, sync
from lattica.plans import present, viewer
from lattica.sources import catalog, families, mapping


class Exit(IntEnum):
    """How a command ends: a request, configuration or source that fails is USAGE."""

    OK = 0
    NOTHING_FOUND = 1
    USAGE = 2
    DENIED = 3
    UNSUPPORTED = 4


@dataclass(frozen=True)
class Source:
    """Where a catalog comes from. A password is only ever read from an environment variable, by name."""

    dialect: str
    location: str
    password_env: str | None = None
    user: str | None = None
    database: str | None = None
    scope: Scope = field(default_factory=Scope)

    def properties(self) -> dict[str, str]:
        out = {} if self.user is None else {"user": self.user}
        if self.password_env is not None:
            if self.password_env not in os.environ:
                raise GraphError(f"environment variable {self.password_env} is not set")
            out["password"] = os.environ[self.password_env]
        return out


def parse_source(config: Mapping[str, Any]) -> Source:
    """A source from a configuration; unknown keys and plain passwords are refused."""
    known = {"dialect", "location", "passwordEnv", "user", "database", "levels", "exclude", "include", "inferRelationships"}
    if extra := set(config) - known:
        raise GraphError(f"unknown configuration keys: {', '.join(sorted(extra))}")
    if config.get("dialect") not in ("sqlite", "mssql", "pg", "mysql", "json"):
        raise UnsupportedError(f"unknown dialect: {config.get('dialect')}")
    bad = {k: v for k, v in (config.get("levels") or {}).items() if k not in DEFAULT_LEVELS or v not in ("off", "metadata", "full")}
    if bad:
        raise GraphError(f"unknown levels: {bad}")
    scope = Scope(dict(config.get("levels") or {}), tuple(config.get("exclude") or ()), tuple(config.get("include") or ()), bool(config.get("inferRelationships", False)))
    return Source(config["dialect"], config["location"], config.get("passwordEnv"), config.get("user"), config.get("database"), scope)


def extract(spark: SparkSession, source: Source) -> tuple[str, DataFrame, str]:
    """Engine, raw objects and fingerprint of a source."""
    if source.dialect == "json":
        engine, objects = catalog.read_raw_catalog(spark, source.location)
        mark = objects.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))).cast("string")), 256)).first()[0]
        return engine, objects, mark
    if source.dialect == "sqlite":
        found = catalog.read_sqlite(spark, source.location)
        mark = found["schema_version"].select(F.sha2(F.col("version").cast("string"), 256)).first()[0]
        return "sqlite", mapping.map_sqlite(found, source.scope), mark
    queries = {"mssql": families.MSSQL_QUERIES, "pg": families.PG_QUERIES}.get(source.dialect) or families.mysql_queries(source.database or "")
    found = catalog.read_jdbc(spark, source.location, queries, source.properties())
    value = catalog.read_jdbc(spark, source.location, {"mark": families.FINGERPRINTS[source.dialect]}, source.properties())["mark"]
    objects = {"mssql": mapping.map_mssql, "pg": mapping.map_pg, "mysql": mapping.map_mysql}[source.dialect](found, source.scope)
    return source.dialect, objects, value.select(F.sha2(F.col("value").cast("string"), 256)).first()[0]


class GraphApi:
    """Questions of a stored graph. Each answers with text; what it collects is one answer's rows."""

    def __init__(self, store: GraphStore) -> None:
        self.store = store

    def resolve(self, qname: str, prefer_real: bool = False) -> tuple[dict[str, Any], list[str]]:
        names = self.store.spark.createDataFrame([(qname.strip(),)], "name STRING")
        row = graph.resolve_names(self.store.nodes, names, prefer_real).first()
        if row is None:
            raise GraphError(f'no object named "{qname}" in the graph')
        return self.store.node(row.id).first().asDict(True), list(row.others)

    def _names(self, ids: Sequence[str]) -> dict[str, str]:
        want = self.store.spark.createDataFrame([(i,) for i in set(ids)], "id STRING")
        return {r.id: r.qname for r in self.store.nodes.join(want, "id").select("id", "qname").collect()}

    def groups(self, node_id: str) -> present.Groups:
        near = graph.neighbors(self.store.nodes, self.store.edges, node_id).select("edge_kind", "direction", "edge_id", F.col("id").alias("other"))
        rows = near.join(self.store.nodes, near.other == F.col("id")).join(self.store.edges.select(F.col("id").alias("edge_id"), "confidence", "score", "attrs"), "edge_id")
        out: present.Groups = {}
        for r in sorted((r.asDict(True) for r in rows.collect()), key=lambda r: (present.locale_key(r["qname"]), r["id"], r["edge_id"])):
            out.setdefault(r["edge_kind"], {}).setdefault(r["direction"], []).append(present.Near(r, {k: r[k] for k in ("confidence", "score", "attrs")}))
        return out

    def data(self, command: str, *args: str) -> dict[str, Any]:
        """What a command answers, as plain values in a fixed order; stable_json() makes the same bytes of it each time."""
        return getattr(self, f"_{command}_data")(*args)

    def _node_data(self, qname: str) -> dict[str, Any]:
        node, others = self.resolve(qname, prefer_real=True)
        near = [{"kind": kind, "direction": way, "qname": e.node["qname"], "nodeKind": e.node["kind"], "confidence": e.edge["confidence"]} for kind, ways in sorted(self.groups(node["id"]).items()) for way, entries in sorted(ways.items()) for e in entries]
        return {"node": node, "alsoKinds": others, "neighbors": near}

    _explore_data = _object_data = _related_data = _node_data

    def _impact_data(self, qname: str) -> dict[str, Any]:
        node, _ = self.resolve(qname)
        ids = self.store.spark.createDataFrame([(node["id"],)], "id STRING")
        found = graph.impact(self.store.nodes, self.store.edges, ids)
        chains = sorted((r.asDict() for r in found.chains.collect()), key=lambda c: (c["depth"], c["nodes"][:-1], c["node"]))
        degraded = [r.id for r in found.degraded.collect()]
        names = self._names([i for c in chains for i in c["nodes"]] + degraded + [node["id"]])
        return {"qname": node["qname"], "chains": [{"access": c["access"], "nodes": [names.get(i, i) for i in c["nodes"]], "kinds": c["kinds"]} for c in chains], "truncated": not found.truncated.isEmpty(), "degraded": sorted(names.get(i, i) for i in degraded)}

    def _path_data(self, start: str, end: str) -> dict[str, Any]:
        (a, _), (b, _) = self.resolve(start), self.resolve(end)
        found = graph.join_path(self.store.nodes, self.store.edges, a["id"], b["id"])
        names = self._names([a["id"], b["id"], *(i for h in found.hops for i in h[:2]), *found.from_neighbors, *found.to_neighbors])
        hops = [{"from": names[x], "to": names[y], "columns": [{"from": u, "to": v} for u, v in cols]} for x, y, cols in found.hops]
        return {"found": found.found, "hops": hops, "fromNeighbors": sorted(names[i] for i in found.from_neighbors), "toNeighbors": sorted(names[i] for i in found.to_neighbors)}

    def _precheck_data(self, ddl: str) -> dict[str, Any]:
        p = precheck(self.store.nodes, self.store.edges, ddl)
        return {"matched": [r.asDict() for r in p.matched.collect()], "affected": [r.asDict() for r in p.affected.collect()], "whatToTest": [r.qname for r in p.what_to_test.collect()], "unmatched": [r.name for r in p.unmatched.collect()]}

    def _search_data(self, query: str) -> dict[str, Any]:
        hits = self.store.search(query)
        rows = hits.join(self.store.nodes.select("id", "kind", "qname"), "id").orderBy(F.desc("score"), "id").collect()
        return {"term": query, "total": rows[0].total if rows else 0, "hits": [{"qname": r.qname, "kind": r.kind, "score": r.score, "matched": r.matched} for r in rows]}

    def _status_data(self) -> dict[str, Any]:
        last = self.store.last_snapshot()
        rows = snapshot_status(self.store.nodes).collect()
        return {"engine": last.engine if last else None, "takenAt": last.taken_at if last else None, "counts": {r.name: r.n for r in rows if r.part == "count"}, "excluded": [r.name for r in rows if r.part == "excluded"]}

    def _diff_data(self) -> dict[str, Any]:
        state, changes = diff_last(self.store)
        rows = [] if changes is None else [r.asDict() for r in changes.select("change", "kind", "qname").orderBy("change", "qname", "kind").collect()]
        return {"state": state, "changes": rows}

    def affected(self, script: str, detail: str = "normal") -> str:
        """The precheck of a file of SQL."""
        return self.precheck(Path(script).read_text(encoding="utf-8"), detail)

    def viz(self, out: str | None = None, **asked: Any) -> str:
        """Writes the page, or the Mermaid diagram (without a file, it is the answer)."""
        options, diagram = viewer.checked_options(**asked), bool(asked.get("mermaid"))
        nodes, edges = self.store.nodes, self.store.edges
        text = viewer.mermaid(nodes, edges) if diagram else viewer.page(viewer.data_block(nodes, edges, **options))
        if diagram and out is None:
            return text
        out = out or "graph.html"
        Path(out).write_text(text, encoding="utf-8")
        return f"Wrote {'the Mermaid diagram' if diagram else 'the graph page'} to {out}\n"

    def explore(self, qname: str, detail: str = "normal") -> str:
        node, others = self.resolve(qname, prefer_real=True)
        note = f"\nAlso named so: {', '.join(others)}\n" if others else ""
        return present.explore(node, self.groups(node["id"]), detail) + note

    def object(self, qname: str, detail: str = "normal") -> str:
        node, others = self.resolve(qname, prefer_real=True)
        note = f"\nAlso named so: {', '.join(others)}\n" if others else ""
        return present.describe(node, self.groups(node["id"]), detail) + note

    def related(self, qname: str, detail: str = "normal") -> str:
        node, _ = self.resolve(qname)
        return present.related(node, self.groups(node["id"]), detail)

    def impact(self, qname: str, depth: int = graph.DEPTH, detail: str = "normal") -> str:
        node, _ = self.resolve(qname)
        ids = self.store.spark.createDataFrame([(node["id"],)], "id STRING")
        found = graph.impact(self.store.nodes, self.store.edges, ids, depth)
        chains = sorted((r.asDict() for r in found.chains.collect()), key=lambda c: (c["depth"], c["nodes"][:-1], c["node"]))
        degraded = [r.id for r in found.degraded.collect()]
        names = self._names([i for c in chains for i in c["nodes"]] + degraded + [node["id"]])
        return present.impact(node, chains, names, not found.truncated.isEmpty(), degraded, detail)

    def path(self, start: str, end: str, allow_inferred: bool = False) -> str:
        (a, _), (b, _) = self.resolve(start), self.resolve(end)
        found = graph.join_path(self.store.nodes, self.store.edges, a["id"], b["id"], allow_inferred)
        names = self._names([a["id"], b["id"], *(i for h in found.hops for i in h[:2]), *found.from_neighbors, *found.to_neighbors])
        return present.path(a["qname"], b["qname"], found, names)

    def precheck(self, ddl: str, detail: str = "normal") -> str:
        if not ddl.strip():
            return present.precheck([], [], [], [], detail)
        p = precheck(self.store.nodes, self.store.edges, ddl)
        rows = lambda df: [r.asDict() for r in df.collect()]
        return present.precheck(rows(p.matched), rows(p.affected), [r.qname for r in p.what_to_test.collect()], [r.name for r in p.unmatched.collect()], detail)

    def search(self, query: str, limit: int = text_search.LIMIT, offset: int = 0, detail: str = "normal", prefix: bool = False) -> str:
        hits = self.store.search(query, limit=limit, offset=offset, prefix=prefix)
        rows = hits.join(self.store.nodes.select("id", "kind", "qname"), "id").orderBy(F.desc("score"), "id").collect()
        if rows:
            return present.search([r.asDict() for r in rows], rows[0].total, offset, detail)
        near = self.store.suggest([query]).join(self.store.nodes.select("id", "kind"), "id").orderBy("distance", "qname", "id").collect()
        return present.search([{**r.asDict(), "matched": "qname"} for r in near], len(near), 0, detail)

    def status(self, fingerprint: str | None = None, detail: str = "normal", scope: Scope = Scope()) -> str:
        last = self.store.last_snapshot()
        visible = self.store.nodes.where("NOT missing AND NOT excluded").groupBy("kind").count().collect()
        excluded = [r.qname for r in self.store.nodes.where("excluded").select("qname").collect()]
        moved = None if fingerprint is None else drift(self.store, fingerprint)
        engine, version, at = (last.engine, last.engine_version, last.taken_at) if last else ("unknown", None, None)
        return present.status(engine, version, at, {r["kind"]: r["count"] for r in visible}, {**DEFAULT_LEVELS, **scope.levels}, excluded, moved, detail)

    def diff(self) -> str:
        state, changes = diff_last(self.store)
        if changes is None:
            return {"too_few": "Fewer than two snapshots.\n", "no_manifest": "A snapshot has no manifest.\n"}[state]
        return present.snapshot_diff([r.asDict() for r in changes.collect()])

    def sync(self, source: Source, force: bool = False) -> str:
        engine, objects, mark = extract(self.store.spark, source)
        return present.sync_summary(sync(self.store, objects, engine, mark, source.scope, force=force))


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica", description="Questions of a stored schema graph.")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"explore": ["qname"], "object": ["qname"], "related": ["qname"], "impact": ["qname"], "path": ["start", "end"], "precheck": ["ddl"], "affected": ["script"], "search": ["query"], "status": [], "diff": [], "sync": ["dialect", "location"], "viz": []}.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name not in ("path", "diff", "sync", "viz"):
            sub.add_argument("--detail", choices=present.DETAILS, default="normal")
        if name not in ("sync", "viz"):
            sub.add_argument("--json", action="store_true")
        if name == "viz":
            for flag in ("--mermaid", "--full", "--columns"):
                sub.add_argument(flag, action="store_true")
            for flag in ("--out", "--kinds", "--schema", "--min-degree"):
                sub.add_argument(flag)
    try:
        given = vars(parser.parse_args(argv))
    except SystemExit as e:
        return Exit.OK if e.code == 0 else Exit.USAGE
    spark = SparkSession.builder.getOrCreate()
    command, as_json, api = given.pop("command"), given.pop("json", False), None
    try:
        api = GraphApi(GraphStore(spark, given.pop("store")))
        if command == "sync":
            given = {"source": parse_source(given)}
        found = None
        if command in ("affected", "search") or as_json:
            plain = {k: v for k, v in given.items() if k != "detail"}
            if command == "affected":
                plain = {"ddl": Path(plain["script"]).read_text(encoding="utf-8")}
            found = api.data("precheck" if command == "affected" else command, *plain.values())
        text = stable_json(found) + "\n" if as_json else getattr(api, command)(**given)
    except (PermissionError, FileNotFoundError, GraphError) as e:
        print(e, file=sys.stderr)
        if isinstance(e, PermissionError):
            return Exit.DENIED
        if isinstance(e, UnsupportedError):
            return Exit.UNSUPPORTED
        return Exit.NOTHING_FOUND if api and command not in ("sync", "viz") and isinstance(e, GraphError) else Exit.USAGE
    sys.stdout.write(text)
    if command == "affected":  # a gate: what touches the graph fails it
        return Exit.NOTHING_FOUND if found["matched"] else Exit.OK
    return Exit.NOTHING_FOUND if command == "search" and not found["hits"] else Exit.OK


if __name__ == "__main__":
    sys.exit(main())
