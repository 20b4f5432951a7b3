"""A store of the graph on Parquet: a log of commits, with changes merged on read.

A commit is a small numbered file that names folders of rows. A change of k rows writes those rows and the keys that they
replace or delete, and nothing else; a table is its base and the changes since, where a row counts unless a later change
touches its key. Two writers can't take one number: the later one looks at what the earlier one touched and goes on with
the next number if that has nothing to do with its own change, else it fails and leaves no trace. From time to time the
newest changes are put together, and with the base where they have grown beyond a part of it, so that a read meets few of
them and what is written stays in proportion to what changes.

Snapshots are added to. A manifest is kept in buckets by id with a hash of each: a snapshot writes the buckets whose hashes
differ from the last one's and names the others where they are, and a difference of snapshots reads buckets with unlike
hashes alone. Nodes and edges are partitioned by kind. The words of all texts are kept by term, changed by the commit that
changes their nodes, so a search reads its own words alone. Leading letters of names are kept by what is left of them with
some deleted; they are added to alone, as those of names that went find nothing, until they are made anew with their base.
A job that dies before its commit leaves folders that no commit names; vacuum() removes those.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.model import EDGES, NODES, SNAPSHOT_OBJECTS, SNAPSHOTS, GraphError
from lattica.operators.search import bucket_of, deletions, lengths, postings, search_stored, suggest, text_rows, typo_index
from lattica.operators.snapshot import bucket_hashes, buckets_for, content_hash, diff, in_buckets, manifest
from lattica.plans.cut import discard, large, staged
from lattica.plans.log import CommitLog, Folder

SCHEMA_VERSION = 5
_META = "key STRING, value STRING"
_SCHEMAS = {"nodes": NODES, "edges": EDGES, "snapshots": SNAPSHOTS, "snapshot_objects": SNAPSHOT_OBJECTS, "meta": _META, "postings": "bucket INT, term STRING, id STRING, col STRING, positions ARRAY<INT>", "lengths": "id STRING, len INT", "typos": "bucket INT, part STRING, lead STRING"}
_PARTS = {"nodes": "kind", "edges": "kind", "postings": "bucket", "typos": "bucket"}
_ADDED_TO = ("snapshots", "snapshot_objects")
#: By table, its key and the scope of keys that commits tell as touched. Without a key rows are added, none is replaced.
_KEYS = {"nodes": ("id", "nodes"), "edges": ("id", "edges"), "postings": ("id", "nodes"), "lengths": ("id", "nodes"), "typos": (None, "nodes"), "meta": ("key", "meta")}
#: Keys by scope. ends are nodes that edges were put at, gone those that were deleted with their edges.
_TOUCHED = "scope STRING, key STRING"
#: Scopes that mustn't meet in two changes of which neither saw the other.
_CLASHES = (("nodes", "nodes"), ("edges", "edges"), ("meta", "meta"), ("ends", "gone"), ("gone", "ends"))
#: Changes of a table that a read meets at most. The newest are put together with older ones up to GROWTH times their size.
MOST_CHANGES, GROWTH = 16, 4


class ConflictError(GraphError):
    """Another writer changed what this change rests on; nothing was committed."""


class Segment(NamedTuple):
    """Rows of a table as of a version, and the keys that they replace in what is older."""

    upto: int
    folder: str | None
    touched: tuple[str, ...]
    size: int
    base: bool


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, self.path)
        self._log = CommitLog(self._folder)
        self._commits: list[dict] = []
        self.refresh()
        if not self._commits:
            self._migrate()
        newest = max((c["schema"] for c in self._commits), default=0)
        if newest > SCHEMA_VERSION:
            raise GraphError(f"the store has schema version {newest}; this library knows {SCHEMA_VERSION}")
        if 0 < newest < SCHEMA_VERSION:  # its index of names held ids
            self._commit(base={"typos": self._put("typos", typo_index(self.nodes))}, whole=True)

    # The log

    def _migrate(self) -> None:
        """Brings a store of before the log, if there is one, into it by one commit; no rows are written anew."""
        try:
            old = self.spark.read.schema("table STRING, version LONG, folder STRING, schema_version INT").parquet(f"{self.path}/_commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        newest = max(r.schema_version for r in old)
        if newest >= SCHEMA_VERSION:
            raise GraphError(f"the store has schema version {newest}, without a log")
        folders: dict[str, list[str]] = {}
        for r in sorted(old, key=lambda r: r.version):
            folders[r.table] = [*(folders.get(r.table, []) if r.table in _ADDED_TO else []), r.folder]
        base = {t: (x[-1], self._folder.size(f"{t}/{x[-1]}")) for t, x in folders.items() if t not in _ADDED_TO}
        if "nodes" in base:  # no index of names was kept, nor of words by the oldest
            nodes = self._rows("nodes", base["nodes"][0])
            base |= {"typos": self._put("typos", typo_index(nodes))} | (self._words(nodes) if newest < 3 else {})
        self._commit(base=base, add={t: folders[t] for t in _ADDED_TO if t in folders}, whole=True)

    def refresh(self) -> None:
        """Sees what others have committed since."""
        self._commits += self._log.after(self.version)

    @property
    def version(self) -> int:
        return self._commits[-1]["version"] if self._commits else 0

    def _segments(self, table: str, version: int | None = None) -> list[Segment]:
        """The table's base, if it has one, and the changes since, oldest first."""
        out: list[Segment] = []
        for c in self._commits:
            if version is not None and c["version"] > version:
                break
            if table in c["base"]:
                out = [Segment(c["version"], *self._of(c["base"][table]), True)]
            elif table in c["delta"] or _KEYS[table][1] in c["scopes"]:
                folder, touched, size = self._of(c["delta"].get(table))
                out.append(Segment(c["version"], folder, (c["touched"],), size, not out))
            elif (made := c["merged"].get(table)) and {*made["replaces"]} <= {s.upto for s in out}:
                first = out[0].base and out[0].upto in made["replaces"]
                whole = Segment(max(made["replaces"]), made["folder"], tuple(made["touched"]), made["size"], first)
                out = sorted([*(s for s in out if s.upto not in made["replaces"]), whole])
        return out

    @staticmethod
    def _of(entry: Sequence | None) -> tuple[str | None, tuple[str, ...], int]:
        return (entry[0], (), entry[1]) if entry else (None, (), 0)

    def _added(self, table: str, version: int | None = None) -> list[str]:
        return [x for c in self._commits if version is None or c["version"] <= version for x in c["add"].get(table, [])]

    def _commit(self, base: dict | None = None, delta: dict | None = None, add: dict | None = None, merged: dict | None = None, touched: DataFrame | None = None, whole: bool = False) -> None:
        """All of it becomes visible at once, or, if another writer's change is in its way, nothing.

        base and delta: (folder, bytes) by table; add: folders by table. whole: it rests on all that there was.
        """
        commit = {"schema": SCHEMA_VERSION, "base": base or {}, "delta": delta or {}, "add": add or {}, "merged": merged or {}, "touched": None, "scopes": [], "whole": whole}
        if touched is not None:
            folder = self._put_touched(touched)
            commit |= {"touched": folder, "scopes": sorted(r.scope for r in self._touched([folder]).select("scope").distinct().collect())}
        while not self._log.put(self.version + 1, commit):
            seen = self.version
            self.refresh()
            for other in self._commits:
                if other["version"] > seen and self._clash(commit, other):
                    raise ConflictError(f"commit {other['version']} of another writer changed what this change rests on")
        self.refresh()
        if not merged:
            self._tidy()

    def _clash(self, mine: dict, other: dict) -> bool:
        if other["merged"] or mine["merged"]:
            return False
        matters = lambda c: c["whole"] or not {"nodes", "edges"}.isdisjoint(c["scopes"])
        if (mine["whole"] and matters(other)) or (other["whole"] and matters(mine)):
            return True
        pairs = [(a, b) for a, b in _CLASHES if a in mine["scopes"] and b in other["scopes"]]
        own, theirs = (self._touched([c["touched"]]) for c in (mine, other)) if pairs else (None, None)
        return any(own.where(F.col("scope") == a).join(theirs.where(F.col("scope") == b), "key", "left_semi").take(1) for a, b in pairs)

    def _put_touched(self, keys: DataFrame) -> str:
        folder = uuid.uuid4().hex
        keys.distinct().sortWithinPartitions("scope", "key").write.parquet(f"{self.path}/touched/{folder}")
        return folder

    def _touched(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(_TOUCHED).parquet(*[f"{self.path}/touched/{x}" for x in folders])

    # Reading

    def _rows(self, table: str, *folders: str) -> DataFrame:
        names = self.spark.createDataFrame([], _SCHEMAS[table]).columns
        return self.spark.read.schema(_SCHEMAS[table]).parquet(*[f"{self.path}/{table}/{x}" for x in folders]).select(names)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was after a commit whose folders weren't removed since."""
        if table in _ADDED_TO:
            return self._read_added(table, self._added(table, version))
        return self._merged(table, self._segments(table, version))

    def _merged(self, table: str, segments: Sequence[Segment]) -> DataFrame:
        """The rows of the segments that no later one of them touches. Keys alone are joined, and there are few of them."""
        parts = [self._rows(table, s.folder).withColumn("__at", F.lit(s.upto)) for s in segments if s.folder]
        if not parts:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        rows = reduce(DataFrame.unionByName, parts)
        later = [s for s in segments if not s.base and s.upto > min(x.upto for x in segments)]
        key, scope = _KEYS[table]
        if later and key:
            keys = reduce(DataFrame.unionByName, [self._touched(s.touched).where(F.col("scope") == scope).select(F.col("key").alias("__key"), F.lit(s.upto).alias("__later")) for s in later])
            rows = rows.join(keys, (F.col(key) == F.col("__key")) & (F.col("__at") < F.col("__later")), "left_anti")
        return rows.drop("__at")

    def _read_added(self, table: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        if table != "snapshots":
            return self._rows(table, *folders)
        # A snapshot's number is its place among the commits, whichever writer made it.
        at = self.spark.createDataFrame([(x, i + 1) for i, x in enumerate(folders)], "__folder STRING, __seq LONG")
        rows = self.spark.read.schema(SNAPSHOTS).parquet(*[f"{self.path}/{table}/{x}" for x in folders])
        rows = rows.withColumn("__folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(at), "__folder")  # a row a snapshot
        return rows.withColumn("seq", F.col("__seq")).drop("__folder", "__seq")

    @property
    def nodes(self) -> DataFrame:
        return self.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    def all_nodes(self) -> DataFrame:
        return self.nodes.orderBy("qname", "id")

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("kind", "src", "dst", "id")

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def node_by_qname(self, kind: str, qname: str) -> DataFrame:
        return self.nodes.where((F.col("kind") == kind) & (F.col("qname") == qname.lower()))

    def nodes_by_kind(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind).orderBy("qname", "id")

    def text(self) -> DataFrame:
        return text_rows(self.nodes)

    def search(self, query: str, **options) -> DataFrame:
        """The page of text_search.search(), from the words that are kept."""
        return search_stored(self.read("postings"), self.read("lengths"), query, **options)

    def suggest(self, terms: Sequence[str] | DataFrame, **options) -> DataFrame:
        """(term, id, qname, distance): the nearest real nodes of each term; of few terms, only their parts of the index are read."""
        index_ = self.read("typos")
        if not isinstance(terms, DataFrame):
            terms = self.spark.createDataFrame([(t,) for t in terms], "term STRING")
            parts = terms.select(F.explode(deletions(F.lower("term"))).alias("part")).select(bucket_of(F.col("part")).alias("b")).distinct()
            index_ = index_.where(F.col("bucket").isin([r.b for r in parts.collect()]))
        return suggest(index_, self.nodes, terms, **options)

    # Writing

    def _put(self, table: str, df: DataFrame, folder: str | None = None) -> tuple[str, int]:
        """Writes rows into a new folder that no reader sees yet; returns it and its bytes."""
        folder, part = folder or uuid.uuid4().hex, _PARTS.get(table)
        rows = df.select(self.spark.createDataFrame([], _SCHEMAS[table]).columns)
        rows = rows.hint("rebalance", part) if part else rows.hint("rebalance")  # files of a fair size, whatever the input's partitions
        out = rows.write.option("compression", "zstd")  # ids are hex, which only an entropy coder makes smaller
        (out.partitionBy(part) if part else out).parquet(f"{self.path}/{table}/{folder}")
        return folder, self._folder.size(f"{table}/{folder}")

    def _words(self, fresh: DataFrame) -> dict[str, tuple[str, int]]:
        rows = text_rows(fresh)
        return {"postings": self._put("postings", postings(rows)), "lengths": self._put("lengths", lengths(rows))}

    def _with_words(self, fresh: DataFrame) -> dict[str, tuple[str, int]]:
        """Nodes, the words of their texts, and what their names are found by in spite of typos."""
        return {"nodes": self._put("nodes", fresh), "typos": self._put("typos", typo_index(fresh)), **self._words(fresh)}

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Rows replace those of the same id; of several in one call one is taken, of edges the last by constraint name."""
        delta, keys, done = {}, [], []
        if nodes is not None:
            done.append(fresh := staged(one_each(nodes)))
            delta |= self._with_words(fresh)
            keys.append(_keys("nodes", fresh))
        if edges is not None:
            done.append(fresh := staged(one_each(edges)))
            delta["edges"] = self._put("edges", fresh)
            keys += [_keys("edges", fresh), _keys("ends", fresh, "src"), _keys("ends", fresh, "dst")]
        if keys:
            self._commit(delta=delta, touched=reduce(DataFrame.unionByName, keys))
        discard(*done)

    def replace(self, nodes: DataFrame, edges: DataFrame) -> None:
        fresh = staged(one_each(nodes))
        self._commit(base=self._with_words(fresh) | {"edges": self._put("edges", one_each(edges))}, whole=True)
        discard(fresh)

    def delete(self, ids: DataFrame) -> int:
        """Nodes of ids (id) go, and all edges at them; returns how many nodes went."""
        return self.apply(self.nodes.limit(0), ids)[1]

    def apply(self, fresh: DataFrame, gone: DataFrame) -> tuple[int, int]:
        """Upserts nodes and deletes those of ids (id) with their edges, in one commit; returns how many of each.

        What is written is in proportion to the change: the nodes, their words, and the keys of what goes.
        """
        fresh = staged(one_each(fresh))
        gone = staged(self.nodes.join(large(gone.select("id").distinct()), "id", "left_semi").select("id"))
        upserted, deleted = fresh.count(), gone.count()
        if upserted or deleted:
            keys = [_keys("nodes", fresh), _keys("nodes", gone)]
            if deleted:
                keys += [_keys("gone", gone), _keys("edges", at_ends(self.edges, gone))]
            self._commit(delta=self._with_words(fresh), touched=reduce(DataFrame.unionByName, keys))
        discard(fresh, gone)
        return upserted, deleted

    def advance(self, fresh: DataFrame, gone: DataFrame, edges: DataFrame, engine: str, engine_version: str | None, fingerprint: str, include_payload: bool = False) -> str:
        """Upserts nodes, deletes those of ids (id), makes the edges those given, and takes a snapshot: one commit.

        Of the edges only those that differ are written.
        """
        fresh, edges, old = staged(fresh), staged(one_each(edges)), self.edges
        told = F.xxhash64(F.to_json(F.struct(*edges.columns))).alias("__told")
        other = staged(edges.join(large(old.select("id", told)), ["id"], "left").where(~told.eqNullSafe(F.col("__told"))).select(edges.columns))
        stale = old.join(large(edges.select("id")), "id", "left_anti")
        keys = [_keys("nodes", fresh), _keys("nodes", gone), _keys("gone", gone), _keys("edges", other), _keys("edges", stale)]
        after = self.nodes.join(large(gone.select("id").unionByName(fresh.select("id"))), "id", "left_anti").unionByName(fresh)
        ident, add = self._snapshot(after, engine, engine_version, fingerprint, None, include_payload)
        self._commit(delta=self._with_words(fresh) | {"edges": self._put("edges", other)}, add=add, touched=reduce(DataFrame.unionByName, keys), whole=True)
        discard(fresh, edges, other)
        return ident

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row.value if row else None

    def set_meta(self, key: str, value: str) -> None:
        row = self.spark.createDataFrame([(key, value)], _META)
        self._commit(delta={"meta": self._put("meta", row)}, touched=_keys("meta", row, "key"))

    def snapshots(self) -> DataFrame:
        """Oldest first."""
        return self.read("snapshots").orderBy("seq")

    def _manifest(self, snapshot_id: str) -> dict | None:
        """{buckets, at: {bucket: [folder, hash]}}; None for snapshots of before there were buckets."""
        name = f"{snapshot_id}.json"
        return json.loads(self._folder.text(f"manifests/{name}")) if name in self._folder.names("manifests") else None

    def _manifest_rows(self, snapshot_id: str, at: dict[str, list[str]]) -> DataFrame:
        """The rows of some buckets, wherever they were written."""
        if not at:
            return self.spark.createDataFrame([], SNAPSHOT_OBJECTS)
        rows = self.spark.read.schema(SNAPSHOT_OBJECTS).parquet(*[f"{self.path}/snapshot_objects/{folder}/bucket={b}" for b, (folder, _) in at.items()])
        return rows.withColumn("snapshot_id", F.lit(snapshot_id))

    def snapshot_objects(self, snapshot_id: str) -> DataFrame:
        """A snapshot's manifest."""
        found = self._manifest(snapshot_id)
        if found is None:
            return self._read_added("snapshot_objects", [x for x in self._added("snapshot_objects") if x == snapshot_id]).orderBy("qname", "node_id")
        return self._manifest_rows(snapshot_id, found["at"]).orderBy("qname", "node_id")

    def difference(self, before: str, after: str) -> DataFrame | None:
        """(change, node_id, kind, qname) between two snapshots, by buckets whose hashes differ; None if one has no manifest."""
        a, b = self._manifest(before), self._manifest(after)
        if a is None or b is None or a["buckets"] != b["buckets"]:
            rows = [self.snapshot_objects(x) for x in (before, after)]
            return None if any(x.isEmpty() for x in rows) else diff(*rows)
        if not a["at"] or not b["at"]:
            return None
        unlike = {k for k in {*a["at"], *b["at"]} if a["at"].get(k, [0, 0])[1] != b["at"].get(k, [0, 0])[1]}
        return diff(*[self._manifest_rows(i, {k: x for k, x in m["at"].items() if k in unlike}) for i, m in ((before, a), (after, b))])

    def take_snapshot(self, engine: str, engine_version: str | None, fingerprint: str, taken_at: str | None = None, include_payload: bool = False) -> str:
        """Writes a snapshot and its manifest of visible nodes in one commit."""
        ident, add = self._snapshot(self.nodes, engine, engine_version, fingerprint, taken_at, include_payload)
        self._commit(add=add, whole=True)
        return ident

    def _snapshot(self, nodes: DataFrame, engine: str, engine_version: str | None, fingerprint: str, taken_at: str | None, include_payload: bool) -> tuple[str, dict[str, list[str]]]:
        at = taken_at or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        ident = uuid.uuid4().hex
        counts = {r.kind: r.n for r in nodes.where("NOT missing AND NOT excluded").groupBy("kind").agg(F.count("*").alias("n")).collect()}
        row = self.spark.createDataFrame([(ident, at, engine, engine_version, fingerprint, counts, None)], SNAPSHOTS)
        last = self.last_snapshot()
        old = (self._manifest(last.id) if last is not None else None) or {"buckets": 0, "at": {}}
        buckets = buckets_for(sum(counts.values()), old["buckets"])
        known = old["at"] if buckets == old["buckets"] else {}
        rows = in_buckets(manifest(nodes, ident, include_payload), buckets)
        found = {str(r.bucket): r.hash for r in bucket_hashes(rows).collect()}  # as many as there are buckets
        fresh = [b for b, h in found.items() if known.get(b, [0, 0])[1] != h]
        add = {"snapshots": [self._put("snapshots", row)[0]]}
        if fresh:
            rows = rows.where(F.col("bucket").isin([int(b) for b in fresh])).hint("rebalance", "bucket")
            rows.write.partitionBy("bucket").parquet(f"{self.path}/snapshot_objects/{ident}")
            add["snapshot_objects"] = [ident]
        self._folder.make(f"manifests/{ident}.json", json.dumps({"buckets": buckets, "at": {b: [ident, h] if b in fresh else known[b] for b, h in found.items()}}))
        return ident, add

    def last_snapshot(self, oldest: bool = False):
        """The newest snapshot; oldest gives the first one, which is what comparing with "the last" did at times."""
        return self.read("snapshots").orderBy(F.asc("seq") if oldest else F.desc("seq")).first()

    # Upkeep

    def _tidy(self) -> None:
        for table in _KEYS:
            if len(self._segments(table)) > MOST_CHANGES:
                self.compact(table)

    def compact(self, table: str, whole: bool = False) -> None:
        """Puts the newest changes of a table together, and with its base where that isn't much larger, or on request.

        Older changes join as long as they are at most GROWTH times as large as what is put together already, so a row is
        written anew a number of times that grows with the logarithm of the table's size alone.
        """
        segments = self._segments(table)
        taken = segments[-2:]
        for s in segments[-3::-1]:
            if not whole and s.size > GROWTH * sum(x.size for x in taken):
                break
            taken = [s, *taken]
        if len(taken) < 2:
            return
        rows = self._merged(table, taken) if _KEYS[table][0] else typo_index(self.nodes) if taken[0].base else self._merged(table, taken).distinct()
        folder, size = self._put(table, rows)
        scope = F.col("scope") == _KEYS[table][1]
        touched = [] if taken[0].base else [self._put_touched(self._touched([x for s in taken for x in s.touched]).where(scope))]
        self._commit(merged={table: {"folder": folder, "size": size, "touched": touched, "replaces": [s.upto for s in taken]}})

    def vacuum(self, hours: float = 168) -> int:
        """Removes folders that no table needs any more and that are older than some hours; returns how many.

        That should be longer than any writer or reader takes, as folders of a commit still to come aren't named yet. What
        tables were at earlier versions can't be read after that.
        """
        self.refresh()
        live = {t: {x for s in self._segments(t) for x in [s.folder]} for t in _KEYS} | {t: {*self._added(t)} for t in _ADDED_TO}
        live["touched"] = {x for t in _KEYS for s in self._segments(t) for x in s.touched}
        n, before = 0, (time.time() - 3600 * hours) * 1000
        for table, named in live.items():
            for name, changed in self._folder.names(table).items():
                if name not in named and changed <= before:
                    self._folder.delete(f"{table}/{name}")
                    n += 1
        return n


def _keys(scope: str, rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.select(F.lit(scope).alias("scope"), F.col(column).alias("key"))


def at_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that have an end among ids (id)."""
    gone = ids.select(F.col("id").alias("__end")).distinct()
    at = lambda end: edges.join(gone, F.col(end) == F.col("__end"), "left_semi")
    return at("src").unionByName(at("dst")).dropDuplicates(["id"])


def without_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that have no end among ids (id)."""
    gone = ids.select("id").distinct()
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each id: of edges the last by constraint name, of nodes by content."""
    order = F.desc("attrs.constraint_name") if "attrs" in rows.columns else F.desc(content_hash())
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("__n = 1").drop("__n")


def put_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of the same id."""
    fresh = one_each(new)
    return old.join(large(fresh.select("id")), "id", "left_anti").unionByName(fresh)
