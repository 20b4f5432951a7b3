"""The catalog data source: real statements on stand-in engines, and the stream that follows a source."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lattica.model import UnsupportedError
from lattica.operators.store import GraphStore
from lattica.queries_mapping import FULL
from lattica.sources import catalog, datasource, families
from tests import standins


def objects(spark, dialect, connect, args, **options):
    given = {"dialect": dialect, "connect": f"tests.standins:{connect}", "args": json.dumps(args), **options}
    rows = datasource.staged(datasource.read_catalog(spark, given))
    return {(r.kind, r.name): r for r in datasource.objects_of(rows, dialect, FULL, database=options.get("database", "")).collect()}, rows


def test_mysql_statements_run(spark, tmp_path):
    found, rows = objects(spark, "mysql", "mysql", {"path": standins.mysql_file(tmp_path / "m.db")}, database="shop")
    assert set(found) == {("table", "teams"), ("table", "people"), ("view", "busy"), ("procedure", "tidy"), ("trigger", "tr")}
    people = found["table", "people"]
    assert [(c.name, c.data_type, c.nullable, c.default) for c in people.columns] == [("person_id", "int", False, None), ("team_id", "int", True, "0")]
    assert {(c.type, tuple(c.columns), c.references and c.references.table) for c in people.constraints} == {("PK", ("person_id",), None), ("FK", ("team_id",), "teams"), ("CHECK", (), None)}
    assert [(i.name, i.unique, i.columns) for i in people.indexes] == [("ix_team", False, ["team_id"])] and found["table", "teams"].comment == "who plays"
    assert [(d.target.name, d.access) for d in found["procedure", "tidy"].dependencies] == [("people", "write")]
    assert found["trigger", "tr"].trigger.events == ["INSERT"] and [p.name for p in found["procedure", "tidy"].parameters] == ["how"]
    # A partition for each family and one for the mark.
    assert len(datasource.Connection({"dialect": "mysql", "connect": "x:y", "database": "shop"}).parts()) == len(families.MYSQL) + 1
    assert rows.where("family = 'tables'").count() == 2


def test_mssql_statements_run_with_a_call_for_each_view(spark):
    found, rows = objects(spark, "mssql", "mssql", {})
    assert {k for k in found if k[0] != "sequence"} == {("table", "teams"), ("table", "people"), ("view", "busy"), ("view", "broken"), ("view", "o'clock"), ("procedure", "tidy"), ("trigger", "tr")}
    used = {(r.v, r.c) for r in rows.where("family = 'view-referenced-columns'").select(F.get_json_object("row", "$.referencing_view").alias("v"), F.get_json_object("row", "$.referenced_column").alias("c")).collect()}
    assert used == {("busy", "person_id"), ("o'clock", "name")}  # a view that can't be bound is left out alone
    assert [(d.target.name, d.columns) for d in found["view", "busy"].dependencies] == [("people", ["person_id"])]
    people = found["table", "people"]
    assert [(c.name, c.nullable, c.default) for c in people.columns] == [("person_id", False, None), ("team_id", True, "((0))"), ("name", True, None)]
    assert ("FK", "teams") in {(c.type, c.references and c.references.table) for c in people.constraints}
    assert found["table", "teams"].comment == "who plays" and ("sequence", "seq") in found
    assert set(r.family for r in rows.select("family").distinct().collect()) == set(families.MSSQL) | {""}


def test_documents_are_sampled_by_collection(spark):
    docs = {"a": [{"n": i, "m": {"x": "s"}} for i in range(5)], "b": [{"n": "t"}], "system.views": [{"n": 1}]}
    found, rows = objects(spark, "documents", "documents", {"docs": docs}, database="d", sample="3")
    assert rows.where("family = 'documents'").groupBy(F.get_json_object("row", "$.collection").alias("c")).count().where("count > 3").count() == 0
    assert set(found) == {("collection", "a"), ("collection", "b")}
    a = found["collection", "a"]
    assert {(f.name, f.data_type, f.frequency) for f in a.fields} == {("n", "numeric", 1.0), ("m.x", "string", 1.0), ("_id", "objectId", 1.0), ("at", "date", 1.0), ("blob", "unknown", 1.0), ("price", "string", 1.0)}
    assert [(i.name, i.unique, i.columns) for i in a.indexes] == [("_id_", False, ["_id"]), ("by_n", True, ["n", "m"])]
    assert json.loads(a.extra) == {"required": ["n"]} and found["collection", "b"].extra is None


def test_an_unknown_dialect_is_refused_and_passwords_come_by_name(spark, tmp_path, monkeypatch):
    with pytest.raises(UnsupportedError):
        datasource.Connection({"dialect": "db9", "connect": "x:y"})
    source = datasource.Connection({"dialect": "mysql", "connect": "tests.standins:mysql", "args": json.dumps({"path": standins.mysql_file(tmp_path / "m.db")}), "passwordEnv": "SECRET_OF_TEST"})
    with pytest.raises(KeyError):
        source.open()
    monkeypatch.setenv("SECRET_OF_TEST", "s")
    assert source.fingerprint() == source.fingerprint()


def change(path, sql):
    con = sqlite3.connect(path)
    con.executescript(sql)
    con.close()


def tables(store):
    store.refresh()
    return sorted(r["name"] for r in store.nodes.where("kind = 'table' AND NOT missing").collect())


def test_a_stream_follows_the_fingerprint_and_recovers(spark, tmp_path, monkeypatch):
    path, store = standins.mysql_file(tmp_path / "m.db"), GraphStore(spark, str(tmp_path / "store"))
    options = {"dialect": "mysql", "connect": "tests.standins:mysql", "args": json.dumps({"path": path}), "database": "shop"}

    def step():
        before = store.version
        query = datasource.follow(store, options, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        store.refresh()
        return store.version - before

    assert step() == 1 and tables(store) == ["people", "teams"]
    assert step() == 0 and store.snapshots().count() == 1  # no batch without a change
    change(path, "INSERT INTO TABLES VALUES ('shop', 'fresh', 'BASE TABLE', ''); DELETE FROM COLUMNS WHERE TABLE_NAME = 'teams';")
    real = datasource._sync
    monkeypatch.setattr(datasource, "_sync", lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost")))
    with pytest.raises(Exception, match="executor lost"):
        step()
    assert tables(store) == ["people", "teams"]
    monkeypatch.setattr(datasource, "_sync", real)
    assert step() == 1 and tables(store) == ["fresh", "people", "teams"] and store.snapshots().count() == 2
    assert step() == 0
    # Another reader of the source finds the mark in the store and asks for no family.
    monkeypatch.setattr(datasource, "read_catalog", lambda *a: 1 / 0)
    assert not datasource.sync_once(store, options).changed


def test_families_that_do_not_fit_fail(spark):
    rows = spark.createDataFrame([("statistics", 0, json.dumps({"table_schema": "s", "non_unique": "many"}), "")], datasource.ROWS)
    with pytest.raises(Exception, match="malformed"):
        datasource.families_of(rows, "mysql")["statistics"].collect()
    assert catalog.camel("a_b") == "aB"
