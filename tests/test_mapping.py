import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import naming, text
from lattica.model import Scope
from lattica.operators import sampling
from lattica.operators.normalize import normalize
from lattica.sources import catalog, families, mapping

FULL = Scope(levels={"procedures": "full", "functions": "full"})


def write(folder, rows):
    for name, data in rows.items():
        (folder / f"{name}.json").write_text(json.dumps(data))
    return str(folder)


def objects(df):
    return {(r.kind, r["name"]): r for r in df.collect()}


def deps(o):
    return [(d.target.name, d.target.kind, d.access, d.confidence, d["columns"]) for d in o.dependencies or []]


def test_mssql(spark, tmp_path):
    s = {"schema_name": "dbo"}
    rows = {k: [] for k in families.MSSQL} | {
        "tables": [s | {"table_name": "orders", "object_id": 1}, s | {"table_name": "items", "object_id": 2}],
        "columns": [s | {"table_name": "orders", "column_id": i, "column_name": c, "data_type": "int", "is_nullable": i > 1, "is_computed": False, "default_definition": None} for i, c in ((2, "total"), (1, "id"))],
        "key-constraints": [s | {"table_name": "items", "constraint_name": "PK_i", "constraint_type": "PK", "column_name": c, "key_ordinal": i} for i, c in ((2, "b"), (1, "a"))],
        "foreign-keys": [s | {"table_name": "items", "constraint_name": "FK_i", "fk_id": 9, "ref_schema_name": "dbo", "ref_table_name": "orders", "local_column": a, "ref_column": b, "constraint_column_id": i} for i, a, b in ((2, "y", "z"), (1, "o", "id"))],
        "check-constraints": [s | {"table_name": "items", "constraint_name": "CK_i", "definition": "(q>0)"}],
        "indexes": [s | {"table_name": "orders", "index_name": "IX", "is_unique": True, "type_desc": "N", "column_name": c, "index_column_id": i, "is_included_column": inc} for i, c, inc in ((2, "id", False), (3, "more", True), (1, "total", False))],
        "modules": [s | {"object_name": n, "object_type": t, "object_id": i, "definition": d} for i, n, t, d in ((10, "v", "V ", "select id from dbo.orders"), (11, "p", "P ", "update [dbo].[orders] set total=1; exec(@x)"), (12, "f", "FN", "return 1"), (13, "t", "TR", "insert into items select 1"), (14, "q", "U", ""))],
        "dependencies": [s | {"object_name": n, "object_type": t, "ref_schema_name": rs, "ref_object_name": r, "ref_object_type": rt} for n, t, rs, r, rt in (("v", "V", "dbo", "orders", "U"), ("p", "P", "dbo", "orders", "U"), ("p", "P", "dbo", "f", "FN"), ("p", "P", None, "x", None), ("t", "TR", "dbo", "items", "U"))],
        "parameters": [s | {"object_name": "p", "object_id": 11, "parameter_id": i, "parameter_name": n, "data_type": "int", "is_output": o, "has_default_value": i == 5} for i, n, o in ((0, "", True), (5, "@b", False), (2, "@a", True))],
        "trigger-events": [{"trigger_id": 13, "trigger_name": "t", "parent_object_id": 1, "is_instead_of_trigger": True, "event_type": e} for e in ("INSERT", "DELETE", "OTHER")],
        "sequences": [s | {"sequence_name": "sq", "data_type": "int", "start_value": "1"}],
        "extended-properties": [s | {"object_name": "orders", "column_id": 0, "column_name": None, "description": "all orders"}, s | {"object_name": "orders", "column_id": 1, "column_name": "id", "description": "the key"}],
        "view-referenced-columns": [{"referencing_schema": "dbo", "referencing_view": "v", "referenced_schema": "dbo", "referenced_entity": "orders", "referenced_column": c} for c in ("id", None)],
    }
    found = mapping.map_mssql(catalog.read_families(spark, write(tmp_path, rows), families.MSSQL), FULL)
    o = objects(found)
    orders, items = o["table", "orders"], o["table", "items"]
    assert [(c.name, c.nullable, c.comment) for c in orders.columns] == [("id", False, "the key"), ("total", True, None)] and orders.comment == "all orders"
    assert [(c.name, c.type, c.columns) for c in items.constraints] == [("CK_i", "CHECK", []), ("FK_i", "FK", ["o", "y"]), ("PK_i", "PK", ["a", "b"])]
    assert items.constraints[1].references.columns == ["id", "z"] and items.indexes == [] and items.columns == []
    assert [(i.name, i.unique, i["columns"]) for i in orders.indexes] == [("IX", True, ["total", "id"])]
    assert deps(o["view", "v"]) == [("orders", None, "read", "declared", ["id"])]
    assert deps(o["procedure", "p"]) == [("orders", None, "write", "parsed", None), ("f", "function", "read", "declared", None)]
    assert o["procedure", "p"].has_dynamic_sql and [(p.name, p.direction, p.has_default, p.ordinal) for p in o["procedure", "p"].parameters] == [("@a", "out", None, 1), ("@b", "in", True, 2)]
    assert o["function", "f"].parameters == [] and o["view", "v"].parameters is None
    t = o["trigger", "t"].trigger
    assert (t.timing, t.events, t.table.name) == ("INSTEAD OF", ["INSERT", "DELETE"], "orders") and deps(o["trigger", "t"])[0][2] == "write"
    assert [(r.kind, r["name"]) for r in found.orderBy("pos").collect()] == [("table", "items"), ("table", "orders"), ("view", "v"), ("procedure", "p"), ("function", "f"), ("trigger", "t"), ("sequence", "sq")]
    bare = objects(mapping.map_mssql(catalog.read_families(spark, str(tmp_path), families.MSSQL), Scope(levels={"functions": "off"})))
    assert ("function", "f") not in bare and bare["procedure", "p"].body is None and bare["procedure", "p"].has_dynamic_sql


def test_pg(spark, tmp_path):
    s = {"schema_name": "app"}
    rows = {k: [] for k in families.PG} | {
        "tables": [s | {"table_name": "orders", "table_oid": 1, "comment": None}, s | {"table_name": "items", "table_oid": 2, "comment": "c"}],
        "columns": [s | {"table_name": "orders", "ordinal": 1, "column_name": "id", "data_type": "integer", "is_nullable": False, "default_expr": "1"}],
        "column-names": [s | {"table_name": t, "table_oid": o, "attnum": i, "column_name": c} for t, o, i, c in (("orders", 1, 1, "id"), ("items", 2, 1, "order_id"), ("items", 2, 2, "n"))],
        "constraints": [s | {"table_name": "items", "constraint_name": "fk", "constraint_type": "f", "column_positions": [1, 9], "fk_ref_positions": [1, 7], "fk_ref_schema": "app", "fk_ref_table": "orders"}, s | {"table_name": "items", "constraint_name": "ck", "constraint_type": "c", "column_positions": [2], "constraint_def": "CHECK (n > 0)"}, s | {"table_name": "items", "constraint_name": "x", "constraint_type": "t"}],
        "indexes": [s | {"table_name": "items", "index_name": "ix", "is_unique": False, "is_primary": False, "key_columns": [0, 2, 1], "n_key_atts": 2, "index_def": ""}, s | {"table_name": "items", "index_name": "pk", "is_unique": True, "is_primary": True, "key_columns": [1], "n_key_atts": 1, "index_def": ""}],
        "views": [s | {"view_name": "v", "rel_kind": "m", "view_def": "SELECT 'items' FROM app.orders", "comment": None}],
        "routines": [s | {"routine_name": n, "routine_kind": k, "routine_def": d, "comment": None, "arg_names": None, "arg_modes": m, "arg_type_names": t, "num_defaults": 1} for n, k, d, m, t in (("f", "f", "insert into items select * from orders; perform g()", None, ["int", "text"]), ("g", "p", "EXECUTE 'x'", ["i", "o", "t"], ["int", "int", "int"]), ("h", "f", "EXECUTE FUNCTION f()", None, None))],
        "triggers": [s | {"table_name": "orders", "trigger_name": "t", "tgtype": 2 + 4 + 16, "function_schema": "app", "function_name": "f", "trigger_def": "CREATE TRIGGER t EXECUTE FUNCTION f()"}],
        "view-column-usage": [{"view_schema": "app", "view_name": "v", "table_schema": "app", "table_name": "orders", "column_name": "id"}],
    }
    o = objects(mapping.map_pg(catalog.read_families(spark, write(tmp_path, rows), families.PG), FULL))
    fk = {c.name: c for c in o["table", "items"].constraints}
    assert set(fk) == {"fk", "ck"} and fk["fk"].columns == ["order_id", "col_9"] and fk["fk"].references.columns == ["id", "col_7"] and fk["ck"].columns == []
    assert [(i.name, i["columns"]) for i in o["table", "items"].indexes] == [("ix", ["n"])]
    assert deps(o["view", "v"]) == [("orders", None, "read", "declared", ["id"])] and "materialized" in o["view", "v"].extra
    assert deps(o["function", "f"]) == [("items", None, "write", "parsed", None), ("orders", None, "read", "parsed", None), ("g", "procedure", "read", "parsed", None)]
    assert o["procedure", "g"].has_dynamic_sql and o["function", "h"].has_dynamic_sql is None and o["function", "h"].parameters is None
    assert [(p.direction, p.has_default) for p in o["procedure", "g"].parameters] == [("in", True), ("out", None)]
    assert [p.has_default for p in o["function", "f"].parameters] == [None, True]
    assert (o["trigger", "t"].trigger.timing, o["trigger", "t"].trigger.events, o["trigger", "t"].has_dynamic_sql) == ("BEFORE", ["INSERT", "UPDATE"], None)
    thin = objects(mapping.map_pg(catalog.read_families(spark, str(tmp_path), families.PG)))
    assert thin["function", "f"].dependencies is None


def test_mysql(spark, tmp_path):
    s = {"table_schema": "app"}
    rows = {k: [] for k in families.MYSQL} | {
        "tables": [s | {"table_name": "orders", "table_comment": ""}],
        "columns": [s | {"table_name": "orders", "ordinal_position": 1, "column_name": "id", "column_type": "int", "is_nullable": "NO", "extra": "auto_increment", "column_comment": ""}],
        "pk-uk-columns": [s | {"table_name": "orders", "constraint_name": "PRIMARY", "constraint_type": "PRIMARY KEY", "column_name": "id", "ordinal_position": 1}],
        "statistics": [s | {"table_name": "orders", "index_name": "ix", "non_unique": 1, "seq_in_index": i, "column_name": c, "index_type": "B"} for i, c in ((2, None), (1, "id"))],
        "views": [s | {"table_name": "v", "view_definition": "select `id` from `app`.`orders`"}],
        "routines": [{"routine_schema": "app", "routine_name": "p", "routine_type": "PROCEDURE", "routine_definition": "replace into orders values (1); prepare x from @y", "routine_comment": ""}],
        "parameters": [{"routine_schema": "app", "routine_name": "p", "ordinal_position": i, "parameter_name": n, "parameter_mode": m, "data_type": "int"} for i, n, m in ((0, None, None), (2, "b", None), (1, "a", "INOUT"))],
        "triggers": [{"trigger_schema": "app", "trigger_name": "t", "event_manipulation": "INSERT", "action_timing": "BEFORE", "event_object_table": "orders", "action_statement": "set @a = 1"}],
    }
    o = objects(mapping.map_mysql(catalog.read_families(spark, write(tmp_path, rows), families.MYSQL), FULL))
    t = o["table", "orders"]
    assert t.comment is None and [(c.name, c.nullable, c.comment) for c in t.columns] == [("id", False, None)] and t.constraints[0].type == "PK" and t.indexes[0]["columns"] == ["id"]
    assert deps(o["view", "v"]) == [("orders", None, "read", "parsed", None)] and deps(o["procedure", "p"])[0][2] == "write" and o["procedure", "p"].has_dynamic_sql
    assert [(p.name, p.direction, p.ordinal) for p in o["procedure", "p"].parameters] == [("a", "inout", 1), ("b", "in", 2)]
    assert o["trigger", "t"].trigger.events == ["INSERT"]
    rows = spark.createDataFrame([("auto_increment", None), ("STORED GENERATED", "a+1"), ("", None)], "extra STRING, e STRING").select(mapping.mysql_column_extra(F.col("extra"), F.col("e")).alias("x")).collect()
    assert [r.x and json.loads(r.x) for r in rows] == [{"autoIncrement": True}, {"generated": True, "generationKind": "STORED", "generationExpression": "a+1"}, None]


def test_documents(spark):
    docs = [{"_id": {"$oid": "a"}, "n": 1, "tags": ["x"], "lines": [{"sku": "s", "at": {"$date": "d"}}], "deep": {"er": {"est": None}}, "none": []}, {"_id": {"$oid": "b"}, "n": "one", "lines": [], "ok": True}]
    df = spark.createDataFrame([("orders", json.dumps(d)) for d in docs] + [("system.x", "{}"), ("system.x", '{"a":1}')], "collection STRING, doc STRING")
    fields = sampling.fields(df)
    got = {r["name"]: (r.data_type, r.frequency, r.nullable) for r in fields.where("collection = 'orders'").collect()}
    assert got == {
        "_id": ("objectId", 1.0, False), "n": ("numeric|string", 1.0, False), "tags": ("string[]", 0.5, True), "lines": ("unknown[]", 0.5, True), "lines[].sku": ("string", 0.5, True), "lines[].at": ("date", 0.5, True),
        "deep.er.est": ("null", 0.5, True), "none": ("unknown[]", 0.5, True), "ok": ("bool", 0.5, True),
    }
    indexes = spark.createDataFrame([("orders", "_id_", ["_id"], None), ("orders", "_id_", ["_id"], None), ("orders", "a", ["n", "_id"], True)], "collection STRING, name STRING, keys ARRAY<STRING>, unique BOOLEAN")
    validators = spark.createDataFrame([("orders", '{"$jsonSchema":{"required":["n"],"title":"x"}}')], "collection STRING, validator STRING")
    found = mapping.map_documents("db", fields, indexes, validators)
    o = objects(found)
    assert list(o) == [("collection", "orders")] and [(i.name, i.unique, i["columns"]) for i in o["collection", "orders"].indexes] == [("_id_", False, ["_id"]), ("a", True, ["n", "_id"])]
    assert json.loads(o["collection", "orders"].extra) == {"required": ["n"]}
    g = normalize(found, "mongodb")
    assert g.nodes.where("kind = 'field'").count() == 9 and g.edges.where("kind = 'in_index'").count() == 0
    assert catalog.sample(df, 0).count() == 1 and catalog.sample(df, 3).count() == 3


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "v STRING").select(expr(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    f = lambda v, e: column(spark, v, e)
    assert f("a 'x''y' b 'z'", text.mask_strings) == "a '##MASKED##' b '##MASKED##'" and f("don't", text.mask_strings) == "don't"
    assert f("a /* b\nc */ d -- e\nf", text.strip_comments) == "a   d  \nf"
    assert f("create trigger x begin select 'end'; end; -- ", text.action_part) == "begin select 'end'; end" and f("no block", text.action_part) is None
    assert f("insert into a.b x; merge into m; delete  from d.e", text.write_targets) == ["a.b", "d.e", "into", "m"]
    assert f("x order_items y", lambda c: text.mentions(c, F.lit("dbo.order"))) is False and f("x ORDERS; y", lambda c: text.mentions(c, F.lit("dbo.orders"))) is True
    assert f("a.b(c", lambda c: text.mentions(c, F.lit("a.b(c"))) is True
    assert f("line  \r\n\tend \n", text.normalized_body) == "line\n\tend" and f("", text.normalized_body) == ""
    assert f("customerID", naming.entity).entity == "customer" and f("_id", naming.entity) is None and f("id_x", naming.entity).conv == 0.8 and f("paid", naming.entity) is None
    assert f("categories", naming.candidate_names) == ["categories", "categoriess", "categorieses", "category"] and f("box", naming.candidate_names) == ["box", "boxs", "boxes"]
    assert f("es", naming.candidate_names) == ["es", "ess", "eses", "e"] and f("day", naming.candidate_names) == ["day", "days", "dayes", "daies"]


def test_reading(spark, tmp_path):
    lines = [(1, "JSON_F52E2B61-18A1-11d1-B105-00805F49916B"), (2, "-----"), (4, '"a":1}]'), (3, '[{"'), (5, ""), (6, "(1 row affected)")]
    df = spark.createDataFrame([("t", n, x) for n, x in lines], "family STRING, n INT, line STRING")
    assert catalog.reassemble_chunks(df).first().value == '[{""a":1}]'
    raw = spark.createDataFrame([("1", "5", None), ("false", None, "x")], "b STRING, i STRING, s STRING")
    assert [tuple(r) for r in catalog.checked_rows(raw, "b BOOLEAN, i INT, s STRING, other INT").collect()] == [(True, 5, None, None), (False, None, "x", None)]
    with pytest.raises(Exception, match="malformed"):
        catalog.checked_rows(raw, "s INT").collect()
    (tmp_path / "dump.json").write_text(json.dumps({"tables": [{"table_name": "a", "object_id": 1}], "modules": []}))
    dump = catalog.read_dump(spark, str(tmp_path / "dump.json"), {k: families.MSSQL[k] for k in ("tables", "modules")})
    assert dump["tables"].first().table_name == "a" and dump["modules"].count() == 0
    assert set(families.MSSQL_QUERIES) == set(families.MSSQL) and set(families.PG_QUERIES) == set(families.PG) and set(families.mysql_queries("a'b")) == set(families.MYSQL)
    script = families.dump_script()
    assert all(f"AS [{k}]" in script for k in families.MSSQL) and script.count("FOR JSON PATH") == len(families.MSSQL) + 1
    assert "'a''b'" in families.mysql_queries("a'b")["tables"]
