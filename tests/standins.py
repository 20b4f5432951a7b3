"""Engines that stand in for servers: the real catalog statements run on SQLite and DuckDB, with the servers' catalog views as tables."""

import sqlite3

MYSQL = """
CREATE TABLE TABLES (TABLE_SCHEMA, TABLE_NAME, TABLE_TYPE, TABLE_COMMENT);
INSERT INTO TABLES VALUES ('shop', 'teams', 'BASE TABLE', 'who plays'), ('shop', 'people', 'BASE TABLE', ''), ('shop', 'busy', 'VIEW', ''), ('other', 'unseen', 'BASE TABLE', '');
CREATE TABLE COLUMNS (TABLE_SCHEMA, TABLE_NAME, ORDINAL_POSITION, COLUMN_NAME, COLUMN_TYPE, IS_NULLABLE, COLUMN_DEFAULT, EXTRA, GENERATION_EXPRESSION, COLUMN_COMMENT);
INSERT INTO COLUMNS VALUES ('shop', 'teams', 1, 'team_id', 'int', 'NO', NULL, 'auto_increment', '', ''), ('shop', 'people', 1, 'person_id', 'int', 'NO', NULL, '', '', 'key'), ('shop', 'people', 2, 'team_id', 'int', 'YES', '0', '', '', ''), ('other', 'unseen', 1, 'x', 'int', 'YES', NULL, '', '', '');
CREATE TABLE TABLE_CONSTRAINTS (CONSTRAINT_SCHEMA, CONSTRAINT_NAME, TABLE_SCHEMA, TABLE_NAME, CONSTRAINT_TYPE);
INSERT INTO TABLE_CONSTRAINTS VALUES ('shop', 'PRIMARY', 'shop', 'teams', 'PRIMARY KEY'), ('shop', 'PRIMARY', 'shop', 'people', 'PRIMARY KEY'), ('shop', 'fk_team', 'shop', 'people', 'FOREIGN KEY'), ('shop', 'ck', 'shop', 'people', 'CHECK');
CREATE TABLE KEY_COLUMN_USAGE (CONSTRAINT_SCHEMA, CONSTRAINT_NAME, TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, POSITION_IN_UNIQUE_CONSTRAINT, REFERENCED_TABLE_SCHEMA, REFERENCED_TABLE_NAME, REFERENCED_COLUMN_NAME);
INSERT INTO KEY_COLUMN_USAGE VALUES ('shop', 'PRIMARY', 'shop', 'teams', 'team_id', 1, NULL, NULL, NULL, NULL), ('shop', 'PRIMARY', 'shop', 'people', 'person_id', 1, NULL, NULL, NULL, NULL), ('shop', 'fk_team', 'shop', 'people', 'team_id', 1, 1, 'shop', 'teams', 'team_id');
CREATE TABLE REFERENTIAL_CONSTRAINTS (CONSTRAINT_SCHEMA, CONSTRAINT_NAME, DELETE_RULE, UPDATE_RULE);
INSERT INTO REFERENTIAL_CONSTRAINTS VALUES ('shop', 'fk_team', 'CASCADE', 'NO ACTION');
CREATE TABLE CHECK_CONSTRAINTS (CONSTRAINT_SCHEMA, CONSTRAINT_NAME, CHECK_CLAUSE);
INSERT INTO CHECK_CONSTRAINTS VALUES ('shop', 'ck', '(person_id > 0)');
CREATE TABLE STATISTICS (TABLE_SCHEMA, TABLE_NAME, INDEX_NAME, NON_UNIQUE, SEQ_IN_INDEX, COLUMN_NAME, EXPRESSION, SUB_PART, INDEX_TYPE);
INSERT INTO STATISTICS VALUES ('shop', 'people', 'ix_team', 1, 1, 'team_id', NULL, NULL, 'BTREE');
CREATE TABLE VIEWS (TABLE_SCHEMA, TABLE_NAME, VIEW_DEFINITION);
INSERT INTO VIEWS VALUES ('shop', 'busy', 'select person_id from shop.people');
CREATE TABLE ROUTINES (ROUTINE_SCHEMA, ROUTINE_NAME, ROUTINE_TYPE, ROUTINE_DEFINITION, ROUTINE_COMMENT);
INSERT INTO ROUTINES VALUES ('shop', 'tidy', 'PROCEDURE', 'DELETE FROM people', '');
CREATE TABLE PARAMETERS (SPECIFIC_SCHEMA, SPECIFIC_NAME, ORDINAL_POSITION, PARAMETER_NAME, PARAMETER_MODE, DTD_IDENTIFIER);
INSERT INTO PARAMETERS VALUES ('shop', 'tidy', 1, 'how', 'IN', 'int');
CREATE TABLE TRIGGERS (TRIGGER_SCHEMA, TRIGGER_NAME, EVENT_MANIPULATION, ACTION_TIMING, EVENT_OBJECT_TABLE, ACTION_STATEMENT);
INSERT INTO TRIGGERS VALUES ('shop', 'tr', 'INSERT', 'AFTER', 'people', 'UPDATE teams SET team_id = 1');
"""


def mysql(path, password=None):
    """information_schema as an attached file."""
    con = sqlite3.connect(":memory:")
    con.execute(f"ATTACH '{path}' AS information_schema")
    con.create_function("DATABASE", 0, lambda: "shop")
    con.create_function("CONCAT", -1, lambda *a: "".join(map(str, a)))
    return con


def mysql_file(path):
    con = sqlite3.connect(path)
    con.executescript(MYSQL)
    con.close()
    return str(path)


MSSQL = """
CREATE SCHEMA sys;
CREATE TABLE names (k INT, kind VARCHAR, name VARCHAR); INSERT INTO names VALUES (1, 's', 'dbo'), (56, 't', 'int'), (231, 't', 'nvarchar');
CREATE MACRO SCHEMA_NAME(x) AS (SELECT name FROM names WHERE k = x AND kind = 's'); CREATE MACRO TYPE_NAME(x) AS (SELECT name FROM names WHERE k = x AND kind = 't'); CREATE MACRO QUOTENAME(x) AS '[' || x || ']';
CREATE TABLE sys.objects (object_id BIGINT, schema_id INT, name VARCHAR, type VARCHAR, parent_object_id BIGINT, is_ms_shipped INT, modify_date TIMESTAMP);
INSERT INTO sys.objects SELECT *, TIMESTAMP '2026-01-01' FROM (VALUES (1, 1, 'teams', 'U', 0, 0), (2, 1, 'people', 'U', 0, 0), (3, 1, 'busy', 'V', 0, 0), (4, 1, 'broken', 'V', 0, 0), (5, 1, 'tidy', 'P', 0, 0), (6, 1, 'tr', 'TR', 2, 0), (7, 1, 'seq', 'SO', 0, 0), (8, 1, 'o''clock', 'V', 0, 0));
CREATE VIEW sys.tables AS SELECT * FROM sys.objects WHERE type = 'U'; CREATE VIEW sys.views AS SELECT * FROM sys.objects WHERE type = 'V';
CREATE TABLE sys.types (user_type_id INT, name VARCHAR); INSERT INTO sys.types VALUES (56, 'int'), (231, 'nvarchar');
CREATE TABLE sys.columns (object_id BIGINT, column_id INT, name VARCHAR, user_type_id INT, max_length INT, precision INT, scale INT, is_nullable BOOLEAN, is_computed BOOLEAN, default_object_id BIGINT);
INSERT INTO sys.columns VALUES (1, 1, 'team_id', 56, 4, 10, 0, false, false, 0), (2, 1, 'person_id', 56, 4, 10, 0, false, false, 0), (2, 2, 'team_id', 56, 4, 10, 0, true, false, 91), (2, 3, 'name', 231, 80, 0, 0, true, false, 0);
CREATE TABLE sys.computed_columns (object_id BIGINT, column_id INT, definition VARCHAR);
CREATE TABLE sys.default_constraints (object_id BIGINT, definition VARCHAR); INSERT INTO sys.default_constraints VALUES (91, '((0))');
CREATE TABLE sys.key_constraints (name VARCHAR, type VARCHAR, parent_object_id BIGINT, unique_index_id INT); INSERT INTO sys.key_constraints VALUES ('pk_teams', 'PK', 1, 1);
CREATE TABLE sys.index_columns (object_id BIGINT, index_id INT, column_id INT, key_ordinal INT, index_column_id INT, is_included_column BOOLEAN); INSERT INTO sys.index_columns VALUES (1, 1, 1, 1, 1, false), (2, 2, 2, 1, 1, false);
CREATE TABLE sys.indexes (object_id BIGINT, index_id INT, name VARCHAR, is_unique BOOLEAN, is_primary_key INT, is_unique_constraint INT, type_desc VARCHAR, filter_definition VARCHAR); INSERT INTO sys.indexes VALUES (1, 1, 'pk_teams', true, 1, 0, 'CLUSTERED', NULL), (2, 2, 'ix_team', false, 0, 0, 'NONCLUSTERED', NULL);
CREATE TABLE sys.foreign_keys (object_id BIGINT, name VARCHAR, parent_object_id BIGINT, referenced_object_id BIGINT); INSERT INTO sys.foreign_keys VALUES (71, 'fk_team', 2, 1);
CREATE TABLE sys.foreign_key_columns (constraint_object_id BIGINT, constraint_column_id INT, parent_object_id BIGINT, parent_column_id INT, referenced_object_id BIGINT, referenced_column_id INT); INSERT INTO sys.foreign_key_columns VALUES (71, 1, 2, 2, 1, 1);
CREATE TABLE sys.check_constraints (name VARCHAR, parent_object_id BIGINT, definition VARCHAR); INSERT INTO sys.check_constraints VALUES ('ck', 2, '([person_id]>(0))');
CREATE TABLE sys.sql_modules (object_id BIGINT, definition VARCHAR); INSERT INTO sys.sql_modules VALUES (3, 'CREATE VIEW busy AS SELECT person_id FROM dbo.people'), (4, 'CREATE VIEW broken AS SELECT 1 AS x FROM dbo.gone'), (5, 'CREATE PROCEDURE tidy @how int AS DELETE FROM dbo.people'), (6, 'CREATE TRIGGER tr ON people AFTER INSERT AS UPDATE dbo.teams SET team_id = 1'), (8, 'CREATE VIEW [o''clock] AS SELECT name FROM dbo.people');
CREATE TABLE sys.sql_expression_dependencies (referencing_id BIGINT, referenced_id BIGINT, referenced_schema_name VARCHAR, referenced_entity_name VARCHAR); INSERT INTO sys.sql_expression_dependencies VALUES (3, 2, 'dbo', 'people'), (5, 2, 'dbo', 'people'), (6, 1, 'dbo', 'teams'), (8, 2, NULL, 'people');
CREATE TABLE sys.parameters (object_id BIGINT, parameter_id INT, name VARCHAR, user_type_id INT, is_output BOOLEAN, has_default_value BOOLEAN); INSERT INTO sys.parameters VALUES (5, 1, '@how', 56, false, false);
CREATE TABLE sys.triggers (object_id BIGINT, name VARCHAR, parent_id BIGINT, is_instead_of_trigger BOOLEAN); INSERT INTO sys.triggers VALUES (6, 'tr', 2, false);
CREATE TABLE sys.trigger_events (object_id BIGINT, type_desc VARCHAR); INSERT INTO sys.trigger_events VALUES (6, 'INSERT');
CREATE TABLE sys.sequences (schema_id INT, name VARCHAR, user_type_id INT, start_value INT, increment INT, minimum_value INT, maximum_value INT, is_cycling BOOLEAN, is_ms_shipped INT); INSERT INTO sys.sequences VALUES (1, 'seq', 56, 1, 2, 1, 100, false, 0);
CREATE TABLE sys.extended_properties (class INT, major_id BIGINT, minor_id INT, name VARCHAR, value VARCHAR); INSERT INTO sys.extended_properties VALUES (1, 1, 0, 'MS_Description', 'who plays');
CREATE MACRO sys.dm_sql_referenced_entities(a, b) AS TABLE SELECT 'dbo' AS referenced_schema_name, 'people' AS referenced_entity_name, c AS referenced_minor_name, CASE WHEN a = '[dbo].[broken]' THEN error('not bound') ELSE n END AS referenced_minor_id
  FROM (VALUES ('[dbo].[busy]', 'person_id', 1), ('[dbo].[busy]', NULL, 0), ('[dbo].[o''clock]', 'name', 3), ('[dbo].[broken]', 'x', 1)) v(view, c, n) WHERE view = a;
"""


class Mssql:
    """Words of the dialect that DuckDB has under other names are replaced."""

    def __init__(self):
        import duckdb

        self._con = duckdb.connect()
        self._con.execute(MSSQL)

    def cursor(self):
        return self

    def execute(self, sql):
        for a, b in (("NVARCHAR(MAX)", "VARCHAR"), ("CONVERT(VARCHAR(33), MAX(modify_date), 126)", "MAX(modify_date)"), ("N'", "'")):
            sql = sql.replace(a, b)
        self._found = self._con.execute(sql)

    @property
    def description(self):
        return self._found.description

    def fetchmany(self, n):
        return self._found.fetchmany(n)

    def close(self):
        pass


def mssql():
    return Mssql()


class ObjectId(str):
    """As a document driver has it: neither JSON nor a plain string there."""


class Documents:
    def __init__(self, docs):
        self._docs = docs

    def list_collection_names(self):
        return list(self._docs)

    def command(self, name, filter):
        validator = {"$jsonSchema": {"required": ["n"]}} if filter["name"] == "a" else {}
        return {"cursor": {"firstBatch": [{"name": filter["name"], "options": {"validator": validator} if validator else {}}]}}

    def __getitem__(self, name):
        self._name = name
        return self

    def list_indexes(self):
        return [{"name": "_id_", "key": {"_id": 1}}, {"name": "by_n", "key": {"n": 1, "m": -1}, "unique": True}]

    def aggregate(self, stages):
        import datetime
        import decimal

        class Id:  # has the driver's name
            def __str__(self):
                return "65f0"

        Id.__name__ = "ObjectId"
        for d in self._docs[self._name][: stages[0]["$sample"]["size"]]:
            yield d | {"_id": Id(), "at": datetime.datetime(2026, 1, 2), "blob": b"xyz", "price": decimal.Decimal("1.5")}

    def close(self):
        pass


def documents(docs):
    return Documents(docs)
