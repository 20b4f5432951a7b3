"""A small shop schema, by hand: raw objects, and row families of each engine."""

import sqlite3

DDL = """
CREATE TABLE teams (team_id INTEGER PRIMARY KEY, title TEXT NOT NULL UNIQUE, budget REAL DEFAULT 0.0);
CREATE TABLE people (person_id INTEGER PRIMARY KEY, full_name TEXT NOT NULL, mail TEXT, team_id INTEGER NOT NULL, FOREIGN KEY (team_id) REFERENCES teams(team_id));
CREATE TABLE shifts (day TEXT, person_id INTEGER, team_id INTEGER, hours INTEGER, PRIMARY KEY (day, person_id), FOREIGN KEY (person_id, team_id) REFERENCES people(person_id, team_id));
CREATE TABLE log_lines (line_id INTEGER PRIMARY KEY, said TEXT);
CREATE TABLE lonely (a INTEGER, b INTEGER, PRIMARY KEY (b, a)) WITHOUT ROWID;
CREATE INDEX ix_people_team ON people(team_id);
CREATE UNIQUE INDEX ux_people_mail ON people(mail);
CREATE INDEX ix_people_lower ON people(lower(mail));
CREATE INDEX ix_people_some ON people(team_id, mail) WHERE mail IS NOT NULL;
CREATE VIEW busy_people AS SELECT p.full_name FROM people p JOIN shifts s ON s.person_id = p.person_id;
CREATE VIEW team_sizes AS SELECT team_id, count(*) AS n FROM people GROUP BY team_id /* not from log_lines */;
CREATE TRIGGER tr_people_added AFTER INSERT ON people BEGIN INSERT INTO log_lines(said) VALUES ('added; update teams'); END;
CREATE TRIGGER tr_people_moved BEFORE UPDATE OF team_id ON people BEGIN UPDATE teams SET budget = budget - 1 WHERE team_id = OLD.team_id; END;
CREATE TRIGGER tr_busy INSTEAD OF DELETE ON busy_people BEGIN DELETE FROM people WHERE full_name = OLD.full_name; END;
"""


def sqlite_file(path):
    con = sqlite3.connect(path)
    con.executescript(DDL)
    con.close()
    return str(path)
