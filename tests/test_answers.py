"""JSON answers, the gate for scripts, and the viewer's page."""

import json

import pytest

from lattica.model import GraphError
from lattica.operators.store import GraphStore
from lattica.plans import api, viewer
from tests.fixtures import sqlite_file


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shop")
    store = GraphStore(spark, str(folder / "store"))
    source = api.Source("sqlite", sqlite_file(folder / "shop.db"))
    api.GraphApi(store).sync(source)
    return store


def run(capsys, shop, *command):
    code = api.main(["--store", shop.path, *command])
    return code, capsys.readouterr().out


def test_json_answers_are_stable(capsys, shop):
    code, out = run(capsys, shop, "search", "people", "--json")
    found = json.loads(out)
    assert code == 0 and found["term"] == "people" and found["total"] >= len(found["hits"]) > 0
    assert out == run(capsys, shop, "search", "people", "--json")[1]
    assert run(capsys, shop, "search", "zzzzzzzz", "--json")[0] == 1
    impact = json.loads(run(capsys, shop, "impact", "main.people", "--json")[1])
    assert impact["qname"] == "main.people" and any(c["nodes"][-1] == "main.busy_people" for c in impact["chains"])
    path = json.loads(run(capsys, shop, "path", "main.shifts", "main.teams", "--json")[1])
    assert path["found"] and [h["to"] for h in path["hops"]][-1] == "main.teams"
    assert {n["kind"] for n in json.loads(run(capsys, shop, "object", "main.people", "--json")[1])["neighbors"]} >= {"has_column", "references"}
    assert json.loads(run(capsys, shop, "status", "--json")[1])["counts"]["table"] == 5
    assert json.loads(run(capsys, shop, "diff", "--json")[1]) == {"state": "too_few", "changes": []}


def test_scripts_that_touch_the_graph_fail_the_gate(capsys, shop, tmp_path):
    (tmp_path / "some.sql").write_text("ALTER TABLE main.people ADD COLUMN x INT;")
    (tmp_path / "none.sql").write_text("ALTER TABLE main.nowhere ADD COLUMN x INT;")
    code, out = run(capsys, shop, "affected", str(tmp_path / "some.sql"))
    assert code == 1 and "main.people" in out
    assert run(capsys, shop, "affected", str(tmp_path / "none.sql"))[0] == 0
    assert run(capsys, shop, "affected", str(tmp_path / "gone.sql"))[0] == 2
    assert json.loads(run(capsys, shop, "affected", str(tmp_path / "some.sql"), "--json")[1])["matched"] == [{"qname": "main.people", "kind": "table"}]


def test_sources_that_nothing_can_read(capsys, shop):
    assert run(capsys, shop, "sync", "oracle", "somewhere")[0] == 4


def test_viewer_page(capsys, shop, tmp_path):
    at = tmp_path / "graph.html"
    assert run(capsys, shop, "viz", "--out", str(at))[0] == 0
    text = at.read_text()
    block = json.loads(text.split('type="application/json">')[1].split("</script>")[0].replace("<\\/", "</"))
    assert [n["i"] for n in block["nodes"]] == list(range(len(block["nodes"]))) and {n["kind"] for n in block["nodes"]} == {"table", "view"}
    people = next(n for n in block["nodes"] if n["label"] == "main.people")
    assert people["detail"] == api.GraphApi(shop).object("main.people", "full")
    assert {e["kind"] for e in block["edges"]} >= {"references", "depends_on"} and block["communities"]
    code, out = run(capsys, shop, "viz", "--mermaid")
    assert code == 0 and out.startswith("erDiagram") and '"main.teams" ||--o{ "main.people" : references' in out


@pytest.mark.parametrize("asked", [{"mermaid": True, "full": True}, {"full": True, "columns": True}, {"full": True, "kinds": "table"}, {"kinds": "tables"}, {"kinds": ","}, {"schema": ""}, {"min_degree": "-1"}])
def test_viewer_options_that_make_no_sense(asked):
    with pytest.raises(GraphError):
        viewer.checked_options(**asked)


def test_viewer_options():
    assert viewer.checked_options(kinds="table, view", min_degree="2") == {"full": False, "columns": False, "kinds": ["table", "view"], "min_degree": 2}
