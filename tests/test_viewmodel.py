"""The view model against counts from the tables themselves."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.plans import ontology, viewmodel
from test_ontology import FILES


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(p, p.rsplit(".", 1)[-1], len(t), t) for p, t in FILES.items() if p.rsplit(".", 1)[-1] in ("ts", "tsx", "js", "jsx", "vue", "go", "dart", "rs")]
    return ontology.build(spark.createDataFrame(rows, "path string, ext string, size int, content string"), go_module="example.com/app", project="demo")


def test_view(graph):
    found = viewmodel.view(graph, generated_at="now")
    assert tuple(found) == viewmodel.KEYS and len(found) == 16 and json.dumps(found)
    assert found["domainCount"] == graph["Domain"].count() == len(found["domains"])
    by_name = {d["name"]: d for d in found["domains"]}
    shop = by_name["shop"]["members"]
    assert shop["Route"]["n"] == by_name["shop"]["n_route"] and len(shop["Route"]["names"]) == min(shop["Route"]["n"], viewmodel.LISTED)
    # domains, stores and layers of its own: no views by script roles
    assert found["scriptDomains"] is None and found["scriptDataMap"] is None and found["scriptFlow"] is None
    stores = {s["store"]: s for s in found["dataMap"]}
    assert set(stores) == {r.id for r in graph["Store"].collect()} and stores["store:useCart"]["n_users"] == 1
    assert stores["store:useCart"]["domains"][0] == {"domain": "dom:billing", "n": 1}
    assert sum(r["n"] for r in found["logicFlow"]) == viewmodel.layer_flow(graph).agg(F.sum("n")).first()[0] > 0
    tree = found["routeMap"]
    assert [r["place"] for r in tree] == list(range(1, len(tree) + 1)) and all(r["last"] >= r["place"] for r in tree)
    assert {x["id"] for r in tree for x in r["routes"] or ()} == {r.id for r in graph["Route"].where("kind <> 'command' and route <> '/'").collect()}
    assert found["propFlow"][0]["n_out"] + found["propFlow"][0]["n_in"] >= 1 and found["entities"][0]["n_out"] + found["entities"][0]["n_in"] >= 2
    assert found["quality"]["cycles"] == [["file:src/a.ts", "file:src/b.ts"]] and found["quality"]["n_orphans"] == graph["orphans"].count()
    assert found["blueprint"]["counts"]["Component"] == graph["Component"].count()


def test_view_of_scripts_alone(spark):
    rows = [(p, "js", 1, FILES[p]) for p in FILES if p.endswith(".user.js")]
    graph = ontology.build(spark.createDataFrame(rows, "path string, ext string, size int, content string"))
    found = viewmodel.view(graph)
    assert found["dataMap"] is None and found["routeMap"] is None and found["propFlow"] is None and [e["name"] for e in found["entities"]] == ["App"]
    hubs = {h["path"]: h for h in found["scriptDataMap"]}
    assert {a["name"] for a in hubs["scripts/demo.user.js"]["apis"]} == {"GM_getValue", "GM_setValue"}
    roles = {r["role"]: r["n"] for r in viewmodel.script_domains(graph).collect()}
    assert sum(roles.values()) == graph["ScriptFunction"].count()
    assert {(r.from_role, r.to_role): r.n for r in viewmodel.script_flow(graph).collect()} == {("logic", "render"): 1, ("render", "data"): 1}
    # scripts/ isn't a folder with a domain of its own or it is: then roles aren't shown
    assert (found["scriptDomains"] is None) == (found["domainCount"] > 0 or len(roles) < 2)
