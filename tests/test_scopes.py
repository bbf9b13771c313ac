"""Forests, scopes, orders and the facts of odd code, against brute force."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import order as O
from graphloom.operators import resolve as R
from graphloom.operators.forest import composed
from graphloom.plans import explore, ontology
from graphloom.sources import facts as X
from graphloom.sources import projects, scan


def test_composed_paths(spark):
    r = random.Random(1)
    parent = {i: (i - 1 if i < 60 else r.randrange(i)) if i % 20 else None for i in range(200)}
    parent |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 999}  # a cycle, a node below it, a parent that isn't there
    rows = [(k, p, [f"s{k}"]) for k, p in parent.items()]
    got = {x.k: (x.parts, x.steps) for x in composed(spark.createDataFrame(rows, "k int, p int, parts array<string>"), ["k"], ["p"], ["parts"]).collect()}
    want = {}
    for k in range(200):
        path, at = [], k
        while at is not None:
            path.append(f"s{at}")
            at = parent[at]
        want[k] = (path[::-1], len(path) - 1)
    assert got == want | {204: (["s204"], 0)}
    assert composed(spark.createDataFrame([], "k int, p int, parts array<string>"), ["k"], ["p"], ["parts"]).count() == 0


def brute_innermost(points, spans):
    out = []
    for g, p in points:
        found = [(low, -high, name) for s, low, high, name in spans if s == g and low <= p < high]
        out.append((g, p, max(found)[2] if found else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_sweeps(spark, width):
    r = random.Random(width)
    spans = []
    for i in range(120):
        low = r.randrange(60)
        spans.append((r.choice("ab"), low, low + r.randrange(-2, 30), i))
    spans = list({(s[0], s[1], s[2]): s for s in spans}.values())
    points = [(r.choice("abc"), r.randrange(-5, 100)) for _ in range(150)] + [(None, 3), ("a", None)]
    p, s = spark.createDataFrame(points, "g string, pos int"), spark.createDataFrame(spans, "g string, low int, high int, span int")
    want = brute_innermost([x for x in points if None not in x], spans)
    got = [tuple(x) for x in R.innermost(p, s, "g", width=width).collect()]
    assert sorted((x for x in got if None not in x[:2]), key=repr) == want and len(got) == len(points)
    every = Counter((g, pos, name) for g, pos in points if None not in (g, pos) for b, low, high, name in spans if b == g and low <= pos < high)
    assert Counter((x.g, x.pos, x.span) for x in R.around(p, s, "g", width=width).collect()) == every


def test_as_of_and_outside(spark):
    r = random.Random(5)
    points = [(r.choice("ab"), r.randrange(50), i) for i in range(100)]
    marks = list({(g, at): (g, at, i) for g, at, i in ((r.choice("ab"), r.randrange(50), i) for i in range(40))}.values())
    p, m = spark.createDataFrame(points, "g string, at int, i int"), spark.createDataFrame(marks, "g string, mark int, v int")
    want = {i: max(((mark, v) for b, mark, v in marks if b == g and mark <= at), default=(0, None))[1] for g, at, i in points}
    assert {x.i: x.v for x in R.as_of(p, m, ["g"], "at", "mark", ["v"]).collect()} == want
    spans = [(r.choice("abc"), low, low + r.randrange(-3, 20)) for low in (r.randrange(50) for _ in range(60))]
    spans += spans[:5]
    got = Counter(map(tuple, R.outside_counts(p.select("g", F.col("at").alias("pos")), spark.createDataFrame(spans, "g string, low int, high int"), "g").collect()))
    inside = lambda g, low, high: sum(b == g and low <= at < high for b, at, _ in points)
    total = Counter(g for g, _, _ in points)
    assert got == Counter((g, low, high, inside(g, low, high), total[g] - inside(g, low, high)) for g, low, high in spans)


def test_follow(spark):
    r = random.Random(6)
    to = {i: r.randrange(80) for i in range(60)} | {i: i + 1 for i in range(100, 160)}
    ends = {70, 71, 5, 160}
    got = {x.id: (x.end, x.steps) for x in G.follow(spark.range(165), spark.createDataFrame(list(to.items()), "src_id bigint, dst_id bigint"), spark.createDataFrame([(e,) for e in ends], "id bigint")).collect()}
    for i in range(165):
        at, n, seen = i, 0, set()
        while at not in ends and at in to and at not in seen:
            seen.add(at)
            at, n = to[at], n + 1
        assert got[i] == ((at, n) if at in ends else (None, None)), i


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_loops_and_tasks_find_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    r = random.Random(9)
    edges = {(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(32)} | {("n1", None)}
    df = spark.createDataFrame(list(edges), "src_id string, dst_id string").where("dst_id is not null")
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(a):
        level, frontier = {a: 0}, [a]
        for step in range(1, 30):
            frontier = [b for b in {b for x in frontier for b in to.get(x, ()) if b} if b not in level]
            level |= dict.fromkeys(frontier, step)
        return level

    far = {f"n{i}": reach(f"n{i}") for i in range(25)}
    groups = {a: {b for b in far[a] if a in far[b]} for a in far}
    assert {x.id: x.component for x in G.strong_components(df).collect()} == {a: min(g) for a, g in groups.items() if len(g) > 1}
    starts = ["n3", "n7", "nowhere"]
    want = {"nowhere": 0}
    for a in starts[:2]:
        for b, n in far[a].items():
            want[b] = min(n, want.get(b, 99))
    assert {x.id: x.level for x in G.levels(df, spark.createDataFrame([(a,) for a in starts], "id string")).collect()} == want


def test_ranks_and_ordered_trees(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    assert {x.v: x.place for x in O.ranked(spark.createDataFrame(rows, "v int").repartition(7), "v").collect()} == {v: v + 1 for v in range(1000)}
    paths = [("b/:id/x",), ("b/a",), ("b",), ("a/c/d",), ("b/:id",), ("b/z/:y/k",), ("b/a",)]
    got = sorted(O.ordered_tree(spark.createDataFrame(paths, "p string"), "p").collect(), key=lambda x: x.place)
    assert [(x.path, x.depth, x.place, x.last, x.n) for x in got] == [
        ("a", 1, 1, 3, 1), ("a/c", 2, 2, 3, 1), ("a/c/d", 3, 3, 3, 1), ("b", 1, 4, 10, 6), ("b/a", 2, 5, 5, 2), ("b/z", 2, 6, 8, 1), ("b/z/:y", 3, 7, 8, 1), ("b/z/:y/k", 4, 8, 8, 1), ("b/:id", 2, 9, 10, 2), ("b/:id/x", 3, 10, 10, 1),
    ]
    assert {x.path for x in O.ordered_tree(spark.createDataFrame(paths, "p string"), "p", depth=1).collect()} == {"a", "b"}


CODE = {
    "src/routes.tsx": "const R = () => <Routes>\n  <Route element={<Shell/>}>\n  <Route path='users' element={<Users/>}>\n    <Route index element={<List/>} />\n    <Route path=':id' element={<One/>}>\n<Route path='edit' element={<Edit/>} /></Route>\n  </Route>\n <Route path='/about' element={<About/>}/></Route></Routes>;\n",
    "src/router.ts": "export default createRouter({ routes: [\n{ path: '/admin', component: Admin, children: [ { path: 'users', component: AdminUsers, children: [\n { path: ':id', name: 'x', component: AdminUser } ] },\n  { path: '', component: AdminHome } ] }, { path: '/plain', meta: { a: { b: 1 } }, component: Plain },\n] });\n",
    "api/routes.go": 'package api\n\nfunc Set(e *gin.Engine) {\n\te.Use(logger)\n\tx := e.Group("/x", auth)\n\ty := x.Group("/y").Use(limit(5))\n\tz := y.Group("/z")\n\tw := z.Group("/w")\n\tw.Use(last)\n\tw.GET("/end", check, Handle)\n\te.POST("/top", Top)\n}\n',
    "src/odd.tsx": "/* one\n two\n three */\nexport function Outer({ a }) {\nconst [n, setN] = useState(0);\n    if (n) {\n}\nreturn <Inner value={n} text={`}${a}{`} />; }\nexport const Second = ({ b }) => (\n<Inner other={b}>\n</Inner>);\nexport const Inner = (p) => <i/>;\n",
    "src/kit/deep.ts": "export interface Shape {\n a: string; }\nexport function helper() { return helper(); }\nexport class Base { run() { go(); } }\n",
    "src/kit/index.ts": "export { Shape as Form, helper } from './deep';\nexport * from './deep';\nexport * from '../loop';\n",
    "src/loop.ts": "export * from './kit';\nexport { nothing } from './loop';\n",
    "src/use.ts": "import { Form, Base as Ground } from './kit';\nexport class Mine extends Ground implements Form {\nrun() { if (x) { y(); } }\n  private stop(n: number): void {\n}\n}\n",
    "src/globs.ts": "const a = import.meta.glob(['./parts/*.ts', '!./parts/skip.ts']);\n",
    "src/parts/one.ts": "export const one = 1;\n",
    "src/parts/skip.ts": "export const skip = 1;\n",
    "src/nav.ts": "const list = [];\nlist.push('/not-a-page');\nconst go = useRouter();\ngo.push('/users');\nconst late = () => { const go = []; };\n",
    "src/broken.ts": "export const bad = '�';\n",
}


@pytest.fixture(scope="module")
def code(spark):
    rows = [(p, p.rsplit(".", 1)[-1], len(t), t) for p, t in CODE.items()]
    return spark.createDataFrame(rows, "path string, ext string, size int, content string")


@pytest.fixture(scope="module")
def facts(code):
    return X.collect(code).cache()


def test_nested_routes(facts):
    got = {(r.path, r.route): (r.component, r.parents) for r in X.router_routes(facts).collect()}
    jsx = {k[1]: v for k, v in got.items() if k[0] == "src/routes.tsx"}
    assert jsx == {"/": ("Shell", []), "/users": ("List", ["Shell", "Users"]), "/users/:id": ("One", ["Shell", "Users"]), "/users/:id/edit": ("Edit", ["Shell", "Users", "One"]), "/about": ("About", ["Shell"])}
    records = {k[1]: v for k, v in got.items() if k[0] == "src/router.ts"}
    assert records == {"/admin": ("AdminHome", ["Admin"]), "/admin/users": ("AdminUsers", ["Admin"]), "/admin/users/:id": ("AdminUser", ["Admin", "AdminUsers"]), "/plain": ("Plain", [])}


def test_groups_four_deep(facts):
    got = {r.route: (r.method, r.handler, r.middlewares) for r in X.go_routes(facts).collect()}
    assert got == {"/x/y/z/w/end": ("GET", "Handle", ["logger", "auth", "limit(5)", "last", "check"]), "/top": ("POST", "Top", ["logger"])}


def test_bodies_of_oddly_indented_code(facts):
    got = {r.name: (r.line, r.line_end) for r in X.functions(facts).where("path = 'src/odd.tsx'").collect()}
    assert got == {"Outer": (4, 8), "Second": (9, 11), "Inner": (12, 12)}
    members = {(r.owner, r.name) for r in X.members(facts).collect()}
    assert members == {("Base", "run"), ("Mine", "run"), ("Mine", "stop")}


def test_graph_of_odd_code(spark, code):
    graph = ontology.build(code)
    edges = {(r.link_type, r.src_id, r.dst_id) for r in graph["edges"].collect()}
    assert {("renders", "comp:Outer", "comp:Inner"), ("renders", "comp:Second", "comp:Inner")} <= edges
    props = {r.src_id: {p.name: p.source for p in r.props} for r in graph["PropEdge"].collect()}
    assert props == {"comp:Outer": {"value": "state", "text": "computed"}, "comp:Second": {"other": "forward"}}
    # renamed and exported again, through a cycle of files
    assert {("extends", "class:src/use.ts#Mine", "class:src/kit/deep.ts#Base"), ("implements", "class:src/use.ts#Mine", "iface:src/kit/deep.ts#Shape")} <= edges
    assert [(r.path, r.error) for r in graph["failed"].collect()] == [("src/broken.ts", "not UTF-8")]
    orphans = {r.path for r in graph["orphans"].collect()}
    assert "src/parts/one.ts" not in orphans and "src/parts/skip.ts" in orphans
    assert {r.target for r in X.navigations(X.collect(code)).collect()} == {"/users"}


def test_props_mean_what_their_own_component_declares(spark):
    text = "export function One() {\n  const [a, setA] = useState(0);\n  return <Box v={a} />;\n}\nexport function Two({ a }) {\n  return <Box v={a} w={b} />;\n}\nexport const Three = () => { const b = useThingStore(); return <Box v={a} w={b} />; };\n"
    got = [(r.name, r.source) for r in X.prop_sites(spark.createDataFrame([("src/a.tsx", "tsx", text)], "path string, ext string, content string")).orderBy("pos", "ord").collect()]
    assert got == [("v", "state"), ("v", "forward"), ("w", "computed"), ("v", "computed"), ("w", "store")]


def test_interpolated_calls(spark):
    text = "fetch(`${BASE}/users/${id}`);\napi.get('/plain');\nclient.post(`/x/${a.b}/y`);\n"
    got = {(r.method, r.url) for r in X.http_calls(spark.createDataFrame([("src/a.ts", "ts", text)], "path string, ext string, content string")).collect()}
    assert got == {("GET", "/users/${id}"), ("GET", "/plain"), ("POST", "/x/${a.b}/y")}


def test_dead_code_by_file(spark):
    files = {
        "src/index.ts": "export const top = 1;\n", "src/a/index.ts": "export function used() {}\nexport function alone() { return alone(); }\nfunction inner() { inner(); }\n",
        "src/b/index.ts": "export function used() {}\nexport function other() {}\n", "src/main.ts": "import { used } from './a';\nimport * as all from './b';\nused();\n",
    }
    rows = [(p, "ts", 1, t) for p, t in files.items()]
    graph = ontology.build(spark.createDataFrame(rows, "path string, ext string, size int, content string"))
    # `import * as all from './b'` exempts that file, not every index file
    assert {(r.path, r.name) for r in graph["unused_exports"].collect()} == {("src/a/index.ts", "alone")}
    dead = {r.id for r in graph["dead"].collect()}
    assert {"method:src/a/index.ts#alone", "method:src/a/index.ts#inner"} <= dead and not {"method:src/a/index.ts#used", "method:src/b/index.ts#other"} & dead


def test_configurations_with_long_strings(spark):
    long = "x" * 1_000_000
    texts = ['{"a": "%s", // note\n "b": ["x,]", "y"],}' % long, '{"a": "%s", "b": [1,\n],/* c */}' % ("\\n" * 300_000)]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scan.plain_json(F.col("t"))).collect()]
    assert got[0] == {"a": long, "b": ["x,]", "y"]} and got[1]["b"] == [1]


def test_props_of_long_attributes(spark):
    text = "export const A = () => <B big={{ " + "k: {v: 1}, " * 60_000 + '}} s="' + "y" * 500_000 + '" last />;\n'
    df = spark.createDataFrame([("src/a.tsx", "tsx", text)], "path string, ext string, content string")
    assert {r.name: r.source for r in X.prop_sites(df).collect()} == {"big": "computed", "s": "literal", "last": "literal"}


def tables_equal(one, two):
    for name in one:
        rows = lambda df: sorted(map(repr, (r.asDict(True) for r in df.select(sorted(df.columns)).collect())))
        assert rows(one[name]) == rows(two[name]), name


def test_refresh_reads_changed_files_alone(spark, tmp_path):
    root, snapshot = tmp_path / "tree", tmp_path / "snapshot"
    for name, text in CODE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "package.json").write_text("{}")
    explore.refresh(spark, str(root), str(snapshot))
    stored = snapshot / "source_facts"
    before = {p: os.stat(p).st_mtime_ns for p in stored.rglob("*.parquet")}
    (root / "src/use.ts").write_text("import { helper } from './kit';\nexport const mine = helper();\n")
    (root / "src/parts/one.ts").unlink()
    (root / "src/parts/two.ts").write_text("export const two = 2;\n")
    again = explore.refresh(spark, str(root), str(snapshot))
    after = {p: os.stat(p).st_mtime_ns for p in stored.rglob("*.parquet")}
    same = {p for p in before if after.get(p) == before[p]}
    # three files changed, so three buckets at most were written anew
    assert len({p.parent for p in before} - {p.parent for p in same}) <= 3 and len(same) >= len(before) - 6
    tables_equal({k: v for k, v in ontology.scan_project(spark, str(root)).items() if k in again}, again)
    files = {r.path for r in again["SourceFile"].collect()}
    assert "src/parts/two.ts" in files and "src/parts/one.ts" not in files


def test_source_roots(spark):
    roots = lambda paths, given=(): scan.source_roots(spark.createDataFrame([(p,) for p in paths], "path string"), given)
    assert roots(["src/a.ts", "server/b.ts"]) == ("src",) and roots(["a.ts"]) == (".",) and roots(["pubspec.yaml", "lib/a.dart", "src/x.ts"]) == ("lib",)
    assert roots(["src/a.ts", "src-tauri/tauri.conf.json", "src-tauri/src/main.rs", "electron/main.ts", "electron/readme.md"]) == ("src", "src-tauri/src", "electron")
    assert roots(["src/a.ts", "web/b.ts", "electron/main.js"], ("web", "none")) == ("web", "electron") and roots(["src/a.ts", "electron/main.js"], (".",)) == (".",)
    assert roots(["src/a.ts", "src-tauri/src/main.rs", "lib/a.dart"]) == ("src",)


def test_aliases_are_read_where_they_are(spark, tmp_path):
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"~/*": ["lib/*"]}}}')
    assert {r.prefix: r.target for r in projects.aliases(spark, str(tmp_path)).collect()} == {"~/": "lib/"}
