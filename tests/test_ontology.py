import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import links as L
from graphloom.plans import explore, ontology, report
from graphloom.plans.types import LEVELS, TYPES
from graphloom.sources import facts, projects
from graphloom.sources.scan import read_manifests, read_sources

FILES = {
    "package.json": json.dumps({"dependencies": {"react": "^18", "unused": "1"}, "devDependencies": {"vite": "5"}}),
    "pubspec.yaml": "name: app\ndependencies:\n  provider: ^6.0.0\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: 1.0.0\n",
    "go.mod": "module example.com/app\n\ngo 1.22\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n)\nexclude (\n\tgithub.com/x/y v1.0.0\n)\n",
    "src/main.tsx": "import React from 'react';\nimport { HomePage } from './pages/HomePage';\nimport './a';\nexport default function Root() { return <HomePage title='x' />; }\n",
    "src/pages/HomePage.tsx": "import { Card } from '@/components/Card';\nimport { useThing } from '../hooks/useThing';\nimport lodash from 'lodash';\nexport function HomePage() { return <Card/>; }\nexport const load = () => fetch('/api/user/7?x=1');\nexport const other = () => api.post('/nowhere/at/all');\n",
    "src/components/Card.tsx": "// import { x } from './nothing';\nexport const Card = () => <div/>;\n",
    "src/hooks/useThing.ts": "import type { Storage } from '../types/storage';\nexport function useThing(s: Storage) { return s; }\n",
    "src/types/storage.ts": "export interface Storage {\n  get(key: string): string;\n}\nexport class Memory implements Storage {\n  get(key: string): string { return key; }\n}\nexport class Cache extends Memory {\n  get(key: string): string { return key; }\n}\n",
    "src/stores/cart.ts": "import { create } from 'zustand';\nexport const useCart = create((set) => ({}));\n",
    "src/App.jsx": "import { HomePage } from './pages/HomePage';\nimport { Shop } from './Shop';\nexport const Routes = () => <><Route path='/' element={<HomePage/>} /><Route path=\"shop/:id\" element={<Shop/>} /></>;\n",
    "src/Shop.tsx": "import { Badge } from './Badge';\nexport function Shop({ title, id }) {\n  const [count, setCount] = useState(0);\n  const items = useCartStore();\n  const go = () => navigate('/');\n  return <div><Badge title={title} count={count} items={items} onClick={go} max={3} label=\"x\" sum={count + 1} {...rest} /><Badge title=\"fixed\" disabled /></div>;\n}\n",
    "src/Badge.tsx": "export const Badge = (p) => <b/>;\n",
    "cmd/root.go": "package main\n\nvar rootCmd = &cobra.Command{\n\tUse: \"app\",\n}\nvar serveCmd = &cobra.Command{\n\tUse: \"serve [port]\",\n}\nvar fastCmd = &cobra.Command{Use: \"fast\"}\n\nfunc init() {\n\trootCmd.AddCommand(serveCmd)\n\tserveCmd.AddCommand(fastCmd)\n}\n",
    "src/a.ts": "import { b } from './b';\nexport const a = () => b;\n",
    "src/b.ts": "import { a } from './a.js';\nexport const b = () => a;\n",
    "src/utils/lonely.ts": "export function neverUsed() { return 1; }\n",
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "$types": ["./src/types/storage.ts"],},},\n  "references": [{"path": "./tsconfig.node.json"}]\n}',
    "tsconfig.node.json": '{"compilerOptions": {"paths": {"~node/*": ["tools/*"], "@/*": ["wrong/*"]}}}',
    "vite.config.ts": "export default { resolve: { alias: { '#lib': path.resolve(__dirname, './src/lib'), }, } }",
    "index.html": '<script type="module" src="/src/boot.ts"></script>',
    "src/boot.ts": "export const boot = 1;\n",
    "src/features/billing/InvoicePage.tsx": "import { useCart } from '../../stores/cart';\nimport { useThing } from '@/hooks/useThing';\nexport function InvoicePage() { return <b/>; }\n",
    "src/services/PriceService.ts": "export class PriceService {}\nexport const unusedPrice = 1;\nexport function price() { return 2; }\n",
    "src/views/shop/Detail.vue": "<template><b/></template>\n<script>\nexport default {\n  meta: { title: 'Shop detail' },\n  methods: {\n    async save() {\n      if (this.x) {\n        run();\n      }\n    },\n    close() {},\n  },\n}\n</script>\n",
    "src/plugins/one.ts": "export const one = 1;\n",
    "src/load.ts": "const all = import.meta.glob('./plugins/*.ts');\nimport { price } from './services/PriceService';\n",
    "model/user.go": "package model\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) Save() error {\n\treturn u.check()\n}\n",
    "model/user_check.go": "package model\n\nfunc (u *User) check() error {\n\treturn validate(u.Name)\n}\n\nfunc validate(s string) error {\n\treturn nil\n}\n\nfunc forgotten() {\n}\n",
    "handler/user.go": 'package handler\n\nimport "example.com/app/model"\n\nfunc Create() {\n\tmodel.NewUser("x")\n\tlocalHelp()\n}\n\nfunc localHelp() {\n}\n',
    "model/new.go": "package model\n\nfunc NewUser(name string) *User {\n\treturn &User{Name: name}\n}\n",
    "src-tauri/src/db/mod.rs": "pub struct Pool {}\n",
    "src-tauri/src/cmd.rs": "use crate::db::Pool;\nuse super::lib::Dot;\nuse serde::Serialize;\npub fn run() {}\n",
    "lib/api.dart": "class Api {\n  static void send(String x) {\n    log(x);\n  }\n}\nvoid log(String x) {\n  print(x);\n}\n",
    "lib/caller.dart": "import 'api.dart';\nclass Caller {\n  void go() {\n    Api.send('x');\n    HomeView();\n    again();\n  }\n  void again() {\n  }\n}\n",
    "scripts/big.user.js": "// ==UserScript==\n// @name Big\n// @grant GM_setValue\n// @connect ok.com\n// ==/UserScript==\nconst box = document.querySelector('#box');\nclass App {\n  constructor() {\n    this.draw();\n  }\n  draw() {\n    box.innerHTML = `<b>${name}</b>`;\n    load();\n  }\n}\nfunction load() {\n  GM_xmlhttpRequest({ url: 'https://bad.com/x' });\n  GM_setValue('k', 1);\n}\nfunction forgotten() {\n  return 1;\n}\nwindow.fetch = function () {};\nconst app = new App();\napp.draw();\ndocument.body.appendChild(box);\n",
    "app/layout.tsx": "export default function Layout() { return null; }\n",
    "app/(shop)/layout.tsx": "export default function Layout() { return null; }\n",
    "src/store/index.js": "import Vuex from 'vuex';\nexport default new Vuex.Store({ state: {} });\n",
    "src/overlays/overlayGroups.ts": "import { Shop } from '../Shop';\nexport const groups = [{ id: 'shop-detail', component: Shop }];\n",
    "api/users.go": "package api\n\nfunc GetUser(c *gin.Context) {\n}\n",
    ".git/HEAD": "ref: refs/heads/main\n",
    ".git/refs/heads/main": "0123456789abcdef0123456789abcdef01234567\n",
    "node_modules/x/index.ts": "export const hidden = 1;\n",
    "src/views/tool/build/x.ts": "export const kept = 1;\n",
    "app/(shop)/cart/[id]/page.tsx": "export default function Page() { return null; }\n",
    "app/api/items/route.ts": "export async function GET() {}\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"example.com/app/router"\n\t"github.com/gin-gonic/gin"\n)\n\nfunc main() { router.Set(gin.Default()) }\n',
    "router/router.go": 'package router\n\nimport (\n\t"example.com/app/api"\n\t"github.com/gin-gonic/gin"\n)\n\nfunc Set(r *gin.Engine) {\n\tgroup := r.Group("/api")\n\tuser := group.Group("/user")\n\tuser.GET("/:id", auth, api.GetUser)\n}\n',
    "src-tauri/src/lib.rs": "pub trait Shape: Clone {}\npub struct Dot { x: i32 }\nimpl Shape for Dot {}\npub fn area() -> i32 { 1 }\n",
    "lib/home.dart": "import 'package:flutter/material.dart';\nclass HomeView extends StatelessWidget {\n  Widget build(BuildContext c) { return Text('x'); }\n}\n",
    "scripts/demo.user.js": "// ==UserScript==\n// @name  Demo\n// @match https://a.com/*\n// @grant GM_getValue\n// @connect api.a.com\n// ==/UserScript==\nGM_getValue('k'); GM_addStyle('x'); GM.setValue('k', 1);\nGM_xmlhttpRequest({ url: 'https://api.a.com/v1', method: 'GET' });\nfetch('https://other.com/x'); fetch(target);\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def graph(spark, root):
    sources = read_sources(spark, root)
    assert sources.count() > 20
    return ontology.scan_project(spark, root, name="demo")


def pairs(graph, link):
    return {(r.src_id, r.dst_id) for r in graph["edges"].where(F.col("link_type") == link).collect()}


def test_scan_skips_folders(spark, root):
    paths = {r.path for r in read_sources(spark, root).collect()}
    assert paths == {p for p in FILES if p.rsplit(".", 1)[-1] in ("ts", "tsx", "js", "jsx", "vue", "go", "rs", "dart") and not p.startswith("node_modules")}
    assert {r.path for r in read_sources(spark, root, ("router", "cmd")).collect()} == {"router/router.go", "cmd/main.go", "cmd/root.go"}


def test_manifests(spark, root):
    got = {r.name: (r.version, r.source) for r in read_manifests(spark, root).collect()}
    assert got == {"react": ("^18", "npm"), "unused": ("1", "npm"), "vite": ("5", "npm"), "provider": ("^6.0.0", "pub"), "flutter": ("", "pub"), "test": ("1.0.0", "pub"), "github.com/gin-gonic/gin": ("v1.9.0", "go")}


def test_imports_resolve(graph):
    f = lambda a, b: (f"file:{a}", f"file:{b}")
    want = {
        f("src/main.tsx", "src/pages/HomePage.tsx"), f("src/main.tsx", "src/a.ts"), f("src/pages/HomePage.tsx", "src/components/Card.tsx"),
        f("src/pages/HomePage.tsx", "src/hooks/useThing.ts"), f("src/hooks/useThing.ts", "src/types/storage.ts"), f("src/a.ts", "src/b.ts"),
        f("src/b.ts", "src/a.ts"), f("cmd/main.go", "router/router.go"), f("src/App.jsx", "src/pages/HomePage.tsx"), f("src/App.jsx", "src/Shop.tsx"), f("src/Shop.tsx", "src/Badge.tsx"),
        f("src/features/billing/InvoicePage.tsx", "src/stores/cart.ts"), f("src/features/billing/InvoicePage.tsx", "src/hooks/useThing.ts"), f("src/load.ts", "src/services/PriceService.ts"),
        f("router/router.go", "api/users.go"), f("src/overlays/overlayGroups.ts", "src/Shop.tsx"), f("handler/user.go", "model/user.go"), f("handler/user.go", "model/user_check.go"), f("handler/user.go", "model/new.go"), f("src-tauri/src/cmd.rs", "src-tauri/src/db/mod.rs"), f("src-tauri/src/cmd.rs", "src-tauri/src/lib.rs"), f("lib/caller.dart", "lib/api.dart"),
    }
    found = pairs(graph, "imports")
    assert {p for p in found if p[1].startswith("file:")} == want
    packages = {r.name: (r.source, r.used) for r in graph["Dependency"].collect()}
    assert packages["lodash"] == ("undeclared", True) and packages["unused"] == ("npm", False) and packages["github.com/gin-gonic/gin"] == ("go", True)


def test_types_and_overrides(graph):
    at = "src/types/storage.ts"
    assert pairs(graph, "implements") == {(f"class:{at}#Memory", f"iface:{at}#Storage")}
    assert (f"class:{at}#Cache", f"class:{at}#Memory") in pairs(graph, "extends")
    assert pairs(graph, "overrides") == {(f"method:{at}#Memory#get", f"method:{at}#Storage#get"), (f"method:{at}#Cache#get", f"method:{at}#Memory#get")}
    assert {r.name for r in graph["Interface"].collect()} == {"Storage", "Shape"}


def test_single_file_components_are_classes(graph):
    assert {r.id for r in graph["Class"].collect() if r.kind == "component"} == {"vclass:Detail"}
    assert {b for a, b in pairs(graph, "contains") if a == "vclass:Detail"} == {"vmethod:Detail.save", "vmethod:Detail.close"}


def test_units_and_layers(graph):
    layers = {r.path: r.layer for r in graph["SourceFile"].collect()}
    assert layers["src/main.tsx"] == "entry" and layers["src/stores/cart.ts"] == "state" and layers["src/pages/HomePage.tsx"] == "presentation"
    assert layers["src/hooks/useThing.ts"] == "shared" and layers["src-tauri/src/lib.rs"] == "tauri" and layers["router/router.go"] == "presentation" and layers["scripts/demo.user.js"] == "script"
    assert {r.name: r.kind for r in graph["Component"].collect()}["HomePage"] == "page"
    assert ("comp:HomePage", "comp:Card") in pairs(graph, "renders")
    assert {(r.name, r.provider) for r in graph["Store"].collect()} == {("useCart", "zustand"), ("store", "vuex")} and "hook:useThing" in {r.id for r in graph["Hook"].collect()}
    assert {(r.name, r.pattern) for r in graph["Service"].collect()} == {("PriceService", "class")}
    modules = {r.id: r for r in graph["Module"].collect()}
    assert modules["mod:src"].n_files == sum(p.startswith("src/") for p in FILES) and modules["mod:src/features/billing"].units == {"component": 1}
    assert modules["mod:model"].n_imported == 3 and modules["mod:src/pages"].summary.startswith("presentation: 1 file")


def test_routes_and_calls(graph):
    routes = {r.id: (r.kind, r.domain) for r in graph["Route"].collect()}
    written = {"route:/": ("jsx", "root"), "route:/shop/:id": ("jsx", "shop")}
    assert {k: v for k, v in routes.items() if v[0] != "command"} == {"route:/cart/:id": ("page", "cart"), "route:/api/items": ("api", "items"), "route:GET /api/user/:id": ("http", "user"), "route:/shop/Detail": ("vue-file", "shop"), "route:/shop-detail": ("overlay", "shop-detail"), **written}
    by_id = {r.id: r for r in graph["Route"].collect()}
    assert by_id["route:/cart/:id"].layouts == ["app/layout.tsx", "app/(shop)/layout.tsx"] and by_id["route:GET /api/user/:id"].handler_id == "method:api/users.go#GetUser"
    assert {k for k, v in routes.items() if v[0] == "command"} == {"route:go-cli:app", "route:go-cli:app serve", "route:go-cli:app serve fast"}
    assert ("route:/shop/:id", "comp:Shop") in pairs(graph, "registers") and pairs(graph, "navigatesTo") == {("route:/shop/:id", "route:/"), ("route:/shop-detail", "route:/")}
    assert {(r.path, r.route_id) for r in graph["frontend_calls"].collect()} == {("src/pages/HomePage.tsx", "route:GET /api/user/:id")}
    assert "/nowhere/at/all" in {r.url for r in graph["unmatched"].collect()}


def test_prop_edges(graph):
    got = {(r.src_id, r.dst_id): {p.name: p.source for p in r.props} for r in graph["PropEdge"].collect()}
    want = {"title": "forward", "count": "state", "items": "store", "onClick": "handler", "max": "literal", "label": "literal", "sum": "computed", "...rest": "spread", "disabled": "literal"}
    assert got[("comp:Shop", "comp:Badge")] == want


def test_analytics(graph):
    assert [r.members for r in graph["cycles"].collect()] == [["file:src/a.ts", "file:src/b.ts"]]
    assert "src/utils/lonely.ts" in {r.path for r in graph["orphans"].collect()}
    assert "method:src/utils/lonely.ts#neverUsed" in {r.id for r in graph["dead"].collect()}
    assert {(r.id, r.level) for r in ontology.impact(graph["edges"], "file:src/types/storage.ts").collect()} == {("file:src/hooks/useThing.ts", 1), ("file:src/pages/HomePage.tsx", 2), ("file:src/main.tsx", 3), ("file:src/App.jsx", 3), ("file:src/features/billing/InvoicePage.tsx", 2)}
    assert [r.dst_id for r in L.follow(graph["edges"], "contains", "mod:src/hooks").collect()] == ["file:src/hooks/useThing.ts"]
    with pytest.raises(ValueError, match="unknown link type"):
        L.follow(graph["edges"], "nothing", "x")


def test_user_scripts(spark, root, graph):
    sources = read_sources(spark, root)
    api = {r.name: (r.kind, r.n, r.declared) for r in facts.script_api_calls(sources).where("path like '%demo%'").collect()}
    assert api == {"GM_getValue": ("storage", 1, True), "GM_addStyle": ("style", 1, False), "GM_setValue": ("storage", 1, False), "GM_xmlhttpRequest": ("network", 1, False)}
    assert {r.domain: r.allowed for r in facts.script_endpoints(sources).where("path like '%demo%'").collect()} == {"api.a.com": True, "other.com": False, "(dynamic)": None}
    got = {r.name: r for r in graph["UserScript"].collect()}
    assert got["Demo"].matches == ["https://a.com/*"] and got["Big"].risk_level == "high"


def test_user_script_chains(graph):
    at = "scripts/big.user.js"
    functions = {r.name: r for r in graph["ScriptFunction"].where(F.col("path") == at).collect()}
    assert set(functions) == {"App.constructor", "App.draw", "load", "forgotten"}
    assert {n for n, r in functions.items() if r.dead} == {"forgotten"}
    assert functions["load"].roles == ["data", "state"] and functions["App.draw"].roles == ["render"] and functions["forgotten"].roles == ["logic"]
    fn = lambda a, b: (f"fn:{at}#{a}", f"fn:{at}#{b}")
    assert {p for p in pairs(graph, "calls") if p[0].startswith("fn:")} == {fn("App.constructor", "App.draw"), fn("App.draw", "load")}
    injected = {(r.kind, r.target): (r.interpolated, r.fns) for r in graph["InjectionPoint"].where(F.col("path") == at).collect()}
    assert injected[("inner-html", "#box")] == (True, ["App.draw"]) and ("mount", "document.body") in injected
    assert [(r.kind, r.domain, r.allowed) for r in graph["NetworkEndpoint"].where(F.col("path") == at).collect()] == [("gm-xhr", "bad.com", False)]
    kinds = {(r.kind, r.severity) for r in graph["risks"].where(F.col("path") == at).collect()}
    assert {("fetch-hijack", "high"), ("html-injection", "medium"), ("undeclared-gm-api", "medium"), ("unlisted-connect-domain", "medium")} <= kinds
    assert {d for _, d in pairs(graph, "usesGmApi") if d.startswith("gm:scripts/big")} == {f"gm:{at}#GM_setValue", f"gm:{at}#GM_xmlhttpRequest"}


def test_links_go_both_ways(graph):
    for one, other in L.INVERSE.items():
        assert pairs(graph, one) and {(b, a) for a, b in pairs(graph, one)} == pairs(graph, other), one
    for link in L.TWO_WAY:
        found = pairs(graph, link)
        assert found and found == {(b, a) for a, b in found}, link
    assert ("comp:InvoicePage", "store:useCart") in pairs(graph, "usesStore") and ("hook:useThing", "file:src/features/billing/InvoicePage.tsx") in pairs(graph, "usesHook")
    assert {r.dst_id for r in L.follow(graph["edges"], "importedBy", "file:src/stores/cart.ts").collect()} == {"file:src/features/billing/InvoicePage.tsx"}


def test_calls(graph):
    m = lambda a, b: (f"method:{a}", f"method:{b}")
    got = {p for p in pairs(graph, "calls") if p[0].startswith("method:")}
    assert got == {
        m("model/user.go#User#Save", "model/user_check.go#User#check"), m("model/user_check.go#User#check", "model/user_check.go#validate"), m("handler/user.go#Create", "model/new.go#NewUser"),
        m("handler/user.go#Create", "handler/user.go#localHelp"), m("cmd/main.go#main", "router/router.go#Set"), m("lib/api.dart#Api#send", "lib/api.dart#log"), m("lib/caller.dart#Caller#go", "lib/api.dart#Api#send"),
        m("lib/caller.dart#Caller#go", "lib/caller.dart#Caller#again"), ("method:lib/caller.dart#Caller#go", "comp:HomeView"),
    }
    assert ("class:model/user.go#User", "method:model/user_check.go#User#check") in pairs(graph, "contains")


def test_domains_and_project(graph):
    domains = {r.name: r for r in graph["Domain"].collect()}
    assert {"billing", "shop", "cart"} <= set(domains) and not {"src", "components", "root"} & set(domains)
    assert domains["shop"].n_route == 2 and domains["shop"].capability == "Shop detail" and domains["shop"].sources == ["route", "module"]
    assert ("comp:InvoicePage", "dom:billing") in pairs(graph, "belongsTo") and ("dom:billing", "mod:src/features/billing") in pairs(graph, "belongsTo")
    row = graph["Project"].first()
    assert (row.id, row.framework, row.style, row.n_cycles) == ("proj:demo", "flutter", "layered-spa", 1) and {"vite", "gin", "provider", "tauri"} <= set(row.variants)
    assert "1 cycle" in row.health and ("proj:demo", "dom:billing") in pairs(graph, "contains")


def test_aliases_and_modules(spark, root):
    assert {r.prefix: r.target for r in projects.aliases(spark, root).collect()} == {"@/": "src/", "$types": "src/types/storage.ts", "~node/": "tools/", "#lib/": "src/lib/"}
    assert [(r.module, r.version, r.main) for r in projects.go_modules(spark, root).collect()] == [("example.com/app", "1.22", True)]
    assert {r.path for r in projects.html_entries(spark, root).collect()} == {"src/boot.ts"}
    assert projects.git_head(spark, root).collect() == [("main", "0123456789abcdef0123456789abcdef01234567")]
    paths = spark.createDataFrame([(p,) for p in FILES], "path string")
    assert {r.path for r in projects.host_configs(paths).collect()} == {"package.json", "pubspec.yaml", "go.mod", "tsconfig.json", "tsconfig.node.json", "vite.config.ts"}
    named = spark.createDataFrame([("src/views/shop/index.vue",), ("src/views/[...rest].vue",), ("src/user-card.vue",)], "path string")
    assert [(r[0], r[1]) for r in named.select(T.component_name(F.col("path")), T.module_layer(F.col("path"))).collect()] == [("Shop", "views"), ("All", "views"), ("UserCard", "src")]


def test_dead_code_exemptions(graph):
    orphans = {r.path for r in graph["orphans"].collect()}
    assert not {"src/boot.ts", "src/plugins/one.ts"} & orphans
    dead = {r.id for r in graph["dead"].collect()}
    assert {"method:model/user_check.go#forgotten", "fn:scripts/big.user.js#forgotten"} <= dead and not {"method:model/user_check.go#validate", "method:model/new.go#NewUser"} & dead
    assert {(r.path, r.name) for r in graph["unused_exports"].collect()} >= {("src/services/PriceService.ts", "PriceService")}


def test_report(spark, graph, tmp_path):
    found = report.summary(graph)
    text = report.markdown(found)
    assert "## Cycles" in text and "file:src/a.ts, file:src/b.ts" in text and len(found) > 30
    assert "</script><" not in report.page_json({"x": [{"y": "</script><b>"}]})
    assert report.page(found).startswith("<!DOCTYPE html>")
    assert report.text_table([{"a": "x" * 50, "b": None}, {"a": "y", "b": 2}]).split("\n")[1].startswith("x" * 39 + "…") and report.text_table([]) == "(no rows)"
    report.save({"edges": graph["edges"]}, str(tmp_path))
    assert report.load(spark, str(tmp_path), ["edges"])["edges"].count() == graph["edges"].count()
    with pytest.raises(report.NoSnapshot):
        report.load(spark, str(tmp_path / "nothing"))


def test_explore(spark, graph, tmp_path):
    assert [r.id for r in explore.find(graph, "Component", "kind=page,name~home").collect()] == ["comp:HomePage"]
    with pytest.raises(ValueError, match="unknown type"):
        explore.find(graph, "Nothing")
    assert {r.id for r in explore.by_keyword(graph["Method"], "USER", ("name",)).collect()} == {"method:model/new.go#NewUser", "method:api/users.go#GetUser"}
    wanted = spark.createDataFrame([("file:src/a.ts",), ("Component:HomePage",), ("src/b.ts",), ("nothing",)], "query string")
    got = {r.query: r.id for r in explore.look_up(explore.named(graph), wanted).collect()}
    assert got == {"file:src/a.ts": "file:src/a.ts", "Component:HomePage": "comp:HomePage", "src/b.ts": "file:src/b.ts", "nothing": None}
    one = explore.details(graph, "store:useCart")
    assert one["type"] == "Store" and {"link_type": "usesStore", "other": "comp:InvoicePage"} in one["links"] and explore.details(graph, "store:none") is None
    assert {r.kind for r in explore.dead(graph).collect()} == {"file", "export", "function", "script", "type"}
    assert {r.type: r.level for r in explore.stats(graph).collect()}.keys() == TYPES.keys()
    assert {(r.by, r.value) for r in explore.tallies(graph).collect()} >= {("ext", "go"), ("kind", "Method"), ("calls", "other language")}
    shop = graph["Component"].where("id = 'comp:Shop'").first()
    assert (shop.n_props_out, shop.n_props_in) == (1, 0)
    assert {(r.name, r.n) for r in graph["top_calls"].collect()} == {("App.constructor", 1), ("App.draw", 1)}
    explore.annotate(spark, str(tmp_path), "store:useCart", "look at this")
    explore.annotate(spark, str(tmp_path), "store:useCart", "again", reviewed=True)
    row = explore.with_notes(spark, str(tmp_path), graph["Store"]).where("id = 'store:useCart'").first()
    assert row.notes == "look at this\nagain" and row.reviewed


def test_every_type_has_one_level_and_category():
    assert {level for _, level, _ in TYPES.values()} <= set(LEVELS) and len({p for p, *_ in TYPES.values()}) == len(TYPES) == 19


def test_one_file_and_refresh(spark, root, tmp_path):
    alone = explore.analyse_file(spark, root, "src/types/storage.ts")
    assert {r.id for r in alone["SourceFile"].collect()} == {"file:src/types/storage.ts"} and alone["Class"].count() == 2
