"""Architecture layers of files, by content first and by folder names where content is silent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers in their order of display; folder names that tell a layer.
LAYERS = ("entry", "presentation", "state", "service", "tauri", "electron", "integration", "shared", "types", "config", "script", "test", "mixed")
FOLDERS = {
    "presentation": ("route", "routes", "page", "pages", "views", "screens", "layout", "layouts", "components", "ui", "widgets", "overlay", "overlays", "templates", "presentation"),
    "state": ("store", "stores", "state", "redux", "zustand", "pinia", "global", "globals", "provider", "providers"),
    "service": ("service", "services", "domain", "domains", "business", "usecase", "usecases", "use-case", "use-cases", "engine", "engines"),
    "integration": ("api", "apis", "client", "clients", "http", "network", "gateway", "gateways", "adapter", "adapters", "repositories"),
    "shared": ("hooks", "composables", "utils", "helpers", "lib", "libs", "shared", "common", "tools", "kit", "core"),
    "types": ("type", "types", "models", "interfaces", "schema", "schemas", "typings", "dts"),
    "config": ("config", "configs", "constants", "env", "envs", "settings", "options"),
    "test": ("test", "tests", "__tests__", "e2e", "spec", "specs", "mock", "mocks", "fixture", "fixtures", "testing"),
    "script": ("script", "scripts", "userscript", "userscripts", "monkey", "tampermonkey"),
    "entry": ("entry", "entries", "bootstrap", "startup", "app", "main"),
}
# Folders that tell a layer of Go files, and endings of service files.
GO_FOLDERS = {
    "entry": ("cmd",),
    "presentation": ("router", "routers", "controller", "controllers", "middleware", "middlewares", "handler", "handlers", "api", "apis"),
    "service": ("model", "models", "dal", "dao", "repository", "repositories", "relay", "service", "services", "monitor", "biz", "domain"),
}
SERVICE_ENDINGS = ("Service", "Engine", "Manager", "Repository", "Factory")
ENTRIES = ("App.tsx", "index.tsx", "main.tsx", "index.ts", "main.ts", "main.js", "App.vue", "main.dart", "main.go")


def folder_layer(path: Column) -> Column:
    """The layer of the deepest folder whose name tells one."""
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))

    def named(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for layer, names in reversed(FOLDERS.items()):
            out = F.when(x.isin(*names), layer).otherwise(out)
        return out

    return F.try_element_at(F.array_compact(F.transform(folders, named)), F.lit(1))


def _within(path: Column, names: tuple[str, ...]) -> Column:
    """Whether one of a path's folders has one of the names."""
    folders = F.split(path, "/")
    return F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, names)))


def is_entry(path: Column, roots: tuple[str, ...] = (".", "src", "lib")) -> Column:
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    return F.substring_index(path, "/", -1).isin(*ENTRIES) & (F.endswith(path, F.lit(".go")) | folder.isin(*roots))


def file_layer(path: Column, *, script: Column, test: Column, entry: Column, components: Column, stores: Column, hooks: Column) -> Column:
    """The first rule that holds."""
    go = F.endswith(path, F.lit(".go"))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(user\.js|mjs|cjs|tsx?|jsx?)$", "")
    bare = (components == 0) & (stores == 0)
    rules = [(script, "script"), (test, "test"), (F.endswith(path, F.lit(".rs")) | _within(path, ("src-tauri",)), "tauri"), (_within(path, ("electron",)), "electron")]
    rules += [(go & ((entry if layer == "entry" else F.lit(False)) | _within(path, names)), layer) for layer, names in GO_FOLDERS.items()]
    rules += [(go, "shared"), (F.endswith(path, F.lit(".d.ts")), "types"), (entry, "entry"), ((stores > 0) & (components == 0), "state")]
    ends = reduce(Column.__or__, (F.endswith(stem, F.lit(x)) for x in SERVICE_ENDINGS))
    rules += [(bare & _within(path, FOLDERS["integration"]), "integration"), (bare & (ends | _within(path, ("services",))), "service"), (components > 0, "presentation"), (hooks > 0, "shared")]
    return F.coalesce(*(F.when(test, layer) for test, layer in rules), folder_layer(path), F.lit("shared"))
