"""The kinds of objects that a build gives: their id prefix, level and category."""

from __future__ import annotations

# Levels from the whole to single facts, and for each type its prefix, level and category.
LEVELS = {"L3": "project", "L2": "structure", "L1": "code unit", "L0": "audit fact"}
TYPES = {
    "Project": ("proj:", "L3", "Container"), "Domain": ("dom:", "L3", "Container"), "Module": ("mod:", "L2", "Container"), "SourceFile": ("file:", "L2", "Container"),
    "Component": ("comp:", "L1", "CodeUnit"), "Hook": ("hook:", "L1", "CodeUnit"), "Store": ("store:", "L1", "CodeUnit"), "Service": ("svc:", "L1", "CodeUnit"),
    "Interface": ("iface:", "L1", "CodeUnit"), "Class": ("class:", "L1", "CodeUnit"), "Method": ("method:", "L1", "CodeUnit"), "PropEdge": ("prop:", "L1", "CodeUnit"),
    "ScriptFunction": ("fn:", "L1", "CodeUnit"), "Route": ("route:", "L2", "EntryPoint"), "UserScript": ("us:", "L2", "Script"), "Dependency": ("dep:", "L2", "Environment"),
    "GmApiUsage": ("gm:", "L0", "AuditFact"), "InjectionPoint": ("inject:", "L0", "AuditFact"), "NetworkEndpoint": ("net:", "L0", "AuditFact"),
}
