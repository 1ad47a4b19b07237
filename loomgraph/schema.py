"""Table schemas and the strings that kinds, tiers and severities may have."""

from __future__ import annotations

NODES = (
    "id long, repo_id long, kind string, subkind string, name string, qualified_name string, file_path string, "
    "start_line int, end_line int, language string, signature string, doc string, exported boolean, meta string, ord long"
)
EDGES = "id long, repo_id long, src long, dst long, kind string, weight double, meta string"
PENDING = "repo_id long, src_node long, name string, kind string"
FILES_STATE = "repo_id long, path string, hash string, size long, mtime long"
REPOS = "id long, name string, root string, head_sha string, indexed_at timestamp"
EXTRACTED = (
    "path string, symbols array<struct<name:string,kind:string,qualified_name:string,start_line:int,end_line:int,"
    "signature:string,doc:string,exported:boolean,parent_name:string>>, refs array<struct<from_symbol:string,name:string,kind:string>>, "
    "imports array<string>, package_name string"
)

# Fixed values.
NODE_KINDS = ("file", "symbol", "commit", "doc", "feature")
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "enum", "struct", "trait", "impl", "variable", "constant", "module")
EDGE_KINDS = ("contains", "calls", "imports", "extends", "implements", "references", "tests", "touched_by", "co_change", "mentions", "in_feature")
IMPACT_KINDS = ("calls", "references", "extends", "implements", "imports")
EXPLORE_KINDS = ("calls", "imports", "contains", "references")
CONTEXT_KINDS = ("calls", "imports", "contains")
CONTAINERS = ("class", "struct", "interface", "trait", "impl")
TYPE_KINDS = ("class", "interface", "enum", "struct", "trait")
TIERS = ("direct", "strong", "weak", "test")
SEVERITIES = ("low", "medium", "high")
