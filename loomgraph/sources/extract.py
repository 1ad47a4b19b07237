"""Symbols, references and imports of source files, statement by statement in DataFrame expressions.

A declaration is a statement of a known form whose block, if it opens one, ends where its bracket or
indent does; members are those whose block is a container's. All of it is windows and equality
joins over statements (sources.statements), linear in a file's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.statements import family, statements

__all__ = ["family", "imports", "packages", "references", "statements", "symbols"]

NAME = r"([A-Za-z_$][\w$]*)"
EXPORT = r"^(?:export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?"
MODIFIERS = r"^(?:(?:public|protected|private|static|final|abstract|synchronized|default|native|transient|volatile|strictfp|sealed) )*"
TYPE = r"(?:[\w.$]+(?:<[^;{(=]*>)?(?: ?\[ ?\])* )"
PUB = r"^(?:pub(?: ?\([^)]*\))? )?"
ARROW = r"[^=]*=\s*(?:async )?(?:function\b|(?:<[^>]*>)?\([^=]*\)[^=]*=>|[\w$]+ ?=>)"

# For each language (kind, pattern of a declaration with its name, level: top, member or any).
DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "script": [
        ("function", EXPORT + r"function ?\*? ?" + NAME, "top"),
        ("class", EXPORT + r"class " + NAME, "top"),
        ("interface", EXPORT + r"interface " + NAME, "top"),
        ("enum", EXPORT + r"(?:const )?enum " + NAME, "top"),
        ("type", EXPORT + r"type " + NAME + r"[^=]*=", "top"),
        ("function", EXPORT + r"(?:const|let|var) " + NAME + ARROW, "top"),
        ("constant", EXPORT + r"(?:const|let|var) " + NAME, "top"),
        ("method", r"^(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set) )*\*?#?" + NAME + r"\??(?:<[^(]*>)? ?\([^;]*\)[^;=]*\{$", "member"),
        ("method", r"^(?:(?:public|private|protected|static|readonly|override) )*#?" + NAME + r"(?:: [^=]*)? ?" + r"= ?(?:async )?(?:function\b|(?:<[^>]*>)?\([^=]*\)[^=]*=>|[\w$]+ ?=>)", "member"),
    ],
    "python": [
        ("class", r"^class " + NAME, "any"),
        ("function", r"^(?:async )?def " + NAME, "top"),
        ("method", r"^(?:async )?def " + NAME, "member"),
    ],
    "go": [
        ("method", r"^func \([^)]*\) ?" + NAME, "top"),
        ("function", r"^func " + NAME, "top"),
        ("struct", r"^type " + NAME + r"(?:\[[^\]]*\])? (?:= )?struct\b", "top"),
        ("interface", r"^type " + NAME + r"(?:\[[^\]]*\])? (?:= )?interface\b", "top"),
        ("type", r"^type " + NAME + r"\b(?! ?\()", "top"),
        ("constant", r"^const " + NAME + r"\b", "top"),
        ("variable", r"^var " + NAME + r"\b", "top"),
    ],
    "java": [
        ("class", MODIFIERS + r"class " + NAME, "any"),
        ("interface", MODIFIERS + r"interface " + NAME, "any"),
        ("enum", MODIFIERS + r"enum " + NAME, "any"),
        ("method", MODIFIERS + r"(?:<[^(]*> ?)?" + TYPE + "?" + NAME + r" ?\([^;=]*\)[^;=]*(?:\{|;)$", "member"),
        ("variable", MODIFIERS + r"(?!(?:return|throw|package|import|new|else|case|record|assert|yield)\b)" + TYPE + NAME + r" ?(?:\[ ?\])* ?(?:=.*|,.*)?(?:;|\{)$", "member"),
    ],
    "rust": [
        ("impl", r"^(?:unsafe )?impl(?:<[^{]*?>)? (?:[^{]+? for )?(?:[\w]+::)*" + NAME, "any"),
        ("function", PUB + r"(?:async |const |unsafe |extern \"\" )*fn " + NAME, "any"),
        ("struct", PUB + r"struct " + NAME, "any"),
        ("enum", PUB + r"enum " + NAME, "any"),
        ("trait", PUB + r"(?:unsafe )?trait " + NAME, "any"),
        ("module", PUB + r"mod " + NAME, "any"),
    ],
}
CONTAINERS = ("class", "interface", "enum", "struct", "trait", "impl")
#: Kinds whose blocks may hold declarations of level any.
HOLDERS = {"java": ("class", "interface", "enum"), "python": ("class",), "rust": ("impl", "trait", "module")}
#: Words before a parenthesis that call nothing, and builtins: of all languages, and of each.
KEYWORDS = (
    "if", "for", "while", "switch", "catch", "return", "function", "def", "class", "func", "fn", "super", "this", "typeof", "print", "len", "range", "str", "int", "list",
    "dict", "set", "isinstance", "append", "make", "panic", "cap", "delete", "copy", "match", "loop", "constructor", "else", "case",
)
RESERVED: dict[str, tuple[str, ...]] = {
    "script": ("await", "yield", "new", "throw", "do", "in", "of", "instanceof", "void", "import"),
    "python": ("elif", "and", "or", "not", "in", "is", "await", "yield", "lambda", "assert", "with", "except", "del", "raise"),
    "go": ("go", "defer", "select", "type", "var", "const", "import", "struct", "interface", "map", "chan", "new", "close", "recover", "println", "range"),
    "java": ("new", "throw", "do", "try", "synchronized", "assert", "yield"),
    "rust": ("in", "move", "mut", "ref", "unsafe", "impl", "where", "as"),
}


def reserved(name: Column, fam: Column) -> Column:
    """Whether a word isn't the name of anything."""
    out = name.isin(*KEYWORDS)
    for own, words in RESERVED.items():
        out |= (fam == own) & name.isin(*words)
    return out


PRIMITIVES = ("int", "long", "short", "byte", "char", "boolean", "float", "double", "void", "var")


def symbols(rows: DataFrame) -> DataFrame:
    """(path, kind, name, qualified_name, parent_name, start_line, end_line, signature, doc, exported, stmt, last_stmt) of statements().

    A statement that declares several names (fields of Java, Go's specs) gives each. last_stmt is the
    last statement of its block, null if it has none.
    """
    fits = F.array().cast("array<struct<kind:string,name:string,rule:string>>")
    for fam, rules in DECLARATIONS.items():
        tried = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract("head", pattern, 1).alias("name"), F.lit(level).alias("rule")) for kind, pattern, level in rules])
        fits = F.when(F.col("fam") == fam, tried).otherwise(fits)
    # The first rule that fits at this level, as a row of its own, so that no rule is tried twice.
    at_level = lambda d: (d["name"] != "") & ((d["rule"] == "any") | ((d["rule"] == "top") == (F.col("level") == 0)))
    decls = rows.select("*", F.explode(F.slice(F.filter(fits, at_level), 1, 1)).alias("d")).select("*", "d.*").drop("d")
    # Members may be named like builtins.
    no_name = reserved(F.col("name"), F.col("fam")) & ~F.col("kind").isin("class", "struct", "variable")
    flow = F.col("name").isin("if", "for", "while", "switch", "catch", "return", "function", "else", "case", "do", "try", "synchronized", "new", "throw")
    decls = decls.where(~no_name | F.col("fam").isin("java", "script") & (F.col("kind") == "method") & ~flow)
    box = decls.select("path", F.col("stmt").alias("outer"), F.col("kind").alias("box_kind"), F.col("name").alias("box_name"))
    decls = decls.join(box, ["path", "outer"], "left")
    held = F.lit(False)
    for fam, kinds in HOLDERS.items():
        held |= (F.col("fam") == fam) & F.col("box_kind").isin(*kinds)
    member = (F.col("rule") == "member") & F.coalesce(F.col("box_kind").isin(*CONTAINERS), F.lit(False))
    decls = decls.where((F.col("rule") == "top") | member | (F.col("rule") == "any") & ((F.col("level") == 0) | F.coalesce(held, F.lit(False))))
    receiver = F.when((F.col("fam") == "go") & (F.col("kind") == "method"), F.regexp_extract("head", r"^func \(\s*(?:\w+ )?\*?(\w+)", 1))
    parent = F.coalesce(receiver, F.when(F.col("box_kind").isin(*CONTAINERS), F.col("box_name")))
    kind = F.when((F.col("fam") == "rust") & (F.col("kind") == "function") & parent.isNotNull(), "method").otherwise(F.col("kind"))
    exported = (
        F.when(F.col("fam") == "script", F.col("head").rlike(r"^export\b"))
        .when(F.col("fam") == "python", ~F.col("name").startswith("_"))
        .when(F.col("fam") == "go", F.col("name").rlike("^[A-Z]"))
        .when(F.col("fam") == "java", F.col("head").rlike(r"^(?:\w+ )*?public\b"))
        .otherwise(F.col("head").rlike(r"^pub\b"))
    )
    listed = F.regexp_extract("head", r"^(?:const|var) ((?:\w+, ?)+\w+)", 1)
    flat = F.regexp_replace(F.regexp_replace("head", r"<[^<>]*>", ""), r"\([^()]*\)", "")
    more = F.when(F.col("kind") == "variable", F.regexp_extract_all(flat, F.lit(r", ?(\w+)(?: ?\[ ?\])* ?(?=[=,;])"), F.lit(1)))
    names = F.when((F.col("fam") == "go") & (listed != ""), F.split(listed, ", ?")).when((F.col("fam") == "java") & (F.col("kind") == "variable"), F.concat(F.array("name"), more)).otherwise(F.array("name"))
    decls = decls.withColumn("name", F.explode(F.array_distinct(names)))
    signature = F.substring(F.trim(F.regexp_replace(F.regexp_replace("code", r"^\s+", ""), r"(?s)[\n{].*$", "")), 1, 200)
    return decls.select("path", kind.alias("kind"), "name", F.concat_ws(".", parent, "name").alias("qualified_name"), parent.alias("parent_name"), "start_line", F.col("last_line").alias("end_line"), signature.alias("signature"), F.substring("doc", 1, 200).alias("doc"), exported.alias("exported"), "stmt", F.when(F.col("opens"), F.coalesce("close", F.lit(1 << 30))).alias("last_stmt"))


def _around(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, stmt, owner, owner_kind): the innermost declaration whose block a statement is in."""
    final = rows.groupBy("path").agg(F.max("stmt").alias("final"))
    spans = found.where("last_stmt is not null").join(final, "path").where("least(last_stmt, final) > stmt")
    # A statement is in as many spans as declarations are nested, so all of them together are about those of the file.
    each = spans.select("path", F.explode(F.expr("sequence(stmt + 1, least(last_stmt, final))")).alias("at"), "stmt", F.struct("name", "kind").alias("own"))
    return each.groupBy("path", F.col("at").alias("stmt")).agg(F.max_by("own", "stmt").alias("own")).select("path", "stmt", F.col("own.name").alias("owner"), F.col("own.kind").alias("owner_kind"))


CALL = r"([A-Za-z_$][\w$]*)\s*(?:<[\w, .?\[\]<>]*>)?\("
CALL_RUST = r"(?<![\w.:])([A-Za-z_]\w*)(?:(?:::|\.)(?:\w+|<[^>()]*>))*\s*\("
GO_TYPE = r"\*?(?:\w+\.)?([A-Za-z_]\w*)"


def references(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, from_symbol, name, kind) of statements and their symbols.

    Calls are named by their last part (Rust: by their first) and come from the innermost function around; those outside of all
    declarations from none (Go, Java and Rust have no such calls), and those in the initialiser of a constant
    or field don't count. extends and implements are of heads and of embedded fields; references are the
    types of Java's parameters and fields, and of Go's parameters, results, fields, variables, literals
    and assertions.
    """
    own = found.select("path", "stmt", F.col("name").alias("own_name"), F.col("kind").alias("own_kind"), F.col("last_stmt").isNotNull().alias("has_block"))
    all_ = rows.join(_around(rows, found), ["path", "stmt"], "left").join(own.dropDuplicates(["path", "stmt"]), ["path", "stmt"], "left")
    in_function = F.col("owner_kind").isin("function", "method")
    body = (
        F.when(F.col("own_name").isNull(), F.col("head"))
        .when(F.col("fam") == "python", F.regexp_extract("head", r"\)(?: ?->[^:]*)? ?:(.+)$", 1))
        .when((F.col("fam") == "script") & F.col("own_kind").isin("function", "method") & ~F.col("has_block"), F.regexp_extract("head", r"=>(.*)$", 1))
    )
    names = F.when(F.col("fam") == "rust", F.regexp_extract_all(body, F.lit(CALL_RUST), F.lit(1))).otherwise(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)))
    caller = F.when(F.col("own_kind").isin("function", "method"), F.col("own_name")).when(in_function, F.col("owner"))
    counts = caller.isNotNull() | F.col("own_name").isNull() & F.col("owner").isNull() & F.col("fam").isin("script", "python") | (F.col("fam") == "python") & (F.col("owner_kind") == "class") & F.col("own_name").isNull()
    inner = F.col("fam").isin("script", "python") & F.col("head").rlike(r"^(?:export )?(?:async )?(?:function|def)\b")  # a nested function's name isn't called
    calls = all_.where(counts).select("path", caller.alias("from_symbol"), F.explode(F.when(inner & F.col("own_name").isNull(), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)).alias("name"), F.lit("calls").alias("kind"), "fam")
    calls = calls.where(~reserved(F.col("name"), F.col("fam"))).drop("fam")

    head, python = F.col("head"), F.col("fam") == "python"
    no_generics = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"<[^<>]*>", ""), r"<[^<>]*>", ""), r"<[^<>]*>", "")
    base = F.when(python, F.regexp_extract("head", r"^class \w+ ?\(([^)]*)\)", 1)).when((F.col("fam") == "java") & (F.col("own_kind") == "interface"), "").otherwise(F.regexp_extract(no_generics, r"\bextends ([\w$., ]+?)(?: implements\b| ?\{|$)", 1))
    done = F.when(F.col("fam") == "rust", F.regexp_extract(no_generics, r"\bimpl ?(?:\w+::)*(\w+) for\b", 1)).otherwise(F.regexp_extract(no_generics, r"\bimplements ([\w$., ]+?)(?: ?\{|$)", 1))
    pairs = F.array(F.struct(base.alias("n"), F.lit("extends").alias("kind")), F.struct(done.alias("n"), F.lit("implements").alias("kind")))
    bases = all_.where(F.col("own_kind").isin("class", "interface", "impl") & (F.col("fam") != "go")).select("path", F.col("own_name").alias("from_symbol"), F.explode(pairs).alias("b"))
    bases = bases.select("path", "from_symbol", F.explode(F.split("b.n", r"\s*,\s*")).alias("name"), "b.kind").where("name <> '' and name not like '%=%'").withColumn("name", F.regexp_replace(F.trim("name"), r"^.*[:]|\..*$", ""))

    go, java = F.col("fam") == "go", F.col("fam") == "java"
    inside = F.regexp_replace("head", r" ?[};]$", "")  # a field that shares its line with the end of its block
    each = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    one = lambda text, pattern: F.array_remove(F.array(F.regexp_extract(text, pattern, 1)), "")
    none = F.array().cast("array<string>")
    # Java: parameters of a method's head, and the type of a field; the last part of a dotted type, without generics.
    params = F.regexp_extract(no_generics, r"^[^(]*\((.*)\)", 1)
    of_params = each(params, r"(?:^|,) ?(?:@\w+(?:\([^)]*\))? |final )*(?:\w+\.)*([A-Za-z_$][\w$]*)(?: ?\[ ?\])*(?: ?\.\.\.)? [A-Za-z_$]")
    of_field = one(no_generics, MODIFIERS + r"(?:\w+\.)*([A-Za-z_$][\w$]*)(?: ?\[ ?\])* [A-Za-z_$]")
    in_java = F.when(java & (F.col("own_kind") == "method"), of_params).when(java & (F.col("own_kind") == "variable"), of_field)
    # Go: heads of functions, fields of structs, and what bodies declare, build and assert.
    signature = F.regexp_extract("head", r"^func (?:\([^)]*\) ?)?\w+(?:\[[^\]]*\])? ?(\(.*)$", 1)
    typed = r"[(,] ?\w+ " + GO_TYPE + r"(?= ?[,)])"
    result = one(signature, r"^\((?:[^()]|\([^()]*\))*\) " + GO_TYPE + r" ?\{?$")
    literal = F.when(F.col("mark") == "{", F.when(~head.rlike(r"^(?:func|type|if|for|switch|select|else)\b"), one("head", r"(?:^|[^\]\w.])" + r"(?:\w+\.)?([A-Za-z_]\w*)\{$"))).otherwise(none)
    declared = one("head", r"^(?:var|const) (?:\w+, ?)*\w+ " + GO_TYPE + r"(?= ?=|$)")
    asserted = each("head", r"\.\(" + GO_TYPE + r"\)")
    lambdas = F.flatten(F.transform(each("head", r"\bfunc ?(\([^()]*\))"), lambda p: each(p, typed)))
    bodies = F.filter(F.concat(F.coalesce(literal, none), declared, asserted, lambdas), lambda x: x != "type")
    field = one(inside, r"^(?:\w+, ?)*\w+ " + GO_TYPE + r"(?: ?\"\")?$")
    in_go = F.when(go & F.col("own_kind").isin("function", "method"), F.concat(each(signature, typed), result)).when(go & (F.col("owner_kind") == "struct"), field).when(go & in_function, bodies)
    types = all_.select("path", F.when(F.col("own_kind").isin("function", "method"), F.col("own_name")).otherwise(F.col("owner")).alias("from_symbol"), F.explode(F.coalesce(in_java, in_go)).alias("name"), F.lit("references").alias("kind"))
    types = types.where(~F.col("name").isin(*PRIMITIVES) | ~F.col("path").endswith(".java"))
    embedded = all_.where(go & F.col("owner_kind").isin("struct", "interface")).select("path", F.col("owner").alias("from_symbol"), F.regexp_extract(inside, "^" + GO_TYPE + r"(?: ?\"\")?$", 1).alias("name"), F.lit("extends").alias("kind")).where("name <> ''")
    return calls.unionByName(bases).unionByName(types).unionByName(embedded).distinct()


def imports(files: DataFrame) -> DataFrame:
    """(path, language, raw) of import statements."""
    fam = family(F.col("language"))
    each = {
        "script": r"""(?m)^\s*import\s+(?:type\s+)?(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]""",
        "python": r"(?m)^\s*(?:from\s+(\S+)\s+import|import\s+[\w.]+)",
        "java": r"(?m)^\s*import\s+(?!static\b)([\w.]+(?:\.\*)?)\s*;",
        "rust": r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);",
    }
    found = F.array().cast("array<string>")
    for name, pattern in each.items():
        found = F.when(fam == name, F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).otherwise(found)
    plain = F.when(fam == "python", F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    block = F.regexp_extract("content", r"(?s)\nimport\s*\((.*?)\)", 1)
    go = F.when(fam == "go", F.concat(F.regexp_extract_all("content", F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1)), F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return files.select("path", "language", F.explode(F.array_distinct(F.concat(found, plain, go))).alias("raw")).where("raw <> ''")


def packages(files: DataFrame) -> DataFrame:
    """(path, package): the package line of Java files, null elsewhere."""
    return files.select("path", F.when(F.col("language") == "java", F.nullif(F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))).alias("package"))
