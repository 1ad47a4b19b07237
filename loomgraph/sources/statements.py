"""Source files as statements: literals and comments masked over all lines, brackets matched, statements cut where their language ends them.

All of it is column expressions and windows by file, linear in a file's bytes. A lexer's state goes
over line ends, as one pattern per language finds comments and literals from the left over the whole
file. Brackets match by windows over (file, nesting level): within a level openers and closers alternate,
so the innermost open bracket is the last one of its level, and a block ends at the next closer of its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.scratch import written

SCRIPT = ("typescript", "tsx", "javascript")

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"
_CHAR = r"'(?:\\[^'\n]{1,10}|\\'|[^'\\\n])'"
#: Comments and literals of each language. An open one goes on to the end of the line, or of the file where it may have several lines.
LITERALS: dict[str, str] = {
    "script": "|".join([_BLOCK, _LINE, _DOUBLE, _SINGLE, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?", r"(?<=[=(,:!&|?{};\[\n]\s{0,8}|=>\s{0,8}|\breturn\s{1,8})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.){0,200}\]){1,1000}/[a-z]*"]),
    "python": "|".join([r"#[^\n]*", r"\"\"\"(?s:.*?)(?:\"\"\"|\z)", r"'''(?s:.*?)(?:'''|\z)", _DOUBLE, _SINGLE]),
    "java": "|".join([_BLOCK, _LINE, r"\"\"\"(?s:.*?)(?:(?<!\\)\"\"\"|\z)", _DOUBLE, _CHAR]),
    "go": "|".join([_BLOCK, _LINE, r"`[^`]*`?", _DOUBLE, _CHAR]),
    "rust": "|".join([_BLOCK, _LINE, r"\br(#{0,8})\"(?s:.*?)(?:\"\1|\z)", r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?', _CHAR]),
}


def family(language: Column) -> Column:
    return F.when(language.isin(*SCRIPT), "script").otherwise(language)


def masked(content: Column, fam: Column) -> Column:
    """content with each comment as a blank and each other literal as "", both with their line ends."""

    def by(pattern: str) -> Column:
        blank = lambda m: F.concat(F.when(m.rlike(r"^(//|/\*|#)"), " ").otherwise('""'), F.regexp_replace(m, r"[^\n]+", ""))
        gaps, found = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNotNull(), blank(m)).otherwise(""))), "")

    out = F.lit(None).cast("string")
    for name, pattern in LITERALS.items():
        out = F.when(fam == name, by(pattern)).otherwise(out)
    return out


#: A Go keyword before a parenthesis whose lines are declarations.
GROUP = r"^\s*(?:const|var|type|import)\s*\($"
#: Ends of a line after which a statement goes on, and beginnings of a line that go on with the one before.
OPEN_END, GOES_ON = r"(?:[=,|&+?.*(\[-]|=>|\b(?:extends|implements|const|let|var))\s*$", r"^\s*(?:\.[^.]|\?[.:\s]|:|=>|&&|\|\||\+|=[^=]|extends\b|implements\b|\{$)"


def _tokens(files: DataFrame) -> DataFrame:
    """(path, fam, pos, tok, mark, depth, at): the text up to each bracket, semicolon or line end, and the brackets open after it."""
    fam = family(F.col("language"))
    rows = files.select("path", fam.alias("fam"), masked(F.regexp_replace("content", "\r\n?", "\n"), fam).alias("code"))
    cut = F.regexp_extract_all("code", F.lit(r"[^\[\](){};\n]*+(?:[\[\](){};\n]|\z)"), F.lit(0))
    rows = rows.select("path", "fam", F.posexplode(cut).alias("pos", "tok")).where("tok <> ''")
    rows = rows.withColumn("mark", F.regexp_extract("tok", r"([\[\](){};\n])\z", 1))
    upto = Window.partitionBy("path").orderBy("pos")
    step = F.when(F.col("mark").isin("(", "[", "{"), 1).when(F.col("mark").isin(")", "]", "}"), -1).otherwise(0)
    line = F.sum(F.when(F.col("mark") == "\n", 1).otherwise(0)).over(upto) - F.when(F.col("mark") == "\n", 1).otherwise(0) + 1
    return rows.withColumn("depth", F.sum(step).over(upto)).withColumn("at", line.cast("int"))


def _cut(tokens: DataFrame) -> DataFrame:
    """tokens with ends, whether a statement ends there, and grouping, whether the bracket is one of a group of declarations."""
    opens, closes = F.col("mark").isin("(", "[", "{"), F.col("mark").isin(")", "]", "}")
    rows = tokens.withColumn("level", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth")))
    bracket = F.when(opens, F.struct("mark", ((F.col("fam") == "go") & F.col("tok").rlike(GROUP)).alias("group")))
    before = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.when(F.col("level") > 0, F.last(bracket, True).over(before)))
    group = F.coalesce(F.col("within.group"), F.lit(False))
    loose = F.col("within").isNull() | (F.col("within.mark") == "{") | group
    by = Window.partitionBy("path").orderBy("pos")
    goes_on = F.col("tok").rlike(OPEN_END) | F.coalesce(F.lead("tok").over(by).rlike(GOES_ON), F.lit(False)) & (F.col("fam") == "script")
    python = F.col("fam") == "python"
    at_line = F.when(python, F.col("within").isNull() & ~F.col("tok").rlike(r"\\\n\z")).otherwise(F.col("fam").isin("script", "go") & loose & ~goes_on)
    ends = (
        F.when(F.col("mark") == "\n", at_line)
        .when(F.col("mark").isin("{", "}"), ~python)
        .when(F.col("mark") == ";", F.when(python, F.col("within").isNull()).otherwise(loose))
        .when(F.col("mark") == "(", (F.col("fam") == "go") & F.col("tok").rlike(GROUP))
        .when(F.col("mark") == ")", group)
        .otherwise(False)
    )
    return rows.withColumn("ends", ends)


def statements(files: DataFrame) -> DataFrame:
    """(path, fam, stmt, code, head, mark, start_line, end_line, level, outer, opens, close, last_line, doc) of files (path, language, content).

    Statements count from 0; code is masked; head has its blanks as one and the keyword of its group before it;
    mark is what ends it. outer is the statement whose block it is in, opens tells whether it opens one and close is the
    statement at whose end that block ends. doc is the comment on the line before. Python's blocks are by
    the indents of its statements.
    """
    rows = _cut(_tokens(files))
    number = F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("stmt", F.coalesce(number, F.lit(0)).cast("int"))
    said = F.when(F.col("tok").rlike(r"\S"), F.col("at"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda t: t["tok"]), "")
    own = rows.groupBy("path", "fam", "stmt").agg(code.alias("code"), F.max_by("mark", "pos").alias("mark"), F.min(said).alias("start_line"), F.max(said).alias("end_line"))
    own = own.where("start_line is not null")
    by = Window.partitionBy("path").orderBy("stmt")
    python = F.col("fam") == "python"
    grouped = F.col("code").rlike(GROUP) & (F.col("fam") == "go")
    opener, closer = (F.col("mark") == "{") | grouped, (F.col("mark") == "}") | ((F.col("mark") == ")") & ~F.col("code").rlike(r"\(") & (F.col("fam") == "go"))
    step = F.when(opener, 1).when(closer, -1).otherwise(0)
    indent = F.length(F.regexp_extract("code", r"^\n*([ \t]*)", 1))
    own = own.withColumn("level", F.when(python, indent).otherwise(F.sum(step).over(by) - step))
    after = F.lead("level").over(by)
    own = own.withColumn("after", F.when(python, F.coalesce(after, F.lit(0)))).withColumn("opens", F.when(python, F.coalesce(after > F.col("level"), F.lit(False))).otherwise(opener))
    own = own.withColumn("closes", F.when(python, F.col("after") < F.col("level")).otherwise(closer))
    flat = F.trim(F.regexp_replace("code", r"\s+", " "))
    own = own.withColumn("flat", F.regexp_replace(flat, r"^(?:#!?\[[^\]]*\] ?|@(?!interface\b)[\w.]+(?:\([^)]*\))? ?)+", ""))
    own = written(own, "cut")  # read for blocks, ends and keywords
    opened = own.where("opens").select("path", F.when(python, F.col("after")).otherwise(F.col("level") + 1).alias("key"), "stmt", F.lit(1).alias("what"))
    closing = own.where("closes").select("path", F.explode(F.when(python, F.expr("sequence(after + 1, greatest(level, after + 1))")).otherwise(F.array("level"))).alias("key"), "stmt", F.lit(2).alias("what"))
    asked = own.select("path", F.col("level").alias("key"), "stmt", F.lit(0).alias("what"))
    events = asked.unionByName(opened).unionByName(closing)
    before = Window.partitionBy("path", "key").orderBy("stmt", "what").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("path", "key").orderBy(F.desc("stmt"), F.desc("what")).rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("outer", F.last(F.when(F.col("what") == 1, F.col("stmt")), True).over(before)).withColumn("close", F.last(F.when(F.col("what") == 2, F.col("stmt")), True).over(later))
    found = events.where("what < 2").groupBy("path", "stmt").agg(F.max(F.when(F.col("what") == 0, F.col("outer"))).alias("outer"), F.max(F.when(F.col("what") == 1, F.col("close"))).alias("close"))
    own = own.drop("after", "closes").join(found, ["path", "stmt"]).withColumn("outer", F.when(F.col("level") > 0, F.col("outer")))
    keyword = own.where(F.col("code").rlike(GROUP)).select("path", F.col("stmt").alias("outer"), F.regexp_extract("flat", r"^(\w+)", 1).alias("keyword"))
    ends = own.select("path", F.col("stmt").alias("close"), F.col("end_line").alias("close_line"))
    final = own.groupBy("path").agg(F.max("end_line").alias("final_line"))
    out = own.join(keyword, ["path", "outer"], "left").join(ends, ["path", "close"], "left").join(final, "path")
    comment = F.trim(F.regexp_replace("raw", r"^\s*(///?|/\*\*|\*/?|#)\s*|\*/\s*$", ""))
    raw = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("at", "raw")).where(F.col("raw").rlike(r"^\s*(///?|\*|/\*\*|#)"))
    docs = raw.select("path", (F.col("at") + 2).alias("start_line"), comment.alias("doc"))
    out = out.join(docs, ["path", "start_line"], "left")
    last_line = F.when(F.col("opens"), F.coalesce("close_line", "final_line")).otherwise(F.col("end_line"))
    head = F.when(F.col("keyword").isNotNull() & ~F.col("flat").rlike(r"^\)"), F.concat_ws(" ", "keyword", "flat")).otherwise(F.col("flat"))
    return out.select("path", "fam", "stmt", "code", head.alias("head"), "keyword", "mark", "start_line", "end_line", F.when(F.col("keyword").isNotNull(), F.col("level") - 1).otherwise(F.col("level")).alias("level"), "outer", "opens", "close", last_line.alias("last_line"), "doc")
