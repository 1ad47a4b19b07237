"""Scalar functions over names, paths, commits and markdown, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the languages they mean.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "java": "java", "rs": "rust",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_identifier(name: Column | str) -> Column:
    """Lower-case words of an identifier, at case changes and other signs; one-letter words and repeats go."""
    spaced = F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, F.lower))


def search_terms(text: Column | str) -> Column:
    """The prefix terms of a search text: its words and the words of the identifiers in it."""
    raw = F.filter(F.split(_c(text), r"[^\p{L}\p{N}_$]+"), lambda w: w != "")
    parts = F.flatten(F.transform(raw, split_identifier))
    return F.array_distinct(F.concat(F.transform(raw, F.lower), parts))


def _folded() -> tuple[str, str]:
    """Lower-case letters that decompose into one of a-z and a single mark, and those of a-z."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0x80, 0x2000)]
    pairs = [(c, d) for c, d in pairs if c == c.lower() and len(d) == 2 and "a" <= d[0] <= "z" and unicodedata.combining(d[1])]
    return "".join(c for c, _ in pairs), "".join(d[0] for _, d in pairs)


#: Letters with marks and what search folds them to.
MARKED, PLAIN = _folded()


def index_tokens(text: Column | str) -> Column:
    """All tokens of an indexed text: lower case, marks folded; letters, digits, _ and $ make up tokens."""
    folded = F.translate(F.lower(F.coalesce(_c(text), F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}_$]+"), lambda w: w != "")


def directory(path: Column | str) -> Column:
    """What stands before the last slash; empty at the root."""
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), "([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def rank_key(path: Column | str) -> Column:
    return F.lower(stem(F.translate(_c(path), "\\", "/")))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]+)$", 1))


def language(path: Column | str) -> Column:
    """Language by extension; null for others."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension(path))


def anchor_word(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]", ""), "[0-9]+$", "")


def is_test_for_rank(path: Column | str) -> Column:
    """A test by the ranker's rule: a test folder in any case, or a .test. or _spec. like part of the name."""
    slashed = F.translate(_c(path), "\\", "/")
    return slashed.rlike(r"(?i)(^|/)(test|tests|__tests__)(/|$)") | base_name(slashed).rlike(r"(?i)\.test\.|\.spec\.|_test\.|_spec\.")


def is_test_for_index(path: Column | str) -> Column:
    """A test by the indexer's rule: test or spec as a word of the name, FooTest.java, or a test folder in lower case."""
    base, name = base_name(F.translate(_c(path), "\\", "/")), F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    words = r"(?i)(^|[._-])(test|spec)[._-]|[._-](test|spec)$"
    return base.rlike(words) | name.rlike(words) | base.rlike(r"Tests?\.java$") | F.translate(_c(path), "\\", "/").rlike(r"(^|/)(__tests__|tests?)(/|$)")


def tested_stem(path: Column | str) -> Column:
    """The stem of the file that a test file tests; null if the name has no test part."""
    name = stem(path)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)[._-](test|spec)s?$", ""), r"(?i)^test[._-]", ""), r"Tests?$", "")
    return F.when((short != name) & (short != ""), short)


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(_c(text), "UTF-16BE")) / 8).cast("long")


def utf16_units(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("long")


def _head(text: Column, units: Column) -> Column:
    """The longest beginning of that many UTF-16 units at most; no half of a pair."""
    # A mark before each character that takes two units lets a cut by characters count units.
    marked = F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", "\uFFFF$1")
    return F.regexp_replace(F.substring(marked, F.lit(1), F.greatest(units, F.lit(0)).cast("int")), "\uFFFF", "")


def clamped(text: Column | str, budget: Column) -> Column:
    """Cut to a budget of tokens, at a line end if one is in the second half, with a note if there is room for it; never over the budget."""
    whole, room = _c(text), budget.cast("long") * 4
    cut = _head(whole, room)
    last = F.locate("\n", F.reverse(cut))
    upto = F.substring(cut, F.lit(1), F.greatest(F.length(cut) - last, F.lit(0)))
    noted = F.concat(F.when((last > 0) & (utf16_units(upto) * 2 > room), upto).otherwise(cut), F.lit("\n… [truncated to ~"), budget.cast("string"), F.lit(" tokens]"))
    bare = F.concat(_head(whole, room - 1), F.lit("…"))
    return F.when(estimate_tokens(whole) <= budget, whole).when(estimate_tokens(noted) <= budget, noted).otherwise(bare)


def commit_type(subject: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(subject), CONVENTIONAL, 1))


def commit_scope(subject: Column | str) -> Column:
    """The scope of a conventional commit; empty without one, or for other subjects."""
    return F.regexp_extract(_c(subject), CONVENTIONAL, 2)


# Fixed value: a conventional commit's subject.
CONVENTIONAL = r"^([a-zA-Z][\w-]*)\(([^)]+)\)!?:\s*(.+)$"


def renamed_path(path: Column | str) -> Column:
    """The new path of a numstat rename, of either form; other paths as they are."""
    braced = F.regexp_replace(F.regexp_replace(_c(path), r"^(.*)\{.* => (.*)\}(.*)$", "$1$2$3"), "//+", "/")
    plain = F.trim(F.regexp_replace(_c(path), r"^.* => ", ""))
    return F.when(_c(path).rlike(r"\{.* => .*\}"), braced).when(_c(path).contains(" => "), plain).otherwise(_c(path))


def doc_class(path: Column | str) -> Column:
    """readme, changelog, adr, spec or doc, by the first rule that fits the lower-case path."""
    low = F.lower(_c(path))
    base = base_name(low)
    return (
        F.when(base.startswith("readme"), "readme")
        .when(base.startswith("changelog") | base.startswith("history"), "changelog")
        .when(base.rlike(r"adr[-_]?\d") | low.contains("/adr"), "adr")
        .when(base.contains("spec") | low.contains("/specs/") | low.contains("/rfcs/"), "spec")
        .otherwise("doc")
    )


def doc_title(body: Column | str, path: Column | str) -> Column:
    found = F.trim(F.regexp_extract(_c(body), r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found).otherwise(stem(path))


def summary(body: Column | str, size: int = 300) -> Column:
    """The text after a leading heading, cut with an ellipsis."""
    rest = F.trim(F.regexp_replace(_c(body), r"\A#[^\n]*\n+", ""))
    return F.when(F.length(rest) > size, F.concat(F.substring(rest, 1, size), F.lit("…"))).otherwise(rest)


def mentioned_paths(body: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(body), F.lit(r"`?((?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]+)`?"), F.lit(1)))


def mentioned_names(body: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(body), F.lit(r"`([A-Za-z_$][A-Za-z0-9_$]*)`"), F.lit(1)))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """How many leading path segments are equal."""
    same = F.zip_with(F.split(_c(a), "/"), F.split(_c(b), "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def snippet(content: Column | str, start: Column, end: Column, most: int = 120) -> Column:
    """struct<source, truncated>: the lines from start to end (counted from 1), at most so many."""
    lines = F.split(_c(content), "\n")
    count = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))
    return F.struct(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.least(count, F.lit(most))), "\n").alias("source"), (count > most).alias("truncated"))


def node_line(kind: Column | str, subkind: Column | str, name: Column | str, qualified_name: Column | str, path: Column | str, line: Column | str) -> Column:
    """A node in one line: [kind/subkind] name — path:line."""
    sort = F.concat(_c(kind), F.coalesce(F.concat(F.lit("/"), _c(subkind)), F.lit("")))
    place = F.coalesce(F.concat(_c(path), F.coalesce(F.concat(F.lit(":"), _c(line).cast("string")), F.lit(""))), F.lit("(no file)"))
    return F.concat(F.lit("["), sort, F.lit("] "), F.coalesce(_c(qualified_name), _c(name)), F.lit(" — "), place)


def ends_with_path(path: Column | str, asked: str) -> Column:
    """Whether a path is, or ends at a slash with, the asked one, ASCII letters in either case."""
    low, want = F.lower(_c(path)), asked.replace("\\", "/").lower()
    return (low == want) | low.endswith("/" + want)
