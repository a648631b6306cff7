"""Column builders for text, paths and code; all of them stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes and their languages.
LANGUAGES = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "c_sharp", ".cxx": "cpp", ".go": "go", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".java": "java", ".js": "javascript",
    ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".m": "objc", ".md": "markdown", ".mjs": "javascript", ".mm": "objc", ".php": "php", ".py": "python", ".rb": "ruby",
    ".rs": "rust", ".sc": "scala", ".scala": "scala", ".sh": "bash", ".sql": "sql", ".swift": "swift", ".ts": "typescript", ".tsx": "tsx",
}

# Which paths are tests.
TEST_PATH = r"(?i)(^|/)(test|tests|spec|__tests__)/|_test\.|\.test\.|\.spec\.|Test\.cs$|Tests\.cs$"


def tokens(text: Column) -> Column:
    """Search terms of a text: each ASCII alphanumeric run in lower case, and the parts of camel-case runs that differ from it. Repeats stay."""
    runs = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), lambda x: x != "")

    def terms(run: Column) -> Column:
        parts = F.transform(F.split(run, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), F.lower)
        mixed = F.concat(F.array(F.lower(run)), F.filter(parts, lambda p: (p != "") & (p != F.lower(run))))
        return F.when(run == F.lower(run), F.array(run)).otherwise(mixed)  # most runs: no expression to match

    return F.flatten(F.transform(runs, terms))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column) -> Column:
    """The first line that isn't blank, collapsed, up to 200 characters."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1)
    return F.substring(collapse(line), 1, 200)


def signature(text: Column) -> Column:
    """What stands before the first brace, or the first colon that ends a line; collapsed, up to 400 characters; else the preview."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^(.*?)(?:\{|:[^\S\n]*(?:\n|$))", 1)
    return F.when(collapse(head) != "", F.substring(collapse(head), 1, 400)).otherwise(preview(text))


def signature_for(text: Column, kind: Column) -> Column:
    return F.when(kind == "text_window", preview(text)).otherwise(signature(text))


def doc_line(text: Column) -> Column:
    """The first line of the first docstring, else of the first /// comment, up to 200 characters; empty if none."""
    text = F.coalesce(text, F.lit(""))
    found = [F.regexp_extract(text, p, 1) for p in (r'(?s)"""(.*?)"""', r"(?s)'''(.*?)'''")]
    own = F.when(F.contains(text, F.lit('"""')) & (F.trim(found[0]) != ""), found[0]).otherwise(found[1])
    line = F.regexp_extract(own, r"^\s*([^\n]*)", 1)
    slashes = F.regexp_extract(text, r"(?m)^\s*///\s?(.*)$", 1)
    return F.substring(F.trim(F.when(F.trim(line) != "", line).otherwise(slashes)), 1, 200)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "^.*/", "")


def extension(path: Column) -> Column:
    """The suffix of the base name in lower case with its dot; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column, content: Column | None = None) -> Column:
    """The language by suffix; a C header with an Objective-C declaration is Objective-C. Null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    found = F.try_element_at(table, extension(path))
    if content is not None:
        found = F.when((extension(path) == ".h") & F.coalesce(content, F.lit("")).rlike("@(interface|protocol|implementation)"), F.lit("objc")).otherwise(found)
    return found


def leaf(label: Column) -> Column:
    return F.element_at(F.split(label, r"\."), -1)


def glob_regex(glob: str) -> str:
    """A file glob as an anchored regular expression: * and ? also take slashes, [seq] and [!seq] are sets."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                out.append(r"\[")
                continue
            body = re.sub(r"([\\\[&])", r"\\\1", glob[i:end])
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    rx = glob_regex(glob)
    return basename(path).rlike(rx) | path.rlike(rx) | slashes(path).rlike(rx)


def normal_url(url: Column) -> Column:
    """Without fragment, and without final slashes unless the path is the root."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*/?$"), bare).otherwise(F.regexp_replace(bare, "/+$", ""))


def origin(url: Column) -> Column:
    """Host and port, as they stand between the scheme and the path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def page_file(url: Column) -> Column:
    """A file name for a page: host and path with all but letters, digits, dot, dash and underscore as underscores; long ones cut to 80 characters and a digest."""
    name = F.regexp_replace(F.regexp_replace(normal_url(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[^A-Za-z0-9._\-]+", "_")
    name = F.regexp_replace(name, "^_+|_+$", "")
    name = F.when(name == "", F.lit("index")).otherwise(name)
    cut = F.concat(F.substring(name, 1, 80), F.lit("_"), F.substring(F.sha1(normal_url(url).cast("binary")), 1, 10))
    return F.concat(F.when(F.length(name) > 100, cut).otherwise(name), F.lit(".md"))


def node_id(*parts: Column) -> Column:
    """An identifier from parts: trimmed of underscores and dots, joined by underscores, other characters than word characters as underscores, in lower case."""
    joined = F.concat_ws("_", *[F.regexp_replace(p, r"^[_.]+|[_.]+$", "") for p in parts])
    clean = F.regexp_replace(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", "_"), "_+", "_")
    return F.lower(F.regexp_replace(clean, "^_+|_+$", ""))


# Words that a grep for the question leaves out.
STOP_WORDS = """the a an and or not is are was be been how where what when which that this it its of in on to for by with from into against
after before between across per via like as does do gets get has have their them they code logic implementation back later same new
whether instead keeping performs turned""".split()


def keywords(question: Column) -> Column:
    """The distinct words of three letters and dashes or more, a letter first, in lower case, in order, without stop words."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-z][a-z\-]{2,})"), 1)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


# How languages declare symbols, and names that are none.
DECLARATIONS = (
    r"\bclass\s+([A-Za-z_]\w*)",
    r"\b(?:struct|interface|trait|enum|object|protocol)\s+([A-Za-z_]\w*)",
    r"\bdef\s+([A-Za-z_]\w*)",
    r"\bfunc(?:tion)?\s+([A-Za-z_]\w*)",
    r"\bfn\s+([A-Za-z_]\w*)",
    r"\b(?:public|private|protected|internal|static|final|override|async)\s+[\w<>\[\].]+\s+([A-Za-z_]\w*)\s*\(",
)
NOT_SYMBOLS = ("if", "for", "while", "switch", "return", "get", "set", "new", "in", "of", "is", "as", "do", "to")


def declared_symbols(content: Column) -> Column:
    """Names that a source text declares, distinct, longer than two characters."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(p), 1) for p in DECLARATIONS]))
    return F.array_sort(F.filter(F.array_distinct(found), lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*NOT_SYMBOLS)))
