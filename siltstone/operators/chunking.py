"""Source texts to chunk rows and to graph facts.

Python is read with its own parser. Other languages are scanned: comments and strings are blanked, declarations found by the
patterns of RULES, and their extents by braces (or "end"), so what comes out for them is approximate.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx

MAX_CHARS, WINDOW, OVERLAP = 8_000, 1_024, 100
CHUNK_SCHEMA = "id string, content string, file_path string, file_name string, symbol_name string, symbol_kind string, language string, chunker string, start_line int, end_line int"
_NAME = r"([A-Za-z_$][\w$]*)"
_BRACED_TYPES = rf"(?P<class>\b(?:class|interface|struct|enum|trait|record|namespace|object|protocol|extension|impl|module)\s+{_NAME})"

#: language -> (pattern of types and functions, how blocks end, line comment marks)
RULES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "braces": (rf"{_BRACED_TYPES}|(?P<function>\b(?:function|func|fn|fun)\s+(?:\([^)]*\)\s*)?{_NAME}\s*[<(])|(?P<method>^[ \t]*(?:(?:public|private|protected|internal|static|final|override|async|virtual|abstract|export|default|const|inline|unsafe|extern)\s+)*(?:[\w<>\[\],.:*&?]+\s+)+[*&]?{_NAME}\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws\s+[\w, .]+)?\s*(?=\{{))", "}", ("//",)),
    "ends": (rf"(?P<class>^[ \t]*(?:class|module)\s+{_NAME})|(?P<function>^[ \t]*(?:local\s+)?(?:def|function)\s+(?:self\.)?([\w.:]+[?!]?))", "end", ("#", "--")),
    "shell": (rf"(?P<function>^[ \t]*(?:function\s+{_NAME}|{_NAME}\s*\(\)))", "}", ("#",)),
}
FAMILY = {"ruby": "ends", "lua": "ends", "bash": "shell"} | dict.fromkeys("c_sharp typescript tsx javascript cpp c go rust java php kotlin swift scala objc".split(), "braces")
_KEYWORDS = frozenset("if for while switch catch return sizeof foreach using lock else do try new throw await function match when with print and or not in is".split())


@dataclass
class Declaration:
    name: str
    kind: str  # class or function
    subkind: str
    start: int  # lines from 1, inclusive
    end: int
    bases: list[str] = field(default_factory=list)
    implemented: list[str] = field(default_factory=list)  # those of bases that the text says are implemented
    calls: list[tuple[str, bool, int]] = field(default_factory=list)  # name, member, line
    inner: list[Declaration] = field(default_factory=list)


def _python(source: str) -> tuple[list[Declaration], list[tuple[str, str, int]]] | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    imports: list[tuple[str, str, int]] = []

    def calls_of(node: ast.AST) -> list[tuple[str, bool, int]]:
        out, todo = [], list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop(0)
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            if isinstance(x, ast.Call):
                if isinstance(x.func, ast.Name):
                    out.append((x.func.id, False, x.lineno))
                elif isinstance(x.func, ast.Attribute):
                    out.append((x.func.attr, True, x.lineno))
            todo[:0] = ast.iter_child_nodes(x)
        return out

    def read(body: list[ast.stmt]) -> list[Declaration]:
        out = []
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                is_class = isinstance(n, ast.ClassDef)
                d = Declaration(n.name, "class" if is_class else "function", type(n).__name__, first, n.end_lineno or n.lineno)
                if is_class:
                    d.bases = [b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
                else:
                    d.calls = calls_of(n)
                d.inner = read(n.body)
                out.append(d)
            elif isinstance(n, ast.Import):
                imports.extend((a.name, "imports", n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports.extend([(n.module, "imports_from", n.lineno)] if n.module else [])
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                out += read([s for f in ("body", "orelse", "finalbody") for s in getattr(n, f, [])] + [s for h in getattr(n, "handlers", []) for s in h.body])
        return out

    return read(tree.body), imports


def _blanked(source: str, comments: tuple[str, ...]) -> str:
    """The text with comments and string contents as spaces, lines kept."""
    marks = "|".join(re.escape(c) + r"[^\n]*" for c in comments)
    rx = re.compile(rf"""/\*.*?(?:\*/|\Z)|{marks}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_IMPORT = re.compile(r"""^[ \t]*(?:import\s+(?:static\s+)?(?:[\w*{},\s]+\s+from\s+)?["']?(?P<a>[\w./@*\-]+)|using\s+(?:static\s+)?(?P<b>[\w.]+)\s*;|#\s*include\s*[<"](?P<c>[^>"]+)|require(?:_relative)?\s*\(?["'](?P<d>[^"']+)|use\s+(?P<e>[\w:\\]+))""", re.M)


def family_of_imports(language: str) -> str:
    return "javascript" if language in ("javascript", "typescript", "tsx") else language


def imported_id(path: str, module: str, language: str) -> str:
    """The node of an imported module: its first part in Python and Rust, the package in JavaScript, or there what a relative path is relative to; else the whole name."""
    family = family_of_imports(language)
    if family == "javascript":
        return _id(path, module) if module.startswith(".") else _id(module.split("/")[0])
    return _id(module.split({"python": ".", "rust": "::"}.get(family, "\n"))[0])


def base_kind(language: str, implemented: bool) -> str:
    """Whether a base is extended or implemented, as far as the language's syntax tells."""
    if language in ("c_sharp", "cpp"):
        return "extends_or_implements"
    return "implements" if implemented or language == "rust" else "extends"


def _scanned(source: str, language: str) -> tuple[list[Declaration], list[tuple[str, str, int]]] | None:
    family = FAMILY.get(language)
    if not family:
        return None
    pattern, ender, comments = RULES[family]
    clean = _blanked(source, comments)
    lines = [i for i, c in enumerate(clean) if c == "\n"]
    line = lambda at: bisect_right(lines, at - 1) + 1 if at else 1
    spans: list[tuple[int, int, Declaration]] = []
    for m in re.finditer(pattern, clean, re.M):
        groups = m.groupdict()
        kind = "class" if groups.get("class") else "function"
        name = next((g for g in reversed(m.groups()) if g and re.fullmatch(r"[\w$.:?!]+", g)), None)
        if not name or name in _KEYWORDS or groups.get("method") and m[0].split()[0] in _KEYWORDS:
            continue
        if ender == "}":
            opened = re.compile(r"[{;]").search(clean, m.end() - (m[0].endswith(("(", "<"))))
            if not opened or opened[0] == ";":
                continue
            depth, end = 0, len(clean)
            for b in re.compile(r"[{}]").finditer(clean, opened.start()):
                depth += 1 if b[0] == "{" else -1
                if not depth:
                    end = b.end()
                    break
            head = clean[m.end() : opened.start()]
        else:
            depth, end = 0, len(clean)
            for b in re.compile(r"\b(class|module|def|function|do|if|unless|while|until|case|begin|for|end)\b").finditer(clean, m.start()):
                depth += -1 if b[0] == "end" else 1
                if not depth:
                    end = b.end()
                    break
            head = clean[m.end() : clean.find("\n", m.end()) if "\n" in clean[m.end() :] else len(clean)]
        named = lambda text: [x for x in re.findall(r"[A-Za-z_][\w]*", text) if x not in ("extends", "implements", "public", "private", "protected", "virtual", "with", "for", "where")]
        heads = re.sub(r"<[^<>]*>|\([^()]*\)", " ", head) if kind == "class" else ""
        bases, implemented = named(heads), named(heads.partition("implements")[2])
        if language == "java" and re.search(r"\binterface\b", m[0]):
            implemented = bases
        word = re.search(r"\w+", m[0])
        spans.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, Declaration(name.split(".")[-1].split(":")[-1], kind, word[0] if word else kind, line(m.start() + len(m[0]) - len(m[0].lstrip())), line(end - 1), bases, implemented)))
    top: list[Declaration] = []
    stack: list[tuple[int, Declaration]] = []
    for start, end, d in spans:
        while stack and stack[-1][0] <= start:
            stack.pop()
        if stack and stack[-1][1].kind == "function":
            continue
        (stack[-1][1].inner if stack else top).append(d)
        stack.append((end, d))
        if d.kind == "function":
            body = clean[start:end]
            opened = body.find("{") if ender == "}" else body.find("\n")
            for c in re.finditer(r"(\.|->|::)?\s*\b([A-Za-z_$][\w$]*)\s*\(", body[max(opened, 0) :]):
                if c[2] not in _KEYWORDS:
                    d.calls.append((c[2], bool(c[1]), line(start + max(opened, 0) + c.start(2))))
    relation = "imports_from" if family_of_imports(language) == "javascript" else "imports"
    imports = [(next(g for g in m.groups() if g), relation, line(m.start())) for m in _IMPORT.finditer(source)]
    if language == "go":
        for block in re.finditer(r"^[ \t]*import\s*\(([^)]*)\)", source, re.M):
            imports += [(m[1], "imports", line(block.start(1) + m.start())) for m in re.finditer(r'"([^"\n]+)"', block[1])]
    return top, imports


def parse(source: str, language: str | None) -> tuple[list[Declaration], list[tuple[str, str, int]]] | None:
    """(declarations, imports) of a source text; None if the language isn't read or the text isn't in it."""
    return _python(source) if language == "python" else _scanned(source, language or "")


def windows(words: list[tuple[int, int]], size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of size words, each beginning overlap words before the last one's end."""
    out, at = [], 0
    while at < len(words):
        last = min(at + size, len(words))
        out.append((words[at][0], words[last - 1][1]))
        if last == len(words):
            break
        at = last - overlap
    return out


def _split(text: str, size: int) -> list[str]:
    return [text[a:b] for a, b in windows([m.span() for m in re.finditer(r"\S+", text)], size)] or [text]


def chunks_of(path: str, source: str, language: str | None) -> list[tuple[str, str, str, str, int, int]]:
    """(name, kind, text, chunker, start_line, end_line) of the chunks of a file: the header first, functions with their containers' names before them, empty containers whole; windows of words where nothing can be read. Chunks over MAX_CHARS are split and keep their lines."""
    found = parse(source, language)
    lines = source.split("\n")
    out: list[tuple[str, str, str, str, int, int]] = []

    def walk(ds: list[Declaration], prefix: str) -> None:
        for d in ds:
            name = f"{prefix}{d.name}"
            if d.kind == "class" and d.inner:
                walk(d.inner, f"{name}.")
            else:
                out.append((name, d.subkind, "\n".join(lines[d.start - 1 : d.end]), "parser", d.start, d.end))

    if found:
        walk(found[0], "")
    if not out:
        line = 1
        for i, piece in enumerate(_split(source, WINDOW) if source.strip() else []):
            n = piece.count("\n")
            out.append((f"<chunk{i}>", "text_window", piece, "windows", line, line + n))
            line += n
    else:
        used = {n for d in found[0] for n in range(d.start, d.end + 1)}
        marks = ("#",) if language == "python" else ("//", "/*", "*")
        head = [x for i, x in enumerate(lines, 1) if i not in used and x.strip() and not x.strip().startswith(marks)]
        if head:
            out.insert(0, ("<header>", "module_header", "\n".join(head), "parser", 1, max(1, min(used) - 1)))
    split = []
    for name, kind, text, by, a, b in out:
        if len(text) <= MAX_CHARS:
            split.append((name, kind, text, by, a, b))
        else:
            split += [(f"{name}#part{i}", kind, text[at : at + MAX_CHARS], by, a, b) for i, at in enumerate(range(0, len(text), MAX_CHARS - OVERLAP))]
    return split


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int32() if n.endswith("line") else pa.string()) for n in (c.split()[0] for c in CHUNK_SCHEMA.split(", "))])
    for batch in batches:
        rows = []
        for path, content, lang in zip(*(c.to_pylist() for c in batch.columns)):
            for name, kind, text, by, a, b in chunks_of(path, content or "", lang):
                rows.append((f"{path}::{name}::{a}", text, path, path.replace("\\", "/").rsplit("/", 1)[-1], name, kind, lang or "text", by, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def chunk_files(files: DataFrame) -> DataFrame:
    """files(path, content) to chunk rows. A file that can't be read as its language becomes windows of words; nothing is raised."""
    return files.select("path", "content", tx.language(F.col("path"), F.col("content")).alias("lang")).mapInArrow(_chunk, CHUNK_SCHEMA)


# ---- graph facts ----------------------------------------------------------------------------------------------------

FACTS = "fact string, a string, b string, label string, kind string, subkind string, file string, start_line int, end_line int, lang string, relation string, is_member boolean"


def _id(*parts: str) -> str:
    import unicodedata

    joined = unicodedata.normalize("NFKC", "_".join(p.strip("_.") for p in parts))
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", joined)).strip("_").casefold()


def facts_of(path: str, source: str, language: str) -> list[tuple]:
    """Rows of FACTS: nodes, edges, and raw calls and inheritances that need other files."""
    found = parse(source, language)
    if found is None:
        return []
    declarations, imports = found
    parts = re.sub(r"\.[^./]*$", "", path.replace("\\", "/")).split("/")
    stem = ".".join(parts[-2:]).strip(".")
    file_id = _id(stem)
    out = [("node", file_id, None, path.rsplit("/", 1)[-1], "file", "file", path, 1, source.count("\n") + 1, language, None, None)]
    local: dict[str, str] = {}
    todo: list[tuple[str, Declaration]] = []

    def declare(ds: list[Declaration], prefix: str, owner: str | None) -> None:
        for d in ds:
            label = f"{prefix}{d.name}"
            node = _id(stem, label)
            out.append(("node", node, None, label, d.kind, d.subkind, path, d.start, d.end, language, None, None))
            if owner:
                out.append(("edge", owner, node, None, None, None, path, d.start, None, language, "contains", None))
            if d.kind == "function":
                local.setdefault(d.name.lower(), node)
            todo.append((node, d))
            if d.kind == "class":
                declare(d.inner, f"{label}.", node)

    declare(declarations, "", None)
    for node, d in todo:
        for base in d.bases:
            out.append(("raw_inherit", node, base, None, base_kind(language, base in d.implemented), None, path, d.start, None, language, None, None))
        for name, member, at in d.calls:
            target = local.get(name.lower())
            if target and target != node:
                out.append(("edge", node, target, None, None, None, path, at, None, language, "calls", None))
            elif not target:
                out.append(("raw_call", node, name, None, None, None, path, at, None, language, None, member))
    for module, relation, at in imports:
        out.append(("edge", file_id, imported_id(path, module, language), module, None, None, path, at, None, language, relation, None))
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in FACTS.split(", "))])
    for batch in batches:
        rows = [r for path, content, lang in zip(*(c.to_pylist() for c in batch.columns)) if lang for r in facts_of(path, content or "", lang)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def extract_facts(files: DataFrame) -> DataFrame:
    return files.select("path", "content", tx.language(F.col("path"), F.col("content")).alias("lang")).mapInArrow(_facts, FACTS)


def graph_inputs(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows, raw_calls, raw_inherits) of the facts, for the upserts and the resolution of operators.graph."""
    # The order of writing is that of paths, then of places in the file.
    order = F.struct("file", "start_line", F.coalesce("label", F.lit("")).alias("label"))
    nodes = facts.where("fact = 'node'").select(F.col("a").alias("id"), "label", "kind", "subkind", "file", "start_line", "end_line", F.col("lang").alias("lang_key"), order.alias("ord"))
    module = F.when(F.col("relation").startswith("imports"), F.col("label"))
    edges = facts.where("fact = 'edge'").select(F.col("a").alias("source"), F.col("b").alias("target"), "relation", F.lit("extracted").alias("confidence"), module.alias("module"), F.lit(None).cast("string").alias("base_kind"), F.col("file").alias("from_file"), F.col("start_line").alias("from_line"), order.alias("ord"))
    calls = facts.where("fact = 'raw_call'").select(F.col("a").alias("caller"), F.col("b").alias("callee_name"), "is_member", "file", F.col("start_line").alias("line"))
    bases = facts.where("fact = 'raw_inherit'").select(F.col("a").alias("child"), F.col("b").alias("base_name"), F.col("kind").alias("base_kind"), "file", F.col("start_line").alias("line"))
    return nodes, edges, calls, bases
