"""The fact job: source files in, one tagged row per symbol, class, call, import, assignment out.

Parsing is per file and local; everything that decides happens later, in joins. A file is laid out
flat first: every node of its syntax tree in reading order, with the names it stands under. Tables then
say which rows a node of a type gives. Nothing is resolved or evaluated.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.session import stage

ARG = "struct<kind:string,value:string,prefix:string,names:array<string>,keys:array<string>,refs:array<string>>"
DECORATOR = "struct<name:string,dotted:string,args:array<string>,keywords:map<string,string>,line:int>"
SCHEMA = (
    "fact string, repo_id string, path string, module string, seq int, scope string, name string, short string, owner string, "
    "kind string, line int, end_line int, nested boolean, text string, receiver string, names array<string>, keys array<string>, "
    f"args array<{ARG}>, kw map<string,{ARG}>, raw_kw map<string,string>, decorators array<{DECORATOR}>, parent int")

_ARG = pa.struct([("kind", pa.string()), ("value", pa.string()), ("prefix", pa.string()), ("names", pa.list_(pa.string())),
                  ("keys", pa.list_(pa.string())), ("refs", pa.list_(pa.string()))])
_DEC = pa.struct([("name", pa.string()), ("dotted", pa.string()), ("args", pa.list_(pa.string())),
                  ("keywords", pa.map_(pa.string(), pa.string())), ("line", pa.int32())])
_TEXT, _WHOLE, _LIST = pa.string(), pa.int32(), pa.list_(pa.string())
ARROW = pa.schema([
    ("fact", _TEXT), ("repo_id", _TEXT), ("path", _TEXT), ("module", _TEXT), ("seq", _WHOLE), ("scope", _TEXT), ("name", _TEXT),
    ("short", _TEXT), ("owner", _TEXT), ("kind", _TEXT), ("line", _WHOLE), ("end_line", _WHOLE), ("nested", pa.bool_()), ("text", _TEXT),
    ("receiver", _TEXT), ("names", _LIST), ("keys", _LIST), ("args", pa.list_(_ARG)), ("kw", pa.map_(pa.string(), _ARG)),
    ("raw_kw", pa.map_(pa.string(), pa.string())), ("decorators", pa.list_(_DEC)), ("parent", _WHOLE)])

#: Source text for one task to parse, some four seconds of work.
TASK_BYTES = 4 << 20
#: Statements that hold others; the rest are spans of their own.
HOLDERS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match)
MARKS = ("classmethod", "staticmethod", "property")


def module_of(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


# --- expressions as text and as cells ----------------------------------------------------------------------

def _chained(head: str, rest: str) -> str:
    return head + rest if head else ""


#: How a link of a name chain is written; other expressions have no chain.
LINKS: dict[type, Callable[[ast.AST], str]] = {
    ast.Name: lambda n: n.id,
    ast.Attribute: lambda n: _chained(chain(n.value), "." + n.attr),
    ast.Call: lambda n: _chained(chain(n.func), "()"),
    ast.Constant: lambda n: repr(n.value) if isinstance(n.value, str) else "",
}


def chain(node: ast.AST | None) -> str:
    """A dotted chain as written, with `()` for a call in it."""
    return LINKS[type(node)](node) if type(node) in LINKS else ""


def _below(node: ast.AST, kind: type, cell: str) -> list[str]:
    return [getattr(n, cell) for n in ast.walk(node) if isinstance(n, kind)]


def _texts(nodes) -> list[str]:
    return [n.value for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str)]


def _template(node: ast.JoinedStr) -> tuple[str, str]:
    """A formatted string with its fields in braces, and the fixed text it begins with."""
    parts = [p.value if isinstance(p, ast.Constant) else None for p in node.values]
    fields = [n for n, p in enumerate(parts) if p is None]
    shown = [p if p is not None else "{" + chain(node.values[n].value) + "}" for n, p in enumerate(parts)]
    return "".join(shown), "".join(parts[: fields[0] if fields else None])


#: Kind and text of an expression by its type; the kind `other` is its source.
KINDS: dict[type, tuple[str, Callable[[ast.AST], str]]] = {
    ast.Constant: ("literal", lambda n: str(n.value)),
    ast.Name: ("name", chain),
    ast.Attribute: ("attribute", chain),
    ast.Call: ("call", lambda n: chain(n.func)),
    ast.JoinedStr: ("fstring", lambda n: _template(n)[0]),
    ast.Dict: ("dict", lambda n: "{...}"),
    **{t: ("sequence", lambda n: "[...]") for t in (ast.List, ast.Tuple, ast.Set)},
}
#: The texts that an expression holds up, by kind: a mapping's keys, a sequence's items, anything in a call.
KEYS: dict[str, Callable[[ast.AST], list[str]]] = {
    "dict": lambda n: _texts(k for k in n.keys if k), "sequence": lambda n: _texts(n.elts), "call": lambda n: _texts(ast.walk(n))}


def cells(node: ast.AST) -> dict:
    """An argument or value as the cells of ARG."""
    kind, text = KINDS.get(type(node), ("other", ast.unparse))
    own = kind in ("literal", "name", "sequence")
    names = [] if own else [node.attr] if kind == "attribute" else _below(node, ast.Attribute, "attr")
    return {"kind": kind, "value": text(node), "prefix": _template(node)[1] if kind == "fstring" else "", "names": names,
            "keys": KEYS[kind](node) if kind in KEYS else [], "refs": _below(node, ast.Name, "id") if kind == "call" else []}


def _plain(node: ast.AST) -> str:
    """The shortest text of a decorator's argument: its chain without quotes, its texts, its value."""
    seen = cells(node)
    return chain(node).strip("'\"") or ",".join(seen["keys"]) or seen["value"]


def _named(keywords: list[ast.keyword], show: Callable) -> list[tuple[str, object]]:
    return [(k.arg, show(k.value)) for k in keywords if k.arg]


def _decorators(node) -> list[dict]:
    rows = []
    for mark in node.decorator_list:
        args, keywords = (mark.args, mark.keywords) if isinstance(mark, ast.Call) else ([], [])
        dotted = chain(mark.func if isinstance(mark, ast.Call) else mark)
        rows.append({"name": dotted.split(".")[-1], "dotted": dotted, "args": list(map(_plain, args)), "keywords": _named(keywords, _plain), "line": mark.lineno})
    return rows


# --- the flat file -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Place:
    """Where a node stands: the names above it, the class it belongs to, how many functions are
    open, and whether a function is the innermost of the classes and functions."""

    module: str
    package: bool
    trail: tuple[str, ...] = ()
    owner: str | None = None
    functions: int = 0
    in_function: bool = False

    def named(self, *more: str) -> str:
        return ".".join(p for p in (self.module, *self.trail, *more) if p)

    def caller(self) -> str:
        return self.named() if self.functions else ".".join(p for p in (self.module, "<module>") if p)

    def inside(self, node: ast.AST) -> Place:
        if isinstance(node, ast.ClassDef):
            return replace(self, trail=(*self.trail, node.name), owner=self.named(node.name), in_function=False)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return replace(self, trail=(*self.trail, node.name), functions=self.functions + 1, in_function=True)
        return self


def laid_out(tree: ast.Module, top: Place) -> Iterator[tuple[ast.AST, Place]]:
    """Every node below the module in reading order. Of classes and functions only the bodies are
    entered: their decorators, bases and defaults are cells of their own row."""
    todo = [(n, top) for n in reversed(tree.body)]
    while todo:
        node, place = todo.pop()
        yield node, place
        below = node.body if hasattr(node, "decorator_list") else [] if isinstance(node, (ast.Import, ast.ImportFrom)) else list(ast.iter_child_nodes(node))
        inner = place.inside(node)
        todo += [(n, inner) for n in reversed(below)]


# --- rows by type of node ------------------------------------------------------------------------------------

Rows = Iterator[tuple[str, dict]]


def bound(node: ast.stmt) -> list[dict]:
    """What an assignment or a loop binds: one set of cells per target with a chain."""
    loop = isinstance(node, (ast.For, ast.AsyncFor))
    source = node.iter if loop else node.value
    if source is None:
        return []
    if loop:
        what = {"kind": "for", "text": chain(source), "keys": []}
    else:
        seen = cells(source)
        empty = isinstance(source, ast.Constant) and source.value is None
        what = {"kind": "none" if empty else seen["kind"], "text": seen["value"], "keys": _texts(ast.walk(source))}
    what["names"] = sorted(set(_below(source, ast.Name, "id")))
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    return [{"name": name, "line": node.lineno, **what} for name in map(chain, targets) if name]


def assignments(node: ast.stmt, place: Place) -> Rows:
    for what in bound(node):
        yield "assign", {"scope": place.named() if place.in_function else None, **what}
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda):
            yield "symbol", {"name": place.named(what["name"]), "short": what["name"], "kind": "lambda", "owner": place.owner, "line": node.lineno,
                             "end_line": node.end_lineno, "nested": False, "decorators": [], "names": [a.arg for a in node.value.args.args]}


def functions(node: ast.FunctionDef, place: Place) -> Rows:
    decorators = _decorators(node)
    method = place.owner is not None and not place.functions
    held = [m for m in MARKS if any(d["name"] == m for d in decorators)]
    yield "symbol", {"name": place.named(node.name), "short": node.name, "kind": ([*["method"], *held][-1]) if method else "function", "owner": place.owner,
                     "line": node.lineno, "end_line": node.end_lineno, "nested": place.functions > 0, "decorators": decorators,
                     "names": [a.arg for a in (*node.args.args, *node.args.kwonlyargs)]}


def classes(node: ast.ClassDef, place: Place) -> Rows:
    name = place.named(node.name)
    yield "class", {"name": name, "short": node.name, "line": node.lineno, "end_line": node.end_lineno, "names": list(map(chain, node.bases)),
                    "decorators": _decorators(node), "raw_kw": _named(node.keywords, lambda v: chain(v) or cells(v)["value"])}
    for line in node.body:
        for what in bound(line) if isinstance(line, (ast.Assign, ast.AnnAssign)) else []:
            yield "class_assign", {"owner": name, **what}
            if isinstance(line.value, ast.Call):
                yield from declared(name, what["name"], line.value)


def declared(owner: str, name: str, call: ast.Call) -> Rows:
    """The call a class attribute is set to and the calls among its arguments, each with how many rows before it its outer call is."""
    todo: list[tuple[ast.Call, int | None]] = [(call, None)]
    at = 0
    while todo:
        call, outer = todo.pop()
        yield "field", {"owner": owner, "name": name, "text": chain(call.func), "line": call.lineno, "back": None if outer is None else at - outer,
                        "args": list(map(cells, call.args)), "kw": _named(call.keywords, cells), "names": list(map(chain, call.args)), "raw_kw": _named(call.keywords, chain)}
        inner = [*call.args, *(k.value for k in call.keywords)]
        todo += [(c, at) for c in reversed(inner) if isinstance(c, ast.Call)]
        at += 1


def calls(node: ast.Call, place: Place) -> Rows:
    func, line = node.func, node.lineno
    form = {ast.Name: "name", ast.Attribute: "attribute"}.get(type(func), "other")
    name = {"name": lambda: func.id, "attribute": lambda: func.attr}.get(form, str)()
    receiver = chain(func.value) if form == "attribute" else ""
    text = chain(func) or (f"{receiver}.{name}" if form == "attribute" else "")
    yield "call", {"scope": place.caller(), "kind": form, "name": name, "receiver": receiver, "text": text, "line": line,
                   "args": list(map(cells, node.args)), "kw": _named(node.keywords, cells)}
    for handed in (*node.args, *(k.value for k in node.keywords)):
        if isinstance(handed, ast.Name):
            yield "name_ref", {"scope": place.caller(), "name": handed.id, "line": line}


def plain_imports(node: ast.Import, place: Place) -> Rows:
    scope = place.named() if place.functions else None
    for alias in node.names:
        yield "import", {"scope": scope, "name": alias.asname or alias.name, "text": alias.name, "kind": "name"}
        if alias.asname is None:
            top = alias.name.split(".")[0]
            yield "import", {"scope": scope, "name": top, "text": top, "kind": "head"}


def imports_from(node: ast.ImportFrom, place: Place) -> Rows:
    """Relative modules count dots from the package the file is in."""
    scope = place.named() if place.functions else None
    base = [node.module] if node.module else []
    if node.level:
        parts = [p for p in place.module.split(".") if p]
        up = node.level - 1 + (not place.package)
        base = parts[: max(0, len(parts) - up)] + base
    origin = ".".join(base)
    for alias in node.names:
        star = alias.name == "*"
        yield "import", {"scope": scope, "name": "*" if star else alias.asname or alias.name, "kind": "star" if star else "name",
                         "text": origin if star else ".".join(p for p in (origin, alias.name) if p)}


GIVES: dict[type, Callable[[ast.AST, Place], Rows]] = {
    ast.ClassDef: classes, ast.FunctionDef: functions, ast.AsyncFunctionDef: functions, ast.Call: calls, ast.Import: plain_imports, ast.ImportFrom: imports_from,
    ast.Assign: assignments, ast.AnnAssign: assignments, ast.For: assignments, ast.AsyncFor: assignments}


def file_facts(repo_id: str, path: str, source: str) -> Iterator[dict]:
    """Every fact of one file, in reading order; one `error` fact where it does not parse."""
    top = Place(module_of(path), path.split("/")[-1] == "__init__.py")
    common = {"repo_id": repo_id, "path": path, "module": top.module}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as failed:
        yield {"fact": "error", **common, "seq": 0, "text": type(failed).__name__}
        return
    yield {"fact": "module", **common, "seq": 0, "name": top.module, "kind": "package" if top.package else "module"}
    seq = 1
    for node, place in laid_out(tree, top):
        for fact, row in GIVES[type(node)](node, place) if type(node) in GIVES else ():
            back = row.pop("back", None)
            yield {"fact": fact, **common, "seq": seq, **row, **({"parent": seq - back} if back else {})}
            seq += 1
    for node in ast.walk(tree):
        if isinstance(node, ast.stmt) and not isinstance(node, HOLDERS):
            yield {"fact": "span", **common, "seq": seq, "line": node.lineno, "end_line": node.end_lineno}
            seq += 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text"))):
            rows.extend(file_facts(repo, path, text))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def fact_rows(files: DataFrame) -> DataFrame:
    """One pass over `files` (repo_id, path, text; read twice): the tagged fact table, not yet written.

    Files are dealt by the length of their texts, for alike sources are a small file or shuffle, which Spark takes for one task."""
    total = files.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return files.select("repo_id", "path", "text").repartition(1 + total // TASK_BYTES, "repo_id", "path").mapInArrow(_batches, SCHEMA)


def extract_facts(files: DataFrame) -> dict[str, DataFrame]:
    """The fact tables, written once (partitioned by kind of fact) and split by reading."""
    rows = stage(fact_rows(files), ["fact"])
    kinds = ("module", "symbol", "class", "class_assign", "field", "call", "import", "assign", "name_ref", "span", "error")
    return {k: rows.where(F.col("fact") == k).drop("fact") for k in kinds}
