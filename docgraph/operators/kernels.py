"""Pure Python kernels of chunkers that fold over their input; they know nothing of Spark."""

from __future__ import annotations

import ast
import builtins
import json
import re
from collections.abc import Callable
from typing import Any

SEPARATORS = ["\n\n", "\n", r"(?<=[.!?])\s+", " ", ""]


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"a chunk size of {size} with an overlap of {overlap} can't advance")


def _pieces(text: str, separator: str) -> list[str]:
    """The parts of a text, each with the separator that ends it; a separator at the front falls away."""
    if separator.startswith("(?<="):
        at = [0, *(m.end() for m in re.finditer(separator, text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False) if b > a]
    raw = text.split(separator)
    joined = [p + separator for p in raw[:-1]] + [raw[-1]]
    if raw and not raw[0]:
        joined = joined[1:]
    return [p for p in joined if p]


def recursive_split(text: str, size: int = 1000, overlap: int = 100, separators: list[str] | None = None, merge: bool = True) -> list[str]:
    """Greedy packing of parts up to ``size`` characters; a part over that is split by the next separator.

    Only slices of text without any separator overlap. With ``merge`` off every part stands alone and blank ones go.
    """
    check_sizes(size, overlap)
    rest = SEPARATORS if separators is None else separators
    if len(text) <= size and merge:
        return [text] if text.strip() else []
    if not rest or rest[0] == "":
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    out: list[str] = []
    held = ""
    for part in _pieces(text, rest[0]):
        if not merge:
            out += [part.strip()] if len(part) <= size else recursive_split(part, size, overlap, rest[1:], merge)
            continue
        if len(held) + len(part) <= size:
            held += part
            continue
        if held:
            out.append(held)
        held = ""
        if len(part) > size:
            out += recursive_split(part, size, overlap, rest[1:], merge)
        else:
            held = part
    if held:
        out.append(held)
    return [p for p in out if p.strip()]


def protected_split(text: str, patterns: list[str], size: int = 1000, overlap: int = 100) -> list[str]:
    """As recursive_split, but what a pattern matches is a chunk of its own, whatever its length."""
    if not patterns:
        return recursive_split(text, size, overlap)
    out, at = [], 0
    for m in re.finditer("|".join(f"(?:{p})" for p in patterns), text, re.S | re.M):
        if m.end() == m.start():
            continue
        out += recursive_split(text[at : m.start()], size, overlap) + [m.group()]
        at = m.end()
    return out + recursive_split(text[at:], size, overlap)


CODE_FENCE, MARKDOWN_TABLE = r"```.*?```", r"(?:^\|[^\n]*\|[ \t]*(?:\n|\Z))+"


def markdown_split(text: str, size: int = 1000, overlap: int = 50) -> list[dict[str, Any]]:
    """Chunks of a Markdown text: headings, and what follows each, with the heading's index and title."""
    parts = [p for p in re.split(r"(?m)(?=^#{1,6} )", text) if p.strip()]
    out: list[dict[str, Any]] = []
    parent, title = None, None
    for part in parts:
        body = part
        if m := re.match(r"(#{1,6}) +(.*?)[ \t]*(?:\n|\Z)", part):
            parent, title, body = len(out), m.group(2), part[m.end() :]
            out.append({"index": parent, "content": f"{m.group(1)} {title}", "kind": "heading", "level": len(m.group(1)), "parent": None, "section": title})
        for block in re.split(r"(?m)(?=^(?:[-*+]|\d+\.) )", body) if "```" not in body else [body]:
            if not block.strip():
                continue
            for chunk in protected_split(block.strip("\n"), [CODE_FENCE, MARKDOWN_TABLE], size, overlap):
                out.append({"index": len(out), "content": chunk.strip("\n"), "kind": markdown_kind(chunk), "level": None, "parent": parent, "section": title})
    return out


def markdown_kind(text: str) -> str:
    t = text.strip()
    if t.startswith("|"):
        return "table"
    if t.startswith("```"):
        return "code_block"
    if re.match(r"(?:[-*+]|\d+\.)\s", t):
        return "list_item"
    return "image" if t.startswith("![") else "text"


def load_json(text: str) -> Any:
    """The value of a JSON text, or of a Python literal; None for neither."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None


def _dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def json_split(value: Any, size: int = 1000, path: str = "$") -> list[dict[str, Any]]:
    """Greedy packing of a list's items or an object's fields by their length as JSON.

    An item or a field over ``size`` is split in its turn if it is an object or a list, and else stands alone.
    """
    out: list[dict[str, Any]] = []

    def emit(content: Any, **meta: Any) -> None:
        out.append({"content": _dumps(content), "json_path": path, "first": None, "last": None, "count": None, **meta})

    if isinstance(value, list):
        held: list[Any] = []
        first, length = 0, 2
        for i, item in enumerate(value):
            n = len(_dumps(item))
            if held and length + n + 2 > size:
                emit(held, first=first, last=i - 1, count=len(held))
                held, length = [], 2
            if n > size and isinstance(item, dict | list):
                out += json_split(item, size, f"{path}[{i}]")
                continue
            if not held:
                first = i
            held.append(item)
            length += n + 2
        if held:
            emit(held, first=first, last=first + len(held) - 1, count=len(held))
    elif isinstance(value, dict):
        box: dict[str, Any] = {}
        length = 2
        for k, v in value.items():
            n = len(_dumps({k: v})) - 2
            if n > size and isinstance(v, dict | list):
                if box:
                    emit(box, count=len(box))
                    box, length = {}, 2
                out += json_split(v, size, f"{path}.{k}")
                continue
            if box and length + n + 2 > size:
                emit(box, count=len(box))
                box, length = {}, 2
            box[k] = v
            length += n + 2
        if box:
            emit(box, count=len(box))
    elif value is not None:
        emit(value, count=1)
    return out


# --- source code ---

BUILTINS = frozenset(dir(builtins))
NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go"}
#: Lines that begin a unit of a language: its kind and the group of its name.
UNIT_LINES: dict[str, list[tuple[str, str]]] = {
    "python": [("class", r"^class\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)")],
    "javascript": [("class", r"^(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("function", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "java": [("class", r"^(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$")],
    "go": [("class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)")],
}
UNIT_LINES["typescript"] = [*UNIT_LINES["javascript"], ("class", r"^(?:export\s+)?(?:declare\s+)?(?:interface|enum|namespace)\s+(\w+)"), ("class", r"^(?:export\s+)?type\s+(\w+)\s*=")]


def language_of(source: str, extension: str | None = None, language: str | None = None) -> str:
    ext = extension or ("." + source.rsplit(".", 1)[-1] if "." in source else "")
    return language or LANGUAGES.get(ext.lower(), "python")


def _facts() -> dict[str, Any]:
    names = ("calls", "attribute_calls", "type_refs", "decorators", "raises", "catches", "globals_declared", "inherits_from", "module_vars", "module_all", "instance_attrs", "imports", "params")
    return {"semantic_type": "code_block", "symbol_name": None, "class_name": None, "line_start": 0, "line_end": 0, "content": "", "is_async": False, "is_generator": False, "return_type": None} | {k: [] for k in names}


def regex_units(code: str, language: str) -> list[dict[str, Any]]:
    """Units of a source text by the lines that begin them; what precedes the first is loose code."""
    rules = [(kind, re.compile(p)) for kind, p in UNIT_LINES[language]]
    lines = code.split("\n")
    starts: list[tuple[int, str, str | None]] = []
    for i, line in enumerate(lines):
        for kind, rule in rules:
            if m := rule.match(line):
                starts.append((i, kind, m.group(1)))
                break
    if not starts or starts[0][0] > 0:
        starts.insert(0, (0, "code_block", None))
    out, owner = [], None
    for (a, kind, name), (b, *_) in zip(starts, [*starts[1:], (len(lines), "", None)], strict=True):
        body = "\n".join(lines[a:b])
        if not body.strip():
            continue
        owner = name if kind == "class" else owner if kind == "method" else None
        out.append(_facts() | {"semantic_type": kind, "symbol_name": name, "class_name": owner if kind == "method" else None, "line_start": a + 1, "line_end": b, "content": body})
    return out


def _children(node: ast.AST) -> list[ast.AST]:
    """The child nodes, without contexts."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST) and name != "ctx":
            out.append(value)
    return out


def _own(node: ast.AST) -> list[ast.AST]:
    """The nodes of a definition, parents first, without those of definitions nested in it."""
    out, todo = [], _children(node)[::-1]
    while todo:
        n = todo.pop()
        if type(n) in NESTED:
            continue
        out.append(n)
        todo += _children(n)[::-1]
    return out


def _code(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


def _distinct(names: list[str | None]) -> list[str]:
    return list(dict.fromkeys(n for n in names if n))


def _type_names(node: ast.AST | None) -> list[str]:
    return [] if node is None else [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and n.id not in BUILTINS]


def _params(args: ast.arguments) -> list[dict[str, Any]]:
    out = []
    plain = [*args.posonlyargs, *args.args]
    without = len(plain) - len(args.defaults)
    for i, a in enumerate(plain):
        out.append((a, "positional_only" if i < len(args.posonlyargs) else "positional", i >= without))
    if args.vararg:
        out.append((args.vararg, "var_positional", False))
    out += [(a, "keyword_only", d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    if args.kwarg:
        out.append((args.kwarg, "var_keyword", False))
    return [{"name": a.arg, "kind": kind, "type_annotation": _code(a.annotation) if a.annotation else None, "has_default": d} for a, kind, d in out]


def _imports(nodes: list[ast.stmt]) -> list[dict[str, Any]]:
    out = []
    for n in nodes:
        if isinstance(n, ast.Import):
            out += [{"module": a.name, "name": None, "alias": a.asname, "level": 0} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [{"module": n.module or "", "name": a.name, "alias": a.asname, "level": n.level} for a in n.names]
    return out


def _function_facts(node: Any) -> dict[str, Any]:
    by: dict[str, list[Any]] = {}
    for n in _own(node):
        kind = type(n).__name__
        by.setdefault("Assign" if kind == "AnnAssign" else kind, []).append(n)
    calls = [n.func for n in by.get("Call", [])]
    types = _type_names(node.returns)
    for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]:
        types += _type_names(a.annotation) if a else []
    types += [t for n in by.get("Assign", []) if isinstance(n, ast.AnnAssign) for t in _type_names(n.annotation)]
    raised = [n.exc.func if isinstance(n.exc, ast.Call) else n.exc for n in by.get("Raise", []) if n.exc]
    caught: list[str | None] = []
    for n in by.get("ExceptHandler", []):
        kinds = n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]
        caught += ["__bare__" if k is None else _code(k) for k in kinds]
    attrs = [t.attr for n in by.get("Assign", []) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"]
    return {
        "calls": _distinct([f.id for f in calls if isinstance(f, ast.Name) and f.id not in BUILTINS]),
        "attribute_calls": _distinct([f.attr for f in calls if isinstance(f, ast.Attribute)]),
        "type_refs": _distinct(types),
        "params": _params(node.args),
        "return_type": _code(node.returns) if node.returns else None,
        "decorators": [_code(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list],
        "raises": _distinct([_code(r) for r in raised]),
        "catches": _distinct(caught),
        "globals_declared": _distinct([g for n in by.get("Global", []) for g in n.names]),
        "instance_attrs": _distinct(attrs),
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_generator": "Yield" in by or "YieldFrom" in by,
    }


def python_units(code: str) -> list[dict[str, Any]]:
    """Units of Python source with their facts; by lines alone where it doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return regex_units(code, "python")
    lines = code.split("\n")
    out: list[dict[str, Any]] = []

    def add(kind: str, first: int, last: int, **facts: Any) -> None:
        body = "\n".join(lines[first - 1 : last])
        if body.strip():
            out.append(_facts() | {"semantic_type": kind, "line_start": first, "line_end": last, "content": body} | facts)

    def top(node: Any) -> int:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)])

    def loose(nodes: list[ast.stmt], kind: str, owner: str | None) -> None:
        if not nodes:
            return
        names, everything = [], []
        for n in nodes:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            names += [t.id for t in targets if isinstance(t, ast.Name)]
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(n.value, ast.List | ast.Tuple):
                everything += [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        add(kind, nodes[0].lineno, nodes[-1].end_lineno or nodes[-1].lineno, class_name=owner, symbol_name=None, imports=_imports(nodes), module_vars=_distinct(names), module_all=everything)

    def walk(nodes: list[ast.stmt], owner: str | None, kind: str) -> None:
        held: list[ast.stmt] = []
        for n in nodes:
            if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                held.append(n)
                continue
            loose(held, kind, owner)
            held = []
            if isinstance(n, ast.ClassDef):
                name = f"{owner}.{n.name}" if owner else n.name
                bases = [_code(b) for b in n.bases]
                add("class", top(n), max(n.lineno, n.body[0].lineno - 1 if n.body[0].lineno > n.lineno else n.lineno), symbol_name=name, class_name=owner, inherits_from=bases, decorators=[_code(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list])
                walk(n.body, name, "class_attributes")
            else:
                add("method" if owner else "function", top(n), n.end_lineno or n.lineno, symbol_name=n.name, class_name=owner, **_function_facts(n))
        loose(held, kind, owner)

    walk(tree.body, None, "code_block")
    return out


def code_units(code: str, language: str) -> list[dict[str, Any]]:
    return python_units(code) if language == "python" else regex_units(code, language)


def contained(kernel: Callable[..., list[Any]], *args: Any) -> tuple[list[Any], str | None]:
    """What the kernel gives, or nothing and the failure's text: one bad input spoils no other."""
    try:
        return kernel(*args), None
    except Exception as failure:
        return [], f"{type(failure).__name__}: {failure}"
