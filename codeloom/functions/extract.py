"""Python source to facts: one nested row for each file, parsed once."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections import deque
from functools import cached_property

#: The facts of a file: lists of names, and of rows with the fields told.
FACTS = {
    "lines": "string",
    "top_names": "string",
    "top_defs": "string",
    "functions": {
        "fn": "int", "name": "string", "line": "int", "end_line": "int", "parent": "string", "cls": "int", "class_name": "string", "owner": "string",
        "params": "array<struct<name:string,line:int,annotation:string>>", "n_defaults": "int", "varargs": "string", "kwargs": "string", "doc": "string",
        "body_lines": "int", "body_stmts": "int", "own_stmts": "int", "signature": "string", "complexity": "int", "isinstance_calls": "int", "decorators": "array<string>",
        "forward": "struct<pos:array<string>,kw:array<string>>", "self_calls": "array<string>", "kinds": "array<struct<name:string,kind:string,line:int>>",
        "reads": "array<struct<name:string,as_arg:boolean>>", "returns": "string",
    },
    "classes": {
        "cls": "int", "name": "string", "line": "int", "end_line": "int", "doc": "string", "bases": "array<string>", "decorators": "array<string>",
        "plain_decorators": "array<string>", "generic_bases": "array<string>", "empty": "boolean", "methods": "array<string>", "top": "boolean", "attributes": "array<string>",
    },
    "targets": {"name": "string", "line": "int"},
    "comments": {"line": "int", "col": "int", "text": "string", "next": "string"},
    "imports": {"line": "int", "module": "string", "name": "string", "orig": "string", "is_from": "boolean", "top": "boolean", "ord": "int"},
    "attrs": {"line": "int", "receiver": "string", "attr": "string"},
    "vars": {"name": "string", "kind": "string", "type": "string", "ord": "int"},
    "calls": {
        "owner": "string", "class_name": "string", "fn": "int", "call": "int", "line": "int", "chain": "array<string>", "method": "string",
        "args": "array<struct<pos:int,kw:string,name:string>>",
    },
}


def wanted_of(wanted: str | None) -> dict[str, set[str]]:
    """What "functions(name,line) comments" asks for: fields by fact. None asks for all of FACTS."""
    if wanted is None:
        return {fact: set(kind) if isinstance(kind, dict) else set() for fact, kind in FACTS.items()}
    out: dict[str, set[str]] = {}
    for fact, fields in re.findall(r"(\w+)(?:\(([^)]*)\))?", wanted):
        every = FACTS[fact] if isinstance(FACTS[fact], dict) else {}
        chosen = set(fields.split(",")) if fields else set(every)
        if unknown := chosen - set(every):
            raise ValueError(f"no such facts: {fact}({', '.join(sorted(unknown))})")
        out.setdefault(fact, set()).update(chosen)
    return out


def ddl(wanted: dict[str, set[str]]) -> str:
    """The schema of extract()'s rows."""
    columns = ["path string", "ok boolean"]
    for fact, fields in wanted.items():
        kind = FACTS[fact]
        columns.append(f"{fact} array<{kind}>" if isinstance(kind, str) else f"{fact} array<struct<{','.join(f'{k}:{v}' for k, v in kind.items() if k in fields)}>>")
    return ", ".join(columns)


_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPE = (*_FUNCTION, ast.ClassDef, ast.Lambda)
#: Constructors whose result has a known kind.
_CONSTRUCTORS = {"list": "list", "dict": "dict", "set": "set", "tuple": "tuple", "str": "str", "int": "int", "float": "float", "bool": "bool", "frozenset": "set"}
_DISPLAYS = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str"}


#: Fields that hold no statement or expression: names, contexts, operators, constants.
_PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "kind", "names", "module", "level", "conversion", "type_comment", "is_async", "simple"))
#: Fields that hold statements, or what holds statements.
_BODIES = frozenset(("body", "orelse", "finalbody", "handlers", "cases"))


class _Fields(dict):
    """The fields of a node type that are walked, in order; made once a type."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, kind: type) -> tuple[str, ...]:
        found = self[kind] = self.of(kind)
        return found


_WALKED = _Fields(lambda kind: () if issubclass(kind, ast.Constant) else tuple(f for f in kind._fields if f not in _PLAIN))
_STATEMENTS = _Fields(lambda kind: () if issubclass(kind, ast.expr) else tuple(f for f in kind._fields if f in _BODIES))


def children(node: ast.AST, walked: _Fields = _WALKED) -> list[ast.AST]:
    """What ast.iter_child_nodes gives, in its order, without contexts, operators and the names of imports."""
    out = []
    for name in walked[type(node)]:
        value = getattr(node, name, None)
        if type(value) is list:
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def inside(nodes: list[ast.AST], walked: _Fields = _WALKED) -> list[ast.AST]:
    """Nodes and all below them, breadth first."""
    found = list(nodes)
    for node in found:
        found += children(node, walked)
    return found


def _statements(body: list[ast.stmt]) -> int:
    return sum(isinstance(n, ast.stmt) for n in inside(body, _STATEMENTS))


def last_name(node: ast.AST | None) -> str | None:
    """The name, or the last part of a dotted one; of a call, that of what is called."""
    if isinstance(node, ast.Call):
        node = node.func
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def plain_name(node: ast.AST) -> str:
    """The last part of a name; "?" of anything else, calls and subscripts too."""
    return "?" if isinstance(node, ast.Call) else last_name(node) or "?"


def annotated_class(node: ast.AST | None) -> str | None:
    while isinstance(node, ast.Subscript):
        node = node.slice
    return last_name(node) if isinstance(node, (ast.Name, ast.Attribute)) else None


def bare(node: ast.AST) -> ast.AST:
    """A type without its arguments."""
    while isinstance(node, ast.Subscript):
        node = node.value
    return node


def dotted(node: ast.AST) -> list[str] | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *parts[::-1]] if isinstance(node, ast.Name) else None


def value_kind(node: ast.AST) -> str | None:
    """The kind of value an expression makes, where its form tells; None for others and for None itself."""
    if isinstance(node, ast.Constant):
        kind = type(node.value).__name__
        return kind if kind in ("str", "int", "float", "bool") else None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return _CONSTRUCTORS.get(node.func.id)
    return _DISPLAYS.get(type(node))


def _body(fn) -> list[ast.stmt]:
    """Statements after a docstring."""
    first = fn.body[0]
    skip = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    return fn.body[1:] if skip else fn.body


def _own(fn) -> list[ast.stmt]:
    """Statements after a leading constant of any kind, be it a docstring or an ellipsis."""
    first = fn.body[0]
    return fn.body[1:] if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) else fn.body


def signature(fn, body: list[ast.stmt]) -> str:
    """The shape of a body: node types with child counts and operators, bound names replaced by their order of binding."""
    slots = {}
    bind = lambda name: slots.setdefault(name, f"${len(slots)}")

    def bound(target):
        todo = [target]
        while todo:
            t = todo.pop()
            if isinstance(t, ast.Name):
                bind(t.id)
            elif isinstance(t, (ast.Tuple, ast.List)):
                todo += t.elts[::-1]
            elif isinstance(t, ast.Starred):
                todo.append(t.value)

    for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs):
        if a.arg not in ("self", "cls"):
            bind(a.arg)
    out, todo = [], body[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Name):
            out.append(slots.get(node.id, node.id))
            continue
        if isinstance(node, ast.arg):
            out.append(bind(node.arg))
            continue
        for target in getattr(node, "targets", None) or [getattr(node, "target", None)]:
            if target is not None and isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor, ast.comprehension)):
                bound(target)
        if isinstance(node, ast.ExceptHandler) and node.name:
            bind(node.name)
        ops = getattr(node, "ops", None) or [getattr(node, "op", None)]
        mark = type(node.value).__name__ if isinstance(node, ast.Constant) else ",".join(type(o).__name__ for o in ops if o)
        children = list(ast.iter_child_nodes(node))
        out.append(f"{type(node).__name__}/{len(children)}{mark}")
        todo += reversed(children)
    return " ".join(out)


def _branches(node: ast.AST) -> int:
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return len(node.ifs)
    return isinstance(node, (ast.If, ast.For, ast.While, ast.AsyncFor, ast.Assert, ast.ExceptHandler, ast.match_case))


def _args(call: ast.Call) -> list[dict]:
    named = lambda n: n.id if isinstance(n, ast.Name) else None
    return [{"pos": i, "kw": None, "name": named(a)} for i, a in enumerate(call.args)] + [{"pos": None, "kw": k.arg, "name": named(k.value)} for k in call.keywords if k.arg]


def _direct_calls(fn) -> list[ast.Call]:
    """Calls of a function, depth first, without those of functions and classes inside it."""
    found, todo = [], children(fn)[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, _SCOPE):
            continue
        if isinstance(node, ast.Call):
            found.append(node)
        todo += children(node)[::-1]
    return found


class _Function:
    """What the fields of a function are made of; each part is made once, if a field needs it."""

    def __init__(self, node, number: int, parent: str, cls: int | None, class_name: str | None, owner: str | None):
        self.node, self.own = node, {"fn": number, "parent": parent, "cls": cls, "class_name": class_name, "owner": owner}
        args = node.args
        self.params = [*args.posonlyargs, *args.args, *args.kwonlyargs]

    body = cached_property(lambda self: _body(self.node))
    own_body = cached_property(lambda self: _own(self.node))
    inside = cached_property(lambda self: inside([self.node]))
    calls = cached_property(lambda self: [n for n in self.inside if isinstance(n, ast.Call)])
    named = cached_property(lambda self: [p for p in self.params if p.arg not in ("self", "cls")])

    def forward(self) -> dict | None:
        call = self.own_body[0].value if len(self.own_body) == 1 and isinstance(self.own_body[0], (ast.Return, ast.Expr)) else None
        call = call.value if isinstance(call, ast.Await) else call
        if not isinstance(call, ast.Call):
            return None
        text = lambda n: n.id if isinstance(n, ast.Name) else f"*{n.value.id}" if isinstance(n, ast.Starred) and isinstance(n.value, ast.Name) else "?"
        return {"pos": [text(a) for a in call.args], "kw": [("" if k.arg else "**") + (k.value.id if isinstance(k.value, ast.Name) else "?") for k in call.keywords]}

    def reads(self) -> list[dict]:
        names = {p.arg for p in self.named}
        as_arg = {id(a) for c in self.calls for a in (*c.args, *(k.value for k in c.keywords))}
        return [{"name": n.id, "as_arg": id(n) in as_arg} for n in self.inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in names]

    def kinds(self) -> list[dict]:
        return [{"name": t.id, "kind": kind, "line": s.lineno} for s in self.node.body if isinstance(s, ast.Assign) and (kind := value_kind(s.value)) for t in s.targets if isinstance(t, ast.Name)]

    def row(self, fields: set[str]) -> dict:
        return {f: self.own[f] if f in self.own else _FIELDS[f](self) for f in fields}


#: How the fields of a function are made.
_FIELDS = {
    "name": lambda f: f.node.name,
    "line": lambda f: f.node.lineno,
    "end_line": lambda f: f.node.end_lineno,
    "params": lambda f: [{"name": p.arg, "line": p.lineno, "annotation": annotated_class(p.annotation)} for p in f.named],
    "n_defaults": lambda f: len(f.node.args.defaults) + sum(d is not None for d in f.node.args.kw_defaults),
    "varargs": lambda f: f.node.args.vararg and f.node.args.vararg.arg,
    "kwargs": lambda f: f.node.args.kwarg and f.node.args.kwarg.arg,
    "doc": lambda f: ast.get_docstring(f.node),
    "body_lines": lambda f: f.node.body[-1].end_lineno - f.node.body[0].lineno + 1,
    "body_stmts": lambda f: _statements(f.body),
    "own_stmts": lambda f: _statements(f.own_body),
    "signature": lambda f: signature(f.node, f.body),
    "complexity": lambda f: 1 + sum(map(_branches, f.inside)),
    "isinstance_calls": lambda f: sum(isinstance(c.func, ast.Name) and c.func.id == "isinstance" for c in f.calls),
    "decorators": lambda f: [last_name(d) or "?" for d in f.node.decorator_list if not isinstance(d, ast.Call)],
    "forward": _Function.forward,
    "self_calls": lambda f: sorted({c[1] for n in f.calls if (c := dotted(n.func)) and len(c) == 2 and c[0] == "self"}),
    "kinds": _Function.kinds,
    "reads": _Function.reads,
    "returns": lambda f: annotated_class(f.node.returns),
}


def attributes(cls: ast.ClassDef) -> list[str]:
    """The public attributes that a class defines: names assigned in its body, and on self in its __init__."""
    names = set()
    for s in cls.body:
        if isinstance(s, ast.Assign):
            names |= {t.id for t in s.targets if isinstance(t, ast.Name)}
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            names.add(s.target.id)
        elif isinstance(s, ast.FunctionDef) and s.name == "__init__":
            at = [t for n in ast.walk(s) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Attribute)]
            names |= {t.attr for t in at if isinstance(t.value, ast.Name) and t.value.id == "self"}
    return sorted(n for n in names if not n.startswith("_"))


def comments(source: str, lines: list[str]) -> list[dict]:
    """Comment tokens, each with the next line that is code; none if the source can't be tokenized."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                after = next((x for x in lines[t.start[0] :] if x.strip() and not x.strip().startswith("#")), None)
                out.append({"line": t.start[0], "col": t.start[1], "text": t.string, "next": after})
    except (tokenize.TokenError, SyntaxError):
        return []
    return out


def extract(path: str, source: str | None, wanted: dict[str, set[str]] | None = None) -> dict:
    """The facts of one file, as far as they are wanted; ok is false, and all else missing, if it can't be parsed."""
    wanted = wanted_of(None) if wanted is None else wanted
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"path": path, "ok": False}
    out: dict = {"path": path, "ok": source is not None} | {fact: [] for fact in wanted}
    if "lines" in wanted or "comments" in wanted:
        lines = (source or "").splitlines()
        out |= {"lines": lines} if "lines" in wanted else {}
        out |= {"comments": comments(source or "", lines)} if "comments" in wanted else {}
    n_functions, classes = 0, []
    # no expression holds a statement, so only who asks for attributes has expressions walked
    walked = _WALKED if "attrs" in wanted else _STATEMENTS
    todo = deque([(tree, None, None, None)])  # breadth first: node, parent, number of the class it stands in, its name
    while todo:
        node, parent, cls, class_name = todo.popleft()
        inner = (None, None)
        if isinstance(node, ast.ClassDef):
            inner = (len(classes), node.name)
            classes.append(isinstance(parent, ast.Module))
            if "classes" in wanted:
                methods = [m.name for m in node.body if isinstance(m, _FUNCTION)]
                empty = all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str) for s in node.body)
                row = {"cls": inner[0], "name": node.name, "line": node.lineno, "end_line": node.end_lineno, "doc": ast.get_docstring(node), "bases": [plain_name(b) for b in node.bases], "generic_bases": [plain_name(bare(b)) for b in node.bases], "decorators": [last_name(d) or "?" for d in node.decorator_list], "plain_decorators": [plain_name(d) for d in node.decorator_list], "empty": empty, "methods": methods, "top": classes[-1], "attributes": attributes(node)}
                out["classes"].append({k: v for k, v in row.items() if k in wanted["classes"]})
        elif isinstance(node, _FUNCTION):
            kind = "class" if isinstance(parent, ast.ClassDef) else "module" if isinstance(parent, ast.Module) else "other"
            owner = node.name if kind == "module" else f"{class_name}.{node.name}" if kind == "class" and classes[cls] else None
            of_class = (cls, class_name) if kind == "class" else (None, None)
            if "functions" in wanted:
                out["functions"].append(_Function(node, n_functions, kind, *of_class, owner).row(wanted["functions"]))
            if owner and "calls" in wanted:
                for c in _direct_calls(node):
                    row = {"owner": owner, "class_name": of_class[1], "fn": n_functions, "call": len(out["calls"]), "line": c.lineno, "chain": dotted(c.func) or [], "method": c.func.attr if isinstance(c.func, ast.Attribute) else None, "args": _args(c)}
                    out["calls"].append({k: v for k, v in row.items() if k in wanted["calls"]})
            n_functions += 1
            if "vars" in wanted:
                for p in (*node.args.args, *node.args.kwonlyargs):
                    if known := annotated_class(p.annotation):
                        out["vars"].append({"name": p.arg, "kind": "class", "type": known, "ord": len(out["vars"])})
        elif isinstance(node, (ast.Import, ast.ImportFrom)) and "imports" in wanted:
            from_ = isinstance(node, ast.ImportFrom)
            for a in node.names:
                if not (from_ and a.name == "*"):
                    name = a.asname or (a.name if from_ else a.name.split(".")[0])
                    row = {"line": node.lineno, "module": (node.module or "") if from_ else a.name, "name": name, "orig": a.name if from_ else None, "is_from": from_, "top": isinstance(parent, ast.Module), "ord": len(out["imports"])}
                    out["imports"].append({k: v for k, v in row.items() if k in wanted["imports"]})
        elif isinstance(node, ast.Assign) and isinstance(parent, (ast.Module, ast.ClassDef)) and "targets" in wanted:
            out["targets"] += [{"name": t.id, "line": node.lineno} for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and "attrs" in wanted:
            out["attrs"].append({"line": node.lineno, "receiver": node.value.id, "attr": node.attr})
        loop = isinstance(node, (ast.For, ast.AsyncFor))
        made = node.value if isinstance(node, ast.Assign) else node.iter if loop else None
        if "vars" in wanted and isinstance(made, ast.Call) and (maker := last_name(made)):
            at = [node.target] if loop else node.targets
            out["vars"] += [{"name": t.id, "kind": "loop" if loop else "call", "type": maker, "ord": len(out["vars"])} for t in at if isinstance(t, ast.Name)]
        todo += [(child, node, *inner) for child in children(node, walked)]
    for s in tree.body:
        if isinstance(s, (*_FUNCTION, ast.ClassDef)):
            for fact in {"top_names", "top_defs"} & wanted.keys():
                out[fact].append(s.name)
        elif isinstance(s, (ast.Assign, ast.AnnAssign)) and "top_names" in wanted:
            out["top_names"] += [t.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
    return out
