"""Turns source text into flat statement records; the only Python that runs per row.

The text is parsed, never imported or executed. What the records mean (reads, writes, flows,
tasks) is worked out by Spark expressions in ``operators.scan`` and ``operators.jobs``.
"""

from __future__ import annotations

import ast

import pyarrow as pa

# Calls whose arguments may hold a storage address.
PATH_CALLS = {"parquet", "csv", "json", "orc", "text", "load", "save"}
# Statement text is kept only when it can be a read or a write.
TEXT_MARKS = (".read", ".write", ".table(", ".sql(")

PIECE = pa.struct([("text", pa.string()), ("name", pa.string()), ("at", pa.int32())])
STATEMENT = pa.struct(
    [
        ("line", pa.int32()),
        ("target", pa.string()),
        ("text", pa.string()),
        ("root", pa.string()),
        ("names", pa.list_(pa.string())),
        ("methods", pa.list_(pa.string())),
        ("value", pa.list_(PIECE)),
        ("calls", pa.list_(pa.struct([("method", pa.string()), ("args", pa.list_(pa.list_(PIECE)))]))),
        ("root_at", pa.int32()),
        ("used", pa.list_(pa.int32())),
        ("before", pa.int32()),
        ("last", pa.bool_()),
    ]
)
SCRIPT_ROW = pa.schema(
    [("script_path", pa.string()), ("statements", pa.list_(STATEMENT)), ("error", pa.string())]
)
SCRIPT_DDL = """script_path string,
statements array<struct<line:int,target:string,text:string,root:string,names:array<string>,
  methods:array<string>,value:array<struct<text:string,name:string,at:int>>,
  calls:array<struct<method:string,args:array<array<struct<text:string,name:string,at:int>>>>>,
  root_at:int,used:array<int>,before:int,last:boolean>>,
error string"""

JOB_ROW = pa.schema(
    [
        ("dag_path", pa.string()),
        ("scripts", pa.list_(pa.string())),
        ("calls", pa.list_(pa.string())),
        ("shifts", pa.list_(pa.struct([("from", pa.string()), ("to", pa.string())]))),
        ("error", pa.string()),
    ]
)
JOB_DDL = """dag_path string, scripts array<string>, calls array<string>,
shifts array<struct<`from`:string,`to`:string>>, error string"""
JOB_MARKS = ("DAG(", "BashOperator(", "SparkSubmitOperator(")


def pieces(node: ast.expr) -> list[dict] | None:
    """A text expression as literal and variable pieces; None when it is anything else."""
    match node:
        case ast.Constant(value=str(text)):
            return [{"text": text, "name": None, "at": None}]
        case ast.Name(id=name):
            return [{"text": None, "name": name, "at": None}]
        case ast.Subscript(value=base):
            return pieces(base)
        case ast.FormattedValue(value=inner):
            return pieces(inner)
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            parts = [pieces(left), pieces(right)]
        case ast.JoinedStr(values=values) if values:
            parts = [pieces(v) for v in values]
        case _:
            return None
    return None if None in parts else [p for part in parts for p in part]


def blocks(tree: ast.AST, kinds: tuple = (ast.stmt, ast.excepthandler, ast.match_case)):
    """Nodes of the given kinds in source order, outer before inner."""
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed([n for n in ast.iter_child_nodes(node) if isinstance(n, kinds)]))


def chain_root(node: ast.expr) -> str | None:
    while isinstance(node, (ast.Call, ast.Attribute)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node.id if isinstance(node, ast.Name) else None


def statement(node: ast.stmt) -> dict | None:
    """Record of an assignment to one name or of a bare call; None for other statements."""
    match node:
        case ast.Assign(targets=[ast.Name(id=target)]):
            pass
        case ast.Expr(value=ast.Call()):
            target = None
        case _:
            return None
    inside = list(ast.walk(node.value))
    called = [n for n in inside if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)]
    text = ast.unparse(node.value)
    usable = any(mark in text for mark in TEXT_MARKS)
    return {
        "line": node.lineno if target is None else node.value.lineno,
        "target": target,
        "text": text if usable else None,
        "root": chain_root(node.value),
        "names": list(dict.fromkeys(n.id for n in inside if isinstance(n, ast.Name))),
        "methods": list(dict.fromkeys(n.func.attr for n in called)),
        "value": pieces(node.value) if target else None,
        "calls": [
            {"method": n.func.attr, "args": [p for p in map(pieces, n.args) if p is not None]}
            for n in called
            if usable and n.func.attr in PATH_CALLS
        ],
    }


def link(found: list[dict]) -> list[dict]:
    """Number the assignments and note for every name which of them it means, in one pass.

    Names in values, chains and lists mean the assignment before them; names in call arguments the last of the script.
    ``before`` is the assignment of the same name that this one follows, ``last`` marks the final one.
    """
    latest: dict[str, int] = {}
    for at, s in enumerate(found, 1):
        s["root_at"], s["before"], s["last"] = latest.get(s["root"]), latest.get(s["target"]), False
        s["used"] = [latest[n] for n in s["names"] if n in latest]
        for p in s["value"] or ():
            p["at"] = latest.get(p["name"])
        if s["target"]:
            latest[s["target"]] = at
    for at in latest.values():
        found[at - 1]["last"] = True
    for p in (p for s in found for c in s["calls"] for a in c["args"] for p in a):
        p["at"] = latest.get(p["name"])
    return found


def parse_scripts(batches, at_once: int = 256):
    for batch in (b.slice(k, at_once) for b in batches for k in range(0, b.num_rows, at_once)):
        rows = []
        for path, source in zip(*(batch.column(c).to_pylist() for c in ("script_path", "source"))):
            found, error = [], None
            try:
                found = link([s for s in map(statement, blocks(ast.parse(source))) if s])
            except SyntaxError as e:
                error = f"SyntaxError: {e}"
            except Exception as e:  # a script that cannot be read is a row, not a failed task
                error = str(e) or type(e).__name__
            rows.append({"script_path": path, "statements": found, "error": error})
        yield pa.RecordBatch.from_pylist(rows, schema=SCRIPT_ROW)


def parse_jobs(batches, at_once: int = 256):
    for batch in (b.slice(k, at_once) for b in batches for k in range(0, b.num_rows, at_once)):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("dag_path", "source", "scripts"))
        for path, source, scripts in zip(*columns):
            calls, shifts, error = [], [], None
            try:
                for node in blocks(ast.parse(source), (ast.AST,)):
                    if isinstance(node, ast.Call):
                        text = ast.unparse(node)
                        if any(mark in text for mark in JOB_MARKS):
                            calls.append(text)
                    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.RShift):
                        shifts.append({"from": ast.unparse(node.left), "to": ast.unparse(node.right)})
            except Exception as e:
                calls, shifts, scripts, error = [], [], [], str(e) or type(e).__name__
            rows.append({"dag_path": path, "scripts": scripts, "calls": calls, "shifts": shifts, "error": error})
        yield pa.RecordBatch.from_pylist(rows, schema=JOB_ROW)
