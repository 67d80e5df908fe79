"""Functions that need syntax, as Arrow UDFs: validity, structure features, leakage stripping and memory lines.

Python code goes through the standard parser and tokenizer. For the other languages a lexer separates comments, strings
and code, and structure comes from keywords and brackets (or keywords and `end` in Ruby); that approximates a grammar.
Every function reads each row's code once and returns all its outputs in one struct, so callers evaluate it per distinct
code hash and join.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X

# The features in their order, and the kind of each.
FEATURES = (
    ("no_of_ifs", "count"), ("no_of_switches", "count"), ("no_of_loop", "count"), ("no_of_break", "count"), ("nested_loop_depth", "count"), ("noOfMethods", "count"),
    ("noOfVariables", "count"), ("noOfStatements", "count"), ("noOfJumps", "count"), ("recursion_present", "bool"), ("priority_queue_present", "bool"), ("hash_set_present", "bool"),
    ("hash_map_present", "bool"), ("no_of_sort", "count"), ("cond_in_loop_freq", "count"), ("loop_in_cond_freq", "count"), ("loop_in_loop_freq", "count"), ("cond_in_cond_freq", "count"),
    ("cyclomatic_max", "cont"), ("cyclomatic_sum", "cont"), ("cyclomatic_mean", "cont"),
)
NAMES = [n for n, _ in FEATURES]
STRUCTURE = "ok boolean, nodes int, has_loop boolean, has_recursion boolean, " + ", ".join(f"{n} double" for n in NAMES)
STRIPPED = "code string, was_unwrapped boolean, n_comments_stripped int, ok boolean"
#: Features that are column expressions on the text; the UDF computes the others.
TEXTUAL = {"noOfVariables", "priority_queue_present", "hash_set_present", "hash_map_present", "no_of_sort"}

# What makes a comment tell the answer, and classes that only wrap methods.
TELLTALE = re.compile(r"(?i)O\([^)]+\)|\bTime\s*:|\bSpace\s*:|\bcomplexity\b")
WRAPPER = re.compile(r"Solution\d*")

# ---- comments, strings and code of the other languages ----

LINE = {"ruby": ("#",), "php": ("//", "#")}
QUOTES = {"java": '"\'', "c": '"\'', "cpp": '"\'', "csharp": '"\'', "go": '"\'`', "javascript": '"\'`', "typescript": '"\'`', "php": '"\'', "ruby": '"\'', "rust": '"', "swift": '"'}


def _lexer(language: str) -> re.Pattern:
    parts = []
    if language == "ruby":
        parts.append(r"(?P<c0>^=begin\b.*?^=end[^\n]*)")
    else:
        parts.append(r"(?P<c0>/\*.*?(?:\*/|\Z))")
    line = "|".join(re.escape(x) for x in LINE.get(language, ("//",)))
    parts.append(rf"(?P<c1>(?:{line})[^\n]*)")
    for i, q in enumerate(QUOTES.get(language, "\"'")):
        parts.append(rf"(?P<s{i}>{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}?)")
    return re.compile("|".join(parts), re.S | re.M)


LEXERS = {x: _lexer(x) for x in QUOTES}


def comment_spans(code: str, language: str) -> list[tuple[int, int]]:
    """Where comments are; strings hide what looks like one."""
    if language == "python":
        starts = [0]
        for line in code.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        try:
            found = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type == tokenize.COMMENT]
        except (tokenize.TokenError, SyntaxError, ValueError):
            return []
        return [(starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]) for t in found]
    lexer = LEXERS.get(language)
    return [m.span() for m in lexer.finditer(code) if m.lastgroup[0] == "c"] if lexer else []


def bare(code: str, language: str) -> str:
    """Code without comments, and with empty strings, at its own places."""
    lexer = LEXERS.get(language, LEXERS["c"])
    return lexer.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def balanced(code: str) -> bool:
    pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
    for c in code:
        if c in "([{":
            open_.append(c)
        elif c in pairs and (not open_ or open_.pop() != pairs[c]):
            return False
    return not open_


# ---- a common tree ----


@dataclass
class Node:
    """kind: loop, if, switch, function, class, import, other. decisions: branches that the node adds to its function's paths."""

    kind: str
    children: list[Node] = field(default_factory=list)
    decisions: int = 0
    name: str = ""
    text: str = ""


@dataclass
class Tree:
    ok: bool
    root: Node = field(default_factory=lambda: Node("other"))
    nodes: int = 0
    statements: int = 0
    breaks: int = 0
    jumps: int = 0


def python_tree(code: str) -> Tree:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Tree(False)
    tree = Tree(True)

    def visit(x: ast.AST, into: Node) -> None:
        tree.nodes += 1
        node = into
        if isinstance(x, ast.stmt):
            tree.statements += not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            tree.breaks += isinstance(x, ast.Break)
            tree.jumps += isinstance(x, (ast.Break, ast.Continue, ast.Return))
        if isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            node = Node("loop", decisions=1)
        elif isinstance(x, ast.If):
            node = Node("if", decisions=1)
        elif isinstance(x, ast.Match):
            node = Node("switch")
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            node = Node("function", name=x.name, text=ast.get_source_segment(code, x) or "")
        elif isinstance(x, (ast.IfExp, ast.ExceptHandler, ast.match_case, ast.comprehension)):
            node = Node("other", decisions=1)
        elif isinstance(x, ast.BoolOp):
            node = Node("other", decisions=len(x.values) - 1)
        if node is not into:
            into.children.append(node)
        for child in ast.iter_child_nodes(x):
            visit(child, node)

    try:
        visit(module, tree.root)
    except RecursionError:
        return Tree(False)
    return tree


WORD = re.compile(r"[A-Za-z_]\w*|&&|\|\||[{}();?]|\n")
FUNCTION = {
    "go": re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)"), "rust": re.compile(r"\bfn\s+(\w+)"), "swift": re.compile(r"\bfunc\s+(\w+)"), "php": re.compile(r"\bfunction\s+(\w+)"),
    "javascript": re.compile(r"\bfunction\s*\*?\s*(\w+)|(?m:^[ \t]*(?:async\s+|static\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;{}]*\)\s*\{)|\b(\w+)\s*=\s*(?:async\s*)?\([^;{}()]*\)\s*=>"),
}
FUNCTION["typescript"] = re.compile(FUNCTION["javascript"].pattern.replace(r"\)\s*\{)", r"\)\s*(?::[^;{}=]+)?\{)"))
TYPED = re.compile(r"(?:[\w<>\[\],:&*~]+[\s*&]+)+?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|new\b)([A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*|throws\s+[\w,\s]+|noexcept\s*)*\{")
LOOPS = frozenset("for while do foreach loop until repeat".split())
SWITCHES = frozenset("switch match select when".split())


def braced_tree(code: str, language: str) -> Tree:
    plain = bare(code, language)
    if not balanced(plain):
        return Tree(False)
    tree = Tree(True, statements=plain.count(";"))
    heads: dict[int, tuple[str, int]] = {}
    for m in FUNCTION.get(language, TYPED).finditer(plain):
        at = plain.find("{", m.end() - 1)
        if at >= 0:
            heads[at] = (next(x for x in m.groups() if x), m.start())
    stack: list[tuple[Node, int, bool]] = [(tree.root, 0, False)]  # node, its first place, closes at a brace
    waiting: list[Node] = []
    skip_while, depth, closed, at = False, 0, False, 0  # open round brackets; whether a brace closed just before
    for m in WORD.finditer(plain):
        word = m[0]
        tree.nodes += word != "\n"
        depth += (word == "(") - (word == ")")
        after_brace = closed and not plain[at : m.start()].strip()
        closed = word == "}" or after_brace and word == "\n"
        at = m.end()
        if word == "{":
            if m.start() in heads:
                name, start = heads[m.start()]
                node = Node("function", name=name)
                stack[-1][0].children.append(node)
                stack.append((node, start, True))
            elif waiting:
                stack.append((waiting.pop(), m.start(), True))
            else:
                node = Node("other")
                stack[-1][0].children.append(node)
                stack.append((node, m.start(), True))
        elif word == "}":
            if len(stack) > 1:
                node, start, _ = stack.pop()
                node.text = code[start : m.end()]
        elif word == ";" and waiting and not depth:
            waiting.clear()
        elif word in LOOPS and not (word == "while" and after_brace and skip_while):
            node = Node("loop", decisions=1)
            (waiting[-1] if waiting else stack[-1][0]).children.append(node)
            waiting.append(node)
            skip_while = word in ("do", "repeat")
        elif word in ("if", "elsif", "elseif", "unless", "guard"):
            node = Node("if", decisions=1)
            (waiting[-1] if waiting else stack[-1][0]).children.append(node)
            waiting.append(node)
        elif word in SWITCHES:
            node = Node("switch")
            (waiting[-1] if waiting else stack[-1][0]).children.append(node)
            waiting.append(node)
        elif word in ("case", "catch", "&&", "||", "?"):
            (waiting[-1] if waiting else stack[-1][0]).decisions += 1
        elif word in ("break", "continue", "return", "goto"):
            tree.breaks += word == "break"
            tree.jumps += 1
    if language in ("go", "swift", "javascript", "typescript"):
        tree.statements = sum(1 for line in plain.split("\n") if line.strip(" \t{}();"))
    return tree


def ruby_tree(code: str) -> Tree:
    plain = bare(code, "ruby")
    tree = Tree(True, statements=sum(1 for line in plain.split("\n") if line.strip() not in ("", "end")))
    stack: list[tuple[Node, int]] = [(tree.root, 0)]
    for m in re.finditer(r"[A-Za-z_]\w*[?!]?|&&|\|\|", plain):
        word, before = m[0], plain[plain.rfind("\n", 0, m.start()) + 1 : m.start()]
        tree.nodes += 1
        first = not before.strip()
        if word in ("break", "next", "return"):
            tree.breaks += word == "break"
            tree.jumps += 1
        elif word in ("&&", "||", "and", "or", "when", "rescue", "elsif"):
            stack[-1][0].decisions += 1
        elif word in ("while", "until", "for", "if", "unless", "case", "begin", "class", "module", "def") or word == "do" and not re.match(r"\s*(while|until|for)\b", before):
            kind = {"while": "loop", "until": "loop", "for": "loop", "if": "if", "unless": "if", "case": "switch", "def": "function"}.get(word, "other")
            node = Node(kind, decisions=int(kind in ("loop", "if")))
            if word == "def":
                node.name = (re.match(r"\s*(?:self\.)?(\w+[?!]?)", plain[m.end() :]) or [None, ""])[1]
            if word == "do" and re.search(r"\.(each\w*|times|upto|downto|step|map|loop)\b[^\n]*$|\bloop\s*$", before):
                node = Node("loop", decisions=1)
            stack[-1][0].children.append(node)
            if first or word in ("do", "case", "begin") or before.rstrip().endswith("="):
                stack.append((node, m.start()))
        elif word == "end":
            if len(stack) == 1:
                return Tree(False)
            node, start = stack.pop()
            node.text = code[start : m.end()]
    return tree if len(stack) == 1 else Tree(False)


def tree_of(code: str, language: str) -> Tree:
    if language == "python":
        return python_tree(code)
    return ruby_tree(code) if language == "ruby" else braced_tree(code, language)


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += reversed(x.children)


def structure(code: str | None, language: str | None) -> tuple:
    """ok, nodes, has_loop, has_recursion, then the features; textual ones are 0 here. Broken or blank code has zeros."""
    blank = (False, 0, False, False, *[0.0] * len(NAMES))
    if code is None or not code.strip():
        return blank
    tree = tree_of(code, language or "python")
    if not tree.ok:
        return blank
    out = dict.fromkeys(NAMES, 0.0)
    conditions = ("if", "switch")
    stack: list[tuple[Node, int, int]] = [(tree.root, 0, 0)]
    while stack:
        node, loops, conds = stack.pop()
        if node.kind == "loop":
            out["no_of_loop"] += 1
            out["loop_in_loop_freq"] += loops > 0
            out["loop_in_cond_freq"] += conds > 0
            loops += 1
            out["nested_loop_depth"] = max(out["nested_loop_depth"], loops)
        elif node.kind in conditions:
            out["no_of_ifs" if node.kind == "if" else "no_of_switches"] += 1
            out["cond_in_loop_freq"] += loops > 0
            out["cond_in_cond_freq"] += conds > 0
            conds += 1
        stack += [(c, loops, conds) for c in node.children]
    functions = [n for n in walk(tree.root) if n.kind == "function"]
    paths = [1 + sum(n.decisions for n in walk(f)) for f in functions]
    recursive = any(f.text.count(f.name) > 1 for f in functions if f.name)
    out |= {"noOfMethods": float(len(functions)), "noOfStatements": float(tree.statements), "no_of_break": float(tree.breaks), "noOfJumps": float(tree.jumps)}
    out["recursion_present"] = float(any(len(f.name) > 1 and f.text.count(f.name) > 1 for f in functions))
    if paths:
        out |= {"cyclomatic_max": float(max(paths)), "cyclomatic_sum": float(sum(paths)), "cyclomatic_mean": sum(paths) / len(paths)}
    return (True, tree.nodes, out["no_of_loop"] > 0, recursive, *out.values())


def _structure(code: pa.Array, language: pa.Array) -> pa.Array:
    """One code at a time is a Python string; the batch stays in Arrow."""
    kind = pa.struct([("ok", pa.bool_()), ("nodes", pa.int32()), ("has_loop", pa.bool_()), ("has_recursion", pa.bool_()), *[(n, pa.float64()) for n in NAMES]])
    columns = zip(*[structure(c.as_py(), x.as_py()) for c, x in zip(code, language)])
    return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, kind)], fields=list(kind)) if len(code) else pa.array([], kind)


def structures(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """(code_sha256, language, ok, nodes, has_loop, has_recursion, the 21 features) of each distinct code of a language."""
    distinct = df.select(F.sha2(code, 256).alias("code_sha256"), F.col(language).alias("language"), F.col(code).alias("code")).where("code is not null").dropDuplicates(["code_sha256", "language"])
    out = distinct.withColumn("_s", F.arrow_udf(_structure, STRUCTURE)("code", "language"))
    own = {
        "noOfVariables": X.assigned_names(F.col("code")), "priority_queue_present": X.has_any(F.col("code"), F.col("language"), X.QUEUE), "hash_set_present": X.has_any(F.col("code"), F.col("language"), X.SETS),
        "hash_map_present": X.has_any(F.col("code"), F.col("language"), X.MAPS), "no_of_sort": X.count_marks(F.col("code"), F.col("language")),
    }
    columns = [(F.when(F.col("_s.ok"), own[n].cast("double")).otherwise(0.0) if n in own else F.col(f"_s.{n}")).alias(n) for n in NAMES]
    return out.select("code_sha256", "language", "_s.ok", "_s.nodes", "_s.has_loop", "_s.has_recursion", *columns)


def pair_structures(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(pair_id, ast): of each feature a, b, b - a, |b - a|. Snippets are parsed once, however many pairs they are in."""
    from textloom.functions.vectors import pair_block, zeros

    own = points.select("code_sha256", "language", F.array(*NAMES).alias("v"))
    keyed = pairs.withColumn("_a", F.sha2("code_a", 256)).withColumn("_b", F.sha2("code_b", 256))
    a = own.select(F.col("code_sha256").alias("_a"), "language", F.col("v").alias("va"))
    b = own.select(F.col("code_sha256").alias("_b"), "language", F.col("v").alias("vb"))
    out = keyed.join(a, ["_a", "language"], "left").join(b, ["_b", "language"], "left")
    empty = zeros(len(NAMES))
    return out.select("pair_id", pair_block(F.coalesce("va", empty), F.coalesce("vb", empty)).alias("ast"))


# ---- leakage ----


def _dedented(line: str, columns: int) -> str:
    done = 0
    for i, c in enumerate(line):
        if done >= columns or c not in " \t":
            return line[i:]
        done += 8 if c == "\t" else 1
    return ""


def unwrapped_python(code: str) -> tuple[str, bool]:
    """Methods of top-level wrapper classes as functions: decorators stay, other statements go, self goes."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return code, False
    lines = code.split("\n")
    wrappers = [x for x in module.body if isinstance(x, ast.ClassDef) and WRAPPER.fullmatch(x.name) and not x.decorator_list]
    if not wrappers:
        return code, False
    out: list[str] = []
    at = 0
    for wrapper in wrappers:
        out += lines[at : wrapper.lineno - 1]
        methods = []
        for x in wrapper.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)]) - 1
                own = [_dedented(line, x.col_offset) for line in lines[first : x.end_lineno]]
                methods.append(re.sub(r"(def\s+\w+\s*\()self\s*(?:,\s*)?", r"\1", "\n".join(own), count=1))
        out.append("\n\n".join(methods))
        at = wrapper.end_lineno
    return "\n".join(out + lines[at:]).lstrip("\n"), True


def unwrapped_ruby(code: str) -> tuple[str, bool]:
    """The same for Ruby: from `class Solution` to the `end` at its column, by indentation."""
    lines, out, at, changed = code.split("\n"), [], 0, False
    while at < len(lines):
        head = re.match(r"class\s+(\w+)", lines[at])
        stop = next((i for i in range(at + 1, len(lines)) if re.match(r"end\b", lines[i])), None) if head and WRAPPER.fullmatch(head[1]) else None
        if stop is None:
            out.append(lines[at])
            at += 1
            continue
        methods, i = [], at + 1
        while i < stop:
            m = re.match(r"([ \t]*)def\b", lines[i])
            if not m:
                i += 1
                continue
            last = next((k for k in range(i, stop) if re.match(re.escape(m[1]) + r"end\b", lines[k])), i)
            methods.append("\n".join(_dedented(x, len(m[1].expandtabs(8))) for x in lines[i : last + 1]))
            i = last + 1
        out.append("\n\n".join(methods))
        at, changed = stop + 1, True
    return ("\n".join(out).lstrip("\n"), True) if changed else (code, False)


def without_telltales(code: str, language: str) -> tuple[str, int]:
    """Without comments that tell the answer: whole lines go with their end, others with the blanks before them."""
    spans = [(a, b) for a, b in comment_spans(code, language) if TELLTALE.search(code[a:b])]
    for a, b in reversed(spans):
        first, last = code.rfind("\n", 0, a) + 1, code.find("\n", b)
        last = len(code) if last < 0 else last
        if not code[first:a].strip() and not code[b:last].strip():
            a, b = first, min(last + 1, len(code))
        else:
            a = len(code[:a].rstrip(" \t"))
            a = max(a, first)
        code = code[:a] + code[b:]
    return code, len(spans)


def stripped(code: str | None, language: str | None) -> tuple[str | None, bool, int, bool]:
    """(code, was_unwrapped, n_comments_stripped, ok)."""
    if code is None:
        return None, False, 0, False
    unwrap: Callable[[str], tuple[str, bool]] = {"python": unwrapped_python, "ruby": unwrapped_ruby}.get(language, lambda c: (c, False))
    code, was = unwrap(code)
    code, n = without_telltales(code, language or "python")
    return code, was, n, bool(code.strip()) and tree_of(code, language or "python").ok


def _stripped(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stripped(c, x) for c, x in zip(code, language)], columns=["code", "was_unwrapped", "n_comments_stripped", "ok"])


def strip_leakage(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """The rows with stripped code, was_stripped, was_unwrapped, n_comments_stripped and reject_reason (null if the code still parses)."""
    out = df.withColumn("_s", F.pandas_udf(_stripped, STRIPPED)(code, language))
    reason = F.when(~F.col("_s.ok"), F.lit("syntax after stripping"))
    changed = F.col("_s.was_unwrapped") | (F.col("_s.n_comments_stripped") > 0)
    return out.withColumns({"was_stripped": changed, "was_unwrapped": F.col("_s.was_unwrapped"), "n_comments_stripped": F.col("_s.n_comments_stripped"), "reject_reason": reason, code: F.col("_s.code")}).drop("_s")


def _valid(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([bool(c and c.strip()) and tree_of(c, x or "python").ok for c, x in zip(code, language)])


def valid(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Rows whose code parses. Call it after the filters that cost less."""
    return df.where(F.pandas_udf(_valid, "boolean")(code, language))


# ---- memory lines ----

# What begins an import, definition or type in the languages with brackets.
MEMORABLE = re.compile(r"(?m)^[ \t]*(?:#\s*(?:include|define)|import\b|package\b|using\b|namespace\b|use\b|extern\b|mod\b|export\b|(?:public |private |protected |static |final |abstract |pub |async )*(?:class|interface|enum|struct|record|trait|impl|protocol|module|func|fn|function|type|def)\b)")


def memory_offsets(code: str | None, language: str | None) -> list[int]:
    """Byte places of the line ends that close imports and outermost definitions."""
    if not code:
        return []
    raw = code.encode()
    ends: list[int] = []
    if language in (None, "python"):
        try:
            module = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        starts = [0]
        for line in raw.split(b"\n"):
            starts.append(starts[-1] + len(line) + 1)

        def visit(x: ast.AST) -> None:
            if isinstance(x, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                ends.append(starts[x.end_lineno - 1] + x.end_col_offset)
                return
            for child in ast.iter_child_nodes(x):
                visit(child)

        visit(module)
    else:
        plain, at = bare(code, language), 0
        for m in MEMORABLE.finditer(plain):
            if m.start() < at:
                continue
            line = plain.find("\n", m.end())
            line = len(plain) if line < 0 else line
            brace = plain.find("{", m.end(), line)
            at = line
            if brace >= 0:
                depth = 0
                for i in range(brace, len(plain)):
                    depth += (plain[i] == "{") - (plain[i] == "}")
                    if not depth:
                        at = i + 1
                        break
            ends.append(len(code[:at].encode()))
    found = {raw.find(b"\n", max(0, e - 1) if raw[e - 1 : e] == b"\n" else e) for e in ends}
    return sorted(found - {-1})


def _memory(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([memory_offsets(c, x) for c, x in zip(code, language)])


def memory_lines(code: Column, language: Column) -> Column:
    return F.pandas_udf(_memory, "array<int>")(code, language)


def length_gate(tokens: Column, least: int = 6, most: int = 3900) -> Column:
    return tokens.between(least, most)
