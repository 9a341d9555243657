"""Chat formatting by a template compiler (operator 3).

A template is literal text, ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``
and ``{% generation %}``, whose text is under the loss mask. It is parsed to a syntax tree, constants
are folded, and each node becomes a Python closure. Expressions know names, keys of records, constants,
``+``, comparisons, ``and``/``or``/``not`` and filters (``x | escape``), and nothing else: no calls, no
attributes of Python objects.

Conversations are dealt by id and sorted by turn; a task then renders one turn after the other, so a
conversation of any length passes through in bounded parts.
"""

from __future__ import annotations

import ast
import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import small_batches

Env = dict[str, Any]
Piece = tuple[str, bool]  # text, and whether it is under the loss mask

#: Characters after which a part of a conversation is handed on.
PART_CHARS = 1 << 20

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | label }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|###|</turn>")
_LABEL = re.compile(r"[\\:<#]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every control string and every backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def label(text: str) -> str:
    return _LABEL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "label": label, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


class TemplateError(ValueError):
    pass


# ---- syntax tree

@dataclass
class Text:
    value: str


@dataclass
class Output:
    value: ast.expr


@dataclass
class Block:
    kind: str  # root, for, if, generation
    head: Any = None
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(-?)\s*(.*?)\s*(-?)%\}", re.S)


def parse(source: str) -> Block:
    """Template text to a syntax tree."""
    root = Block("root")
    stack: list[tuple[Block, list]] = [(root, root.body)]
    at = 0

    def close(kind: str) -> None:
        while len(stack) > 1:
            block, _ = stack.pop()
            if block.kind == kind and not getattr(block, "nested", False):
                return
            if not (block.kind == kind == "if"):
                break
        raise TemplateError(f"end of {kind} without its start")

    trim = False

    def literal(text: str, before_dash: bool) -> None:
        """Text between tags; a dash in the tag next to it takes the white space away."""
        text = text.lstrip() if trim else text
        text = text.rstrip() if before_dash else text
        if text:
            stack[-1][1].append(Text(text))

    for tag in _TAG.finditer(source):
        literal(source[at : tag.start()], tag[2] == "-")
        at, trim = tag.end(), tag[4] == "-"
        if tag[1] is not None:
            stack[-1][1].append(Output(expression(tag[1])))
            continue
        word, _, rest = tag[3].partition(" ")
        if word == "for":
            if not (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                raise TemplateError(f"for: {rest}")
            block = Block("for", (m[1], expression(m[2])))
        elif word == "if":
            block = Block("if", expression(rest))
        elif word == "generation":
            block = Block("generation")
        elif word in ("elif", "else"):
            top = stack[-1][0]
            if top.kind != "if" or stack[-1][1] is top.other:
                raise TemplateError(f"{word} without if")
            stack[-1] = (top, top.other)
            if word == "else":
                continue
            block = Block("if", expression(rest))
            block.nested = True  # type: ignore[attr-defined]
        elif word in ("endfor", "endif", "endgeneration"):
            close(word[3:])
            continue
        else:
            raise TemplateError(f"unknown tag {word}")
        stack[-1][1].append(block)
        stack.append((block, block.body))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} has no end")
    literal(source[at:], False)
    return root


_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le,
            ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}


def expression(source: str) -> ast.expr:
    """An expression's tree, if it holds allowed nodes only."""
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(source) from e
    for node in ast.walk(tree):
        allowed = (ast.Name, ast.Load, ast.Attribute, ast.Constant, ast.Compare, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp,
                   ast.Not, ast.BinOp, ast.Add, ast.BitOr, *_COMPARE)
        if not isinstance(node, allowed):
            raise TemplateError(f"{type(node).__name__} is not allowed: {source}")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) and not (
                isinstance(node.right, ast.Name) and node.right.id in FILTERS):
            raise TemplateError(f"unknown filter: {source}")
        if isinstance(node, ast.Attribute) and node.attr.startswith("_"):
            raise TemplateError(f"hidden key: {source}")
    return tree


# ---- constant folding

def fold_expression(node: ast.expr) -> ast.expr:
    for name, value in ast.iter_fields(node):
        if isinstance(value, ast.expr) and not (isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) and name == "right"):
            setattr(node, name, fold_expression(value))
        elif isinstance(value, list):
            setattr(node, name, [fold_expression(v) if isinstance(v, ast.expr) else v for v in value])
    parts = [n for n in ast.iter_child_nodes(node) if isinstance(n, ast.expr)]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        parts = parts[:1]
    if parts and all(isinstance(p, ast.Constant) for p in parts):
        try:
            return ast.Constant(value_of(node)({}))
        except TypeError as e:
            raise TemplateError(f"constants that do not go together: {ast.unparse(node)}") from e
    return node


def fold(nodes: list) -> list:
    """Constant outputs become text, constant conditions vanish, neighbouring texts join."""
    out: list = []

    def put(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = fold_expression(node.value)
            put(Text(shown(value.value)) if isinstance(value, ast.Constant) else Output(value))
        elif isinstance(node, Block):
            body, other = fold(node.body), fold(node.other)
            head = node.head
            if node.kind == "if":
                head = fold_expression(head)
                if isinstance(head, ast.Constant):
                    for inner in body if head.value else other:
                        put(inner)
                    continue
            put(Block(node.kind, head, body, other))
        else:
            put(node)
    return out


# ---- closures

def shown(value: Any) -> str:
    return "" if value is None else str(value)


def value_of(node: ast.expr) -> Callable[[Env], Any]:
    """The closure of an expression."""
    if isinstance(node, ast.Constant):
        constant = node.value
        return lambda env: constant
    if isinstance(node, ast.Name):
        name = node.id
        return lambda env: env.get(name)
    if isinstance(node, ast.Attribute):
        inner, key = value_of(node.value), node.attr

        def get(env: Env) -> Any:
            record = inner(env)
            return record.get(key) if isinstance(record, dict) else None

        return get
    if isinstance(node, ast.Compare):
        first, rest = value_of(node.left), [(_COMPARE[type(op)], value_of(x)) for op, x in zip(node.ops, node.comparators, strict=True)]

        def compare(env: Env) -> bool:
            left = first(env)
            for op, x in rest:
                right = x(env)
                if not op(left, right):
                    return False
                left = right
            return True

        return compare
    if isinstance(node, ast.BoolOp):
        parts, every = [value_of(v) for v in node.values], isinstance(node.op, ast.And)
        return (lambda env: all(p(env) for p in parts)) if every else (lambda env: any(p(env) for p in parts))
    if isinstance(node, ast.UnaryOp):
        inner = value_of(node.operand)
        return lambda env: not inner(env)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        inner, use = value_of(node.left), FILTERS[node.right.id]  # type: ignore[attr-defined]
        return lambda env: use(shown(inner(env)))
    if isinstance(node, ast.BinOp):
        left, right = value_of(node.left), value_of(node.right)
        return lambda env: shown(left(env)) + shown(right(env))
    raise TemplateError(type(node).__name__)


Render = Callable[[Env, bool], Iterator[Piece]]


def closure(nodes: list) -> Render:
    parts = [_closure(n) for n in nodes]

    def run(env: Env, mask: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(env, mask)

    return run


def _closure(node: Any) -> Render:
    if isinstance(node, Text):
        text = node.value
        return lambda env, mask: iter(((text, mask),))
    if isinstance(node, Output):
        value = value_of(node.value)
        return lambda env, mask: iter(((shown(value(env)), mask),))
    body = closure(node.body)
    if node.kind == "generation":
        return lambda env, mask: body(env, True)
    if node.kind == "if":
        test, other = value_of(node.head), closure(node.other)
        return lambda env, mask: body(env, mask) if test(env) else other(env, mask)
    name, source = node.head[0], value_of(node.head[1])

    def loop(env: Env, mask: bool) -> Iterator[Piece]:
        for i, item in enumerate(source(env) or ()):  # lazily: a conversation may be longer than memory
            yield from body({**env, name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, mask)

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A template's renderer: keyword arguments to pieces of text and mask."""
    run = closure(fold(parse(source).body))
    return lambda **env: run(env, False)


# ---- conversations

def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text, starts, ends: formatted text in parts, with the masked spans of each part.

    Rows are (conv_id, turn, role, text), ordered by turn, then role and text; null turns come first,
    null roles and texts count as empty, repeated rows are turns of their own, and rows with a null id
    form one conversation. Ids may have any type. A part ends after the piece that fills it; most conversations have one part.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields: list = []

    def schema() -> pa.Schema:
        return pa.schema([("conv_id", fields[0]), ("part", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema(), strict=True)], schema=schema())

    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            fields[:] = [batch.schema.field(0).type]
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def conversations(found: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[dict]]]:
        row = next(found, None)
        while row is not None:
            conv = row[0]

            def messages() -> Iterator[dict]:
                nonlocal row
                while row is not None and row[0] == conv:
                    now, row = row, None
                    yield {"role": now[1], "text": now[2]}
                    row = next(found, None)

            yield conv, messages()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        held = 0
        for conv, messages in conversations(turns(batches)):
            part, texts, size, starts, ends = 0, [], 0, [], []
            for text, masked in render(messages=messages):
                if masked and text:
                    if ends and ends[-1] == size:
                        ends[-1] += len(text)
                    else:
                        starts.append(size)
                        ends.append(size + len(text))
                texts.append(text)
                size += len(text)
                if size >= PART_CHARS and text.endswith("\n") and not masked:
                    out.append((conv, part, "".join(texts), starts, ends))
                    held += size
                    part, texts, size, starts, ends = part + 1, [], 0, [], []
                    if held >= PART_CHARS:
                        yield table(out)
                        out, held = [], 0
            for _ in messages:  # what the template did not ask for
                pass
            if texts or not part:
                out.append((conv, part, "".join(texts), starts, ends))
                held += size
            if held >= PART_CHARS:
                yield table(out)
                out, held = [], 0
        if out:
            yield table(out)

    empty = F.lit("")
    plain = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind}, part long, text string, starts array<long>, ends array<long>")


#: Possessive: no way back is kept for the characters of a long turn.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if not turn:
            raise ValueError("not a formatted conversation")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted text.

    Takes the rows of format_conversations as they come: the parts of a conversation follow each other
    within a partition.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rest = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        schema = None

        def table(found: list[list]) -> pa.RecordBatch:
            rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *rest])
            done = []
            for conv, part, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for start, end in zip(starts, ends, strict=True):
                    said = unescape(text[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield table(done)
        if state:
            yield table([state])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_conversations(rows.unionByName(probe)))


#: The same from the turns themselves: escapes add one character each.
OP3_SQL = r"""WITH R AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(n))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '([\\:<#])', 'x\1', 'g')) + 2 + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM R GROUP BY conv_id"""
