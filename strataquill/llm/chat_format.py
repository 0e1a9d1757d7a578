"""Chat formatting by a small sandboxed template language, compiled to Python closures.

``{{ expression }}`` prints, ``{% for m in messages %}``, ``{% if %} {% elif %} {% else %}``, ``{% set name = expression %}`` and
``{% generation %} ... {% endgeneration %}`` control, ``{# ... #}`` is dropped. Expressions have literals, names, ``a.b`` and ``a["b"]`` (keys of
mappings only, never attributes of objects), arithmetic, ``~`` for joining strings, comparisons, ``in``, ``and or not`` and filters.
There are no calls, so a template can reach nothing but its inputs.

A template is parsed to a syntax tree, constants are folded (operators and filters on literals, branches with a
constant condition, neighbouring texts), and each node becomes a closure. The marks of ``generation`` become
spans of characters: the loss mask.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm._store import shuffle_width
from strataquill.shipping import ship

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = "{% for m in messages %}<s>[INST]{{ m.role | guard }}[/INST]{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}</s>{% endfor %}"
#: Characters after which a chunk of a long conversation is given out.
CHUNK = 1 << 20


class TemplateError(ValueError):
    """A template that does not parse, or an expression that its inputs don't allow."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    children: tuple = ()


# Escaping --------------------------------------------------------------------------------------------------


def guard(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """``text`` without any control string: a backslash follows their first character, and backslashes are doubled."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    for c in controls:
        if c in text:
            text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unguard(text: str) -> str:
    """Inverse of guard."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "guard": guard,
    "trim": lambda s: s.strip(),
    "lower": lambda s: s.lower(),
    "upper": lambda s: s.upper(),
    "length": len,
    "default": lambda v, d="": d if v is None else v,
    "replace": lambda s, a, b: s.replace(a, b),
}

# Parsing ---------------------------------------------------------------------------------------------------

_PIECES = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>().,|\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            number, string, name, sign = m.groups()
            if number:
                self.tokens.append(("const", int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: object = None) -> object:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or (value is not None and self.tokens[self.at][1] != value):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("expression goes on after its end")
        return out

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", None, (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", None, (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("not", None, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        out = self.added()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                out = Node("binary", op, (out, self.added()))
            elif self.peek("not"):
                self.take("not")
                self.need("name", "in")
                out = Node("not", None, (Node("binary", "in", (out, self.added())),))
            else:
                return out

    def added(self) -> Node:
        out = self.multiplied()
        while op := self.take("+", "-", "~"):
            out = Node("binary", op, (out, self.multiplied()))
        return out

    def multiplied(self) -> Node:
        out = self.signed()
        while op := self.take("*", "/", "%"):
            out = Node("binary", op, (out, self.signed()))
        return out

    def signed(self) -> Node:
        return Node("minus", None, (self.signed(),)) if self.take("-") else self.filtered()

    def filtered(self) -> Node:
        out = self.reached()
        while self.take("|"):
            name, given = self.need("name"), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                while not self.take(")"):
                    given.append(self.either())
                    if not self.peek(")"):
                        self.need("sign", ",")
            out = Node("filter", name, (out, *given))
        return out

    def reached(self) -> Node:
        out = self.primary()
        while True:
            if self.take("."):
                out = Node("item", None, (out, Node("const", self.need("name"))))
            elif self.take("["):
                out = Node("item", None, (out, self.either()))
                self.need("sign", "]")
            else:
                return out

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Node("const", value)
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Node("const", fixed[value]) if value in fixed else Node("name", value)
        if value == "(":
            out = self.either()
            self.need("sign", ")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    pieces = [p for p in _PIECES.split(template) if p]
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                out.append(Node("print", None, (_Expression(piece[2:-2]).whole(),)))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return Node("block", None, tuple(out)), f"{word} {rest}".strip()
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"for {rest}")
                    body, _ = block("endfor")
                    out.append(Node("for", m[1], (_Expression(m[2]).whole(), body)))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "set":
                    name, sign, value = rest.partition("=")
                    if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                        raise TemplateError(f"set {rest}")
                    out.append(Node("set", name.strip(), (_Expression(value).whole(),)))
                elif word == "generation":
                    out.append(Node("generation", None, (block("endgeneration")[0],)))
                else:
                    raise TemplateError(f"unknown or unmatched {word!r}")
            else:
                out.append(Node("text", piece))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return Node("block", None, tuple(out)), ""

    def branch(condition: str) -> Node:
        test = _Expression(condition).whole()
        body, end = block("elif", "else", "endif")
        other = Node("block")
        if end.startswith("elif"):
            other = branch(end[4:])
        elif end == "else":
            other, _ = block("endif")
        return Node("if", None, (test, body, other))

    return block()[0]


# Folding ---------------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod, "~": lambda a, b: _str(a) + _str(b),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b,
}


def _str(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Node) -> Node:
    """The same tree with constant expressions, branches and neighbouring texts folded."""
    children = tuple(fold(c) for c in node.children)
    node = Node(node.kind, node.value, children)
    constant = bool(children) and all(c.kind == "const" for c in children)
    if node.kind in ("binary", "filter", "not", "minus", "item", "and", "or") and constant:
        try:
            return Node("const", evaluator(node)({}))
        except (TemplateError, TypeError, ArithmeticError, AttributeError):
            return node  # it fails when, and only when, it is reached
    if node.kind == "print" and constant:
        return Node("text", _str(children[0].value))
    if node.kind == "if" and children[0].kind == "const":
        return children[1] if children[0].value else children[2]
    if node.kind == "block":
        out: list[Node] = []
        for c in itertools.chain.from_iterable(c.children if c.kind == "block" else (c,) for c in children):
            if c.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + c.value)
            elif c.kind != "text" or c.value:
                out.append(c)
        return Node("block", None, tuple(out))
    return node


# Closures --------------------------------------------------------------------------------------------------


def evaluator(node: Node) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind, value = node.kind, node.value
    if kind == "const":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    parts = [evaluator(c) for c in node.children]
    if kind == "item":
        base, key = parts

        def item(scope: dict) -> object:
            b, k = base(scope), key(scope)
            if isinstance(b, dict):
                return b.get(k)
            if isinstance(b, (list, tuple)) and isinstance(k, int):
                return b[k] if -len(b) <= k < len(b) else None
            raise TemplateError(f"{type(b).__name__} has no items")

        return item
    if kind == "filter":
        f, first, rest = FILTERS[value], parts[0], parts[1:]
        return (lambda scope: f(first(scope))) if not rest else (lambda scope: f(first(scope), *[r(scope) for r in rest]))
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "minus":
        return lambda scope: -parts[0](scope)
    left, right = parts
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    op = _BINARY[value]
    return lambda scope: op(left(scope), right(scope))


class Output:
    """Rendered text so far and the spans under generation marks, in characters."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def drain(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.spans
        self.__init__()
        return out


def renderer(node: Node, marked: bool = False) -> Callable[[dict, Output], Iterator[None]]:
    """The closure of a statement: a generator that pauses after a loop's rounds when much is written and no mark is open."""
    kind, value = node.kind, node.value
    if kind == "text":

        def text(scope: dict, out: Output) -> Iterator[None]:
            out.put(value)
            return iter(())

        return text
    if kind == "print":
        get = evaluator(node.children[0])

        def show(scope: dict, out: Output) -> Iterator[None]:
            out.put(_str(get(scope)))
            return iter(())

        return show
    if kind == "set":
        get = evaluator(node.children[0])

        def assign(scope: dict, out: Output) -> Iterator[None]:
            scope[value] = get(scope)
            return iter(())

        return assign
    if kind == "block":
        steps = [renderer(c, marked) for c in node.children]

        def block(scope: dict, out: Output) -> Iterator[None]:
            for s in steps:
                yield from s(scope, out)

        return block
    if kind == "if":
        test, yes, no = evaluator(node.children[0]), renderer(node.children[1], marked), renderer(node.children[2], marked)
        return lambda scope, out: (yes if test(scope) else no)(scope, out)
    if kind == "generation":
        body = renderer(node.children[0], True)

        def generation(scope: dict, out: Output) -> Iterator[None]:
            start = out.size
            yield from body(scope, out)
            out.spans.append((start, out.size))

        return generation
    if kind == "for":
        many, body = evaluator(node.children[0]), renderer(node.children[1], marked)

        def loop(scope: dict, out: Output) -> Iterator[None]:
            rows = iter(many(scope) or ())
            now, i = next(rows, loop), 0
            while now is not loop:
                following = next(rows, loop)
                inner = {**scope, value: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": following is loop}}
                yield from body(inner, out)
                if not marked:
                    yield
                now, i = following, i + 1

        return loop
    raise TemplateError(kind)


def _uses(node: Node, name: str) -> int:
    return (node.kind == "name" and node.value == name) + sum(_uses(c, name) for c in node.children)


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        top = self.tree.children if self.tree.kind == "block" else (self.tree,)
        loops = sum(n.kind == "for" and n.children[0] == Node("name", "messages") for n in top)
        #: Whether messages are read once, in order, so that a conversation need not be held as a whole.
        self.streams = loops == 1 and _uses(self.tree, "messages") == 1
        self.run = renderer(self.tree)

    def chunks(self, messages: Iterable[dict], size: int = CHUNK, **scope: object) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, spans) of consecutive parts of the rendered conversation, cut between rounds of a loop."""
        out = Output()
        for _ in self.run({"messages": messages if self.streams else list(messages), **scope}, out):
            if out.size >= size:
                yield out.drain()
        yield out.drain()

    def render(self, messages: Iterable[dict], **scope: object) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans) of the whole conversation."""
        (out,) = self.chunks(messages, 1 << 62, **scope)
        return out


# Spark -----------------------------------------------------------------------------------------------------

_FORMATTED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, chunk, formatted, spans: each conversation's rendered text with the loss mask as spans of characters.

    Turns come in order of ``turn`` (nulls first; ties by role, then text, so repeated rows are repeated turns). Null
    roles and texts count as empty; turns without a conversation id form the conversation null. A
    conversation is one row unless it is longer than a million characters: then its chunks, cut between turns, follow
    each other in the same partition, and neither rendering nor reading back holds more than one of them.
    """
    ship(turns.sparkSession)
    compiled = Template(template)  # errors show here, not on an executor
    assert compiled.tree
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template)

        def messages() -> Iterator[tuple[int | None, dict]]:
            for batch in batches:
                for c, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    yield c, {"role": r, "text": t}

        out, size = [], 0
        for conv, group in itertools.groupby(messages(), key=lambda x: x[0]):
            for no, (text, spans) in enumerate(made.chunks(m for _, m in group)):
                out.append({"conv_id": conv, "chunk": no, "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]})
                size += len(text)
                if size > 4 * CHUNK or len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, _FORMATTED)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _FORMATTED)

    return rows.mapInArrow(run, "conv_id long, chunk int, formatted string, spans array<struct<start: long, end: long>>")


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a text made by TEMPLATE."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        out.append((unguard(m[1]), unguard(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from format_conversations' output, as counts and SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def done() -> dict:
            conv, n, turns, chars, loss, size = now
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if now:
                        out.append(done())
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in row["spans"]:
                    said = unguard(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, _DIGEST)
                out = []
        if now:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_template(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(format_conversations(turns.unionByName(own)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 20 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
