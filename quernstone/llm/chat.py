"""Chat formatting by compiling a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures.  Rendering writes pieces to a sink, each marked as
inside or outside a ``generation`` block, and takes messages one at a time, so
that a conversation of any length needs the memory of one turn.

The language: ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% set x = expression %}``, ``{% generation %}``
and the matching ``end`` tags; ``-`` inside a tag's bounds strips blanks.
Expressions have ``or and not``, comparisons, ``in``, ``+``, ``~``, literals,
names, members of mappings and filters of a fixed list.  Nothing else of Python
can be reached: there are no calls, attributes, imports or names with underscores
in front.

Defined results: rows go by turn, then role, then text, nulls first; a null
text or role is empty; repeated rows are repeated turns; a null conv_id is a
conversation of its own; further columns are ignored; an empty table has only
the conversation that the query adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import _run

#: Strings with a meaning for models; all begin with one of the characters that escaping breaks up.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_UNITS = re.compile(r"<\\|\[\\|\\\\")


def escape(text: str) -> str:
    """Break up whatever could begin a control string; :func:`unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _UNITS.sub(lambda m: m[0][0], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_show(v)),
    "trim": lambda v: _show(v).strip(),
    "upper": lambda v: _show(v).upper(),
    "lower": lambda v: _show(v).lower(),
    "length": len,
}


class TemplateError(ValueError):
    """The template can't be parsed, or asks for something that isn't there."""


def _show(v) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


_TAG = re.compile(r"\{(?:\{(-?)(.*?)(-?)\}|%(-?)(.*?)(-?)%)\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z][A-Za-z0-9_]*)|(==|!=|<=|>=|[<>+~|.()\[\]=]))""", re.S)
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at, code = [], 0, code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at:]!r}")
        number, text, name, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif text:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif name:
            out.append(("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag; nodes are tuples, kind first."""

    def __init__(self, code: str) -> None:
        self.left = _tokens(code)

    def next(self, *wanted: tuple[str, str]) -> bool:
        if self.left and self.left[0] in wanted:
            self.left.pop(0)
            return True
        return False

    def need(self, kind: str, value: object = None):
        if not self.left or self.left[0][0] != kind or value is not None and self.left[0][1] != value:
            raise TemplateError(f"expected {value or kind}")
        return self.left.pop(0)[1]

    def end(self, node):
        if self.left:
            raise TemplateError(f"left over: {self.left}")
        return node

    def either(self):
        node = self.both()
        while self.next(("name", "or")):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.next(("name", "and")):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.next(("name", "not")) else self.compared()

    def compared(self):
        node = self.sum()
        while self.left and self.left[0][1] in _COMPARE and self.left[0][0] != "const":
            node = ("compare", self.left.pop(0)[1], node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.left and self.left[0] in (("sign", "+"), ("sign", "~")):
            node = (self.left.pop(0)[1], node, self.filtered())
        return node

    def filtered(self):
        node = self.member()
        while self.next(("sign", "|")):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def member(self):
        node = self.atom()
        while True:
            if self.next(("sign", ".")):
                node = ("member", node, ("const", self.need("name")))
            elif self.next(("sign", "[")):
                node = ("member", node, self.either())
                self.need("sign", "]")
            else:
                return node

    def atom(self):
        if self.next(("sign", "(")):
            node = self.either()
            self.need("sign", ")")
            return node
        if not self.left:
            raise TemplateError("an expression ends too early")
        kind, value = self.left.pop(0)
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of statements."""
    root: list[tuple] = []
    open_: list[tuple[str, list, object]] = [("", root, None)]
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        at = m.end()
        text = text.lstrip() if strip else text
        value = m[2] is not None
        text = text.rstrip() if (m[1] if value else m[4]) else text
        strip = bool(m[3] if value else m[6])
        body = open_[-1][1]
        if text:
            body.append(("text", text))
        if value:
            e = _Expression(m[2])
            body.append(("out", e.end(e.either())))
            continue
        word, _, rest = m[5].strip().partition(" ")
        e = _Expression(rest)
        if word == "for":
            name = e.need("name")
            e.need("name", "in")
            node = ("for", name, e.end(e.either()), [])
            body.append(node)
            open_.append(("for", node[3], None))
        elif word == "if":
            arms = [(e.end(e.either()), [])]
            body.append(("if", arms))
            open_.append(("if", arms[0][1], arms))
        elif word in ("elif", "else"):
            kind, _, arms = open_.pop()
            if kind != "if":
                raise TemplateError(f"{word} without if")
            arms.append((e.end(e.either()) if word == "elif" else ("const", True), []))
            open_.append(("if", arms[-1][1], arms))
        elif word == "set":
            name = e.need("name")
            e.need("sign", "=")
            body.append(("set", name, e.end(e.either())))
        elif word == "generation":
            node = ("generation", [])
            body.append(node)
            open_.append(("generation", node[1], None))
        elif word.startswith("end") and word[3:] == open_[-1][0] and len(open_) > 1:
            open_.pop()
        else:
            raise TemplateError(f"unexpected {word}")
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        open_[-1][1].append(("text", text))
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't ended")
    return root


def _apply(node: tuple, values: list):
    kind = node[0]
    if kind == "compare":
        return _COMPARE[node[1]](*values)
    if kind == "filter":
        return FILTERS[node[1]](*values)
    if kind == "+":
        return values[0] + values[1]
    if kind == "~":
        return _show(values[0]) + _show(values[1])
    if kind == "not":
        return not values[0]
    if kind == "or":
        return values[0] or values[1]
    if kind == "and":
        return values[0] and values[1]
    return values[0].get(values[1]) if isinstance(values[0], dict) else None


def fold_expression(node: tuple) -> tuple:
    """Replace what has only constants below by its value."""
    if node[0] in ("const", "name"):
        return node
    parts = [fold_expression(x) if isinstance(x, tuple) else x for x in node]
    below = [x for x in parts[1:] if isinstance(x, tuple)]
    if all(x[0] == "const" for x in below):
        return ("const", _apply(node, [x[1] for x in below]))
    return tuple(parts)


def fold(body: list[tuple]) -> list[tuple]:
    """Fold constants, choose arms with constant conditions and join neighbouring texts."""
    out: list[tuple] = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", _show(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            add(node)
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    below = [_value(x) for x in node[1:] if isinstance(x, tuple)]
    if kind == "member" and node[2][0] == "const":
        of, key = below[0], node[2][1]

        def member(env):
            v = of(env)
            return v.get(key) if isinstance(v, dict) else None

        return member
    if kind == "or":
        return lambda env: below[0](env) or below[1](env)
    if kind == "and":
        return lambda env: below[0](env) and below[1](env)
    if kind in ("compare", "filter"):
        f = _COMPARE[node[1]] if kind == "compare" else FILTERS[node[1]]
        return (lambda env, a=below[0]: f(a(env))) if len(below) == 1 else (lambda env, a=below[0], b=below[1]: f(a(env), b(env)))
    return lambda env: _apply(node, [b(env) for b in below])


def _statement(node: tuple) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda env, emit, masked, t=node[1]: emit(t, masked)
    if kind == "out":
        value = _value(node[1])
        return lambda env, emit, masked: emit(_show(value(env)), masked)
    if kind == "set":
        name, value = node[1], _value(node[2])
        return lambda env, emit, masked: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = _block(node[1])
        return lambda env, emit, masked: inner(env, emit, True)
    if kind == "if":
        arms = [(_value(t), _block(b)) for t, b in node[1]]

        def choose(env, emit, masked):
            for test, inner in arms:
                if test(env):
                    return inner(env, emit, masked)

        return choose
    name, items, inner = node[1], _value(node[2]), _block(node[3])

    def loop(env, emit, masked):
        it = iter(items(env) or ())
        done = object()
        item, i = next(it, done), 0
        while item is not done:
            later = next(it, done)
            inner({**env, name: item, "loop": {"index": i + 1, "index0": i, "first": not i, "last": later is done}}, emit, masked)
            item, i = later, i + 1

    return loop


def _block(body: list[tuple]) -> Callable:
    steps = [_statement(x) for x in body]

    def run(env, emit, masked):
        for step in steps:
            step(env, emit, masked)

    return run


class Template:
    """A compiled template."""

    def __init__(self, source: str) -> None:
        self.run = _block(fold(parse(source)))

    def stream(self, emit: Callable[[str, bool], None], **names) -> None:
        """Render to ``emit(piece, in a generation block)``."""
        self.run(dict(names), emit, False)

    def render(self, **names) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the code point ranges that a model has to generate."""
        pieces: list[str] = []
        spans: list[list[int]] = []
        at = 0

        def emit(piece, masked):
            nonlocal at
            pieces.append(piece)
            if masked and piece:
                if spans and spans[-1][1] == at:
                    spans[-1][1] += len(piece)
                else:
                    spans.append([at, at + len(piece)])
            at += len(piece)

        self.stream(emit, **names)
        return "".join(pieces), [tuple(s) for s in spans]


#: Turns between markers; what assistants say, and only that, is under the loss mask.
TURNS = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"


class Reader:
    """Reads turns and the loss mask back from pieces of formatted text as they come."""

    TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)

    def __init__(self) -> None:
        self.chars = self.turns = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.open: list[str] = []
        self.masked: list[str] = []

    def feed(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        self.open.append(piece)
        if masked:
            self.masked.append(piece)
        elif self.masked:
            self.close_mask()
        if "<|end|>\n" in piece:
            text = "".join(self.open)
            at = 0
            while m := self.TURN.match(text, at):
                self.turns += 1
                self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                at = m.end()
            self.open = [text[at:]] if at < len(text) else []

    def close_mask(self) -> None:
        text = unescape("".join(self.masked))
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.masked = []

    def result(self) -> tuple:
        if self.masked:
            self.close_mask()
        if self.open:
            raise ValueError(f"formatted text can't be read back: {''.join(self.open)[:80]!r}")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _conversations(it) -> Iterable[tuple[int | None, Iterable[dict]]]:
    rows = ((c, r, t) for b in it for c, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
    for conv, turns in groupby(rows, key=lambda x: x[0]):
        yield conv, ({"role": r or "", "text": t or ""} for _, r, t in turns)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(rows: DataFrame, template: str = TURNS) -> DataFrame:
    """``(conv_id, text, generated array<struct<start,end>>)``: each conversation as a model sees it."""

    def run(it):
        compiled = Template(template)
        for conv, messages in _conversations(it):
            text, spans = compiled.render(messages=messages)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text], pa.string()), pa.array([[{"start": a, "end": b} for a, b in spans]], kind)], ["conv_id", "text", "generated"])

    _run.small_batches(rows.sparkSession)
    return _in_order(rows).mapInArrow(_run.tidy(run), "conv_id long, text string, generated array<struct<start:long,end:long>>")


def round_trip(rows: DataFrame, template: str = TURNS) -> DataFrame:
    """Format each conversation and read turns and loss mask back from what comes out."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(it):
        compiled = Template(template)
        found: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        for conv, messages in _conversations(it):
            reader = Reader()
            compiled.stream(reader.feed, messages=messages)
            found.append((conv, *reader.result()))
            if len(found) == 1000:
                yield batch()
                found = []
        if found:
            yield batch()

    _run.small_batches(rows.sparkSession)
    return _in_order(rows).mapInArrow(_run.tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation full of control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and a tricky one, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = _run.local_rows(spark, [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return round_trip(rows.unionByName(tricky))


OP8_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), each AS (
  SELECT *, length(text) AS n, length(role) AS r,
    length(text) + length(role)
      + (3 * length(text) - length(replace(text, '\\', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')))
      + (3 * length(role) - length(replace(role, '\\', '')) - length(replace(role, '<', '')) - length(replace(role, '[', ''))) + 24 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role0 NULLS FIRST, text0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM each GROUP BY conv_id
"""
