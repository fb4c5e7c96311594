"""Chat formatting with a compiled template language.

A template is text with ``{{ expression }}`` and the blocks ``{% for x in expression %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}`` and ``{% generation %}``, each ended by ``{% endfor %}``, ``{% endif %}``,
``{% endgeneration %}``. Expressions have strings, numbers, names, fields of mappings (``m.role``), ``==``,
``!=``, ``in``, ``and``, ``or``, ``not``, ``+`` and the filters ``escape``, ``trim``, ``upper``, ``lower``.
There are no calls, no attributes of Python objects and no other names than those given, so a template
cannot reach anything else.

``compile_template`` parses the text into a syntax tree, folds constants (operators on literals, branches
with a known condition, neighbouring text) and turns the tree into Python closures. Rendering streams: chunks
go to a sink as they are made, with the generation mark, and ``messages`` may be any iterator, so a
conversation of any length is formatted in the memory of one turn.

Control strings of the template cannot occur in texts: ``escape`` writes ``\\``, ``<`` and ``[`` as ``\\\\``,
``\\l`` and ``\\b``, and ``unescape`` undoes it.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null text or role is empty;
repeated rows are turns of their own; a null conversation id is one conversation; a template error names the
place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded

DEFAULT = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)
#: Characters of formatted text in one output row, about; rows end where turns end.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "b": "["}[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template's text breaks the language's rules."""


# --- parsing: expressions are tuples (kind, ...), statements likewise

_LEXEME = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))""")


def _lexemes(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, loosest operator first: or, and, not, comparison, +, filters, fields."""

    def __init__(self, text: str) -> None:
        self.text, self.left = text, _lexemes(text)

    def parse(self) -> tuple:
        e = self._or()
        if self.left:
            raise TemplateError(f"{self.left[0][1]!r} is left over in {self.text!r}")
        return e

    def _next(self, *values: str) -> str | None:
        if self.left and self.left[0][0] in ("op", "name") and self.left[0][1] in values:
            return self.left.pop(0)[1]
        return None

    def _or(self) -> tuple:
        e = self._and()
        while self._next("or"):
            e = ("or", e, self._and())
        return e

    def _and(self) -> tuple:
        e = self._not()
        while self._next("and"):
            e = ("and", e, self._not())
        return e

    def _not(self) -> tuple:
        return ("not", self._not()) if self._next("not") else self._compare()

    def _compare(self) -> tuple:
        e = self._sum()
        op = self._next("==", "!=", "in")
        return (op, e, self._sum()) if op else e

    def _sum(self) -> tuple:
        e = self._filtered()
        while self._next("+"):
            e = ("+", e, self._filtered())
        return e

    def _filtered(self) -> tuple:
        e = self._field()
        while self._next("|"):
            name = self.left.pop(0)[1] if self.left else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def _field(self) -> tuple:
        e = self._atom()
        while self._next("."):
            kind, name = self.left.pop(0) if self.left else ("", "")
            if kind != "name":
                raise TemplateError(f"a field's name is missing in {self.text!r}")
            e = ("field", e, name)
        return e

    def _atom(self) -> tuple:
        if not self.left:
            raise TemplateError(f"{self.text!r} ends too early")
        kind, value = self.left.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "num":
            return ("const", int(value))
        if value == "(":
            e = self._or()
            if not self._next(")"):
                raise TemplateError(f"a bracket is open in {self.text!r}")
            return e
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return ("const", value == "true") if value in ("true", "false") else ("name", value)
        raise TemplateError(f"{value!r} is out of place in {self.text!r}")


def parse_template(text: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("print", e), ("for", name, e, body), ("if", [(e, body)], else), ("generation", body)."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", text, flags=re.S)
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p.startswith("{{"):
                out.append(("print", _Expression(p[2:-2]).parse()))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return out, p[2:-2].strip()
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {p!r}")
                    inner, _ = body("endfor")
                    out.append(("for", m[1], _Expression(m[2]).parse(), inner))
                elif word == "if":
                    arms, other, condition = [], [], rest
                    while True:
                        inner, end = body("elif", "else", "endif")
                        arms.append((_Expression(condition).parse(), inner))
                        if not end.startswith("elif"):
                            break
                        condition = end[4:]
                    if end == "else":
                        other, _ = body("endif")
                    out.append(("if", arms, other))
                elif word == "generation":
                    inner, _ = body("endgeneration")
                    out.append(("generation", inner))
                else:
                    raise TemplateError(f"{p!r} is out of place")
            elif p:
                out.append(("text", p))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


# --- constant folding

_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
}


def fold_expression(e: tuple) -> tuple:
    kind = e[0]
    if kind in _BINARY:
        a, b = fold_expression(e[1]), fold_expression(e[2])
        return ("const", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold_expression(e[1]), fold_expression(e[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold_expression(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold_expression(e[2])
        return ("const", FILTERS[e[1]](str(a[1]))) if a[0] == "const" else ("filter", e[1], a)
    if kind == "field":
        return ("field", fold_expression(e[1]), e[2])
    return e


def fold(tree: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in tree:
        new = [node]
        if node[0] == "print":
            e = fold_expression(node[1])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("print", e)]
        elif node[0] == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        elif node[0] == "if":
            arms, other = [], fold(node[2])
            for condition, inner in node[1]:
                c = fold_expression(condition)
                if c[0] == "const" and c[1]:
                    other = fold(inner)
                    break
                if c[0] != "const":
                    arms.append((c, fold(inner)))
            new = [("if", arms, other)] if arms else other
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


# --- closures

Sink = Callable[[str, bool], None]


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _value(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        def name(env: dict, n: str = e[1]) -> Any:
            if n not in env:
                raise TemplateError(f"no value {n!r}")
            return env[n]
        return name
    if kind == "field":
        inner = _value(e[1])

        def field(env: dict, n: str = e[2]) -> Any:
            value = inner(env)
            if type(value) is not dict:
                raise TemplateError(f"no field {n!r} of a value that is no mapping")
            return value.get(n)
        return field
    if kind == "filter":
        inner, f = _value(e[2]), FILTERS[e[1]]
        return lambda env: f(_text(inner(env)))
    if kind == "not":
        inner = _value(e[1])
        return lambda env: not inner(env)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


def _block(tree: list[tuple], marked: bool) -> Callable[[dict, Sink], None]:
    steps = [_statement(node, marked) for node in tree]

    def run(env: dict, out: Sink) -> None:
        for step in steps:
            step(env, out)
    return run


def _statement(node: tuple, marked: bool) -> Callable[[dict, Sink], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, s=node[1]: out(s, marked)
    if kind == "print":
        value = _value(node[1])
        return lambda env, out: out(_text(value(env)), marked)
    if kind == "generation":
        return _block(node[1], True)
    if kind == "for":
        items, inner, name = _value(node[2]), _block(node[3], marked), node[1]

        def loop(env: dict, out: Sink) -> None:
            for item in items(env):
                inner(env | {name: item}, out)
        return loop
    arms = [(_value(c), _block(inner, marked)) for c, inner in node[1]]
    other = _block(node[2], marked)

    def choose(env: dict, out: Sink) -> None:
        for condition, inner in arms:
            if condition(env):
                return inner(env, out)
        return other(env, out)
    return choose


def compile_template(text: str) -> Callable[[dict, Sink], None]:
    """A function that renders an environment into a sink."""
    return _block(fold(parse_template(text)), False)


# --- on Spark

PARTS = "conv_id bigint, part bigint, formatted string, loss array<struct<first:int,end:int>>"


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for big in batches:
        for b in bounded(big, columns[-1:]):
            yield from zip(*(b.column(c).to_pylist() for c in columns))


def format_conversations(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """``conv_id``, ``part`` (from 0), ``formatted`` and ``loss`` (character spans under the generation mark).

    Conversations are dealt by id and sorted by turn; a task streams through them. One part holds a whole
    conversation unless that is longer than ``PART_CHARS``; parts of a conversation follow each other.
    """
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rows = compile_template(template), _runs(batches, ["conv_id", "role", "text"])
        done: list[tuple] = []
        chunks: list[str] = []
        spans: list[list[int]] = []
        at = part = 0

        def sink(s: str, marked: bool) -> None:
            nonlocal at
            if s:
                chunks.append(s)
                if marked:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] += len(s)
                    else:
                        spans.append([at, at + len(s)])
                at += len(s)

        def close(conv: int | None) -> None:
            nonlocal at, part, spans
            done.append((conv, part, "".join(chunks), [{"first": a, "end": b} for a, b in spans]))
            chunks.clear()
            spans, at, part = [], 0, part + 1

        def messages(first: tuple, nxt: list) -> Iterator[dict]:
            row = first
            while row is not None and row[0] == first[0]:
                yield {"role": row[1] or "", "text": row[2] or ""}
                if at >= PART_CHARS:  # the template has finished this turn
                    close(first[0])
                row = next(rows, None)
            nxt[0] = row

        def out() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), kind))], names=["conv_id", "part", "formatted", "loss"])
            done.clear()
            return b

        nxt = [next(rows, None)]
        while nxt[0] is not None:
            first, part = nxt[0], 0
            for m in [messages(first, nxt)]:
                run({"messages": m}, sink)
                for _ in m:  # a template need not read all messages
                    pass
            if chunks or not part:
                close(first[0])
            if sum(len(d[2]) for d in done) >= PART_CHARS or len(done) >= 1000:
                yield out()
        if done:
            yield out()

    slim = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, PARTS)


_TURN = re.compile(r"<s>\[ROLE\]([^<\[]*)\[/ROLE\](?:\[INST\]([^<\[]*)\[/INST\]|([^<\[]*))</s>")


def read_back(parts: DataFrame) -> DataFrame:
    """The contract's row per conversation, from output of the default template; ``parts`` as they were made."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        done: list[tuple] = []

        def close() -> None:
            done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        for conv, part, text, loss in _runs(batches, ["conv_id", "part", "formatted", "loss"]):
            if part == 0:
                if state is not None:
                    close()
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
            end = 0
            for m in _TURN.finditer(text):
                if m.start() != end:
                    raise ValueError(f"conversation {conv} cannot be read back at {end}")
                end = m.end()
                state["n"] += 1
                body = m[2] if m[2] is not None else m[3]
                state["turns"].update(f"{unescape(m[1])}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            if end != len(text):
                raise ValueError(f"conversation {conv} cannot be read back at {end}")
            for span in loss:
                said = unescape(text[span["first"] : span["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode("utf-8", "surrogatepass"))
            state["all"] += len(text)
            if len(done) >= 2000:
                yield batch(done)
        if state is not None:
            close()
        if done:
            yield batch(done)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return b

    return parts.mapInArrow(read, schema)
