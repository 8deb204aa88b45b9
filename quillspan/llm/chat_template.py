"""Chat formatting by a template compiler.

A template in a sandboxed language (expressions, ``if``, ``for``, ``set``, ``macro``, ``generation`` blocks, filters and tests; no
attribute access on anything but the given data, no calls but the listed ones, no imports) is parsed into a syntax tree,
constants are folded, and the tree becomes nested Python closures. A closure writes into a buffer that knows its
length, so that each ``{% generation %}`` block yields the code-point range that it rendered.

Language: ``{{ e }}``, ``{% if/elif/else/endif %}``, ``{% for x in e if e %}…{% else %}…{% endfor %}`` with ``break``, ``continue`` and
``loop.index, index0, revindex, revindex0, first, last, length, previtem, nextitem``, ``{% set x = e %}``, ``{% set ns.x = e %}``,
``{% set x %}…{% endset %}``, ``{% macro f(a, b=e) %}…{% endmacro %}``, ``{% generation %}…{% endgeneration %}``, ``{# #}``, ``-`` for
trimming; literals, lists, dictionaries, ``or and not``, comparisons, ``in``, ``+ - * / // % ~``, ``a if b else c``, ``x[i]``, ``x[i:j]``,
``x.name``, the methods ``strip lstrip rstrip startswith endswith upper lower title capitalize split replace`` of texts and
``items keys values get`` of dictionaries, ``is [not]`` with the tests of ``TESTS``, the filters of ``FILTERS``,
``raise_exception(e)``, ``range(n)``, ``namespace(x=e)`` and ``dict(x=e)``.

What a template computes for one conversation is bounded, not only what it writes: texts and lists that it makes may come to
``FREE_CHARS`` and ``TIMES_INPUT`` times what the conversation holds, loops turn ``MOST_TURNS`` times, whole numbers stay
within 64 bits, macros call one another ``MOST_CALLS`` deep and trees are ``MOST_DEPTH`` deep. Beyond, it raises.

Edges: a null text or role is the empty string; turns are ordered by turn, then role, then text, null turns first;
repeated turns are rendered each; turns without a conversation id form no conversation and give no row; an empty
table gives an empty result; a template that raises, or passes a bound, gives a null ``rendered`` and the reason in ``error``; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

CHATML = (
    "{%- for message in messages -%}"
    "{{ '<|im_start|>' + message.role + '\\n' }}"
    "{%- if message.role == 'assistant' -%}{%- generation -%}{{ message.content + '<|im_end|>' }}{%- endgeneration -%}{%- else -%}{{ message.content + '<|im_end|>' }}{%- endif -%}"
    "{{ '\\n' }}"
    "{%- endfor -%}"
)
#: Bounds of one conversation's rendering.
FREE_CHARS, TIMES_INPUT, MOST_TURNS, MOST_DEPTH, MOST_CALLS, TREE_DEPTH = 16_000_000, 64, 10_000_000, 60, 40, 150


class TemplateError(ValueError):
    pass


class _Undefined:
    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0


UNDEFINED = _Undefined()

# ---------------------------------------------------------------- reading

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<e>(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)-?\}\}|\{%-?(?P<s>(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>()\[\]{}.,:|=]))", re.S)


_BLANKS = re.compile(r"(?<=\n)[ \t]+\Z")


def _pieces(template: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list[tuple[str, str]]:
    """('text' | 'print' | 'stmt', content), with white space trimmed where tags ask for it.

    ``trim_blocks`` drops a line end right after a statement, ``lstrip_blocks`` blanks between a line's begin and a statement.
    """
    out: list[list[str]] = []
    at, trim, block = 0, False, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        if trim:
            text = text.lstrip()
        elif trim_blocks and block and text.startswith("\n"):
            text = text[1:]
        inner = m[0]
        block = not inner.startswith("{{")
        if lstrip_blocks and block:
            text = _BLANKS.sub("", text) if at or "\n" in text or text.strip(" \t") else ""
        if inner[2] == "-":
            text = text.rstrip()
        if text:
            out.append(["text", text])
        trim = inner[-3] == "-"
        at = m.end()
        if inner.startswith("{{"):
            out.append(["print", m["e"]])
        elif inner.startswith("{%"):
            out.append(["stmt", m["s"].strip()])
    text = template[at:]
    text = text.lstrip() if trim else text[1:] if trim_blocks and block and text.startswith("\n") else text
    if "{{" in text or "{%" in text:
        raise TemplateError("a tag isn't closed")
    if text:
        out.append(["text", text])
    return [tuple(x) for x in out]


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    """Recursive descent over one tag's tokens; trees are tuples (kind, ...)."""

    def __init__(self, code: str):
        self.tokens, self.at, self.depth = _tokens(code), 0, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = self.disjunction()
        if self.take("if"):
            condition = self.disjunction()
            out = ("cond", condition, out, self.expression() if self.take("else") else ("const", UNDEFINED))
        self.depth -= 1
        return out

    def disjunction(self):
        out = self.conjunction()
        while self.take("or"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("and"):
            out = ("and", out, self.negation())
        return out

    def deeper(self, read: Callable):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = read()
        self.depth -= 1
        return out

    def negation(self):
        return ("not", self.deeper(self.negation)) if self.take("not") else self.comparison()

    def comparison(self):
        out = self.concatenation()
        while True:
            if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                out = ("op", op, out, self.concatenation())
            elif self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                out = ("not", ("op", "in", out, self.concatenation()))
            else:
                return out

    def concatenation(self):
        out = self.sum()
        while self.take("~"):
            out = ("op", "~", out, self.sum())
        return out

    def sum(self):
        out = self.product()
        while op := self.take("+", "-"):
            out = ("op", op, out, self.product())
        return out

    def product(self):
        out = self.unary()
        while op := self.take("*", "/", "//", "%"):
            out = ("op", op, out, self.unary())
        return out

    def unary(self):
        if self.take("-"):
            return ("neg", self.deeper(self.unary))
        return self.postfix(self.primary())

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "str":
            return ("const", ast.literal_eval('u' + value.replace("\n", "\\n")))
        if kind == "name":
            constants = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            if value in constants:
                return ("const", constants[value])
            if self.take("("):
                return ("call", value, self.arguments(")"))
            return ("var", value)
        if value == "(":
            out = self.expression()
            self.need(")")
            return out
        if value == "[":
            return ("list", self.arguments("]"))
        if value == "{":
            pairs = []
            while not self.take("}"):
                k = self.expression()
                self.need(":")
                pairs.append((k, self.expression()))
                if not self.take(","):
                    self.need("}")
                    break
            return ("dict", pairs)
        raise TemplateError(f"unexpected {value!r}")

    def arguments(self, close: str) -> list:
        out = []
        while not self.take(close):
            if close == ")" and self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                out.append(("named", name, self.expression()))
            elif out and out[-1][0] == "named":
                raise TemplateError("a value without a name after one with a name")
            else:
                out.append(self.expression())
            if not self.take(","):
                self.need(close)
                break
        return out

    def postfix(self, out):
        while True:
            if self.take("."):
                name = self.name()
                if self.take("("):
                    if name not in METHODS:
                        raise TemplateError(f"no method {name!r}")
                    out = ("method", name, out, self.arguments(")"))
                else:
                    out = ("item", out, ("const", name))
            elif self.take("["):
                first = None if self.peek(":") else self.expression()
                if self.take(":"):
                    last = None if self.peek("]") else self.expression()
                    out = ("slice", out, first or ("const", None), last or ("const", None))
                else:
                    out = ("item", out, first)
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = ("filter", name, out, self.arguments(")") if self.take("(") else [])
            elif self.take("is"):
                negated = bool(self.take("not"))
                name = self.name()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                out = ("test", name, out, self.arguments(")") if self.take("(") else [])
                out = ("not", out) if negated else out
            else:
                return out


def _depth(tree) -> int:
    """Levels of a tree, found without recursion."""
    deepest, todo = 0, [(tree, 1)]
    while todo:
        node, level = todo.pop()
        if isinstance(node, (tuple, list)):
            deepest = max(deepest, level)
            todo += [(x, level + isinstance(node, tuple)) for x in node]
    return deepest


def parse(template: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list:
    """The syntax tree: a list of ('text', s), ('print', e), ('if', [(e, body)], body), ('for', …), ('set', …), ('macro', …), ('generation', body)."""
    pieces, at, macros, looping = _pieces(template, trim_blocks, lstrip_blocks), 0, set(), 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[list, str]:
        nonlocal at, looping
        if depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                out.append(("text", content))
                continue
            if kind == "print":
                p = _Parser(content)
                out.append(("print", p.expression()))
                p.end()
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return out, content
            if word == "if":
                branches, otherwise, condition = [], [], rest
                while True:
                    p = _Parser(condition)
                    test = p.expression()
                    p.end()
                    inner, end = body(("elif", "else", "endif"), depth + 1)
                    branches.append((test, inner))
                    if end.startswith("elif"):
                        condition = end[4:]
                        continue
                    if end == "else":
                        otherwise, _ = body(("endif",), depth + 1)
                    break
                out.append(("if", branches, otherwise))
            elif word == "for":
                p = _Parser(rest)
                names = [p.name()]
                if p.take(","):
                    names.append(p.name())
                p.need("in")
                over = p.disjunction()
                test = p.expression() if p.take("if") else None
                p.end()
                looping += 1
                inner, end = body(("else", "endfor"), depth + 1)
                looping -= 1
                otherwise = body(("endfor",), depth + 1)[0] if end == "else" else []
                out.append(("for", names, over, test, inner, otherwise))
            elif word == "set":
                p = _Parser(rest)
                name = p.name()
                within = p.name() if p.take(".") else None
                if within is None and p.at == len(p.tokens):
                    out.append(("capture", name, body(("endset",), depth + 1)[0]))
                    continue
                p.need("=")
                out.append(("set", name, p.expression(), within))
                p.end()
            elif word == "macro":
                p = _Parser(rest)
                name = p.name()
                p.need("(")
                parameters = []
                while not p.take(")"):
                    parameters.append([p.name(), p.expression() if p.take("=") else None])
                    if not p.take(","):
                        p.need(")")
                        break
                p.end()
                macros.add(name)
                outside, looping = looping, 0
                out.append(("macro", name, parameters, body(("endmacro",), depth + 1)[0]))
                looping = outside
            elif content in ("break", "continue"):
                if not looping:
                    raise TemplateError(f"{content} outside a loop")
                out.append((content,))
            elif word == "generation":
                out.append(("generation", body(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    tree = body((), 0)[0]
    if _depth(tree) > TREE_DEPTH:
        raise TemplateError("nested too deeply")
    _check_calls(tree, macros)
    return tree


def _check_calls(tree, macros: set[str]) -> None:
    """Only listed functions and the template's macros are called, and no macro marks what is generated."""
    todo = [(tree, False)]
    while todo:
        node, in_macro = todo.pop()
        if isinstance(node, tuple) and node:
            if node[0] == "call" and node[1] not in CALLS and node[1] not in macros:
                raise TemplateError(f"no function {node[1]!r}")
            if node[0] == "generation" and in_macro:
                raise TemplateError("a generation block in a macro")
            in_macro = in_macro or node[0] in ("macro", "capture")
        if isinstance(node, (tuple, list)):
            todo += [(x, in_macro) for x in node if isinstance(x, (tuple, list))]


# ---------------------------------------------------------------- meaning

class _Budget:
    """What one rendering may still make, in characters and items, and how deep its macro calls are. A worker renders one at a time."""

    left, calls = FREE_CHARS, 0


def _spend(n: int) -> None:
    _Budget.left -= n
    if _Budget.left < 0:
        raise TemplateError("too much is made")


def _made(x):
    """A new text or list, paid for."""
    _spend(len(x))
    return x


def _weighed(x):
    """Pays for every value within x, as often as it is met: what is small but names itself many times counts in full."""
    todo = [x]
    while todo:
        y = todo.pop()
        if isinstance(y, dict):
            _spend(len(y) + 1)
            todo += [*y, *y.values()]
        elif isinstance(y, (list, tuple)):
            _spend(len(y) + 1)
            todo += y
        elif isinstance(y, str):
            _spend(len(y))
    return x


def _text(x) -> str:
    if isinstance(x, str):
        return x
    return "" if x is UNDEFINED else str(_weighed(x)) if isinstance(x, (list, dict)) else str(x)


def _number(x):
    if isinstance(x, int) and not -(1 << 63) <= x < 1 << 63:
        raise TemplateError("a whole number beyond 64 bits")
    return x


def _plus(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return _number(a + b)
    if isinstance(a, str) != isinstance(b, str):
        a, b = (_text(a), _text(b)) if UNDEFINED in (a, b) else _raise("text and another type can't be added")
    _spend(len(a) + len(b))
    return a + b


def _raise(message: str):
    raise TemplateError(message)


def _numbers(f: Callable) -> Callable:
    def run(a, b):
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            raise TemplateError("only numbers can be reckoned with")
        return _number(f(a, b))

    return run


def _compared(f: Callable) -> Callable:
    def run(a, b):
        if isinstance(a, (list, dict)) or isinstance(b, (list, dict)):
            _weighed(a)
            _weighed(b)
        return f(a, b)

    return run


def _within(a, b) -> bool:
    if isinstance(b, str):
        _spend(len(b) >> 4)
    elif isinstance(b, (list, dict)):
        _weighed(b) if isinstance(a, (list, dict)) else _spend(len(b) >> 2)
    return a in b


def _joined(x, by="", attribute=None) -> str:
    parts = [_text(y if attribute is None else _item(y, attribute)) for y in x]
    _spend(sum(map(len, parts)) + len(_text(by)) * len(parts))
    return _text(by).join(parts)


def _exchanged(x, a, b, count=-1) -> str:
    x, a, b = _text(x), _text(a), _text(b)
    _spend(len(x) + (x.count(a) if count < 0 else min(count, x.count(a))) * len(b))
    return x.replace(a, b, count)


def _json(x, indent=None) -> str:
    if x is UNDEFINED:
        return '""'
    _weighed(x)
    return _made(json.dumps(x, ensure_ascii=False, indent=min(indent, 8) if isinstance(indent, int) else None))


def _default(x, value="", boolean=False):
    return value if x is UNDEFINED or (boolean and not x) else x


def _picked(keep: bool):
    def run(x, attribute, test=None, *more) -> list:
        if test is not None and test not in TESTS:
            raise TemplateError(f"no test {test!r}")
        return _made([y for y in x if bool(_item(y, attribute) if test is None else TESTS[test](_item(y, attribute), *more)) == keep])

    return run


def _mapped(x, name=None, *more, attribute=None) -> list:
    if attribute is not None:
        return _made([_item(y, attribute) for y in x])
    if name not in FILTERS:
        raise TemplateError(f"no filter {name!r}")
    return _made([FILTERS[name](y, *more) for y in x])


def _split(x: str, by=None, most=-1) -> list:
    return _made(x.split(by, most))


OPERATIONS: dict[str, Callable] = {
    "+": _plus, "-": _numbers(lambda a, b: a - b), "*": _numbers(lambda a, b: a * b), "/": _numbers(lambda a, b: a / b), "//": _numbers(lambda a, b: a // b), "%": _numbers(lambda a, b: a % b), "~": lambda a, b: _plus(_text(a), _text(b)),
    "==": _compared(lambda a, b: a == b), "!=": _compared(lambda a, b: a != b), "<": _compared(lambda a, b: a < b), ">": _compared(lambda a, b: a > b), "<=": _compared(lambda a, b: a <= b), ">=": _compared(lambda a, b: a >= b), "in": _within,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _made(_text(x).strip()), "upper": lambda x: _made(_text(x).upper()), "lower": lambda x: _made(_text(x).lower()), "title": lambda x: _made(_text(x).title()), "capitalize": lambda x: _made(_text(x).capitalize()), "length": len, "count": len,
    "first": lambda x: x[0] if len(x) else UNDEFINED, "last": lambda x: x[-1] if len(x) else UNDEFINED, "join": _joined, "default": _default, "d": _default, "replace": _exchanged,
    "tojson": _json, "string": _text, "safe": _text, "int": lambda x, y=0: _number(int(x)) if x is not UNDEFINED else y, "float": float, "abs": lambda x: _number(abs(x)), "reverse": lambda x: _made(x[::-1]), "list": lambda x: _made(list(x)),
    "items": lambda x: _made(list(x.items())) if isinstance(x, dict) else [], "selectattr": _picked(True), "rejectattr": _picked(False), "map": _mapped,
    "sum": lambda x: _number(sum(x)), "min": min, "max": max, "unique": lambda x: _made(list(dict.fromkeys(x))), "sort": lambda x, reverse=False: _made(sorted(x, reverse=bool(reverse))), "split": lambda x, *a: _split(_text(x), *a),
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict),
    "sequence": lambda x: isinstance(x, (list, str, tuple)), "iterable": lambda x: isinstance(x, (list, str, dict, tuple)), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool),
    "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "equalto": lambda x, y: OPERATIONS["=="](x, y), "eq": lambda x, y: OPERATIONS["=="](x, y), "ne": lambda x, y: OPERATIONS["!="](x, y), "in": _within,
}


class _Namespace(dict):
    """What ``set ns.x`` may change from within loops."""


def _named_values(**values) -> dict:
    return dict(values)


CALLS: dict[str, Callable] = {
    "raise_exception": lambda m="": _raise(_text(m)), "range": lambda *a: _made(list(range(*a))) if all(isinstance(x, int) and abs(x) <= MOST_TURNS for x in a) and len(range(*a)) <= max(0, _Budget.left) else _raise("the range is too long"),
    "namespace": lambda **values: _Namespace(values), "dict": _named_values,
}


def _on(kind: type, f: Callable) -> Callable:
    def run(x, *args, **named):
        if not isinstance(x, kind):
            raise TemplateError("no such method of this value")
        return f(x, *args, **named)

    return run


METHODS: dict[str, Callable] = {
    **{k: _on(str, lambda x, *a, f=getattr(str, k): _made(f(x, *a))) for k in ("strip", "lstrip", "rstrip", "upper", "lower", "title", "capitalize")},
    **{k: _on(str, lambda x, y, f=getattr(str, k): f(x, y)) for k in ("startswith", "endswith")},
    "split": _on(str, _split), "replace": _on(str, _exchanged), "items": _on(dict, lambda x: _made(list(x.items()))), "keys": _on(dict, lambda x: _made(list(x))), "values": _on(dict, lambda x: _made(list(x.values()))),
    "get": _on(dict, lambda x, k, y=None: x.get(k, y)),
}


def _item(x, key):
    """Keys of mappings and positions of lists and texts, nothing else: no attribute of any object is reachable."""
    if isinstance(x, dict):
        return x.get(key, UNDEFINED)
    if isinstance(x, (list, str, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else UNDEFINED
    return UNDEFINED


def fold(tree):
    """The tree with every expression of constants replaced by its value, and dead branches and joined texts removed."""
    if isinstance(tree, list):
        out: list = []
        for node in tree:
            for new in _folded_statement(node):
                if new[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + new[1])
                elif new != ("text", ""):
                    out.append(new)
        return out
    kind = tree[0]
    if kind in ("const", "var"):
        return tree
    if kind in ("list",):
        tree = ("list", [fold(x) for x in tree[1]])
        parts = tree[1]
    elif kind == "dict":
        return ("dict", [(fold(k), fold(v)) for k, v in tree[1]])
    elif kind == "named":
        return ("named", tree[1], fold(tree[2]))
    elif kind == "call":
        return ("call", tree[1], [fold(x) for x in tree[2]])
    elif kind == "method":
        tree = ("method", tree[1], fold(tree[2]), [fold(x) for x in tree[3]])
        parts = [tree[2], *tree[3]]
    elif kind == "filter":
        tree = ("filter", tree[1], fold(tree[2]), [fold(x) for x in tree[3]])
        parts = [tree[2], *tree[3]]
    elif kind == "op":
        tree = (kind, tree[1], *map(fold, tree[2:]))
        parts = tree[2:]
    elif kind == "test":
        tree = ("test", tree[1], fold(tree[2]), [fold(x) for x in tree[3]])
        parts = [tree[2], *tree[3]]
    elif kind == "cond":
        condition = fold(tree[1])
        if condition[0] == "const":
            return fold(tree[2] if condition[1] else tree[3])
        return ("cond", condition, fold(tree[2]), fold(tree[3]))
    else:
        tree = (kind, *map(fold, tree[1:]))
        parts = tree[1:]
        if kind in ("and", "or") and parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind != "list" and all(x[0] == "const" for x in parts):
        try:
            _Budget.left = FREE_CHARS
            value = _closure(tree)({})
            return tree if isinstance(value, (list, dict)) else ("const", value)  # what can be changed is made anew each time
        except Exception:  # noqa: BLE001  what a constant raises, it raises when it is rendered
            return tree
    return tree


def _folded_statement(node) -> list:
    kind = node[0]
    if kind == "print":
        e = fold(node[1])
        return [("text", _text(e[1]))] if e[0] == "const" else [("print", e)]
    if kind == "if":
        branches, otherwise = [], fold(node[2])
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const":
                if test[1]:
                    otherwise = fold(body)
                    break
                continue
            branches.append((test, fold(body)))
        return [("if", branches, otherwise)] if branches else otherwise
    if kind == "for":
        return [("for", node[1], fold(node[2]), node[3] and fold(node[3]), fold(node[4]), fold(node[5]))]
    if kind == "set":
        return [("set", node[1], fold(node[2]), node[3])]
    if kind == "capture":
        return [("capture", node[1], fold(node[2]))]
    if kind == "macro":
        return [("macro", node[1], [(n, e and fold(e)) for n, e in node[2]], fold(node[3]))]
    if kind == "generation":
        return [("generation", fold(node[1]))]
    return [node]


class _Out:
    """Rendered parts, their length in code points, and the ranges of generation blocks."""

    __slots__ = ("parts", "size", "spans", "turns")

    def __init__(self):
        self.parts, self.size, self.spans, self.turns = [], 0, [], 0

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)
        _spend(len(s))


class _Leave(Exception):
    """``break``."""


class _Next(Exception):
    """``continue``."""


class _Macro:
    def __init__(self, name: str, parameters: list, body: Callable, scope: dict):
        self.name, self.parameters, self.body, self.scope = name, parameters, body, scope

    def __call__(self, *args, **named) -> str:
        if len(args) > len(self.parameters) or set(named) - {n for n, _ in self.parameters}:
            raise TemplateError(f"{self.name} has no such parameter")
        _Budget.calls += 1
        if _Budget.calls > MOST_CALLS:
            raise TemplateError("macros call one another too deeply")
        scope, out = dict(self.scope), _Out()
        for i, (n, default) in enumerate(self.parameters):
            scope[n] = args[i] if i < len(args) else named[n] if n in named else default(scope) if default else UNDEFINED
        self.body(scope, out)
        _Budget.calls -= 1
        return "".join(out.parts)


def _arguments(trees: list) -> Callable:
    """The call's values: (positions, names)."""
    plain, named = [_closure(x) for x in trees if x[0] != "named"], [(x[1], _closure(x[2])) for x in trees if x[0] == "named"]
    if not named:
        return lambda v: ([p(v) for p in plain], {})
    return lambda v: ([p(v) for p in plain], {n: e(v) for n, e in named})


def _closure(tree) -> Callable:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda v: value
    if kind == "var":
        name = tree[1]
        return lambda v: v.get(name, UNDEFINED)
    if kind == "item":
        of, key = _closure(tree[1]), tree[2]
        if key[0] == "const":
            k = key[1]
            return lambda v: _item(of(v), k)
        by = _closure(key)
        return lambda v: _item(of(v), by(v))
    if kind == "slice":
        of, a, b = map(_closure, tree[1:])
        return lambda v: _made(of(v)[a(v) : b(v)])
    if kind == "op":
        f, a, b = OPERATIONS[tree[1]], _closure(tree[2]), _closure(tree[3])
        return lambda v: f(a(v), b(v))
    if kind == "and":
        a, b = _closure(tree[1]), _closure(tree[2])
        return lambda v: a(v) and b(v)
    if kind == "or":
        a, b = _closure(tree[1]), _closure(tree[2])
        return lambda v: a(v) or b(v)
    if kind == "not":
        a = _closure(tree[1])
        return lambda v: not a(v)
    if kind == "neg":
        a = _closure(tree[1])
        return lambda v: -a(v)
    if kind == "cond":
        c, a, b = map(_closure, tree[1:])
        return lambda v: a(v) if c(v) else b(v)
    if kind == "list":
        parts = [_closure(x) for x in tree[1]]
        return lambda v: _made([p(v) for p in parts])
    if kind == "dict":
        pairs = [(_closure(k), _closure(x)) for k, x in tree[1]]
        return lambda v: {k(v): x(v) for k, x in pairs}
    if kind in ("filter", "method"):
        f, of, more = (FILTERS if kind == "filter" else METHODS)[tree[1]], _closure(tree[2]), _arguments(tree[3])
        if not tree[3]:
            return lambda v: f(of(v))

        def applied(v):
            args, named = more(v)
            return f(of(v), *args, **named)

        return applied
    if kind == "test":
        f, of, more = TESTS[tree[1]], _closure(tree[2]), _arguments(tree[3])
        return (lambda v: f(of(v), *more(v)[0])) if tree[3] else (lambda v: f(of(v)))
    if kind == "call":
        name, more = tree[1], _arguments(tree[2])
        known = CALLS.get(name)

        def called(v):
            f = v.get(name) if isinstance(v.get(name), _Macro) else known
            if f is None:
                raise TemplateError(f"{name} isn't defined here")
            args, named = more(v)
            return f(*args, **named)

        return called
    raise TemplateError(f"no expression {kind!r}")


def _writer(body: list) -> Callable:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(v: dict, out: _Out) -> None:
        for step in steps:
            step(v, out)

    return run


def _step(node) -> Callable:
    kind = node[0]
    if kind == "text":
        s = node[1]
        return lambda v, out: out.write(s)
    if kind == "print":
        e = _closure(node[1])
        return lambda v, out: out.write(_text(e(v)))
    if kind == "set":
        name, e, within = node[1], _closure(node[2]), node[3]

        def assign(v: dict, out: _Out) -> None:
            if within is None:
                v[name] = e(v)
            elif isinstance(v.get(name), _Namespace):
                v[name][within] = e(v)
            else:
                raise TemplateError(f"{name} is no namespace")

        return assign
    if kind == "capture":
        name, inner = node[1], _writer(node[2])

        def capture(v: dict, out: _Out) -> None:
            own = _Out()
            inner(v, own)
            v[name] = "".join(own.parts)

        return capture
    if kind == "macro":
        name, parameters, inner = node[1], [(n, e and _closure(e)) for n, e in node[2]], _writer(node[3])

        def define(v: dict, out: _Out) -> None:
            v[name] = _Macro(name, parameters, inner, v)

        return define
    if kind in ("break", "continue"):
        sign = _Leave if kind == "break" else _Next

        def leave(v: dict, out: _Out) -> None:
            raise sign

        return leave
    if kind == "if":
        branches, otherwise = [(_closure(t), _writer(b)) for t, b in node[1]], _writer(node[2])

        def choose(v: dict, out: _Out) -> None:
            for test, body in branches:
                if test(v):
                    return body(v, out)
            return otherwise(v, out)

        return choose
    if kind == "generation":
        inner = _writer(node[1])

        def mark(v: dict, out: _Out) -> None:
            begin = out.size
            inner(v, out)
            if out.size > begin:
                out.spans.append((begin, out.size))

        return mark
    names, over, test = node[1], _closure(node[2]), node[3] and _closure(node[3])
    inner, otherwise = _writer(node[4]), _writer(node[5])

    def loop(v: dict, out: _Out) -> None:
        items = over(v)
        items = list(items.items() if isinstance(items, dict) and len(names) == 2 else items)
        scope = dict(v)  # what a loop sets ends with it

        def bind(x) -> None:
            if len(names) == 1:
                scope[names[0]] = x
            else:
                scope[names[0]], scope[names[1]] = x

        if test:
            kept = []
            for x in items:
                bind(x)
                if test(scope):
                    kept.append(x)
            items = kept
        out.turns += len(items)
        if out.turns > MOST_TURNS:
            raise TemplateError("loops turn too often")
        n = len(items)
        for i, x in enumerate(items):
            bind(x)
            scope["loop"] = {"index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n, "previtem": items[i - 1] if i else UNDEFINED, "nextitem": items[i + 1] if i < n - 1 else UNDEFINED}
            try:
                inner(scope, out)
            except _Next:
                continue
            except _Leave:
                break
        if not n:
            otherwise(v, out)

    return loop


@lru_cache(maxsize=64)
def compiled(template: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of (messages, **variables) that gives the text and its generation ranges."""
    run = _writer(fold(parse(template, trim_blocks, lstrip_blocks)))

    def render(messages: list[dict], **variables) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        _Budget.left, _Budget.calls = FREE_CHARS + TIMES_INPUT * sum(len(x) for m in messages for x in m.values() if isinstance(x, str)), 0
        try:
            run({"messages": messages, **variables}, out)
        except TemplateError:
            raise
        except Exception as e:  # noqa: BLE001  any fault of a template on some conversation is a template error
            raise TemplateError(f"{type(e).__name__}: {e}") from e
        return "".join(out.parts), out.spans

    return render


def formatted(turns: DataFrame, template: str = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", variables: dict | None = None, trim_blocks: bool = False, lstrip_blocks: bool = False) -> DataFrame:
    """(conv_col, n_turns, rendered, generation array<struct<begin,end>>, error). One exchange, by conversation."""
    compiled(template, trim_blocks, lstrip_blocks)  # faults of the template itself come before any job
    given = dict(variables or {})
    rows = turns.where(col(conv_col).isNotNull()).select(col(conv_col).alias("conv"), F.struct(col(turn_col).alias("t"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("content")).alias("m"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("m"))

    @F.pandas_udf("rendered string, generation array<struct<begin:int,end:int>>, error string")
    def render(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        run = compiled(template, trim_blocks, lstrip_blocks)
        for roles, contents in batches:
            out = []
            for r, c in zip(roles, contents):
                try:
                    text, spans = run([{"role": a, "content": b} for a, b in zip(r, c)], **given)
                    out.append((text, [{"begin": a, "end": b} for a, b in spans], None))
                except TemplateError as e:
                    out.append((None, None, str(e)))
            yield pd.DataFrame(out, columns=["rendered", "generation", "error"])

    done = whole.select(F.col("conv").alias(conv_col), F.size("m").alias("n_turns"), render(F.col("m.role"), F.col("m.content")).alias("r"))
    return done.select(col(conv_col), "n_turns", "r.rendered", "r.generation", "r.error")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = formatted(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "n_turns", "rendered", F.to_json("generation").alias("generation"), "error")


ORACLES = {
    "op3_chat_formatting": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        m AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole FROM t),
        p AS (SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(whole) AS begun FROM m)
        SELECT conv_id, count(*)::INTEGER AS n_turns, string_agg(whole, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
            '[' || coalesce(string_agg('{"begin":' || (begun + length(head))::BIGINT || ',"end":' || (begun + length(whole) - 1)::BIGINT || '}', ',' ORDER BY begun) FILTER (WHERE role = 'assistant'), '') || ']' AS generation,
            NULL::VARCHAR AS error
        FROM p GROUP BY conv_id
    """,
}
