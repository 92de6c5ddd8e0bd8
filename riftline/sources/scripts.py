"""Script files (JavaScript, TypeScript) as a table of syntax nodes.

A file is one row and its nodes come out of Arrow batches; everything that asks about nodes is a join on the table.
Numbers are in the order of a walk from the top, so that what a node holds are the numbers from its own to ``last``.

The reader knows expressions, bindings, functions, loops over keys and exports, which the rules ask about, and passes over
the rest. A file whose brackets, strings or comments do not close, or that nests deeper than Python's stack, has no
nodes, like one that a strict parser gives up on. Null texts and files of other languages have none either.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions.rules import AST_LANGUAGES

NODES = (
    "file_id {key}, node int, last int, parent int, slot string, place int, kind string, name string, text string, computed boolean, operator string, plus int, cat int, "
    "line int, col int, end_line int, end_col int"
)

SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*)*")
TOKEN = re.compile(
    r"""(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.`@#])"
)
PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]+)\}|u([\da-fA-F]{4})|x([\da-fA-F]{2})|\r?\n|([\s\S]))")
#: How tightly binary operators hold.
TIGHT = {op: k for k, ops in enumerate((("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in", "as", "satisfies"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",)), 1) for op in ops}
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="))
PREFIX = frozenset(("!", "~", "+", "-", "++", "--", "typeof", "void", "delete"))
MODIFIERS = frozenset(("public", "private", "protected", "readonly", "override", "declare", "abstract"))
CLOSING = {"(": ")", "[": "]", "{": "}"}


class Broken(Exception):
    """The text does not parse."""


def unescaped(literal: str) -> str:
    """Value of a string literal without its quotes."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code and int(code, 16) < 0x110000 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", None: ""}.get(m[4], m[4] or "")

    return ESCAPE.sub(one, literal) if "\\" in literal else literal


class Node:
    """A node before it is numbered; kids are (slot, node) in the order of the walk."""

    __slots__ = ("kind", "start", "end", "name", "text", "computed", "operator", "kids")

    def __init__(self, kind: str, start: int, kids=(), *, name=None, text=None, computed=False, operator=None, end=0):
        self.kind, self.start, self.end, self.name, self.text, self.computed, self.operator, self.kids = kind, start, end, name, text, computed, operator, list(kids)


class Reader:
    """Reads one text; ``one`` is the token at hand as (group, value, start, end)."""

    def __init__(self, text: str, typed: bool):
        self.text, self.typed, self.before, self.at = text, typed, 0, 0
        self.step()

    # tokens

    def step(self) -> None:
        self.before = self.at
        start = SPACE.match(self.text, self.at).end()
        if start == len(self.text):
            self.group, self.value, self.start, self.at = "end", "", start, start
            return
        m = TOKEN.match(self.text, start)
        if not m or self.text.startswith("/*", start):
            raise Broken
        self.group, self.value, self.start, self.at = m.lastgroup, m[0], start, m.end()

    def back(self, state: tuple) -> None:
        self.group, self.value, self.start, self.at, self.before = state

    def here(self) -> tuple:
        return self.group, self.value, self.start, self.at, self.before

    def next_is(self, *values: str) -> bool:
        """Whether the token after the one at hand is one of ``values``."""
        m = TOKEN.match(self.text, SPACE.match(self.text, self.at).end())
        return bool(m) and m[0] in values

    def new_line(self) -> bool:
        return "\n" in self.text[self.before : self.start]

    def sees(self, *values: str) -> bool:
        return self.value in values and self.group in ("mark", "name")

    def take(self, *values: str) -> bool:
        if self.sees(*values):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Broken

    def done(self, node: Node) -> Node:
        node.end = self.before
        return node

    def skip_type(self, stops: frozenset[str]) -> None:
        """Pass over a type up to one of ``stops`` outside brackets."""
        while not (self.group == "end" or self.sees(*stops) or self.sees(")", "]", "}", ";")):
            if self.sees("{", "(", "["):
                self.skip_group()
            elif self.sees("<"):
                self.skip_angles()
            else:
                arrow = self.sees("=>", "|", "&", ":", "?", ",", "keyof", "typeof", "extends", "is", "infer", "readonly", "new", "asserts")
                self.step()
                if not arrow and self.new_line() and not self.sees("|", "&", "=>", ".", "[", "extends", "?", ":", "is") and "=" not in stops:
                    return

    def skip_group(self) -> None:
        """Pass over a bracketed group."""
        depth = 0
        while True:
            if self.group == "end":
                raise Broken
            if self.sees("{", "(", "["):
                depth += 1
            elif self.sees("}", ")", "]"):
                depth -= 1
            if self.sees("`"):
                self.template()
                continue
            self.step()
            if not depth:
                return

    def skip_angles(self) -> bool:
        """Pass over type arguments; whether they close."""
        depth = 0
        while self.group != "end":
            if self.sees("{", "(", "["):
                self.skip_group()
                continue
            if self.sees(";", ")", "]", "}"):
                return False
            depth += self.value.count("<") - (self.value.count(">") if self.value != "=>" else 0)
            self.step()
            if depth <= 0:
                return True
        return False

    # statements

    def program(self) -> Node:
        top = Node("Program", 0)
        while self.group != "end":
            if self.sees(")", "]", "}"):
                raise Broken
            top.kids.append(("body", self.statement()))
        top.end = len(self.text)
        return top

    def block(self, kind: str = "BlockStatement") -> Node:
        node = Node(kind, self.start)
        self.need("{")
        while not self.sees("}"):
            if self.group == "end" or self.sees(")", "]"):
                raise Broken
            node.kids.append(("body", self.statement()))
        self.step()
        return self.done(node)

    def statement(self) -> Node:
        start, v = self.start, self.value if self.group in ("name", "mark") else ""
        if v == "{":
            return self.block()
        if v == ";":
            self.step()
            return self.done(Node("EmptyStatement", start))
        if v in ("var", "let", "const", "using") and not self.next_is("=", ".", "(", ";", ","):
            if v == "const" and self.next_is("enum"):
                self.step()
                return self.statement()
            return self.ended(self.declaration())
        if v == "function" or (v == "async" and self.next_is("function")):
            return self.function("FunctionDeclaration")
        if v in ("class", "abstract") and (v == "class" or self.next_is("class")):
            self.take("abstract")
            return self.klass("ClassDeclaration")
        if v.startswith("@") and self.group == "name":
            self.decorator()
            return self.statement()
        if v == "export":
            return self.export()
        if v == "import" and not self.next_is("(", "."):
            self.step()
            while not (self.group == "end" or self.sees(";")):
                ends = self.group == "string"
                if self.sees("{"):
                    self.skip_group()
                else:
                    self.step()
                if ends and not self.sees("with", "assert"):
                    break
            self.take(";")
            return self.done(Node("ImportDeclaration", start))
        if v == "for":
            return self.loop()
        if v in ("if", "while", "switch", "with", "catch"):
            self.step()
            node = Node("Statement", start)
            if self.take("("):
                node.kids.append(("test", self.expression() if v != "catch" else self.pattern()))
                self.skip_type(frozenset(")")) if v == "catch" else None
                self.need(")")
            if v != "switch":
                node.kids.append(("body", self.statement()))
                return self.done(node)
            self.need("{")
            while not self.take("}"):
                if self.take("case"):
                    node.kids.append(("test", self.expression()))
                    self.need(":")
                elif self.sees("default") and self.next_is(":"):
                    self.step()
                    self.step()
                elif self.group == "end" or self.sees(")", "]"):
                    raise Broken
                else:
                    node.kids.append(("body", self.statement()))
            return self.done(node)
        if v in ("else", "try", "finally", "do") and not self.next_is("=", ".", ":", "("):
            self.step()
            return self.statement()
        if v in ("return", "throw"):
            self.step()
            node = Node("Statement", start)
            if not (self.new_line() or self.group == "end" or self.sees(";", "}")):
                node.kids.append(("argument", self.expression()))
            return self.ended(node)
        if v in ("break", "continue", "debugger"):
            self.step()
            if self.group == "name" and not self.new_line():
                self.step()
            return self.ended(Node("Statement", start))
        if self.typed and v in ("interface", "namespace", "module", "enum", "declare", "type", "global") and not self.next_is("=", ".", "(", ";", ",", ")"):
            return self.typing()
        if self.group == "name" and self.next_is(":") and v not in ("default",):
            self.step()
            self.step()
            return self.statement()
        return self.ended(Node("ExpressionStatement", start, [("expression", self.expression())]))

    def ended(self, node: Node) -> Node:
        self.take(";")
        return self.done(node)

    def typing(self) -> Node:
        """A declaration of types alone; its name is kept."""
        start, kind = self.start, self.value
        self.step()
        if kind == "declare":
            return self.statement()
        node = Node("TypeDeclaration", start, name=self.value if self.group == "name" else None)
        if self.group in ("name", "string"):
            self.step()
        if kind in ("namespace", "module"):
            while self.take("."):
                self.step()
            if self.sees("{"):
                node.kids.append(("body", self.block()))
            return self.ended(node)
        if kind == "type":
            if self.sees("<"):
                self.skip_angles()
            self.need("=")
            self.take("|", "&")
            self.skip_type(frozenset())
            return self.ended(node)
        while not (self.group == "end" or self.sees("{")):
            self.step()
        self.skip_group()
        return self.ended(node)

    def export(self) -> Node:
        start = self.start
        self.step()
        if self.take("default"):
            node = Node("ExportDefaultDeclaration", start, name="default")
            if self.sees("function") or (self.sees("async") and self.next_is("function")):
                inner = self.function("FunctionDeclaration")
            elif self.sees("class") or (self.sees("abstract") and self.next_is("class")) or self.value.startswith("@"):
                inner = self.statement()
            elif self.typed and self.sees("interface") and not self.next_is(";"):
                inner = self.typing()
            else:
                inner = self.assignment()
            if inner.kind in ("FunctionDeclaration", "ClassDeclaration", "TypeDeclaration", "ClassExpression", "FunctionExpression"):
                node.name = inner.name or "default"
            node.kids.append(("declaration", inner))
            return self.ended(node)
        if self.take("*"):
            node = Node("ExportAllDeclaration", start, name="*")
            if self.take("as"):
                node.kind, node.name = "ExportNamedDeclaration", self.name_of()
            return self.source(node)
        if self.typed and self.sees("="):
            self.step()
            return self.ended(Node("Statement", start, [("argument", self.expression())]))
        if self.typed and self.sees("type") and self.next_is("{", "*"):
            self.step()
        if self.sees("{"):
            node, first = Node("ExportNamedDeclaration", start), True
            self.step()
            while not self.take("}"):
                if self.group == "end":
                    raise Broken
                if self.sees("type") and not self.next_is(",", "}", "as"):
                    self.step()
                shown = local = self.name_of()
                node.kids.append(("specifier", Node("Identifier", self.before - len(local), name=local, end=self.before)))
                if self.take("as"):
                    shown = self.name_of()
                node.name, first = (shown if first else node.name), False
                self.take(",")
            return self.source(node)
        inner = self.statement()
        name = inner.name
        if inner.kind == "VariableDeclaration":
            ids = [k for k in inner.kids[0][1].kids if k[0] == "id"]
            name = ids[0][1].name if ids and ids[0][1].kind == "Identifier" else None
        return self.done(Node("ExportNamedDeclaration", start, [("declaration", inner)], name=name))

    def name_of(self) -> str:
        if self.group not in ("name", "string"):
            raise Broken
        value = self.value
        self.step()
        return value.strip("\"'")

    def source(self, node: Node) -> Node:
        if self.take("from"):
            self.step()
            if self.take("with", "assert"):
                self.skip_group()
        return self.ended(node)

    def declaration(self, of_loop: bool = False) -> Node:
        node = Node("VariableDeclaration", self.start)
        self.step()
        while True:
            one = Node("VariableDeclarator", self.start)
            target = self.pattern()
            one.name = target.name if target.kind == "Identifier" else None
            one.kids.append(("id", target))
            self.take("!")
            if self.take(":"):
                self.skip_type(frozenset(("=", ",", "in", "of")))
                target.end = self.before
            if self.take("="):
                one.kids.append(("init", self.assignment(no_in=of_loop)))
            node.kids.append(("declarator", self.done(one)))
            if not self.take(","):
                return self.done(node)

    def loop(self) -> Node:
        node = Node("ForStatement", self.start)
        self.step()
        self.take("await")
        self.need("(")
        if not self.sees(";"):
            inner = self.declaration(of_loop=True) if self.sees("var", "let", "const", "using") else self.expression(no_in=True)
            node.kids.append(("init", inner))
        if self.sees("in", "of"):
            node.kind = "ForInStatement" if self.value == "in" else "ForOfStatement"
            node.kids[0] = ("left", node.kids[0][1])
            self.step()
            node.kids.append(("right", self.expression()))
        else:
            for slot in ("test", "update"):
                self.need(";")
                if not self.sees(";", ")"):
                    node.kids.append((slot, self.expression()))
        self.need(")")
        node.kids.append(("body", self.statement()))
        return self.done(node)

    def decorator(self) -> None:
        self.step()
        while self.take("."):
            self.step()
        if self.sees("("):
            self.skip_group()

    # functions and classes

    def function(self, kind: str) -> Node:
        node = Node(kind, self.start)
        self.take("async")
        self.need("function")
        self.take("*")
        if self.group == "name" and not self.sees("("):
            node.name = self.value
            node.kids.append(("id", self.identifier()))
        return self.rest_of_function(node)

    def rest_of_function(self, node: Node) -> Node:
        """From type parameters or parameters to the end of the body."""
        if self.sees("<"):
            self.skip_angles()
        self.parameters(node)
        if self.take(":"):
            self.skip_type(frozenset(("{", ";"))) if not self.sees("{") else self.skip_group()
        if self.sees("{"):
            node.kids.append(("body", self.block()))
        else:
            self.take(";")
        return self.done(node)

    def parameters(self, node: Node) -> None:
        self.need("(")
        while not self.take(")"):
            if self.group == "end":
                raise Broken
            while self.group == "name" and self.value.startswith("@"):
                self.decorator()
            while self.typed and self.sees(*MODIFIERS) and not self.next_is(",", ")", ":", "=", "?"):
                self.step()
            node.kids.append(("param", self.parameter()))
            self.take(",")

    def parameter(self) -> Node:
        """A parameter with its signature in ``text``: x, x?, x=, ...x, {…} or […]."""
        start = self.start
        if self.take("..."):
            inner = self.parameter()
            return self.done(Node("RestElement", start, [("argument", inner)], text="..." + (inner.text or "_")))
        node = self.pattern()
        node.text = {"ObjectPattern": "{…}", "ArrayPattern": "[…]"}.get(node.kind, node.name or "_")
        if self.take("?"):
            node.text += "?"
        if self.take(":"):
            self.skip_type(frozenset(("=", ",")))
            node.end = self.before
        if self.take("="):
            node = self.done(Node("AssignmentPattern", start, [("left", node), ("right", self.assignment())], text=node.text + "="))
        return node

    def pattern(self) -> Node:
        if self.sees("{", "["):
            node = self.primary()
            node.kind = {"ObjectExpression": "ObjectPattern", "ArrayExpression": "ArrayPattern"}.get(node.kind, node.kind)
            return node
        return self.identifier()

    def identifier(self) -> Node:
        if self.group != "name":
            raise Broken
        node = Node("Identifier", self.start, name=self.value)
        self.step()
        return self.done(node)

    def klass(self, kind: str) -> Node:
        node = Node(kind, self.start)
        self.need("class")
        if self.group == "name" and not self.sees("extends", "implements"):
            node.name = self.value
            node.kids.append(("id", self.identifier()))
        if self.sees("<"):
            self.skip_angles()
        if self.take("extends"):
            node.kids.append(("extends", self.unary()))
            if self.sees("<"):
                self.skip_angles()
        while not (self.sees("{") or self.group == "end"):
            self.step()
        body = Node("ClassBody", self.start)
        self.need("{")
        while not self.take("}"):
            if self.group == "end":
                raise Broken
            if not self.take(";"):
                body.kids.append(("member", self.member()))
        node.kids.append(("body", self.done(body)))
        return self.done(node)

    def member(self) -> Node:
        """A class member, or a property of an object literal when it is none of the plain forms."""
        node = Node("ClassMember", self.start)
        while self.group == "name" and self.value.startswith("@"):
            self.decorator()
        while self.sees("static", "async", "get", "set", "accessor", *MODIFIERS) and not self.next_is("(", "=", ";", ":", "{", "}", ",", "<", "?", "!"):
            self.step()
        if self.sees("static") and self.next_is("{"):
            self.step()
            node.kids.append(("body", self.block()))
            return self.done(node)
        self.take("*")
        node.kids.append(("key", self.key()))
        self.take("?", "!")
        if self.sees("(", "<"):
            return self.rest_of_function(node)
        if self.take(":"):
            self.skip_type(frozenset(("=", ",")))
        if self.take("="):
            node.kids.append(("value", self.assignment()))
        self.take(";")
        return self.done(node)

    def key(self) -> Node:
        if self.sees("["):
            self.step()
            node = self.assignment()
            if self.take(":"):
                self.skip_type(frozenset())
            self.need("]")
            return node
        if self.group == "name":
            return self.identifier()
        if self.group in ("string", "number"):
            return self.primary()
        raise Broken

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.sees(","):
            return first
        node = Node("SequenceExpression", first.start, [("expression", first)])
        while self.take(","):
            node.kids.append(("expression", self.assignment(no_in)))
        return self.done(node)

    def assignment(self, no_in: bool = False) -> Node:
        start = self.start
        if arrow := self.arrow():
            return arrow
        if self.sees("yield") and not self.next_is("=", ".", ","):
            self.step()
            self.take("*")
            node = Node("YieldExpression", start)
            if not (self.new_line() or self.group == "end" or self.sees(")", "]", "}", ",", ";", ":")):
                node.kids.append(("argument", self.assignment(no_in)))
            return self.done(node)
        left = self.binary(0, no_in)
        if self.sees("?"):
            self.step()
            node = Node("ConditionalExpression", start, [("test", left), ("consequent", self.assignment())])
            self.need(":")
            node.kids.append(("alternate", self.assignment(no_in)))
            return self.done(node)
        if self.group == "mark" and self.value in ASSIGN:
            op = self.value
            self.step()
            return self.done(Node("AssignmentExpression", start, [("left", left), ("right", self.assignment(no_in))], operator=op))
        return left

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        state, node = self.here(), Node("ArrowFunctionExpression", self.start)
        if self.sees("async") and not self.next_is("=>", "=", ".", ",", ")", ";", "function"):
            self.step()
        if self.group == "name" and self.next_is("=>") and not self.new_line():
            param = self.identifier()
            param.text = param.name
            node.kids.append(("param", param))
            self.step()
        elif self.sees("(") or (self.typed and self.sees("<")):
            try:
                if self.sees("<"):
                    self.skip_angles()
                self.look_past_parentheses()
                after = self.here()
                if self.sees(":") and self.typed:
                    self.step()
                    self.skip_group() if self.sees("{") else self.skip_type(frozenset(("=>", ",")))
                arrow = self.sees("=>")
                end = self.here()
                self.back(state)
                if not arrow:
                    return None
                self.take("async")
                if self.sees("<"):
                    self.skip_angles()
                self.parameters(node)
                if self.here()[2] != after[2]:
                    raise Broken
                self.back(end)
                self.step()
            except Broken:
                self.back(state)
                return None
        else:
            self.back(state)
            return None
        node.kids.append(("body", self.block() if self.sees("{") else self.assignment()))
        return self.done(node)

    def look_past_parentheses(self) -> None:
        """Go behind the group at hand; what opened where is remembered, so that nested groups are passed but once."""
        known = self.__dict__.setdefault("_behind", {})
        if self.start not in known:
            open_ = []
            start = self.start
            while True:
                if self.group == "end":
                    raise Broken
                if self.sees("`"):
                    self.template()
                    continue
                if self.sees("/", "/=") and (m := PATTERN.match(self.text, self.start)) and self.operand_place():
                    self.at = m.end()
                elif self.sees("(", "[", "{"):
                    open_.append((self.start, self.value))
                elif self.sees(")", "]", "}"):
                    at, mark = open_.pop()
                    if CLOSING[mark] != self.value:
                        raise Broken
                    if mark == "(":
                        known[at] = self.start
                self.last = self.value if self.group == "mark" or self.value in ("return", "typeof", "case", "in", "of") else "x"
                self.step()
                if not open_:
                    return
            known[start] = self.start
        close = known[self.start]
        self.at = close
        self.step()
        self.step()

    def operand_place(self) -> bool:
        return getattr(self, "last", "(") not in (")", "]", "}", "x")

    def binary(self, floor: int, no_in: bool) -> Node:
        start = self.start  # of the parenthesis, if the left side stands in one
        left = self.unary()
        while self.value in TIGHT and self.group in ("mark", "name") and TIGHT[self.value] > floor:
            op = self.value
            if op == "in" and no_in:
                return left
            if op in ("as", "satisfies"):
                if not self.typed or self.new_line():
                    return left
                self.step()
                self.cast()
                left = self.done(Node("TypeCast", start, [("expression", left)]))
                continue
            self.step()
            right = self.binary(TIGHT[op] - (op == "**"), no_in)
            left = self.done(Node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", start, [("left", left), ("right", right)], operator=op))
        return left

    def cast(self) -> None:
        """Pass over the type of a cast."""
        while self.take("keyof", "typeof", "readonly", "unique"):
            pass
        while True:
            if self.sees("{", "("):
                self.skip_group()
            elif self.group in ("name", "string", "number"):
                self.step()
                while self.take("."):
                    self.step()
                if self.sees("<"):
                    self.skip_angles()
            while self.sees("[") and not self.new_line():
                self.skip_group()
            if not self.take("|", "&", "=>"):
                return

    def unary(self) -> Node:
        start = self.start
        if self.sees("await") and not self.next_is("=", ".", ",", ")", ";", "=>"):
            self.step()
            return self.done(Node("AwaitExpression", start, [("argument", self.unary())]))
        if self.value in PREFIX and self.group in ("mark", "name"):
            op = self.value
            self.step()
            return self.done(Node("UnaryExpression", start, [("argument", self.unary())], operator=op))
        node = self.postfix(self.primary(), start)
        if self.sees("++", "--") and not self.new_line():
            self.step()
            node = self.done(Node("UpdateExpression", start, [("argument", node)]))
        return node

    def postfix(self, node: Node, start: int, calls: bool = True) -> Node:
        optional = False
        while True:
            if self.sees("?."):
                self.step()
                optional = True
                if not self.sees("[", "("):
                    node = self.done(Node("OptionalMemberExpression", start, [("object", node), ("property", self.identifier())]))
                    continue
            elif self.sees("."):
                self.step()
                node = self.done(Node("OptionalMemberExpression" if optional else "MemberExpression", start, [("object", node), ("property", self.identifier())]))
                continue
            if self.sees("["):
                self.step()
                inner = self.expression()
                self.need("]")
                node = self.done(Node("OptionalMemberExpression" if optional else "MemberExpression", start, [("object", node), ("property", inner)], computed=True))
            elif self.sees("(") and calls:
                node = Node("OptionalCallExpression" if optional else "CallExpression", start, [("callee", node)])
                self.arguments(node)
            elif self.sees("`"):
                node = self.done(Node("TaggedTemplate", start, [("tag", node), ("quasi", self.template())]))
            elif self.typed and self.sees("!") and not self.new_line():
                self.step()
                node = self.done(Node("TypeCast", start, [("expression", node)]))
            elif self.typed and self.sees("<") and calls:
                state = self.here()
                try:
                    closed = self.skip_angles() and self.sees("(", "`")
                except Broken:
                    closed = False
                if not closed:
                    self.back(state)
                    return node
            else:
                return node

    def arguments(self, node: Node) -> None:
        self.need("(")
        while not self.take(")"):
            if self.group == "end":
                raise Broken
            start = self.start
            if self.take("..."):
                node.kids.append(("argument", self.done(Node("SpreadElement", start, [("argument", self.assignment())]))))
            else:
                node.kids.append(("argument", self.assignment()))
            if not self.sees(")"):
                self.need(",")
        self.done(node)

    def primary(self) -> Node:
        start, v = self.start, self.value
        if self.group == "string":
            self.step()
            return self.done(Node("StringLiteral", start, text=unescaped(v[1:-1])))
        if self.group == "number":
            self.step()
            return self.done(Node("BigIntLiteral" if v.endswith("n") and v[:2] not in ("0x", "0X") else "NumericLiteral", start, text=v))
        if self.group == "name":
            if v in ("true", "false", "null"):
                self.step()
                return self.done(Node("NullLiteral" if v == "null" else "BooleanLiteral", start, text=v))
            if v == "this":
                self.step()
                return self.done(Node("ThisExpression", start))
            if v == "function" or (v == "async" and self.next_is("function")):
                return self.function("FunctionExpression")
            if v == "class":
                return self.klass("ClassExpression")
            if v == "new":
                self.step()
                if self.take("."):
                    self.step()
                    return self.done(Node("MetaProperty", start))
                of = self.start
                node = Node("NewExpression", start, [("callee", self.postfix(self.primary(), of, calls=False))])
                if self.typed and self.sees("<"):
                    self.skip_angles()
                if self.sees("("):
                    self.arguments(node)
                return self.done(node)
            return self.identifier()
        if v == "(":
            self.step()
            node = self.expression()
            if self.take(":"):
                self.skip_type(frozenset())
            self.need(")")
            return node
        if v == "[":
            return self.array()
        if v == "{":
            return self.object()
        if v == "`":
            return self.template()
        if v in ("/", "/="):
            m = PATTERN.match(self.text, start)
            if not m:
                raise Broken
            self.at = m.end()
            self.step()
            return self.done(Node("RegExpLiteral", start))
        if v == "<":
            return self.markup()
        raise Broken

    def array(self) -> Node:
        node = Node("ArrayExpression", self.start)
        self.step()
        while not self.take("]"):
            if self.group == "end" or self.sees(")", "}"):
                raise Broken
            start = self.start
            if self.take(","):
                continue
            if self.take("..."):
                node.kids.append(("element", self.done(Node("SpreadElement", start, [("argument", self.assignment())]))))
            else:
                node.kids.append(("element", self.assignment()))
        return self.done(node)

    def object(self) -> Node:
        node = Node("ObjectExpression", self.start)
        self.step()
        while not self.take("}"):
            if self.group == "end" or self.sees(")", "]"):
                raise Broken
            start = self.start
            if self.take("..."):
                node.kids.append(("property", self.done(Node("SpreadElement", start, [("argument", self.assignment())]))))
            else:
                one = Node("ObjectProperty", start)
                while self.sees("async", "get", "set") and not self.next_is("(", ":", ",", "}", "="):
                    self.step()
                self.take("*")
                one.kids.append(("key", self.key()))
                if self.take(":"):
                    one.kids.append(("value", self.assignment()))
                elif self.sees("(", "<"):
                    self.rest_of_function(one)
                elif self.take("="):
                    one.kids.append(("value", self.assignment()))
                node.kids.append(("property", self.done(one)))
            if not self.sees("}"):
                self.need(",")
        return self.done(node)

    def template(self) -> Node:
        """A template: its raw text joined by blanks is in ``text``."""
        node, parts, at = Node("TemplateLiteral", self.start), [], self.start + 1
        while True:
            k = at
            while k < len(self.text) and self.text[k] != "`" and not self.text.startswith("${", k):
                k += 2 if self.text[k] == "\\" else 1
            if k >= len(self.text):
                raise Broken
            parts.append(self.text[at:k])
            if self.text[k] == "`":
                self.at = k + 1
                self.step()
                node.text = " ".join(parts)
                return self.done(node)
            self.at = k + 2
            self.step()
            node.kids.append(("expression", self.expression()))
            if not self.sees("}"):
                raise Broken
            at = self.start + 1

    def markup(self) -> Node:
        """An element: text is passed over, attributes and children in braces are read."""
        node, text = Node("JSXElement", self.start), self.text
        at = self.start + 1
        tag = re.compile(r"\s*([\w$.:-]*)").match(text, at)
        at = tag.end()
        while True:  # attributes
            at = SPACE.match(text, at).end()
            if text.startswith("/>", at):
                self.at = at + 2
                self.step()
                return self.done(node)
            if at >= len(text):
                raise Broken
            if text[at] == ">":
                at += 1
                break
            if text[at] == "{":
                at = self.braces(node, at)
            elif text[at] in "\"'":
                at = text.find(text[at], at + 1) + 1
                if not at:
                    raise Broken
            elif m := re.compile(r"[\w$:.-]+|=").match(text, at):
                at = m.end()
            else:
                raise Broken
        while True:  # children
            k = min((p for p in (text.find("<", at), text.find("{", at)) if p >= 0), default=-1)
            if k < 0:
                raise Broken
            if text[k] == "{":
                at = self.braces(node, k)
            elif m := re.compile(r"</\s*[\w$.:-]*\s*>").match(text, k):
                self.at = m.end()
                self.step()
                return self.done(node)
            else:
                self.at = k
                self.step()
                node.kids.append(("child", self.markup()))
                at = self.before

    def braces(self, node: Node, at: int) -> int:
        self.at = at + 1
        self.step()
        self.take("...")
        if not self.sees("}"):
            node.kids.append(("child", self.expression()))
        if not self.sees("}"):
            raise Broken
        return self.start + 1


def _name(node: Node, names: dict[int, str | None]) -> str | None:
    """Dotted name of an identifier, ``this`` or a plain member; names of the parts are known already."""
    if node.kind == "Identifier":
        return node.name
    if node.kind == "ThisExpression":
        return "this"
    if node.kind == "MemberExpression" and not node.computed:
        of, part = names.get(id(node.kids[0][1])), node.kids[1][1].name
        return f"{of}.{part}" if of and part and not part.startswith("#") else None
    return node.name


def rows(text: str, typed: bool) -> list[tuple]:
    """The nodes of a text in the order of the walk, as in ``NODES`` without the file; none if it does not parse."""
    try:
        top = Reader(text, typed).program()
    except (Broken, RecursionError, IndexError):
        return []
    order, stack = [], [(top, -1, "", 0)]
    while stack:
        node, parent, slot, place = stack.pop()
        me = len(order)
        order.append((node, parent, slot, place))
        seen: dict[str, int] = {}
        kids = []
        for s, k in node.kids:
            kids.append((k, me, s, seen.get(s, 0)))
            seen[s] = seen.get(s, 0) + 1
        stack.extend(reversed(kids))
    last, names = list(range(len(order))), {}
    for me in range(len(order) - 1, -1, -1):
        node, parent, _, _ = order[me]
        names[id(node)] = _name(node, names)
        if parent >= 0:
            last[parent] = max(last[parent], last[me])
    lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def place_of(at: int) -> tuple[int, int]:
        k = bisect_right(lines, at)
        return k, at - lines[k - 1]

    out, plus, cat = [], [], []
    for me, (node, parent, slot, place) in enumerate(order):
        above = order[parent][0] if parent >= 0 else None
        in_sum = above is not None and above.kind == "BinaryExpression" and above.operator == "+"
        plus.append(plus[parent] if in_sum else me)
        cat.append(cat[parent] if in_sum or (above is not None and above.kind == "TemplateLiteral") else me)
        out.append((me, last[me], parent, slot, place, node.kind, names[id(node)], node.text, node.computed, node.operator, plus[me], cat[me], *place_of(node.start), *place_of(node.end)))
    return out


def nodes(files: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """The node table of the script files among ``files``; see ``NODES`` for its columns.

    slot and place: the part that a node has in its parent. name: the dotted name of identifiers and plain members, the
    bound name of a declaration, the symbol of an export. text: value of strings, raw text of templates, signature of
    parameters. plus and cat: the outermost sum, or sum or template, that a node is a part of (itself otherwise).
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            for file, body, typed in zip(batch["k"], batch["t"], batch["typed"], strict=True):
                if found := rows(body, typed):
                    yield pd.DataFrame([(file, *r) for r in found], columns=columns)

    scripts = files.where(F.col(text).isNotNull() & F.col(language).isin(*AST_LANGUAGES))
    return scripts.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(language) == "typescript").alias("typed")).mapInPandas(run, NODES.format(key=kind))
