"""Turtle: a recursive-descent parser, and a reader that gives each file to one task.

Any error aborts the document; its message names the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import terms as T
from ..plans.parser import SyntaxError_, unescape
from .ntriples import TRIPLES

#: Property lists and collections inside each other at most.
DEPTH = 128


class TurtleError(ValueError):
    pass


_SKIP = re.compile(r"(?:\s+|#[^\n]*)*")
_IRI = re.compile(r'<((?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)>')
_NAME = r"[A-Za-z\u00c0-\uffff](?:[\w.\-\u00b7]*[\w\-\u00b7])?"
_LOCAL = r"(?:[\w:\u00c0-\uffff]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w.\-:\u00b7\u00c0-\uffff]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w\-:\u00b7\u00c0-\uffff]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_PNAME = re.compile(rf"({_NAME})?:({_LOCAL})?")
_BLANK = re.compile(r"_:([A-Za-z0-9_\u00c0-\uffff](?:[\w.\-\u00b7]*[\w\-\u00b7])?)")
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)")
_LONG = [re.compile(rf"{q}{{3}}((?:{q}{{0,2}}(?:[^{q}\\]|\\.))*){q}{{3}}", re.S) for q in "\"'"]
_SHORT = [re.compile(rf"{q}((?:[^{q}\\\n\r]|\\.)*){q}") for q in "\"'"]
_LANG = re.compile(r"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)")
_WORD = re.compile(r"(true|false)(?![\w\-.:]*[\w:])")


class Turtle:
    def __init__(self, text: str, base: str = ""):
        self.text = text.removeprefix("\ufeff")
        self.at = 0
        self.base = base
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple[str, str, str]] = []
        self.made = 0
        self.depth = 0

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise TurtleError(f"line {line}: {what}")

    def skip(self) -> None:
        self.at = _SKIP.match(self.text, self.at).end()

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def sign(self, c: str) -> bool:
        self.skip()
        if self.text.startswith(c, self.at):
            self.at += len(c)
            return True
        return False

    def need(self, c: str) -> None:
        if not self.sign(c):
            self.fail(f"expected {c}")

    def unescaped(self, text: str) -> str:
        try:
            return unescape(text) if "\\" in text else text
        except (SyntaxError_, ValueError, OverflowError) as e:
            self.fail(str(e))

    def parse(self) -> list[tuple[str, str, str]]:
        self.skip()
        while self.at < len(self.text):
            if not self.directive():
                self.statement()
            self.skip()
        return self.out

    def directive(self) -> bool:
        m = re.compile(r"@(prefix|base)\b").match(self.text, self.at)
        dotted = bool(m)
        m = m or re.compile(r"(?i)(prefix)(?=\s+(?:[^\s:<]*):\s*<)|(?i:(base))(?=\s*<)").match(self.text, self.at)
        if not m:
            return False
        word = next(g for g in m.groups() if g).lower()
        self.at = m.end()
        self.skip()
        if word == "prefix":
            name = self.take(re.compile(r"([^\s:<]*):"))
            if not name:
                self.fail("expected a prefix")
            self.skip()
            self.prefixes[name[1]] = self.iri_ref()
        else:
            self.base = self.iri_ref()
        if dotted:
            self.need(".")
        return True

    def iri_ref(self) -> str:
        m = self.take(_IRI)
        if not m:
            self.fail("expected an IRI")
        value = self.unescaped(m[1])
        if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value):
            return value
        return urljoin(self.base, value) if value else self.base

    def statement(self) -> None:
        if self.text.startswith("[", self.at):
            s = self.blank_list()
            self.skip()
            if not self.text.startswith(".", self.at):
                self.properties(s)
        else:
            self.properties(self.node(literals=False))
        self.need(".")

    def properties(self, s: str) -> None:
        while True:
            p = self.verb()
            while True:
                self.out.append((s, p, self.node()))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            self.skip()
            if self.at >= len(self.text) or self.text[self.at] in ".]":
                return

    def verb(self) -> str:
        self.skip()
        if self.take(re.compile(r"a(?=[\s<\[\"(])")):
            return T.iri(T.RDF + "type")
        return T.iri(self.iri())

    def iri(self) -> str:
        self.skip()
        if self.text.startswith("<", self.at):
            return self.iri_ref()
        m = self.take(_PNAME)
        if not m:
            self.fail("expected an IRI")
        if (m[1] or "") not in self.prefixes:
            self.fail(f"unknown prefix {m[1] or ''}:")
        return self.prefixes[m[1] or ""] + re.sub(r"\\(.)", r"\1", m[2] or "")

    def new_blank(self) -> str:
        self.made += 1
        return T.blank(f"_ttl{self.made}")

    def node(self, literals: bool = True) -> str:
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.blank_list()
        if c == "(":
            return self.collection()
        if c == "_":
            m = self.take(_BLANK)
            if not m:
                self.fail("bad blank node")
            return T.blank("_" + m[1] if m[1].startswith("_") else m[1])  # labels of ours stay apart
        if literals:
            if c and c in "\"'":
                return self.string()
            if c and (c in "+-." or c.isdigit()):
                m = self.take(_NUMBER)
                if not m:
                    self.fail("bad number")
                kind = "double" if re.search("[eE]", m[0]) else "decimal" if "." in m[0] else "integer"
                return T.literal(m[0], T.XSD + kind)
            m = self.take(_WORD)
            if m:
                return T.literal(m[0], T.XSD + "boolean")
        return T.iri(self.iri())

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("nested too deeply")

    def blank_list(self) -> str:
        self.need("[")
        self.deeper()
        s = self.new_blank()
        if not self.sign("]"):
            self.properties(s)
            self.need("]")
        self.depth -= 1
        return s

    def collection(self) -> str:
        self.need("(")
        self.deeper()
        items = []
        while not self.sign(")"):
            if self.at >= len(self.text):
                self.fail("expected )")
            items.append(self.node())
        self.depth -= 1
        rest = T.iri(T.RDF + "nil")
        for item in reversed(items):
            cell = self.new_blank()
            self.out.append((cell, T.iri(T.RDF + "first"), item))
            self.out.append((cell, T.iri(T.RDF + "rest"), rest))
            rest = cell
        return rest

    def string(self) -> str:
        quote = "\"'".index(self.text[self.at])
        m = self.take(_LONG[quote]) or self.take(_SHORT[quote])
        if not m:
            self.fail("string without end")
        text = self.unescaped(m[1])
        lang = self.take(_LANG)
        if lang:
            return T.literal(text, lang=lang[1])
        if self.text.startswith("^^", self.at):
            self.at += 2
            return T.literal(text, self.iri())
        return T.literal(text)


def parse_turtle(text: str, base: str = "") -> list[tuple[str, str, str]]:
    """The triples of a document, as keys; TurtleError names the line of the first error."""
    return Turtle(text, base).parse()


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for text in b["value"]:
            yield pd.DataFrame(parse_turtle(text), columns=["s", "p", "o"])


def read_turtle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The distinct triples of Turtle files; a file is read by one task. Blank nodes of different files with one label are one."""
    return spark.read.text(path, wholetext=True).mapInPandas(_documents, TRIPLES).distinct()
