"""Symbols of JavaScript and TypeScript files by a lexer and a bracket-aware scan.

Recognised: function, class, interface, type and enum declarations; imports
(module, specifiers with their aliases, namespaces); exports (declarations,
lists with aliases, default, re-exports); functions, components and objects
bound to names; methods of classes and functions of objects.  Not recognised:
decorators with bodies, computed member names, and declarations built at run
time.

The lexer keeps apart what looks alike: a template literal is one token however
its ``${}`` parts nest; a slash begins a regular expression where a value may
stand, else it divides; and in files that may hold JSX an element is taken up
where a value may stand and its end is found, its text skipped and its ``{}``
parts lexed as code.

Broken sources give the declarations around the fault: a closing bracket that
opens nothing is passed over, one that does not fit closes no brace, and a
bracket that is never closed ends where the next declaration begins a line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .python_source import SCHEMA, emit

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<dots>\.\.\.)|(?P<sign>.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TAG = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*)(?=[\s/>]))")
_CLOSING = re.compile(r"</([A-Za-z_$][\w$.:-]*|(?=>))")
#: Words after which a value stands.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do await yield instanceof default".split())
#: Declarations that begin a line; and how deep literals and elements are followed into one another.
_STARTS = frozenset("import export function class interface enum type const let var async abstract declare".split())
_DEPTH = 60
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = {"async", "static", "public", "private", "protected", "readonly", "get", "set", "override", "abstract", "declare"}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "await", "typeof", "new", "with"}


def _value_may_stand(tokens: list[tuple]) -> bool:
    """Whether a value, and so no operator, is next."""
    if not tokens:
        return True
    kind, text, _ = tokens[-1]
    if kind == "word":
        return text in _BEFORE_VALUE
    return kind in ("arrow", "dots") or (kind == "sign" and text not in (")", "]"))


def _code(source: str, at: int, out: list[tuple], jsx: dict[str, int] | None, depth: int = 0, inner: bool = False) -> int:
    """Lexes code from at; inner code ends before the brace that closes it.  Returns where it ends.

    jsx has the last place of each closing tag, or is None where there are no elements.
    """
    open_braces = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m.group()
        if kind in ("space", "comment"):
            at = m.end()
        elif text == "`":
            end = _template(source, at + 1, jsx, depth)
            out.append(("string", source[at:end], at))
            at = end
        elif text == "/" and _value_may_stand(out) and (found := _REGEX.match(source, at)):
            out.append(("string", found.group(), at))
            at = found.end()
        elif text == "<" and jsx is not None and depth < _DEPTH and _value_may_stand(out) and _closes(source, at, jsx):
            at = _element(source, at, out, jsx, depth)
        else:
            if inner and text == "}" and kind == "sign":
                if not open_braces:
                    return at
                open_braces -= 1
            open_braces += text == "{"
            out.append((kind, text, at))
            at = m.end()
    return at


def _template(source: str, at: int, jsx: dict[str, int] | None, depth: int) -> int:
    """The end of a template literal whose content begins at at."""
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at) and depth < _DEPTH:
            at = _code(source, at + 2, [], jsx, depth + 1, True) + 1
        else:
            at += 1
    return len(source)


def _closes(source: str, at: int, jsx: dict[str, int]) -> bool:
    """Whether what begins at at is an element: a tag that is closed at once or further on."""
    tag = _TAG.match(source, at)
    if not tag:
        return False
    if jsx.get(tag.group(1) or "", -1) > at:
        return True
    end = source.find(">", at)
    return end > 0 and source[end - 1] == "/"


def _element(source: str, at: int, out: list[tuple], jsx: dict[str, int], depth: int) -> int:
    """An element and its children: its first and last sign and its braced parts are tokens, text and tags are not."""
    level = 0
    out.append(("sign", "<", at))
    while at < len(source):
        if source.startswith("</", at):
            end = source.find(">", at)
            at, level = (len(source) if end < 0 else end + 1), level - 1
        elif source[at] == "<":
            at, level = at + 1, level + 1
            while at < len(source):
                c = source[at]
                if c == "{":
                    at = _braced(source, at, out, jsx, depth)
                elif c in "\"'":
                    end = source.find(c, at + 1)
                    at = len(source) if end < 0 else end + 1
                elif c == ">":
                    level -= source[at - 1] == "/"
                    at += 1
                    break
                else:
                    at += 1
        else:
            at = _braced(source, at, out, jsx, depth) if source[at] == "{" else at + 1
            continue
        if level <= 0:
            break
    out.append(("sign", ">", max(at - 1, 0)))
    return at


def _braced(source: str, at: int, out: list[tuple], jsx: dict[str, int], depth: int) -> int:
    out.append(("sign", "{", at))
    end = _code(source, at + 1, out, jsx, depth + 1, True)
    if end < len(source):
        out.append(("sign", "}", end))
    return end + 1


class Scan:
    def __init__(self, source: str, jsx: bool = True):
        self.source = source
        self.tokens: list[tuple] = []
        _code(source, 0, self.tokens, {m.group(1): m.start() for m in _CLOSING.finditer(source)} if jsx else None)
        self.match = self._brackets()
        self.starts = [0] + [i + 1 for i, c in enumerate(source) if c == "\n"]
        self.out: list[tuple] = []

    def _brackets(self) -> dict[int, int]:
        """Index of the closing token of each opening one."""
        stack, match = [], {}
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind != "sign":
                continue
            if text in _OPEN:
                stack.append(i)
            elif text in _CLOSE:
                # a brace closes what was left open in it; another bracket closes nothing beyond the brace it is in
                for at in range(len(stack) - 1, -1, -1):
                    opened = self.tokens[stack[at]][1]
                    if _OPEN[opened] == text:
                        for j in stack[at:]:
                            match[j] = i
                        del stack[at:]
                        break
                    if opened == "{":
                        break
        lines = self._line_starts() if stack else []
        for j in stack:
            match[j] = next((i - 1 for i in lines if i > j), len(self.tokens) - 1)
        return match

    def _line_starts(self) -> list[int]:
        """Tokens that begin a line with a declaration."""
        return [i for i, (kind, text, at) in enumerate(self.tokens) if kind == "word" and text in _STARTS and (at == 0 or self.source[at - 1] == "\n")]

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def place(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        return line, len(self.source[self.starts[line - 1] : at].encode()) + 1

    def add(self, name: str, kind: str, first: int, last: int, parent=None, source=None) -> None:
        last = min(max(last, first), len(self.tokens) - 1)
        end = self.tokens[last][2] + len(self.tokens[last][1])
        self.out.append((name, kind, parent, source, *self.place(self.tokens[first][2]), *self.place(end)))

    def statement_end(self, i: int, stop: int) -> int:
        """Last token of the statement that i is in: before a semicolon, a closing bracket, or a line that starts anew."""
        while i < stop:
            if self.text(i) in _OPEN and self.kind(i) == "sign":
                i = self.match[i]
            elif self.text(i) == ";":
                return i
            if i + 1 >= stop or (self.text(i + 1) in _CLOSE and self.kind(i + 1) == "sign"):
                return i
            between = self.source[self.tokens[i][2] : self.tokens[i + 1][2]]
            if "\n" in between[len(self.text(i)) :] and self.kind(i + 1) == "word" and self.text(i) not in ("=", ",", "=>", "+", "?", ":", "&", "|", "(", "extends", "implements") and self.text(i + 1) not in ("extends", "implements", "from", "as"):
                return i
            i += 1
        return stop - 1

    def body_of(self, i: int, stop: int) -> int:
        """The first brace at this level from i, or -1."""
        while i < stop:
            if self.text(i) == "{" and self.kind(i) == "sign":
                return i
            if self.text(i) == ";":
                return -1
            if self.kind(i) == "sign" and self.text(i) in _OPEN:
                i = self.match[i]
            i += 1
        return -1

    def block(self, i: int, stop: int) -> None:
        """All declarations in tokens [i, stop), outer before inner."""
        while i < stop:
            word = self.text(i) if self.kind(i) == "word" else ""
            before = self.text(i - 1)
            if word and before == "." and self.kind(i - 1) == "sign":
                i += 1
            elif word == "import" and self.text(i + 1) not in ("(", "."):
                i = self.imported(i, stop) + 1
            elif word == "export":
                i = self.exported(i, stop)
            else:
                i = self.declaration(i, stop)

    def declaration(self, i: int, stop: int, first: int | None = None) -> int:
        """Handles a declaration at i, if there is one; returns where to go on."""
        first = i if first is None else first
        word = self.text(i) if self.kind(i) == "word" else ""
        if word == "function":
            at = i + 2 if self.text(i + 1) == "*" else i + 1
            body = self.body_of(at, stop)
            start = i - 1 if self.text(i - 1) == "async" and self.kind(i - 1) == "word" else i
            if self.kind(at) == "word":
                self.add(self.text(at), "function", start, self.match[body] if body >= 0 else self.statement_end(i, stop))
            if body >= 0:
                self.block(body + 1, self.match[body])
                return self.match[body] + 1
            return at + 1
        if word == "class" and (self.kind(i + 1) == "word" or self.text(i + 1) == "{"):
            body = self.body_of(i + 1, stop)
            named = self.kind(i + 1) == "word" and self.text(i + 1) not in ("extends", "implements")
            if body < 0:
                return i + 1
            if named:
                self.add(self.text(i + 1), "class", i, self.match[body])
            self.members(body + 1, self.match[body], self.text(i + 1) if named else None)
            return self.match[body] + 1
        if word in ("interface", "enum") and self.kind(i + 1) == "word":
            body = self.body_of(i + 2, stop)
            if body < 0:
                return i + 1
            start = i - 1 if word == "enum" and self.text(i - 1) == "const" else i
            self.add(self.text(i + 1), word, start, self.match[body])
            return self.match[body] + 1
        if word == "type" and self.kind(i + 1) == "word" and self.text(i + 2) in ("=", "<"):
            end = self.statement_end(i + 2, stop)
            self.add(self.text(i + 1), "type_alias", i, end)
            return end + 1
        if word in ("const", "let", "var") and self.kind(i + 1) == "word" and self.text(i + 1) != "enum":
            return self.binding(i + 1, stop)
        return i + 1

    def binding(self, i: int, stop: int) -> int:
        """name [: type] = value[, name = value...]"""
        name, at = self.text(i), i + 1
        while at < stop and self.text(at) not in ("=", ",", ";"):
            if self.kind(at) == "sign" and self.text(at) in _OPEN:
                at = self.match[at]
            at += 1
        if self.text(at) != "=":
            return at
        value = at + 1
        end = self.statement_end(value, stop)
        return self.value(name, i, value, stop, end)

    def value(self, name: str, first: int, value: int, stop: int, end: int) -> int:
        if self.is_function(value, stop):
            self.add(name, "component" if name[:1].isupper() else "function", first, end)
        elif self.text(value) == "{" and self.kind(value) == "sign":
            self.add(name, "object", first, end)
            self.pairs(value + 1, self.match[value], name)
            return self.match[value] + 1
        return value

    def is_function(self, i: int, stop: int) -> bool:
        if self.text(i) == "async" and self.kind(i) == "word":
            i += 1
        if self.text(i) == "function":
            return True
        if self.text(i) == "<" and self.kind(i) == "sign":
            while i < stop and self.text(i) not in ("(", "{", ";"):
                i += 1
        if self.text(i) == "(" and self.kind(i) == "sign":
            i = self.match[i] + 1
            if self.text(i) == ":":  # a return type stands before the arrow
                while i < stop and self.text(i) not in ("=>", ";", "="):
                    i = self.match[i] + 1 if self.kind(i) == "sign" and self.text(i) in _OPEN else i + 1
            return self.text(i) == "=>"
        return self.kind(i) == "word" and self.text(i + 1) == "=>"

    def members(self, i: int, stop: int, parent: str | None) -> None:
        """Methods of a class body."""
        while i < stop:
            first = i
            while self.kind(i) == "word" and self.text(i) in _MODIFIERS and self.kind(i + 1) in ("word", "string") or self.text(i) == "*" or (self.kind(i) == "word" and self.text(i) in _MODIFIERS and self.text(i + 1) == "*"):
                i += 1
            if self.kind(i) in ("word", "string") and self.text(i + 1) in ("(", "<"):
                name = self.text(i).strip("\"'")
                body = self.body_of(i + 1, stop)
                if body >= 0 and name not in _NOT_METHODS:
                    self.add(f"{parent}.{name}" if parent else name, "method", first, self.match[body], parent)
                    self.block(body + 1, self.match[body])
                    i = self.match[body] + 1
                    continue
            end = self.statement_end(i, stop)
            self.block(i + 1, end + 1)
            i = end + 1

    def pairs(self, i: int, stop: int, parent: str) -> None:
        """Methods and functions of an object literal."""
        while i < stop:
            first = i
            while self.kind(i) == "word" and self.text(i) in ("async", "get", "set") and self.kind(i + 1) in ("word", "string"):
                i += 1
            name = self.text(i).strip("\"'")
            if self.kind(i) in ("word", "string") and self.text(i + 1) == "(":
                body = self.body_of(i + 1, stop)
                if body >= 0:
                    self.add(f"{parent}.{name}", "method", first, self.match[body], parent)
                    self.block(body + 1, self.match[body])
                    i = self.match[body] + 1
            elif self.kind(i) in ("word", "string") and self.text(i + 1) == ":":
                at = i + 2
                while at < stop and self.text(at) != ",":
                    at = self.match[at] + 1 if self.kind(at) == "sign" and self.text(at) in _OPEN else at + 1
                if self.is_function(i + 2, stop):
                    self.add(f"{parent}.{name}", "method", first, at - 1, parent)
                self.block(i + 2, at)
                i = at
            else:
                i += 1
                continue
            if self.text(i) == ",":
                i += 1

    def imported(self, i: int, stop: int) -> int:
        at, names = i + 1, []
        while at < stop and self.kind(at) != "string" and self.text(at) != ";":
            if self.text(at) == "{" and self.kind(at) == "sign":
                names += self.specifiers(at)
                at = self.match[at]
            elif self.text(at) == "*" and self.text(at + 1) == "as":
                names.append((self.text(at + 2), at, at + 2))
                at += 2
            at += 1
        if self.kind(at) != "string":
            return i
        source = self.text(at)[1:-1]
        end = at + 1 if self.text(at + 1) == ";" else at
        self.add(source, "import", i, end, None, source)
        for name, a, b in names:
            self.add(name, "import", a, b, None, source)
        return end

    def specifiers(self, brace: int) -> list[tuple[str, int, int]]:
        """(name or its alias, first, last token) of each item in braces."""
        out, i = [], brace + 1
        while i < self.match[brace]:
            j = i
            while j < self.match[brace] and self.text(j) != ",":
                j += 1
            words = [k for k in range(i, j) if self.kind(k) == "word" and not (self.text(k) == "type" and k == i and j - i > 1)]
            if words:
                out.append((self.text(words[-1]), words[0], words[-1]))
            i = j + 1
        return out

    def exported(self, i: int, stop: int) -> int:
        at = i + 1
        if self.text(at) == "type" and self.text(at + 1) in ("{", "*"):
            at += 1
        if self.text(at) == "{" or self.text(at) == "*":
            names = self.specifiers(at) if self.text(at) == "{" else []
            after = self.match[at] + 1 if self.text(at) == "{" else at + 1
            if self.text(at) == "*" and self.text(after) == "as":
                names, after = [(self.text(after + 1), at, after + 1)], after + 2
            source = None
            if self.text(after) == "from" and self.kind(after + 1) == "string":
                source = self.text(after + 1)[1:-1]
                after += 2
            end = after if self.text(after) == ";" else after - 1
            if names:
                for name, a, b in names:
                    self.add(name, "export", a, b, None, source)
            elif source is not None:
                self.add("*", "export", i, end, None, source)
            return end + 1
        if self.text(at) == "default":
            at += 1
            declared = at + 1 if self.text(at) in ("async", "abstract") else at
            name = "default"
            if self.text(declared) in ("function", "class"):
                k = declared + 2 if self.text(declared + 1) == "*" else declared + 1
                name = self.text(k) if self.kind(k) == "word" else name
            self.add(name, "export", i, self.statement_end(at, stop))
            return at
        if self.kind(at) == "word":
            k = at
            while self.text(k) in ("async", "abstract", "declare", "const", "let", "var", "function", "class", "interface", "type", "enum") or self.text(k) == "*":
                k += 1
            body_end = self.statement_end(at, stop)
            if self.kind(k) == "word":
                self.add(self.text(k), "export", i, body_end)
        return at


def symbols_of(source: str, jsx: bool = True) -> list[tuple]:
    scan = Scan(source, jsx)
    scan.block(0, len(scan.tokens))
    return scan.out


#: Files in which an angle bracket before a value is a type.
_NO_JSX = (".ts", ".mts", ".cts")


def _run(batches):
    for batch in batches:
        yield emit([(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in symbols_of(text, not path.endswith(_NO_JSX))])


def ecmascript_symbols(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_run, SCHEMA)
