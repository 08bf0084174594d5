"""JavaScript and TypeScript files by a tokenizer and a descent over declarations.

The tokenizer knows comments, strings, templates and regular expressions, so that brackets pair up;
the reader then walks statement by statement over the tokens and passes over what it doesn't declare.
Read are classes with members, functions, constants bound to functions, other variables, interfaces,
type aliases, imports and exports, and calls within bodies. Classes and functions without a name,
which only a default export can have, are called default.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from graphweave.extract.records import Parsed

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)
|(?P<name>\#?[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*)
|(?P<num>\d[\w.]*)
|(?P<str>'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")
|(?P<op>=>|\?\.(?!\d)|\.\.\.|[=!]==?|\+\+|--|&&=?|\|\|=?|\?\?=?|[-+*/%&|^<>]=|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
# Words before which a slash starts a regular expression, that start a statement, that stand before a member, and that no call is named by.
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new do else throw yield await".split())
_STARTS = frozenset("export import const let var function class interface type enum abstract declare async namespace if for while do switch return throw try break continue".split())
_MODIFIERS = frozenset("public private protected static abstract readonly override declare async accessor get set".split())
_NO_CALL = frozenset("if for while switch catch return typeof function await new throw delete void in of instanceof else do case super import async yield with".split())


class _Tokens:
    """The tokens of a text: kind, text and place of each, and the partner of each bracket."""

    def __init__(self, text: str):
        self.kind: list[str] = []
        self.val: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.pair: dict[int, int] = {}
        self.sound = True
        self._run(text)

    def _run(self, text: str) -> None:
        at, size = 0, len(text)
        stack: list[int] = []
        while at < size:
            if text[at] == "`":
                end = self._template(text, at)
                self._add("str", text, at, end)
                at = end
                continue
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind in ("space", "comment"):
                at = end
                continue
            if text[at] == "/" and self._regex_may_start():
                m = _REGEX.match(text, at) or m
                end = m.end()
                kind = "op" if m.re is _TOKEN else "str"
            val = text[at:end]
            if kind == "op" and val in _OPEN:
                stack.append(len(self.val))
            elif kind == "op" and val in _CLOSE:
                if stack and _OPEN[self.val[stack[-1]]] == val:
                    i = stack.pop()
                    self.pair[i] = len(self.val)
                else:
                    self.sound = False
            self._add(kind, text, at, end)
            at = end
        self.sound &= not stack

    def _add(self, kind: str, text: str, at: int, end: int) -> None:
        self.kind.append(kind)
        self.val.append(text[at:end])
        self.start.append(at)
        self.end.append(end)

    def _regex_may_start(self) -> bool:
        if not self.val:
            return True
        last = self.val[-1]
        return last in _BEFORE_REGEX if self.kind[-1] == "name" else self.kind[-1] == "op" and last not in (")", "]", "}")

    def _template(self, text: str, at: int) -> int:
        """The end of a template from its opening quote on, with whatever its fields hold."""
        at += 1
        while at < len(text):
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif text.startswith("${", at):
                depth, at = 1, at + 2
                while at < len(text) and depth:
                    if text[at] == "`":
                        at = self._template(text, at)
                        continue
                    m = _TOKEN.match(text, at)
                    depth += (m.group() == "{") - (m.group() == "}")
                    at = m.end()
            else:
                at += 1
        return len(text)


class _Reader:
    def __init__(self, path: str, text: str, language: str):
        self.out, self.text = Parsed(path, language), text
        self.t = _Tokens(text)
        self.size = len(self.t.val)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    # ------------------------------------------------------------ tokens

    def val(self, i: int) -> str:
        return self.t.val[i] if 0 <= i < self.size else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.size and self.t.kind[i] == "name"

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def new_line(self, i: int) -> bool:
        """Whether a token starts on another line than the one before ends on."""
        return i > 0 and self.line(self.t.start[i]) > self.line(self.t.end[i - 1] - 1)

    def past(self, i: int) -> int:
        """The token after i, or after its closing partner where it opens a bracket."""
        return self.t.pair.get(i, i) + 1

    def past_angles(self, i: int) -> int:
        """After a list in angle brackets that starts at i."""
        depth = 0
        while i < self.size:
            depth += (self.val(i) == "<") - (self.val(i) == ">")
            i = self.past(i)
            if depth <= 0:
                break
        return i

    def past_type(self, i: int, stop: frozenset[str]) -> int:
        """After a type that starts at i: at the first stop word at this depth, or where another statement starts."""
        begun = False
        while i < self.size and not (begun and self.val(i) in stop) and self.val(i) not in (")", "]", "}"):
            if begun and self.new_line(i) and self.val(i) in _STARTS:
                break
            begun = self.val(i) not in ("|", "&", "=>", "extends", "keyof")  # an object type may follow these
            i = self.past_angles(i) if self.val(i) == "<" else self.past(i)
        return i

    def past_statement(self, i: int, end: int) -> int:
        """After a statement that declares nothing itself: behind its ';' or before a word that starts another one."""
        first = i
        while i < end:
            if self.val(i) == ";":
                return i + 1
            if i > first and self.val(i) in _STARTS and (self.new_line(i) or self.val(i - 1) == "}"):
                return i
            i = self.past(i)
        return end

    # ------------------------------------------------------------ nodes

    def doc(self, i: int) -> str | None:
        """The block comment right before a token."""
        before = self.text[: self.t.start[i]].rstrip()
        if not before.endswith("*/"):
            return None
        body = re.sub(r"^/\*+|\*+/$", "", before[before.rfind("/*") :])
        return "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in body.split("\n")).strip()

    def add(self, kind: str, name: str, parent: str, first: int, last: int, signature: str | None, relation: str) -> str:
        """A node over the tokens from first to before last."""
        at, end = self.t.start[first], self.t.end[max(first, last - 1)]
        code = self.text[self.lines[self.line(at) - 1] : end]
        qualified = self.out.node(kind, name, f"{parent}.{name}", self.line(at), self.line(end - 1), signature, self.doc(first), code)
        self.out.edge(parent, qualified, relation)
        return qualified

    def calls(self, owner: str, i: int, end: int) -> None:
        while i < end:
            if not self.is_name(i) or self.val(i - 1) in (".", "?."):
                i += 1
                continue
            first, chain = i, [self.val(i)]
            while self.val(i + 1) in (".", "?.") and self.is_name(i + 2):
                chain.append(self.val(i + 2))
                i += 2
            i += 1
            if self.val(i) == "?." and self.val(i + 1) == "(":
                i += 1
            if self.val(i) != "(" or self.val(first - 1) in ("new", "function") or (len(chain) == 1 and chain[0] in _NO_CALL):
                continue
            if self.val(first - 1) in ("{", ",", "async", "get", "set", "*") and self.val(self.past(i)) == "{":
                continue  # a method of an object
            self.out.edge(owner, ".".join(chain), "CALLS")

    def callable_(self, kind: str, name: str, parent: str, first: int, head: int, relation: str, end: int) -> int:
        """A function whose type parameters or parameters start at head; after its body."""
        if self.val(head) == "<":
            head = self.past_angles(head)
        if self.val(head) != "(" or head not in self.t.pair:
            return head
        i = close = self.past(head)
        if self.val(i) == ":":
            i = close = self.past_type(i + 1, frozenset(("{", ";", ",", "=")))
        if self.val(i) == "{" and i in self.t.pair:
            i = self.past(i)
        elif self.val(i) == ";":
            i += 1
        signature = name + re.sub(r"\s+", " ", self.text[self.t.start[head] : self.t.end[close - 1]]).strip()
        self.calls(self.add(kind, name, parent, first, i, signature, relation), close, i)
        return i

    def arrow(self, i: int) -> tuple[int, int] | None:
        """(first token of the parameters, token of the arrow) if a function with an arrow starts at i."""
        if self.val(i) == "async" and not self.new_line(i + 1) and self.val(i + 1) != "=>":
            i += 1
        head = self.past_angles(i) if self.val(i) == "<" else i
        if self.is_name(head) and self.val(head + 1) == "=>":
            return head, head + 1
        if self.val(head) != "(" or head not in self.t.pair:
            return None
        at = self.past(head)
        if self.val(at) == ":":
            at = self.past_type(at + 1, frozenset(("=>", ";", ",", "=")))
        return (head, at) if self.val(at) == "=>" else None

    # ------------------------------------------------------------ statements

    def read(self) -> Parsed:
        top = self.out.file(self.text)
        i = 0
        while i < self.size:
            i = max(i + 1, self.statement(i, self.size, top))
        if not self.t.sound:
            self.out.error = "unbalanced brackets"
        return self.out

    def statement(self, first: int, end: int, top: str) -> int:
        i = first
        while self.val(i) == "@":  # decorators
            i += 2
            while self.val(i) == ".":
                i += 2
            i = self.past(i) if self.val(i) == "(" else i
        exported = self.val(i) == "export"
        i += exported
        i += exported and self.val(i) == "default"
        while self.val(i) in ("declare", "abstract") and self.is_name(i + 1):
            i += 1
        i += self.val(i) == "async" and self.val(i + 1) == "function"
        word = self.val(i)
        names: list[str] = []
        if word == "import" and not exported and self.val(i + 1) not in ("(", "."):
            return self.import_(i, end, top)
        if word == "class":
            name, after = self.class_(first, i + 1, end)
            names.append(name)
        elif word == "function":
            i += 1 + (self.val(i + 1) == "*")
            name = self.val(i) if self.is_name(i) else "default"
            after = self.callable_("FUNCTION", name, top, first, i + self.is_name(i), "DEFINES", end)
            names.append(name)
        elif word in ("const", "let", "var") and self.val(i + 1) != "enum":
            after = self.variables(first, i + 1, end, top, names)
        elif word == "interface" and self.is_name(i + 1):
            after = i + 2
            while after < end and self.val(after) != "{":
                after = self.past_angles(after) if self.val(after) == "<" else self.past(after)
            after = self.past(after)
            self.add("TYPE", self.val(i + 1), top, first, after, None, "DEFINES")
            names.append(self.val(i + 1))
        elif word == "type" and self.is_name(i + 1) and self.val(i + 2) in ("=", "<"):
            after = self.past_angles(i + 2) if self.val(i + 2) == "<" else i + 2
            after = self.past_type(after + 1, frozenset((";",)))
            after += self.val(after) == ";"
            self.add("TYPE", self.val(i + 1), top, first, after, None, "DEFINES")
            names.append(self.val(i + 1))
        else:
            return self.past_statement(first, end)
        if exported:
            for name in names:
                self.out.edge(top, f"{top}.{name}", "EXPORTS")
        return after

    def variables(self, first: int, i: int, end: int, top: str, names: list[str]) -> int:
        """The variables of one declaration, those bound to functions as functions."""
        while i < end:
            name, begin = (self.val(i) if self.is_name(i) else None), i if names else first
            i = self.past(i)
            if self.val(i) in (":", "!"):
                i = self.past_type(i + 1, frozenset(("=", ";", ",")))
            bound = None
            if self.val(i) == "=":
                i += 1
                bound = self.arrow(i)
                if bound is None and self.val(i + (self.val(i) == "async")) == "function":
                    i += 1 + (self.val(i) == "async")
                    i += self.val(i) == "*"
                    i += self.is_name(i)
                    if name:
                        i = self.callable_("FUNCTION", name, top, begin, i, "DEFINES", end)
                        names.append(name)
                        name = None
            value = bound[1] + 1 if bound else i
            i = value
            while i < end and self.val(i) not in (",", ";") and not (i > value and self.val(i) in _STARTS and (self.new_line(i) or self.val(i - 1) == "}")):
                if bound and i > value and self.new_line(i) and self.val(i - 1) == "}" and self.val(value) == "{":
                    break
                i = self.past(i)
            if name and bound:
                head = re.sub(r"\s+", " ", self.text[self.t.start[bound[0]] : self.t.end[bound[1] - 1]]).strip()
                last = self.past(value) if self.val(value) == "{" else i
                self.calls(self.add("FUNCTION", name, top, begin, last, f"{name}{head if head.startswith('(') else f'({head})'}", "DEFINES"), value, last)
                names.append(name)
            elif name:
                self.add("VARIABLE", name, top, begin, i + (self.val(i) == ";"), None, "DEFINES")
                names.append(name)
            if self.val(i) != ",":
                return i + (self.val(i) == ";")
            i += 1
        return end

    def class_(self, first: int, i: int, end: int) -> tuple[str, int]:
        named = self.is_name(i) and self.val(i) not in ("extends", "implements")
        name = self.val(i) if named else "default"
        i += named
        base = None
        while i < end and self.val(i) != "{":
            if self.val(i) == "extends" and base is None and self.is_name(i + 1):
                base = self.val(i + 1)
                i += 2
                while self.val(i) == "." and self.is_name(i + 1):
                    base += "." + self.val(i + 1)
                    i += 2
                base = "" if self.val(i) == "(" else base  # made by a call
            else:
                i = self.past_angles(i) if self.val(i) == "<" else self.past(i)
        if i not in self.t.pair:
            return name, i + 1
        qualified = self.add("CLASS", name, self.out.path, first, self.past(i), None, "DEFINES")
        if base:
            self.out.edge(qualified, base, "INHERITS")
        at, close = i + 1, self.t.pair[i]
        while at < close:
            at = max(at + 1, self.member(at, close, qualified))
        return name, close + 1

    def member(self, first: int, close: int, owner: str) -> int:
        i = first
        while self.val(i) == "@":
            i += 2
            i = self.past(i) if self.val(i) == "(" else i
        while self.val(i) in _MODIFIERS and self.val(i + 1) not in ("(", "<", "=", ";", ":", "?", "!", "}"):
            i += 1
        i += self.val(i) == "*"
        name = self.val(i).strip("'\"") if self.is_name(i) or (i < self.size and self.t.kind[i] == "str") else None
        if name is None and self.val(i) != "[":
            return self.past(first)
        i = self.past(i)
        i += self.val(i) == "?"
        if self.val(i) in ("(", "<") and name:
            return self.callable_("METHOD", name, owner, first, i, "CONTAINS", close)
        while i < close and self.val(i) != ";" and not (self.new_line(i) and (self.is_name(i) or self.val(i) in ("@", "[", "*")) and self.val(i - 1) not in ("=", "=>", ":", "|", "&", "?", "+", "(", ",")):
            i = self.past(i)
        return i + (self.val(i) == ";")

    def import_(self, i: int, end: int, top: str) -> int:
        i += 1
        named: list[str] = []
        if self.val(i) == "type" and (self.val(i + 1) in ("{", "*") or (self.is_name(i + 1) and self.val(i + 1) != "from")):
            i += 1
        while i < end and self.t.kind[i] != "str":
            if self.val(i) == "{":
                for k in range(i + 1, self.t.pair.get(i, i)):
                    word = self.val(k)
                    if self.is_name(k) and self.val(k - 1) in ("{", ",", "type") and not (word == "type" and self.is_name(k + 1) and self.val(k + 1) != "as"):
                        named.append(word)
            elif self.is_name(i) and self.val(i - 1) in ("import", "type") and self.val(i) != "from":
                named.append("default")
            elif self.val(i) == ";" or self.val(i) == "=":
                return self.past_statement(i, end)
            i = self.past(i)
        if i < end:
            source = self.val(i)[1:-1]
            self.out.imports.append(source)
            for name in named:
                self.out.edge(top, f"{source}.{name}", "IMPORTS")
        i += 1
        return i + (self.val(i) == ";")


def parse(path: str, text: str, language: str = "typescript") -> Parsed:
    return _Reader(path, text.replace("\r\n", "\n"), language).read()
