"""Python 3.13: lines and blocks by a tokenizer with an indent stack, then recursive descent with precedence climbing."""

from __future__ import annotations

import re

from graphweave.llm.syntax import Bad, Fault, Faults

#: The keywords, the binary operators with their precedence, the assignment operators and the names in __future__.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
BINARY = {
    "or": 1, "and": 2, "in": 4, "is": 4, "not": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4,
    "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "@": 10, "/": 10, "//": 10, "%": 10,
}
#: Levels: of 'not' before its operand, and above all comparisons, where targets and starred values begin.
NOT, BITWISE = 3, 4
AUGMENTED = frozenset("+= -= *= @= /= //= %= **= >>= <<= &= ^= |=".split())
FUTURE = frozenset("nested_scopes generators division absolute_import with_statement print_function unicode_literals barry_as_FLUFL generator_stop annotations".split())
PREFIXES = frozenset(("", "r", "u", "b", "f", "br", "rb", "fr", "rf"))

_TOKEN = re.compile(
    r"""[\ \t\f]*(?:(?P<skip>\\\r?\n|\#[^\r\n]*)
|(?P<nl>\r\n|\n|\r)
|(?P<string>(?i:[rubf]|br|rb|fr|rf)?(?:'{3}|"{3}|'|"))
|(?P<name>[^\W\d][\w\x80-\U0010ffff]*+)
|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+
  |(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:.;=]))""",
    re.X,
)
_BLANKS = re.compile(r"[ \t\f]*")
_REST = {
    "'": re.compile(r"(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"),
    '"': re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_BAD_BYTES = re.compile(r"\\x(?![0-9a-fA-F]{2})")
_PAIR = {")": "(", "]": "[", "}": "{"}

#: What ends an expression: the kinds of token and their texts.
_CLOSERS = frozenset(("op", "newline", "eof"))
_AFTER = frozenset(("", ",", ")", "]", "}", ":", "=", ":="))

# what an expression can be: a plain value, an assignable one, a name
VALUE, TARGET, NAME = 0, 1, 2

Token = tuple[str, str, int]


class Lexer:
    """Tokens (kind, value, place); kinds: name, num, str, fstr, op, newline, indent, dedent, eof."""

    def __init__(self, text: str, faults: Faults):
        self.text, self.faults = text, faults
        self.fields: dict[int, list[list[Token]]] = {}  # place of an f-string -> tokens of its fields

    def run(self) -> list[Token]:
        text, out, at = self.text, [], 0
        if text.startswith("\ufeff"):
            at = 1
        if "\0" in text:
            self.faults.note(Bad(text.index("\0"), "null byte"))
        stack = [(0, 0)]
        depth: list[tuple[str, int]] = []
        fresh = True
        size = len(text)
        match, add = _TOKEN.match, out.append
        while True:
            if fresh and not depth:
                fresh = False
                col = alt = 0
                while at < size and text[at] in " \t\f":
                    c = text[at]
                    col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                    at += 1
                if at < size and text[at] in "#\r\n" or at >= size:
                    pass
                elif (col, alt) != stack[-1]:
                    if col == stack[-1][0] or (col > stack[-1][0]) != (alt > stack[-1][1]):
                        self.faults.note(Bad(at, "inconsistent use of tabs and spaces"))
                    if col > stack[-1][0]:
                        stack.append((col, alt))
                        out.append(("indent", "", at))
                    else:
                        while col < stack[-1][0]:
                            stack.pop()
                            out.append(("dedent", "", at))
                        if col != stack[-1][0]:
                            self.faults.note(Bad(at, "unindent does not match any outer level"))
                        elif alt != stack[-1][1]:
                            self.faults.note(Bad(at, "inconsistent use of tabs and spaces"))
            if at >= size:
                break
            m = match(text, at)
            if m is None:
                at = _BLANKS.match(text, at).end()
                if at < size:
                    self.faults.note(Bad(at, f"unexpected character {text[at]!r}"))
                    at += 1
                continue
            kind = m.lastgroup
            start, at = m.span(kind)
            if kind == "name":
                value = m[kind]
                if not value.isascii() and not value.isidentifier():
                    self.faults.note(Bad(start, "invalid character in a name"))
                add((kind, value, start))
                continue
            if kind == "skip":
                if text[start] == "\\" and at >= size:
                    self.faults.note(Bad(start, "unexpected end of file after a line continuation"))
                continue
            if kind == "nl":
                if not depth:
                    if out and out[-1][0] not in ("newline", "indent", "dedent"):
                        out.append(("newline", "", start))
                    fresh = True
                continue
            if kind == "string":
                at = self.string(m, out)
                if at < 0:
                    at = size
                continue
            value = m.group(kind)
            if kind == "num":
                if at < size and (text[at].isalnum() or text[at] == "_") and not re.match(r"(?:and|or|if|else|in|is|not|for)\b", text[at : at + 5]):
                    self.faults.note(Bad(start, "invalid number"))
                elif len(value) > 1 and value[0] == "0" and value.replace("_", "").isdigit() and value.replace("_", "").strip("0"):
                    self.faults.note(Bad(start, "leading zeros in a number"))
            elif value in "([{":
                depth.append((value, start))
            elif value in ")]}":
                if not depth:
                    self.faults.note(Bad(start, f"unmatched {value!r}"))
                    continue
                opened = depth.pop()
                if opened[0] != _PAIR[value]:
                    self.faults.note(Bad(start, f"{value!r} does not match {opened[0]!r}"))
                    depth.clear()
            add((kind, value, start))
        if depth:
            self.faults.note(Bad(depth[-1][1], f"{depth[-1][0]!r} was never closed"))
        if out and out[-1][0] not in ("newline", "indent", "dedent"):
            out.append(("newline", "", size))
        out += [("dedent", "", size)] * (len(stack) - 1)
        out.append(("eof", "", size))
        return out

    def string(self, m: re.Match, out: list[Token]) -> int:
        """A string token from its opening quote on; the place after it, or -1 if it has no end."""
        text, start = self.text, m.start("string")
        head = m.group("string")
        quote = head.lstrip("rRbBuUfF")
        prefix = head[: len(head) - len(quote)].lower()
        if "f" in prefix:
            end = self.formatted(m.end(), quote, "r" in prefix, start)
            out.append(("fstr", prefix, start))
            return end
        found = _REST[quote].match(text, m.end())
        if found is None:
            self.faults.note(Bad(start, "unterminated triple-quoted string literal" if len(quote) == 3 else "unterminated string literal"))
            out.append(("str", prefix, start))
            if len(quote) == 3:
                return -1
            line = re.compile(r"[\r\n]").search(text, m.end())
            return line.start() if line else -1
        body = found.group()
        if "\\" in body and "r" not in prefix:
            plain = body.replace("\\\\", "")
            if (_BAD_BYTES if "b" in prefix else _BAD_ESCAPE).search(plain):
                self.faults.note(Bad(start, "bad escape in a string literal"))
        if "b" in prefix and not body.isascii():
            self.faults.note(Bad(start, "bytes can only contain ASCII characters"))
        out.append(("str", prefix, start))
        return found.end()

    def formatted(self, at: int, quote: str, raw: bool, start: int) -> int:
        text, size = self.text, len(self.text)
        fields = self.fields.setdefault(start, [])
        while True:
            if at >= size or (len(quote) == 1 and text[at] in "\r\n"):
                self.faults.note(Bad(start, "unterminated f-string literal"))
                return at if at < size else -1
            if text.startswith(quote, at):
                return at + len(quote)
            c = text[at]
            if c == "\\" and at + 1 < size and text[at + 1] not in "{}":
                if not raw and text.startswith("\\N{", at):
                    close = text.find("}", at)
                    at = close + 1 if close > 0 else size
                    continue
                if not raw and _BAD_ESCAPE.match(text, at):
                    self.faults.note(Bad(at, "bad escape in a string literal"))
                at += 3 if text.startswith("\\\r\n", at) else 2
            elif c == "{":
                if text.startswith("{{", at):
                    at += 2
                    continue
                at = self.field(at + 1, fields, quote, raw, start)
                if at < 0:
                    return -1
            elif c == "}":
                if not text.startswith("}}", at):
                    self.faults.note(Bad(at, "f-string: single '}' is not allowed"))
                at += 2
            else:
                at += 1

    def field(self, at: int, fields: list[list[Token]], quote: str, raw: bool, start: int) -> int:
        """A replacement field after its '{'; the place after its '}'."""
        text, size = self.text, len(self.text)
        tokens: list[Token] = []
        depth: list[str] = []
        fields.append(tokens)
        begin = at
        while at < size:
            at = _BLANKS.match(text, at).end()
            if at >= size or (len(quote) == 1 and not depth and text[at] == quote):
                break
            if not depth:
                c = text[at]
                if c == "!" and not text.startswith("!=", at):
                    m = re.compile(r"!\s*([sra])\s*(?=[:}])").match(text, at)
                    if m is None:
                        self.faults.note(Bad(at, "f-string: invalid conversion character"))
                        return self.after_field(at)
                    at = m.end()
                    c = text[at]
                elif c == "=" and not text.startswith("==", at) and tokens and text[at - 1] not in "<>!=":
                    m = re.compile(r"=\s*(?=[!:}])").match(text, at)
                    if m:
                        at = m.end()
                        continue
                if c == ":":
                    at += 1
                    while at < size:
                        if text[at] == "{":
                            at = self.field(at + 1, fields, quote, raw, start)
                            if at < 0:
                                return -1
                        elif text[at] == "}" or text.startswith(quote, at) or (len(quote) == 1 and text[at] in "\r\n"):
                            break
                        else:
                            at += 1
                    c = text[at] if at < size else ""
                if c == "}":
                    tokens.append(("eof", "", at))
                    if len(tokens) == 1:
                        self.faults.note(Bad(begin, "f-string: empty expression"))
                    return at + 1
                if c == "" or c in "\r\n" and text[at - 1] == ":" or c == quote[0] and text.startswith(quote, at):
                    break
            m = _TOKEN.match(text, at)
            if m is None:
                self.faults.note(Bad(at, "f-string: unexpected character"))
                return self.after_field(at)
            kind = m.lastgroup
            value = m.group(kind)
            place, at = m.span(kind)
            if kind in ("skip", "nl"):
                continue
            if kind == "string":
                at = self.string(m, tokens)
                if at < 0:
                    return -1
                continue
            if kind == "op":
                if value == ":=" and not depth:
                    at = place + 1
                    tokens.append(("eof", "", place))
                    at = place
                    tokens.pop()
                    # at the top of a field ':=' is a format that starts with '='
                    at = place + 1
                    while at < size and text[at] != "}":
                        at += 1
                    continue
                if value in "([{":
                    depth.append(value)
                elif value in ")]}":
                    if not depth or depth.pop() != _PAIR[value]:
                        self.faults.note(Bad(place, f"f-string: unmatched {value!r}"))
                        return self.after_field(place)
            tokens.append((kind, value, place))
        self.faults.note(Bad(begin, "f-string: expecting '}'"))
        tokens.append(("eof", "", at))
        return at if at < size else -1

    def after_field(self, at: int) -> int:
        m = re.compile(r"[}\r\n]").search(self.text, at)
        return m.end() if m else -1


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.faults = Faults(text)
        self.lexer = Lexer(text, self.faults)
        self.tokens = self.lexer.run()
        self.pos = 0
        self.kind, self.val, self.place = self.tokens[0]
        self.fn = self.asyn = self.yields = False
        self.returned: int | None = None
        self.loop = self.inside = 0

    def scan(self) -> None:
        if self.kind != "eof":
            self.pos += 1
        self.kind, self.val, self.place = self.tokens[self.pos]

    def back(self, pos: int) -> None:
        self.pos = pos
        self.kind, self.val, self.place = self.tokens[pos]

    def fail(self, why: str = "") -> Bad:
        return Bad(self.place, why or ("unexpected end of file" if self.kind == "eof" else f"unexpected {self.kind}" if self.kind in ("indent", "dedent", "newline") else "invalid syntax"))

    def at(self, val: str) -> bool:
        return self.val == val and self.kind in ("op", "name")

    def eat(self, val: str) -> bool:
        if self.val == val and self.kind in ("op", "name"):
            self.scan()
            return True
        return False

    def need(self, val: str) -> None:
        if not self.eat(val):
            raise self.fail(f"expected {val!r}")

    def name(self) -> str:
        if self.kind != "name" or self.val in KEYWORDS:
            raise self.fail()
        v = self.val
        self.scan()
        return v

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.pos + n, len(self.tokens) - 1)]

    # ------------------------------------------------------------ statements

    def program(self) -> list[Fault]:
        while self.kind != "eof":
            before = self.pos
            try:
                if self.kind == "indent":
                    raise self.fail("unexpected indent")
                if self.kind in ("dedent", "newline"):
                    self.scan()
                    continue
                self.statement()
            except Bad as bad:
                self.recover(bad, before)
            except RecursionError:
                self.faults.note(Bad(self.place, "nested too deeply"))
                break
        return self.faults.all()

    def recover(self, bad: Bad, before: int) -> None:
        """Panic mode: to the start of the next line."""
        self.faults.note(bad)
        self.fn = self.asyn = False
        self.loop = self.inside = 0
        if self.pos == before:
            self.scan()
        while self.kind not in ("newline", "eof"):
            self.scan()
        while self.kind in ("newline", "indent", "dedent"):
            self.scan()

    def block(self) -> None:
        self.need(":")
        if self.kind != "newline":
            return self.simple()
        self.scan()
        if self.kind != "indent":
            raise self.fail("expected an indented block")
        self.scan()
        while self.kind not in ("dedent", "eof"):
            before = self.pos
            try:
                if self.kind == "indent":
                    raise self.fail("unexpected indent")
                self.statement()
            except Bad as bad:
                # recovery inside the block keeps the block's own end
                self.faults.note(bad)
                if self.pos == before:
                    self.scan()
                deep = 0
                while self.kind != "eof" and not (self.kind == "newline" and self.peek()[0] != "indent"):
                    if self.kind == "indent":
                        deep += 1
                    elif self.kind == "dedent":
                        deep -= 1
                        if deep < 0:
                            break
                    self.scan()
                if self.kind == "newline":
                    self.scan()
                    while deep > 0 and self.kind == "dedent":
                        deep -= 1
                        self.scan()
        self.scan()
        return None

    def statement(self) -> None:
        if self.kind == "name":
            handler = _COMPOUND.get(self.val)
            if handler:
                return handler(self)
            if self.val == "match" and self.match():
                return None
        elif self.at("@"):
            while self.eat("@"):
                self.named()
                if self.kind != "newline":
                    raise self.fail()
                self.scan()
            if self.at("async") and self.peek()[1] == "def":
                return self.s_async()
            if self.at("def"):
                return self.s_def()
            if self.at("class"):
                return self.s_class()
            raise self.fail()
        return self.simple()

    def simple(self) -> None:
        while True:
            self.small()
            if not self.eat(";") or self.kind == "newline":
                break
        if self.kind not in ("newline", "eof"):
            raise self.fail()
        if self.kind == "newline":
            self.scan()

    def small(self) -> None:
        if self.kind == "name":
            handler = _SMALL.get(self.val)
            if handler:
                return handler(self)
            if self.val == "type" and self.peek()[0] == "name" and self.peek()[1] not in KEYWORDS and self.peek(2)[1] in ("=", "["):
                self.scan()
                self.name()
                self.type_params()
                self.need("=")
                return self.expression()
        place = self.place
        kind = self.star_expressions(True)
        if self.at(":"):
            if kind not in (TARGET, NAME) or self.last_tuple:
                raise Bad(place, "illegal target for annotation")
            self.scan()
            self.expression()
            if self.eat("="):
                self.yield_or_stars()
            return None
        if self.kind == "op" and self.val in AUGMENTED:
            if kind not in (TARGET, NAME) or self.last_tuple:
                raise Bad(place, "illegal target for augmented assignment")
            self.scan()
            return self.yield_or_stars()
        while self.at("="):
            if kind == VALUE:
                raise Bad(place, "cannot assign to this")
            self.scan()
            place = self.place
            kind = self.yield_kind()
        if kind == STAR_ONLY:
            raise Bad(place, "can't use starred expression here")
        return None

    last_tuple = False

    def yield_kind(self) -> int:
        if self.at("yield"):
            self.yield_()
            return VALUE
        return self.star_expressions(True)

    def yield_or_stars(self) -> None:
        if self.at("yield"):
            self.yield_()
        elif self.star_expressions(False) == STAR_ONLY:
            raise self.fail("can't use starred expression here")

    def yield_(self) -> None:
        if not self.fn:
            raise self.fail("'yield' outside function")
        self.yields = True
        self.scan()
        if self.at("from"):
            if self.asyn:
                raise self.fail("'yield from' inside async function")
            self.scan()
            return self.expression()
        if self.kind in ("newline", "eof") or (self.kind == "op" and self.val in (")", "]", "}", "=", ";", ":")):
            return None
        self.star_expressions(False)
        return None

    def s_pass(self) -> None:
        self.scan()

    def s_loop_word(self) -> None:
        if not self.loop:
            raise self.fail(f"'{self.val}' outside loop")
        self.scan()

    def ends(self) -> bool:
        return self.kind in ("newline", "eof") or self.at(";")

    def s_return(self) -> None:
        if not self.fn:
            raise self.fail("'return' outside function")
        place = self.place
        self.scan()
        if not self.ends():
            self.star_expressions(False)
            if self.returned is None:
                self.returned = place

    def s_raise(self) -> None:
        self.scan()
        if not self.ends():
            self.expression()
            if self.eat("from"):
                self.expression()

    def s_global(self) -> None:
        if self.val == "nonlocal" and not self.inside:
            raise self.fail("nonlocal declaration not allowed at module level")
        self.scan()
        self.name()
        while self.eat(","):
            self.name()

    def s_del(self) -> None:
        self.scan()
        place = self.place
        if self.star_expressions(True) == VALUE:
            raise Bad(place, "cannot delete this")

    def s_assert(self) -> None:
        self.scan()
        self.expression()
        if self.eat(","):
            self.expression()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def s_import(self) -> None:
        self.scan()
        while True:
            self.dotted()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                return

    def s_from(self) -> None:
        self.scan()
        dots = False
        while self.at(".") or self.at("..."):
            dots = True
            self.scan()
        future = not dots and self.val == "__future__"
        if not (dots and self.at("import")):
            self.dotted()
        self.need("import")
        if self.eat("*"):
            if self.fn:
                raise self.fail("import * only allowed at module level")
            return
        paren = self.eat("(")
        while True:
            if future and self.val not in FUTURE:
                raise self.fail(f"future feature {self.val} is not defined")
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                break
            if paren and self.at(")"):
                break
        if paren:
            self.need(")")

    def s_if(self) -> None:
        self.scan()
        self.named()
        self.block()
        while self.at("elif"):
            self.scan()
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def loop_block(self) -> None:
        self.loop += 1
        self.block()
        self.loop -= 1
        if self.eat("else"):
            self.block()

    def s_while(self) -> None:
        self.scan()
        self.named()
        self.loop_block()

    def s_for(self) -> None:
        self.scan()
        self.targets()
        self.need("in")
        self.star_expressions(False)
        self.loop_block()

    def targets(self) -> None:
        place = self.place
        while True:
            self.eat("*")
            kind = self.binary(BITWISE)
            if kind == VALUE:
                raise Bad(place, "cannot assign to this")
            if not self.eat(",") or self.at("in"):
                return

    def s_try(self) -> None:
        self.scan()
        self.block()
        seen = star = bare = False
        while self.at("except"):
            if bare:
                raise self.fail("default 'except:' must be last")
            self.scan()
            star = self.eat("*") or star
            if self.at(":"):
                bare = True
            else:
                self.expression()
                if self.eat("as"):
                    self.name()
            seen = True
            self.block()
        if seen and self.eat("else"):
            self.block()
        if self.eat("finally"):
            seen = True
            self.block()
        if not seen:
            raise self.fail("expected 'except' or 'finally' block")

    def s_with(self) -> None:
        self.scan()
        if self.at("("):
            pos = self.pos
            try:
                self.scan()
                while True:
                    self.with_item(")")
                    if not self.eat(",") or self.at(")"):
                        break
                self.need(")")
                if not self.at(":"):
                    raise self.fail()
            except Bad:
                self.back(pos)
            else:
                return self.block()
        while True:
            self.with_item(":")
            if not self.eat(","):
                break
        return self.block()

    def with_item(self, end: str) -> None:
        self.expression()
        if self.eat("as"):
            place = self.place
            self.eat("*")
            if self.binary(BITWISE) == VALUE:
                raise Bad(place, "cannot assign to this")

    def s_async(self) -> None:
        self.scan()
        if self.at("def"):
            return self.s_def(True)
        if self.at("for") or self.at("with"):
            if not self.asyn:
                raise self.fail("'async' outside async function")
            return self.s_for() if self.at("for") else self.s_with()
        raise self.fail()

    def s_def(self, asyn: bool = False) -> None:
        self.scan()
        self.name()
        self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        keep = self.fn, self.asyn, self.loop, self.yields, self.returned
        self.fn, self.asyn, self.loop, self.yields, self.returned = True, asyn, 0, False, None
        self.inside += 1
        self.block()
        self.inside -= 1
        if asyn and self.yields and self.returned is not None:
            self.faults.note(Bad(self.returned, "'return' with value in async generator"))
        self.fn, self.asyn, self.loop, self.yields, self.returned = keep

    def params(self, end: str, typed: bool) -> None:
        default = star = slash = kwargs = bare = False
        names: set[str] = set()
        first = True
        while not self.at(end):
            if kwargs:
                raise self.fail("arguments cannot follow var-keyword argument")
            if self.eat("/"):
                if slash or star or first:
                    raise self.fail("misplaced '/'")
                slash = True
            elif self.eat("**"):
                kwargs = True
                self.param(names, typed)
            elif self.eat("*"):
                if star:
                    raise self.fail("* argument may appear only once")
                star, default = True, False
                if self.at(","):
                    bare = True
                else:
                    self.param(names, typed, starred=True)
            else:
                self.param(names, typed)
                bare = False
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise self.fail("parameter without a default follows parameter with a default")
            first = False
            if not self.eat(","):
                break
        if bare:
            raise self.fail("named arguments must follow bare *")

    def param(self, names: set[str], typed: bool, starred: bool = False) -> None:
        place = self.place
        n = self.name()
        if n in names:
            raise Bad(place, f"duplicate argument {n!r}")
        names.add(n)
        if typed and self.eat(":"):
            if starred:
                self.eat("*")
            self.expression()

    def type_params(self) -> None:
        if not self.eat("["):
            return
        while not self.at("]"):
            self.eat("*") or self.eat("**")
            self.name()
            if self.eat(":"):
                self.expression()
            if self.eat("="):
                self.eat("*")
                self.expression()
            if not self.eat(","):
                break
        self.need("]")

    def s_class(self) -> None:
        self.scan()
        self.name()
        self.type_params()
        if self.at("("):
            self.arguments()
        keep = self.fn, self.asyn, self.loop
        self.fn, self.asyn, self.loop = False, False, 0
        self.block()
        self.fn, self.asyn, self.loop = keep

    # ------------------------------------------------------------ match

    def match(self) -> bool:
        """A match statement, if the line is one."""
        kind, val, _ = self.peek()
        if kind in ("newline", "eof") or (kind == "op" and val not in ("(", "[", "{", "-", "*", "~", "...")) or (kind == "name" and val in KEYWORDS and val not in ("None", "True", "False", "not", "lambda", "await")):
            return False
        pos = self.pos
        try:
            self.scan()
            self.star_named_list()
            if not self.at(":") or self.peek()[0] != "newline":
                raise self.fail()
        except Bad:
            self.back(pos)
            return False
        if not (self.peek(2)[0] == "indent"):
            raise Bad(self.peek(2)[2], "expected an indented block after 'match' statement")
        self.scan()
        self.scan()
        self.scan()
        if not self.at("case"):
            raise self.fail("expected 'case'")
        while self.at("case"):
            self.scan()
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()
        if self.kind != "dedent":
            raise self.fail()
        self.scan()
        return True

    def star_named_list(self) -> None:
        while True:
            if self.eat("*"):
                self.binary(BITWISE)
            else:
                self.named()
            if not self.eat(",") or self.at(":"):
                return

    def patterns(self) -> None:
        while True:
            if self.eat("*"):
                self.name()
            else:
                self.pattern()
            if not self.eat(",") or self.at(":") or self.at("if"):
                return

    def pattern(self) -> None:
        while True:
            self.closed_pattern()
            if not self.eat("|"):
                break
        if self.eat("as"):
            self.name()

    def closed_pattern(self) -> None:
        if self.kind in ("str", "fstr"):
            if self.kind == "fstr":
                raise self.fail("patterns may only match literals")
            return self.strings()
        if self.kind == "num" or self.at("-"):
            self.eat("-")
            if self.kind != "num":
                raise self.fail()
            self.scan()
            if self.at("+") or self.at("-"):
                self.scan()
                if self.kind != "num":
                    raise self.fail()
                self.scan()
            return None
        if self.kind == "name":
            if self.val in ("None", "True", "False"):
                return self.scan()
            self.dotted()
            if self.eat("("):
                named = False
                while not self.at(")"):
                    if self.kind == "name" and self.peek()[1] == "=":
                        self.name()
                        self.scan()
                        named = True
                    elif named:
                        raise self.fail("positional patterns follow keyword patterns")
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")
            return None
        for opening, closing in (("(", ")"), ("[", "]")):
            if self.eat(opening):
                while not self.at(closing):
                    if self.eat("*"):
                        self.name()
                    else:
                        self.pattern()
                    if not self.eat(","):
                        break
                return self.need(closing)
        if self.eat("{"):
            while not self.at("}"):
                if self.eat("**"):
                    self.name()
                else:
                    if self.kind == "name" and self.val not in ("None", "True", "False") and self.peek()[1] != ".":
                        raise self.fail()
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.eat(","):
                    break
            return self.need("}")
        raise self.fail()

    # ------------------------------------------------------------ expressions

    def star_expressions(self, assigning: bool) -> int:
        """Expressions with commas and stars; what they can be. last_tuple says whether there was a comma."""
        if self.at("yield"):
            self.yield_()
            self.last_tuple = False
            return VALUE
        best, stars, many = NAME, False, False
        while True:
            if self.eat("*"):
                stars = True
                kind = self.binary(BITWISE)
            else:
                kind = self.named() if not assigning else self.expression_kind()
                if assigning and self.at(":=") and kind == NAME:
                    raise self.fail()
            best = min(best, kind)
            if not self.at(","):
                break
            many = True
            self.scan()
            if self.ends() or self.kind == "op" and (self.val in (")", "]", "}", "=", ":") or self.val in AUGMENTED):
                break
        self.last_tuple = many
        if stars and not many:
            return STAR_ONLY if best != VALUE or not assigning else STAR_ONLY
        return best if not many else min(best, TARGET)

    def named(self) -> int:
        """An expression that may be named by ':='."""
        kind = self.expression_kind()
        if self.at(":="):
            if kind != NAME:
                raise self.fail("cannot use assignment expressions with this")
            self.scan()
            self.expression_kind()
            return VALUE
        return kind

    def expression(self) -> None:
        self.expression_kind()

    def expression_kind(self) -> int:
        kind, val = self.kind, self.val
        if kind == "num" or (kind == "name" and val not in KEYWORDS):
            after = self.tokens[self.pos + 1]
            if after[1] in _AFTER and after[0] in _CLOSERS:  # one token that nothing follows needs no climbing
                self.scan()
                return NAME if kind == "name" else VALUE
        if kind == "name" and val == "lambda":
            self.scan()
            self.params(":", False)
            self.need(":")
            keep = self.fn, self.asyn, self.loop
            self.fn, self.asyn = True, False
            self.expression_kind()
            self.fn, self.asyn, self.loop = keep
            return VALUE
        kind = self.binary(0)
        if self.at("if"):
            self.scan()
            self.binary(0)
            if not self.at("else"):
                raise self.fail("expected 'else' after 'if' expression")
            self.scan()
            self.expression_kind()
            return VALUE
        return kind

    def binary(self, least: int) -> int:
        """Operators that bind tighter than a level: or, and, not, comparisons and arithmetic in one table."""
        if self.val == "not" and self.kind == "name":
            if least > NOT:
                raise self.fail()
            self.scan()
            self.binary(NOT)
            kind = VALUE
        else:
            kind = self.unary()
        while self.kind == "op" or self.kind == "name":
            op = self.val
            level = BINARY.get(op)
            if level is None or level <= least:
                return kind
            if op == "not":
                if self.peek()[1] != "in":
                    return kind
                self.scan()
            self.scan()
            if op == "is":
                self.eat("not")
            self.binary(level)
            kind = VALUE
        return kind

    def unary(self) -> int:
        if self.kind == "op" and self.val in ("-", "+", "~"):
            self.scan()
            self.unary()
            return VALUE
        if self.at("await"):
            if not self.asyn:
                raise self.fail("'await' outside async function")
            self.scan()
            self.postfix()
            kind = VALUE
        else:
            kind = self.postfix()
        if self.at("**"):
            self.scan()
            self.unary()
            return VALUE
        return kind

    def postfix(self) -> int:
        kind = self.atom()
        while self.kind == "op":
            if self.val == ".":
                self.scan()
                self.name()
                kind = TARGET
            elif self.val == "(":
                self.arguments()
                kind = VALUE
            elif self.val == "[":
                self.scan()
                if self.at("]"):
                    raise self.fail()
                while not self.at("]"):
                    self.subscript()
                    if not self.eat(","):
                        break
                self.need("]")
                kind = TARGET
            else:
                break
        return kind

    def subscript(self) -> None:
        if self.eat("*"):
            self.binary(BITWISE)
            return
        if not self.at(":"):
            self.named()
        if self.eat(":"):
            if not (self.at(":") or self.at("]") or self.at(",")):
                self.expression()
            if self.eat(":") and not (self.at("]") or self.at(",")):
                self.expression()

    def arguments(self) -> None:
        self.need("(")
        keyword = double = False
        n = 0
        while not self.at(")"):
            if self.eat("**"):
                self.expression()
                double = True
            elif self.eat("*"):
                if double:
                    raise self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.expression()
            elif self.kind == "name" and self.val not in KEYWORDS and self.peek()[1] == "=" and self.peek()[0] == "op":
                self.scan()
                self.scan()
                self.expression()
                keyword = True
            else:
                place = self.place
                self.named()
                if self.at("for") or self.at("async"):
                    self.comprehension()
                    if n or not (self.at(")")):
                        if n or self.at(",") and self.peek()[1] != ")":
                            raise Bad(place, "Generator expression must be parenthesized")
                elif double:
                    raise Bad(place, "positional argument follows keyword argument unpacking")
                elif keyword:
                    raise Bad(place, "positional argument follows keyword argument")
            n += 1
            if not self.eat(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while True:
            if self.eat("async"):
                if not self.at("for"):
                    raise self.fail()
            if not self.eat("for"):
                return
            self.targets()
            self.need("in")
            self.binary(0) if not self.at("lambda") else self.expression()
            if self.at("if") is False and self.at("else"):
                raise self.fail()
            while self.eat("if"):
                self.binary(0) if not self.at("lambda") else self.expression()
                if self.at(":="):
                    self.scan()
                    self.expression()
            if not (self.at("for") or self.at("async")):
                return

    def strings(self) -> None:
        raw = None
        while self.kind in ("str", "fstr"):
            is_bytes = "b" in self.val
            if raw is not None and raw != is_bytes:
                raise self.fail("cannot mix bytes and nonbytes literals")
            raw = is_bytes
            if self.kind == "fstr":
                for field in self.lexer.fields.get(self.place, ()):
                    self.inner(field)
            self.scan()

    def inner(self, tokens: list[Token]) -> None:
        """The expression of a replacement field."""
        if len(tokens) < 2 or tokens[-1][0] != "eof":  # a field without end is a fault already
            return
        keep = self.tokens, self.pos
        self.tokens = tokens
        self.back(0)
        try:
            self.star_expressions(False)
            if self.kind != "eof":
                raise self.fail("f-string: invalid syntax")
        finally:
            self.tokens = keep[0]
            self.back(keep[1])

    def atom(self) -> int:
        kind, val = self.kind, self.val
        if kind == "name":
            if val in KEYWORDS:
                if val in ("None", "True", "False"):
                    self.scan()
                    return VALUE
                raise self.fail()
            self.scan()
            return NAME
        if kind == "num":
            self.scan()
            return VALUE
        if kind in ("str", "fstr"):
            self.strings()
            return VALUE
        if kind == "op":
            if val == "(":
                return self.group()
            if val == "[":
                return self.list()
            if val == "{":
                return self.braces()
            if val == "...":
                self.scan()
                return VALUE
        raise self.fail()

    def group(self) -> int:
        self.scan()
        if self.eat(")"):
            return TARGET
        if self.at("yield"):
            self.yield_()
            self.need(")")
            return VALUE
        best, many = NAME, False
        star = False
        while True:
            if self.eat("*"):
                star = True
                kind = self.binary(BITWISE)
            else:
                kind = self.named()
            if not many and not star and (self.at("for") or self.at("async")):
                self.comprehension()
                self.need(")")
                return VALUE
            best = min(best, kind)
            if not self.eat(","):
                break
            many = True
            if self.at(")"):
                break
        self.need(")")
        if star and not many:
            raise self.fail("cannot use starred expression here")
        return min(best, TARGET)

    def list(self) -> int:
        self.scan()
        best, n = TARGET, 0
        while not self.at("]"):
            if self.eat("*"):
                kind = self.binary(BITWISE)
            else:
                kind = self.named()
                if not n and (self.at("for") or self.at("async")):
                    self.comprehension()
                    best = VALUE
                    break
            best = min(best, kind)
            n += 1
            if not self.eat(","):
                break
        self.need("]")
        return best

    def braces(self) -> int:
        self.scan()
        n, pairs = 0, None
        while not self.at("}"):
            if self.eat("**"):
                if pairs is False:
                    raise self.fail()
                pairs = True
                self.binary(BITWISE)
            elif self.eat("*"):
                if pairs:
                    raise self.fail()
                pairs = False
                self.binary(BITWISE)
            else:
                self.named()
                if pairs is not False and self.at(":"):
                    self.scan()
                    self.expression()
                    pairs = True
                elif pairs:
                    raise self.fail("':' expected after dictionary key")
                else:
                    pairs = False
                if not n and (self.at("for") or self.at("async")):
                    self.comprehension()
                    break
            n += 1
            if not self.eat(","):
                break
        self.need("}")
        return VALUE


STAR_ONLY = 3
_COMPOUND = {
    "if": Parser.s_if, "while": Parser.s_while, "for": Parser.s_for, "try": Parser.s_try, "with": Parser.s_with,
    "def": Parser.s_def, "class": Parser.s_class, "async": Parser.s_async,
}
_SMALL = {
    "pass": Parser.s_pass, "break": Parser.s_loop_word, "continue": Parser.s_loop_word, "return": Parser.s_return,
    "raise": Parser.s_raise, "global": Parser.s_global, "nonlocal": Parser.s_global, "del": Parser.s_del,
    "assert": Parser.s_assert, "import": Parser.s_import, "from": Parser.s_from, "yield": Parser.yield_,
}


def faults(text: str) -> list[Fault]:
    """All syntax errors of a module; none if it is valid."""
    return Parser(text).program()
