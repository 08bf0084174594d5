"""JavaScript and TypeScript, with or without JSX: recursive descent with precedence climbing."""

from __future__ import annotations

import re

from graphweave.llm.syntax import Bad, Fault, Faults

_UNIT = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_ID = rf"(?:[A-Za-z_$]|[^\W\d]|{_UNIT})[\w$\u200c\u200d]*+(?:{_UNIT}[\w$\u200c\u200d]*+)*+"
_BLANK = r"(?:[ \t\n\r\v\f\xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++|//[^\n\r\u2028\u2029]*+|/\*(?>[\s\S]*?\*/))"
_SKIP = re.compile(f"{_BLANK}+")
_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_TOKEN = re.compile(
    rf"""{_BLANK}*+(?:(?P<name>{_ID})
|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?
  |(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?)
|(?P<str>'[^'\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*+)*+'|"[^"\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*+)*+")
|(?P<private>\#{_ID})
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@`])
|(?P<eof>\Z))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\[\]/\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\](?=)|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/[\w$]*")
_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?!\{[0-9a-fA-F]{1,6}\}|[0-9a-fA-F]{4}))")
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_NAME = re.compile(rf"\s*({_ID}(?:-[\w$-]*)?(?:[:.]{_ID}(?:-[\w$-]*)?)*)")
_JSX_STRING = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')")

#: The reserved words and the binary operators with their precedence.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = frozenset(("!", "~", "+", "-", "typeof", "void", "delete"))
STATEMENTS = frozenset("if for while do switch try return throw break continue var let const function class import export debugger with".split())
MODIFIERS = frozenset("public private protected static abstract readonly override declare async accessor".split())

# what an expression can be used as
OTHER, TARGET, PATTERN = 0, 1, 2


class Parser:
    def __init__(self, text: str, types: bool, jsx: bool):
        self.text, self.types, self.jsx = text, types, jsx
        self.faults = Faults(text)
        self.kind = self.val = ""
        self.start = self.end = self.last = 0
        self.broke = False
        self.known: dict[int, tuple[str, str, int, int, bool]] = {}  # place -> the sound token from there on
        self.cover = -1
        self.fn = self.asyn = self.gen = False
        self.loop = self.switch = 0
        self.no_in = False
        self.in_cond = False
        self.ambient = False
        self.module = False
        self.labels: list[str] = []
        self.always_module = False

    # ------------------------------------------------------------ tokens

    def scan(self) -> None:
        at = self.last = self.end
        known = self.known.get(at)
        if known is not None:
            self.kind, self.val, self.start, self.end, self.broke = known
            return
        text = self.text
        m = _TOKEN.match(text, at)
        if m is None:
            return self.no_token(at)
        kind = self.kind = m.lastgroup
        val = self.val = m[kind]
        end = self.end = m.end()
        start = self.start = end - len(val)
        self.broke = start > at and _BREAK.search(text, at, start) is not None
        if kind == "op":
            if val == "/" and text.startswith("*", end):
                return self.no_token(at)
        elif kind == "name":
            if not val.isascii() and "\\" not in val and not val.replace("$", "a").replace("\u200c", "").replace("\u200d", "").isidentifier():
                raise Bad(start, "bad character in a name")
        elif kind == "num":
            if end < len(text) and (text[end].isalnum() or text[end] in "_$\\"):
                raise Bad(start, "identifier directly after number")
        elif kind == "str" and "\\" in val and self.bad_escape(val):
            raise Bad(start, "bad escape sequence")
        self.known[at] = kind, val, start, end, self.broke

    def no_token(self, at: int) -> None:
        """What stands where no token does: a comment without end, or a character that starts nothing."""
        text = self.text
        m = _SKIP.match(text, at)
        self.broke = m is not None and _BREAK.search(text, at, m.end()) is not None
        at = self.start = m.end() if m else at
        if text.startswith("/*", at):
            self.kind, self.val, self.end = "eof", "", len(text)
            raise Bad(at, "unterminated comment")
        self.kind, self.val, self.end = "bad", text[at], at + 1
        raise Bad(at, "unterminated string literal" if text[at] in "'\"" else f"unexpected character {text[at]!r}")

    @staticmethod
    def bad_escape(text: str) -> bool:
        return _ESCAPE.search(re.sub(r"\\\\", "", text)) is not None

    next = scan

    def save(self) -> tuple:
        return (self.kind, self.val, self.start, self.end, self.last, self.broke, self.cover, self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, len(self.labels))

    def back(self, s: tuple) -> None:
        (self.kind, self.val, self.start, self.end, self.last, self.broke, self.cover, self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, n) = s
        del self.labels[n:]

    def fail(self, why: str = "") -> Bad:
        if not why:
            why = "unexpected end of file" if self.kind == "eof" else f"unexpected {self.val[:30]!r}"
        return Bad(self.start, why)

    def at(self, val: str) -> bool:
        return self.val == val and self.kind in ("op", "name")

    def eat(self, val: str) -> bool:
        if self.val == val and self.kind in ("op", "name"):
            self.scan()
            return True
        return False

    def need(self, val: str) -> None:
        if not self.eat(val):
            raise self.fail(f"{val!r} expected, found " + ("end of file" if self.kind == "eof" else repr(self.val[:30])))

    def peek(self) -> tuple[str, str, bool]:
        s = self.save()
        try:
            self.scan()
            return self.kind, self.val, self.broke
        except Bad:
            return "bad", "", False
        finally:
            self.back(s)

    def close_angle(self) -> None:
        """One '>' of a token that may hold several."""
        if self.kind == "op" and self.val[0] == ">":
            self.end = self.start + 1
            self.scan()
        else:
            raise self.fail("'>' expected")

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "eof" or self.broke:
            return
        raise self.fail()

    def name(self, any_word: bool = False) -> str:
        if self.kind != "name" or (not any_word and self.val in RESERVED):
            raise self.fail()
        if not any_word and ((self.val == "await" and (self.asyn or self.module)) or (self.val == "yield" and self.gen)):
            raise self.fail()
        v = self.val
        self.scan()
        return v

    # ------------------------------------------------------------ program and recovery

    def program(self) -> list[Fault]:
        text = self.text
        if text.startswith("\ufeff"):
            self.end = 1
        if text.startswith("#!", self.end):
            m = _BREAK.search(text)
            self.end = m.start() if m else len(text)
        self.module = self.always_module or re.search(r"^\s*(?:import|export)\b", text, re.M) is not None
        self.forward()
        while self.kind != "eof":
            before = self.start
            try:
                if self.at("}"):
                    raise self.fail()
                self.statement(True)
            except Bad as bad:
                self.recover(bad, before)
            except RecursionError:
                self.faults.note(Bad(before, "nested too deeply"))
                break
        return self.faults.all()

    def forward(self) -> None:
        """The next token, past what is no token."""
        while True:
            try:
                self.scan()
                return
            except Bad as bad:
                self.faults.note(bad)

    def recover(self, bad: Bad, before: int) -> None:
        """Panic mode: to the next ';', closing brace or line that starts like a statement."""
        self.faults.note(bad)
        self.fn = self.asyn = self.gen = self.no_in = self.in_cond = self.ambient = False
        self.loop = self.switch = 0
        self.cover = -1
        self.labels.clear()
        if self.start <= before and self.kind != "eof":
            self.forward()
        while self.kind != "eof":
            if self.kind == "op" and self.val in (";", "}"):
                self.forward()
                return
            if self.broke and self.kind == "name" and self.val in STATEMENTS:
                return
            self.forward()

    # ------------------------------------------------------------ statements

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.fail("'}' expected, found end of file")
            self.statement(True)
        self.scan()

    def statement(self, declarations: bool = False) -> None:
        kind, val = self.kind, self.val
        if kind == "op":
            if val == "{":
                return self.block()
            if val == ";":
                return self.scan()
            if val == "@":
                self.decorators()
                if self.at("export"):
                    return self.export()
                if self.types and self.at("abstract"):
                    self.scan()
                return self.class_(True)
        elif kind == "name":
            handler = _STATEMENTS.get(val)
            if handler is not None:
                return handler(self)
            if val in _WORDS and self.word_statement(val, declarations):
                return None
            if val not in RESERVED:
                k, v, _ = self.peek()
                if k == "op" and v == ":":
                    if val in self.labels:
                        raise self.fail("label is there already")
                    self.labels.append(val)
                    self.scan()
                    self.scan()
                    self.statement()
                    self.labels.pop()
                    return None
        self.expression_alone()
        self.semicolon()
        return None

    def expression_alone(self) -> int:
        outer, self.cover = self.cover, -1
        kind = self.expression()
        if self.cover >= 0:
            raise Bad(self.cover, "'=' in an object literal")
        self.cover = outer
        return kind

    def word_statement(self, val: str, declarations: bool) -> bool:
        """Statements that start with a word that is no reserved word; False if it is none."""
        k, v, broke = self.peek()
        if val == "let":
            if k == "name" and v not in ("in", "instanceof", "of") or (k == "op" and v in ("[", "{")) or (k == "name" and v == "of"):
                self.variables()
                return True
            return False
        if val == "async":
            if k == "name" and v == "function" and not broke:
                self.scan()
                self.function(True, asyn=True)
                return True
            return False
        if val == "using":
            return False
        if not self.types or broke:
            return False
        if val == "type" and k == "name" and v not in ("in", "instanceof", "as", "satisfies"):
            self.scan()
            self.name()
            self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if val == "interface" and k == "name":
            self.scan()
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.heritage()
            self.object_type()
            return True
        if val == "abstract" and k == "name" and v == "class":
            self.scan()
            self.class_(True)
            return True
        if val == "declare" and k == "name" and v not in ("in", "instanceof", "as", "satisfies"):
            self.scan()
            outer, self.ambient = self.ambient, True
            if self.at("global") or (self.at("module") or self.at("namespace")):
                self.namespace()
            elif self.at("abstract"):
                self.scan()
                self.class_(True)
            elif self.at("async"):
                raise self.fail()
            else:
                self.statement(True)
            self.ambient = outer
            return True
        if val in ("namespace", "module") and (k == "name" or (k == "str" and val == "module")):
            self.namespace()
            return True
        if val == "global" and self.ambient and k == "op" and v == "{":
            self.namespace()
            return True
        return False

    def namespace(self) -> None:
        word = self.val
        self.scan()
        if word != "global":
            if self.kind == "str":
                self.scan()
            else:
                self.name()
                while self.eat("."):
                    self.name(True)
        if self.at("{"):
            self.block()
        else:
            self.semicolon()

    def paren_expression(self) -> None:
        self.need("(")
        self.expression_alone()
        self.need(")")

    def variables(self, in_for: bool = False) -> tuple[int, bool]:
        """Declarations after var, let or const; how many, and whether the last has a value."""
        const = self.val == "const"
        self.scan()
        if const and self.types and self.at("enum"):
            self.enum()
            return 1, True
        n, value = 0, False
        while True:
            pattern = self.binding_target()
            if self.types:
                if self.at("!") and not self.broke:
                    self.scan()
                if self.eat(":"):
                    self.type()
            n += 1
            value = False
            if self.at("="):
                self.scan()
                self.assign()
                value = True
            elif not in_for and (pattern or const) and not self.ambient:
                raise self.fail("'=' expected")
            if not self.eat(","):
                break
        if not in_for:
            self.semicolon()
        return n, value

    def s_variables(self) -> None:
        self.variables()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.at("}"):
            if self.kind == "str":
                self.scan()
            elif self.eat("["):
                self.assign()
                self.need("]")
            else:
                self.name(True)
            if self.eat("="):
                self.assign()
            if not self.eat(","):
                break
        self.need("}")

    def s_enum(self) -> None:
        if not self.types:
            raise self.fail()
        self.enum()

    def binding_target(self) -> bool:
        """A name or pattern that is bound; whether it is a pattern."""
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    self.binding_target()
                    break
                self.binding_element()
                if not self.at("]"):
                    self.need(",")
            self.need("]")
            return True
        if self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding_target()
                    break
                shorthand = self.kind == "name" and self.val not in RESERVED
                self.property_name()
                if self.eat(":"):
                    self.binding_element()
                elif not shorthand:
                    raise self.fail()
                elif self.eat("="):
                    self.assign()
                if not self.at("}"):
                    self.need(",")
            self.need("}")
            return True
        self.name()
        return False

    def binding_element(self) -> None:
        self.binding_target()
        if self.eat("="):
            self.assign()

    def property_name(self) -> None:
        if self.eat("["):
            outer, self.no_in = self.no_in, False
            self.assign()
            self.no_in = outer
            self.need("]")
        elif self.kind in ("name", "str", "num"):
            self.scan()
        else:
            raise self.fail()

    def s_if(self) -> None:
        self.scan()
        self.paren_expression()
        self.statement()
        if self.eat("else"):
            self.statement()

    def body_of_loop(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def s_while(self) -> None:
        self.scan()
        self.paren_expression()
        self.body_of_loop()

    def s_do(self) -> None:
        self.scan()
        self.body_of_loop()
        self.need("while")
        self.paren_expression()
        self.eat(";")

    def s_for(self) -> None:
        self.scan()
        if self.at("await"):
            if not (self.asyn or (self.module and not self.fn)):
                raise self.fail()
            self.scan()
        self.need("(")
        outer, self.no_in = self.no_in, True
        if self.at(";"):
            pass
        elif self.val in ("var", "const") and self.kind == "name" or (self.at("let") and self.peek()[0:2] not in (("name", "in"),) and (self.peek()[0] == "name" or self.peek()[1] in ("[", "{"))):
            n, value = self.variables(in_for=True)
            if self.at("of") or self.at("in"):
                if n != 1:
                    raise self.fail()
                of = self.at("of")
                self.no_in = outer
                self.scan()
                self.assign() if of else self.expression_alone()
                self.need(")")
                return self.body_of_loop()
        else:
            cover, self.cover = self.cover, -1
            kind = self.expression()
            if self.at("of") or self.at("in"):
                if kind == OTHER:
                    raise self.fail("bad loop target")
                self.cover = cover
                of = self.at("of")
                self.no_in = outer
                self.scan()
                self.assign() if of else self.expression_alone()
                self.need(")")
                return self.body_of_loop()
            if self.cover >= 0:
                raise Bad(self.cover, "'=' in an object literal")
            self.cover = cover
        self.no_in = outer
        self.need(";")
        if not self.at(";"):
            self.expression_alone()
        self.need(";")
        if not self.at(")"):
            self.expression_alone()
        self.need(")")
        return self.body_of_loop()

    def s_switch(self) -> None:
        self.scan()
        self.paren_expression()
        self.need("{")
        self.switch += 1
        default = False
        while not self.at("}"):
            if self.eat("case"):
                self.expression_alone()
            elif self.at("default"):
                if default:
                    raise self.fail("more than one default")
                default = True
                self.scan()
            else:
                raise self.fail()
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.kind == "eof":
                    raise self.fail()
                self.statement(True)
        self.switch -= 1
        self.scan()

    def s_try(self) -> None:
        self.scan()
        self.block()
        more = False
        if self.eat("catch"):
            more = True
            if self.eat("("):
                self.binding_target()
                if self.types and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            more = True
            self.block()
        if not more:
            raise self.fail("catch or finally expected")

    def s_return(self) -> None:
        if not self.fn:
            raise self.fail("return outside a function")
        self.scan()
        if not (self.broke or self.at(";") or self.at("}") or self.kind == "eof"):
            self.expression_alone()
        self.semicolon()

    def s_throw(self) -> None:
        self.scan()
        if self.broke:
            raise self.fail("line break after throw")
        self.expression_alone()
        self.semicolon()

    def s_break(self) -> None:
        word = self.val
        self.scan()
        if self.kind == "name" and not self.broke and self.val not in RESERVED:
            if self.val not in self.labels:
                raise self.fail("no such label")
            self.scan()
        elif not (self.loop or (word == "break" and self.switch)):
            raise self.fail(f"{word} outside a loop")
        self.semicolon()

    def s_debugger(self) -> None:
        self.scan()
        self.semicolon()

    def s_with(self) -> None:
        if self.module:
            raise self.fail()
        self.scan()
        self.paren_expression()
        self.statement()

    def s_function(self) -> None:
        self.function(True)

    def s_class(self) -> None:
        self.class_(True)

    # ------------------------------------------------------------ modules

    def s_import(self) -> None:
        k, v, _ = self.peek()
        if k == "op" and v in ("(", "."):
            self.expression_alone()
            return self.semicolon()
        if self.fn or self.loop:
            raise self.fail()
        self.scan()
        if self.kind == "str":
            self.scan()
        else:
            if self.types and self.at("type"):
                k, v, _ = self.peek()
                if k == "op" and v in ("{", "*") or (k == "name" and v != "from"):
                    self.scan()
            more = True
            if self.kind == "name":
                self.name()
                if self.types and self.eat("="):
                    if self.at("require") and self.peek()[1] == "(":
                        self.scan()
                        self.scan()
                        if self.kind != "str":
                            raise self.fail()
                        self.scan()
                        self.need(")")
                    else:
                        self.name()
                        while self.eat("."):
                            self.name(True)
                    return self.semicolon()
                more = self.eat(",")
            if more:
                if self.eat("*"):
                    self.need("as")
                    self.name()
                else:
                    self.specifiers(True)
            self.need("from")
            if self.kind != "str":
                raise self.fail()
            self.scan()
        self.attributes()
        return self.semicolon()

    def attributes(self) -> None:
        if (self.at("with") or (self.at("assert") and not self.broke)) and self.peek()[1] == "{":
            self.scan()
            self.primary()

    def specifiers(self, importing: bool) -> None:
        self.need("{")
        while not self.at("}"):
            if self.types and self.at("type") and self.peek()[0] in ("name", "str") and not (self.peek()[1] == "as"):
                self.scan()
            first, word = self.kind, self.val
            if self.kind == "str":
                self.scan()
            else:
                self.name(True)
            if self.eat("as"):
                if self.kind == "str" and not importing:
                    self.scan()
                else:
                    self.name(not importing)
            elif importing and (first == "str" or word in RESERVED):
                raise self.fail()
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def export(self) -> None:
        if self.fn or self.loop:
            raise self.fail()
        self.need("export")
        if self.eat("*"):
            if self.eat("as"):
                if self.kind == "str":
                    self.scan()
                else:
                    self.name(True)
            self.need("from")
            if self.kind != "str":
                raise self.fail()
            self.scan()
            self.attributes()
            return self.semicolon()
        if self.eat("default"):
            if self.at("function"):
                return self.function(True, anonymous=True)
            if self.at("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.scan()
                return self.function(True, asyn=True, anonymous=True)
            if self.at("@"):
                self.decorators()
            if self.types and self.at("abstract") and self.peek()[1] == "class":
                self.scan()
            if self.at("class"):
                return self.class_(True, anonymous=True)
            if self.types and self.at("interface") and self.peek()[0] == "name":
                self.word_statement("interface", True)
                return None
            self.assign()
            return self.semicolon()
        if self.types:
            if self.eat("="):
                self.expression_alone()
                return self.semicolon()
            if self.at("as") and self.peek()[1] == "namespace":
                self.scan()
                self.scan()
                self.name()
                return self.semicolon()
            if self.at("type") and self.peek()[1] in ("{", "*"):
                self.scan()
                if self.eat("*"):
                    if self.eat("as"):
                        self.name(True)
                    self.need("from")
                    if self.kind != "str":
                        raise self.fail()
                    self.scan()
                    return self.semicolon()
            elif self.at("import"):
                return self.s_import()
        if self.at("{"):
            self.specifiers(False)
            if self.eat("from"):
                if self.kind != "str":
                    raise self.fail()
                self.scan()
                self.attributes()
            return self.semicolon()
        if self.at("@"):
            self.decorators()
            return self.class_(True)
        if self.kind == "name" and (self.val in ("var", "let", "const", "function", "class", "async") or (self.types and self.val in ("enum", "interface", "type", "abstract", "declare", "namespace", "module"))):
            if self.val == "async" and self.peek()[1] != "function":
                raise self.fail()
            return self.statement(True)
        raise self.fail()

    # ------------------------------------------------------------ functions and classes

    def function(self, declaration: bool, asyn: bool = False, anonymous: bool = False) -> None:
        self.need("function")
        gen = self.eat("*")
        if self.kind == "name" and not self.at("("):
            self.name()
        elif declaration and not anonymous:
            raise self.fail("function name expected")
        self.signature_and_body(asyn, gen, may_lack=declaration and self.types)

    def signature_and_body(self, asyn: bool, gen: bool, may_lack: bool = False) -> None:
        keep = (self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels)
        self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels = True, asyn, gen, 0, 0, False, False, []
        if self.types:
            self.type_params()
        self.params()
        if self.types and self.eat(":"):
            self.return_type()
        if self.at("{"):
            self.block_then(keep)
        elif may_lack:
            self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels = keep
            self.semicolon()
        else:
            raise self.fail("'{' expected, found " + ("end of file" if self.kind == "eof" else repr(self.val[:30])))

    def block_then(self, keep: tuple) -> None:
        """A block after whose '}' the outer state holds again: what follows is scanned under it."""
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.fail("'}' expected, found end of file")
            self.statement(True)
        self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels = keep
        self.scan()

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.at("@"):
                self.decorators()
            rest = self.eat("...")
            if self.types:
                while self.kind == "name" and self.val in ("public", "private", "protected", "readonly", "override") and (self.peek()[0] == "name" or self.peek()[1] in ("{", "[")):
                    self.scan()
                if self.at("this"):
                    self.scan()
                    if self.eat(":"):
                        self.type()
                    if not self.at(")"):
                        self.need(",")
                    continue
            self.binding_target()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.at("="):
                if rest:
                    raise self.fail()
                self.scan()
                self.assign()
            if rest:
                if self.types and self.ambient:
                    self.eat(",")
                break
            if not self.at(")"):
                self.need(",")
        self.need(")")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression_alone()
                self.need(")")
            else:
                self.name()
                while self.eat("."):
                    if self.kind == "private":
                        self.scan()
                    else:
                        self.name(True)
            if self.types and self.at("<"):
                self.type_args()
            if self.at("("):
                self.arguments()
            # further calls and members of the decorator
            while self.at(".") or self.at("("):
                if self.eat("."):
                    self.name(True)
                else:
                    self.arguments()

    def class_(self, declaration: bool, anonymous: bool = False) -> None:
        self.need("class")
        if self.kind == "name" and self.val not in ("extends", "implements"):
            self.name()
        elif self.kind == "name" and self.val == "implements" and not self.types:
            self.name()
        elif declaration and not anonymous:
            raise self.fail("class name expected")
        if self.types:
            self.type_params()
        if self.eat("extends"):
            self.left_hand()
            if self.types and self.at("<"):
                self.type_args()
        if self.types and self.eat("implements"):
            self.heritage()
        self.need("{")
        keep = (self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels)
        self.loop = self.switch = 0
        self.no_in = self.in_cond = False
        self.labels = []
        while not self.at("}"):
            if self.kind == "eof":
                raise self.fail("'}' expected, found end of file")
            if self.eat(";"):
                continue
            self.member()
        self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels = keep
        self.scan()

    def heritage(self) -> None:
        while True:
            self.type_reference()
            if not self.eat(","):
                return

    def ends_name(self) -> bool:
        """After a word like 'static' or 'get': whether the word was the member's name itself."""
        k, v, broke = self.peek()
        return k == "eof" or (k == "op" and v in ("(", "=", ";", "}", ",", "<") or (self.types and k == "op" and v in (":", "?", "!")))

    def member(self) -> None:
        if self.at("@"):
            self.decorators()
        asyn = gen = accessor = False
        abstract = self.ambient
        words = 0
        while self.kind == "name" and not self.ends_name():
            k, v, broke = self.peek()
            w = self.val
            if w == "static":
                if v == "{" and k == "op":
                    self.scan()
                    keep = (self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels)
                    self.fn = self.asyn = self.gen = False
                    return self.block_then(keep)
            elif w == "async":
                if broke:
                    break
                asyn = True
            elif w in ("get", "set"):
                if k == "op" and v == "*" or (broke and not (k in ("name", "str", "num", "private") or v == "[")):
                    break
                accessor = True
            elif w == "accessor":
                if broke:
                    break
            elif self.types and w in MODIFIERS:
                if broke and w in ("declare", "abstract"):
                    break
                abstract = abstract or w in ("abstract", "declare")
            else:
                break
            words += 1
            self.scan()
            if accessor:
                break
        if self.eat("*"):
            gen = True
        if self.types and self.at("[") and not gen and self.index_signature():
            return None
        if self.kind == "private":
            self.scan()
        else:
            self.property_name()
        if self.types:
            if self.at("?") or (self.at("!") and not self.broke):
                self.scan()
        if self.at("(") or (self.at("<") and self.types):
            return self.signature_and_body(asyn, gen, may_lack=self.types)
        if gen or asyn or (accessor and not self.types):
            raise self.fail()
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            keep = (self.fn, self.asyn, self.gen)
            self.fn = self.asyn = self.gen = False
            self.assign()
            self.fn, self.asyn, self.gen = keep
        self.semicolon()
        return None

    def index_signature(self) -> bool:
        s = self.save()
        try:
            self.need("[")
            self.name()
            self.need(":")
            self.type()
            self.need("]")
        except Bad:
            self.back(s)
            return False
        if self.eat(":"):
            self.type()
        if not (self.eat(",") or self.eat(";")) and not self.at("}") and not self.broke:
            raise self.fail()
        return True

    # ------------------------------------------------------------ expressions

    def expression(self) -> int:
        kind = self.assign_part()
        while self.at(","):
            self.scan()
            self.assign_part()
            kind = OTHER
        return kind

    def assign(self) -> int:
        """One assignment expression that is no part of a possible pattern."""
        outer, self.cover = self.cover, -1
        kind = self.assign_part()
        if self.cover >= 0:
            raise Bad(self.cover, "'=' in an object literal")
        self.cover = outer
        return kind

    def assign_part(self) -> int:
        if self.kind == "name":
            val = self.val
            if val == "yield" and self.gen:
                return self.yield_()
            if val == "async" and self.async_arrow():
                return OTHER
            if val not in RESERVED:
                k, v, broke = self.peek()
                if k == "op" and v == "=>":
                    if broke:
                        raise self.fail()
                    self.name()
                    self.arrow_body(False)
                    return OTHER
        elif self.kind == "op" and (self.val == "(" or (self.val == "<" and self.types)) and self.try_arrow(False):
            return OTHER
        start = self.start
        kind = self.conditional()
        if self.kind == "op" and self.val in ASSIGN:
            if kind == OTHER or (kind == PATTERN and self.val != "="):
                raise Bad(start, "can't assign to this")
            if kind == PATTERN:
                self.cover = -1
            self.scan()
            self.assign()
            return OTHER
        return kind

    def yield_(self) -> int:
        self.scan()
        if self.broke or self.kind == "eof" or (self.kind == "op" and self.val in (")", "]", "}", ",", ";", ":")):
            return OTHER
        self.eat("*")
        self.assign()
        return OTHER

    def async_arrow(self) -> bool:
        k, v, broke = self.peek()
        if broke:
            return False
        if k == "name" and v not in RESERVED and v not in ("in", "of", "as", "satisfies", "instanceof"):
            s = self.save()
            self.scan()
            self.name()
            if self.at("=>") and not self.broke:
                self.arrow_body(True)
                return True
            self.back(s)
            return False
        if k == "op" and (v == "(" or (v == "<" and self.types)):
            s = self.save()
            self.scan()
            if self.try_arrow(True):
                return True
            self.back(s)
        return False

    def try_arrow(self, asyn: bool) -> bool:
        """An arrow function from its parameters on; otherwise everything stays as it was."""
        s = self.save()
        try:
            if self.types and self.at("<"):
                self.type_params()
            if not self.at("("):
                raise self.fail()
            keep = self.asyn
            self.asyn = asyn or self.asyn
            self.params()
            self.asyn = keep
            typed = False
            if self.types and self.at(":"):
                self.scan()
                self.return_type()
                typed = True
            if not self.at("=>") or self.broke:
                raise self.fail()
            if typed and s[13]:  # (a) : b => c may end a conditional's middle part
                self.arrow_body(asyn)
                if not self.at(":"):
                    raise self.fail()
                return True
        except Bad:
            self.back(s)
            return False
        self.arrow_body(asyn)
        return True

    def arrow_body(self, asyn: bool) -> None:
        if self.broke:
            raise self.fail()
        self.need("=>")
        if self.at("{"):
            keep = (self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels)
            self.fn, self.asyn, self.gen, self.loop, self.switch, self.no_in, self.in_cond, self.labels = True, asyn, False, 0, 0, False, False, []
            self.block_then(keep)
        else:
            keep2 = (self.asyn, self.gen)
            self.asyn, self.gen = asyn or (self.asyn and not self.fn), False
            self.assign()
            self.asyn, self.gen = keep2

    def conditional(self) -> int:
        kind = self.binary(0)
        if self.at("?"):
            self.scan()
            outer, cond = self.no_in, self.in_cond
            self.no_in, self.in_cond = False, True
            self.assign()
            self.no_in, self.in_cond = outer, cond
            self.need(":")
            self.assign()
            return OTHER
        return kind

    def binary(self, least: int) -> int:
        if self.kind == "private":
            self.scan()
            if not self.at("in"):
                raise self.fail()
            kind = OTHER
        else:
            kind = self.unary()
        while True:
            if self.kind == "op" or self.kind == "name":
                op = self.val
            else:
                return kind
            level = BINARY.get(op)
            if level is None:
                if self.types and self.kind == "name" and op in ("as", "satisfies") and not self.broke and least < 8:
                    self.scan()
                    if op == "as" and self.at("const"):
                        self.scan()
                    else:
                        self.type()
                    continue
                return kind
            if level <= least and op != "**" or level < least or (op == "in" and self.no_in):
                return kind
            self.scan()
            self.binary(level - 1 if op == "**" else level)
            kind = OTHER

    def unary(self) -> int:
        val = self.val
        if self.kind == "op":
            if val in ("++", "--"):
                at = self.start
                self.scan()
                if self.unary() != TARGET:
                    raise Bad(at, "can't change this")
                return OTHER
            if val in UNARY:
                self.scan()
                self.unary()
                if self.at("**"):
                    raise self.fail()
                return OTHER
            if val == "<" and self.types and not self.jsx:
                self.scan()
                if self.at("const"):
                    self.scan()
                else:
                    self.type()
                self.close_angle()
                self.unary()
                return OTHER
        elif self.kind == "name":
            if val in UNARY:
                self.scan()
                self.unary()
                if self.at("**"):
                    raise self.fail()
                return OTHER
            if val == "await" and (self.asyn or (self.module and not self.fn)):
                self.scan()
                self.unary()
                return OTHER
        at = self.start
        kind = self.left_hand()
        if self.kind == "op" and self.val in ("++", "--") and not self.broke:
            if kind != TARGET:
                raise Bad(at, "can't change this")
            self.scan()
            return OTHER
        return kind

    def left_hand(self) -> int:
        """Calls, members and templates after a primary expression."""
        start = self.start
        if self.at("new"):
            kind = self.new()
        elif self.at("import"):
            self.scan()
            if self.eat("."):
                if self.name(True) not in ("meta", "source", "defer"):
                    raise self.fail()
            elif not self.at("("):
                raise self.fail()
            kind = OTHER
        elif self.at("super"):
            self.scan()
            if not (self.at("(") or self.at(".") or self.at("[")):
                raise self.fail()
            kind = OTHER
        else:
            kind = self.primary()
        chain = False
        while True:
            if self.kind != "op":
                return kind
            val = self.val
            if val == ".":
                self.scan()
                if self.kind == "private":
                    self.scan()
                else:
                    self.name(True)
                kind = OTHER if chain else TARGET
            elif val == "?.":
                self.scan()
                chain = True
                kind = OTHER
                if self.at("["):
                    self.index()
                elif self.at("("):
                    self.arguments()
                elif self.kind == "private":
                    self.scan()
                elif self.types and self.at("<"):
                    self.type_args()
                    self.arguments()
                else:
                    self.name(True)
            elif val == "[":
                self.index()
                kind = OTHER if chain else TARGET
            elif val == "(":
                self.arguments()
                kind = OTHER
            elif val == "`":
                if chain:
                    raise self.fail()
                self.template(tagged=True)
                kind = OTHER
            elif val == "!" and self.types and not self.broke:
                self.scan()
            elif val in ("<", "<<") and self.types and self.text[start] != "<":
                s = self.save()
                try:
                    self.type_args()
                    k, v = self.kind, self.val
                    if not (k == "eof" or self.broke or (k == "op" and v in ("(", "`", ")", "]", ":", ";", ",", ".", "?.", "?", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}", "=", "...")) or (k == "name" and v in ("as", "satisfies", "instanceof", "in"))):
                        raise self.fail()
                except Bad:
                    self.back(s)
                    return kind
                kind = OTHER
            else:
                return kind

    def index(self) -> None:
        self.need("[")
        outer, self.no_in = self.no_in, False
        self.expression_alone()
        self.no_in = outer
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        keep = self.no_in, self.in_cond
        self.no_in = self.in_cond = False
        while not self.at(")"):
            self.eat("...")
            self.assign()
            if not self.at(")"):
                self.need(",")
        self.no_in, self.in_cond = keep
        self.scan()

    def new(self) -> int:
        self.scan()
        if self.eat("."):
            if self.name(True) != "target" or not self.fn:
                raise self.fail()
            return OTHER
        if self.at("new"):
            self.new()
        elif self.at("import"):
            raise self.fail()
        elif self.at("super"):
            self.scan()
        else:
            self.primary()
        while True:
            if self.eat("."):
                if self.kind == "private":
                    self.scan()
                else:
                    self.name(True)
            elif self.at("["):
                self.index()
            elif self.at("`"):
                self.template(tagged=True)
            elif self.types and self.at("!") and not self.broke:
                self.scan()
            elif self.at("?."):
                raise self.fail()
            else:
                break
        if self.types and self.at("<"):
            s = self.save()
            try:
                self.type_args()
            except Bad:
                self.back(s)
        if self.at("("):
            self.arguments()
        return OTHER

    def primary(self) -> int:
        kind, val = self.kind, self.val
        if kind == "name":
            if val in RESERVED:
                if val in ("this", "null", "true", "false"):
                    self.scan()
                    return OTHER
                if val == "function":
                    self.function(False)
                    return OTHER
                if val == "class":
                    self.class_(False)
                    return OTHER
                raise self.fail()
            if val == "async":
                k, v, broke = self.peek()
                if k == "name" and v == "function" and not broke:
                    self.scan()
                    self.function(False, asyn=True)
                    return OTHER
            self.name()
            return TARGET
        if kind in ("num", "str"):
            self.scan()
            return OTHER
        if kind == "op":
            if val == "(":
                self.scan()
                keep = self.no_in, self.in_cond
                self.no_in = self.in_cond = False
                inner = self.expression_alone()
                self.no_in, self.in_cond = keep
                self.need(")")
                return inner if inner == TARGET else OTHER
            if val == "[":
                return self.array()
            if val == "{":
                return self.object()
            if val == "`":
                self.template()
                return OTHER
            if val in ("/", "/="):
                return self.regex()
            if val == "<" and self.jsx:
                self.jsx_element()
                self.scan()
                return OTHER
            if val == "@":
                self.decorators()
                self.class_(False)
                return OTHER
        raise self.fail()

    def regex(self) -> int:
        m = _REGEX.match(self.text, self.start)
        if m is None:
            raise self.fail("unterminated regular expression")
        flags = m.group().rpartition("/")[2]
        if len(set(flags)) != len(flags) or not set(flags) <= set("dgimsuvy"):
            raise self.fail("bad flags of a regular expression")
        body = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "x", m.group()[1 : m.end() - m.start() - len(flags) - 1])
        if body.count("(") != body.count(")"):
            raise self.fail("unbalanced regular expression")
        self.end = m.end()
        self.scan()
        return OTHER

    def template(self, tagged: bool = False) -> None:
        text, at, begin = self.text, self.end, self.start
        while True:
            m = _TEMPLATE.match(text, at)
            at = m.end()
            if not tagged and "\\" in m.group() and self.bad_escape(m.group()):
                raise Bad(m.start(), "bad escape sequence")
            if at >= len(text):
                self.start = self.end = at
                self.kind, self.val = "eof", ""
                raise Bad(begin, "unterminated template")
            if text[at] == "`":
                self.end = at + 1
                self.scan()
                return
            self.end = at + 2
            self.scan()
            keep = self.no_in, self.in_cond
            self.no_in = self.in_cond = False
            self.expression_alone()
            self.no_in, self.in_cond = keep
            if not self.at("}"):
                raise self.fail("'}' expected in a template")
            at = self.end

    def array(self) -> int:
        self.scan()
        keep = self.no_in, self.in_cond
        self.no_in = self.in_cond = False
        pattern = True
        while not self.at("]"):
            if self.eat(","):
                continue
            rest = self.eat("...")
            k = self.element()
            pattern = pattern and k
            if not self.at("]"):
                if rest:
                    pattern = False
                self.need(",")
        self.no_in, self.in_cond = keep
        self.scan()
        return PATTERN if pattern else OTHER

    def element(self) -> bool:
        """A value that may also be a target with a default; whether it may."""
        before = self.start
        kind = self.assign_part()
        return kind != OTHER or self.was_default(before)

    def was_default(self, begin: int) -> bool:
        return "=" in self.text[begin : self.last]

    def object(self) -> int:
        self.scan()
        keep = self.no_in, self.in_cond
        self.no_in = self.in_cond = False
        pattern = True
        while not self.at("}"):
            if self.kind == "eof":
                raise self.fail("'}' expected, found end of file")
            if self.eat("..."):
                pattern = (self.assign_part() != OTHER) and pattern
            else:
                pattern = self.property() and pattern
            if not self.at("}"):
                self.need(",")
        self.no_in, self.in_cond = keep
        self.scan()
        return PATTERN if pattern else OTHER

    def property(self) -> bool:
        asyn = gen = False
        word = self.kind == "name"
        if word and self.val in ("get", "set", "async"):
            k, v, broke = self.peek()
            if k in ("name", "str", "num", "private") or (k == "op" and (v == "[" or (v == "*" and self.val == "async"))):
                asyn = self.val == "async"
                if asyn and broke:
                    raise self.fail()
                self.scan()
                gen = self.eat("*")
                self.property_name()
                self.signature_and_body(asyn, gen)
                return False
        if self.eat("*"):
            self.property_name()
            self.signature_and_body(False, True)
            return False
        first, at = self.val, self.start
        self.property_name()
        if self.at("(") or (self.types and self.at("<")):
            self.signature_and_body(False, False)
            return False
        if self.eat(":"):
            return self.element()
        if not word or first in RESERVED or (first == "await" and (self.asyn or self.module)):
            raise Bad(at if word else self.start, f"unexpected {first[:30]!r}" if word else "':' expected")
        if self.at("="):
            if self.cover < 0:
                self.cover = self.start
            self.scan()
            self.assign()
        return True

    # ------------------------------------------------------------ JSX

    def jsx_element(self) -> None:
        """From '<' on; leaves the end after the closing '>', without scanning on."""
        text, begin = self.text, self.start
        name = self.jsx_open(begin)
        if name is None:
            return
        at = self.end
        while True:
            m = _JSX_TEXT.match(text, at)
            at = m.end()
            if at >= len(text):
                self.start = self.end = at
                self.kind, self.val = "eof", ""
                raise Bad(begin, f"<{name}> isn't closed")
            c = text[at]
            if c in ">}":
                raise Bad(at, f"{c!r} in JSX text")
            if c == "{":
                self.end = at + 1
                self.scan()
                if not self.at("}"):
                    self.eat("...")
                    self.expression_alone()
                if not self.at("}"):
                    raise self.fail("'}' expected in JSX")
                at = self.end
                continue
            m = re.compile(r"<\s*/").match(text, at)
            if m:
                at = m.end()
                n = _JSX_NAME.match(text, at)
                close = n.group(1) if n else ""
                at = n.end() if n else at
                m = re.compile(r"\s*>").match(text, at)
                if m is None or close != name:
                    self.start = self.end = at
                    raise Bad(at, f"</{name}> expected")
                self.end = m.end()
                return
            self.start, self.end = at, at + 1
            self.jsx_element()
            at = self.end

    def jsx_open(self, begin: int) -> str | None:
        """An opening tag; its name, or None if it closes itself."""
        text = self.text
        at = begin + 1
        blank = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*")
        at = blank.match(text, at).end()
        if text.startswith(">", at):
            self.end = at + 1
            return ""
        n = _JSX_NAME.match(text, at)
        if n is None:
            self.start = self.end = min(at, len(text))
            raise Bad(at, "tag name expected")
        name, at = n.group(1), n.end()
        if self.types and text.startswith("<", at):
            self.end = at
            self.scan()
            self.type_args(scan_on=False)
            at = self.end
        while True:
            at = blank.match(text, at).end()
            if text.startswith("/", at):
                m = re.compile(r"/\s*>").match(text, at)
                if not m:
                    raise Bad(at, "'>' expected")
                self.end = m.end()
                return None
            if text.startswith(">", at):
                self.end = at + 1
                return name
            if text.startswith("{", at):
                self.end = at + 1
                self.scan()
                self.need("...")
                self.assign()
                if not self.at("}"):
                    raise self.fail("'}' expected in JSX")
                at = self.end
                continue
            n = _JSX_NAME.match(text, at)
            if n is None or "." in n.group(1):
                self.start = self.end = min(at, len(text))
                raise Bad(at, "attribute expected")
            at = blank.match(text, n.end()).end()
            if not text.startswith("=", at):
                continue
            at = blank.match(text, at + 1).end()
            m = _JSX_STRING.match(text, at)
            if m:
                at = m.end()
            elif text.startswith("{", at):
                self.end = at + 1
                self.scan()
                self.assign()
                if not self.at("}"):
                    raise self.fail("'}' expected in JSX")
                at = self.end
            elif text.startswith("<", at):
                self.start, self.end = at, at + 1
                self.jsx_element()
                at = self.end
            else:
                self.start = self.end = min(at, len(text))
                raise Bad(at, "attribute value expected")

    # ------------------------------------------------------------ types

    def type_params(self) -> None:
        if not self.at("<"):
            return
        self.scan()
        while True:
            while self.kind == "name" and self.val in ("const", "in", "out") and (self.val in ("const", "in") or self.peek()[0] == "name"):
                self.scan()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or (self.kind == "op" and self.val[0] == ">"):
                break
        self.close_angle()

    def type_args(self, scan_on: bool = True) -> None:
        if self.val == "<<":
            self.end = self.start + 1
            self.val = "<"
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        if scan_on:
            self.close_angle()
        elif self.kind == "op" and self.val[0] == ">":
            self.end = self.start + 1
        else:
            raise self.fail("'>' expected")

    def return_type(self) -> None:
        if self.at("asserts") and self.peek()[0] == "name" and not self.peek()[2]:
            self.scan()
            self.scan()
            if self.eat("is"):
                self.type()
            return
        if self.kind == "name" and self.peek()[1] == "is" and not self.peek()[2]:
            self.scan()
            self.scan()
            self.type()
            return
        self.type()

    def type(self) -> None:
        if self.at("new") or (self.at("abstract") and self.peek()[1] == "new"):
            self.eat("abstract")
            self.scan()
            self.type_params()
            self.params()
            self.need("=>")
            return self.return_type()
        if self.at("<"):
            self.type_params()
            self.params()
            self.need("=>")
            return self.return_type()
        if self.at("("):
            s = self.save()
            try:
                self.params()
                self.need("=>")
            except Bad:
                self.back(s)
            else:
                return self.return_type()
        self.union()
        if self.at("extends") and not self.broke and not self.no_in_types:
            self.scan()
            keep, self.no_in_types = self.no_in_types, True
            self.type()
            self.no_in_types = keep
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        return None

    no_in_types = False

    def union(self) -> None:
        if self.at("|") or self.at("&"):
            self.scan()
        while True:
            self.type_operator()
            if not (self.at("|") or self.at("&")):
                return
            self.scan()
            if self.at("new") or self.at("<"):
                return self.type()
            if self.at("("):
                s = self.save()
                try:
                    self.params()
                    self.need("=>")
                except Bad:
                    self.back(s)
                else:
                    return self.return_type()

    def type_operator(self) -> None:
        while self.kind == "name" and self.val in ("keyof", "unique", "readonly", "infer"):
            k, v, broke = self.peek()
            if not (k in ("name", "str") or (k == "op" and v in ("(", "[", "{"))):
                break
            if self.val == "infer":
                self.scan()
                self.name()
                if self.at("extends"):
                    s = self.save()
                    try:
                        self.scan()
                        keep, self.no_in_types = self.no_in_types, True
                        self.union()
                        self.no_in_types = keep
                        if self.at("?"):
                            raise self.fail()
                    except Bad:
                        self.no_in_types = keep
                        self.back(s)
                return self.postfix_type()
            self.scan()
        self.atom_type()
        return self.postfix_type()

    def postfix_type(self) -> None:
        while self.at("[") and not self.broke:
            self.scan()
            if not self.at("]"):
                keep, self.no_in_types = self.no_in_types, False
                self.type()
                self.no_in_types = keep
            self.need("]")

    def atom_type(self) -> None:
        kind, val = self.kind, self.val
        if kind == "name":
            if val in ("void", "null", "this", "true", "false"):
                self.scan()
                return None
            if val == "typeof":
                self.scan()
                if self.at("import"):
                    return self.import_type()
                if not self.eat("this"):
                    self.name()
                while self.eat("."):
                    if self.kind == "private":
                        self.scan()
                    else:
                        self.name(True)
                if self.at("<") and not self.broke:
                    self.type_args()
                return None
            if val == "import":
                return self.import_type()
            return self.type_reference()
        if kind in ("num", "str"):
            self.scan()
            return None
        if kind == "op":
            if val == "-":
                self.scan()
                if self.kind != "num":
                    raise self.fail()
                self.scan()
                return None
            if val == "(":
                self.scan()
                keep, self.no_in_types = self.no_in_types, False
                self.type()
                self.no_in_types = keep
                return self.need(")")
            if val == "[":
                return self.tuple_type()
            if val == "{":
                return self.object_type()
            if val == "`":
                return self.template_type()
        raise self.fail("type expected, found " + ("end of file" if kind == "eof" else repr(val[:30])))

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.object()
        self.need(")")
        while self.eat("."):
            self.name(True)
        if self.at("<"):
            self.type_args()

    def type_reference(self) -> None:
        self.name()
        while self.eat("."):
            self.name(True)
        if self.at("<") and not self.broke or self.at("<<"):
            self.type_args()

    def tuple_type(self) -> None:
        self.scan()
        keep, self.no_in_types = self.no_in_types, False
        while not self.at("]"):
            self.eat("...")
            k, v, _ = self.peek()
            if self.kind == "name" and v in (":", "?") and k == "op":
                s = self.save()
                self.scan()
                optional = self.eat("?")
                if self.eat(":"):
                    self.type()
                elif optional and (self.at(",") or self.at("]")):
                    pass
                else:
                    self.back(s)
                    self.type()
            else:
                self.type()
            self.eat("?")
            if not self.at("]"):
                self.need(",")
        self.no_in_types = keep
        self.need("]")

    def template_type(self) -> None:
        text, at, begin = self.text, self.end, self.start
        while True:
            at = _TEMPLATE.match(text, at).end()
            if at >= len(text):
                raise Bad(begin, "unterminated template")
            if text[at] == "`":
                self.end = at + 1
                return self.scan()
            self.end = at + 2
            self.scan()
            self.type()
            if not self.at("}"):
                raise self.fail()
            at = self.end

    def object_type(self) -> None:
        self.need("{")
        keep, self.no_in_types = self.no_in_types, False
        if self.mapped_type():
            self.no_in_types = keep
            return
        while not self.at("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and not self.at("}") and not self.broke:
                raise self.fail()
        self.no_in_types = keep
        self.scan()

    def mapped_type(self) -> bool:
        s = self.save()
        try:
            if self.at("+") or self.at("-"):
                self.scan()
                self.need("readonly")
            else:
                self.eat("readonly")
            self.need("[")
            self.name()
            self.need("in")
        except Bad:
            self.back(s)
            return False
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.at("+") or self.at("-"):
            self.scan()
            self.need("?")
        else:
            self.eat("?")
        if self.eat(":"):
            self.type()
        if not self.eat(";"):
            self.eat(",")
        self.need("}")
        return True

    def type_member(self) -> None:
        if self.at("(") or self.at("<"):
            return self.call_signature()
        if self.at("new") and self.peek()[1] in ("(", "<"):
            self.scan()
            return self.call_signature()
        while self.kind == "name" and self.val in ("readonly", "get", "set") and (self.peek()[0] in ("name", "str", "num") or self.peek()[1] == "["):
            self.scan()
        if self.at("["):
            s = self.save()
            try:
                self.scan()
                self.name()
                self.need(":")
                self.type()
                self.need("]")
                self.need(":")
            except Bad:
                self.back(s)
            else:
                return self.type()
        self.property_name()
        self.eat("?")
        if self.at("(") or self.at("<"):
            return self.call_signature()
        if self.eat(":"):
            self.type()
        return None

    def call_signature(self) -> None:
        self.type_params()
        self.params()
        if self.eat(":"):
            self.return_type()


_STATEMENTS = {
    "if": Parser.s_if, "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do, "switch": Parser.s_switch,
    "try": Parser.s_try, "return": Parser.s_return, "throw": Parser.s_throw, "break": Parser.s_break,
    "continue": Parser.s_break, "var": Parser.s_variables, "const": Parser.s_variables, "function": Parser.s_function,
    "class": Parser.s_class, "import": Parser.s_import, "export": Parser.export, "debugger": Parser.s_debugger,
    "with": Parser.s_with, "enum": Parser.s_enum,
}
_WORDS = frozenset(("let", "async", "using", "type", "interface", "abstract", "declare", "namespace", "module", "global"))


def faults(text: str, types: bool, jsx: bool) -> list[Fault]:
    """All syntax errors of a program; none if it is valid as a script or as a module."""
    parser = Parser(text, types, jsx)
    found = parser.program()
    if found and "await" in text and not parser.module:
        other = Parser(text, types, jsx)
        other.always_module = True
        return found if other.program() else []
    return found
