"""Whether a piece of documentation says more than the name and signature beside it."""

from __future__ import annotations

import re

# Words and phrases that carry no information about a function.
GLUE = frozenset(
    "a an the this that these it its is are be will shall to of for and or in on with by as from does do function method class helper utility"
    " wrapper routine procedure callback constructor simple simply just basic main new given used uses using".split()
)
ECHO_VERBS = frozenset("get gets set sets return returns returned returning gives call calls perform performs execute executes handle handles implement implements implementation define defines definition".split())
TYPES = frozenset(
    "any string strings number numbers void none null nil undefined unknown int integer float double bool boolean str list array dict dictionary"
    " object objects promise map record tuple optional union self cls true false bytes never type types value values param params parameter parameters argument arguments arg args kwargs result results".split()
)
# what follows in the same clause, however long: up to a comma or the sentence's end
_REST_OF = r"(?:[^.!?;,]|[.,](?=\S))*"
PLACEHOLDER = re.compile(
    rf"""(?ix)^\W*(?:
      (?:todo|fixme|xxx|hack|tbd|tba|wip|n/?a|none|null|nil|empty|blank|docstring|doc|docs|documentation|description|summary|comment|placeholder|stub|untitled|lorem\ ipsum.*)
      |(?:todo|fixme|xxx|tbd)\b\W*(?:add|write|fill|complete|document|describe|explain|update|improve|missing)?\W*(?:(?:the|a|some|this|me|it|in|here|later|soon|docs?|docstrings?|documentation|description|comments?|function|method|missing)\W*)*
      |(?:(?:to\ be|not\ yet|needs?\ to\ be|still|please)\W+)?(?:add|write|insert|fill\ in|put|provide)\W+(?:(?:a|an|the|your|some|proper|real|better)\W+)*(?:docs?|docstring|documentation|description|comment|text|summary)s?(?:\W+(?:here|later|soon|now))?
      |(?:to\ be|not\ yet|needs?\ to\ be|still\ to\ be)\W+(?:documented|described|written|done|defined|determined)
      |(?:no|missing|without)\W+(?:docs?|docstring|documentation|description|comment)s?(?:\W+(?:yet|available|here|given|provided))*
      |(?:un|not\ )documented|documentation\W+(?:pending|missing|to\ follow|follows)|coming\ soon|work\ in\ progress
      |(?:auto|automatically|machine|tool)?\W*generated\b(?:\W+(?:by\W+\w+|method|function|stub|code|docs?|docstring|documentation|comment|file|class|constructor|catch|block|javadoc))*
      |auto\W*generated\W+{_REST_OF}
      |(?:noch\ (?:zu\ dokumentieren|nicht\ dokumentiert|offen|undokumentiert)|(?:zu|muss\ noch)\ dokument\w+(?:\ werden)?|dokumentation\ (?:fehlt|folgt)|(?:noch\ )?keine\ (?:beschreibung|dokumentation)(?:\ vorhanden)?|beschreibung\ (?:fehlt|folgt)|hier\ beschreibung\ (?:einfügen|ergänzen))
      |(?:pendiente(?:\ de\ documentar)?|por\ documentar|falta\ (?:la\ )?(?:documentación|descripción|documentar)|sin\ (?:documentar|documentación|descripción)|(?:añadir|agregar|escribir)\ (?:la\ )?(?:descripción|documentación)(?:\ aquí)?)
      |(?:à\ (?:documenter|compléter)|a\ documenter|documentation\ à\ venir|da\ documentare|待补充|待完善|待编写|暂无(?:说明|描述|文档)?|未记录|無し|なし|未記載|後で書く|要ドキュメント|без\ описания|описание\ отсутствует|нужно\ описать|документировать)
    )\W*$"""
)
POINTER = re.compile(
    rf"""(?ix)^\W*(?:
      (?:(?:please|for\ (?:details|documentation|more|docs|information))\W+)?(?:see|refer\ to|cf\.?|compare|check|consult)\b(?:\W+(?:also|the))*\W+{_REST_OF}
      |(?:same|just|exactly)\W+(?:as|like)\b{_REST_OF}|as\W+(?:above|below|before|in\b{_REST_OF})|(?:dito|ditto|idem|likewise|same)
      |(?:docs?|docstring|documentation|description|behaviou?r)?\W*(?:is\W+)?(?:inherited|inherits)(?:\W+(?:from|by|docs?|docstring|documentation)\b{_REST_OF})?
      |inherit\W*docs?|(?:overrides?|overridden|implements|extends)\b(?:\W+(?:of|from|by|in|the|base|parent|super|interface|class|method|docs?|\{{?@?\w+[.\#]?\w*\}}?))*
      |(?:described|documented|explained|defined)\W+(?:above|below|elsewhere|in\b{_REST_OF})
      |(?:siehe|wie|vgl\.?|s\.)\W+(?:oben|unten|dort|{_REST_OF}(?:klasse|methode|doku\w*|basis\w*|eltern\w*))|geerbt(?:\W+von\b{_REST_OF})?
      |(?:véase|ver|igual\ que|como)\W+(?:arriba|abajo|más\W+arriba|{_REST_OF}(?:clase|padre|método|base|documentación))|heredad[oa](?:\W+de\b{_REST_OF})?
      |(?:同上|参见{_REST_OF}|见上文?|見よ|上記参照|см\.?\W{_REST_OF})
    )\W*$"""
)
DIRECTIVE = re.compile(
    r"""(?ix)^\W*(?:
      noqa\b.*|type:\s*ignore.*|pylint:.*|flake8[:-].*|mypy:.*|pyright:.*|ruff:.*|isort:.*|yapf:.*|fmt:\s*\w+.*|black:.*|pragma:?\s*no\W*(?:cover|branch|mutate).*|nosec\b.*|nopep8\b.*|coverage:.*|bandit:.*|sourcery\b.*|cython:.*|distutils:.*|doctest:.*|sphinx-.*
      |(?:eslint|tslint|jshint|jscs|jslint|prettier|stylelint|biome|standard|oxlint|deno-lint)[-:\w]*(?:\s.*)?|(?:istanbul|c8|v8|vitest|jest)\s+ignore\b.*|@ts-\w+.*|@jest-environment.*|@flow\b.*|@jsx\w*.*|webpack\w+:.*|@vite-ignore|sourceMappingURL=.*|global\s+\w+.*|region\b.*|endregion\b.*|-\*-.*-\*-|vim?:.*
      |todo-lint.*|codespell:.*|cspell:.*|spell-?checker:.*|lint-?ignore.*|clang-format\s.*|go:\w+.*|\#?nolint.*
    )\s*$"""
)
_BARE_TAG = re.compile(r"(?i)^\{?@(?:override|inherit_?doc|private|public|protected|internal|ignore|hidden|readonly|static|abstract|async|virtual|final|api|beta|alpha|export|constructor|class|function|method|func|memberof|module|name|type|template|typedef|callback|implements|extends|augments|see|link|author|version|since|license|package|access|kind|nocollapse|suppress|generator|yields?)\b")
_JSDOC = re.compile(r"^@(\w+)\s*(?:\{[^}]*\}*)?\s*(.*)$", re.S)
_REST = re.compile(r"^:(\w+)(?:\s+([^:]*))?:\s*(.*)$", re.S)
_SECTION = re.compile(r"(?i)^(args|arguments|parameters|params|keyword args|keyword arguments|returns?|raises|throws|yields|attributes|note|notes|example|examples|see also|warnings?|references|todo|parameter|rückgabe|parámetros|devuelve)\s*:?\s*$")
_ENTRY = re.compile(r"^(\*{0,2}\w+)\s*(?:\([^)]*\)|\{[^}]*\})?\s*(?::|-{1,2}|–)\s*(.*)$")
_NUMPY = re.compile(r"^(\*{0,2}\w+)\s+:\s+(.*)$")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
_LINK = re.compile(r"\{@\w+[^}]*\}|https?://\S+")
_WIDE = re.compile(r"[Ѐ-ӿ぀-ヿ㐀-鿿가-힯]")


def name_words(*names: str | None) -> set[str]:
    """The words of identifiers, in lower case."""
    return {w.lower() for n in names if n for w in _HUMP.findall(n.replace("_", " "))}


def _echoes(word: str, known: set[str]) -> bool:
    """Whether a word is one of the known, up to its ending."""
    if word in known:
        return True
    for n in known:
        if len(n) >= 3 and abs(len(word) - len(n)) <= 4:
            stem = n[: max(3, len(n) - 1)]
            if word.startswith(stem) and (word[len(stem) :] in _ENDINGS or word[len(n) :] in _ENDINGS):
                return True
    return False


_ENDINGS = frozenset(("", "s", "es", "ed", "d", "ing", "er", "r", "or", "y", "ies", "ied", "e", "ly", "ion", "ment", "tion", "ping", "ning", "ting", "ged", "ped", "ted", "ned", "ging", "ations", "ation", "n", "t", "te", "ts"))


def _said(line: str, state: dict) -> str:
    """What a line explains, without tags, parameter names and types; state keeps the section."""
    text = line.strip()
    if not text:
        state["numpy"] = False
        return ""
    if not any(c.isalnum() for c in text):
        return ""
    if DIRECTIVE.match(text) or _BARE_TAG.match(text) and not re.match(r"(?i)^@(?:yields?|type)\b", text):
        return ""
    m = _JSDOC.match(text)
    if m:
        tag, rest = m.group(1).lower(), m.group(2)
        state["section"] = "tag"
        if tag in ("param", "arg", "argument", "property", "prop", "template", "typeparam"):
            rest = re.sub(r"^(?:\[[^\]]*\]|\S+)\s*(?:-{1,2}|–|:)?\s*", "", rest, count=1)
        elif tag in ("throws", "exception", "raises"):
            rest = re.sub(r"^\w+\s*(?:-|:)?\s*", "", rest, count=1)
        elif tag in ("type", "todo"):
            return ""
        return rest
    m = _REST.match(text)
    if m:
        state["section"] = "tag"
        tag, rest = m.group(1).lower(), m.group(3)
        return "" if tag in ("type", "rtype", "vartype") else rest
    m = _SECTION.match(text)
    if m:
        state["section"] = m.group(1).lower()
        return ""
    section = state.get("section", "")
    if section.startswith(("arg", "param", "keyword", "attr", "raise", "throw", "parám")):
        m = _NUMPY.match(text)
        if m and state.get("indent") == "numpy":
            return ""
        m = _ENTRY.match(text)
        if m:
            return m.group(2)
        if re.fullmatch(r"\*{0,2}\w+", text):
            return ""
    if section.startswith(("return", "yield", "rück", "devuel")):
        m = re.match(r"^([\w\[\], |.]+):\s*(.*)$", text)
        if m and len(m.group(1).split()) <= 3:
            return m.group(2)
    return text


def informative(doc: str | None, name: str | None, signature: str | None = None) -> bool:
    """Whether a documentation text tells more than name and signature do.

    Not enough are blank texts, placeholders, rulers, pointers to other documentation, tool
    directives, the name in other words, and lists of parameters or types without explanation. One
    word that is none of these is enough, in any language. None is not informative.
    """
    if not doc or not doc.strip():
        return False
    known = name_words(name, signature)
    squeezed = " ".join(doc.split())
    if PLACEHOLDER.match(squeezed) or POINTER.match(squeezed) or DIRECTIVE.match(squeezed):
        return False
    if squeezed.strip("`'\"() .;:").lower() == (name or "").lower():
        return False
    state: dict = {}
    extra = 0
    for line in doc.splitlines():
        said = _LINK.sub(" ", _said(line, state)).strip()
        if not said:
            continue
        for sentence in re.split(r"(?<=[.!?;])\s+", said):
            s = sentence.strip()
            if not s or PLACEHOLDER.match(s) or POINTER.match(s) or DIRECTIVE.match(s) or re.match(r"(?i)^\W*(?:todo|fixme|xxx)\b", s):
                continue
            if s.startswith(">>>"):
                state["example"] = True
                continue
            for w in _WORD.findall(s):
                if _WIDE.search(w):
                    extra += 2
                    continue
                low = w.lower()
                if low != w and low[1:] != w[1:] and all(_echoes(h, known) for h in name_words(w)):
                    continue  # an identifier made of known words
                if low in GLUE or low in TYPES or low in ECHO_VERBS or _echoes(low, known):
                    continue
                extra += 1
    return extra >= 1
