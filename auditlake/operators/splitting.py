"""Where the functions of a source file begin and end, and what lies outside them.

A small helper per file, linear in the file's length whatever it holds: one pass
blanks comments and literals in place, one pushdown pass pairs the brackets, and
then Python functions end where the indentation does, C and Java functions where
their braces close.  Nested functions and methods are pieces of their own besides
the one around them (down to ``DEEPEST`` levels, so pieces stay bounded by the
file's length); all other lines are ``<module>`` pieces, so the pieces of a
file cover every line that isn't blank.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

MODULE = "<module>"
#: Functions nested deeper than this are part of the piece around them.
DEEPEST = 24

_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"}
_C_OPENS, _PY_OPENS = re.compile(r"[\"']|//|/\*"), re.compile(r"[\"'#]")
_NOT_BREAK = re.compile(r"[^\n]+")
_PY_DEF = re.compile(r"[ \t]*+(?:async[ \t]+)?def[ \t]++(\w+)")
_CALLABLE = re.compile(r"(?<!\w)([A-Za-z_]\w*+)\s*+\(")
_BRACKETS, _ENDS = re.compile(r"[()]|[{}]"), re.compile(r"[;{}]")
#: Between a parameter list and its body: qualifiers and throws, then initialisers; or old-style declarations.
_QUALIFIERS = re.compile(r"\s*+(?:(?:const|noexcept|override|final)\b\s*+)*+(?:throws\s[\w.,\s<>]*+)?+([:{])")
_DECLARATIONS = re.compile(r"(?:\s*+[A-Za-z_][\w\s*,\[\]]*+;)++\s*+\{")
_DIRECTIVE = re.compile(r"(?m)^[ \t]*+#(?:[^\n\\]|\\.|\\\n)*+\n?")
_ANNOTATION = re.compile(r"@[\w.]++\s*+(?:\([^()]*+\))?+")
_NOT_NAMES = {
    "if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "new", "synchronized", "case", "defined", "throw", "try", "goto", "typedef",
}


def _spaces(text: str) -> str:
    return _NOT_BREAK.sub(lambda m: " " * len(m.group()), text)


def _blanked(text: str, python: bool) -> str:
    """The text with comments and literals as spaces; a quote that nothing closes on its line stays."""
    out, at, kept_from, opens = [], 0, 0, _PY_OPENS if python else _C_OPENS
    open_until = {'"': 0, "'": 0}  # up to where a quote of the kind is known to stay open
    while m := opens.search(text, at):
        start, sign = m.start(), m.group()
        if sign in ("#", "//"):
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        elif sign == "/*" or python and text.startswith(sign * 3, start):
            closing = "*/" if sign == "/*" else sign * 3
            end = text.find(closing, start + len(closing))
            end = len(text) if end < 0 else end + len(closing)
        elif start < open_until[sign]:
            at = start + 1
            continue
        elif quoted := _QUOTED[sign].match(text, start):
            end = quoted.end()
        else:
            line_end = text.find("\n", start)
            open_until[sign] = len(text) if line_end < 0 else line_end
            at = start + 1
            continue
        out += [text[kept_from:start], _spaces(text[start:end])]
        at = kept_from = end
    out.append(text[kept_from:])
    return "".join(out)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _python(text: str) -> list[tuple[str, int, int]]:
    """(name, first, last) with lines from 0, by one pass with a stack of the functions that are open."""
    lines, bare = text.split("\n"), _blanked(text, python=True).split("\n")
    depth = [0, *accumulate(sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}") for line in bare)]
    found: list[tuple[str, int, int]] = []
    names, firsts, owns, lasts = [], [], [], []  # of the open functions, from the outermost

    def close() -> None:
        last = lasts.pop()
        owns.pop()
        if len(names) <= DEEPEST:
            found.append((names[-1], firsts[-1], last))
        names.pop()
        firsts.pop()
        if lasts:
            lasts[-1] = max(lasts[-1], last)

    continued = False
    for i, line in enumerate(bare):
        if not line.strip():
            if lines[i].strip():  # a comment inside, or a literal's line
                at = bisect_left(owns, _indent(lines[i])) if lines[i].lstrip().startswith("#") else len(owns)
                if at:
                    lasts[at - 1] = i
        else:
            if depth[i] <= 0 and not continued:
                while owns and _indent(line) <= owns[-1]:
                    close()
                if head := _PY_DEF.match(line):
                    own, first = _indent(line), i
                    while first > 0:
                        above = first - 1
                        while above > 0 and depth[above] > 0:
                            above -= 1
                        if not lines[above].lstrip().startswith("@") or _indent(lines[above]) != own:
                            break
                        first = above
                    names.append(head.group(1))
                    firsts.append(first)
                    owns.append(own)
                    lasts.append(i)
            if lasts:
                lasts[-1] = i
        continued = line.rstrip().endswith("\\")
    while names:
        close()
    return found


def _closings(bare: str) -> tuple[dict[int, int], dict[int, int]]:
    """For every bracket that is closed the place behind its partner, and for every opening parenthesis the one around it."""
    closes, around, open_round, open_curly = {}, {}, [], []
    for m in _BRACKETS.finditer(bare):
        at, sign = m.start(), m.group()
        if sign == "(":
            if open_round:
                around[at] = open_round[-1]
            open_round.append(at)
        elif sign == "{":
            open_curly.append(at)
        else:
            opened = open_round if sign == ")" else open_curly
            if opened:
                closes[opened.pop()] = at + 1
    return closes, around


def _braced(text: str, nested: bool) -> list[tuple[str, int, int]]:
    bare = _blanked(text, python=False)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at) - 1
    ends = [m.start() for m in _ENDS.finditer(bare)]
    closes, around = _closings(bare)
    found, open_ends, decided = [], [], set()

    def body_of(close: int) -> int:
        """Place of the brace that opens the body; -1 if there is none."""
        if m := _QUALIFIERS.match(bare, close):
            if m.group(1) == "{":
                return m.end() - 1
            at = bisect_left(ends, m.end())
            if at < len(ends) and bare[ends[at]] == "{":
                return ends[at]
        m = _DECLARATIONS.match(bare, close)
        return m.end() - 1 if m else -1

    for m in _CALLABLE.finditer(bare):
        while open_ends and m.start() >= open_ends[-1]:
            open_ends.pop()
        if m.group(1) in _NOT_NAMES or (open_ends and not nested) or m.end() - 1 not in closes:
            continue
        body = body_of(closes[m.end() - 1])
        if body < 0 or body in decided:
            continue
        decided.add(body)  # the first list before a body is its parameters', later ones are initialisers
        at = bisect_left(ends, m.start())
        before = max(ends[at - 1] if at else -1, around.get(m.end() - 1, -1)) + 1
        lead = bare[before : m.start()]
        cut = lead.rfind("\n") if lead.rstrip().endswith(">") and "#" in lead else -1
        for directive in _DIRECTIVE.finditer(lead):
            cut = max(cut, directive.end() - 1)
        lead_text = lead[cut + 1 :]
        words = _ANNOTATION.sub(" ", lead_text).split()
        if "=" in lead_text or (words and (words[-1] in _NOT_NAMES or words[-1][-1] in ".,(&|!?+-/%<" or words[0] in ("return", "else", "new", "throw"))):
            continue
        if open_ends and not words:
            continue  # a call or a macro inside a body
        first = before + cut + 1 + len(lead_text) - len(lead_text.lstrip())
        end = closes.get(body, len(bare))
        open_ends.append(end)
        if len(open_ends) <= DEEPEST:
            found.append((m.group(1), line_of(first), line_of(max(first, end - 1))))
    return found


def pieces(text: str | None, language: str | None) -> list[dict]:
    """name, first and last line (from 1) and code of every function and of every stretch outside."""
    text = text or ""
    lines = text.split("\n")
    found = _python(text) if language == "python" else _braced(text, nested=language == "java")
    outside, at = [], 0
    for first, last in [*sorted((a, b) for _, a, b in found), (len(lines), len(lines))]:
        told = [i for i in range(at, first) if lines[i].strip()]
        if told:
            outside.append((MODULE, told[0], told[-1]))
        at = max(at, last + 1)
    found = sorted([*found, *outside], key=lambda p: (p[1], p[2]))
    return [{"name": n, "first": a + 1, "last": b + 1, "code": "\n".join(lines[a : b + 1]).rstrip()} for n, a, b in found]
