"""A small lexer for source files: words, quoted texts and signs, with their places.

It knows nothing of a language's grammar; scanners look for calls, brackets and names in its tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

_QUOTES = "\"'`"
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
_TOKEN = re.compile(
    r"""(?P<word>\w+) | (?P<text>"(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' | `(?:\\.|[^`\\])*`) | (?P<sign>\S)""", re.VERBOSE | re.DOTALL
)
_BARE = re.compile(r"(?P<word>\w+)|(?P<sign>\S)")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int

    @property
    def value(self) -> str | None:
        """What stands between the quotes, up to any other quote; None of a token that isn't quoted."""
        if self.kind != "text":
            return None
        inner = self.text[1:-1]
        return inner[: min((i for i in map(inner.find, _QUOTES) if i >= 0), default=len(inner))]


class Call(NamedTuple):
    """Names joined by points before an opening bracket, with the place of the first name's token and of the bracket's."""

    names: tuple[str, ...]
    generic: bool
    first: int
    open: int


class Source:
    """The tokens of a text; with ``quotes`` off, quotes are signs like others."""

    def __init__(self, text: str, quotes: bool = True):
        self.text = text
        self.tokens = [Token(m.lastgroup, m.group(), *m.span()) for m in (_TOKEN if quotes else _BARE).finditer(text)]

    def is_at(self, i: int, *wanted: str) -> bool:
        """Whether the tokens from there on read so."""
        return 0 <= i and [t.text for t in self.tokens[i : i + len(wanted)]] == list(wanted)

    def word(self, i: int) -> str | None:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "word" else None

    def value(self, i: int) -> str | None:
        return self.tokens[i].value if 0 <= i < len(self.tokens) else None

    def index(self, offset: int) -> int:
        """The first token that starts there or later."""
        return bisect_left(self.tokens, offset, key=lambda t: t.start)

    def broken(self, i: int) -> bool:
        """Whether a new line begins between this token and the next."""
        after = self.tokens[i + 1].start if i + 1 < len(self.tokens) else len(self.text)
        return "\n" in self.text[self.tokens[i].end : after]

    def closing(self, i: int, until: int | None = None) -> int | None:
        """The place of the bracket that closes the one at ``i``; None if there is none before ``until``."""
        opened, depth = self.tokens[i].text, 0
        for k in range(i, len(self.tokens) if until is None else min(until, len(self.tokens))):
            if self.tokens[k].text == opened:
                depth += 1
            elif self.tokens[k].text == _CLOSING[opened]:
                depth -= 1
                if not depth:
                    return k
        return None

    def next(self, sign: str, i: int) -> int | None:
        """The next such sign from ``i`` on, of whatever depth."""
        return next((k for k in range(i, len(self.tokens)) if self.tokens[k].text == sign), None)

    def calls(self) -> Iterator[Call]:
        """Every name or chain of names with a bracket after it; type arguments in between are passed over."""
        for i, t in enumerate(self.tokens):
            if t.text != "(" or not i:
                continue
            k = i - 1
            generic = self.tokens[k].text == ">"
            if generic:
                k = next((j for j in range(k - 1, -1, -1) if self.tokens[j].text in "<>"), -1)
                if k < 1 or self.tokens[k].text != "<":
                    continue
                k -= 1
            names = []
            while self.word(k) is not None:
                names.append(self.tokens[k].text)
                if k < 2 or self.tokens[k - 1].text != ".":
                    break
                k -= 2
            if names:
                # A chain may hang on something that isn't a name, as in f().g(); what is known of it starts there.
                yield Call(tuple(reversed(names)), generic, k if self.word(k) is not None else k + 2, i)


def skip_space(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def block_at(text: str, start: int, reach: int) -> str:
    """The text from an opening brace to before the one that closes it, if that is within reach; else nothing."""
    depth = 0
    for i in range(start, min(len(text), start + reach)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i]
    return ""


class Before:
    """Which of the named stretches that are complete by an offset starts last."""

    def __init__(self, found: list[tuple[int, int, str]]):
        ordered = sorted((end, start, name) for start, end, name in found)
        self.ends, self.names, latest = [e for e, _, _ in ordered], [], -1
        for _, start, name in ordered:
            self.names.append(name if start > latest else self.names[-1])
            latest = max(latest, start)

    def __call__(self, offset: int, otherwise: str | None = None) -> str | None:
        known = bisect_left(self.ends, offset + 1)
        return self.names[known - 1] if known else otherwise


def function_heads(source: Source, any_type: bool) -> list[tuple[int, int, str]]:
    """(start, end, name) of what reads like the head of a function: a name, arguments up to the first closing bracket, maybe a type, and a brace.

    The type is a run without blanks, or with ``any_type`` whatever has no equals sign and no brace.
    """
    text, out, done = source.text, [], 0
    for i, t in enumerate(source.tokens):
        if t.kind != "word" or t.start < done or not source.is_at(i + 1, "("):
            continue
        close = text.find(")", source.tokens[i + 1].end)
        if close < 0:
            break
        brace = _after_type(text, skip_space(text, close + 1), any_type)
        if brace is not None:
            start = source.tokens[i - 1].start if source.word(i - 1) == "async" else t.start
            out.append((start, brace + 1, t.text))
            done = brace + 1
    return out


def _after_type(text: str, i: int, any_type: bool) -> int | None:
    """Where the brace stands that follows at once or after a colon and a type."""
    if text[i : i + 1] == "{":
        return i
    if text[i : i + 1] != ":":
        return None
    if any_type:
        brace = text.find("{", i + 2)
        return brace if brace > 0 and "=" not in text[i + 1 : brace] else None
    run = skip_space(text, i + 1)
    end = run
    while end < len(text) and not text[end].isspace():
        end += 1
    after = skip_space(text, end)
    if end > run and text[after : after + 1] == "{":
        return after
    brace = text.rfind("{", run + 1, end)
    return brace if brace > 0 else None


def arrow_heads(source: Source) -> list[tuple[int, int, str]]:
    """(start, end, name) of constants that are functions with a body in braces."""
    text, out = source.text, []
    for i, t in enumerate(source.tokens):
        if t.text != "const" or source.word(i + 1) is None or not source.is_at(i + 2, "="):
            continue
        k = i + 4 if source.word(i + 3) == "async" else i + 3
        if not source.is_at(k, "("):
            continue
        close = text.find(")", source.tokens[k].end)
        at = skip_space(text, close + 1) if close >= 0 else len(text)
        if text[at : at + 1] == ":":  # a type, which has no equals sign
            at = text.find("=", at)
        if at >= 0 and text[at : at + 2] == "=>" and text[(brace := skip_space(text, at + 2)) : brace + 1] == "{":
            start = source.tokens[i - 1].start if source.word(i - 1) == "export" else t.start
            out.append((start, brace + 1, source.tokens[i + 1].text))
    return out
