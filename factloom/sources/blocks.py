"""The blocks of a Scala text, in braces or by indentation, as one tree of token ranges.

The definition scan adds a block for each statement that it finds, with the owner of its members;
the lines' columns give those of indented bodies. The reference scan reads both and so treats
braces and indentation alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import PAIRS, Tokens

#: What an indented block may follow at a line's end.
OPENERS = frozenset("= => ?=> <- if then else while do for yield try catch finally match return throw with :".split())


@dataclass(frozen=True, slots=True)
class Block:
    """Tokens [begin, end) of a statement; owner: of its members, if it has some."""

    begin: int
    end: int
    owner: str | None = None


def indented(t: Tokens) -> dict[int, int]:
    """The index after the last token of each indented block, by the index of its first token.

    A block begins where a line stands further right than the line that an opener ends, and lasts
    until a line stands further left than it, or the bracket around it closes.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # (first token, column) of open blocks; (-1, 0) of open brackets
    column = 0  # of the first token of the line
    for i, token in enumerate(t.tokens):
        if token.first:
            while stack and stack[-1][0] >= 0 and token.char < stack[-1][1]:
                ends[stack.pop()[0]] = i
            if i and t.text(i - 1) in OPENERS and t.tokens[i - 1].kind != "string" and token.char > column and token.text not in PAIRS.values():
                stack.append((i, token.char))
            column = token.char
        if token.kind == "mark":
            if token.text in PAIRS:
                stack.append((-1, 0))
            elif token.text in PAIRS.values():
                while stack and stack[-1][0] >= 0:
                    ends[stack.pop()[0]] = i
                if stack:
                    stack.pop()
    return ends | {begin: len(t) for begin, _ in stack if begin >= 0}
