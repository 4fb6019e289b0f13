"""Errors of the query language: a message, a place in the text and a hint."""

from __future__ import annotations


class QueryError(ValueError):
    """What is wrong, where, and how to mend it."""

    def __init__(self, message: str, source: str = "", at: int | None = None, hint: str = "", length: int = 1):
        self.message, self.hint, self.at = message, hint, at
        self.line = self.column = 0
        lines = [message]
        if at is not None and source:
            self.line = source.count("\n", 0, at) + 1
            start = source.rfind("\n", 0, at) + 1
            self.column = at - start + 1
            text = source[start:].split("\n", 1)[0]
            lines += [f"  line {self.line}, column {self.column}", f"    {text}", f"    {' ' * (self.column - 1)}{'^' * max(1, length)}"]
        if hint:
            lines.append(f"  hint: {hint}")
        super().__init__("\n".join(lines))


def nearest(name: str, names) -> str:
    """A hint that names the closest of ``names``, or lists them."""
    import difflib

    names = list(names)
    close = difflib.get_close_matches(name, names, 1, 0.6)
    if close:
        return f"did you mean `{close[0]}`?"
    return f"there is {', '.join(names[:8])}" if names else ""
