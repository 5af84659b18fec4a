"""Regular expressions: compilation, templates with &n group references, dialects."""

from __future__ import annotations

import re

import regex

_REF = regex.compile(r"&(\d+)")


def compiled(pattern: str | re.Pattern | regex.Pattern, flags: str = "") -> regex.Pattern:
    """A pattern of the regex module; flags is a string of i, m, s, u, x, l letters."""
    if not isinstance(pattern, str):
        keep = pattern.flags
        letters = "".join(x for x, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if keep & f)
        return compiled(pattern.pattern, flags + letters)
    f = regex.UNICODE
    for x in flags:
        f |= {"i": regex.IGNORECASE, "m": regex.MULTILINE, "s": regex.DOTALL, "x": regex.VERBOSE, "u": regex.UNICODE, "l": 0}[x]
    return regex.compile(pattern, f)


def has_refs(template: str) -> bool:
    return _REF.search(template) is not None


def expand(template: str, m: regex.Match) -> str:
    """The template with each &n replaced by group n; a group that took no part is empty."""
    return _REF.sub(lambda r: m.group(int(r.group(1))) or "", template)


def substitute(pattern: regex.Pattern, template: str, text: str) -> tuple[str, int]:
    """(text with matches replaced by the expanded template, number of replacements)."""
    if has_refs(template):
        return pattern.subn(lambda m: expand(template, m), text)
    return pattern.subn(lambda _: template, text)


_PORTABLE = regex.compile(r"(?:[\w ,;:!@#%&\"'<>=~`/-]|\\[pP]\{\w+\}|\\n|\\t|\\r|\\\.|\[\^?(?:[\w ,;:.!@#%&*+?(){}|$\"'<>=~`/-]|\\[pP]\{\w+\}|\\n|\\t|\\r|\\\]|\\\\)+\]|\+)+")


def portable(pattern: str) -> bool:
    """Whether Java and Python surely agree on the pattern: literals, classes and + only, never empty."""
    return _PORTABLE.fullmatch(pattern) is not None and not pattern.startswith("+") and "\\w" not in pattern and "++" not in pattern
