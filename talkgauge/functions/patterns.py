"""Regular expressions written once, in Python's syntax, for Python and for Java's matcher.

Python's ``\\w \\d \\s \\b`` know Unicode; Java's don't, and Java's Unicode flag counts combining marks as word
characters, which Python doesn't. ``to_java`` spells the classes out, so that both find the same matches.
"""

from __future__ import annotations

_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\s\x1c-\x1f\x85\p{Z}"}
_WORD = rf"[{_CLASSES['w']}]"
#: Inside a plain word there is no boundary: two cheap looks rule that out before the classes of Unicode are asked.
_NOT_INSIDE = "(?:(?<![A-Za-z0-9_])|(?![A-Za-z0-9_]))"
_BOUNDARY = rf"{_NOT_INSIDE}(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def to_java(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """``pattern`` (Python's syntax) in Java's."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            code = pattern[i + 1]
            i += 2
            if code.lower() in _CLASSES:
                inner = _CLASSES[code.lower()]
                negated = code.isupper()
                out.append(f"[^{inner}]" if negated else inner if in_class else f"[{inner}]")
            elif code == "b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append("\\" + code)
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        if ch == "[":
            out.append("\\[")
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "&" and in_class:
            out.append("\\&")
        elif pattern.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 3
        else:
            out.append(ch)
        i += 1
    flags = ("iu" if ignore_case else "") + ("s" if dot_all else "")
    return (f"(?{flags})" if flags else "") + "".join(out)
