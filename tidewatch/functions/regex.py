"""Turn a Python regular expression into one the JVM reads the same way.

Runs on the driver, once per rule. Groups are addressed by number afterwards, so names are dropped.
"""

from __future__ import annotations

import re
from re import _parser as sre

UNICODE_CLASSES = re.compile(r"\\[wWdDsSbB]")
QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


class UnsupportedPattern(ValueError):
    """The pattern uses a construct with no JVM counterpart."""


def group_number(pattern: str, group: int | str) -> int | None:
    """Number of a capture group given by number or name; None when the pattern has no such group."""
    compiled = re.compile(pattern, re.MULTILINE)
    if isinstance(group, str) and group.isdigit() and group not in compiled.groupindex:
        group = int(group)
    if isinstance(group, int):
        return group if 0 <= group <= compiled.groups else None
    return compiled.groupindex.get(group)


def optional_groups(pattern: str) -> set[int]:
    """Groups that may take no part in a match."""
    found: set[int] = set()

    def walk(items, optional: bool) -> None:
        for op, arg in items:
            name = str(op)
            if name == "SUBPATTERN":
                number, _, _, inner = arg
                if optional and number:
                    found.add(number)
                walk(inner, optional)
            elif name == "BRANCH":
                for branch in arg[1]:
                    walk(branch, True)
            elif name.endswith("REPEAT"):
                low, _, inner = arg
                walk(inner, optional or low == 0)
            elif name in ("ASSERT", "ASSERT_NOT"):
                walk(arg[1], optional or name == "ASSERT_NOT")
            elif name == "ATOMIC_GROUP":
                walk(arg, optional)

    walk(sre.parse(pattern, re.MULTILINE), False)
    return found


def _nodes(items):
    for op, arg in items:
        name = str(op)
        yield name
        if name == "SUBPATTERN":
            yield from _nodes(arg[3])
        elif name == "BRANCH":
            for branch in arg[1]:
                yield from _nodes(branch)
        elif name.endswith("REPEAT"):
            yield from _nodes(arg[2])
        elif name == "ATOMIC_GROUP":
            yield from _nodes(arg)


def reads_context(pattern: str) -> bool:
    """Whether a match depends on text around it (anchors, word borders, lookaround)."""
    parsed = sre.parse(pattern, re.MULTILINE)
    return any(name in ("AT", "ASSERT", "ASSERT_NOT", "GROUPREF_EXISTS") for name in _nodes(parsed))


def required_literal(pattern: str, least: int = 3) -> str | None:
    """Longest text that every match holds, if it has at least ``least`` characters."""
    parsed = sre.parse(pattern, re.MULTILINE)
    if parsed.state.flags & re.IGNORECASE:
        return None
    runs = [""]

    def visit(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                visit(arg[3])
            elif name != "AT":
                # Whatever else matches here, the text after it starts a new run.
                runs.append("")

    visit(parsed)
    best = max(runs, key=len)
    return best if len(best) >= least else None


def _class_body(pattern: str, start: int) -> tuple[str, int]:
    """Rewrite the character class whose ``[`` is at ``start``; returns the text and the next index."""
    out = ["["]
    i = start + 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    first = True
    while i < len(pattern):
        ch = pattern[i]
        if ch == "]" and not first:
            return "".join(out) + "]", i + 1
        if ch == "\\":
            text, i = _escape(pattern, i, {}, in_class=True)
            out.append(text)
        else:
            out.append("\\" + ch if ch in "[]&^" else ch)
            i += 1
        first = False
    raise UnsupportedPattern(f"unterminated character class in {pattern!r}")


def _escape(pattern: str, i: int, names: dict[str, int], in_class: bool = False) -> tuple[str, int]:
    nxt = pattern[i + 1]
    if nxt == "Z":
        return r"\z", i + 2
    if nxt == "v":
        return r"\x0B", i + 2
    if nxt == "b" and in_class:
        return r"\x08", i + 2
    if nxt == "N":
        raise UnsupportedPattern("named characters are not supported")
    if nxt == "U":
        return r"\x{" + pattern[i + 2 : i + 10] + "}", i + 10
    if nxt.isdigit():
        digits = re.match(r"0[0-7]{0,2}|[0-3][0-7]{2}|\d{1,2}", pattern[i + 1 :]).group()
        octal = nxt == "0" or in_class or len(digits) == 3
        end = i + 1 + len(digits)
        return (rf"\x{int(digits, 8):02X}" if octal else rf"(?:\{digits})"), end
    return pattern[i : i + 2], i + 2


def to_jvm(pattern: str, multiline: bool = True) -> str:
    """The JVM spelling of a Python pattern, flags included."""
    compiled = re.compile(pattern, re.MULTILINE if multiline else 0)
    if compiled.flags & re.VERBOSE:
        raise UnsupportedPattern("verbose patterns are not supported")
    names = dict(compiled.groupindex)
    # The JVM's ^ does not match after a final newline; only an empty match can tell.
    matches_empty = multiline and compiled.search("") is not None
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            text, i = _escape(pattern, i, names)
            out.append(text)
        elif ch == "[":
            text, i = _class_body(pattern, i)
            out.append(text)
        elif pattern.startswith("(?P<", i):
            out.append("(")
            i = pattern.index(">", i) + 1
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"(?:\{names[pattern[i + 4:end]]})")
            i = end + 1
        elif pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
        elif pattern.startswith("(?(", i):
            raise UnsupportedPattern("conditional groups are not supported")
        elif ch == "{":
            hit = QUANTIFIER.match(pattern, i)
            if hit and out and (hit.group(1) or hit.group(2)) and hit.group() != "{,}":
                out.append(f"{{{hit.group(1) or 0}{hit.group(2)}{hit.group(3)}}}")
                i = hit.end()
            elif hit and hit.group() == "{,}":
                out.append("*")
                i = hit.end()
            else:
                out.append(r"\{")
                i += 1
        elif ch == "}":
            out.append(r"\}")
            i += 1
        elif ch == "^" and matches_empty:
            out.append(r"(?<![^\n])")
            i += 1
        else:
            out.append(ch)
            i += 1
    flags = "d" + ("m" if multiline else "")
    if compiled.flags & re.IGNORECASE:
        flags += "u"
    if UNICODE_CLASSES.search(pattern) and not compiled.flags & re.ASCII:
        flags += "U"
    body = re.sub(r"^\(\?([aiLmsux]+)\)", lambda m: _inline_flags(m.group(1)), "".join(out))
    return f"(?{flags}){body}"


def _inline_flags(letters: str) -> str:
    kept = "".join(x for x in letters if x in "ims")
    return f"(?{kept})" if kept else ""


def quote(literal: str) -> str:
    """A JVM pattern for the literal text."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def glob_to_jvm(name: str) -> str:
    """JVM pattern for one glob path segment (``*``, ``?``, ``[...]``), to be matched whole."""
    out: list[str] = []
    literal = ""
    i = 0
    while i < len(name):
        ch = name[i]
        special = None
        step = 1
        if ch == "*":
            special = "[^/]*"
        elif ch == "?":
            special = "[^/]"
        elif ch == "[":
            end = name.find("]", i + 2 + (name[i + 1 : i + 2] == "!"))
            if end > 0:
                body = name[i + 1 : end]
                negate = body.startswith("!")
                body = body[1:] if negate else body
                body = re.sub(r"([\[\]\\&^])", r"\\\1", body)
                special = f"[{'^' if negate else ''}{body}]"
                step = end + 1 - i
        if special is None:
            literal += ch
        else:
            if literal:
                out.append(quote(literal))
                literal = ""
            out.append(special)
        i += step
    if literal:
        out.append(quote(literal))
    return "(?s)^" + "".join(out) + r"\z"
