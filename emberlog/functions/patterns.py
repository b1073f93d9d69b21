"""Patterns of the query language (linear-time dialect) as patterns of the JVM."""

from __future__ import annotations

import re

from emberlog.plans.errors import Position, QueryError

#: POSIX classes and what they hold.
CLASSES = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_GROUP = re.compile(r"\(\?(?:P?<[A-Za-z_]\w*>|[a-zA-Z]*(?:-[a-zA-Z]+)?[:)])")


def translate(pattern: str, position: Position = Position()) -> str:
    """The same pattern for java.util.regex; what the dialect lacks is an E-TYPE error."""

    def bad(why: str) -> QueryError:
        return QueryError("E-TYPE", position, f"invalid pattern {pattern!r}: {why}")

    out, at, inside, multiline = [], 0, False, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern):
                raise bad("trailing backslash")
            e = pattern[at + 1]
            if e in "123456789kCGXRhHVNZ":
                raise bad(f"\\{e} is not supported")
            if e == "Q":
                end = pattern.find("\\E", at + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.sub(r"([^A-Za-z0-9\s])", r"\\\1", pattern[at + 2 : end]))
                at = end + 2
                continue
            out.append(("\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]") if e == "s" else "[^\\t\\n\\f\\r ]" if e == "S" and not inside else "\\x0B" if e == "v" else c + e)
            at += 2
        elif inside:
            m = re.match(r"\[:(\^?)(\w+):\]", pattern[at:])
            if m:
                if m[2] not in CLASSES:
                    raise bad(f"unknown class [:{m[2]}:]")
                out.append(f"[^{CLASSES[m[2]]}]" if m[1] else CLASSES[m[2]])
                at += m.end()
                continue
            inside = c != "]"
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
            at += 1
        elif c == "[":
            inside = True
            m = re.match(r"\[\^?\]?", pattern[at:])
            out.append(m[0][:-1] + "\\]" if m[0].endswith("]") else m[0])
            at += m.end()
        elif c == "(" and pattern.startswith("(?", at):
            if not (m := _GROUP.match(pattern, at)):
                raise bad("this kind of group is not supported")
            text = m[0].replace("(?P<", "(?<")
            flags = re.match(r"\(\?([a-zA-Z]*)", text)[1] if "<" not in text else ""
            if set(flags) - set("ims"):
                raise bad(f"flags {flags!r} are not supported")
            multiline |= "m" in flags
            out.append(text)
            at = m.end()
        elif c == "$":
            out.append("$" if multiline else "\\z")
            at += 1
        elif c in "*+?}" and pattern[at + 1 : at + 2] == "+":
            raise bad("possessive quantifiers are not supported")
        else:
            out.append(c)
            at += 1
    text = "(?d)" + "".join(out)
    try:
        re.compile(re.sub(r"\\z|\\p\{\w+\}|\\P\{\w+\}|\\[pP]\w", "x", "".join(out)).replace("(?<", "(?P<"))
    except re.error as e:
        raise bad(str(e)) from None
    return text
