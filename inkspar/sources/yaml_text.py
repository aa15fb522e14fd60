"""YAML as indexes are exchanged in it: block and flow collections, quoted and plain scalars, tags with translators.

A translator is a pair of functions: from an object to plain data (maps, lists, strings, numbers, booleans, null) and back.  It is
found by its tag when text is read, and by the class of the object when text is written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class YamlError(ValueError):
    pass


@dataclass(frozen=True)
class Tagged:
    """A node whose tag has no translator."""

    tag: str
    value: Any


@dataclass(frozen=True)
class Translator:
    tag: str
    kind: type
    plain: Callable[[Any], Any]
    back: Callable[[Any], Any]


_PLAIN = re.compile(r"[A-Za-z_/][A-Za-z0-9_/.@-]*")
_WORDS = {"null": None, "~": None, "": None, "true": True, "false": False}
_INT = re.compile(r"[-+]?\d+")
_FLOAT = re.compile(r"[-+]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][-+]?\d+)?")
_SPECIAL = {".inf": float("inf"), "-.inf": float("-inf"), ".nan": float("nan")}
_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#'\"\[\]{},!&*|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)")


def scalar_text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        special = {float("inf"): ".inf", float("-inf"): "-.inf"}.get(value)
        return special or (".nan" if value != value else repr(value) if "." in repr(value) else repr(value).replace("e", ".0e"))
    if isinstance(value, str):
        return value if _PLAIN.fullmatch(value) and value.lower() not in _WORDS else json.dumps(value, ensure_ascii=False)
    raise YamlError(f"no YAML form: {type(value).__name__}")


def dump(value: Any, translators: list[Translator] = (), indent: int = 0) -> str:
    """Block style without a limit on width."""
    tag = ""
    found = next((t for t in translators if isinstance(value, t.kind)), None)
    if found:
        tag, value = found.tag, found.plain(value)
    elif isinstance(value, Tagged):
        tag, value = value.tag, value.value
    head = f"{tag} " if tag else ""
    pad = " " * indent
    if isinstance(value, dict):
        if not value:
            return f"{head}{{}}\n"
        lines = [f"{pad}{scalar_text(k)}:{_inside(v, translators, indent)}" for k, v in value.items()]
        return (f"{tag}\n" if tag else "\n" if indent else "") + "".join(lines)
    if isinstance(value, (list, tuple)):
        if not value:
            return f"{head}[]\n"
        lines = [f"{pad}-{_inside(v, translators, indent)}" for v in value]
        return (f"{tag}\n" if tag else "\n" if indent else "") + "".join(lines)
    return f"{head}{scalar_text(value)}\n"


def _inside(value: Any, translators: list[Translator], indent: int) -> str:
    text = dump(value, translators, indent + 2)
    return text if text.startswith("\n") else " " + text


class _Lines:
    def __init__(self, text: str):
        self.rows: list[tuple[int, str]] = []
        for line in text.splitlines():
            bare = _without_comment(line)
            if bare.strip() and bare.strip() not in ("---", "..."):
                self.rows.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))
        self.at = 0

    def peek(self) -> tuple[int, str]:
        return self.rows[self.at] if self.at < len(self.rows) else (-1, "")


def _without_comment(line: str) -> str:
    quote, at = "", 0
    while at < len(line):
        c = line[at]
        if quote:
            if c == "\\" and quote == '"':
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"" and (at == 0 or line[at - 1] in " [{,:"):
            quote = c
        elif c == "#" and (at == 0 or line[at - 1] == " "):
            return line[:at]
        at += 1
    return line


def load(text: str, translators: list[Translator] = ()) -> Any:
    by_tag = {t.tag: t for t in translators}
    lines = _Lines(text)
    value = _node(lines, 0, by_tag)
    if lines.at < len(lines.rows):
        raise YamlError(f"not understood: {lines.peek()[1][:60]}")
    return value


def _tagged(tag: str, value: Any, by_tag: dict[str, Translator]) -> Any:
    if not tag:
        return value
    return by_tag[tag].back(value) if tag in by_tag else Tagged(tag, value)


def _split_tag(text: str) -> tuple[str, str]:
    if not text.startswith("!"):
        return "", text
    tag, _, rest = text.partition(" ")
    return tag, rest.strip()


def _node(lines: _Lines, least: int, by_tag: dict[str, Translator]) -> Any:
    """The block that begins at the next line, if that is indented by least or more."""
    indent, text = lines.peek()
    if indent < least:
        return None
    if text == "-" or text.startswith("- "):
        return _sequence(lines, indent, by_tag)
    if _KEY.match(text):
        return _mapping(lines, indent, by_tag)
    lines.at += 1
    return _value(lines, text, indent, by_tag)


def _value(lines: _Lines, text: str, indent: int, by_tag: dict[str, Translator], same_dash: bool = False) -> Any:
    """What stands after a dash or a key at that indent: on the line, or as the block below."""
    tag, rest = _split_tag(text)
    if rest:
        if rest[0] in "[{\"'":
            # a flow collection or a quoted scalar may go on over lines
            while True:
                try:
                    value, at = _flow(rest, 0, by_tag)
                    break
                except EOFError:
                    if lines.at >= len(lines.rows):
                        raise YamlError(f"no end: {rest[:60]}") from None
                    rest += " " + lines.peek()[1]
                    lines.at += 1
            if rest[at:].strip():
                raise YamlError(f"not understood: {rest[at:][:60]}")
            return _tagged(tag, value, by_tag)
        if rest in ("|", "|-", ">", ">-"):
            parts = []
            while lines.peek()[0] > indent:
                parts.append(lines.peek()[1])
                lines.at += 1
            return _tagged(tag, ("\n" if rest[0] == "|" else " ").join(parts) + ("" if rest.endswith("-") else "\n"), by_tag)
        return _tagged(tag, _plain(rest), by_tag)
    below, start = lines.peek()
    if below > indent or (same_dash and below == indent and (start == "-" or start.startswith("- "))):
        return _tagged(tag, _node(lines, below, by_tag), by_tag)
    return _tagged(tag, None, by_tag)


def _sequence(lines: _Lines, indent: int, by_tag: dict[str, Translator]) -> list:
    out = []
    while lines.peek()[0] == indent and (lines.peek()[1] == "-" or lines.peek()[1].startswith("- ")):
        text = lines.peek()[1][1:]
        inner = text.strip()
        _, rest = _split_tag(inner)
        if (rest == inner and _KEY.match(inner)) or inner.startswith("- "):
            # a collection that begins on the line of its dash: as if it began below, at its own column
            lines.rows[lines.at] = (indent + 1 + len(text) - len(text.lstrip(" ")), inner)
            out.append(_node(lines, indent + 1, by_tag))
        else:
            lines.at += 1
            out.append(_value(lines, inner, indent, by_tag))
    return out


def _mapping(lines: _Lines, indent: int, by_tag: dict[str, Translator]) -> dict:
    out = {}
    while lines.peek()[0] == indent:
        text = lines.peek()[1]
        m = _KEY.match(text)
        if not m:
            raise YamlError(f"no key: {text[:60]}")
        key = _flow(m[1], 0, by_tag)[0] if m[1][0] in "\"'" else _plain(m[1])
        if key in out:
            raise YamlError(f"a key stands twice: {key}")
        lines.at += 1
        out[key] = _value(lines, text[m.end() :].strip(), indent, by_tag, True)
    return out


def _plain(text: str) -> Any:
    low = text.lower()
    if low in _WORDS:
        return _WORDS[low]
    if low in _SPECIAL:
        return _SPECIAL[low]
    if _INT.fullmatch(text):
        return int(text)
    return float(text) if _FLOAT.fullmatch(text) else text


def _flow(text: str, at: int, by_tag: dict[str, Translator]) -> tuple[Any, int]:
    """A flow node and where it ends; EOFError where the text ends first."""
    at = _skip(text, at)
    tag = ""
    if text[at] == "!":
        tag = re.match(r"![^\s,\]}]*", text[at:])[0]
        at = _skip(text, at + len(tag))
    c = text[at]
    if c == '"':
        m = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL).match(text, at)
        if not m:
            raise EOFError
        try:
            return _tagged(tag, json.loads(m[0], strict=False), by_tag), m.end()
        except json.JSONDecodeError as e:
            raise YamlError(f"bad escape: {m[0][:60]}") from e
    if c == "'":
        m = re.compile(r"'((?:[^']|'')*)'").match(text, at)
        if not m:
            raise EOFError
        return _tagged(tag, m[1].replace("''", "'"), by_tag), m.end()
    if c == "[":
        out, at = [], _skip(text, at + 1)
        while text[at] != "]":
            value, at = _flow(text, at, by_tag)
            out.append(value)
            at = _skip(text, at)
            if text[at] == ",":
                at = _skip(text, at + 1)
            elif text[at] != "]":
                raise YamlError(f"no comma: {text[at:][:60]}")
        return _tagged(tag, out, by_tag), at + 1
    if c == "{":
        found, at = {}, _skip(text, at + 1)
        while text[at] != "}":
            key, at = _flow(text, at, by_tag)
            at = _skip(text, at)
            if text[at] != ":":
                raise YamlError(f"no colon: {text[at:][:60]}")
            found[key], at = _flow(text, at + 1, by_tag)
            at = _skip(text, at)
            if text[at] == ",":
                at = _skip(text, at + 1)
            elif text[at] != "}":
                raise YamlError(f"no comma: {text[at:][:60]}")
        return _tagged(tag, found, by_tag), at + 1
    m = re.compile(r"(?:[^,\[\]{}:]|:(?!\s|$))*").match(text, at)
    return _tagged(tag, _plain(m[0].strip()), by_tag), m.end()


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text):
        raise EOFError
    return at
