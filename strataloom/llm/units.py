"""Lines of a chunk on which a unit starts: definitions of listed symbols in code, headings in Markdown."""

from __future__ import annotations

import re

NAME = r"[A-Za-z_$][\w$]*"
MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|readonly|override|export|default|declare|synchronized|native|partial|open|get|set)\s+)*"
FAMILY = {"py": "py", "pyi": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "vue": "js", "go": "go", "java": "java", "kt": "java", "cs": "java", "php": "php"}
LANGUAGE = {"python": "py", "javascript": "js", "typescript": "js", "go": "go", "java": "java", "php": "php"}
#: Words before a bracket that name no method.
NOT_NAMES = frozenset("if for while switch catch return function await new throw else do try with typeof super foreach synchronized".split())

_CLASS = {
    "py": re.compile(rf"\s*class\s+({NAME})"),
    "js": re.compile(rf"\s*{MODS}(?:class|interface|namespace|enum|const\s+enum|type(?=\s+{NAME}\s*[=<]))\s+({NAME})"),
    "go": re.compile(rf"(?:type\s+|\t)({NAME})(?:\[[^\]]*\])?\s+=?\s*(?:struct|interface|func|map|\[\]|\*|{NAME})"),
    "java": re.compile(rf"\s*(?:@{NAME}(?:\([^)]*\))?\s+)*{MODS}(?:class|interface|@interface|enum|record|object|struct)\s+({NAME})"),
    "php": re.compile(rf"\s*{MODS}(?:class|interface|trait|enum)\s+({NAME})"),
}
_FUNC = {
    "py": re.compile(rf"\s*(?:async\s+)?def\s+({NAME})"),
    "js": re.compile(rf"\s*{MODS}function\b\s*\*?\s*({NAME})|\s*{MODS}(?:const|let|var)\s+({NAME})\s*(?::[^=]*)?=(?!=)"),
    "go": re.compile(rf"func\s+(?:\(\s*(?:{NAME}\s+)?\*?({NAME})[^)]*\)\s*)?({NAME})\s*[(\[]|(?:var|const)\s+({NAME})\b"),
    "java": re.compile(rf"\s*(?:@{NAME}(?:\([^)]*\))?\s+)*{MODS}(?:<[^>]+>\s+)?(?:[\w$.]+(?:<.*?>)?(?:\[\])*\??\s+)({NAME})\s*\("),
    "php": re.compile(rf"\s*{MODS}function\s+&?\s*({NAME})\s*\(|\s*{MODS}const\s+({NAME})\s*="),
}
_MEMBER = {
    "js": re.compile(rf"\s+{MODS}\*?\s*#?({NAME})\s*(?:<[^>]*>)?\s*(?:\((?!.*;\s*$)|[?!]?\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\(|{NAME}\s*=>))"),
    "py": re.compile(rf"\s+({NAME})\s*(?::[^=]+)?=\s*(?:lambda\b|property\()"),
}
_PY_CONST = re.compile(rf"({NAME})\s*(?::[^=]+)?=(?!=)")
_COMMENT = {"py": ("#",), "js": ("//", "*"), "go": ("//",), "java": ("//", "*"), "php": ("//", "#", "*")}


def family(path: str | None, language: str | None) -> str | None:
    ext = (path or "").split("#")[0].rsplit(".", 1)[-1].lower()
    return FAMILY.get(ext) or LANGUAGE.get((language or "").strip().lower())


def body_line(lines: list[str]) -> int:
    """The index of the first line after the header lines and their empty line; 0 without a header."""
    for i, x in enumerate(lines[:12]):
        if not x.strip():
            return i + 1
        if not re.match(r"[A-Z][A-Za-z]+: |\S+:$|Imports of ", x):
            return 0
    return 0


def definitions(lines: list[str], first: int, symbols: list[str], fam: str | None) -> dict[int, str]:
    """Line index -> listed symbol that is defined there."""
    listed = {s.strip() for s in symbols if s and s.strip()}
    last = {s.rsplit(".", 1)[-1] for s in listed}
    fams = [fam] if fam else list(_CLASS)
    out: dict[int, str] = {}
    headers: set[str] = set()
    stack: list[tuple[int, str, bool]] = []  # indent, name, is a class
    quote, block = "", False
    comments = tuple({c for f in fams for c in _COMMENT[f]})
    for i in range(first, len(lines)):
        line = lines[i].rstrip("\r")
        text = line.strip()
        if not text:
            continue
        if quote:  # inside a string of several lines
            if text.count(quote) % 2:
                quote = ""
            continue
        if block:
            block = "*/" not in text
            continue
        if "py" in fams:
            opened = [q for q in ('"""', "'''") if text.count(q) % 2]
            if opened:
                quote = opened[0]
                if not re.match(r"(?:async\s+)?(?:def|class)\b", text):
                    continue
        if fams != ["py"] and text.startswith("/*"):
            block = "*/" not in text
            continue
        if text.startswith(comments):
            continue
        indent = len(line) - len(line.lstrip())
        closer = text[0] in ")]}"
        if not closer or text[0] == "}":
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent):
                stack.pop()
        if closer:
            continue
        for f in fams:
            if m := _CLASS[f].match(line):
                name = m[1]
                if name in last and _is_listed(name, None, stack, listed, headers, True, indent):
                    out.setdefault(i, name)
                headers.add(name)
                stack.append((indent, name, True))
                break
            inside = stack[-1] if stack else None
            m, loose = _FUNC[f].match(line), f == "java"  # loose: no word of the language says that it is a definition
            if m is None and f in _MEMBER and indent and (inside is None or inside[2]):
                m, loose = _MEMBER[f].match(line), True
            if m is None and f == "py" and not indent:
                m = _PY_CONST.match(line)
            if m is None:
                continue
            owner = m[1] if f == "go" and m[2] else None
            name = (m[2] or (m[3] if m.lastindex and m.lastindex >= 3 else None)) if f == "go" else next(g for g in m.groups() if g)
            if not name or loose and name in NOT_NAMES or (f == "java" and re.match(r"\s*(?:return|new|throw|else|case|await|yield)\b", line)):
                continue
            if name in last and (full := _is_listed(name, owner, stack, listed, headers, False, indent)):
                out.setdefault(i, full)
            stack.append((indent, name, False))
            break
    return out


def _is_listed(name: str, owner: str | None, stack: list, listed: set[str], headers: set[str], is_class: bool, indent: int) -> str | None:
    """The listed symbol that a definition of `name` at this place is, if any."""
    if owner:
        return f"{owner}.{name}" if f"{owner}.{name}" in listed else None
    inside = stack[-1] if stack else None
    if inside is None:
        if name in listed and (not indent or is_class):
            return name
        if indent:  # a member of something whose header lies before the chunk
            for s in listed:
                x, _, y = s.rpartition(".")
                if y == name and x and x.rsplit(".", 1)[-1] not in headers:
                    return s
        return None
    if inside[2]:
        for s in listed:
            x, _, y = s.rpartition(".")
            if y == name and x.rsplit(".", 1)[-1] == inside[1]:
                return s
        if is_class and name in listed:
            return name
    return None


_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_NO_PARAGRAPH = re.compile(r" {0,3}(?:>|[-*+][ \t]|\d{1,9}[.)][ \t]|(?:[-*_][ \t]*){3,}$)| {4}|\t|\|")


def headings(lines: list[str], first: int) -> list[int]:
    """Indexes of Markdown headings outside fenced blocks; of underlined ones, the line with the words."""
    out, fence, comment = [], "", False
    for i in range(first, len(lines)):
        line = lines[i].rstrip("\r")
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if comment:
            comment = "-->" not in line
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif line.lstrip().startswith("<!--"):
            comment = "-->" not in line
        elif _ATX.match(line):
            out.append(i)
        elif _SETEXT.match(line) and i > first:
            above = lines[i - 1].rstrip("\r")
            if above.strip() and not _ATX.match(above) and not _NO_PARAGRAPH.match(above) and not _SETEXT.match(above) and not _FENCE.match(above):
                out.append(i - 1)
    return sorted(set(out))


def unit_lines(text: str, kind: str | None, symbols: list[str], path: str | None, language: str | None) -> dict[int, str]:
    """Line index (from 0) -> symbol ('' for a heading or the first line)."""
    lines = text.split("\n")
    out = {0: ""}
    first = body_line(lines)
    if kind == "code":
        out |= definitions(lines, first, symbols, family(path, language))
    elif kind in ("doc_full", "doc_summary", "repo_doc"):
        out |= {i: "" for i in headings(lines, first)}
    return out
