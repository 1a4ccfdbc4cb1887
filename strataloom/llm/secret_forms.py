"""Where a text may hold a credential: the forms in which a value is written, and what its key and shape say."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

#: Words for a password, and words that with "key" name a credential.
PASSWORD_WORDS = "pass password passwd passphrase passcode pwd pw pswd kennwort passwort contrasena contraseña clave senha mdp parola wachtwoord heslo haslo lozinka salasana".split()
TOKEN_WORDS = "secret secrets token tokens jwt assertion cred credential credentials creds authorization auth bearer apikey".split()
KEY_OF = "api access account service licence license signing encryption private shared secret master client webhook storage app deploy ssh auth hmac crypto token admin root db fallback".split()
#: A last word that makes a credential's name that of something about it.
ABOUT = frozenset(
    "name header ttl url uri path file filename dir id ids type length len size count policy hint field label prefix suffix format expiry expires expiration timeout algorithm alg enabled "
    "required regex pattern class provider service manager reader store env var ref prompt placeholder min max age version hash digest fingerprint checksum column param parameter attempts "
    "limit rotation days hours seconds endpoint host port scope scopes issuer audience kind status state index section mode source option page template message error test public".split()
)
#: Prefixes of tokens that public services give out.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[srp]k_live_[A-Za-z0-9]{10,}|SG\.[\w-]{10,}\.[\w-]{16,}|xox[abeprs]-[\w-]{10,}|hf_[A-Za-z0-9]{16,}"
    r"|npm_[A-Za-z0-9]{16,}|AIza[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{6,}\.[\w-]{8,}|pypi-[\w-]{16,}|dop_v1_[a-f0-9]{20,}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|ya29\.[\w-]{20,})"
)
PREFIX = re.compile(r"(?:A(?:KI|SI)A|gh[pousr]_|github_pat_|glpat-|[srp]k_live_|SG\.|xox[abeprs]-|hf_|npm_|AIza|eyJ[\w-]+\.|pypi-|dop_v1_|shp(?:at|ca|pa|ss)_|ya29\.)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----.*?(?:-----END \1-----|(?=-----BEGIN )|\Z)", re.S)
_BODY = re.compile(r"(?:\\[nr]|[\s\"'+,;:#/*.|>\-`()\\])*[A-Za-z0-9+/=]{24,}")
_BODY_PIECE = re.compile(r"[A-Za-z0-9+/=]{8,}")

#: A line is looked at if a letter stands next to a digit, with no more than marks between, as in every value that could be one under any name (see _worth), or if a word is in
#: it that names, announces or introduces a credential.
_DIGIT = re.compile(r"[^\W\d_](?:_|[^\w\s\"'`(){}\[\]<>,])*+\d|\d(?:_|[^\w\s\"'`(){}\[\]<>,])*+[^\W\d_]")
_HINTS = ("pass", "pw", "secret", "token", "kennwort", "contrase", "mot_de", "motde", "mot de", "clave", "senha", "mdp", "parola", "wachtwoord", "heslo", "haslo", "lozinka", "salasana", "mysql", "mariadb", "redis-cli", "curl ", "-----begin", "auth", "://", "key", "cred", "login", "jwt", "assertion", "value")
_HINTED = re.compile(r"(?i)pass|pw|secret|token|kennwort|contrase|mot[_ ]?de|clave|senha|mdp|parola|wachtwoord|heslo|haslo|lozinka|salasana|jwt|assertion|mysql|mariadb|redis-cli|curl\s|-----begin|auth|\bvalue[\"']?\s*[:=]|://[^\s/:@]*:[^\s/@]+@|(?:" + "|".join(KEY_OF) + r")[_\-. ]?key|key[\"'`\]]*\s*(?:[:=]|,\s*[\"'`])|cred|login")


def _hot_lines(text: str) -> list[int]:
    """Where the lines begin that may hold a candidate."""
    starts: set[int] = set()
    rfind, find = text.rfind, text.find
    done = -1
    for m in _DIGIT.finditer(text):
        if m.start() >= done:
            starts.add(rfind("\n", 0, m.start()) + 1)
            done = find("\n", m.start())
            if done < 0:
                break
    low = text.lower()
    if len(low) != len(text):
        return [m.start() for m in re.finditer(r"(?m)^.+$", text)]
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            start, end = rfind("\n", 0, at) + 1, find("\n", at)
            end = len(text) if end < 0 else end
            if start not in starts and _HINTED.search(text, start, end):
                starts.add(start)
            at = low.find(hint, end)
    return sorted(starts)


# Patterns begin at the start of a run of name characters and don't give back what only one reading allows, so that a long line takes linear time.
_Q = r"(?:\"((?:[^\"\\\n]++|\\.)*+)\"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)"
_KEY = r"([A-Za-z_$À-ɏ][\w$.\-À-ɏ]*+)"
_NAMED = rf"(?<![\w$.\-À-ɏ])(?:(?![A-Za-z_$À-ɏ])[\w$.\-])*+{_KEY}[\"'`]?\s*+(?:\]\s*+)?"
ASSIGN = re.compile(
    rf"{_NAMED}(?:(?::\s*[A-Za-z][\w.\[\]<>]*\s*=(?!=)|:=|=>|=|:)|(?<=[\"'`]),(?=\s*[\"'`]))\s*(?:\(\s*)?(?:[fbruFBRU]{{1,2}}(?=[\"'`]))?(?:{_Q}|([^\s\"'`(){{}}\[\]<>,][^\s\"'`(){{}}<>,]*)(?=\s*(?:$|\r|;|,|\}}|\"|'|`)|\s+(?:#|//)))",
    re.M,
)
_NAME = re.compile(rf"{_NAMED}(?=[:=,])")
_SIMPLE = re.compile(r"(?:=>|:=|[=:,])\s*+(?:\(\s*+)?")
_TYPED = re.compile(r":\s*+[A-Za-z][\w.\[\]<>]*+\s*+=(?!=)\s*+")
_RUN = re.compile(r"[^\s\"'`(){}\[\]<>,][^\s\"'`(){}<>,]*+")
TAG = re.compile(rf"(?:key|name|Name|Key)\s*[=:]\s*\"{_KEY}\"\s*+(?:,\s*+)?\"?(?:value|Value)\"?\s*[=:]\s*\"([^\"\n]*)\"|<{_KEY}>([^<>\s]{{4,}})</")
URL = re.compile(r"(?<![A-Za-z0-9+.\-])[0-9+.\-]*+[A-Za-z][A-Za-z0-9+.\-]*+://([^\s/:@'\"`<>]*):([^\s/@'\"`]+)@(?=[\w\[.\-$%{])")
CONN = re.compile(r"(?i)(?<![\w.])((?:password|pwd|accountkey|sharedaccesskey|secret))\s*=\s*([^;\"'`\s]+)")
HEADER = re.compile(r"\b(Bearer|Token|Basic|ApiKey|Api-Key)\s+([A-Za-z0-9._~+/=\-]{8,})")
#: A command and the flag before its password.
_COMMANDS = (
    (r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b", r"\s-p([^\s\"'`]{4,})"), (r"\bredis-cli\b", r"\s-a\s+[\"']?([^\s\"'`]{4,})"), (r"\b(?:curl|wget|http)\b", r"\s(?:-u|--user)[ =]?[\"']?[^\s:\"'`]+:([^\s\"'`]{4,})"),
    (r"\bsshpass\b", r"\s-p\s*[\"']?([^\s\"'`]{4,})"), (r"\bldap\w+\b", r"\s-w\s+([^\s\"'`]{4,})"), (r"\bdocker\s+login\b", r"\s-p\s+([^\s\"'`]{4,})"),
)
_FLAG = r"--(?:password|passwd|pass|token|secret|api-key|auth-token|access-token|client-secret)[ =][\"']?([^\s\"'`\-][^\s\"'`]{3,})|\bpass:([^\s\"'`]{4,})"
CLI = re.compile("|".join([*(rf"{c}[^\n|;]*?{f}" for c, f in _COMMANDS[:4]), _FLAG, *(rf"{c}[^\n|;]*?{f}" for c, f in _COMMANDS[4:])]))
_APART = [(re.compile(c), re.compile(f)) for c, f in _COMMANDS]
_ALONE = re.compile(_FLAG)
NETRC = re.compile(r"\blogin\s+\S+\s+password\s+([^\s\"'`]+)")
_WORDS_RE = "|".join(sorted([*PASSWORD_WORDS, "mot de passe", "secret", "token", "key"], key=len, reverse=True))
PROSE = re.compile(rf"(?i)\b({_WORDS_RE})\b\s*(?:was|is|are|war|ist|es|est|:|->|—)\s*[\"'`]?([^\s\"'`,()]{{6,}})")
_ANY_WORD = re.compile(rf"(?i)\b({_WORDS_RE})\b")
#: A word and, within 60 characters of prose, a run of letters and digits.
NEARBY = re.compile(rf"(?i)\b({_WORDS_RE})\b[^\n\"'`=<>()\[\]{{}}]{{0,60}}?(?<![^\s\"'`:])[\"'`]?((?=[^\s]*\d)(?=[^\s]*[a-z])[A-Za-z0-9_\-+/=.]{{16,}})")
#: A name and a value given as a pair.
LOGIN = re.compile(r"(?i)\b(login|user|account|credentials?)\s+\S+\s*(?:/|:|with)\s*[\"'`]?([^\s\"'`,()]{6,})")
ENV = re.compile(r"(?<![\w$.])([A-Z][A-Z0-9_]{2,})=([^\s\"'`$]{4,})[ \t]+(?=[a-z])")
_LAST = re.compile(r"(?<![^\s\"'`$])[^\s\"'`$]++[ \t]++(?=[a-z])")
_PIECE = re.compile(rf"\s*(?:[+.&|]{{1,2}}|\\)?[ \t]*(?:\n[ \t]*(?:[#/;*]+[ \t]*)?)?(?:[+.&]{{1,2}})?\s*{_Q}")
_GLUE = re.compile(r"[+.&]|\n")
_NAME_LINE = re.compile(rf"^\s*[#;/*]*\s*(?:-\s+)?[\"']?(?:name|key)[\"']?\s*:\s*[\"']?{_KEY}[\"']?\s*,?\s*$")
_CAMEL = re.compile(r"[A-ZÀ-Þ]?[a-zà-ɏ]+|[A-ZÀ-Þ]+(?![a-zà-ɏ])|\d+")


class Candidate(NamedTuple):
    line: int  # from 1
    form: str
    key: str
    value: str
    spans: tuple[tuple[int, int], ...]
    comment: bool


def key_words(key: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(key)]




def _worth(v: str, key: str) -> bool:
    """A value that could be a credential: under a name that names one any of 4 characters, under another one of 6 with a letter next to a digit."""
    if len(v) < 4 or " " in v or "\t" in v:
        return False
    return names_credential(key) or len(v) >= 6 and bool(_DIGIT.search(v))


def names_credential(key: str) -> bool:
    ws = key_words(key.rsplit(".", 1)[-1] if "." in key else key)
    return _names(ws)


def _names(ws: list[str]) -> bool:
    for i, w in enumerate(ws):
        if w in _PW or w in _TK or w.endswith(_ENDS):
            return True
        if w == "key" and i and ws[i - 1] in _KO:
            return True
        if w == "passe" and i:
            return True
    return False


_ENDS = ("password", "passwd", "passphrase", "passwort", "kennwort", "secret", "apikey")
_PW, _TK, _KO = frozenset(PASSWORD_WORDS), frozenset(TOKEN_WORDS), frozenset(KEY_OF)


#: Lines over this length are searched by the functions below, which find the same in linear time.
LONG = 600
#: On such a line a bare value is named by a word of its key or by one at most so many characters before it, as far as on a shorter line.
NEAR = 600


def _assigns(text: str, start: int, end: int) -> Iterator[re.Match]:
    """The matches of ASSIGN within a line."""
    if end - start <= LONG:
        yield from ASSIGN.finditer(text, start, end)
        return
    at, dead = start, -1  # no bare value begins before `dead`: one that began earlier ran up to there and had no good end
    for k in _NAME.finditer(text, start, end):
        if k.start() < at:
            continue
        s = _SIMPLE.match(text, k.end(), end)
        if s.end() < dead and not ((t := _TYPED.match(text, k.end(), end)) and t.end() >= dead):
            continue
        if u := ASSIGN.match(text, k.start(), end):
            at = u.end()
            yield u
        elif r := _RUN.match(text, s.end(), end):
            dead = max(dead, r.end())


def _commands(line: str) -> Iterator[tuple[str, int, int]]:
    """(first word, start and end of the value) of the matches of CLI."""
    if len(line) <= LONG:
        for u in CLI.finditer(line):
            k = next(i for i, g in enumerate(u.groups(), 1) if g)
            yield u[0].split()[0], u.start(k), u.end(k)
        return
    for u in _ALONE.finditer(line):
        k = 1 if u[1] else 2
        yield u[0].split()[0], u.start(k), u.end(k)
    stops: list[int] | None = None
    for command, flag in _APART:
        heads = [(m.start(), m.end(), m[0].split()[0]) for m in command.finditer(line)]
        if not heads:
            continue
        if stops is None:
            stops = [m.start() for m in re.finditer("[|;]", line)]
        at = 0
        for f in flag.finditer(line):
            n = bisect_left(stops, f.start())
            h = bisect_left(heads, (max(at, stops[n - 1] if n else 0),))
            if h < len(heads) and heads[h][1] <= f.start():
                yield heads[h][2], f.start(1), f.end(1)
                at = f.end()


def _env(line: str) -> Iterator[re.Match]:
    """The matches of ENV: its value is the end of a run of characters before a blank."""
    if len(line) <= LONG:
        yield from ENV.finditer(line)
        return
    for r in _LAST.finditer(line):
        if u := ENV.search(line, r.start(), r.end() + 1):
            yield u


def candidates(text: str) -> list[Candidate]:
    """All values of a text that are written where or as a credential may be, one for each value."""
    found: dict[int, Candidate] = {}
    breaks: list[int] | None = None

    def add(at: int, form: str, key: str, value: str, spans: tuple, comment: bool) -> None:
        nonlocal breaks
        if spans[0][0] in found:
            return
        if any((i := bisect_left(taken, (y,))) and taken[i - 1][1] > x for x, y in spans):
            return
        if breaks is None:
            breaks = [m.start() for m in re.finditer("\n", text)]
        found[spans[0][0]] = Candidate(bisect_right(breaks, at - 1) + 1 if at else 1, form, key, value, spans, comment)
        for s in spans:
            insort(taken, s)

    taken: list[tuple[int, int]] = []  # sorted, without overlaps
    blocks: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in BLOCK.finditer(text):
            end = m.end()
            if PEM.match(text, m.start()) and (b := _BODY.match(text, m.start() + len(m[1]) + 16)):
                if not m[0].endswith("-----"):  # without an end: as far as the body goes
                    end = b.end()
                    while (n := _BODY.match(text, end)) and n.start() == end:
                        end = n.end()
                body = tuple((x.start(), x.end()) for x in _BODY_PIECE.finditer(text, m.start() + len(m[1]) + 16, end - (len(m[1]) + 14 if m[0].endswith("-----") else 0)))
                if body:
                    line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                    if breaks is None:
                        breaks = [x.start() for x in re.finditer("\n", text)]
                    found[m.start()] = Candidate(bisect_right(breaks, m.start() - 1) + 1 if m.start() else 1, "pem", m[1], text[body[0][0] : body[0][1]], body, bool(re.match(r"\s*(?:#|//|;|\*|--)", line)))
            if m[0].endswith("-----") or PEM.match(text, m.start()):
                blocks.append((m.start(), end))
        taken.extend(blocks)
    for start in _hot_lines(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        if blocks and any(b[0] < start < b[1] for b in blocks):
            continue
        line = text[start:end]
        comment = bool(re.match(r"\s*(?:#|//|;|\*|--|/\*|<!--)", line))
        for u in URL.finditer(line):
            add(start, "url", u[1], u[2], ((start + u.start(2), start + u.end(2)),), comment)
        if "=" in line and ";" in line:
            for u in CONN.finditer(line):
                add(start, "conn", u[1], u[2], ((start + u.start(2), start + u.end(2)),), comment)
        for u in HEADER.finditer(line):
            if any(c.isdigit() for c in u[2]) or u[1] == "Basic" and ":" in (decoded(u[2]) or ""):
                add(start, "header", u[1], u[2], ((start + u.start(2), start + u.end(2)),), comment)
        if "-" in line or "pass:" in line:
            for word, a, b in _commands(line):
                add(start, "cli", word, line[a:b], ((start + a, start + b),), comment)
        if "login" in line:
            for u in NETRC.finditer(line):
                add(start, "netrc", "password", u[1], ((start + u.start(1), start + u.end(1)),), comment)
        for u in TAG.finditer(line):
            k = 2 if u[1] else 4
            if u[k] and _worth(u[k], u[k - 1]):
                add(start, "tag", u[k - 1], u[k], ((start + u.start(k), start + u.end(k)),), comment)
        for u in _env(line):
            if _worth(u[2], u[1]):
                add(start, "cli", u[1], u[2], ((start + u.start(2), start + u.end(2)),), comment)
        words: list[re.Match] | None = None if len(line) > LONG else []
        for u in _assigns(text, start, end):
            k = next((i for i in (2, 3, 4, 5) if u[i] is not None), 5)
            value, key = u[k], u[1]
            spans = [(u.start(k), u.end(k))]
            form = "bare" if k == 5 else "quoted"
            if k != 5 and value:  # pieces that are put together
                at = u.end()
                while (p := _PIECE.match(text, at)) and _GLUE.search(text, at, p.start(p.lastindex) - 1):
                    if "\n" in text[at : p.start(p.lastindex)] and not re.search(r"[+.&]", text[at : p.start(p.lastindex)]) and "(" not in u[0]:
                        break
                    value += p[p.lastindex]
                    spans.append((p.start(p.lastindex), p.end(p.lastindex)))
                    at = p.end()
                if len(spans) > 1:
                    form = "pieces"
            if key in ("value", "Value", "val"):
                prev = text[text.rfind("\n", 0, max(0, start - 1)) + 1 : max(0, start - 1)]
                if n := _NAME_LINE.match(prev):
                    key, form = n[1], "named"
            value = value.rstrip("\r")
            if k == 5 and not names_credential(key):  # a word before the value may say what it is
                if words is None:
                    words = list(_ANY_WORD.finditer(text, start, end))
                if end - start <= LONG:
                    n = _ANY_WORD.search(text, start, u.start(1))
                else:
                    i = bisect_left(words, u.start(1) - NEAR, key=lambda m: m.start())
                    n = words[i] if i < len(words) and words[i].end() <= u.start(1) else None
                if n:
                    key, form = n[1], "prose"
            if k == 5:
                value = value.rstrip(",;")
                spans = [(spans[0][0], spans[0][0] + len(value))]
            if value and _worth(value, key):
                add(start, form, key, value, tuple(spans), comment)
        for u in KNOWN.finditer(line):
            add(start, "known", "", u[0], ((start + u.start(), start + u.end()),), comment)
        for pattern in (PROSE, NEARBY, LOGIN):
            for u in pattern.finditer(line):
                v = u[2].rstrip(".;:)!?" if not re.search(r"\d!$", u[2]) else ".;:)")
                if (_worth(v, "") or _worth(v, "password") and not wordy(v)) and any(c.isalpha() for c in v):
                    add(start, "prose", u[1], v, ((start + u.start(2), start + u.start(2) + len(v)),), comment)
    return [found[k] for k in sorted(found)]


PLACEHOLDER = re.compile(
    r"(?i)^[\W_]*$|^(?:x{3,}|\*{2,}|\.{3,}|-{3,}|_{3,})|[*x•]{5,}|^<.*>$|^\[.*\]$|^\{\{?.*\}?\}$|^(?:null|none|nil|undefined|true|false|todo|tbd|fixme|redacted|masked|hidden|empty|unset|changeme|change[-_]?me|change[-_]this|password|passwd|secret|token|"
    r"example|sample|default|dummy|test|foo|bar)$|changeme|change[-_ ]me|replace[-_ ]?(?:me|with|this)|placeholder|^your[-_]|[-_]here$|^(?:dummy|example|sample|fake|mock|insert|enter|put|some|my|the)[-_]|^not[-_]?(?:a[-_]?)?(?:real|set)|redacted|^%[\w]+%$|^0+$|^(.)\1{5,}$"
)
REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|\{[a-z_]+\}|^\$[a-z_]|^%\(|<[a-z_ -]+>|\b(?:os\.)?(?:environ|getenv|env)\b[.\[(]|process\.env|^(?:vault|arn|op|ssm|secretsmanager|keyring|kms|gcp|aws|azure|akv|sops|env|file|ref|secret|keychain|pass)[:/]|!(?:vault|ref|sub)|^@|config\.get|\bENC\["
)
HASHY = frozenset("sha sha1 sha256 sha384 sha512 sha3 md5 digest checksum integrity etag commit rev revision hash fingerprint crc sum signature sig blake2 ref sri".split())
UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$")
PATHLIKE = re.compile(r"^(?:\.{0,2}/)?[\w.@-]+(?:/[\w.@-]+)+/?$|^/[\w./-]*$|^[A-Za-z]:\\")
URLLIKE = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://|^www\.|^mailto:|^data:")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]{16,}$")
IDENT = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*$")


_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^A-Za-z]+")


def wordy(v: str) -> bool:
    """In one letter case, or made of words as identifiers are; not so are random letters of mixed case."""
    if v.islower() or v.isupper():
        return True
    return all(len(x) > 2 for x in _PIECES.findall(v) if x.isalpha())


def decoded(v: str) -> str | None:
    """The printable text that a base64 or hex value stands for."""
    for f in (lambda: base64.b64decode(v + "=" * (-len(v) % 4), validate=True), lambda: binascii.unhexlify(v)):
        try:
            s = f().decode("ascii")
        except (ValueError, binascii.Error):
            continue
        if len(s) >= 6 and s.isprintable():
            return s
    return None
