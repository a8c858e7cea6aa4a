"""Credentials in transcript messages: finding them, and redacting them without harm to what surrounds them.

A text is scanned with context rules (names, headers, command lines, prose), token formats
and key blocks. Encoded literals (base64, hex, percent, escapes) are decoded
layer by layer and scanned again; decoded bytes are also parsed as key containers by
their binary grammar. What is found inside an encoded literal redacts the whole literal.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "[REDACTED]"

# --- Values that carry their own format.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{18,}"
    r"|sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9\-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{40,}|AIza[A-Za-z0-9_\-]{35}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")"
)
KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.{16,}?-----END \1-----", re.S)

# --- Names under which credentials stand.
_NAME = (
    r"(?:[A-Za-z0-9_.\-]*(?:passw(?:or)?d|passphrase|passwd|passcode|secret|token|api[_\-]?key|apikey|access[_\-]?key|private[_\-]?key|signing[_\-]?key|upload[_\-]?key|"
    r"encryption[_\-]?key|credential|authorization|auth)(?:[_\-]?(?:key|value|id))?|(?:[A-Za-z0-9]+[_\-])*(?:pass|pwd|pw|psk|key|auth)|pwd|pass|pw)"
)
_QUOTED = r"(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n])+?)(?P=q)"
_BARE = r"(?P<w>[^\s\"'`,;&<>()\[\]{}]+)"

#: name = value, name: value, "name": "value", name := value, name => value, name == "value", []byte("value")
ASSIGN = re.compile(rf"(?i)(?<![A-Za-z0-9_.\-$])(?P<n>{_NAME})[\"'`]?\]?[ \t]*(?::=|=>|===?|!=|=|:)[ \t]*(?:\[\]byte\(|[A-Za-z]+\()?(?:{_QUOTED}|(?P<w>[^\s\"'`<>(){{}}\[\]]+))")
ENV = re.compile(rf"(?im)^[ \t]*(?:ENV|ARG|setx?|setenv)[ \t]+(?P<n>{_NAME})[ \t]+(?:{_QUOTED}|(?P<w>\S+))")
FLAG = re.compile(rf"(?i)(?<!\S)--?(?P<n>{_NAME})[= \t]+(?:{_QUOTED}|(?P<w>[^\s\"'`]+))")
NETRC = re.compile(r"(?i)\blogin[ \t]+\S+[ \t]+password[ \t]+(?P<w>\S+)")
SSHPASS = re.compile(rf"(?i)\bsshpass[ \t]+-p[ \t]*(?:{_QUOTED}|(?P<w>\S+))")
MYSQL = re.compile(r"(?i)\b(?:mysql|mariadb)\w*\b[^\n|;]*?[ \t]-p(?:" + _QUOTED + r"|(?P<w>[^\s\"'`]+))")
CURL_USER = re.compile(r"(?i)(?<!\S)(?:-u|--user|--proxy-user)[ \t=]*[\"']?(?P<u>[^\s:\"']+):(?P<w>[^\s\"']+)")
URL_USER = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://(?:(?P<u>[^\s/:@\"'<>]*):)?(?P<w>[^\s/\"'<>]+)@(?=[A-Za-z0-9\[{$])")
QUERY = re.compile(r"(?i)[?&;](?P<n>[A-Za-z_\-]*(?:token|key|secret|password|passwd|pwd|sig|signature|auth))=(?P<w>[^\s&#\"'<>]+)")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?[ \t]*[:=][ \t]*[\"']?(?:bearer|basic|token|digest|apikey)[ \t]+(?P<w>[^\s\"'`,;]+)")
BEARER = re.compile(r"\b(?:Bearer|Basic)[ \t]+(?P<w>[A-Za-z0-9+/=_\-.~]{12,})")
XML = re.compile(rf"(?i)<(?P<n>{_NAME})(?:\s[^<>]*)?>(?P<w>[^<>\n]+)</(?P=n)>")
#: Words by which running text speaks of credentials or of getting in, and such by which it may.
CUE = re.compile(r"(?i)\b(?:pass(?:words?|phrases?|codes?|wd|keys?)?|pwd|secrets?|tokens?|keys?|pins?|psk|credentials?|wi-?fi|log(?:ged|ging|s)?[ \-]?(?:in|on)|sign(?:ed|ing|s)?[ \-]?in|auth\w*|unlock\w*|rotat\w+)\b")
WEAK_CUE = re.compile(r"(?i)\b(?:us(?:e|es|ed|ing)|re-?us(?:e|es|ed|ing)|headers?|accounts?|users?|admin|root|connect\w*|access\w*)\b")
#: What leads from the cue to the value.
LEADS = re.compile(r"(?i)(?:\b(?:is|was|are|were|be|became|stays|still|now|with|as|to|carries|contains|has|sends|holds)|[:/=])[ \t]+[\"'`(]?$")
#: Names with a value of their own: other rules judge those.
ASSIGNED = re.compile(r"[\w.\-]+[\"'`]?\]?[ \t]*(?::?=|=>|===?|!=)[ \t]*[\"'`]?$|(?:^|[{,])[ \t\-]*[\"'`]?[\w.\-]+[\"'`]?[ \t]*:[ \t]*[\"'`]?$")
SPOKEN = re.compile(r"(?<![^\s\"'`(])[^\s\"'`()<>]{8,}(?![^\s\"'`).,;:!?])")
OTHER_IDS = re.compile(r"(?i)\b(?:commits?|sha\d*|hash(?:es)?|digests?|checksums?|md5|etags?|revisions?|builds?|uuid|fingerprints?|versions?|releases?)\b")
_VERSIONED = re.compile(r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:-?\d{1,3}|-?v?\d+(?:\.\d+)+)$|^\d{4}-\d\d-\d\d|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)+\d{0,2}$|^(?:[A-Z][a-z]*-)+[A-Z][a-z]*\d{0,2}$")


def _random_like(v: str) -> bool:
    """Whether a word of running text is built like a generated or composed password: both cases with digits or signs among them, and no name, version, date or path."""
    if not plausible(v, False) or _VERSIONED.match(v) or CODE_VALUE.match(v) or "://" in v or "/" in v[:1] or v.count("/") > 1 or "@" in v[1:-1] and re.search(r"@[\w\-]+(?:\.[\w\-]+)+$", v):
        return False
    lower, upper, digit = (any(f(c) for c in v) for f in (str.islower, str.isupper, str.isdigit))
    sign = any(not c.isalnum() and c not in "-_./" for c in v)
    return lower and upper and (digit or sign) and entropy(v) >= 2.7


def _spoken(line: str) -> Iterator[tuple[int, int]]:
    """Values that a line of running text gives away: words built like a password, within a cue's reach; hexadecimal ones only where the text leads straight to them."""
    for m in SPOKEN.finditer(line):
        a, b = m.span()
        v = m.group()
        short = v.rstrip(".,;:!?") if not re.search(r"[^\w.,;:!?\-]", v[:-1]) else v.rstrip(",;:")
        b -= len(v) - len(short)
        before = line[max(0, a - 90) : a]
        cut = max(before.rfind(". "), before.rfind("; "), before.rfind("? "), before.rfind("! "))
        before = before[cut + 1 :]
        strong, weak = CUE.search(before), WEAK_CUE.search(before)
        if not (strong or weak) or ASSIGNED.search(before):
            continue
        if re.fullmatch(r"[0-9a-f]{24,}", short):
            if LEADS.search(before) and not OTHER_IDS.search(before) and plausible(short, False):
                yield a, b
        elif _random_like(short) and not (OTHER_IDS.search(before) and not strong):
            yield a, b
        elif LEADS.search(before) and (strong or short.isalpha()) and plausible(short, False) and (any(c.isdigit() for c in short) or sum(c.isupper() for c in short[1:]) >= 3) and not CODE_VALUE.match(short) and not _VERSIONED.match(short) and "://" not in short and "/" not in short[:1] and not re.fullmatch(r"[a-z]+(?:[_\-][a-z]+)*[_\-]?\d{1,3}", short):
            yield a, b


#: Lower-case pieces of text without which no rule can match, by the rules they may belong to.
TRIGGERS = {
    "name": "pass pwd secret token key auth pw psk credential sig",
    "format": "akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ rk_live_ xoxa- xoxb- xoxp- xoxr- xoxs- npm_ hf_ dop_v1_ aiza sg. eyj",
    "header": "bearer basic authorization",
    "url": "://",
    "command": "curl|mysql|mariadb|sshpass|-u |--user|--proxy-user",
    "prose": "wifi|wi-fi|log in|logged in|logging in|login|log-in|log on|sign in|signed in|signing in|sign-in|header|pin |pin:|pins|use |used |using |unlock|rotat|account|user|admin|root|connect|access",
}

PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.#_\-•?]+|<[^>]*>?|\[[^\]]*\]?|\{[^}]*\}?|\$.*|%[A-Za-z_]+%|@\{.*|\\?\$\(.*|.*(?:example|placeholder|changeme|change[_\-]me|your[_\-]|redacted|dummy|xxxx|\*\*\*\*|masked|insert[_\-]).*|"
    r"null|none|nil|true|false|undefined|string|str|bytes|int|number|bool(?:ean)?|any|object|optional|required|secret|password|token|key|value|test|todo|tbd|n/?a|empty|unset|set|hidden|yes|no|on|off)$"
)
CODE_VALUE = re.compile(r"(?i)^(?:os\.|process\.|env\.|config\.|settings\.|self\.|this\.|args\.|request\.|getenv|next\(|[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_.]*$|[a-z_][a-z0-9_]*\()")
HASH_PREFIX = re.compile(r"(?i)^(?:sha\d*[:\-]|md5[:\-]|ssh-|etag|urn:)")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


def _classes(s: str) -> int:
    return sum((any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s), any(not c.isalnum() for c in s)))


def plausible(value: str, named: bool) -> bool:
    """Whether a value may be a live credential: not a placeholder, a variable, code, a number or a plain word."""
    if len(value) < (6 if named else 8) or PLACEHOLDER.match(value) or "${" in value or "{{" in value or HASH_PREFIX.match(value) or UUID.match(value):
        return False
    if len(set(value)) < 5:
        return False
    if not named and value.isalpha():
        return _classes(value) >= 2 and any(c.isupper() for c in value[1:]) and entropy(value) >= 2.8
    if value.isalpha() and (value.islower() or value.isupper() or value.istitle()):
        return False
    if re.fullmatch(r"[\d.,:\-/]+", value):
        return False
    return _classes(value) >= 2


#: Names that hold numbers, kinds or identifiers rather than credentials, as _parted writes them: what makes a token or key harmless is a whole part of the name.
NOT_A_CREDENTIAL = re.compile(
    r"(?:^|_)(?:(?:max|min|num|total|count|n|input|output|prompt|completion|next|prev|page|public|ssh|primary|foreign|sort|partition|cache|hash|object|map|dict|index|idempotency|row|group|shuffle)_?)+(?:tokens?|keys?)$"
    r"|tokens$|keys$|keyword|tokeni[sz]er|author$|public_?key|key_?id$|token_?id$|secret_?name$|auth_?(?:method|type|mode|url|provider)$"
)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _parted(name: str) -> str:
    """The name in lower case with its parts, camelCase ones too, divided by underscores."""
    return re.sub(r"[_.\-]+", "_", _HUMP.sub("_", name)).lower()


#: Names whose quoted value may hold blanks.
STRONG_NAME = re.compile(r"passw|passphrase|passcode|passwd|pwd|secret")
#: Words of sentences about credentials, which stand under such names in forms and messages.
_SENTENCE = re.compile(r"(?i)\b(?:a|an|the|is|are|was|be|been|must|should|can(?:not)?|may|will|your|you|our|my|its?|this|that|these|for|from|with|without|please|enter|re-?enter|confirm|forgot|reset|change|new|old|current|invalid|incorrect|wrong|required|missing|and|or|not|no|to|of|in|on|by|at|least|characters?|if|when|used?|passwords?|secrets?|tokens?|keys?)\b")
WEAK_NAME = re.compile(r"(?i)^(?:key|auth|pass|pw)$")


def _named(m: re.Match, text: str) -> tuple[int, int] | None:
    groups = m.groupdict()
    name = groups.get("n") or "password"
    if m.re is ASSIGN and text[m.start() - 1 : m.start()] in ("?", "&") and m.start():
        return None  # a URL's query has its own rule
    parted = _parted(name)
    if NOT_A_CREDENTIAL.search(parted) and not parted.endswith("access_key_id"):
        return None
    group = "v" if groups.get("v") is not None else "w"
    value = m.group(group)
    a, b = m.span(group)
    if group == "w":
        if "n" in groups:
            b -= len(value) - len(value.rstrip(",;)"))
            value = value.rstrip(",;)")
        if CODE_VALUE.match(value) or "(" in value or text[b : b + 1] in ("(", "["):
            return None
    if " " in value and group == "v":
        return (a, b) if STRONG_NAME.search(parted) and _is_phrase(value) else None
    if value.lower() in ("bearer", "basic", "digest", "token"):
        return None
    if WEAK_NAME.match(name) and group == "w" and not (len(value) >= 12 and _classes(value) >= 2):
        return None
    if re.search(r"secret_?id$", parted) and UUID.match(value):
        return a, b  # an application role's second half is a UUID
    return (a, b) if plausible(value, True) else None


def _is_phrase(value: str) -> bool:
    """Whether a value with blanks may be a pass phrase: no sentence or template, and with a digit or of four words at least."""
    words = value.split()
    return plausible(value, True) and not _SENTENCE.search(value) and not re.search(r"[<>{}$%]", value) and (len(words) >= 4 or any(c.isdigit() for c in value)) and len(words) > 1


_automaton = None


def _triggered(text: str) -> dict[tuple[int, int], set[str]]:
    """The lines of a text that hold triggers, as (from, to), with their kinds."""
    global _automaton
    if _automaton is None:
        kinds: dict[str, set[str]] = {}
        for kind, words in TRIGGERS.items():
            for w in words.split("|") if "|" in words else words.split():
                kinds.setdefault(w, set()).add(kind)
        _automaton = ahocorasick.Automaton()
        for w, k in kinds.items():
            _automaton.add_word(w, k)
        _automaton.make_automaton()
    lines: dict[tuple[int, int], set[str]] = {}
    a = b = -1
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for at, kind in _automaton.iter(low):
        if not a <= at < b or b < 0:
            a = text.rfind("\n", 0, at) + 1
            b = text.find("\n", at)
            b = len(text) if b < 0 else b
        lines.setdefault((a, b), set()).update(kind)
    return lines


def _rules(line: str, kinds: set[str]) -> Iterator[re.Pattern]:
    """The rules that can match a line."""
    assigns = "=" in line or ":" in line
    if "name" in kinds:
        if assigns:
            yield ASSIGN
        if "-" in line:
            yield FLAG
        if "login" in line.lower():
            yield NETRC
        if "<" in line:
            yield XML
        if "=" in line and ("?" in line or "&" in line or ";" in line):
            yield QUERY
        yield ENV
    if "header" in kinds:
        yield HEADER
        yield BEARER
    if "url" in kinds and "@" in line:
        yield URL_USER
    if "command" in kinds:
        yield from (SSHPASS, MYSQL, CURL_USER)


def _scan_plain(text: str) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    lines = _triggered(text)
    if not lines:
        return spans
    if "-----BEGIN" in text:
        spans += [m.span() for m in KEY_BLOCK.finditer(text)]
    if "PuTTY-User-Key-File-" in text:
        spans += [m.span() for m in PUTTY.finditer(text)]
    for (a, b), kinds in lines.items():
        line = text[a:b]
        own: list[tuple[int, int]] = []
        if "format" in kinds:
            own += [m.span() for m in TOKEN.finditer(line) if not PLACEHOLDER.match(m.group()) and len(set(m.group()[4:])) >= 6]
        for rule in _rules(line, kinds):
            own += [s for m in rule.finditer(line) if (s := _named(m, line))]
        if "prose" in kinds or "name" in kinds:
            own += _spoken(line)
        spans += [(a + x, a + y) for x, y in own]
    return spans


# --- Encoded layers.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_\-=])(?:[A-Za-z0-9+/]{11,}|[A-Za-z0-9_\-]{11,})={0,2}(?![A-Za-z0-9+/_\-=])")
#: Lines of base64 as tools wrap them; the last may be of any length, or already be other text.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_\-=])(?P<full>(?:[A-Za-z0-9+/]{40,}[ \t]*\r?\n[ \t]*)*[A-Za-z0-9+/]{40,})[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]+={0,2}(?![A-Za-z0-9+/_\-=])")
HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{2}){16,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9A-F]{2}){16,}(?![A-Za-z0-9])")
PERCENT = re.compile(r"[^\s\"'<>]*(?:%[0-9A-Fa-f]{2}[^\s\"'<>%]*){2,}")
ESCAPED = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[nrt\"'\\/]|[^\s\\]){2,}")
_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\([nrt\"'\\/])")


def _readable(data: bytes) -> str | None:
    """Bytes as text: UTF-16 where it is marked or every second byte is null, else UTF-8; None if that isn't text."""
    wide = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-le" if len(data) > 3 and not any(data[1:64:2]) else "utf-16-be" if len(data) > 3 and not any(data[:64:2]) else "utf-8"
    try:
        text = data.decode(wide)
    except UnicodeDecodeError:
        return None
    printable = sum(c.isprintable() or c in "\r\n\t" for c in text)
    return text if text and printable >= 0.95 * len(text) else None


def _der(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, content from, to) of the DER element at a place."""
    if at + 2 > len(data):
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= len(data) else None


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n strings with four bytes of length each, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def _is_openssh(data: bytes) -> bool:
    """Magic, cipher, key derivation and its options, the number of keys, a public part for each, and the private part to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or not (head := _strings(data, len(magic), 3)):
        return False
    (cipher, kdf, _), at = head
    keys = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not kdf or not 1 <= keys <= 64 or not (rest := _strings(data, at + 4, keys + 1)):
        return False
    return bool(rest[0][-1]) and rest[1] == len(data)


PUTTY = re.compile(
    r"PuTTY-User-Key-File-[123]: [\w\-@.]+\r?\nEncryption: [\w\-]+\r?\nComment: [^\n]*\nPublic-Lines: \d+\r?\n(?:[A-Za-z0-9+/=]+\r?\n)+"
    r"(?:(?:Key-Derivation|Argon2-\w+): [^\n]*\n)*Private-Lines: \d+\r?\n(?:[A-Za-z0-9+/=]+\r?\n)+Private-(?:MAC|Hash): [0-9a-f]+"
)


def _oid(data: bytes, element: tuple[int, int, int] | None) -> bytes | None:
    return data[element[1] : element[2]] if element and element[0] == 0x06 else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between two places, if they fill them."""
    out = []
    while at < end:
        e = _der(data, at)
        if not e or e[2] > end:
            return None
        out.append(e)
        at = e[2]
    return out


def is_key_container(data: bytes) -> bool:
    """Whether bytes are a private key by their grammar: PKCS#1, DSA, SEC1, PKCS#8 (plain or encrypted), PKCS#12, OpenSSH, or PuTTY."""
    if data.startswith(b"openssh-key-v1\0"):
        return _is_openssh(data)
    if data.startswith(b"PuTTY-User-Key-File-"):
        return bool(PUTTY.match(data.decode("utf-8", "replace")))
    outer = _der(data, 0)
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _elements(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return False
    first, second = parts[0], parts[1]
    if first[0] == 0x02 and first[2] - first[1] == 1:
        version = data[first[1]]
        if version == 3 and second[0] == 0x30:  # PKCS#12: the content of the safe is data or signed data, and a MAC may follow
            inner = _elements(data, second[1], second[2])
            return bool(inner) and (_oid(data, inner[0]) or b"")[:-1] == b"\x2a\x86\x48\x86\xf7\x0d\x01\x07" and len(inner) == 2 and inner[1][0] == 0xA0
        if version in (0, 1) and second[0] == 0x30:  # PKCS#8: algorithm, then the key as an octet string
            algorithm = _elements(data, second[1], second[2])
            return len(parts) >= 3 and parts[2][0] == 0x04 and bool(algorithm) and _oid(data, algorithm[0]) is not None
        if version == 0 and all(e[0] == 0x02 for e in parts):  # nine integers for RSA, six for DSA
            return len(parts) in (6, 9)
        return version == 1 and second[0] == 0x04 and all(e[0] in (0xA0, 0xA1) for e in parts[2:])  # SEC1
    if first[0] == 0x30 and second[0] == 0x04 and len(parts) == 2:  # encrypted PKCS#8
        inner = _elements(data, first[1], first[2])
        return bool(inner) and (_oid(data, inner[0]) or b"").startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01\x05")
    return False


def _decode_base64(s: str) -> bytes | None:
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s.rstrip("=")) % 4 if not s.endswith("=") else 0), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unescape(s: str) -> str:
    named = {"n": "\n", "r": "\r", "t": "\t"}
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else named.get(m[3], m[3]), s)


def _encoded(text: str) -> Iterator[tuple[int, int, bytes | str]]:
    for m in BASE64.finditer(text):
        if (data := _decode_base64(m.group())) is not None:
            yield *m.span(), data
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            for a, b in (m.span(), m.span("full")):
                if any(c.isspace() for c in text[a:b]) and (data := _decode_base64("".join(text[a:b].split()))) is not None:
                    yield a, b, data
    for m in HEX.finditer(text):
        yield *m.span(), bytes.fromhex(m.group())
    if "%" in text:
        for m in PERCENT.finditer(text):
            if (plain := unquote(m.group(), errors="replace")) != m.group():
                yield *m.span(), plain
    if "\\x" in text or "\\u" in text:
        for m in ESCAPED.finditer(text):
            if _ESCAPE.search(m.group()) and ("\\x" in m.group() or "\\u" in m.group()):
                yield *m.span(), _unescape(m.group())


_LONG_RUN = re.compile(r"[A-Za-z0-9+/_\-]{11}|%[0-9A-Fa-f]{2}|\\[xu]")


def _holds(inner: bytes | str) -> bool:
    """Whether a decoded literal holds a credential, however many layers down; each layer is shorter than the one around it."""
    stack, seen = [inner], set()
    while stack:
        text = stack.pop()
        if isinstance(text, bytes):
            if is_key_container(text):
                return True
            text = _readable(text) or ""
        if len(text) < 8 or text in seen:
            continue
        seen.add(text)
        if _scan_plain(text):
            return True
        if _LONG_RUN.search(text):
            stack += [x for _, _, x in _encoded(text)]
    return False


def find(text: str) -> list[tuple[int, int]]:
    """Spans of the credentials in a text, merged and in order; one found in an encoded literal spans the literal."""
    spans = _scan_plain(text)
    if _LONG_RUN.search(text):
        plain = list(spans)
        spans += [(a, b) for a, b, inner in _encoded(text) if not any(x <= a and b <= y for x, y in plain) and _holds(inner)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        elif b > a:
            merged.append((a, b))
    return merged


def _with_repeats(text: str, known: set[str]) -> list[tuple[int, int]]:
    """Spans of the credentials of a text, and of those known from beside it, wherever they are said again."""
    spans = find(text)
    taken = bytearray(len(text))
    for a, b in spans:
        taken[a:b] = b"\1" * (b - a)
    for value in sorted(known, key=lambda v: (-len(v), v)):
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            if not any(taken[at:end]):
                spans.append((at, end))
                taken[at:end] = b"\1" * len(value)
            at = text.find(value, end)
    return sorted(spans)


def _replace(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], MARK]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(text: str) -> str:
    """The text with each credential replaced by MARK."""
    return _replace(text, _with_repeats(text, {text[a:b] for a, b in find(text)}))


# --- Messages: JSON with a string, or an array of items, as content.


def _item_texts(message: dict) -> Iterator[tuple[int, tuple, str]]:
    """(item number, path, text) of each text in scope."""
    content = message.get("content")
    if isinstance(content, str):
        yield 0, ("content",), content
    elif isinstance(content, list):
        for no, item in enumerate(content):
            if not isinstance(item, dict):
                continue
            if item.get("type") == "text" and isinstance(item.get("text"), str):
                yield no, ("content", no, "text"), item["text"]
            elif item.get("type") == "tool_result":
                inner = item.get("content")
                if isinstance(inner, str):
                    yield no, ("content", no, "content"), inner
                elif isinstance(inner, list):
                    for k, part in enumerate(inner):
                        if isinstance(part, dict) and isinstance(part.get("text"), str):
                            yield no, ("content", no, "content", k, "text"), part["text"]


def scan_message(raw: str) -> tuple[list[tuple[int, str]], str]:
    """(item_no, secret) pairs of a message, and the message with them replaced.

    Only the characters of a credential are replaced, in the literal that holds it by its place in the message; every
    other character stays. A message that isn't valid JSON is returned as it is.
    """
    try:
        message = json.loads(raw)
    except (ValueError, RecursionError):
        return [], raw
    if not isinstance(message, dict):
        return [], raw
    found: list[tuple[int, str]] = []
    swaps: dict[tuple, list[tuple[int, int]]] = {}
    texts = list(_item_texts(message))
    known = {text[a:b] for _, _, text in texts for a, b in find(text)}
    for no, path, text in texts if known else ():
        spans = _with_repeats(text, known)
        if spans:
            found += [(no, text[a:b]) for a, b in spans]
            swaps[path] = spans
    return found, _rewrite(raw, swaps) if swaps else raw


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
_CHARACTER = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)


def _literals(raw: str, wanted: set[tuple]) -> dict[tuple, tuple[int, int]]:
    """Where the string literals at the wanted paths lie; of a key given twice the last counts, as for a parser."""
    places: dict[tuple, tuple[int, int]] = {}
    stack: list[list] = []  # [is an array, key or index]
    key = False
    for m in _PIECE.finditer(raw):
        piece = m.group()
        if piece in "{[":
            stack.append([piece == "[", 0 if piece == "[" else None])
            key = piece == "{"
        elif piece in "}]":
            stack.pop()
            key = False
        elif piece == ",":
            if stack[-1][0]:
                stack[-1][1] += 1
            key = not stack[-1][0]
        elif piece == ":":
            key = False
        elif key and piece[0] == '"':
            stack[-1][1] = json.loads(piece, strict=False)
        elif piece[0] == '"' and len(stack) <= 5:
            path = tuple(s[1] for s in stack)
            if path in wanted:
                places[path] = m.span()
    return places


def _rewrite(raw: str, swaps: dict[tuple, list[tuple[int, int]]]) -> str:
    """raw with the given characters of the literals at the given paths replaced by MARK."""
    cuts: list[tuple[int, int]] = []
    for path, (a, b) in _literals(raw, set(swaps)).items():
        starts = [a + 1 + m.start() for m in _CHARACTER.finditer(raw[a + 1 : b - 1])] + [b - 1]
        cuts += [(starts[x], starts[y]) for x, y in swaps[path]]
    return _replace(raw, sorted(cuts))


def credentials(lines: DataFrame, id_col: str = "line_id", message: str = "message") -> DataFrame:
    """(line_id, item_no, secret): each credential in each row whose message is valid JSON, distinct within the row.

    Null, empty and damaged messages hold none. Inputs of tool_use items aren't looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, nos, values = [], [], []
            for line, raw in zip(batch["line_id"].tolist(), batch["message"].tolist()):
                if not raw:
                    continue
                for no, value in dict.fromkeys(scan_message(raw)[0]):
                    ids.append(line)
                    nos.append(no)
                    values.append(value)
            if not ids:
                continue
            yield pd.DataFrame({"line_id": pd.Series(ids, dtype="int64"), "item_no": pd.Series(nos, dtype="int64"), "secret": pd.Series(values, dtype="object")})

    rows = lines.where(F.col(id_col).isNotNull() & F.col(message).isNotNull()).select(F.col(id_col).cast("bigint").alias("line_id"), F.col(message).alias("message"))
    return rows.mapInPandas(run, "line_id bigint, item_no bigint, secret string")


def redact_messages(lines: DataFrame, message: str = "message") -> DataFrame:
    """lines with message replaced by its redacted form, and n_secrets; a message that is null or damaged stays as it is."""

    @F.pandas_udf("message string, n_secrets int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            done = [scan_message(r) if r else ([], r) for r in raws]
            yield pd.DataFrame({"message": [d[1] for d in done], "n_secrets": pd.Series([len(d[0]) for d in done], dtype="int32")})

    others = [c for c in lines.columns if c not in (message, "n_secrets")]
    return lines.withColumn("__r", run(F.col(message))).select(*others, F.col("__r.message").alias(message), F.col("__r.n_secrets").alias("n_secrets"))
