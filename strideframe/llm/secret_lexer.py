"""Secrets in texts: fixed base patterns, and a lexer for assignments.

The lexer reads source and configuration syntax into pairs of a name and a
value, with sigils, types and literals over line ends, follows constants through later lines (``key = PART_A +
"..."``), and scores the literals that reach a name by how sensitive the name
is and how random the literal looks. Base matches always stay; the lexer adds
spans for literals that no base match covers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")
_RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

#: how sensitive a part of a target name is, 0 to 1
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0,
    "secretkey": 1.0, "authkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "clientsecret": 1.0,
    "connectionstring": 0.8, "key": 0.4, "salt": 0.5, "signature": 0.4,
}
#: values that stand for a secret without being one
PLACEHOLDERS = {"changeme", "password", "secret", "token", "example", "placeholder", "redacted", "none", "null", "true", "false", "undefined", "todo", "xxx", "yourpassword", "yourtoken", "test"}
#: names that these words end are more sensitive than names that merely hold them
LAST_WEIGHTS = {"pass": 0.85, "auth": 0.85, "pw": 0.85}
THRESHOLD = 0.6
#: from this weight on a name makes any literal a secret
NEAR = 0.9
SHORTEST = 6

_LITERAL = r"""(?:[rRbBfFuUL@$]{0,2}(?P<q>\"\"\"|'''|"|'|`)|r(?P<raw>#+)")"""
_TYPE = r"""(?:&\s*)?(?:'\w+\s+)?(?:mut\s+|dyn\s+)?(?:\[\d*\]|[*?])*[A-Za-z_](?:[\w.]|::)*+(?:<[^<>=\n]*>|\[[^\[\]=\n]*\])?(?:\[\d*\])*[?!]?(?:\s*\|\s*[\w.]+)*"""
_TARGET = re.compile(r"""(?:^|[\s{(\[,;<])(?:export\s+|const\s+|let\s+|var\s+|val\s+|my\s+|our\s+|local\s+|final\s+|static\s+|set\s+)*+
    (?:--?(?=[A-Za-z])|[$@%&:*]{0,2})(?:(?:env|script|global|private|local):)?(?P<quote>["']?)(?P<name>[A-Za-z_](?:->|::|[\w.\-])*+)(?P=quote)
    (?:\s*(?:\[\s*["':]?|\{\s*["']?)(?P<item>[A-Za-z_][\w.\-]*+)["']?\s*[\]}]|\[\s*\d*\s*\])*+
    (?:\s*[?!]?:\s*(?P<type>TYPE)(?:\s+=(?![=>~])|=(?=\s*(?:LITERAL|\()))|\s+(?P<go>TYPE)\s*=(?=\s*(?:LITERAL))|\s*(?P<op>=>|:=|<-|(?:\?\??|\+|\|\|)?=(?!=)|:(?![:/])))[^\S\n]*
    """.replace("TYPE", _TYPE).replace("LITERAL", r"""[rRbBfFuUL@$]{0,2}["'`]|r\#+"|$"""), re.VERBOSE | re.MULTILINE)
#: types that follow a name in Go; before a name, any other word may be a type
_GO_TYPES = re.compile(r"(?:\[\d*\]|\*)*(?:string|byte|rune|any|error)")
_QUOTE = re.compile(_LITERAL)
_STOPS = {
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*+(?=""")'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*+(?=''')"),
    '"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*+(?=")'), "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*+(?=')"), "`": re.compile(r"[^`]*+(?=`)"),
}
_REF = re.compile(r"[$@]?\{?(?P<ref>[A-Za-z_][\w.]*)\}?")
_OPEN = re.compile(r"\(\s*(?=[rRbBfFuUL@$]{0,2}[\"'`]|r#+\")")
_NEXT_LINE = re.compile(r"\\?\r?\n\s*(?=[(rRbBfFuUL@$]{0,2}\s*[\"'`]|r#+\")")
_NAME_FOLLOWS = re.compile(r"[^\S\n]*(?::|=)")
_JOIN = re.compile(r"\s*(?:\+|\.\.?|<>|&)\s*|[^\S\n]*\\\r?\n\s*(?=[\"'])|[^\S\n]+(?=[\"'])")
_BESIDE = re.compile(r"\s*(?:(?:\+|\.\.?|<>|&)\s*)?(?=[^\s)])")
_BLOCK = re.compile(r"[|>][+-]?\d?[^\S\n]*\r?\n(?P<lines>(?P<indent>[^\S\n]+)\S.*(?:\n(?:(?P=indent).*|[^\S\n]*(?=\n)))*)")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^*-]+")
_WORDY = re.compile(r"[A-Za-z]*+\d{0,4}(?:[_\-./: ]++[A-Za-z]*+\d{0,4})*+")
_MASK = re.compile(r"<[\w -]*>|\*+|\$?\{+[\w. ]*\}+|%\w+%", re.ASCII)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

#: <add key="name" value="..."/> and <name>...</name>, with the value's element closed by the same name
_XML_PAIR = re.compile(r"""<[A-Za-z][\w:.-]*\s(?=[^<>]*?\b(?:key|name|id)\s*=\s*(?P<q>["'])(?P<name>[A-Za-z_][\w.:-]*)(?P=q))(?=[^<>]*?\bvalue\s*=\s*(?P<v>["']))[^<>]*?\bvalue\s*=\s*(?P=v)(?P<value>(?:(?!(?P=v))[^<>\n])*)(?P=v)""")
_XML_TEXT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>(?:<!\[CDATA\[)?[^\S\n]*(?P<value>[^<>\n]*?)[^\S\n]*(?:\]\]>)?</(?P=name)\s*>")
_XML_NAMED = re.compile(r"""<[A-Za-z][\w:.-]*\s[^<>]*?\b(?:key|name|id)\s*=\s*(?P<q>["'])(?P<name>[A-Za-z_][\w.:-]*)(?P=q)[^<>]*(?<!/)>[^\S\n]*(?P<value>[^<>\n]+?)[^\S\n]*</""")
_HEADER = re.compile(r"""\b(?:proxy-)?authorization["']?\s*[:=,]\s*["']?(?:bearer|basic|token|digest|apikey)\s+(?P<value>[A-Za-z0-9+/_.=~-]+)""", re.ASCII | re.IGNORECASE)
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,31}+://[^\s/@:"'<>]*+:(?P<value>[^\s/@"'<>]++)@[^\s/"'<>]""")

Span = tuple[int, int, int]
#: a literal (value, start, end), or what another name held, as a list of the same
Part = tuple[str, int, int] | list


def base_spans(text: str) -> list[Span]:
    """Base matches as (start, end, rank of kind), leftmost and apart within a kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def name_score(name: str) -> float:
    """How sensitive a target name is: the best of its parts and of neighbouring parts joined."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    last = LAST_WEIGHTS.get(parts[-1], 0.0) if parts else 0.0
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max(last, max((NAME_WEIGHTS.get(p, NAME_WEIGHTS.get(p.rstrip("s"), 0.0)) for p in joined), default=0.0))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, mixture of characters, no placeholder."""
    if len(value) < SHORTEST or value.lower().strip("<>{}[]*_-. ") in PLACEHOLDERS or len(set(value)) < 3:
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 3) * (0.6 + 0.2 * min(2, kinds - 1)) if kinds > 1 else 0.35 * min(1.0, bits / 3)


def looks_random(value: str) -> bool:
    """Whether a literal is a secret by its look alone: letters and digits mixed, or cases, and no words or addresses."""
    if "://" in value or len(set(value)) < 8 or any(c.isspace() for c in value) and "-----BEGIN" not in value:
        return False
    if re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value):
        return not _WORDY.fullmatch(value)
    return len(re.findall(r"[a-z](?=[A-Z])", value)) * 5 >= len(value)


def pair_score(name: str, value: str, quoted: bool = True) -> float:
    """How likely a name holds a secret in this value.

    The product of both scores, or what one of them carries alone: a name of
    weight near 1 any literal, a literal of random look any listed name. Spaces
    and values of one kind count in literals under names near 1 that end in the
    sensitive word; of unquoted values only those without spaces and other kinds.
    """
    weight, look = name_score(name), literal_score(value)
    if not weight or not look:
        return 0.0
    if any(c.isspace() for c in value) and "-----BEGIN" not in value:
        return weight if quoted and weight >= NEAR and name_score(_SPLIT.split(name.rstrip("0123456789_-."))[-1]) + name_score("".join(_SPLIT.split(name.rstrip("0123456789_-."))[-2:])) > 0 else 0.0
    carried = weight if quoted and weight >= NEAR else look if looks_random(value) else 0.0
    return max(weight * look, carried)


def _literal(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of the content of the literal at a position, and the end of the literal."""
    if not (m := _QUOTE.match(text, at)):
        return None
    if m["raw"]:
        stop = text.find('"' + m["raw"], m.end())
        return (m.end(), stop, stop + 1 + len(m["raw"])) if stop >= 0 else None
    q = m["q"]
    if (s := _STOPS[q].match(text, m.end())) is None:
        return None
    return m.end(), s.end(), s.end() + len(q)


def expanded(parts: list[Part]) -> list[tuple[str, int, int]]:
    """The literals of linked parts in order, each once, in time linear to the links."""
    out: dict[tuple[str, int, int], None] = {}
    seen, todo = {id(parts)}, [iter(parts)]
    while todo:
        for p in todo[-1]:
            if isinstance(p, list):
                if id(p) not in seen:
                    seen.add(id(p))
                    todo.append(iter(p))
                    break
            else:
                out[p] = None
        else:
            todo.pop()
    return list(out)


def _parts(text: str, at: int, constants: dict[str, list[Part]]) -> tuple[list[Part], int]:
    """Literals and constants that are joined from a position on, and where they end; line ends pass in brackets and next to an operator."""
    parts: list[Part] = []
    seen = bracket = False
    if m := _NEXT_LINE.match(text, at):
        first = _literal(text, m.end())
        if first is None or not _NAME_FOLLOWS.match(text, first[2]):
            at = m.end()
    if m := _OPEN.match(text, at):
        at, bracket = m.end(), True
    pos = at
    while True:
        if lit := _literal(text, pos):
            parts.append((text[lit[0]:lit[1]], lit[0], lit[1]))
            seen, pos = True, lit[2]
        elif m := _REF.match(text, pos):
            known = constants.get(m["ref"])
            if known is None and not seen:
                break
            if known is not None:
                parts.append(known)
            pos = m.end()
        else:
            break
        if not (j := (_BESIDE if bracket else _JOIN).match(text, pos)):
            break
        pos = j.end()
    return parts, pos


def lex(text: str) -> Iterator[tuple[str, list[Part], int, bool]]:
    """Name and linked parts of each assignment; where the value begins, and whether it is quoted.

    A target may have a sigil, dashes or a type; literals may go over line ends.
    A constant is a link to what was last assigned to its name, so a chain of
    assignments costs its length; ``expanded`` follows the links.
    """
    constants: dict[str, list[Part]] = {}
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        begin = at
        if text.find("=", at, stop) >= 0 or text.find(":", at, stop) >= 0 or text.find("<-", at, stop) >= 0:
            while begin <= stop and (m := _TARGET.search(text, begin, stop)):
                name, own = m["item"] or m["name"], m["name"]
                if m["go"] and not _GO_TYPES.fullmatch(m["go"]) and name_score(m["go"]) >= name_score(name):
                    # a type and a name: the type is not the target
                    name = own = m["go"]
                parts, pos = _parts(text, m.end(), constants)
                quoted = bool(parts)
                if not parts and m["op"] == ":" and (b := _BLOCK.match(text, m.end())):
                    parts, pos, quoted = [(b["lines"].strip(), b.start("lines") + len(b["indent"]), b.start("lines") + len(b["lines"].rstrip()))], b.end(), True
                if not parts and m["type"] and any(c.isdigit() for c in m["type"]):
                    parts, pos = [(m["type"], m.start("type"), m.end("type"))], m.end()
                elif not parts and (b := _BARE.match(text, m.end(), stop)):
                    value = b[0].rstrip(".,;")
                    parts, pos = [(value, b.start(), b.start() + len(value))], b.end()
                    # unspaced, as in environments and flags, and no name of something sensitive: as good as quoted
                    quoted = m["op"] == "=" and m[0].endswith("=") and not m[0][:-1].endswith(" ") and b.end() == len(text[:stop].rstrip()) and not name_score(value)
                if parts:
                    constants[own] = parts
                    yield name, parts, m.end(), quoted
                begin = max(pos, m.end())
                if begin > stop:
                    # a literal went over line ends: go on behind it
                    stop = text.find("\n", begin)
                    stop = len(text) if stop < 0 else stop
        at = stop + 1


def _markup(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Name, value and span of pairs in XML, authorisation headers and URLs."""
    if "</" in text or "/>" in text:
        for pattern in (_XML_PAIR, _XML_TEXT, _XML_NAMED):
            for m in pattern.finditer(text):
                yield m["name"].rsplit(":", 1)[-1], m["value"], m.start("value"), m.end("value")
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            yield "password", m["value"], m.start("value"), m.end("value")
    if "uthorization" in text or "UTHORIZATION" in text:
        for m in _HEADER.finditer(text):
            yield "authkey", m["value"], m.start("value"), m.end("value")


def lexed_spans(text: str, covered: list[Span], threshold: float = THRESHOLD) -> list[Span]:
    """Literals whose name and look together reach the threshold and that no given span covers whole.

    A name that is assigned from itself is judged by its last such assignment.
    """
    out = set()
    for name, value, a, b in _markup(text):
        if name_score(name) and not _MASK.fullmatch(value) and pair_score(name, value) >= threshold:
            out.add((a, b, 3))
    if "=" in text or ":" in text or "<-" in text:
        judged: dict[int, tuple[str, list[Part], int, bool]] = {}
        last: dict[str, list[Part]] = {}
        for name, parts, begin, quoted in lex(text):
            if name_score(name):
                before = last.get(name)
                if before is not None and any(p is before for p in parts):
                    judged.pop(id(before), None)
                judged[id(parts)] = name, parts, begin, quoted
                last[name] = parts
        for name, parts, begin, quoted in judged.values():
            literals = [p for p in expanded(parts) if not _MASK.fullmatch(p[0])]
            if pair_score(name, "".join(v for v, _, _ in literals), quoted) >= threshold:
                # a piece of one or two characters in the line itself tells nothing
                out.update((a, b, 3) for v, a, b in literals if v and (len(v) > 2 or a < begin))
    # of spans one in another the outer one stays
    flat, reach = [], -1
    for a, b, k in sorted(out, key=lambda x: (x[0], -x[1])):
        if b > reach:
            flat.append((a, b, k))
            reach = b
    return [x for x in flat if not any(a <= x[0] and x[1] <= b for a, b, _ in covered)]


def spans(text: str | None) -> list[Span]:
    """All spans of a text by start and kind; null has none."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + lexed_spans(text, base), key=lambda s: (s[0], s[2], s[1]))


def _joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts per base kind, n_lexed, base_sha256, spans: one row per document.

    Offsets count code points, end exclusive. Null and empty texts have no
    spans. Repeated rows get equal results; whole texts are read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(x.as_py()) for x in batch.column(1)]
            base = [[s for s in f if s[2] < 3] for f in found]
            counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([_joined(f) for f in found], pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_lexed bigint, base_sha256 string, spans string")


def masked(text: str | None, mark: str = "<redacted>") -> str | None:
    """The text with every secret replaced by the mark; of an assignment only the value goes."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        if kind == 0:
            a = _ASSIGN.match(text, a).start(2)
        if b <= at:
            continue
        out.append(text[at:max(a, at)])
        if a >= at:
            out.append(mark)
        at = b
    out.append(text[at:])
    return "".join(out)


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "<redacted>") -> DataFrame:
    """The documents with secrets masked in ``text``; all other columns and all rows as they are.

    Null stays null, empty stays empty; texts without secrets are untouched,
    repeated rows get equal results, an empty table gives an empty one.
    """
    field = docs.schema.names.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = pa.array([masked(x.as_py(), mark) for x in batch.column(field)], batch.schema.field(field).type)
            yield batch.set_column(field, batch.schema.field(field), col)

    return docs.mapInArrow(scan, docs.schema)
