"""Secret scans with structural confirmation.

Base kinds are plain patterns: assign, access, hex. The method's kinds are reported only
after decoding: ``key`` for a private key (base64, PEM or hex) whose nested lengths parse as
PKCS#1, PKCS#8, SEC1 or the OpenSSH format, also wrapped over lines, and ``jwt`` for a signed token whose header and
claims decode to JSON objects with an algorithm.

Spans are code points, end exclusive. Base spans are whole matches of the pattern, found
leftmost and without overlap within a kind; the method's spans may overlap them.

Wrapped keys: a key is also read from its head (the bytes that every such structure starts
with, in base64 or hex), taking as many characters as its own nested length asks for from the
runs that follow. Between runs may stand white space, written escapes, quotes, signs of
concatenation, quotation and comments; in base64 also anything short, if all lines but the last
are as long as the first. Marks of PEM around a key belong to its span.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; spans of
equal start are ordered by kind as listed in KINDS, then by end; an empty table gives an empty result;
other columns are ignored. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from .tables import batches_of, per_text, table

KINDS = ("assign", "access", "hex", "key", "jwt")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
RUNHEX = re.compile(r"(?:[0-9a-f]{2}){32,}|(?:[0-9A-F]{2}){32,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+")
_ANY64, _LOW00 = "[A-Za-z0-9+/_-]", "[AEIMQUYcgkosw048]"
#: SEQUENCE of any form of length, then INTEGER 0 or 1, in base64; or the OpenSSH magic.
HEAD64 = re.compile(rf"M(?:I(?:[I-L]{_ANY64}{{2}}[AQgw]IBA[A-Za-z]|[E-H]{_ANY64}AgE[AB]|[M-P]{_ANY64}{{3}}{_LOW00}CAQ[A-H]|[Q-T]{_ANY64}{{5}}AgE[AB])|[A-H]{_LOW00}CAQ[A-H])|b3BlbnNzaC1rZXktdjEA")
_ESCAPE = r"\\+(?:[nrt]|u00[0-9A-Fa-f]{2})|%0[AaDd]|&#(?:1[03]|x0?[AaDd]);|&(?:quot|gt);|<br ?/?>"
_GAP = r"[\s\"'`>,.;:#*|\\&=()!%$<{}\[\]]"
PIECE64 = re.compile(rf"({_ESCAPE})|({_ANY64}+)|{_GAP}")
_SEP = r"(?:\\+[nrt]|[\s\"'`>,.;:#*|+/_{}()&-]|\\+(?=x)|0?[xX])*"
HEADHEX = re.compile(r"30S(?:82S..S..S|81S..S|83S..S..S..S|84S..S..S..S..S|[0-7].S)02S01S0[01]".replace("..", "hh").replace(".", "h").replace("h", "[0-9A-Fa-f]").replace("S", _SEP) + "|" + _SEP.join("(?:" + "".join(f"[{c.lower()}{c.upper()}]" for c in f"{b:02x}") + ")" for b in b"openssh-key-v1\0"))
PIECEHEX = re.compile(r"(\\+[nrt]|\\+x|0[xX])|((?:(?!0[xX])[0-9A-Fa-f]{2})+)|[\s\"'`>,.;:#*|+/_{}()&-]")
#: Where a head may stand: not within a run, unless an escape, a mark or a sign glued to the line ends there.
_OPEN64 = re.compile(rf"(?<!{_ANY64})|(?<=\\[nrt])|(?<=\\u000[AaDd])|(?<=%0[AaDd])|(?<=-----)|(?<=\n[+/_-])|(?<=\n[+/_-][+/_-])")
_OPENHEX = re.compile(r"(?<![0-9A-Fa-f])")
_MARK = re.compile(r"-----(?:BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: Most characters between two lines of a wrapped key.
APART = 256
_HEX_AS_X = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_AS_X = bytes(120 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/-_") else 32 for c in range(256))


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, end of the value) of the DER element at `at`, if it fits before `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (x := _tlv(data, at, end)) is None or len(out) > 64:
            return None
        out.append(x)
        at = x[2]
    return out


def private_key(data: bytes) -> str | None:
    """The format of an encoded private key, if every nested length fits."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while fields < 3:
            if at + 4 > len(data) or (n := int.from_bytes(data[at : at + 4], "big")) > len(data) - at - 4:
                return None
            at, fields = at + 4 + n, fields + 1
        return "openssh" if at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16 else None
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or not (items := _items(data, top[1], top[2])) or items[0][0] != 2 or items[0][2] - items[0][1] != 1:
        return None
    version, tags = data[items[0][1]], [x[0] for x in items]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {2} and all(b > a for _, a, b in items):
        return "pkcs1"
    if version in (0, 1) and tags[1:3] == [0x30, 4] and (inner := _items(data, *items[1][1:])) and inner[0][0] == 6:
        return "pkcs8"
    if version == 1 and tags[1:2] == [4] and items[1][2] - items[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1"
    return None


def _decoded(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (ValueError, binascii.Error):
        return b""


def extent(data: bytes) -> int | None:
    """Bytes of the structure that starts here, by its own lengths; None if they lie beyond what is given, 0 if there is none."""
    if data[:1] == b"0":
        if len(data) < 2 or len(data) < 2 + (k := data[1] & 0x7F if data[1] & 0x80 else 0):
            return None
        return 0 if k > 4 or data[1] == 0x80 else 2 + k + int.from_bytes(data[2 : 2 + k], "big") if k else 2 + data[1]
    at, left = 15, 3
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    if at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys + 1):  # public keys, then the private ones together
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


class _Gathered:
    """Characters of one key and where each piece stands in the text."""

    def __init__(self, bits: int):
        self.bits, self.pieces, self.n, self.total, self.tried = bits, [], 0, None, 0

    def add(self, start: int, run: str) -> bool:
        """True once all characters of the key are there, or it can't be one."""
        self.pieces.append((start, run))
        self.n += len(run)
        if self.total is None and self.n >= self.tried:
            self.tried = self.n + self.n // 4
            self.total = extent(self.bytes())
        return self.total is not None and self.n >= self.need()

    def need(self) -> int:
        return -(-self.total * 8 // self.bits)

    def bytes(self) -> bytes:
        chars = "".join(run for _, run in self.pieces)
        if self.bits == 4:
            return bytes.fromhex(chars[: len(chars) // 2 * 2])
        chars = chars if self.total is None else chars[: self.need()]
        return _decoded(chars[:-1] if len(chars) % 4 == 1 else chars)

    def end(self) -> int | None:
        """End of the key in the text, if it is one and its last run ends with it."""
        if not self.total or self.n != self.need() or not private_key(self.bytes()[: self.total]):
            return None
        return self.pieces[-1][0] + len(self.pieces[-1][1])


def _in_a_row(text: str, at: int, piece: re.Pattern, bits: int, signs: bool, glued: str = "") -> int | None:
    """End of a key whose runs are parted only by what `piece` allows; runs of signs alone count if `signs`."""
    got, since = _Gathered(bits), at
    while (m := piece.match(text, at)) and at - since <= APART:
        if run := m[2]:
            start, run, more = at, *run.partition("-----")[:2]
            if glued and text[at - 1 : at] == "\n" and run.startswith(glued):
                start, run = at + len(glued), run[len(glued) :]
            if run and (signs or bits == 4 or len(run) > 3 or run.strip("+/_-")):
                if got.add(start, run):
                    break
                since = m.end()
            if more:
                break
        at = m.end()
    if got.total is None and got.n:
        got.total = extent(got.bytes())
    return got.end()


def _by_width(text: str, at: int) -> int | None:
    """End of a base64 key whose lines but the last are as long as the first, whatever stands between them."""
    got, width, since = _Gathered(6), 0, at
    for m in PIECE64_ANY.finditer(text, at):
        if m.start() - since > APART:
            break
        if not m[2]:
            continue
        run = m[2].partition("-----")[0]
        width = width or len(run)
        last = got.need() - got.n if got.total is not None else None
        if last is not None and last < width:
            if len(run) != last:
                continue
        elif len(run) != width:
            continue
        if got.add(m.start(), run):
            break
        since = m.end()
    return got.end()


PIECE64_ANY = re.compile(rf"({_ESCAPE})|({_ANY64}+)")


def wrapped_key(text: str, at: int, hexed: bool) -> int | None:
    """End of the key whose head stands at `at`."""
    if hexed:
        return _in_a_row(text, at, PIECEHEX, 4, True)
    glued = re.search(r"(?:^|\n)([+/_-]{1,3})$", text[max(0, at - 4) : at])
    return _in_a_row(text, at, PIECE64, 6, False) or _in_a_row(text, at, PIECE64, 6, True) or (_in_a_row(text, at, PIECE64, 6, True, glued[1]) if glued else None) or _by_width(text, at)


def wrapped_keys(text: str, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of keys that are told by their heads and lie in none of `known`."""
    out: list[tuple[int, int]] = []
    marks = None
    for a, hexed in sorted([(m.start(), hexed) for head, begins, hexed in ((HEAD64, _OPEN64, False), (HEADHEX, _OPENHEX, True)) for m in head.finditer(text) if begins.match(text, m.start())]):
        if any(x <= a < y for x, y in known) or out and a < out[-1][1] or (b := wrapped_key(text, a, hexed)) is None:
            continue
        while not hexed and b < len(text) and text[b] == "=":
            b += 1
        if marks is None:
            marks = [(m.start(), m.end(), m[0][5:10] == "BEGIN") for m in _MARK.finditer(text)]
        before = max((x for x in marks if x[1] <= a), default=None)
        after = min((x for x in marks if x[0] >= b), default=None)
        if before and after and before[2] and not after[2]:
            a, b = before[0], after[1]
        out.append((a, b))
    return out


def signed_token(run: str) -> bool:
    try:
        head, claims = (json.loads(_decoded(x)) for x in run.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    one = text.encode("latin-1", "replace")  # one byte for each code point, so places stay
    if b"x" * 24 in one.translate(_HEX_AS_X):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    keys: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        keys += [m.span() for m in PEM.finditer(text) if private_key(_decoded(re.sub(r"\s", "", m[2])))]
    keys += wrapped_keys(text, keys)
    if b"x" * 40 in one.translate(_B64_AS_X):
        for m in RUN64.finditer(text):
            if not any(a <= m.start() and m.end() <= b for a, b in keys) and (private_key(_decoded(m[0])) or any(private_key(bytes.fromhex(h[0])) for h in RUNHEX.finditer(m[0]) if h[0] == m[0].rstrip("="))):
                keys.append(m.span())
    out += [(a, b, "key") for a, b in keys]
    if "eyJ" in text:
        out += [(*m.span(), "jwt") for m in JWT.finditer(text) if signed_token(m[0])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at, n = [], 0, len(text)
    for a, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:n]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make():
        def one(t: str) -> tuple:
            found = spans(t)
            told = [f"{k}:{a}:{b}" for a, b, k in found]
            base = ",".join(s for s, x in zip(told, found, strict=True) if x[2] in KINDS[:3])
            return (*(sum(x[2] == k for x in found) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(told))

        return one

    return per_text(docs, [key], "n_assign long, n_access long, n_hex long, n_key long, n_jwt long, base_sha256 string, spans string", make, text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced in `text`."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        for b in batches_of(batches):
            cols = list(b.columns)
            cols[at] = pa.array([None if t is None else redacted(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, pa.string()) if i == at else f for i, f in enumerate(b.schema)]))

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
