"""Secret scans with a recursive decoding worklist.

A text's base secrets are found by three patterns. Then every layer of the text that can be decoded
(percent escapes, Unicode escapes, base64, and zlib or gzip data inside base64) goes on a worklist:
it is decoded, scanned, and searched for further layers until none is new. Base64 may begin and end anywhere in a run of its
characters (behind a path, a prefix, before a slash): a run is decoded at all four alignments, and inflated from every
place where compressed data may begin. An escape that escapes itself over and over (``%252525...``) is unwound to its last
levels in one step, since the levels between differ by its repeats alone; past ``LEVELS`` levels of a whole text, the rest is unwound in
one pass, so that time grows with the length and not with its square. A layer whose content was
seen before at the same place of this document is not decoded again, so cycles end, and each place of a
repeated layer is reported. Base64 may be wrapped in lines. Bytes that are no UTF-8 stand as replacement
characters, so they hide nothing around them. Data is inflated to its end (all members, however often compressed)
in overlapping windows of about ``max_inflated`` bytes, so that a compression bomb takes time but little memory;
a window grows only while one run without breaks lasts. Each decoded character
keeps the range of the original text that it came from, so every finding is mapped to original code
points. A decoded finding is left out only where one base finding of its kind covers it, and at alignments
other than that of a run's first character a row of hex digits only where it has under five different ones (data that
repeats looks like that). Null text is empty; repeated rows give equal results; further columns are ignored.
Ids are whole numbers, or text that says one (other text counts as null).

The worklist is Python inside Arrow tasks, one text at a time; Spark deals out the rows.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
#: Escapes of themselves, as they stand before the last levels.
_PERCENT_CHAIN = re.compile(r"%(?:25){8,}")
_UNICODE_CHAIN = re.compile(r"\\(?:u005[cC]|u\{0{0,4}5[cC]\}|x5[cC]){8,}")
_UNICODE_UNIT = re.compile(r"u005[cC]|u\{0{0,4}5[cC]\}|x5[cC]")
_ESCAPE_END = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})$")
CHAIN, LEVELS = 7, 40
_UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What in decoded bytes may be a secret or a further layer.
_SUSPECT = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-]{16}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++={0,2}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++={0,2}+)++")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: A character that no secret or layer holds; a token with the spaces after it (not those that begin a line).
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=%\\{}"':\s-]""")
_TOKEN = re.compile(r"(?:[^ \n]|\n[ \t]*)+ +")

#: Where each character of a layer came from: first and last + 1.
Origin = tuple[np.ndarray, np.ndarray]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, leftmost and non-overlapping within a kind."""
    out = []
    if _KEYWORD.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return out


def _rebuilt(text: str, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, Origin] | None:
    """A text with ranges (start, end, characters with their own ranges) replaced, and where each character came from."""
    if not pieces:
        return None
    out, first, last, at = [], [], [], 0
    for a, z, got in pieces:
        out += [text[at:a], "".join(c for c, _, _ in got)]
        for ends, k in ((first, 1), (last, 2)):
            ends += [np.arange(at, a) + (k - 1), np.array([g[k] for g in got], np.int64)]
        at = z
    out.append(text[at:])
    first.append(np.arange(at, len(text)))
    last.append(np.arange(at, len(text)) + 1)
    return "".join(out), (np.concatenate(first), np.concatenate(last))


def _unpercent(text: str) -> tuple[str, Origin] | None:
    """All percent escapes of a text decoded once; a byte that is no UTF-8 becomes a replacement character."""
    pieces = []
    chains = {m.start(): m.end() for m in _PERCENT_CHAIN.finditer(text)}
    at = 0
    while m := _PERCENT.search(text, at):
        at = m.end()
        if z := chains.get(m.start()):
            pieces.append((m.start(), z - 2 * CHAIN, [("%", m.start(), z - 2 * CHAIN)]))
            at = z
            continue
        got, p = [], m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            bad = "\udc80" <= c <= "\udcff"
            n = 3 if bad else 3 * len(c.encode())
            got.append(("\ufffd" if bad else c, p, p + n))
            p += n
        pieces.append((*m.span(), got))
    return _rebuilt(text, pieces)


def _characters(run: re.Match) -> list[tuple[str, int, int]]:
    """The characters of a run of Unicode escapes, each with its source range."""
    units = [(int(m[1] or m[2] or m[3], 16), run.start() + m.start(), run.start() + m.end()) for m in _UNICODE_ONE.finditer(run[0])]
    got, i = [], 0
    while i < len(units):
        v, a, z = units[i]
        if 0xD800 <= v < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            v, z = 0x10000 + ((v - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2]
            i += 1
        i += 1
        if 0xD800 <= v < 0xE000 or v > 0x10FFFF:
            v = 0xFFFD
        got.append((chr(v), a, z))
    return got


def _chain_cut(m: re.Match) -> int:
    """Where the last CHAIN units of a chain of Unicode escapes begin."""
    return m.start() + 1 + [u.start() for u in _UNICODE_UNIT.finditer(m[0], 1)][-CHAIN] - 1


def _ununicode(text: str) -> tuple[str, Origin] | None:
    chains = {m.start(): m for m in _UNICODE_CHAIN.finditer(text)}
    pieces, at = [], 0
    while run := _UNICODE.search(text, at):
        at = run.end()
        if m := chains.get(run.start()):
            cut = _chain_cut(m)
            pieces.append((m.start(), cut, [("\\", m.start(), cut)]))
            at = m.end()
        else:
            pieces.append((*run.span(), _characters(run)))
    return _rebuilt(text, pieces)


def _unwound(text: str) -> tuple[str, Origin] | None:
    """A text with all percent and Unicode escapes decoded to the end, in one pass: what the characters so far end with is decoded at once."""
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    done = False
    for i, c in enumerate(text):
        out.append(c)
        first.append(i)
        last.append(i + 1)
        while (c in "0123456789abcdefABCDEF}") and (m := _ESCAPE_END.search("".join(out[-10:]))):
            n = len(m[0])
            v = int(m[0].lstrip("%\\ux{").rstrip("}") or "0", 16)
            byte = m[0][0] == "%" and v >= 128
            c = chr(0xDC00 + v) if byte else chr(v) if v <= 0x10FFFF else "\ufffd"
            out[-n:], first[-n:], last[-n:] = [c], [first[-n]], [last[-1]]
            done = True
    if not done:
        return None
    # Bytes become text, pairs of halves one character.
    pieces, i = [], 0
    whole = "".join(out)
    for m in re.finditer("[\ud800-\udfff]+", whole):
        got, p = [], m.start()
        run = m[0].encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udbff]", m[0]) else None
        if run is None:
            for x in m[0].encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape") if all(0xDC80 <= ord(h) <= 0xDCFF for h in m[0]) else "\ufffd" * len(m[0]):
                bad = "\udc80" <= x <= "\udcff"
                n = 1 if bad else len(x.encode("utf-8", "surrogatepass")) if x != "\ufffd" else 1
                got.append(("\ufffd" if bad else x, p, p + n))
                p += n
        else:
            for x in run:
                n = 2 if ord(x) > 0xFFFF else 1
                got.append((x, p, min(p + n, m.end())))
                p = min(p + n, m.end() - 1)
        pieces.append((*m.span(), got))
    starts, ends = np.array(first, np.int64), np.array(last, np.int64)
    if not (made := _rebuilt(whole, pieces)):
        return whole, (starts, ends)
    new, (a, z) = made
    return new, (starts[a], ends[z - 1])


def _percent_run(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] * 256 + raw[1]) % 31 == 0)


def _inflate(chunks: Iterator[bytes], window: int) -> Iterator[bytes]:
    """All members' data in pieces of at most window bytes, then what follows the last member."""
    d, members, more = zlib.decompressobj(zlib.MAX_WBITS | 32), 0, False
    for chunk in chunks:
        while chunk or more:
            try:
                out = d.decompress(chunk, window)
            except zlib.error:
                if members and not more:  # no further member
                    yield from chain([b"\0", chunk], chunks)
                return
            if out:
                yield out
            more, chunk = len(out) == window and not d.eof, d.unconsumed_tail
            if d.eof:
                members, chunk = members + 1, d.unused_data.lstrip(b"\0")
                d = zlib.decompressobj(zlib.MAX_WBITS | 32)


def _unpadded(body: str) -> bytes | None:
    """The bytes of a base64 run; a last character that belongs to no byte goes."""
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body.translate({45: 43, 95: 47}) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _after(raw: bytes, window: int) -> int:
    """How many bytes follow compressed data."""
    while _packed(raw):
        d = zlib.decompressobj(zlib.MAX_WBITS | 32)
        try:
            while raw and not d.eof:
                d.decompress(raw, window)
                raw = d.unconsumed_tail
            if not d.eof and not d.decompress(b"") and not d.eof:
                return 0
        except zlib.error:
            return 0
        raw = d.unused_data
        if not _packed(raw):
            return len(raw)
    return 0


def _opened(body: str, window: int, strict: bool = False) -> tuple[str, Iterator[str]] | None:
    """The name and text (in overlapping windows) of a base64 run, inflated as often as it can be; strict: text must be valid UTF-8."""
    if len(body) < 16:
        return None
    if (head := _unpadded(body)) is None:
        return None
    name, rest, seen = "base64", iter(()), set()
    while _packed(head):
        if (key := hashlib.sha256(head).digest()) in seen:  # data that inflates to itself
            return None
        seen.add(key)
        inner, got, size = _inflate(chain([head], rest), window), [], 0
        for piece in inner:
            got.append(piece)
            size += len(piece)
            if size >= window:
                break
        if not got:
            break
        head, rest, name = b"".join(got), inner, name + "+zlib"
    if name != "base64":
        return name, _windows(chain([head], rest), window)
    try:
        return name, iter([head.decode("utf-8", "strict" if strict else "replace")])
    except UnicodeDecodeError:
        return None


def _packed_starts() -> re.Pattern:
    """Where in a base64 run zlib or gzip data may begin: the characters that the two first bytes of either give."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    heads = [0x1F8B] + [c << 8 | f for c in range(0x08, 0x80, 0x10) for f in range(256) if (c << 8 | f) % 31 == 0]
    both = {"+": "+\\-", "/": "/_"}  # of both alphabets
    some = lambda i, n: "[" + "".join(both.get(c, c) for c in letters[i : i + n]) + "]"
    return re.compile("(?=" + "|".join(some(h >> 10, 1) + some(h >> 4 & 63, 1) + some((h & 15) << 2, 4) for h in heads) + ")")


_PACKED = _packed_starts()


def _shifted(body: str, window: int) -> Iterator[tuple[int, int, str, Iterator[str]]]:
    """(first character, shift, name, texts) of what a base64 run holds elsewhere than from its first character on.

    A shift of 1 to 3 decodes the whole rest of the run at another alignment; compressed data has a shift of 0.
    """
    for s in (1, 2, 3):
        raw = _unpadded(body[s:]) if len(body) >= s + 2 else None
        if raw and _SUSPECT.search(raw):
            yield s, s, "base64", iter([raw.decode("utf-8", "surrogateescape")])
    for m in _PACKED.finditer(body, 1):
        if got := _opened(body[m.start() :], window):
            if got[0] != "base64":
                yield m.start(), 0, *got


def _windows(chunks: Iterator[bytes], window: int) -> Iterator[str]:
    decoder, text, most = codecs.getincrementaldecoder("utf-8")("replace"), "", window
    for chunk in chunks:
        text += decoder.decode(chunk)
        if len(text) > most:
            cut = _cut(text, len(text) - window // 8)
            if cut:
                yield text
                text = text[cut:]
            most = max(window, 2 * len(text))
    yield text + decoder.decode(b"", True)


def _cut(text: str, at: int) -> int:
    """A place before at that no secret or layer of the text ahead needs to be seen beyond; 0 if there is none."""
    reach = 1 << 10
    while True:
        low = max(0, at - reach)
        if ends := [m.end() for m in _BREAK.finditer(text, low, at)]:
            return ends[-1]
        # A secret reaches over at most two stretches of spaces.
        if len(tokens := [m.start() for m in _TOKEN.finditer(text, low, at)]) > 4:
            return tokens[-4]
        if not low:
            return 0
        reach *= 4


def _blocks(text: str, window: int) -> Iterator[tuple[list[tuple[int, int]], str, str, Iterator[str]]]:
    """(lines' ranges, body, name, windows) of base64 that is wrapped in lines."""
    for m in _LINES.finditer(text):
        group: list[tuple[int, int]] = []
        for one in _LINE.finditer(text, *m.span()):
            group.append(one.span())
            if text[one.end() - 1] == "=" or one.end() == m.end():
                yield from _block(text, group, window)
                group = []


def _block(text: str, lines: list[tuple[int, int]], window: int) -> Iterator[tuple[list[tuple[int, int]], str, str, Iterator[str]]]:
    bodies = [text[a:z].rstrip("=") for a, z in lines]
    n, i, done = len(lines), 0, 0
    while i < n:
        j = i
        while j + 1 < n and len(bodies[j + 1]) == len(bodies[i]):
            j += 1
        # The first line may stand after other text, the last may be shorter.
        ends = [j + 2, j + 1] if j + 1 < n and len(bodies[j + 1]) < len(bodies[i]) else [j + 1]
        tries = [(max(i - 1, done), e) for e in ends] + [(i, e) for e in ends]
        for a, z in ([(0, n)] if not i else []) + tries:
            if z - a > 1 and (got := _opened(body := "".join(bodies[a:z]), window, strict=True)):
                behind = _after(_unpadded(body) or b"", window)
                if behind and 4 * behind >= 3 * len(bodies[z - 1]) - 4:  # the last line is no part of it
                    continue
                yield lines[a:z], body, *got
                j, done = z - 1, z
                break
        else:
            if j > i and (got := _opened(body := "".join(bodies[i : j + 1]), window)):
                yield lines[i : j + 1], body, *got
        i = j + 1


def _below(name: str, text: str, window: int) -> Iterator[tuple[str, str]]:
    """(name, content) of the layers right inside a decoded one."""
    if name.count(".url") + name.count(".unicode") >= LEVELS:
        if got := _unwound(text):
            yield f"{name}.url", got[0]
        return
    if _PERCENT.search(text):
        yield f"{name}.url", _PERCENT.sub(_percent_run, _PERCENT_CHAIN.sub("%" + "25" * (CHAIN + 1), text))
    if _UNICODE.search(text):
        short = _UNICODE_CHAIN.sub(lambda m: "\\" + text[_chain_cut(m) : m.end()], text)
        yield f"{name}.unicode", _UNICODE.sub(lambda m: "".join(c for c, _, _ in _characters(m)), short)
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        if got := _opened(body, window):
            yield from ((f"{name}.{got[0]}", t) for t in got[1])
        for _, _, how, texts in _shifted(body, window):
            yield from ((f"{name}.{how}", t) for t in texts)
    for _, _, how, texts in _blocks(text, window):
        yield from ((f"{name}.{how}", t) for t in texts)


def _inside(name: str, texts: Iterator[str], window: int) -> set[tuple[str, str]]:
    """(kind, name of the layer) of all findings in a decoded layer and in those inside it."""
    found, seen, stack = set(), set(), [((name, t) for t in texts)]
    while stack:
        got = next(stack[-1], None)
        if got is None:
            stack.pop()
            continue
        key = hashlib.sha256(got[1].encode("utf-8", "surrogatepass")).digest()
        if key not in seen:
            seen.add(key)
            found |= {(kind, got[0]) for kind, _, _ in find(got[1])}
            stack.append(_below(*got, window))
    return found


def scan(text: str, max_inflated: int = 1 << 22) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings, and those that only decoded layers show (kind@layers), both in original code points."""
    base = find(text)
    if not ("%" in text or "\\" in text or _BASE64.search(text) or _LINES.search(text)):
        return base, []
    added: set[tuple[str, int, int]] = set()
    seen: set[tuple] = set()
    known: dict[str, set[tuple[str, str]]] = {}
    # A layer of the whole text: its content, its name, and where each character came from.
    work: list[tuple[str, str, Origin | None]] = [(text, "", None)]
    own = {kind: sorted((a, z) for k, a, z in base if k == kind) for kind in KINDS}

    def origin(spans: Origin | None, a: int, z: int) -> tuple[int, int]:
        return (a, z) if spans is None else (int(spans[0][a]), int(spans[1][z - 1]))

    def add(kind: str, name: str, a: int, z: int) -> None:
        i = bisect_right(own[kind], (a, len(text) + 1)) - 1  # base findings of a kind do not overlap
        if i < 0 or own[kind][i][1] < z:
            added.add((f"{kind}@{name}", a, z))

    def digest(content: str, spans: Origin) -> tuple[bytes, ...]:
        parts = (content.encode("utf-8", "surrogatepass"), *spans)
        return tuple(hashlib.sha256(p).digest() for p in parts)

    def inside(body: str, got: tuple[str, Iterator[str]] | None = None) -> set[tuple[str, str]]:
        if body not in known:
            got = got or _opened(body, max_inflated)
            known[body] = _inside(*got, max_inflated) if got else set()
        return known[body]

    def elsewhere(body: str) -> set[tuple[str, str, int, int]]:
        """(kind, name, from, to) of what a run holds elsewhere than from its first character on; from and to are places in the run."""
        if body not in further:
            found = further[body] = set()
            for start, shift, how, texts in _shifted(body, max_inflated):
                if not shift:
                    found |= {(kind, at, start, len(body)) for kind, at in _inside(how, texts, max_inflated)}
                    continue
                inner = next(texts)
                for kind, a, z in find(inner):
                    if kind == "hex" and len(set(inner[a:z])) < 5:
                        continue
                    a, z = (len(inner[:x].encode("utf-8", "surrogateescape")) for x in (a, z))
                    found.add((kind, how, shift + a // 3 * 4, min(len(body), shift - -z // 3 * 4)))
                # A deeper layer of a wrong alignment would have to be text again, which chance does not give.
                found |= {(kind, at, start, len(body)) for kind, at in _inside(how, iter([inner]), max_inflated) if at != how}
        return further[body]

    further: dict[str, set[tuple[str, str, int, int]]] = {}
    while work:
        content, name, spans = work.pop()
        if name:
            for kind, a, z in find(content):
                add(kind, name, *origin(spans, a, z))
        layers = []
        if name.count(".") >= LEVELS:
            if got := _unwound(content):
                layers.append(("url", *got))
        else:
            if "%" in content and (got := _unpercent(content)):
                layers.append(("url", *got))
            if "\\" in content and (got := _ununicode(content)):
                layers.append(("unicode", *got))
        for how, new, inner in layers:
            to = inner if spans is None else (spans[0][inner[0]], spans[1][inner[1] - 1])
            if (key := digest(new, to)) not in seen:
                seen.add(key)
                work.append((new, f"{name}.{how}".lstrip("."), to))
        runs = {m.span(): inside(m[0].rstrip("=")) for m in _BASE64.finditer(content)}
        for lines, body, how, texts in _blocks(content, max_inflated):
            found = inside(body, (how, texts))
            # What each line shows by itself stays there; what only the block shows counts once, for the block.
            each = set.intersection(*(runs.get(line, set()) for line in lines))
            runs |= {line: runs[line] - (found - each) for line in lines if line in runs}
            runs[lines[0][0], lines[-1][1]] = found - each
        for (a, z), found in runs.items():
            if found and (key := (content[a:z], to := origin(spans, a, z))) not in seen:
                seen.add(key)
                for kind, how in found:
                    add(kind, f"{name}.{how}".lstrip("."), *to)
        for m in _BASE64.finditer(content):
            for kind, how, a, z in elsewhere(m[0].rstrip("=")):
                add(kind, f"{name}.{how}".lstrip("."), *origin(spans, m.start() + a, m.start() + z))
    return base, sorted(added, key=lambda s: (s[1], s[0], s[2]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0].partition("@")[0]), s[0], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """The digest of secrets in each document; n_decoded counts those that only decoding shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, more = scan(text.as_py() or "")
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(_joined(_ordered(base)).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS), digest, _joined(_ordered(base + more)), len(more)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"],
            )

    return docs.select(F.col("doc_id").try_cast("long"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every finding's range in ``text`` replaced by mark; other columns pass through."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base, more = scan(text)
                    done = len(text) + 1
                    for _, a, z in sorted(base + more, key=lambda s: (-s[2], s[1])):
                        z = min(z, done)
                        if a < z:
                            text, done = text[:a] + mark + text[z:], a
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
