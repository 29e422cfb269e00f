"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINT = re.compile("|".join(_either(w) for w in ("passw", "secret", "token", "key")))
#: A maximal run of at least so many characters is the leftmost match of the whole run.
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")

#: Character class of a candidate, window length, least bits a symbol in a window.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
}
#: Least length of a candidate; one shorter than a window is judged as one window of its own length.
SHORT = 16
#: What a part of a URL may consist of: quotes, brackets, commas and other marks around a URL end it.
_PART = r"""[^\s"'`<>(){}\[\],;|\\^=&?#/@]"""
#: Strings that look random and are public: identifiers, digests named as such, host and plain path of a URL,
#: placeholders, alphabets. A group ``quiet`` is the part of the match that is silenced.
ALLOWED = (
    r"(?i:sha(?:1|256|384|512)[-:])[A-Za-z0-9+/=]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    # no user and password, nothing from a web hook's name on, no query and no fragment
    rf"""(?i:https?://)(?:[^\s"'`<>/?#@]*@)?(?P<quiet>(?!hooks?\.){_PART}+(?:/(?!(?i:(?:web)?hooks?|services)/){_PART}*)*)""",
    r"(?<![A-Za-z0-9+/_=-])(?i:[A-Z0-9+/_=-]*(?:example|placeholder|0123456789|abcdefghij)[A-Z0-9+/_=-]*)",
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


_TERM = [0.0, 0.0] + [c * math.log2(c) for c in range(2, 65)]


def hot_windows(s: str, width: int, bits: float, digits: int = 0) -> list[tuple[int, int]]:
    """Merged windows of ``width`` characters with at least ``bits`` of Shannon entropy and ``digits`` digits.

    One character enters and one leaves per step; ``load`` keeps the sum of c log2 c over the counts.
    """
    counts: dict[str, int] = {}
    load, nums, out, most = 0.0, 0, [], math.log2(width) - bits + 1e-9
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        load += _TERM[c + 1] - _TERM[c]
        nums += "0" <= ch <= "9"
        if i >= width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            load += _TERM[c - 1] - _TERM[c]
            nums -= "0" <= old <= "9"
        if i >= width - 1 and nums >= digits and load / width <= most:
            b = i - width + 1
            if out and b <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((b, i + 1))
    return out


def _hot(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Hot windows of a candidate; a short one is a window of its own, with ``bits`` in proportion to the most it can have."""
    if len(s) < width:
        width, bits = len(s), bits * math.log2(len(s)) / math.log2(width)
    return hot_windows(s, width, bits)


def _candidates(alphabet: str) -> re.Pattern:
    one = "[" + re.escape(alphabet) + "]"
    return re.compile(f"(?<!{one}){one}{{{SHORT},}}")


def _outside(b: int, e: int, quiet: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of ``b`` to ``e`` that no sorted span of ``quiet`` covers, if long enough for a candidate."""
    for x, y in quiet[max(0, bisect_right(quiet, (b,)) - 1) :]:
        if x >= e:
            break
        if x - b >= SHORT:
            yield b, x
        b = max(b, y)
    if e - b >= SHORT:
        yield b, e


def _clear(span: tuple[int, int], others: Sequence[tuple]) -> bool:
    return all(span[1] <= o[-2] or o[-1] <= span[0] for o in others)


class Scanner:
    """Spans of one text at a time; ``allow`` are patterns whose matches are cut out of the candidates."""

    def __init__(self, allow: Sequence[str] = ALLOWED, classes: dict = CLASSES):
        self.allow = [re.compile(p) for p in allow]
        self.classes = [(kind, _candidates(a), w, bits) for kind, (a, w, bits) in classes.items()]

    def _quiet(self, text: str) -> list[tuple[int, int]]:
        spans = sorted(m.span("quiet" if "quiet" in p.groupindex else 0) for p in self.allow for m in p.finditer(text))
        out: list[tuple[int, int]] = []
        for b, e in spans:
            if out and b <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((b, e))
        return out

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        quiet = None
        for kind, runs, width, bits in self.classes:
            for m in runs.finditer(text):
                if quiet is None:
                    quiet = self._quiet(text)
                for x, y in _outside(*m.span(), quiet):
                    for b, e in _hot(text[x:y], width, bits):
                        span = (x + b, x + e)
                        if _clear(span, base) and _clear(span, out):
                            out.append((kind, *span))
        return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan_secrets(docs: DataFrame, allow: Sequence[str] = ALLOWED) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind. ``base_sha256``
    digests those of the fixed patterns; ``spans`` also has the entropy spans: windows of candidate
    strings of one character class whose entropy is high, merged where they overlap, unless they touch
    a fixed span. Matches of the allow-list are cut out of the candidates first. Null and empty texts have no spans; every row, repeated
    or with a null id, gives one row. A text is scanned whole by one task, in memory of its own length;
    one entropy window costs one step per character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allow)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                base = base_spans(text)
                added = scanner.added(text, base)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
