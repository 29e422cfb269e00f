"""Token counts by a compiled transducer whose transitions carry the number of emitted tokens.

A vocabulary of byte pairs with word ends is compiled into two machines.

* The *splitter* walks character classes (letter, number, space, other) and cuts a text into pieces.
* The *counter* reads the symbols of a piece. After each prefix its encoding ends in exactly one token,
  so its state is the last token of every prefix that a longer token can still reach back to. Taking
  token ``b`` after the prefix that ends in ``a`` is a transition that emits one token; it exists if and
  only if merging the symbols of ``a`` and ``b`` gives back ``a`` and ``b``. Transitions are compiled on
  first use and kept.

Both machines fall back to their start at white space, so the state map of a chunk of text is short: the
unfinished front up to its first space, the tokens emitted between, and the unfinished end. Maps compose
associatively (:func:`compose`), which is how the chunks of a long text are put together.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import stow

#: Code points of a chunk; longer texts are cut into chunks that several tasks may count.
CHUNK = 1 << 16
#: White space as the splitter's pattern takes it (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_GAP = regex.compile(f"[{_SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")
#: Suffixes that stand alone after an apostrophe (fixed values), longest checked in this order.
_CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")
_PIECE = regex.compile(rf"[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_KEPT = 1 << 21


def _byte_names() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(free)
            free += 1
    return [names[b] for b in range(256)]


class Transducer:
    """Counts tokens of texts under one vocabulary file; transitions are compiled as texts need them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this compiler reads byte pairs with word ends over lower-cased text")
        self.end = model["end_of_word_suffix"]
        self.vocab = {t: i for i, t in enumerate(model["vocab"])}
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.names = _byte_names()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole: dict[str, bool] = {}
        self.edges: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    # ---- compiling transitions

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.end)
        out = list(bare)
        if bare is not token and len(bare) < len(token) and out:
            out[-1] += self.end
        return out

    def _merge(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _reachable(self, token: str) -> bool:
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = token in self.vocab and self._merge(self._symbols(token)) == [token]
        return got

    def _edge(self, a: str, b: str) -> bool:
        got = self.edges.get((a, b))
        if got is None:
            if len(self.edges) > _KEPT:
                self.edges.clear()
            got = self.edges[a, b] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return got

    # ---- running

    def piece(self, text: str) -> int:
        """Tokens of one piece of normalised text."""
        got = self.pieces.get(text)
        if got is not None:
            return got
        s = "".join(map(self.names.__getitem__, text.encode("utf-8", "surrogatepass")))
        n = len(s)
        last: list[str] = [""] * (n + 1)
        emitted = [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                token = s[j:i] if i < n else s[j:i] + self.end
                if token in self.vocab and self._reachable(token) and (not j or self._edge(last[j], token)):
                    last[i], emitted[i] = token, emitted[j] + 1
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {text[:40]!r}")
        if len(self.pieces) > _KEPT:
            self.pieces.clear()
        if n <= 64:
            self.pieces[text] = emitted[n]
        return emitted[n]

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        else:
            text = text.lower()
        total, i, n = 0, 0, len(text)
        while i < n:
            if text[i] == "'":
                tail = next((c for c in _CLITICS if text.startswith(c, i + 1)), None)
                if tail:
                    total += self.piece("'" + tail)
                    i += 1 + len(tail)
                    continue
            m = _PIECE.match(text, i)
            if m is None:  # a control that separates for the pattern's space class only
                i += 1
                continue
            total += self.piece(m.group())
            i = m.end()
        return total

    def run(self, text: str) -> int:
        """Tokens of a run without white space."""
        got = self.runs.get(text)
        if got is not None:
            return got
        if self.special is not None and self.special.search(text):
            total = len(self.special.findall(text)) + sum(self._plain(p) for p in self.special.split(text) if p)
        else:
            total = self._plain(text)
        if len(self.runs) > _KEPT:
            self.runs.clear()
        if len(text) <= 64:
            self.runs[text] = total
        return total

    def split(self, text: str) -> list[str]:
        return _GAP.split(text) if _ODD.search(text) else text.split()

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        known, total = self.runs.get, 0
        for r in self.split(text):
            if r:
                n = known(r)
                total += self.run(r) if n is None else n
        return total

    def state_map(self, text: str) -> tuple[str, int, str | None]:
        """A chunk's map: unfinished front, tokens emitted after it, unfinished end (None: no space in it)."""
        gap = _GAP.search(text)
        if gap is None:
            return text, 0, None
        head, rest = text[: gap.start()], text[gap.end() :]
        cut = 0
        for m in _GAP.finditer(rest):
            cut = m.end()
        return head, self.count(rest[:cut]), rest[cut:]

    def finish(self, m: tuple[str, int, str | None]) -> int:
        """Tokens of a text from its map."""
        return self.count(m[0]) + m[1] + (self.count(m[2]) if m[2] else 0)


def compose(t: Transducer, a: tuple, b: tuple) -> tuple:
    """The map of two chunks in a row; associative."""
    if a[2] is None:
        return (a[0] + b[0], b[1], b[2])
    if b[2] is None:
        return (a[0], a[1], a[2] + b[0])
    return (a[0], a[1] + t.count(a[2] + b[0]) + b[1], b[2])


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of a vocabulary file, once per worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``path`` names the vocabulary file on every executor. Special strings in a text count as one token
    each, and none is added. Null counts as empty: no bytes, no tokens. Texts of over ``CHUNK`` code
    points are cut into chunks; every chunk gives its state map, and the maps of a text are composed in
    order. Rows are told apart by a number of their own, so repeated rows and null ids each keep theirs;
    other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    n = F.expr(f"greatest(1, cast(ceil(char_length(text) / {CHUNK}D) as int))")
    chunks = rows.withColumn("of", n).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        "row", "doc_id", "of", "at", F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("of") == 1, F.col("text")).otherwise(F.expr(f"substring(text, at * {CHUNK} + 1, {CHUNK})")).alias("part"),
    )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for batch in batches:
            of = batch.column(2).to_pylist()
            out = [(None, t.count(batch.column(5)[i].as_py()), None) if of[i] == 1 else t.state_map(batch.column(5)[i].as_py()) for i in range(len(of))]
            heads, counts, tails = zip(*out) if out else ((), (), ())
            types = (pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([*batch.columns[:5], *[pa.array(list(c), k) for c, k in zip((heads, counts, tails), types)]], names=["row", "doc_id", "of", "at", "n_bytes", "head", "n", "tail"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for batch in batches:
            done = []
            for parts in batch.column(2).to_pylist():
                done.append(t.finish(reduce(lambda a, b: compose(t, a, b), [(p["head"], p["n"], p["tail"]) for p in parts])))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(done, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    mapped = stow(chunks.mapInArrow(maps, "row long, doc_id long, of int, at int, n_bytes long, head string, n long, tail string"), "maps")
    short = mapped.where("of = 1").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    parts = F.sort_array(F.collect_list(F.struct("at", "head", "n", "tail"))).alias("parts")
    long_ = mapped.where("of > 1").groupBy("row", "doc_id", "n_bytes").agg(parts).select("doc_id", "n_bytes", "parts")
    long_ = long_.mapInArrow(composed, "doc_id long, n_bytes long, n_tokens long")
    return short.unionByName(long_).withColumn("over_limit", F.col("n_tokens") > limit)
