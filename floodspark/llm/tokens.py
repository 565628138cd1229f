"""Token counts of whole texts with a byte-level BPE tokenizer file.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
boundary that both show: the start of a pre-token that is neither among the first two of the later
chunk nor near the end of the earlier. The splitting pattern looks at the text ahead only, so
from such a boundary on both chunks must agree, up to the later chunk's end. Where no boundary is
common (one very long run), the later chunk starts earlier by three times the overlap, at last at the
earlier chunk's own last sure boundary.

A space between two characters that are no white space always starts a pre-token, so texts and chunks
are counted piece by piece between such spaces, and a bounded cache saves encoding pieces again; a piece that is a word followed by punctuation is counted as these two. A batch's
distinct pieces are encoded many at once, joined by spaces: only a piece's first token begins with a space. A word of
Latin letters is one pre-token, which the tokenizer's model takes as it is. Texts with other white space next to a space are encoded as they are. Null and empty texts have no
tokens; repeated rows count alike; further columns are ignored; an empty table gives no rows. Ids are
whole numbers, a null one stays null.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

CHUNK, OVERLAP, MARGIN = 1 << 15, 1 << 9, 64
CACHE, BATCH = 100_000, 1 << 20
#: Pieces that are encoded as one text.
JOINED = 256

#: A word and what follows it: a letter and one of these marks never share a pre-token.
_WORD_AND_MORE = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,./:;<=>?@\[\\\]^`{|}~-].*)""", re.DOTALL)
#: Marks that most often end a piece.
_MARKS = "!),.:;?"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        # Without its post-processor, which adds tokens that are not counted and trims spaces off the offsets.
        out = Tokenizer.from_str(json.dumps(json.load(f) | {"post_processor": None}))
    out.no_truncation()
    out.no_padding()
    return out


@cache
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@cache
def after_space(path: str) -> np.ndarray:
    """Of each token id, whether the token begins with a space (which byte-level tokenizers write as Ġ)."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(vocab.values(), default=0) + 1 + len(specials(path)), bool)
    out[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
    return out


@cache
def letters(path: str) -> dict[int, str]:
    """Latin letters beyond ASCII as the tokenizer's model takes them, by code point."""
    pre = tokenizer(path).pre_tokenizer
    return {c: "".join(part for part, _ in pre.pre_tokenize_str(chr(c))) for c in range(128, 256) if chr(c).isalpha()}


def _by_pieces(path: str) -> bool:
    """Whether the tokenizer splits before a lone space."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j["pre_tokenizer"] or {}
    return (
        j["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(" " in s or s[:1].isalpha() or t["lstrip"] or t["rstrip"] for t in j["added_tokens"] for s in [t["content"]])
    )


def _sure(c: str) -> bool:
    return c.isalnum() or (c.isprintable() and not c.isspace())


def _latin(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or max(piece) <= "ÿ")


def _regular(piece: str) -> bool:
    """Neither empty nor with white space, or what might count as such, at an end."""
    return bool(piece) and _sure(piece[0]) and _sure(piece[-1])


@contextmanager
def _uncollected() -> Iterator[None]:
    """No passes of the cyclic collector meanwhile: strings and counts form no cycles, but new ones by the thousand start it."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Counter:
    """Counts tokens of texts, with the counts of pieces seen before in two generations."""

    def __init__(self, path: str) -> None:
        self.path, self.pieces = path, _by_pieces(path)
        self.new: dict[str, int | None] = {}
        self.old: dict[str, int | None] = {}
        self.tails: dict[str, int] = {}
        self.margin = max([MARGIN, *(2 * len(s) for s in specials(path))])

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, pieces: list[str]) -> list[int]:
        """Tokens of regular pieces, each with the space before it."""
        out, begins = [], after_space(self.path)
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, e in zip(groups, tokenizer(self.path).encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids)
            starts = np.flatnonzero(begins.take(ids, mode="clip"))
            if len(starts) == len(group) and not starts[0]:
                out += np.diff(starts, append=len(ids)).tolist()
            else:
                out += self.lengths([" " + p for p in group])
        return out

    def words(self, words: list[str]) -> list[int]:
        """Tokens of words of Latin letters, each with the space before it."""
        tokenize, beyond = tokenizer(self.path).model.tokenize, letters(self.path)
        return [len(tokenize("Ġ" + (w if w.isascii() else w.translate(beyond)))) for w in words]

    def learn(self, pieces: set[str]) -> None:
        """From here on self.new has the pieces' counts, each with the space before it; None: not regular."""
        missing = pieces.difference(self.new)
        if len(self.new) + len(missing) > CACHE:
            self.old, self.new, missing = self.new, {}, pieces
        if len(self.tails) > CACHE:
            self.tails = {}
        seen = missing & self.old.keys()
        self.new.update(zip(seen, map(self.old.__getitem__, seen)))
        whole, words, split = set(), set(), {}
        for p in missing - seen:
            if p.isalpha():
                (words if _latin(p) else whole).add(p)
            elif _latin(head := p.rstrip(_MARKS)):
                split[p] = head, p[len(head) :]
            elif not p or not _sure(p[-1]):
                self.new[p] = None
            elif m := _WORD_AND_MORE.fullmatch(p):
                split[p] = m.groups()
            elif _sure(p[0]):
                whole.add(p)
            else:
                self.new[p] = None
        for head in {head for head, _ in split.values()}.difference(self.new):
            if head in self.old:
                self.new[head] = self.old[head]
            else:
                words.add(head)
        words = list(words)
        self.new.update(zip(words, self.words(words)))
        whole = list(whole)
        self.new.update(zip(whole, self.spaced(whole)))
        tails = {t for _, t in split.values()}.difference(self.tails)
        self.tails.update(zip(tails, self.lengths(list(tails))))
        self.new.update((p, self.new[head] + self.tails[tail]) for p, (head, tail) in split.items())

    def encoded(self, text: str, base: int) -> tuple[dict[int, int], int]:
        """Of a chunk: its pre-token starts but the first ones, each with the tokens before it; all its tokens."""
        if self.pieces:
            first, *rest = text.split(" ")
            self.learn(set(rest))
            counts = [self.new[p] for p in rest]
            if None not in counts and (_regular(first) if first else not base):
                sums = list(accumulate(counts, initial=self.lengths([first])[0]))
                places = accumulate((len(p) + 1 for p in rest), initial=base + len(first))
                return dict(list(zip(places, sums))[2:-1]), sums[-1]
        e = tokenizer(self.path).encode(text, add_special_tokens=False)
        ids, offsets = e.word_ids, e.offsets
        at = [i for i in range(len(ids)) if not i or ids[i] is None or ids[i] != ids[i - 1]]
        return {base + offsets[i][0]: i for i in at[2:]}, len(ids)

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text, from chunks of it."""
        n = len(text)
        at, end = 0, min(n, chunk + overlap)
        (starts, size), skip, total = self.encoded(text[at:end], at), 0, 0
        while end < n:
            # What stands near this chunk's end may change with the text that follows.
            sure = {p: i for p, i in ({at: 0} | starts).items() if p <= end - self.margin and i >= skip}
            own = max(sure, default=at)
            start, wider, z = end - overlap, overlap, min(n, end + chunk)
            while True:
                if start <= at:
                    start = p = own
                    z = max(z, min(n, 2 * end - p + chunk))
                    later, behind = self.encoded(text[start:z], start), 0
                    break
                later = self.encoded(text[start:z], start)
                p = next((p for p in sorted(later[0]) if p in sure), None)
                if p is not None:
                    behind = later[0][p]
                    break
                wider *= 3
                start -= wider
            total += sure[p] - skip if p in sure else 0
            (starts, size), at, skip, end = later, start, behind, z
        return total + size - skip

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        plain, split = [], []
        for i, text in enumerate(texts):
            if len(text) > CHUNK + OVERLAP:
                out[i] = self.huge(text)
            elif self.pieces:
                first, *rest = text.split(" ")
                if first and not _regular(first):
                    plain.append(i)
                else:
                    split.append((i, first, rest))
            else:
                plain.append(i)
        if split:
            self.learn(set().union(*(rest for _, _, rest in split)))
            for (i, _, rest), head in zip(split, self.lengths([first for _, first, _ in split])):
                try:
                    out[i] = head + sum(map(self.new.__getitem__, rest))
                except TypeError:
                    plain.append(i)
        for i, n in zip(plain, self.lengths([texts[i] for i in plain])):
            out[i] = n
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each document; path: the tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            ids, column, i = batch.column(0).cast(pa.int64()), batch.column(1), 0
            sizes = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
            while i < len(column):
                j, size = i, 0
                while j < len(column) and (j == i or size + sizes[j] <= BATCH):
                    size += sizes[j]
                    j += 1
                with _uncollected():
                    n = counter([x or "" for x in column.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(sizes[i:j], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
                i = j

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
