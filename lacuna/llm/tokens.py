"""Token ids of whole texts by a public tokenizer, with a bounded cache of encoded chunks in each Python worker.

Byte-level and word-level BPE tokenise every run of non-space characters by itself, given the one blank in front of it, a
single newline between such runs by itself, and a run of signs at the end of one apart from the letter or digit before it.
A text is therefore cut at single blanks and newlines that stand between non-space characters and before such signs, each
distinct chunk is encoded by the library once, and a text's ids are those of its chunks in turn. Longer white space stays
inside a chunk, so the cut never changes an id.

Cutting, hashing and gathering work on the bytes of many texts at once with numpy. A chunk is known by two 64-bit hashes of
different byte tables: the first one finds it and the second one is compared at every occurrence; a chunk that differs in
it is encoded by itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import mix

_ENCODERS: dict[str, Encoder] = {}
#: Chunks that the cache holds before it starts anew, and the longest chunk (in bytes) that is kept.
CACHE_CHUNKS = 600_000
CACHE_BYTES = 64
#: Characters of the texts that are cut together; longer texts are cut in pieces of about that length.
GROUP_CHARS = 1_000_000
_BREAK = re.compile(r"(?<=\S)[ \n](?=\S)")
#: White space of Unicode beyond ASCII, in UTF-8, by pieces that are searched for first.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = np.array([b == 0x20 or 9 <= b <= 13 or 0x1C <= b <= 0x1F for b in range(256)])
_SIGN = np.array([chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_TABLES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]))
    return _POWERS


class Chunks:
    """The chunks of texts: start and end in `data`, whether a blank stands before them, hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        text_end = np.cumsum(lens + 1) - 1
        text_start, between = text_end - lens, text_end[:-1]
        space = _SPACE[raw]
        if any(w in self.data for w in _WIDE):
            for m in _WIDE_SPACE.finditer(self.data):
                space[m.start() : m.end()] = True
        space[between] = True
        alone = (raw == 0x20) | (raw == 0x0A)
        alone[between] = False
        alone[1:] &= ~space[:-1]
        alone[:-1] &= ~space[1:]
        if len(raw):
            alone[0] = alone[-1] = False
        cuts, some = np.flatnonzero(alone), lens > 0
        lines = cuts[raw[cuts] == 0x0A]
        start = np.concatenate([cuts + 1, lines, text_start[some]])
        blank = np.concatenate([raw[cuts] == 0x20, np.zeros(len(lines) + int(some.sum()), bool)])
        order = np.argsort(start, kind="stable")
        start, blank = start[order], blank[order]
        end = np.sort(np.concatenate([cuts, lines + 1, text_end[some]]))
        # before the signs at a chunk's end
        core = np.maximum.accumulate(np.where(_SIGN[raw], 0, np.arange(1, len(raw) + 1)))[end - 1] if len(end) else end
        last = raw[core - 1]
        letter = _ALNUM[last] | _LATIN[last] & (raw[np.maximum(core - 2, 0)] == 0xC3) & (core - 2 >= start)
        tails = core[(core < end) & (core > start) & letter]
        order = np.argsort(np.concatenate([start, tails]), kind="stable")
        self.start = np.concatenate([start, tails])[order]
        self.blank = np.concatenate([blank, np.zeros(len(tails), bool)])[order]
        self.end = np.sort(np.concatenate([end, tails]))
        self.first = np.searchsorted(self.start, text_start)
        self.last = np.searchsorted(self.start, text_end)
        self.first_hash, self.second_hash = self._hashed(raw, np.concatenate([cuts[raw[cuts] == 0x20], between]))

    def _hashed(self, raw: np.ndarray, outside: np.ndarray) -> list[np.ndarray]:
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * 2
        power, inverse = _powers(len(raw) + 1)
        out = []
        for table in _TABLES:
            values = table[raw]
            values *= power[: len(raw)]
            values[outside] = 0
            h = np.add.reduceat(values, self.start) * inverse[self.start]
            out.append(mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + self.blank * table[7]))
        return out


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit integers, without any special token.

    `known` holds the first hashes in order and `at` the places of their chunks in the arrays `second` (hashes) and `edge`
    (ranges of `held`, the ids).
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.word_end, self.word_start = self._word_edges()
        self._forget()

    def _forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.second, self.edge, self.held = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _word_edges(self) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Whether an id ends a word, for a vocabulary that marks ends; whether it starts one, where blanks are kept as signs."""
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        edges = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            edges[i] = token.endswith(mark) if mark else token.startswith("\u0120")
        return (edges, None) if mark else (None, edges if edges.any() else None)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that all have a blank in front, and where each word's ids end; None if their marks don't tell."""
        ids = np.array(self._encode([f" {' '.join(words)}"])[0], "<u4")
        if self.word_end is not None:
            stops = np.flatnonzero(self.word_end[ids]) + 1
        else:
            starts = np.flatnonzero(self.word_start[ids])
            stops = np.append(starts[1:], len(ids)) if len(starts) and starts[0] == 0 else starts[:0]
        return (ids, stops) if len(stops) == len(words) else None

    def _hold(self, chunks: Chunks, at: np.ndarray) -> np.ndarray:
        """Encode the chunks at these places and append them to the arrays; where they stand there.

        Words of letters alone with a blank in front are encoded many at a time.
        """
        if not len(at):
            return at
        data = chunks.data
        bodies = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(chunks.start[at].tolist(), chunks.end[at].tolist(), strict=True)]
        alpha = np.fromiter(map(str.isalpha, bodies), bool, len(bodies))
        if self.word_end is None:  # white space counts
            alpha &= chunks.blank[at] if self.word_start is not None else False
        words, rest = np.flatnonzero(alpha), np.flatnonzero(~alpha).tolist()
        order, ids, lens = [], [], []
        for k in range(0, len(words), 512):
            group = words[k : k + 512].tolist()
            if (found := self._together([bodies[j] for j in group])) is None:
                rest += group
                continue
            order += group
            ids.append(found[0])
            lens.append(np.diff(found[1], prepend=0))
        blank = chunks.blank[at]
        made = self._encode([f" {bodies[k]}" if blank[k] else bodies[k] for k in rest])
        ids.append(np.array([i for m in made for i in m], "<u4"))
        lens.append(np.array([len(m) for m in made], np.int64))
        place = np.empty(len(at), np.int64)
        place[order + rest] = np.arange(len(self.second), len(self.second) + len(at))
        self.second = np.concatenate([self.second, chunks.second_hash[at[order + rest]]])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.concatenate(lens))])
        self.held = np.concatenate([self.held, *ids])
        return place

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owners, group, size = [], [], 0
        for i, piece in ((i, p) for i, t in enumerate(texts) if t for p in _pieces(t)):
            if group and size + len(piece) > GROUP_CHARS:
                for k, ids in zip(owners, self._group(group), strict=True):
                    out[k].append(ids)
                owners, group, size = [], [], 0
            owners.append(i)
            group.append(piece.encode("utf-8", "surrogatepass"))
            size += len(piece)
        for k, ids in zip(owners, self._group(group), strict=True):
            out[k].append(ids)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        chunks = Chunks(texts)
        if not len(chunks.start):
            return [b""] * len(texts)
        keys, first, of = np.unique(chunks.first_hash, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        place = np.where(self.known[near] == keys, self.at[near], -1) if len(self.known) else np.full(len(keys), -1)
        fresh = np.flatnonzero(place < 0)
        short = (chunks.end - chunks.start)[first[fresh]] <= CACHE_BYTES
        kept, long = fresh[short], fresh[~short]
        place[kept] = self._hold(chunks, first[kept])
        n_kept = len(self.second)
        place[long] = self._hold(chunks, first[long])
        own = place[of]
        differ = np.flatnonzero(self.second[own] != chunks.second_hash)
        own[differ] = self._hold(chunks, differ)
        lens = (self.edge[1:] - self.edge[:-1])[own]
        bounds = np.concatenate([[0], np.cumsum(lens)])
        ids = self.held[np.arange(bounds[-1]) + np.repeat(self.edge[own] - bounds[:-1], lens)]
        self.second, self.edge = self.second[:n_kept], self.edge[: n_kept + 1]
        self.held = self.held[: self.edge[-1]]
        known, at = np.concatenate([self.known, keys[kept]]), np.concatenate([self.at, place[kept]])
        order = np.argsort(known, kind="stable")  # two ordered runs
        self.known, self.at = known[order], at[order]
        return [ids[a:b].tobytes() for a, b in zip(bounds[chunks.first].tolist(), bounds[chunks.last].tolist(), strict=True)]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about GROUP_CHARS; each but the first begins with the single blank or newline that parts them."""
    lo = 0
    while len(text) - lo > GROUP_CHARS and (m := _BREAK.search(text, lo + GROUP_CHARS)):
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:] if lo else text


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept for the worker's life."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
