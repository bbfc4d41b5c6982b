"""Exact, memoised encoding with a public word-level BPE vocabulary.

The vocabulary's pre-tokeniser never joins text across white space and its
normaliser works character by character, so the ids of a text are the ids of
its runs (words, single digits, punctuation) in order. Latin-1 texts are cut
into runs with array operations, each distinct run of a batch is merged once,
and its ids are copied to all its places. The merging is done by ``tiktoken``, whose merge loop is given the vocabulary's merges
as ranks: a run carries a NUL as its word end, and the 256 pairs (byte, NUL)
get the lowest ranks, so that the word end joins its byte before any other
merge. Chunks with characters beyond Latin-1 or with control characters go to
the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np
import regex

from gradewell.llm.bytehash import buffer, hash_runs

_SPACES = re.compile(r"[ \t\n\r\f\v]+")
#: Chunks of these characters are in NFC already and lower-case one to one.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
#: Fixed value: the vocabulary's own pre-tokenisation pattern.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin-1 bytes for which the pattern isn't a matter of single characters' classes.
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\xa0']")
_END = "</w>"


def _latin_classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each Latin-1 character: 0 space, 1 letter, 2 number, 3 other; and its lower case."""
    kind, low = np.full(256, 3, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if c in " \t\n\r\f\v":
            kind[b] = 0
        elif regex.fullmatch(r"\p{L}", c):
            kind[b] = 1
            low[b] = ord(c.lower())
        elif regex.fullmatch(r"\p{N}", c):
            kind[b] = 2
    return kind, low


_KIND, _LOW = _latin_classes()
_ENCODERS: dict[str, ChunkEncoder] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: symbol -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkEncoder:
    """Text -> little-endian unsigned 16-bit ids (the vocabulary has 49,408)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids of this vocabulary need more than 16 bits")

        def raw(token: str) -> bytes:
            end = token.endswith(_END)
            return bytes(symbols[c] for c in (token[: -len(_END)] if end else token)) + b"\0" * end

        order = [c + _END for c in symbols] + list(symbols)
        order += ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.ids = np.array([vocab[t] for t in order], dtype="<u2")
        self.ends = np.array([t.endswith(_END) for t in order])
        self.merger = tiktoken.Encoding("runs", pat_str=r"[^\x00]+\x00", mergeable_ranks={raw(t): i for i, t in enumerate(order)}, special_tokens={})

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _merge(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs in order, and where each run's ids stop."""
        ranks = self.merger.encode_to_numpy("\0".join([*runs, ""]))
        return self.ids[ranks], np.flatnonzero(self.ends[ranks]) + 1

    def _latin(self, parts: list[bytes]) -> list[bytes]:
        """Of Latin-1 texts: each distinct run is merged once, then its ids are copied to all its places."""
        buf, text_at = buffer(parts, b" ")
        kind, buf = _KIND[buf], _LOW[buf]
        kind[text_at[-1] :] = 0
        change = kind[1:] != kind[:-1]
        number = kind[1:] == 2
        starts = np.flatnonzero((kind[1:] != 0) & (change | number)) + 1
        if kind[0]:
            starts = np.concatenate([[0], starts])
        stops = np.flatnonzero((kind[:-1] != 0) & (change | (kind[:-1] == 2))) + 1
        if not len(starts):
            return [b""] * len(parts)
        _, first, which = np.unique(hash_runs(buf, starts, stops - starts), return_index=True, return_inverse=True)
        body = buf.tobytes()
        ids, ends = self._merge([body[a:b].decode("latin-1") for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)])
        begins = np.concatenate([[0], ends[:-1]])
        counts = (ends - begins)[which]
        out_stop = np.cumsum(counts)
        gather = np.repeat(begins[which] - (out_stop - counts), counts) + np.arange(out_stop[-1])
        out = ids[gather].tobytes()
        edges = np.concatenate([[0], out_stop])[np.searchsorted(starts, text_at)] * 2
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _mixed(self, text: str) -> bytes:
        """Of any text, by white-space chunks."""
        out: list[bytes] = []
        for c in _SPACES.split(text):
            if not c:
                continue
            if _PLAIN.fullmatch(c):
                out.append(self._merge(_RUNS.findall(c.lower()))[0].tobytes())
            else:
                out.append(self._by_library(c))
        return b"".join(out)

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        found: list[bytes] = [b""] * len(texts)
        latin, where = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                b = None
            if b is None or _ODD.search(b):
                found[i] = self._mixed(t)
            else:
                latin.append(b)
                where.append(i)
        if latin:
            for i, ids in zip(where, self._latin(latin), strict=True):
                found[i] = ids
        return found


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
