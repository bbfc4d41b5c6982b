"""Main text of web pages by a recurrent block labeller (operator 10).

A page is the sequence of its leaf blocks. Each block is a vector of its tag
path (tags and the parts of class and id names of the open elements, hashed),
its words (hashed) and a few measures; a bidirectional LSTM in numpy reads the
sequence, so that every block is labelled with the whole page as context. The
network is trained on invented pages whose labels are known by construction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.bytehash import words
from gradewell.llm.html_blocks import BLOCK_TAGS, Block, blocks
from gradewell.llm.html_pages import PageMaker

NAME_DIMS, WORD_DIMS, MEASURES, HIDDEN = 96, 24, 8, 20
TRAINING_PAGES, EPOCHS, SEED = 900, 8, 11
#: Pages are labelled together while they have so many blocks, padding included, and read together while they have so many
#: characters; a longer page is labelled alone. Block vectors are made for so many blocks at a time, so what a page takes is its
#: blocks and a few hundred bytes for each.
CELLS = 32_768
BATCH_CHARS = 4_000_000
STRETCH = 8192
_TAG_AT = {t: i for i, t in enumerate(BLOCK_TAGS)}
PATH_DIMS = 2 * len(BLOCK_TAGS) + NAME_DIMS
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES
RESULT = "page_id long, url string, text string, n_chars long"


def _path_vector(path: tuple) -> np.ndarray:
    """Open elements' tags, the innermost tag, and hashed parts of their names."""
    v = np.zeros(PATH_DIMS, dtype=np.float32)
    for tag, names in path:
        v[_TAG_AT[tag]] = 1
        for name in names:
            h = zlib.crc32(name.encode())
            v[2 * len(BLOCK_TAGS) + h % NAME_DIMS] += 1 if h >> 16 & 1 else -1
    if path:
        v[len(BLOCK_TAGS) + _TAG_AT[path[-1][0]]] = 1
    return np.clip(v, -2, 2)


def vectors(flat: list[Block], place: np.ndarray, paths: dict) -> np.ndarray:
    """A row for each block; ``place`` is where it stands in its page, from 0 to 1."""
    out = np.zeros((len(flat), INPUTS), dtype=np.float32)
    if not flat:
        return out
    for i, b in enumerate(flat):
        v = paths.get(b.path)
        if v is None:
            if len(paths) > 20_000:
                paths.clear()
            v = paths[b.path] = _path_vector(b.path)
        out[i, :PATH_DIMS] = v
    h, at = words([b.text for b in flat])
    n = np.maximum(np.diff(at), 1)
    block = np.repeat(np.arange(len(flat)), np.diff(at))
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(block * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), weights=sign, minlength=len(flat) * WORD_DIMS)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = hashed.reshape(len(flat), WORD_DIMS) / n[:, None]
    chars = np.array([len(b.text) for b in flat], dtype=np.float32)
    m = PATH_DIMS + WORD_DIMS
    out[:, m] = np.log1p(chars) / 5
    out[:, m + 1] = np.minimum(1, np.array([b.linked for b in flat]) / chars)
    out[:, m + 2] = np.log1p(n) / 4
    out[:, m + 3] = [min(1.0, 10 * sum(map(b.text.count, ".,;!?")) / len(b.text)) for b in flat]
    out[:, m + 4] = [b.text[-1] in ".!?" for b in flat]
    out[:, m + 5] = ["©" in b.text for b in flat]
    out[:, m + 6] = place
    out[:, m + 7] = [len(b.path) / 8 for b in flat]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Labeller:
    """Bidirectional LSTM with one output for each place; gates are ordered input, forget, cell, output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (r.standard_normal((INPUTS, 4 * HIDDEN)) * 0.08).astype(np.float32)
            self.w[f"h{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"b{d}"] = bias
        self.w["o"] = (r.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.w["c"] = np.zeros(1, dtype=np.float32)

    def _gates(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.w[f"x{d}"] + self.w[f"b{d}"]

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """gates: (time, pages, 4 * HIDDEN); states of all places; with ``keep`` what the gradient needs."""
        steps, pages = mask.shape
        h = np.zeros((pages, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out, tape = np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 3))
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            on = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, g, o, th, on))
            c = np.where(on, new, c)
            h = np.where(on, o * th, h)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._logits({d: self._gates(x, d) for d in "fb"}, mask)

    def _logits(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        ways = [self._run(gates[d], mask, d, False)[0] @ self.w["o"][k * HIDDEN : (k + 1) * HIDDEN] for k, d in enumerate("fb")]
        return ways[0] + ways[1] + self.w["c"][0]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(self._gates(x, d), mask, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        error = (_sigmoid(states @ self.w["o"] + self.w["c"][0]) - y) * mask / mask.sum()
        grads = {"o": np.einsum("tp,tph->h", error, states), "c": np.array([error.sum()])}
        for k, d in enumerate("fb"):
            from_out = error[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32)
            dh_next = np.zeros((mask.shape[1], HIDDEN), dtype=np.float32)
            dc_next = np.zeros_like(dh_next)
            dwh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, g, o, th, on in reversed(runs[d][1]):
                dh = dh_next + from_out[t]
                dc = (dc_next + dh * o * (1 - th**2)) * on
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g**2), dh * th * o * (1 - o) * on], axis=1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh_next = dz @ self.w[f"h{d}"].T + np.where(on, 0, dh)
                dc_next = np.where(on, dc * f, dc_next)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads |= {f"x{d}": x.reshape(-1, x.shape[2]).T @ flat, f"h{d}": dwh, f"b{d}": flat.sum(axis=0)}
        return grads

    def content(self, pages: list[list[Block]], paths: dict) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        found: list[np.ndarray] = [np.zeros(len(p), dtype=bool) for p in pages]
        some: list[int] = []
        for i in sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])):
            if some and (len(some) + 1) * len(pages[i]) > CELLS:
                self._label(pages, some, paths, found)
                some = []
            some.append(i)
        if some:
            self._label(pages, some, paths, found)
        return found

    def _label(self, pages: list[list[Block]], some: list[int], paths: dict, found: list[np.ndarray]) -> None:
        lengths = [len(pages[i]) for i in some]
        mask = np.arange(max(lengths))[:, None] < np.array(lengths)
        page, step = np.nonzero(mask.T)  # of each block of these pages
        flat = pages[some[0]] if len(some) == 1 else [b for i in some for b in pages[i]]
        gates = {d: np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32) for d in "fb"}
        for k in range(0, len(flat), STRETCH):
            own = slice(k, k + STRETCH)
            rows = vectors(flat[own], step[own] / np.array(lengths)[page[own]], paths)
            for d in "fb":
                gates[d][step[own], page[own]] = self._gates(rows, d)
        z = self._logits(gates, mask)
        for j, i in enumerate(some):
            found[i] = z[: lengths[j], j] > 0


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x = np.zeros((steps, len(rows), INPUTS), dtype=np.float32)
    mask = np.zeros((steps, len(rows)), dtype=bool)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
        mask[: len(r), j] = True
    return x, mask


def labelled_page(source: str) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a page of PageMaker: the marks move with the text and are taken off."""
    found, labels, inside, out = [], [], False, False
    # marks stand next to tags, so each is a text of its own or the edge of one
    for b in blocks(source.replace("\x01", "<hr>\x01<hr>").replace("\x04", "<hr>\x04<hr>").replace("\x02", "<hr>\x02<hr>").replace("\x03", "<hr>\x03<hr>")):
        if b.text in ("\x01", "\x04"):
            inside = b.text == "\x01"
        elif b.text in ("\x02", "\x03"):
            out = b.text == "\x02"
        else:
            found.append(b)
            labels.append(inside and not out)
    return found, np.array(labels, dtype=np.float32)


@cache
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained with Adam on invented pages; the same for the same numbers."""
    maker, paths = PageMaker(seed), {}
    data = [labelled_page(maker.page()) for _ in range(pages)]
    rows = [vectors(b, np.arange(len(b)) / len(b), paths) for b, _ in data]
    model, r = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    order, step = sorted(range(pages), key=lambda i: len(rows[i])), 0
    groups = [order[k : k + 30] for k in range(0, pages, 30)]
    for epoch in range(epochs):
        for g in r.permutation(len(groups)):
            x, mask = _padded([rows[i] for i in groups[g]])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, i in enumerate(groups[g]):
                y[: len(data[i][1]), j] = data[i][1]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for k, grad in model.gradient(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html; other columns are not read): ``RESULT``.

    The main text's blocks in page order, joined by two line ends; character
    references are decoded, white space inside a block is one space. Null and
    empty html and pages without main text give an empty text. No block is
    dropped or cut for its length, and pages of any length are read whole, in
    memory that follows their blocks and not their neighbours'. Repeated rows
    give the same text each; an empty table gives an empty result.
    """
    model = model or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths: dict = {}
        for batch in batches:
            size = batch["html"].str.len().fillna(0).astype(np.int64).cumsum() // BATCH_CHARS
            for _, part in batch.groupby(size.to_numpy(), sort=False):
                found = [blocks(None if pd.isna(h) else h) for h in part["html"]]
                kept = model.content(found, paths)
                texts = ["\n\n".join(b.text for b, on in zip(p, c.tolist(), strict=True) if on) for p, c in zip(found, kept, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, RESULT)
