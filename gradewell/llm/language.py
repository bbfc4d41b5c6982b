"""Hierarchical language identification (operator 5).

Languages whose letter sequences are alike form a family. Linear support vector
machines first tell the families apart (one against the rest); inside a family
one machine for each pair of languages votes. Features are the shares of hashed
letter pairs and triples, word edges included, so a margin is a sum over the
places of a text and texts of any length are read whole in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.samples import sample_ids, sample_texts

#: The model is fitted on at most so many labelled texts a language, of at most so many characters together;
#: with more languages than four each gets its share of SAMPLE_ROWS texts, one at least.
SAMPLE_PER_LANGUAGE = 800
SAMPLE_ROWS = 3200
SAMPLE_CHARS = 8_000_000
BITS = 13
PIECE_CHARS = 400_000
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def places(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all letter pairs and triples, and the text that each belongs to."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join([f"\0{t}\0" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) + 2 for t in texts])
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    one = codes * _A
    two = (one[:-1] + codes[1:] * _B) ^ np.uint32(0x5BD1E995)
    three = one[:-2] + codes[1:-1] * _B + codes[2:] * _C
    shift = np.uint32(32 - BITS)
    whole = []
    for h, real in ((two, (codes[:-1] != 0) | (codes[1:] != 0)), (three, codes[1:-1] != 0)):
        at = np.flatnonzero(real)
        h = h[at]
        h = (h ^ (h >> np.uint32(15))) * _C >> shift
        whole.append((h, np.searchsorted(ends, at, side="right")))
    return np.concatenate([h for h, _ in whole]), np.concatenate([t for _, t in whole])


def shares(texts: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for i, t in enumerate(texts):
        h, _ = places([t])
        out[i] = np.bincount(h, minlength=1 << BITS) / max(len(h), 1)
    return out


def _svm(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, reg: float = 1e-4) -> np.ndarray:
    """Pegasos on the hinge loss; y is -1 or 1; the weights' last is the bias. Classes count alike."""
    x = np.column_stack([x * 30, np.ones(len(x), dtype=np.float32)])
    w, rng, step = np.zeros(x.shape[1]), np.random.default_rng(seed), 0
    sides = [np.flatnonzero(y == s) for s in (-1, 1)]
    for _ in range(epochs * max(1, len(x) // 32)):
        step += 1
        at = np.concatenate([rng.choice(s, 16) for s in sides])
        bad = at[y[at] * (x[at] @ w) < 1]
        rate = 1 / (reg * (step + 200))
        w *= 1 - rate * reg
        if len(bad):
            w += rate / len(at) * (y[bad, None] * x[bad]).sum(axis=0)
    return np.concatenate([w[:-1] * 30, w[-1:]])


@dataclass
class LanguageModel:
    families: list[list[str]]
    weights: np.ndarray  # a column for each family, then one for each pair of languages in each family
    slopes: np.ndarray

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """Of each machine for each text; long texts are read in pieces that end where a word does."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            while at < len(t) or not at:
                cut = len(t)
                if cut - at > PIECE_CHARS:
                    space = t.rfind(" ", at + 1, at + PIECE_CHARS)
                    cut = space if space > at else at + PIECE_CHARS
                pieces.append(t[at:cut])
                owner.append(i)
                at = max(cut, 1)
        sums, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        first = 0
        while first < len(pieces):
            last, size = first, 0
            while last < len(pieces) and (last == first or size + len(pieces[last]) <= PIECE_CHARS):
                size += len(pieces[last])
                last += 1
            h, t = places(pieces[first:last])
            who = np.array(owner[first:last])[t]
            n += np.bincount(who, minlength=len(texts))
            for m in range(sums.shape[1]):
                sums[:, m] += np.bincount(who, weights=self.weights[:-1, m][h], minlength=len(texts))
            first = last
        return sums / np.maximum(n, 1)[:, None] + self.weights[-1]

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.slopes, -30, 30)))
        count = len(self.families)
        of_family = p[:, :count] / np.maximum(p[:, :count].sum(axis=1, keepdims=True), 1e-12)
        names, scores, at = [], [], count
        for f, langs in enumerate(self.families):
            votes = np.zeros((len(texts), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                votes[:, a] += p[:, at]
                votes[:, b] += 1 - p[:, at]
                at += 1
            share = votes / np.maximum(votes.sum(axis=1, keepdims=True), 1e-12) if len(langs) > 1 else np.ones((len(texts), 1))
            best = share.argmax(axis=1)
            names.append([langs[i] for i in best])
            scores.append(of_family[:, f] * (share[np.arange(len(texts)), best] if len(langs) <= 2 else np.minimum(1, share[np.arange(len(texts)), best] * len(langs) / 2)))
        pick = of_family.argmax(axis=1)
        return [names[f][i] for i, f in enumerate(pick)], np.array([scores[f][i] for i, f in enumerate(pick)])


def _families(langs: list[str], means: np.ndarray) -> list[list[str]]:
    """Complete-link merging of the languages' mean shares into about the square root of their number."""
    unit = np.sqrt(means)  # shares' square roots have unit length
    like, groups = unit @ unit.T, [[i] for i in range(len(langs))]
    while len(groups) > max(1, round(len(langs) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda g: (min(like[i, j] for i in groups[g[0]] for j in groups[g[1]]), -g[0], -g[1]))
        groups[a] += groups.pop(b)
    return [sorted(langs[i] for i in g) for g in groups]


def fit(labelled: list[tuple[int, str, str]]) -> LanguageModel | None:
    """From (doc_id, language, text); None without any text that has letters."""
    labelled = [x for x in labelled if any(c.isalpha() for c in x[2])]
    if not labelled:
        return None
    y = np.array([lang for _, lang, _ in labelled])
    x = shares([t for _, _, t in labelled])
    langs = sorted(set(y.tolist()))
    families = _families(langs, np.stack([x[y == lang].mean(axis=0) for lang in langs]))
    tasks = []
    for f in families:
        inside = np.isin(y, f)
        tasks.append((np.ones(len(y), dtype=bool), np.where(inside, 1, -1)))
    for f in families:
        tasks += [(np.isin(y, (a, b)), np.where(y == a, 1, -1)) for a, b in combinations(f, 2)]
    weights, slopes = [], []
    for k, (rows, side) in enumerate(tasks):
        if len(set(side[rows].tolist())) < 2:  # one family only
            weights.append(np.concatenate([np.zeros(x.shape[1]), [30.0]]))
            slopes.append(1.0)
            continue
        w = _svm(x[rows], side[rows].astype(np.float64), k)
        m = side[rows] * (x[rows] @ w[:-1] + w[-1])
        weights.append(w)
        slopes.append(4.0 / max(np.median(np.abs(m)), 1e-6))
    return LanguageModel(families, np.stack(weights, axis=1), np.array(slopes))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fitted on a bounded sample of the rows with a language that aren't held out."""
    rows = docs.where(~held_out() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"))
    return fit(sample_texts(docs, sample_ids(rows, per_language, total=SAMPLE_ROWS), SAMPLE_CHARS))


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang; other columns are not read): doc_id, held_out, lang_pred, score.

    Texts are read whole; those of more than PIECE_CHARS in pieces that end at a
    space, or inside a run that is longer itself, where two letter triples are
    then read without their neighbours. Null texts and those without a letter
    are ``und`` with score 0, and so is every text if there is nothing to learn
    from. Every language that a row with a text names is learned. Repeated rows
    get the same answer each; a null doc_id isn't held out. An empty table gives
    an empty result.
    """
    model = train(docs)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for texts in batches:
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            known = [] if model is None else [i for i, t in enumerate(texts.tolist()) if t and letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")].any()]
            if known:
                found, sure = model.predict([texts.iat[i] for i in known])
                names[known], scores[known] = found, sure
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict("text").alias("p"))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")
