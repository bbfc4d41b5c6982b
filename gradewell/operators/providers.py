"""Model calls behind small interfaces, with deterministic stand-ins (OP-014, 015, 141 to 146, 14A, 14F to 14H)."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A failed call is tried again so often, after so many seconds and that much more each time.
RETRIES, PAUSE = 2, 2.0


class Reply(NamedTuple):
    text: str
    thinking: str = ""
    prompt_tokens: int = 0
    reply_tokens: int = 0


class EmbeddingProvider(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class ChatProvider(Protocol):
    def chat(self, system: str, user: str, json_format: bool = False) -> Reply: ...


class TokenizerProvider(Protocol):
    def encode(self, text: str) -> list[int]: ...


class TextProvider(Protocol):
    def text(self, data: bytes) -> str: ...


class LetterEmbedding:
    """Stand-in: how often each of the first letters of the alphabet occurs, at unit length."""

    def __init__(self, letters: str = "abcdefgh"):
        self.letters = letters

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.array([[t.count(c) for c in self.letters] for t in texts], dtype=float).reshape(len(texts), len(self.letters))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def prompt_number(system: str, user: str) -> int:
    """What a stand-in knows of a prompt."""
    return int(hashlib.md5((system + user).encode()).hexdigest()[:8], 16)


def one_hint(n: int) -> str:
    return json.dumps({"hints": [{"level": "macro", "text": f"Look at part {n % 97} of the task again."}]})


class EchoChat:
    """Stand-in: answers made from the prompt's number; every ``fail_every``-th prompt fails.

    With ``moods`` some prompts get their answer fenced, some only in the
    thinking trace, and both are empty where JSON was asked for.
    """

    def __init__(self, answer: Callable[[int], str] = one_hint, fail_every: int = 0, moods: bool = False):
        self.answer, self.fail_every, self.moods = answer, fail_every, moods

    def chat(self, system: str, user: str, json_format: bool = False) -> Reply:
        n = prompt_number(system, user)
        if self.fail_every and n % self.fail_every == 0:
            raise ConnectionError("no answer")
        text, mood = self.answer(n), n % 4 if self.moods else 0
        counts = len((system + " " + user).split()), len(text.split())
        if mood in (1, 2) and json_format:
            return Reply("", "", *counts)
        if mood == 1:
            return Reply(f"Here it is:\n```json\n{text}\n```", "", *counts)
        if mood == 2:
            return Reply("", f"I would say {text} is right", *counts)
        return Reply(text, "", *counts)


class HashTokenizer:
    """Stand-in: one id for each white-space word."""

    def __init__(self, size: int = 50_000):
        self.size = size

    def encode(self, text: str) -> list[int]:
        return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.size for w in text.split()]


def embed(rows: DataFrame, text: str, make: Callable[[], EmbeddingProvider | None], batch: int = 8):
    """``rows`` with ``embedding``, null without a provider.

    The provider is made once a partition, sees small batches, and each text of
    an Arrow batch once.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for texts in batches:
            texts = texts.fillna("")
            if provider is None:
                yield pd.Series([None] * len(texts), dtype=object)
                continue
            known = texts.drop_duplicates().tolist()
            parts = [provider.encode(known[k : k + batch]) for k in range(0, len(known), batch)]
            memo = dict(zip(known, np.concatenate(parts), strict=True)) if parts else {}
            yield texts.map(memo)

    return rows.withColumn("embedding", run(F.col(text)))


def embed_cached(rows: DataFrame, text: str, cache: DataFrame, make: Callable[[], EmbeddingProvider | None]) -> tuple[DataFrame, DataFrame]:
    """Read-through by content: rows with embeddings, and the new cache entries (content_key, embedding) to append."""
    from gradewell.functions.text import content_key

    keyed = rows.withColumn("content_key", content_key(F.col(text)))
    missing = keyed.select("content_key", text).dropDuplicates(["content_key"]).join(cache, "content_key", "left_anti")
    new = embed(missing, text, make).select("content_key", "embedding")
    return keyed.join(cache.unionByName(new), "content_key").drop("content_key"), new


def document_texts(files: DataFrame, content: str, make: Callable[[], TextProvider]) -> DataFrame:
    """``files`` with ``text``: each distinct content of a batch is parsed once; what can't be parsed is empty."""
    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            memo: dict[bytes, str] = {}
            for data in batch[content]:
                data = b"" if data is None else bytes(data)
                if data not in memo:
                    try:
                        memo[data] = provider.text(data)
                    except Exception:  # noqa: BLE001 - whatever a parser raises, the document is empty
                        memo[data] = ""
            yield batch.assign(text=[memo[b"" if d is None else bytes(d)] for d in batch[content]])

    return files.mapInPandas(run, schema)


def _called(provider: ChatProvider, system: str, user: str, retries: int, pause: float) -> tuple[Reply | None, str | None, int]:
    problem = None
    for k in range(retries + 1):
        try:
            return provider.chat(system, user), None, k + 1
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is a row's error
            problem = f"{type(e).__name__}: {e}"
            if pause and k < retries:
                time.sleep(pause * (k + 1))
    return None, problem, retries + 1


def chat(rows: DataFrame, system: str, user: str, make: Callable[[], ChatProvider], retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """``rows`` with answer, error, attempts and token counts: a failed call is data and never stops the others."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", answer string, error string, attempts int, prompt_tokens long, reply_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            found = [_called(provider, s or "", u or "", retries, pause) for s, u in zip(batch[system], batch[user], strict=True)]
            replies = [r or Reply("") for r, _, _ in found]
            yield batch.assign(answer=[r.text if r else None for r, _, _ in found], error=[e for _, e, _ in found], attempts=[n for _, _, n in found], prompt_tokens=[r.prompt_tokens for r in replies], reply_tokens=[r.reply_tokens for r in replies])

    return rows.mapInPandas(run, schema)


def json_object(text: str) -> dict | None:
    """The object that a text is, without a fence around it, or that its outermost braces hold."""
    text = text.strip()
    bare = text.removeprefix("```").removesuffix("```").removeprefix("json").strip()
    for part in (text, bare, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def chat_json(rows: DataFrame, system: str, user: str, make: Callable[[], ChatProvider]) -> DataFrame:
    """``rows`` with answer (a JSON object), via and error.

    Asked for JSON first, then freely; an empty reply's thinking trace counts as
    the reply. ``via`` is json, free or thinking.
    """
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", answer string, via string, error string"

    def ask(provider: ChatProvider, s: str, u: str) -> tuple[str | None, str | None, str | None]:
        problem = None
        for as_json in (True, False):
            try:
                reply = provider.chat(s, u, as_json)
            except Exception as e:  # noqa: BLE001
                problem = f"{type(e).__name__}: {e}"
                continue
            found = json_object(reply.text or reply.thinking)
            if found is not None:
                return json.dumps(found, ensure_ascii=False), "json" if as_json else "free" if reply.text else "thinking", None
            problem = "no JSON object in the reply" if reply.text or reply.thinking else "empty reply"
        return None, None, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            found = [ask(provider, s or "", u or "") for s, u in zip(batch[system], batch[user], strict=True)]
            yield batch.assign(answer=[a for a, _, _ in found], via=[v for _, v, _ in found], error=[e for _, _, e in found])

    return rows.mapInPandas(run, schema)


def route(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose answer parses as JSON, and the dead letters with their error."""
    parsed = answered.withColumn("parses", F.try_parse_json("answer").isNotNull())
    bad = parsed.where(~F.coalesce("parses", F.lit(False))).withColumn("error", F.coalesce("error", F.lit("answer is no JSON")))
    return parsed.where("parses").drop("parses"), bad.drop("parses")


def template_ids(output: Any) -> list[int]:
    """The ids in whatever a chat template returns: ids, one object with ids or input_ids, or a mapping with (nested) input_ids."""
    first = output[0] if isinstance(output, list) and output else None
    for name in ("ids", "input_ids"):
        if first is not None and hasattr(first, name):
            return list(getattr(first, name))
    if isinstance(output, list):
        return list(output)
    if hasattr(output, "keys") and "input_ids" in output:
        ids = output["input_ids"]
        return list(ids[0] if len(ids) and isinstance(ids[0], list) else ids)
    raise TypeError(f"a chat template returned {type(output).__name__}")


def apply_template(tokenizer: Any, messages: list[dict[str, str]], **options: Any) -> Any:
    """The tokenizer's chat template with those options that it takes."""
    takes = inspect.signature(tokenizer.apply_chat_template).parameters
    return tokenizer.apply_chat_template(messages, **{k: v for k, v in options.items() if k in takes})


class WordTemplate:
    """Stand-in: a chat template over HashTokenizer; ``shape`` is one of the forms that templates return."""

    def __init__(self, shape: str = "flat"):
        self.shape, self.words = shape, HashTokenizer()

    def apply_chat_template(self, messages: list[dict[str, str]], add_generation_prompt: bool = False) -> Any:
        ids = [i for m in messages for i in self.words.encode(f"<{m['role']}> {m['content']}")] + (self.words.encode("<assistant>") if add_generation_prompt else [])
        return {"flat": ids, "mapping": {"input_ids": ids}, "nested": {"input_ids": [ids]}}[self.shape]


def inference_ids(system: str, user: str, make: Callable[[], Any]) -> Column:
    """Ids of a prompt ready to be continued, of two columns."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer = make()
        for some, other in batches:
            pairs = zip(some.fillna(""), other.fillna(""), strict=True)
            made = [apply_template(tokenizer, [{"role": "system", "content": s}, {"role": "user", "content": u}], add_generation_prompt=True, reasoning_effort="low") for s, u in pairs]
            yield pd.Series([template_ids(x) for x in made], dtype=object)

    return run(system, user)


def training_rows(samples: DataFrame, make: Callable[[], TokenizerProvider], max_length: int) -> DataFrame:
    """``samples`` (sample_id, prompt, target) -> input_ids, attention_mask, labels: cut on the left, prompt labels -100."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for texts in batches:
            yield texts.fillna("").map(tokenizer.encode)

    ids = samples.select("sample_id", encode("prompt").alias("p"), encode("target").alias("t"))
    whole = ids.select("sample_id", F.concat("p", "t").alias("ids"), F.concat(F.transform("p", lambda _: F.lit(-100)), F.col("t")).alias("labels"))

    def tail(c: str):
        n = F.least(F.size(c), F.lit(max_length))
        return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)

    cut = whole.select("sample_id", tail("ids").alias("input_ids"), tail("labels").alias("labels"))
    return cut.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
