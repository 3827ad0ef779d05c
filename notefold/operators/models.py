"""Stages backed by a language model: chunk by chunk, combined in a tree, with failures kept as values.

The model is a small interface; ``EchoModel`` is its deterministic stand-in for tests. A client is made once per
partition. A failed call never ends the job: its row has null text and an ``error``.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.markdown import filled, merged_sections, model_answer, translated
from notefold.operators.chunk import chunks
from notefold.session import materialise


# What is asked of a model for quick reading and for telling dialogues, and the note in a failed translation's place.
QUICK_READ = """请基于下面论文内容生成一篇中文速读笔记。

论文标题：{title}
来源路径：{path}
页数：{pages}

要求：
1. 用中文输出 Markdown，不要输出思考过程。
2. 先做“翻译式速读”：保留论文问题、方法、实验、结论、局限和关键术语。
3. 必须包含这些二级标题：`## 中文速读`、`## 一句话概括`、`## 速读摘要`、`## 思维导图`、`## 值得精读的理由`、`## 待核验`、`## 全文翻译`。
4. `## 思维导图` 使用纯 Mermaid mindmap 代码块，只保留层级结构；不要输出 `%%{init}%%`、`theme`、`style`、`classDef`、`class`、`linkStyle`、颜色、图标或 HTML 样式。
5. `## 全文翻译` 必须放在文件末尾，按原文顺序保留可读中文翻译；公式、表格、图示或引用不确定时，用 `[公式待核验]`、`[表格待核验]`、`[图示待核验]` 标注，不要编造。
6. 如果输入内容疑似被截断，在 `## 待核验` 和 `## 全文翻译` 开头说明。

论文文本：

```text
{text}
```"""
IS_DIALOGUE = (
    "你是一个文本分析助手。请判断以下转录文本是否属于对话/访谈/多人讨论类型。不要输出思考过程，只回复一个字：「是」或「否」。如果无法判断，回复「否」。\n"
    "判断依据：是否出现明显的多人轮流发言特征，如问答交替、观点交锋、不同语气或立场切换、明显的说话人切换等。\n\n转录文本片段：\n"
)
NOT_TRANSLATED = "> 全文翻译生成失败，请重新运行或使用 prompt-only 模式。"


class CutShort(ValueError):
    """An empty answer because the token budget was used up."""


class TextModel(Protocol):
    """Text in, text out. Where a budget is set, ``complete(prompt, budget)`` is called."""

    def complete(self, prompt: str) -> str: ...


class EchoModel:
    """Answers with the prompt's first line and a hash; fails on prompts that hold ``FAIL``."""

    def complete(self, prompt: str) -> str:
        if "FAIL" in prompt:
            raise RuntimeError("refused")
        return f"## {prompt.strip().splitlines()[0][:40] if prompt.strip() else 'empty'}\n\n{hashlib.sha256(prompt.encode()).hexdigest()[:12]}"


class OcrBackend(Protocol):
    """Image in, text out; the first backend of a chain whose answer isn't empty counts."""

    def read(self, image: bytes) -> str: ...


def asked(prompts: DataFrame, model: Callable[[], TextModel], prompt: str = "prompt", retries: int = 2, delay: float = 0.0, budget: int | None = None, cap: int = 32_768) -> DataFrame:
    """``prompts`` with ``answer`` and ``error``; each call is tried ``retries`` times more, a blank answer being a failure.

    Before the k-th of these ``delay * 2 ** (k - 1)`` seconds pass. A token ``budget`` at least doubles, up to ``cap``, with
    each answer that it cuts short (``CutShort``).
    """
    names = prompts.columns

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            answers, errors = [], []
            for text in batch[prompt]:
                answer, error, tokens = None, None, budget
                for k in range(1 + retries):
                    if k and delay:
                        time.sleep(delay * 2 ** (k - 1))
                    try:
                        said = client.complete(text) if tokens is None else client.complete(text, tokens)
                        if not (said or "").strip():
                            raise ValueError("empty answer")
                        answer, error = said, None
                        break
                    except Exception as e:  # the failure is the row's value
                        error = f"{type(e).__name__}: {e}"
                        if isinstance(e, CutShort) and tokens is not None:
                            tokens = max(tokens, min(cap, max(2 * tokens, tokens + 1024)))
                answers.append(answer)
                errors.append(error)
            yield batch.assign(answer=answers, error=errors)[[*names, "answer", "error"]]

    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(call, f"{fields}, answer string, error string")


def quick_read_prompt(title: Column, path: Column, pages: Column, text: Column) -> Column:
    """What is asked of a model for a quick-read note; usable by hand, too."""
    put = {"title": title, "path": path, "pages": pages.cast("string"), "text": text}
    parts = re.split(r"\{(title|path|pages|text)\}", QUICK_READ)
    return F.concat(*(F.coalesce(put[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def with_translation(notes: DataFrame, id_col: str, markdown_col: str, text_col: str, prompt: str, model: Callable[[], TextModel], limit: int = 16_000) -> DataFrame:
    """``id, text, n_chunks, n_failed``: notes without a full translation get one, made chunk by chunk of ``text_col``.

    ``prompt`` is put before each chunk. If a chunk fails, a line saying so stands in the translation's place: none is
    passed off as whole.
    """
    own = notes.select(F.col(id_col).alias("id"), F.col(markdown_col).alias("markdown"), F.col(text_col).alias("source"), F.coalesce(translated(F.col(markdown_col)), F.lit(False)).alias("done"))
    parts = chunks(own.where("not done"), "id", "source", limit, style="plain").withColumn("prompt", F.concat(F.lit(prompt + "\n\n"), "text"))
    said = asked(parts.select("id", "chunk_no", "prompt"), model)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.trim("answer").alias("a")))), lambda x: x["a"])
    made = said.groupBy("id").agg(F.array_join(ordered, "\n\n").alias("made"), F.count("*").alias("n_chunks"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    whole = F.when(F.col("n_failed") == 0, F.col("made")).otherwise(NOT_TRANSLATED)
    bare = F.trim(F.coalesce("markdown", F.lit("")))
    text = F.concat_ws("\n\n", F.nullif(bare, F.lit("")), F.lit("## 全文翻译"), whole)
    return own.join(made, "id", "left").select("id", F.when(F.col("done"), bare).otherwise(text).alias("text"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_failed")])


def dialogues(texts: DataFrame, id_col: str, text_col: str, model: Callable[[], TextModel], sample: int = 3_000) -> DataFrame:
    """``id, is_dialogue`` by a model's view of each text's head, asked once; any failure means no."""
    prompts = texts.select(F.col(id_col).alias("id"), F.concat(F.lit(IS_DIALOGUE), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, sample)).alias("prompt"))
    return asked(prompts, model, retries=0).select("id", F.coalesce(F.col("answer").contains("是"), F.lit(False)).alias("is_dialogue"))


def read_images(images: DataFrame, chain: list[Callable[[], OcrBackend]]) -> DataFrame:
    """``path, text, error`` of images by the first backend that gives text; all errors joined if none does."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backends = [make() for make in chain]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                text, errors = None, []
                for backend in backends:
                    try:
                        text = backend.read(bytes(content)).strip() or None
                    except Exception as e:
                        errors.append(f"{type(e).__name__}: {e}")
                    if text:
                        break
                rows.append((path, text, None if text else "; ".join(errors) or "no text"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return images.select("path", "content").mapInPandas(call, "path string, text string, error string")


def organised(notes: DataFrame, id_col: str, text_col: str, model: Callable[[], TextModel], limit: int, overlap: int, window: int, depth: int = 2) -> DataFrame:
    """``id, text, n_chunks, n_failed``: notes mapped chunk by chunk, then combined round by round.

    A round joins a note's parts in order into windows of at most ``window`` signs and lets the model combine each; after
    ``depth`` rounds, or once one part is left, the parts are joined as they are. Equal sections are merged at the end.
    """
    parts = asked(chunks(notes, id_col, text_col, limit, overlap).withColumnRenamed("text", "prompt"), model)
    parts = materialise(parts.select("id", F.col("chunk_no").alias("no"), model_answer(F.col("answer")).alias("text"), F.col("error").isNotNull().cast("int").alias("failed")), "parts")
    counts = parts.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum("failed").alias("n_failed"))
    current = parts.where("text is not null").select("id", "no", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    none = F.array().cast("array<string>")

    def windows(texts):
        fits = lambda acc, t: F.coalesce(F.length(F.try_element_at(acc, F.lit(-1))) + F.length(t) + 2 <= window, F.lit(False))
        longer = lambda acc, t: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n\n"), t)))
        return F.aggregate(texts, none, lambda acc, t: F.when(fits(acc, t), longer(acc, t)).otherwise(F.concat(acc, F.array(t))))

    for _ in range(depth):
        packed = current.groupBy("id").agg(windows(ordered).alias("w"))
        many = packed.where("size(w) > 1").select("id", F.posexplode("w").alias("no", "prompt"))
        combined = asked(many, model).select("id", "no", F.coalesce(model_answer(F.col("answer")), "prompt").alias("text"))
        current = materialise(combined.unionByName(packed.where("size(w) = 1").select("id", F.lit(0).alias("no"), F.element_at("w", 1).alias("text"))), "combined")
    whole = current.groupBy("id").agg(merged_sections(F.array_join(ordered, "\n\n")).alias("text"))
    return counts.join(whole, "id", "left").select("id", "text", "n_chunks", "n_failed")


def placeholders_filled(notes: DataFrame, id_col: str, text_col: str, prompts: dict[str, str], model: Callable[[], TextModel]) -> DataFrame:
    """``id, text, n_filled, n_failed``: each placeholder of a note answered by the model; a failure leaves its placeholder.

    ``prompts`` maps a placeholder to the prompt put before the note's text.
    """
    own = notes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = F.array_compact(F.array(*(F.when(F.col("text").contains(p), F.struct(F.lit(p).alias("placeholder"), F.concat(F.lit(q + "\n\n"), F.col("text")).alias("prompt"))) for p, q in prompts.items())))
    calls = own.select("id", F.explode(wanted).alias("x")).select("id", "x.*")
    done = asked(calls, model).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNull(), F.struct("placeholder", "answer")))).alias("answers"),
        F.count_if(F.col("error").isNull()).alias("n_filled"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
    )
    joined = own.join(done, "id", "left")
    text = F.col("text")
    for p in prompts:
        text = filled(text, p, F.try_element_at("answers", F.lit(p)))
    return joined.select("id", text.alias("text"), F.coalesce("n_filled", F.lit(0)).alias("n_filled"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
