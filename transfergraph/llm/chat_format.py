"""Operator 4, chat formatting: whole conversations are rendered and encoded once; the loss mask comes from token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pa_schema, slices, table

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A tokenizer's vocabulary has a fixed size; a file above this bound is not sent to the tasks.
TOKENIZER_BYTES = 64 << 20
#: Conversations that are encoded together.
BATCH = 64
#: Or fewer, once their texts have so many characters.
BATCH_CHARS = 4 << 20


@dataclass(frozen=True)
class Template:
    """Each turn is `open` role `middle` text `close`; these three and `extra` are control strings, which no rendered text holds.

    `extra` should name the tokenizer's own special tokens, which a text could otherwise set.

    A backslash in a text is doubled and a control string gets one after its first character, so unescape() is exact.
    """

    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    extra: tuple[str, ...] = ("<s>", "<|endoftext|>")
    loss_role: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.extra)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The conversation, and the (start, end) code points of the texts that bear loss, ascending."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.open}{self.escape(role)}{self.middle}", self.escape(text)
            at += len(head)
            if role == self.loss_role:
                spans.append((at, at + len(body)))
            at += len(body) + len(self.close)
            parts += (head, body, self.close)
        return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        turn = re.compile(f"{re.escape(self.open)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.close)}", re.S)
        return [(self.unescape(role), self.unescape(text)) for role, text in turn.findall(rendered)]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token whose offsets lie in a span, by binary search of the sorted spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), np.int8)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return ((at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 0] < offsets[:, 1])).astype(np.int8)


def masked_text(rendered: str, offsets: np.ndarray, mask: np.ndarray, template: Template) -> str:
    """The unescaped text under the mask: runs of masked tokens, each piece of text once."""
    on = offsets[mask == 1]
    if not len(on):
        return ""
    new = np.concatenate(([True], on[1:, 0] > on[:-1, 1]))  # tokens that share a character overlap
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(on)) - 1
    return "".join(template.unescape(rendered[on[a, 0] : on[b, 1]]) for a, b in zip(first, ends, strict=True))


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str, controls: tuple[str, ...]) -> Tokenizer:
    made = Tokenizer.from_str(vocabulary)
    made.add_special_tokens(list(controls))  # a token never crosses a control string, so turns begin and end between tokens
    return made


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array a row, without a Python object for each value."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<tinyint>"


def _format(done: list[tuple[object, list[tuple[str, str]]]], tokenizer: Tokenizer, template: Template) -> pa.RecordBatch:
    drawn = [template.render(turns) for _, turns in done]
    codes = tokenizer.encode_batch([t for t, _ in drawn], add_special_tokens=False)
    offsets = [np.fromiter(chain.from_iterable(c.offsets), np.int32).reshape(-1, 2) for c in codes]
    masks = [loss_mask(at, spans) for at, (_, spans) in zip(offsets, drawn, strict=True)]
    columns = [
        pa.array([conv for conv, _ in done], pa.int64()), pa.array([len(turns) for _, turns in done], pa.int64()), pa.array([t for t, _ in drawn], pa.string()),
        _lists([np.array(c.ids, np.int32) for c in codes], pa.int32()), _lists([x[:, 0] for x in offsets], pa.int32()), _lists([x[:, 1] for x in offsets], pa.int32()), _lists(masks, pa.int8()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "formatted", "ids", "starts", "ends", "mask"])


def _formatted(turns: DataFrame, tokenizer_path: str, template: Template, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Format in one pass over the sorted turns, and hand each batch on to `then` in the same task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    if len(vocabulary) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} is over {TOKENIZER_BYTES} bytes")
    sent = turns.sparkSession.sparkContext.broadcast(vocabulary)

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value, template.controls)
        done: list[tuple[object, list[tuple[str, str]]]] = []
        held = 0
        for batch in batches:
            for part in slices(batch, 5000):
                for conv, role, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if not done or done[-1][0] != conv:
                        if len(done) >= BATCH or held >= BATCH_CHARS:
                            yield _format(done, tokenizer, template)
                            done, held = [], 0
                        done.append((conv, []))
                    done[-1][1].append((role or "", text or ""))
                    held += len(text or "")
        if done:
            yield _format(done, tokenizer, template)

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(lambda batches: then(batched(batches)), schema)


def format_conversations(turns: DataFrame, tokenizer_path: str = DEFAULT_TOKENIZER, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, ids, starts, ends, mask): one row per conversation.

    turns: conv_id, turn, role, text; other columns are not read. Rows go by turn (null first), equal turns by role and text;
    repeated rows are turns too. A null role or text is empty; rows without a conv_id are one conversation; an empty table gives no rows.
    Rows are dealt by conv_id and sorted by Spark, which spills; a task holds BATCH conversations or BATCH_CHARS characters, and one
    conversation at least, at a time: a very long one is one row of the result and needs its room.
    """
    return _formatted(turns, tokenizer_path, template or Template(), lambda batches: batches, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _digest(batch: pa.RecordBatch, template: Template) -> Iterator[tuple]:
    for conv, text, starts, ends, mask in zip(*(batch.column(k) for k in ("conv_id", "formatted", "starts", "ends", "mask")), strict=True):
        text = text.as_py()
        offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1).astype(np.int64).reshape(-1, 2)
        lost = masked_text(text, offsets, mask.values.to_numpy(), template)
        turns = template.parse(text)
        said = "".join(f"{role}\n{body}\n" for role, body in turns)
        yield conv.as_py(), len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text), len(offsets)


def _digested(batches: Iterator[pa.RecordBatch], template: Template, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 500):
            rows = list(zip(*_digest(part, template), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(rows, fields, strict=True)], schema=fields)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted conversations hold, read back from text, offsets and mask alone."""
    template, fields = template or Template(), pa_schema(formatted.sparkSession, DIGESTS)
    return formatted.mapInArrow(lambda batches: _digested(batches, template, fields), DIGESTS)


def format_digests(turns: DataFrame, tokenizer_path: str = DEFAULT_TOKENIZER, template: Template | None = None) -> DataFrame:
    """digests(format_conversations(turns)) in one pass: each batch is read back in the task that formatted it."""
    template, fields = template or Template(), pa_schema(turns.sparkSession, DIGESTS)
    return _formatted(turns, tokenizer_path, template, lambda batches: _digested(batches, template, fields), DIGESTS)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    extra = extra.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return format_digests(turns).drop("n_tokens")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(replace(role || text, '\', '\\')) + len(regexp_extract_all(text, '\[INST\]|\[/INST\]|</s>|<s>|<\|endoftext\|>')) + len(regexp_extract_all(role, '\[INST\]|\[/INST\]|</s>|<s>|<\|endoftext\|>')) + 17 AS drawn FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(drawn) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
