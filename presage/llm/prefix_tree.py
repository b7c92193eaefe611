"""Chat formatting into prefix trees.

Conversations are sorted by their turns' hashes, so those that share initial
turns become neighbours, and are dealt by range of (hashes, conv_id), which
splits groups of any size. Each task walks its conversations in order with a
stack of the open turns and emits every new turn once, depth first: the tree of
shared prefixes, serialised. A block ends at `budget` characters or conversations;
the next one emits its open turns anew, so blocks stay bounded and every
conversation lies in one block whole.

A block is one text, its token ids, and for each node (turn): its parent, its
interval in the text and the part of that under the loss mask; its interval in
the ids, again with the part under the mask; its first position id (the tokens of
its ancestors; position ids then run on by one); and the intervals of the
ancestors' tokens that its own may attend to besides the earlier ones of its own.
A turn's head, body and close are encoded each by itself, once a node. Leaves
name the conversations that end at a node. Without a tokenizer the tokens are the
code points of the text and no ids are emitted.

The template is OPEN role BODY text CLOSE. Control strings (the template's and
other chat formats') inside a role or text are broken by a backslash behind
their first character, and backslashes are doubled, which unescape() undoes.

Defined results: a null role or text counts as empty; rows of a turn that repeat
stand side by side in order of (role, text); null turns come first; rows with a
null conv_id are one conversation, and a conversation, however long, is held by
one task; equal conversations share all nodes; an empty table gives no blocks;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.bpe import encoder

OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings that never appear in formatted text but as control.
CONTROL = [OPEN, BODY, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]
_START = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", re.DOTALL)

#: Characters, and leaves, of a block.
BUDGET = 1 << 20

NODE = pa.struct(
    [
        ("parent", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
        ("token_start", pa.int64()),
        ("token_end", pa.int64()),
        ("loss_token_start", pa.int64()),
        ("loss_token_end", pa.int64()),
        ("position", pa.int64()),
        ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_SCHEMA = pa.schema(
    [("text", pa.string()), ("ids", pa.list_(pa.int32())), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))]
)
BLOCK = (
    "text string, ids array<int>, nodes array<struct<parent:int,start:bigint,`end`:bigint,loss_start:bigint,loss_end:bigint,"
    "token_start:bigint,token_end:bigint,loss_token_start:bigint,loss_token_end:bigint,position:bigint,"
    "attends:array<struct<start:bigint,`end`:bigint>>>>, "
    "leaves array<struct<conv_id:bigint,node:int>>"
)


def escape(text: str) -> str:
    return _START.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and the interval in it under the loss mask (empty but for assistants)."""
    head, body = OPEN + escape(role) + BODY, escape(text)
    start = len(head)
    return head + body + CLOSE, start, start + (len(body) if role == "assistant" else 0)


class _Block:
    """One serialised tree under construction."""

    def __init__(self, tokenizer: str | None) -> None:
        self.tokenizer = tokenizer
        self.parts: list[str] = []
        self.ids: list[np.ndarray] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.size = self.tokens = 0

    def _lengths(self, parts: list[str]) -> list[int]:
        """The tokens of each part, which are put behind the block's ids."""
        if self.tokenizer is None:
            return [len(p) for p in parts]
        found = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder(self.tokenizer).encode(parts)]
        self.ids += found
        return [len(x) for x in found]

    def add(self, parent: int, turn: tuple[str, str]) -> int:
        text, loss_start, loss_end = format_turn(*turn)
        body = len(text) - len(CLOSE)
        head, said, close = self._lengths([text[:loss_start], text[loss_start:body], text[body:]])
        first, up = self.tokens, self.nodes[parent] if parent >= 0 else None
        attends = []
        if up:
            attends = [dict(x) for x in up["attends"]]
            if attends and attends[-1]["end"] == up["token_start"]:  # neighbours become one interval
                attends[-1]["end"] = up["token_end"]
            else:
                attends.append({"start": up["token_start"], "end": up["token_end"]})
        self.nodes.append(
            {
                "parent": parent,
                "start": self.size,
                "end": self.size + len(text),
                "loss_start": self.size + loss_start,
                "loss_end": self.size + loss_end,
                "token_start": first,
                "token_end": first + head + said + close,
                "loss_token_start": first + head,
                "loss_token_end": first + head + (said if loss_end > loss_start else 0),
                "position": up["position"] + up["token_end"] - up["token_start"] if up else 0,
                "attends": attends,
            }
        )
        self.parts.append(text)
        self.size += len(text)
        self.tokens = first + head + said + close
        return len(self.nodes) - 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.leaves:
            ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
            row = {"text": "".join(self.parts), "ids": ids, "nodes": self.nodes, "leaves": self.leaves}
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)


def _trees(conversations: Iterator[tuple[int | None, list[tuple[str, str]]]], budget: int, tokenizer: str | None) -> Iterator[pa.RecordBatch]:
    block, stack, nodes = _Block(tokenizer), [], []
    for conv, turns in conversations:
        shared = 0
        while shared < min(len(stack), len(turns)) and stack[shared] == turns[shared]:
            shared += 1
        stack, nodes = turns, nodes[:shared]
        for turn in turns[shared:]:
            nodes.append(block.add(nodes[-1] if nodes else -1, turn))
        block.leaves.append({"conv_id": conv, "node": nodes[-1]})
        if block.size > budget or len(block.leaves) > budget // 64:
            yield from block.rows()
            block, stack, nodes = _Block(tokenizer), [], []
    yield from block.rows()


def format_conversations(rows: DataFrame, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """Blocks (text, ids, nodes, leaves) of conversations(conv_id, turn, role, text); tokenizer: a file of the tokenizers library."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", role, text).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    dealt = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
            for b in batches:
                for conv, own in zip(b.column(0), b.column(1)):
                    yield conv.as_py(), [(t["role"], t["text"]) for t in own.as_py()]

        yield from _trees(conversations(), budget, tokenizer)

    return dealt.select("conv_id", "turns").mapInArrow(run, BLOCK)


def read_back(blocks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from blocks alone."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, nodes, leaves in zip(frame["text"], frame["nodes"], frame["leaves"]):
                out = []
                turns: dict[int, tuple[str, str]] = {}
                for leaf in leaves:
                    path, i = [], leaf["node"]
                    while i >= 0:
                        path.append(i)
                        i = nodes[i]["parent"]
                    said, loss, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for i in reversed(path):
                        node = nodes[i]
                        size += node["end"] - node["start"]
                        if i not in turns:
                            head, body = _TURN.fullmatch(text[node["start"] : node["end"]]).groups()
                            under = unescape(text[node["loss_start"] : node["loss_end"]])
                            turns[i] = (f"{unescape(head)}\n{unescape(body)}\n".encode(), under.encode(), len(under))
                        whole, under, n = turns[i]
                        said.update(whole)
                        loss.update(under)
                        n_loss += n
                    out.append((leaf["conv_id"], len(path), said.hexdigest(), n_loss, loss.hexdigest(), size))
                yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return blocks.select("text", "nodes", "leaves").mapInPandas(run, schema)
