"""Chat formatting along a prefix tree.

Conversations that begin with the same turns share these turns: the formatted turns form a tree, written depth first, each
once. A turn carries its place in that sequence, the position its tokens have in the conversation, and the intervals of
its ancestors, which its tokens may attend to. Reading the tree back gives every conversation exactly.

Depth-first order is the order of conversations sorted by their chained turn digests: neighbours share a beginning, and
what is new in one is written. The sort is spread over partitions by range; of each partition only its ends and its
length meet on the driver, so places go on from one partition to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import settle

# The template, and strings that control it or other common templates.
BEGIN, END = "<|turn|>", "<|end|>\n"
_REST = {"<": r"(?=\||/?s>|</?SYS>>)", "[": r"(?=/?INST\])"}
_ESCAPE = re.compile(rf"<\\*{_REST['<']}|\[\\*{_REST['[']}")
_UNESCAPE = re.compile(rf"(<\\*)\\{_REST['<']}|(\[\\*)\\{_REST['[']}")


def escape(text: str) -> str:
    """A backslash goes into every control string, after its first character and the backslashes that follow it."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or m[2], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text lies in it."""
    head = f"{BEGIN}{escape(role.replace('\\', '\\\\').replace('\n', '\\n'))}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = piece[len(BEGIN) : -len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body)


_RENDERED = pa.schema({"conv_id": pa.int64(), "conv_key": pa.string(), "keys": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "pieces": pa.list_(pa.string()), "loss": pa.list_(pa.list_(pa.int64()))})


def _render(loss_role: str, tokenizer: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if tokenizer:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
    for batch in batches:
        out = []
        for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            chain, keys, pieces, loss = b"", [], [], []
            for turn in turns:
                role, text = turn["role"] or "", turn["text"] or ""
                piece, start, end = turn_text(role, text)
                chain = blake2b(chain + piece.encode(), digest_size=16).digest()
                keys.append(int.from_bytes(chain[:8], "big", signed=True))
                pieces.append(piece)
                loss.append([start, end] if role == loss_role else None)
            lengths = [len(e.ids) for e in encoder.encode_batch(pieces, add_special_tokens=False)] if tokenizer else list(map(len, pieces))
            out.append({"conv_id": conv_id, "conv_key": chain.hex(), "keys": keys, "lengths": lengths, "pieces": pieces, "loss": loss})
        yield pa.RecordBatch.from_pylist(out, _RENDERED)


def _shared(a: list, b: list) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last conversation, and tokens written if nothing came before."""
    first, path, total = None, [], 0
    for batch in batches:
        for keys, lengths in zip(batch.column("keys").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
            if first is None:
                first = keys, lengths
            same = _shared(keys, [p[0] for p in path])
            path = path[:same]
            for k in range(same, len(keys)):
                path.append((keys[k], total, total + lengths[k]))
                total += lengths[k]
    if first is not None:
        row = {"part": TaskContext.get().partitionId(), "first_keys": first[0], "first_lengths": first[1], "total": total, "last": [list(p) for p in path]}
        yield pa.RecordBatch.from_pylist([row])


_NODES = pa.schema(
    {
        "start": pa.int64(),
        "end": pa.int64(),
        "position": pa.int64(),
        "depth": pa.int32(),
        "ancestors": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})),
        "piece": pa.string(),
        "loss": pa.list_(pa.int64()),
        "conv_key": pa.string(),
    }
)


def _write(known: dict[int, tuple[int, list]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each conversation adds to the tree."""
    at, path = known.get(TaskContext.get().partitionId(), (0, []))
    path = list(path)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            keys = row["keys"]
            path = path[: _shared(keys, [p[0] for p in path])]
            for k in range(len(path), len(keys)):
                end = at + row["lengths"][k]
                above = [{"start": s, "end": e} for _, s, e in path]
                out.append(
                    {
                        "start": at,
                        "end": end,
                        "position": sum(e - s for _, s, e in path),
                        "depth": k,
                        "ancestors": above,
                        "piece": row["pieces"][k],
                        "loss": row["loss"][k],
                        "conv_key": row["conv_key"] if k + 1 == len(keys) else None,
                    }
                )
                path.append((keys[k], at, end))
                at = end
        yield pa.RecordBatch.from_pylist(out, _NODES)


def _places(ends: list) -> dict[int, tuple[int, list]]:
    """Of each partition, where it begins to write and the path open at that moment."""
    out, at, path = {}, 0, []
    for row in sorted(ends, key=lambda r: r["part"]):
        out[row["part"]] = at, path
        same = _shared(row["first_keys"], [p[0] for p in path])
        before = sum(row["first_lengths"][:same])
        own = [(k, s + at - before, e + at - before) for k, s, e in row["last"]]
        still = _shared([k for k, _, _ in own], [p[0] for p in path[:same]])  # turns shared with the partition before stay where they are
        path = path[:still] + own[still:]
        at += row["total"] - before
    return out


def prefix_tree(rows: DataFrame, loss_role: str = "assistant", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree of formatted turns, and (conv_id, conv_key) of every conversation.

    ``rows``: conv_id, turn, role, text; turns are ordered by turn (missing first), then role and text. A missing role or text
    is empty, rows without conv_id are one conversation. Other columns are ignored, no rows give an empty tree.

    Tree, ordered by start: start and end in the sequence of all tokens, position of its first token in a conversation, depth,
    ancestors (start and end of each, the first turn first), piece (the formatted turn), loss (where in the piece text is
    learned, null if none is), conv_key of the conversation that ends here (null if none does). Tokens are code points of the
    piece, or those of the ``tokenizers`` file named. Equal conversations have one conv_key.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conversations = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    schema = "conv_id long, conv_key string, keys array<long>, lengths array<long>, pieces array<string>, loss array<array<long>>"
    rendered = settle(conversations.mapInArrow(partial(_render, loss_role, tokenizer), schema))
    in_order = settle(rendered.drop("conv_id").dropDuplicates(["conv_key"]).orderBy("keys"))
    ends = in_order.select("keys", "lengths").mapInArrow(_ends, "part long, first_keys array<long>, first_lengths array<long>, total long, last array<array<long>>").collect()
    schema = "start long, end long, position long, depth int, ancestors array<struct<start: long, end: long>>, piece string, loss array<long>, conv_key string"
    return in_order.mapInArrow(partial(_write, _places(ends)), schema), rendered.select("conv_id", "conv_key")


_READ = pa.schema({"conv_key": pa.string(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns, loss, chars, size = sha256(), sha256(), 0, 0
            for node in row["nodes"]:
                piece = node["piece"]
                role, text = read_turn(piece)
                turns.update(f"{role}\n{text}\n".encode())
                size += len(piece)
                if node["loss"]:
                    learned = unescape(piece[node["loss"][0] : node["loss"][1]])
                    loss.update(learned.encode())
                    chars += len(learned)
            out.append(
                {"conv_key": row["conv_key"], "n_turns": len(row["nodes"]), "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}
            )
        yield pa.RecordBatch.from_pylist(out, _READ)


def conversation_digests(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation read back from the tree: the nodes its last turn descends from, in order."""
    places: Column = F.concat(F.transform("ancestors", lambda a: a["start"]), F.array("start"))
    paths = tree.where("conv_key IS NOT NULL").select("conv_key", F.explode(places).alias("start"))
    nodes = paths.join(tree.select("start", "piece", "loss"), "start")
    whole = nodes.groupBy("conv_key").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "loss"))).alias("nodes"))
    schema = "conv_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return members.join(whole.mapInArrow(_read, schema), "conv_key").drop("conv_key")
