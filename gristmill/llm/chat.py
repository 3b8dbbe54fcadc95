"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A turn is written as ``### role: text</turn>`` and a line feed. Inside role and text the
characters that could begin a control string (``#``, ``<``, in roles also ``:``) and the
backslash get a backslash, so every formatted conversation reads back exactly. Header, text and
end of a turn are encoded apart, so the loss mask (texts of assistants) ends on token borders.

A node of the tree is a chain of turns, named by a running hash. Different conversations are
sorted by their chains, which is depth-first order; a node belongs to the first conversation
that has it, and its place in the packed stream is a distributed prefix sum. Each node carries
position ids that count from the start of its conversation, and the intervals of the stream
that hold its ancestors: a token attends to these and to the earlier tokens of its own node.
Neighbouring intervals are merged, so a chain without branches has one.

A first turn shared by a third of all conversations costs one aggregate with partial results and
joins with adaptive skew splitting; nothing collects a tree. One conversation is one unit.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null text or role
is empty; rows without conversation id form one conversation; repeated rows are repeated turns;
an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.llm.tables import in_batches
from gristmill.plans.ordering import with_row_number
from gristmill.plans.session import checkpoint

# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST = 4096  # characters encoded in one go; merging is quadratic in runs without blanks
SPEAKER = "assistant"
LEAVES_PER_SLOT = 10_000
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"([\\#<:])" if role else r"([\\#<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    return f"### {escape(role, True)}: ", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; an error if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Tokens:
    """Encodes and decodes with a vocabulary; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coding = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), LONGEST):
            out += self.coding.encode_ordinary(text[at : at + LONGEST])
        return out

    def decode(self, tokens: list[int]) -> str:
        return self.coding.decode_bytes(tokens).decode()


@dataclass
class Packed:
    """``nodes``: the packed stream; ``paths``: nodes of each different conversation; ``members``."""

    nodes: DataFrame
    paths: DataFrame
    members: DataFrame


def chains(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order and the running hash of each."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = F.array_sort(F.collect_list(turn))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))

    def link(done: Column, x: Column) -> Column:
        name = F.md5(F.concat(done["last"], F.length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]))
        return F.struct(name.alias("last"), F.concat(done["all"], F.array(name)).alias("all"))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))
    names = F.aggregate("turns", start, link, lambda done: done["all"])
    return grouped.withColumn("names", names).withColumn("leaf", F.element_at("names", -1))


def encoded(nodes: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens(shared.value)
        for batch in batches:
            tokens, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                head, body, tail = (coder.encode(x) for x in parts_of(role, text))
                tokens.append(head + body + tail)
                start.append(len(head) if role == SPEAKER else 0)
                end.append(len(head) + len(body) if role == SPEAKER else 0)
            made = [pa.array(tokens, pa.list_(pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            kept = batch.select(["node", "tree", "leaf_no", "depth"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, "tokens", "loss_start", "loss_end"])

    schema = "node string, tree string, leaf_no long, depth int, tokens array<int>, loss_start int, loss_end int"
    return in_batches(nodes.select("node", "tree", "leaf_no", "depth", "role", "text"), run, schema)


def merged(line: Column) -> Column:
    """Intervals ``(start, end)`` of a list of nodes, neighbours joined."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        end = x["start"] + x["n"]
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end")))
        )
        more = F.concat(done, F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] == x["start"]), grown).otherwise(more).cast(kind)

    return F.aggregate(line, F.array().cast(kind), step)


def packed(conversations: DataFrame, ranks: dict[bytes, int]) -> Packed:
    """The packed stream of all conversations.

    ``nodes`` has ``tree, packed_start, packed_end, position_ids, ancestors, tokens, loss_start,
    loss_end``; sorted by ``packed_start`` it is the depth-first stream.
    """
    every = checkpoint(chains(conversations))
    different = checkpoint(every.groupBy("leaf").agg(F.first("turns").alias("turns"), F.first("names").alias("names")))
    leaves = checkpoint(with_row_number(different, ["names"], "leaf_no").withColumn("leaf_no", F.col("leaf_no").cast("long")))
    steps = leaves.select(
        "leaf_no", F.get("names", F.lit(0)).alias("tree"), F.posexplode(F.arrays_zip("names", "turns")).alias("depth", "x")
    ).select("leaf_no", "tree", "depth", F.col("x.names").alias("node"), F.col("x.turns.role").alias("role"), F.col("x.turns.text").alias("text"))
    first = steps.groupBy("node").agg(F.min(F.struct("leaf_no", "depth", "tree", "role", "text")).alias("f")).select("node", "f.*")
    nodes = checkpoint(encoded(first, ranks))
    sized = nodes.select("node", "leaf_no", "depth", F.size("tokens").cast("long").alias("n"))
    slot = F.floor(F.col("leaf_no") / F.lit(LEAVES_PER_SLOT))
    sums = sized.groupBy(slot.alias("slot")).agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per 10,000 leaves
    offsets = sums.select("slot", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("slot").orderBy("leaf_no", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpoint(
        sized.withColumn("slot", slot).join(offsets, "slot")
        .select("node", "leaf_no", "depth", "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))
    )
    paths = checkpoint(steps.select("leaf_no", "depth", "node").join(placed.select("node", "start", "n"), "node").drop("node"))
    lines = paths.groupBy("leaf_no").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "n"))).alias("line"))
    above = F.slice("line", F.lit(1), F.col("depth"))
    attached = placed.join(lines, "leaf_no").select(
        "node", "n", F.col("start").alias("packed_start"), (F.col("start") + F.col("n")).alias("packed_end"),
        merged(above).alias("ancestors"),
        F.aggregate(above, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("from"),
    )
    out = nodes.join(attached, "node").select(
        "tree", "packed_start", "packed_end",
        F.sequence(F.col("from"), F.col("from") + F.col("n") - 1).alias("position_ids"),
        "ancestors", "tokens", "loss_start", "loss_end",
    )
    members = every.select("conv_id", "leaf").join(leaves.select("leaf", "leaf_no"), "leaf").select("conv_id", "leaf_no")
    return Packed(out, paths.select("leaf_no", "depth", F.col("start").alias("packed_start")), members)


def read_back(stream: Packed, ranks: dict[bytes, int]) -> DataFrame:
    """Conversations decoded from the packed stream, as digests.

    Per conversation: ``n_turns, turns_sha256`` of its parsed turns, ``loss_chars, loss_sha256`` of
    the text under the loss mask, and ``formatted_chars``.
    """
    shared = stream.nodes.sparkSession.sparkContext.broadcast(ranks)
    found = stream.paths.join(stream.nodes.select("packed_start", "tokens", "loss_start", "loss_end"), "packed_start")
    whole = found.groupBy("leaf_no").agg(
        F.array_sort(F.collect_list(F.struct("depth", "tokens", "loss_start", "loss_end"))).alias("line")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens(shared.value)
        names = ["leaf_no", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for leaf, line in zip(batch.column("leaf_no").to_pylist(), batch.column("line")):
                formatted, loss, chars = [], hashlib.sha256(), 0
                for x in line.as_py():
                    formatted.append(coder.decode(x["tokens"]))
                    if x["loss_end"] > x["loss_start"]:
                        said = unescape(coder.decode(x["tokens"][x["loss_start"] : x["loss_end"]]))
                        loss.update(said.encode())
                        chars += len(said)
                text = "".join(formatted)
                turns, digest = parse(text), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                rows.append((leaf, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=ARROW)

    schema = "leaf_no long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return stream.members.join(in_batches(whole, run, schema), "leaf_no").drop("leaf_no")


ARROW = pa.schema([
    ("leaf_no", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
