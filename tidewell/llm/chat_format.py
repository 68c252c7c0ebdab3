"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share those turns' tokens. A node of the tree is a
turn after its whole history, named by a chained digest. Sorting the conversations by the
digests along their paths puts the tree in depth-first order: a conversation brings the nodes
below its longest common prefix with the one before it, and each node is brought once.

Steps, none of which needs a whole tree in one place:
1. turns are dealt by conversation and sorted; a stream over them formats each turn, cuts it
   into ids and chains the digest;
2. a conversation's digests, in order, are its path; conversations are range-partitioned by
   (path, conversation), so a very common first turn or whole conversation spreads out;
3. pass one over each range gives its last path with its places and the sum of new ids, a row a
   partition; those rows give each range its first place and the open path where it begins;
4. pass two gives each turn its place, and each new node its position and its ancestors'
   intervals from the open path; one join by (conversation, turn) brings them to the ids.

A segment holds its ids, its place in the token stream, the position id of its first token
(its depth in tokens), the span of its loss and the intervals of the stream its tokens may
attend to besides the earlier ones of the segment itself: its ancestors', joined where they
touch.

The template is ``<|im_start|>role\\n text <|im_end|>\\n``. The two control strings are ids of
their own behind the tokenizer's. Inside texts and roles each ``<``, backslashes, ``|`` gets
one backslash more, so no control string can occur there and the step can be undone.

Defined cases: null role or text is empty; turns with equal numbers are ordered by role and
text, and repeated rows are turns of their own; a null conversation id is a conversation of
its own; no rows give no rows; other columns are not looked at; texts are formatted whole.
Work is linear in a conversation's turns and in the intervals given out. Only a conversation's
digests and sizes (24 bytes a turn) are held together, and one such path a partition on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import in_arrow, settle
from tidewell.llm.tokens import tokenizer

#: Stands for a null conversation id between the steps, where joins need a value.
_NULL_ID = -(2**63) + 1
START, END = "<|im_start|>", "<|im_end|>"


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(s: str) -> str:
    return unescape(s).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Vocabulary:
    """The tokenizer's ids, then one id for each control string."""

    path: str

    def __post_init__(self) -> None:
        self.encoder = tokenizer(self.path)
        self.size = self.encoder.tokenizer.get_vocab_size()
        self.start, self.end = ((self.size + k).to_bytes(4, "little") for k in (0, 1))

    def turns(self, roles: list[str], texts: list[str], loss_roles: tuple[str, ...]) -> Iterator[tuple[bytes, int, int]]:
        """ids of each turn, and where its loss begins and how long it is (0, 0: none); a batch is one call of the encoder."""
        *heads, tail = self.encoder.encode([*(escape_role(r) + "\n" for r in roles), "\n"])
        for role, head, body in zip(roles, heads, self.encoder.encode([escape(t) for t in texts]), strict=True):
            ids = self.start + head + body + self.end + tail
            yield (ids, 1 + len(head) // 4, len(body) // 4) if role in loss_roles else (ids, 0, 0)


def decode(tok: Tokenizer, size: int, ids: bytes) -> str:
    """The formatted text of any run of ids; control ids become their strings."""
    out, run = [], []
    for i in np.frombuffer(ids, "<u4").tolist():
        if i < size:
            run.append(i)
        else:
            out += [tok.decode(run, skip_special_tokens=False), (START, END)[i - size]]
            run = []
    return "".join([*out, tok.decode(run, skip_special_tokens=False)])


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _batches(rows: Iterator[tuple], kinds: list, names: list[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if size > most:
            yield _batch(held, kinds, names)
            held, size = [], 0
    if held:
        yield _batch(held, kinds, names)


def _turns(conversations: DataFrame, path: str, loss_roles: tuple[str, ...]) -> DataFrame:
    """Each turn with its ids, its number in the conversation and the digest of its history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)

        def rows() -> Iterator[tuple]:
            last, digest, k = (), b"", 0
            for batch in batches:
                convs, _, roles, texts = (c.to_pylist() for c in batch.columns)
                for conv, role, text, turn in zip(convs, roles, texts, vocabulary.turns(roles, texts, loss_roles), strict=True):
                    if (conv,) != last:
                        last, digest, k = (conv,), b"", 0
                    history = hashlib.sha256(digest + len(role.encode()).to_bytes(8, "big") + role.encode() + b"\n" + text.encode())
                    digest = history.digest()[:16]
                    yield (conv, k, digest, role, *turn)
                    k += 1

        yield from _batches(rows(), [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int32()], ["conv_id", "k", "node", "role", "ids", "loss_start", "loss_length"])

    own = conversations.select(F.coalesce("conv_id", F.lit(_NULL_ID)).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.transform(in_arrow, run, "conv_id long, k int, node binary, role string, ids binary, loss_start int, loss_length int")


def _common(a: bytes, b: bytes) -> int:
    """Nodes at the start of both paths."""
    n = min(len(a), len(b)) // 16
    k = 0
    while k < n and a[16 * k : 16 * k + 16] == b[16 * k : 16 * k + 16]:
        k += 1
    return k


def format_conversations(conversations: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[DataFrame, DataFrame]:
    """(segments, references): the depth-first token stream, and the segments of each conversation in order.

    ``references`` has a row for each turn of each conversation, shared or not, naming its
    segment by ``place``; reading the segments of a conversation in order gives its text.
    """
    turns = settle(_turns(conversations, tokenizer_path, loss_roles), "turns")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "node", F.expr("length(ids) div 4").alias("n")))).alias("t"))
    ordered = settle(
        whole.select("conv_id", F.expr("unhex(array_join(transform(t, x -> hex(x.node)), ''))").alias("path"), F.expr("transform(t, x -> x.n)").alias("sizes"))
        .repartitionByRange("path", "conv_id").withColumn("part", F.spark_partition_id()),
        "paths",
    )
    ends = ordered.repartition("part").sortWithinPartitions("part", "path", "conv_id")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range: its first and last path, the places of the last one's nodes and its new ids if nothing were open before it."""
        found: dict[int, list] = {}
        for batch in batches:
            for part, path, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in found:
                    found[part] = [path, sizes, b"", [], 0]
                own = found[part]
                shared = _common(own[2], path)
                del own[3][shared:]
                for n in sizes[shared:]:
                    own[3].append(own[4])
                    own[4] += n
                own[2] = path
        if found:
            rows = [(p, *x) for p, x in found.items()]
            yield _batch(rows, [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64()], ["part", "first", "first_sizes", "last", "places", "n"])

    opened, place, path, places = {}, 0, b"", []
    rows = ends.select("part", "path", "sizes").transform(in_arrow, bounds, "part long, first binary, first_sizes array<long>, last binary, places array<long>, n long").collect()
    for r in sorted(rows, key=lambda r: r["part"]):  # a row for each range
        opened[r["part"]] = (place, path, places)
        shared = _common(path, bytes(r["first"]))
        known = sum(r["first_sizes"][:shared])  # ids of the range's first nodes, which are open already
        places = [places[k] if k < shared and x < known else place + x - known for k, x in enumerate(r["places"])]
        place, path = place + r["n"] - known, bytes(r["last"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each turn of each conversation with its node's place; a new node also with its position and its ancestors' intervals."""

        def rows() -> Iterator[tuple]:
            part_now, path, stack, at = None, b"", [], 0
            for batch in batches:
                for part, conv, own, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part != part_now:
                        at, path, open_places = opened[part]
                        part_now, stack = part, list(open_places)
                    shared = _common(path, own)
                    del stack[shared:]
                    begins: list[int] = []  # depths at which an interval begins: an ancestor that doesn't follow its parent at once
                    position = 0
                    for k, n in enumerate(sizes):
                        attends = None
                        if k >= shared:
                            stack.append(at)
                            at += n
                            attends = [{"begin": stack[i], "end": stack[j - 1] + sizes[j - 1]} for i, j in zip(begins, [*begins[1:], k], strict=True)] if k else []
                        if not k or stack[k] != stack[k - 1] + sizes[k - 1]:
                            begins.append(k)
                        yield conv, k, stack[k], k >= shared, position, attends
                        position += n
                    path = own

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        yield from _batches(rows(), kinds, ["conv_id", "k", "place", "new", "position", "attends"])

    schema = "conv_id long, k int, place long, new boolean, position long, attends array<struct<begin:long,end:long>>"
    laid = settle(ends.select("part", "conv_id", "path", "sizes").transform(in_arrow, lay_out, schema), "laid")
    segments = turns.join(laid.where("new").select("conv_id", "k", "place", "position", "attends"), ["conv_id", "k"]).select(
        "place", F.expr("cast(length(ids) div 4 as long)").alias("length"), "position", F.col("k").alias("depth"), "role", "ids", "loss_start", "loss_length", "attends"
    )
    return segments, laid.select(F.when(F.col("conv_id") != _NULL_ID, F.col("conv_id")).alias("conv_id"), F.col("k").alias("turn_index"), "place")


def read_back(segments: DataFrame, references: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the token stream says of each conversation, from its ids alone.

    A common segment is joined to all its references; that join is on ``place``, where a
    large partition is split at run time since the other side has one row a key. Then the
    turns of each conversation are dealt by it, sorted and streamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer.from_file(tokenizer_path)
        size = tok.get_vocab_size()

        def rows() -> Iterator[tuple]:
            last, state = (), None

            def done() -> tuple:
                n, turns, loss, loss_chars, chars = state
                return (*last, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

            for batch in batches:
                for conv, _, ids, loss_start, loss_length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (conv,) != last:
                        if state:
                            yield done()
                        last, state = (conv,), [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                    text = decode(tok, size, ids)
                    role, _, body = text[len(START) :].partition("\n")
                    body = body[: body.rindex(END)]
                    state[0] += 1
                    state[1].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                    masked = unescape(decode(tok, size, ids[4 * loss_start : 4 * (loss_start + loss_length)]))
                    state[2].update(masked.encode())
                    state[3] += len(masked)
                    state[4] += len(text)
            if state:
                yield done()

        yield from _batches(rows(), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    joined = references.join(segments.select("place", "ids", "loss_start", "loss_length"), "place")
    dealt = joined.select("conv_id", "turn_index", "ids", "loss_start", "loss_length").repartition("conv_id").sortWithinPartitions("conv_id", "turn_index")
    return dealt.transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
