"""Chat formatting on tokens: segments are encoded apart, reserved ids are spliced between them, and the loss mask is a prefix sum of marks.

Template (fixed text of the reserved ids):

    system      [SYS] text [/SYS]
    user        [INST] text [/INST]
    assistant   <s> text </s>
    other       [ROLE] role [SAYS] text [/ROLE]      (without the blanks)

What stands in a text is never encoded to a reserved id. So that the formatted text can be read too, control strings in a content get a backslash behind
their first character, and such strings that have backslashes there already get one more; unescape() takes one off.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import list_array, small_side, stage

C = F.col
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[SAYS]", "[/ROLE]")
#: Opening and closing mark of the roles that have their own.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS))
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})"), re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")


def _fits(match: re.Match) -> bool:
    """Whether bracket and rest belong together ('<' with 's>', '[' with 'INST]')."""
    rest = match.string[match.end() : match.end() + 8]
    return any(c[0] == match[1] and rest.startswith(c[1:]) for c in CONTROLS)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2] + "\\" if _fits(m) else m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2] if _fits(m) else m[0], text)


class Codec:
    """A byte-level BPE vocabulary (a file of ranks) with the reserved ids behind its own."""

    _known: dict[bytes, Codec] = {}

    def __init__(self, ranks: bytes, pattern: str):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.plain, self.first = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), max(merges.values()) + 1
        self.ids = {c: self.first + k for k, c in enumerate(CONTROLS)}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        """One codec a worker."""
        key = hashlib.sha256(ranks + pattern.encode()).digest()
        if key not in cls._known:
            cls._known[key] = cls(ranks, pattern)
        return cls._known[key]

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, loss mask, characters of the formatted turn). The mask is 1 on the tokens of an assistant's text, not on the marks around it."""
        said = escape(text)
        body, own = self.plain.encode_ordinary(said), MARKS.get(role)
        if own:
            head, chars = [self.ids[own[0]]], len(own[0]) + len(own[1])
        else:
            head, chars = [self.ids["[ROLE]"], *self.plain.encode_ordinary(escape(role)), self.ids["[SAYS]"]], len("[ROLE][SAYS][/ROLE]") + len(escape(role))
        ids = np.array([*head, *body, self.ids[own[1] if own else "[/ROLE]"]], np.int32)
        steps = np.zeros(len(ids), np.int8)
        if role == "assistant":
            steps[1] += 1
            steps[-1] -= 1
        return ids, np.cumsum(steps, dtype=np.int8), chars + len(said)

    def content(self, ids: np.ndarray) -> str:
        """The text of ids that are not reserved, unescaped."""
        return unescape(self.plain.decode_bytes(ids.tolist()).decode("utf-8"))

    def parse(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of a turn's ids; raises ValueError if they don't follow the template."""
        marks = np.nonzero(ids >= self.first)[0]
        kinds = [CONTROLS[k - self.first] for k in ids[marks]]
        if len(marks) >= 2 and marks[0] == 0 and marks[-1] == len(ids) - 1:
            if kinds == ["[ROLE]", "[SAYS]", "[/ROLE]"]:
                return self.content(ids[1 : marks[1]]), self.content(ids[marks[1] + 1 : -1])
            for role, own in MARKS.items():
                if kinds == list(own):
                    return role, self.content(ids[1:-1])
        raise ValueError(f"no turn of the template: {kinds}")

    def formatted(self, ids: np.ndarray) -> str:
        """The turn as text, with its marks and escapes."""
        marks = np.nonzero(ids >= self.first)[0]
        parts = np.split(ids, np.sort(np.concatenate([marks, marks + 1])))
        return "".join(CONTROLS[p[0] - self.first] if len(p) and p[0] >= self.first else self.plain.decode_bytes(p.tolist()).decode("utf-8") for p in parts)


def format_turns(conversations: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, role, tie, ids, loss, chars: each turn as token ids with its loss mask.

    Turns are encoded where they lie; nothing is shuffled, and a conversation of any length is no single row. Null roles and texts are empty. tie (the
    text's MD5) orders rows of equal conversation, turn and role.
    """
    rows = conversations.select(C("conv_id").cast("long").alias("conv_id"), C("turn").cast("long").alias("turn"), F.coalesce(C("role").cast("string"), F.lit("")).alias("role"), F.coalesce(C("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.unhex(F.md5("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            done = [codec.turn(r.as_py(), t.as_py()) for r, t in zip(batch.column("role"), batch.column("text"), strict=True)]
            arrays = [batch.column(k) for k in ("conv_id", "turn", "role", "tie")]
            arrays += [list_array([d[0] for d in done], pa.int32()), list_array([d[1] for d in done], pa.int8()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "tie", "ids", "loss", "chars"])

    return rows.select("conv_id", "turn", "role", "tie", "text").mapInArrow(run, "conv_id long, turn long, role string, tie binary, ids array<int>, loss array<tinyint>, chars long")


def place_turns(formatted: DataFrame) -> DataFrame:
    """format_turns()'s rows with start: the offset of a turn's first token in its conversation.

    Rows are ranged by conversation and turn, so that a conversation of any size spreads over tasks; each task sums up its own, and what came before in
    the same conversation is added from the few sums at the seams between tasks.
    """
    order = ["conv_id", "turn", "role", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in batches:
            local = []
            for conv, n in zip(batch.column("conv_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                last, at = conv, (at if conv == last else 0)
                local.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "local"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in formatted.schema.fields)
    ranged = formatted.withColumn("n", F.size("ids").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    rows = stage(ranged.mapInArrow(run, f"{names}, n long, block int, local long"), "placed")
    sums = rows.groupBy("conv_id", "block").agg(F.max(C("local") + C("n")).alias("n"))
    several = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("parts")).filter(F.size("parts") > 1)
    before = several.select("conv_id", F.explode("parts").alias("p")).select(C("conv_id").alias("_conv"), C("p.block").alias("_block"), F.coalesce(F.sum("p.n").over(Window.partitionBy("conv_id").orderBy("p.block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(small_side(stage(before, "seams")), C("conv_id").eqNullSafe(C("_conv")) & (C("block") == C("_block")), "left")
    return out.withColumn("start", C("local") + F.coalesce("_before", F.lit(0))).drop("n", "block", "local", "_conv", "_block", "_before")


def read_back(formatted: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """format_turns()'s rows, written -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the ids and masks.

    A hash over a conversation is read in order, so a conversation is one task's; its turns stream through, and no more than a batch is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        now, done = None, []
        for batch in batches:
            conv, ids, loss = batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss")
            at, flat, masks = ids.offsets.to_numpy(), ids.values.to_numpy(), loss.values.to_numpy()
            for k, key in enumerate(conv):
                if now is None or now[0] != key:
                    if now:
                        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own, mask = flat[at[k] : at[k + 1]], masks[at[k] : at[k + 1]]
                role, text = codec.parse(own)
                learnt = codec.content(own[mask == 1])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(codec.formatted(own))
            if len(done) >= 1000:
                yield out(done)
                done = []
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
        if done:
            yield out(done)

    rows = formatted.select("conv_id", "turn", "role", "tie", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return rows.select("conv_id", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_formatted(conversations: DataFrame, ranks: bytes, pattern: str, folder: str | None = None) -> DataFrame:
    """format_turns() written under `folder` (the shared one if none is named) and read again."""
    formatted = format_turns(conversations, ranks, pattern)
    if folder is None:
        return stage(formatted, "formatted")
    formatted.write.parquet(folder)
    return conversations.sparkSession.read.parquet(folder)


def format_and_check(conversations: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Formatted, written, read back: the columns of read_back(), a row for each conversation.

    Null conv_ids are one conversation; turns go by turn (null first), then role, then tie; null roles and texts are empty, and an empty text has no
    token in the mask. Repeated rows are turns of their own. An empty table gives no rows; other columns are ignored.
    """
    return read_back(write_formatted(conversations, ranks, pattern), ranks, pattern)


__all__ = ["CONTROLS", "MARKS", "Codec", "escape", "format_and_check", "format_turns", "place_turns", "read_back", "unescape", "write_formatted"]
