"""Chat formatting from event logs: fold by message, render, sort by conversation.

A log has the columns conv_id, message, seq, kind, role and text. ``message`` orders the
messages of a conversation, ``seq`` all its events. Kinds:

* ``start``: the message exists, with its role;
* ``delta``: text to append;
* ``edit``: the message's text is this one, whatever came before;
* ``regenerate``: the message begins anew, with this text if any, and all later messages that
  were there by then are gone.

The log is written once. Which events still count follows from a table without texts, of one
row per message: its last edit and its role, and the last regeneration up to it. The events
are joined to it, folded and rendered by message, so that a conversation of any length is
spread over all tasks. Only the finished pieces of a conversation go through one stream.

The template marks turns with ``<|im_start|>`` and ``<|im_end|>``. Within roles and texts
every ``<|`` gets a backslash after the ``<``, one more than it had, so that no text can
look like a mark and reading back restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.tables import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Loss is on the texts of this role.
LEARNED = "assistant"
#: Characters of a delta, where a log is made from finished turns.
DELTA = 512

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _header(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one message, and where the text under the loss mask begins and ends."""
    begin = f"{OPEN}{_header(role)}\n"
    body = escape(text)
    masked = len(body) if role == LEARNED else 0
    return f"{begin}{body}{CLOSE}\n", len(begin), len(begin) + masked


# --- logs ---------------------------------------------------------------------------


def log_of_turns(turns: DataFrame) -> DataFrame:
    """A log as a stream could have left it, whose fold gives the turns.

    By their digest, a fourth of the turns each has a start and deltas only; a draft that an
    edit replaces; a draft and a later message that a regeneration drops; and both. A text
    that an edit or a regeneration begins goes on with deltas.

    Rows of equal turn are messages of their own, ordered by role and text. NULL text has no
    delta; a NULL turn comes first.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    message = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.unhex(F.md5(text)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart
    )
    # later than the message, and before the next turn's
    dropped = F.struct(
        F.col("message.turn").alias("turn"),
        F.concat("message.role", F.lit("~")).alias("role"),
        F.col("message.digest").alias("digest"),
        F.col("message.row").alias("row"),
    )
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    told = turns.select("conv_id", message.alias("message"), "role", pieces.alias("_pieces"))

    def event(kind: str, text: Column, role: Column | None = None, later: bool = False) -> Column:
        return F.struct(
            F.lit(later).alias("later"),
            F.lit(kind).alias("kind"),
            (F.lit(None) if role is None else role).cast("string").alias("role"),
            text.cast("string").alias("text"),
        )

    def deltas(texts: Column) -> Column:
        return F.transform(texts, lambda x: event("delta", x))

    none, head = F.lit(None), F.get("_pieces", F.lit(0))
    tail = deltas(F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0))))
    begin = event("start", none, F.col("role"))
    draft = event("delta", F.concat(F.lit("draft "), F.reverse(F.coalesce(head, F.lit("")))))
    gone = [event("start", none, F.lit("user"), True), event("delta", F.lit("to be gone"), None, True)]
    histories = [
        F.concat(F.array(begin), deltas(F.col("_pieces"))),
        F.concat(F.array(begin, draft, event("edit", head)), tail),
        F.concat(F.array(begin, draft, *gone, event("regenerate", none)), deltas(F.col("_pieces"))),
        F.concat(
            F.array(begin, draft, event("edit", F.lit("edited")), *gone, event("regenerate", head)),
            tail,
        ),
    ]
    kind = F.pmod(F.xxhash64("message.digest", "message.turn", "conv_id"), F.lit(len(histories)))
    history = F.when(kind == 0, histories[0])
    for i, events in enumerate(histories[1:], 1):
        history = history.when(kind == i, events)
    parts = told.select("conv_id", "message", dropped.alias("_gone"), F.posexplode(history).alias("part", "_e"))
    return parts.select(
        "conv_id",
        F.when(F.col("_e.later"), F.col("_gone")).otherwise(F.col("message")).alias("message"),
        F.struct("message", "part").alias("seq"),
        "_e.kind",
        "_e.role",
        "_e.text",
    )


def cuts(events: DataFrame) -> DataFrame:
    """A row for each message: _conv, _message, _role, and _since, the event from which on its
    events count (NULL: all of them)."""
    role = F.when(F.col("role").isNotNull(), F.struct("seq", "role"))
    of_message = events.groupBy(F.col("conv_id").alias("_conv"), F.col("message").alias("_message")).agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_anew"),
        F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("_edit"),
        F.min(role)["role"].alias("_role"),
    )
    upto = Window.partitionBy("_conv").orderBy("_message")
    return of_message.select(
        "_conv",
        "_message",
        F.coalesce("_role", F.lit("")).alias("_role"),
        F.greatest(F.max("_anew").over(upto), "_edit").alias("_since"),
    )


def standing(events: DataFrame) -> DataFrame:
    """conv_id, message, _role and _text of every message of which events still count."""
    of_message = cuts(events)
    same = events["conv_id"].eqNullSafe(of_message["_conv"])
    same &= events["message"].eqNullSafe(of_message["_message"])
    last = events.join(of_message, same).where(F.col("_since").isNull() | (F.col("seq") >= F.col("_since")))
    parts = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    return last.groupBy("conv_id", "message").agg(
        F.first("_role").alias("_role"),
        F.array_join(F.array_sort(F.collect_list(parts))["text"], "").alias("_text"),
    )


def formatted(events: DataFrame) -> DataFrame:
    """conv_id, piece, loss_begin and loss_end of every message that stands, in order.

    A conversation's text is its pieces one after another; they stay in one partition and in
    order. An event of unknown kind appends its text like a delta. NULL role and text are
    empty. An empty log gives no rows.
    """
    rows_in = standing(written(events, "chat-log"))
    kinds = ", ".join(f"{c} {rows_in.schema[c].dataType.simpleString()}" for c in ("conv_id", "message"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(batch.column("_role").to_pylist(), batch.column("_text").to_pylist(), strict=True)
            found = [render(role, text) for role, text in told]
            pieces, begins, ends = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("message"),
                    pa.array(pieces, pa.string()),
                    pa.array(begins, pa.int32()),
                    pa.array(ends, pa.int32()),
                ],
                ["conv_id", "message", "piece", "loss_begin", "loss_end"],
            )

    made = rows_in.mapInArrow(rows, f"{kinds}, piece string, loss_begin int, loss_end int")
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.select("conv_id", "piece", "loss_begin", "loss_end")


def read_back(pieces: DataFrame) -> DataFrame:
    """What each conversation's formatted text says: a row of counts and digests.

    Turns are parsed from the pieces, which come in order. Only digests are held, so that a
    conversation may have any number of turns.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def told(s: list) -> tuple:
            conv, n, turns, chars, loss, length = s
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), length

        def batch_of(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *map(pa.array, columns[1:])], NAMES
            )

        id_type = None
        for batch in batches:
            out, id_type = [], batch.column("conv_id").type
            columns = (c.to_pylist() for c in batch.columns)
            for conv, piece, begin, end in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(told(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(piece)
                if end > begin:
                    learned = unescape(piece[begin:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                for header, body in _TURN.findall(piece):
                    state[1] += 1
                    state[2].update(f"{_role(header)}\n{unescape(body)}\n".encode())
            if out:
                yield batch_of(out, id_type)
        if state is not None:
            yield batch_of([told(state)], id_type)

    return pieces.mapInArrow(
        rows,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint,"
        " loss_sha256 string, formatted_chars bigint",
    )


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
