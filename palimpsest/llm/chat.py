r"""Chat formatting by event-sourced reconstruction.

An event is (conversation, turn, seq, kind, role, text) with kind one of
``message`` (opens a message; a further one of the same turn follows the
first), ``delta`` (the text is appended), ``edit`` and ``regenerate`` (the text
replaces what there is) and ``retract`` (the message goes).  Events are dealt out by
conversation, sorted by (turn, seq) and folded turn by turn, so memory holds
one message and not one conversation.

The rendered form of a turn is ``<|im_start|>ROLE\nTEXT<|im_end|>\n``; inside
role and text a backslash is doubled, ``<|`` becomes ``<\|`` and a role's line
break ``\n``, which is undone exactly when reading back.  A conversation is
rendered into consecutive chunks of about ``CHUNK`` characters with the spans
under the loss mask.

Defined cases: null text is empty; null role is empty; null turns sort first;
null conversation ids form one conversation; events equal in (turn, seq) apply
in order of (kind, role, text); a conversation whose every turn was retracted
gives no rows; an empty table gives none.  A conversation's digest runs over
its turns in order, so one conversation is one task's stream, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ddl, table, tuned

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 1 << 20
ESCAPED = re.compile(r"\\(.)", re.S)
CHUNKS = "conv:long chunk:long text:string loss:longs"
DIGESTS = "conv_id:long n_turns:long turns_sha256:string loss_chars:long loss_sha256:string formatted_chars:long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn and where its text begins and ends in it."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """Final (conv, role, text) of each turn, from sorted (conv, turn, kind, role, text)."""
    at, role, parts, gone = None, "", [], False
    for conv, turn, kind, r, text in events:
        if at != (conv, turn) or kind == "message":
            if at is not None and not gone:
                yield at[0], role, "".join(parts)
            at, role, parts, gone = (conv, turn), "", [], False
        if kind == "retract":
            parts, gone = [], True
            continue
        if kind != "delta":
            parts = []
        gone = False
        role = r if r is not None else role
        parts.append(text or "")
    if at is not None and not gone:
        yield at[0], role, "".join(parts)


def format_events(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered chunks (conv, chunk, text, loss) in order within each task.

    ``events`` has columns conv, turn, seq, kind, role, text.  ``loss`` lists
    begin and end of each masked span, in code points of the chunk.
    """
    tuned(events.sparkSession)
    order = ["conv", "turn", "seq", "kind", "role", "text"]
    dealt = events.select(*order).repartition("conv").sortWithinPartitions(*order)

    def run(batches):
        def rows():
            for b in batches:
                c = b.to_pydict()
                yield from zip(c["conv"], c["turn"], c["kind"], c["role"], c["text"], strict=True)

        out, ready, conv, chunk, held, loss, size = [], 0, None, 0, [], [], 0
        for c, role, text in folded(rows()):
            if held and (c != conv or size >= CHUNK):
                out.append((conv, chunk, "".join(held), loss))
                ready += size
                chunk, held, loss, size = chunk + 1, [], [], 0
                if ready >= CHUNK or len(out) >= 2000:
                    yield table(CHUNKS, out)
                    out, ready = [], 0
            if c != conv:
                conv, chunk = c, 0
            whole, begin, end = render(role, text)
            if role == loss_role:
                loss += [size + begin, size + end]
            held.append(whole)
            size += len(whole)
        if held:
            out.append((conv, chunk, "".join(held), loss))
        yield table(CHUNKS, out)

    return dealt.mapInArrow(run, ddl(CHUNKS))


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered chunk, unescaped."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        line, end = text.index("\n", at), text.index(END, at)
        yield unescape(text[at + len(START) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, from chunks that follow one another in their tasks."""

    def run(batches):
        out, conv, state = [], None, None

        def end():
            n, turns, chars, loss, size = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            c = b.to_pydict()
            for k, chunk, text, spans in zip(c["conv"], c["chunk"], c["text"], c["loss"], strict=True):
                if state is None or k != conv or chunk == 0:
                    if state is not None:
                        end()
                    conv, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for i in range(0, len(spans), 2):
                    masked = unescape(text[spans[i] : spans[i + 1]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(out) >= 2000:
                yield table(DIGESTS, out)
                out = []
        if state is not None:
            end()
        yield table(DIGESTS, out)

    return chunks.mapInArrow(run, ddl(DIGESTS))


def op9(spark, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], told.schema)
    rows = told.unionByName(probe).select("conv", F.col("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return read_back(format_events(rows))
