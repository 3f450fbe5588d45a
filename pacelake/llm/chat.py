"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor walks the parts and
flattens them into one string with a placeholder for each attachment, in order, and notes the
attachment's reference and how many tokens it stands for. A turn becomes

    <|turn|>ROLE<|says|>CONTENT<|end|>

Control strings inside texts and roles get a backslash behind their first character, and those that
already have some get one more, so unescaping gives back every text. Turns are formatted row by row; the
text of a conversation is its turns' strings joined in order of turn, role and content. The loss mask
is the content of each turn whose role is trained.

Null text counts as empty and so does a null role; a null list of parts has none, and null parts are
skipped; an unknown type of part is an error of that row and kept as text of its type name. Equal
rows are separate turns. Rows without a conversation belong to the conversation null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
KINDS = ("image", "audio", "document")
CONTROL = (TURN, SAYS, END, *(f"<|{kind}|>" for kind in KINDS), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
"""The template's own marks and those of common other templates."""

_TAILS = "|".join(re.escape(control[1:]) for control in sorted(CONTROL, key=len, reverse=True))
_HEADS = "".join(sorted({re.escape(control[0]) for control in CONTROL}))
_RAW = re.compile(rf"([{_HEADS}])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([{_HEADS}])\\(\\*)(?={_TAILS})")
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType()),
])
ATTACHMENT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType()),
])
FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("attachment_tokens", T.LongType()),
])


def escape(text: str) -> str:
    return _RAW.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class Visitor:
    """Flattens parts; one for each turn."""

    patch, audio_tokens_a_second, tokens_a_page = 14, 25, 512

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict[str, Any]] = []

    def visit(self, part: dict[str, Any]) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"kind": part["type"], "ref": part["ref"], "at": self.length, "tokens": tokens})
        self._write(f"<|{part['type']}|>")

    def visit_text(self, part: dict[str, Any]) -> None:
        self._write(escape(part["text"] or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        self._attach(part, -(-(part["width"] or 0) // self.patch) * -(-(part["height"] or 0) // self.patch))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach(part, int((part["seconds"] or 0) * self.audio_tokens_a_second + 0.5))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach(part, (part["pages"] or 0) * self.tokens_a_page)

    def visit_other(self, part: dict[str, Any]) -> None:
        self._write(escape(f"[{part['type'] or ''}]"))


def format_turn(role: str | None, parts: list[dict[str, Any] | None] | None, trained: bool) -> dict[str, Any]:
    visitor = Visitor()
    head = TURN + escape(role or "") + SAYS
    merged: list[dict[str, Any]] = []
    for part in parts or []:
        # Neighbouring texts are escaped as one: a control string may begin in one and end in the next.
        if part and part["type"] == "text" and merged and merged[-1]["type"] == "text":
            merged[-1] = merged[-1] | {"text": (merged[-1]["text"] or "") + (part["text"] or "")}
        elif part:
            merged.append(part)
    for part in merged:
        visitor.visit(part)
    content = "".join(visitor.out)
    attachments = [a | {"at": a["at"] + len(head)} for a in visitor.attachments]
    return {
        "formatted": head + content + END,
        "loss_start": len(head) if trained else None,
        "loss_end": len(head) + len(content) if trained else None,
        "attachments": attachments,
        "attachment_tokens": sum(a["tokens"] for a in attachments),
    }


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and content of each turn, unescaped."""
    return [(unescape(role), unescape(content)) for role, content in _TURN.findall(formatted)]


def text_parts(text_col: str = "text"):
    """A content of one text part."""
    values = {"type": F.lit("text"), "text": F.col(text_col)}
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields]
    return F.array(F.struct(*fields))


def format_chat(turns: DataFrame, parts_col: str = "parts", role_col: str = "role", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Replace ``parts_col`` by ``formatted``, the trained span, and the turn's attachments.

    ``loss_start`` and ``loss_end`` are code points within ``formatted``, as is an attachment's ``at``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(role_col).to_pylist()
            contents = batch.column(parts_col).to_pylist()
            rows = [format_turn(role, parts, role in trained) for role, parts in zip(roles, contents, strict=True)]
            columns = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(columns | {
                field.name: pa.array([row[field.name] for row in rows], to_arrow(field.dataType)) for field in FORMATTED.fields
            })

    turns = turns.drop(*[name for name in FORMATTED.names if name not in (parts_col, role_col)])
    names = [name for name in turns.columns if name != parts_col]
    return turns.mapInArrow(run, T.StructType([*(turns.schema[name] for name in names), *FORMATTED.fields]))


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}[kind]


class Digest:
    """What is read back from one conversation's formatted turns, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, content in parse_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{content}\n".encode())
        self.formatted_chars += len(formatted)
        if start is not None:
            trained = unescape(formatted[start:end])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self, conv_id: int | None) -> dict[str, Any]:
        return {
            "conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars,
        }


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """Parse the formatted turns again and digest them by conversation.

    Rows come sorted by conversation and are digested one after another, so a conversation of any
    length needs no more memory than one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ])
        here, digest = None, None
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if digest is None or conv != here:
                    if digest is not None:
                        done.append(digest.row(here))
                    here, digest = conv, Digest()
                digest.add(text, start, end)
            yield pa.RecordBatch.from_pylist(done, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([digest.row(here)], schema)

    partitions = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.select(conv_col, turn_col, role_col, "formatted", "loss_start", "loss_end")
    rows = rows.repartition(partitions, conv_col).sortWithinPartitions(conv_col, turn_col, role_col, "formatted")
    return rows.select(conv_col, "formatted", "loss_start", "loss_end").mapInArrow(run, READ_BACK)


def _sql_regex(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


_SQL_TAILS = "|".join(_sql_regex(control[1:]) for control in sorted(CONTROL, key=len, reverse=True))
_SQL_ESCAPED = r"regexp_replace(%s, '([<\[])(\\*)(" + _SQL_TAILS + r")', '\1\2\\\3', 'g')"

ORACLE_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(TURN + SAYS + END)} + length({_SQL_ESCAPED % 'role'}) + length({_SQL_ESCAPED % 'text'})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
