"""Chat formatting.

Schema fingerprinting: a record's nested field paths (`messages[].role`), as far as any mapping knows them, are sorted and
hashed; the hash selects a declarative mapping that turns the record into canonical turns (conversation, turn, role, text).
A typed table has one fingerprint, that of its schema, and is converted by DataFrame functions; a column of JSON records
has one for each row.

The template is `<|im_start|>role newline text<|im_end|> newline`. Inside roles and texts each `<`, backslashes, `|` gets
one backslash more, so that no control string is left and taking one away restores the text; roles have line ends and
backslashes escaped as well. The loss mask is a span of code points in each assistant turn's formatted string: its text.

Roles of other layouts get their usual name (ROLES): "human" is read back as "user". formatted_conversations() joins the
turns of a conversation into one text with the spans of its loss mask; read_back() gives digests of conversations of any
length without putting them together.

Cases: null texts and roles are empty; turns are ordered by turn (nulls first), then role, then text, repeated rows stay;
very long texts are one string each; records whose fingerprint no mapping knows give one turn each of role null and text null in canonical_turns_json() and raise
ValueError for a table; an empty table gives no rows; columns that no mapping names are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.frames import arrow_map

START, END = "<|im_start|>", "<|im_end|>"
#: Roles of other layouts and their canonical names; any other role stays as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """each: (list, role field, text field) of a list of turns; rows: (order, role, text) of a table by turn; said: (role, fields joined by a blank line) in order."""

    name: str
    each: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    said: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.rows:
            return set(self.rows)
        if self.each:
            return {f"{self.each[0]}[].{x}" for x in self.each[1:]} | {p for _, fields in self.said for p in fields}
        return {p for _, fields in self.said for p in fields}


MAPPINGS = (
    Mapping("turn_rows", rows=("turn", "role", "text")),
    Mapping("messages", each=("messages", "role", "content"), said=(("system", ("system",)),), optional=("system",)),
    Mapping("from_value", each=("conversations", "from", "value"), said=(("system", ("system",)),), optional=("system",)),
    Mapping("instruction_output", said=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("prompt_completion", said=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", said=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question_answer", said=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)
KNOWN = set().union(*(m.paths() for m in MAPPINGS))


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


def _register() -> dict[str, Mapping]:
    found = {}
    for m in MAPPINGS:
        for gone in chain.from_iterable(combinations(m.optional, k) for k in range(len(m.optional) + 1)):
            found.setdefault(fingerprint(m.paths() - set(gone)), m)
    return found


#: Fingerprint -> mapping, with each choice of a mapping's optional fields.
REGISTRY = _register()


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def record_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(record_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(record_paths(v, f"{at}[]") for v in value))
    return {at} if value is not None else set()


def canonical_role(role: Column) -> Column:
    known = F.create_map(*map(F.lit, chain.from_iterable(ROLES.items())))
    return F.coalesce(F.try_element_at(known, role), role)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turn, role, text) of a typed table."""
    paths = schema_paths(df.schema)
    mapping = REGISTRY.get(fingerprint(paths - {id_col}))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    if mapping.rows:
        turn, role, text = mapping.rows
        return df.select(id_col, F.col(turn).cast("long").alias("turn"), canonical_role(F.col(role)).alias("role"), F.col(text).alias("text"))
    said = lambda role, fields: F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fields if f in paths)).alias("text"))
    turns = F.array(*(said(r, fields) for r, fields in mapping.said if paths.intersection(fields))) if paths.intersection(*[set(chain.from_iterable(f for _, f in mapping.said))]) else None
    if mapping.each:
        listed, role, text = mapping.each
        own = F.transform(F.coalesce(F.col(listed), F.array().cast(df.schema[listed].dataType)), lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))
        turns = own if turns is None else F.concat(F.filter(turns, lambda x: x["text"] != ""), own)
    return df.select(id_col, F.posexplode(turns).alias("__turn", "__said")).select(id_col, F.col("__turn").cast("long").alias("turn"), canonical_role(F.col("__said.role")).alias("role"), F.col("__said.text").alias("text"))


def record_turns(record: str | None) -> list[tuple[str | None, str | None]]:
    """(role, text) of the turns of one JSON record."""
    try:
        value = json.loads(record or "")
        mapping = REGISTRY.get(fingerprint(record_paths(value))) if isinstance(value, dict) else None
    except ValueError:
        mapping = None
    if mapping is None or mapping.rows:
        return [(None, None)]
    turns = [(role, "\n\n".join(str(value[f]) for f in fields if value.get(f) not in (None, ""))) for role, fields in mapping.said if any(f in value for f in fields)]
    if mapping.each:
        listed, role, text = mapping.each
        turns = [t for t in turns if t[1]] + [(x.get(role), x.get(text)) for x in value[listed]]
    return [(ROLES.get(r, r), t) for r, t in turns]


def canonical_turns_json(df: DataFrame, record_col: str, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turn, role, text) of a column of JSON records whose layouts may differ."""
    df = df.select(id_col, record_col)
    schema = T.StructType([df.schema[id_col], T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, role, text) for i, record in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (role, text) in enumerate(record_turns(record))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((batch.schema.types[0], pa.int64(), pa.string(), pa.string()))], names=schema.names)

    return arrow_map(df, kernel, schema)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds `formatted`, and loss_start and loss_end (null but for assistant turns). A conversation is its turns' strings in order."""
    role = escaped(F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    mask = F.col("role") == "assistant"
    return turns.select(
        "*", F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.when(mask, F.char_length(head)).alias("loss_start"), F.when(mask, F.char_length(head) + F.char_length(text)).alias("loss_end"),
    )


def formatted_conversations(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted, loss): one string for each conversation and the spans (start, end) of its loss mask, in code points. A conversation must fit in one row."""
    turn = F.struct("turn", "role", "text", "formatted", "loss_start", "loss_end")
    whole = formatted.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        span = F.struct((acc["at"] + x["loss_start"]).alias("start"), (acc["at"] + x["loss_end"]).alias("end"))
        return F.struct((acc["at"] + F.char_length(x["formatted"])).alias("at"), F.when(x["loss_start"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return whole.select(id_col, F.array_join(F.transform("turns", lambda x: x["formatted"]), "").alias("formatted"), F.aggregate("turns", start, step)["out"].alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted string."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        if not rest.endswith(END + "\n"):
            raise ValueError("a turn has no end")
        turns.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return turns


#: What read_back() tells of each conversation.
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Digests of one conversation, turn by turn, so that a conversation of any length needs no more memory than a turn."""

    def __init__(self):
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            under = unescape(formatted[start:end])
            self.loss.update(under.encode())
            self.loss_chars += len(under)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation with DIGESTS, from the formatted turns alone."""
    ordered = formatted.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")
    schema = T.StructType([formatted.schema[id_col], *T._parse_datatype_string(DIGESTS).fields])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, kind = None, None, pa.null()
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

        for batch in batches:
            kind = batch.schema.types[0]
            for i, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or i != now:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    now, reader = i, _Reader()
                reader.add(*turn)
            if done:
                yield batch_of(done)
                done = []
        if reader is not None:
            yield batch_of([(now, *reader.row())])

    return arrow_map(ordered.select(id_col, "formatted", "loss_start", "loss_end"), kernel, schema)
