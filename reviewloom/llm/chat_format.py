"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns (operator 8).

A record's schema is the set of its nested field paths (``messages[].role``), its fingerprint their hash. The first
mapping whose required paths are all there is chosen once per fingerprint and then applied to every record with it.
Canonical turns (role, text) are written by a template of control strings; control strings inside texts and roles are
escaped reversibly, so a text cannot open or close a turn. The loss mask is the code points of the assistant's texts.

A record that is null, no JSON object, or of no known schema gives null turns and a reason. Null or absent texts and roles
are empty; numbers and booleans as texts take their JSON form. Fields beyond a mapping's own are ignored.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SPLIT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this template and of others, to be escaped in texts (fixed values).
CONTROLS = (TURN, SPLIT, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)))
_BACK = re.compile(r"\\(\\?)")


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are.

    ``turns``: (role, path of a text field), in order; or ``each``: list path, role field, text field, with ``roles``
    translating role names. ``optional`` paths give no turn where they are absent.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def required(self) -> set[str]:
        if self.each:
            return {f"{self.each[0]}[].{x}" for x in self.each[1:]}
        return {p for _, p in self.turns} - set(self.optional)

    def apply(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            items = _at(record, self.each[0]) or []
            found = [(_text(_at(x, self.each[1])), _text(_at(x, self.each[2]))) for x in items if isinstance(x, dict)]
            return [(self.roles.get(r, r), t) for r, t in found]
        return [(r, _text(_at(record, p))) for r, p in self.turns if p not in self.optional or _at(record, p) is not None]


MAPPINGS = (
    Mapping("messages", each=("messages", "role", "content")),
    Mapping("conversations", each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question", turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("nested_chat", each=("chat.turns", "speaker", "text"), roles={"human": "user", "bot": "assistant"}),
)


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a record; [] stands for any element of a list."""
    found: set[str] = set()
    left = [(prefix, value)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                path = f"{at}.{k}" if at else k
                found.add(path)
                left.append((path, v))
        elif isinstance(value, list):
            left.extend((f"{at}[]", v) for v in value)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the (start, end) code points of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SPLIT}", escape(text)
        parts += [head, body, END]
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(SPLIT)
        out.append((unescape(role), unescape(rest.removesuffix(END))))
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = "layout string, fingerprint string, reason string, turns array<struct<role:string,text:string>>, formatted string, loss array<struct<start:long,end:long>>"


def _format(columns: list[str], mappings: tuple[Mapping, ...], learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        for batch in batches:
            raw = batch.column("record")
            rows, size, first = [], 0, 0
            for i in range(len(batch)):
                try:
                    record = json.loads(raw[i].as_py() or "null")
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((None, None, "no object", None, None, None))
                else:
                    paths = field_paths(record)
                    name = fingerprint(paths)
                    if name not in chosen:
                        chosen[name] = next((m for m in mappings if m.required() <= paths), None)
                    mapping = chosen[name]
                    if mapping is None:
                        rows.append((None, name, "unknown schema", None, None, None))
                    else:
                        turns = mapping.apply(record)
                        text, spans = render(turns, learned)
                        size += len(text)
                        rows.append((mapping.name, name, None, [{"role": r, "text": t} for r, t in turns], text, [{"start": a, "end": b} for a, b in spans]))
                if size > 1 << 22 or i + 1 == len(batch):
                    kinds = (pa.string(), pa.string(), pa.string(), _TURNS, pa.string(), _SPANS)
                    made = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(rows)) for c in columns] + made, [*columns, "layout", "fingerprint", "reason", "turns", "formatted", "loss"])
                    rows, size, first = [], 0, i + 1

    return run


def format_chats(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, learned: str = LEARNED) -> DataFrame:
    """``records`` (JSON in column record, other columns are kept): layout, fingerprint, reason, turns, formatted, loss."""
    columns = [c for c in records.columns if c != "record"]
    fields = "".join(f"`{c}` {records.schema[c].dataType.simpleString()}, " for c in columns)
    return records.mapInArrow(_format(columns, mappings, learned), fields + _OUT)


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """Read back from the output: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            rows = []
            spans = batch.column("loss")
            texts = batch.column("formatted")
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans[i].as_py() or [])
                rows.append((len(turns), _sha(whole), len(learned), _sha(learned), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(key)] + [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], [key, *names])

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.select(key, "formatted", "loss").mapInArrow(
        run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def as_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> (conv_id, record): one JSON record per conversation, in a layout by its shape.

    Two turns of user and assistant make a prompt record, three with a system turn an instruction record; of the others,
    those with plain roles and an even id are lists of from and value, the rest lists of messages.
    """
    clean = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    text = lambda i: F.element_at("turns", i)["text"]
    plain = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    tagged = F.transform(
        "turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value"))
    )
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("completion"))))
        .when(
            roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
            F.to_json(F.struct(text(1).alias("system"), text(2).alias("instruction"), text(3).alias("output"))),
        )
        .when(plain & (F.col("conv_id") % 2 == 0), F.to_json(F.struct(tagged.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return rows.select("conv_id", record.alias("record"))


_PATTERN = "|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)).replace("\\<", "<")
#: The digests of ``digests(format_chats(as_records(...)))`` in DuckDB.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM %s
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '{_PATTERN}')) AS text_size,
         length(role) + length(role) - length(replace(role, '\\', '')) + len(regexp_extract_all(role, '{_PATTERN}')) AS role_size
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       sum(role_size + text_size + {len(TURN + SPLIT + END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
