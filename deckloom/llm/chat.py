"""Chat formatting by schema fingerprints.

Nested field paths of a table, and of each row the paths that hold something,
are hashed; the hash selects a declarative mapping from one of many layouts
(messages, speaker and value pairs, prompt and response, instruction and
output, rows by turn) to canonical turns.  A template then marks the turns,
with its own control strings in texts escaped reversibly, and says which
characters take part in the loss.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: DataType, prefix: str = "") -> list[str]:
    """Nested paths of a schema with their kinds: ``messages[].role:string``."""
    if isinstance(schema, StructType):
        return sorted(chain.from_iterable(field_paths(f.dataType, f"{prefix}.{f.name}".lstrip(".")) for f in schema))
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    kind = schema.typeName()
    return [f"{prefix}:{'string' if kind in ('varchar', 'char') else 'number' if isinstance(schema, NumericType) else kind}"]


def fingerprint(paths) -> str:
    """Hash of a set of paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A mapping: the paths it needs, those it can use, and its turns as an
    SQL expression of the table's columns.  With ``order``, a row is one turn
    and the expression is that turn; a conversation's rows come in that order."""

    name: str
    needs: tuple[str, ...]
    uses: tuple[str, ...]
    turns: str
    order: str | None = None


def fingerprint_map(layouts) -> dict[str, str]:
    """The layouts that each set of paths selects, by its fingerprint: one,
    or several, joined by ``+``, whose paths a row fills at once."""
    out: dict[str, str] = {}
    for some in chain.from_iterable(combinations(layouts, n) for n in range(1, len(layouts) + 1)):
        needs = {p for x in some for p in x.needs}
        uses = sorted({p for x in some for p in x.uses} - needs)
        for extra in chain.from_iterable(combinations(uses, n) for n in range(len(uses) + 1)):
            out.setdefault(fingerprint([*needs, *extra]), "+".join(x.name for x in some))
    return out


#: Speakers of foreign layouts, by their names in canonical turns.
SPEAKERS = {
    "human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant",
    "model": "assistant", "ai": "assistant", "agent": "assistant", "chatbot": "assistant",
}


def _speaker(column: str) -> str:
    known = ", ".join(f"'{a}', '{b}'" for a, b in SPEAKERS.items())
    return f"coalesce(element_at(map({known}), lower(trim({column}))), lower(trim({column})), '')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _pair(first: str, second: str, system: str | None = "system") -> str:
    lead = f"if({system} IS NULL, array(), array({_turn('system', system)}))" if system else "array()"
    return f"concat({lead}, array({_turn('user', first)}, {_turn('assistant', second)}))"


LAYOUTS = (
    Layout("messages", ("messages[].content:string", "messages[].role:string"), (),
           f"transform(messages, m -> named_struct('role', {_speaker('m.role')}, 'text', coalesce(m.content, '')))"),
    Layout("speaker_value", ("conversations[].from:string", "conversations[].value:string"), ("system:string",),
           "concat(if(system IS NULL, array(), array(" + _turn("system", "system") + ")), transform(conversations, "
           f"m -> named_struct('role', {_speaker('m.from')}, 'text', coalesce(m.value, ''))))"),
    Layout("instruction_output", ("instruction:string", "output:string"), ("input:string", "system:string"),
           _pair("concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))", "output")),
    Layout("prompt_response", ("prompt:string", "response:string"), ("system:string",), _pair("prompt", "response")),
    Layout("prompt_completion", ("completion:string", "prompt:string"), ("system:string",), _pair("prompt", "completion")),
    Layout("question_answer", ("answer:string", "question:string"), ("system:string",), _pair("question", "answer")),
    Layout("rows_by_turn", ("role:string", "text:string", "turn:number"), (),
           "named_struct('role', coalesce(role, ''), 'text', coalesce(text, ''))", order="turn"),
)


def _column_of(path: str) -> str:
    return path.split(":")[0].split("[]")[0].split(".")[0]


def canonical_turns(table: DataFrame, conv_id: str) -> DataFrame:
    """(conv_id, layout, turns) of a table of any known layout.

    The paths of a table's schema that layouts name, hashed, select a layout
    for the whole table if it is one of rows by turn: one row a conversation,
    ordered by turn, null turns first, ties by role and text; repeated rows
    stay, and rows of a null id are one conversation.  Other tables give one
    row a row: the paths that are not null there, hashed, select the mapping,
    so one table may mix layouts.  A row that fills several layouts has the
    turns of each, in the order of ``LAYOUTS``.  Rows of no known layout have a
    null layout and no turns.  Null roles and texts are empty; an empty table
    gives no rows.  Columns that no layout names are ignored, whatever their
    names.
    """
    own = {p for p in field_paths(table.schema) if _column_of(p) != conv_id}
    usable = [x for x in LAYOUTS if set(x.needs) <= own]
    known = sorted(own & {p for x in usable for p in (*x.needs, *x.uses)})
    selects = fingerprint_map(usable)
    if by_turn := [x for x in usable if x.order and selects.get(fingerprint(known)) == x.name]:
        return _grouped(table, conv_id, by_turn[0])
    usable = [x for x in usable if not x.order]
    if not usable:
        return table.select(F.col(conv_id).alias("conv_id"), F.lit(None).cast("string").alias("layout"), F.array().cast(TURNS).alias("turns"))
    known = sorted(own & {p for x in usable for p in (*x.needs, *x.uses)})
    missing = {_column_of(p) for x in usable for p in x.uses} - {_column_of(p) for p in known}
    rows = table.select(
        F.col(conv_id).alias("__id"), *sorted({_column_of(p) for p in known}), *[F.lit(None).cast("string").alias(c) for c in sorted(missing)]
    )
    held = [F.when(F.col(_column_of(p)).isNotNull(), F.lit(p)) for p in known]
    print_ = F.sha2(F.array_join(F.array_compact(F.array(*held)), "\n"), 256)
    mapping = F.create_map(*[F.lit(y) for item in fingerprint_map(usable).items() for y in item])
    rows = rows.withColumn("__layout", F.try_element_at(mapping, print_))
    chosen = F.split(F.coalesce("__layout", F.lit("")), r"\+")
    none = F.array().cast(TURNS)
    turns = [F.when(F.array_contains(chosen, x.name), F.expr(x.turns).cast(TURNS)).otherwise(none) for x in usable]
    return rows.select(F.col("__id").alias("conv_id"), F.col("__layout").alias("layout"), F.concat(*turns).alias("turns"))


def _grouped(table: DataFrame, conv_id: str, layout: Layout) -> DataFrame:
    turn = F.struct(F.col(layout.order).alias("at"), F.expr(layout.turns).alias("turn"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["turn"]).cast(TURNS)
    grouped = table.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("turns"))
    return grouped.select("conv_id", F.lit(layout.name).alias("layout"), "turns")


@dataclass(frozen=True)
class Template:
    """Marks of turns; ``controls`` are further strings that texts may not
    bring in unescaped."""

    start: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: str = "assistant"

    def escape(self, text: Column) -> Column:
        """A backslash follows each backslash and the first character of each
        control string, so that none is left whole."""
        strings = [self.start, self.after_role, self.end, *self.controls]
        parts = [r"\\", *[f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in strings]]
        return F.regexp_replace(text, F.lit("|".join(parts)), F.lit(r"$0\\"))

    @staticmethod
    def unescape(text: Column) -> Column:
        """The inverse: of each backslash and what it doubles, one goes."""
        return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Add ``formatted`` and ``loss``: (start, length) in code points of each
    learned turn's escaped text.

    Null turns, and none, give an empty text and no spans.  Rows are formatted
    one by one; an empty table gives no rows; columns of the two names are
    replaced and others kept.
    """
    t = template or Template()
    marked = F.transform(
        "turns",
        lambda x: F.struct(
            F.concat(F.lit(t.start), t.escape(x["role"]), F.lit(t.after_role)).alias("head"),
            t.escape(x["text"]).alias("text"),
            (x["role"] == t.learned).alias("learned"),
        ),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["head"])
        size = F.length(x["text"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        spans = F.when(x["learned"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((begin + size + F.lit(len(t.end))).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("__marked", lambda x: F.concat(x["head"], x["text"], F.lit(t.end))), "")
    rows = conversations.withColumn("__marked", F.coalesce(marked, F.expr("filter(array(named_struct('head', '', 'text', '', 'learned', false)), x -> false)")))
    kept = [c for c in conversations.columns if c not in ("formatted", "loss")]
    return rows.select(*kept, text.alias("formatted"), F.aggregate("__marked", nothing, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Turns and learned text read from ``formatted`` and ``loss`` alone."""
    t = template or Template()
    pieces = F.split("formatted", re.escape(t.end), -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.split(F.substr(piece, F.lit(len(t.start) + 1)), re.escape(t.after_role), 2)
        return F.struct(t.unescape(cut[0]).alias("role"), t.unescape(cut[1]).alias("text"))

    learned = F.transform(
        "loss", lambda x: t.unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))
    )
    return formatted.withColumns({"turns_read": F.transform(pieces, turn), "loss_read": F.array_join(learned, "")})


def digests(read: DataFrame) -> DataFrame:
    """What the formatted table holds, as counts and hashes."""
    line = F.lit("\n")
    told = F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], line, x["text"], line)), "")
    return read.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_read").cast("long").alias("loss_chars"),
        F.sha2("loss_read", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
