"""Chat formatting by schema fingerprints.

Records of many layouts (JSON texts) become conversations of one layout. The
set of nested field paths of a record (``messages[].role``) is reduced to the
paths that some mapping names, so that ids, scores and other extra fields do
not matter, and hashed; the hash selects a declarative mapping. A mapping lists
the turns a layout gives: one turn with a fixed role from a path, or one turn
for each element of a list with its role and text from paths below it. Paths
that may be missing are marked; the registry holds the fingerprint of every
choice of them, and refuses two mappings with one fingerprint.

Turns are written in a template of control strings. Control strings inside a
text are escaped: ``<|`` gets a backslash in between, and so does ``<\\|``, so
the inverse is exact. The loss mask is a list of spans (code points of the
formatted text) that cover the text of each trained turn and nothing else.
``read_back`` gives turns and masked texts from the formatted text alone.

Each record is worked on alone, so records are never shuffled; only rows by
turn are (``records_of_turns``), by their conversation.

Defined results: a record that is null, no JSON, or no object has no
fingerprint, one whose fingerprint no mapping has keeps its own; both stay with
a null layout, no turns and a null text. Null texts and roles are empty ones;
values that are no strings give their JSON text; half surrogates are replaced.
A missing or null path that may be missing gives no turn. Rows by turn are
ordered by turn (null first), then role, then text, and repeated rows are
repeated turns; a row without a conversation id is a conversation of its own.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import map_batches, row_struct, with_fields

# ---- field paths ------------------------------------------------------------------------------------------------

_PLAIN = re.compile(r"\w+")


def _step(key: str) -> str:
    return key if _PLAIN.fullmatch(key) else json.dumps(key)


def field_paths(record: object) -> set[str]:
    """The paths of all fields below a record, at any depth; ``[]`` stands for the elements of a list."""
    found: set[str] = set()
    todo: list[tuple[str, object]] = [("", record)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            for key, below in value.items():
                name = f"{path}.{_step(key)}" if path else _step(key)
                found.add(name)
                if isinstance(below, (dict, list)):
                    todo.append((name, below))
        elif isinstance(value, list):
            todo += [(f"{path}[]", v) for v in value if isinstance(v, (dict, list))]
    return found


def values_at(record: object, path: str) -> list:
    """All values at a path, in order; a missing key gives none, ``[]`` goes through lists."""
    here = [record]
    for step in re.findall(r'"(?:[^"\\]|\\.)*"|\w+|\[\]', path):
        if step == "[]":
            here = [v for h in here if isinstance(h, list) for v in h]
        else:
            key = json.loads(step) if step.startswith('"') else step
            here = [h[key] for h in here if isinstance(h, dict) and key in h]
    return here


def as_text(value: object) -> str:
    """A value's text: strings as they are, null empty, the texts of a list of parts together, others as JSON."""
    if value is None:
        return ""
    if isinstance(value, list) and all(isinstance(v, str) or (isinstance(v, dict) and "text" in v) for v in value):
        return "".join(v if isinstance(v, str) else as_text(v["text"]) for v in value)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


# ---- mappings ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Say:
    """One turn of a fixed role; texts of several paths are joined by an empty line, empty ones left out."""

    role: str
    paths: tuple[str, ...]
    may_miss: bool = False

    def turns(self, record: object) -> list[tuple[str, str]]:
        values = [v for p in self.paths for v in values_at(record, p)[:1]]
        if self.may_miss and all(v is None for v in values):
            return []
        return [(self.role, "\n\n".join(filter(None, map(as_text, values))))]


@dataclass(frozen=True)
class Each:
    """One turn for each element of the list at ``path``, its role (renamed by ``roles``) and text from its own paths."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, record: object) -> list[tuple[str, str]]:
        renamed = dict(self.roles)
        out = []
        for element in values_at(record, f"{self.path}[]"):
            role = as_text(next(iter(values_at(element, self.role)), None))
            out.append((renamed.get(role, role), as_text(next(iter(values_at(element, self.text)), None))))
        return out


@dataclass(frozen=True)
class Layout:
    """A mapping: its name, its turns in order, and further paths that a record has (``also``) or may have (``may``)."""

    name: str
    turns: tuple[Say | Each, ...]
    also: tuple[str, ...] = ()
    may: tuple[str, ...] = ()

    def paths(self) -> tuple[set[str], set[str]]:
        """The paths every record of the layout has, and those it may have. Containers on the way count."""
        must, may = set(self.also), set(self.may)
        for turn in self.turns:
            if isinstance(turn, Each):
                must |= {turn.path, f"{turn.path}[].{turn.role}", f"{turn.path}[].{turn.text}"}
            else:
                (may if turn.may_miss else must).update(turn.paths)
        parts = re.compile(r"(?:\[\])?\.")
        must |= {p[:m.start()] for p in must for m in parts.finditer(p)}
        return must, may - must

    def read(self, record: object) -> list[tuple[str, str]]:
        return [t for turn in self.turns for t in turn.turns(record)]


def fingerprint(paths: set[str]) -> int:
    """The hash of a set of paths."""
    import xxhash
    return xxhash.xxh64_intdigest("\n".join(sorted(paths))) - (1 << 63)


@dataclass(frozen=True)
class Registry:
    """Mappings by fingerprint."""

    layouts: tuple[Layout, ...]
    known: frozenset[str] = field(init=False, default=frozenset())
    by_print: dict[int, tuple[frozenset[str], Layout]] = field(init=False, default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        known: set[str] = set()
        for layout in self.layouts:
            known.update(*layout.paths())
        object.__setattr__(self, "known", frozenset(known))
        for layout in self.layouts:
            must, may = layout.paths()
            for size in range(len(may) + 1):
                for some in itertools.combinations(sorted(may), size):
                    paths = frozenset(must | set(some))
                    taken = self.by_print.setdefault(fingerprint(paths), (paths, layout))
                    if taken != (paths, layout):
                        raise ValueError(f"layouts {taken[1].name} and {layout.name} have one fingerprint")

    def select(self, record: object) -> tuple[int, Layout | None]:
        """The fingerprint of a record and its mapping."""
        paths = field_paths(record) & self.known
        key = fingerprint(paths)
        found = self.by_print.get(key)
        return key, found[1] if found and found[0] == paths else None


_SHARE_ROLES = (("human", "user"), ("gpt", "assistant"))

#: Layouts of public instruction and chat data sets.
PUBLIC = Registry((
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("message_parts", (Each("messages", "role", "content"),),
           also=("messages[].content[].text",), may=("messages[].content[].type",)),
    Layout("share", (Say("system", ("system",), may_miss=True), Each("conversations", "from", "value", _SHARE_ROLES))),
    Layout("dialog", (Each("data.dialog", "speaker", "utterance"),)),
    Layout("instruction", (Say("system", ("system",), may_miss=True), Say("user", ("instruction",)),
                           Say("assistant", ("output",)))),
    Layout("instruction_input", (Say("system", ("system",), may_miss=True), Say("user", ("instruction", "input")),
                                 Say("assistant", ("output",)))),
    Layout("completion", (Say("system", ("system",), may_miss=True), Say("user", ("prompt",)),
                          Say("assistant", ("completion",)))),
    Layout("response", (Say("system", ("system",), may_miss=True), Say("user", ("prompt",)),
                        Say("assistant", ("response",)))),
    Layout("question", (Say("system", ("system",), may_miss=True), Say("user", ("question",)),
                        Say("assistant", ("answer",)))),
))


# ---- template ---------------------------------------------------------------------------------------------------

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(turns: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{_OPEN}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role in trained:
            spans.append((at, at + len(body)))
        at += len(body) + len(_CLOSE) + 1
        out += [head, body, _CLOSE, "\n"]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for piece in formatted.split(_OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape_role(role), unescape(rest[:-len(_CLOSE) - 1])))
    return turns


# ---- the operator -----------------------------------------------------------------------------------------------

_TURNS = "array<struct<role:string,text:string>>"


def _loaded(record: str | None) -> object:
    if record is None:
        return None
    try:
        return json.loads(record)
    except (ValueError, RecursionError):
        return None


def format_records(df: DataFrame, record_col: str = "record", carry: tuple[str, ...] = ("conv_id",),
                   registry: Registry = PUBLIC, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per record: ``row`` (struct of ``carry``), ``fingerprint``, ``layout``, ``turns``, ``formatted`` and
    ``loss_spans`` (start and end, code points of ``formatted``)."""
    packed = df.select(row_struct(carry), F.col(f"`{record_col}`").cast("string").alias("record"))
    roles = frozenset(trained)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("fingerprint", "layout", "turns", "formatted", "loss_spans")}
        for text in batch["record"]:
            record = _loaded(text)
            key, layout = registry.select(record) if isinstance(record, dict) else (None, None)
            out["fingerprint"].append(key)
            out["layout"].append(layout and layout.name)
            turns = layout.read(record) if layout else None
            formatted, spans = render(turns, roles) if layout else (None, None)
            out["turns"].append(turns and [{"role": r, "text": t} for r, t in turns] if layout else None)
            out["formatted"].append(formatted)
            out["loss_spans"].append([{"start": a, "end": b} for a, b in spans] if layout else None)
        return {"row": batch["row"]} | out

    return map_batches(packed, run, with_fields(packed, "row", (
        f"fingerprint bigint, layout string, turns {_TURNS}, formatted string, "
        "loss_spans array<struct<start:bigint,end:bigint>>")))


def layouts_found(formatted: DataFrame) -> DataFrame:
    """``fingerprint``, ``layout`` and the records that have them, to see which layouts no mapping covers."""
    return formatted.groupBy("fingerprint", "layout").agg(F.count("*").alias("n_records"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``row``, ``formatted``, and from the formatted text: ``turns`` and ``loss_texts`` (unescaped, one a masked span)."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        turns, texts = [], []
        for text, spans in zip(batch["formatted"], batch["loss_spans"]):
            turns.append(None if text is None else [{"role": r, "text": t} for r, t in parse(text)])
            texts.append(None if text is None else [unescape(text[s["start"]:s["end"]]) for s in spans or ()])
        return {"row": batch["row"], "formatted": batch["formatted"], "turns": turns, "loss_texts": texts}

    packed = formatted.select("row", "formatted", "loss_spans")
    return map_batches(packed, run, with_fields(packed, "row", f"formatted string, turns {_TURNS}, loss_texts array<string>"))


def turn_lists(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Rows by turn gathered: ``conv_id`` and ``turns`` (array of ``turn, role, text``, in order)."""
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"),
                     F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"),
                              F.col(f"`{text_col}`").alias("text")).alias("t"))
    # rows without an id stay apart
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return (rows.withColumn("own", own).groupBy("conv_id", "own")
            .agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("own"))


def message_record(turns: Column) -> Column:
    """The turns of ``turn_lists`` as a record of the ``messages`` layout."""
    return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
                              .alias("messages")), {"ignoreNullFields": "false"})


def records_of_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """Rows by turn as records (JSON): ``conv_id``, ``record``."""
    return turn_lists(df, conv_col, turn_col, role_col, text_col).select("conv_id", message_record(F.col("turns")).alias("record"))
