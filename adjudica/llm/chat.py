"""Chat formatting: records of several layouts to canonical turns, and turns to one marked string.

A record is JSON, or a row of a table whose columns are the fields (``row_turns``, which takes texts of
any length as they are). The nested field paths that any layout knows are looked up in it, and the hash of
those present is the record's schema fingerprint. The fingerprint selects a declarative mapping,
which says where roles and texts are. Fields that no layout knows do not count.

The template starts each turn with ``<s>`` and marks its role. Control strings inside a text are
escaped by a backslash after their first character (and a backslash by another), so no text can end
a turn, and reading takes the texts back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Characters of a string that the reader of JSON takes. ``try_parse_json`` stops at 20,000,000.
LONGEST = 2**31 - 1
#: A bracket that would start a control string.
CONTROL = r"([<\[])(?=/?s>|/?INST\]|/?SYS\]|/?ROLE)"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``turns``: (role, paths) in order, for records that name their parts; paths that are there are
    joined by an empty line, and a turn without any is left out. ``items``: (list, role field, text
    field) for lists of messages. ``row``: (role field, text field) where the record is one turn.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def fingerprints(self) -> list[str]:
        """The path sets this layout stands for: the required ones with any of the optional ones."""
        return [
            path_key(self.required + some)
            for n in range(len(self.optional) + 1)
            for some in combinations(self.optional, n)
        ]


LAYOUTS = (
    Layout("turn", ("role", "text"), row=("role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), ("system",),
           turns=(("system", ("system",)),), items=("messages", "role", "content")),
    Layout("exchange", ("conversations[].from", "conversations[].value"), ("system",),
           turns=(("system", ("system",)),), items=("conversations", "from", "value"),
           roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("completion", ("prompt", "completion"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), ("context",),
           turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def path_key(paths: tuple[str, ...] | list[str]) -> str:
    return "|".join(sorted(paths))


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for p in layout.required + layout.optional})


def _has(record: Column, path: str) -> Column:
    """Whether the path is there, also with a JSON null. Lists are judged by their first item."""
    return F.try_variant_get(record, "$." + path.replace("[]", "[0]"), "variant").isNotNull()


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known field paths that the variant ``record`` has."""
    present = [F.when(_has(record, p), F.lit(p)) for p in known_paths(layouts)]
    return F.xxhash64(F.concat_ws("|", *present))


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )


def _turns(record: Column, layout: Layout) -> Column:
    if layout.row:
        role, text = layout.row
        return F.array(_turn(_text(record, role), _text(record, text)))
    parts = []
    for role, paths in layout.turns:
        texts = F.array_compact(F.array(*[_text(record, p) for p in paths]))
        filled = F.filter(texts, lambda t: t != "")
        required = any(p in layout.required for p in paths)
        turn = F.array(_turn(F.lit(role), F.array_join(filled, "\n\n")))
        nothing = F.filter(turn, lambda t: F.lit(False))
        parts.append(turn if required else F.when(F.size(filled) > 0, turn).otherwise(nothing))
    if layout.items:
        items, role_field, text_field = layout.items

        def one(item: Column) -> Column:
            role = _text(item, role_field)
            named = F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in layout.roles.items()], role)
            return _turn(named, _text(item, text_field))

        listed = F.try_variant_get(record, f"$.{items}", "array<variant>")
        parts.append(F.transform(listed, one))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def canonical_turns(
    records: DataFrame, payload: str = "payload", keys: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """``keys``, layout, pos, role, text: one row per turn, by the mapping of the record's fingerprint.

    A record that is no JSON, is above 128 MB as a variant, or has a fingerprint of no layout gives one
    row with NULL layout, pos, role and text; ``format_turns`` stops at such a row, so none gets lost.
    NULL texts and roles are empty. An empty table gives an empty result.
    """
    record = F.from_json(F.col(payload), "variant", {"maxStringLen": str(LONGEST)})
    parsed = records.select(*[F.col(k) for k in keys], record.alias("__record")).withColumn(
        "__print", fingerprint(F.col("__record"), layouts)
    )
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        fits = F.col("__print").isin([])
        for key in layout.fingerprints():
            fits = fits | (F.col("__print") == F.xxhash64(F.lit(key)))
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, _turns(F.col("__record"), layout)).otherwise(turns)
    return parsed.select(
        *keys, name.alias("layout"), F.posexplode_outer(turns).alias("pos", "__turn")
    ).select(*keys, "layout", "pos", "__turn.role", "__turn.text")


def row_turns(
    rows: DataFrame, keys: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """The same as ``canonical_turns`` for a table that has a turn in each row.

    The known fields among its columns other than ``keys`` select the layout, and roles and texts are
    taken from the columns as they are. A table of no such layout is an error.
    """
    known = {p for p in known_paths(layouts) if "[]" not in p}
    present = path_key([c for c in rows.columns if c in known and c not in keys])
    fitting = [layout for layout in layouts if layout.row and present in layout.fingerprints()]
    if not fitting:
        raise ValueError(f"no layout of one turn a row has the columns {present}")
    role, text = fitting[0].row
    return rows.select(
        *keys, F.lit(fitting[0].name).alias("layout"), F.lit(0).alias("pos"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marks(role: Column) -> tuple[Column, Column]:
    """What stands before and after a turn's text."""
    other = F.concat(F.lit("<s>[ROLE "), F.replace(escaped(role), F.lit("]"), F.lit("\\]")), F.lit("] "))
    before = (
        F.when(role == "user", F.lit("<s>[INST] "))
        .when(role == "system", F.lit("<s>[SYS] "))
        .when(role == "assistant", F.lit("<s> "))
        .otherwise(other)
    )
    after = (
        F.when(role == "user", F.lit(" [/INST]"))
        .when(role == "system", F.lit(" [/SYS]"))
        .when(role == "assistant", F.lit(" </s>"))
        .otherwise(F.lit(" [/ROLE]"))
    )
    return before, after


def format_turns(turns: DataFrame, conversation: str, order: tuple[str, ...]) -> DataFrame:
    """conversation, formatted, spans: one row per conversation.

    ``turns`` has role and text, which count as empty where NULL; ``order`` are the columns that
    put a conversation's turns in order (then role and text, where these tie; repeated rows are
    turns of their own). ``spans`` has, for each turn, the code point where it starts in the
    string, where its text starts, how long its text is, and ``loss``: whether it is under the loss
    mask, as texts of the assistant are. NULL is a conversation like others. A conversation becomes
    one value, so it must fit a task as such. Where ``turns`` has ``layout`` and ``pos``, a row without
    either is a record that could not be read: it is an error, not a blank turn.
    """
    if {"layout", "pos"} <= set(turns.columns):
        unread = F.concat(F.lit("a record of no known layout in conversation "), F.coalesce(F.col(conversation).cast("string"), F.lit("NULL")))
        stop = F.when(F.col("layout").isNull(), F.raise_error(unread).cast("string"))
        turns = turns.withColumn("role", F.coalesce(stop, F.col("role")))
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    before, after = _marks(F.col("__role"))
    rendered = (
        turns.select(F.col(conversation).alias("__conv"), F.struct(*order).alias("__order"), role.alias("__role"), text.alias("__text"))
        .withColumn("__body", escaped(F.col("__text")))
        .select(
            "__conv", "__order", "__role", "__text", before.alias("__before"), F.concat(before, "__body", after).alias("__piece"),
            F.length("__body").alias("__length"),
        )
    )
    earlier = (
        Window.partitionBy("__conv").orderBy("__order", "__role", "__text").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("__piece")).over(earlier), F.lit(0)).cast("long")
    placed = rendered.select(
        "__conv",
        F.struct(
            start.alias("start"),
            F.length("__before").alias("body"),
            F.col("__length").alias("length"),
            (F.col("__role") == "assistant").alias("loss"),
            F.col("__piece").alias("piece"),
        ).alias("__turn"),
    )
    whole = placed.groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    return whole.select(
        F.col("__conv").alias(conversation),
        F.array_join(F.transform("__turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            "__turns",
            lambda t: F.struct(
                t["start"].alias("start"),
                (t["start"] + t["body"]).alias("text_start"),
                t["length"].alias("length"),
                t["loss"].alias("loss"),
            ),
        ).alias("spans"),
    )


def pieces(formatted: Column) -> Column:
    """The string cut before each ``<s>``: one piece per turn."""
    return F.filter(F.split(formatted, "(?=<s>)"), lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string, by its marks alone."""

    def between(piece: Column, before: Column | int, after: int) -> Column:
        start = F.lit(before) if isinstance(before, int) else before
        return unescaped(piece.substr(start + 1, F.length(piece) - start - after))

    def one(piece: Column) -> Column:
        # The role of other turns ends at the first bracket that no backslash precedes.
        other = F.regexp_extract(piece, r"(?s)^<s>\[ROLE ((?:[^\]\\]|\\.)*)\] ", 1)
        return (
            F.when(piece.startswith("<s>[INST] "), F.struct(F.lit("user").alias("role"), between(piece, 10, 8).alias("text")))
            .when(piece.startswith("<s>[SYS] "), F.struct(F.lit("system").alias("role"), between(piece, 9, 7).alias("text")))
            .when(piece.startswith("<s> "), F.struct(F.lit("assistant").alias("role"), between(piece, 4, 5).alias("text")))
            .otherwise(
                F.struct(unescaped(other).alias("role"), between(piece, F.length(other) + 11, 8).alias("text"))
            )
        )

    return F.transform(pieces(formatted), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""

    def masked(pair: Column) -> Column:
        piece, span = pair["piece"], pair["span"]
        return unescaped(piece.substr((span["text_start"] - span["start"] + 1).cast("int"), span["length"]))

    both = F.arrays_zip(pieces(formatted).alias("piece"), spans.alias("span"))
    return F.array_join(F.transform(F.filter(both, lambda p: p["span"]["loss"]), masked), "")
