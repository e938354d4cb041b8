"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a JSON text, a variant, or a struct, as tables have it. A registry of declarative layouts says how it becomes canonical turns (role, text): prompt and response pairs, instructions with
an input, lists of messages under several names, messages whose content is a list of parts, or one row for each turn.

A record's fingerprint is a hash of its sorted nested field paths, of those that any layout needs; other fields don't count. A map from fingerprints, one for each admissible set of paths of each layout, selects the layout. The paths of a struct are those of its type, which
fix the layout of a whole table; where they select none, as in a table of several layouts that has the columns of all, they are those of the record's fields that aren't null. A record whose fingerprint isn't in the map is rejected, and counted and listed as such.

Template: each turn is

    <|ROLE|>
    TEXT</s>

and a line end. In roles and texts a backslash, <, [ and | become \\s, \\l, \\b and \\p, so no control string can begin inside them, whatever they say;
undoing the last four in the order l, b, p, s gives the text back. The loss mask is a list of spans of the formatted text, one for each assistant turn's text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window

#: The escapes, in the order in which they are made; undone in reverse order.
ESCAPES = [("\\", "\\s"), ("|", "\\p"), ("[", "\\b"), ("<", "\\l")]
TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "</s>\n"

#: Layouts. Each has a name, needed paths (a field's, "list[].field" or "struct.field", at any depth), optional ones that other layouts need, and what they mean.
LAYOUTS = [
    {"name": "turn_row", "need": ["role", "text", "turn"], "turns": [("$role", "text")]},
    {"name": "prompt_response", "need": ["prompt", "response"], "turns": [("system?", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt_completion", "need": ["completion", "prompt"], "turns": [("system?", "system"), ("user", "prompt"), ("assistant", "completion")]},
    {"name": "question_answer", "need": ["answer", "question"], "turns": [("user", "context+question"), ("assistant", "answer")]},
    {"name": "instruction", "need": ["instruction", "output"], "turns": [("system?", "system"), ("user", "instruction+input"), ("assistant", "output")]},
    {"name": "messages", "need": ["messages", "messages[].content", "messages[].role"], "may": ["prompt"], "list": ("messages", "role", "content")},
    {"name": "message_parts", "need": ["messages", "messages[].content", "messages[].content[].text", "messages[].role"], "may": ["prompt"], "list": ("messages", "role", "content[].text")},
    {"name": "conversations", "need": ["conversations", "conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "dialog", "need": ["dialog", "dialog[].speaker", "dialog[].text"], "list": ("dialog", "speaker", "text")},
    {"name": "conversation_turns", "need": ["conversation", "conversation.turns", "conversation.turns[].role", "conversation.turns[].text"], "list": ("conversation.turns", "role", "text")},
]
#: The paths that fingerprints are made of, and those under which they lie.
KNOWN = sorted({p for layout in LAYOUTS for p in layout["need"]})
PARENTS = sorted({p.rpartition(".")[0] for p in KNOWN if "." in p})
#: Other names of the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def admissible() -> list[tuple[list[str], int]]:
    """Every set of known paths that selects a layout, with the layout's number from 1."""
    sets = [(sorted([*layout["need"], *some]), i) for i, layout in enumerate(LAYOUTS, 1) for n in range(len(layout.get("may", [])) + 1) for some in combinations(layout.get("may", []), n)]
    if len({tuple(s) for s, _ in sets}) < len(sets):
        raise ValueError("two layouts have the same paths")
    return sets


def fingerprint(found: Column) -> Column:
    """Hash of the sorted paths, of those that a layout needs."""
    return F.xxhash64(F.array_join(F.sort_array(F.array_intersect(found, F.array(*map(F.lit, KNOWN)))), ","))


def layout_of(found: Column) -> Column:
    """The number, from 1, of the layout that the paths' fingerprint selects; null if none."""
    known = F.create_map(*[x for paths, i in admissible() for x in (fingerprint(F.array(*map(F.lit, paths))), F.lit(i))])
    return F.try_element_at(known, fingerprint(found))


def paths(record: Column) -> Column:
    """Field paths of a variant at any depth: the record's own and those under the known parents. A list has paths only if all its entries are objects."""
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    out = [F.coalesce(keys(record), F.array().cast("array<string>"))]
    for parent in PARENTS:
        at = F.array(record)
        for step in parent.split("."):
            at = F.transform(at, lambda v: F.try_variant_get(v, f"$.{step.removesuffix('[]')}", "variant"))  # noqa: B023
            if step.endswith("[]"):
                at = F.flatten(F.filter(F.transform(at, lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda v: v.isNotNull()))
        found = F.transform(at, keys)
        under = F.transform(F.array_distinct(F.flatten(found)), lambda k: F.concat(F.lit(f"{parent}."), k))  # noqa: B023
        out.append(F.when(F.forall(found, lambda k: k.isNotNull()), F.coalesce(under, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*out))


def paths_of(kind: StructType, above: str = "") -> list[str]:
    """Field paths of a struct type, at any depth."""
    out = []
    for f in kind:
        inner, name = f.dataType, above + f.name
        out.append(name)
        while isinstance(inner, ArrayType):
            inner, name = inner.elementType, name + "[]"
        if isinstance(inner, StructType):
            out += paths_of(inner, name + ".")
    return out


def layout_of_struct(record: Column, kind: StructType) -> Column:
    """The layout of a struct's type or, if that has none, of its fields that aren't null; null for a null record."""
    filled = [F.when(record[f.name].isNotNull(), F.array(*map(F.lit, paths_of(StructType([f]))))).otherwise(F.array().cast("array<string>")) for f in kind]
    return F.when(record.isNotNull(), F.coalesce(layout_of(F.array(*map(F.lit, paths_of(kind)))), layout_of(F.flatten(F.array(*filled)))))


def _turn(role: Column, text: Column, rename: bool = True) -> Column:
    role = F.coalesce(role, F.lit(""))
    if not rename:
        return F.struct(role.alias("role"), text.alias("text"))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.struct(F.coalesce(F.try_element_at(names, role), role).alias("role"), text.alias("text"))


def _turns(layout: dict, record: Column, kind: StructType | None) -> Column:
    """The layout's turns of a variant or, with its type, of a struct that has its paths."""
    get = lambda p: F.try_variant_get(record, f"$.{p}", "string") if kind is None else record[p].cast("string") if p in kind.names else F.lit(None).cast("string")
    if "list" in layout:
        path, role, text = layout["list"]
        text, _, part = text.partition("[].")
        if kind is None:
            items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`: string, `{text}`: {f'array<struct<`{part}`: string>>' if part else 'string'}>>")
        else:
            items = record
            for step in path.split("."):
                items = items[step]
        said = (lambda m: F.array_join(F.transform(m[text], lambda x: F.coalesce(x[part].cast("string"), F.lit(""))), "")) if part else (lambda m: m[text].cast("string"))
        return F.transform(items, lambda m: _turn(m[role].cast("string"), F.coalesce(said(m), F.lit(""))))
    turns = []
    for role, fields in layout["turns"]:
        there = [get(p) for p in fields.split("+")]
        text = F.array_join(F.filter(F.array(*there), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n") if len(there) > 1 else F.coalesce(there[0], F.lit(""))
        turn = F.array(_turn(get(role[1:]) if role[0] == "$" else F.lit(role.removesuffix("?")), text, rename=role[0] != "$"))
        turns.append(F.when(there[0].isNotNull(), turn).otherwise(F.array().cast(TURNS)) if role.endswith("?") else turn)
    return F.concat(*turns)


def _chosen(at: Column, record: Column, kind: StructType | None) -> Column:
    """The turns by the layout of that number. A struct's type rules out the layouts whose paths it doesn't have."""
    own = None if kind is None else set(paths_of(kind))
    found = F.lit(None).cast(TURNS)
    for i, layout in enumerate(LAYOUTS, 1):
        if own is None or own >= set(layout["need"]):
            found = F.when(at == i, _turns(layout, record, kind)).otherwise(found)
    return found


def canonical_turns(record: Column, kind: DataType | None = None) -> Column:
    """array<struct<role, text>> of a variant or, with its type, of a struct; null if its fingerprint selects no layout."""
    if isinstance(kind, StructType):
        return _chosen(layout_of_struct(record, kind), record, kind)
    return _chosen(layout_of(paths(record)), record, None)


def escaped(text: Column) -> Column:
    for what, to in ESCAPES:
        text = F.replace(text, F.lit(what), F.lit(to))
    return text


def unescaped(text: Column) -> Column:
    for what, to in reversed(ESCAPES):
        text = F.replace(text, F.lit(to), F.lit(what))
    return text


def _record(records: DataFrame, raw: str) -> Column:
    return F.try_parse_json(F.col(raw)) if records.schema[raw].dataType.typeName() == "string" else F.col(raw)


def rejects(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows of records that format_chats makes no turns of, with all their columns."""
    return records.where(canonical_turns(_record(records, raw), records.schema[raw].dataType).isNull())


def format_chats(records: DataFrame, conv_id: str = "conv_id", order: str = "turn", raw: str = "raw") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (array of start and end, code points, end exclusive), n_rejected (its records without turns).

    records: conv_id, order (place of the record in its conversation) and raw, a struct, a variant or a JSON text (the JSON parser refuses strings of over 20,000,000 characters, so such a record is rejected); a conversation may be one record of a list of turns, or a row for
    each turn. Ties in order are broken by the text. A record whose fingerprint selects no layout, or that isn't JSON, has no turns: it is counted in n_rejected and a row of rejects(); a conversation without any turns is in rejects() only; null texts and roles
    are empty. A conversation is one value of the result, so it has to fit a row: only its own turns meet in one task. Empty tables give empty ones; other columns aren't read.
    """
    rows, kind = records.select(F.col(conv_id).alias("conv_id"), F.col(order).alias("_order"), _record(records, raw).alias("_record")), records.schema[raw].dataType
    typed = isinstance(kind, StructType)
    if typed:
        rows = rows.withColumn("_layout", layout_of_struct(F.col("_record"), kind))
    else:  # the paths, and then the layout, are worked out once for each record
        rows = rows.withColumn("_paths", paths(F.col("_record"))).withColumn("_layout", layout_of(F.col("_paths")))
    found = _chosen(F.col("_layout"), F.col("_record"), kind if typed else None)
    turns = rows.select("conv_id", "_order", F.posexplode_outer(found).alias("_place", "_turn"))
    head = F.concat(F.lit(OPEN), escaped(F.col("_turn.role")), F.lit(MIDDLE))
    turns = turns.select("conv_id", "_order", "_place", F.col("_turn.role").alias("_role"), head.alias("_head"), escaped(F.col("_turn.text")).alias("_text"))
    turns = turns.withColumn("_size", F.length("_head") + F.length("_text") + len(CLOSE))
    before = F.sum("_size").over(Window.partitionBy("conv_id").orderBy("_order", "_place", "_head", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    span = F.struct((before + F.length("_head")).alias("start"), (before + F.length("_head") + F.length("_text")).alias("end"))
    turns = turns.select("conv_id", before.alias("_at"), F.concat("_head", "_text", F.lit(CLOSE)).alias("_part"), F.col("_place").isNull().alias("_rejected"), F.when(F.col("_role") == "assistant", span).alias("_span"))
    parts = F.array_sort(F.collect_list(F.when(~F.col("_rejected"), F.struct("_at", "_part", "_span"))))
    return turns.groupBy("conv_id").agg(parts.alias("_parts"), F.count_if("_rejected").alias("n_rejected")).where(F.size("_parts") > 0).select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: p["_part"]), "").alias("formatted"),
        F.filter(F.transform("_parts", lambda p: p["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        "n_rejected",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    whole = F.split(formatted, "</s>\n", -1)
    return F.transform(
        F.slice(whole, 1, F.size(whole) - 1),
        lambda t: F.struct(unescaped(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescaped(F.substr(t, F.locate(MIDDLE, t) + len(MIDDLE))).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
