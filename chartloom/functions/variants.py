"""VARIANT helpers: typed guards, nullish fallbacks, strict parsing, tree walks.

All of them are row-local expressions, so no operator built on them needs a
shuffle to take a document apart or put it back together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT_MAP = "map<string,variant>"
VARIANT_ARRAY = "array<variant>"
#: Levels written out as nested expressions, which is fast for exam trees; what lies deeper goes level by level
#: through a fold inside the row.  The number changes no result.
UNROLLED = 6


def at(doc: Column, path: str, kind: str = "variant") -> Column:
    """Value at a dotted path below ``doc``; absent or unconvertible gives NULL."""
    return F.try_variant_get(doc, "$." + path if path else "$", kind)


def present(value: Column) -> Column:
    """JSON null becomes SQL NULL, so that ``coalesce`` behaves like ``??``."""
    return F.when(~F.is_variant_null(value), value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*[present(value) for value in values])


def is_object(value: Column) -> Column:
    """True only for a JSON object; a cast to an empty struct does not walk the tree."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", VARIANT_ARRAY).isNotNull()


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    """True for a JSON number; numeric text and booleans are not numbers."""
    kind = F.schema_of_variant(value)
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False)
    )


def number(value: Column) -> Column:
    """DOUBLE value of a JSON number, NULL for anything else (never NaN)."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def text(value: Column) -> Column:
    """STRING value of a JSON string, NULL for anything else."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def as_map(value: Column) -> Column:
    """Members of a JSON object as a map, NULL when it is not an object."""
    return F.try_variant_get(value, "$", OBJECT_MAP)


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", VARIANT_ARRAY)


def strict_root(raw: Column) -> Column:
    """Parse ``raw`` as exactly one JSON value; trailing text makes it NULL.

    The parser stops after the first complete value.  Wrapping once in brackets
    and once in braces closes that gap: text that ends one wrapper early cannot
    also be well-formed inside the other.
    """
    in_array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", VARIANT_ARRAY
    )
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when((F.size(in_array) == 1) & in_object.isNotNull(), F.get(in_array, F.lit(0)))


def _brackets(value: Column) -> Column:
    """An upper bound of the levels of a tree: the opening brackets in its text, at least 1."""
    written = F.to_json(value)
    return F.greatest(F.length(written) - F.length(F.replace(written, F.lit("{"), F.lit(""))), F.lit(1))


def _is_filled(members: Column) -> Column:
    return F.coalesce(F.size(members) > 0, F.lit(False))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _children(prefix: Column, members: Column) -> Column:
    """(path, value, members) of every member; the members of a child are taken out of its tree here and nowhere else."""
    return F.transform(F.map_entries(members), lambda entry: F.struct(
        F.concat(prefix, entry["key"]).alias("path"), entry["value"].alias("value"), as_map(entry["value"]).alias("members"),
    ))


def _open_leaves(prefix: Column, value: Column, members: Column) -> Column:
    """Leaves below a filled object, by a frontier of open subtrees that goes down one level a round until none is left."""
    kind = f"array<struct<path:string,value:variant,members:{OBJECT_MAP}>>"

    def down(state: Column, _level: Column) -> Column:
        below = F.flatten(F.transform(state["open"], lambda node: _children(F.concat(node["path"], F.lit(".")), node["members"])))
        split = _once(below, lambda found: F.struct(
            F.concat(state["done"], F.filter(found, lambda m: ~_is_filled(m["members"]))).alias("done"),
            F.filter(found, lambda m: _is_filled(m["members"])).alias("open"),
        ))
        return F.when(F.size(state["open"]) > 0, split).otherwise(state)

    first = F.array(F.struct(prefix.alias("path"), value.alias("value"), members.alias("members")))
    start = F.struct(F.array().cast(kind).alias("done"), first.cast(kind).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), _brackets(value)), start, down, lambda state: F.transform(
        state["done"], lambda m: F.struct(m["path"].alias("path"), m["value"].alias("value"))
    ))


def leaves(doc: Column, unrolled: int = UNROLLED) -> Column:
    """ARRAY<STRUCT<path, value>> of every leaf at any depth; arrays and empty objects stay leaves."""

    def walk(prefix: Column, value: Column, members: Column, left: int, here: Column) -> Column:
        leaf = F.array(F.struct(here.alias("path"), value.alias("value")))
        if left == 0:
            return F.when(_is_filled(members), _open_leaves(here, value, members)).otherwise(leaf)
        return F.when(
            _is_filled(members),
            F.flatten(F.transform(
                _children(prefix, members), lambda m: walk(F.concat(m["path"], F.lit(".")), m["value"], m["members"], left - 1, m["path"])
            )),
        ).otherwise(leaf)

    return _once(
        F.struct(doc.alias("value"), as_map(doc).alias("members")),
        lambda root: walk(F.lit(""), root["value"], root["members"], max(1, unrolled), F.lit("")),
    )


def _is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _filled(old: Column, new: Column) -> Column:
    """Value that stays where ``new`` is no object."""
    return F.when(_is_null(new), old).when(_is_null(old), new).otherwise(old)


def _fill_below(target: Column, repair: Column) -> Column:
    """The merge of two objects at any depth, inside the row.

    A frontier of pairs (what the target has, the object of the repair) goes down one level a round until no pair is
    open; then the objects are built again from the deepest level up.
    """
    node = "struct<parent:int,key:string,value:variant,old:variant,new:variant,open:boolean>"
    empty = F.expr(f"cast(map() as {OBJECT_MAP})")

    def children(pair: Column, place: Column) -> Column:
        members = F.map_zip_with(
            F.coalesce(as_map(pair["old"]), empty), F.coalesce(as_map(pair["new"]), empty),
            lambda _key, old, new: F.struct(old.alias("old"), new.alias("new")),
        )
        entries = F.transform(F.map_entries(members), lambda entry: F.struct(
            place.alias("parent"), entry["key"].alias("key"), _filled(entry["value"]["old"], entry["value"]["new"]).alias("value"),
            entry["value"]["old"].alias("old"), entry["value"]["new"].alias("new"), as_map(entry["value"]["new"]).isNotNull().alias("open"),
        ))
        # A null repair of an absent member leaves the member absent.
        return F.filter(entries, lambda entry: entry["open"] | entry["value"].isNotNull()).cast(f"array<{node}>")

    def down(levels: Column, _level: Column) -> Column:
        last = F.element_at(levels, F.lit(-1))
        nodes = F.transform(last, lambda pair, place: F.when(pair["open"], children(pair, place)).otherwise(F.array().cast(f"array<{node}>")))
        below = F.flatten(nodes)
        return F.when(F.size(last) > 0, F.concat(levels, F.array(below))).otherwise(levels).cast(f"array<array<{node}>>")

    def up(below: Column, level: Column) -> Column:
        def built(pair: Column, place: Column) -> Column:
            own = F.filter(below, lambda child: child["parent"] == place)
            members = F.map_from_entries(F.transform(own, lambda child: F.struct(child["key"], child["value"])))
            value = F.when(pair["open"], F.to_variant_object(members.cast(OBJECT_MAP))).otherwise(pair["value"])
            return F.struct(pair["parent"].alias("parent"), pair["key"].alias("key"), value.alias("value"))

        return F.transform(level, built).cast("array<struct<parent:int,key:string,value:variant>>")

    nothing = F.lit(None).cast("variant")
    root = F.struct(F.lit(0).alias("parent"), F.lit("").alias("key"), nothing.alias("value"), target.alias("old"), repair.alias("new"), F.lit(True).alias("open"))
    start = F.array(F.array(root.cast(node))).cast(f"array<array<{node}>>")
    levels = F.aggregate(F.sequence(F.lit(1), _brackets(repair)), start, down)
    lowest = F.array().cast("array<struct<parent:int,key:string,value:variant>>")
    return F.get(F.aggregate(F.reverse(levels), lowest, up), F.lit(0))["value"]


def fill_missing(target: Column, repair: Column, unrolled: int = UNROLLED) -> Column:
    """Recursive merge that writes ``repair`` values only where ``target`` has none, at any depth.

    A null in ``repair`` is skipped, an object in ``repair`` replaces a target
    that is not an object before descending, and any other value lands only on
    an absent or null target.  NULL if one side is no object.
    """
    empty = F.expr(f"cast(map() as {OBJECT_MAP})")

    def merge(base: Column, extra: Column, left: int) -> Column:
        def pick(_key: Column, old: Column, new: Column) -> Column:
            new_members = as_map(new)
            if left == 0:
                nested = _fill_below(old, new)
            else:
                nested = F.to_variant_object(
                    merge(F.coalesce(as_map(old), empty), new_members, left - 1)
                )
            return F.when(~_is_null(new) & new_members.isNotNull(), nested).otherwise(_filled(old, new))

        # A null repair of an absent member leaves the member absent.
        return F.map_filter(F.map_zip_with(base, extra, pick), lambda _key, value: value.isNotNull())

    return F.to_variant_object(merge(as_map(target), as_map(repair), unrolled))
