"""JSON texts as VARIANT values: taken apart, judged, mended and written again by built-in functions.

A text that is no JSON, one that repeats a key, and null are no value (null). Objects written again have their keys in order of name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that are gone through; a deeper text raises an error rather than a part of a result.
DEPTH = 8

#: Fields that say what a thing is, and why, the first that holds a text.
WHAT = ("question", "item", "topic", "what", "unknown", "claim", "description", "text", "summary", "title", "name", "path", "file")
WHY = ("reason", "why", "detail", "details", "note", "notes", "explanation", "because", "impact")


def value(text: Column) -> Column:
    return F.try_parse_json(text)


def fields(v: Column) -> Column:
    """An object's fields as a map, null of anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """An array's items, null of anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null of a value."""
    said = F.schema_of_variant(v)
    return (
        F.when(fields(v).isNotNull(), "object").when(items(v).isNotNull(), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(F.is_variant_null(v), "null").otherwise("number")
    )


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _too_deep(v: Column) -> Column:
    return F.when(fields(v).isNotNull() | items(v).isNotNull(), F.raise_error(F.lit(f"JSON of over {DEPTH} levels")).cast("variant")).otherwise(v)


def _everywhere(v: Column, change: Callable[[Column], Column], levels: int) -> Column:
    """``change`` on the (key, value) entries of every object, from the inside out; an array's entries have no key."""
    if not levels:
        return _too_deep(v)
    none = F.lit(None).cast("string")
    entry = lambda k, x: F.struct(k.alias("key"), x.alias("value"))
    inner = F.coalesce(change(F.map_entries(fields(v))), F.transform(items(v), lambda x: entry(none, x)))
    done = F.transform(inner, lambda e: entry(e["key"], _everywhere(e["value"], change, levels - 1)))
    again = lambda es: F.when(items(v).isNotNull(), F.to_variant_object(F.transform(es, lambda e: e["value"]))).when(es.isNotNull(), F.to_variant_object(F.map_from_entries(es))).otherwise(v)
    return _let(done, again)


def without_keys(text: Column, keys: tuple[str, ...], levels: int = DEPTH) -> Column:
    """JSON without the named keys at any depth, compact; null where the text is no JSON."""
    return F.to_json(_everywhere(value(text), lambda es: F.filter(es, lambda e: ~e["key"].isin(*keys)), levels))


def tree_paths(text: Column, levels: int = DEPTH) -> Column:
    """Paths of all nodes of a JSON tree of (name, children), a parent before its children; none where the text is no tree.
    A node without a name is left out with all below it."""

    def paths(v: Column, above: Column, left: int) -> Column:
        name, children = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.children", "array<variant>")
        at = F.concat(above, name)
        if left:
            below = F.flatten(F.transform(children, lambda c: paths(c, F.concat(at, F.lit("/")), left - 1)))
        else:
            below = F.when(F.size(children) > 0, F.raise_error(F.lit(f"a tree of over {levels} levels")).cast("array<string>"))
        none = F.array().cast("array<string>")
        return F.when(name != "", F.concat(F.array(at), F.coalesce(below, none))).otherwise(none)

    return paths(value(text), F.lit(""), levels)


def _is(v: Column, wanted: str) -> Column:
    if wanted == "integer":
        number = F.try_variant_get(v, "$", "double")
        return (kind(v) == "number") & (number == F.floor(number))
    return kind(v) == wanted


def _errors(v: Column, schema: dict, at: Column) -> Column:
    none = F.array().cast("array<string>")
    told = lambda wrong, said, where=at: F.when(wrong, F.array(F.concat(where, F.lit(said)))).otherwise(none)
    key = lambda k: F.concat(at, F.lit(f".{k}"))
    found = []
    if "enum" in schema:
        found.append(told(~F.to_json(v).isin(*[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]), ": not one of its values"))
    has = lambda k: F.coalesce(F.map_contains_key(fields(v), F.lit(k)), F.lit(False))
    found += [told(fields(v).isNotNull() & ~has(k), ": missing", key(k)) for k in schema.get("required", ())]
    found += [F.when(has(k), _errors(F.try_element_at(fields(v), F.lit(k)), s, key(k))).otherwise(none) for k, s in schema.get("properties", {}).items()]
    if "items" in schema:
        each = F.flatten(F.transform(items(v), lambda x, k: _errors(x, schema["items"], F.concat(at, F.lit("["), k.cast("string"), F.lit("]")))))
        found.append(F.coalesce(each, none))
    if "maxItems" in schema:
        found.append(told(F.coalesce(F.size(items(v)) > schema["maxItems"], F.lit(False)), ": too many"))
    if "maxLength" in schema:
        found.append(told((kind(v) == "string") & (F.length(text_of(v)) > schema["maxLength"]), ": too long"))
    inner = F.concat(*found) if found else none
    return F.when(_is(v, schema["type"]), inner).otherwise(F.array(F.concat(at, F.lit(f": not {schema['type']}")))) if "type" in schema else inner


def schema_errors(text: Column, schema: dict) -> Column:
    """What is wrong with a JSON text by a schema (type, enum, required, properties, items, maxItems, maxLength), each with its path.

    The schema is known beforehand, so every rule is an expression of its own. An integer is a whole number, however written.
    """
    v = value(text)
    return F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_errors(v, schema, F.lit("$")))


def sentence(v: Column, levels: int = 3) -> Column:
    """Any value as a sentence: a text as it is, an array's sentences with semicolons between, of an object what it says it is and
    why (``WHAT``, ``WHY``: the first field with more than blanks), else the object as JSON; null is empty."""

    def pick(names: tuple[str, ...]) -> Column:
        def field(k: str) -> Column:
            x = F.try_element_at(fields(v), F.lit(k))
            return F.when(x.isNotNull() & (F.schema_of_variant(x) == "STRING"), F.nullif(F.regexp_replace(text_of(x), r"^\s+|\s+$", ""), F.lit("")))

        return F.coalesce(*map(field, names))

    what, why = pick(WHAT), pick(WHY)
    if levels:
        parts = F.array_join(F.filter(F.transform(items(v), lambda x: sentence(x, levels - 1)), lambda s: s != ""), "; ")
    else:
        parts = F.raise_error(F.lit("arrays in over so many arrays")).cast("string")
    said = F.when(why.isNotNull() & (why != what), F.concat_ws(" — ", what, why)).otherwise(what)
    scalar = F.when(F.is_variant_null(v) | v.isNull(), "").otherwise(text_of(v))
    return F.when(items(v).isNotNull(), parts).when(fields(v).isNotNull(), F.coalesce(said, why, F.to_json(v))).otherwise(scalar)


def _mended(v: Column, schema: dict) -> Column:
    wanted = schema.get("type")
    if wanted == "string":
        said = F.when(kind(v) == "string", text_of(v)).otherwise(sentence(v, 2))
        return F.when(v.isNull(), v).otherwise((F.substring(said, 1, schema["maxLength"]) if "maxLength" in schema else said).cast("variant"))
    if wanted == "array":
        kept = F.slice(items(v), 1, schema["maxItems"]) if "maxItems" in schema else items(v)
        done = F.transform(kept, lambda x: _mended(x, schema["items"])) if "items" in schema else kept
        return F.when(items(v).isNotNull(), F.to_variant_object(done)).otherwise(v)
    if wanted == "object" and schema.get("properties"):

        def field(k: Column, x: Column) -> Column:
            out = F
            for name, s in schema["properties"].items():
                out = out.when(k == name, _mended(x, s))
            return out.otherwise(x)

        return F.when(fields(v).isNotNull(), F.to_variant_object(F.transform_values(fields(v), field))).otherwise(v)
    return v


def mended(text: Column, schema: dict) -> Column:
    """The JSON text with what can be put right by a schema put right: any value where a text is wanted becomes a sentence, texts
    and arrays that are too long are cut. Missing fields, other types and values out of an enum stay as they are."""
    return F.to_json(_mended(value(text), schema))
