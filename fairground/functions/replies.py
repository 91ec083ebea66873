"""Decode replies of an inference service: loose lists and declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Keys under which services wrap a list.
LIST_KEYS = ("uuids", "events", "results", "rankings", "candidates", "winners", "event_uuids")
PEOPLE_KEYS = ("people", "key_people", "entities", "results")

# Accepted category labels.
CATEGORIES = ("Concert", "Theater", "Cinema", "Stand-up", "Festival", "Kids", "Workshop", "Sports", "Opera/Ballet", "Other")


def decode_list(c: Column, element: str = "string", keys: Sequence[str] = LIST_KEYS, any_key: bool = True) -> Column:
    """A JSON list, or the list under a known key, or (``any_key``) the first list value; null when there is none."""
    shape = f"array<{element}>"
    text = F.trim(c)
    direct = F.when(F.startswith(text, F.lit("[")), F.from_json(text, shape))
    fields = F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,string>"))

    def as_list(value: Column) -> Column:
        return F.when(F.startswith(F.trim(value), F.lit("[")), F.from_json(value, shape))

    tries = [direct, *[as_list(fields[k]) for k in keys]]
    if any_key:
        first = F.get(F.filter(F.map_values(fields), lambda v: F.startswith(F.trim(v), F.lit("["))), 0)
        tries.append(as_list(first))
    return F.coalesce(*tries)


def decode_people(c: Column) -> Column:
    """Entity reply to array<struct<name, role>>; a single object counts as a list of one."""
    person = "struct<name: string, role: string>"
    listed = decode_list(c, person, PEOPLE_KEYS, any_key=False)
    single = F.when(F.startswith(F.trim(c), F.lit("{")), F.from_json(c, person))
    single = F.when(single["name"].isNotNull() & single["role"].isNotNull(), F.array(single))
    people = F.coalesce(single, listed, F.array().cast(f"array<{person}>"))
    return F.filter(people, lambda p: (p["name"] != "") & (p["role"] != ""))


def decode_reply(c: Column, schema: str, required: Sequence[str]) -> Column:
    """Parse a reply against ``schema``; null when it does not parse, is empty, or lacks a required field."""
    reply = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    ok = F.to_json(reply) != "{}"  # malformed text parses to a struct of nulls
    for name in required:
        ok = ok & reply[name].isNotNull()
    return F.when(ok, reply)


def json_strings(c: Column) -> Column:
    """JSON list of strings, [] when absent or malformed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def csv_strings(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def refine_category(current: Column, proposed: Column) -> Column:
    """Take the proposed label only when it is one of the accepted ones."""
    return F.when(proposed.isin(*CATEGORIES), proposed).otherwise(current)
