"""Tool-call linking for chat data.

Turns are read into events: messages, tool definitions, calls and results.
Calls and results are joined by (conversation, identifier) with a shuffled hash
join; events get a topological order in which a call follows the results that
its arguments cite and a result follows its call; arguments are validated
against the tool's JSON schema; every event is serialised as canonical JSON
(sorted keys, no spaces, UTF-8).

Read forms, all public conventions: a turn that is one JSON object with
"tool_calls" (function name and arguments, an object or a JSON string), with
"tool_call_id" (a result) or with "tools" (definitions with "parameters"); and
<tool_call>{...}</tool_call> and <tool_response>{...}</tool_response> blocks
inside text.  A call cites a result by the string "$ID" anywhere in its
arguments, ID being the identifier of an earlier or later call.

A conversation's events are never gathered in one place: order is a sort key
(turn, part, depth), so one conversation may hold most rows of the table.

Defined results, in `status`: ok; orphan_result (no such call); unanswered
(a call without result); duplicate_id (a later call of the same identifier;
results belong to the first); unknown_tool (definitions exist, this is not one
of them); invalid_arguments (with `error`); unsupported_schema (the tool's
schema holds a keyword, named in `error`, that cannot be decided here);
malformed (a block that is not JSON); cycle (calls that wait for each other).  A null text is an empty
message; null conv_id and turn are values of their own; repeated rows give
repeated messages and duplicate calls.
"""

from __future__ import annotations

import datetime
import fractions
import ipaddress
import json
import math
import re
import urllib.parse
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import NULL_ID, Tables, id_of, process_state, read, runs_by_key, slices, width
from papyr.llm.components import connected_components

#: Citations of one component that a task orders in memory.
COMPONENT = 1_000_000
_OPEN = re.compile("<tool_(call|response)>")
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def _refuse(x: str) -> Any:
    raise ValueError(x)


# made once: json.dumps with options makes an encoder for each value
canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _strict(text: str) -> Any:
    state = process_state()
    if "strict_json" not in state:  # a decoder can't be pickled with this module's functions
        state["strict_json"] = json.JSONDecoder(parse_constant=_refuse).decode
    return state["strict_json"](text)


class Unsupported(ValueError):
    """A keyword of a schema that validate() cannot decide."""


#: Keywords that assert nothing.
_SILENT = {
    "$schema", "$comment", "$defs", "definitions", "$anchor", "title", "description", "default", "examples", "example", "deprecated", "readOnly", "writeOnly",
    "contentEncoding", "contentMediaType", "contentSchema",
}
_PLAIN = {
    "type", "enum", "const", "multipleOf", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "uniqueItems", "minContains", "maxContains", "required", "minProperties", "maxProperties", "dependentRequired",
}
#: Keywords that hold one schema, a list of them, and schemas by name.
_ONE = {"items", "additionalItems", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"}
_LIST = {"allOf", "anyOf", "oneOf", "prefixItems", "items"}
_NAMED = {"properties", "patternProperties", "dependentSchemas", "dependencies"}


def _parses(read: Any) -> Any:
    def fits(text: str) -> bool:
        try:
            read(text)
        except (ValueError, re.error):
            return False
        return True

    return fits


def _date_time(text: str) -> None:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](.+)", text, re.A)
    if not m:
        raise ValueError(text)
    datetime.date.fromisoformat(m[1])
    _time(m[2])


def _time(text: str) -> None:
    m = re.fullmatch(r"(\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](\d\d):(\d\d))", text, re.A)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3]) > 60 or int(m[4] or 0) > 23 or int(m[5] or 0) > 59:
        raise ValueError(text)


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = re.compile(rf"(?=.{{1,253}}\Z){_LABEL}(?:\.{_LABEL})*")
_FORMATS = {
    "date": lambda x: bool(re.fullmatch(r"\d{4}-\d\d-\d\d", x, re.A)) and _parses(datetime.date.fromisoformat)(x),
    "time": _parses(_time),
    "date-time": _parses(_date_time),
    "duration": lambda x: bool(re.fullmatch(r"P(?!\Z)(?:\d+W|(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?!\Z)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?)", x, re.A)),
    "email": lambda x: bool(re.fullmatch(rf"[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@{_HOST.pattern}", x)),
    "hostname": lambda x: bool(_HOST.fullmatch(x)),
    "ipv4": _parses(ipaddress.IPv4Address),
    "ipv6": lambda x: "%" not in x and _parses(ipaddress.IPv6Address)(x),
    "uuid": lambda x: bool(re.fullmatch(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", x)),
    "uri": lambda x: bool(re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:(?:[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*", x)),
    "regex": _parses(re.compile),
}


def matches(pattern: str, text: str) -> bool:
    """Whether a schema's pattern is found in a text, by an automaton: the time is in proportion to the text for any pattern.

    Patterns that need another way (look-around, back references, counts over
    1000) or that are none are Unsupported.
    """
    if not isinstance(pattern, str):
        raise Unsupported(f"pattern {pattern}")
    # an escape \uXXXX is written \x{XXXX} here
    known = re.sub(r"(?<!\\)((?:\\\\)*)\\u([0-9A-Fa-f]{4})", r"\1\\x{\2}", pattern)
    try:
        return pc.match_substring_regex(pa.array([text]), known)[0].as_py()
    except (pa.ArrowInvalid, UnicodeEncodeError):
        raise Unsupported(f"pattern {pattern}") from None


def _resolve(ref: Any, root: Any) -> Any:
    """The schema that a reference inside `root` points to: "#", "#/a/b" or "#anchor"."""
    if not isinstance(ref, str) or not ref.startswith("#"):
        raise Unsupported(f"$ref {ref}")
    path = urllib.parse.unquote(ref[1:])
    if path and path[0] != "/":
        stack = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, dict) and x.get("$anchor") == path:
                return x
            stack += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        raise Unsupported(f"$ref {ref}")
    at = root
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, TypeError, ValueError):
            raise Unsupported(f"$ref {ref}") from None
    return at


def unsupported(schema: Any) -> str | None:
    """The first keyword, in the schema or in what it refers to, that validate() cannot decide."""
    stack, seen = [schema], set()
    while stack:
        x = stack.pop()
        if not isinstance(x, dict) or id(x) in seen:
            continue
        seen.add(id(x))
        for k in sorted(x):
            v = x[k]
            if k == "$ref":
                try:
                    stack.append(_resolve(v, schema))
                except Unsupported as e:
                    return str(e)
            elif k == "format":
                if v not in _FORMATS:
                    return f"format {v}"
            elif k == "pattern" or (k == "patternProperties" and isinstance(v, dict)):
                for pattern in [v] if k == "pattern" else sorted(v):
                    try:
                        matches(pattern, "")
                    except Unsupported as e:
                        return str(e)
                stack += v.values() if k == "patternProperties" else ()
            elif k in _LIST and isinstance(v, list):
                stack += v
            elif k in _ONE:
                stack.append(v)
            elif k in _NAMED and isinstance(v, dict):
                stack += v.values()
            elif k not in _PLAIN | _SILENT and not k.startswith("x-") and not (k == "$id" and x is schema):
                return k
    return None


def validate(value: Any, schema: Any, at: str = "$", root: Any = None) -> str | None:
    """The first violation of a JSON schema.

    All assertions of draft 2020-12 but unevaluatedItems, unevaluatedProperties
    and dynamic or remote references, which unsupported() tells; also the older
    forms of items, dependencies and exclusive bounds.
    """
    if schema is True or schema is None:
        return None
    if schema is False or not isinstance(schema, dict):
        return f"{at}: not allowed"
    root = schema if root is None else root
    check = lambda v, s, where=at: validate(v, s, where, root)
    if "$ref" in schema and (e := check(value, _resolve(schema["$ref"], root))):
        return e
    kinds = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds is not None:
        fits = lambda k: (
            number if k == "number" else number and (isinstance(value, int) or value.is_integer()) if k == "integer" else k in _TYPES and isinstance(value, _TYPES[k])
        )
        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return f"{at}: not {kinds if isinstance(kinds, str) else '/'.join(kinds)}"
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not const"
    if number:
        for key, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            bound = schema.get(key)
            if bound is True:  # the form of draft 4: the other bound is exclusive
                bound = schema.get({"exclusiveMinimum": "minimum", "exclusiveMaximum": "maximum"}.get(key))
            if isinstance(bound, (int, float)) and not isinstance(bound, bool) and bad(value, bound):
                return f"{at}: {key}"
        if "multipleOf" in schema and (value in (math.inf, -math.inf) or fractions.Fraction(str(value)) % fractions.Fraction(str(schema["multipleOf"]))):
            return f"{at}: multipleOf"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: minLength"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{at}: maxLength"
        if "pattern" in schema and not matches(schema["pattern"], value):
            return f"{at}: pattern"
        if "format" in schema:
            if schema["format"] not in _FORMATS:
                raise Unsupported(f"format {schema['format']}")
            if not _FORMATS[schema["format"]](value):
                return f"{at}: format"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return f"{at}: minItems"
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            return f"{at}: maxItems"
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            return f"{at}: uniqueItems"
        first, rest = schema.get("prefixItems", []), schema.get("items")
        if isinstance(rest, list):
            first, rest = rest, schema.get("additionalItems")
        for i, x in enumerate(value):
            if e := check(x, first[i] if i < len(first) else rest, f"{at}[{i}]"):
                return e
        if "contains" in schema:
            n = sum(not check(x, schema["contains"]) for x in value)
            if n < schema.get("minContains", 1):
                return f"{at}: contains"
            if "maxContains" in schema and n > schema["maxContains"]:
                return f"{at}: maxContains"
    if isinstance(value, dict):
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: required"
        if len(value) < schema.get("minProperties", 0):
            return f"{at}: minProperties"
        if "maxProperties" in schema and len(value) > schema["maxProperties"]:
            return f"{at}: maxProperties"
        for k in sorted(value):
            rules = ([own[k]] if k in own else []) + [s for p, s in sorted(patterns.items()) if matches(p, k)]
            for rule in rules or [schema.get("additionalProperties")]:
                if e := check(value[k], rule, f"{at}.{k}"):
                    return e
            if "propertyNames" in schema and check(k, schema["propertyNames"]):
                return f"{at}.{k}: propertyNames"
        for key in ("dependentRequired", "dependentSchemas", "dependencies"):
            for k, need in sorted(schema.get(key, {}).items()):
                if k not in value:
                    continue
                if isinstance(need, list):
                    if not all(x in value for x in need):
                        return f"{at}.{k}: {key}"
                elif e := check(value, need):
                    return e
    for s in schema.get("allOf", ()):
        if e := check(value, s):
            return e
    if "anyOf" in schema and all(check(value, s) for s in schema["anyOf"]):
        return f"{at}: anyOf"
    if "oneOf" in schema and sum(not check(value, s) for s in schema["oneOf"]) != 1:
        return f"{at}: oneOf"
    if "not" in schema and not check(value, schema["not"]):
        return f"{at}: not"
    if "if" in schema:
        branch = "else" if check(value, schema["if"]) else "then"
        if branch in schema and (e := check(value, schema[branch])):
            return e
    return None


def cited(value: Any) -> list[str]:
    """Identifiers that the arguments cite as "$ID"."""
    if isinstance(value, str):
        return [value[1:]] if len(value) > 1 and value[0] == "$" else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({c for x in inner for c in cited(x)})


def _call(item: Any) -> tuple[str, str, str | None, str, list[str]]:
    f = item.get("function", item) if isinstance(item, dict) else None
    if not isinstance(f, dict) or not isinstance(f.get("name"), str):
        return "malformed", canonical(item), None, "", []
    arguments = f.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = _strict(arguments)
        except ValueError:
            return "malformed", arguments, item.get("id"), f["name"], []
    call_id = item.get("id", f.get("id"))
    return "call", canonical(arguments), None if call_id is None else str(call_id), f["name"], cited(arguments)


def blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, body) of the blocks of a turn: from an opening mark to the next closing one of its kind.

    A mark that is never closed opens nothing.  One search per block, and one
    more for each kind, so the time grows with the text alone.
    """
    open_ended, at = set(), 0
    while m := _OPEN.search(text, at):
        end = -1 if m[1] in open_ended else text.find(f"</tool_{m[1]}>", m.end())
        if end < 0:
            open_ended.add(m[1])
            at = m.end()
        else:
            at = end + len(f"</tool_{m[1]}>")
            yield m.start(), at, m[1], text[m.end() : end]


def events_of(text: str) -> list[tuple[str, str, str | None, str | None, list[str]]]:
    """(kind, body, id, name, cites) of one turn, in order."""
    out: list = []
    bare = text.strip()
    if bare.startswith("{") and bare.endswith("}"):
        try:
            turn = _strict(bare)
        except (ValueError, RecursionError):
            turn = {}
        known = False
        if isinstance(turn.get("tools"), list):
            known = True
            for t in turn["tools"]:
                f = t.get("function", t) if isinstance(t, dict) else {}
                if isinstance(f, dict) and isinstance(f.get("name"), str):
                    out.append(("tool", canonical(f.get("parameters", {})), None, f["name"], []))
        if isinstance(turn.get("content"), str) and ("tool_calls" in turn or "tools" in turn):
            out.append(("message", turn["content"], None, None, []))
        if isinstance(turn.get("tool_calls"), list):
            known = True
            for c in turn["tool_calls"]:
                kind, body, i, name, cites = _call(c)
                out.append((kind, body, i, name, cites))
        if turn.get("tool_call_id") is not None:
            known = True
            out.append(("result", canonical(turn.get("content")), str(turn["tool_call_id"]), turn.get("name"), []))
        if known:
            return out
    at = 0
    for start, end, kind, body in blocks(text):
        if text[at:start].strip():
            out.append(("message", text[at:start].strip(), None, None, []))
        at = end
        try:
            item = _strict(body)
        except (ValueError, RecursionError):
            item = None
        if not isinstance(item, dict):
            out.append(("malformed", body.strip(), None, None, []))
        elif kind == "call":
            out.append(_call(item))
        else:
            i = item.get("tool_call_id", item.get("id"))
            out.append(("result", canonical(item.get("content")), None if i is None else str(i), item.get("name"), []))
    if text[at:].strip() or not out:
        out.append(("message", text[at:].strip() if at else text, None, None, []))
    return out


def _read_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("id", pa.string()),
         ("name", pa.string()), ("body", pa.string()), ("cites", pa.list_(pa.string()))]
    )
    for batch in slices(batches, "text", 4_000_000):
        rows = []
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
            for part, (kind, body, i, name, cites) in enumerate(events_of(text or "")):
                rows.append((conv, turn, part, role, kind, i, name if isinstance(name, str) else None, body, cites))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rules(text: str) -> tuple[Any, str | Exception | None]:
    """A schema and the first keyword in it that cannot be decided or, where it can't even be searched, the error of that."""
    rules = _strict(text)
    try:
        return rules, unsupported(rules)
    except (re.error, TypeError, ValueError, AttributeError, ZeroDivisionError, RecursionError) as e:
        return rules, e


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quoted = lambda x: "null" if x is None else canonical(x)
    for batch in batches:
        # the batch's schemas, which its calls share
        known: dict[str, tuple[Any, str | Exception | None]] = {}
        out: list[list] = [[], [], []]
        names = ("kind", "id", "name", "body", "role", "status", "schema")
        for kind, i, name, body, role, status, schema in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            error = None
            if kind == "call" and schema is not None and status in ("ok", "unanswered"):
                value = _strict(body)
                if schema not in known:
                    known[schema] = _rules(schema)
                rules, unknown = known[schema]
                try:
                    if isinstance(unknown, Exception):
                        raise unknown
                    if unknown:
                        status, error = "unsupported_schema", f"schema: {unknown}"
                    elif error := validate(value, rules):
                        status = "invalid_arguments"
                except (re.error, TypeError, ValueError, AttributeError, ZeroDivisionError, RecursionError) as e:
                    status, error = "invalid_arguments", f"schema: {type(e).__name__}"
            # bodies of these kinds are canonical already, and the keys stand in their order
            rest = f'"kind":{quoted(kind)},"name":{quoted(name)},'
            if kind == "call":
                line = f'{{"arguments":{body},"id":{quoted(i)},{rest}'
            elif kind == "result":
                line = f'{{"content":{body},"id":{quoted(i)},{rest}'
            elif kind == "tool":
                line = f'{{"id":{quoted(i)},{rest}"parameters":{body},'
            else:
                line = f'{{"content":{quoted(body)},"kind":{quoted(kind)},'
            out[0].append(status), out[1].append(error), out[2].append(f'{line}"role":{quoted(role)},"status":{quoted(status)}}}')
        keep = [c for c in batch.schema.names if c in ("conv", "turn", "part", "depth", "kind", "id", "name")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(x, pa.string()) for x in out)], names=[*keep, "status", "error", "json"]
        )


def _placed(rows: list[tuple]) -> list[tuple]:
    """(conv, id, t, p, depth, cyclic) of citing calls, by Kahn's algorithm; rows: (conv, id, turn, part, cite, ct, cp, at, ap).

    A call stands where it was made or, if that is later, behind all that it
    cites: the cited call's result, or the call itself where it was moved to.
    """
    own: dict[tuple, tuple] = {}
    cites: dict[tuple, list] = {}
    cited_by: dict[tuple, list] = {}
    for conv, i, turn, part, cite, ct, cp, at, ap in rows:
        own[conv, i] = (turn, part)
        cites.setdefault((conv, i), []).append(((conv, cite), (ct, cp), None if at is None else (at, ap)))
        cited_by.setdefault((conv, cite), []).append((conv, i))
    left = {k: sum(c in own for c, *_ in v) for k, v in cites.items()}
    ready = [k for k, n in left.items() if not n]
    place: dict[tuple, tuple] = {}
    while ready:
        k = ready.pop()
        best = (*own[k], 0)
        for c, at, answer in cites[k]:
            t, p, depth = place.get(c, (*at, 0))
            best = max(best, (*max((t, p), answer or (t, p)), depth + 2))
        place[k] = best
        for x in cited_by.get(k, ()):
            left[x] -= 1
            if not left[x]:
                ready.append(x)
    return [(*k, *(place[k] if k in place else (*v, 0)), k not in place) for k, v in own.items()]


_PLACES = "conv long, id string, t long, p int, depth int, cyclic boolean"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv", "id", "turn", "part", "cite", "ct", "cp", "at", "ap")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    for t in runs_by_key(batches, "component", 20_000):
        out = _placed(list(zip(*(t.column(c).to_pylist() for c in names), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "id", "t", "p", "depth", "cyclic"])


def _depths(calls: DataFrame, tables: Tables) -> DataFrame:
    """(conv, id, t, p, depth, cyclic) for calls that cite others: their place, which is after all that they cite.

    Calls cite within their conversation, so one of at most COMPONENT citations
    is ordered in one task.  In a larger one, calls that cite each other, directly
    or by others, form a component, which is found by a distributed search and
    ordered likewise.  A component of over COMPONENT citations is ordered by
    rounds over the whole cluster.
    """
    spark = calls.sparkSession
    edges = tables.settle(
        calls.select("conv", "id", "turn", "part", F.explode("cites").alias("cite"))
        .join(calls.select("conv", F.col("id").alias("cite"), F.col("turn").alias("ct"), F.col("part").alias("cp"), F.col("first").alias("answer")),
              ["conv", "cite"])
        .withColumns({"a": F.xxhash64("conv", "id"), "b": F.xxhash64("conv", "cite")})
    )
    if edges.isEmpty():
        return spark.createDataFrame([], _PLACES)
    by_task = lambda df: (
        df.select("*", F.col("answer.t").alias("at"), F.col("answer.p").alias("ap"))
        .repartition(width(spark), "component").sortWithinPartitions("component").mapInArrow(_places, _PLACES)
    )
    whole = edges.withColumn("component", F.col("conv"))
    long = tables.settle(edges.groupBy("conv").count().where(F.col("count") > COMPONENT).select("conv"))
    if long.isEmpty():
        return by_task(whole)
    placed = by_task(whole.join(long, "conv", "left_anti"))
    edges = tables.settle(edges.join(long, "conv", "left_semi"))
    # equal hashes of different calls would only join their components
    components = connected_components(edges.select("a", "b"), tables).withColumnRenamed("node", "a")
    edges = tables.settle(edges.join(components, "a", "left").withColumn("component", F.coalesce("component", "a")))
    large = tables.settle(edges.groupBy("component").count().where(F.col("count") > COMPONENT).select("component"))
    placed = placed.union(by_task(edges.join(large, "component", "left_anti")))
    return placed if large.isEmpty() else placed.union(_by_rounds(edges.join(large, "component", "left_semi"), tables))


def _by_rounds(edges: DataFrame, tables: Tables) -> DataFrame:
    """The same by rounds: in each the calls whose cited calls are all placed get their place; when a round places none, the rest wait for each other."""
    spark = edges.sparkSession
    heads = edges.select("conv", F.col("id").alias("cite")).distinct().withColumn("waits", F.lit(True))
    every = spark.createDataFrame([], _PLACES)
    # what is known of each citation: the cited call's place, once it has one; a call that cites nothing stands where it is
    known = edges.join(heads, ["conv", "cite"], "left").select(
        "conv", "id", "turn", "part", "cite", "ct", "cp", "answer", F.col("waits").isNull().alias("placed"),
        F.lit(None).cast("long").alias("t"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("depth"),
    )
    while True:
        known = tables.settle(known)
        # the cited call's result stands behind its call, where it was or where the call was moved
        after = F.greatest(F.struct(F.coalesce("t", "ct").alias("t"), F.coalesce("p", "cp").alias("p")), "answer")
        behind = F.struct(after["t"].alias("t"), after["p"].alias("p"), (F.coalesce("depth", F.lit(0)) + 2).alias("depth"))
        ready = tables.settle(
            known.groupBy("conv", "id").agg(
                F.min("placed").alias("all"),
                F.greatest(F.struct(F.min("turn").alias("t"), F.min("part").alias("p"), F.lit(0).alias("depth")), F.max(behind)).alias("at"),
            )
            .where("all").select("conv", "id", "at.t", "at.p", "at.depth", F.lit(False).alias("cyclic"))
        )
        if ready.isEmpty():
            rest = known.groupBy("conv", "id").agg(F.min("turn").alias("t"), F.min("part").alias("p"))
            return every.union(rest.select("conv", "id", "t", "p", F.lit(0), F.lit(True)))
        every = every.union(ready)
        left = known.join(ready.select("conv", "id"), ["conv", "id"], "left_anti")
        new = ready.select("conv", F.col("id").alias("cite"), F.col("t").alias("t1"), F.col("p").alias("p1"), F.col("depth").alias("d1"))
        known = left.join(new, ["conv", "cite"], "left").select(
            "conv", "id", "turn", "part", "cite", "ct", "cp", "answer", (F.col("placed") | F.col("t1").isNotNull()).alias("placed"),
            F.coalesce("t", "t1").alias("t"), F.coalesce("p", "p1").alias("p"), F.coalesce("depth", "d1").alias("depth"),
        )


def link_tool_calls(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per event: conv_id, turn, part, order_turn, order_part, depth, kind, call_id, name, status, error, json.

    Sorting a conversation by (order_turn, order_part, depth, turn, part) gives
    its topological order.
    """
    tables = Tables(spark)
    turns = conversations.select(
        id_of("conv_id").alias("conv"), id_of("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    events = tables.settle(
        turns.mapInArrow(_read_events, "conv long, turn long, part int, role string, kind string, id string, name string, body string, cites array<string>")
    )
    plain = events.where("kind not in ('call', 'result') or id is null")
    linked = events.where("kind in ('call', 'result') and id is not null")
    calls = linked.where("kind = 'call'")
    # the first call of an identifier; aggregated before the shuffle, so a hot one is one row per task
    first = calls.groupBy("conv", "id").agg(F.min_by(F.struct("turn", "part", "cites", "name"), F.struct("turn", "part", "body")).alias("c"), F.count("*").alias("n_calls"))
    answered = linked.where("kind = 'result'").groupBy("conv", "id").agg(F.count("*").alias("n_results"), F.min(F.struct(F.col("turn").alias("t"), F.col("part").alias("p"))).alias("first"))
    heads = tables.settle(
        first.select("conv", "id", "n_calls", "c.*").withColumnsRenamed({"turn": "c_turn", "part": "c_part", "name": "c_name"})
        .join(answered.hint("shuffle_hash"), ["conv", "id"], "left")
    )
    depths = _depths(heads.select("conv", "id", F.col("c_turn").alias("turn"), F.col("c_part").alias("part"), "cites", "first"), tables)
    # written, as calls and results are joined to it apart
    heads = tables.settle(
        heads.drop("cites").join(depths, ["conv", "id"], "left").select(
            "conv", "id", "c_turn", "c_part", "c_name", "n_results", F.coalesce("t", "c_turn").alias("t"), F.coalesce("p", "c_part").alias("p"),
            F.coalesce("depth", F.lit(0)).alias("depth0"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        )
    )
    is_call = F.col("kind") == "call"
    own = (F.col("turn") == F.col("c_turn")) & (F.col("part") == F.col("c_part"))
    status = (
        F.when(is_call & ~own, "duplicate_id")
        .when(~is_call & F.col("c_turn").isNull(), "orphan_result")
        .when(F.col("cyclic"), "cycle")
        .when(is_call & F.col("n_results").isNull(), "unanswered")
        .otherwise("ok")
    )
    late = F.struct("turn", "part") >= F.struct(F.col("t").alias("turn"), F.col("p").alias("part"))
    joined = linked.join(heads.hint("shuffle_hash"), ["conv", "id"], "left").select(
        "conv", "turn", "part", "role", "kind", "id", F.coalesce("name", "c_name").alias("name"), "body", status.alias("status"),
        # a result that came before its call is moved behind it
        F.when(is_call & own, F.col("t")).when(F.col("t").isNull() | late, F.col("turn")).otherwise(F.col("t")).alias("order_turn"),
        F.when(is_call & own, F.col("p")).when(F.col("t").isNull() | late, F.col("part")).otherwise(F.col("p")).alias("order_part"),
        F.when(is_call & own, F.col("depth0")).when(F.col("t").isNull(), F.lit(0)).otherwise(F.col("depth0") + 1).alias("depth"),
    )
    rest = plain.select(
        "conv", "turn", "part", "role", "kind", "id", "name", "body",
        F.when(F.col("kind") == "malformed", "malformed").when(F.col("kind") == "result", "orphan_result").when(is_call, "unanswered").otherwise("ok").alias("status"),
        F.col("turn").alias("order_turn"), F.col("part").alias("order_part"), F.lit(0).alias("depth"),
    )
    tools = events.where("kind = 'tool'").groupBy("conv", "name").agg(F.max_by("body", F.struct("turn", "part", "body")).alias("schema"))
    offers = tools.select("conv").distinct().withColumn("offers", F.lit(True))
    all_calls = joined.where(is_call).union(rest.where(is_call)).join(tools, ["conv", "name"], "left").join(offers, "conv", "left")
    unknown = F.col("offers") & F.col("schema").isNull() & F.col("status").isin("ok", "unanswered")
    checked = all_calls.withColumn("status", F.when(unknown, "unknown_tool").otherwise(F.col("status"))).drop("offers")
    others = joined.where(~is_call).union(rest.where(~is_call)).withColumn("schema", F.lit(None).cast("string"))
    every = others.unionByName(checked)
    keys = ["conv", "turn", "part", "depth", "kind", "id", "name"]
    # order columns ride along as two longs
    done = every.select(*keys, "order_turn", "order_part", "role", "body", "status", "schema").mapInArrow(
        _with_order, "conv long, turn long, part int, depth int, kind string, id string, name string, order_turn long, order_part int, status string, error string, json string"
    )
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return done.select(
        shown("conv").alias("conv_id"), shown("turn").alias("turn"), "part", shown("order_turn").alias("order_turn"), "order_part", "depth",
        "kind", F.col("id").alias("call_id"), "name", "status", "error", "json",
    )


def _with_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for out in _serialise(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:7], batch.column("order_turn"), batch.column("order_part"), *out.columns[7:]],
                    names=[*out.schema.names[:7], "order_turn", "order_part", *out.schema.names[7:]],
                )


def op3_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event of the conversations table; see the module for the columns' defined results."""
    return link_tool_calls(spark, read(spark, sf_dir, "conversations"))


#: Conversations of calls and results made from orders: calls that cite the customer's next order, unanswered ones, results without a call, unknown tools and bad arguments.
MADE = """
WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS conv, CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS s,
    lead(CAST(o_orderkey AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM {orders}),
c AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'audit' ELSE 'ship' END AS name,
    concat('{{', CASE WHEN k % 3 = 0 AND nxt IS NOT NULL THEN concat('"after":"$c', CAST(nxt AS VARCHAR(12)), '",') ELSE '' END, '"n":', CAST(k % 10 AS VARCHAR(12)), '}}') AS args FROM o)
"""
_PARAMETERS = '{"properties":{"n":{"minimum":3,"type":"integer"}},"required":["n"],"type":"object"}'


def tool_links_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on calls and results made from the whole orders table, in which all but cycles occurs."""
    made = spark.sql(
        MADE.replace("VARCHAR(12)", "STRING")
        + """SELECT conv AS conv_id, -1L AS turn, 'system' AS role, t AS text FROM (SELECT DISTINCT conv FROM c), {tools}
        UNION ALL SELECT conv, 2 * k, 'assistant', concat('{{"tool_calls":[{{"id":"c', k, '","function":{{"name":"', name, '","arguments":', args, '}}}}]}}') FROM c
        UNION ALL SELECT conv, 2 * k + 1, 'tool', concat('{{"tool_call_id":"', if(k % 7 = 0, 'z', 'c'), k, '","content":"', s, '"}}') FROM c WHERE s <> 'P'""",
        orders=read(spark, sf_dir, "orders"), tools=spark.range(1).select(F.lit('{"tools":[{"name":"ship","parameters":' + _PARAMETERS + "}]}").alias("t")),
    )
    return link_tool_calls(spark, made).drop("error")


MADE_SQL = (
    "WITH RECURSIVE" + MADE.replace("{orders}", "orders").replace("{{", "{").replace("}}", "}").strip().removeprefix("WITH")
    + """,
a AS (SELECT *, 2 * k AS turn, CASE WHEN k % 3 = 0 THEN nxt END AS cite, s <> 'P' AND k % 7 <> 0 AS answered FROM c),
m AS (SELECT conv, k, turn AS t, 0 AS depth FROM a WHERE cite IS NULL
      UNION ALL SELECT a.conv, a.k, greatest(m.t, CASE WHEN y.answered THEN y.turn + 1 END), m.depth + 2 FROM m JOIN a ON a.conv = m.conv AND a.cite = m.k JOIN a y ON y.conv = m.conv AND y.k = m.k),
e AS (SELECT a.*, m.t, m.depth, CASE WHEN name = 'audit' THEN 'unknown_tool' WHEN k % 10 < 3 THEN 'invalid_arguments' WHEN answered THEN 'ok' ELSE 'unanswered' END AS status FROM a JOIN m USING (conv, k))
SELECT conv AS conv_id, turn, 0 AS part, t AS order_turn, 0 AS order_part, depth, 'call' AS kind, 'c' || k AS call_id, name, status,
  '{"arguments":' || args || ',"id":"c' || k || '","kind":"call","name":"' || name || '","role":"assistant","status":"' || status || '"}' AS json FROM e
UNION ALL SELECT conv, turn + 1, 0, greatest(turn + 1, t), 0, depth + 1, 'result', 'c' || k, name, 'ok',
  '{"content":"' || s || '","id":"c' || k || '","kind":"result","name":"' || name || '","role":"tool","status":"ok"}' FROM e WHERE answered
UNION ALL SELECT conv, turn + 1, 0, turn + 1, 0, 0, 'result', 'z' || k, NULL, 'orphan_result',
  '{"content":"' || s || '","id":"z' || k || '","kind":"result","name":null,"role":"tool","status":"orphan_result"}' FROM e WHERE s <> 'P' AND k % 7 = 0
UNION ALL SELECT DISTINCT conv, -1, 0, -1, 0, 0, 'tool', NULL, 'ship', 'ok', '{"id":null,"kind":"tool","name":"ship","parameters":"""
    + _PARAMETERS
    + ""","role":"system","status":"ok"}' FROM e"""
)
