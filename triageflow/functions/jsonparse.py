"""Strict JSON answer extraction as native column expressions.

Python's ``json.loads`` rejects trailing text; Spark's JSON readers accept it.
Wrapping the text as ``[<text>,"~end~"]`` and requiring exactly two elements
with the sentinel second makes ``try_parse_json`` strict: any trailing text,
second value or bracket break-out either fails the parse or changes the
element count.

Known differences from Python's parser (documented, not emulated): NaN and
Infinity literals are rejected; duplicate keys keep the last value only with
``spark.sql.variant.allowDuplicateKeys=true`` (set by ``session.configure``).
A valid JSON value that is not an object is a parse error here (the
reference fails on it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triageflow.functions.text import let, py_strip

SENTINEL = "~end~"
GREEDY = r"(?s)\{.*\}"
NON_GREEDY = r"(?s)\{.*?\}"


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{SENTINEL}"]')))


def _vget(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _is_valid(w: Column) -> Column:
    """Two elements, the sentinel second: read by path, so that no element is copied."""
    return F.coalesce((_vget(w, "$[1]", "string") == F.lit(SENTINEL)) & _vget(w, "$[2]", "variant").isNull(), F.lit(False))


def _is_object(text: Column) -> Column:
    """Whether valid JSON is an object: its first character after white space tells."""
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def _object_of(w: Column, text: Column) -> Column:
    return F.when(_is_object(text), _vget(w, "$[0]", "variant"))


def strict_object(text: Column) -> Column:
    """The text parsed as a JSON object (Python-strict), else null."""
    return let(_wrapped(text), lambda w: F.when(_is_valid(w), _object_of(w, text)))


def answer_text(raw: Column, greedy: bool = True) -> Column:
    """The text that :func:`extract_answer` parses into an object, or null."""
    pattern = GREEDY if greedy else NON_GREEDY

    def from_span(span: Column) -> Column:  # starts with a brace
        return F.when((span != F.lit("")) & _is_valid(_wrapped(span)), span)

    def from_text(text: Column) -> Column:
        return let(_wrapped(text), lambda w: F.when(_is_valid(w), F.when(_is_object(text), text))
                   .otherwise(let(F.regexp_extract(text, pattern, 0), from_span)))

    return let(py_strip(raw), from_text)


def parsed_object(text: Column) -> Column:
    """The object of a text that is known to be one (:func:`answer_text`), null of null."""
    return F.try_parse_json(text)


# A JSON string, a run of other characters, or one that may take a space.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[^",:]+|[,:]'


def _escaped(token: Column) -> Column:
    """Characters outside printable ASCII as ``\\uXXXX`` (pairs above U+FFFF), in
    lower case like those already written so."""
    one = lambda c: F.when(c.rlike(r"^[\x20-\x7e]$"), c).otherwise(
        F.regexp_replace(F.lower(F.hex(F.encode(c, "utf-16be"))), "(.{4})", r"\\u$1"))
    parts = F.regexp_extract_all(token, F.lit(r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), 0)
    lowered = F.array_join(F.transform(parts, lambda x: F.when(x.startswith(r"\u"), F.lower(x)).otherwise(x)), "")
    ascii_only = F.when(token.contains(r"\u"), lowered).otherwise(token)
    return let(ascii_only, lambda t: F.when(t.rlike(r"[^\x20-\x7e]"), F.array_join(F.transform(F.split(t, ""), one), "")).otherwise(t))


def dumped(json_text: Column) -> Column:
    """Compact JSON as Python's ``json.dumps`` writes it: a space after every comma
    and colon outside strings, and everything outside printable ASCII escaped."""
    tokens = F.regexp_extract_all(json_text, F.lit(_JSON_TOKEN), 0)
    spaced = F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(_escaped(t)))
    return F.array_join(spaced, "")


def field_dump(parsed: Column, text: Column, name: str, default: str = "[]") -> Column:
    """A field of any kind as JSON text, as it stands: list, object, text, number,
    boolean or null; ``default`` where the object lacks it or there is none. ``parsed``
    tells the kind; all but text is copied from ``text`` (:func:`answer_text`),
    which keeps the order of their keys. Of repeated keys inside a list or object all
    stay; numbers stay as written."""
    v = _vget(parsed, f"$.{name}", "variant")
    kind = F.schema_of_variant(v)
    compact = F.when(kind == "STRING", F.to_json(v)).otherwise(F.get_json_object(text, f"$.{name}"))
    return F.when(v.isNull(), F.lit(default)).when(kind == "VOID", F.lit("null")).otherwise(dumped(compact))


def extract_answer(raw: Column, greedy: bool = True) -> Column:
    """Parsed answer object (variant) or null.

    strip -> strict parse of the whole text; if that is valid JSON but not an
    object -> null; if invalid -> strict parse of the regex span (greedy: first
    ``{`` to last ``}``; non-greedy: first ``{`` to the first ``}``).
    """
    pattern = GREEDY if greedy else NON_GREEDY

    def from_span(span: Column) -> Column:
        return F.when(span != F.lit(""), strict_object(span))

    def from_text(text: Column) -> Column:
        return let(_wrapped(text), lambda w: F.when(_is_valid(w), _object_of(w, text))
                   .otherwise(let(F.regexp_extract(text, pattern, 0), from_span)))

    return let(py_strip(raw), from_text)


def field_text(parsed: Column, name: str) -> Column:
    """Field as text (numbers print as JSON numbers, nested values as JSON)."""
    return _vget(parsed, f"$.{name}", "string")


def field_double(parsed: Column, name: str) -> Column:
    return _vget(parsed, f"$.{name}", "double")


def field_list(parsed: Column, name: str) -> Column:
    """List coercion: JSON array -> its elements as text; non-blank string ->
    one-element list; anything else (absent, null, blank, number, object) -> []."""
    as_list = _vget(parsed, f"$.{name}", "array<string>")  # null of any other kind
    as_str = _vget(parsed, f"$.{name}", "string")
    is_str = F.schema_of_variant(_vget(parsed, f"$.{name}", "variant")) == F.lit("STRING")
    return F.coalesce(as_list, F.when((F.length(py_strip(as_str)) > 0) & is_str, F.array(as_str)),
                      F.array().cast("array<string>"))
