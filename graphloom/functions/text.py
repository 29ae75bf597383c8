"""Column expressions over names, paths and text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import names as N

_WORD = r"[\p{L}\p{M}\p{N}_-]+"
_LOW = r"[\p{L}\p{M}&&[^\p{Lu}]]"
_PART = rf"\p{{Lu}}+(?=\p{{Lu}}{_LOW})|\p{{Lu}}*{_LOW}+|\p{{Lu}}+|\p{{N}}+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Words of letters, digits, ``_`` and ``-``, lower-cased, each followed by its parts if it has several.

    Most words of prose are small letters alone, and are one part each; only others are searched for parts.
    """
    trimmed = F.transform(_all(text, _WORD), lambda w: F.btrim(w, F.lit("_-")))

    def parts(word: Column) -> Column:
        found = _all(word, _PART)
        several = F.concat(F.array(F.lower(word)), F.when(F.size(found) > 1, F.transform(found, F.lower)).otherwise(F.array().cast("array<string>")))
        return F.when(word.rlike("[^a-z]"), several).otherwise(F.array(word))

    return F.flatten(F.transform(F.filter(trimmed, lambda w: w != ""), parts))


def path_tokens(path: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return _all(F.lower(path), r"[\p{L}\p{N}]+")


def rank_name(text: Column) -> Column:
    """ASCII letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def grep_terms(text: Column) -> Column:
    """Sorted different ASCII words, split where case rises and where letters and digits meet."""
    return F.array_sort(F.array_distinct(F.transform(_all(text, "[A-Z]*[a-z]+|[A-Z]+|[0-9]+"), F.lower)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def label_words(text: Column) -> Column:
    """Lower-cased ASCII words, split only where a capital follows a small letter or digit."""
    marked = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.transform(_all(marked, "[A-Za-z0-9]+"), F.lower)


def title_case(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def compact(label: Column) -> Column:
    """At most 34 characters."""
    trimmed = F.trim(label)
    return F.when(F.length(trimmed) > 34, F.concat(F.substring(trimmed, 1, 31), F.lit("..."))).otherwise(trimmed)


def noisy_path(path: Column) -> Column:
    """Whether a path is generated, vendored or a lock or vocabulary file."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    ends = F.lit(False)
    for ending in N.NOISY_ENDINGS:
        ends = ends | plain.endswith(ending)
    return F.coalesce(F.arrays_overlap(F.split(plain, "/"), F.array(*map(F.lit, N.NOISY_SEGMENTS))) | ends, F.lit(False))


def plausible_file(path: Column) -> Column:
    """Whether a path can name a file rather than a folder or a template."""
    trimmed = F.trim(path)
    name = F.element_at(F.split(F.replace(trimmed, F.lit("\\"), F.lit("/")), "/"), -1)
    bad = (trimmed == "") | trimmed.contains("{") | trimmed.contains("}") | trimmed.isin(*N.NO_FILES)
    return F.coalesce(~bad & (name.contains(".") | name.isin(*N.BARE_FILES)), F.lit(False))


def layout_dir(path: Column) -> Column:
    """First path segment; empty for files at the root."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(plain.contains("/"), F.regexp_extract(plain, "^/*([^/]*)/", 1)).otherwise("")


def first_segment(path: Column) -> Column:
    """First non-empty path segment, be it the file's own name."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "^/*([^/]+)", 1)


def selector_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def short_name(name: Column) -> Column:
    """The last non-empty part of a qualified name."""
    parts = F.filter(F.split(name, "[:./#]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), name)


def snippet(text: Column, terms: list[str], chars: int = 160) -> Column:
    """A stretch about the first matching word, with matching words marked."""
    if not terms:
        return F.lit(None).cast("string")
    any_term = "(?i)(" + "|".join(sorted(map(_quoted, terms), key=len, reverse=True)) + ")"
    at = F.regexp_instr(text, F.lit(any_term))
    start = F.greatest(at - chars // 4, F.lit(1))
    cut = F.substring(text, start, F.lit(chars))
    return F.when(at > 0, F.regexp_replace(cut, any_term, "<b>$1</b>"))


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, "</?b>", "")


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in term)


def cut_bytes(text: Column, limit: int = 2048) -> Column:
    """At most ``limit`` bytes of UTF-8, never half a character."""
    whole = F.octet_length(text) <= limit
    cut = F.substring(F.encode(text, "utf-8"), 1, limit + 1)
    following = F.conv(F.hex(F.substring(cut, limit + 1, 1)), 16, 10).cast("int")
    # a byte 10xxxxxx after the cut continues a character that must go
    tail = F.lit(limit)
    for back in range(3, 0, -1):
        byte = F.conv(F.hex(F.substring(cut, limit + 1 - back, 1)), 16, 10).cast("int")
        lead = byte >= 0xC0
        tail = F.when(lead & (following >= 0x80) & (following < 0xC0), F.lit(limit - back)).otherwise(tail)
    return F.when(whole, text).otherwise(F.expr("''") if limit <= 0 else F.decode(F.substring(cut, F.lit(1), tail), "utf-8"))


def string_prop(props: Column, key: str) -> Column:
    return F.regexp_replace(F.get_json_object(props, f"$.{key}"), '^"|"$', "")


def array_prop(props: Column, key: str) -> Column:
    """The non-empty strings of a JSON array property; no array gives an empty array."""
    found = F.from_json(F.get_json_object(props, f"$.{key}"), "array<string>")
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, '^"|"$', ""))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))


def fetch_reason(reason: Column) -> tuple[Column, Column]:
    """(accessed keys, fetch count) of a reason like ``keys:a,b|fetches:2``."""
    parts = F.split(reason, r"\|")
    last = lambda mark: F.try_element_at(F.filter(parts, lambda p: p.startswith(mark)), F.lit(-1))
    keys = F.filter(F.transform(F.split(F.substring(last("keys:"), 6, 1_000_000), ","), lambda k: F.trim(k)), lambda k: k != "")
    count = F.try_to_number(F.regexp_extract(F.coalesce(last("fetches:"), F.lit("")), r"^fetches:(\d+)$", 1), F.lit("9999999999")).cast("int")
    return F.coalesce(keys, F.array().cast("array<string>")), count


def node_text(label: Column, props: Column) -> Column:
    """Searchable text of a semantic node: its label, string properties and array properties in their fixed order."""
    strings = [F.get_json_object(props, f"$.{p}") for p in N.TEXT_PROPS]

    def flat(key: str) -> Column:
        items = F.from_json(F.get_json_object(props, f"$.{key}"), "array<string>")
        named = lambda x: F.when(x.startswith("{"), F.concat_ws(" ", *[F.get_json_object(x, f"$.{k}") for k in ("name", "summary", "label", "kind")])).otherwise(x)
        return F.array_join(F.filter(F.transform(items, named), lambda x: x != ""), " ")

    arrays = [F.nullif(flat(p), F.lit("")) for p in N.ARRAY_PROPS]
    return F.when(label.isin(*N.SEMANTIC_LABELS), F.concat_ws(" ", label, *strings, *arrays)).otherwise("")
