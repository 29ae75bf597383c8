"""Functions of request arguments, which are scalars on the driver."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

import regex

from graphloom.functions import names as N

_PART = regex.compile(r"\p{Lu}+(?=\p{Lu}[[\p{L}\p{M}]--\p{Lu}])|\p{Lu}*[[\p{L}\p{M}]--\p{Lu}]+|\p{Lu}+|\p{N}+", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_-]+")


def query_terms(query: str) -> list[str]:
    """Different code tokens of a query in order of appearance, and the synonyms that they bring."""
    found: list[str] = []
    for word in _WORD.findall(query):
        word = word.strip("_-")
        if word:
            parts = _PART.findall(word)
            found += [word.lower(), *(p.lower() for p in parts if len(parts) > 1)]
    return list(dict.fromkeys([*found, *(s for t in dict.fromkeys(found) for s in N.SYNONYMS.get(t, ()))]))


def rank_name(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isalnum()).lower()


def ranking_terms(*parts: str | None) -> list[str]:
    words = {w.strip("_").lower() for p in parts if p for w in re.split(r"[^A-Za-z0-9_]+", p)}
    return sorted(w for w in words if len(w) >= 3)


def expanded_query(query: str, *extra: str | None) -> str:
    """The query with at most six words of its context that it lacks."""
    own = set(ranking_terms(query))
    added = [w for w in ranking_terms(*extra) if w not in own][:6]
    return " ".join([query, *added])


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    return max(least, min(most, default if value is None else value))


def is_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) is not None


def fnv1a(data: bytes) -> int:
    """FNV-1a, 32 bits."""
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def repository_folder(path: str) -> str:
    """A readable folder name of a repository path, kept apart from others by a hash."""
    slug = re.sub(r"[^a-z0-9]+", "-", path.rstrip("/").rsplit("/", 1)[-1].lower()).strip("-") or "repo"
    return f"{slug}-{fnv1a(path.encode()):08x}"


def repository_name(url: str) -> str:
    return re.sub(r"\.git$", "", re.split(r"[/:]", url.rstrip("/"))[-1]) or "repo"


def unique_name(name: str, taken: set[str]) -> str:
    out, k = name, 2
    while out in taken:
        out, k = f"{name}-{k}", k + 1
    return out


def file_uri_path(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" and parts.netloc in ("", "localhost") else None


def risk_level(consumers: int, mismatch: bool) -> str:
    """LOW, MEDIUM or HIGH, one higher if some consumer reads what no response has."""
    level = 2 if consumers >= 10 else 1 if consumers >= 4 else 0
    return ("LOW", "MEDIUM", "HIGH")[min(2, level + mismatch)]
