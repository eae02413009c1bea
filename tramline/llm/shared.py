"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa

from tramline.plans.scratch import discard, new_path, shared_dir, written  # noqa: F401  the operators take them from here

#: ASCII-only lower-casing of UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def free_name(taken: list[str], stem: str) -> str:
    """A column name that starts with `stem` and clashes with none of `taken`, whatever the case."""
    used, name, k = {c.lower() for c in taken}, stem, 0
    while name.lower() in used:
        k += 1
        name = f"{stem}_{k}"
    return name


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
