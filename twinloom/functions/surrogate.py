"""Surrogates of texts: a keyed bijection that keeps their form.

Letters stay letters of their case, digits stay digits, and all else stays where it
is. In each of four rounds every second character is moved on within its class, by
as much as a digest of the others says, and then the others by a digest of these. A
round can be undone by whoever has the key, so different texts keep different
surrogates and equal ones stay equal. A text with characters beyond ASCII is first
written as the hexadecimal digits of its bytes, behind a character that no other
surrogate begins with. Null stays null.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa

ROUNDS = 4
#: Begins surrogates of texts beyond ASCII.
MARK = "¤"
# The classes of characters that are moved on.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: Positions that one digest serves, two hexadecimal digits each; later ones use it again.
STEPS = 32


def surrogate_text(text: str | None, key: str) -> str | None:
    """The surrogate of one text."""
    if text is None:
        return None
    chars = list(text if text.isascii() else text.encode().hex().upper())
    for r in range(ROUNDS):
        for side in (0, 1):
            others = "".join(x for i, x in enumerate(chars) if i % 2 != side)
            digest = hashlib.sha256(f"{key}|{r}|{side}|{others}".encode()).digest()
            for i in range(side, len(chars), 2):
                for letters in CLASSES:
                    if chars[i] in letters:
                        chars[i] = letters[(letters.index(chars[i]) + digest[i % STEPS]) % len(letters)]
                        break
    return ("" if text.isascii() else MARK) + "".join(chars)


def surrogates(texts: pa.Array, key: str) -> pa.Array:
    """The surrogates of a column; equal values are worked out once."""
    coded = texts.dictionary_encode()
    return pa.array([surrogate_text(t, key) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def surrogate_sql(name: str, source: str, column: str, key: str) -> str:
    """Tables that end in ``name``: ``source`` (of ASCII texts) with column ``column`` replaced."""
    parts = [f"{name}_0 AS (SELECT *, CASE WHEN {column} = '' THEN [] ELSE string_split({column}, '') END AS _c FROM {source})"]
    step = f"('0x' || substr(_d, 2 * ((i - 1) % {STEPS}) + 1, 2))::INT"
    moved = "x"
    for letters in CLASSES:
        moved = f"CASE WHEN instr('{letters}', x) > 0 THEN substr('{letters}', (instr('{letters}', x) - 1 + {step}) % {len(letters)} + 1, 1) ELSE {moved} END"
    at = 0
    for r in range(ROUNDS):
        for side in (0, 1):
            digest = f"sha256('{key}|{r}|{side}|' || coalesce(array_to_string(list_filter(_c, lambda x, i: (i - 1) % 2 <> {side}), ''), ''))"
            changed = f"list_transform(_c, lambda x, i: CASE WHEN (i - 1) % 2 = {side} THEN {moved} ELSE x END)"
            parts.append(f"{name}_{at + 1} AS (SELECT * EXCLUDE (_d) REPLACE ({changed} AS _c) FROM (SELECT *, {digest} AS _d FROM {name}_{at}))")
            at += 1
    parts.append(f"{name} AS (SELECT * EXCLUDE (_c) REPLACE (CASE WHEN {column} IS NOT NULL THEN coalesce(array_to_string(_c, ''), '') END AS {column}) FROM {name}_{at})")
    return ", ".join(parts)
