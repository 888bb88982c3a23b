"""SQL text fragments for the comparison queries."""

from __future__ import annotations


def s_base(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), "
            f"'^_+|_+$', '', 'g')")


def s_singular(stem: str) -> str:
    """Written as the rule reads: `ies`, then a plain `s`, then an `e` left by `es`."""
    cut = f"left({stem}, length({stem}) - 1)"
    cut2 = f"left({stem}, length({stem}) - 2)"
    return (
        f"CASE WHEN {stem} LIKE '%ies' AND length({stem}) > 4 THEN left({stem}, length({stem}) - 3) || 'y' "
        f"WHEN {stem} LIKE '%s' AND NOT ({stem} LIKE '%ss' OR {stem} LIKE '%us' OR {stem} LIKE '%is') "
        f"AND length({stem}) > 3 THEN CASE WHEN {cut} LIKE '%e' AND length({stem}) > 4 AND "
        f"regexp_matches({cut2}, '(ss|x|z|ch|sh)$') THEN {cut2} ELSE {cut} END "
        f"ELSE {stem} END")


def s_norm_of(stem: str) -> str:
    """`stem` must be a column already passed through `s_base`."""
    return f"regexp_replace({s_singular(stem)}, '^_+|_+$', '', 'g')"


def s_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def s_array(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
