"""Column names."""

from __future__ import annotations

from collections import Counter


def snake_case(name: str) -> str:
    """CamelCase to snake_case, by ASCII letters: a new word begins at a capital after a small letter or digit, and at the last
    capital of a run that a small letter follows. Outer white space goes; inner spaces and hyphens stay."""
    s = name.strip()
    capital = ["A" <= c <= "Z" for c in s]
    small = ["a" <= c <= "z" for c in s]
    out = []
    for k, c in enumerate(s):
        if k and capital[k] and (small[k - 1] or "0" <= s[k - 1] <= "9" or capital[k - 1] and k + 1 < len(s) and small[k + 1]):
            out.append("_")
        out.append(c)
    return "".join(out).lower()


def snake_cased(names: list[str]) -> list[str]:
    """All names in snake_case; two that become one are an error."""
    made = [snake_case(n) for n in names]
    twice = [n for n, c in Counter(made).items() if c > 1]
    if twice:
        raise ValueError(f"columns with the same name after renaming: {', '.join(twice)}")
    return made
