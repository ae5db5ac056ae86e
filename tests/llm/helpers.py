"""Plain versions of the operators' contracts, and the tables that every operator must survive."""

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def near_copies(n: int) -> list[tuple]:
    """A base text and copies with a few words changed, passages they share, and unlike texts."""
    words = [f"w{i * 7 % 101}x{i}" for i in range(90)]
    rows = []
    for k in range(n):
        w = list(words)
        for j in range(k % 7):
            w[(k * 13 + j * 29) % 90] = f"edit{k}v{j}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(words[:30] + [f"own{k}n{i}" for i in range(40)])) for k in range(5)]
    return rows


def odd_rows() -> list[tuple]:
    """Nulls, empties, ties, repeated rows, one long text."""
    long = " ".join(f"t{i % 5003}" for i in range(30_000))
    return [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "One TWO"), (505, long), (506, long), (506, long), (507, "é" * 50 + " end"), (None, "one two"), (None, None), (508, "\x0ba\x0cb\xa0c")]
