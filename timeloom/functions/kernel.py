"""Arrow functions for what built-in expressions cannot say: Unicode forms, subsequences, loose JSON and repeated n-grams."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; memory is one row of the shorter side."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def balanced(text: str) -> list[str]:
    """All ``{...}`` with matching braces, inner ones too, in the order in which they begin; braces in JSON strings do not count. An opening brace without an end is passed over."""
    out, opened, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"' and opened:
            quoted = True
        elif c == "{":
            opened.append(i)
        elif c == "}" and opened:
            begin = opened.pop()
            out.append((begin, text[begin : i + 1]))
    return [t for _, t in sorted(out)]


def without_commas(text: str) -> str:
    """JSON text without commas before a closing bracket, but for those in strings."""
    return "".join(x if x.startswith('"') else re.sub(r",(?=\s*[}\]])", "", x) for x in re.split(r'("(?:[^"\\]|\\.)*")', text))


def loose(text: str | None, needed: tuple[str, ...] = ()) -> str | None:
    """Strict JSON of the first readable object in a loose text (fences, prose, trailing commas); the longest is tried first."""
    if text is None:
        return None
    for part in [text, *sorted(balanced(text), key=len, reverse=True)]:
        for form in (part, without_commas(part)):
            try:
                got = json.loads(form)
            except ValueError:
                continue
            if isinstance(got, dict) and all(k in got for k in needed):
                return json.dumps(got, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return None


def repeated_share(text: str, n_from: int = 2, n_to: int = 5, least: int = 8) -> float:
    """Largest share of a text that one n-gram of characters covers by following itself at least ``least`` times."""
    best = 0
    for n in range(n_from, n_to + 1):
        run = 0
        for i in range(n, len(text)):
            run = run + 1 if text[i] == text[i - n] else 0
            if (run + n) // n >= least:
                best = max(best, (run + n) // n * n)
    return best / len(text) if text else 0.0


def numeric_values(text: str | None) -> list[int] | None:
    """The numbers of a text that holds nothing but numbers (0-99) and separators; null otherwise."""
    if text is None or not re.fullmatch(r"[\s,.、。0-9]*", t := unicodedata.normalize("NFKC", text)):
        return None
    got = [int(x) for x in re.findall(r"\d+", t)]
    return got if got and max(got) <= 99 else None


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else lcs(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def loose_json(s: pd.Series) -> pd.Series:
    return s.map(loose)


@F.pandas_udf(T.DoubleType())
def repeated_ngram_share(s: pd.Series) -> pd.Series:
    return s.map(lambda t: repeated_share(t or ""))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def numbers_only(s: pd.Series) -> pd.Series:
    return s.map(numeric_values)
