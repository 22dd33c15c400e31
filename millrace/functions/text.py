"""Text functions: normalisation, shingles, masking, code fences, syntax."""

from __future__ import annotations

import ast
import json
import unicodedata
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_RE = r"(?U)(\w+)"
#: Ends of lines as Python's splitlines sees them, and what is none.
LINE_END, NOT_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Fixed value: the line above an instruction's input.
INPUT_HEADING = "Входные данные:"
#: White space as Python sees it: Java's Unicode class and the four information separators.
SPACE_RE = r"(?U)[\s\x1c-\x1f]+"

# Patterns of personal data, in the order in which they are applied, with placeholders.
PII = {
    "phone": (r"(?:\+7|\b8)[\s\-(]{0,3}\d{3}[\s\-)]{0,3}\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b", "[PHONE]"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    "birth_date": (
        r"((?:дат[аеы]\s+рождения|год\s+рождения|родил(?:ся|ась)|\bг\.\s?р\.|\bд\.\s?р\.)\s*[:\-—]?\s*)(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}\b",
        "$1[DATE]",
    ),
}
IGNORE_CASE = {"birth_date"}
#: What a text must have for a pattern to be worth a search: characters that each of its matches has.
HINTS = {"phone": "[78]", "email": "@", "birth_date": "[гдрГДР]"}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


#: A character that NFKC might change, alone or with its neighbours; the ranges left out it never does.
UNSAFE = r"[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F]"


def composed(text: Column) -> Column:
    """NFKC. Only texts that it could change go to the Python worker; the others cross as nulls."""
    return F.coalesce(nfkc(F.when(text.rlike(UNSAFE), text)), text)


@F.pandas_udf(T.StringType())
def casefold_key(text: pd.Series) -> pd.Series:
    """The leak key: case folded, white space collapsed."""
    return text.map(lambda t: " ".join(t.casefold().split()), na_action="ignore")


#: White space that is more than a lone space: nothing else needs replacing.
RUN_RE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, RUN_RE, " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFKC, en and em dashes to hyphens, white space collapsed and stripped, lower case.
    compose=False skips NFKC (and the Python worker) for text that is known to be composed."""
    # Dashes and the no-break space, and what stands for each.
    dashes = F.translate(composed(text) if compose else text, "\u2014\u2013\u2011\u00a0", "--- ")
    return F.lower(collapse(dashes))


def normalize_group(topic: Column, compose: bool = True) -> Column:
    return normalize_text(F.substring_index(topic, "|", 1), compose)


def clean_instruction(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_RE), 1)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: the optimizer would copy it to each of its uses."""
    return F.transform(F.array(value), body)[0]


def shingles(w: Column, size: int = 4) -> Column:
    """Distinct word n-grams of an array of words; fewer words make one shingle, none an empty array."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(w, of)


def _flags(name: str) -> str:
    return "(?iuU)" if name in IGNORE_CASE else "(?U)"


def pii_hits(text: Column, rules: dict = PII) -> dict[str, Column]:
    """Hits of each rule in the text that the rules before it have left."""
    out = {}
    for name, (pattern, replacement) in rules.items():
        out[name] = F.coalesce(F.regexp_count(text, F.lit(_flags(name) + pattern)), F.lit(0))
        text = _masked(text, name, pattern, replacement)
    return out


def _masked(text: Column, name: str, pattern: str, replacement: str) -> Column:
    replaced = lambda t: F.regexp_replace(t, _flags(name) + pattern, replacement)
    hint = HINTS.get(name) if PII.get(name) == (pattern, replacement) else None
    return let(text, lambda t: F.when(t.rlike(hint), replaced(t)).otherwise(t)) if hint else replaced(text)


def scrub(text: Column, rules: dict = PII) -> Column:
    for name, (pattern, replacement) in rules.items():
        text = _masked(text, name, pattern, replacement)
    return text


def strip(text: Column) -> Column:
    """Without white space, as Python sees it, at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE_RE}|{SPACE_RE.removeprefix('(?U)')}\z", "")


def line_count(text: Column) -> Column:
    """Lines as Python's splitlines counts them; null has none."""
    ends = F.regexp_count(text, F.lit(LINE_END))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).when(text.rlike(rf"(?:{LINE_END})\z"), ends).otherwise(ends + 1)


def strip_fence(text: Column) -> Column:
    """(code, fenced): stripped, and of a fenced text without its first line and all closing fence lines."""

    def of(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(t, rf"\A{NOT_END}*(?:{LINE_END}|\z)", ""), LINE_END, "\n")
        body = F.regexp_replace(body, r"(?U)(?:(?:\A|\n)[\s\x1c-\x1f&&[^\n]]*```[^\n]*)+\z", "")
        fenced = F.startswith(t, F.lit("```"))
        return F.struct(F.when(fenced, strip(body)).otherwise(t).alias("code"), fenced.alias("fenced"))

    return let(strip(F.coalesce(text, F.lit(""))), of)


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether Python's own parser accepts the code; depends on the interpreter's version."""

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pd.Series([_tree(c) is not None for c in code.fillna("")], dtype=bool)


def _tree(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except Exception:  # whatever the parser cannot take
        return None


def join_input(instruction: Column, given: Column, heading: str = INPUT_HEADING) -> Column:
    """The instruction, with its stripped input under a heading if there is any."""
    return let(strip(F.coalesce(given, F.lit(""))), lambda x: F.when(F.length(x) > 0, F.concat(instruction, F.lit(f"\n\n{heading}\n"), x)).otherwise(instruction))


@F.pandas_udf(T.BooleanType())
def is_json_object(text: pd.Series) -> pd.Series:
    """Whether the whole text is one JSON object; SQL's parsers let trailing text pass."""

    def one(t: str) -> bool:
        try:
            return isinstance(json.loads(t), dict)
        except (ValueError, TypeError, RecursionError):
            return False

    return text.map(one)
