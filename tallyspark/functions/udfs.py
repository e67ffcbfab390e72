"""The few scalar functions that Spark has no expressions for: Arrow-batched, pure and deterministic."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "[redacted-name]"


def portfolio_token(secret: str):
    """Opaque stable token of a portfolio key: keyed digest in base 32; null without a key or a secret."""

    @F.pandas_udf(T.StringType())
    def token(keys: pd.Series) -> pd.Series:
        def one(k):
            k = (k or "").strip().upper()
            if not k or not secret.strip():
                return None
            digest = hmac.new(secret.strip().encode(), k.encode(), hashlib.sha256).digest()
            return "P-" + base64.b32encode(digest).decode()[:16]

        return keys.map(one, na_action=None)

    return token


def redact_names(tokens: list[str]):
    """Names in a text become one mark each: configured tokens anywhere, and the capitalised words next to them.

    A text is read once into spans: marks (listed tokens of three characters or more, whatever their case), capitalised words
    (a capital and more letters), other words and what lies between.  A mark takes in a capitalised word that only blanks
    part from it, and the next mark if no more than one other word stands between them."""
    listed = [t.strip().casefold() for t in tokens if len(t.strip()) >= 3]

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: _with_marks(s or "", listed), na_action=None)

    return redact


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _with_marks(text: str, listed: list[str]) -> str:
    folded = text.lower() if len(text.lower()) == len(text) else text
    marked = [False] * len(text)
    for token in listed:
        at = folded.find(token)
        while at >= 0:
            marked[at : at + len(token)] = [True] * len(token)
            at = folded.find(token, at + len(token))
    spans: list[tuple[str, int, int]] = []  # kind, begin, end
    i = 0
    while i < len(text):
        j, letter = i + 1, _letter(text[i])
        while j < len(text) and marked[j] == marked[i] and (marked[i] or _letter(text[j]) == letter):
            j += 1
        word = text[i:j]
        kind = "mark" if marked[i] else "gap" if not letter else "name" if len(word) > 1 and word[0].isupper() else "word"
        spans.append((kind, i, j))
        i = j
    # names next to marks, outwards from each
    kinds = [k for k, _, _ in spans]
    blank = lambda n: kinds[n] == "gap" and text[spans[n][1] : spans[n][2]].isspace()
    for order in (range(len(spans)), range(len(spans) - 1, -1, -1)):
        step = 1 if order.step > 0 else -1
        for n in order:
            other = n - 2 * step
            if kinds[n] == "name" and 0 <= other < len(spans) and kinds[other] == "mark" and blank(n - step):
                kinds[n] = "mark"
    out, at = [], 0
    n = 0
    while n < len(spans):
        if kinds[n] != "mark":
            n += 1
            continue
        last = n
        while (follow := next((m for m in range(last + 1, len(spans)) if kinds[m] == "mark"), None)) is not None:
            between = [k for k in kinds[last + 1 : follow] if k in ("word", "name")]
            if len(between) > 1 or any(c in "[]" for c in text[spans[last][2] : spans[follow][1]]):
                break
            last = follow
        out += [text[at : spans[n][1]], _MARK]
        at, n = spans[last][2], last + 1
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def normalized_narration(texts: pd.Series) -> pd.Series:
    """Canonically composed, case-folded, single spaces; '' for null."""
    return texts.fillna("").astype(str).str.casefold().str.split().str.join(" ").str.normalize("NFC")


#: Characters that belong to a word in any script: letters, digits, marks, connecting punctuation and joiners.
_WORD = r"[\p{L}\p{N}\p{M}\p{Pc}\u200C\u200D]"


def contains_whole_token(text: Column, token: Column) -> Column:
    """Whether the token stands in the text with no word character next to it (letters, digits, marks and joiners of any script)."""
    quoted = F.concat(F.lit(f"(?<!{_WORD})\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{_WORD})"))
    return F.coalesce((token != "") & F.regexp_like(text, quoted), F.lit(False))


def register(spark) -> None:
    """The functions under their names for SQL."""
    spark.udf.register("normalized_narration", normalized_narration)
    for name, args, body in _SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")


#: Functions of expressions alone, for SQL: name, arguments, body.
_SQL_FUNCTIONS = [
    ("normalized_text", "c STRING", "trim(regexp_replace(regexp_replace(lower(coalesce(c, '')), '[^a-z0-9 ]+', ' '), ' +', ' '))"),
    ("normalized_counterparty", "c STRING", r"regexp_replace(lower(coalesce(c, '')), '[^\\p{L}\\p{N}]', '')"),
    ("normalized_mask", "c STRING", r"CASE WHEN regexp_replace(coalesce(c, ''), '[\\s-]', '') RLIKE '^[0-9Xx*#]+$' THEN regexp_replace(regexp_replace(c, '[\\s-]', ''), '[x*#]', 'X') ELSE '' END"),
    ("masks_agree", "a STRING, b STRING", "least(length(a), length(b)) > 0 AND forall(sequence(1, greatest(least(length(a), length(b)), 1)), i -> substr(a, -i, 1) = substr(b, -i, 1) OR substr(a, -i, 1) = 'X' OR substr(b, -i, 1) = 'X')"),
    ("contains_whole_token", "t STRING, k STRING", r"coalesce(k <> '' AND regexp_like(t, concat('(?<![\\p{L}\\p{N}\\p{M}\\p{Pc}\\u200C\\u200D])\\Q', replace(k, '\\E', '\\E\\\\E\\Q'), '\\E(?![\\p{L}\\p{N}\\p{M}\\p{Pc}\\u200C\\u200D])')), false)"),
]


def narration_names(narration: Column, counterparty: Column) -> Column:
    """Whether a statement's narration names a counterparty as a whole token."""
    return contains_whole_token(normalized_narration(narration), normalized_narration(counterparty))
