"""Operator 2, quality rules: lines are judged first, then what is left of the document."""

from __future__ import annotations

import re
from collections import Counter
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, map_rows, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: The marks that stand between the entries of a menu, and phrases of page furniture.
SEPARATORS = frozenset({"|", "»", "›", "·", "•", ">", "/"})
PHRASES = r"\b(cookies|privacy policy|terms of (use|service)|all rights reserved|copyright|enable javascript|click here|sign (in|up)|log ?in|subscribe|newsletter|read more|share this|skip to (main )?content|powered by|lorem ipsum)\b"
ENDS = "[.!?:;…。！？][\"'”’»)\\]]*$"
INNER = r"[.!?…][\x20\x09-\x0D]"
#: A line of so many code points or more that a lower-case letter follows on the next line is wrapped prose: its end is not judged.
WRAPPED = 40
_phrases, _ends, _inner, _symbol = re.compile(PHRASES, re.I | re.A), re.compile(ENDS), re.compile(INNER), re.compile("[#*$%&|<>]")


def line_fails(line: str, after: str = "") -> bool:
    """Whether a line with a word breaks a rule; after is the next line.

    Navigation: two or more separators with three words or fewer between them on average. Symbols: over a third of three or more
    words hold one of SYMBOLS. Punctuation: no sentence end at the line's end and either under 10 words or no sentence end within,
    unless the line is wrapped (WRAPPED code points or more, and the next line goes on with a lower-case letter); or over half of
    eight or more words end in an exclamation mark. Boilerplate: a phrase of page furniture, as whole words, in 40 words or fewer.
    """
    line = line.strip(BLANKS)
    words = line.encode().split()
    n = len(words)
    if not n:
        return False
    if "|" in line or _symbol.search(line) or any(x in line for x in "»›·•/"):
        separators = sum(w.decode() in SEPARATORS for w in words)
        if separators >= 2 and n - separators <= 3 * (separators + 1):
            return True
        if n >= 3 and 3 * sum(_symbol.search(w.decode()) is not None for w in words) > n:
            return True
    if not _ends.search(line) and (n < 10 or not _inner.search(line)):
        goes_on = after.strip(BLANKS)[:1]
        if len(line) < WRAPPED or not goes_on or category(goes_on) != "Ll":
            return True
    if n >= 8 and "!" in line and 2 * sum(w.endswith(b"!") for w in words) > n:
        return True
    return n <= 40 and _phrases.search(line) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words that are in a 3-word window which is found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n <= 100_000:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) == n:
            return 0
        often = np.fromiter(map(times.__getitem__, windows), np.int64, n) > 1
    else:  # by numbers in place of tuples, for memory
        ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
        _, two = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
        _, three, count = np.unique(two[:-1].astype(np.int64) * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
        often = count[three] > 1
    cover = np.zeros(n + 2, bool)
    for k in range(3):
        cover[k : k + n] |= often
    return int(cover.sum())


def judge(text: str | None, min_words: int = 50, max_repeat: float = 0.5, max_lost: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, chars_left, clean)."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    dup = failed = 0
    clean, left = [], 0
    lines = text.split("\n")
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        bare = line.strip(BLANKS)
        if bare:
            dup += line in seen
            seen.add(line)
            if line_fails(bare, after):
                failed += 1
                continue
            left += len(bare) - sum(map(bare.count, BLANKS))
        clean.append(line)
    repeats = repeated_words(words)
    base = len(words) < min_words or repeats > max_repeat * len(words)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeats, base, not base and left >= (1 - max_lost) * chars, len(lines), failed, left, "\n".join(clean)


def apply_rules(docs: DataFrame, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """The columns keep of docs (default doc_id) with the counts and verdicts of judge(), and with_text the cleaned text.

    Every row is judged by itself, so ties, repeated rows and null ids need no rule; a null text counts as empty and fails for having
    too few words; other columns are not read. One pass, no shuffle.
    """
    names = ["doc_id"] if keep is None else keep
    kinds = dict(docs.select(*names).dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, chars_left long"
    upto = None if with_text else -1
    return map_rows(docs, [F.col("text").alias("_text"), *names], lambda text, *own: (*own, *judge(text)[:upto]), schema + (", clean string" if with_text else ""))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), with_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents columns of each row that is kept, with its failed lines cut out of the text and n_chars counted anew.

    Rows are judged one by one: null ids, repeated rows and ties need no rule, a null text goes (too few words), an empty table gives no
    rows, columns beyond those of documents are dropped.
    """
    out = apply_rules(docs, ["doc_id", "lang", "source"]).where("kept")
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.char_length("clean").cast("long").alias("n_chars")).select(*DOCUMENT_COLUMNS)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
base AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
tri AS (SELECT r, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
often AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY p) AS nth, lead(line) OVER (PARTITION BY r ORDER BY p) AS after, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d)),
s AS (SELECT *, regexp_extract_all(bare, '[^\x20\x09-\x0D]+') AS ws FROM l),
c AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: x IN ('|', '»', '›', '·', '•', '>', '/'))) AS seps, len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS syms,
      len(list_filter(ws, lambda x: x LIKE '%!')) AS bangs, length(array_to_string(ws, '')) AS chars FROM s),
f AS (SELECT *, n > 0 AND ((seps >= 2 AND n - seps <= 3 * (seps + 1)) OR (n >= 3 AND 3 * syms > n)
      OR (NOT regexp_matches(bare, '{ENDS.replace("'", "''")}') AND (n < 10 OR NOT regexp_matches(bare, '[.!?…][\x20\x09-\x0D]')) AND NOT (length(bare) >= {WRAPPED} AND regexp_matches(coalesce(after, ''), '^[\x20\x09-\x0D]*\p{{Ll}}')))
      OR (n >= 8 AND 2 * bangs > n) OR (n <= 40 AND regexp_matches(bare, '(?i){PHRASES}'))) AS bad FROM c),
lines AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_failed_lines, count(*) FILTER (WHERE n > 0 AND nth > 1) AS n_dup_lines,
      coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS chars_left FROM f GROUP BY r),
v AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, n_failed_lines, chars_left FROM d JOIN lines USING (r) LEFT JOIN base USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * chars_left >= word_chars AS kept, n_lines, n_failed_lines,
       CAST(chars_left AS BIGINT) AS chars_left FROM b
"""
