"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

quality() gives counts of the text as it came and the verdict, and on demand the text without its failed lines;
filter_quality() gives the documents that pass with that text.
Cases: an empty table gives no rows; a null or empty text has no words and is rejected by the base rule; ids aren't looked at and may be null or repeated;
extra columns are ignored by quality() and pass unchanged, whatever their names, through filter_quality(); repeated rows get
one result each; no rule depends on other rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import kernel as K


@dataclass(frozen=True)
class Rules:
    #: Base: fewer words, or a larger share of words (per cent) in repeated 3-word windows, rejects a document.
    min_words: int = 50
    max_repeat_pct: int = 50
    #: A line fails when its symbols make more than this share of its words, or its exclamation marks do.
    max_symbols: float = 0.3
    max_shouts: float = 0.5
    #: So many of either are no fault in the shortest line.
    few: int = 2
    #: A line with this many words or more fails when one word makes more than this share of it.
    same_words: int = 8
    max_same: float = 0.4
    #: A line fails as navigation when separators make more than this share of its tokens.
    max_separators: float = 0.2
    #: A document is rejected when the lines that remain hold less than this share of its word characters.
    min_left: float = 0.6


SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATORS = frozenset(["|", "»", "›", "•", "·", "/", ">", "::", "-", "→"])
#: A whole line that is a notice: what follows its opening must be what follows it in notices, as the same words open sentences too.
BOILERPLATE = re.compile(
    r"^(©.{0,120}|\(c\) ?[0-9]{4}.{0,120}|copyright(( ?©| \(c\)| [0-9]{4}|:).{0,110}|[.]?)|all rights reserved\b.{0,80}|(licensed|released) under (the|a|an|cc|mit|gpl|apache|bsd|creative commons)\b.{0,110}"
    r"|this work is licensed\b.{0,110}|terms (of (use|service)|and conditions)( (apply|and|of|for|[|/-]) ?.{0,80})?[.]?|privacy (policy|notice)( (and|of|for|[|/-]) ?.{0,80})?[.]?"
    r"|(we use cookies|(this|our) (web)?site uses cookies|accept (all )?cookies|cookie (policy|settings|preferences|notice|consent))\b.{0,120}"
    r"|subscribe( (now|today|here|to|for) ?.{0,80})?[.!]*|(sign ?(in|up|out)|log ?(in|out)|register)( (now|here|today|to|for|with|or|and|/) ?.{0,60})?[.!]*"
    r"|share (this|on) ?(page|post|article|story|link|facebook|twitter|x|linkedin|email|whatsapp)?( (on|with|via) .{0,40})?[.!:]*|follow us\b.{0,80}|click here\b.{0,100}"
    r"|skip to (main |the )?(content|navigation|main|search|footer)[.]?|please enable javascript\b.{0,100}"
    r"|(read|load|show|see|view|learn) (more|all)[.…»›>]*|continue reading[.…»›>]*|back to top|(next|previous) (page|post|article)[.…»›>]*)$",
    re.I,
)
_MENU = "home|products?|services?|about( us)?|contacts?( us)?|blog|news|sports?|login|log in|search|menu|shop|store|cart|help|faq|previous|next|more|top|archives?|events?|careers?|support|privacy|terms|sitemap|press|team|pricing|account|gallery|downloads?"
#: A whole line of names that menus have, two or more.
MENU = re.compile(rf"^({_MENU})([ ,/-]+({_MENU}))+$", re.I)


def line_fault(line: str, rules: Rules) -> str | None:
    """The first rule that a line fails: boilerplate, navigation, punctuation or repetition; None for a good line."""
    bare = line.strip()
    if BOILERPLATE.match(bare):
        return "boilerplate"
    tokens = line.split()
    n = len(tokens)
    if "|" in line or "»" in line or "›" in line or "•" in line or "·" in line:
        if sum(t in SEPARATORS for t in tokens[1:]) > rules.max_separators * n:  # the first one may be a bullet
            return "navigation"
    if len(bare) < 200 and MENU.match(bare):
        return "navigation"
    symbols, shouts = len(SYMBOLS.findall(line)), line.count("!")
    if symbols > max(rules.few, rules.max_symbols * n) or shouts > max(rules.few, rules.max_shouts * n):
        return "punctuation"
    if n >= rules.same_words and len(set(tokens)) < n * (1 - rules.max_same) + 1:
        counts: dict[str, int] = {}
        for t in tokens:
            counts[t] = counts.get(t, 0) + 1
        if max(counts.values()) > rules.max_same * n:
            return "repetition"
    return None


def lines_left(text: str, rules: Rules) -> list[str]:
    """The lines that pass every rule. Lines without a word part paragraphs and stay."""
    return [x for x in text.split("\n") if line_fault(x, rules) is None]


def word_size(text: str) -> int:
    return sum(map(len, text.split()))


def cleaned(text: str, rules: Rules) -> tuple[str, bool]:
    """The text without its failed lines, and whether it lost too much."""
    left = "\n".join(lines_left(text, rules))
    return left, word_size(left) < rules.min_left * word_size(text)


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = K.NOT_SPACE.astype(np.int64)
_POINT[0x80:0xC0] = 0


def base_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row: words, code points in words, symbols, words in 3-word windows that the row has twice or more."""
    out = np.zeros((len(offs) - 1, 4), np.int64)
    for i, j, part, own in K.pieces(data, offs):
        h, row, _, _ = K.words(part, own)
        out[i:j, 0] = np.bincount(row, minlength=j - i)
        for k, of in ((1, _POINT), (2, _SYMBOL)):
            total = np.concatenate([[0], np.cumsum(of[part])])
            out[i:j, k] = total[own[1:]] - total[own[:-1]]
        got, at = K.windows(h, row, 3)
        key = K.mixed(got + row[at].astype(np.uint64) * K.PRIME)  # equal for equal windows of one row only
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[at[twice] + k] = True
        out[i:j, 3] = np.bincount(row[hit], minlength=j - i)
    return out


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _judged(docs: DataFrame, keep: list[str], rules: Rules, text_col: str, clean: bool) -> DataFrame:
    """_row (a struct of keep), counts, verdict and, if asked for, _clean. One pass, no shuffle."""
    given = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    made = T.StructType([given.schema["_row"], *T.StructType.fromDDL(OUT).fields, *([T.StructField("_clean", T.StringType())] if clean else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            counts = base_counts(*K.buffers(col))
            failed = (counts[:, 0] < rules.min_words) | (100 * counts[:, 3] > rules.max_repeat_pct * counts[:, 0])
            texts = col.to_pylist()
            # Documents that the base rule rejects are cleaned only if their text is asked for.
            left = [cleaned(t, rules) if t and (clean or not f) else (t, False) for t, f in zip(texts, failed, strict=True)]
            kept = np.array([not f and not lost for (_, lost), f in zip(left, failed, strict=True)], bool)
            dups = [dup_lines(t) if t else 0 for t in texts]
            counted = [pa.array(x, pa.int64()) for x in (counts[:, 0], counts[:, 1], counts[:, 2], dups, counts[:, 3])]
            texts = [pa.array([t for t, _ in left], pa.string())] if clean else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *counted, pa.array(failed), pa.array(kept), *texts], names=[f.name for f in made])

    return given.mapInArrow(run, made)


def quality(docs: DataFrame, keep: list[str] | None = None, rules: Rules = Rules(), text_col: str = "text", clean_col: str | None = None) -> DataFrame:  # noqa: B008
    """One row for each document: the columns in keep, the counts and the verdict, and as clean_col the text without its
    failed lines (null for a null text)."""
    found = _judged(docs, keep or ["doc_id"], rules, text_col, clean_col is not None)
    return found.select("_row.*", *[x.split()[0] for x in OUT.split(", ")], *([F.col("_clean").alias(clean_col)] if clean_col else []))


def filter_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents that pass, their text without the lines that fail and n_chars, where there is one, as its length."""
    rest = [c for c in docs.columns if c != "text"]
    made = {"text": F.col("_clean")} | ({"n_chars": F.length("_clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in rest else {})
    found = _judged(docs, rest or ["text"], rules, "text", True).where("kept")
    return found.select(*[made[c].alias(c) if c in made else F.col("_row")[c].alias(c) for c in docs.columns])
