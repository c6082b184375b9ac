"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags; licence expressions are parsed.

A text is lower-cased (A-Z only) and laid out as its words, one space between two. The automaton holds every phrase
with a space on either side, so a match is a place where the phrase's words stand one after another. Where the words of
an identifier tag are found, the expression behind the tag is taken from the text itself and evaluated by a
shunting-yard parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The method's own phrases and labels.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "licensed under the apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: Labels of licences that leave a text free to use; all others restrict it.
OPEN = frozenset({"cc-by", "mit", "apache", "bsd", "mpl", "cc0", "public-domain", "unlicense", "isc", "zlib"})

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_KINDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_TAG_IN_TEXT = re.compile(r"spdx-license-identifier\s*:\s*", re.I)
_TOKEN = re.compile(r"\(|\)|[\r\n]|[A-Za-z0-9][A-Za-z0-9.+\-:]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str, start: int = 0) -> list[str] | None:
    """The longest licence expression from start on in postfix order (with binds before and before or), None if there is none.

    An expression ends with its line, where an operand follows an operand, or where the brackets that are open are closed.
    """
    output: list[str] = []
    stack: list[str] = []
    # The length of the output and the operators left over where the expression was last complete.
    complete: tuple[int, list[str]] | None = None
    operand_next, depth = True, 0
    for m in _TOKEN.finditer(text, start):
        word = m[0].lower()
        if word in "\r\n":
            break
        if operand_next:
            if word == "(":
                stack.append(word)
                depth += 1
            elif word in _BINDS or word == ")":
                break
            else:
                output.append(word)
                operand_next = False
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif word == ")":
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                break
            stack.pop()
            depth -= 1
        else:
            break
        if not operand_next and not depth:
            complete = len(output), stack[::-1]
    return None if complete is None else output[: complete[0]] + complete[1]


def evaluate(postfix: list[str]) -> tuple[frozenset[str], bool]:
    """(licences named, whether some choice leaves the text free to use): or needs one free side, and needs both; an exception frees nothing."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _BINDS:
            (right, right_free), (left, left_free) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, left_free))
            else:
                if len(left) < len(right):
                    left, right = right, left
                left |= right
                stack.append((left, left_free or right_free if token == "or" else left_free and right_free))
        else:
            stack.append(({token}, any(token == x or token.startswith(f"{x}-") for x in OPEN)))
    return frozenset(stack[-1][0]), stack[-1][1]


class Scanner:
    def __init__(self, base: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICE_PHRASES):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, TAG}:
            # Bytes as Latin-1, to match the texts' layout; the last word's closing space is left out of the length.
            raw = f" {phrase} ".encode().decode("latin-1")
            self.automaton.add_word(raw, (len(raw), base.get(phrase), notices.get(phrase), phrase == TAG))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """(words, base places, first and last word of these, base labels, all labels, score).

        The score is 0 without a label, 1 if a label restricts use, 0.5 if all are free.
        """
        if not text:
            return 0, 0, None, None, "", "", 0.0
        words = text.encode("utf-8", "surrogatepass").translate(_KINDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        starts, base, labels, tagged, seen, at = [], set(), set(), False, 0, 0
        for end, (length, base_label, label, tag) in self.automaton.iter(line):
            begin = end - length + 1
            if base_label:
                # Matches come by their ends; the base phrases' starts need not follow that order.
                if begin >= at:
                    seen += line.count(" ", at, begin)
                    at = begin
                    starts.append(seen)
                else:
                    starts.append(seen - line.count(" ", begin, at))
                base.add(base_label)
            if label:
                labels.add(label)
            tagged |= tag
        free = all(x in OPEN for x in base | labels)
        if tagged:
            for m in _TAG_IN_TEXT.finditer(text):
                if (postfix := parse_expression(text, m.end())) is not None:
                    named, allowed = evaluate(postfix)
                    labels |= {f"spdx:{x}" for x in named}
                    free &= allowed
        every = base | labels
        score = 0.0 if not every else 0.5 if free else 1.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df, over whole texts; see Scanner.scan for the columns.

    A null text counts as empty: no words, no labels, null positions, score 0. Null ids stay null, repeated rows stay
    repeated, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for part in slices(batches, "text"):
            columns = zip(*[scanner.scan(t) for t in part.column("text").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), SCHEMA)
