"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

1. The distinct pre-tokens of all texts are gathered with how often they occur, each with its number of pieces, as a
   table in the shared folder.
2. Documents become pre-token frequencies. The most frequent pre-tokens (a bounded number) are joined to them inside the
   tasks, so that these never travel; the others, none of which is frequent, by a shuffle on the pre-token.
3. Pieces times frequencies are summed per document. No list of ids is ever built.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices, written
from tidemark.llm.pretokens import BARE_WORDS, all_plain

#: Pre-tokens whose pieces are sent to every task at most; rarer ones are joined by a shuffle.
BROADCAST_WORDS = 200_000
#: Distinct pre-tokens that a task gathers before it hands them on, and the longest one that is sent to every task.
HELD_WORDS = 200_000
MAX_SENT = 64
#: Bytes of a vocabulary file that are sent to the executors at most.
MAX_FILE_BYTES = 64_000_000

#: The normalizer and pre-tokenizer of a file whose splitting BARE_WORDS repeats.
_KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PreTokens:
    """Splits texts into pre-tokens and counts their pieces as the library does with add_special_tokens=False and its
    default handling of special strings. ValueError for a vocabulary whose tokens do not depend on pre-tokens alone."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        split = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        added = parsed.get("added_tokens") or []
        if parsed["model"]["type"] != "BPE" or parsed["model"].get("dropout") is not None:
            raise ValueError("only BPE vocabularies without dropout can be counted by pre-tokens")
        if any(not a["special"] or a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that are not special, or take in what is beside them, can't be counted by pre-tokens")
        self.fast = (
            (parsed.get("normalizer") or {}).get("normalizers") == _KNOWN_NORMALIZER
            and split[0].get("pattern") == {"Regex": _KNOWN_SPLIT}
            and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
        )
        self.names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.names))) if self.names else None
        self.letters = byte_letters()

    def pieces(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize(word))

    def _mapped(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def _count(self, text: str) -> dict[str, int]:
        if self.fast and all_plain(text):
            found = Counter(BARE_WORDS.findall(unicodedata.normalize("NFC", text).lower()))
            return found if text.isascii() and text.isprintable() else {self._mapped(w): n for w, n in found.items()}
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return Counter([w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer is not None else [text])

    def count(self, text: str) -> tuple[int, dict[str, int]]:
        """(special strings in the text, how often each pre-token occurs beside them)."""
        if not any(name in text for name in self.names):
            return 0, self._count(text)
        out: Counter[str] = Counter()
        for part in self.special.split(text):
            out.update(self._count(part))
        return len(self.special.findall(text)), out


def distinct_words(docs: DataFrame, definition) -> tuple[DataFrame, str]:
    """word, times, pieces: every distinct pre-token of the texts once, and the folder that holds them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = PreTokens(definition.value), Counter()
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    held.update(split.count(text)[1])
            if len(held) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "times"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(definition.value)
        for part in slices(batches, "word"):
            pieces = pa.array([split.pieces(w) for w in part.column("word").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("times"), pieces], names=["word", "times", "pieces"])

    words = docs.mapInArrow(frugal(gather), "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return written(words.mapInArrow(frugal(count), "word string, times long, pieces int"), "words")


def _rare_below(words: DataFrame) -> int:
    """The least power of two that at most BROADCAST_WORDS pre-tokens occur as often as."""
    sizes = words.groupBy(F.floor(F.log2("times")).cast("int").alias("p")).count().collect()
    power = max((r["p"] for r in sizes), default=0) + 1
    left = BROADCAST_WORDS
    for r in sorted(sizes, key=lambda r: -r["p"]):
        left -= r["count"]
        if left < 0:
            break
        power = r["p"]
    return 2**power


def count_tokens(df: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of df, over whole texts.

    A null or empty text counts no bytes and no tokens; a null id stays null; repeated rows stay repeated; other
    columns of df are ignored, whatever their names; an empty table gives an empty result.
    tokenizer_file is a .json file of the tokenizers library; see PreTokens for those that are refused.
    """
    path = Path(tokenizer_file)
    if path.suffix != ".json":
        raise ValueError(f"{tokenizer_file}: only .json vocabularies have pre-tokens to count")
    if path.stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{tokenizer_file} is larger than {MAX_FILE_BYTES} bytes")
    PreTokens(path.read_text(encoding="utf-8"))
    spark = df.sparkSession
    definition = spark.sparkContext.broadcast(path.read_text(encoding="utf-8"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, _ = distinct_words(docs, definition)
    frequent = (F.col("times") >= _rare_below(words)) & (F.length("word") <= MAX_SENT)
    sent = spark.sparkContext.broadcast({r["word"]: r["pieces"] for r in words.filter(frequent).select("word", "pieces").toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = PreTokens(definition.value), sent.value
        for part in slices(batches, "text"):
            sums: list[int] = []
            rest: list[list[dict]] = []
            for text in part.column("text").to_pylist():
                total, found = split.count(text) if text else (0, {})
                other = []
                for word, times in found.items():
                    n = known.get(word)
                    if n is None:
                        other.append({"word": word, "times": times})
                    else:
                        total += n * times
                sums.append(total)
                rest.append(other)
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), sizes, pa.array(sums, pa.int64()), pa.array(rest, kind)], names=["doc_id", "n_bytes", "known", "rest"]
            )

    counted = docs.mapInArrow(frugal(run), "doc_id long, n_bytes long, known long, rest array<struct<word string, times long>>")
    # Rows are told apart by a number of their own, as ids may repeat; the table fixes it.
    counted, _ = written(counted.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = counted.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    sums = rare.join(words.filter(~frequent).select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    out = counted.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
