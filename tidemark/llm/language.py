"""Language identification by compression.

Each language gets a zstandard raw-content dictionary, made of a bounded number of its labelled texts as they are. A text is
encoded block by block with every dictionary; the language whose dictionary gives the smallest total wins. The score
is the margin to the runner-up; a text whose margin is too narrow is rejected. Texts and dictionaries are lower-cased
and lose the ASCII characters that are neither letters nor white space, which say nothing about the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices

#: Labelled documents that a language's dictionary is made of at most, each as a whole, and the bytes of one that is
#: preferred: longer ones are sampled only where a language has not as many that are shorter.
SAMPLE_DOCS = 200
SAMPLE_BYTES = 4_000
#: Languages that a model holds at most: dictionaries travel to every executor.
MAX_LANGUAGES = 500
#: A text is encoded in blocks of so many bytes, so that a long text's own repetitions don't drown the dictionary's part.
BLOCK_BYTES = 4_096
LEVEL = 6
#: Shortest match that the encoder takes: short ones tell languages apart where texts are short.
MIN_MATCH = 4
#: Spaces behind every block. They keep the encoder from storing a short block as it is, which costs the same in every language.
PADDING = 32
#: Margins below this are rejected.
MIN_SCORE = 0.003
UNKNOWN = "und"

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_DROP = bytes(c for c in range(0x21, 0x80) if not chr(c).isalpha())

SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


def learn_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """{language: dictionary}, from SAMPLE_DOCS different texts of each language, those whose hashes are least.

    Rows without text, language or id are ignored; equal texts count once; an empty table gives no dictionaries. The
    result's size is bounded by MAX_LANGUAGES and SAMPLE_DOCS texts, of SAMPLE_BYTES where there are enough of these.
    """
    named = labelled.filter(F.col(id_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    named = named.filter("l IS NOT NULL AND t IS NOT NULL").withColumn("short", F.octet_length("t") <= SAMPLE_BYTES)
    h = F.xxhash64("t")
    counts = named.groupBy("l").agg(F.approx_count_distinct(h).alias("all"), F.approx_count_distinct(F.when(F.col("short"), h)).alias("few"))
    counts = counts.limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Four times as many texts as are wanted pass by their hashes alone, so that no task ranks a whole language; copies
    # of a text pass together and collapse before the shuffle.
    spark = labelled.sparkSession
    shares = [(r["l"], only := r["few"] >= 2 * SAMPLE_DOCS, min(1.0, 4.0 * SAMPLE_DOCS / max(1, r["few"] if only else r["all"]))) for r in counts]
    known = spark.createDataFrame(shares, "l string, only boolean, share double")
    hashed = named.withColumn("u", F.shiftrightunsigned(h, 11) / F.lit(2.0**53))
    few = hashed.join(F.broadcast(known), "l").filter("u < share AND (short OR NOT only)").groupBy("l", "u", "t").agg(F.count("*").alias("n"))
    ranked = few.selectExpr("l", "u", "t", "row_number() OVER (PARTITION BY l ORDER BY u, t) AS n").filter(F.col("n") <= SAMPLE_DOCS)
    held: dict[str, list] = {}
    for r in ranked.toLocalIterator():
        held.setdefault(r["l"], []).append((r["u"], r["t"]))
    return {lang: b" ".join(letters(t) for _, t in sorted(texts)) for lang, texts in sorted(held.items())}


def letters(text: str) -> bytes:
    return text.lower().encode().translate(_FOLD, _DROP)


class Classifier:
    """Picks the language whose dictionary encodes a text in the fewest bytes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.languages = sorted(dictionaries)
        self.coders = []
        parameters = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        for lang in self.languages:
            # zstandard refuses dictionaries of under eight bytes; spaces say nothing.
            content = zstd.ZstdCompressionDict(dictionaries[lang].ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.coders.append(zstd.ZstdCompressor(compression_params=parameters, dict_data=content).compress)

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        blocks = [data[i : i + BLOCK_BYTES] + b" " * PADDING for i in range(0, len(data), BLOCK_BYTES)]
        return [sum([len(code(b)) for b in blocks]) for code in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin from 0 to 1); (und, 0) without text, letters or languages. Ties go to the first in order."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        return self.languages[best], 1.0 - sizes[best] / min(rest) if rest else 1.0


def classify(df: DataFrame, dictionaries: dict[str, bytes], min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted (score at least min_score, language known) for every row, over whole texts.

    Text that is null, empty or without a letter: und, score 0, not accepted. Null ids stay null, repeated rows stay
    repeated, other columns are ignored, an empty table gives an empty result.
    """
    model = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for part in slices(batches, "text"):
            found = [classifier.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                    pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), SCHEMA)


def keep_accepted(df: DataFrame, dictionaries: dict[str, bytes], min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of df that classify would accept, all columns as they are; nothing is shuffled.

    Rows whose text is null or has no letter go; null ids and repeated rows do not matter; an empty table stays empty.
    """
    model = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for part in slices(batches, text_col):
            found = [classifier.predict(t) for t in part.column(text_col).to_pylist()]
            yield part.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()))

    return df.mapInArrow(frugal(run), df.schema)


def held_out(id_col: str = "doc_id"):
    """Column: whether a document is kept from learning (crc32 of the id as text leaves 1 modulo 3); null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
