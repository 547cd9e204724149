"""Language identification by compression.

Each language has a raw-content dictionary of its frequent words. A text is compressed with every
dictionary in turn, and its language is the one whose dictionary leaves the fewest bytes. Where the
runner-up comes too close, the answer is marked as not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import text_slices, utf8

#: Bytes of a text that are compressed at a time, each block by itself, so that every one leans on the dictionary.
BLOCK = 8192
LEVEL = 6
#: Words longer than so many bytes are learned in pieces of so many characters (scripts without spaces).
WORD, PIECE = 48, 8
#: Bytes of all dictionaries together.
ALL_BYTES = 1 << 25
UNKNOWN = "und"

# letters of ASCII in lower case, all else of ASCII as space; what is beyond ASCII stays
_CLEAN = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_SPACES = re.compile(rb" +")


def cleaned(raw: bytes) -> bytes:
    return _SPACES.sub(b" ", raw.translate(_CLEAN))


def words_of(raw: bytes) -> set[str]:
    """Distinct words of a text, long ones in pieces."""
    found = {w for w in raw.translate(_CLEAN).split(b" ") if w}
    out = {w.decode() for w in found if len(w) <= WORD}
    for word in found:
        if len(word) > WORD:
            text = word.decode()
            out.update(text[n : n + PIECE] for n in range(0, len(text), PIECE))
    return out


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 when divided by four. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    """Languages, those of most documents first, and the dictionary of each."""

    languages: list[str]
    dictionaries: list[bytes]


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 400, dictionary_bytes: int = 1 << 16) -> LanguageModel:
    """A dictionary for every language of documents that are not held out and have an id, a text and a language.

    It holds the words that most of ``train_docs`` of its documents have (those whose ids hash lowest; a documented bound of the fit),
    the most frequent ones last, in ``dictionary_bytes`` at most, and less where there are so many languages that all
    dictionaries together would exceed ``ALL_BYTES``. Languages are ordered by the number of all their documents, then
    by name, which settles ties of sizes. Rows that repeat an id are chosen together and count each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return LanguageModel([], [])
    most = min(dictionary_bytes, ALL_BYTES // len(languages))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("lang", "id").distinct().withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= train_docs).select("lang", "id")
    chosen = rows.join(F.broadcast(ids), ["lang", "id"])  # train_docs ids of each language

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            raw, bounds = utf8(batch["text"])
            for n, lang in enumerate(batch["lang"].to_pylist()):
                found = sorted(words_of(raw[bounds[n] : bounds[n + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], names=["lang", "word"])

    counted = chosen.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").count()
    by_count = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    upto = F.sum(F.octet_length("word") + 1).over(by_count.rowsBetween(Window.unboundedPreceding, 0))
    frequent = counted.withColumn("upto", upto).where(F.col("upto") < most).collect()
    words: dict[str, list[tuple[int, str]]] = {lang: [] for lang in languages}
    for r in frequent:
        words[r["lang"]].append((r["upto"], r["word"]))
    return LanguageModel(languages, [b" " + " ".join(w for _, w in sorted(words[lang], reverse=True)).encode() + b" " for lang in languages])


def compressors(model: LanguageModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.dictionaries:
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        # fewer than eight bytes are no dictionary
        given = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(dict_data=given, compression_params=settings))
    return out


def compressed_sizes(raw: memoryview | bytes, with_each: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes that are left of a whole text with each dictionary."""
    out = [0] * len(with_each)
    for at in range(0, len(raw), BLOCK):
        block = cleaned(bytes(raw[at : at + BLOCK]))
        for n, c in enumerate(with_each):
            out[n] += len(c.compress(block))
    return out


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least_margin: int = 2) -> DataFrame:
    """``id_col``, held_out, lang_pred, score, margin and accepted of every row.

    lang_pred is the language whose dictionary leaves the fewest bytes of the whole text; equal sizes go to the language of
    more documents. margin is by how many bytes the runner-up is larger, score is ``1 - 2 ** -margin``, and accepted
    says that the margin is ``least_margin`` or more. Where there is only one language, its margin is what it saves of the text.
    A text that is null or has no letter, and every text where no language was learned, is ``und`` with score 0, no margin and
    not accepted. held_out is false for a null id. Rows that repeat are answered alike; an empty table gives no rows.
    Other columns are not read: languages, sources and ids are no inputs.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_each = compressors(model)
        for batch in text_slices(batches, "text"):
            letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_pylist()
            raw, bounds = utf8(batch["text"])
            view = memoryview(raw)
            found, scores, margins = [], [], []
            for n, has in enumerate(letters):
                if not has or not with_each:
                    found.append(UNKNOWN), scores.append(0.0), margins.append(None)
                    continue
                sizes = compressed_sizes(view[bounds[n] : bounds[n + 1]], with_each)
                order = np.argsort(sizes, kind="stable")
                best = sizes[order[0]]
                margin = (sizes[order[1]] if len(sizes) > 1 else max(best, int(bounds[n + 1] - bounds[n]))) - best
                found.append(model.languages[order[0]]), scores.append(1 - 2.0**-margin), margins.append(margin)
            columns = [batch["id"], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(identify, f"id {kind}, lang_pred string, score double, margin long")
    accepted = F.coalesce(F.col("margin") >= least_margin, F.lit(False))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "margin", accepted.alias("accepted"))
