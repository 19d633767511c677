"""Language identification by compression: each language has a zstandard raw-content dictionary of its own training text, and a text's
language is the one whose dictionary makes it smallest.

The whole text, lowered and with one space for whatever is no letter, is compressed with each dictionary in pieces of PIECE bytes, so that
the dictionary counts alike in texts of every length; the sizes are added. Sizes are whole bytes, so less than one byte is taken off for the
share of the text's 4-grams that stand in the dictionary: that orders equal sizes and no others. A decision is accepted if the runner-up needs
more bytes by a margin, in proportion to the text; a text without a letter is `und` and never accepted.

Nulls: a null or empty text is `und`, score 0. Rows are judged one by one, so repeated rows get equal results. Without training text
every text is `und`. Null ids are kept; rows without a language aren't learned from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import pieces

#: Bytes of raw content for each language, characters of a training text at most, and the number of training texts that are drawn for each
#: language (by a hash of the id, all being alike likely): the bounds of the training sample.
DICT_BYTES = 96 << 10
TRAIN_CHARS = 20_000
TRAIN_DOCS = 300
#: Languages that are learned at most, those with most rows first: a bound on the classifier, as each has a dictionary on every worker.
LANGUAGES = 200
LEVEL, PIECE = 6, 16 << 10
GRAM_BITS = 18
#: A decision is accepted if the runner-up takes this share more bytes.
MARGIN = 0.002

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def grams(data: bytes) -> np.ndarray:
    """A hash of GRAM_BITS bits of each 4 bytes in a row."""
    b = np.frombuffer(data.ljust(4), dtype=np.uint8).astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return code * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame | None:
    """lang, i, t: about `per_lang` texts of each language, drawn by a hash of the id; None if no row has a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & (F.length(text_col) <= TRAIN_CHARS))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))


def content(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Raw content: distinct lines, as many as fit."""
    kept, total = [], 0
    for line in dict.fromkeys(letters(x) for t in texts for x in t.split("\n")):
        data = line + b" "
        if total + len(data) <= size:
            kept.append(data)
            total += len(data)
    return b"".join(kept)


def dictionaries(sample: DataFrame | None, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content of each language, made where its texts are: per_lang * TRAIN_CHARS characters or so are one group."""
    if sample is None:
        return {}

    def made(own: pa.Table) -> pa.Table:
        rows = sorted(zip(own["i"].to_pylist(), own["t"].to_pylist(), strict=True), key=lambda r: (len(r[0]), *r))
        return pa.table({"lang": own["lang"].slice(0, 1).cast(pa.string()), "data": pa.array([content([t for _, t in rows], size)], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(made, "lang string, data binary").collect()
    return {r["lang"]: bytes(r["data"]) for r in found if r["data"]}


class Judge:
    def __init__(self, dicts: tuple[tuple[str, bytes], ...], margin: float = MARGIN):
        self.langs = [k for k, _ in dicts]
        self.margin = margin
        self.grams, self.by_lang = [], []
        for _, data in dicts:
            own = np.zeros(1 << GRAM_BITS, dtype=bool)
            own[grams(data)] = True
            self.grams.append(own)
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.by_lang.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        sizes, shared, n = np.zeros(len(self.langs)), np.zeros(len(self.langs)), 1
        for s in range(0, len(data), PIECE):
            piece = data[s : s + PIECE]
            sizes += [len(c.compress(piece)) for c in self.by_lang]
            own = grams(piece)
            shared += [np.count_nonzero(g[own]) for g in self.grams]
            n += len(own)
        return sizes - shared / n

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the probability that the sizes give the language), accepted."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(letters(text))
        order = np.argsort(sizes, kind="stable")
        best = order[0]
        if len(sizes) == 1:
            return self.langs[best], 1.0, True
        gap = sizes[order[1]] - sizes[best]
        p = np.exp(-(sizes - sizes[best]) / (1 + 0.01 * sizes[best]))
        return self.langs[best], float(p[best] / p.sum()), bool(gap >= self.margin * sizes[best])


@cache
def _judge(dicts: tuple[tuple[str, bytes], ...], margin: float) -> Judge:
    return Judge(dicts, margin)


def judged(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with lang_pred, score and accepted as further columns; a column of docs with such a name is replaced."""
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dicts.items())))  # LANGUAGES * DICT_BYTES at most
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(held.value, margin)
        for batch in batches:
            for part in pieces(batch, text_col):
                cols = list(zip(*[judge.judge(t.as_py()) for t in part.column(text_col)], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*part.schema.names, *names])

    extra = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def held_out(id_col: str = "doc_id"):
    """True for rows that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from the rows of docs that aren't held out."""
    return dictionaries(sampled(docs.where(~held_out(id_col)), id_col, text_col, lang_col, TRAIN_DOCS))
