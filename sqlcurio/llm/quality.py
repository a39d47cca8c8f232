"""Quality rules: base counts and zstandard compression bands over documents and fixed chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Band(NamedTuple):
    """Texts of at least ``least_bytes`` keep a ratio (raw / packed) within ``low`` and ``high``."""

    least_bytes: int
    low: float
    high: float


#: Longer texts pack better, so limits widen with length. Ordinary prose stays between about 1.4
#: (a few hundred bytes) and 3; text that repeats itself goes far above, random characters below.
BANDS = (Band(0, 0.0, float("inf")), Band(128, 0.85, 2.5), Band(512, 1.1, 3.5), Band(2048, 1.3, 4.5), Band(16384, 1.4, 6.0))
CHUNK = 4096
CHUNK_BAND = Band(CHUNK, 1.3, 8.0)
#: A document goes if more than this share of its bytes lies in chunks that are out of their band.
MOST_BAD = 0.5
SYMBOLS = "#*$%&|<>"


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def base_counts(text: str | None) -> Counts:
    if not text:
        return Counts(0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the blanks of the word pattern
    n, repeats = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            reach = 0
            for k, w in enumerate(windows):
                if w in often:
                    repeats += k + 3 - max(k, reach)
                    reach = k + 3
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(raw.count, map(str.encode, SYMBOLS)))
    return Counts(n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats)


class Packed(NamedTuple):
    ratio: float  # of the whole text
    n_chunks: int
    n_bad_chunks: int
    bad_bytes: int  # in chunks out of their band


def band_of(size: int) -> Band:
    return [b for b in BANDS if size >= b.least_bytes][-1]


def compression(raw: bytes, packer: zstandard.ZstdCompressor) -> Packed:
    """The whole text and each of its chunks; the last chunk, if shorter, has the limits of its own length."""
    if not raw:
        return Packed(0.0, 0, 0, 0)
    ratio, bad, bad_bytes = len(raw) / len(packer.compress(raw)), 0, 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        band = CHUNK_BAND if len(part) == CHUNK else band_of(len(part))
        own = ratio if len(part) == len(raw) else len(part) / len(packer.compress(part))
        if not band.low <= own <= band.high:
            bad += 1
            bad_bytes += len(part)
    return Packed(ratio, -(-len(raw) // CHUNK), bad, bad_bytes)


def in_band(size: int, packed: Packed) -> bool:
    band = band_of(size)
    return band.low <= packed.ratio <= band.high and packed.bad_bytes <= MOST_BAD * size


def quality(docs: DataFrame, level: int = 3) -> DataFrame:
    """Base counts, compression figures and verdict of every row of ``docs`` (doc_id, text).

    One pass without a shuffle; a task holds one Arrow batch, so one very long text at worst. Null,
    empty and blank texts have zero counts and ratio 0 (blank: its own) and fail the base rule. Texts
    and last chunks under 128 bytes have no ratio limits. Every byte is in a chunk: those of 4096
    bytes keep within CHUNK_BAND, a shorter last one within the band of its length.
    Repeated rows and other columns do no harm; no rows in, no rows out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *Counts._fields, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py()
                c = base_counts(text)
                raw = (text or "").encode("utf-8", "surrogatepass")
                packed = compression(raw, packer)
                failed = c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words
                rows.append((*c, failed, not failed and in_band(len(raw), packed), *packed[:3]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(cols, types, strict=True)]], names=names)

    counts = ", ".join(f"{c} long" for c in Counts._fields)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    )
