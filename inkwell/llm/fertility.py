"""Quality rules from tokeniser fertility (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import mix, prefix_hash, released, span_hash, text_blocks, word_hashes, word_spans

#: Where the public vocabularies lie; a place of this machine, so a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Scripts by ranges of code points; anything else with a letter is "other".
SCRIPTS = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
#: Per script, for a vocabulary of 32k pieces: least and most characters per token (runs of random letters and digits stay below
#: 1.6), most byte-fallback share, least token entropy as a share of log2(tokens).
BANDS = {
    "latin": (1.6, 9.0, 0.05, 0.25), "greek": (0.7, 6.0, 0.2, 0.35), "cyrillic": (0.7, 6.0, 0.2, 0.35), "hebrew": (0.5, 5.0, 0.3, 0.3), "arabic": (0.5, 5.0, 0.3, 0.3), "indic": (0.25, 4.0, 0.95, 0.25), "thai": (0.25, 4.0, 0.95, 0.25),
    "kana": (0.35, 3.0, 0.8, 0.3), "han": (0.35, 3.0, 0.85, 0.3), "hangul": (0.3, 3.0, 0.9, 0.3), "other": (0.2, 9.0, 1.0, 0.25), "none": (0.8, 9.0, 0.2, 0.35),
}
NAMES = (*dict.fromkeys(s for s, _, _ in SCRIPTS), "other", "none")
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"
_loaded: dict[str, tuple] = {}


def load_vocabulary(folder: str = TOKENIZERS) -> tuple:
    """(piece vocabulary, which of its pieces are single bytes of characters that it can't spell), once in each worker.

    Line breaks and other white space are bytes in any text, so they don't count."""
    if folder not in _loaded:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, "piece_bpe_32k.model")))
        _loaded[folder] = pieces, np.array([pieces.is_byte(i) and not 9 <= int(pieces.id_to_piece(i)[1:-1], 16) <= 13 for i in range(pieces.get_piece_size())])
    return _loaded[folder]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    rows = len(offs) - 1
    starts, ends, first = word_spans(data, offs)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    head = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": _sums(inside & head, offs), "n_symbols": _sums(_SYMBOL[data], offs), "n_dup_lines": np.zeros(rows, np.int64), "n_repeat_words": np.zeros(rows, np.int64), "n_chars": _sums(head, offs)}
    if not len(starts):
        return out
    # lines that hold a word, by the hash of the whole line
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offs, breaks, breaks + 1]))
    begin, end = edges[:-1], edges[1:]
    line = (end > begin) & (data[np.minimum(begin, len(data) - 1)] != 10)
    begin, end = begin[line], end[line]
    holds = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[holds], end[holds]
    row = np.searchsorted(offs, begin, side="right") - 1
    hashed = mix(span_hash(prefix_hash(data), begin, end)) ^ (end - begin).astype(np.uint64)
    key = mix(hashed + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[kept], minlength=rows)
    # words under 5-word windows that occur again
    words = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(rows), np.diff(first))
    if len(words) >= 5:
        at = np.flatnonzero(owner[:-4] == owner[4:])
        acc = owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(5):
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + k]
        acc = mix(acc)
        order = np.argsort(acc)
        same = acc[order][1:] == acc[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        cover[at[again]] += 1
        np.add.at(cover, at[again] + 5, -1)
        out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return out


_SCRIPT = np.full(0x110000, NAMES.index("other"), np.int8)
for _name, _lo, _hi in SCRIPTS:
    _SCRIPT[_lo : _hi + 1] = NAMES.index(_name)
_SCRIPT[:0x41] = _SCRIPT[0x5B:0x61] = _SCRIPT[0x7B:0xAA] = NAMES.index("none")
_SCRIPT[[0xAB, 0xAC, 0xAD, 0xAE, 0xAF, 0xB0, 0xB1, 0xB4, 0xB6, 0xB7, 0xBB, 0xD7, 0xF7]] = NAMES.index("none")
_SCRIPT[0x2000:0x2C00] = _SCRIPT[0x3000:0x3040] = NAMES.index("none")


def token_measures(text: str, pieces, single: np.ndarray) -> tuple[int, float, float, float, str]:
    """(tokens, characters per token, share of tokens that are byte fallbacks, entropy over log2(tokens), script) of a text."""
    if not text:
        return 0, 0.0, 0.0, 1.0, "none"
    ids = np.asarray(pieces.encode(text), np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = np.bincount(_SCRIPT[points], minlength=len(NAMES))
    letters = found[: NAMES.index("none")]
    script = NAMES[int(letters.argmax())] if letters.any() else "none"
    if not len(ids):
        return 0, 0.0, 0.0, 1.0, script
    _, counts = np.unique(ids, return_counts=True)
    p = counts / len(ids)
    entropy = float(-(p * np.log2(p)).sum() / np.log2(len(ids))) if len(ids) > 1 else 1.0
    return len(ids), len(points) / len(ids), float(single[ids].mean()), entropy, script


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Base counts and tokeniser measures of every row, over whole texts, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, single = load_vocabulary(folder)
        for batch in batches:
            for at, to, data, offs in text_blocks(batch.column(1)):
                base = base_counts(data, offs)
                texts = batch.column(1).slice(at, to - at).to_pylist()
                n, fertility, fallback, entropy, script = zip(*(token_measures(t or "", pieces, single) for t in texts), strict=True)
                longs = [pa.array(base[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *longs, pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (fertility, fallback, entropy)), pa.array(script, pa.string())], [f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run), RESULT).withColumnRenamed("doc_id", key)


def judge(measured: DataFrame, bands: dict[str, tuple[float, float, float, float]] = BANDS) -> DataFrame:
    """Adds base_failed, in_band and kept.

    ``bands`` gives each script its limits.  A text of a single token is judged by its base rules alone."""
    rule = F.create_map(*[x for s, b in bands.items() for x in (F.lit(s), F.array(*map(F.lit, b)))])[F.col("script")]
    within = (F.col("chars_per_token").between(rule[0], rule[1])) & (F.col("fallback_share") <= rule[2]) & (F.col("token_entropy") >= rule[3])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("in_band", (F.col("n_tokens") < 2) | within)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, bands: dict = BANDS) -> DataFrame:
    """Measures and verdict for every row.  Null and empty texts have no word, fail the base rule and are not kept; repeated rows
    have the same result; an empty table gives an empty result."""
    return judge(measure(docs, key, text, folder), bands)
