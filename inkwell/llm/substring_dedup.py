"""Removal of repeated byte strings by a hash-compared suffix sort (operator 2)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import by_bucket, cut, ensure_checkpoints, likely_in, mix, pack, packed_schema, partitions, powers, prefix_hash, released, skew_join, span_hash, text_blocks, unpack, without

LENGTH, GRAM = 100, 40
#: Occurrences of one anchor that are sorted together; more are dealt into groups first.
GROUP = 5_000
#: Bytes of a bucket that are sorted at a time.
CHUNK_BYTES = 1_000_000
#: Bytes of text that anchors are looked for in at a time.
TEXT_BYTES = 500_000
_INDEX_BITS = 24


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have, out = 1, key
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first start, last start, place of the anchor) of all anchors.

    The strings of ``length`` bytes are named by their starts.  Each has as anchor the leftmost of its ``gram``-byte strings of
    least hash, which depends on nothing but its own bytes; so equal strings have equal anchors at equal places, and all starts
    of one anchor are a run.  The index rides in the low bits of the compared values; a text too long for them is taken in parts."""
    empty = np.zeros(0, np.int64)
    parts = []
    limit = (1 << _INDEX_BITS) - 2 * length
    if len(data) > limit:
        for r in range(len(offs) - 1):
            for s in range(int(offs[r]), int(offs[r + 1]), limit - length + 1):
                end = min(s + limit, int(offs[r + 1]))
                _, h, lo, hi, a = anchors(data[s:end], np.array([0, end - s]), length, gram)
                parts.append((np.full(len(h), r), h, lo + s, hi + s, a + s))
        return tuple(np.concatenate([p[k] for p in parts]) if parts else empty for k in range(5))
    n = len(data)
    if n < length:
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    prefix = prefix_hash(data)
    h = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1, inverse=True)[: n + 1 - gram])
    key = (h & ~np.uint64((1 << _INDEX_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    place = (_least_in_windows(key, length - gram + 1) & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(place)]
    good = np.arange(len(place)) + length <= offs[row + 1]
    starts = np.flatnonzero(good)
    if not len(starts):
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    a = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[starts[first]], h[a[first]], starts[first], starts[last], a[first]


class Strings:
    """Byte strings in one buffer, with polynomial hashes of all their prefixes; compared from any offset by hash."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.data, self.begin, self.size = data, begin, size
        longest = int(size.max()) if len(size) else 0
        local = np.arange(len(data)) - np.repeat(begin, size)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(longest + 1)[local], out=self.prefix[1:])
        self.inverse = powers(longest + 1, inverse=True)

    def take(self, which: np.ndarray, offset: np.ndarray, size: np.ndarray) -> Suffixes:
        return Suffixes(self, self.begin[which] + offset, offset, size)


class Suffixes:
    """Suffixes of strings, each cut to a size."""

    def __init__(self, strings: Strings, at: np.ndarray, offset: np.ndarray, size: np.ndarray):
        self.of, self.at, self.offset, self.size = strings, at, offset, size

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes i and j: binary search over prefix hashes."""
        prefix, inverse = self.of.prefix, self.of.inverse
        ai, aj, oi, oj = self.at[i], self.at[j], inverse[self.offset[i]], inverse[self.offset[j]]
        pi, pj = prefix[ai], prefix[aj]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (prefix[ai + mid] - pi) * oi == (prefix[aj + mid] - pj) * oj
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; equal ones stand in order of their numbers."""
        n = self.common(i, j)
        ended_i, ended_j = n == self.size[i], n == self.size[j]
        last = len(self.of.data) - 1
        byte_i, byte_j = self.of.data[np.minimum(self.at[i] + n, last)], self.of.data[np.minimum(self.at[j] + n, last)]
        return np.where(ended_i & ended_j, i < j, np.where(ended_i, True, np.where(ended_j, False, byte_i < byte_j)))

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether two suffixes are the same: by hash, then verified byte by byte against collisions."""
        same = (self.size[i] == self.size[j]) & (self.common(i, j) == self.size[i])
        for k in np.array_split(np.flatnonzero(same), max(1, len(i) // 20_000)):
            if len(k):
                width = int(self.size[i[k]].max())
                step, last = np.arange(width), len(self.of.data) - 1
                inside = step < self.size[i[k]][:, None]
                a, b = (self.of.data[np.minimum(self.at[x[k]][:, None] + step, last)] for x in (i, j))
                same[k] = ((a == b) | ~inside).all(axis=1)
        return same


def merge_sort(group: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """Numbers of the suffixes, sorted within groups; ``group`` is sorted.

    Bottom-up mergesort of all groups side by side: each suffix finds its place in the sibling run by binary search, with
    suffixes compared by hash, so a comparison takes logarithmic time."""
    n = len(group)
    order = np.arange(n)
    if not n:
        return order
    cut_at = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    begin, end = np.repeat(cut_at[:-1], np.diff(cut_at)), np.repeat(cut_at[1:], np.diff(cut_at))
    width, longest = 1, int(np.diff(cut_at).max())
    while width < longest:
        at = np.flatnonzero(end - begin > width)
        b, e, inside = begin[at], end[at], at - begin[at]
        run = inside // width
        left = run % 2 == 0
        pair = b + (run // 2) * 2 * width
        lo = np.minimum(np.where(left, pair + width, pair), e)
        hi = np.minimum(np.where(left, pair + 2 * width, pair + width), e)
        base, own = lo.copy(), order[at]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            before = suffixes.less(order[mid], own[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        placed = order.copy()
        placed[pair + (inside % width) + (lo - base)] = own
        order = placed
        width *= 2
    return order


def _heads(group: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """For every suffix the number of the first of its group that is equal to it (numbers are in order of place)."""
    order = merge_sort(group, suffixes)
    head = np.arange(len(group))
    if len(order) > 1:
        same = np.zeros(len(order), dtype=bool)
        near = np.flatnonzero(group[order[1:]] == group[order[:-1]])
        same[near + 1] = suffixes.equal(order[near], order[near + 1])
        run = np.flatnonzero(~same)
        head[order] = np.repeat(order[run], np.diff(np.append(run, len(order))))
    return head


def sort_bucket(columns: dict[str, np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sorts one bucket of occurrences.

    Takes key (an anchor's hash), part, doc, lo (first start), starts, shift (the anchor's place) and the bytes of each
    occurrence's strings together.  Returns (doc, start, end) of what repeats an earlier occurrence, and, for keys dealt into
    parts, (number of the occurrence, start) of strings that are the first of their part."""
    n = len(columns["key"])
    size = columns["starts"].astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    group = mix(columns["key"] + columns["part"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((columns["lo"], columns["doc"], group))
    strings = Strings(columns["bytes"], begin, size)
    # whole contexts: an occurrence equal to an earlier one repeats it throughout
    head = _heads(group[order], strings.take(order, np.zeros(n, np.int64), size[order]))
    first = head == np.arange(n)
    doc, lo, starts = (columns[c][order].astype(np.int64) for c in ("doc", "lo", "starts"))
    gone = [(doc[~first], lo[~first], lo[~first] + starts[~first] + length - 1)]
    # what differs somewhere: string by string, at equal places about the anchor
    kept = np.flatnonzero(first)
    _, inverse, counts = np.unique(group[order][kept], return_inverse=True, return_counts=True)
    dealt = columns["part"][order][kept] > 0
    kept = kept[(counts[inverse] > 1) | dealt]
    who = np.repeat(kept, starts[kept])
    offset = np.arange(len(who)) - np.repeat(np.cumsum(starts[kept]) - starts[kept], starts[kept])
    fine = mix(group[order][who] + (columns["shift"][order][who].astype(np.int64) - offset).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.lexsort((lo[who] + offset, doc[who], fine))
    who, offset, fine = who[again], offset[again], fine[again]
    head = _heads(fine, strings.take(order[who], offset, np.full(len(who), length, np.int64)))
    own = head == np.arange(len(who))
    gone.append((doc[who[~own]], lo[who[~own]] + offset[~own], lo[who[~own]] + offset[~own] + length))
    left = np.flatnonzero(own & (columns["part"][order][who] > 0))
    return (*(np.concatenate(x) for x in zip(*gone, strict=True)), np.stack([order[who[left]], offset[left]], axis=1))


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _spans_by_doc(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    which, first = np.unique(doc, return_index=True)
    raw = [np.stack(_merge(start[a:b], end[a:b])).astype(np.int64).tobytes() for a, b in zip(first, np.append(first[1:], len(doc)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(raw, pa.binary()), pa.nulls(len(which), pa.int32()), pa.nulls(len(which), pa.int32()), *[pa.nulls(len(which), pa.binary())] * len(_FIELDS)], ["doc", "spans", "bucket", "n", *_FIELDS])


_FIELDS = {"key": np.uint64, "part": np.int32, "doc": np.int64, "lo": np.int64, "starts": np.uint8, "shift": np.uint8, "bytes": np.uint8}


def _chunks(columns: dict[str, np.ndarray], length: int, most: int = CHUNK_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """A bucket in parts of about ``most`` bytes, a key's occurrences together: what is sorted at a time is bounded."""
    count = -(-len(columns["bytes"]) // most)
    if count <= 1:
        yield columns
        return
    size = columns["starts"].astype(np.int64) + length - 1
    begin, part = np.cumsum(size) - size, mix(columns["key"] + np.uint64(0x5D588B65)) % np.uint64(count)
    for k in range(count):
        own = np.flatnonzero(part == k)
        if len(own):
            at = np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
            yield {c: columns["bytes"][at] if c == "bytes" else v[own] for c, v in columns.items()}


def _pack_strings(buckets: int, key, part, doc, lo, starts, shift, data, begin, length: int) -> pa.RecordBatch:
    """Occurrences with their bytes, dealt into buckets by key."""
    size = starts.astype(np.int64) + length - 1
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = pack(key, buckets, key=key, part=part.astype(np.int32), doc=doc, lo=lo, starts=starts.astype(np.uint8), shift=shift.astype(np.uint8))
    ends = np.cumsum(out.column("n").to_numpy().astype(np.int64))
    raw = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        own = order[a:b]
        at = np.repeat(begin[own], size[own]) + np.arange(int(size[own].sum())) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        raw.append(data[at].tobytes())
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(raw, pa.binary())], [*out.schema.names, "bytes"])


def _sort(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows (doc, spans, ...) of removed spans, and rows (bucket, ...) of strings for a further round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in (part for _, whole in unpack(batches, **_FIELDS) for part in _chunks(whole, length)):
            doc, start, end, left = sort_bucket(columns, length)
            if len(doc):
                yield _spans_by_doc(doc, start, end)
            if len(left):
                who, offset = left[:, 0], left[:, 1]
                size = columns["starts"].astype(np.int64) + length - 1
                begin = (np.cumsum(size) - size)[who] + offset
                prefix = prefix_hash(columns["bytes"])
                key, ones = mix(span_hash(prefix, begin, begin + length)), np.ones(len(who), np.int64)
                more = _pack_strings(buckets, key, np.zeros(len(who), np.int32), columns["doc"][who], columns["lo"][who] + offset, ones, 0 * ones, columns["bytes"], begin, length)
                yield pa.RecordBatch.from_arrays([pa.nulls(more.num_rows, pa.int64()), pa.nulls(more.num_rows, pa.binary()), *more.columns], ["doc", "spans", "bucket", "n", *_FIELDS])

    schema = "doc long, spans binary, bucket int, n int, " + ", ".join(f"{c}_ binary" for c in _FIELDS)
    renamed = lambda batches: (b.rename_columns(["doc", "spans", "bucket", "n", *(f"{c}_" for c in _FIELDS)]) for b in run(batches))
    return by_bucket(packed).mapInArrow(released(renamed), schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, spans) of the distinct documents in ``docs`` (doc, text): start and end of every run to remove, as packed integers.

    Only strings whose anchor occurs again anywhere can repeat.  A first pass ships half hashes of anchors alone and finds those; a
    second one ships the bytes about them, an anchor's occurrences to one bucket, where the suffix sort decides.  An anchor of
    more than GROUP occurrences is dealt into parts: each part drops what it has twice, and the first strings of all parts
    meet again under a hash of their own, so no task gets a large group whole."""
    spark = docs.sparkSession
    buckets = partitions(spark)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [(ids[at + row], h) for at, _, data, offs in text_blocks(batch.column(1), TEXT_BYTES) for row, h, *_ in [anchors(data, offs, length)]]
            if found:
                doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pack(h, buckets, h=_short(h), doc=doc)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in unpack(batches, h=np.uint32, doc=np.int64):
            order = np.argsort(c["h"])
            h = c["h"][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts = np.repeat(*[np.diff(np.append(first, len(h)))] * 2)
            many = counts > 1
            if not many.any():
                continue
            doc, h, counts = c["doc"][order][many], h[many], counts[many]
            order = np.lexsort((h, doc))
            doc, h, counts = doc[order], h[order], counts[order]
            which, begin = np.unique(doc, return_index=True)
            ends = np.append(begin[1:], len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([h[a:b].tobytes() + np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32).tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())], ["doc", "again"])

    counted = by_bucket(docs.select("doc", "text").mapInArrow(released(hashes), packed_schema("h", "doc"))).mapInArrow(released(again), "doc long, again binary")
    place = f"{ensure_checkpoints(spark)}/anchors-{uuid.uuid4().hex}"
    counted.write.parquet(place)
    counted = spark.read.parquet(place)
    wanted = counted.groupBy("doc").agg(F.collect_list("again").alias("again"))
    texts = docs.where(likely_in(counted.select(F.col("doc").alias("id")), F.col("doc"))).join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", "again")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, again_ = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for at, to, data, offs in text_blocks(batch.column(1), TEXT_BYTES):
                row, h, lo, hi, place = anchors(data, offs, length)
                split = np.searchsorted(row, np.arange(to - at + 1))
                keep, counts = [], []
                for r in range(to - at):
                    raw = [(np.frombuffer(x, np.uint32, len(x) // 8), np.frombuffer(x, np.uint32, len(x) // 8, len(x) // 2)) for x in again_[at + r]]
                    known, often = (np.concatenate(x) for x in zip(*raw, strict=True))
                    order = np.argsort(known)
                    known, often = known[order], often[order]
                    own = _short(h[split[r] : split[r + 1]])
                    place_in = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[place_in] == own
                    keep.append(np.flatnonzero(hit) + split[r])
                    counts.append(often[place_in[hit]])
                keep, counts = np.concatenate(keep), np.concatenate(counts)
                if len(keep):
                    doc, start = ids[at + row[keep]], lo[keep]
                    parts = -(-counts.astype(np.int64) // GROUP)
                    part = np.where(parts > 1, 1 + (mix(doc.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
                    yield _pack_strings(buckets, _salted(h[keep], part), part, doc, start - offs[row[keep]], hi[keep] - start + 1, place[keep] - start, data, start, length)

    found = cut(_sort(texts.mapInArrow(released(contexts), packed_schema(*_FIELDS)), length, buckets))
    spans = found.where("spans is not null").select("doc", "spans")
    more = found.where("spans is null").select("bucket", "n", *[F.col(f"{c}_").alias(c) for c in _FIELDS])
    if not more.isEmpty():
        spans = spans.unionByName(_sort(more, length, buckets).where("spans is not null").select("doc", "spans"))
    return spans


def _short(h: np.ndarray) -> np.ndarray:
    """Half of an anchor's hash, enough to look for anchors that may occur again; the suffix sort sees the whole."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _salted(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.where(part > 0, mix(h + part.astype(np.uint64)), h)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for every row: each byte of a ``length``-byte string that
    also starts earlier (a smaller key, or the same document) is removed; ``kept`` is what is left, as bytes.

    Strings are judged on the input.  Texts are UTF-8 bytes, null is empty, and matches never cross documents.  A text equal to
    an earlier one, of ``length`` bytes or more, repeats it throughout and needs no sorting.  Keys should be unique and not
    null: a row with a null key is returned whole, and rows with one key count as copies of one document, each returned with
    the spans of that key.  Texts of any length are taken whole, long ones in parts that share a seam; other columns are not looked
    at.  An empty table gives an empty result."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = rows.where((F.octet_length("text") >= length) & F.col("doc").isNotNull()).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    firsts = long.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("w"))
    repeated = cut(firsts.where("w > 1"))
    copies = cut(skew_join(long.select("doc", "digest"), repeated, "digest", "w").where("doc <> first").select("doc").distinct())
    singles = without(long.select("doc", "text"), copies.select(F.col("doc").alias("id")), "doc")
    spans = repeated_spans(singles, length).groupBy("doc").agg(F.collect_list("spans").alias("spans"))
    facts = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc", F.array().cast("array<binary>").alias("spans"), F.lit(True).alias("copy")))
    facts = cut(facts)
    maybe = likely_in(facts.select(F.col("doc").alias("id")), F.col("doc"))
    joined = rows.where(maybe).join(facts.hint("shuffle_hash"), "doc", "left").select("doc", "text", "spans", "copy")
    joined = joined.unionByName(rows.where(~maybe).select("doc", "text", F.lit(None).cast("array<binary>").alias("spans"), F.lit(None).cast("boolean").alias("copy")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for value, raw, copy in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                start, end = (np.zeros(1, np.int64), np.array([len(data)])) if copy else _merge(*(np.concatenate(x) for x in zip(*(np.frombuffer(s, np.int64).reshape(2, -1) for s in raw or [np.zeros(0, np.int64).tobytes()]), strict=True)))
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(data[at:s])
                    at = e
                left = b"".join([*kept, data[at:]])
                for c, v in zip(out, (len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest(), [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)], left), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc", *out])

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(released(finish), schema).withColumnRenamed("doc", key)
