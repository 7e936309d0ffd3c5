"""Removal of repeated byte strings with a logarithmic family of indexes of sampled suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same
document or another; matches do not cross documents and are judged on the input.

1. Suffixes are sampled by content. The anchor of a window of ``length`` bytes is the substring of 32 bytes
   with the least hash in it (the first of equals). Equal windows have equal anchors at equal places, so
   windows are only ever compared with windows of the same anchor. Neighbouring windows with one anchor
   are a run.
2. Documents come in batches. Each batch gets an index of its anchors, by their hash with the number of their
   runs and bytes. It is joined with all levels that exist, which tells the anchors that occur
   again, and becomes a level itself; two levels of equal size class merge into one of the next. Levels are
   tables in the shared folder, so another batch can be added to them at any later time.
3. The bytes around the runs of these anchors are dealt by anchor. There the suffixes from the anchors on are put in
   a suffix array, in order of their bytes, and the reversed prefixes before the anchors likewise, each with its
   longest common prefixes. Two windows are equal if and only if they lie at the same distance from the
   anchor and their suffixes and prefixes have these depths in common: bytes decide, not fingerprints.

A passage that a third of all documents share meets its likes early: of equal runs in one batch of a task one goes on,
marked as repeated. An anchor whose runs still may exceed ``part_bytes`` is dealt by window instead of by run, by
the digest of the window, so that no anchor has to fit into a task.

Texts that occur in several rows are repeated throughout, and take part once. Null counts as empty. Texts
shorter than ``length`` lose nothing. Repeated rows repeat each other. Ids may be null or repeated: rows
are told apart by text. Very long texts are read in pieces that overlap. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.bytetext import bytes_of, chunks, hash_of, prefix_hash
from strandline.plans.runtime import cut, discard

GRAM = 32
#: Texts are read by this many bytes at once; places of windows in a piece have 24 bits.
PIECE = 1 << 19
PLACE_BITS = np.uint64(24)
RUN = "array<struct<key:bigint,lo:int,hi:int,at:int>>"
CONTEXT = "grp bigint, text_key binary, lo int, at int, hi int, bytes binary, sure boolean"
_RUN = pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor key, first, last, anchor place) of each run of windows with one anchor; places count in the document."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    h = hash_of(prefix, at, at + GRAM)
    least = sliding_min((h >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64), length - GRAM + 1)
    place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[: len(place)] == doc[length - 1 : length - 1 + len(place)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    hi = np.flatnonzero(last)
    d, p = doc[lo], place[lo]
    return d, h[p].view(np.int64), lo - offsets[d], hi - offsets[d], p - offsets[d]


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, bytes, offsets) of a slice of texts, or of overlapping pieces of the one text that is longer than a piece."""
    if len(offsets) != 2 or len(data) <= PIECE + length:
        yield 0, data, offsets
        return
    for start in range(0, len(data) - length + 1, PIECE):
        part = data[start : start + PIECE + length - 1]
        yield start, part, np.array([0, len(part)])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=PIECE):
                data, offsets = bytes_of(part.column("text"))
                found = []
                for shift, piece, piece_offsets in pieces_of(data, offsets, length):
                    doc, key, *places = anchored_runs(piece, piece_offsets, length)
                    found.append([doc, key, *[p + shift for p in places]])
                doc, key, lo, hi, at = (np.concatenate(x) for x in zip(*found, strict=True))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(key, pa.int64()), *[pa.array(x.astype(np.int32)) for x in (lo, hi, at)]], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), runs)],
                    names=["id", "text_key", "n_bytes", "runs"],
                )

    return run


class SuffixIndex:
    """The family of levels. Each level is a table (key, n, size) of anchors with their runs and bytes, in order of key."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Index a batch of runs (key, lo, hi); the anchors of it that occur twice or more by now, with all their bytes so far."""
        weight = F.sum(F.col("hi") - F.col("lo") + self.length).alias("size")
        own = cut(entries.groupBy("key").agg(F.count("*").alias("n"), weight).sortWithinPartitions("key"), "level")
        matched = own.filter("n > 1").select("key", "size")
        if self.levels:
            sums = F.sum("n").alias("n_before"), F.sum("size").alias("size_before")
            before = None
            for _, level in self.levels:
                met = level.join(own.select("key"), "key", "left_semi")
                before = met if before is None else before.unionByName(met)
            before = before.groupBy("key").agg(*sums)
            joined = own.join(before, "key", "left").filter("n + coalesce(n_before, 0) > 1")
            matched = joined.select("key", (F.col("size") + F.coalesce("size_before", F.lit(0))).alias("size"))
        matched = cut(matched, "matched")
        level = 0
        while self.levels and self.levels[-1][0] == level:
            _, other = self.levels.pop()
            merged = other.unionByName(own).groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
            merged = cut(merged.sortWithinPartitions("key"), "level")
            discard(other, own)
            own, level = merged, level + 1
        self.levels.append((level, own))
        return matched

    def close(self) -> None:
        """Delete all levels."""
        discard(*[level for _, level in self.levels])
        self.levels = []


def _contexts(length: int, part_bytes: int):
    """The bytes around the runs of each repeated anchor; a run that is equal to another one of the slice goes on without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=4 * PIECE):
                out: list[tuple] = []
                seen: dict[tuple, int] = {}
                sure = bytearray()
                twins: list[tuple] = []
                lists = part.column("runs")
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                fields = [f.to_pylist() for f in lists.flatten().flatten()]
                for i, (own, text) in enumerate(zip(part.column("text_key").to_pylist(), part.column("text"), strict=True)):
                    raw = (text.as_py() or "").encode()
                    for j in range(ends[i], ends[i + 1]):
                        key, lo, hi, at, size = (f[j] for f in fields)
                        whole = size <= part_bytes
                        for a in (lo,) if whole else range(lo, hi + 1):
                            b = hi if whole else a
                            string = raw[a : b + length]
                            name = (key, at - a, b - a, string)
                            first = seen.setdefault(name, len(out))
                            if first == len(out):
                                digest = b"" if whole else hashlib.blake2b(string, digest_size=8).digest()
                                out.append((group_of(key, at - a, digest), own, a, at, b, string))
                                sure.append(0)
                            else:
                                sure[first] = 1
                                twins.append((len(twins), own, a, at, b, None))
                columns = list(zip(*(out + twins), strict=True))
                if columns:
                    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    marks = [*map(bool, sure), *[True] * len(twins)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(marks)],
                        names=["grp", "text_key", "lo", "at", "hi", "bytes", "sure"],
                    )

    return run


def group_of(key: int, distance: int, digest: bytes) -> int:
    """Runs are grouped by anchor alone; single windows by distance and digest as well."""
    if not digest:
        return key
    own = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + distance.to_bytes(4, "little") + digest, digest_size=8).digest()
    return int.from_bytes(own, "little", signed=True)


def suffix_classes(group: np.ndarray, parts: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For each row and depth a number that rows of one group share if they begin with the same bytes to that depth.

    ``parts`` has one suffix in each row, padded; the suffix array is the order of rows by group and bytes, and a
    class at a depth is a stretch of it whose longest common prefixes reach that depth.
    """
    head = np.ascontiguousarray(group.astype(">i8").reshape(-1, 1)).view(np.uint8)
    strings = np.ascontiguousarray(np.concatenate([head, parts], axis=1))
    order = np.argsort(strings.view(f"S{strings.shape[1]}").ravel(), kind="stable")
    strings = strings[order]
    differs = strings[1:] != strings[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1]) - head.shape[1]
    breaks = np.zeros((len(order), len(depths)), np.int32)
    np.less(lcp[:, None], depths[None, :], out=breaks[1:], casting="unsafe")
    out = np.empty_like(breaks)
    out[order] = np.cumsum(breaks, axis=0, dtype=np.int32)
    return out


def repeated_windows(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every window that occurs again among whole groups of contexts, in order."""
    group, lo, at, hi = (rows.column(c).to_numpy() for c in ("grp", "lo", "at", "hi"))
    data, offsets = bytes_of(rows.column("bytes"))
    n, most = len(group), length - GRAM
    near, far = at - hi, at - lo  # the distances of the anchor from the windows' starts
    anchor, end = offsets[:-1] + far, offsets[1:]
    data = np.concatenate([data, np.zeros(1, np.uint8)])
    right = anchor[:, None] + np.arange(length)
    right = data[np.where(right < end[:, None], right, len(data) - 1)]
    left = anchor[:, None] - 1 - np.arange(most)
    left = data[np.where(left >= offsets[:-1, None], left, len(data) - 1)]
    distance = np.arange(most + 1)
    ahead, behind = suffix_classes(group, right, length - distance), suffix_classes(group, left, distance)
    counts = hi - lo + 1
    row = np.repeat(np.arange(n), counts)
    d = np.repeat(near, counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    name = (d * n + ahead[row, d].astype(np.int64)) * n + behind[row, d]
    order = np.argsort(name, kind="stable")
    equal = np.diff(name[order]) == 0
    again = np.zeros(len(name), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    # a row that is sure is repeated throughout, whatever it meets here
    again |= rows.column("sure").to_numpy(zero_copy_only=False)[row]
    row, start = row[again], at[row[again]] - d[again]
    order = np.lexsort((start, row))
    return row[order], start[order]


def _spans(keys: pa.ChunkedArray, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Maximal runs of covered bytes in each row, from rows and starts in order."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(row)]]) - 1
    own = keys.combine_chunks().take(pa.array(row[a]))
    return pa.RecordBatch.from_arrays([own, pa.array(start[a], pa.int32()), pa.array(start[b] + length, pa.int32())], names=["text_key", "start", "stop"])


def _compare(length: int, at_once: int = 1 << 20):
    """Repeated spans of contexts that come in order of group; whole groups of about ``at_once`` bytes are taken together."""

    def spans(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        known = rows.filter(rows.column("bytes").is_null())
        if len(known):
            lo, hi = (known.column(c).to_numpy() for c in ("lo", "hi"))
            yield pa.RecordBatch.from_arrays(
                [known.column("text_key").combine_chunks(), pa.array(lo, pa.int32()), pa.array(hi + length, pa.int32())], names=["text_key", "start", "stop"]
            )
        rows = rows.filter(rows.column("bytes").is_valid())
        row, start = repeated_windows(rows, length) if len(rows) else ([], [])
        if len(row):
            yield _spans(rows.column("text_key"), row, start, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in chunks(whole, "bytes", at_once):
                if held and size >= at_once:
                    last = held[-1].column("grp")[-1].as_py()
                    more = batch.column("grp").to_numpy()
                    until = int(np.argmax(more != last)) if (more != last).any() else len(more)
                    if until:
                        held.append(batch.slice(0, until))
                    if until < len(more):
                        yield from spans(held)
                        held, size, batch = [], 0, batch.slice(until)
                    else:
                        continue
                held.append(batch)
                size += len(bytes_of(batch.column("bytes"))[0])
        if held:
            yield from spans(held)

    return run


def repeated_spans(docs: DataFrame, reps: DataFrame, length: int, batches: int, part_bytes: int, shard_bytes: int) -> DataFrame:
    """(text_key, spans) for each text that has repeated bytes; ``docs`` has id, text and text_key."""
    entries = reps.select("text_key", "id", F.explode("runs").alias("r")).select("text_key", "id", "r.*")
    index, matched = SuffixIndex(length), []
    for b in range(batches):
        matched.append(index.add(entries.filter(F.pmod(F.xxhash64("text_key"), F.lit(batches)) == b)))
    index.close()
    every = matched[0]
    for m in matched[1:]:
        every = every.unionByName(m)
    # the last batch that met an anchor knows all of its bytes
    repeated = cut(every.groupBy("key").agg(F.max("size").alias("size")), "anchors")
    discard(*matched)
    total = repeated.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    run = F.struct("key", "lo", "hi", "at", "size")
    hits = entries.join(repeated, "key").groupBy("text_key", "id").agg(F.collect_list(run).alias("runs"))
    rows = docs.join(hits, ["text_key", "id"]).select("text_key", "text", "runs")
    shards = max(1, -(-int(total) // shard_bytes))
    dealt = rows.mapInArrow(_contexts(length, part_bytes), CONTEXT).repartition(shards, "grp").sortWithinPartitions("grp")
    spans = dealt.mapInArrow(_compare(length), "text_key binary, start int, stop int")
    out = cut(spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(repeated)
    return out


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for whole in batches:
        for batch in chunks(whole):
            out: dict[str, list] = {"kept": [], "spans": []}
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw, merged, parts, last = (text.as_py() or "").encode(), [], [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                for s in merged:
                    parts.append(raw[last : s["start"]])
                    last = s["stop"]
                out["kept"].append(b"".join([*parts, raw[last:]]))
                out["spans"].append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], span)], names=["text_key", "kept", "spans"])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    batches: int = 4,
    part_bytes: int = 6 << 20,
    shard_bytes: int = 24 << 20,
) -> DataFrame:
    """doc_id, n_bytes, kept_sha256 and the removed spans (in bytes) of every row of ``docs``.

    The result does not depend on the number of ``batches`` that the documents come in.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text", text_key(F.col("text")).alias("text_key"))
    signed = keyed.select("id", "text_key", "text").mapInArrow(_anchors(length), f"id string, text_key binary, n_bytes long, runs {RUN}").filter(F.size("runs") > 0)
    reps = cut(signed.groupBy("text_key").agg(F.min("id").alias("id"), F.first("runs").alias("runs"), F.count("*").alias("copies")), "suffixes")
    copied = cut(reps.filter("copies > 1").select("text_key", F.lit(True).alias("copied")), "copied")
    found = repeated_spans(keyed, reps, length, batches, part_bytes, shard_bytes)
    spans = cut(found.join(copied, "text_key", "left_anti"), "spans")
    discard(reps, found)
    pieces = keyed.select("text_key", "text").join(spans, "text_key").mapInArrow(_cutter, "text_key binary, kept binary, spans array<struct<start:int,stop:int>>")
    changed = pieces.select("text_key", F.sha2("kept", 256).alias("cut_sha256"), "spans")
    base = keyed.select("doc_id", "text_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    whole_span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    joined = base.join(copied, "text_key", "left").join(changed, "text_key", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), whole_span).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "whole")).alias("kept_sha256"),
    )
