"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a public SentencePiece file; nothing is trained. A file of the byte-pair kind holds
merge ranks, not probabilities, so a piece of rank r gets the log score of Zipf's law, -ln(r + 2) less a
constant; a file of the unigram kind keeps its own log scores. A character that is no piece is written as
its UTF-8 bytes by byte pieces, at ten below the least score.

A space is the marker U+2581 and one is put before the text; decoding turns markers into spaces and
takes that one away. A marker that stands in the text itself is written by byte pieces, so that decoding
returns every text exactly. No piece has a marker after another character, so a text falls into units at
spaces (and at characters in no piece) whose best paths together are the best path of the text.

Equal units of a task are solved once. Units of any length go one way: the trie is walked from all characters of
a stretch of bytes at once, and one pass over the pieces found, in order of their starts, keeps the best score
at each end. Characters at one place of many units take this step together, the others one after another, which
changes nothing but the time. The state of the pass is 16 bytes for each byte of the units at hand, besides one
stretch; what is remembered of earlier units is bounded by bytes.

A null text has null ids, an empty one no ids. Null ids decode to a null text, no ids to an empty one. An id
that is null or that the file does not have decodes to U+FFFD, control pieces to nothing. A file without all 256
byte pieces gives a character in no piece the unknown id, which decodes to U+FFFD, so such a character is not
brought back. All columns of the input stay; the new columns replace columns of the same name. Nothing is
truncated.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARKER = "▁"
#: What stands for an id or a character that cannot be named.
REPLACEMENT = "\ufffd".encode()
#: Bytes of units and ids that a task remembers, bytes of units solved together, characters walked at once.
REMEMBERED, TOGETHER, STRETCH = 64 << 20, 1 << 20, 1 << 16
#: So many rows are worth an array operation; fewer go one by one.
ABREAST = 64


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        ordered = sorted(keys)
        size = 4 * sum(map(len, ordered)) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = -2
        taken = bytearray(size)  # as check, but quick to look at one by one
        taken[0] = 1
        free_from, wide_from, last = 258, 258, 0
        todo = [(0, 0, 0, len(ordered))]
        while todo:
            state, depth, lo, hi = todo.pop()
            if lo < hi and len(ordered[lo]) == depth:
                value[state] = keys[ordered[lo]]
                lo += 1
            children, at = [], lo
            while at < hi:
                byte, start = ordered[at][depth], at
                while at < hi and ordered[at][depth] == byte:
                    at += 1
                children.append((byte, start, at))
            if not children:
                continue
            while taken[free_from]:
                free_from += 1
            steps = [c[0] + 1 for c in children]
            if len(steps) == 1:  # fills the gaps
                place = max(free_from - steps[0], 0)
            else:  # looks on from the last such place
                place = wide_from
            while any(taken[place + x] for x in steps):
                place += 1
            if len(steps) > 1:
                wide_from = max(place - 64, 258)
            base[state] = place
            for x in steps:
                taken[place + x] = 1
                check[place + x] = state
            last = max(last, place + 257)
            todo += [(place + c + 1, depth + 1, a, b) for c, a, b in children]
        self.base, self.check, self.value = base[: last + 258].copy(), check[: last + 258].copy(), value[: last + 258].copy()


class Pieces:
    """The pieces of a file with their log scores and trie; small and of a fixed size, so it is sent to every task."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        raw = np.array([model.get_score(i) for i in normal])
        if (raw == np.round(raw)).all():  # ranks
            rank = raw.max() - raw
            scores = -np.log(rank + 2) - np.log((1 / (rank + 2)).sum())
        else:
            scores = raw
        self.scores = np.full(n, -np.inf)
        self.scores[normal] = scores
        self.unknown = float(scores.min() - 10)
        self.trie = DoubleArray({names[i].replace(MARKER, " ").encode(): i for i in normal})
        self.bytes_of = [names[i].replace(MARKER, " ").encode() if self.scores[i] > -np.inf else b"" for i in range(n)]
        self.unknown_id = model.unk_id()
        if self.unknown_id >= 0:
            self.bytes_of[self.unknown_id] = REPLACEMENT
        self.byte_id = None
        if sum(map(model.is_byte, range(n))) == 256:
            self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
            for b, i in enumerate(self.byte_id.tolist()):
                self.bytes_of[i] = bytes([b])
        elif self.unknown_id < 0:
            raise ValueError("a piece file needs byte pieces or an unknown piece")
        inner = {c for i in normal for c in names[i]}
        if any(MARKER in names[i].lstrip(MARKER) for i in normal):
            raise ValueError("a piece has a marker after another character")
        self.alone = "" if "\n" in inner else "\n"
        self.known: dict[str, bytes] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        own = self.alone
        return re.findall(f"{own}| *[^ {own}]+| +" if own else " *[^ ]+| +", " " + text)

    def _found(self, data: np.ndarray, stop: np.ndarray, starts: np.ndarray, char_end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row of starts, end, piece) of all pieces that begin at ``starts``; -1 is a character in no piece."""
        t = self.trie
        end, state, row = starts, np.zeros(len(starts), np.int64), np.arange(len(starts))
        single, rows, ends, pieces = np.zeros(len(starts), bool), [], [], []
        while len(row):
            to = t.base[state] + data[end].astype(np.int64) + 1
            ok = t.check[to] == state
            end, state, row = end[ok] + 1, to[ok], row[ok]
            piece = t.value[state]
            has = piece >= 0
            single[row[has & (end == char_end[row])]] = True
            rows.append(row[has])
            ends.append(end[has])
            pieces.append(piece[has])
            inside = end < stop[row]
            end, state, row = end[inside], state[inside], row[inside]
        bare = np.flatnonzero(~single)
        return np.concatenate([*rows, bare]), np.concatenate([*ends, char_end[bare]]), np.concatenate([*pieces, np.full(len(bare), -1)])

    def solve(self, raw: list[bytes]) -> list[bytes]:
        """The best path of each unit: of equal scores, the one whose last piece starts first."""
        sizes = np.array([len(u) for u in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        char_end = np.append(first[1:], len(data))
        unit = np.repeat(np.arange(len(raw)), sizes)
        stops = np.cumsum(sizes)
        nth = np.arange(len(first)) - np.searchsorted(first, stops - sizes)[unit[first]]
        # a unit of n bytes has n + 1 places, so that its end is not the start of the next
        n, heads = len(data) + len(raw), stops - sizes + np.arange(len(raw))
        best, back, with_piece = array("d", [-np.inf]) * n, array("i", [-1]) * n, array("i", [-1]) * n
        bests, backs, pieces = np.frombuffer(best), np.frombuffer(back, np.int32), np.frombuffer(with_piece, np.int32)
        bests[heads] = 0.0
        scores = np.append(self.scores, self.unknown)
        for a in range(0, len(first), STRETCH):
            own, level = first[a : a + STRETCH], nth[a : a + STRETCH]
            row, e, piece = self._found(data, stops[unit[own]], own, char_end[a : a + STRETCH])
            s, gain = own[row] + unit[own[row]], scores[piece]
            e = e + unit[own[row]]
            # characters that many units have at one place are taken together: their pieces end apart
            wide = int(np.argmin(np.append(np.bincount(np.minimum(level, STRETCH)), 0) >= ABREAST))
            together = level[row] < wide
            at = np.flatnonzero(together)
            at = at[np.argsort(level[row[at]].astype(np.uint16), kind="stable")]
            cuts = np.searchsorted(level[row[at]], np.arange(wide + 1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i = at[lo:hi]
                score = bests[s[i]] + gain[i]
                up = score > bests[e[i]]
                i = i[up]
                bests[e[i]], backs[e[i]], pieces[e[i]] = score[up], s[i], piece[i]
            at = np.flatnonzero(~together)
            at = at[np.argsort(row[at].astype(np.uint16), kind="stable")]
            for x, y, p, g in zip(s[at].tolist(), e[at].tolist(), piece[at].tolist(), gain[at].tolist(), strict=True):
                score = best[x] + g
                if score > best[y]:
                    best[y], back[y], with_piece[y] = score, x, p
        on_path = np.zeros(n, bool)
        place = stops + np.arange(len(raw))
        while len(place) >= ABREAST:
            on_path[place] = True
            place = backs[place]
            place = place[backs[place] >= 0]
        for x in place.tolist():
            came = array("q")
            while back[x] >= 0:
                came.append(x)
                x = back[x]
            on_path[came] = True
        ends = np.flatnonzero(on_path)
        starts, piece = backs[ends], pieces[ends]
        of_unit = np.searchsorted(stops + np.arange(len(raw)), ends)
        bare = piece < 0
        counts = np.where(bare & (self.byte_id is not None), ends - starts, 1)
        ids = np.repeat(np.where(bare, self.unknown_id, piece), counts).astype(np.int32)
        if self.byte_id is not None:
            nth = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            spelt = np.repeat(bare, counts)
            ids[spelt] = self.byte_id[data[(np.repeat(starts - of_unit, counts) + nth)[spelt]]]
        flat, cuts = ids.tobytes(), np.cumsum(np.bincount(of_unit, counts, len(raw)).astype(np.int64)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def learn(self, units: set[str]) -> None:
        """Solve the units that are not known yet."""
        names: list[str] = []
        raw: list[bytes] = []
        size = 0
        for unit in units:
            if unit in self.known:
                continue
            names.append(unit)
            raw.append(unit.encode())
            size += len(raw[-1])
            if size >= TOGETHER:
                self._remember(names, raw)
                names, raw, size = [], [], 0
        if names:
            self._remember(names, raw)

    def _remember(self, names: list[str], raw: list[bytes]) -> None:
        solved = self.solve(raw)
        self.known.update(zip(names, solved, strict=True))
        self.held += sum(map(len, raw)) + sum(map(len, solved)) + 200 * len(names)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """For each text its ids as the bytes of 32-bit integers."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        units = [self.units(t) if t else [] for t in texts]
        self.learn({u for us in units for u in us})
        get = self.known.__getitem__
        return [None if t is None else b"".join(map(get, us)) for t, us in zip(texts, units, strict=True)]

    def decode(self, ids: list[int | None]) -> str:
        n, of = len(self.bytes_of), self.bytes_of
        try:
            raw = b"".join(map(of.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except (TypeError, IndexError):
            raw = None
        if raw is None:  # an id that is null or out of range
            raw = b"".join(of[i] if i is not None and 0 <= i < n else REPLACEMENT for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _outer(docs: DataFrame, column: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [c for c in docs.columns if c != column]
    return keep, T.StructType([*[docs.schema[c] for c in keep], T.StructField(column, kind)])


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``ids_col``; without the text if ``keep_text`` is false."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    keep, schema = _outer(docs, ids_col, T.ArrayType(T.IntegerType()))
    if not keep_text:
        keep, schema = [c for c in keep if c != text_col], T.StructType([f for f in schema if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(text_col).to_pylist()):
                got = p.encode(texts)
                sizes = np.array([0 if g is None else len(g) // 4 for g in got])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(g for g in got if g), np.int32))
                ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([g is None for g in got]))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], names=[*keep, ids_col])

    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``text_col``."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    keep, schema = _outer(docs, text_col, T.StringType())
    if not keep_ids:
        keep, schema = [c for c in keep if c != ids_col], T.StructType([f for f in schema if f.name != ids_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if i is None else p.decode(i) for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, text_col])

    return docs.mapInArrow(run, schema)


def byte_range(model_file: str) -> tuple[int, int]:
    """The first and last id of the byte pieces, which stand together."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return model.piece_to_id("<0x00>"), model.piece_to_id("<0xFF>")


def default_model(spark: SparkSession) -> str:
    """The piece file named by ``spark.strandline.pieces``, else the one on this machine's tokenizer shelf."""
    return spark.conf.get("spark.strandline.pieces", "/opt/tokenizers/piece_bpe_32k.model")
