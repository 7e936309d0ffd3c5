"""Personal data by fixed patterns, extended by bootstrapped contextual extraction.

The base patterns give e-mail addresses, IP addresses, card numbers and phone numbers. They are the seeds of a
bootstrap, with key-like strings (32 or more hex digits, letters and figures among them), which are seeds but no spans by
themselves. A candidate is any other run of characters with an @ or at least four digits.

A text is a row of words and signs: words end at spaces, at signs (: = quotes brackets), and before the first digit,
@ or + in them. Before each word stand up to two lexical patterns: the two words before it with the signs that
follow them, and, if there are such signs, the last word with them alone (token = "). Patterns are taken from seeds
and candidates, and counted over all words of the corpus, by the same rule.

Spark then scores the graph of patterns and instances in rounds, until nothing changes: a pattern scores by the share of all its occurrences
in the corpus, whatever word follows, that lead to a believed instance (a candidate that is not believed counts less against it than a plain word), and an instance by the patterns that hold it
(noisy or). Patterns that reach ``min_score`` with ``min_support`` distinct believed instances make spans of the kind ``id``
of what follows them and is no base span. So words that stand before anything, like articles, are never patterns.

Null and empty texts have no spans. Texts, words and identifiers are read whole. Spans of rows with equal texts
are equal. Added spans never overlap a base span. Columns besides id and text are not read. Candidate tables
hold no texts; a pattern or an instance that stands in a third of all rows is pre-aggregated by
(pattern, value) before anything else. Patterns are counted in one reading, against a filter of a fixed size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bytetext import by_bytes, chunks
from strandline.plans.runtime import cut, discard, join_small

KINDS = ("email", "ip", "card", "phone", "id")
SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"
CANDIDATE = "array<struct<start:int,stop:int,value:binary,patterns:array<string>,seed:boolean,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match ends at the end of a run of digits, so the next one starts at the start of one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]+")
# what ends a word: white space, and signs that may stand between a label and what it names
_SIGNS = frozenset(":=\"'`<>()[]{}\u00ab\u00bb\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2039\u203a")
_BREAKS = frozenset(" \t\n\x0b\x0c\r") | _SIGNS
_CLASS = re.escape("".join(sorted(_SIGNS)))
_TOKEN = re.compile(rf"[{_CLASS}]|[0-9@+][^\x20\x09-\x0D{_CLASS}]*|[^\x20\x09-\x0D{_CLASS}0-9@+]+")
_RUN = re.compile(rf"[^\x20\x09-\x0D{_CLASS}]*[0-9@][^\x20\x09-\x0D{_CLASS}]*")
_KEY = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}")
#: Bits of the filter that says which words and patterns are worth counting: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base kinds, in order."""
    if not _SIGN.search(text):
        return []
    out = [(a, 0, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def folded(text: str) -> str:
    """In lower case, every digit as 0."""
    text = text.lower()
    for d in "123456789":
        text = text.replace(d, "0")
    return text


def patterns_of(tokens: list[str]) -> Iterator[tuple[str, str, str]]:
    """(word before last, last word, signs after it) for each word of a text that has a word before it."""
    before = last = signs = ""
    for t in tokens:
        if t in _SIGNS:
            signs += t
            continue
        if last:
            yield before, last, signs
        before, last, signs = last, t, ""


def named(before: str, last: str, signs: str) -> list[str]:
    """The patterns of a place."""
    long = [f"{before} {last} {signs}"] if before else []
    return [*long, f"{last} {signs}"] if signs else long


def contexts(text: str, starts: set[int]) -> dict[int, list[str]]:
    """The patterns before each of the places ``starts`` at which a word begins; one reading of the text."""
    out: dict[int, list[str]] = {}
    before = last = ""
    signs: list[str] = []
    for m in _TOKEN.finditer(text):
        if m[0] in _SIGNS:
            signs.append(m[0])
            continue
        if last and m.start() in starts:
            out[m.start()] = named(folded(before), folded(last), "".join(signs))
        before, last, signs = last, m[0], []
    return out


def candidates(text: str, spans: list[tuple[int, int, str, int]]) -> list[dict]:
    """Base spans as seeds, and the other runs with an @ or at least four digits; key-like ones are seeds too."""

    def found(a: int, b: int, seed: bool, base: bool) -> dict:
        value = hashlib.md5(text[a:b].lower().encode(), usedforsecurity=False).digest()
        return {"start": a, "stop": b, "value": value, "patterns": [], "seed": seed, "base": base}

    out = [found(a, b, True, True) for a, _, _, b in spans]
    by_start, k = sorted((a, b) for a, _, _, b in spans), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while start < end and not (text[start].isalnum() or text[start] == "+"):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while k < len(by_start) and by_start[k][1] <= start:
            k += 1
        if k < len(by_start) and by_start[k][0] < end:
            continue
        word = text[start:end]
        if "@" in word or len(_NOT_DIGIT.sub("", word)) >= 4:
            out.append(found(start, end, _KEY.fullmatch(word.lower()) is not None, False))
    patterns = contexts(text, {c["start"] for c in out}) if out else {}
    for c in out:
        c["patterns"] = patterns.get(c["start"], [])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))
_CANDIDATES = pa.list_(
    pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("base", pa.bool_())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole):
            keys, spans_of, found = [], [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                spans = base_spans(t)
                found.append(candidates(t, spans) if _SIGN.search(t) else [])
                spans_of.append([{"start": a, "rank": r, "kind": k, "stop": b} for a, r, k, b in spans])
                keys.append(hashlib.sha256(t.encode()).digest() if found[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(spans_of, _SPANS), pa.array(found, _CANDIDATES)],
                names=["doc_id", "text_key", "base", "candidates"],
            )


def _filter(strings: DataFrame) -> np.ndarray:
    """A bit for the checksum of each string of a column, set on Spark; at most FILTER_BITS / 64 rows reach the driver."""
    at = F.crc32(F.encode(F.col(strings.columns[0]), "UTF-8")) % FILTER_BITS
    words = strings.select((at / 64).cast("int").alias("w"), (at % 64).cast("int").alias("b"))
    bits = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[bits["w"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, n): how often each pattern stands in the corpus before a word.

    One reading of the texts counts what passes a filter by checksum, and a join with the patterns leaves out what
    passed by chance.
    """
    last = F.element_at(F.split("pattern", " "), -2)
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast((_filter(patterns.select("pattern")), _filter(patterns.select(last))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lasts = bits.value
        known: dict[str, bool] = {}

        def has(table: np.ndarray, s: str) -> bool:
            at = zlib.crc32(s.encode()) % FILTER_BITS
            return bool(table[at >> 3] >> (at & 7) & 1)

        for whole in batches:
            for batch in chunks(whole):
                found: Counter = Counter()
                for text in batch.column("text"):
                    for before, word, signs in patterns_of(_TOKEN.findall(folded(text.as_py() or ""))):
                        ok = known.get(word)
                        if ok is None:
                            if len(known) > 100_000:
                                known.clear()
                            ok = known[word] = has(lasts, word)
                        if ok:
                            found.update(p for p in named(before, word, signs) if has(own, p))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n")).join(patterns, "pattern", "left_semi")


def trusted_patterns(edges: DataFrame, totals: DataFrame, min_score: float = 0.5, min_support: int = 3, unknown: float = 0.25, tolerance: float = 1e-4) -> DataFrame:
    """Patterns worth trusting, from (pattern, value, seed, n) of all instances and the patterns' own totals.

    A word that is no candidate counts against the pattern before it in full, a candidate only by ``unknown`` as far as it is not believed.
    Beliefs only grow from round to round, and with them scores and the set of trusted patterns. Rounds go on until that set stays
    as it is and no belief grows by ``tolerance`` any more, however many it takes.
    """
    known = cut(join_small(edges.drop("seed"), totals.withColumnRenamed("n", "total"), ["pattern"], "inner"), "known")
    believed = cut(edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("belief")), "beliefs")
    patterns, trusted, good = None, -1, F.sum(F.col("belief") * F.col("n"))
    while True:
        scored = join_small(known, believed, ["value"], "inner").groupBy("pattern").agg(
            (good / F.greatest(good, F.first("total") - (1 - unknown) * (F.sum("n") - good))).alias("score"), F.count_if(F.col("belief") >= min_score).alias("support")
        )
        if patterns is not None:
            discard(patterns)
        patterns = cut(scored.filter((F.col("score") >= min_score) & (F.col("support") >= min_support)), "patterns")
        before, trusted = trusted, patterns.count()
        if not trusted:
            break
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999))))
        heard = cut(join_small(known, patterns, ["pattern"], "inner").groupBy("value").agg((1 - F.exp(doubt)).alias("heard")), "heard")
        grown = join_small(believed, heard, ["value"]).select("value", F.greatest("belief", F.coalesce("heard", F.lit(0.0))).alias("belief"), "belief")
        grown = cut(grown.toDF("value", "belief", "was"), "beliefs")
        rise = grown.agg(F.max(F.col("belief") - F.col("was"))).first()[0]
        discard(believed, heard)
        believed = grown.drop("was")
        believed.written_at = grown.written_at
        if trusted == before and rise < tolerance:
            break
    discard(known, believed)
    return patterns.select("pattern")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a key of the text, base spans and candidates of every row, written once."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return cut(rows.mapInArrow(_scan, f"doc_id long, text_key binary, base {SPAN}, candidates {CANDIDATE}"), "candidates")


def discovered(docs: DataFrame, found: DataFrame, text_col: str = "text", min_support: int = 3, **graph: float) -> DataFrame | None:
    """(text_key, added spans) by trusted patterns; None if no pattern is trusted."""
    all_found = found.filter("text_key is not null").select("text_key", F.explode("candidates").alias("c")).select("text_key", "c.*")
    placed = all_found.withColumn("pattern", F.explode("patterns"))
    edges = cut(placed.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "graph")
    # belief begins with seeds, and reaches a pattern only over one of them or an instance that shares a pattern with one
    worth = cut(edges.groupBy("pattern").agg(F.count("*").alias("k")).filter(F.col("k") >= min_support).select("pattern"), "worth")
    if worth.isEmpty():
        return None
    totals = cut(occurrences(docs, worth, text_col), "occurrences")
    patterns = trusted_patterns(edges, totals, min_support=min_support, **graph)
    discard(worth, totals)
    if patterns.isEmpty():
        return None
    new = join_small(placed.filter("not base"), patterns, ["pattern"], "left_semi").dropDuplicates(["text_key", "start"])
    span = F.struct(F.col("start"), F.lit(4).alias("rank"), F.lit("id").alias("kind"), F.col("stop"))
    return new.groupBy("text_key").agg(F.sort_array(F.collect_list(span)).alias("added"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **graph: float) -> DataFrame:
    """doc_id, base spans, and all spans of every row of ``docs``."""
    found = scan(docs, id_col, text_col)
    added = discovered(docs, found, text_col, **graph)
    none = F.array().cast(SPAN)
    if added is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    joined = join_small(found.filter("text_key is not null"), cut(added, "added"), ["text_key"])
    joined = joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))
    return joined.unionByName(found.filter("text_key is null").select("doc_id", "base", F.col("base").alias("spans")))


def redacted(text: str, added: list[dict]) -> str:
    """A text with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    out, last = [], 0
    for a, _, kind, b in sorted([*base_spans(text), *((m["start"], 4, "id", m["stop"]) for m in added)]):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
            last = b
        elif b > last:
            last = b
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **graph: float) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets. All columns stay, null texts too."""
    added = discovered(docs, scan(docs, id_col, text_col), text_col, **graph)
    schema, names = docs.schema, docs.columns
    place = names.index(text_col)
    text = F.col(f"`{text_col}`")
    # the row is one column, so that no name of the input can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("text_key"))
    if added is None:
        rows = rows.select("row", F.array().cast(SPAN).alias("added"))
    else:
        rows = join_small(rows, cut(added, "added"), ["text_key"]).select("row", "added")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, more = batch.column("row").flatten(), batch.column("added")
            for start, n in by_bytes(columns[place]):
                part = [c.slice(start, n) for c in columns]
                texts = []
                for t, spans in zip(part[place], more.slice(start, n).to_pylist(), strict=True):
                    t = t.as_py()
                    texts.append(redacted(t, spans or []) if t is not None and _SIGN.search(t) else t)
                part[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(part, names=names)

    return rows.mapInArrow(rewrite, schema)
