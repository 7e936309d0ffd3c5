"""MinHash near-duplicate search with sequential Bayesian verification.

1. Every text becomes the set of its word shingles (64-bit hashes) and a MinHash signature, cut into
   bands. Texts with equal sets are one node from here on.
2. Nodes that share a band bucket are candidates. The least node of each bucket is its hub. Every other member is
   compared with the least of its hubs, and then with those of the others that it is not connected with by then (a large
   group of copies so costs one comparison a member): the signatures batch by batch, where a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls under ``miss``. (Both share a band, so the
   signatures agree more than by chance; that keeps pairs, and loses none.) Survivors are verified on their full
   sets: texts travel for survivors only, and those of one hub are dealt over tasks by ``fan`` at a time.
3. Verified links have connected components. A bucket is settled if all its members but the hub are in one of
   them. In the others, members of different components are compared in pairs of blocks, one task each, of ``block``
   nodes and ``block_bytes`` of sets at most on average; a pair that shares several buckets counts in the first of
   them. The signatures come first. What leaves a task is not the pairs that pass, whose number can grow with the square of a group,
   but their nodes; the same tasks are run on those again, with their full sets, and give the links
   that connect what was not connected yet. So each candidate pair has been compared, or is connected without it.

Nulls and texts without words have no set and are linked with nothing. Rows with the same id are judged row by
row, by their texts. Ties are settled by the least id. Columns besides the id and the text are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bytetext import bytes_of, chunks, grouped, mix, shingle_sets
from strandline.llm.components import connected_components, extended_components
from strandline.plans.runtime import cut, discard

BATCH = 32


def bands_for(percent: int, rows: int, miss: float) -> int:
    """How many bands of ``rows`` values find a pair at the threshold but for a chance of ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def least_matches(percent: int, n_hashes: int, miss: float) -> list[int]:
    """After 32, 64, ... compared values: the fewest matches that keep a pair.

    Under a uniform prior the similarity after m matches in n is Beta(m + 1, n - m + 1), and its chance
    of reaching t equals that of at most m successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, n_hashes + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def minhash(sets: list[np.ndarray], n_hashes: int, seed: int) -> np.ndarray:
    """A row of ``n_hashes`` 32-bit minima for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.uint64(seed) << np.uint64(32)
    factors = mix(np.arange(n_hashes, dtype=np.uint64) + base) | np.uint64(1)
    shifts = mix(np.arange(n_hashes, dtype=np.uint64) + base + np.uint64(1 << 20))
    out = np.empty((len(sets), n_hashes), np.uint32)
    work = np.empty_like(values)
    for i in range(n_hashes):
        np.multiply(values, factors[i], out=work)
        work += shifts[i]
        out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the keys of different bands differ."""
    coef = mix(np.arange(bands * rows, dtype=np.uint64) + np.uint64(77)).reshape(bands, rows)
    parts = signature.astype(np.uint64).reshape(-1, bands, rows) + np.uint64(1)
    return mix((parts * coef).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _signer(size: int, bands: int, rows: int):
    """Sizes, names, band keys and signatures of sets; of a signature's values the low 16 bits are kept."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                names, keys, signatures = ([None] * len(sets) for _ in range(3))
                if full:
                    values = minhash([sets[i] for i in full], bands * rows, 1)
                    for i, k, v in zip(full, band_keys(values, bands, rows), values.astype(np.uint16), strict=True):
                        names[i], keys[i], signatures[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("h"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(signatures, pa.binary()),
                    ],
                    names=["doc_id", "h", "n_shingles", "set_key", "bands", "signature"],
                )

    return sign


def _values(column: pa.Array) -> np.ndarray:
    """Signatures as rows of 16-bit numbers."""
    return bytes_of(column)[0].view(np.uint16).reshape(len(column), -1)


class Bounds:
    """The sequential test of candidate pairs."""

    def __init__(self, percent: int, n_hashes: int, miss: float):
        self.percent, self.least = percent, least_matches(percent, n_hashes, miss)

    def keeps(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """The places of the pairs of rows of ``a`` and ``b`` that may reach the threshold; ``a`` may be one row."""
        small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
        at = np.flatnonzero(100 * small >= self.percent * large)
        matches = np.zeros(len(at), np.int64)
        for k, least in enumerate(self.least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += ((a[:, part] if len(a) == 1 else a[at, part]) == b[at, part]).sum(axis=1)
            keep = matches >= least
            at, matches = at[keep], matches[keep]
        return at


def _pairs_kept(bounds: Bounds):
    """The pairs (u, v) of rows with both signatures that pass the sequential test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(bounds.keeps(*(_values(batch.column(c)) for c in ("a", "b")), *(batch.column(c).to_numpy() for c in ("size_a", "size_b"))))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("u", "v")], names=["u", "v"])

    return run


def _across(rows: pa.Table, label: np.ndarray, bounds: Bounds) -> Iterator[tuple[int, np.ndarray]]:
    """Row i of a task and later rows that pass the sequential test with it: of other labels, of another block if there are two, and
    in no bucket before that both share. ``label`` may be changed between the steps."""
    own, size, bucket = (rows.column(c).to_numpy() for c in ("own", "n", "bucket"))
    values = _values(rows.column("signature").combine_chunks())
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    two = len(np.unique(own)) > 1
    for i in range(len(label) - 1):
        other = label[i + 1 :] != label[i]
        if two:
            other &= own[i + 1 :] != own[i]
        j = np.flatnonzero(other) + i + 1
        j = j[bounds.keeps(values[i : i + 1], values[j], size[i], size[j])]
        j = j[bands[i, (bands[j] == bands[i]).argmax(axis=1)] == bucket[i]]
        if len(j):
            yield i, j


def _blocks_kept(bounds: Bounds):
    """The rows (task, node, label, own, bucket) of each task that pass the sequential test with any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "task"):
            kept = np.zeros(len(rows), bool)
            for i, j in _across(rows, rows.column("label").to_numpy(), bounds):
                kept[i] = True
                kept[j] = True
            yield from rows.select(["task", "node", "label", "own", "bucket"]).filter(pa.array(kept)).to_batches()

    return run


def _blocks_linked(bounds: Bounds, percent: int):
    """Links (u, v) by the full sets of each task's rows; one for each two groups that they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "task"):
            node = rows.column("node").to_numpy()
            _, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
            data, offsets = bytes_of(rows.column("set"))
            data, starts, sizes = data.view(np.uint64), offsets[:-1] // 8, np.diff(offsets) // 8
            us, vs = [], []
            for i, j in _across(rows, label, bounds):
                mine = data[starts[i] : starts[i] + sizes[i]]
                theirs = np.concatenate([data[starts[k] : starts[k] + sizes[k]] for k in j])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
                j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
                groups, first = np.unique(label[j], return_index=True)
                label[np.isin(label, groups)] = label[i]
                us.append(np.maximum(node[i], node[j[first]]))
                vs.append(np.minimum(node[i], node[j[first]]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _setter(size: int):
    """The sets of texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "set"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(size: int, percent: int):
    """The links among rows (task, member, node, text) in order, where each task begins with its hub; one text at a time is compared."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = hub = hub_set = None
        for batch in batches:
            for part in chunks(batch):
                us, vs = [], []
                sets = shingle_sets(part.column("text"), size)
                for t, member, node, s in zip(*(part.column(c).to_pylist() for c in ("task", "member", "node")), sets, strict=True):
                    if not member:
                        task, hub, hub_set = t, node, s
                    elif t == task and linked(hub_set, s, percent):
                        us.append(node)
                        vs.append(hub)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return verify


def _texts(wanted: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(node, text) of the distinct nodes of ``wanted``."""
    wanted = wanted.select("node").distinct().join(nodes.select("node", "rep"), "node")
    wanted = wanted.select("node", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    return base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "text").join(wanted, ["h", "id"]).groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame, size: int, percent: int, fan: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that are linked by their full sets."""
    texts = cut(_texts(pairs.select(F.explode(F.array("u", "v")).alias("node")), nodes, base), "texts")
    hubs = cut(pairs.groupBy("v").agg(F.ceil(F.count("*") / fan).cast("int").alias("salts")), "hubs")
    salt = F.pmod(F.xxhash64("u"), F.col("salts")).cast("int")
    members = pairs.join(hubs, "v").select(F.xxhash64("v", salt).alias("task"), F.lit(True).alias("member"), F.col("u").alias("node"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    firsts = hubs.select("v", salts).select(F.xxhash64("v", "salt").alias("task"), F.lit(False).alias("member"), F.col("v").alias("node"))
    dealt = members.unionByName(firsts).join(texts, "node").select("task", "member", "node", "text")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "member")
    links = cut(dealt.mapInArrow(_verifier(size, percent), "u long, v long"), "links")
    discard(texts, hubs)
    return links


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, rows: int, miss: float, block: int, fan: int, block_bytes: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and label (of its class; null without a set) of every row."""
    bands = bands_for(percent, rows, miss)
    bounds = Bounds(percent, bands * rows // BATCH * BATCH, miss)
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    schema = "doc_id long, h long, n_shingles long, set_key binary, bands array<long>, signature binary"
    signed = cut(base.mapInArrow(_signer(size, bands, rows), schema), "signatures")
    # the least id, if there is one, and a text of that row
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h")))
    sets = signed.filter("set_key is not null").groupBy("set_key")
    sets = sets.agg(rep.alias("rep"), *[F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("bands", "bands"), ("signature", "signature"))])
    nodes = cut(sets.withColumn("node", F.xxhash64("set_key")), "nodes")

    slots = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    hubs = slots.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("bucket", "hub")
    rest = cut(slots.join(hubs, "bucket").filter("node <> hub"), "slots")
    stars = cut(rest.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "stars")

    def tested(pairs: DataFrame) -> DataFrame:
        for name, side in (("u", "a"), ("v", "b")):
            own = nodes.select(F.col("node").alias(name), F.col("signature").alias(side), F.col("n").alias(f"size_{side}"))
            pairs = pairs.join(own, name)
        return cut(pairs.mapInArrow(_pairs_kept(bounds), "u long, v long"), "near")

    near = tested(stars.groupBy("u").agg(F.min("v").alias("v")))
    links = _verified(near, nodes, base, size, percent, fan)
    labels = connected_components(links)
    apart = stars
    for name in ("u", "v"):
        apart = apart.join(labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}")), name, "left")
    others = tested(apart.filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"))
    if not others.isEmpty():
        labels = extended_components(labels, _verified(others, nodes, base, size, percent, fan))
    discard(stars, near, others)

    known = rest.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    known = cut(known, "known")
    n_blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / block_bytes)).cast("int")
    mixed = known.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), n_blocks.alias("n_blocks"))
    mixed = cut(mixed.filter("a <> b").select("bucket", "n_blocks"), "mixed")
    if not mixed.isEmpty():
        own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("n_blocks")).cast("int")
        dealt = known.join(mixed, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "label", "own", "bucket")
        dealt = dealt.join(nodes.select("node", "n", "signature", "bands"), "node").repartition("task").sortWithinPartitions("task")
        near = cut(dealt.mapInArrow(_blocks_kept(bounds), "task long, node long, label long, own int, bucket long"), "near")
        if not near.isEmpty():
            sets = cut(_texts(near, nodes, base).mapInArrow(_setter(size), "node long, set binary"), "sets")
            dealt = near.join(nodes.select("node", "n", "signature", "bands"), "node").join(sets, "node")
            dealt = dealt.repartition("task").sortWithinPartitions("task")
            more = cut(dealt.mapInArrow(_blocks_linked(bounds, percent), "u long, v long"), "links")
            labels = extended_components(labels, more)
            discard(sets, more)
        discard(near)
    discard(rest, known, mixed)

    ids = nodes.select("set_key", "node", F.when(~F.col("rep.none"), F.col("rep.id")).alias("id"))
    grouped_ids = ids.join(labels, "node").groupBy("label").agg(F.min("id").alias("least"))
    of_node = labels.join(grouped_ids, "label").select("node", "label", "least")
    classes = ids.join(of_node, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"), F.coalesce("least", "id").alias("found"))
    out = signed.select("doc_id", "h", "n_shingles", "set_key").join(classes, "set_key", "left")
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("label").isNotNull(), F.col("found")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    rows: int = 7,
    miss: float = 1e-5,
    block: int = 2048,
    fan: int = 256,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets;
    component_id is the least id reachable, and kept says that the document is that one. If no row of a class has an
    id, component_id is null and all are kept. ``miss`` bounds the chance that banding, and again that the
    posterior bound, loses a linked pair.
    """
    out = _labelled(docs, id_col, text_col, shingle_words, percent, rows, miss, block, fan, block_bytes)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    rows: int = 7,
    miss: float = 1e-5,
    block: int = 2048,
    fan: int = 256,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the one with the least id; of repeated rows one.

    A row without an id stays for its class only if no row of it has an id. Rows without words all stay.
    """
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    labelled = _labelled(docs, id_col, text_col, shingle_words, percent, rows, miss, block, fan, block_bytes).filter("label is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h")))
    kept = cut(labelled.groupBy("label").agg(best.alias("b")).select("b.*"), "kept")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("worded"))
    first = held.filter("worded").join(kept, ["none", "id", "h"], "left_semi").dropDuplicates(["none", "id", "h"])
    return first.select("row.*").unionByName(held.filter("not worded").select("row.*"))
