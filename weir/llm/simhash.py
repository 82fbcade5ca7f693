"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set if more than half of its shingles' hashes have it. Fingerprints are linked
at few differing bits. The 64 bits are cut into three segments; if two fingerprints differ in at most four bits,
then the first or second segment differs in at most one bit, or the third doesn't differ at all. So each
fingerprint is put into the table of each segment once, looks into the Hamming balls of radius 1, 1 and 0 around
its own segments, and what it meets is verified on all 64 bits.

Only distinct fingerprints are compared, so exact copies cost nothing. A segment value that very many distinct
fingerprints share is dealt out over cells of pairs of parts. What a bucket finds leaves it as a spanning forest,
never as all its pairs.

``representatives`` is the filter for training data: it links similar texts rather than nearly equal fingerprints. Its
fingerprints have 512 bits, as 64 can't tell a similarity of 0.8 from one of 0.7. The first 126 are cut into six segments.
Both sides look into their Hamming balls of radius 1 there, so two texts meet if some segment differs in two bits at
most; at a similarity of 0.8 that holds for 93 of 100 pairs, at 0.9 for 99.7. A bucket hands on the closest links
that span it, judged by the first 128 bits with room for twice their error; a link counts only if the exact Jaccard similarity
of the two texts' shingle sets is high enough. Where a link fails, it may have displaced a real one: the texts that were
connected by such links are looked at again, by complete fingerprints with room for three times their error and by exact similarity,
all but those that are in one group already. This second look costs the pairs of such texts, but writes none of them out.

Defined cases: a null text or one without words has fingerprint 0 and links like any other; a text of fewer words
than a shingle is one shingle; very long texts count all their shingles, in parts; repeated rows are linked, being equal; a null id is never the smallest; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.components import components, forest
from weir.plans.durable import durable, join_checked, unused

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Segments as (first bit, bits, radius). The radii plus one sum to more than ``DISTANCE``.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
DISTANCE = 4
#: Looks into one bucket that are compared in one cell.
CELL = 1 << 14
#: Pairs that are compared at once.
PAIRS = 1 << 21
_bits = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    words = WORD.findall(text.encode().translate(LOWER)) if text else []
    if not words:
        return 0
    # with one space between words, every shingle is a slice
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(n, 8)
    if n < 64:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        flat = (lanes + (np.arange(8, dtype=np.int16) * 256)[None, :]).ravel()
        counts = (np.bincount(flat, minlength=2048).reshape(8, 256) @ _bits).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``fp``, the 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.withColumn("fp", fp("text"))


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's own buckets (``own`` 1) and those that it looks into besides (0)."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for t, (first, bits, radius) in enumerate(SEGMENTS):
            key = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            flips = [0, *(1 << i for i in range(bits) if radius)]
            for flip in flips:
                bucket = (key ^ flip) * len(SEGMENTS) + t
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("fp"), pa.array(np.full(len(fp), flip == 0))], ["bucket", "fp", "own"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by bucket and cell, own rows first: own with own, own with others."""
    held: list[np.ndarray] = []

    def links(bucket: np.ndarray, cell: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
        ends = np.append(starts[1:], len(fp))
        end = np.repeat(ends, ends - starts)
        at = np.flatnonzero(own)
        to = end[at] - at - 1  # each own row meets all rows behind it
        at, to = at[to > 0], to[to > 0]
        found_a, found_b = [], []
        upto = np.cumsum(to)
        i = 0
        while i < len(at):
            base = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
            left = np.repeat(at[i:j], to[i:j])
            right = left + 1 + np.arange(len(left)) - np.repeat(upto[i:j] - to[i:j] - base, to[i:j])
            near = np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE
            a, b = forest(fp[left[near]], fp[right[near]])
            found_a.append(a)
            found_b.append(b)
            i = j
        if found_a:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)]
        held.append(columns)
        if sum(len(c[0]) for c in held) < 200_000:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = cut[-1] + 1 if len(cut) else 0
        yield from links(*[c[:cut] for c in columns]) if cut else ()
        held = [[c[cut:] for c in columns]]
    if held:
        yield from links(*[np.concatenate(c) for c in zip(*held)])


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links with the components of all pairs of fingerprints (column ``fp``) within ``DISTANCE``."""
    looks = distinct.mapInArrow(_looks, "bucket long, fp long, own boolean")
    # Hot buckets from the few own rows alone: a bucket's looks are the own rows of its ball.
    own = distinct.mapInArrow(_looks, "bucket long, fp long, own boolean").filter("own").groupBy("bucket").agg(F.count("*").alias("n"))
    n_seg = len(SEGMENTS)
    flips = [[0, *(1 << i for i in range(bits if radius else 0))] for _, bits, radius in SEGMENTS]
    ball = F.element_at(F.lit(flips), (F.pmod("bucket", F.lit(n_seg)) + 1).cast("int"))
    key = F.floor(F.col("bucket") / n_seg)
    hot = own.filter(F.col("n") * 32 > CELL).select(F.col("bucket"), "n", F.explode(ball).alias("flip")).select((key.bitwiseXOR(F.col("flip").cast("long")) * n_seg + F.pmod("bucket", F.lit(n_seg))).alias("bucket"), "n")
    hot = durable(hot.groupBy("bucket").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("parts")).filter("parts > 1"), "hot-buckets")
    n_hot = hot.limit(50_001).count()
    if n_hot:
        looks = looks.join(F.broadcast(hot) if n_hot <= 50_000 else hot, "bucket", "left")
        part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: F.least(part, j) * 65_536 + F.greatest(part, j))
        looks = looks.select("bucket", F.explode(cells).alias("cell"), "fp", "own")
    else:
        looks = looks.select("bucket", F.lit(0).alias("cell"), "fp", "own")
    met = looks.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", F.desc("own"))
    return met.mapInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for a table with ``doc_id, text``: the smallest id reachable over links."""
    prints = durable(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("id", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Bits of a wide fingerprint and of its head; segments of the head as (first bit, bits).
WIDE_BITS, HEAD_BITS, WIDE = 512, 128, tuple((i * 21, 21) for i in range(6))
#: Rows of a bucket whose pairs are all compared at once, at most, and pairs that are compared at once.
SMALL, WIDE_PAIRS = 1 << 10, 1 << 19
#: Texts in a part of the second look.
PART = 512
_lane_keys = np.random.default_rng(77).integers(0, 1 << 63, WIDE_BITS // 64 - 2, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def wide_distance(similarity: float, bits: int, errors: float) -> int:
    """Bits in which texts with such a Jaccard similarity of shingle sets differ on average, and so many standard errors."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def _text_key():
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)


def _digests(text: str | None, shingle: int) -> set[bytes]:
    """16 bytes for each of a text's shingles."""
    words = WORD.findall(text.encode().translate(LOWER)) if text else []
    n = max(1, len(words) - shingle + 1) if words else 0
    return {xxhash.xxh3_128_digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)}


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """64 bytes, from each shingle once; zeros for a text without words."""
    digests = b"".join(_digests(text, shingle))
    if not digests:
        return bytes(WIDE_BITS // 8)
    counts, many = np.zeros(WIDE_BITS, np.int64), len(digests) // 16
    for lo in range(0, many, 1 << 14):  # a long text in parts
        head = np.frombuffer(digests[lo * 16 : (lo + (1 << 14)) * 16], "<u8").reshape(-1, 2)
        tail = (head[:, :1] ^ (head[:, :1] >> np.uint64(31)) ^ head[:, 1:]) * _lane_keys  # more bits from the same digest
        tail = (tail ^ (tail >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        lanes = np.hstack([head, tail ^ (tail >> np.uint64(32))]).view(np.uint8)
        if len(lanes) < 256:
            counts += np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            flat = (lanes + (np.arange(lanes.shape[1], dtype=np.int16) * 256)[None, :]).ravel()
            counts += (np.bincount(flat, minlength=256 * lanes.shape[1]).reshape(-1, 256) @ _bits).ravel()
    return np.packbits(2 * counts > many, bitorder="little").tobytes()


def _lanes(column: pa.Array, lanes: int = 2) -> np.ndarray:
    """Values of 8 bytes a lane as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, lanes)


def _segment(fp: np.ndarray, t: int) -> np.ndarray:
    first, bits = WIDE[t]
    lane, shift = divmod(first, 64)
    value = fp[:, lane] >> np.uint64(shift)
    if shift + bits > 64:
        value = value | (fp[:, lane + 1] << np.uint64(64 - shift))
    return (value & np.uint64((1 << bits) - 1)).astype(np.int64)


def _wide_looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        fp = _lanes(batch.column("fp"), len(batch.column("fp")[0].as_py()) // 8)
        for t, (_, bits) in enumerate(WIDE):
            value = _segment(fp, t)
            for flip in (0, *(1 << i for i in range(bits))):
                yield pa.RecordBatch.from_arrays([pa.array((value ^ flip) * len(WIDE) + t), *batch.columns], ["bucket", *batch.schema.names])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the lightest links that connect what all the links between ``n`` nodes connect."""
    root, kept = np.arange(n), [np.zeros(0, np.int64)]
    order = (weight.astype(np.int64) << 40) | np.arange(len(a))
    while len(order):
        live = root[a[order & MASK]] != root[b[order & MASK]]
        order = order[live]
        if not len(order):
            break
        at = order & MASK
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, root[a[at]], order)
        np.minimum.at(best, root[b[at]], order)
        chosen = np.unique(best[best < np.iinfo(np.int64).max]) & MASK
        kept.append(chosen)
        u, v = root[a[chosen]], root[b[chosen]]
        while not np.array_equal(root[u], root[v]):
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while not np.array_equal(root, root[root]):
                root = root[root]
    return np.unique(np.concatenate(kept))


MASK = (1 << 40) - 1


def _walk(fp: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``most`` bits that connect groups of one large bucket, and the groups that they make.

    Breadth first: a row that is reached is never compared with another one again but as the one that reaches, so a dense
    bucket costs its rows, not its pairs. Reaching a row reaches its group.
    """
    left, links, joined = np.random.default_rng(len(fp)).permutation(len(fp)), [], group.copy()
    while len(left):
        start = left[0]
        inside = group[left] == group[start]
        queue, left = left[inside].tolist(), left[~inside]
        while queue and len(left):
            at = queue.pop()
            reached = left[_apart(fp[left], fp[at]) <= most]
            if len(reached):
                met, first = np.unique(group[reached], return_index=True)
                links += [(at, b) for b in reached[first].tolist()]
                inside = np.isin(group[left], met)
                joined[left[inside]] = group[start]
                queue += left[inside].tolist()
                left = left[~inside]
    return np.array(links, np.int64).reshape(-1, 2).T, joined


def _large(fp: np.ndarray, flip: np.ndarray, close: int, most: int) -> np.ndarray:
    """Links of one large bucket, close ones first. Guests with the same flip have a bucket of their own, which links them."""
    group = np.arange(len(fp))
    for f in np.unique(flip[flip > 0]):
        at = np.flatnonzero(flip == f)
        group[at] = at[_walk(fp[at], np.arange(len(at)), most)[1]]
    first, group = _walk(fp, group, close)
    return np.concatenate([first, _walk(fp, group, most)[0]], axis=1)


def _wide_meet(close: int, most: int):
    """Links that with those of other buckets have the components of all pairs within ``most`` bits that meet in a bucket."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(bucket: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
            ends = np.append(starts[1:], len(fp))
            size = ends - starts
            end = np.repeat(ends, size)
            flip = np.zeros(len(fp), np.int64)
            for t in range(len(WIDE)):
                own = np.flatnonzero(bucket % len(WIDE) == t)
                flip[own] = _segment(fp[own], t) ^ (bucket[own] // len(WIDE))
            at = np.flatnonzero(np.repeat(size, size) <= SMALL)
            to = end[at] - at - 1
            at, to = at[to > 0], to[to > 0]
            found = [np.zeros((2, 0), np.int64)]
            upto = np.cumsum(to)
            i = 0
            while i < len(at):
                base = upto[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(upto, base + WIDE_PAIRS, "right")))
                left = np.repeat(at[i:j], to[i:j])
                right = left + 1 + np.arange(len(left)) - np.repeat(upto[i:j] - to[i:j] - base, to[i:j])
                apart = _apart(fp[left], fp[right])
                near = apart <= most
                left, right, apart = left[near], right[near], apart[near]
                nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
                # guests with the same flip meet in a bucket of their own: connected, but not told here
                here = (flip[left] != flip[right]) | (flip[left] == 0)
                kept = spanning(flat[: len(left)], flat[len(left) :], apart + here * (HEAD_BITS + 1), len(nodes))
                kept = kept[here[kept]]
                found.append(np.stack([left[kept], right[kept]]))
                i = j
            for s, e in zip(starts[size > SMALL], ends[size > SMALL]):
                found.append(_large(fp[s:e], flip[s:e], close, most) + s)
            pairs = np.concatenate(found, axis=1)
            if pairs.shape[1]:
                rows = [np.ascontiguousarray(fp[x]).view("V16").ravel() for x in pairs]
                data = np.unique(np.stack(rows, 1).view("V32").ravel()).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data[i + o : i + o + 16] for i in range(0, len(data), 32)], pa.binary()) for o in (0, 16)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _lanes(batch.column(2))))
            if sum(len(c[0]) for c in held) < 200_000:
                continue
            bucket, cell, fp = (np.concatenate(c) for c in zip(*held))
            cut = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield from links(bucket[:cut], cell[:cut], fp[:cut])
            held = [(bucket[cut:], cell[cut:], fp[cut:])]
        if held and len(held[0][0]):
            yield from links(*(np.concatenate(c) for c in zip(*held)))

    return meet


def _dealt(nodes: DataFrame) -> DataFrame:
    """``bucket, cell`` and the columns of ``nodes`` (``fp`` and others), sorted by the first two: what each bucket compares."""
    looks = nodes.mapInArrow(_wide_looks, f"bucket long, {', '.join(f'{c} {kind}' for c, kind in nodes.dtypes)}".replace("bigint", "long"))
    # Hot buckets are dealt out over cells of pairs of parts. A bucket's looks are the rows of its own ball.
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(WIDE[0][1])))
    n_seg = len(WIDE)
    own = nodes.select("fp").mapInArrow(_wide_own, "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    dense = own.filter(F.col("n") * (WIDE[0][1] + 1) > CELL).select(F.explode(F.transform(flips, lambda x: F.floor(F.col("bucket") / n_seg).bitwiseXOR(x) * n_seg + F.pmod("bucket", F.lit(n_seg)))).alias("bucket"), "n")
    hot = durable(dense.groupBy("bucket").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("parts")).filter("parts > 1"), "hot-buckets")
    cell = F.lit(0)
    if n_hot := hot.limit(50_001).count():
        looks = looks.join(F.broadcast(hot) if n_hot <= 50_000 else hot, "bucket", "left")
        parts = F.coalesce("parts", F.lit(1))
        part = F.pmod(F.xxhash64("fp"), parts).cast("int")
        cell = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(part, j) * 65_536 + F.greatest(part, j)))
    return looks.select("bucket", cell.alias("cell"), *nodes.columns).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")


def _judged(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """``a, b, alike``: whether the shingle sets in ``grams`` (``long, grams``) have that Jaccard similarity."""
    sides = [grams.select(F.col("long").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b")]
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    alike = both / (F.size("grams_a") + F.size("grams_b") - both) >= similarity
    # sets of too different sizes aren't compared
    close = F.least(F.size("grams_a"), F.size("grams_b")) / F.greatest(F.size("grams_a"), F.size("grams_b")) >= similarity
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", F.coalesce(F.when(close, alike), F.lit(False)).alias("alike"))


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1  # values of one set count for nothing
    row, at = row[many[at] > 1], place[at[many[at] > 1]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[i:j], at[i:j] - lo] = 1
        out += has[left] @ has[right].T
    return out


def _alike(similarity: float, most: int):
    """Links with the components of all similar pairs of one cell: of its two parts, or of its only one."""

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        fp, sets = np.frombuffer(b"".join(cell["long"]), "<u8").reshape(len(cell), -1), [np.asarray(g, np.int64) for g in cell["grams"]]
        group, size = pd.factorize(cell["group"])[0], np.array([len(s) for s in sets])
        left, right = np.flatnonzero(cell["first"]), np.flatnonzero(~cell["first"])
        right = right if len(right) else left
        apart = np.stack([np.bitwise_count(fp[right] ^ fp[i]).sum(1, dtype=np.int64) for i in left])
        ratio = np.minimum(size[left][:, None], size[right]) / np.maximum(np.maximum(size[left][:, None], size[right]), 1)
        near = (apart <= most) & (group[left][:, None] != group[right]) & (ratio >= similarity)
        a, b = left[near.any(1)], right[near.any(0)]
        near = near[near.any(1)][:, near.any(0)]
        if near.size:
            both = _shared(sets, a, b)
            near &= both / np.maximum(size[a][:, None] + size[b] - both, 1) >= similarity
        i, j = np.nonzero(near)
        a, b = forest(a[i], b[j]) if len(i) else (a[:0], a[:0])
        return pd.DataFrame({"a": [fp[x].tobytes() for x in a], "b": [fp[x].tobytes() for x in b]})

    return links


def _second_look(nodes: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: verified links with the components of all similar pairs of ``nodes`` (``long, root, group``) that share a root but no group.

    A root's texts are dealt over parts of about PART; a pair of parts is a cell, which compares shingle sets where they are, so no
    pair of texts is written out. A group larger than a part has parts of its own, which aren't compared with one another.
    """
    sizes = durable(nodes.groupBy("root", "group").agg(F.count("*").alias("n")), "open-groups")
    small = sizes.filter(F.col("n") <= PART).groupBy("root").agg(F.sum("n").alias("n_small"))
    sizes = join_checked(sizes, small, ["root"], "left")
    large = F.col("n") > PART
    own = F.struct(F.coalesce(F.when(large, F.col("group")), F.lit(0)).alias("of"), large.alias("large"), F.pmod(F.when(large, F.xxhash64("long")).otherwise(F.xxhash64("group")), F.ceil(F.when(large, F.col("n")).otherwise(F.col("n_small")) / PART)).alias("i"))
    dealt = durable(join_checked(nodes, sizes, ["root", "group"]).select("root", "group", "long", own.alias("part")), "open-dealt")
    parts = durable(dealt.select("root", "part").distinct(), "open-parts")
    pairs = parts.join(parts.select("root", F.col("part").alias("other")), "root").filter("part <= other AND NOT (part.large AND other.large AND part.of = other.of)")
    cell = F.xxhash64("root", "part", "other").alias("cell")
    firsts = pairs.select("root", "part", cell, F.lit(True).alias("first"))
    seconds = pairs.filter("part < other").select("root", F.col("other").alias("part"), cell, F.lit(False).alias("first"))
    cells = durable(firsts.unionByName(seconds), "open-cells")
    rows = dealt.join(grams, "long").join(cells, ["root", "part"]).select("cell", "first", "group", "long", "grams")
    return rows.groupBy("cell").applyInPandas(_alike(similarity, wide_distance(similarity, WIDE_BITS, 3)), "a binary, b binary")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text_, root``: a row for each row of ``docs``, with 16 bytes for its text; similar texts share a root, directly
    or over others."""

    @F.pandas_udf("binary")
    def wide(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield texts.map(lambda t: wide_fingerprint(t, shingle))

    @F.pandas_udf("array<long>")
    def grams_of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield texts.map(lambda t: np.unique(np.frombuffer(b"".join(_digests(t, shingle)), "<i8")[::2]))

    prints = durable(docs.select("doc_id", _text_key().alias("text_"), wide("text").alias("long")), "wide-fingerprints")
    # texts with the same complete fingerprint are one
    distinct = durable(prints.groupBy("long").agg(F.min("text_").alias("text_")).withColumn("fp", F.substring("long", 1, HEAD_BITS // 8)), "distinct-fingerprints")
    heads = durable(distinct.groupBy("fp").agg(F.min("long").alias("first")), "heads")
    close, most = (wide_distance(similarity, HEAD_BITS, e) for e in (-1, 2))
    met = _dealt(heads.select("fp")).mapInArrow(_wide_meet(close, most), "a binary, b binary").distinct()
    for c in ("a", "b"):
        met = met.join(heads.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    same = distinct.join(heads, "fp").filter("long <> first").select(F.col("first").alias("a"), F.col("long").alias("b"))
    pairs = durable(met.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).unionByName(same), "wide-pairs")
    nodes = pairs.select(F.col("a").alias("long")).unionByName(pairs.select(F.col("b").alias("long"))).distinct()
    wanted = durable(distinct.join(nodes, "long").select("text_", "long"), "linked-texts")
    texts = join_checked(docs.select(_text_key().alias("text_"), "text"), wanted, ["text_"]).withColumn("grams", grams_of("text"))
    grams = durable(texts.groupBy("long").agg(F.first("grams").alias("grams")), "linked-shingles")
    judged = durable(_judged(pairs, grams, similarity), "wide-links")
    links = judged.filter("alike").select("a", "b")
    failed = judged.filter("not alike")
    if not failed.isEmpty():
        # A link that failed may have displaced a real one: where one did, all pairs that aren't joined yet are compared.
        joined = components(judged.select("a", "b"))
        open_ = joined.join(failed.select(F.col("a").alias("id")).join(joined, "id").select("root").distinct(), "root")
        groups = components(links).select("id", F.col("root").alias("group"))
        open_ = open_.join(groups, "id", "left").select(F.col("id").alias("long"), F.xxhash64("root").alias("root"), F.xxhash64(F.coalesce("group", "id")).alias("group"))
        links = links.unionByName(durable(_second_look(durable(open_, "open-texts"), grams, similarity), "more-links"))
    roots = components(links).select(F.col("id").alias("long"), "root")
    return prints.join(roots, "long", "left").select("doc_id", "text_", F.coalesce("root", "long").alias("root"))


def _wide_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, batch in enumerate(_wide_looks(batches)):
        if i % (WIDE[0][1] + 1) == 0:
            yield batch.select(["bucket"])


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-copies: of each group the row with the smallest id stays, of equal rows one; null ids come last."""
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_").alias("r")
    first = similar_groups(docs, shingle, similarity).groupBy("root").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_")
    keys = [unused(docs, c) for c in ("no_id_", "id_", "text_")]
    kept = durable(first.select(*(c.alias(k) for k, c in zip(keys, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_"))))), "representatives")
    met = docs.withColumns(dict(zip(keys, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), _text_key())))).join(kept, keys)
    place = unused(docs, "place_")  # of equal rows
    met = met.withColumn(place, F.row_number().over(Window.partitionBy(keys).orderBy(keys[1])))
    return met.filter(F.col(place) == 1).select(docs.columns)
