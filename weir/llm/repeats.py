"""Windows of a fixed number of tokens (bytes or words): their anchors, for both substring operators, and what of them repeats.

A window's anchor is its gram with the least hash: equal windows have the same one at the same place, and one anchor serves a run
of windows, so there is one row for each run (``anchors``). A run that is there twice as a whole is settled: all its windows
repeat (``settle``). Only runs that share their anchor with others but not the whole, as at the edges of a repeated passage,
have to be looked at closer. ``confirm``, for words, cuts them into narrower classes of windows, which have a longer stretch in
common, and of those the ones that are still open into single windows; for bytes, ``suffixes`` sorts them. All steps are counts
and joins over rows of a few bytes; a passage that very many texts share is counted before the shuffle. Windows are named by
128 bits of two polynomial hashes.

Defined cases: a null text has no windows; very long texts are read in parts that overlap by a window; grams that tie count by
place; repeated rows have the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import discard, durable

#: Tokens handled at once, and the bits that number their places.
CHUNK, PLACE_BITS = 1 << 19, 21
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_bytes = np.random.default_rng(2024).integers(0, 1 << 63, (2, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        rows = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            rows.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = (rows[0], rows[1])
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def sums(tokens: np.ndarray, base: int) -> np.ndarray:
    p, _ = powers(base, len(tokens) + 1)
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * p[: len(tokens)], out=out[1:])
    return out


def slices(total: np.ndarray, base: int, at: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hashes of token slices from running sums; slices of equal tokens are equal wherever they lie."""
    _, inverse = powers(base, len(total))
    return mixed((total[ends] - total[at]) * inverse[at])


@dataclass(frozen=True)
class Kind:
    """unit: bytes or words; length: tokens of a window; gram: tokens of the first digit; width: windows of a class."""

    unit: str
    length: int
    gram: int
    width: int

    def load(self, text: str) -> np.ndarray:
        """A text's tokens in a compact form; ``values`` gives the tokens of a part of it."""
        data = text.encode()
        return np.frombuffer(data, np.uint8) if self.unit == "bytes" else word_hashes(data)[1]

    def values(self, part: np.ndarray) -> np.ndarray:
        return _bytes[0][part] if self.unit == "bytes" else part

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit tokens of the texts one after the other, and how many each has."""
        data = [t.encode() for t in texts]
        if self.unit == "bytes":
            return _bytes[0][np.frombuffer(b"".join(data), np.uint8)], np.array([len(d) for d in data], np.int64)
        out, counts = [], np.zeros(len(data), np.int64)
        some: list[int] = []
        size = 0
        for i, d in enumerate(data):
            some.append(i)
            size += len(d) + 1
            if size >= CHUNK or i == len(data) - 1:
                joined = b" ".join(data[k] for k in some)
                starts, hashes = word_hashes(joined)
                limits = np.cumsum([len(data[k]) + 1 for k in some])
                counts[some] = np.diff(np.searchsorted(starts, limits), prepend=0)
                out.append(hashes)
                some, size = [], 0
        return np.concatenate([*out, np.zeros(0, np.uint64)]), counts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words, and a hash of each, in slices cut between words."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + CHUNK)
        if hi < len(raw):
            gaps = np.flatnonzero(SPACES[raw[lo:hi]])
            while not len(gaps) and hi < len(raw):  # a word longer than a slice
                hi = min(len(raw), hi + CHUNK)
                gaps = np.flatnonzero(SPACES[raw[lo:hi]])
            hi = lo + gaps[-1] + 1 if len(gaps) and hi < len(raw) else hi
        part = raw[lo:hi]
        space = SPACES[part]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h = slices(sums(_bytes[0][part], BASES[0]), BASES[0], a, b) ^ (slices(sums(_bytes[1][part], BASES[1]), BASES[1], a, b) * np.uint64(3))
        starts.append(a + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, np.uint64)])


@dataclass
class Piece:
    """Tokens of some texts, or of a part of a long one. text, first: of each token's text its number and its first place here;
    base: place of the first token in its text."""

    tokens: np.ndarray
    text: np.ndarray
    first: np.ndarray
    base: int
    starts: np.ndarray

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.first[at] + self.base


def pieces(kind: Kind, texts: list[str]) -> Iterator[Piece]:
    """Pieces of about CHUNK tokens with the starts of all windows; parts of a long text overlap by a window."""
    some: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t)
        if size < CHUNK and i < len(texts) - 1:
            continue
        tokens, counts = kind.tokens([texts[k] for k in some])
        group = np.repeat(np.array(some), counts)
        ends = np.cumsum(counts)
        if len(tokens) <= CHUNK + CHUNK // 4:
            first, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
            yield Piece(tokens, group, first, 0, np.flatnonzero(end - np.arange(len(tokens)) >= kind.length))
        else:
            for k, lo, hi in zip(some, ends - counts, ends):
                for a in range(lo, hi, CHUNK):
                    part = tokens[a : min(hi, a + CHUNK + kind.length - 1)]
                    yield Piece(part, np.full(len(part), k), np.zeros(len(part), np.int64), a - lo, np.arange(max(0, len(part) - kind.length + 1)))
        some, size = [], 0


def least_grams(kind: Kind, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's gram with the least hash, and the hashes of all grams."""
    total = sums(piece.tokens, BASES[0])
    n, k = len(piece.tokens), kind.gram
    hashes = slices(total, BASES[0], slice(0, n - k + 1), slice(k, n + 1))
    places = np.uint64((1 << PLACE_BITS) - 1)
    key = (mixed(hashes) & ~places) | np.arange(len(hashes), dtype=np.uint64)
    w = kind.length - k + 1  # the least of each w in a row: of a block's rest and the next one's beginning
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    begin = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    s = piece.starts
    return (np.minimum(rest[s], begin[s + w - 1]) & places).astype(np.int64), hashes


def parted(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds fewer texts as Python objects at once."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def text_key(text: str = "text"):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def short_key():
    """16 bytes that stand for a text within the passes here."""
    return F.substring(text_key(), 1, 16).alias("key")


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """``key, place, start, stop, core, block``: a row for each run of windows of a text that share their first digit.

    place: of the gram; start, stop: of the run's tokens; core: the first digit; block: a hash of all of the run.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            for piece in pieces(kind, texts):
                s = piece.starts
                if not len(s):
                    continue
                least, hashes = least_grams(kind, piece)
                cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (s[1:] != s[:-1] + 1)]))
                lo, hi, at = s[cut], s[np.append(cut[1:], len(s)) - 1], least[cut]
                block = run_hash(sums(piece.tokens, BASES[1]), at, lo, hi + kind.length)
                numbers = [piece.place(at), piece.place(lo), piece.place(hi) + kind.length, hashes[at].view(np.int64), block.view(np.int64)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(piece.text[lo])), *map(pa.array, numbers)], ["key", "place", "start", "stop", "core", "block"])

    return docs.filter("text is not null").select(short_key(), "text").mapInArrow(find, "key binary, place long, start long, stop long, core long, block long")


def with_texts(docs: DataFrame, info: DataFrame) -> DataFrame:
    """Each distinct text that ``info`` (``key`` and more) is about, as a table in its place."""
    texts = docs.filter("text is not null").select(short_key(), "text").dropDuplicates(["key"])
    texts = durable(texts.join(info, "key"), "texts", compression="zstd")
    discard(info)
    return texts


def sharing(found: DataFrame, cores: DataFrame) -> DataFrame:
    """The rows of ``found`` whose core is in ``cores``, as a table in place of ``found``."""
    rows = durable(found.join(cores.select("core"), "core", "left_semi"), "runs")
    discard(found)
    return rows


def run_hash(total: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of runs of tokens with the place of the gram in them."""
    return mixed(slices(total, BASES[1], start, stop) + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def settle(rows: DataFrame, more: list[str], name: str) -> DataFrame:
    """What of ``rows`` (key, start, stop, core, block, weight and ``more``) repeats as a whole (``hit``) and what has to be looked at closer (``open``).

    Rows with the same core may share windows. If the whole block is there twice, so are all its windows. A core with several blocks,
    one of them single, stays open, with one row of each block.
    """
    which = F.xxhash64("key", "start")
    blocks = durable(rows.groupBy("core", "block").agg(F.sum("weight").alias("n"), F.min(which).alias("one")), f"{name}-blocks")
    several = blocks.groupBy("core").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("single"))
    several = durable(several.filter("m > 1 and single > 0").select("core", F.lit(True).alias("mixed")), f"{name}-mixed")
    told = blocks.join(several, "core", "left").filter("n > 1 or mixed")
    told = durable(told.select("core", "block", F.col("n").alias("n_same"), "one", F.coalesce("mixed", F.lit(False)).alias("mixed")), f"{name}-told")
    met = rows.join(told, ["core", "block"])
    is_open = F.col("mixed") & (which == F.col("one"))
    met = met.withColumn("hit", (F.col("n_same") > 1) & (F.col("weight") == 1)).withColumn("open", is_open).filter("hit or open")
    kept = [F.when(F.col("open"), F.col(c)).alias(c) for c in more]
    out = durable(met.select("key", "start", "stop", "core", "hit", "open", F.least("n_same", F.lit(2)).alias("weight"), *kept), f"{name}-settled")
    for old in (blocks, several, told):
        discard(old)
    return out


def _classes(kind: Kind, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The open runs of some texts cut into classes of up to ``kind.width`` windows, by their distance from the gram.

    All windows of a class have a stretch of tokens in common whatever run they are from: its hash is the core. ``names`` are 64-bit
    hashes of the windows, packed in the order of their starts.
    """
    some: list[dict] = []
    size = 0
    for i, r in enumerate(rows):
        some.append(r)
        size += len(r["text"])
        if size < CHUNK and i < len(rows) - 1:
            continue
        data = [kind.load(r["text"]) for r in some]
        first = np.cumsum([0, *map(len, data)])[:-1]
        data = np.concatenate(data)
        owner = np.repeat(np.arange(len(some)), [len(r["open"]) for r in some])
        runs = np.array([(x["place"], x["start"], x["stop"], x["weight"]) for r in some for x in r["open"]], np.int64).reshape(-1, 4)
        runs[:, :3] += first[owner][:, None]
        order = np.argsort(runs[:, 1], kind="stable")
        runs, owner = runs[order], owner[order]
        lo = 0
        while lo < len(runs):
            hi = int(np.searchsorted(runs[:, 1], runs[lo, 1] + CHUNK, "right"))
            begin = int(runs[lo, 1])
            yield _cut(kind, kind.values(data[begin : int(runs[lo:hi, 2].max())]), runs[lo:hi] - np.array([begin, begin, begin, 0]), owner[lo:hi], begin - first, some)
            lo = hi
        some, size = [], 0


def _cut(kind: Kind, tokens: np.ndarray, runs: np.ndarray, owner: np.ndarray, shift: np.ndarray, rows: list[dict]) -> pa.RecordBatch:
    w, length = kind.width, kind.length
    place, start, stop, weight = runs.T
    near, far = place - (stop - length), place - start  # least and most distance of a window's start
    each = far // w - near // w + 1
    row = np.repeat(np.arange(len(runs)), each)
    c = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + (near // w)[row]
    e_lo, e_hi = np.maximum(c * w, near[row]), np.minimum(c * w + w - 1, far[row])
    at = place[row]
    one, two = sums(tokens, BASES[0]), sums(tokens, BASES[1])
    core = mixed(slices(one, BASES[0], at - c * w, at - c * w - w + 1 + length) + (c + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    block = run_hash(two, at, at - e_hi, at - e_lo + length)
    many = e_hi - e_lo + 1
    upto = np.cumsum(many)
    starts = np.arange(upto[-1]) - np.repeat(upto - many, many) + np.repeat(at - e_hi, many)
    packed = slices(two, BASES[1], starts, starts + length).tobytes()
    names = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], upto * 8]).astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
    text = owner[row]
    keys = pa.array([r["key"] for r in rows], pa.binary()).take(pa.array(text))
    return pa.RecordBatch.from_arrays([keys, pa.array(at - e_hi + shift[text]), pa.array(at - e_lo + length + shift[text]), pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), pa.array(weight[row]), names], ["key", "start", "stop", "core", "block", "weight", "names"])


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def confirm(docs: DataFrame, found: DataFrame, kind: Kind, kept: Callable[[str, list[tuple[int, int]]], bytes]) -> DataFrame:
    """``key, spans, kept``: for each distinct text with repeated windows the token spans ``[start, stop)`` that they cover and what is left.

    found: the anchors whose first digit repeats.
    """
    runs = settle(found.withColumn("weight", F.lit(1).cast("long")), ["place"], "runs")
    whole = F.collect_set(F.when(F.col("hit"), F.struct("start", "stop"))).alias("whole")
    is_open = F.collect_set(F.when(F.col("open"), F.struct("place", "start", "stop", "weight"))).alias("open")
    info = durable(runs.groupBy("key").agg(whole, is_open), "run-info")
    discard(runs)
    texts = with_texts(docs, info)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            yield from _classes(kind, batch.to_pylist())

    rows = texts.filter(F.size("open") > 0).select("key", "text", "open").mapInArrow(classes, "key binary, start long, stop long, core long, block long, weight long, names binary")
    rows = durable(rows, "classes")
    closer = settle(rows, ["names"], "classes")
    discard(rows)
    name = F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("names") / 8).cast("int") - 1), lambda i: F.substring("names", i * 8 + 1, F.lit(8)))).alias("i", "name")
    windows = closer.filter("open").select("key", "start", "core", "weight", name).select("key", (F.col("start") + F.col("i")).alias("start"), "core", "name", "weight")
    windows = durable(windows, "windows")
    again = durable(windows.groupBy("core", "name").agg(F.sum("weight").alias("n")).filter("n > 1").select("core", "name"), "windows-again")
    single = windows.filter("weight = 1").join(again, ["core", "name"], "left_semi").select("key", "start", (F.col("start") + kind.length).alias("stop"))
    spans = _spans(closer.filter("hit").select("key", "start", "stop").unionByName(single))

    return marked(texts.select("key", "text", "whole").join(spans, "key", "left"), kept)


def marked(texts: DataFrame, kept: Callable[[str, list[tuple[int, int]]], bytes]) -> DataFrame:
    """``key, spans, kept`` from ``key, text, whole, spans``: the whole runs and other spans of a text as one set of maximal spans."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            out = []
            for r in batch.to_pylist():
                merged: list[tuple[int, int]] = []
                for s in sorted((x["start"], x["stop"]) for x in [*r["whole"], *(r["spans"] or ())]):
                    if merged and merged[-1][1] >= s[0]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                    else:
                        merged.append(s)
                if merged:
                    out.append({"key": hashlib.sha256(r["text"].encode()).digest(), "spans": [{"start": a, "stop": b} for a, b in merged], "kept": kept(r["text"], merged)})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("key", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    return texts.mapInArrow(mark, "key binary, spans array<struct<start:long,stop:long>>, kept binary")
