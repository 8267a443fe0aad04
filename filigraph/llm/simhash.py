"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``distance`` bits
differ in few bits of some segment, so small Hamming balls are enumerated within the segments, matches
are fetched from the table of segment values, and complete distances are verified. Verified
links become connected components by rounds of star contraction over written tables.

For a similarity of word runs that lies far above a few bits of 64 (:func:`drop_near_copies`), wider fingerprints are cut into as
many segments, and what they find is verified on the runs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, discard, keep_rows, look_up, sized, small_batches, text_key, text_or_empty

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 65_536


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no words."""
    data = b" ".join(text.encode().translate(LOWER).split())
    if not data:
        return 0
    bounds = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(bounds + 1).tolist()], [*bounds.tolist(), len(data)]
    if len(starts) <= shingle:
        return xxhash.xxh64_intdigest(data, seed)
    digest, total = xxhash.xxh64_intdigest, len(starts) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        pairs = zip(starts[at : min(at + _BLOCK, total)], ends[at + shingle - 1 :])
        hashes = np.array([digest(data[a:b], seed) for a, b in pairs], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), one row per input row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def segmentation(fingerprints_count: int, distance: int, bucket: int = 4096) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment: as many segments as keep a table value's mean bucket small.

    If no segment i differed in ``radius`` i bits or fewer, the whole would differ in more than
    ``distance`` bits: the radii and the number of segments add up to ``distance`` + 1 or more.
    """
    count = 4
    while count > 1 and fingerprints_count / 2 ** (64 // count) > bucket:
        count -= 1
    base, extra = divmod(distance, count)
    bits = [64 // count + (i < 64 % count) for i in range(count)]
    shifts = [sum(bits[i + 1 :]) for i in range(count)]
    return [(s, b, base if i <= extra else base - 1) for i, (s, b) in enumerate(zip(shifts, bits))]


def ball(bits: int, radius: int) -> np.ndarray:
    """The masks of all values within ``radius`` of zero, zero first."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(masks, np.uint64)


def _probes(distinct: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(slot, value, probe, fp, rep): table entries (probe 0) and the other values of each ball (probe 1).

    Of two different values of one segment only the lower is looked up from the higher, which finds the pair once.
    """

    def enumerate_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 8192):
                batch = big.slice(at, 8192)
                fp, rep = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
                for slot, (shift, bits, radius) in enumerate(plan):
                    if radius < 0:
                        continue
                    own = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    near = own[:, None] ^ ball(bits, radius)[None, :]
                    keep = near <= own[:, None]
                    rows, cols = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), slot, np.int32)), pa.array(near[keep].view(np.int64)),
                            pa.array((cols > 0).astype(np.int32)), pa.array(fp[rows].view(np.int64)), pa.array(rep[rows]),
                        ],
                        ["slot", "value", "probe", "fp", "rep"],
                    )

    return distinct.mapInArrow(enumerate_balls, "slot int, value long, probe int, fp long, rep long")


def verified_links(fp: np.ndarray, rep: np.ndarray, entries: int, distance: int) -> list[tuple[int, int]]:
    """Links that span the near pairs of one bucket, whose first ``entries`` places are table entries.

    All entries meet each other and all probes meet the entries, in blocks of a million pairs at
    most; of the pairs that pass the complete distance only one for each two groups is kept, so a
    bucket of near copies needs memory and gives links by its size, not by its square.
    """
    group, links, width = np.arange(len(fp)), [], max(1, 1_000_000 // max(1, entries))
    table = fp[:entries]
    for at in range(0, len(fp), width):
        near = np.bitwise_count(fp[at : at + width, None] ^ table[None, :]) <= distance
        if at < entries:
            near &= np.arange(entries)[None, :] < np.arange(at, at + len(near))[:, None]
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            i, hits = at + row, np.flatnonzero(near[row])
            others, first = np.unique(group[hits], return_index=True)
            for other, k in zip(others.tolist(), first.tolist()):
                own = int(group[i])
                if own != other:
                    links.append((int(rep[i]), int(rep[hits[k]])))
                    group[group == max(own, other)] = min(own, other)
    return links


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): links found within each bucket (slot, value). Buckets stream through sorted partitions."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if not part.shape[1]:
                continue
            held.append(part)
            ends = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1]))
            if len(held) > 1 and (held[-2][:2, -1] != part[:2, 0]).any() or len(ends):
                last = int(ends[-1]) + 1 if len(ends) else 0
                yield from buckets(np.concatenate([*held[:-1], part[:, :last]], axis=1))
                held = [part[:, last:]]
        if held:
            yield from buckets(np.concatenate(held, axis=1))

    def buckets(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])) + 1
        starts = np.concatenate([[0], change]).astype(np.int64)
        ends = np.concatenate([change, [part.shape[1]]]).astype(np.int64)
        tables = np.add.reduceat(part[2] == 0, starts) if part.shape[1] else np.zeros(0, np.int64)
        found: list[tuple[int, int]] = []
        fp, rep = part[3].view(np.uint64), part[4]
        for k in np.flatnonzero((tables > 0) & (ends - starts > 1)).tolist():
            found += verified_links(fp[starts[k] : ends[k]], rep[starts[k] : ends[k]], int(tables[k]), distance)
        links = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    dealt = rows.repartition("slot", "value").sortWithinPartitions("slot", "value", "probe")
    return dealt.mapInArrow(search, "a long, b long")


def _ball_links(heavy: DataFrame, distance: int) -> DataFrame:
    """(a, b): links of the fingerprints of very large buckets, by balls of half the distance over all 64 bits.

    Any two fingerprints within ``distance`` share a point of the smaller ball (side 0) of one and the larger of the other, and those that share
    one so are within it. Each point's lowest fingerprint of side 0, linked to all others of the point, spans these pairs in linear space.
    """
    low, high = ball(64, distance // 2), ball(64, distance - distance // 2)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                batch = big.slice(at, 64)
                fp, rep = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
                for side, masks in ((0, low),) if len(low) == len(high) else ((0, low), (1, high)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((fp[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.full(len(fp) * len(masks), side, np.int32)), pa.array(np.repeat(rep, len(masks)))],
                        ["point", "side", "rep"],
                    )

    at = heavy.mapInArrow(points, "point long, side int, rep long")
    least = at.where("side = 0").groupBy("point").agg(F.min("rep").alias("a"))
    return at.join(least, "point").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def links(distinct: DataFrame, distance: int = 4, heavy_bucket: int = 65_536) -> DataFrame:
    """(a, b): links between representatives that span all pairs of fingerprints at ``distance`` or fewer bits.

    ``distinct`` has one row (fp, rep) per fingerprint and is read several times. Buckets of more
    than ``heavy_bucket`` table entries are solved by :func:`_ball_links`; no bucket is capped.
    """
    plan = segmentation(distinct.count(), distance)
    probes = _probes(distinct, plan)
    entries = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), _segment(s, b).alias("value")) for i, (s, b, r) in enumerate(plan) if r >= 0])).alias("at"), "fp", "rep"
    ).select("at.*", "fp", "rep")
    heavy = cut(entries.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_bucket).select("slot", "value"), "heavy_buckets")
    if heavy.isEmpty():
        return _bucket_links(probes, distance)
    in_heavy = probes.join(heavy, ["slot", "value"], "left_semi").select("fp", "rep").distinct()
    return _bucket_links(probes.join(heavy, ["slot", "value"], "left_anti"), distance).unionByName(_ball_links(in_heavy, distance))


def _segment(shift: int, bits: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Alternates the large-star and small-star contractions until every node hangs on the least node of its component; each round is written to
    the shared folder. The least neighbours meet the edges by broadcast while there are few edges, so a hub's edges stay where they are; beyond, by a
    shuffle whose hubs adaptive execution splits. Edges must not be null.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state, rows = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sized(least, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(least, rows), "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        before, edges = edges, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, rows = now, now["n"]
    raise RuntimeError("the components did not settle")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Null texts are empty; texts without words share the fingerprint zero, which links like any
    other. Rows without an id make no links and have a null component. Repeated rows stay. An empty input gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct_fingerprints")
    joined = components(links(distinct.where(F.col("rep").isNotNull()).drop("n"), distance))
    labels = distinct.join(joined, distinct["rep"] == joined["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"), "n"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return look_up(prints, cut(labels, "labels"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


# --- near copies by the similarity of their runs of words -----------------------------------------


def _mixed(x: np.ndarray, mask: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each value, of another kind for each mask and factor."""
    x = (x ^ mask) * factor
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """The sorted 64-bit hashes of all runs of ``shingle`` words; a shorter text is one run, one without words the empty run."""

    def __init__(self, shingle: int, remembered: int = 100_000):
        self.shingle, self.remembered, self.seen = shingle, remembered, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().translate(LOWER).split()
        if len(words) < self.shingle:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
        if len(self.seen) > self.remembered:
            self.seen.clear()
        seen = self.seen
        seen.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in seen)
        hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        total = np.zeros(len(words) - self.shingle + 1, np.uint64)
        for k in range(self.shingle):
            total = _mixed(total + hashes[k : k + len(total)], np.uint64(k), np.uint64(0x9E3779B97F4A7C15))
        return np.unique(total)


def ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (of 64-bit words) have each bit. Many rows are first added in thirds, sums and carries."""
    if len(rows) <= 256:
        bits = np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1)
        return bits.sum(0, dtype=np.uint16).astype(np.int64)
    third = len(rows) // 3
    a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
    half = a ^ b
    return ones(np.concatenate([half ^ c, rows[3 * third :]])) + 2 * ones((a & b) | (half & c))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of ``words`` times 64 bits over a set of run hashes, most significant word first."""
    draw = np.random.default_rng(42)
    masks, factors = draw.integers(0, 2**64, words, np.uint64), draw.integers(0, 2**64, words, np.uint64) | np.uint64(1)
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        total += ones(_mixed(hashes[at : at + 4096, None], masks, factors))
    return np.packbits(total * 2 > len(hashes)).view(">u8").astype(np.uint64)


@dataclass(frozen=True)
class WidePlan:
    """``segments`` of ``bits`` bits, each with a ball of one bit, and the ``reach`` of complete distances (of 128 bits)."""

    bits: int
    segments: int
    prefix: int
    reach: int

    @property
    def words(self) -> int:
        return max(2, -(-self.bits * self.segments // 64))


def wide_plan(texts: int, similarity: float, missed: float = 2e-4, group: int = 1 << 18) -> WidePlan:
    """As many bits a segment as tell ``texts`` apart, and as many segments as miss a pair at ``similarity`` with a chance of ``missed``.

    Two sets of Jaccard similarity s and one size differ in a bit with the chance acos(2 s / (1 + s)) / pi. Entries of a segment
    are dealt by the first ``prefix`` bits of its value, so that a task holds about ``group`` of them.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(40, max(12, math.ceil(math.log2(max(2, texts)))))
    hit = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = math.ceil(math.log(missed) / math.log(1 - hit))
    prefix = min(bits - 1, max(0, math.ceil(math.log2(max(1, texts) / group))))
    return WidePlan(bits, segments, prefix, math.ceil(128 * p + 4.5 * math.sqrt(128 * p * (1 - p))))


def _segments(prints: np.ndarray, plan: WidePlan) -> np.ndarray:
    """(text, segment) values of ``plan.bits`` bits."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
    cut_bits = bits[:, : plan.bits * plan.segments].reshape(len(prints), plan.segments, plan.bits).astype(np.int64)
    return cut_bits @ (np.int64(1) << np.arange(plan.bits - 1, -1, -1, dtype=np.int64))


_ENTRY = np.dtype([("value", "<i8"), ("key", "<i8"), ("a", "<u8"), ("b", "<u8")])


def near_entries(entries: np.ndarray, probes: np.ndarray, bits: int, reach: int, block: int = 1 << 17) -> list[tuple[int, int]]:
    """Links that span the pairs of entries whose values differ in one bit of ``bits`` at most, and of probes and entries of one value, within ``reach`` of 128 bits.

    Pairs are looked up and compared in blocks of about ``block``, and those of one group are not compared further,
    so memory and links grow with the entries, not with the pairs.
    """
    entries = np.sort(entries, order=("value", "key"))
    everything = np.concatenate([entries, probes])
    group = np.arange(len(everything))
    links: list[tuple[int, int]] = []
    value = entries["value"]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def compare(left: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Entries or probes ``left``, each with the entries from ``low`` to ``high``."""
        count = np.maximum(high - low, 0)
        some = np.flatnonzero(count)
        left, low, count = left[some], low[some], count[some]
        ends = np.cumsum(count)
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            i = np.repeat(left[at:stop], count[at:stop])
            first = np.cumsum(count[at:stop]) - count[at:stop]
            j = np.arange(len(i)) - np.repeat(first - low[at:stop], count[at:stop])
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]
            distance = np.bitwise_count(everything["a"][i] ^ everything["a"][j]) + np.bitwise_count(everything["b"][i] ^ everything["b"][j])
            near = distance <= reach
            i, j = i[near], j[near]
            if len(i):
                _, once = np.unique(np.stack([group[i], group[j]]), axis=1, return_index=True)
                for x, y in zip(i[once].tolist(), j[once].tolist()):
                    a, b = root(x), root(y)
                    if a != b:
                        group[max(a, b)] = min(a, b)
                        if everything["key"][x] != everything["key"][y]:
                            links.append((int(everything["key"][x]), int(everything["key"][y])))
                while (flat := group[group]).tobytes() != group.tobytes():
                    group[:] = flat
            at = stop

    own = np.arange(len(entries))
    compare(own, np.searchsorted(value, value, "left"), own)
    for bit in range(bits):
        near = value ^ np.int64(1 << bit)
        lower = np.flatnonzero(near < value)
        compare(lower, np.searchsorted(value, near[lower], "left"), np.searchsorted(value, near[lower], "right"))
    compare(np.arange(len(entries), len(everything)), np.searchsorted(value, probes["value"], "left"), np.searchsorted(value, probes["value"], "right"))
    return links


def candidate_links(texts: DataFrame, plan: WidePlan, shingle: int) -> DataFrame:
    """(a, b): keys of ``texts`` (key, text) whose fingerprints share a ball of a segment and are within reach, spanning all such pairs.

    Each text sends a table entry to the task of each segment (and of the first bits of its value), and from the other values of the
    ball those that fall into a lower task; balls within a task are looked up there. Entries travel packed, 32 bytes each.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        low_bits = plan.bits - plan.prefix
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                prints = np.stack([wide_fingerprint(shingler(t), plan.words) for t in batch.column(1).to_pylist()])
                values = _segments(prints, plan)
                entry = np.zeros(len(prints), _ENTRY)
                entry["key"], entry["a"], entry["b"] = batch.column(0).to_numpy(zero_copy_only=False), prints[:, 0], prints[:, 1]
                parts: list[int] = []
                probes: list[int] = []
                packed: list[bytes] = []
                for slot in range(plan.segments):
                    value = values[:, slot]
                    for flip in (None, *range(low_bits, plan.bits)):
                        near = value if flip is None else value ^ np.int64(1 << flip)
                        sent = np.flatnonzero(near <= value)
                        entry["value"] = near & np.int64((1 << low_bits) - 1)
                        place = near[sent] >> np.int64(low_bits)
                        order = np.argsort(place, kind="stable")
                        for rows in np.split(sent[order], np.flatnonzero(np.diff(place[order])) + 1):
                            if len(rows):
                                parts.append((slot << plan.prefix) | int(near[rows[0]] >> np.int64(low_bits)))
                                probes.append(int(flip is not None))
                                packed.append(entry[rows].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(probes, pa.int32()), pa.array(packed, pa.binary())], ["part", "probe", "entries"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def found() -> pa.RecordBatch:
            entries, probes = (np.frombuffer(b"".join(h), _ENTRY) for h in held)
            links = np.array(near_entries(entries, probes, plan.bits - plan.prefix, plan.reach), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for part, probe, entries in zip(*[c.to_pylist() for c in batch.columns]):
                if part != at:
                    yield found()
                    at, held = part, ([], [])
                held[probe].append(entries)
        yield found()

    dealt = texts.mapInArrow(pack, "part long, probe int, entries binary").repartition(min(plan.segments << plan.prefix, 32_768), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(search, "a long, b long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spanning_links(keys: list[int], sets: list[np.ndarray], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links that span the pairs of two sides (or of one, if there is no other) at ``similarity`` or more: a group that a text has joined isn't compared further."""
    groups: list[list[int]] = []
    links = []
    two = len(set(sides)) > 1
    for i, own in enumerate(sets):
        joined, apart = [i], []
        for members in groups:
            for m in reversed(members):
                small, large = sorted((len(own), len(sets[m])))
                if not (two and sides[i] == sides[m]) and small >= similarity * large and jaccard(own, sets[m]) >= similarity:
                    links.append((keys[i], keys[m]))
                    joined = members + joined
                    break
            else:
                apart.append(members)
        groups = [*apart, joined]
    return links


def similar_links(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 400) -> DataFrame:
    """(a, b): keys of ``texts`` (key, text), one row a key, that span all pairs of a Jaccard similarity of ``similarity`` or more.

    Candidates form clusters. The texts of a cluster meet with their whole sets of runs, each set once; a
    cluster of more than ``block`` texts meets in pairs of blocks, so a task holds two blocks.
    """
    plan = wide_plan(texts.count(), similarity)
    joined = components(candidate_links(texts.select("key", "text"), plan, shingle))
    clusters = joined.select(F.col("component").alias("cluster"), F.col("node").alias("key"))
    clusters = cut(clusters.unionByName(joined.select(F.col("component").alias("cluster"), F.col("component").alias("key")).distinct()), "clusters")
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), blocks)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("low"), F.greatest(o, own).alias("high")))
    members = look_up(clusters, cut(sizes, "cluster_sizes"), "cluster").select("cluster", "key", own.alias("side"), F.explode(pair).alias("at")).select("cluster", "key", "side", "at.low", "at.high")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["key", "hashes"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])

        def found() -> pa.RecordBatch:
            links = np.array(spanning_links(*held, similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for *place, side, key, hashes in zip(*[c.to_pylist() for c in batch.columns]):
                if place != at:
                    yield found()
                    at, held = place, ([], [], [])
                for column, value in zip(held, (key, np.frombuffer(hashes, np.uint64), side)):
                    column.append(value)
        yield found()

    keys = clusters.select("key")
    sets = cut(texts.join(sized(keys, clusters.count()), "key", "left_semi").select("key", "text").mapInArrow(whole, "key long, hashes binary"), "shingle_sets")
    dealt = members.join(sets, "key").select("cluster", "low", "high", "side", "key", "hashes")
    return dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "key").mapInArrow(search, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all its columns; of each group of near copies the row with the smallest id stays.

    Near copies have ``similarity`` or more of their runs of ``shingle`` words in common (Jaccard); a group is all that their links reach, and texts without words
    are one group. Candidates come from wide fingerprints by multi-index hashing (:func:`wide_plan` states the chance to miss a pair at the very similarity), all links are
    verified on whole texts. Null texts are empty, rows without an id make no links. A verdict is of an id and its text,
    so another text with the same id has its own; of rows of one id in a group, and of rows that repeat id and text, one stays.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key")), "text_keys")
    keyed = docs.where(F.col(id_col).isNotNull()).select(text_key(text_col).alias("key"), text_or_empty(text_col).alias("text"))
    several = rows.where("doc_id is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    several = cut(several, "repeated_keys")
    repeats = several.count()
    if repeats:  # one text of each key
        alone = keyed.join(sized(several, repeats), "key", "left_anti")
        keyed = alone.unionByName(keyed.join(sized(several, repeats), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
    with small_batches(docs.sparkSession, 500):  # sets and packed entries are large rows
        joined = components(similar_links(keyed, shingle, similarity))
    labels = cut(joined.select(F.col("node").alias("key"), "component").unionByName(joined.select(F.col("component").alias("key"), "component").distinct()), "near_labels")
    in_groups = rows.where("doc_id is not null").join(labels.unionByName(several.join(labels, "key", "left_anti").select("key", F.col("key").alias("component"))), "key")
    in_groups = cut(in_groups, "near_copies")
    least = in_groups.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count(F.lit(1)).alias("n"))
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    verdicts = look_up(in_groups, cut(least, "least_ids"), "component").select("doc_id", "key", first.alias("stays"))
    nameless = rows.where("doc_id is null").select("doc_id", "key", F.lit(True).alias("stays"))
    return keep_rows(docs, verdicts.unionByName(nameless), id_col, text_col)
