"""Near-duplicate linking shared by the document and the line operators.

Nodes carry band keys of a MinHash signature. A bucket (nodes with one band key) is never expanded
into its pairs. Its members are filed under its smallest node, the hub, in blocks of bounded size
that each hold the hub too, and a block is compared in memory: only confirmed links leave it. After
components of these links, hubs with several blocks whose members lie in different components are
looked at again, block by block, where pairs inside one component need no comparison. Every link
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, discard, distinct, in_bitmap, key_bitmap, materialize, mix64, sliced, stored_bytes

#: Members of a hub, and bytes of their sets, per block.
BLOCK = 64
BLOCK_BYTES = 4 << 20
#: Up to so many pairs are compared one by one, more as products of matrices.
FEW = 16
#: Distinct hashes of a pair of blocks that are compared in one product.
COLUMNS = 8192
#: Hashes of many sets that are signed in one product.
SIGNED = 8192
#: Band keys that a task packs together, and about as many as one task gets to compare.
PACKED = 1 << 20
#: Bytes of payloads that are unpacked together, unless one block has more.
UNPACKED = 1 << 20


@dataclass(frozen=True)
class Banding:
    """MinHash shape for a Jaccard threshold of num / den."""

    num: int
    den: int
    rows: int
    bands: int

    @classmethod
    def for_threshold(cls, num: int, den: int, hashes: int, miss: float) -> Banding:
        """The most selective rows per band that lose a pair at the threshold with at most ``miss``."""
        t = num / den
        for rows in range(16, 0, -1):
            if (1 - t**rows) ** (hashes // rows) <= miss:
                return cls(num, den, rows, hashes // rows)
        raise ValueError("too few hashes for this threshold")

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def _factors(self) -> np.ndarray:
        """The hashes are random already, so odd factors alone reorder them."""
        rng = np.random.Generator(np.random.PCG64(0xB4D))
        return rng.integers(0, 2**32, (self.hashes, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def signer(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from 64-bit hashes to their signature (uint32)."""
        factors = self._factors()

        def sign(hashes: np.ndarray) -> np.ndarray:
            x = (hashes >> np.uint64(32)).astype(np.uint32)
            if len(x) <= 2048:
                return (x * factors).min(axis=1)
            out = np.full(self.hashes, 0xFFFFFFFF, dtype=np.uint32)
            for at in range(0, len(x), 2048):
                np.minimum(out, (x[at : at + 2048] * factors).min(axis=1), out=out)
            return out

        return sign

    def range_signer(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A function from 64-bit hashes and the starts and ends of ranges of them to (n, hashes) signatures.

        The same values as ``signer`` of each range. Ranges ascend, do not overlap and are not empty.
        """
        factors = self._factors()

        def sign(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.full((self.hashes, len(starts)), 0xFFFFFFFF, dtype=np.uint32)
            for low in range(0, len(hashes), SIGNED):
                x = (hashes[low : low + SIGNED] >> np.uint64(32)).astype(np.uint32)
                a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(x), "left")
                if a < b:
                    cuts = np.empty(2 * (b - a), dtype=np.int64)
                    cuts[::2], cuts[1::2] = np.maximum(starts[a:b] - low, 0), np.minimum(ends[a:b] - low, len(x))
                    cuts = cuts[:-1] if cuts[-1] == len(x) else cuts
                    np.minimum(out[:, a:b], np.minimum.reduceat(x * factors, cuts, axis=1)[:, ::2], out=out[:, a:b])
            return out.T

        return sign

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(n, bands) band keys of (n, hashes) signatures."""
        cut = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        total = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), cut.shape[:2]).copy()
        for r in range(self.rows):
            total = mix64(total * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r])
        return total.view(np.int64)

    def screen_table(self, miss: float, batch: int = 24) -> list[tuple[int, int]]:
        """(hashes compared, fewest matches to go on) for each batch of a sequential comparison.

        With a uniform prior, the posterior of the similarity after m matches among n hashes is
        Beta(m + 1, n - m + 1); its mass above t is the chance of at most m successes in n + 1
        trials at t. A pair is dropped when that mass is below ``miss``.
        """
        t, out = self.num / self.den, []
        for n in [*range(batch, self.hashes, batch), self.hashes]:
            mass, m = 0.0, 0
            while m <= n:
                mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if mass >= miss:
                    break
                m += 1
            out.append((n, m))
        return out


def _screen(left: np.ndarray, right: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the signature pairs that no batch rules out."""
    alive, at = np.arange(len(left)), 0
    matches = np.zeros(len(left), dtype=np.int32)
    for n, least in table:
        matches[alive] += (left[alive, at:n] == right[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        at = n
        if not len(alive):
            break
    return alive


def stored_sets(payloads: list[bytes]) -> list[np.ndarray]:
    """The sets of payloads that hold sorted distinct 64-bit hashes."""
    return [np.frombuffer(data, dtype=np.uint64) for data in payloads]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


def _same_enough(one: np.ndarray, two: np.ndarray, plan: Banding) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small) or plan.den * len(small) < plan.num * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return plan.den * both >= plan.num * (len(one) + len(two) - both)


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersection sizes of each set of ``one`` with each of ``two``, and both sides' sizes.

    Products of 0/1 matrices; hashes may repeat inside a set.
    """
    sets = [*one, *two]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    width = int(column.max()) + 1
    if width > COLUMNS:
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
    out, sizes = np.zeros((len(one), len(two))), np.zeros(len(sets))
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS]) if width > COLUMNS else (0, len(column))
        part = np.zeros((len(sets), min(COLUMNS, width - low)), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part[: len(one)] @ part[len(one) :].T
        sizes += part.sum(axis=1)
    return out, sizes[: len(one)], sizes[len(one) :]


class _Side:
    """Some nodes of a block: ids, labels of what is known to be connected, signatures and sets."""

    def __init__(self, rows: pa.StructArray, labels: np.ndarray, plan: Banding, sets: list[np.ndarray], screened: bool) -> None:
        self.node = rows.field("node").to_numpy(zero_copy_only=False)
        self.label = labels
        self.signature = _matrix(rows.field("sig"), plan.hashes) if screened else None
        self._sets, self._sorted = sets, {}

    def full(self, i: int) -> np.ndarray:
        return self._sets[i]

    def sorted(self, i: int) -> np.ndarray:
        if i not in self._sorted:
            self._sorted[i] = distinct(self.full(i))
        return self._sorted[i]


def _links(one: _Side, two: _Side, wanted: np.ndarray, plan: Banding, table: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Confirmed links among the wanted pairs of differently labelled nodes; labels are joined as links are found.

    Nodes that a link has just connected need no further link, so there are fewer links than nodes.
    """
    wanted = wanted & (one.label[:, None] != two.label[None, :])
    if one.signature is not None:
        for i in np.flatnonzero(wanted.any(axis=1)):
            at = np.flatnonzero(wanted[i])
            alive = at[_screen(np.broadcast_to(one.signature[i], (len(at), plan.hashes)), two.signature[at], table)]
            wanted[i] = False
            wanted[i, alive] = True
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        out.append((int(one.node[i]), int(two.node[j])))
        old, now = two.label[j], one.label[i]
        one.label[one.label == old] = now
        two.label[two.label == old] = now

    if np.count_nonzero(wanted) <= FEW:
        for i, j in zip(*np.nonzero(wanted), strict=True):
            if one.label[i] != two.label[j] and _same_enough(one.sorted(i), two.sorted(j), plan):
                join(i, j)
        return out
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    both, size_a, size_b = _shared([one.full(i) for i in rows], [two.full(j) for j in columns])
    whole = size_a[:, None] + size_b[None, :] - both
    alike = (plan.den * both >= plan.num * whole) & wanted[np.ix_(rows, columns)]
    for i, j in zip(*np.nonzero(alike), strict=True):
        i, j = rows[i], columns[j]
        if one.label[i] != two.label[j]:
            join(i, j)
    return out


def _unpacked(blocks: list[pa.StructArray], unpack: Callable[[list[bytes]], list[np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number, sets) of each block of a batch; small blocks are unpacked together."""
    low = size = 0
    for high, rows in enumerate(blocks, 1):
        size += rows.field("set").nbytes
        if size > UNPACKED or high == len(blocks):
            made, at = unpack([x for part in blocks[low:high] for x in part.field("set").to_pylist()]), 0
            for i in range(low, high):
                yield i, made[at : at + len(blocks[i])]
                at += len(blocks[i])
            low, size = high, 0


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([p[i] for p in found], pa.int64()) for i, k in enumerate("ab")})


def _blocked(members: DataFrame, payload: DataFrame, *more: str) -> DataFrame:
    """(hub, block, rows): the payloads of each block's members, a bounded number of bounded bytes."""
    rows = F.collect_list(F.struct("node", *more, "sig", "set")).alias("rows")
    return members.join(payload.drop("bytes"), "node").groupBy("hub", "block").agg(rows)


def _within(members: DataFrame, payload: DataFrame, plan: Banding, table: list[tuple[int, int]], unpack: Callable[[list[bytes]], list[np.ndarray]], screened: bool) -> DataFrame:
    """Links inside the blocks, each with its hub: hub against members first, then those still apart."""

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        hubs, blocks = batch.column(0).to_pylist(), [x.values for x in batch.column(2)]
        for at, sets in _unpacked(blocks, unpack):
            hub, n = hubs[at], len(sets)
            side = _Side(blocks[at], np.arange(n), plan, sets, screened)
            middle = np.flatnonzero(side.node == hub)[:1]
            first = np.zeros((n, n), dtype=bool)
            first[middle] = True
            found += _links(side, side, first, plan, table)
            if n > 2 and (side.label != side.label[0]).any():
                rest = np.triu(np.ones((n, n), dtype=bool), 1)
                rest[middle] = rest[:, middle] = False  # compared before
                found += _links(side, side, rest, plan, table)
        yield _pair_batch(found)

    hubs = members.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("node"))
    return arrow_map(_blocked(members.select("hub", "block", "node").union(hubs), payload), compare, "a bigint, b bigint", rows=32)


def _across(
    members: DataFrame, linked: DataFrame, payload: DataFrame, plan: Banding, table: list[tuple[int, int]], unpack: Callable[[list[bytes]], list[np.ndarray]], screened: bool
) -> DataFrame | None:
    """Links between members of one hub that lie in different blocks and, so far, different components.

    Members are dealt anew: a component with a block's worth of members under a hub gets blocks of
    its own, and pairs of its blocks are left out; the others share blocks. What is compared grows
    with the members outside the largest component times all members.
    """
    labelled = members.join(linked, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hub")
    labelled = materialize(labelled.join(mixed, "hub"))
    if labelled.isEmpty():
        discard(labelled)
        return None
    weight = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    weighed = labelled.join(payload.select("node", "bytes"), "node").groupBy("hub", "comp").agg(weight.alias("blocks"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    own = weighed.withColumn("own", F.when((F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES), F.col("comp")))
    shared = own.where("own IS NULL").groupBy("hub").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("shared")
    )
    plans = materialize(own.join(shared, "hub", "left").select("hub", "comp", "own", F.when(F.col("own").isNull(), F.col("shared")).otherwise(F.col("blocks")).alias("blocks")))
    index = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    block = lambda i: F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), i)
    blocks = materialize(_blocked(labelled.join(plans, ["hub", "comp"]).select("hub", "node", "comp", block(index).alias("block")), payload, "comp"))
    listed = plans.select("hub", "own", "blocks").distinct().select("hub", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    listed = materialize(listed.select("hub", "own", block(F.col("i")).alias("block")))
    other = listed.select("hub", F.col("own").alias("own_b"), F.col("block").alias("block_b"))
    pairs = listed.join(other, "hub").where("block <= block_b AND (own IS NULL OR own_b IS NULL OR own <> own_b)").select("hub", "block", "block_b")
    # A hub's pairs of blocks are dealt by hub and block, not by hub.
    both = pairs.join(blocks, ["hub", "block"]).join(blocks.select("hub", F.col("block").alias("block_b"), F.col("rows").alias("rows_b")), ["hub", "block_b"])

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for one, two in zip(batch.column(0), batch.column(1), strict=True):
            a, b = (_Side(x.values, x.values.field("comp").to_numpy(zero_copy_only=False).copy(), plan, unpack(x.values.field("set").to_pylist()), screened) for x in (one, two))
            found += _links(a, b, np.ones((len(a.node), len(b.node)), dtype=bool), plan, table)
        yield _pair_batch(found)

    found = materialize(arrow_map(both.select("rows", "rows_b"), compare, "a bigint, b bigint", rows=8))
    discard(labelled, plans, blocks, listed)
    return found


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and band keys (int64), one by one, of a batch of (node, bands)."""
    bands = batch.column(1).to_pylist()
    keys = np.frombuffer(b"".join(bands), dtype=np.int64)
    return np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // 8 for x in bands]), keys


def _extremes(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (uint64, ascending), and the smallest and the largest node of each."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return keys[first], np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)


def crowded_keys(nodes: DataFrame) -> DataFrame:
    """(key, hub) of every band key that several nodes have; hub is the smallest of them.

    Keys travel packed: a row holds many keys of one part of their range, each with its smallest and
    its largest node among what a task has gathered, so a frequent key costs a task two entries.
    Parts grow in number with the table, not in size.
    """
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(nodes) // (8 * PACKED) + 1)

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, low, high = _extremes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        several = low != high
        last = np.cumsum(several + 1) - 1
        key, node = np.repeat(key, several + 1), np.repeat(low, several + 1)
        node[last] = high
        cuts = np.searchsorted(((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(cuts))
        data = [key[cuts[p] : cuts[p + 1]].tobytes() + node[cuts[p] : cuts[p + 1]].tobytes() for p in filled]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches, 10_000):
            node, key = _flat(batch)
            if len(key):
                held.append((key.view(np.uint64), node))
                n += len(key)
            if n >= PACKED:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.frombuffer(x, dtype=np.uint64).reshape(2, -1) for batch in batches for x in batch.column(0).to_pylist()]
        if both:
            key, low, high = _extremes(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]).view(np.int64))
            several = low != high
            key, hub = key[several].view(np.int64), low[several]
            for at in range(0, len(key), 10_000):
                yield pa.RecordBatch.from_pydict({"key": key[at : at + 10_000], "hub": hub[at : at + 10_000]})

    dealt = nodes.select("node", "bands").mapInArrow(packed, "part int, data binary").repartitionById(parts, "part")
    return dealt.select("data").mapInArrow(compared, "key bigint, hub bigint")


def link(
    nodes: DataFrame, fetch: Callable[[DataFrame], tuple[DataFrame, object]], plan: Banding, miss: float, screened: bool = True,
    unpack: Callable[[list[bytes]], list[np.ndarray]] = stored_sets,
) -> DataFrame:
    """(node, comp) for every node that has a link; comp is the smallest node reachable.

    nodes: node bigint, bands binary (``band_batch``); a node may come several times. fetch: from a table of
    nodes to at least those nodes' (node bigint, sig binary, set binary) and a broadcast that is not
    needed afterwards (or None); of rows that repeat a node one counts; sig may be null where nothing
    is screened. unpack: from sets' binaries to their hashes, in any order and with repeats.
    """
    keys = materialize(crowded_keys(nodes))
    shared = key_bitmap(keys, "key")

    def bucketed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, key = _flat(batch)
        hit = in_bitmap(shared.value, key) if shared else np.ones(len(key), dtype=bool)
        yield pa.RecordBatch.from_pydict({"node": node[hit], "key": key[hit]})

    found = arrow_map(nodes.select("node", "bands"), bucketed, "node bigint, key bigint", rows=10_000)
    members = materialize(found.join(keys, "key").select("hub", "node").where("node <> hub").distinct())
    involved = materialize(members.select("node").union(members.select("hub")).distinct())
    payload, wanted = fetch(involved)
    payload = payload.join(involved, "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig"), F.first("set").alias("set"))
    payload = materialize(payload.withColumn("bytes", F.octet_length("set").cast("bigint")))
    for bitmap in (shared, wanted):
        if bitmap:
            bitmap.destroy()

    table = plan.screen_table(miss)
    weighed = members.join(payload.select("node", "bytes"), "node").groupBy("hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / (BLOCK - 1)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = materialize(weighed.select("hub", blocks.alias("blocks")).where("blocks > 1"))
    placed = members.join(large, "hub", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    first = materialize(_within(placed, payload, plan, table, unpack, screened))
    final = components(first)
    several = members.join(large.select("hub"), "hub", "left_semi")
    second = _across(several, final, payload, plan, table, unpack, screened)
    if second is not None and not second.isEmpty():
        known = final.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        whole = components(known.union(second))
        discard(final)
        final = whole
    discard(keys, members, involved, payload, large, first, *([second] if second is not None else []))
    return final


def band_batch(plan: Banding, signatures: list[np.ndarray | None]) -> pa.BinaryArray:
    """Band keys as a column of packed longs; None gives an empty value."""
    full = [x for x in signatures if x is not None]
    signed = np.array([x is not None for x in signatures], dtype=bool)
    return packed_bands(plan, signed, np.concatenate(full).reshape(len(full), plan.hashes) if full else np.empty((0, plan.hashes), dtype=np.uint32))


def packed_bands(plan: Banding, signed: np.ndarray, signatures: np.ndarray) -> pa.BinaryArray:
    """Band keys as a column of packed longs: of the signatures in turn where ``signed``, else an empty value."""
    offsets = np.zeros(len(signed) + 1, dtype=np.int32)
    np.cumsum(signed * (8 * plan.bands), out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(signed), [None, pa.py_buffer(offsets), pa.py_buffer(plan.keys(signatures).tobytes())])
