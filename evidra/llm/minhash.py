"""Near-duplicate documents by b-bit MinHash with exact confirmation.

Each document's word shingles give ``n_hashes`` minima.  Rows of minima hashed
band by band make buckets; the low ``b`` bits of all minima are packed into a
signature, which is stored, and whose equal positions, corrected for chance
collisions, estimate the similarity of two candidates.  Candidates whose
estimate allows a link are confirmed on full shingle sets, and components are
made of confirmed links only.

Scale.  Equal sets are collapsed to one class first, with map-side
aggregation, so copies never meet in a bucket.  Then every document is
confirmed against the most similar of its buckets' first members, one text for
each document, which joins groups of near copies at a cost linear in their
size.  What remains are buckets whose members are in different components:
there signatures, not texts, are compared, each member outside the bucket's
largest component with the others, in blocks of bounded size, and each is
confirmed against its most similar partners.  Where some have more partners
than that, the components that allowed pairs connect are read in blocks, and
every document outside the largest of them is compared with all of its block
through an inverted index of shingles; no pairs are written.  So documents that
are already together are not compared again.  A first member with many
partners is dealt out over tasks by shingle count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm.components import connected_components
from evidra.llm.scratch import stored

#: Word separators: space and the control characters from tab to carriage return.
SPACE = np.ones(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False


@dataclass(frozen=True)
class MinHashParams:
    """``words``: shingle length; a link has 100 * common >= percent * union.

    ``bands * rows`` minima form buckets: a pair at the threshold of 0.8
    shares none of 30 bands of 5 with a probability of 7e-6.  ``block``:
    shingles that a task reads of one document's partners, or of a block.
    ``bucket``: members of a bucket that a task compares with as many others,
    and documents that it compares with a block.  ``partners``: how many are
    confirmed one by one for each member of a bucket, before blocks are read.
    """

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    n_hashes: int = 160
    b: int = 4
    block: int = 2_000_000
    bucket: int = 8192
    partners: int = 8
    seed: int = 11


def pack_low_bits(minima: np.ndarray, b: int) -> np.ndarray:
    """Low ``b`` bits (1, 2, 4 or 8) of each minimum, packed into 64-bit words."""
    per = 64 // b
    low = (minima & np.uint32((1 << b) - 1)).astype(np.uint64)
    pad = -low.shape[1] % per
    low = np.pad(low, ((0, 0), (0, pad))).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(b)), axis=2)


def estimate(one: np.ndarray, many: np.ndarray, b: int, n_hashes: int) -> np.ndarray:
    """Similarity of packed signatures, row by row: equal positions by bit counts, less chance collisions."""
    diff = one ^ many
    shift = 1
    while shift < b:
        diff |= diff >> np.uint64(shift)
        shift *= 2
    lowest = np.uint64(sum(1 << i for i in range(0, 64, b)))
    differ = np.bitwise_count(diff & lowest).sum(axis=1, dtype=np.int32)
    chance = 1 / (1 << b)
    return ((n_hashes - differ) / n_hashes - chance) / (1 - chance)


def floor_estimate(p: MinHashParams) -> float:
    """Estimates below it are 4.5 deviations under the threshold, which a link has with a probability of 4e-6."""
    chance, s = 1 / (1 << p.b), p.percent / 100
    q = chance + (1 - chance) * s
    return s - 4.5 * (q * (1 - q) / p.n_hashes) ** 0.5 / (1 - chance)


def allowed(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature tables that may be linked, by set sizes and estimate; the estimates of all rows, or -1."""
    found = np.full(len(x), -1.0)
    near = np.flatnonzero(100 * np.minimum(size_x, size_y) >= p.percent * np.maximum(size_x, size_y))
    found[near] = estimate(x[near], y[near], p.b, p.n_hashes)
    return found >= floor_estimate(p), found


def _coefficients(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(1 << 10, 1 << 32, p.n_hashes, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, p.n_hashes, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, sorted inside each document, and the bounds of the documents."""
    start, end, doc = B.segment(data, offs, SPACE)
    n = len(offs) - 1
    h, d = B.shingles(B.fingerprints(B.prefix_sums(data, values), start, end), doc, n, words)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n))))
    out = np.empty_like(h)
    for i in np.flatnonzero(np.diff(bounds)):
        out[bounds[i] : bounds[i + 1]] = np.sort(h[bounds[i] : bounds[i + 1]])
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[bounds]


def minima(sets: np.ndarray, bounds: np.ndarray, p: MinHashParams) -> np.ndarray:
    """``n_hashes`` minima of each document that has shingles."""
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]
    a, c = _coefficients(p)
    out = np.empty((len(begin), p.n_hashes), np.uint32)
    for i in range(p.n_hashes if len(begin) else 0):
        out[:, i] = np.minimum.reduceat(x * a[i] + c[i], begin)
    return out


_SIGNATURE = "doc_id long, n_shingles long, lo long, hi long, bands array<long>, packed binary"


def signatures(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """One row for each document: set size, 128-bit set digest, band hashes, packed signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = B.byte_values(lower=True)
        step = np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            for i, j in B.slices(offs):
                sets, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words, values)
                size = np.diff(bounds)
                has = np.flatnonzero(size)
                begin = bounds[:-1][has]
                sums = np.zeros((2, j - i), np.uint64)
                if len(has):
                    sums[0, has] = np.add.reduceat(B.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    sums[1, has] = np.add.reduceat(B.mix(sets + np.uint64(0x14057B7EF767814F)), begin)
                low = minima(sets, bounds, p)
                acc = np.arange(1, p.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95) + np.zeros((len(has), 1), np.uint64)
                for r in range(p.rows):
                    acc = acc * step + low[:, r : p.bands * p.rows : p.rows].astype(np.uint64)
                acc, packed = B.mix(acc).view(np.int64), pack_low_bits(low, p.b)
                counts = np.zeros(j - i + 1, np.int32)
                counts[1:][has] = p.bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(size.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(acc.reshape(-1))),
                        pa.array(_spread(packed, has, j - i), pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "lo", "hi", "bands", "packed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIGNATURE)


def _spread(packed: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    out = [b""] * n
    for k, i in enumerate(at):
        out[i] = packed[k].tobytes()
    return out


def _signature_rows(column: pa.Array, p: MinHashParams) -> np.ndarray:
    """Packed signatures of a binary column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -(-p.n_hashes * p.b // 64))


def _first_partners(keys: DataFrame, rows: DataFrame, p: MinHashParams) -> DataFrame:
    """``(u, v, n)``: for each document the first member of one of its buckets that is most similar, if a link is allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_signature_rows(batch.column(c), p) for c in (4, 5))
                ok, found = allowed(x, y, *(batch.column(c).to_numpy() for c in (2, 3)), p)
                at = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3)), pa.array(found[at])], ["u", "v", "n", "estimate"])

    low = keys.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("top")).where("v < top").select("key", "v")
    star = keys.join(low, "key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()
    own = rows.select("doc_id", "n_shingles", "packed")
    pairs = star.join(own.toDF("u", "n", "pu"), "u").join(own.toDF("v", "m", "pv"), "v").select("u", "v", "n", "m", "pu", "pv")
    close = pairs.mapInArrow(run, "u long, v long, n long, estimate double")
    best = close.groupBy("u").agg(F.max_by(F.struct("v", "n"), F.struct("estimate", -F.col("v"))).alias("b"))
    return best.select("u", "b.v", "b.n")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of whole groups, from batches sorted by the first ``keys`` columns that tell them apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cut = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
        if held:
            before = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(keys)]
            cut = np.concatenate(([0], cut)) if before != cols[:, 0].tolist() else cut
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, cut[-1])])
            held = []
            batch = batch.slice(cut[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


#: Pairs of signatures that are compared at once.
CELLS = 100_000


def _bucket_members(keys: DataFrame, rows: DataFrame, labels: DataFrame, p: MinHashParams) -> DataFrame:
    """``key, task, side, doc_id, label, n_shingles, packed``, dealt and sorted by task, of buckets in several components.

    Side 1 holds the members outside the bucket's largest component, side 0
    all; a bucket larger than ``p.bucket`` has a task for each two blocks.
    """
    own = keys.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    sizes = own.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"), F.count("*").alias("labels"))
    mixed = sizes.where("labels > 1").select("key", "main", F.ceil(F.col("all") / p.bucket).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / p.bucket).alias("shares"))
    members = own.join(mixed, "key").join(rows.select("doc_id", "n_shingles", "packed"), "doc_id")
    return _dealt(members, F.col("label") != F.col("main"), ["key"], ["doc_id", "label", "n_shingles", "packed"])


def _dealt(members: DataFrame, rest: Column, keys: list[str], more: list[str]) -> DataFrame:
    """Rows by ``keys, task, side``: each of all members meets each of ``rest`` in one of ``blocks`` times ``shares`` tasks."""
    share, block = F.pmod(F.xxhash64("doc_id", F.lit(2)), "shares"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks")
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    sides = members.withColumn("side", F.explode(F.when(rest, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tasks = F.when(F.col("side") == 1, F.transform(until("blocks"), lambda b: share * F.col("blocks") + b)).otherwise(F.transform(until("shares"), lambda a: a * F.col("blocks") + block))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.withColumn("task", F.explode(tasks)).select(*keys, "task", "side", *more).repartition(n, *keys, "task").sortWithinPartitions(*keys, "task", "side")


def _compared(table: pa.Table, p: MinHashParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and estimates of the allowed pairs of :func:`_bucket_members` that are apart; the rows of side 1 come first."""
    key, task, side, _, label, size = (table.column(c).to_numpy() for c in range(6))
    packed = _signature_rows(table.column(6).combine_chunks(), p)
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (task[1:] != task[:-1]))))
    x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    begin, end = (np.searchsorted(group[y], group[x], s) for s in ("left", "right"))
    total = np.concatenate(([0], np.cumsum(end - begin)))
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, "right")) - 1)
        count = (end - begin)[at:to]
        xi = np.repeat(x[at:to], count)
        yi = y[np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at] - begin[at:to], count)]
        apart = np.flatnonzero(label[xi] != label[yi])
        xi, yi = xi[apart], yi[apart]
        ok, found = allowed(packed[xi], packed[yi], size[xi], size[yi], p)
        yield xi[ok], yi[ok], found[ok]
        at = to


def _bucket_pairs(members: DataFrame, p: MinHashParams) -> DataFrame:
    """``(u, v, n, cut)``: the ``p.partners`` most similar allowed partners of each member that is compared; ``cut``: there were more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            doc, size = table.column(3).to_numpy(), table.column(5).to_numpy()
            for xi, yi, found in _compared(table, p):
                order = np.lexsort((doc[yi], -found, xi))
                xi, yi = xi[order], yi[order]
                first = np.searchsorted(xi, xi, "left")
                many = np.searchsorted(xi, xi, "right") - first
                keep = np.arange(len(xi)) - first < p.partners
                more = many > p.partners
                if not p.partners and len(xi):
                    keep[0] = True  # a pair that tells that there are some
                yield pa.RecordBatch.from_arrays([pa.array(doc[xi[keep]]), pa.array(doc[yi[keep]]), pa.array(size[xi[keep]]), pa.array(more[keep])], ["u", "v", "n", "cut"])

    found = members.mapInArrow(run, "u long, v long, n long, cut boolean")
    return found.groupBy("u", "v").agg(F.max("n").alias("n"), F.max("cut").alias("cut"))


def _least(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _near_components(members: DataFrame, p: MinHashParams) -> DataFrame:
    """``(u, v)``: components that allowed pairs connect, each with the smallest that its task connects it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            label = table.column(4).to_numpy()
            u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for xi, yi, _ in _compared(table, p):
                u, v = _least(np.concatenate((u, label[xi])), np.concatenate((v, label[yi])))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return members.mapInArrow(run, "u long, v long").distinct()


def _block_links(texts: DataFrame, rows: DataFrame, labels: DataFrame, near: DataFrame, p: MinHashParams) -> DataFrame:
    """Links between the components that ``near`` connects: every document outside the largest of them against all, block by block.

    A document gives one link to each component that it is linked to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = B.byte_values(lower=True)
        now, parts, index = None, [], None
        for batch in batches:
            cluster, task, side, doc, label = (batch.column(c).to_numpy() for c in range(5))
            data, offs = B.utf8(batch.column(5))
            u: list[int] = []
            v: list[int] = []
            for i, j in B.slices(offs):
                flat, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words, values)
                for k in range(i, j):
                    own = flat[bounds[k - i] : bounds[k - i + 1]]
                    if (cluster[k], task[k]) != now:
                        now, parts, index = (cluster[k], task[k]), [], None
                    if side[k] == 0:
                        parts.append((own.copy(), int(doc[k]), int(label[k])))
                    elif parts:
                        if index is None:
                            index = _Block(parts, p.percent)
                            parts = [None]  # the index holds the sets
                        for partner in index.linked(own, int(label[k])):
                            u.append(int(doc[k]))
                            v.append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    clusters = stored(connected_components(near), "clusters").toDF("label", "cluster")
    sizes = rows.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    members = sizes.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    members = stored(members.join(clusters, "label").select("doc_id", "label", "cluster", "n"), "members")
    parts = members.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    plan = parts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.ceil(F.sum("n") / p.block).alias("blocks"), F.ceil((F.sum("c") - F.max("c")) / p.bucket).alias("shares"))
    placed = members.join(plan, "cluster").join(texts, "doc_id")
    return _dealt(placed, F.col("label") != F.col("main"), ["cluster"], ["doc_id", "label", "text"]).mapInArrow(run, "u long, v long")


class _Block:
    """An inverted index of the sets of a block: sorted shingles with their owners."""

    def __init__(self, parts: list[tuple[np.ndarray, int, int]], percent: int) -> None:
        self.size = np.array([len(s) for s, _, _ in parts])
        self.doc, self.label = np.array([d for _, d, _ in parts]), np.array([x for _, _, x in parts])
        ids, owner = np.concatenate([s for s, _, _ in parts]), np.repeat(np.arange(len(parts), dtype=np.int32), self.size)
        order = np.argsort(ids, kind="stable").astype(np.int32)
        self.ids, self.owner, self.percent = ids[order], owner[order], percent

    def linked(self, own: np.ndarray, label: int) -> list[int]:
        """One document of each other component that a set is linked to."""
        if not len(own):
            return []
        lo, hi = (np.searchsorted(self.ids, own, s) for s in ("left", "right"))
        total = np.concatenate(([0], np.cumsum(hi - lo)))
        common, at = np.zeros(len(self.size), np.int64), 0
        while at < len(own):  # postings in pieces, since a long text may have many frequent shingles
            to = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, "right")) - 1)
            span = (hi - lo)[at:to]
            place = np.arange(total[to] - total[at]) + np.repeat(lo[at:to] - (total[at:to] - total[at]), span)
            common += np.bincount(self.owner[place], minlength=len(self.size))
            at = to
        hit = np.flatnonzero((100 * common >= self.percent * (len(own) + self.size - common)) & (common > 0) & (self.label != label))
        _, first = np.unique(self.label[hit], return_index=True)
        return self.doc[hit[first]].tolist()


def _confirmed(texts: DataFrame, pairs: DataFrame, p: MinHashParams) -> DataFrame:
    """Those ``(u, v)`` of ``pairs(u, v, n)`` that are linked, by their full shingle sets.

    The partners of a document are dealt out over tasks, ``p.block`` shingles
    each, and pass by its set one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = B.byte_values(lower=True)
        now, hubs = None, []
        for batch in batches:
            v, task, side, doc = (batch.column(c).to_numpy() for c in range(4))
            data, offs = B.utf8(batch.column(4))
            linked: list[int] = []
            for i, j in B.slices(offs):
                flat, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words, values)
                for k in range(i, j):
                    own = flat[bounds[k - i] : bounds[k - i + 1]]
                    if (v[k], task[k]) != now:
                        now, hubs = (v[k], task[k]), []
                    if side[k] == 0:
                        hubs.append(own.copy())
                    elif any(_linked(own, hub, p.percent) for hub in hubs):
                        linked.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(doc[linked]), pa.array(v[linked])], ["u", "v"])

    spark = texts.sparkSession
    chunks = stored(pairs.groupBy("v").agg(F.ceil(F.sum("n") / p.block).alias("chunks")).where("chunks > 1"), "chunks")
    task = F.pmod(F.xxhash64("u"), F.coalesce("chunks", F.lit(1)))
    members = pairs.join(chunks, "v", "left").select("v", task.alias("task"), F.lit(1).alias("side"), F.col("u").alias("doc_id"))
    hubs = members.select("v", "task").distinct().select("v", "task", F.lit(0).alias("side"), F.col("v").alias("doc_id"))
    rows = members.unionByName(hubs).join(texts, "doc_id").select("v", "task", "side", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "v", "task").sortWithinPartitions("v", "task", "side").mapInArrow(run, "u long, v long")


def _pointed(links: DataFrame) -> DataFrame:
    """``id, component``: for each larger end of a link a smaller document that links reach, four links away at most.

    Documents with equal ones are together; more of them may be.
    """
    way = links.where("u <> v").groupBy(F.greatest("u", "v").alias("id")).agg(F.min(F.least("u", "v")).alias("component"))
    for _ in range(2):
        way = stored(way, "way")
        way = way.join(way.toDF("component", "further"), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    return stored(way, "labels")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted fingerprints are linked."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the
    document itself included; ``kept`` marks that document.  Other columns of
    ``docs`` are not read.  Null and empty texts have no shingles and link
    with nothing.  A row with a null ``doc_id`` links with nothing, has a null
    ``component_id`` and is kept.  Rows that share a ``doc_id`` are one
    document: each reports its own set, and what one of them links with, all
    do.  An empty table gives an empty table.  Words are folded A-Z only.
    """
    p = params
    sig = stored(signatures(docs, p), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    digest = ["lo", "hi", "n_shingles"]
    reps = stored(some.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")
    rows = some.join(reps.withColumnRenamed("rep", "doc_id"), [*digest, "doc_id"], "left_semi")
    keys = rows.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    keys = stored(keys.join(shared, "key"), "keys")
    rows = stored(rows.select("doc_id", "n_shingles", "packed").join(keys.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The candidates grow with the documents, so they aren't broadcast at any size.
    texts = stored(texts.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    # A document with several texts joins the classes of all of them.
    several = some.groupBy("doc_id").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a < b").select("doc_id")
    own = some.join(several, "doc_id", "left_semi").join(reps, digest).groupBy("doc_id").agg(F.collect_set("rep").alias("r"))
    edges = own.select(F.explode("r").alias("u"), F.array_min("r").alias("v"))
    links = stored(_confirmed(texts, stored(_first_partners(keys, rows, p), "pairs"), p).unionByName(edges), "links")
    labels = _pointed(links)
    pairs = stored(_bucket_pairs(_bucket_members(keys, rows, labels, p), p), "pairs")
    seen = pairs.agg(F.count("*").alias("n"), F.max("cut").alias("cut")).first()
    if seen.n:
        links = stored(links.unionByName(_confirmed(texts, pairs, p)), "links")
    labels = connected_components(links)
    if seen.cut:
        labels = stored(labels, "labels")
        near = stored(_near_components(_bucket_members(keys, rows, labels, p), p), "near")
        links = stored(links.unionByName(_block_links(texts, rows, labels, near, p)), "links")
        labels = connected_components(links)
    near = labels.withColumnRenamed("id", "rep")
    return (
        sig.select("doc_id", *digest)
        .join(reps.join(near, "rep", "left").select(*digest, F.coalesce("component", "rep").alias("near")), digest, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("near", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
