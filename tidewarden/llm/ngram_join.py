"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share of THRESHOLD or more.

Steps, each a Spark job whose tables stay in the shared folder:
1. `classes`: documents with equal sets are one class (they link with one another by definition).
2. `frequencies`: each task counts all its shingles in a sketch of two rows of WIDTH counters, and the tasks' sketches are
   summed; the smaller of a shingle's two counters gives the global order, rare shingles first. Any order gives the same links; this
   one keeps common shingles out of prefixes. Chance adds the same to all counters, give or take its root, so a shingle is told
   from rare ones if it is in more documents than a few times the root of (all shingles / WIDTH).
3. `postings`: each class's prefix (for overlap t, |x| - ceil(t |x|) + 1 shingles) is dealt out by shingle; those of a
   frequent shingle go to several tasks. Shingles of one class alone end here.
4. Rounds over the postings: some classes of each shingle (leaders; 1, then LEADERS more in each round) are joined with
   all its classes, unless both are known to be connected. Bounds by length, by position and by the halves of the suffixes
   behind the shared shingle drop pairs, as does a bound on the Hamming distance of parity bitmaps; each pair is judged
   once, on whole sets, and never comes again. Rounds end when all of a shingle's other classes are connected, so no
   link between components is lost, and a group of near copies costs a few pairs a member instead of all pairs.
5. Components by large-star and small-star steps over the verified links, as DataFrame joins.

Shingles are 64-bit hashes, sets have 64-bit signatures beside their size; texts are known by their MD5.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; a text of fewer than
k words is one shingle; equal sets link; rows that repeat a doc_id are rows of their own with the same component if
their texts link; a null doc_id takes part and is never a component's id unless all its members' ids are null;
an empty table gives an empty result; other columns are ignored. `keep_one` keeps the row of the smallest doc_id of each
component (null last, ties by the text's MD5), one row where several repeat both, and all rows that link with nothing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Words in a shingle; a link needs 100 * intersection >= THRESHOLD * union.
K = 5
THRESHOLD = 75
#: Counters of a row of the sketch, and in a block of it that one task sums; the sketch has a fixed size whatever the input.
WIDTH = 1 << 21
BLOCK = 1 << 16
#: Shingles that a task counts at once.
COUNT_SHINGLES = 1 << 20
#: Steps of the order for each doubling of a count.
STEPS = 16

#: Documents of a frequent shingle that one task is to get about.
HOT_ROWS = 256
#: Share of a round's pairs above which a class's rows meet it by broadcast.
HOT_SHARE = 1 / 50
#: Leaders of a shingle in each round, at most; the last number holds for all further rounds.
LEADERS = (1, 8, 4096)

_SIG = np.uint64(0xD6E8FEB86659FD93)
#: Fills the place of a null doc_id in joins; the digest tells it from an id.
_NO_ID = 0


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size, and an order-free 64-bit signature, of each row's set."""
    n = np.diff(bounds)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(values * _SIG))))
    return n, c.mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64) * _SIG)


def _sets(batches: Iterator[pa.RecordBatch], column: int, k: int):
    """Batch, first row, sizes, signatures, values, bounds of each chunk."""
    for batch in batches:
        data, off = c.utf8(batch.column(column))
        for i, j in c.chunks(off):
            values, bounds = c.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
            yield batch, i, *_signatures(values, bounds), values, bounds


def parity_bits(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, a bitmap of 64 bits or the power of two from 2 n on, in which each shingle turns one bit; with offsets.

    Two bitmaps differ in as many bits at most as the sets differ in shingles. A longer one folds to a shorter one."""
    n = np.diff(bounds)
    size = np.where(n <= 32, 8, 1 << (np.ceil(np.log2(np.maximum(n, 33) * 2)).astype(np.int64) - 3))
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(n)), n)
    bit = (values & (size[owner] * 8 - 1).astype(np.uint64)).astype(np.int64) + at[owner] * 8
    odd = np.bincount(bit, minlength=int(at[-1]) * 8).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little"), at


def _key(doc_id: str, text: str) -> tuple[Column, Column]:
    """doc, digest of a row: doc_id, or _NO_ID where it is null, and the text's MD5 with a byte more where doc_id is null."""
    doc, md5 = F.col(doc_id).cast("long"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.coalesce(doc, F.lit(_NO_ID)), F.when(doc.isNull(), F.concat(md5, F.lit(bytearray(1)))).otherwise(md5)


def _named(docs: DataFrame) -> DataFrame:
    """doc, digest, text."""
    doc, digest = _key("doc_id", "text")
    return docs.select(doc.alias("doc"), digest.alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest (of the text), n (size of the set), sig, bits (parity bitmap) for each document."""

    def run(batches):
        for batch, i, n, sig, values, bounds in _sets(batches, 2, k):
            bits, at = parity_bits(values, bounds)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).slice(i, len(n)) for x in (0, 1)), pa.array(n.astype(np.int64)), pa.array(sig.view(np.int64)), raw],
                names=["doc", "digest", "n", "sig", "bits"],
            )

    made = _named(docs).mapInArrow(run, "doc long, digest binary, n long, sig long, bits binary")
    return made.withColumn("doc_id", F.when(F.octet_length("digest") == 16, F.col("doc"))).drop("doc")


def _with_side(found: DataFrame, of: DataFrame, column: str, x: str, hot: DataFrame | None) -> DataFrame:
    """found with the column of class x of each pair. hot (sig, n): classes in so many pairs that their rows are not dealt by class: their columns, few by
    number and measured by bytes, are broadcast."""
    on = [f"sig_{x}", f"n_{x}"]
    told = of.select(F.col("sig").alias(on[0]), F.col("n").cast("int").alias(on[1]), F.col(column).alias(f"{column}_{x}"))
    if hot is not None:
        keys = hot.select(F.col("sig").alias(on[0]), F.col("n").alias(on[1]))
        few = c.stage(told.join(F.broadcast(keys), on, "left_semi"), "hot-classes")
        if c.small(few):
            return found.join(F.broadcast(few), on).unionByName(found.join(F.broadcast(keys), on, "left_anti").join(told, on))
    return found.join(told, on)


def _with_both(found: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """found (staged: sig_a, n_a, sig_b, n_b) with the column of either class."""
    side = lambda x: found.select(F.lit(x).alias("side"), F.col(f"sig_{x}").alias("sig"), F.col(f"n_{x}").alias("n"))
    sides, n = {}, found.count()
    if n > HOT_ROWS:
        counts = side("a").unionByName(side("b")).groupBy("side", "sig", "n").agg(F.count(F.lit(1)).alias("pairs"))
        hot = c.stage(counts.where(F.col("pairs") > max(HOT_SHARE * n, HOT_ROWS)), "hot-ends")  # 2 / HOT_SHARE rows at most
        sides = {r.side: hot.where(F.col("side") == r.side) for r in hot.select("side").distinct().collect()}
    for x in ("a", "b"):
        found = _with_side(found, of, column, x, sides.get(x))
    return found.select("sig_a", "n_a", "sig_b", "n_b", f"{column}_a", f"{column}_b")


def possible(found: DataFrame, bitmaps: DataFrame, t: int) -> DataFrame:
    """The pairs of found whose bitmaps leave the overlap possible (they give a least Hamming distance of the sets)."""

    def run(batches):
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                m = min(len(x), len(y))
                x, y = np.bitwise_xor.reduce(x.reshape(-1, m)), np.bitwise_xor.reduce(y.reshape(-1, m))
                ok[i] = 100 * (n[i] - int(np.bitwise_count(x ^ y).sum())) >= 2 * (-(-t * n[i] // (100 + t))) * 100
            yield batch.select(range(4)).filter(pa.array(ok))

    return _with_both(found, bitmaps, "bits").mapInArrow(run, "sig_a long, n_a int, sig_b long, n_b int")


def _counters(shingles: np.ndarray) -> list[np.ndarray]:
    """Each shingle's counters, one in each row of the sketch."""
    mask = np.uint64(WIDTH - 1)
    return [(shingles & mask).astype(np.int64), ((shingles >> np.uint64(32)) & mask).astype(np.int64) + WIDTH]


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """The sketch's counts on a scale of STEPS to a doubling, 2 * WIDTH of them."""

    def count(batches):
        total, held, size = np.zeros(2 * WIDTH, np.uint32), [], 0

        def add():
            nonlocal total
            for at in _counters(np.concatenate(held)):
                total += np.bincount(at, minlength=2 * WIDTH).astype(np.uint32)

        for _, _, n, sig, values, _ in _sets(batches, 0, k):
            # copies of one set in a chunk count once
            _, firsts = np.unique(sig, return_index=True)
            once = np.zeros(len(n), bool)
            once[firsts] = True
            held.append(values[np.repeat(once, n)])
            size += len(held[-1])
            if size >= COUNT_SHINGLES:
                add()
                held, size = [], 0
        if size:
            add()
        if total.any():
            blocks = range(2 * WIDTH // BLOCK)
            packed = [zlib.compress(total[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
        scaled = [(STEPS * np.log2(1 + x.astype(float))).astype(np.uint16).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(scaled, pa.binary())], names=["block", "counts"])

    made = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(merge, "block int, counts binary")
    out = np.zeros(2 * WIDTH, np.uint16)
    for r in made.collect():  # 2 * WIDTH counters in all
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint16)
    return out


class Order:
    """Rare shingles first, by the sketch; its ranks are steps of the scale."""

    def __init__(self, scale: np.ndarray):
        self.scale = scale
        counts = np.exp2(scale[:WIDTH].astype(np.float32) / STEPS)
        self.chance = float(counts.mean())

    def ranks(self, x: np.ndarray) -> np.ndarray:
        a, b = _counters(x)
        return np.minimum(self.scale[a], self.scale[b]).astype(np.int64)

    def tasks(self, rank: np.ndarray) -> np.ndarray:
        """To how many tasks the postings of shingles of these ranks go."""
        sure = np.exp2(rank / STEPS) - self.chance - 5 * self.chance**0.5
        return 1 + (np.maximum(sure, 0) // HOT_ROWS).astype(np.int64)


def prefix_length(n: np.ndarray, t: int) -> np.ndarray:
    return n - -(-t * n // 100) + 1


def postings(docs: DataFrame, scale: np.ndarray, k: int, t: int) -> DataFrame:
    """shingle, part, sig, n, pos, low of the prefixes of all sets.

    low is the number of the shingles behind pos, in the global order, that are below 2^63 by value: it splits the suffix in
    two, and what two suffixes share is at most the sum of the smaller halves. part is 0 but for shingles of several tasks,
    where it is their class's share, from 1."""
    told = docs.sparkSession.sparkContext.broadcast(scale)  # of a fixed size

    def run(batches):
        order = Order(told.value)
        for _, _, n, sig, values, bounds in _sets(batches, 0, k):
            _, firsts = np.unique(sig, return_index=True)
            rank = order.ranks(values)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.lexsort((values, rank, owner))  # owner is ascending already, so places stay in their rows
            small = np.concatenate(([0], np.cumsum(values[place] < np.uint64(1 << 63))))
            low = small[bounds[1:]][owner] - small[1:]
            pos = np.arange(len(values)) - bounds[owner]
            once = np.zeros(len(n), bool)
            once[firsts] = True
            take = (pos < prefix_length(n, t)[owner]) & once[owner]
            place, owner = place[take], owner[take]
            tasks = order.tasks(rank[place]).astype(np.uint64)
            part = np.where(tasks > 1, c.mix(sig[owner]) % tasks + np.uint64(1), np.uint64(0))
            out = (
                values[place].view(np.int64), part.astype(np.int32), sig.view(np.int64)[owner], n[owner].astype(np.int32), pos[take].astype(np.int32),
                low[take].astype(np.int32),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["shingle", "part", "sig", "n", "pos", "low"])

    return docs.select("text").mapInArrow(run, "shingle long, part int, sig long, n int, pos int, low int")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in batch.columns]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def shared(rows: DataFrame) -> DataFrame:
    """shingle, sig, n, pos, low: postings of shingles that two classes or more have (or that are dealt to several tasks), each class once."""
    names = ["shingle", "sig", "n", "pos", "low"]

    def run(batches):
        last = None  # the last row of the batch before, and whether it has gone out
        gone = False
        for batch in batches:
            cols = _columns(batch)
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(last, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:4]])
            cols = [x[new] for x in cols]
            heads = _starts(cols[0])
            count = np.diff(np.append(heads, len(cols[0])))
            several = count > 1
            several[0] |= gone
            keep = np.repeat(several, count) | (cols[1] > 0)
            gone_now = bool(keep[-1])
            if gone:
                keep[0] = False
            last, gone = [x[-1:] for x in cols], gone_now
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for n, x in enumerate(cols) if n != 1], names=names)

    parted = rows.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "sig", "n")
    return parted.mapInArrow(run, "shingle long, sig long, n int, pos int, low int")


def leaders_of(rows: DataFrame, most: int, turn: int) -> DataFrame:
    """shingle, lead (a class of it), left: `most` leaders at most of each shingle whose classes aren't all connected.

    left tells whether two classes or more remain that don't lead. The classes are dealt into `most` groups by hash, and the first of each
    group by pos leads; both steps combine on the map side."""
    group = F.pmod(F.xxhash64("sig", F.lit(turn)), F.lit(most)) if most > 1 else F.lit(0)
    first = (
        rows.groupBy("shingle", group.alias("group"))
        .agg(
            F.min(F.struct("pos", "sig", "n", "low", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    if most == 1:
        return first.where(F.col("lo") != F.col("hi")).select("shingle", "lead", (F.col("rows") > 2).alias("left"))
    all_ = (
        first.groupBy("shingle")
        .agg(F.collect_list("lead").alias("leads"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    )
    all_ = all_.where(F.col("lo") != F.col("hi"))
    return all_.select("shingle", F.explode("leads").alias("lead"), (F.col("rows") > F.size("leads") + 1).alias("left"))


def pairs(rows: DataFrame, leads: DataFrame, t: int) -> DataFrame:
    """sig_a, n_a, sig_b, n_b (the smaller first): leaders with classes of their shingles that can link with them.

    Pairs within a component are left out. The bounds are by length, and by the place of the shingle with the halves of what stands behind it:
    at the first shingle that two sets share in the global order, they share no more than it and the smaller halves."""
    n, m = F.col("n"), F.col("lead.n")
    need = F.expr(f"({t}L * (n + lead.n) + {99 + t}L) div {100 + t}L")
    halves = F.least("low", "lead.low") + F.least(n - F.col("pos") - 1 - F.col("low"), m - F.col("lead.pos") - 1 - F.col("lead.low"))
    fits = (F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * t) & (halves + 1 >= need)
    leads = F.broadcast(leads) if c.small(leads) else leads
    both = rows.join(leads.select("shingle", "lead"), (rows["shingle"] == leads["shingle"]) & (F.col("comp") != F.col("lead.comp")) & fits)
    a, b = F.struct(F.col("sig"), n.alias("n")), F.struct(F.col("lead.sig").alias("sig"), m.alias("n"))
    ordered = both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return (
        ordered.select(F.col("a.sig").alias("sig_a"), F.col("a.n").alias("n_a"), F.col("b.sig").alias("sig_b"), F.col("b.n").alias("n_b")).distinct()
    )


def _ends(found: DataFrame) -> DataFrame:
    """sig, n of the classes in found."""
    side = lambda x: found.select(F.col(f"sig_{x}").alias("sig"), F.col(f"n_{x}").cast("long").alias("n"))
    return side("a").unionByName(side("b")).distinct()


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """sig, n, shingles (binary, 8 bytes each, sorted) of the documents in ids (doc, digest; one of each class)."""

    def run(batches):
        for _, _, n, sig, values, bounds in _sets(batches, 0, k):
            at = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, at, pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32)), raw], names=["sig", "n", "shingles"])

    wanted = c.join_checked(_named(docs), ids, ["doc", "digest"], "left_semi")
    return wanted.select("text").mapInArrow(run, "sig long, n int, shingles binary").dropDuplicates(["sig", "n"])


def verified(found: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs of found whose whole sets overlap enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(4), batch.column(5)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= t * (len(x) + len(y) - both)
            yield batch.select(range(4)).filter(pa.array(ok))

    return _with_both(found, sets, "shingles").mapInArrow(run, "sig_a long, n_a int, sig_b long, n_b int")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each node's component, for the nodes of edges (a, b).

    Large-star and small-star steps, each a group-by and a join, by turns until the edges are stars: no node has two centres,
    and no centre has one itself."""
    edges = c.stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: each node's larger neighbours link to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = c.stage(large, "large-star")
        # small star: each node and its smaller neighbours link to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = c.stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        sides = (
            edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v"))
            .unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        )
        seen = sides.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.sum("as_v").alias("as_v"))
        if seen.where((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0))).isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return c.stage(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct(), "components")


def _connected(docs: DataFrame, known: DataFrame, k: int, t: int) -> DataFrame | None:
    """node, comp (sig and n of classes) of all classes that link with others; None if none do. known: the staged table of `classes`."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "digest")).alias("first")
    firsts = c.stage(known.where(F.col("n") > 0).groupBy("sig", "n").agg(first).select("sig", "n", "first.doc", "first.digest"), "class-firsts")
    lists = c.stage(shared(postings(docs, frequencies(docs, k), k, t)), "postings")
    key = F.struct(F.col("sig"), F.col("n").cast("long").alias("n"))
    comps, judged, turn = None, None, 0
    while True:
        most = LEADERS[min(turn, len(LEADERS) - 1)]
        rows = lists.withColumn("comp", key)
        if comps is not None:
            of = comps.select(F.col("node.sig").alias("sig"), F.col("node.n").cast("int").alias("n"), F.col("comp").alias("of"))
            rows = c.join_checked(rows, of, ["sig", "n"], "left").withColumn("comp", F.coalesce("of", "comp")).drop("of")
            rows = c.stage(rows, "connected-postings")
        leads = c.stage(leaders_of(rows, most, turn), "leaders")
        if leads.isEmpty():
            return comps
        found = pairs(rows, leads, t)
        if judged is not None:
            found = found.join(judged, ["sig_a", "n_a", "sig_b", "n_b"], "left_anti")
        found = c.stage(found, "pairs")
        bitmaps = known.join(_ends(found), ["sig", "n"], "left_semi").dropDuplicates(["sig", "n"])
        real = c.stage(possible(found, bitmaps, t), "possible-pairs")
        ids = c.stage(firsts.join(_ends(real), ["sig", "n"], "left_semi").select("doc", "digest"), "ends")
        good = c.stage(verified(real, sets_of(docs, ids, k), t), "links")
        a = F.struct(F.col("sig_a").alias("sig"), F.col("n_a").cast("long").alias("n"))
        b = F.struct(F.col("sig_b").alias("sig"), F.col("n_b").cast("long").alias("n"))
        edges = good.select(a.alias("a"), b.alias("b"))
        if comps is not None:  # what is connected already stays so, as stars
            edges = edges.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        if comps is not None or not good.isEmpty():
            comps = components(edges)
        judged = found if judged is None else judged.unionByName(found)
        more = leads.where("left").select("shingle", "lead.sig", "lead.n")
        side = F.broadcast if c.small(more) else lambda x: x
        kept = rows.drop("comp").join(side(more.select("shingle").distinct()), "shingle", "left_semi")
        lists = c.stage(kept.join(side(more), ["shingle", "sig", "n"], "left_anti"), "postings")
        turn += 1


def near_components(docs: DataFrame, k: int = K, t: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    c.small_batches(docs.sparkSession)
    known = c.stage(classes(docs, k), "classes")
    comps = _connected(docs, known, k, t)
    ids = known.where(F.col("n") > 0).groupBy("sig", "n").agg(F.min("doc_id").alias("least"))
    if comps is not None:
        of = comps.select(F.col("node.sig").alias("sig"), F.col("node.n").alias("n"), "comp")
        joined = c.stage(ids.join(of, ["sig", "n"], "left").withColumn("comp", F.coalesce("comp", F.struct("sig", "n"))), "class-components")
        least = c.stage(joined.groupBy("comp").agg(F.min("least").alias("of_all")), "least-ids")
        ids = c.join_checked(joined, least, ["comp"], "inner").select("sig", "n", F.col("of_all").alias("least"))
    out = c.join_checked(known, c.stage(ids, "component-ids"), ["sig", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = K, t: int = THRESHOLD) -> DataFrame:
    """The documents with all their columns: one row of each component, and all that link with nothing."""
    c.small_batches(docs.sparkSession)
    known = c.stage(classes(docs, k), "classes")
    comps = _connected(docs, known, k, t)
    rows = (
        known.where(F.col("n") > 0)
        .select("sig", "n", "digest", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"))
    )
    rows = rows.groupBy("sig", "n", "no_id", "doc", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("comp", F.struct("sig", "n"))
    if comps is not None:
        of = comps.select(F.col("node.sig").alias("sig"), F.col("node.n").alias("n"), F.col("comp").alias("of"))
        rows = c.join_checked(rows, of, ["sig", "n"], "left").withColumn("comp", F.coalesce("of", "comp"))
    rows = c.stage(rows.select("comp", "no_id", "doc", "digest", "copies"), "members")
    first = rows.groupBy("comp").agg(F.min(F.struct("no_id", "doc", "digest")).alias("first"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    first = c.stage(first.select("comp", "first"), "kept-rows")
    told = c.join_checked(rows, first, ["comp"], "inner").withColumn("stays", F.struct("no_id", "doc", "digest") == F.col("first"))
    told = told.where(~F.col("stays") | (F.col("copies") > 1))
    acts = c.stage(told.select("doc", "digest", "stays"), "near-copies")
    inner, at = c.by_place(docs)
    doc, digest = _key(at["doc_id"], at["text"])
    joined = c.join_checked(inner.withColumns({"doc": doc, "digest": digest}), acts, ["doc", "digest"], "left")
    alone = joined.where(F.col("stays").isNull()).select(*at.values())
    # rows that repeat both doc_id and text, of which one is to stay
    return alone.unionByName(joined.where("stays").dropDuplicates(["doc", "digest"]).select(*at.values())).toDF(*docs.columns)
