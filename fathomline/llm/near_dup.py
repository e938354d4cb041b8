"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Each text becomes its set of k-word shingles (64-bit hashes); texts with equal sets are one class from here on, with a key of its own, whatever ids its rows have.
2. A set of any size gets a sketch of T coordinates. In round i < T each shingle is thrown into a random bin, in round T + j all go to bin j; a bin
   keeps the smallest (round, hash). Rounds end when all bins are full, which takes about T ln T throws, so every coordinate is
   filled and the share of equal coordinates of two sketches concentrates around their Jaccard similarity as if drawn without replacement.
3. Bands of ROWS coordinates are bucket keys. A pair at similarity .8 shares none of the 42 bands with a chance of 3e-6.
4. In each bucket, sketches screen the pairs; the bucket gives one star for each group of similar sketches, never its pairs.
5. The components of those stars are clusters. Texts of a cluster are compared exactly on full sets, which gives one star for each linked group. Components of these links, and of those between classes that share an id, are the result.

Steps 4 and 5 compare every member with its bucket's or cluster's smallest member first, in time linear in the members. Those that match it are connected, so they meet only the others afterwards: others are
active and meet everyone, in pairs of blocks dealt out over tasks. No task holds more than two blocks, and no partner is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.components import connected_components
from fathomline.llm.shared import parts, released, set_up, text_of, written

COORDINATES = 256
ROWS = 6
BANDS = COORDINATES // ROWS
#: Five standard deviations of a sketch's estimate below the threshold.
SLACK = 5.0
BLOCK = 1024
U = np.uint64


def sketches(hashes: np.ndarray, counts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of t uint64 for each set; an empty set has all ones. t is a power of two, below 2**15."""
    out = np.full(len(counts) * t, np.iinfo(U).max, U)
    text = np.repeat(np.arange(len(counts)), counts)
    live = counts > 0
    for i in range(2 * t):
        h = W.mix(hashes ^ U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = text * t + ((h & U(t - 1)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, place, (U(i) << U(48)) | (h >> U(16)))
        full = (out.reshape(-1, t) != np.iinfo(U).max).all(1) | ~live
        if full.all():
            break
        if full[text].any():
            keep = ~full[text]
            hashes, text = hashes[keep], text[keep]
    return out.reshape(-1, t)


def shingle_sets(column: pa.Array, k: int):
    """(rows from, to, sorted distinct shingles, their number by text), for pieces of a column of bounded bytes."""
    for at, to in W.pieces(column):
        data, offsets = W.bytes_of(column.slice(at, to - at))
        start, end, n = W.spans(data, offsets, W.SPACED)
        yield at, to, *W.distinct(*W.shingles(W.word_hashes(data, start, end), n, k))


def _sketch_batches(k: int):
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for at, to, hashes, n in shingle_sets(column, k):
                sketch = sketches(hashes, n)
                text = np.repeat(np.arange(to - at), n)
                with np.errstate(over="ignore"):
                    ones = np.zeros(to - at, U)
                    twos = np.zeros(to - at, U)
                    np.add.at(ones, text, W.mix(hashes))
                    np.add.at(twos, text, W.mix(hashes ^ U(0x5851F42D4C957F2D)))
                    bands = sketch[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                    factor = W.mix(np.arange(1, ROWS + 1, dtype=U)) | U(1)
                    keys = W.mix((W.mix(bands) * factor).sum(2) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
                low = np.ascontiguousarray((sketch ^ (sketch >> U(8))).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        batch.column(1).slice(at, to - at),
                        pa.array(n.astype(np.int64)),
                        pa.array(ones.view(np.int64)),
                        pa.array(twos.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                    ],
                    ["doc_id", "said", "n_shingles", "set_1", "set_2", "bands", "sketch"],
                )

    return run


class Sets:
    """Union-find over 0..n-1; a set's root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def groups(batches, n_keys: int):
    """Whole groups, as tables, of batches that are sorted by their first n_keys columns (integers)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for at, to in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(at, to - at)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def stars(ids: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets with several members: (member, smallest id of its set), without the smallest itself."""
    order = np.lexsort((ids, roots))
    r, i = roots[order], ids[order]
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]
    least = i[np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))]
    keep = least != i
    return i[keep], least[keep]


def _pairs_out(found: list):
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def floor_of(percent: float) -> float:
    """The least share of equal coordinates at which a pair is still looked at."""
    p = percent / 100
    return p - SLACK * (p * (1 - p) / COORDINATES) ** 0.5


def _near_pivot(percent: float):
    """Of (keys..., rep, sketch, pivot's sketch): whether the two sketches are similar."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            if batch.num_rows:
                own, pivot = _matrix(batch.column(n - 2)), _matrix(batch.column(n - 1))
                like = (own == pivot).sum(1) >= floor_of(percent) * own.shape[1]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 2)), pa.array(like)], [*batch.schema.names[: n - 2], "passive"])

    return run


def _screen(percent: float):
    """In each pair of blocks of a bucket: stars of the groups that similar sketches connect. Passive members are connected from the start."""

    def run(batches):
        found, waiting = [], 0
        for table in groups(batches, 3):
            ids, passive, sketch = table.column(3).to_numpy(), table.column(4).to_numpy(), _matrix(table.column(5))
            known, least = Sets(len(ids)), floor_of(percent) * sketch.shape[1]
            calm = np.flatnonzero(passive)
            for x in calm[1:]:
                known.join(int(calm[0]), int(x))
            active = np.flatnonzero(~passive)
            for place, x in enumerate(active):
                rest = active[place + 1 :]
                for y in rest[(sketch[rest] == sketch[x]).sum(1) >= least]:
                    known.join(int(x), int(y))
                if len(calm) and ((sketch[calm] == sketch[x]).sum(1) >= least).any():
                    known.join(int(x), int(calm[0]))
            found.append(stars(ids, known.roots()))
            waiting += len(found[-1][0])
            if waiting > 50_000:
                yield from _pairs_out(found)
                found, waiting = [], 0
        yield from _pairs_out(found)

    return run


def _meets_pivot(k: int, percent: float):
    """Of (rep, component, text, pivot's text): whether the two are linked, by full sets. Rows of one cluster follow each other, so a pivot's set is made once."""

    def run(batches):
        last, pivot = None, np.zeros(0, U)
        for batch in batches:
            out = []
            clusters = batch.column(1).to_pylist()
            for at, to, hashes, n in shingle_sets(batch.column(2), k):
                for i, own in enumerate(np.split(hashes, np.cumsum(n)[:-1]), at):
                    if clusters[i] != last:
                        last, pivot = clusters[i], next(shingle_sets(batch.column(3).slice(i, 1), k))[2]
                    out.append(bool(len(own)) and bool(len(pivot)) and bool(_linked([pivot, own], 0, np.array([1]), percent)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["rep", "component", "passive"])

    return run


def _linked(sets: list[np.ndarray], x: int, others: np.ndarray, percent: float) -> np.ndarray:
    """Which of the others have a similarity of at least percent to x, by full sets."""
    size = np.array([len(sets[o]) for o in others])
    both = np.concatenate([sets[o] for o in others])
    place = np.minimum(np.searchsorted(sets[x], both), len(sets[x]) - 1)
    same = np.add.reduceat((sets[x][place] == both).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return 100 * same >= percent * (size + len(sets[x]) - same)


def _verify(k: int, percent: float):
    """In each block (or pair of blocks) of a cluster: stars of the groups that true links connect."""

    def run(batches):
        found, waiting = [], 0
        for table in groups(batches, 4):
            if len(table) < 2:
                continue
            ids, native, passive, sketch = table.column(4).to_numpy(), table.column(5).to_numpy().astype(bool), table.column(6).to_numpy(), _matrix(table.column(7))
            sets: list[np.ndarray] = []
            for _, _, hashes, n in shingle_sets(table.column(8).combine_chunks(), k):
                sets += np.split(hashes, np.cumsum(n)[:-1])
            sizes = np.array([len(s) for s in sets])
            known = Sets(len(ids))
            calm = np.flatnonzero(passive)
            for x in calm[1:]:
                known.join(int(calm[0]), int(x))
            order = np.argsort(~native, kind="stable")  # natives first: a guest meets natives only
            for place, x in enumerate(order[: int(native.sum())]):
                rest = order[place + 1 :]
                rest = rest[(100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])) & (sizes[rest] > 0)]
                if not len(rest) or not sizes[x]:
                    continue
                alike = (sketch[rest] == sketch[x]).sum(1)
                like = alike >= floor_of(percent) * sketch.shape[1]
                rest = rest[like][np.argsort(-alike[like], kind="stable")]
                step = 1
                while len(rest):
                    root = known.find(x)
                    rest = rest[[known.find(r) != root for r in rest]]
                    if not len(rest):
                        break
                    tried, rest = rest[:step], rest[step:]
                    for y in tried[_linked(sets, x, tried, percent)]:
                        known.join(x, int(y))
                    step = min(step * 8, 512)
            found.append(stars(ids, known.roots()))
            waiting += len(found[-1][0])
            if waiting > 50_000:
                yield from _pairs_out(found)
                found, waiting = [], 0
        yield from _pairs_out(found)

    return run


def _blocks(rows: DataFrame, by: Column, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Adds p <= q, so that any two rows of a group (keys) of which one is active meet in some (p, q). rows have a column passive; a group without an active row goes.

    Actives lie in the first blocks and passives in those after; an active row goes to every pair that names its block, a passive one to its block's pairs with active blocks.
    """
    share = F.lit(1.0 / BLOCK) if weight is None else F.greatest(F.lit(1.0 / BLOCK), weight / 1_500_000)
    loads = rows.groupBy(*keys).agg(F.ceil(F.sum(F.when(~F.col("passive"), share))).alias("_a"), F.ceil(F.sum(F.when(F.col("passive"), share))).alias("_c"), F.count("*").alias("_n"))
    loads = written(loads.where("_a is not null and _n > 1").select(*keys, "_a", F.coalesce("_c", F.lit(0).cast("bigint")).alias("_c")), "near-loads")
    own = F.when(F.col("passive"), F.col("_a") + F.pmod(F.xxhash64(by), F.greatest("_c", F.lit(1)))).otherwise(F.pmod(F.xxhash64(by), F.col("_a")))
    dealt = rows.join(loads, keys).withColumn("_s", own)
    last = F.when(F.col("passive"), F.col("_a") - 1).otherwise(F.col("_a") + F.col("_c") - 1)
    return dealt.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumns({"p": F.least("_s", "_t"), "q": F.greatest("_s", "_t")}).drop("_s", "_t", "_a", "_c")


def _dealt(rows: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """Rows with p <= q, each pair of blocks in one partition. The pairs of a group are numbered and go round the partitions from a place of the group's own, so a large group's pairs are spread evenly."""
    n = parts(docs)
    pair = F.pmod(F.xxhash64(*keys), F.lit(n)) + F.expr("q * (q + 1) div 2 + p")
    return rows.repartitionById(n, F.pmod(pair, F.lit(n)).cast("int"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: float = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that chains of links reach), kept.

    A text's set: its distinct k-word shingles, of words parted by [\\x20\\x09-\\x0D]+, A-Z in lower case; a text with fewer words, but not
    none, is one shingle. Two texts are linked when 100 * intersection >= percent * union of the full sets. A null, empty or blank
    text has an empty set and is linked with nothing; nor is a row without doc_id, whose component_id is null and which is kept. Rows that share a doc_id count as one node of the graph, each with a row of its own. An empty table gives an empty one;
    further columns, whatever their names, are not read.
    """
    set_up(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id bigint, said bigint, n_shingles bigint, set_1 bigint, set_2 bigint, bands array<bigint>, sketch binary"
    each = written(rows.select("doc_id", F.xxhash64("text").alias("said"), "text").mapInArrow(released(_sketch_batches(k)), schema), "near-sketches")
    alike = ["n_shingles", "set_1", "set_2"]
    classes = each.where("n_shingles > 0 and doc_id is not null").groupBy(*alike).agg(F.min(F.struct("doc_id", "said")).alias("shown"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "near-classes")

    in_band = classes.select(F.explode("bands").alias("band"), "rep")
    buckets = in_band.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "least", "members").agg(F.min("band").alias("band"))  # the same texts meet in many bands: once is enough
    sketch = classes.select("rep", "sketch")
    pivots = sketch.select(F.col("rep").alias("least"), F.col("sketch").alias("pivot"))
    in_bucket = in_band.join(buckets.select("band", "least"), "band").join(sketch, "rep").join(pivots, "least").select("band", "least", "rep", "sketch", "pivot")
    in_bucket = written(in_bucket.mapInArrow(released(_near_pivot(percent)), "band bigint, least bigint, rep bigint, passive boolean"), "near-buckets")
    to_pivot = in_bucket.where("passive and rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    screened = _blocks(in_bucket.select("band", "rep", "passive"), F.col("rep"), ["band"]).join(sketch, "rep").select("band", "p", "q", "rep", "passive", "sketch")
    screened = _dealt(screened, docs, "band").sortWithinPartitions("band", "p", "q")
    clusters = connected_components(to_pivot.union(screened.mapInArrow(released(_screen(percent)), "a bigint, b bigint")))

    shown = clusters.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "shown.doc_id", "shown.said"), "rep")
    shown = shown.join(rows.withColumn("said", F.xxhash64("text")), ["doc_id", "said"]).groupBy("doc_id", "said", "rep", "component").agg(F.first("text").alias("text"))  # one text of each class
    members = written(shown.select("rep", "component", "text"), "near-members")
    pivots = members.where("rep = component").select("component", F.col("text").alias("pivot"))
    met = members.join(pivots, "component").select("rep", "component", "text", "pivot").mapInArrow(released(_meets_pivot(k, percent)), "rep bigint, component bigint, passive boolean")
    met = written(met, "near-met")
    to_pivot = met.where("passive and rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))
    width = float(np.log(100 / percent) * 1.001) if percent < 100 else 1e-9
    sized = met.join(classes.select("rep", "n_shingles"), "rep").withColumn("size", F.floor(F.log(F.col("n_shingles").cast("double")) / width))
    both = F.array(F.struct(F.col("size").alias("g"), F.lit(1).alias("native")), F.struct((F.col("size") - 1).alias("g"), F.lit(0).alias("native")))
    dealt = sized.select("component", "rep", "passive", "n_shingles", F.explode(both).alias("to")).select("component", F.col("to.g").alias("g"), F.col("to.native").alias("native"), "rep", "passive", "n_shingles")
    dealt = _blocks(dealt, F.col("rep"), ["component", "g"], F.col("n_shingles")).join(sketch, "rep").join(members.select("rep", "text"), "rep")
    dealt = dealt.select("component", "g", "p", "q", "rep", "native", "passive", "sketch", "text")
    dealt = _dealt(dealt, docs, "component", "g").sortWithinPartitions("component", "g", "p", "q")
    # rows that share an id are one node: all classes of an id hang on its first
    named, kind = each.where("n_shingles > 0 and doc_id is not null").select("doc_id", *alike), F.struct(*alike)
    several = named.groupBy("doc_id").agg(F.min(kind).alias("x"), F.max(kind).alias("y")).where("x <> y").select("doc_id")
    of_row = named.join(several, "doc_id", "left_semi").distinct().join(classes.select(*alike, "rep"), alike).select("doc_id", "rep")
    first = of_row.groupBy("doc_id").agg(F.min("rep").alias("b"))
    one_id = of_row.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    links = connected_components(to_pivot.union(dealt.mapInArrow(released(_verify(k, percent)), "a bigint, b bigint")).union(one_id))

    least = links.join(classes.select(F.col("rep").alias("node"), "shown.doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = links.join(least, "component").select("node", "least")
    of_class = classes.join(named, F.col("rep") == F.col("node"), "left").select(*alike, F.coalesce("least", "shown.doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    rows = each.select("doc_id", *alike).join(of_class, alike, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: float = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies, with all its columns: of each group of rows that chains of links connect, the row of the smallest doc_id stays.

    Each row is a node of its own, under a key that is written with it, so rows that share a doc_id are told apart. Null doc_ids come after all others; of rows with the same smallest doc_id
    the first as they were written stays. Null, empty and blank texts are linked with nothing and stay, repeated ones too; an empty table gives an empty one; columns may have any names.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows")
    linked = near_duplicates(rows, k, percent, key, text).where("component_id <> doc_id").select(F.col("doc_id").alias(key), "component_id")
    linked = written(linked, "near-linked")
    members = linked.union(linked.select("component_id").distinct().select(F.col("component_id").alias(key), "component_id"))
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("null"), F.col(f"`{doc_id}`").alias("id"), F.col(key).alias("key"))
    stay = members.join(rows.select(key, order.alias("_order")), key).groupBy("component_id").agg(F.min("_order").alias("_first"))
    gone = members.select(key).join(stay.select(F.col("_first.key").alias(key)), key, "left_anti")
    return rows.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
