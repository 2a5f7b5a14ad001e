"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts makes, for each document, its set of word shingles (as 64-bit hashes), 128 minima, and from
   these the band keys (four whole minima each) and a signature that keeps two low bits of each minimum (32 bytes).
2. Documents with equal sets fall together first, so that thousands of copies count as one.
3. Documents that share a band key are compared by signature within the task: bit counts of the XOR, corrected for
   chance collisions of two-bit values. Pairs above a loose threshold are joined into families; only a spanning tree of
   links leaves the task, never all pairs.
4. Within each family links are confirmed on full sets, rebuilt from whole texts.

Band keys and families of any size are split into blocks, and each pair of blocks is a task of its own, so that no
task holds more than two blocks; a group's links are the union over its pairs of blocks, so none is lost to the split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, join_counted, materialize, narrow, runs, utf8
from .components import connected_components

HASHES, ROWS, BANDS, BITS = 128, 4, 24, 2
#: Signature estimates have a standard deviation of about 0.042 at a similarity of 0.8.
SLACK = 0.18
#: Documents of a band key, and documents and shingles of a family, that one block holds.
KEY_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 4096, 1024, 2_000_000

_LOW = np.uint64(0x5555555555555555)
_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes. Letters A-Z count as lower case; words end at ASCII white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, data: bytes) -> np.ndarray:
        import xxhash

        found, known = data.lower().split(), self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        n = min(self.words, len(h))
        if n == 0:
            return h
        s = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            s = (s ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, ((s[None, i : i + 2048] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    k = np.arange(BANDS, dtype=np.uint64)
    for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        k = (k ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        k ^= k >> np.uint64(31)
    return k.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """BITS low bits of each folded minimum, packed."""
    low = ((least ^ (least >> np.uint64(32))) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, -BITS:].ravel()).tobytes()


def estimated(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: equal values less those that would be equal by chance."""
    x = one ^ others
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=-1)
    by_chance = 2.0**-BITS
    return (1 - differ / HASHES - by_chance) / (1 - by_chance)


def _sketches(words: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        import xxhash

        shingles = Shingler(words)
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                piece = batch.slice(part, 1024)
                rows = []
                for data in utf8(piece.column("text")):
                    s = shingles(data)
                    if len(s) == 0:
                        rows.append((0, 0, 0, None, None))
                        continue
                    least = minima(s)
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                    rows.append((len(s), int(a), int(b), signature(least), band_keys(least)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([piece.column("id"), *[pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return run


def _merge(group: np.ndarray, i: int, hits: np.ndarray) -> None:
    """Puts i and hits into one group; group holds a label for each row."""
    labels = np.unique(np.append(group[hits], group[i]))
    group[np.isin(group, labels)] = labels[0]


def _stars(ids: np.ndarray, group: np.ndarray):
    """(smallest id of the group, id) for all but the smallest."""
    order = np.lexsort((ids, group))
    g, d = group[order], ids[order]
    first = np.append(True, g[1:] != g[:-1])
    root = d[first][np.cumsum(first) - 1]
    return root[~first], d[~first]


def _likely(threshold: float):
    """Links between documents of one band key whose signatures look alike."""
    least = threshold - SLACK

    def run(batches):
        for table in runs(batches, ["key", "i", "j"]):
            at = bounds(table, ["key", "i", "j"])
            ids = table.column("id").to_numpy()
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[estimated(sig[two], sig[two + 1]) >= least]
            a, b = [ids[two]], [ids[two + 1]]
            for lo, hi in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
                d, s = ids[lo:hi], sig[lo:hi]
                group = np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
                    if len(rest) and len(hits := rest[estimated(s[i], s[rest]) >= least]):
                        _merge(group, i, hits)
                roots, others = _stars(d, group)
                a.append(roots)
                b.append(others)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _confirmed(words: int, threshold_percent: int):
    """Links of a family, exact: 100 * intersection >= threshold_percent * union on full sets."""

    def run(batches):
        shingles = Shingler(words)
        for table in runs(batches, ["family", "i", "j"]):
            at = bounds(table, ["family", "i", "j"])
            all_ids, texts, alone = table.column("id").to_numpy(), table.column("text"), table.column("alone").to_pylist()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                ids = all_ids[lo:hi]
                sets = [shingles(x) for x in utf8(texts.slice(lo, hi - lo))]
                size = np.array([len(s) for s in sets])
                start = np.concatenate(([0], np.cumsum(size)))
                flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
                group = np.unique(ids, return_inverse=True)[1]
                marked = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
                for i in range(hi - lo - 1):
                    rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
                    fits = 100 * np.minimum(size[rest], size[i]) >= threshold_percent * np.maximum(size[rest], size[i])
                    rest = rest[fits & (size[rest] > 0)]
                    if len(rest) == 0 or size[i] == 0:
                        continue
                    own = flat[start[i] : start[i + 1]]
                    marked[own] = True
                    if len(rest) < 16:
                        both = np.array([np.count_nonzero(marked[flat[start[r] : start[r + 1]]]) for r in rest])
                    else:
                        where = np.concatenate([np.arange(start[r], start[r + 1]) for r in rest])
                        both = np.add.reduceat(marked[flat[where]].astype(np.int64), np.concatenate(([0], np.cumsum(size[rest])[:-1])))
                    marked[own] = False
                    hits = rest[100 * both >= threshold_percent * (size[rest] + size[i] - both)]
                    if len(hits):
                        _merge(group, i, hits)
                roots, others = _stars(ids, group)
                yield pa.RecordBatch.from_pydict({"a": roots, "b": others, "alone": np.full(len(roots), alone[lo])})

    return run


def _blocked(df: DataFrame, blocks, *spread) -> DataFrame:
    """Adds i, j: a row of block x of n goes to each pair of blocks with x in it."""
    block = F.pmod(F.xxhash64(*spread), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda y: F.struct(F.least(F.col("_block"), y).alias("i"), F.greatest(F.col("_block"), y).alias("j")))
    return df.withColumn("_block", block).withColumn("_pair", F.explode(pairs)).select(*df.columns, "_pair.i", "_pair.j")


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Two documents are linked when 100 * |A and B| >= threshold_percent * |A or B| on their sets of shingles; a text of
    fewer words than a shingle has is one shingle. Null, empty or blank texts have empty sets, link with nothing and stay
    in a component of their own. Rows with equal ids are one node; rows with a null id link with nothing, have a null
    component_id and are kept. Repeated rows come out as often as they went in. Other columns of docs are not read.
    At a similarity of exactly 0.8 a pair misses all bands with a chance of 3e-6.
    """
    docs = narrow(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    parts = _parts(docs)
    sketches = materialize(docs.mapInArrow(_sketches(shingle_words), "id long, n_shingles long, set_a long, set_b long, signature binary, keys array<long>"), "sketches")
    filled = sketches.filter("n_shingles > 0 and id is not null")
    sets = materialize(filled.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "n_shingles", "signature", "keys")).alias("m"), F.count("*").alias("copies")).select("set_a", "set_b", "copies", "m.*"), "sets")
    n_sets, n_filled = sets.agg(F.count("*"), F.sum("copies")).first()

    keys = sets.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    met = join_counted(keys, shared, ["key"], BANDS * n_sets).join(sets.select("id", "signature"), "id")
    met = _blocked(met, F.ceil(F.col("size") / KEY_BLOCK), "id").select("key", "i", "j", "id", "signature")
    likely = met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(_likely(threshold_percent / 100), "a long, b long")
    family = materialize(connected_components(likely).withColumnRenamed("component", "family"), "families")

    members = family.join(sets.select(F.col("id").alias("node"), "n_shingles"), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES)).alias("blocks"))
    members = members.join(sizes, "family").select(F.col("node").alias("id"), "family", "blocks")
    texts = docs.join(members.hint("shuffle_hash"), "id")
    texts = _blocked(texts, F.col("blocks"), "id").select("family", "i", "j", "id", "text", (F.col("blocks") == 1).alias("alone"))
    links = texts.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "id").mapInArrow(_confirmed(shingle_words, threshold_percent), "a long, b long, alone boolean")
    links = materialize(links, "confirmed")
    # a family of one block is closed: its links point at the component's smallest id already
    component = links.filter("alone").select(F.col("b").alias("node"), F.col("a").alias("component_id")).distinct()
    if not (split := links.filter("not alone").select("a", "b")).isEmpty():
        component = component.union(connected_components(split))

    named = sets.select("set_a", "set_b", F.col("copies").alias("n"), F.col("id").alias("node")).join(component, "node", "left")
    named = materialize(named.select("set_a", "set_b", "n", F.coalesce("component_id", "node").alias("component_id")), "named")
    out = join_counted(filled.select("id", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b"], n_filled or 0).select("id", "n_shingles", "component_id")
    alone = sketches.filter("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates() doesn't keep. Of rows with one id all stay or go."""
    gone = near_duplicates(docs, id_col, text_col, **how).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def bands_miss(similarity: float) -> float:
    """The chance that a pair of this similarity shares no band key."""
    return math.pow(1 - similarity**ROWS, BANDS)
