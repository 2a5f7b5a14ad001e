"""Prefix trie of conversations, built by cutting sequences at half depth as the van Emde Boas layout does.

A sequence of up to 2w turns is cut after w: the first half belongs to an upper trie, and the second to a lower forest
whose root is the cut prefix. The prefix is named by the hash of its start and of the block it takes in (blocks are named
pairwise from turns), so that both halves are named without waiting for each other, down to single turns. Cuts stand at
the same depths in all sequences, hence equal prefixes have equal names. Sequences of more than TILE turns are cut into
tiles first: the upper trie is then the one of the sequences of tiles, named by the same recursion in Spark, and a tile is
the most that one row ever holds.

Totals go up the same way: at width w each forest root at an odd multiple of w adds its total to the w nodes above it, for
w = 1, 2, 4, ...; so a trie of depth d needs log2(d) rounds instead of d. Names are SHA-256, taken as equal only where what
they name is. The table of paths has a row for each turn of each rebuilt conversation, which bounds all that is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: Turns in one row at most, as a power of two.
TILE_BITS = 12
#: Ids that are put together before a node's hash takes them in.
CHUNK = 65_536
#: What a conversation may borrow: h is below.
MOST_BORROWED = 9

_NODE = ["depth", "name"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), symbol (of role and text), size (UTF-8 bytes of text), in the order of turn, null first; equal turns go by symbol.

    A conversation may be of any length: rows are dealt by ranges of conversation and turn, numbered where they lie, and
    what a conversation has in earlier parts is added from a table of two rows a part at most.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(told.cast("binary"), 256)).alias("symbol"), F.octet_length(text).cast("long").alias("size"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("symbol")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        import numpy as np
        import pyarrow as pa

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += n
            last, n = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(place.astype(np.int64)), batch.column(1), batch.column(2)], ["conv_id", "part", "place", "symbol", "size"])

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "symbol", "size")
    placed = materialize(dealt.mapInArrow(number, "conv_id long, part int, place long, symbol binary, size long"), "trie-turns")
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).select(F.explode(F.array("low", "high")).alias("conv_id")).distinct()
    sums = placed.join(F.broadcast(edges), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))  # two conversations a part
    sums = sums.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n")).alias("all")).filter(F.size("all") > 1)
    before = F.aggregate(F.filter("all", lambda x: x["part"] < F.col("one.part")), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    sums = sums.withColumn("one", F.explode("all")).select("conv_id", F.col("one.part").alias("part"), before.alias("before"))
    return placed.join(F.broadcast(sums), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "symbol", "size")  # as few


def _borrowed(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h: rows like those of turns, and conv_id and n_turns of all."""
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumn("h", _borrowed(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(bases, "base", "left").withColumn("start", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "n", "start", (F.col("start") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-conversations")
    heads = turns.filter((F.col("pos") < MOST_BORROWED - 1) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.filter("start > 0").select("conv_id", "base", "h").join(heads, "base").filter("pos < h").select("conv_id", "pos", "symbol", "size")
    total = max(1, convs.agg(F.sum("n")).first()[0] or 1)
    rest = join_counted(turns, convs.select("conv_id", "h", "start", "n"), ["conv_id"], total).filter("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("start")).alias("pos"), "symbol", "size")
    return materialize(taken.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "n_turns")


def _named(kind: bytes, x: bytes, y: bytes) -> bytes:
    return hashlib.sha256(kind + x + y).digest()


def block_names(symbols: list[bytes]) -> list[list[bytes]]:
    """Names of all whole blocks of 1, 2, 4, ... symbols."""
    levels = [symbols]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_named(b"b", below[k], below[k + 1]) for k in range(0, len(below) - 1, 2)])
    return levels


def prefix_names(start: bytes, symbols: list[bytes]) -> list[bytes]:
    """Names of the prefixes of 1, 2, ... symbols after the prefix `start`, by cuts at half depth."""
    blocks, names = block_names(symbols), [b""] * len(symbols)

    def cut(root: bytes, at: int, level: int) -> None:
        if level == 0:
            names[at] = _named(b"p", root, symbols[at])
            return
        half = 1 << (level - 1)
        cut(root, at, level - 1)  # the upper trie
        if at + half < len(symbols):  # the lower forest hangs on the cut prefix
            cut(_named(b"c", root, blocks[level - 1][at >> (level - 1)]), at + half, level - 1)

    if symbols:
        cut(start, 0, (len(symbols) - 1).bit_length())
    return names


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), name and size of each prefix of rows' sequences (conv_id, pos, symbol, size)."""
    bits = TILE_BITS
    tile = F.shiftright("pos", bits)
    lists = F.array_sort(F.collect_list(F.struct("pos", "symbol", "size")))  # a tile at most
    tiles = rows.groupBy("conv_id", tile.alias("tile")).agg(lists.alias("all")).select("conv_id", "tile", F.col("all.symbol").alias("symbols"), F.col("all.size").alias("sizes"))
    if (rows.agg(F.max("pos")).first()[0] or 0) >> bits == 0:
        tiles = tiles.withColumn("start", F.lit(b""))
    else:
        tiles = materialize(tiles, "trie-tiles")

        def whole(batches):
            import pyarrow as pa

            for batch in batches:
                names = [block_names(s)[-1][0] for s in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([0] * len(names), pa.int64())], ["conv_id", "pos", "symbol", "size"])

        above = prefixes(tiles.filter(F.size("symbols") == 1 << bits).select("conv_id", "tile", "symbols").mapInArrow(whole, "conv_id long, pos long, symbol binary, size long"))
        starts = above.select("conv_id", F.col("depth").alias("tile"), F.col("name").alias("start"))
        tiles = tiles.join(starts, ["conv_id", "tile"], "left").withColumn("start", F.coalesce("start", F.lit(b"")))

    def name(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64).to_pydict()
                names = [prefix_names(start, symbols) for start, symbols in zip(some["start"], some["symbols"], strict=True)]
                ids = [c for c, n in zip(some["conv_id"], names, strict=True) for _ in n]
                depths = [(t << bits) + d for t, n in zip(some["tile"], names, strict=True) for d in range(1, len(n) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depths, pa.int64()), pa.array([x for n in names for x in n], pa.binary()), pa.array([x for s in some["sizes"] for x in s], pa.int64())], ["conv_id", "depth", "name", "size"])

    return tiles.select("conv_id", "tile", "start", "symbols", "sizes").mapInArrow(name, "conv_id long, depth long, name binary, size long")


def _ends(ends: DataFrame) -> DataFrame:
    """depth, name, ends_sha256 of rows depth, name, conv_id: ids are put together where ranges of them lie, and hashed in order, a chunk at a time."""

    def chunks(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], ["depth", "name", "first", "ids"])

        node, held = None, []
        for batch in batches:
            for depth, name, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (depth, name) != node or len(held) == CHUNK:
                    if held:
                        yield out()
                    node, held = (depth, name), []
                held.append(conv)
        if held:
            yield out()

    def hashed(batches):
        import pyarrow as pa

        node, state, done = None, None, []
        for batch in batches:
            for depth, name, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, name) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, name), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "name", "ends_sha256"])
            done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["depth", "name", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    texts = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, name binary, first long, ids string")
    return texts.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "depth long, name binary, ends_sha256 string")


def _grafted(totals: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """Sums of saved and leaves over each node's subtree. A round of width w adds the totals of the forests that hang w deep to the w nodes above their roots."""
    for level in range(max(1, deepest.bit_length())):
        width = 1 << level
        unit = min(level, TILE_BITS)  # rows of a long path meet a tile at a time
        roots = totals.filter(F.col("depth").bitwiseAND(F.lit(2 * width - 1)) == width)
        spans = F.sequence(F.shiftright(F.col("depth") - width, unit), F.shiftright(F.col("depth") - 1, unit))
        roots = roots.select("conv_id", "saved", "leaves", F.explode(spans).alias("span"))
        above = paths.withColumn("span", F.shiftright("depth", unit)).join(roots, ["conv_id", "span"])
        sums = above.groupBy(*_NODE).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        more = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c)
        totals = materialize(totals.join(sums, _NODE, "left").select(*_NODE, "conv_id", more("saved"), more("leaves")), f"trie-graft-{level}")
    return totals


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation; null roles and texts are empty; repeated rows are turns of their own;
    conversations without turns end at the root. Without conversations there is no node. Other columns don't matter.
    """
    turns = materialize(turns_of(conversations), "trie-placed")
    rows, convs = rebuilt(turns)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), F.lit(0).cast("long").alias("size"))
    paths = materialize(roots.unionByName(prefixes(rows)), "trie-paths")
    nodes = paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("above"))
    nodes = materialize(nodes.join(above, ["conv_id", "depth"], "left"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    own = nodes.select(*_NODE, "conv_id", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
    deepest = convs.agg(F.max("n_turns")).first()[0] or 0
    totals = _grafted(own, paths, deepest)
    ends = _ends(paths.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"]))
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_counted(nodes.filter("depth > 0"), parents, ["depth", "above"], max(1, nodes.count()))
    nodes = below.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = nodes.join(totals.select(*_NODE, "saved", "leaves"), _NODE).join(ends, _NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: The same in DuckDB, with whole prefixes as keys. CRC-32 comes from its table, made from the polynomial.
ORACLE = """
with crc as (select list(v order by b) as lut from (select b, list_reduce([b::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) as v from range(256) t(b))),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
s0 as (select conv_id, turn, sha256(octet_length(encode(role))::varchar || ':' || role || text) as sym, octet_length(encode(text))::bigint as size from t),
s as (select conv_id, sym, size, row_number() over (partition by conv_id order by turn nulls first, sym) - 1 as pos from s0),
convs as (select conv_id, n, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(conv_id::varchar, '.'), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, lut[(xor(c, x) & 255) + 1])), 4294967295) % 9 as h
    from (select conv_id, count(*) as n from s group by conv_id), crc),
rebuilt as (
    select c.conv_id, s.pos, s.sym, s.size from convs c join s on s.conv_id = c.base and s.pos < c.h
    union all
    select c.conv_id, s.pos - c.h + least(c.h, coalesce(b.n, 0)), s.sym, s.size from s join convs c on c.conv_id = s.conv_id left join convs b on b.conv_id = c.base where s.pos >= c.h),
seqs as (select conv_id, coalesce(p, []) as p, coalesce(sizes, []) as sizes from convs left join (select conv_id, list(sym order by pos) as p, list(size order by pos) as sizes from rebuilt group by conv_id) using (conv_id)),
paths as (select conv_id, d as depth, p[1 : d] as key, case when d = 0 then 0 else sizes[d] end as size from (select *, unnest(range(0, len(p) + 1)) as d from seqs)),
nodes as (select key, depth, min(conv_id)::bigint as conv_id, count(*)::bigint as n_convs, ((count(*) - 1) * max(size))::bigint as own from paths group by key, depth),
children as (select key[1 : depth - 1] as key, count(*)::bigint as n_children from nodes where depth > 0 group by 1),
told as (select n.*, coalesce(n_children, 0)::bigint as n_children from nodes n left join children using (key)),
below as (select key[1 : i] as key, sum(own)::bigint as saved_tokens, sum(leaf)::bigint as n_leaves from (select key, own, case when n_children = 0 then 1 else 0 end as leaf, unnest(range(0, depth + 1)) as i from told) group by 1),
ends as (select p as key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from seqs group by p)
select t.conv_id, t.depth::bigint as depth, up.conv_id as parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from told t join below using (key) left join ends using (key) left join told up on t.depth > 0 and up.key = t.key[1 : t.depth - 1]"""
