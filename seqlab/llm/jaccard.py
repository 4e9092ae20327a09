"""N-gram Jaccard join: a grouped prefix join over word shingles (operator 1).

A document's set holds the distinct ``k``-word shingles of its whole text
(ASCII letters lower-cased; with fewer words, the whole sequence is the one
shingle; without words the set is empty and links with nothing).  Two
documents link when ``100 * |intersection| >= percent * |union|``.

How it runs:

1. ``shingle_weights``: how often shingles occur, counted over all documents
   into a table of fixed size.  Rare shingles come first in the global order
   (ties by hash), so passages that many documents share leave the prefixes.
2. ``shingle_prefixes``: per document the set's size, a 128-bit digest, a sketch
   and the prefix: the first ``n - ceil(t*n) + DEPTH`` shingles.  Any two linked
   sets share at least ``min(DEPTH, ceil(t * larger size))`` shingles of both
   prefixes.  The sketch has one or two bits a shingle, each the parity of the
   shingles that fall on it, so two sketches differ in at most as many bits as
   two sets in shingles.
3. Equal sets collapse into one class; classes with the same prefix and size
   collapse into one group.  Only groups are joined.
4. Group pairs that share enough prefix shingles and pass the size bound are
   candidates.  A shingle held by more than ``BUCKET`` groups emits no pairs:
   its groups are chained to one of them instead.  Candidates form clusters.
5. ``near_clusters``: the classes of a cluster are compared by size and sketch,
   which leaves out pairs that cannot link, so classes that are only chained
   fall apart before whole sets are copied.  Large clusters are cut by size.
6. What is left of a cluster is verified exactly, in blocks of bounded size, so
   that a large cluster spreads over many tasks.  Each block emits a spanning
   forest of its links, never all pairs.
7. Components of the forest, with the smallest doc_id as the id.

Shingles are compared as 64-bit hashes.  Null, empty and blank texts have an
empty set.  A row without a doc_id has a set size, but links with nothing and
has no component.  Repeated rows give repeated results; other columns are
ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.components import components
from seqlab.llm.scratch import bounded_batches, collected, dropped, written, written_at

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Size of the table of shingle counts: 2 ** WEIGHT_BITS entries, whatever the input.
WEIGHT_BITS = 24
#: Entries of that table in one row, when the tables of several tasks are added.
WEIGHT_ROW = 1 << 16
#: Shared prefix shingles that a candidate pair needs.
DEPTH = 4
#: Groups of one shingle up to which pairs are formed; larger buckets are chained and verified in blocks.
BUCKET = 64
#: Most sketches, and bytes of sketches, in one block of a cluster.
BLOCK_SKETCHES, BLOCK_BYTES = 4096, 4 << 20
#: Most sets and most shingles in one block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Rows up to which the ids of candidate documents are broadcast (some 40 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 400_000


def shingle_sets(raw, offsets, k: int):
    """Sorted distinct shingle hashes of every text of a batch, flat, with offsets."""
    _, _, h, first = wordscan.words(raw, offsets, wordscan.BLANKS)
    n = np.diff(first)
    grams = wordscan.run_hash(h, k)
    count = np.where(n >= k, n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    value = grams[first[:-1][owner] + within]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        tail = [wordscan.run_hash(h[first[d]:first[d + 1]], int(n[d])) for d in short]
        value = np.concatenate([value, *tail])
        owner = np.concatenate([owner, short])
    order = np.argsort(value)
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    if len(value):
        keep = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[keep], owner[keep]
    return value, owner, np.searchsorted(owner, np.arange(len(n) + 1))


def _slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """Row slices of a batch with about ``most`` bytes of text each."""
    raw, offsets, null = wordscan.text_buffer(batch.column(text))
    at = 0
    while at < len(null):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], null[at:to]
        at = to


def shingle_weights(texts: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur over all texts, on a log scale, in 2 ** WEIGHT_BITS hash buckets of one byte."""
    shift, length, width = np.uint64(64 - WEIGHT_BITS), 1 << WEIGHT_BITS, min(WEIGHT_ROW, 1 << WEIGHT_BITS)

    def count(batches):
        total = np.zeros(length, np.uint16)
        for batch in batches:
            for _, raw, offsets, _ in _slices(batch, "text"):
                value, _, _ = shingle_sets(raw, offsets, k)
                np.add.at(total, (value >> shift).astype(np.int64), np.uint16(1))
        codec = pa.Codec("zstd", compression_level=1)
        for lo in range(0, length, width):
            part = total[lo:lo + width]
            if part.any():
                body = codec.compress(np.minimum(part, 255).astype(np.uint8), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([lo // width], pa.int32()), pa.array([body], pa.binary())], ["part", "body"])

    def level(batches):
        totals: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                total = totals.setdefault(part, np.zeros(width, np.uint32))
                total += np.frombuffer(codec.decompress(body, width), np.uint8)
        for part, total in totals.items():
            log = np.minimum(255, 12 * np.log2(np.maximum(total, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([log.tobytes()], pa.binary())], ["part", "body"])

    rows = (texts.select("text").mapInArrow(wordscan.trimmed(count), "part int, body binary").repartition("part")
            .mapInArrow(wordscan.trimmed(level), "part int, body binary").collect())  # 2 ** WEIGHT_BITS bytes
    levels = np.zeros(length, np.uint8)
    for row in rows:
        levels[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["body"], np.uint8)
    return levels


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def parity_sketches(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """The sketch of every set: 64 bits, or as many as the least power of two that is no less than its size.

    A bit is the parity of the shingles whose low hash bits name it.
    """
    n = np.diff(first)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.r_[0, np.cumsum(bits)]
    place = (value & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1], n)
    odd = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)),
                                                       pa.py_buffer(np.packbits(odd, bitorder="little"))])


def shingle_prefixes(docs: DataFrame, k: int, percent: int, held: Broadcast[bytes]) -> DataFrame:
    """doc_id, n, sig (digest of the set), pkey (digest of the prefix), sketch, prefix (shingle hashes).

    ``held`` has the weights of ``shingle_weights``.
    """
    shift = np.uint64(64 - WEIGHT_BITS)

    def prefixes(batches):
        levels = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for rows, raw, offsets, _ in _slices(batch, "text"):
                value, owner, first = shingle_sets(raw, offsets, k)
                n = np.diff(first)
                sig = [_digest(value[first[d]:first[d + 1]]) if n[d] else None for d in range(len(n))]
                order = np.lexsort((value, levels[(value >> shift).astype(np.int64)], owner))
                need = np.minimum(n, n - (percent * n + 99) // 100 + DEPTH)
                within = np.arange(len(value)) - first[:-1][owner]
                taken = value[order][within < need[owner]]
                at = np.r_[0, np.cumsum(need)]
                pkey = [_digest(taken[at[d]:at[d + 1]]) if n[d] else None for d in range(len(n))]
                prefix = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(taken.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sig, pa.binary()),
                     pa.array(pkey, pa.binary()), parity_sketches(value, first), prefix],
                    ["doc_id", "n", "sig", "pkey", "sketch", "prefix"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(wordscan.trimmed(prefixes), f"doc_id {id_type}, n long, sig binary, pkey binary, sketch binary, prefix array<long>")


def candidate_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(gid, cluster) of groups that may link with another group."""
    groups = sets.groupBy("n", "pkey").agg(F.first("prefix").alias("prefix")).select(
        F.xxhash64("n", "pkey").alias("gid"), F.col("n").cast("int").alias("n"), "prefix")
    postings = groups.select("gid", "n", F.explode("prefix").alias("shingle"))
    shared = postings.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    shared, path = written_at(postings.join(shared, "shingle"), "postings")
    collected(sets.sparkSession)
    few = shared.where(F.col("held") <= BUCKET)
    larger, smaller = F.greatest("n", "m"), F.least("n", "m")
    other = few.select("shingle", F.col("gid").alias("hid"), F.col("n").alias("m"))
    pairs = (few.select("shingle", "gid", "n").join(other, "shingle")
             .where((F.col("gid") < F.col("hid")) & (100 * smaller >= percent * larger))
             .groupBy("gid", "hid").agg(F.count("*").alias("common"), F.first(larger).alias("larger"))
             .where(F.col("common") >= F.least(F.lit(DEPTH), F.ceil(F.col("larger") * percent / 100))))
    many = shared.where(F.col("held") > BUCKET)
    # every BUCKET or so groups of a shingle find the one they are chained to under a key of their own
    lists = F.ceil(F.col("held") / BUCKET).cast("int")
    hubs = many.groupBy("shingle", "held").agg(F.min("gid").alias("hid")).select(
        "shingle", "hid", F.explode(F.sequence(F.lit(0), lists - 1)).alias("part"))
    chains = many.withColumn("part", F.pmod(F.xxhash64("gid"), lists)).join(hubs, ["shingle", "part"])
    found = components(pairs.select("gid", "hid").unionByName(chains.select("gid", "hid")), "gid", "hid", "clusters")
    dropped(sets.sparkSession, path)  # components() has written what it needs
    collected(sets.sparkSession)
    return found


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (64-bit words along the last axis) as they would be with ``words`` words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def near_forest(size: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, percent: int):
    """Edges (i, j) of a spanning forest of the pairs that sizes and sketches let link, between sides 0 and 1 (or within, if all are side 0)."""
    words = np.array([len(s) for s in sketches], np.int64)
    place = np.zeros(len(sketches), np.int64)
    tables = {}
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        place[rows] = np.arange(len(rows))
        tables[w, w] = np.stack([sketches[i] for i in rows])
    two = bool(side.any())
    todo = np.ones(len(sketches), bool)
    for i in np.flatnonzero(side == 0):
        if not todo[i]:
            continue
        todo[i] = False
        wave = [i]
        while wave:  # every vertex is expanded once, and compared with what no other one has reached
            x = wave.pop()
            rest = np.flatnonzero(todo & (side != side[x]) if two else todo)
            rest = rest[100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])]
            for w in np.unique(words[rest]):
                those = rest[words[rest] == w]
                least = min(w, words[x])
                if (w, least) not in tables:
                    tables[w, least] = _folded(tables[w, w], least)
                differ = np.bitwise_count(tables[w, least][place[those]] ^ _folded(sketches[x], least)).sum(1, dtype=np.int64)
                found = those[differ * (100 + percent) <= (100 - percent) * (size[those] + size[x])]
                todo[found] = False
                for y in found:
                    yield x, y
                    wave.append(y)


def near_clusters(member: DataFrame, percent: int) -> DataFrame:
    """(sig, cluster) of the classes of ``member`` that may link with another one of their cluster, by size and sketch.

    Clusters of more than a block are cut into bands of sizes, of which only
    neighbours can link, and bands into blocks.
    """
    width = max(0.01, 1.001 * math.log(100 / percent))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SKETCHES), F.ceil(F.sum(F.length("sketch")) / BLOCK_BYTES)).cast("int")
    size = member.groupBy("cluster").agg(F.count("*").alias("sets"), blocks.alias("whole")).where("sets > 1").select("cluster", "whole")
    banded = (member.select("sig", "n", "sketch", "cluster").join(size, "cluster")
              .withColumn("band", F.when(F.col("whole") > 1, F.floor(F.log("n") / width)).otherwise(0).cast("int")))
    bands = banded.groupBy("cluster", "band").agg(blocks.alias("blocks"))
    lower = bands.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    upper = bands.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    bands = bands.join(lower, ["cluster", "band"], "left").join(upper, ["cluster", "band"], "left").na.fill(0, ["below", "above"])
    pairs = """explode(concat(
        transform(sequence(0, blocks - 1), j -> struct(band as u, least(block, j) as i, band as v, greatest(block, j) as j, int(block > j) as side)),
        transform(filter(sequence(0, above), j -> j > 0), j -> struct(band as u, block as i, band + 1 as v, j - 1 as j, 0 as side)),
        transform(filter(sequence(0, below), j -> j > 0), j -> struct(band - 1 as u, j - 1 as i, band as v, block as j, 1 as side))))"""
    keyed = (banded.join(bands, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
             .select("sig", "n", "sketch", "cluster", F.expr(pairs).alias("at")).select("sig", "n", "sketch", "cluster", "at.*"))

    def compare(table: pa.Table) -> pa.Table:
        sigs = table["sig"].to_pylist()
        sketches = [np.frombuffer(s, np.uint64) for s in table["sketch"].to_pylist()]
        edges = list(near_forest(table["n"].to_numpy(), sketches, table["side"].to_numpy(), percent)) if len(sigs) > 1 else []
        return pa.table({"a": pa.array([sigs[x] for x, _ in edges], pa.binary()),
                         "b": pa.array([sigs[y] for _, y in edges], pa.binary())})

    edges = keyed.groupBy("cluster", "u", "i", "v", "j").applyInArrow(compare, "a binary, b binary")
    return components(edges, "a", "b", "near").select(F.col("vertex").alias("sig"), F.xxhash64("root").alias("cluster"))


def verified_forest(ids: list[bytes], sets: list[np.ndarray], side: np.ndarray, percent: int):
    """Edges (i, j) of a spanning forest of the links between side 0 and side 1 (or within, if all are side 0)."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    keep = np.bincount(column)[column] > 1
    owner, column = owner[keep], column[keep]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    row_a, row_b = np.full(len(sets), -1), np.full(len(sets), -1)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    common = np.zeros((len(a), len(b)))
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [lo, lo + width])
        own, col = owner[s:e], column[s:e] - lo
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        here = row_a[own] >= 0
        left[row_a[own[here]], col[here]] = 1
        here = row_b[own] >= 0
        right[row_b[own[here]], col[here]] = 1
        common += left @ right.T
    union = size[a][:, None] + size[b][None, :] - common
    link = 100 * common >= percent * union
    todo_a, todo_b = np.ones(len(a), bool), np.ones(len(b), bool)
    same = b is a
    for i in range(len(a)):
        if not todo_a[i]:
            continue
        todo_a[i] = False
        if same:
            todo_b[i] = False
        wave = [i]
        while wave:  # reach from a to b and back; every vertex is expanded once
            x = wave.pop()
            found = np.flatnonzero(link[x] & todo_b)
            todo_b[found] = False
            for y in found:
                yield a[x], b[y]
                if same:
                    todo_a[y] = False
                    wave.append(y)
                else:
                    back = np.flatnonzero(link[:, y] & todo_a)
                    todo_a[back] = False
                    for z in back:
                        yield a[z], b[y]
                        wave.append(z)


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, first, sig of every row of ``documents`` (see the module's text).

    ``sig`` is the set's digest (null without words); ``first`` marks the rows
    of the class that stands for its component.
    """
    docs = documents.select("doc_id", "text")
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs, k).tobytes())  # 2 ** WEIGHT_BITS bytes
    sets = written(shingle_prefixes(docs, k, percent, held), "sets")
    held.unpersist()
    collected(docs.sparkSession)
    full = sets.where("n > 0 and doc_id is not null")
    classes = (full.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                       F.first("pkey").alias("pkey"), F.first("sketch").alias("sketch"))
               .withColumn("gid", F.xxhash64("n", "pkey")))
    clusters = candidate_clusters(full, percent)
    member = (classes.join(clusters.withColumnRenamed("vertex", "gid"), "gid", "left")
              .select("sig", "doc_id", "n", "sketch", F.coalesce("root", "gid").alias("cluster")))
    member = written(member, "members")
    close = written(member.select("sig", "doc_id", "n").join(near_clusters(member, percent), "sig"), "close")
    size = (close.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
            .select("cluster", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS),
                                          F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    chosen = written(close.join(size, "cluster")
                     .select("doc_id", "sig", "cluster", "blocks",
                             F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block")), "chosen")
    wanted = chosen.count()
    collected(docs.sparkSession)
    side = F.broadcast(chosen) if wanted <= BROADCAST_ROWS else chosen

    def expand(batches):
        for batch in batches:
            for rows, raw, offsets, _ in _slices(batch, "text"):
                value, _, first = shingle_sets(raw, offsets, k)
                out = []
                sigs, cl, bl, nb = (rows.column(c).to_pylist() for c in ("sig", "cluster", "block", "blocks"))
                for d in range(rows.num_rows):
                    own = value[first[d]:first[d + 1]]
                    if _digest(own) == sigs[d]:
                        body = own.tobytes()
                        for j in range(nb[d]):
                            out.append((cl[d], min(j, bl[d]), max(j, bl[d]), int(bl[d] > j), sigs[d], body))
                for lo in range(0, len(out), 1000):
                    part = list(zip(*out[lo:lo + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[0], pa.int64()), *(pa.array(c, pa.int32()) for c in part[1:4]),
                         pa.array(part[4], pa.binary()), pa.array(part[5], pa.binary())],
                        ["cluster", "i", "j", "side", "sig", "body"])

    def verify(table: pa.Table) -> pa.Table:
        found: dict[bytes, tuple] = {}
        for s, b, x in zip(table["sig"].to_pylist(), table["body"].to_pylist(), table["side"].to_pylist(), strict=True):
            found.setdefault(s, (x, b))
        ids = list(found)
        sides = np.array([found[s][0] for s in ids])
        edges = list(verified_forest(ids, [np.frombuffer(found[s][1], np.uint64) for s in ids], sides, percent)
                     ) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], pa.binary()),
                         "b": pa.array([ids[y] for _, y in edges], pa.binary())})

    blocks = (docs.join(side, "doc_id").select("text", "sig", "cluster", "blocks", "block")
              .mapInArrow(wordscan.trimmed(expand), "cluster long, i int, j int, side int, sig binary, body binary"))
    edges = blocks.groupBy("cluster", "i", "j").applyInArrow(verify, "a binary, b binary")
    linked = components(edges, "a", "b", "links").withColumnRenamed("vertex", "sig")
    collected(docs.sparkSession)
    named = member.select("sig", "doc_id").join(linked, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    component = named.join(first, "root").select("sig", F.col("first.doc_id").alias("component_id"),
                                                 F.col("first.sig").alias("first_sig"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "sig")
    alone = "sig is null or doc_id is null"
    single = out.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), "sig")
    return (out.where(f"not ({alone})").join(component, "sig").select(
        "doc_id", "n_shingles", "component_id",
        ((F.col("doc_id") == F.col("component_id")) & (F.col("sig") == F.col("first_sig"))).alias("first"), "sig").unionByName(single))


def one_of_each_group(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of every group of linked documents: the one with the smallest doc_id.

    All columns stay.  Documents without words and rows without doc_id stay;
    equal rows are one document.  Only the ids of rows that go are gathered:
    they are broadcast up to ``BROADCAST_ROWS`` and joined by a shuffle beyond.
    """
    found = written(jaccard_components(documents, k, percent), "components")
    again = written(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n"))
                    .where("n > 1").select("doc_id"), "again")
    gone = written(found.where("not first").select("doc_id").join(again, "doc_id", "left_anti"), "gone")
    collected(documents.sparkSession)

    def side(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    kept = documents.join(side(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    # ids that several rows bear: those rows are told apart by their sets
    ids = side(again)

    def digests(batches):
        for batch in batches:
            for rows, raw, offsets, _ in _slices(batch, "text"):
                value, _, first = shingle_sets(raw, offsets, k)
                sig = [_digest(value[first[d]:first[d + 1]]) if first[d] < first[d + 1] else None for d in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(sig, pa.binary())], ["row", "sig"])

    several = documents.join(ids, "doc_id", "left_semi").select(F.struct(*documents.columns).alias("row"), "text")
    row_type = several.schema["row"].dataType.simpleString()
    several = several.mapInArrow(wordscan.trimmed(digests), f"row {row_type}, sig binary").withColumn("doc_id", F.col("row.doc_id"))
    firsts = found.where("first and sig is not null").select("doc_id", "sig").distinct()
    chosen = (several.where("sig is not null").join(firsts, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"]).select("row.*")
              .unionByName(several.where("sig is null").select("row.*")))
    return kept.join(ids, "doc_id", "left_anti").select(*documents.columns).unionByName(chosen)
