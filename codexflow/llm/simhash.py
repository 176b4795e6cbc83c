"""SimHash near-dedup by multi-index hashing (operator 7).

A fingerprint has one bit per hash bit: set in more than half of the text's shingle hashes. It is cut into
segments, and each segment has a table from its value to the fingerprints. If two fingerprints differ in
few bits, they differ in very few within some segment, so it is enough to enumerate a small Hamming ball
around each segment's value, fetch the table rows found there and verify the complete distance.

Balls are one-sided: a set bit is cleared, never the reverse. Of two values that differ in one bit, the one
that has the bit finds the other, so half the ball is enough.

``link`` joins 64-bit fingerprints within ``bits`` differing bits, losing no pair. ``group`` serves near
copies by shingle similarity: the same tables and balls bring the closest together, and the exact similarity
decides. Similarity may move more bits than balls can cover, so the texts still apart then meet by prefixes of their
ordered shingles, which no pair of the similarity escapes; longer fingerprints thin these candidates out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import Shared, by_value, map_slices, written
from codexflow.llm.components import components
from codexflow.session import new_table_path, temporary_tables

by_value(__name__)

SEED = 42
SEGMENTS, WIDTH = 2, 32
SPREAD = 0x9E3779B97F4A7C15
BLOCKS = 8  # of 64 bits, in the fingerprints that thin out candidates
APART = 64 * BLOCKS * 3 // 10
HEADS = 16  # first open buckets of a text that its rows carry, to tell where a pair has met before


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the space-joined shingles, repeats included; A-Z count as a-z, ASCII white space separates words."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    joined = [b" ".join(own)] if 0 < len(own) < words else map(b" ".join, zip(*[own[i:] for i in range(words)]))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype=np.uint64)


def set_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set, highest bit first."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[lo:lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int64)
    return ones


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer; no hash gives zero."""
    return int(np.packbits(2 * set_counts(hashes) > len(hashes)).view(">i8")[0])


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further hash of the same shingles."""
    h = hashes + np.uint64(k * SPREAD % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _own(docs: DataFrame, id_col: str, text_col: str):
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own, own.schema["id"].dataType.simpleString()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long): one row per input row; null and empty texts have fingerprint 0."""
    own, kind = _own(docs, id_col, text_col)

    def work(rows):
        return {"id": rows["id"], "fingerprint": [majority(shingle_hashes(t, words)) for t in rows["text"]]}

    return map_slices(own, lambda: work, f"id {kind}, fingerprint long")


def near_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column ``fingerprint``, no repeats) within ``bits`` <= 3 differing bits.

    With two segments of 32 bits, one of them differs in at most ``bits // 2`` <= 1 bit.
    """
    if not 0 <= bits < 2 * SEGMENTS:
        raise ValueError("two segments and balls of radius 1 cover 0 to 3 bits")
    values = [F.shiftrightunsigned("fingerprint", WIDTH), F.col("fingerprint").bitwiseAND(0xFFFFFFFF)]
    table = prints.select("fingerprint", F.posexplode(F.array(*values)).alias("segment", "value"))
    flips = F.expr(f"transform(filter(sequence(0, {WIDTH - 1}), i -> (value >> i) & 1 = 1), i -> value ^ (1L << i))")
    ball = F.concat(F.array("value"), flips) if bits >= SEGMENTS else F.array("value")
    probes = table.select(F.col("fingerprint").alias("a"), "segment", F.posexplode(ball).alias("turn", "value"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    once = (F.col("turn") > 0) | (F.col("a") < F.col("b"))
    return probes.join(table.withColumnRenamed("fingerprint", "b"), ["segment", "value"]).filter((distance <= bits) & once & (F.col("a") != F.col("b"))).select("a", "b")


def link(docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component): rows linked by fingerprints within ``bits`` bits.

    ``component`` is the smallest id reachable, the row's own included. Fingerprints are compared once
    however many rows share them. Null and empty texts share fingerprint 0 and link like any other; rows
    with a null id follow their fingerprint; an empty table gives none; other columns are not read.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    first = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "distinct-fingerprints")
    pairs = near_pairs(first.select("fingerprint"), bits)
    linked = (pairs.join(first.select(F.col("fingerprint").alias("a"), F.col("first").alias("fa")), "a")
              .join(first.select(F.col("fingerprint").alias("b"), F.col("first").alias("fb")), "b"))
    found = components(linked.select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter("a is not null and b is not null"))
    named = first.join(found.withColumnRenamed("node", "first"), "first", "left").select(
        "fingerprint", F.coalesce("component", "first").alias("component"))
    return prints.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component")


def common_shingles(docs: DataFrame, words: int, rows: int, sample: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles in at least ``least`` of about ``sample`` drawn texts, ``most`` at most.

    They only decide the order of a text's shingles, hence how large buckets get, never which pairs are found.
    """
    drawn = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / max(rows, 1)) * (1 << 30)))

    def work(part):
        return {"shingle": [h for t in part["text"] for h in np.unique(shingle_hashes(t, words)).view(np.int64).tolist()]}

    seen = map_slices(drawn, lambda: work, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = seen.filter(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    hashes = found["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy(dtype=np.int64)[order]


def shingle_index(own: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """(id, digest, same binary, long_print array<long>, prefix array<long>, n int): over the set of shingles.

    All texts order their shingles alike, common ones last. Two sets of Jaccard similarity s share a shingle
    among the first n - ceil(s n) + 1 of each, the ``prefix``. ``same`` is a digest of the sorted set: equal
    sets are copies of similarity 1.
    """
    kind, shared = own.schema["id"].dataType.simpleString(), Shared(own.sparkSession, common)

    def one(text, hashes, counts):
        own = np.unique(shingle_hashes(text, words))
        lead = np.concatenate([set_counts(own if k == 0 else mixed(own, k)) for k in range(BLOCKS)]) * 2 - len(own)
        prints = np.packbits(lead > 0).view(">i8").astype(np.int64).tolist()
        at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
        often = np.where(hashes[at] == own, counts[at], 0) if len(hashes) else np.zeros(len(own), dtype=np.int64)
        first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
        prefix = own[np.lexsort((own, often))[:first]].view(np.int64).tolist()
        return xxhash.xxh3_128_digest(own.tobytes()), prints, prefix, len(own)

    def work(rows):
        found = list(zip(*(one(t, *shared.value) for t in rows["text"])))
        return {"id": rows["id"], "digest": rows["digest"], **dict(zip(("same", "long_print", "prefix", "n"), map(list, found)))}

    return map_slices(own, lambda: work, f"id {kind}, digest binary, same binary, long_print array<long>, prefix array<long>, n int")


def fingerprint_pairs(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): nodes (node, fingerprint) to compare, so that all within ``bits`` differing bits are joined through them.

    Each fingerprint's smallest node is paired with the others of it, and with those of the fingerprints near it.
    """
    lead = nodes.groupBy("fingerprint").agg(F.min("node").alias("leader"))
    lead = written(lead, "leading-fingerprints")
    side = lambda name: lead.select(F.col("fingerprint").alias(name), F.col("leader").alias(f"{name}_leader"))
    near = near_pairs(lead.select("fingerprint"), bits).join(side("a"), "a").join(side("b"), "b")
    same = nodes.join(lead, "fingerprint").filter(F.col("node") != F.col("leader"))
    return same.select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(
        near.select(F.col("a_leader").alias("a"), F.col("b_leader").alias("b")))


CELL = ["bucket", "low", "high"]


def cell_rows(batches, columns):
    """Rows sorted by cell in; (cell, one list per column) out, a cell at a time."""
    held: list = []
    at = None
    for batch in batches:
        rows = batch.to_pydict()
        for *cell, row in zip(*(rows[c] for c in CELL), zip(*(rows[c] for c in columns))):
            if at != cell:
                if len(held) > 1:
                    yield at, [list(c) for c in zip(*held)]
                held, at = [], cell
            held.append(row)
    if len(held) > 1:
        yield at, [list(c) for c in zip(*held)]


def sides(low: int, high: int, blocks: list[int]):
    """For each row of a cell of one or two blocks, if it is compared with later rows, and which rows those are."""
    place = np.arange(len(blocks))
    if low == high:
        return [(i, place[i + 1:]) for i in place]
    right = np.flatnonzero(np.array(blocks) == high)
    return [(i, right) for i in np.flatnonzero(np.array(blocks) == low)]


def candidate_members(similarity: float):
    """Rows of cells in; (cell, block, node) out for the members that may reach the similarity with one of another component.

    A pair is left to an earlier bucket if both rows' first open buckets (``heads``) show one that they share.
    """
    schema = pa.schema([("bucket", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("node", pa.int64())])

    def members(bucket, low, high, blocks, nodes, components, n, place, prints, heads):
        own, n, place = np.array(components), np.array(n), np.array(place)
        prints = np.array(prints, dtype=np.int64).view(np.uint64)
        early = [set(h[:h.index(bucket)] if bucket in h else h) for h in heads]
        met = np.zeros(len(nodes), dtype=bool)
        for i, j in sides(low, high, blocks):
            j = j[(own[j] != own[i]) & ~(met[j] & met[i])]
            # at their first common shingle, two sets have at most the rest of either in common
            j = j[np.minimum(n[i] - place[i], n[j] - place[j]) * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-9]
            j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(axis=1, dtype=np.int64) <= APART]
            j = [k for k in j.tolist() if early[i].isdisjoint(early[k])]
            if j:
                met[i] = True
                met[j] = True
        return np.flatnonzero(met)

    def run(batches):
        for (bucket, low, high), columns in cell_rows(batches, ["block", "node", "component", "n", "place", "long_print", "heads"]):
            found = members(bucket, low, high, *columns).tolist()
            if found:
                size = len(found)
                blocks, nodes = ([columns[c][i] for i in found] for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(([bucket] * size, [low] * size, [high] * size, blocks, nodes), schema)], schema=schema)

    return run


def spanning_links(similarity: float):
    """Rows of cells with their shingle sets in; (a, b) out: a forest that joins the members linked by exact similarity.

    Pairs already of one tree are not compared, so a cell gives fewer links than it has members.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(low, high, blocks, nodes, components, sets):
        sizes = np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate([np.array(s, dtype=np.int64) for s in sets]), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        number: dict = {}
        tree = np.array([number.setdefault(c, len(number)) for c in components])
        marked = np.zeros(int(flat.max()) + 1, dtype=bool)
        for i, j in sides(low, high, blocks):
            j = j[(tree[j] != tree[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9)]
            if not len(j):
                continue
            own = flat[starts[i]:ends[i]]
            marked[own] = True
            if len(j) * 4 < len(sizes):
                common = np.array([np.count_nonzero(marked[flat[starts[k]:ends[k]]]) for k in j])
            else:
                common = np.diff(np.r_[0, np.cumsum(marked[flat])][np.r_[starts, ends[-1]]])[j]
            marked[own] = False
            for k in j[common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9].tolist():
                if tree[k] != tree[i]:
                    tree[tree == tree[k]] = tree[i]
                    yield nodes[i], nodes[k]

    def run(batches):
        for (_, low, high), columns in cell_rows(batches, ["block", "node", "component", "shingles"]):
            found = list(links(low, high, *columns))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, cell: int = 1024, sample: int = 10_000,
                broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, first struct): one row per row; rows whose shingle sets have a Jaccard similarity of
    ``similarity`` or more, transitively, share ``first``: the smallest (id, digest of the text) among them.

    Candidates: fingerprints within 3 bits, by multi-index hashing (``fingerprint_pairs``). For pairs that differ in
    more, each shingle of a text's prefix (``shingle_index``) is a bucket, so every pair of that similarity
    shares one, whatever the number of texts. Each member of a bucket is also compared with one of it,
    which joins large groups of near copies. Then, in the buckets that still hold several components, all pairs
    of different components are compared, in cells of about ``cell`` x ``cell`` members: sizes and SimHash
    fingerprints of 512 bits tell which members may have a partner (30 % of the bits may differ; 15 to 19 % do at
    similarity 0.8, six standard deviations below the bound), only those get their shingle sets, and each
    cell hands on a forest of exact links, fewer than its members. ``cell``, ``sample`` and ``broadcast_rows`` do not
    change which pairs are found.

    Null texts count as empty; texts without a word have an empty shingle set and form one group. Rows with a null
    id are grouped like others and come last in the order. Rows that repeat an id with other texts are texts of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    common = common_shingles(own, words, own.count(), sample, 4, 500_000)
    prints = written(shingle_index(own, common, words, similarity), "shingle-index")
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")).alias("first")
    first = prints.groupBy("same").agg(least, *(F.first(c).alias(c) for c in ("long_print", "prefix", "n")))
    first = written(first.withColumn("node", F.monotonically_increasing_id()), "distinct-shingles")
    full = first.select("node", "long_print", "n")
    member = first.select("node", F.posexplode("prefix").alias("place", "bucket"))
    shared = written(member.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket"), "buckets")
    shared = F.broadcast(shared) if shared.count() <= broadcast_rows else shared  # 8 bytes a row
    met = written(member.join(shared, "bucket"), "bucket-members")

    lead = met.groupBy("bucket").agg(F.min("node").alias("leader"))
    pairs = met.join(lead, "bucket").filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    near = fingerprint_pairs(first.select("node", F.col("long_print")[0].alias("fingerprint")))
    order = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.unionByName(near).select(*order).distinct()
    side = lambda name: full.select(F.col("node").alias(name), F.col("long_print").alias(f"{name}_print"), F.col("n").alias(f"{name}_n"))
    distance = F.aggregate(F.zip_with("a_print", "b_print", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9
    close = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(alike & (distance <= APART)).select("a", "b"), "close-pairs")
    sets = shingle_sets(own, first, close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    exact = both >= similarity * (F.size("a_set") + F.size("b_set") - both) - 1e-9
    links = written(close.join(of("a"), "a").join(of("b"), "b").filter(exact).select("a", "b"), "leader-links")

    joined = components(links)
    placed = written(met.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(first.select("node", "n"), "node"), "placed-members")
    blocks = F.ceil(F.greatest(F.col("members") / cell, F.col("shingles") / (cell << 12))).cast("int")
    open_buckets = (placed.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .filter("lo <> hi").select("bucket", blocks.alias("blocks")))
    opened = written(placed.drop("n").join(open_buckets, "bucket"), "open-members")
    heads = opened.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "bucket"))), 1, HEADS)["bucket"].alias("heads"))
    cells = (opened.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("node", "bucket", "place", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    dealt = cells.join(full.join(heads, "node"), "node").repartition(*CELL).sortWithinPartitions(*CELL)
    partnered = written(dealt.mapInArrow(candidate_members(similarity), "bucket long, low int, high int, block int, node long"), "partnered-members")
    needed = shingle_sets(own, first, partnered.select("node").distinct(), words)
    placed_once = partnered.join(needed, "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crossing = placed_once.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(spanning_links(similarity), "a long, b long")
    found = components(links.unionByName(written(crossing, "crossing-links")))

    grouped = first.select("same", "node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = grouped.groupBy("component").agg(F.min("first").alias("first"))
    told = grouped.select("same", "component").join(named, "component")
    return prints.select("id", "digest", "same").join(told, "same").select("id", "digest", "first")


def shingle_sets(own: DataFrame, first: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the sorted shingle set of each of ``nodes``, from one text that has it."""
    wanted = first.select("node", "first.id", "first.digest").join(nodes, "node")
    texts = own.join(wanted, own["id"].eqNullSafe(wanted["id"]) & (own["digest"] == wanted["digest"])).select("node", "text")

    def work(rows):
        return {"node": rows["node"], "shingles": [np.unique(shingle_hashes(t, words)).view(np.int64).tolist() for t in rows["text"]]}

    return written(map_slices(texts.dropDuplicates(["node"]), lambda: work, "node long, shingles array<long>"), "shingle-sets")


def group(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component): the smallest id of each row's group of near copies (``near_copies``); null where no row of the group has an id."""
    found = near_copies(docs, words, similarity, id_col=id_col, text_col=text_col, **options)
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("component"))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near copies: that of the smallest id, of its smallest text digest, of rows that repeat both the smallest.

    Texts that are no near copies all stay, whether or not they share an id.
    """
    path = new_table_path(docs.sparkSession, "llm-near-copies")
    with temporary_tables(docs.sparkSession):
        found = written(near_copies(docs, words, similarity, id_col=id_col, text_col=text_col), "near-copies", path)
    own = found.filter(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    # texts of one digest and id count once, whichever groups their rows came from
    stays = written(own.groupBy(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).agg(F.count("*").alias("_kept_rows")), "kept-texts")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    met = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (digest == F.col("_kept_digest"))
    once = docs.join(stays.filter("_kept_rows = 1"), met, "left_semi")
    again = docs.join(stays.filter("_kept_rows > 1"), met, "inner").groupBy("_kept_id", "_kept_digest").agg(F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("_kept_row"))
    return once.unionByName(again.select(*(F.col("_kept_row")[c].alias(c) for c in docs.columns)))
