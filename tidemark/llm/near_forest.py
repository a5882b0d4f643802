"""Near duplicates among edit texts, found in an LSH forest and confirmed on full shingle sets.

An edit's set is its distinct shingles of five words; edits with equal sets are one node
from here on. A node's MinHash signature is read by several trees, each in an order of its own;
sorting the nodes by a tree's reading puts those with the longest common prefix side by side.

1. Neighbours in the first sorted orders that share a prefix of the floor depth are
   confirmed on full sets, and confirmed links are joined to components. A group of near
   copies is mostly one component after that, from a few links for each node.
2. In every tree, the nodes that share a prefix of the floor depth are a region. A region inside
   one component is done. In the others, nodes outside the largest component are compared with
   the rest by signature, a pair in the first tree only where it meets. All these comparisons are
   made: a region is dealt to cells, each of a block of the nodes outside and a block of the
   rest, so a crowded region is more tasks and not a larger one.
3. Nodes with a near partner in another component meet once more with their full sets, in
   parts of their cell that hold a bounded number of shingles. Components are joined there as
   links are confirmed, so a part gives fewer links than it has nodes, and no pairs leave it.

Two nodes at the similarity bound share a region in at least one of ``TREES`` trees with
probability 1 - (1 - 0.75^4)^32, over 0.999994.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import edit_columns
from tidemark.llm.components import components
from tidemark.session import stored

WORDS = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 75
TREES = 32
FLOOR_DEPTH = 4
#: Trees whose sorted order gives the first candidates.
ORDERS = 2
HASHES = TREES * FLOOR_DEPTH
#: Share of equal hashes from which a pair is confirmed; five standard deviations below the bound.
NEAR = 0.55
#: Comparisons in a region beyond which it is dealt to several cells of about as many each.
CROWDED = 4_000_000
#: What a row does in a cell: ask whether others are near, be asked, and lie outside the largest component.
ASKS, ASKED, OUTSIDE = 1, 2, 4
#: Shingles of a block of full sets that one task compares with another block.
BLOCK_SHINGLES = 2_000_000
CACHED_WORDS = 500_000
SALTS = 16

_SETS = "rev_id bigint, n_shingles bigint, set_key binary, signature binary"
_SETS_ARROW = pa.schema([("rev_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of a text, sorted."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        # Bytes: lower-casing and splitting then know ASCII letters and blanks only.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - WORDS + 1
        with np.errstate(over="ignore"):
            total = h[:n] * _MIX[0]
            for k in range(1, WORDS):
                total = total + h[k : k + n] * _MIX[k]
            return np.unique(_mixed(total))


def _multipliers() -> np.ndarray:
    seeds = np.arange(1, HASHES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(seeds * _MIX[0]) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """The upper 32 bits of the smallest product with each multiplier."""
    factors = _multipliers()[:, None]
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[None, i : i + 4096] * factors).min(1))
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            sizes, keys, signatures = [], [], []
            for text in part.column(1).to_pylist():
                found = shingler.shingles(text)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS_ARROW)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bag) from (node, set_key, diff); a text that is not the node's set, or repeats it, has no row."""
    shingler = Shingler()
    seen: set[int] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            nodes, bags = [], []
            for node, key, text in zip(*(c.to_pylist() for c in batch.slice(i, 200).columns), strict=True):
                bag = shingler.shingles(text).tobytes()
                if node not in seen and xxhash.xxh3_128_digest(bag) == key:
                    seen.add(node)
                    nodes.append(node)
                    bags.append(bag)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bags, pa.binary())], names=["node", "bag"])


def _reading(signature: bytes, tree: int, levels: int) -> bytes:
    """A tree's first ``levels`` hashes: the signature from the tree's own place on, cyclically."""
    at = 4 * FLOOR_DEPTH * tree
    return (signature + signature)[at : at + 4 * levels]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent nodes of a sorted order that share a prefix of the floor depth."""
    before, node_before = None, None
    for batch in batches:
        a, b = [], []
        for tree, reading, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prefix = (tree, reading[: 4 * FLOOR_DEPTH])
            if before == prefix:
                a.append(min(node, node_before))
                b.append(max(node, node_before))
            before, node_before = prefix, node
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, signatures = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for tree in range(ORDERS):
            readings = [_reading(s, tree, 2 * FLOOR_DEPTH) for s in signatures]
            columns = [pa.array([tree] * len(nodes), pa.int32()), pa.array(readings, pa.binary()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "reading", "node"])


def _all_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the hash of the tree's reading to the floor depth."""
    trees = np.arange(TREES, dtype=np.uint64)
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            pairs = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, TREES, FLOOR_DEPTH // 2)
            with np.errstate(over="ignore"):
                total = trees * _MIX[4]
                for k in range(FLOOR_DEPTH // 2):
                    total = _mixed(total + pairs[:, :, k]) * _MIX[k]
                regions = _mixed(total).view(np.int64).ravel()
            nodes = np.repeat(part.column(0).to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(regions), pa.array(tree), pa.array(nodes)], names=["region", "tree", "node"])


def _by_cell(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of one cell after another, from rows sorted by its first ``keys`` columns."""
    cell, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != cell and held:
                yield held
                held = []
            cell = row[:keys]
            held.append(row)
    if held:
        yield held


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` (region, tree, node, component) of regions with several components, as (region, tile, tree, node, component, role).

    Every node outside its region's largest component asks all the others in exactly one cell
    each. A cell is a block of those that ask and a block of those asked, each about the root of ``CROWDED``.
    """
    side = max(1, math.isqrt(CROWDED))
    # Counts by component first: a region inside one component ends here.
    shape = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = shape.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    blocks = [F.ceil(F.col(n) / side).alias(name) for n, name in (("outside", "p"), ("n", "q"))]
    mixed = shape.where("n > top.n").withColumn("outside", F.expr("n - top.n")).select("region", F.col("top.component").alias("top"), *blocks)
    mixed = stored(mixed, "mixed-regions")
    open_ = rows.join(mixed, "region").withColumns(
        {"outside": F.expr("component <> top"), "at_p": F.expr("pmod(xxhash64(1, node), p)"), "at_q": F.expr("pmod(xxhash64(2, node), q)")}
    )
    asked = f"""transform(sequence(0L, p - 1), i -> named_struct('tile', i * q + at_q,
        'role', {ASKED} + if(outside, {OUTSIDE}, 0) + if(outside AND i = at_p, {ASKS}, 0)))"""
    asks = f"""transform(filter(sequence(0L, q - 1), j -> outside AND j <> at_q), j -> named_struct('tile', at_p * q + j, 'role', {ASKS + OUTSIDE}))"""
    dealt = open_.select("region", "tree", "node", "component", F.explode(F.expr(f"concat({asked}, {asks})")).alias("cell"))
    return dealt.select("region", "cell.tile", "tree", "node", "component", "cell.role")


_MET = "region bigint, tile bigint, part bigint, node bigint, component bigint, role int"
_MET_ARROW = pa.schema(
    [("region", pa.int64()), ("tile", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("role", pa.int32())]
)


def _pairs_with(i: int, node: np.ndarray, component: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Whom row ``i`` of a cell asks; of two nodes outside the largest component the smaller asks."""
    return (role & ASKED > 0) & (component != component[i]) & ((role & OUTSIDE == 0) | (node > node[i]))


def _active(rows: list[tuple]) -> np.ndarray:
    """The rows of a cell with a near partner in another component; a pair counts in the first tree alone in which it meets."""
    tree = rows[0][2]
    node, component, role, size = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 7))
    signatures = np.frombuffer(b"".join(r[6] for r in rows), ">u4").astype(np.uint32).reshape(len(rows), HASHES)
    marked = np.zeros(len(rows), bool)
    for i in np.flatnonzero(role & ASKS):
        alike = 4 * np.minimum(size, size[i]) >= 3 * np.maximum(size, size[i])
        others = np.flatnonzero(_pairs_with(i, node, component, role) & alike)
        for k in range(0, len(others), 8192):
            part = others[k : k + 8192]
            equal = signatures[part] == signatures[i]
            near = equal.sum(1) >= NEAR * HASHES
            met = equal[near].reshape(-1, TREES, FLOOR_DEPTH).all(2)
            hits = part[near][met.argmax(1) == tree]
            marked[hits] = True
            marked[i] |= len(hits) > 0
    return np.flatnonzero(marked)


def parts(roles: list[int], sizes: list[int], limit: int) -> Iterator[tuple[int, int, int]]:
    """(row, part, role) so that who asks meets whom it asks in one part, of two blocks of about ``limit`` shingles."""
    role, size = np.array(roles, np.int64), np.array(sizes, np.int64)

    def blocks(flag: int) -> np.ndarray:
        own = np.where(role & flag > 0, size, 0)
        return (np.cumsum(own) - own) // limit

    at_p, at_q = blocks(ASKS), blocks(ASKED)
    p, q = at_p.max(initial=0) + 1, at_q.max(initial=0) + 1
    for k, r in enumerate(roles):
        if r & ASKED:
            yield from ((k, int(i * q + at_q[k]), r if i == at_p[k] else r & ~ASKS) for i in range(p))
        if r & ASKS:
            yield from ((k, int(at_p[k] * q + j), r & ~ASKED) for j in range(q) if not (r & ASKED and j == at_q[k]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for rows in _by_cell(batches, 2):
        met = [rows[i] for i in _active(rows)]
        for k, part, role in parts([r[5] for r in met], [r[7] for r in met], BLOCK_SHINGLES):
            out.append((*met[k][:2], part, *met[k][3:5], role))
        if len(out) > 5000:
            yield _met(out)
            out = []
    if out:
        yield _met(out)


def _met(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MET_ARROW, strict=True)], schema=_MET_ARROW)


def joining_links(nodes: list[int], component: list[int], role: list[int], bags: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components, each of which joins two that were apart.

    Only rows that ask are looked at, against those they ask, through the list of nodes that
    hold each shingle.
    """
    node, role = np.array(nodes), np.array(role)
    label = np.unique(component, return_inverse=True)[1]
    sizes = np.array([len(x) for x in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    values, token = np.unique(np.concatenate(bags), return_inverse=True)
    holders = owner[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token, minlength=len(values)))
    starts = np.concatenate([[0], ends[:-1]])
    tokens = np.split(token, np.cumsum(sizes)[:-1])
    links = []
    for i in np.argsort(sizes, kind="stable"):
        asked = _pairs_with(i, node, label, role)
        if not role[i] & ASKS or not asked.any():
            continue
        both = np.bincount(np.concatenate([holders[s:e] for s, e in zip(starts[tokens[i]], ends[tokens[i]], strict=True)]), minlength=len(bags))
        near = np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[i] - both)) & asked)
        for j in near:
            if label[j] != label[i]:
                links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                label[label == label[j]] = label[i]
    return links


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_cell(batches, 3):
        bags = [np.frombuffer(r[6], np.uint64) for r in rows]
        links = joining_links([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], bags)
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(t) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    first = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("p")), "a")
    both = first.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(_confirmed, "a bigint, b bigint")


def _met_rows(dealt: DataFrame, signed: DataFrame) -> DataFrame:
    """The rows of cells that have a near partner in another component."""
    full = dealt.join(signed, "node").select("region", "tile", "tree", "node", "component", "role", "signature", "n_shingles")
    full = full.repartition("region", "tile").sortWithinPartitions("region", "tile", "node")
    return stored(full.mapInArrow(_meet, _MET), "meetings")


def _links_of(met: DataFrame, bags: DataFrame) -> DataFrame:
    """Confirmed links that join components in each part of a cell."""
    close = met.join(bags, "node").select("region", "tile", "part", "node", "component", "role", "bag")
    dealt = close.repartition("region", "tile", "part").sortWithinPartitions("region", "tile", "part", "node")
    return dealt.mapInArrow(_joined, "a bigint, b bigint")


def near_duplicates(edits: DataFrame) -> DataFrame:
    """One row per edit: rev_id, n_shingles, component_id, kept.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored. A-Z are lower-cased
    and words are runs of non-blanks. A text of one to four words is one shingle; a NULL text
    or one without words has none and is linked with nothing, itself the component. Edits are
    linked at a Jaccard similarity of 0.75 or more; ``component_id`` is the smallest id that
    links reach, and ``kept`` says it is the edit's own. Repeated rows share a component. An
    edit without an id belongs to the component of equal edits that have one, else to none.
    """
    v = edit_columns(edits)
    sets = stored(v.mapInArrow(_sets, _SETS), "shingle-sets")
    some = sets.where(F.col("set_key").isNotNull() & F.col("rev_id").isNotNull())
    groups = stored(some.groupBy("set_key").agg(F.min("rev_id").alias("node"), F.count(F.lit(1)).alias("n")), "set-groups")
    # Ids are unique but for repeated rows; of different texts under one id the smallest digest stands for it.
    picked = stored(groups.groupBy("node").agg(F.min("set_key").alias("set_key")), "nodes")
    keyed = picked.select("node", F.col("set_key").alias("k"))
    signed = sets.join(keyed, (F.col("rev_id") == F.col("node")) & (F.col("set_key") == F.col("k")))
    signed = stored(signed.groupBy("node").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "signatures")

    order = signed.select("node", "signature").mapInArrow(_orders, "tree int, reading binary, node bigint")
    order = order.repartitionByRange("tree", "reading", "node").sortWithinPartitions("tree", "reading", "node")
    first_pairs = stored(order.mapInArrow(_neighbours, "a bigint, b bigint").distinct(), "first-pairs")

    regions = signed.select("node", "signature").mapInArrow(_all_regions, "region bigint, tree int, node bigint")
    # Counts are stored before they meet their rows: such a join has a shuffle that Spark can split at a hot region.
    shared = stored(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"), "shared-regions")
    shared = stored(regions.join(shared, "region"), "regions")
    wanted = shared.select("node").union(first_pairs.select("a")).union(first_pairs.select("b")).distinct()
    texts = v.join(picked.join(wanted, "node", "left_semi"), F.col("rev_id") == F.col("node")).select("node", "set_key", "diff")
    bags = stored(texts.mapInArrow(_bags, "node bigint, bag binary"), "bags")

    links = stored(confirm(first_pairs, bags), "first-links")
    known = stored(components(links), "first-components")

    rows = shared.join(known, "node", "left").select("region", "tree", "node", F.coalesce("component", "node").alias("component"))
    more = _links_of(_met_rows(cells(rows), signed), bags)
    named = stored(components(links.unionByName(more)), "components")

    # What goes back to the rows is small for each set or node, but its rows may be many: both joins are salted.
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = sets.select("rev_id", "n_shingles", "set_key", F.pmod(F.xxhash64("rev_id"), F.lit(SALTS)).cast("int").alias("salt"))
    node = groups.where("n > 1").select("set_key", "node", spread.alias("salt"))
    placed = dealt.join(node, ["set_key", "salt"], "left").select("rev_id", "n_shingles", "salt", F.coalesce("node", "rev_id").alias("node"))
    name = named.select("node", "component", spread.alias("salt"))
    component = F.coalesce("component", "node")
    return placed.join(name, ["node", "salt"], "left").select(
        "rev_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("rev_id") == component, F.lit(False)).alias("kept")
    )
