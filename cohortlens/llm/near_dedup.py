"""Near-duplicate documents by chosen-path set similarity join.

A document's set holds its word shingles as 64-bit hashes.  Documents with equal sets are one
representative from then on, so groups of copies weigh as much as one text.

Chosen path: a set is embedded as SIZE minwise tokens (16 bits of each).  A tree starts with all sets in its root.  A node
selects tokens (one, and with probability 1/4 a second; the root two) by its own hash; a set goes to the child named by
the token's value.  Sets with similarity 0.8 or more share a child with probability 0.8 or more, so expected
1 of them goes on, and nodes of unlike sets fall apart.  Sizes are looked at from level START on: a node of one set
ends there, a node of at most SMALL sets is a leaf, and only rows of larger nodes are branched again, with tokens that
are picked anew, until a node stops shrinking (it has kept TIGHT of its parent's sets: they are much alike, and branching won't part
them) or is DEPTH deep.  TREES independent trees give the recall (measured in the tests).

Leaves are compared exhaustively by sketches (4 bits of every minwise token): a pair is likely if its estimate is at least the
limit minus 4 standard deviations.  A leaf gives a maximum spanning forest of its likely pairs, a large node one of each
of its blocks of SMALL sets and a link of each set to its first one.  What these connect is a family, and every link that
a tree has seen is within one.  Families are then compared on full sets:

1. a family of at most FAMILY sets goes to one task as a whole, once, and all its pairs are compared;
2. in a larger one each set is first compared with its likeliest partner and with the family's hub (the set that most
   others are likest to); that gives groups.  Sets outside the largest group then meet all others in blocks of at most BLOCK sets and
   SHINGLES shingles a side; a block counts common shingles exactly through an inverted list, and gives one link for two groups at
   most.  So rows are copied (sets outside / BLOCK) times, and never pairs.

Every level is written to the shared folder, nothing of the size of the corpus reaches the driver, and a hot node
is one count and many rows, never one task's group.

Edge cases: null or blank text has an empty set and no links; fewer words than a shingle's width: their sequence is the
only shingle; rows with the same doc_id are one document (reachable through each of its texts); a null doc_id is not
linked (component null, kept); repeated rows come out as often as they came in; very long texts are shingled whole, CHUNK characters
at a time with others, and a long set is one row; an empty table gives an empty result; other columns of docs are not looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .common import among, arrow_batches, by_bytes, frugal, stored
from .components import components

SIZE, TREES, START, DEPTH, SMALL, TIGHT = 128, 8, 3, 12, 128, 0.8
#: Sets and shingles of a family that one task compares as a whole; of each side of a block of a larger one.
FAMILY, BLOCK, SHINGLES = 256, 1024, 1_000_000
#: Characters that are shingled at once.
CHUNK = 250_000
_U = np.uint64
_rng = np.random.default_rng(20_240_801)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_SEED = _rng.integers(0, 1 << 32, (SIZE, 1), dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, (SIZE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The words' hashes of each text, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.empty(0, _U) for _ in texts]
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    hashes = mix(np.add.reduceat(_BYTE[data[solid]] * powers[inside], firsts) + lengths.astype(_U))
    bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(hashes, bounds[:-1])


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text (A-Z lower-cased)."""
    for chunk in chunks(texts, CHUNK):
        for h in word_hashes([t.encode().lower() for t in chunk]):
            n = len(h) - width + 1
            if n >= 1:
                s = h[:n]
                for k in range(1, width):
                    s = mix(s * _U(3) + h[k : k + n])
                yield np.unique(s)
            elif len(h):
                s = mix(h[:1] + _U(len(h)))
                for k in range(1, len(h)):
                    s = mix(s * _U(5) + h[k])
                yield s
            else:
                yield h


def minwise(shingles: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens of a set that isn't empty, 16 bits of each."""
    x = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        m = (x[at : at + 2048] ^ _SEED) * _ODD
        m ^= m >> np.uint32(15)
        low = np.minimum(low, m.min(axis=1))
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The low 4 bits of each token, two to a byte."""
    low = (tokens & np.uint16(15)).astype(np.uint8)
    return low[..., ::2] << 4 | low[..., 1::2]


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Sketches as one number of 4 bits to a byte."""
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def similarity(equal: np.ndarray) -> np.ndarray:
    """Estimated similarity from how many numbers of two sketches are equal."""
    return (equal / SIZE - 1 / 16) * (16 / 15)


def children(nodes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): children, at a level, of sets in nodes one level above; row counts nodes, owner is a row of tokens."""
    rows, found = [], []
    for k in range(2):
        pick = mix(nodes + np.array([level * 2 + k + 1], _U) * _BASE)
        go = np.flatnonzero(pick >> _U(62) == 0) if k and level > 1 else np.arange(len(nodes))
        value = tokens[owner[go], (pick[go] % _U(SIZE)).astype(np.int64)].astype(_U)
        rows.append(go)
        found.append(mix(pick[go] ^ mix(value + _U(k))))
    return np.concatenate(rows), np.concatenate(found)


def paths(tokens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, owner) of all trees at a level, for sets given by their tokens."""
    n = len(tokens)
    node, owner = mix(np.repeat(np.arange(1, TREES + 1, dtype=_U), n)), np.tile(np.arange(n), TREES)
    for k in range(1, level + 1):
        row, node = children(node, owner, tokens, k)
        owner = owner[row]
    return node, owner


def _described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set; null if empty), tokens (minwise, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, tokens = [], [], []
            for part in by_bytes(batch):
                for s in shingle_sets([t or "" for t in part.column(1).to_pylist()], width):
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    tokens.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "set_key", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id bigint, n_shingles bigint, set_key binary, tokens binary")


def _matrix(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(-1, SIZE)


def _first_nodes(sets: DataFrame) -> DataFrame:
    """node, id, n_parent: where each set is at level START."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, (node, owner) = batch.column(0).to_numpy(zero_copy_only=False), paths(_matrix(batch.column(1)), START)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[owner]), pa.array(np.full(len(node), 1 << 62))], ["node", "id", "n_parent"])

    return sets.select("id", "tokens").mapInArrow(frugal(run), "node bigint, id bigint, n_parent bigint")


def _next_nodes(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """node, id, n_parent: the children, at a level, of rows (node, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                row, child = children(node.view(_U), np.arange(len(node)), _matrix(batch.column(3)), level)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row]), pa.array(n[row])], ["node", "id", "n_parent"])

    return rows.join(sets.select("id", "tokens"), "id").select("node", "id", "n", "tokens").mapInArrow(frugal(run), "node bigint, id bigint, n_parent bigint")


def leaves(sets: DataFrame) -> DataFrame:
    """node, id, n (the node's sets), head (the least of them), of all nodes where trees end with two sets or more."""
    found, rows = [], _first_nodes(sets)
    for level in range(START, DEPTH + 1):
        rows = stored(rows, f"level{level}")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("head"), F.first("n_parent").alias("n_parent")).where("n > 1")
        goes_on = (F.col("n") > SMALL) & (F.col("n") < TIGHT * F.col("n_parent")) & F.lit(level < DEPTH)
        sizes = stored(sizes.select("node", "n", "head", goes_on.alias("goes_on")), f"sizes{level}")
        found.append(rows.select("node", "id").join(sizes.where("NOT goes_on").select("node", "n", "head"), "node"))
        more = sizes.where("goes_on").select("node", "n")
        if more.isEmpty():
            break
        rows = _next_nodes(rows.select("node", "id").join(more, "node"), sets, level + 1)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def likely_pairs(node: np.ndarray, ids: np.ndarray, packed: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of equal nodes: (a, b, estimate) of its pairs that reach the limit, a < b."""
    cuts = np.flatnonzero(np.diff(node)) + 1
    low = unpacked(packed)
    starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(node)]]))
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        per = max(1, 200_000 // len(i))
        for k in range(0, len(at), per):
            base = at[k : k + per, None]
            left, right = (base + i).ravel(), (base + j).ravel()
            share = np.empty(len(left), np.float32)
            for c in range(0, len(left), 50_000):
                share[c : c + 50_000] = (low[left[c : c + 50_000]] == low[right[c : c + 50_000]]).sum(axis=1, dtype=np.int16)
            estimate = similarity(share)
            ok = estimate >= limit
            left, right, estimate = left[ok], right[ok], estimate[ok]
            yield from _by_node(node, ids, left, right, estimate)


def _by_node(node: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, estimate: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row numbers) as pairs of ids, least first, apart by node."""
    if not len(left):
        return
    order = np.argsort(node[left], kind="stable")
    left, right, estimate = left[order], right[order], estimate[order]
    cuts = np.flatnonzero(np.diff(node[left])) + 1
    a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    yield from zip(np.split(a, cuts), np.split(b, cuts), np.split(estimate, cuts), strict=True)


def forest(a: np.ndarray, b: np.ndarray, estimate: np.ndarray) -> list[int]:
    """Which pairs make a maximum spanning forest (ties: least ids first, the same in every tree)."""
    if len(a) == 1:
        return [0]
    root: dict[int, int] = {}
    kept = []
    for k in np.lexsort((b, a, -estimate)).tolist():
        x, y = _find(root, int(a[k])), _find(root, int(b[k]))
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _candidates(rows: DataFrame, limit: float) -> DataFrame:
    """Distinct likely pairs a, b, likeness of rows (node, block, id, sketch): a spanning forest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            node = mix(table.column("node").to_numpy().view(_U)) + table.column("block").to_numpy().astype(_U)
            ids = table.column("id").to_numpy()
            packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE // 2)
            out: tuple[list, list, list] = ([], [], [])
            for pairs in likely_pairs(node, ids, packed, limit):
                keep = forest(*pairs)
                for all_kept, one in zip(out, pairs, strict=True):
                    all_kept.append(one[keep])
            a, b, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)[1]
            return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(e[once].astype(np.float32))], ["a", "b", "likeness"])

        for table in runs(batches, ["node", "block"]):
            yield solve(table)

    sorted_rows = rows.repartition("node", "block").sortWithinPartitions("node", "block")
    pairs = sorted_rows.mapInArrow(frugal(run), "a bigint, b bigint, likeness float")
    return pairs.where("a <> b").groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches as tables that hold all rows of their keys (whole numbers, not null)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        new[0] = bool(held) and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if new.any():
            last = int(np.flatnonzero(new)[-1])  # rows from here on may go on in the next batch
            whole = pa.concat_tables([*held, table.slice(0, last)])
            held = [table.slice(last)]
            if whole.num_rows:
                yield whole
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are alike enough."""
    left, right = full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), full.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = [alike(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(frugal(run), "a bigint, b bigint")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, shingles (sorted, binary) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                made = [s.tobytes() for s in shingle_sets([t or "" for t in part.column(1).to_pylist()], width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "shingles"])

    return among(docs.select("doc_id", "text"), "doc_id", ids.select("id")).mapInArrow(frugal(run), "id bigint, shingles binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept: one row for each of docs."""
    arrow_batches(docs.sparkSession)
    described = stored(_described(docs, width), "described")
    linkable = described.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # equal sets have equal tokens, so any row's will do
    sets = linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    sets = stored(sets, "sets")
    links = _links(docs, sets, width, percent)
    labels = components(links)
    known = sets.where("copies > 1").select("set_key", "id")
    rows = described.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    rows = rows.withColumn("id", F.coalesce("id", "doc_id")).join(labels.withColumnRenamed("vertex", "id"), "id", "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: confirmed links between ids of different sets, that connect all that are linked."""
    j = percent / 100
    limit = j - 4 * ((j + (1 - j) / 16) * (1 - j - (1 - j) / 16) / SIZE) ** 0.5 * 16 / 15
    nodes = stored(leaves(sets), "leaves")
    # which sets of a large node share a block differs from node to node
    block = F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("n") / SMALL)).cast("int")
    rows = nodes.withColumn("block", F.when(F.col("n") > SMALL, block).otherwise(F.lit(0)))
    pairs = stored(_candidates(rows.join(_sketches(sets), "id").select("node", "block", "id", "sketch"), limit), "forests")
    whole = nodes.where(F.col("n") > SMALL).select(F.col("id").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    families = components(pairs.select("a", "b").union(whole)).select(F.col("vertex").alias("id"), F.col("component").alias("family"))
    sizes = sets.groupBy("id").agg(F.sum("size").alias("size"))  # texts that share an id are one member
    members = stored(families.join(sizes, "id"), "members")
    totals = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    big = stored(totals.where((F.col("n") > FAMILY) | (F.col("shingles") > SHINGLES)).select("family"), "large")
    small = members.join(big, "family", "left_anti")
    links = stored(_within(small.join(_full_sets(docs, small, width), "id"), percent), "links")
    if big.isEmpty():
        return links
    members = stored(members.join(big, "family"), "members")
    full = stored(_full_sets(docs, members, width).join(members.select("id"), "id", "left_semi"), "full")
    sure = stored(_confirm(_likeliest(pairs, members), full, percent), "links")
    return links.union(sure).union(_across(_blocks(members, components(sure)).join(full, "id"), percent))


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what is linked in each family of rows (family, id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["family"]):
            family, ids = table.column("family").to_numpy(), table.column("id").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("shingles")]
            links = []
            for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(family)) + 1):
                root: dict[int, int] = {}
                for k, i in enumerate(at.tolist()):
                    for h in at[:k].tolist():
                        if _find(root, ids[h]) != _find(root, ids[i]) and alike(sets[h], sets[i], percent):
                            root[_find(root, ids[h])] = _find(root, ids[i])
                            links.append((ids[h], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    dealt = rows.select("family", "id", "shingles").repartition("family").sortWithinPartitions("family")
    return dealt.mapInArrow(frugal(run), "a bigint, b bigint")


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.setdefault(x, x)) != x:
        root[x] = root[up]
        x = root[x]
    return x


def _likeliest(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: each member of a large family with the one it is likest to, and with the family's hub."""
    both = pairs.select("a", "b", "likeness").union(pairs.select("b", "a", "likeness"))
    best = both.join(members.select(F.col("id").alias("a"), "family"), "a").groupBy("a", "family").agg(F.max(F.struct("likeness", (-F.col("b")).alias("b"))).alias("top")).select("a", (-F.col("top.b")).alias("b"), "family")
    hubs = best.groupBy("family", "b").count().groupBy("family").agg(F.max(F.struct("count", (-F.col("b")).alias("b"))).alias("top")).select("family", (-F.col("top.b")).alias("b"))
    to_hub = members.select(F.col("id").alias("a"), "family").join(hubs, "family").where("a <> b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(to_hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _blocks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """id, family, grp, ask, at, asking: where the sets outside a family's largest group (asking) meet all its others."""
    rows = members.join(groups.select(F.col("vertex").alias("id"), F.col("component").alias("grp")), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    rows = stored(rows.select("id", "family", "size", "grp"), "members")
    counts = rows.groupBy("family", "grp").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    totals = counts.groupBy("family").agg(F.max(F.struct("m", "grp", "size")).alias("top"), F.sum("m").alias("n"), F.sum("size").alias("size")).where("n > top.m")
    sides = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / SHINGLES)).cast("int")
    totals = totals.select("family", F.col("top.grp").alias("main"), sides(F.col("n") - F.col("top.m"), F.col("size") - F.col("top.size")).alias("asks"), sides(F.col("n"), F.col("size")).alias("asked"))
    rows = rows.select("id", "family", "grp").join(totals, "family")
    mine = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    place = lambda ask, at, asking: F.struct(ask.alias("ask"), at.alias("at"), F.lit(asking).alias("asking"))
    stays = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda k: place(k, mine("asked"), False))
    goes = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda k: place(mine("asks"), k, True))
    return rows.select("id", "family", "grp", F.inline(F.when(F.col("grp") == F.col("main"), stays).otherwise(F.concat(stays, goes))))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links between asking and other sets of different groups, one for two groups of a block.

    rows: id, family, grp, ask, at, asking, shingles."""

    def links(block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        q, t = block[block.asking], block[~block.asking]
        if len(q) and len(t):
            root: dict[int, int] = {}
            sets = [np.frombuffer(s, _U) for s in t.shingles]
            sizes = np.array([len(s) for s in sets])
            # who has a shingle: owners[starts[k]:starts[k + 1]] for the k-th of the sorted shingles
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            shingles, starts = np.unique(every[order], return_index=True)
            owners, starts = owner[order], np.append(starts, len(every))
            ids, groups = t.id.to_numpy(), t.grp.to_numpy()
            for a, group, blob in zip(q.id.tolist(), q.grp.tolist(), q.shingles, strict=True):
                own = np.frombuffer(blob, _U)
                at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                at = at[shingles[at] == own]
                width = starts[at + 1] - starts[at]
                inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
                common = np.bincount(owners[np.repeat(starts[at], width) + inside], minlength=len(sets))
                near = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (groups != group))
                for k in near.tolist():
                    g, h = _find(root, group), _find(root, int(groups[k]))
                    if g != h:
                        root[g] = h
                        found.append((a, int(ids[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select("id", "family", "grp", "ask", "at", "asking", "shingles").groupBy("family", "ask", "at").applyInPandas(links, "a bigint, b bigint")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted) reach the similarity."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _sketches(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sketch(_matrix(batch.column(1)))], pa.binary())], ["id", "sketch"])

    return sets.select("id", "tokens").mapInArrow(frugal(run), "id bigint, sketch binary")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
