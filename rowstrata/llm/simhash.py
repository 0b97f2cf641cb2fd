"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values
have it set. Two fingerprints link at Hamming distance ``RADIUS`` or less. All
links are found exactly: distinct fingerprints are compared tile against tile
with numpy exclusive-or and bit counts, and a pair of tiles is skipped when the
population counts in them differ by more than the radius.

So that tiles of fingerprints that can't link never meet, rows are first dealt
by pigeonhole: of radius + 2 blocks of bits two must agree, so each fingerprint is
filed under all pairs of its blocks and tiles are cut from rows with a common pair.
Files of more than ``BUCKET_ROWS`` fingerprints are dealt again by
blocks of the bits left, exactly. A task keeps a spanning forest of the links that
it finds, never all pairs; components are then found by star contraction.

``near_copies`` links texts at a Jaccard similarity of 0.8 or more of their five-word
shingles. No radius alone can tell those, so its tiles propose pairs within the wide radius
``NEAR_RADIUS``, a parity sketch of each set spares most pairs that don't link (exclusive-or and bit counts
again: they bound the difference of two sets from below), and an exact check of the shingle sets decides. Its rows are dealt by
prefix filtering, which such texts can't escape: with all shingles in one order, they share
one of the first n - ceil(0.8 n) + 1 of each. The order is rarest first, by counts
over all texts that are kept in ``CELLS`` cells, then by hash; it decides the cost only.

Defined results: a null text is the empty text; texts without words have the
fingerprint zero and link like any other; rows that share a doc_id or a text
share fingerprints; a null doc_id never names a component (null if a class has
no other), yet its text links others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
RADIUS = 2
BITS = 64
TILE = 256
#: Rows of small files that are compared together.
CHUNK = 1024
BUCKET_ROWS = 8192
_HASH_CHUNK = 1 << 15


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingles, unsigned."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _HASH_CHUNK):
        part = hashes[at : at + _HASH_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, width))


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    """Fingerprints as signed longs."""
    common.bounded_batches()

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("binary"))


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    """The bits in so many runs of about one length."""
    return [bits[i * len(bits) // count : (i + 1) * len(bits) // count] for i in range(count)]


def _part(*blocks: list[int]) -> Column:
    """The fingerprint with all other bits cleared."""
    mask = sum(1 << i for b in blocks for i in b)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long"))


class Forest:
    """Union-find over the nodes of one task; roots are the smallest ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in self.up if self.find(x) != x]


def tile_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a set of fingerprints within the radius, tile pair by tile pair."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int64)
    starts = range(0, len(fps), tile)
    for i in starts:
        a, most = fps[i : i + tile], counts[min(i + tile, len(fps)) - 1]
        for j in range(i, len(fps), tile):
            if counts[j] - most > radius:  # sorted: no later tile is nearer
                break
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius)
            keep = x + i < y + j
            if keep.any():
                yield order[x[keep] + i], order[y[keep] + j]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links among sorted (file, fp, rep) rows.

    Files are compared many at a time: rows of neighbouring files fill a tile,
    and any link found is a true one. Only a file that goes on holds rows back.
    """
    forest = Forest()

    def compare(fp: np.ndarray, rep: np.ndarray) -> None:
        roots = rep
        for x, y in tile_links(fp.view(np.uint64), radius):
            # One link per row and round, until no link joins two trees: dense groups cost no pair each.
            while True:
                roots = np.array([forest.find(r) for r in roots.tolist()], np.int64)
                open_ = roots[x] != roots[y]
                if not open_.any():
                    break
                x, y = x[open_], y[open_]
                _, at = np.unique(x, return_index=True)
                for a, b in zip(rep[x[at]].tolist(), rep[y[at]].tolist()):
                    forest.join(a, b)

    def cut(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> None:
        """Compare whole files, about a chunk of rows at once."""
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        at = 0
        while at < len(key):
            stop = int(ends[np.searchsorted(ends, min(at + CHUNK, len(key)))])
            compare(fp[at:stop], rep[at:stop])
            at = stop

    held = (np.zeros(0, np.int64),) * 3
    for batch in batches:
        key, fp, rep = (np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns))
        first = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
        cut(key[:first], fp[:first], rep[:first])
        held = (key[first:], fp[first:], rep[first:])
    if len(held[0]):
        cut(*held)
    edges = forest.edges()
    for at in range(0, len(edges), 100_000):
        a, b = zip(*edges[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def link_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a > b: edges between the representatives of linked fingerprints, connected as the links are.

    ``nodes`` has distinct (fp, rep) rows and is stored. Any radius is exact; the wider it is,
    the fewer bits have the blocks and the more rows meet.
    """
    if not 0 <= radius <= BITS // 2 - 2:
        raise ValueError(f"no blocks for a radius of {radius}")
    blocks = _blocks(list(range(BITS)), radius + 2)
    pairs = [(k, x, y) for k, (x, y) in enumerate(combinations(blocks, 2))]
    file = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.xxhash64(F.lit(k), _part(x, y)).alias("file")) for k, x, y in pairs)))
    filed = nodes.select(file.alias("f"), "fp", "rep").select("f.pair", "f.file", "fp", "rep")
    large = filed.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select(F.col("file").alias("large"))
    rest = filed.join(large, F.col("file") == F.col("large"), "left")
    # A large file is dealt again: of as many blocks of the bits outside its equal ones two are equal too.
    again = F.array("file")
    for k, x, y in pairs:
        free = _blocks([i for i in range(BITS) if i not in x and i not in y], radius + 2)
        again = F.when(F.col("pair") == k, F.array(*(F.xxhash64("file", F.lit(n), _part(*own)) for n, own in enumerate(combinations(free, 2))))).otherwise(again)
    keys = F.when(F.col("large").isNull(), F.array("file")).otherwise(again)
    dealt = rest.select(F.explode(keys).alias("file"), "fp", "rep")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "file").sortWithinPartitions("file")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def components(edges: DataFrame, label: str = "star") -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge but roots.

    Large-star and small-star rounds, each written to the shared folder, until
    the edges are stars around the smallest nodes. Minima are pre-aggregated
    before they are joined to the edges of a hub.
    """
    edges = common.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.store(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.store(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (a, b), a > b, are stars around their smallest nodes: no node is below two, or below one and above another.

    Each partial count has a row per node and task at most, so a hub costs no task more than others.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("below")), F.struct(F.col("b").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    counts = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return counts.agg(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("least") == 0)))).first()[0] is not True


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    Fingerprints link by themselves, whatever ids their rows have, so rows without an id
    connect like others; a component is named by the smallest id in it.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(common.text_or_empty(text_col), width).alias("fp"))
    slim = common.store(slim, "fingerprints")
    nodes = common.store(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(link_edges(nodes.select("fp", F.col("fp").alias("rep")), radius))
    classes = nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("class"), "least")
    names = classes.groupBy("class").agg(F.min("least").alias("component_id")).withColumnRenamed("class", "named")
    classes = classes.join(names, F.col("class") == F.col("named")).select("class_fp", "component_id")
    return slim.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


# ---- near copies: tiles propose, shingle sets decide

NEAR_WIDTH = 5
#: The least Jaccard similarity that links, as a fraction.
ALIKE = (4, 5)
#: Texts of that similarity differ in 10 of 64 bits on average; in more than so many, one in ten thousand does.
NEAR_RADIUS = 20
#: Cells in which shingles are counted, a power of 2: the only thing the driver gets, of one size for any input.
CELLS = 1 << 16
#: Rows of a file too large for all pairs that the others are compared with at first.
PIVOTS = 64
#: Bits of the parity sketch of a set: how many of its shingles fall on each, odd or even.
PARITY = 2048


def shingle_set(text: bytes, width: int = NEAR_WIDTH) -> np.ndarray:
    """The different shingles of a text by their signed hashes; a text without words has one, 0."""
    hashes = shingle_hashes(text, width)
    return np.unique(hashes.view(np.int64)) if len(hashes) else np.zeros(1, np.int64)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def shingle_counts(texts: DataFrame, width: int = NEAR_WIDTH) -> np.ndarray:
    """How many shingles of the texts (a column ``text``) fall into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(_cell(shingle_set(t.as_py() or b"", width)))
                size += len(held[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(total[live], pa.int64())], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for cell, n in texts.select(F.col("text").cast("binary")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def prefix(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that each set it links with has one of them in its own."""
    keep = len(tokens) + (-ALIKE[0] * len(tokens)) // ALIKE[1] + 1
    return tokens[np.lexsort((tokens, counts[_cell(tokens)]))[:keep]]


def _print_column(text: Column, counts: np.ndarray, width: int) -> Column:
    @F.pandas_udf("struct<fp: long, prefix: array<long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        prints, prefixes = np.zeros(len(texts), np.uint64), []
        for i, t in enumerate(texts):
            hashes = shingle_hashes(t or b"", width)
            prints[i] = majority(hashes)
            prefixes.append(prefix(np.unique(hashes.view(np.int64)) if len(hashes) else np.zeros(1, np.int64), counts))
        return pd.DataFrame({"fp": prints.view(np.int64), "prefix": pd.Series(prefixes, dtype=object)})

    return run(text.cast("binary"))


def parity(tokens: np.ndarray) -> bytes:
    """The bits on which an odd number of the tokens falls. Those of two sets differ in no more bits than the sets in tokens."""
    bit = ((tokens.view(np.uint64) >> np.uint64(16)) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def _set_column(text: Column, width: int) -> Column:
    @F.pandas_udf("struct<tokens: array<long>, parity: binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t or b"", width) for t in texts]
        return pd.DataFrame({"tokens": pd.Series(sets, dtype=object), "parity": [parity(s) for s in sets]})

    return run(text.cast("binary"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut where the first column changes: about a chunk of rows, or pieces of a run of more than ``most``."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held = new if held is None or not len(held[0]) else [np.concatenate(two) for two in zip(held, new)]
        if not len(held[0]):
            continue
        ends = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1  # of all runs but the last, which may go on
        at = 0
        while at < (ends[-1] if len(ends) else 0):
            last = min(int(np.searchsorted(ends, at + CHUNK)), len(ends) - 1)
            if last and at < ends[last - 1] and ends[last] - ends[last - 1] > most:
                last -= 1  # a long run stands alone
            stop = int(ends[last])
            yield [c[at:stop] for c in held]
            at = stop
        held = [c[at:] for c in held]
        while len(held[0]) > most:
            yield [c[:most] for c in held]
            held = [c[most:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _leaders(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The sorted (token, node, fp) rows that have a neighbour within the radius under their token, and the smallest one.

    A file of ``BUCKET_ROWS`` rows or more is compared with its smallest nodes alone, piece by piece, and stays whole.
    """

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "fp", "leader"])

    large, pivots = None, (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for token, node, fp in _runs(batches, BUCKET_ROWS):
        if len(node) >= BUCKET_ROWS and token[0] == token[-1] and large != token[0]:
            large, pivots = token[0], (node[:PIVOTS], fp[:PIVOTS].view(np.uint64))
        rest = token != large if large is not None else np.ones(len(token), bool)
        if not rest.all():
            of = ~rest
            leader = node[of].copy()
            for n, bits in zip(*pivots):
                near = np.bitwise_count(fp[of].view(np.uint64) ^ bits) <= radius
                leader[near] = np.minimum(leader[near], n)
            yield out(token[of], node[of], fp[of], leader)
        token, node, fp = token[rest], node[rest], fp[rest]
        alike = token[1:] == token[:-1]
        some = np.flatnonzero(np.r_[False, alike] | np.r_[alike, False]) if len(token) else []
        if not len(some):
            continue
        token, node, fp = token[some], node[some], fp[some]
        leader, live = node.copy(), np.zeros(len(node), bool)
        for x, y in tile_links(fp.view(np.uint64), radius):
            own = token[x] == token[y]
            x, y = x[own], y[own]
            live[x] = live[y] = True
            np.minimum.at(leader, x, node[y])
            np.minimum.at(leader, y, node[x])
        if live.any():
            yield out(token[live], node[live], fp[live], leader[live])


def _across(batches: Iterator[pa.RecordBatch], radius: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a > b, of the sorted (file, node, fp, group, size, parity) rows that may link: in one file and two groups.

    ``nearest``: of each row, only the pair whose sketches differ least.
    """

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for file, node, fp, group, size, bits in _runs(batches, 1 << 62):
        best, partner = np.full(len(fp), np.iinfo(np.int64).max), np.zeros(len(fp), np.int64)
        for x, y in tile_links(fp.view(np.uint64), radius):
            own = (file[x] == file[y]) & (group[x] != group[y])
            x, y = x[own], y[own]
            apart = np.concatenate([np.bitwise_count(bits[x[i : i + 4096]] ^ bits[y[i : i + 4096]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
            # sets of this similarity differ by so much of their sizes, at most
            may = (ALIKE[1] + ALIKE[0]) * apart <= (ALIKE[1] - ALIKE[0]) * (size[x] + size[y])
            x, y, apart = x[may], y[may], apart[may]
            if not len(x):
                continue
            if not nearest:
                yield out(node[x], node[y])
                continue
            order = np.argsort(-apart, kind="stable")  # the nearest is written last
            x, y, far = x[order], y[order], apart[order]
            for here, there in ((x, y), (y, x)):
                closer = far < best[here]
                partner[here[closer]] = node[there[closer]]
                best[here[closer]] = far[closer]
        found = np.flatnonzero(best < np.iinfo(np.int64).max)
        if len(found):
            yield out(node[found], partner[found])


def _dealt_across(rows: DataFrame) -> DataFrame:
    """(file, ...) of the (token, node, fp, group) rows whose token holds more than one group.

    A token's rows are one file. Of a token with more than ``BUCKET_ROWS`` the rows of the largest group, which need no comparison
    with each other, and the rest are cut into slices, and each pair of slices but two of that group is a file: of bounded size, and no pair is left out.
    """
    per = rows.groupBy("token", "group").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("most"))
    per = per.where(F.col("most.n") < F.col("n")).select(F.col("token").alias("t"), F.when(F.col("n") > BUCKET_ROWS, F.ceil(F.col("most.n") / BUCKET_ROWS)).alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BUCKET_ROWS).alias("rest"), F.col("most.group").alias("mode"))
    rows = rows.join(per, F.col("token") == F.col("t"))
    slice_of = lambda count: F.pmod(F.xxhash64("node"), count)
    each = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    of_most = F.transform(each(F.col("rest")), lambda j: F.xxhash64("token", F.lit("m"), slice_of(F.col("main")), j))
    own = slice_of(F.col("rest"))
    with_most = F.transform(each(F.col("main")), lambda i: F.xxhash64("token", F.lit("m"), i, own))
    with_rest = F.transform(each(F.col("rest")), lambda j: F.xxhash64("token", F.lit("r"), F.least(own, j), F.greatest(own, j)))
    files = F.when(F.col("main").isNull(), F.array(F.xxhash64("token"))).when(F.col("group") == F.col("mode"), of_most).otherwise(F.concat(with_most, with_rest))
    return rows.select(F.explode(files).alias("file"), "node", "fp", "group")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, stored."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    x, y, shared = F.size("ta"), F.size("tb"), F.size(F.array_intersect("ta", "tb"))
    sizes = ALIKE[1] * F.least(x, y) >= ALIKE[0] * F.greatest(x, y)
    return common.store(both.where(sizes).where(ALIKE[1] * shared >= ALIKE[0] * (x + y - shared)).select("a", "b"), "links")


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(common.text_or_empty(text_col))


def near_copies(docs: DataFrame, text_col: str = "text", width: int = NEAR_WIDTH, radius: int = NEAR_RADIUS) -> DataFrame:
    """(node, root) of each text key that has links, by which the texts of a component have one root.

    Equal texts are one node. Rows are compared under every common prefix shingle, in three rounds: with
    the smallest neighbour, then the nearest one of another group, then all those of other
    components. Pairs within what is connected by then are spared, so a large group of near copies costs
    no pair each, and no link between components is left out.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    texts = docs.select(text_key(text_col).alias("node"), common.text_or_empty(text_col).alias("text"))
    slim = texts.select("node", _print_column(F.col("text"), shingle_counts(texts, width), width).alias("p"))
    nodes = slim.groupBy("node").agg(F.first("p").alias("p"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filed = nodes.select(F.explode("p.prefix").alias("token"), "node", F.col("p.fp").alias("fp"))
    filed = filed.repartition(n, "token").sortWithinPartitions("token", "node")
    live = common.store(filed.mapInArrow(lambda batches: _leaders(batches, radius), "token long, node long, fp long, leader long"), "candidates")
    named = live.select(F.col("node").alias("named")).distinct()
    sets = texts.join(named, F.col("node") == F.col("named"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = common.store(sets.select("node", _set_column(F.col("text"), width).alias("s")).select("node", "s.*"), "shingles")
    sketches = sets.select(F.col("node").alias("of"), F.size("tokens").alias("size"), "parity")

    def proposed(groups: DataFrame, nearest: bool) -> DataFrame:
        rows = live.select("token", "node", "fp").join(groups.select(F.col("node").alias("in"), "root"), F.col("node") == F.col("in"), "left")
        rows = _dealt_across(rows.select("token", "node", "fp", F.coalesce("root", "node").alias("group")))
        rows = rows.join(sketches, F.col("node") == F.col("of")).select("file", "node", "fp", "group", F.col("size").cast("long").alias("size"), "parity")
        rows = rows.repartition(n, "file").sortWithinPartitions("file", "node")
        return rows.mapInArrow(lambda batches: _across(batches, radius, nearest), "a long, b long").distinct()

    first = common.store(live.where("leader < node").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    links = _verified(first, sets)
    # as a group each text has its smallest leader's own
    led = links.groupBy("a").agg(F.min("b").alias("b"))
    above = led.select(F.col("a").alias("up"), F.col("b").alias("top"))
    groups = led.join(above, F.col("b") == F.col("up"), "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("root"))
    second = common.store(proposed(groups, True).join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(second, sets))
    stars = components(links)
    third = proposed(stars, False).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
    # the stars connect what all links did, and stay stars if no link is new
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(third, sets)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
