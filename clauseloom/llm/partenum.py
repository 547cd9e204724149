"""N-gram Jaccard join by PartEnum signatures.

Sets are dealt into bands so that sizes in one band differ by a quarter at most; sets of Jaccard 0.8
lie in one band or in two that adjoin. Within a band the symmetric difference of such sets is bounded by
a number k. The domain of shingles is cut into n1 first-level partitions, so many that in one of
them two similar sets differ in k2 shingles at most, and each of these into n2 second-level ones. Every subset of
n2 - k2 of these gives a signature, the hash of the set's shingles in it: where two sets differ in k2
shingles or fewer, they agree on such a subset.

The three numbers are chosen by k, for signatures that hold enough shingles to tell sets apart: one first-level
partition and subsets of three up to k = 5, subsets of three out of six up to k = 11, and k2 = 0 beyond, where
subsets are whole partitions. There, a quarter of k more partitions are cut than it takes, and each set leaves out
as many, its emptiest: partitions on which sets agree are equally full in both, so the fullest of these is
among the k + 1 fullest of either. (With k2 = 1, pairs out of three, some 1 % of the signatures of sets of 60
to 300 shingles are empty and shared by unlike sets; this way it is 0.04 % and less.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, runs, text_slices
from .bpe import rest
from .buckets import BITS, TILE, bits_apart, bucket_links, cell_bitmap, in_bitmap, merged_keys, pair_keys, parity_sketches, signed
from .shingles import shingle_sets
from .storage import staged

WIDTH = 5
SLICE = 1 << 19
#: Shingles of a task that are turned into signatures at a time.
HELD = 400_000


def band_limits(largest: int) -> np.ndarray:
    """Largest size of each band: the first is 1, and each reaches a quarter beyond its smallest size."""
    out = [1]
    while out[-1] < largest:
        out.append((out[-1] + 1) * 5 // 4)
    return np.array(out, np.int64)


def levels(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each bound k of differences: first-level partitions, those of them left out, second-level partitions, and how many of these a subset has."""
    few, some = k <= 5, k < 12
    out = np.where(some, 0, -(-k // 4))
    first = np.select([few, some], [1, k // 4 + 1], k + 1 + out)
    return first, out, np.select([k == 0, few, some], [1, k + 3, 6], 1), np.select([k == 0, some], [1, 3], 1)


def signatures(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set number and signature, for every signature of sets (``sizes`` ascending hashes on end)."""
    limits = band_limits(int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(limits, sizes)
    content = mix(values, 7)
    firsts = np.cumsum(sizes) - sizes
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for step in (0, 1):
        band = own + step
        # |r - s| + |s - r| <= (|r| + |s|) / 9 at Jaccard 0.8
        first, out, second, subset = levels(2 * limits[band] // 9)
        for n, m in np.unique(np.stack([second, subset], axis=1)[sizes > 0], axis=0).tolist():
            sets = np.flatnonzero((second == n) & (subset == m) & (sizes > 0))
            at = np.repeat(firsts[sets], sizes[sets]) + runs(sizes[sets])
            parts = first[sets] * n
            row = np.repeat(np.arange(len(sets)), sizes[sets])
            slot = (np.cumsum(parts) - parts)[row] + ((values[at] >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.diff(slot, prepend=-1))
            total = np.zeros(int(parts.sum()), np.uint64)
            total[slot[heads]] = np.add.reduceat(content[at], heads)
            total = total.reshape(-1, n)
            owner, index = np.repeat(np.arange(len(sets)), first[sets]), runs(first[sets])
            if out[sets].any():
                held = np.bincount(slot, minlength=total.size).reshape(-1, n)
                order = np.lexsort((index, -held.sum(axis=1), owner))
                order = order[index < (first - out)[sets][owner[order]]]
                total, owner, index = total[order], owner[order], index[order]
            place = band[sets][owner] << 40 | index << 8
            for c, chosen in enumerate(combinations(range(n), m)):
                rows.append(sets[owner])
                found.append(mix(mix(sum(total[:, x] for x in chosen)) + mix((place | c).astype(np.uint64), 5)))
    return np.concatenate(rows), np.concatenate(found)


def wide_sketch(values: np.ndarray) -> bytes:
    """A parity sketch of at least two bits for each member, a power of two of them."""
    cells = 1 << max(9, int(2 * len(values) - 1).bit_length())
    hits = np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_between(one: pa.Buffer, two: pa.Buffer) -> int:
    """In how many bits two wide sketches differ; the longer one is folded to the size of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (one, two)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _read_again(docs: DataFrame, nodes: DataFrame, work, kinds: str) -> DataFrame:
    """``work`` over the rows of docs whose node is one of ``nodes``; a bitmap keeps most others from it, a join all that remain."""
    nodes = staged(nodes, "nodes")
    cells = cell_bitmap(nodes, F.xxhash64("node"))

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(cells.value, batch["cell"].to_numpy(zero_copy_only=False))))

    return docs.mapInArrow(lambda batches: work(known(batches)), kinds).join(nodes, "node", "left_semi")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: ``id_col`` (a long), n_shingles and component_id, the smallest id that links reach.

    Two documents link when the Jaccard similarity of their sets of ``width``-word shingles is 0.8 or more.
    Signatures come from one pass over the texts; documents of candidate pairs are read again for
    what their sketches leave open.

    A null or empty text, or one of white space, has no shingles and links with nothing. Rows of one
    id are one document that links by any of its texts. A row with a null id links with nothing and has a
    null component. An empty table gives no rows. Other columns are not read.
    """
    key = F.col(id_col).cast("long")
    texts = docs.select(key.alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(key).alias("cell"))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        for batch in text_slices(batches, "text", SLICE):
            values, sizes = shingle_sets(batch["text"], width)
            ends = np.cumsum(sizes).tolist()
            digest = np.array([xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip([0, *ends], ends)], np.uint64)
            words = parity_sketches(values, sizes)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sizes), signed(digest), *map(pa.array, words)], names=["node", "size", "digest", *BITS])

    base = staged(texts.mapInArrow(describe, "node long, size long, digest long, " + ", ".join(f"{b} long" for b in BITS)), "sets")
    sketches = staged(base.where("node is not null and size > 0").dropDuplicates(["node", "digest"]), "sketches")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of equal sets that a task holds only the smallest node goes on
        known: dict[bytes, int] = {}
        values, sizes, kind, nodes = [], [], [], []

        def merged():
            of, node = np.array(kind, np.int64), np.concatenate(nodes)
            least = np.full(len(sizes), np.iinfo(np.int64).max)
            np.minimum.at(least, of, node)
            row, found = signatures(np.concatenate(values), np.array(sizes, np.int64))
            key, own = merged_keys(found, least[row])
            other = node != least[of]
            more, both = pair_keys(least[of][other], node[other])
            return pa.RecordBatch.from_arrays([signed(np.concatenate([key, more])), pa.array(np.concatenate([own, both]))], names=["key", "node"])

        count = 0
        for batch in text_slices(batches, "text", SLICE):
            own, each = shingle_sets(batch["text"], width)
            ends = np.cumsum(each).tolist()
            full = np.flatnonzero(each)
            for n in full.tolist():
                part = own[ends[n] - each[n] : ends[n]]
                of = known.setdefault(xxhash.xxh3_128_digest(part.tobytes()), len(sizes))
                if of == len(sizes):
                    values.append(part)
                    sizes.append(len(part))
                    count += len(part)
                kind.append(of)
            nodes.append(batch["node"].to_numpy(zero_copy_only=False)[full])
            if count >= HELD or len(kind) >= HELD:
                yield merged()
                known.clear()
                count = 0
                for held in (values, sizes, kind, nodes):
                    held.clear()
        if sizes:
            yield merged()

    whole = texts.where("node is not null")
    keys = whole.mapInArrow(emit, "key long, node long")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            values, sizes = shingle_sets(batch["text"], width)
            ends = np.cumsum(sizes).tolist()
            each = [values[a:b] for a, b in zip([0, *ends], ends)]
            columns = [batch["node"], batch["cell"], pa.array([wide_sketch(v) for v in each], pa.binary()), pa.array([v.tobytes() for v in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "cell", "wide", "set"])

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [9 * bits_between(x.as_buffer(), y.as_buffer()) <= n for x, y, n in zip(batch["x"], batch["y"], batch["n"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch["x"], batch["y"]):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, two]))
                common = int((both[1:] == both[:-1]).sum())
                on.append(100 * common >= 80 * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: sketches.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "digest", *BITS)))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        low, high = bits_apart("a_", "b_")
        equal = (F.col("a_digest") == F.col("b_digest")) & (F.col("a_size") == F.col("b_size")) & (low + high == 0)
        can = (5 * F.least("a_size", "b_size") >= 4 * F.greatest("a_size", "b_size")) & (9 * (low + high) <= F.col("a_size") + F.col("b_size"))
        looked = staged(met.where(equal | can).groupBy("a", "b").agg(F.bool_or(equal).alias("equal"), F.max(F.col("a_size") + F.col("b_size")).alias("n")), "looked")
        left = looked.where("not equal").select("a", "b", "n")
        ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        own = staged(_read_again(whole, ends(left), sets, "node long, cell long, wide binary, set binary"), "candidate-sets")
        named = lambda rows, c, of, to: rows.select(F.col("node").alias(c), F.col(of).alias(to))
        left = staged(left.join(named(own, "a", "wide", "x"), "a").join(named(own, "b", "wide", "y"), "b").mapInArrow(near, "a long, b long").distinct(), "near")
        own = _read_again(own.select("node", "cell", "set"), ends(left), lambda batches: batches, "node long, cell long, set binary")
        both = left.join(named(own, "a", "set", "x"), "a").join(named(own, "b", "set", "y"), "b")
        return looked.where("equal").select("a", "b").union(both.mapInArrow(similar, "a long, b long")).distinct()

    same = ["digest", "size", *BITS]

    def apart(members: DataFrame) -> DataFrame:
        smallest = sketches.groupBy(*same).agg(F.min("node").alias("node")).select("node")
        return members.join(smallest, "node", "left_semi")

    def prepare(nodes: DataFrame):
        # equal sets need not meet in any star, so each is linked to the smallest node of its kind
        copied = staged(sketches.groupBy(*same).agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last"), "copied")
        return sketches, verify, apart, sketches.join(copied, same).where("a < node").select("a", F.col("node").alias("b"))

    may_link = lambda m, n, low, high: (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (9 * (low + high) <= m + n)
    found = bucket_links(keys, prepare, may_link, tile)
    named = base.select("node", "size").join(found.withColumnRenamed("id", "node"), "node", "left")
    return named.select(F.col("node").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def jaccard_oracle(width: int = WIDTH) -> str:
    """DuckDB SQL for :func:`jaccard_groups` over table documents, for small tables: it counts common shingles of all pairs that have any."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {width} then list_transform(generate_series(1, len(w) - {width - 1}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from r join e on e.x = r.y),
c as (select x, min(y) component_id from r group by x)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id from documents join c on c.x = doc_id left join n using (doc_id)"""
