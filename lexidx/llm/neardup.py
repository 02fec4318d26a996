"""Near copies: MinHash signatures joined through inverted lists of coordinates.

1. Every text becomes its set of distinct word shingles (64-bit fingerprints)
   and a MinHash signature of K coordinates. Equal sets are one class with a
   number of its own; everything below works on classes. Classes that hold texts
   of one id are linked.
2. Signatures are posted under their (coordinate, value) tokens. Two sets above
   the similarity bound agree on at least T coordinates but for a chance of
   ``miss``; so it is enough to post each class under the K-T+1 tokens that come
   first in a common order (prefix filter). The order puts frequent tokens last,
   so long lists are skipped; a fixed-size count sketch knows which are long.
3. First pass: each class meets the smallest class of every list it is in; pairs
   with fewer than T collisions go, the rest are confirmed on their full sets,
   links are contracted to components.
4. Second pass: only lists that still hold several components are looked at, and
   only across components of compatible set sizes: a pair inside one component
   cannot change the result. Short lists are joined into pairs. Long ones are
   dealt in blocks, and a task that holds two blocks merges them: it counts the
   collisions of all their signatures at once, skips pairs that met in a list
   before this one, confirms the rest on the full sets it holds, and gives out
   only links that join components. So groups of thousands of copies never expand
   into rows of pairs, yet no link between different components goes untested.

Sets are built anew from the texts of those classes that are candidates, and
links are confirmed in integers: den * |A and B| >= num * |A or B|.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; texts with fewer words than a shingle are one shingle; very long
texts are read whole; a component has its smallest id as name; rows that repeat
an id are one document, whatever their texts (linked with what any of them is
linked with), and each gets its row; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.llm.common import discard, per_batch, sliced, staged

COORDINATES = 64
MISS = 1e-6
SKETCH = 1 << 18
FILTER_BITS = 1 << 24
LONG_LIST = 32  # lists above this are merged in blocks
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1_000_000
SEED = 1009


def least_collisions(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest T such that fewer than T of k coordinates agree with a chance below ``miss``."""
    tail, t = 0.0, 0
    while t < k:
        tail += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


class Shingler:
    """Texts to sets of shingle fingerprints; one for each task, with a bounded memory of words."""

    MEMORY = 100_000

    def __init__(self, words: int):
        import xxhash
        self.n, self.hash, self.memory = words, xxhash.xxh64_intdigest, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct fingerprints. bytes.lower() changes A-Z only, bytes.split() cuts at space and 09-0D."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memory = self.memory
        try:
            codes = [memory[w] for w in words]
        except KeyError:
            if len(memory) > self.MEMORY:
                memory.clear()
            for w in set(words).difference(memory):
                memory[w] = self.hash(w)
            codes = [memory[w] for w in words]
        h = np.array(codes, np.uint64)
        m = min(self.n, len(h))
        out = np.full(len(h) - m + 1, m, np.uint64)
        for j in range(m):
            out = (out ^ h[j:len(h) - m + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _mix(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(1, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(fingerprints: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """K minima of 32-bit values; long sets are taken in slices, so memory stays small."""
    best = np.full(len(mult), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(fingerprints), 1024):
        x = fingerprints[at:at + 1024]
        best = np.minimum(best, (((x[None, :] * mult[:, None] + add[:, None])) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sig, low): the set's size, its 128-bit name, its signature and the low byte of each coordinate."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        import xxhash
        shingles, (mult, add) = Shingler(words), _mix(COORDINATES)
        for batch in sliced(batches):
            sizes, names, sigs, lows = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                names.append(xxhash.xxh128_digest(s.tobytes()))
                sig = signature(s, mult, add) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                lows.append(None if sig is None else sig.astype(np.uint8).tobytes())
            fp = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()),
                 pa.array(sigs, pa.binary()), pa.array(lows, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "sig", "low"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_shingles long, fp1 long, fp2 long, sig binary, low binary")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(rows, K) 64-bit names of (coordinate, value)."""
    k = sig.shape[1]
    return (np.arange(k, dtype=np.int64)[None, :] << 32) | sig.astype(np.int64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return ((tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def token_counts(classes: DataFrame) -> np.ndarray:
    """How often tokens fall into each of SKETCH slots; its size does not depend on the data."""
    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in sliced(batches):
            total += np.bincount(_slot(_tokens(_sig_matrix(batch.column(0)))).ravel(), minlength=SKETCH)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    out = np.zeros(SKETCH, np.int64)
    rows = classes.select("sig").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def posts(classes: DataFrame, counts: np.ndarray, least: int) -> DataFrame:
    """(token, cid, n): each class under the first K-T+1 of its tokens, rare ones first."""
    spark = classes.sparkSession
    shipped = spark.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.int32))
    take = COORDINATES - least + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _tokens(_sig_matrix(batch.column(2)))
        slots = _slot(tokens)
        order = np.lexsort((tokens, slots, shipped.value[slots]), axis=1)[:, :take]
        chosen = np.take_along_axis(tokens, order, axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(chosen.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), take)),
             pa.array(np.repeat(batch.column(1).to_numpy(), take))], ["token", "cid", "n"])

    return classes.select("cid", "n", "sig").mapInArrow(per_batch(run), "token long, cid long, n long")


def _enough_collisions(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on at least ``least`` coordinates, or seem to.

    Low bytes are compared: a quarter of the bytes travels, no pair with enough collisions is
    lost, and the few others that pass are refused on the full sets.
    """
    low = classes.select("cid", "low")
    both = (pairs.join(low.withColumnsRenamed({"cid": "a", "low": "low_a"}), "a")
            .join(low.withColumnsRenamed({"cid": "b", "low": "low_b"}), "b").select("a", "b", "low_a", "low_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
        same = (a == b).sum(axis=1)
        return batch.select(["a", "b"]).filter(pa.array(same >= least))

    return both.mapInArrow(per_batch(run), "a long, b long")


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits, one set for each id's hash; it may let others pass, never drops one."""
    h = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    rows = (ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def class_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, set): the full shingle set of each wanted class, once, from the texts of its smallest id."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(_bitmap(wanted, "first_id"))
    src = docs.select(F.col(id_col).cast("long").alias("first_id"), F.col(text_col).cast("binary").alias("text"),
                      F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_BITS)).alias("h"))

    def run(batches):
        import xxhash
        shingles, bits, seen = Shingler(words), shipped.value, set()
        for batch in sliced(batches):
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            rows, sets, names = [], [], []
            for r, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = shingles(text)
                name = xxhash.xxh128_digest(found.tobytes())
                if not len(found) or (i, name) in seen:  # rows that repeat
                    continue
                seen.add((i, name))
                rows.append(r)
                sets.append(found.view(np.int64))
                names.append(name)
            if len(seen) > Shingler.MEMORY:  # what repeats after this goes below
                seen.clear()
            if not rows:
                continue
            fp = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["first_id", "fp1", "fp2", "set"])

    keys = ["first_id", "fp1", "fp2"]
    return (src.mapInArrow(run, "first_id long, fp1 long, fp2 long, set array<long>")
            # by the keys of the join, so that dropping what repeats exchanges no set again
            .join(wanted.select("cid", *keys), keys).dropDuplicates(keys).select("cid", "set"))


def same_ids(sigs: DataFrame, named: DataFrame, written: list[str]) -> DataFrame:
    """(a, b): links between the classes that hold texts of one id."""
    spark = sigs.sparkSession
    rows = sigs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "fp1", "fp2")
    several = (rows.groupBy("doc_id").agg(*(f("fp" + c).alias(f.__name__ + c) for f in (F.min, F.max) for c in "12"))
               .where("min1 <> max1 or min2 <> max2").select("doc_id"))
    several = staged(spark, several, "neardup-several", written)
    held = rows.join(several, "doc_id", "left_semi").distinct().join(named, ["n_shingles", "fp1", "fp2"]).select("doc_id", "cid")
    held = staged(spark, held, "neardup-held", written)
    return held.join(held.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").where("cid <> a").select("a", F.col("cid").alias("b"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = (pairs.join(sets.withColumnsRenamed({"cid": "b", "set": "set_b"}), "b")
              .join(sets.withColumnsRenamed({"cid": "a", "set": "set_a"}), "a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return joined.select("a", "b", "set_a", "set_b", common.alias("common")).where(F.col("common") * den >= union * num).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))


def merged_blocks(open_long: DataFrame, classes: DataFrame, sets: DataFrame, counts: np.ndarray, least: int, num: int, den: int) -> DataFrame:
    """(a, b): links between components among the posts (token, cid, n, component) of long lists.

    A list is dealt in parts by a hash, as many as keep a part below BLOCK_ROWS
    posts and BLOCK_SHINGLES shingles on average; every two parts meet in one task.
    """
    shipped = open_long.sparkSession.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.int32))
    parts = open_long.groupBy("token").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(float(BLOCK_ROWS)), F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("parts"))
    dealt = (open_long.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cid", "component"))
    full = dealt.join(classes.select("cid", "sig"), "cid").join(sets, "cid")

    def merge(group: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        part = group.column("part").to_numpy()
        left = np.flatnonzero(part == lo)
        right = np.flatnonzero(part == hi)
        cid, component = group.column("cid").to_numpy(), group.column("component").to_numpy()
        sig = _sig_matrix(group.column("sig").combine_chunks())
        here = int(group.column("token")[0].as_py()) >> 32  # the list's coordinate
        tokens = _tokens(sig)
        slots = _slot(tokens)
        order = np.lexsort((tokens, slots, shipped.value[slots]), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        earlier = rank < rank[:, here][:, None]  # coordinates whose lists come before this one
        column = group.column("set").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        shingles, local = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        starts = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
        present = np.zeros(len(shingles) + 1, bool)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        index = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in right]) if len(right) else np.zeros(0, np.int64)
        right_local = local[index]
        right_starts = np.concatenate(([0], np.cumsum(sizes[right])[:-1])) if len(right) else np.zeros(0, np.int64)
        for i in left:
            same = sig[right] == sig[i]
            maybe = ((component[right] != component[i]) & (same.sum(axis=1) >= least) & ~(same & earlier[i]).any(axis=1)
                     & (sizes[right] * den >= sizes[i] * num) & (sizes[i] * den >= sizes[right] * num))
            if lo == hi:
                maybe &= right > i
            if not maybe.any():
                continue
            mine = local[starts[i]:starts[i] + sizes[i]]
            present[mine] = True
            common = np.add.reduceat(present[right_local].astype(np.int64), right_starts)
            present[mine] = False
            for j in right[maybe & (common * den >= (sizes[i] + sizes[right] - common) * num)]:
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:  # links inside what is already joined add nothing
                    parent[max(x, y)] = min(x, y)
                    links.append((int(cid[i]), int(cid[j])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("token", "lo", "hi").applyInArrow(merge, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(cid, component) for every id in a link: the smallest id it is connected with.

    Large-star and small-star steps: each is a minimum per node and a join, so a
    node with very many links is only ever pre-aggregated. Stops when nothing changes;
    links that still change after ``rounds`` are an error, never a result.
    """
    spark = links.sparkSession
    edges = staged(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "neardup-edges")
    written: list[str] = []
    for _ in range(rounds):
        before = list(written)
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(spark, both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "neardup-large", written)
        # Small star: a node's smaller neighbours and itself are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        small = staged(spark, small, "neardup-small", written)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        was = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = small
        if now == was:
            break
        del written[:len(before)]
        discard(spark, before)  # this round's tables are written, those before no longer read
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("component")).distinct())


def near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; similarity at least num / den."""
    spark = docs.sparkSession
    written: list[str] = []  # tables that only the way to the components needs
    least = least_collisions(COORDINATES, num / den)
    sigs = staged(spark, signatures(docs, words, id_col, text_col), "neardup-signatures")
    named = (sigs.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "fp1", "fp2")
             .agg(F.min("doc_id").cast("long").alias("first_id")).withColumn("cid", F.monotonically_increasing_id()))
    named = staged(spark, named, "neardup-classes")
    keys = ["first_id", "n_shingles", "fp1", "fp2"]
    classes = staged(spark, named.join(sigs.select(F.col("doc_id").cast("long").alias("first_id"), *keys[1:], "sig", "low"), keys)
                     .dropDuplicates(keys).select("cid", F.col("n_shingles").alias("n"), "sig", "low"), "neardup-class-sigs", written)
    counts = token_counts(classes)
    posted = staged(spark, posts(classes, counts, least), "neardup-posts", written)

    # Most lists hold one class; from here on only the others travel.
    first = (posted.groupBy("token").agg(F.min("cid").alias("a"), F.min_by("n", "cid").alias("na"), F.max("cid").alias("last"))
             .where("a <> last").select("token", "a", "na"))
    posted = staged(spark, posted.join(first, "token"), "neardup-shared", written)
    fits = (F.col("na") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("na") * num)  # else too different in size
    pairs = posted.where(F.col("cid") != F.col("a")).where(fits).select("a", F.col("cid").alias("b")).distinct()
    pairs = staged(spark, _enough_collisions(pairs, classes, least), "neardup-pairs", written)
    sets = staged(spark, class_sets(docs, named.join(_ends(pairs), "cid", "left_semi"), words, id_col, text_col), "neardup-sets", written)
    links = staged(spark, similar_pairs(pairs, sets, num, den), "neardup-links", written)
    part = staged(spark, components(links.union(same_ids(sigs, named, written))), "neardup-parts", written)

    tied = posted.join(part.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c"), "left").select(
        "token", "cid", "n", F.coalesce("component", "cid").alias("component"))
    mixed = (tied.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("posts"))
             .where("lo <> hi").select("token", (F.col("posts") > LONG_LIST).alias("long")))
    open_posts = staged(spark, tied.join(mixed, "token"), "neardup-open", written)
    short = open_posts.where("not long")
    left = short.select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = short.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    across = (left.join(right, "token").where("ca < cb")
              .where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)).select("a", "b").distinct())
    across = staged(spark, _enough_collisions(across, classes, least), "neardup-across", written)
    open_long = open_posts.where("long").select("token", "cid", "n", "component")
    wanted = named.join(_ends(across).union(open_long.select("cid")), "cid", "left_semi")
    sets = staged(spark, class_sets(docs, wanted, words, id_col, text_col), "neardup-more-sets", written)
    more = similar_pairs(across, sets, num, den).union(merged_blocks(open_long, classes, sets, counts, least, num, den))
    # Contract what the first pass found: its components are stars now.
    merged = staged(spark, components(more.union(part.select(F.col("cid").alias("a"), F.col("component").alias("b")))), "neardup-components", written)
    linked = merged.join(named.select("cid", "first_id"), "cid")
    names = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = named.join(merged.join(names, "component").select("cid", "component_id"), "cid", "left").select(
        "n_shingles", "fp1", "fp2", F.coalesce("component_id", "first_id").alias("component_id"))
    member = staged(spark, member, "neardup-members")
    rows = sigs.select("doc_id", "n_shingles", "fp1", "fp2")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # Rows without words go with the other texts of their id, if there are any.
    bare = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    ids = staged(spark, bare.select("doc_id").distinct(), "neardup-bare", written)
    others = staged(spark, full.join(ids, "doc_id", "left_semi").distinct().join(member, ["n_shingles", "fp1", "fp2"])
                    .groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "neardup-others")
    discard(spark, written)
    out = (full.join(member, ["n_shingles", "fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
           .union(bare.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", F.col("doc_id").cast("long"))))
           .union(rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id").cast("long") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows that repeat it, one stays.

    That one is chosen by a hash of the row, among those with words if there are any. Rows without id all stay.
    """
    spark = docs.sparkSession
    found = near_copies(docs, words, num, den, id_col, text_col)
    keep = staged(spark, found.where("kept").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows")), "neardup-keep")
    # One plan at every size: merged, never broadcast while the ids happen to be few.
    once = docs.join(keep.where("_rows = 1 or _keep is null").hint("merge"), F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
    again = staged(spark, keep.where("_rows > 1 and _keep is not null").select("_keep"), "neardup-again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(~F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False)), F.xxhash64(*columns))
    one = (docs.join(again, F.col(id_col) == F.col("_keep"), "left_semi").groupBy(F.col(id_col).alias("_keep"))
           .agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*"))
    return once.union(one)
