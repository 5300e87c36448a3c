"""Operator 4: near-duplicate detection with SetSketch registers.

A document is the set of its word shingles. A register keeps the largest exponentially spaced step that the least of
its exponential hash values reaches; registers of parts merge by maximum, and equal registers become likelier with
the Jaccard similarity. Bands of registers give buckets. Documents with one shingle set are joined into one
representative first, and get its component in the end. In a bucket of few representatives all are compared, in a larger one each is
compared with a leader of its own choice for every band; pairs whose similarity, estimated by maximum likelihood from
all registers and the known set sizes, is near the threshold or above are likely.

Likely pairs are verified on full sets in rounds, as in Boruvka's spanning forest: first the best pair of each
representative, then the best pair of each component to another one, then those that still lie across components;
pairs inside a component are dropped, and links between the same components count once. Large buckets that still hold several components are then searched
exhaustively between components, in blocks of bounded size. Only tables of links and labels are iterated over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import key_filter, key_slot, materialize, passes, text_batches
from fathomline.llm.components import connected_components
from fathomline.llm.word_hash import of_column

#: Words of a shingle and least similarity in percent.
SHINGLE, MIN_PCT = 5, 80
#: Registers: BANDS bands of BAND registers; base of the spacing and rate of the exponential values.
BANDS, BAND, BASE, RATE = 40, 5, 1.05, 20.0
REGISTERS = BANDS * BAND
#: Estimates from here on are verified: six standard deviations below the threshold.
MIN_ESTIMATE = 0.62
#: Buckets up to this many representatives are compared in full; bytes of sets and registers in a block and in a part of the exhaustive search.
SMALL, SEARCH_BYTES = 12, 4_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_A = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_BAND_FACTORS = _random.integers(0, 2**63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's word hashes; a shorter text is one shingle, one without words has none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * _A + h[j : j + n]
    return np.unique(_mixed(out))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow column; A-Z count as a-z."""
    for _, n, words, text in of_column(column, lower=True):
        cuts = np.searchsorted(text, np.arange(n + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield shingles(words[a:b], size)


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes (uint16); the empty set has zeros."""
    if not len(members):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for k in range(0, len(members), 256):
        least = np.minimum(least, (members[k : k + 256, None] * _FACTORS + _OFFSETS).min(0))
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, different between bands."""
    return _mixed((regs.reshape(BANDS, BAND).astype(np.uint64) * _BAND_FACTORS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _A).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of pairs of register rows: the maximum of their joint likelihood given the set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = na / (na + nb)
    v = 1 - u
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    for share in np.linspace(0, 1, 101):
        j = top * share
        plus, minus = p(u - v * j), p(v - u * j)
        score = more * np.log(np.maximum(plus, 1e-12)) + less * np.log(np.maximum(minus, 1e-12)) + (REGISTERS - more - less) * np.log(np.maximum(1 - plus - minus, 1e-12))
        up = score > best
        best[up], at[up] = score[up], j[up]
    return at


def sketch(docs: DataFrame, key_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, n, same, regs): set size, a 128-bit fingerprint of the set, and the registers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, regs = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], names=["doc", "n", "same", "regs"])

    return text_batches(docs).select(F.col(key_col).cast("long").alias("doc"), text_col).mapInArrow(run, "doc long, n long, same binary, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, doc) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            keys = [band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(docs, BANDS))], names=["band", "doc"])

    return reps.select("doc", "regs").mapInArrow(run, "band long, doc long")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b, similarity) whose sizes and estimate allow a link."""
    left, right = (reps.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= MIN_PCT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = [np.frombuffer(b"".join(batch.column(f"r{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab"]
                n = [batch.column(f"n{x}").to_numpy().astype(float) for x in "ab"]
                found = estimate(*r, *n)
                yield batch.select(["a", "b"]).append_column("similarity", pa.array(found)).filter(pa.array(found >= MIN_ESTIMATE))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, similarity double")


def _sets(wanted: DataFrame, docs: DataFrame, key_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, members): full sets of the documents in ``wanted`` (doc), and of few others.

    Sets are made where the texts are read, for documents that a filter of the wanted ones lets through; texts are
    not shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select("doc")))
    keyed = docs.select(F.col(key_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column("slot").to_numpy(zero_copy_only=False))))
            made = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), made], names=["doc", "members"])

    return materialize(keyed.select("doc", "text", key_slot("doc").alias("slot")).mapInArrow(sets, "doc long, members binary"))


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets share enough members."""
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= MIN_PCT * (len(p) + len(q) - shared)


def _verified(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs (a, b, ca, cb) that share enough of their full sets. The number of pairs has no bound, so they are never broadcast."""
    of_b = made.select(F.col("doc").alias("b"), F.col("members").alias("mb")).join(pairs.select("a", "b", "ca", "cb").hint("merge"), "b")
    of_a = made.select(F.col("doc").alias("a"), F.col("members").alias("ma"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True)]
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return of_a.join(of_b.hint("merge"), "a").select("a", "b", "ca", "cb", "ma", "mb").mapInArrow(compare, "a long, b long, ca long, cb long")


def _relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity, ca, cb) with the components that ``labels`` gives their components; those inside one are dropped."""
    left, right = (labels.select(F.col("node").alias(f"c{x}"), F.col("component").alias(f"n{x}")) for x in "ab")
    j = pairs.join(left, "ca", "left").join(right, "cb", "left")
    return j.select("a", "b", "similarity", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each component the best pair to another one: fewer pairs than components, as equal similarities are told apart by their ends."""
    order = F.struct("similarity", "a", "b")
    best = (pairs.groupBy(c).agg(F.max(F.struct(order.alias("order"), F.struct("a", "b", "ca", "cb").alias("p"))).alias("best")).select(F.col(c).alias("c"), "best") for c in ("ca", "cb"))
    return next(best).union(next(best)).groupBy("c").agg(F.max("best").alias("best")).select("best.p.*").distinct()


def _joined(links: DataFrame) -> DataFrame:
    """One edge (a, b) between components for all links between them."""
    return links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def spanning_links(likely: DataFrame, made: DataFrame) -> DataFrame:
    """Edges (a, b) that join whatever verified pairs among ``likely`` (a, b, similarity) join.

    First each document has its best pair to an earlier one verified, then each component that this leaves its best
    pair to another, then all pairs that still lie across components. Pairs inside a component are never verified,
    and links between the same two components count once.
    """
    first = likely.groupBy("b").agg(F.max_by("a", F.struct("similarity", "a")).alias("a")).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    tried = materialize(first)
    links = materialize(_verified(tried, made))
    rest = likely.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "similarity", F.col("a").alias("ca"), F.col("b").alias("cb"))
    edges = materialize(_joined(links))
    pool = materialize(_relabelled(rest, connected_components(edges)))
    if pool.limit(1).count():
        tried = materialize(_best(pool))
        more = materialize(_joined(_verified(tried, made)))
        pool = _relabelled(pool.join(tried.select("a", "b"), ["a", "b"], "left_anti"), connected_components(more))
        last = materialize(_joined(_verified(materialize(pool), made)))
        edges = edges.union(more).union(last)
    return edges


def _pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) from buckets: all of small buckets; in larger ones each member with the leader that the band prefers."""
    prefers = F.xxhash64("doc", "band")
    counts = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min_by("doc", F.struct(prefers, "doc")).alias("leader")).where("members > 1")
    shared = materialize(bands.join(counts, "band"))
    small = shared.where(F.col("members") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("doc")).alias("d"))
    all_of_small = small.select(F.explode(F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 2, F.lit(SMALL)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    led = shared.where((F.col("members") > SMALL) & (F.col("doc") != F.col("leader"))).select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b"))
    return materialize(all_of_small.union(led).where("a <> b").distinct()), shared


def _left_over(large: DataFrame, labels: DataFrame, reps: DataFrame, made: DataFrame) -> DataFrame:
    """Edges (a, b) between components in large buckets (band, doc) that hold several: members outside the bucket's main
    component, in blocks, against all, in parts.

    Blocks and parts hold SEARCH_BYTES of sets and registers, one document at least. A task estimates its pairs,
    verifies the likely ones on full sets and gives an edge only where a link joins two components that its own links
    have not joined yet, so it gives fewer edges than it has members. A pair is compared in the first band that both share
    only; in a small bucket it has been compared before.
    """
    sized = large.join(reps.select("doc", (8 * F.col("n") + 2 * REGISTERS).alias("bytes")), "doc")
    known = materialize(sized.join(labels, sized["doc"] == labels["node"], "left").select("band", "doc", "bytes", F.coalesce("component", "doc").alias("component")))
    sizes = known.groupBy("band", "component").agg(F.sum("bytes").alias("k"))
    mixed = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("components"), F.sum("k").alias("g"), F.max(F.struct("k", "component")).alias("top")).where("components > 1")
    blocks, parts = F.ceil((F.col("g") - F.col("top.k")) / SEARCH_BYTES), F.ceil(F.col("g") / SEARCH_BYTES)
    mixed = materialize(mixed.select("band", F.col("top.component").alias("main"), blocks.cast("int").alias("blocks"), parts.cast("int").alias("parts")))
    members = known.join(mixed, "band").join(reps.select("doc", "n", "regs").join(made, "doc"), "doc")
    block, part = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int")
    fields = ["doc", "component", "n", "regs", "members"]
    outside = materialize(members.where("component <> main").select("band", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *fields))
    every = members.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), *fields)

    def compare(key: tuple, queries: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if len(queries) and len(others):
            rq, ro = (np.frombuffer(b"".join(x["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (queries, others))
            cq, co = queries["component"].to_numpy(), others["component"].to_numpy()
            nq, no = queries["n"].to_numpy().astype(float), others["n"].to_numpy().astype(float)
            mq, mo = queries["members"], others["members"]
            band = int(np.flatnonzero(band_keys(rq[0]) == key[0].as_py())[0])
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            left, right = [], []
            for k in range(len(rq)):
                same = ro == rq[k]
                # registers agree at least as often as the similarity says; equal bytes are counted eight at a time
                often = np.bitwise_count(same.view(np.uint64)).sum(1) >= (MIN_ESTIMATE - 0.08) * REGISTERS
                fit = np.flatnonzero(often & (co != cq[k]) & (100 * np.minimum(no, nq[k]) >= MIN_PCT * np.maximum(no, nq[k])))
                fit = fit[same[fit].reshape(-1, BANDS, BAND).all(2).argmax(1) == band]
                left.append(np.full(len(fit), k))
                right.append(fit)
            i, j = np.concatenate(left), np.concatenate(right)
            likely = np.concatenate([np.zeros(0), *(estimate(rq[i[x : x + 20_000]], ro[j[x : x + 20_000]], nq[i[x : x + 20_000]], no[j[x : x + 20_000]]) for x in range(0, len(i), 20_000))])
            order = np.argsort(-likely, kind="stable")
            for x in order[: int((likely >= MIN_ESTIMATE).sum())]:
                q, o = i[x], j[x]
                a, b = find(int(cq[q])), find(int(co[o]))
                if a != b and linked(np.frombuffer(mq[int(q)].as_py(), np.uint64), np.frombuffer(mo[int(o)].as_py(), np.uint64)):
                    parent[max(a, b)] = min(a, b)
                    out.append((cq[q], co[o]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    key = ["band", "block", "part"]
    return materialize(outside.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(compare, "a long, b long"))


def representatives(sketched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reps, copies, joints): one row (doc, n, regs) a distinct set, with the least document that has it; (doc, rep) of
    every document that has a set; and links (a, b) between representatives of a key that has several sets."""
    sets = sketched.where(F.col("same").isNotNull() & F.col("doc").isNotNull())
    first = materialize(sets.groupBy("same").agg(F.min("doc").alias("rep")))
    joined = sets.join(first, "same")
    copies = materialize(joined.select("doc", "rep").distinct())
    reps = materialize(joined.where("doc = rep").select("doc", "n", "regs", "same").dropDuplicates(["doc", "same"]).drop("same"))
    several = copies.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most")
    joints = materialize(copies.join(several, "doc").where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    return reps, copies, joints


def likely_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of the pairs to verify, and the members (band, doc) of large buckets."""
    pairs, shared = _pairs(_bands(reps))
    likely = materialize(_estimated(pairs, reps).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    return likely, shared.where(F.col("members") > SMALL).select("band", "doc").distinct()


def group_labels(reps: DataFrame, joints: DataFrame, docs: DataFrame, key_col: str, text_col: str, size: int) -> DataFrame:
    """(node, component) of the representatives that are linked with others."""
    likely, large = likely_pairs(reps)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc")).union(large.select("doc")).distinct()
    made = _sets(wanted, docs, key_col, text_col, size)
    labels = connected_components(spanning_links(likely, made).union(joints))
    more = _left_over(large, labels, reps, made)
    if not more.limit(1).count():
        return labels
    again = connected_components(more).toDF("was", "now")
    alone = again.select(F.col("was").alias("node"), F.col("was").alias("component")).join(labels.select("node"), "node", "left_anti")
    known = labels.union(alone)
    return materialize(known.join(again, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")))


def near_duplicates(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of ``size`` words, of a
    shorter text its whole sequence, of an empty or null text nothing (such a text is linked with nothing). Two
    documents are linked when 100 * intersection >= MIN_PCT * union of their sets (64-bit hashes of the shingles);
    component_id is the smallest key reachable, itself included, and kept marks it. Rows with equal keys count as
    one document each with their component; a null key is a document of its own (component null, kept).
    """
    sketched = materialize(sketch(docs, key_col, text_col, size))
    reps, copies, joints = representatives(sketched)
    final = group_labels(reps, joints, docs, key_col, text_col, size)
    # a copy has the component of its representative; documents that are alone keep their own key
    of_copy = copies.groupBy("doc").agg(F.min("rep").alias("rep"))
    found = of_copy.join(final, of_copy["rep"] == final["node"], "left").select(F.col("doc").alias("node"), F.coalesce("component", "rep").alias("component")).where("component <> node")
    out = sketched.join(found, sketched["doc"] == found["node"], "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(key_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The documents that are the first of their group of near duplicates, with their columns."""
    gone = near_duplicates(docs, key_col, text_col, size).where(~F.col("kept")).select(F.col(key_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(key_col) == F.col("_gone"), "left_anti")
