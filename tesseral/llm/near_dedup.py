"""MinHash near-dedup with min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so half the
permutations do. Bands of the signature, together with the size class of the set (linked sets differ in size by the
asked similarity at most, so they share a class or lie in neighbours), are the buckets in which links are looked for.

Equal sets are one representative first, and of buckets with the same members only one is kept. Then each bucket is searched by
pivots instead of by pairs: its most central member is held against all others, and what it links is one component. The pivot
that a member met most often is its home;
in homes with members of several components, blocks of members are held against each other by products of matrices of
shingles. Homes that meet in a bucket of more than CROWD members which its pivot left open are one home, so that a large group of
near copies, few of them linked, does not become rows of its pairs. Buckets in which members of different components and homes
are left are searched again with more pivots, each
pivot leaving its bucket when it has been held against all, until no bucket is open. So every pair that shares a bucket is
tested or connected already, and tests are exact: both texts' full shingle sets. Pairs that fail are never rows, except
against pivots. Joins on hot buckets are joins of plain tables, which Spark splits; the members of a hot pivot are salted,
and its text meets SALT of them at a time.

Homes of more than HOME members are not held together; their members stay in the search by buckets, which is exact without homes.
Homes that would have more than that together, or more shingles than its blocks, stay apart.

What is lost. With ROWS rows in BANDS bands a pair of similarity 0.85 shares no bucket with probability (1 - 0.85^5)^24 < 1e-6
(of similarity 0.80: 7e-5). Of candidates, those are dropped before the test whose signatures agree in DEVIATIONS standard
deviations less of their places than expected of a linked pair, which a linked pair does with probability under 1e-7 (the tail of
a binomial of 120 places: 5e-8 at 0.85). Tests are on 64-bit hashes of shingles, words are not compared again: sets of 1000 shingles that
share none would have one in common by chance with probability 1e-13.

The work of a bucket of which no members are linked grows with the square of its members, since each pair has to be refused;
most pairs are refused by signatures of 120 bytes, by pivots, never as rows of all pairs.

Defined cases: a text of fewer words than a shingle has its whole sequence as one shingle; one without words (null, empty,
white space) has an empty set and is linked with nothing; rows that repeat a doc_id are one node, with the links of all its texts;
rows without doc_id are linked with nothing and stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_groups, maybe_in, temporary, tidy
from .components import components
from .shingles import ascii_words, mix, shingles

GRAM = 5
BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS // 2
SALT = 512
#: Signature values of a linked pair may fall short of the similarity by this many standard deviations.
DEVIATIONS = 6
MOST_PIVOTS = 256
#: Members of a home that are held against each other, all of them.
HOME = 1 << 15
#: Members of a bucket above which the homes that meet in it are held together.
CROWD = 16
#: Members, and shingles of them, that are held against another such block at once; shingles of a product of matrices.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 4096
#: Bytes of text and number of texts that a task hashes together.
SLICE_BYTES, SLICE = 1 << 19, 256

_rng = np.random.default_rng(7919)
_MULTIPLY = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each set: minimum and maximum under each permutation in turn. No set may be empty."""
    out = np.empty((len(starts) - 1, 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        x = hashes * _MULTIPLY[k]
        x += _ADD[k]
        x ^= x >> np.uint64(31)
        x *= _BAND[k]
        out[:, 2 * k] = np.minimum.reduceat(x, starts[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(x, starts[:-1])
    return out


def buckets(signature: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The bucket ids of each row: its bands under its own size class and the next."""
    values = mix(signature) * _BAND
    bands = mix(values.reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    classes = np.floor(np.log(sizes) / math.log(100 / percent) + 1e-9).astype(np.uint64)
    return np.concatenate([mix(bands ^ ((classes + np.uint64(k)) * _SIZE)[:, None]) for k in (0, 1)], axis=1)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and (size + len(t or "") > SLICE_BYTES or k - lo == SLICE):
            yield lo, k
            lo, size = k, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def sketch(docs: DataFrame, percent: int, gram: int) -> DataFrame:
    """doc_id, text_h, n, set_a, set_b (a digest of the set), buckets, sig (the signature's low bytes) for each row (doc_id, text, text_h)."""
    schema = "doc_id long, text_h long, n long, set_a long, set_b long, buckets array<long>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(1)
            for lo in range(0, b.num_rows, 1024):
                ids, keys, texts = b.column(0).slice(lo, 1024), b.column(2).slice(lo, 1024), every.slice(lo, 1024).to_pylist()
                for p, q in _slices(texts):
                    hashes, starts = shingles([ascii_words(t) for t in texts[p:q]], gram)
                    sets = [np.unique(hashes[x:y]) for x, y in zip(starts[:-1], starts[1:])]
                    sizes = np.array([len(s) for s in sets])
                    some = np.flatnonzero(sizes)
                    n, a, c = len(sets), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                    lists, sig = [None] * n, [None] * n
                    if len(some):
                        flat = np.concatenate([sets[k] for k in some])
                        begin = np.concatenate([[0], np.cumsum(sizes[some])])
                        a[some] = np.add.reduceat(mix(flat), begin[:-1])
                        c[some] = np.bitwise_xor.reduceat(mix(flat ^ _SIZE), begin[:-1])
                        signed = signatures(flat, begin)
                        for k, where, low in zip(some, buckets(signed, sizes[some], percent).view(np.int64), signed.astype(np.uint8)):
                            lists[k], sig[k] = where, low.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(p, q - p), keys.slice(p, q - p), pa.array(sizes, pa.int64()), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                        ["doc_id", "text_h", "n", "set_a", "set_b", "buckets", "sig"],
                    )

    return docs.mapInArrow(tidy(run), schema)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes are as similar as asked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree nearly as often as those of linked sets."""
    j = percent / 100
    least = 2 * PERMUTATIONS * j - DEVIATIONS * math.sqrt(2 * PERMUTATIONS * j * (1 - j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            left, right = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(x.num_rows, -1) for k in (2, 3))
            met = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(met), x.column(1).filter(met)], ["a", "b"])

    first = pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    pivots = cut(pairs.select("a").distinct().join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a"), slim=True)
    return join_groups(first, pivots, ["a"]).select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, gram: int) -> DataFrame:
    """The pairs (a, b) of texts (rep, text; a written table) that are linked. Each a meets SALT members at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for x in batches:
            for lo in range(0, x.num_rows, SLICE):
                part = x.slice(lo, SLICE)
                a, b, text_a, text_b = (part.column(k) for k in range(4))
                ids_a, texts = a.to_pylist(), text_b.to_pylist()
                met = np.zeros(part.num_rows, bool)
                for p, q in _slices(texts):
                    hashes, starts = shingles([ascii_words(t) for t in texts[p:q]], gram)
                    for k in range(p, q):
                        if ids_a[k] != key:
                            key, own = ids_a[k], np.unique(shingles([ascii_words(text_a[k].as_py())], gram)[0])
                        met[k] = linked(own, np.unique(hashes[starts[k - p] : starts[k - p + 1]]), percent)
                met = pa.array(met)
                yield pa.RecordBatch.from_arrays([a.filter(met), b.filter(met)], ["a", "b"])

    sizes = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")), slim=True)
    salts = F.ceil(F.col("size") / SALT)
    salted = join_groups(pairs, sizes.withColumn("salts", salts), ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    mine, others = (maybe_in(texts, F.xxhash64("rep"), ends, F.xxhash64("end")) for ends in (sizes.select(F.col("a").alias("end")), cut(pairs.select(F.col("b").alias("end")).distinct(), slim=True)))
    left = sizes.select("a", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt")).join(mine.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    right = salted.join(others.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    met = right.hint("merge").join(left.hint("merge"), ["a", "salt"])
    return met.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long").distinct()


def block_links(texts: list[str], ids: list[int], labels: list[int], percent: int, gram: int) -> list[tuple[int, int]]:
    """A linked pair of members for each two labels of which members are linked."""
    hashes, starts = [], [0]
    for lo, hi in _slices(texts):
        h, s = shingles([ascii_words(t) for t in texts[lo:hi]], gram)
        hashes += [np.unique(h[x:y]) for x, y in zip(s[:-1], s[1:])]
    sizes = np.array([len(x) for x in hashes])
    _, which, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(texts)), sizes)
    several = often[which] > 1
    number = np.cumsum(often > 1) - 1
    which, member = number[which[several]], member[several]
    order = np.argsort(which, kind="stable")
    which, member = which[order], member[order]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        x, y = np.searchsorted(which, (lo, lo + COLUMNS))
        has = np.zeros((len(texts), COLUMNS), np.float32)
        has[member[x:y], which[x:y] - lo] = 1
        shared += has @ has.T
    label = np.array(labels)
    a, b = np.nonzero((100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (label[:, None] < label[None, :]))
    _, first = np.unique(np.stack([label[a], label[b]]), axis=1, return_index=True)
    return [(ids[a[k]], ids[b[k]]) for k in first.tolist()]


def in_homes(homes: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, gram: int) -> DataFrame:
    """Links (a, b) between differently labelled members (rep, home, label) of a home, all of whose members are held against
    each other. The pairs of its blocks are tasks of their own; links are given, and one of each two labels is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            ids, labels, texts = zip(*held)
            found = block_links(list(texts), list(ids), list(labels), percent, gram) if len(set(labels)) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for x in batches:
            for home, i, j, *member in zip(*(c.to_pylist() for c in x.columns)):
                if (home, i, j) != key:
                    if held:
                        yield from out()
                    key, held = (home, i, j), []
                held.append(member)
        if held:
            yield from out()

    sized = homes.join(sigs.select("rep", "n"), "rep")
    parts = sized.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("home", "parts")
    own = join_groups(homes, cut(parts, slim=True), ["home"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    own = cut(own, slim=True)
    full = own.join(maybe_in(texts, F.xxhash64("rep"), own, F.xxhash64("rep")), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    return full.select(*keys, "rep", "label", "text").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(tidy(run), "a long, b long")


def gathered(rows: DataFrame, homes: DataFrame, sigs: DataFrame) -> DataFrame:
    """The homes of members (rep, home, label), those that meet in crowded open buckets (bucket, rep) joined up to the size of HOME."""
    placed = cut(rows.select("bucket", "rep").join(homes, "rep"), slim=True)
    span = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "home") for f in (F.min, F.max)]
    crowds = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *span).where((F.col("size") > CROWD) & F.expr("min_label <> max_label and min_home <> max_home"))
    meet = cut(join_groups(placed, cut(crowds.select("bucket", "min_home"), slim=True), ["bucket"]).where("home <> min_home").select(F.col("home").alias("a"), F.col("min_home").alias("b")).distinct(), slim=True)
    if meet.isEmpty():
        return homes
    wide = components(meet)
    wide = cut(homes.join(wide, homes["home"] == wide["node"], "left").select("rep", "home", "label", F.coalesce("component", "home").alias("wide")), slim=True)
    sized = wide.join(sigs.select("rep", "n"), "rep").groupBy("wide").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    fits = cut(sized.select("wide", ((F.col("size") <= HOME) & (F.col("n") <= HOME // BLOCK * BLOCK_SHINGLES)).alias("fits")), slim=True)
    return cut(join_groups(wide, fits, ["wide"]).select("rep", F.when(F.col("fits"), F.col("wide")).otherwise(F.col("home")).alias("home"), "label"), slim=True)


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85, gram: int = GRAM) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; of each component the smallest doc_id stays.

    Documents are linked where ``100 * shared shingles >= percent * all shingles`` of the two.
    """
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_h"))
    with temporary(docs.sparkSession):
        sketches = cut(sketch(rows, percent, gram))
        named = named_components(sketches, rows, percent, gram)
        out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
        done = cut(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), keep=True)
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def named_components(sketches: DataFrame, rows: DataFrame, percent: int, gram: int) -> DataFrame:
    """doc_id, component_id (its smallest doc_id) of the documents that are linked with others."""
    valid = sketches.where("n > 0 and doc_id is not null")
    digest = ["set_a", "set_b", "n"]
    # a number for each different set, whichever doc_ids have it
    groups = cut(valid.groupBy(*digest).agg(F.min(F.struct("doc_id", "text_h")).alias("least")).select(F.monotonically_increasing_id().alias("rep"), *digest, "least.*"))
    members = cut(join_groups(valid.select("doc_id", *digest), groups.select("rep", *digest), digest).select("doc_id", "rep").distinct())
    own = groups.select("rep", "doc_id", "text_h")
    # rows that repeat doc_id and text go by the exchange that the join needs
    each_row = ["doc_id", "text_h"]
    reps = cut(valid.select(*each_row, "n", "sig", "buckets").dropDuplicates(each_row).join(own, each_row).drop(*each_row))
    sigs = reps.select("rep", "n", "sig")

    spread = reps.select("rep", F.explode("buckets").alias("bucket"))
    # of buckets with the same members, which two hashes of 64 bits over them tell, one is searched
    each = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"members{k}") for k in range(2)]).where("size > 1")
    sizes = cut(each.groupBy("size", "members0", "members1").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))
    met = join_groups(cut(maybe_in(spread, F.col("bucket"), sizes, F.col("bucket"))), sizes, ["bucket"])
    met = cut(met.distinct())
    open_rows = cut(met.join(met.groupBy("rep").agg(F.sum("size").alias("weight")), "rep").select("bucket", "rep", "weight", F.col("rep").alias("label"), F.col("rep").alias("home")))
    asked_for = cut(own.join(open_rows.select("rep").distinct(), "rep"), slim=True)
    texts = cut(maybe_in(rows, F.xxhash64(*each_row), asked_for, F.xxhash64(*each_row)).dropDuplicates(each_row).join(asked_for, each_row).select("rep", "text"))

    found = search(open_rows, sigs, texts, percent, gram)
    several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("of")).where(F.size("of") > 1)
    links = several.select(F.explode("of").alias("a"), "b").where("a <> b")
    labels = components(links if found is None else links.unionByName(found))
    labelled = cut(members.join(labels, members["rep"] == labels["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("label")).distinct())
    least = cut(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    return join_groups(labelled, least, ["label"]).select("doc_id", "component_id")


def search(open_rows: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, gram: int) -> DataFrame | None:
    """Links (a, b) that connect what is linked among the members of buckets; none if no bucket has two members."""
    pivots, homes = 1, None
    found: DataFrame | None = None
    while True:
        # buckets in which members of different components and homes are left
        span = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "home") for f in (F.min, F.max)]
        still = open_rows.groupBy("bucket").agg(*span, F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "label", "home")).alias("first")).where("min_label <> max_label and min_home <> max_home")
        still = cut(still.select("bucket", "first"), slim=True)
        if still.isEmpty():
            return found
        if pivots == 1:
            chosen = still.select("bucket", F.array("first").alias("best"))
        else:
            place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), "rep"))
            best = open_rows.withColumn("place", place).where(F.col("place") <= pivots).groupBy("bucket").agg(F.collect_list(F.struct("weight", (-F.col("rep")).alias("minus"), "label", "home")).alias("best"))
            chosen = best.join(still.select("bucket"), "bucket", "left_semi")
        tried = cut(join_groups(open_rows, cut(chosen, slim=True), ["bucket"]).withColumn("own", F.exists("best", lambda p: -p["minus"] == F.col("rep"))))
        # once there are homes, members that share one have been held against each other
        asked = lambda p: (p["label"] != F.col("label")) & (~F.col("own") | (-p["minus"] < F.col("rep"))) & (F.lit(homes is None) | (p["home"] != F.col("home")))
        wanted = tried.select("rep", F.transform(F.filter("best", asked), lambda p: -p["minus"]).alias("of")).where(F.size("of") > 0)
        each = wanted.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_set("of"))).alias("of")).select(F.explode("of").alias("a"), F.col("rep").alias("b"))
        new = verify(cut(likely(cut(each, slim=True), sigs, percent), slim=True), texts, percent, gram)
        found = cut(new if found is None else new.unionByName(found), slim=True)
        labels = components(found)
        if homes is None:
            count = tried.select("rep", F.col("best")[0]["minus"].alias("minus")).groupBy("rep", "minus").agg(F.count(F.lit(1)).alias("n"))
            nearest = cut(count.groupBy("rep").agg((-F.max(F.struct("n", "minus"))["minus"]).alias("home")), slim=True)
            homes = cut(nearest.join(labels, nearest["rep"] == labels["node"], "left").select("rep", "home", F.coalesce("component", "rep").alias("label")), slim=True)
            homes = gathered(tried, homes, sigs)
            size = cut(homes.groupBy("home").agg(F.count(F.lit(1)).alias("size")), slim=True)
            homes = cut(join_groups(homes, size, ["home"]).select("rep", F.when(F.col("size") > HOME, F.col("rep")).otherwise(F.col("home")).alias("home"), "label"), slim=True)
            found = cut(found.unionByName(in_homes(homes, sigs, texts, percent, gram)), slim=True)
            labels = components(found)
            tried = tried.drop("home").join(homes.select("rep", "home"), "rep")
        rest = tried.where("not own").select("bucket", "rep", "weight", "home")
        open_rows = cut(rest.join(labels, rest["rep"] == labels["node"], "left").select("bucket", "rep", "weight", "home", F.coalesce("component", "rep").alias("label")), slim=True)
        pivots = min(MOST_PIVOTS, 16 * pivots)
