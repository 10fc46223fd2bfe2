"""Documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

A set's shingles are put in one order for all sets, rare ones first. Two similar sets share one
of their first shingles (the prefix), so prefixes are joined by shingle. What the order, the
sizes and the places of a shared shingle say about the most that two sets can have in common
leaves few pairs: the length, positional and suffix filters. Each pair left is verified once, by
its sets. Pairs that are already of one component are not tried, and a group of a shingle that
many sets have is first linked through some of its members, so that large groups of copies are
never paired in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, join_to_one, materialize, small_batches
from siftwell.llm.near_dups import BACK, BYTES, HASHED_TOGETHER, PLACES, POWERS, components, in_portions, mixed, runs

#: Words in a shingle, and least similarity in hundredths.
WORDS, PERCENT = 3, 90
#: Document frequencies are counted in hashed buckets, a table of fixed size in chunks; partial sums are salted.
BUCKET_BITS, CHUNKS, SALTS = 24, 32, 32
#: Shingles that a task counts together.
TOGETHER_COUNTED = 1 << 22
#: Classes of shingles, 64 for each long, by whose parities the suffix filter bounds what two sets differ in.
CLASSES = 512
PARITIES = [f"p{k}" for k in range(CLASSES // 64)]
#: Sets from which on a group's rows get the parities before pairs are made of them: smaller groups make few pairs.
FEW = 4
#: Rows of a shingle's group, and pairs of one set, that one task joins.
TOGETHER = 10_000
#: Times that groups are linked through some members, and of how many shingles one counts then.
STARS, ONE_OF = 3, 4
#: Candidate pairs for each row of the groups, beyond which groups are linked through some members first, and through how
#: many each time: few while all members meet them, more when only those do that the first have left.
PAIRS_A_ROW, CENTRES = 2, (2, 8, 32)
#: Keys of texts that all tasks get at most; more are joined by a shuffle.
MOST_SENT = 1 << 20

#: Word ends, and bytes with A-Z in lower case: fixed values.
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of several texts, and how many there are of each."""
    coded = [t.encode() for t in texts]
    data = LOWER[np.frombuffer(b" ".join([*coded, b""]), np.uint8)]
    edge = np.flatnonzero(np.diff(IS_SPACE[data], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        last = int(np.searchsorted(ends, base + HASHED_TOGETHER, "right"))
        if last == at:  # a longer word
            out[at] = xxhash.xxh3_64_intdigest(data[base : ends[at]].tobytes())
            at += 1
            continue
        first, values = starts[at:last] - base, BYTES[data[base : ends[last - 1]]]
        values *= PLACES[: len(values)]
        out[at:last] = np.add.reduceat(values, np.stack([first, ends[at:last] - base], 1).ravel()[:-1])[::2] * BACK[first]
        at = last
    return mixed(out), np.diff(np.searchsorted(starts, np.cumsum([0, *[len(c) + 1 for c in coded]])))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For several texts, one after another: distinct hashes, in order, of the runs of three words (of all
    words, if fewer), and how many there are of each text."""
    h, n = hashed_words(texts)
    at = n.cumsum() - n
    whole = h * POWERS[0]
    for j in range(1, WORDS):
        whole[:-j] += h[j:] * POWERS[j]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        whole[at[i]] = (h[at[i] : at[i] + n[i]] * POWERS[: n[i]]).sum()
    sizes = np.minimum(np.maximum(n - WORDS + 1, 1), n)
    z, row = mixed(whole[runs(at, sizes)]), np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((z, row))
    z = z[order]
    new = np.ones(len(z), bool)
    new[1:] = (z[1:] != z[:-1]) | (row[1:] != row[:-1])
    return z[new], np.bincount(row[new], minlength=len(texts))


def buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each bucket are in documents, in 256 levels of some tenth more each.

    Tasks send the buckets that they have met and their counts, which are summed in two rounds; the driver gets a
    byte for each bucket. A bucket is as frequent as all its shingles together, so at any size the frequent ones
    stand out from the others' noise. Any order that is one for all sets gives the same links.
    """
    size = (1 << BUCKET_BITS) // CHUNKS

    def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "salt", "counts"])

    def written(places: np.ndarray, counts: np.ndarray) -> bytes:
        """Places in order, as steps, and counts."""
        steps = np.diff(places, prepend=0).astype("<u4")
        return zlib.compress(np.concatenate([steps, np.minimum(counts, (1 << 32) - 1).astype("<u4")]).tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, n = TaskContext.get().partitionId() % SALTS, [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(found, np.arange(CHUNKS + 1) * size)
            return packed([(c, salt, written(found[a:b] - c * size, times[a:b])) for c, (a, b) in enumerate(pairwise(cuts.tolist())) if b > a])

        for batch in batches:
            for some in in_portions(batch.column(0).to_pylist()):
                held.append(buckets(shingle_sets(some)[0]).astype(np.int32))
                n += len(held[-1])
                if n >= TOGETHER_COUNTED:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    def add(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                steps, counts = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
                table = sums.setdefault(c, np.zeros(size, np.int64))
                table[steps.cumsum(dtype=np.int64)] += counts
        for c, table in sums.items():
            if last:
                yield packed([(c, 0, np.minimum(np.log1p(table) * 10, 255).astype(np.uint8).tobytes())])
            else:
                places = np.flatnonzero(table)
                yield packed([(c, 0, written(places, table[places]))])

    schema = "chunk int, salt int, counts binary"
    partial = texts.select("text").mapInArrow(count, schema).repartition("chunk", "salt").mapInArrow(add, schema)
    out = np.zeros((CHUNKS, size), np.uint8)
    for r in partial.repartition("chunk").mapInArrow(lambda b: add(b, True), schema).collect():
        out[r.chunk] = np.frombuffer(bytes(r.counts), np.uint8)
    return out.ravel()


def signed(texts: DataFrame, levels: np.ndarray, percent: int, kind: str) -> DataFrame:
    """doc_id, key (of the text), node (digest of the set; null if it is empty), size, prefix (its first shingles), parity (a bit for each class: if it has an odd number of its shingles)."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes, parities = [], [], [], []
            for some in in_portions(batch.column(2).to_pylist()):
                keys, n = shingle_sets(some)
                row, level = np.repeat(np.arange(len(some)), n), shared.value[buckets(keys)]
                # within a text the hashes are in order already
                rare = keys[np.argsort(row * 256 + level, kind="stable")].view(np.int64)
                split = np.bincount(row * CLASSES + (keys & np.uint64(CLASSES - 1)).astype(np.int64), minlength=len(some) * CLASSES)
                parities.append(np.packbits((split & 1).astype(np.uint8)).view(np.int64).reshape(-1, len(PARITIES)))
                for i, (at, k) in enumerate(zip((n.cumsum() - n).tolist(), n.tolist(), strict=True)):
                    nodes.append(xxhash.xxh3_128_digest(keys[at : at + k].tobytes()) if k else None)
                    sizes.append(k)
                    end = k + 1 - (percent * k + 99) // 100 if k else 0
                    prefixes.append(rare[at : at + end])
            columns = [pa.array(c, t) for c, t in ((nodes, pa.binary()), (sizes, pa.int64()), (prefixes, pa.list_(pa.int64())))]
            bits = np.concatenate([np.zeros((0, len(PARITIES)), np.int64), *parities])
            parity = pa.StructArray.from_arrays([pa.array(bits[:, k]) for k in range(len(PARITIES))], PARITIES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, parity], names=["doc_id", "key", "node", "size", "prefix", "parity"])

    bits = ", ".join(f"{p}: long" for p in PARITIES)
    return texts.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key binary, node binary, size long, prefix array<long>, parity struct<{bits}>")


def least_common(size: Column, other: Column, percent: int) -> Column:
    """The least size of the intersection of two similar sets."""
    return F.ceil((size + other) * percent / (100 + percent) - 1e-9)


def can_be_similar(x: str, y: str, percent: int, first: bool) -> Column:
    """Length and positional filter of rows ``x`` and ``y`` of a shingle's group; y isn't the larger set.

    With ``first`` the shared shingle counts as the first that the two share: a similar pair passes at that one.
    Without, no more is said than that they share it.
    """
    sx, sy, px, py = (F.col(f"{a}.{c}") for c in ("size", "pos") for a in (x, y))
    rest = F.least(sx - px, sy - py)
    common = rest if first else rest + F.least(px, py)
    return (sy <= sx) & (sy * 100 >= sx * percent) & (common >= least_common(sx, sy, percent))


def differ_little(x: str, y: str, size: Column, other: Column, percent: int) -> Column:
    """Suffix filter of two sets' parities: each shingle that one set alone has turns one bit, so two sets differ in as many shingles as their bits do, or in more. Null without parities."""
    turned = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    return turned <= size + other - least_common(size, other, percent) * 2


def pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.nid", f"{y}.nid").alias("a"), F.greatest(f"{x}.nid", f"{y}.nid").alias("b")]


def shared_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """Rows (token, nid, size, pos, indexed, n) of the prefix shingles that two sets or more have.

    A row is indexed if the shingle stands so early that a set of no smaller size can be similar.
    """
    rows = nodes.select("nid", "size", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.withColumn("indexed", F.col("pos") <= F.col("size") - least_common(F.col("size"), F.col("size"), percent))
    group, rest = Window.partitionBy("token"), F.col("size") - F.col("pos")
    # rows are dealt by shingle once, and what is said of a group stays beside them; few sets have any one shingle of the prefixes
    said = {"n": F.count(F.lit(1)), "indexed_n": F.count(F.when(F.col("indexed"), 1)), "least": F.min("size"), "most": F.max("size"), "rest": F.min(rest)}
    rows = rows.withColumns({k: x.over(group) for k, x in said.items()}).filter("n > 1 and indexed_n > 0")
    # most groups are two sets that share a shingle by chance: both filters of a pair can be told from the group
    pair_passes = (F.col("least") * 100 >= F.col("most") * percent) & (F.col("rest") >= least_common(F.col("least"), F.col("most"), percent))
    return materialize(rows.filter((F.col("n") > 2) | pair_passes).select("token", "nid", "size", "pos", "indexed", "n"), "shared")


def open_groups(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """``rows`` of the groups with sets of several components, with n and main (the component that most are of); how many rows, and how many pairs."""
    each = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("i"))
    groups = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("i").alias("i"), F.max(F.struct("n", "i", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 and i > 0")
    pairs = (F.col("i") - F.col("m.i")) * F.col("n") + F.col("m.i") * (F.col("n") - F.col("m.n"))
    groups = materialize(groups.select("token", "n", F.col("m.comp").alias("main"), pairs.alias("pairs")).filter("pairs > 0"), "open")
    total = groups.agg(F.sum("n"), F.sum("pairs")).first()
    found = join_to_one(rows, groups.withColumn("m", F.col("n")), "token", "m", ["nid"], TOGETHER)
    return found, total[0] or 0, total[1] or 0


def with_parity(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` and parity, null in groups of fewer than ``FEW`` sets."""
    large = rows.filter(F.col("n") >= FEW).join(nodes.select("nid", "parity"), "nid")
    return rows.filter(F.col("n") < FEW).withColumn("parity", F.lit(None).cast(nodes.schema["parity"].dataType)).unionByName(large)


def met(few: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """Rows (few, many) of one token and different components that pass the suffix filter, where they have parities. A large group's ``many`` are dealt to several tasks, and its ``few`` go to each."""
    parts = F.greatest(F.ceil(F.col("n") / TOGETHER).cast("int"), F.lit(1))
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("few")
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("nid"), parts.cast("long")).cast("int")).alias("many")
    same = (F.col("few.token") == F.col("many.token")) & (F.col("few.salt") == F.col("many.salt")) & (F.col("few.comp") != F.col("many.comp"))
    if "parity" in few.columns:
        same &= F.coalesce(differ_little("few.parity", "many.parity", F.col("few.size"), F.col("many.size"), percent), F.lit(True))
    return spread.join(dealt, same)


def star_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of some members of each group and others.

    The least hashes choose the centres, so groups that share members mostly choose the same ones. First some of
    all members meet all; later on, others of the group's main component meet what isn't of it. Sets that are alike
    share many shingles, so one of some shingles is enough here; what isn't linked is left to ``all_pairs``.
    """
    rows = rows.filter(F.pmod(F.xxhash64("token"), F.lit(ONE_OF)) == turn % ONE_OF)
    rest = F.col("comp") != F.col("main")
    own, many = (rows, rows) if turn == 0 else (rows.filter(~rest), rows.filter(rest))
    order = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "nid"))
    # Spark keeps the first rows of a group before it deals them out
    centres = own.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= CENTRES[turn]).drop("k")
    both = met(centres, many, percent)
    return both.filter(can_be_similar("few", "many", percent, False) | can_be_similar("many", "few", percent, False)).select(*pair("few", "many")).distinct()


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets of different components that pass the filters. Of each group only what isn't of its main component meets all others."""
    rest = F.col("comp") != F.col("main")
    first = met(rows.filter(rest & F.col("indexed")), rows, percent).filter(can_be_similar("many", "few", percent, True))
    second = met(rows.filter(rest), rows.filter(~rest & F.col("indexed")), percent).filter(can_be_similar("few", "many", percent, True))
    return first.union(second).select(*pair("few", "many")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int, total: int) -> DataFrame:
    """Those of the ``total`` pairs that pass the suffix filter: by the parities of both sets they needn't differ in too many shingles."""
    for c in "ab":
        own = nodes.join(pairs.groupBy(F.col(c).alias("nid")).agg(F.count(F.lit(1)).alias("n")), "nid").select(F.col("nid").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"), "n")
        pairs = join_to_one(pairs, own, c, "n", ["b" if c == "a" else "a"], TOGETHER, total)
    return pairs.filter(differ_little("parity_a", "parity_b", F.col("size_a"), F.col("size_b"), percent)).select("a", "b")


def sets_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(nid, shingles): the sets of the nodes ``wanted`` (nid), from one text of each."""
    keyed = materialize(wanted.join(nodes, "nid").select("nid", "rep.doc_id", F.col("rep.key").alias("wanted_key"), "copies").withColumnRenamed("doc_id", "rep_id"), "wanted")
    if keyed.count() <= most_sent:
        met = texts.join(F.broadcast(keyed), F.col("key") == F.col("wanted_key"))
    else:
        met = join_to_one(texts, keyed.withColumnRenamed("wanted_key", "key"), "key", "copies", ["doc_id"])
    one = met.filter(F.col("doc_id").eqNullSafe(F.col("rep_id"))).groupBy("nid").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for some in in_portions(batch.column(1).to_pylist()):
                keys, n = shingle_sets(some)
                found += [part.tobytes() for part in np.split(keys, n.cumsum()[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["nid", "shingles"])

    return materialize(one.select("nid", "text").mapInArrow(run, "nid long, shingles binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Those of the ``total`` pairs (a, b) that are similar. The set of an ``a`` is sent once for each task that has pairs of it."""
    counts = [pairs.groupBy(F.col(c).alias("nid")).agg(F.count(F.lit(1)).alias("n")) for c in "ab"]
    firsts = sets.join(counts[0], "nid").select(F.col("nid").alias("a"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / TOGETHER).cast("int"))).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    if total < TOGETHER:
        salt = pairs.select("a", F.lit(0).alias("salt"), "b")
    else:
        salt = join_to_one(pairs, counts[0].select(F.col("nid").alias("a"), "n", F.floor(F.col("n") / TOGETHER).cast("int").alias("top")), "a", "n", ["b"], TOGETHER, total)
        salt = salt.select("a", F.pmod(F.xxhash64("b"), F.col("top") + 1).cast("int").alias("salt"), "b")
    seconds = join_to_one(salt, sets.join(counts[1], "nid").withColumnRenamed("nid", "b"), "b", "n", ["a"], TOGETHER, total).select("a", "salt", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            at = []
            for i, (b, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                other = np.frombuffer(data.as_buffer(), np.uint64)
                if b is None:
                    own = other.copy()
                    continue
                place = np.searchsorted(own, other)
                place[place == len(own)] = 0
                common = int((own[place] == other).sum())
                if 100 * common >= percent * (len(own) + len(other) - common):
                    at.append(i)
            yield batch.select(["a", "b"]).take(pa.array(at, pa.int64()))

    dealt = firsts.unionByName(seconds).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "shingles").mapInArrow(run, "a long, b long")


def similar_links(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of all nodes that a link joins to a lower one."""
    rows = shared_rows(nodes, percent)
    if rows.isEmpty():
        return None
    sets, links, tried, labels, turn = None, None, None, None, 0
    while True:
        named = rows.withColumn("comp", F.col("nid")) if labels is None else rows.join(labels, rows["nid"] == labels["node"], "left").withColumn("comp", F.coalesce("root", "nid")).drop("node", "root")
        found, n, pairs = open_groups(named.drop("n"))
        if not pairs:
            return labels
        found = materialize(with_parity(found, nodes), "rows")
        # large groups are linked through some members first
        star = pairs > PAIRS_A_ROW * n and turn < STARS
        new = star_pairs(found, percent, turn) if star else all_pairs(found, percent)
        new = materialize(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "pairs")
        count = new.count()
        likely = materialize(plausible(new, nodes, percent, count), "likely") if count else new
        count = likely.count()
        if count:
            # sets are made of the nodes of likely pairs alone, and once
            wanted = likely.select(F.col("a").alias("nid")).union(likely.select("b")).distinct()
            more = sets_of(texts, nodes, wanted if sets is None else wanted.join(sets, "nid", "left_anti"))
            sets = more if sets is None else sets.union(more)
            good = materialize(verified(likely, sets, percent, count), "similar")
            links = good if links is None else links.union(good)
            if not good.isEmpty():
                labels = materialize(components(links), "labels")
        if not star:
            return labels
        tried, turn = new if tried is None else tried.union(new), turn + 1


def ngram_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set), component_id (the least id that links reach, its own included).

    Words are what stands between ASCII white space, with A-Z in lower case. Two rows are linked if
    their sets' similarity is ``percent`` hundredths or more, so rows of equal sets are. A text of
    one or two words has one shingle of these. A null text, or one without words, has an empty set,
    is linked with nothing and keeps its own id, null too. Rows and ids may repeat, each row is returned;
    null ids count only where a component has no other. No rows: no rows. Texts of any length are
    taken whole, other columns are not read, so their names can't clash.

    Shingles are compared by 64-bit hashes.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    small_batches(spark)
    texts = id_and_text(docs, id_col, text_col).withColumn("key", F.unhex(F.md5(F.encode("text", "utf-8"))))
    all_rows = materialize(signed(texts, frequency_levels(texts), percent, kind), "signed")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("rep")
    grouped = all_rows.filter("size > 0").groupBy("node").agg(rep, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("size", "prefix", "parity")])
    # numbered before it is written, so the numbers stay
    nodes = materialize(grouped.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    labels = similar_links(texts, nodes, percent)
    named = nodes.select("node", "copies", "nid", F.col("rep.doc_id").alias("rep"))
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "linked"), F.col("nid") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "nid")).drop("linked")
        classes = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("texts"))
        named = join_to_one(named, classes, "root", "texts", ["nid"])
    else:
        named = named.withColumn("component_id", F.col("rep"))
    own = all_rows.select("doc_id", "node", F.col("size").alias("n_shingles"))
    full = join_to_one(own.filter("node is not null"), named.select("node", "copies", "component_id"), "node", "copies", ["doc_id"])
    out = ["doc_id", "n_shingles", "component_id"]
    return full.select(*out).unionByName(own.filter("node is null").withColumn("component_id", F.col("doc_id")).select(*out))
