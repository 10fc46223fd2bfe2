"""Matrices of layers as tables of blocks, and scores of samples by them.

A block table has a row for each block of each layer: layer, r, c (the block's place), n, w (its rows and
columns), data (float64, row by row). Nothing of a layer's size is on the driver or in one task but one block:
states come in as blocks, are combined block by block, and meet the samples' factors in groups of bounded
size that read the blocks one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.scoring import BETA2, EPS, RHO, STEP, dot, sanitized
from siftwell.sources.storage import shared_folder

#: Rows and columns of a block, and bytes of factors that one task holds while it reads a layer's blocks.
SIZE, GROUP_BYTES = 256, 64 << 20
#: Rows of a group that are multiplied at a time.
ROWS = 4096
PLACE = ["layer", "r", "c"]


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def matrix(data, n: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, w)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to shared storage and read again, so that a round isn't made twice."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_columns(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time; blocks stay bytes."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}


def stretches(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, begin, number) of consecutive rows that have the same values of some columns."""
    at = 0
    for values, same in groupby(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
        n = sum(1 for _ in same)
        yield values, at, n
        at += n


def numbers(batch: pa.RecordBatch, column: str, at: int, n: int) -> np.ndarray:
    """Some rows of a column of arrays of one length, as a matrix of its own memory."""
    return np.array(batch.column(column).slice(at, n).flatten(), float).reshape(n, -1)


def stacked(factors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The left and the right matrices of pairs, each as one; the list is emptied."""
    both = tuple(np.concatenate([f[k] for f in factors]) for k in (0, 1))
    factors.clear()
    return both


def named(names: list[tuple[pa.Array, pa.Array]], at, layer_type: pa.DataType, x: np.ndarray) -> pa.RecordBatch:
    """sample_id, step, layer, x of the rows of a layer."""
    ids, steps = (pa.concat_arrays([n[k] for n in names]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([ids, steps, pa.array([at] * len(x), layer_type), pa.array(x)], names=["sample_id", "step", "layer", "x"])


def names_of(batch: pa.RecordBatch, at: int, n: int) -> tuple[pa.Array, pa.Array]:
    """The ids and steps of some rows, copied, so that their batch isn't held."""
    some = pa.array(np.arange(at, at + n))
    return batch.column("sample_id").take(some), batch.column("step").take(some)


def block_rows(layer_kind: str) -> str:
    return f"layer {layer_kind}, r int, c int, n int, w int, data binary"


def made(rows: list[tuple], layer_type: pa.DataType) -> pa.RecordBatch:
    kinds = [layer_type, *[pa.int32()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["layer", "r", "c", "n", "w", "data"])


# vectors and factors


def layer_means(rows: DataFrame, power: int = 1) -> DataFrame:
    """layer, a, b: the means of the factors (to a power) over all samples and tokens. Tasks send a sum for each layer."""
    kind = kind_of(rows, "layer")
    schema = f"layer {kind}, n long, a array<double>, b array<double>"

    def fold(sums: dict, layer, n: int, a: np.ndarray, b: np.ndarray) -> None:
        had = sums.get(layer)
        sums[layer] = (n, a, b) if had is None else (had[0] + n, had[1] + a, had[2] + b)

    def out(sums: dict, layer_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(list(sums), layer_type), pa.array([n for n, _, _ in sums.values()], pa.int64()), *[pa.array([v[k].tolist() for v in sums.values()], pa.list_(pa.float64())) for k in (1, 2)]]
        return pa.RecordBatch.from_arrays(columns, names=["layer", "n", "a", "b"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            layers = np.array(batch.column(0).to_pylist(), object)
            for layer in dict.fromkeys(layers):
                at = pa.array(np.flatnonzero(layers == layer))
                a, b = (np.asarray(batch.column(c).take(at).flatten(), float).reshape(len(at), -1) ** power for c in (1, 2))
                fold(sums, layer, len(at), a.sum(axis=0), b.sum(axis=0))
        if sums:
            yield out(sums, batch.schema.field(0).type)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for layer, n, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fold(sums, layer, n, np.array(a), np.array(b))
        if sums:
            yield out(sums, batch.schema.field(0).type)

    total = rows.select("layer", "a", "b").mapInArrow(partial, schema).repartition("layer").mapInArrow(add, schema)
    return total.select("layer", *[F.transform(c, lambda x: x / F.col("n")).alias(c) for c in ("a", "b")])


def pieces(vector: Column, size: int) -> Column:
    """An array of (k, x): the vector's pieces of ``size`` numbers."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / size).cast("int")), lambda k: F.struct(k.alias("k"), F.slice(vector, k * size + 1, F.lit(size)).alias("x")))


def outer(vectors: DataFrame, size: int = SIZE, left: str = "b", right: str = "a") -> DataFrame:
    """The blocks of left right' of each layer (layer, and two vectors)."""
    rows = vectors.select("layer", F.explode(pieces(F.col(left), size)).alias("y"), right).select("layer", "y", F.explode(pieces(F.col(right), size)).alias("x"))
    rows = rows.select("layer", F.col("y.k").alias("r"), F.col("x.k").alias("c"), F.col("y.x").alias("y"), F.col("x.x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in by_columns(batch):
                m = np.outer(row["y"], row["x"])
                out.append((row["layer"], row["r"], row["c"], *m.shape, m.tobytes()))
            if out:
                yield made(out, batch.schema.field(0).type)

    return rows.mapInArrow(run, block_rows(kind_of(vectors, "layer")))


def from_rows(rows: DataFrame, size: int = SIZE, row: str = "o", values: str = "values") -> DataFrame:
    """The blocks of matrices that are given by their rows (layer, number, array). All rows of a layer are there and of one length."""
    kind = kind_of(rows, "layer")
    cut = rows.select("layer", F.col(row).cast("int").alias("o"), F.explode(pieces(F.col(values), size)).alias("p")).select("layer", F.floor(F.col("o") / size).cast("int").alias("r"), F.col("p.k").alias("c"), "o", F.col("p.x").alias("x"))
    parts = cut.groupBy(*PLACE).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b["layer"], b["r"], b["c"], *np.shape(b["m"]), np.array(b["m"], float).tobytes()) for b in by_columns(batch)]
            if out:
                yield made(out, batch.schema.field(0).type)

    return parts.mapInArrow(run, block_rows(kind))


def entries(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """layer, o, i, x of each number."""
    kind = kind_of(blocks, "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_columns(batch):
                n, w = b["n"], b["w"]
                o, i = np.divmod(np.arange(n * w), w)
                layer = pa.array([b["layer"]] * (n * w), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([layer, pa.array(o + b["r"] * size, pa.int64()), pa.array(i + b["c"] * size, pa.int64()), pa.array(matrix(b["data"], n, w).ravel())], names=["layer", "o", "i", "x"])

    return blocks.select("layer", "r", "c", "n", "w", "data").mapInArrow(run, f"layer {kind}, o long, i long, x double")


# block by block


def aligned(**tables: DataFrame) -> DataFrame:
    """One row for each block that all tables have, with each table's data under its name."""
    (first, table), *others = tables.items()
    out = table.withColumnRenamed("data", first)
    for name, other in others:
        out = out.join(other.select(*PLACE, F.col("data").alias(name)), PLACE)
    return out


def elementwise(table: DataFrame, f: Callable[..., np.ndarray], arrays: list[str], numbers: list[str] = ()) -> DataFrame:
    """Blocks of f(*arrays, *numbers): the data of each block of an aligned table, and columns of one number."""
    kind, numbers = kind_of(table, "layer"), list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in by_columns(batch):
                m = f(*[matrix(b[a], b["n"], b["w"]) for a in arrays], *[b[x] for x in numbers])
                out.append((b["layer"], b["r"], b["c"], b["n"], b["w"], np.ascontiguousarray(m, np.float64).tobytes()))
            if out:
                yield made(out, batch.schema.field(0).type)

    return table.select(*PLACE, "n", "w", *arrays, *numbers).mapInArrow(run, block_rows(kind))


def transposed(blocks: DataFrame) -> DataFrame:
    flipped = elementwise(blocks, lambda m: m.T, ["data"])
    return flipped.select("layer", F.col("c").alias("r"), F.col("r").alias("c"), F.col("w").alias("n"), F.col("n").alias("w"), "data")


def added(blocks: DataFrame) -> DataFrame:
    """One block for each place: the sum of all there. Tasks add before and after they are dealt out."""
    kind = kind_of(blocks, "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, layer_type = None, None, None
        for batch in batches:
            layer_type, out = batch.schema.field(0).type, []
            for b in by_columns(batch):
                here, m = (b["layer"], b["r"], b["c"]), matrix(b["data"], b["n"], b["w"])
                if here != at:
                    out += [(*at, *total.shape, total.tobytes())] if at else []
                    at, total = here, m.copy()
                else:
                    total += m
            if out:
                yield made(out, layer_type)
        if at:
            yield made([(*at, *total.shape, total.tobytes())], layer_type)

    columns = ["layer", "r", "c", "n", "w", "data"]
    return blocks.select(*columns).repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, block_rows(kind))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The blocks of left right of each layer: each pair of blocks is multiplied once, by the place that they share."""
    l = left.select("layer", "r", F.col("c").alias("k"), F.col("n").alias("n"), F.col("w").alias("m"), F.col("data").alias("x"))  # noqa: E741
    r = right.select("layer", F.col("r").alias("k"), "c", F.col("w").alias("w"), F.col("data").alias("y"))
    kind = kind_of(left, "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in by_columns(batch):
                m = matrix(b["x"], b["n"], b["m"]) @ matrix(b["y"], b["m"], b["w"])
                out.append((b["layer"], b["r"], b["c"], b["n"], b["w"], m.tobytes()))
            if out:
                yield made(out, batch.schema.field(0).type)

    met = l.join(r, ["layer", "k"]).select("layer", "r", "c", "n", "w", "m", "x", "y")
    return added(met.mapInArrow(run, block_rows(kind)))


def squares(blocks: DataFrame) -> DataFrame:
    """layer, s: the sum of the squares of each layer's numbers."""
    kind = kind_of(blocks, "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float((matrix(b["data"], b["n"], b["w"]) ** 2).sum()) for b in by_columns(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["layer", "s"])

    return blocks.select("layer", "n", "w", "data").mapInArrow(run, f"layer {kind}, s double").groupBy("layer").agg(F.sum("s").alias("s"))


# preconditioners

#: What an optimizer's state must have: second moments, momentum, the moments of the step before, an average of raw squares, a gradient.
NEEDED = {"adamw": ["v"], "ademamix": ["v"], "adam-mini": ["v"], "adopt": ["before"], "mars": ["raw"], "sophia": ["v"], "lion": ["m"], "sign": ["m"], "cadamw": ["v", "m", "g"]}
FORMULAS: dict[str, Callable[..., np.ndarray]] = {
    "adamw": lambda v: 1 / (np.sqrt(v / (1 - BETA2**STEP)) + EPS), "adopt": lambda v: 1 / np.maximum(np.sqrt(v / (1 - BETA2 ** max(STEP - 1, 1))), EPS), "mars": lambda v: 1 / (np.sqrt(v) + EPS),
    "sophia": lambda v: 1 / np.maximum(RHO * v, 1e-12), "lion": np.sign,
}
FORMULAS |= {"ademamix": FORMULAS["adamw"], "adam-mini": FORMULAS["adamw"], "sign": FORMULAS["lion"]}


def agrees(v: np.ndarray, m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where an update and the gradient have one sign."""
    return m / (np.sqrt(v / (1 - BETA2**STEP)) + EPS) * g > 0


def kernel(kind: str, state: DataFrame) -> DataFrame | None:
    """The blocks of an optimizer's elementwise preconditioner from an aligned state; None where the state lacks what it needs: plain descent."""
    needed = NEEDED.get(kind, [])
    if not needed or not set(needed) <= set(state.columns):
        return None
    if kind != "cadamw":
        return elementwise(state, FORMULAS[kind], needed)
    # the mask is scaled by its share of the whole layer, so that is counted first
    counts = elementwise(state, lambda *x: agrees(*x).astype(float), needed)
    totals = squares(counts).join(counts.groupBy("layer").agg(F.sum(F.col("n").cast("long") * F.col("w")).alias("size")), "layer")
    scale = totals.select("layer", (F.col("size") / (F.col("s") + 1)).alias("scale"))
    return elementwise(state.join(F.broadcast(scale), "layer"), lambda v, m, g, s: agrees(v, m, g) * s * FORMULAS["adamw"](v), needed, ["scale"])


def direction(kind: str, state: DataFrame | None, validation: DataFrame) -> DataFrame:
    """The blocks of C * D: the validation direction, preconditioned where the state allows. Layers without a state aren't in it."""
    found = None if state is None else kernel(kind, state)
    return validation if found is None else elementwise(aligned(scale=found, own=validation), lambda scale, own: scale * own, ["scale", "own"])


def inverse_roots(gram: DataFrame, eps: float = 1e-6, size: int = SIZE) -> DataFrame:
    """The blocks of (gram + eps I) ** -1/2 of each layer, with eigenvalues not under eps. One task has one layer's matrix, as wide as its input."""
    kind = kind_of(gram, "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, layer_type = None, [], None

        def end() -> Iterator[pa.RecordBatch]:
            most = max(c for _, c, _ in held)
            m = np.block([[next(x for r, c, x in held if (r, c) == (i, j)) for j in range(most + 1)] for i in range(most + 1)])
            w, q = np.linalg.eigh((m + m.T) / 2 + eps * np.eye(len(m)))
            root = (q / np.sqrt(np.maximum(w, eps))) @ q.T
            for i in range(most + 1):
                for j in range(most + 1):
                    part = np.ascontiguousarray(root[i * size : (i + 1) * size, j * size : (j + 1) * size])
                    yield made([(at, i, j, *part.shape, part.tobytes())], layer_type)

        for batch in batches:
            layer_type = batch.schema.field(0).type
            for b in by_columns(batch):
                if held and b["layer"] != at:
                    yield from end()
                    held = []
                at = b["layer"]
                held.append((b["r"], b["c"], matrix(b["data"], b["n"], b["w"])))
        if held:
            yield from end()

    return gram.select("layer", "r", "c", "n", "w", "data").repartition("layer").sortWithinPartitions(*PLACE).mapInArrow(run, block_rows(kind))


def muon_direction(momentum: DataFrame, validation: DataFrame, eps: float = 1e-6, size: int = SIZE) -> DataFrame:
    """The blocks of D P with P = (M'M + eps I) ** -1/2 of each layer's momentum M."""
    gram = kept(product(transposed(momentum), momentum), "gram")
    return product(validation, inverse_roots(gram, eps, size))


def muon_products(rows: DataFrame, momentum: DataFrame, vectors: DataFrame, eps: float = 1e-6, size: int = SIZE) -> DataFrame:
    """sample_id, step, score: of each layer the product of two sums over tokens, of a' P a_V and of b' b_V (vectors: layer, a, b)."""
    column = outer(vectors.withColumn("one", F.array(F.lit(1.0))), size, "a", "one")
    inner = product(inverse_roots(kept(product(transposed(momentum), momentum), "gram"), eps, size), column)
    ends = entries(inner, size).groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("u")).join(vectors.select("layer", F.col("b").alias("v")), "layer")
    sums = rows.join(ends, "layer").groupBy("sample_id", "step", "layer").agg(F.sum(dot(F.col("a"), F.col("u"))).alias("x"), F.sum(dot(F.col("b"), F.col("v"))).alias("y"))
    return sums.groupBy("sample_id", "step").agg(sanitized(F.sum(F.col("x") * F.col("y"))).alias("score"))


def reflections(vectors: DataFrame, rank: int, vector: str = "u") -> DataFrame:
    """layer, o, values: the first ``rank`` rows of I - 2 u u' / u'u, an orthogonal matrix of each layer's vector."""
    s = dot(F.col(vector), F.col(vector))
    row = lambda o: F.transform(vector, lambda x, i: F.when(i == o, 1.0).otherwise(0.0) - 2 * x * F.element_at(vector, (o + 1).cast("int")) / s)
    numbered = vectors.select("layer", vector, F.explode(F.sequence(F.lit(0), F.least(F.lit(rank), F.size(vector)) - 1)).alias("o"))
    return numbered.select("layer", "o", row(F.col("o")).alias("values"))


def rotated_kernel(second_moments: DataFrame, t: int) -> DataFrame:
    """The preconditioner of second moments that are in rotated coordinates, after ``t`` steps."""
    return elementwise(second_moments, lambda v: 1 / (np.sqrt(v / (1 - BETA2**t if t > 0 else 1.0)) + EPS), ["data"])


def rotated_direction(kernel: DataFrame, validation: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The blocks of L' (C * (L D R')) R: elementwise in the coordinates of L and R, whose rows are a basis or a part of one.

    Layers that lack a basis or moments keep their direction, as under plain descent. A basis whose columns are
    its vectors is given ``transposed``.
    """
    low = product(product(left, validation), transposed(right))
    scaled = kept(elementwise(aligned(scale=kernel, own=low), lambda scale, own: scale * own, ["scale", "own"]), "rotated")
    back = product(product(transposed(left), scaled), right)
    plain = validation.join(scaled.select("layer").distinct(), "layer", "left_anti")
    return back.unionByName(plain.select(back.columns))


def newton_schulz(blocks: DataFrame, steps: int = 5) -> DataFrame:
    """Nearly orthogonal matrices near the given ones: singular values are driven near 1 by an odd quintic polynomial.

    Every product is of blocks, and every step is written, so a lost executor costs one step at most. The
    smaller side of a matrix is best its rows: X X' is as large as that.
    """
    a, b, c = 3.4445, -4.7750, 2.0315  # fixed values: the polynomial's coefficients
    norms = squares(blocks).select("layer", (F.sqrt("s") + 1e-7).alias("norm"))
    x = kept(elementwise(blocks.join(F.broadcast(norms), "layer"), lambda m, s: m / s, ["data"], ["norm"]), "scaled")
    for _ in range(steps):
        s = kept(product(x, transposed(x)), "gram")
        inner = elementwise(aligned(s=s, ss=product(s, s)), lambda s, ss: b * s + c * ss, ["s", "ss"])
        x = kept(elementwise(aligned(x=x, y=product(inner, x)), lambda m, n: a * m + n, ["x", "y"]), "step")
    return x


# samples


def groups(rows: DataFrame, group_bytes: int) -> DataFrame:
    """layer, parts: how many groups of bounded size a layer's rows go to. One row a layer."""
    width = (F.size("a") + F.size("b")).cast("long") * 8
    return rows.groupBy("layer").agg(F.sum(width).alias("bytes")).select("layer", F.greatest(F.lit(1), F.ceil(F.col("bytes") / group_bytes)).cast("int").alias("parts"))


def scored(rows: DataFrame, directions: DataFrame, layer_bound: float = 1e9, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """sample_id, step, score: sums over tokens of b' D a of the layers that have a direction D (out x in); none at all raises.

    ``rows``: sample_id, step, layer, a, b, a row for each token. They are dealt once, into groups of a layer
    that are held while that layer's blocks pass. Rows of other layers add nothing. The sum of each layer,
    and that of all, is sanitised.
    """
    if directions.isEmpty():
        raise ValueError("no layer has a validation direction")
    kinds = {c: kind_of(rows, c) for c in ("layer", "sample_id", "step")}
    # a row for each layer that both have
    load = kept(groups(rows, group_bytes).join(directions.select("layer").distinct(), "layer"), "groups")
    none = lambda **kind: [F.lit(None).cast(k).alias(c) for c, k in kind.items()]
    held = rows.join(F.broadcast(load), "layer").select("layer", F.pmod(F.xxhash64("sample_id", "step"), F.col("parts").cast("long")).cast("int").alias("part"), *none(r="int", c="int", n="int", w="int", data="binary"), "sample_id", "step", "a", "b")
    sent = directions.join(F.broadcast(load), "layer").select("layer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "r", "c", "n", "w", "data", *none(sample_id=kinds["sample_id"], step=kinds["step"], a="array<double>", b="array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, factors, place, layer_type = None, [], [], [0, 0], None
        a = b = x = None
        for batch in batches:
            layer_type = batch.schema.field("layer").type
            for (layer, part, r), begin, n in stretches(batch, ["layer", "part", "r"]):
                if (layer, part) != at:
                    if names and x is not None:
                        yield named(names, at[0], layer_type, x)
                    at, names, factors, x = (layer, part), [], [], None
                if r is None:
                    names.append(names_of(batch, begin, n))
                    factors.append((numbers(batch, "a", begin, n), numbers(batch, "b", begin, n)))
                elif names:
                    if x is None:
                        a, b = stacked(factors)
                        x, place = np.zeros(len(a)), [0, 0]
                        rows_at, at_row = 0, None
                    for row in by_columns(batch.slice(begin, n).select(["r", "n", "w", "data"])):
                        # blocks come row by row of blocks, so places add up
                        if row["r"] != at_row:
                            rows_at, at_row, place = place[0], row["r"], [place[0] + row["n"], 0]
                        m = matrix(row["data"], row["n"], row["w"])
                        for k in range(0, len(x), ROWS):
                            x[k : k + ROWS] += ((b[k : k + ROWS, rows_at : rows_at + row["n"]] @ m) * a[k : k + ROWS, place[1] : place[1] + row["w"]]).sum(axis=1)
                        place[1] += row["w"]
        if names and x is not None:
            yield named(names, at[0], layer_type, x)

    order = ["layer", "part", F.col("r").asc_nulls_first(), "c"]
    found = held.unionByName(sent).repartition("layer", "part").sortWithinPartitions(*order).mapInArrow(run, f"sample_id {kinds['sample_id']}, step {kinds['step']}, layer {kinds['layer']}, x double")
    per_layer = found.groupBy("sample_id", "step", "layer").agg(sanitized(F.sum("x"), layer_bound).alias("x"))
    return per_layer.groupBy("sample_id", "step").agg(sanitized(F.sum("x")).alias("score"))


def gradient(rows: DataFrame, size: int = SIZE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The blocks of the layers' gradients: the summed outer products of the rows over their number of samples.

    A group of rows is held while its blocks are multiplied and sent one by one; groups are added by place.
    """
    kind = kind_of(rows, "layer")
    load = kept(groups(rows, group_bytes), "groups")
    n = F.broadcast(rows.agg(F.count_distinct("sample_id").alias("samples")))  # one row
    held = rows.join(F.broadcast(load), "layer").select("layer", F.pmod(F.xxhash64("sample_id"), F.col("parts").cast("long")).cast("int").alias("part"), "a", "b")

    def multiplied(at, factors: list, layer_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        a, b = stacked(factors)
        for r in range(0, b.shape[1], size):
            for c in range(0, a.shape[1], size):
                m = b[:, r : r + size].T @ a[:, c : c + size]
                yield made([(at[0], r // size, c // size, *m.shape, m.tobytes())], layer_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, factors, layer_type = None, [], None
        for batch in batches:
            layer_type = batch.schema.field(0).type
            for here, begin, n in stretches(batch, ["layer", "part"]):
                if here != at and factors:
                    yield from multiplied(at, factors, layer_type)
                at = here
                factors.append((numbers(batch, "a", begin, n), numbers(batch, "b", begin, n)))
        if factors:
            yield from multiplied(at, factors, layer_type)

    total = added(held.repartition("layer", "part").sortWithinPartitions("layer", "part").mapInArrow(run, block_rows(kind)))
    return elementwise(total.join(n), lambda m, k: m / k, ["data"], ["samples"])


def gram_dots(rows: DataFrame, val: DataFrame, group_bytes: int = GROUP_BYTES, together: int = 256) -> DataFrame:
    """sample_id, step, score as ``scored`` with ``gradient(val)``, without that gradient: for each pair of tokens the product of both factors' inner products.

    Each layer's validation tokens pass by the groups of its rows, some at a time.
    """
    kinds = {c: kind_of(rows, c) for c in ("layer", "sample_id", "step")}
    load = kept(groups(rows, group_bytes), "groups")
    n = val.agg(F.count_distinct("sample_id")).first()[0]
    if not n:
        raise ValueError("no layer has a validation direction")
    held = rows.join(F.broadcast(load), "layer").select("layer", F.pmod(F.xxhash64("sample_id", "step"), F.col("parts").cast("long")).cast("int").alias("part"), F.lit(False).alias("val"), "sample_id", "step", "a", "b")
    sent = val.join(F.broadcast(load), "layer").select("layer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("val"), F.lit(None).cast(kinds["sample_id"]).alias("sample_id"), F.lit(None).cast(kinds["step"]).alias("step"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, own, x, layer_type = None, [], [], None, None
        for batch in batches:
            layer_type = batch.schema.field("layer").type
            for (layer, part, is_val), begin, k in stretches(batch, ["layer", "part", "val"]):
                if (layer, part) != at:
                    if names:
                        yield named(names, at[0], layer_type, np.zeros(sum(len(i) for i, _ in names)) if x is None else x / n)
                    at, names, own, x = (layer, part), [], [], None
                if not is_val:
                    names.append(names_of(batch, begin, k))
                    own.append((numbers(batch, "a", begin, k), numbers(batch, "b", begin, k)))
                elif names:
                    if x is None:
                        left, right = stacked(own)
                        x = np.zeros(len(left))
                    a, b = numbers(batch, "a", begin, k), numbers(batch, "b", begin, k)
                    for v in range(0, k, together):
                        for r in range(0, len(x), ROWS):
                            x[r : r + ROWS] += ((left[r : r + ROWS] @ a[v : v + together].T) * (right[r : r + ROWS] @ b[v : v + together].T)).sum(axis=1)
        if names:
            yield named(names, at[0], layer_type, np.zeros(sum(len(i) for i, _ in names)) if x is None else x / n)

    ordered = held.unionByName(sent).repartition("layer", "part").sortWithinPartitions("layer", "part", "val")
    found = ordered.mapInArrow(run, f"sample_id {kinds['sample_id']}, step {kinds['step']}, layer {kinds['layer']}, x double")
    return found.groupBy("sample_id", "step").agg(sanitized(F.sum("x")).alias("score"))


def dots(rows: DataFrame, val: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Inner products with the mean validation gradient, layer by layer the cheaper way: by pairs of tokens where twice the square of a sample's tokens is no more than the layer's weights, else by the gradient."""
    tokens = rows.groupBy("layer", "sample_id").agg(F.count(F.lit(1)).alias("t"), F.max(F.size("a").cast("long") * F.size("b")).alias("weights"))
    choice = kept(tokens.groupBy("layer").agg((2 * F.max("t") * F.max("t") <= F.max("weights")).alias("ghost")), "choice")
    parts = []
    for ghost in sorted(r.ghost for r in choice.select("ghost").distinct().collect()):
        own = F.broadcast(choice.filter(F.col("ghost") == ghost).select("layer"))  # a row a layer
        r, v = rows.join(own, "layer", "left_semi"), val.join(own, "layer", "left_semi")
        if not v.isEmpty():
            parts.append(gram_dots(r, v, group_bytes) if ghost else scored(r, kept(gradient(v, group_bytes=group_bytes), "gradient"), group_bytes=group_bytes))
    if not parts:
        raise ValueError("no layer has a validation direction")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("sample_id", "step").agg(sanitized(F.sum("score")).alias("score"))


def conv1d_dots(rows: DataFrame, val: DataFrame, bias: bool = True) -> DataFrame:
    """``dots`` of layers that hold their weights input by output, and with ``bias`` of their bias: the product of both sums of b."""
    weights = dots(rows, val)
    if not bias:
        return weights
    total = lambda df, by: df.select(*by, F.posexplode("b").alias("o", "x")).groupBy(*by, "o").agg(F.sum("x").alias("x"))
    n = F.broadcast(val.agg(F.count_distinct("sample_id").alias("n")))  # one row
    mean = total(val, ["layer"]).join(n).select("layer", "o", (F.col("x") / F.col("n")).alias("v"))
    biases = total(rows, ["sample_id", "step", "layer"]).join(mean, ["layer", "o"]).groupBy("sample_id", "step").agg(F.sum(F.col("x") * F.col("v")).alias("score"))
    return weights.unionByName(biases).groupBy("sample_id", "step").agg(sanitized(F.sum("score")).alias("score"))


def conv_rows(images: DataFrame, channels: int, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """Rows (layer, a, b and the other columns) of a convolution as of a linear layer: one for each place that the kernel stands at.

    ``images``: layer, x (an image, flat), g (the gradient of the output: an array for each output channel). A
    patch is made when its row is, so an image's patches, which overlap, are never there together.
    """
    high, wide = (height + 2 * padding - kernel) // stride + 1, (width + 2 * padding - kernel) // stride + 1
    placed = images.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(high * wide - 1))))
    r, k = F.floor(F.col("t") / wide) * stride - padding, F.col("t") % wide * stride - padding

    def pixel(j: Column) -> Column:
        c, y, x = F.floor(j / kernel**2), r + F.floor(j % kernel**2 / kernel), k + j % kernel
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, F.get("x", (c * height * width + y * width + x).cast("int"))).otherwise(0.0)

    patch = F.transform(F.sequence(F.lit(0), F.lit(channels * kernel**2 - 1)), pixel)
    return placed.withColumn("a", patch).withColumn("b", F.transform("g", lambda own: F.get(own, F.col("t")))).drop("x", "g", "t")
