"""Archives, logs of arrays, LaTeX, streams, similarities and step statistics by hand or brute force."""

import gzip
import io
import tarfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import latex
from siftwell.operators import dynamics, projection, routing, runs, similar
from siftwell.sources import archives, array_log, corpora
from siftwell.streaming import ledger, packing


def tar_bytes(members, **options):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", **options) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def read(spark, folder, **options):
    return sorted(((r.file, r.key, {k: bytes(v) for k, v in (r.parts or {}).items()}, r.error) for r in archives.read_samples(spark, str(folder), **options).collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [512, 1536, 5000, 1 << 20])
@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_samples_whatever_the_ranges(spark, tmp_path, range_bytes, kind):
    inner = tar_bytes([("x/7.txt", b"?" * 700)])  # an archive within has headers of its own
    long = "d/" + "n" * 150
    members = [("a/1.jpg", b"\xff" * 1300), ("a/1.json", b"{}"), ("a/2.tar", inner), ("a/2.txt", b""), (f"{long}.txt", b"long"), (f"{long}.seg.PNG", b"p"), ("a/1.jpg", b"again")]
    (tmp_path / "one.tar").write_bytes(tar_bytes(members, format=kind))
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "none.tar").write_bytes(tar_bytes([]))
    (tmp_path / "other.txt").write_bytes(b"x")
    want = [("one.tar", "a/1", {"jpg": b"again"}, None), ("one.tar", "a/1", {"jpg": b"\xff" * 1300, "json": b"{}"}, None), ("one.tar", "a/2", {"tar": inner, "txt": b""}, None), ("one.tar", long, {"txt": b"long", "seg.png": b"p"}, None)]
    assert read(spark, tmp_path, range_bytes=range_bytes) == sorted(want, key=repr)


def test_cut_shards_give_a_fault(spark, tmp_path):
    whole = tar_bytes([("1.txt", b"a" * 600), ("2.txt", b"b" * 600)])
    (tmp_path / "cut.tar").write_bytes(whole[: 512 + 1024 + 512 + 100])
    (tmp_path / "junk.tar").write_bytes(b"junk" * 500)
    found = read(spark, tmp_path)
    assert [(f, k, p) for f, k, p, e in found if e is None] == [("cut.tar", "1", {"txt": b"a" * 600})]
    assert sorted(f for f, _, _, e in found if e is not None) == ["cut.tar", "junk.tar"]


@pytest.mark.parametrize("index", [True, False])
def test_written_shards(spark, tmp_path, monkeypatch, index):
    monkeypatch.setattr(archives, "INDEX_BYTES", 2048)
    rows = [(f"k/{k:03d}", {"bin": bytes([k]) * (k * 37 % 900), "txt": b"t"}) for k in range(60)] + [(None, {"x": b""}), ("none", None)]
    df = spark.createDataFrame(rows, "key string, parts map<string,binary>").repartition(3)
    manifest = archives.write_samples(df, f"{tmp_path}/out", shard_bytes=9000, index=index).collect()
    assert len(manifest) > 3
    assert sum(m.samples for m in manifest) == 60
    found = read(spark, tmp_path / "out", range_bytes=3000)
    assert {f for f, _, _, _ in found} == {m.file_name for m in manifest}
    assert sorted((k, p) for _, k, p, _ in found if p) == sorted((k, p) for k, p in rows if k and p)


def test_captions(spark):
    rows = [('{"caption": ["a", "b"]}', "t"), ('{"caption": "one"}', "t"), ('{"caption": []}', "t"), ('{"id": 1}', "t"), (None, "t"), ("{broken", "t"), ('{"caption": "[x"}', "t")]
    df = spark.createDataFrame(rows, "json string, text string")
    assert [r[0] for r in df.select(archives.caption(F.col("json"), F.col("text"))).collect()] == ["a", "one", "t", "t", "t", "t", "[x"]


def test_nested_archives():
    inner = gzip.compress(tar_bytes([("a.tex", b"A"), ("b/c.tex.gz", gzip.compress(b"C"))]))
    assert list(archives.nested("x.gz", inner)) == [("x/a.tex", b"A"), ("x/b/c.tex", b"C")]
    assert list(archives.nested("x.gz", inner[:-12])) == [("x.gz", None)]
    deep = b"x"
    for _ in range(7):
        deep = gzip.compress(deep)
    assert list(archives.nested("d", deep)) == [("d", None)]


def test_array_logs(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = {9: rng.normal(size=(5, 4)).astype("<f4"), 10: rng.normal(size=(700, 3)), 2: np.arange(6), 100: np.zeros((0, 4))}
    for step, x in data.items():
        np.save(tmp_path / f"iter_{step}.npy", x)
    np.save(tmp_path / "iter_11.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "other_1.npy", np.ones(3))
    (tmp_path / "iter_12.npy").write_bytes(b"junk")
    whole = (tmp_path / "iter_10.npy").read_bytes()
    (tmp_path / "iter_13.npy").write_bytes(whole[:-1])
    log = array_log.read_log(spark, str(tmp_path), range_bytes=1000)
    rows = log.collect()
    for step, x in data.items():
        got = sorted((r.row, list(r["values"])) for r in rows if r.step == step)
        assert got == [(k, [float(v) for v in np.atleast_1d(row)]) for k, row in enumerate(x)]
    assert sorted(r.step for r in rows if r.fault) == [11, 12, 13]
    assert [tuple(r) for r in array_log.step_places(log.filter("fault is null")).orderBy("place").collect()] == [(2, 1, 0), (9, 2, 6), (10, 3, 0)]


def test_small_arrays_share_a_task(spark, tmp_path):
    for step in range(150):
        np.save(tmp_path / f"iter_{step}.npy", np.full((2, 3), step))
    log = array_log.read_log(spark, str(tmp_path))
    assert log.rdd.getNumPartitions() == 3  # 63 files and what opening them counts are 64 MB
    assert sorted((r.step, r.row, list(r["values"])) for r in log.collect()) == [(s, k, [float(s)] * 3) for s in range(150) for k in range(2)]


SOURCE = r"""
\documentclass[12pt]{article}
\newcommand{\pair}[2][left]{#1 and \emph{#2}}
\def\twice#1{#1 #1}
\begin{document}
\title{On \twice{this}}
Text % a comment
goes on, 5\% of it~here \& ``quoted''---with \'{e}, \c{c}, \"o and \ss{}.

\subsection*{Two}\label{s:2} See \cite[p.~3]{x}\footnote{A \textbf{note}.} $a_1 + b$ and \[ c^2 \]
\begin{itemize}
\item one \pair{right}
\item[Key] two \pair[up]{down}
\end{itemize}
\begin{equation} x = \frac{1}{2} \end{equation}
\begin{figure}\includegraphics{a.eps}\caption{gone}\end{figure}
\begin{verbatim}
 \raw  {text
\end{verbatim}
\href{http://a.b}{link} {\bf bold} \unknown{kept}
\end{document}
after
"""
MARKDOWN = """# On this this

Text goes on, 5% of it here & “quoted”—with é, ç, ö and ß.

## Two

 See (A **note**.) $a_1 + b$ and $$c^2$$
- one left and *right*
- **Key** two up and *down*

$$x = \\frac{1}{2}$$

```
 \\raw  {text
```

[link](http://a.b) bold kept"""


def squeezed(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.strip()]


def test_latex_by_hand():
    text, fault = latex.to_markdown(SOURCE)
    assert fault is None
    assert squeezed(text) == squeezed(MARKDOWN)


@pytest.mark.parametrize(("source", "text", "fault"), [("a {b", "a b", "a group isn't closed"), ("a } b", "a", "a group ends that didn't begin"), (r"a \begin{x} b", "a b", "x isn't closed"), (r"a \end{x} b", "a", "x ends that didn't begin"), ("a $b", "a", "a formula isn't closed"), (r"\def\x{\x}\x", "", "macros call each other without end"), ("", "", None), ("{" * 5000, "", "a group isn't closed"), (r"\emph{" * 300, "", "a group isn't closed"), (r"x\newcommand", "x", "a definition is cut off")])
def test_malformed_sources(source, text, fault):
    assert latex.to_markdown(source) == (text, fault)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("\\{}$%&~^_# \nab[]'`-") + ["\\begin{itemize}", "\\end{itemize}", "\\item ", "\\emph{", "\\newcommand{\\q}[1]{#1}", "\\q", "\\verb"]), max_size=40).map("".join))
def test_no_source_breaks_the_reader(source):
    text, fault = latex.to_markdown(source)
    assert isinstance(text, str)
    assert fault is None or isinstance(fault, str)


def test_latex_corpus(spark, tmp_path):
    members = [("2000/1.gz", gzip.compress(b"\\section{One}")), ("2000/2.tar.gz", gzip.compress(tar_bytes([("p.tex", "caf\xe9".encode("latin-1")), ("fig.eps", b"%!PS")]))), ("2000/3.gz", gzip.compress(b"x" * 99)[:-3]), ("2000/4.tex", b"{")]
    (tmp_path / "y.tar").write_bytes(tar_bytes(members))
    found = {r.key: (r.text, r.fault) for r in corpora.read_corpus(spark, "arxiv", str(tmp_path)).collect()}
    assert found == {"2000/1": ("# One", None), "2000/2": ("café", None), "2000/3": (None, "the archive is damaged"), "2000/4": ("", "a group isn't closed")}


def shards(rng, n, shard_rows=40):
    return [(k // shard_rows, k % shard_rows, [int(x) for x in rng.integers(0, 99, rng.integers(0, 9))] if k % 11 else None) for k in range(n)]


def written(spark, rows, schema, folder, files):
    """Rows in files, in no order at all."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_packing_goes_on_after_a_stop(spark, tmp_path):
    rows = shards(np.random.default_rng(5), 100)
    rng = np.random.default_rng(6)
    mixed = [rows[k] for k in rng.permutation(len(rows))]
    source = written(spark, mixed + mixed[:7], "shard bigint, place bigint, ids array<int>", f"{tmp_path}/docs", 9)
    want = []
    for shard in range(3):
        flat = [x for s, _, ids in rows if s == shard for x in ids or []]
        want += [(shard, n, flat[n * 10 : n * 10 + 10]) for n in range(len(flat) // 10)]
    folder = f"{tmp_path}/stream"
    some = packing.pack_stream(spark, source, folder, 10, 40, files=2, triggers=2).collect()
    assert len(some) < len(want)
    with pytest.raises(ValueError, match="was begun as"):
        packing.pack_stream(spark, source, folder, 10, 50, files=2)
    found = packing.pack_stream(spark, source, folder, 10, 40, files=2)
    assert sorted((r.shard, r.n, list(r.ids)) for r in found.collect()) == want


@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("files", [1, 4])
def test_replay_however_it_is_cut(spark, tmp_path, drop_last, files):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for shard in range(2):
        log = [(int(rng.integers(100)) if rng.random() < 0.8 else None, float(rng.normal()) if k % 13 else [None, float("nan")][k % 2], False) for k in range(45)]
        kept = [(-1 if i is None else i, m) for i, m, _ in log if m is not None and m >= 0.1]
        batches = [kept[k : k + 6] for k in range(0, len(kept), 6)]
        want += [(shard, n, slot, *s) for n, b in enumerate(batches) if len(b) == 6 or not drop_last for slot, s in enumerate(b)]
        rows += [(shard, place, *x) for place, x in enumerate([*log, (None, None, True), (5, 9.0, False)])]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    source = written(spark, rows, "shard bigint, place bigint, idx bigint, metric double, last boolean", f"{tmp_path}/log", 5)
    found = packing.replay_stream(spark, source, f"{tmp_path}/s", 6, 0.1, drop_last, files=files)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_samples_are_kept_while_only_early_rows_come(spark, tmp_path):
    schema = "shard bigint, place bigint, idx bigint, metric double, last boolean"
    rows = [(0, place, place, 1.0, False) for place in range(9)] + [(0, 9, None, None, True)]
    for part in (rows[:2], rows[6:], rows[2:6]):  # the second file's rows are all early, while two samples are kept
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    found = packing.replay_stream(spark, f"{tmp_path}/log", f"{tmp_path}/s", 4, 0.5, drop_last=False, files=1)
    assert sorted(tuple(r) for r in found.collect()) == [(0, k // 4, k % 4, k, 1.0) for k in range(9)]


class Cell:
    """A state of one value or of a map, which counts what is put into it."""

    def __init__(self):
        self.value, self.map, self.puts = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key], self.puts = value, self.puts + 1

    def removeKey(self, key):
        del self.map[key]


@pytest.mark.parametrize(("most", "puts"), [(packing.HELD, 0), (50, 1)])
def test_early_rows_of_a_trigger_wait_in_memory(monkeypatch, most, puts):
    monkeypatch.setattr(packing, "HELD", most)
    ids = [np.arange(k, k + 5, dtype=np.int32) for k in range(30)]
    packer = packing.PackWindows(7)
    packer.at, packer.early = Cell(), Cell()
    batches = [pd.DataFrame({"place": range(k, k + 10), "ids": ids[k : k + 10]}) for k in (20, 10, 0)]
    found = pd.concat(packer.handleInputRows((3,), iter(batches), None))
    flat = np.concatenate(ids)
    assert [x.tolist() for x in found.ids] == flat[: 21 * 7].reshape(21, 7).tolist()
    assert (packer.early.puts > 0) == puts and not packer.early.map
    assert packer.at.value == (30, 21, 0, flat[147:].tolist())


def test_triggers_do_not_grow_with_the_files(spark, tmp_path):
    schema = "shard bigint, place bigint, ids array<int>"
    spark.range(100).selectExpr("id div 10 as shard", "id % 10 as place", "array(1, 2) as ids").repartition(100).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/docs")
    assert packing.trigger_files(spark, f"{tmp_path}/docs", schema) == -(-100 // packing.TRIGGERS)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    source = written(spark, [(k,) for k in range(40)], "x long", f"{tmp_path}/in", 4)
    stream = lambda: spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(source)
    folder, killed = f"{tmp_path}/out", []

    def broken(rows, batch):
        if batch == 2 and not killed:
            killed.append(batch)
            rows.limit(1).write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")  # half of it is there
            raise RuntimeError("killed")
        ledger.append_once(rows, batch, folder)
        if batch == 3 and len(killed) == 1:
            killed.append(batch)
            raise RuntimeError("killed after the mark, before the checkpoint")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            stream().writeStream.foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    ledger.run_once(stream(), folder, lambda rows: rows, f"{tmp_path}/state")
    assert killed == [2, 3]
    assert sorted(r.x for r in ledger.committed(spark, folder, "x long").collect()) == list(range(40))
    assert not ledger.append_once(spark.range(3).withColumnRenamed("id", "x"), 1, folder)
    assert ledger.committed(spark, f"{tmp_path}/nothing", "x long").count() == 0


@pytest.mark.parametrize("rows", [7, 2048])
def test_most_similar_by_all_pairs(spark, rows):
    rng = np.random.default_rng(8)
    left = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(40)]  # whole numbers, so many ties
    right = [(k + 20, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(55)]
    frames = [spark.createDataFrame([*x, (None, [1.0] * 4), (999, None)], "id long, v array<double>").repartition(5) for x in (left, right)]
    for apart in (False, True):
        want = []
        for i, v in left:
            order = sorted(((-float(np.dot(v, w)), j) for j, w in right if not apart or j != i))[:6]
            want += [(i, n + 1, j, -d) for n, (d, j) in enumerate(order)]
        found = similar.most_similar(frames[0], frames[1], 6, "id", "v", apart, rows)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("n", [300, 1200])
def test_most_similar_by_slices(spark, n):
    """What a task gets doesn't grow with the tables, and slices give what the whole gives."""
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (n, 4)).astype(float)
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(2)
    met, parts, slices = similar.dealt(frame, frame, "id", "v", 50, 2)
    assert (parts, slices) == (n // 50, n // 100)
    sizes = [r.n for r in met.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert len(sizes) <= parts * slices and max(sizes) < 750
    order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), -(v @ v.T)), axis=1)[:, :3]
    want = [(i, r + 1, int(j), float(v[i] @ v[j])) for i in range(n) for r, j in enumerate(order[i])]
    assert sorted(tuple(r) for r in similar.most_similar(frame, frame, 3, "id", "v", rows=50, blocks=2).collect()) == want


def test_most_similar_shuffles_each_table_twice(spark):
    """Blocks meet in the tasks that take them: what is shuffled doesn't grow with the parts."""
    n = 1200
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.random.default_rng(10).standard_normal((n, 64)))], "id long, v array<double>").repartition(2)
    context, found = spark.sparkContext, similar.most_similar(frame, frame, 1, "id", "v", rows=50, blocks=2)
    context.setJobGroup("similar", "")
    try:
        found.write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {k for job in context.statusTracker().getJobIdsForGroup("similar") for k in context.statusTracker().getJobInfo(job).stageIds}
    written = sum(context._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteBytes() for k in stages)
    assert n * 64 * 8 < written < 8 * n * 64 * 8


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("rows", [64, 8192])
def test_most_similar_of_equal_vectors(spark, kind, rows):
    """Products are the doubles' in order, so equal vectors tie wherever they are; sizes, zeros and NaN don't matter."""
    rng, number = np.random.default_rng(11), np.float32 if kind == "float" else np.float64
    v = rng.standard_normal((40, 61))
    v[1], v[2], v[3] = 0, v[4] * 1e-25, v[5] * 1e15
    v[6:9] = v[9] + 1e-9 * rng.standard_normal((3, 61))  # floats of these have the same products, nearly
    v = np.tile(v.astype(number), (5, 1)).astype(float)
    v[150] = np.nan
    ids = rng.permutation(1000)[: len(v)]
    left = [k for k in range(len(v)) if k != 150]
    want = []
    for i in left:
        dots = (v[i] * v[left]).cumsum(axis=1)[:, -1]
        order = sorted((-d, int(ids[j])) for d, j in zip(dots.tolist(), left, strict=True) if j != i)[:6]
        want += [(int(ids[i]), r + 1, j, -d) for r, (d, j) in enumerate(order)]
    frame = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(ids, v, strict=True)], f"id long, v array<{kind}>").repartition(3)
    found = similar.most_similar(frame, frame, 6, "id", "v", apart=True, rows=rows, blocks=2)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize(("rows", "cols"), [(5, 5), (8, 3000)])
def test_orthonormal_rows_by_numpy(spark, monkeypatch, rows, cols):
    monkeypatch.setattr(projection, "TALL_ROWS", 60)
    monkeypatch.setattr(projection, "FAN", 4)
    q = np.zeros((rows, cols))
    for r in projection.orthonormal(spark, rows, cols, 3).collect():
        q[r.o, r.k] = r.p
    assert np.abs(q @ q.T - np.eye(rows)).max() < 1e-12


def test_step_statistics_of_odd_rows(spark):
    schema = "step long, layer string, neuron long, is_scalar boolean, before array<double>, after array<double>, grad array<double>, fast array<double>, slow array<double>"
    rows = [(0, "w", 0, False, [3.0, 4.0], [3.0, 4.0], [1.0, 0.0], [0.0, 0.0], [1.0, 1.0]), (0, "w", 1, False, [0.0, 0.0], [6.0, 8.0], [0.0, 2.0], [2.0, 0.0], [4.0, 0.0]), (0, "b", None, True, [1.0, 1.0], [2.0, 2.0], [3.0, 3.0], None, None)]
    found = {(r.level, r.layer, r.neuron): r for r in dynamics.step_statistics(spark.createDataFrame(rows, schema)).collect()}
    assert set(found) == {("neuron", "w", 0), ("neuron", "w", 1), ("layer", "w", None), ("layer", "b", None), ("step", None, None)}
    w = found["layer", "w", None]
    assert (w.norm, w.update_norm, w.grad_rms) == (5.0, 10.0, pytest.approx(np.sqrt(5 / 4)))
    assert w.fast_slow_ratio == pytest.approx(np.sqrt(18 / 4))
    assert found["neuron", "w", 0].fast_slow_ratio is None
    assert found["neuron", "w", 1].angular_update == pytest.approx(np.pi / 2)
    b = found["layer", "b", None]
    assert (b.norm, b.update_rms, b.grad_rms, b.fast_rms) == (None, 1.0, 3.0, None)
    with pytest.raises(ValueError, match="no reducer"):
        dynamics.shortened(spark.range(1), [], "id", "id", "id", 2, "median")


def test_balance_loss_below_the_smallest_number(spark):
    rows = [(t, e, z) for t, pair in enumerate([(0.0, -800.0), (0.0, -800.0), (-800.0, 0.0)]) for e, z in enumerate(pair)]
    logits = spark.createDataFrame(rows, "tok long, expert long, z double")
    for log_space in (False, True):
        assert routing.balance_loss(logits, 1, log_space).first().loss == pytest.approx(5 / 9)
    far = spark.createDataFrame([(t, e, z) for t in range(3) for e, z in enumerate((0.0, -900.0))], "tok long, expert long, z double")
    assert routing.log_probability(far).filter("expert = 1").first().lp == -900.0


def test_names_of_experiments(spark):
    args = {"model": "llama", "opt": "lion", "batch_size": "8", "acc_steps": "2", "lr": "0.1", "wd": None, "same": "1", "extra": "?"}
    df = spark.createDataFrame([(args,), ({**args, "weight_average": "True", "run_prefix": "p"},), ({**args, "experiment_name": "mine"},)], "a map<string,string>")
    name = runs.experiment_name(F.col("a"), {"lr": "0.2", "wd": "0.3", "same": "1"}, ["model", "dataset", "opt"])
    first, second, third = (r[0] for r in df.select(name).collect())
    assert first.startswith("8x2_model-llama_opt-lion__")
    assert set(first.split("__")[1].split("_")) == {"lr-0.1", "wd-None"}
    assert second.startswith("p_8x2_model-llama_WA_opt-lion__")
    assert third == "mine"
    assert [r[0] for r in df.limit(1).select(runs.experiment_name(F.col("a"), {}, ["opt"])).collect()] == ["8x2_opt-lion"]
