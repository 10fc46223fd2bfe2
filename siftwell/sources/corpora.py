"""Named corpora and tasks: where they are, which column has the text, how they are split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.tokens import domain_file
from siftwell.sources.archives import latex_corpus


@dataclass(frozen=True)
class Corpus:
    """A corpus's text column, validation share (None: split beforehand) and file format."""

    text: str = "text"
    share: float | None = 0.0005
    format: str = "parquet"


# Names that users give, and the share of documents held back for validation.
CORPORA: dict[str, Corpus] = {
    "c4": Corpus(share=0.0001), "fineweb": Corpus(share=0.0001), "finewebedu": Corpus(share=0.0001), "openwebtext2": Corpus(), "redpajama": Corpus(), "redpajamav2": Corpus(text="raw_content"),
    "slimpajama": Corpus(), "slimpajama_chunk1": Corpus(), "wikitext": Corpus(share=None, format="text"), "shakespeare-char": Corpus(share=None, format="text"), "arxiv": Corpus(share=None, format="latex"),
}
CORPORA |= {name: Corpus(share=None, format="json") for k in range(1, 38) for name in {f"recipe_{k}", f"recipe_{k:02d}"}}

# The columns that a task's text is made of, and what stands between them.
TASKS: dict[str, tuple[tuple[str, ...], str]] = {
    "humaneval": (("prompt", "canonical_solution"), " \n "), "kodcode": (("question", "solution"), "\n"), "gsm8k": (("question", "answer"), "\n"), "mathqa": (("Problem", "answer"), " "), "arc_easy": (("question", "answer"), " "),
    "arc_challenge": (("question", "answer"), " "), "hellaswag": (("ctx", "ending"), " "), "logiqa": (("context", "query", "option"), " "), "piqa": (("goal", "solution"), " "), "sciq": (("support", "question", "correct_answer"), ""), "medqa": (("question", "answer"), " "),
}


# The domains of a corpus that is kept in a file for each, and what a split's files begin with.
DOMAINS = (
    "Pile-CC", "Github", "StackExchange", "HackerNews", "Wikipedia (en)", "ArXiv", "DM Mathematics", "PubMed Abstracts", "PubMed Central", "NIH ExPorter", "EuroParl", "PhilPapers", "USPTO Backgrounds", "FreeLaw", "Gutenberg (PG-19)", "Enron Emails",
)
SPLIT_FILES = {"train": "train", "val": "validation", "test": "test"}


def domain_files(spark: SparkSession, folder: str, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """name, split, path: where each domain's file of each split is. A name that isn't a domain's raises."""
    if unknown := sorted(set(domains) - set(DOMAINS)):
        raise ValueError(f"no domain is named {', '.join(unknown)}; there are {', '.join(DOMAINS)}")
    names = spark.createDataFrame([(d,) for d in domains], "name string")
    splits = F.explode(F.create_map(*[F.lit(x) for kv in SPLIT_FILES.items() for x in kv])).alias("split", "head")
    return names.select("name", splits).select("name", "split", F.concat(F.lit(f"{folder.rstrip('/')}/"), "split", F.lit("/"), "head", F.lit("-"), domain_file(F.col("name")), F.lit(".bin")).alias("path"))


def corpus(name: str) -> Corpus:
    """The corpus of a name in any case; unknown names raise."""
    found = CORPORA.get(name.lower())
    if found is None:
        raise ValueError(f"no corpus is named {name!r}; there are {', '.join(sorted(CORPORA))}")
    return found


def read_corpus(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A corpus's documents with their text in ``text``; other columns are pruned by the reader when unused."""
    kind = corpus(name)
    if kind.format == "text":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    if kind.format == "latex":
        return latex_corpus(spark, path)
    reader = spark.read.json(path, pathGlobFilter="shard_*.jsonl") if kind.format == "json" else spark.read.parquet(path)
    return reader if kind.text == "text" else reader.withColumnRenamed(kind.text, "text")


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two corpora of one split as one; their columns must be the same."""
    return first.unionByName(second, allowMissingColumns=False)


def task_text(df: DataFrame, task: str) -> DataFrame:
    """``df`` with ``text``: the task's columns joined by its separator (nulls as empty)."""
    if task not in TASKS:
        raise ValueError(f"no task is named {task!r}; there are {', '.join(sorted(TASKS))}")
    columns, separator = TASKS[task]
    return df.withColumn("text", F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def image_source(name: Column) -> Column:
    """The source of an image by its file name: the folder that it begins with; coco for twelve digits; other."""
    return F.when(name.contains("/"), F.split_part(name, F.lit("/"), F.lit(1))).when(name.rlike(r"^\d{12}\.jpg$"), "coco").otherwise("other")


def split_name(split: Column) -> Column:
    """The split that a source's own name stands for: train, or val for its test or validation part; others raise."""
    name = F.lower(split)
    held = ("test", "val", "valid", "validation")
    return F.when(name == "train", "train").when(name.isin(*held), "val").when(split.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("no split is named "), split)).cast("string"))


def materialize_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` unless a finished table is there already; read it."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_files(names: DataFrame, column: str = "name", pattern: str = r"iter_(\d+)") -> DataFrame:
    """Files whose name has a number, with it; others are left out."""
    number = F.regexp_extract(column, pattern, 1)
    return names.withColumn("number", F.expr(f"try_cast(nullif(regexp_extract({column}, '{pattern.replace(chr(92), chr(92) * 2)}', 1), '') as bigint)")).filter(number != "")
