"""Queries that write archives and logs of arrays, and read them back."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query
from siftwell.sources import archives, array_log
from siftwell.sources.storage import shared_folder


@query("image_text_shards", """WITH p AS (SELECT page_id, coalesce(html, '') AS html, 'page ' || page_id AS txt, CASE page_id % 3 WHEN 0 THEN '{"caption": ["first ' || page_id || '", "second"]}' WHEN 1 THEN '{"caption": "only ' || page_id || '"}' ELSE '{"id": ' || page_id || '}' END AS json FROM pages)
SELECT page_id, m.part AS part, strlen(m.content)::BIGINT AS n_bytes, md5(m.content) AS digest, CASE page_id % 3 WHEN 0 THEN 'first ' || page_id WHEN 1 THEN 'only ' || page_id ELSE txt END AS caption FROM p, unnest([{'part': 'jpg', 'content': html}, {'part': 'json', 'content': json}, {'part': 'txt', 'content': txt}]) u(m)""")
def image_text_shards(spark, sf_dir):
    """The pages as samples of three members in tar shards; what is read back, a member a row, with the caption of its sample."""
    folder = shared_folder(spark, "shards")
    k, page = F.col("page_id") % 3, F.col("page_id").cast("string")
    json = F.when(k == 0, F.concat(F.lit('{"caption": ["first '), page, F.lit('", "second"]}'))).when(k == 1, F.concat(F.lit('{"caption": "only '), page, F.lit('"}'))).otherwise(F.concat(F.lit('{"id": '), page, F.lit("}")))
    parts = {"jpg": F.coalesce("html", F.lit("")), "json": json, "txt": F.concat(F.lit("page "), page)}
    samples = table(spark, sf_dir, "pages").select(F.format_string("%d/%09d", F.expr("page_id div 1000"), "page_id").alias("key"), F.create_map(*[x for name, text in parts.items() for x in (F.lit(name), F.encode(text, "UTF-8"))]).alias("parts"))
    archives.write_samples(samples, f"{folder}/tar", shard_bytes=4 << 20).write.parquet(f"{folder}/manifest")
    # files of tasks that failed are in no manifest
    back = archives.read_samples(spark, f"{folder}/tar", range_bytes=1 << 20).join(spark.read.parquet(f"{folder}/manifest"), F.col("file") == F.col("file_name"), "left_semi")
    named = back.select(F.regexp_extract("key", r"(\d+)$", 1).cast("bigint").alias("page_id"), "parts", archives.caption(archives.text_part(F.col("parts"), "json"), archives.text_part(F.col("parts"), "txt")).alias("caption"))
    members = named.select("page_id", "caption", F.explode("parts").alias("part", "content"))
    return members.select("page_id", "part", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest"), "caption")


def packed_source(name: str, source: str, kind: int) -> bytes:
    """A LaTeX source as it is archived: compressed, compressed in an archive beside another file, cut off, or plain."""
    if kind == 0:
        return gzip.compress(source.encode(), 1, mtime=0)
    if kind == 1:
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for member, data in ((f"{name}.tex", source.encode()), ("figure.eps", b"%!PS")):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return buffer.getvalue()
    return gzip.compress(source.encode(), 1, mtime=0)[:-9] if kind == 2 else source.encode()


#: What a text's characters are in LaTeX: braces break up what would be read as one sign.
ESCAPES = {"\\": "\x01", "{": "\\{", "}": "\\}", "$": "\\$", "&": "\\&", "#": "\\#", "_": "\\_", "%": "\\%", "^": "\\textasciicircum{}", "~": "\\textasciitilde{}", "-": "-{}", "'": "'{}", "\x01": "\\textbackslash{}"}
# one kind of white space at a time: spaces, paragraphs, lines that begin a list, other lines
PLAIN = r"""trim(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), '`', ''), '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?(?:\n ?)+', chr(2), 'g'), '\n(- |1\. )', chr(1) || '\1', 'g'), ' ?\n ?', ' ', 'g'), chr(1), chr(10)), chr(2), chr(10) || chr(10)), ' ' || chr(10))"""


@query("latex_archives", f"""WITH t AS (SELECT doc_id, doc_id % 16 AS kind, {PLAIN} AS body FROM documents),
m AS (SELECT doc_id, kind, trim('# Document ' || doc_id || chr(10) || chr(10) || body, ' ' || chr(10)) || CASE WHEN kind = 3 THEN chr(10) || chr(10) || '$$x_' || doc_id || '$$' ELSE '' END AS text FROM t)
SELECT doc_id, CASE WHEN kind = 2 THEN NULL ELSE length(text) END AS n_chars, CASE WHEN kind = 2 THEN NULL ELSE md5(text) END AS digest, CASE kind WHEN 2 THEN 'the archive is damaged' WHEN 5 THEN 'itemize isn''t closed' END AS fault FROM m""")
def latex_archives(spark, sf_dir):
    """The documents as LaTeX sources with a macro, in nested archives, some of them damaged; their texts, read back as Markdown."""
    folder = shared_folder(spark, "latex")
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit(""))
    for sign, written in ESCAPES.items():
        body = F.replace(body, F.lit(sign), F.lit(written))
    doc, kind = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(16))
    head = F.concat(F.lit("\\documentclass{article} % by hand\n\\newcommand{\\numbered}[2][Document]{\\section{#1 #2}}\n\\author{N. N.}\\begin{document}\n\\numbered{"), doc, F.lit("}\\label{sec:one}\n"))
    tail = F.when(kind == 3, F.concat(F.lit("\n\\begin{equation}x_"), doc, F.lit("\\end{equation}\\cite{me}"))).when(kind == 5, F.lit("\\begin{itemize}")).otherwise(F.lit(""))
    sources = table(spark, sf_dir, "documents").select("doc_id", kind.cast("int").alias("kind"), F.concat(head, body, tail, F.when(kind == 5, F.lit("")).otherwise(F.lit("\n\\end{document}\nwhat comes after it"))).alias("source"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            parts = [[("gz" if k < 3 else "tex", packed_source(str(i), s, k))] for i, k, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i % 4 + 2000}/{i}" for i, _, _ in rows]), pa.array(parts, pa.map_(pa.string(), pa.binary()))], names=["key", "parts"])

    packed = sources.mapInArrow(pack, "key string, parts map<string,binary>")
    archives.write_samples(packed, f"{folder}/tar", shard_bytes=4 << 20).write.parquet(f"{folder}/manifest")
    texts = archives.latex_corpus(spark, f"{folder}/tar").join(spark.read.parquet(f"{folder}/manifest"), F.col("file") == F.col("file_name"), "left_semi")
    return texts.select(F.regexp_extract("key", r"(\d+)$", 1).cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"), "fault")


@query("array_log", """WITH e AS (SELECT vec_id // 16 * 3 AS step, vec_id, embedding FROM embeddings WHERE vec_id // 16 % 7 <> 3), r AS (SELECT step, vec_id, embedding, row_number() OVER (PARTITION BY step ORDER BY vec_id) - 1 AS row FROM e),
s AS (SELECT step, row_number() OVER (ORDER BY step) AS place, coalesce(step - lag(step) OVER (ORDER BY step) - 1, 0) AS gap FROM (SELECT DISTINCT step FROM e))
SELECT step, place, gap, row, round(list_sum(list_transform(embedding, lambda x, k: x::DOUBLE * k)), 6) AS digest FROM r JOIN s USING (step)""")
def array_log_query(spark, sf_dir):
    """The embeddings as a log of arrays, a file for each step, and back in the order of steps; a file in between isn't of the log."""
    folder = f"{shared_folder(spark, 'arrays')}/log"
    step = F.expr("vec_id div 16")
    rows = table(spark, sf_dir, "embeddings").filter(step % 7 != 3).select((step * 3).alias("step"), F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    array_log.write_log(rows, folder).agg(F.sum("rows")).collect()
    spark.range(1).select(F.lit("x").alias("value")).write.text(f"{folder}/iter_5.txt")
    log = array_log.read_log(spark, folder)
    dot = F.aggregate(F.transform("values", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return log.join(array_log.step_places(log), "step").select("step", "place", "gap", "row", F.round(dot, 6).alias("digest"))
