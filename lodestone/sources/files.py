"""Files as documents: routing by extension, decoding, mail, and report sinks."""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions by parser. Formats that need models or office libraries come in as block rows instead.
PARSERS = {
    "text": ("txt", "py", "js", "java", "c", "cpp", "h", "php", "go", "ts", "sh", "cs", "kt", "sql", "log"),
    "markdown": ("md", "markdown", "mdx"),
    "html": ("htm", "html"),
    "json": ("json", "jsonl", "ldjson"),
    "table": ("csv", "tsv"),
    "mail": ("eml",),
}
CODECS = ("utf-8", "gb18030", "big5", "utf-16", "latin-1")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, parser, content) of all files below a path; unknown extensions have a null parser."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parser = F.coalesce(*[F.when(ext.isin(*exts), name) for name, exts in PARSERS.items()])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", parser.alias("parser"), "content")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes by the first codec that reads them."""

    def one(data):
        for codec in CODECS:
            try:
                return bytes(data).decode(codec)
            except UnicodeDecodeError:
                continue

    return content.map(one)


_MAIL = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "sender", "recipients", "body")] + [T.StructField("n_attachments", T.IntegerType())])


@F.pandas_udf(_MAIL)
def parse_mail(content: pd.Series) -> pd.DataFrame:
    """Headers, the plain body (HTML if there is none) and the number of attachments."""
    rows = []
    for data in content:
        m = email.message_from_bytes(bytes(data), policy=email.policy.default)
        body = m.get_body(("plain", "html"))
        rows.append((str(m["subject"] or ""), str(m["from"] or ""), str(m["to"] or ""), body.get_content() if body else "", sum(1 for _ in m.iter_attachments())))
    return pd.DataFrame(rows, columns=["subject", "sender", "recipients", "body", "n_attachments"])


def write_reports(df: DataFrame, folder: str, title: str) -> None:
    """The same rows as JSON lines and CSV, and a Markdown table of counts by column."""
    df.write.mode("overwrite").json(f"{folder}/jsonl")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    lines = df.agg(*[F.count(c).alias(c) for c in df.columns]).select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("k", "v"))
    head = df.sparkSession.range(1).select(F.lit(f"# {title}\n\n| column | values |\n| --- | --- |").alias("value"))
    head.union(lines.select(F.format_string("| %s | %s |", "k", "v"))).coalesce(1).write.mode("overwrite").text(f"{folder}/report")
