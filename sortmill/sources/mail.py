"""Mail archives and made-up documents as sources."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _body(messages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in messages:
        out = []
        for m in column:
            text = m.as_py()
            if text is None:
                out.append(None)
                continue
            try:
                part = email.message_from_string(text, policy=email.policy.default).get_body(("plain", "html"))
                out.append(part.get_content() if part is not None else "")
            except (LookupError, ValueError, AttributeError):  # unknown charset or broken structure: what follows the headers
                out.append(text.partition("\n\n")[2])
        yield pa.array(out, pa.string())


def read_mbox(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """(file, message, body): every message of mbox files, the last of each file too.

    Messages are the records of a text source whose separator is a line's `From `, so a huge archive is read by many tasks.
    `longest` cuts messages to that many characters before their bodies are taken; None, the default, cuts none.
    """
    raw = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    message = F.regexp_replace("value", r"^[^\n]*(\n|$)", "")
    rows = raw.select("file", message.alias("message")).filter("message <> ''")
    if longest is not None:
        rows = rows.withColumn("message", F.substring("message", 1, longest))
    return rows.withColumn("body", _body("message"))


def made_up(spark: SparkSession, documents: int = 100, words: int = 10_000, vocabulary: int = 5_000, seed: int = 100) -> DataFrame:
    """(doc_id, words): documents of hash-drawn words, the same for the same seed."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(vocabulary))))
    return spark.range(documents).select(F.col("id").alias("doc_id"), drawn.alias("words"))
