"""Replies of batch jobs and the requests they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators.prefix import numbered


def by_fingerprint(requests: DataFrame, replies: DataFrame, text: str = "text", request_id: str = "request_id", reply_id: str = "reply_id") -> DataFrame:
    """request_id, reply_id (null if none): by equal fingerprints of the texts, equal ones first come, first served."""

    def served(df: DataFrame, key: str) -> DataFrame:
        own = df.select(F.col(key), parsing.fingerprint(F.col(text)).alias("print"))
        return own.withColumn("n", F.row_number().over(Window.partitionBy("print").orderBy(key)))

    return served(requests, request_id).join(served(replies, reply_id), ["print", "n"], "left").select(request_id, reply_id)


def by_custom_id(requests: DataFrame, replies: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every request with `matched`; an unmatched one is an error of the batch."""
    return requests.join(replies.select(key).distinct().withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def chunked(rows: DataFrame, order: list[str], size: int, group: list[str]) -> DataFrame:
    """rows with chunk: numbers of chunks of `size` rows of each group, in order."""
    return numbered(rows, order, "_n", group).withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def chunk_outcomes(requests: DataFrame, responses: DataFrame, expected: int, key: str = "design_id") -> DataFrame:
    """key, got, outcome: evaluated if all expected responses parsed, else failed; keys without any response count as failed too. responses: key, parsed."""
    got = responses.where("parsed").groupBy(key).agg(F.count("*").alias("got"))
    return requests.select(key).distinct().join(got, key, "left").select(key, F.coalesce("got", F.lit(0)).alias("got")).withColumn("outcome", F.when(F.col("got") >= expected, "evaluated").otherwise("failed"))
