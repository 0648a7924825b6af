"""Full-text matching and ranking."""

from __future__ import annotations

import math
import re

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that aren't indexed.
STOPWORDS = "a an the is are was were in on at to for of with without and or but so yet".split()


def query_tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case, longer than two and no stopwords, in order."""
    return [w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) > 2 and w not in STOPWORDS]


_LONG_STOPWORDS = [w for w in STOPWORDS if len(w) > 2]


def has(column: str, token: str) -> str:
    """Whether a text has a token; a plain search spares most texts the pattern."""
    return f"(contains(lower({column}), '{token}') AND lower({column}) RLIKE '(?<![a-z0-9]){token}(?![a-z0-9])')"


def match(column: str, query: str) -> str:
    """Whether a text has all tokens of the query; no tokens, no match."""
    wanted = list(dict.fromkeys(query_tokens(query)))
    return "coalesce(" + " AND ".join(has(column, w) for w in wanted) + ", FALSE)" if wanted else "FALSE"


def tokens(text: Column) -> Column:
    """The indexed tokens of a text in order, repeats included; none of a null."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.coalesce(F.filter(runs, lambda w: ~w.isin(_LONG_STOPWORDS)), F.array().cast("array<string>"))


def terms(texts: DataFrame) -> DataFrame:
    """(token, file, docs, tokens): for each token of each file, how many of its ``texts`` (file, text) have it.

    The empty token stands for all texts that aren't null, with the number of their tokens, repeats included.
    """
    listed = texts.where("text IS NOT NULL").select("file", tokens(F.col("text")).alias("list"))
    each = listed.select("file", F.size("list").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("list"))).alias("token"))
    return each.groupBy("token", "file").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("token") == "", F.col("n"))).alias("tokens"))


def rank(rows: DataFrame, column: str, query: str, found: Iterable) -> DataFrame:
    """The rows with any of the query's tokens and their score, from what the term table says of each file (``Storage.found``).

    A token's weight is ln((N - df + 0.5) / (df + 0.5) + 1) over all N texts, once for each time that the query has it; each
    adds weight * (l + 0.5) / (l + 1), with l the row's tokens against the average, repeats included.
    """
    wanted = query_tokens(query)
    n, total, df = 0, 0, dict.fromkeys(wanted, 0)
    for f in found:
        n, total = n + f["docs"], total + f["tokens"]
        for w in df:
            df[w] += f["having"].get(w, 0)
    asked = [w for w in df if df[w]]
    if not asked:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    text = f"`{column}`"
    weights = [F.when(F.expr(has(text, w)), F.lit(wanted.count(w) * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1))).otherwise(0.0) for w in asked]
    share = F.size(tokens(F.col(text))) / F.lit(total / n)
    score = sum(weights, F.lit(0.0)) * (share + 0.5) / (share + 1.0)
    return rows.where(" OR ".join(has(text, w) for w in asked)).withColumn("score", score)
