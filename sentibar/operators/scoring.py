"""Article scoring (B8-B13): a pluggable scorer stage.

``score_articles`` takes any scorer: a step ``scorer(df, text) -> df`` that
adds a struct column ``_s`` with a label and a probability.  Two
implementations:

* ``lexicon_scorer`` - the built-in default, native column expressions
  (split + filter + size), stays inside whole-stage codegen;
* ``pandas_scorer(fn)`` - wraps an external batch model (``fn`` gets a
  pandas Series of texts, returns a DataFrame with label and prob) as an
  Arrow-batched iterator pandas UDF, so model weights load once per task
  and inference runs on executor batches, never on the driver.

Only rows whose score is still NULL are scored (A14); the others pass
through unchanged, and no key or join is involved - see ``rescore_pending``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as FV
from ..functions.text import lexicon_counts, polar_score, reply_fields, reply_object

SCORE_TYPE = T.StructType([T.StructField("label", T.StringType()),
                           T.StructField("prob", T.DoubleType())])


def lexicon_scorer(positive=FV.POSITIVE_WORDS, negative=FV.NEGATIVE_WORDS):
    """Label by majority of lexicon hits over the whole text; probability is
    the Laplace-smoothed share of the majority class.  The word array is
    projected once and shared by both counts."""

    def step(df: DataFrame, text: Column) -> DataFrame:
        # Letter runs of the lower-cased text; empty tokens never match a
        # lexicon word, so the raw split is counted directly.
        w = df.withColumn("_w", F.split(F.lower(text), r"[^\p{L}]+"))
        n_pos, n_neg = lexicon_counts(F.col("_w"), positive, negative)
        counted = w.withColumn("_c", F.struct(n_pos.alias("p"), n_neg.alias("n"))).drop("_w")
        p, n = F.col("_c.p"), F.col("_c.n")
        label = (F.when(p > n, F.lit("positive")).when(n > p, F.lit("negative"))
                 .otherwise(F.lit("neutral")))
        prob = (F.greatest(p, n) + 1).cast("double") / (p + n + 2).cast("double")
        return (counted.withColumn("_s", F.struct(label.alias("label"), prob.alias("prob"),
                                                  p.alias("n_pos"), n.alias("n_neg")))
                .drop("_c"))

    return step


def pandas_scorer(fn: Callable[[pd.Series], pd.DataFrame]):
    """Wrap a batch model as an Arrow iterator UDF returning (label, prob)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(SCORE_TYPE)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = fn(texts.fillna(""))
            yield out[["label", "prob"]].reset_index(drop=True)

    return lambda df, text: df.withColumn("_s", _score(text))


def score_articles(df: DataFrame, text: Column, scorer=None,
                   prefix: str = "lexicon") -> DataFrame:
    scorer = scorer or lexicon_scorer()
    return (scorer(df, text)
            .withColumn(f"{prefix}_label", F.col("_s.label"))
            .withColumn(f"{prefix}_prob", F.col("_s.prob"))
            .withColumn(f"{prefix}_sentiment", polar_score(F.col("_s.label"), F.col("_s.prob")))
            .drop("_s"))


def with_reply_fields(df: DataFrame, reply: str, keep_valid_only: bool = False) -> DataFrame:
    """B11 on a DataFrame: parse each reply once, then project its fields."""
    v = df.withColumn("_v", reply_object(reply))
    if keep_valid_only:
        v = v.filter(F.col("_v").isNotNull())
    return v.withColumns(reply_fields("_v")).drop("_v")


def rescore_pending(articles: DataFrame, text: Column, target_col: str,
                    scorer=None) -> DataFrame:
    """Score rows whose ``target_col`` is NULL; the others stay as they are.

    Row-wise: rows with NULL or repeated keys are scored like any other, no
    row is lost or multiplied, and nothing is shuffled."""
    kind = articles.schema[target_col].dataType
    todo = articles.filter(F.col(target_col).isNull()).withColumn("_text", text)
    scored = (score_articles(todo, F.col("_text"), scorer, prefix="_new")
              .withColumn(target_col, F.col("_new_sentiment").cast(kind)))
    return articles.filter(F.col(target_col).isNotNull()).unionByName(scored.select(*articles.columns))
