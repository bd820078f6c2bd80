"""Structured Streaming: documents that keep arriving, and conversations that remember."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.operators import index, needs


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of a stream of documents(doc_id, text), kept up to date (output mode complete or update)."""
    return index.postings_stream(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def append_postings(docs: DataFrame, path: str, checkpoint: str):
    """Starts a query that adds the postings of arriving documents to a Parquet folder. Exactly once: the folder has Spark's sink log."""
    return index.postings_stream(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def remembered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, entity, carried) for a stream of user turns(conv_id, turn, text): each turn's entity, or the
    conversation's last one where it has none. State is one word a conversation."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kws = turns.select("conv_id", "turn", needs.entity(needs.T.keywords("text", needs.V.STOP_WORDS), F.col("text")).alias("entity"))

    def step(key, batches, state):
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, own in zip(rows.turn, rows.entity):
            last = own or last
            out.append((key[0], turn, own, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "entity", "carried"])

    return kws.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, entity string, carried string", "last string", "append", GroupStateTimeout.NoTimeout)
