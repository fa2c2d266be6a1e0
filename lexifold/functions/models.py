"""Places for models: encoders and pair scorers are in retrieve; here are generators, speech scorers and table functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import MAX_CHARS, OVERLAP, split_text
from .speech import sentences

REPLY = "answer string, gen_sec double, tokens long, tps double, tries int, error string"


def extractive_stub(prompt: str) -> str:
    """A stand-in for a generator: the first sentence of the prompt."""
    return (sentences(prompt) or [""])[0]


def complete(df: DataFrame, prompt: str, model: Callable[[str], str], tries: int = 2) -> DataFrame:
    """df with REPLY of a model for each prompt. A failure after some tries is a row with its error, never a failed task. Such
    calls cost much and may differ when repeated: write the result before it is used more than once."""
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), REPLY]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f[prompt]:
                began, answer, error, n = time.perf_counter(), None, None, 0
                while n < tries and answer is None:
                    n += 1
                    try:
                        answer, error = model(p), None
                    except Exception as e:  # a model may fail in any way
                        error = f"{type(e).__name__}: {e}"
                spent, tokens = time.perf_counter() - began, len((answer or "").split())
                rows.append((answer, spent, tokens, tokens / spent if spent > 0 else 0.0, n, error))
            replies = pd.DataFrame(rows, columns=["answer", "gen_sec", "tokens", "tps", "tries", "error"])
            yield pd.concat([f.reset_index(drop=True), replies], axis=1)

    return df.mapInPandas(run, ", ".join(fields))


def energy_scorer(samples: np.ndarray, full: float = 3000.0) -> float:
    """A stand-in for a speech model: loudness from 0 to 1."""
    x = np.asarray(samples, np.float64)
    return float(min(1.0, np.sqrt((x * x).mean()) / full)) if len(x) else 0.0


def speech_probability(frames: DataFrame, model: Callable[[np.ndarray], float] = energy_scorer, window: int = 512) -> DataFrame:
    """(session, seq, prob) of frames (session, seq, samples): the highest score of the whole windows that a frame completes, samples
    left over going on to the session's next frame; the score before where it completes none."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rest, prob, out = np.empty(0), 0.0, []
        for session, seq, samples in f.sort_values("seq")[["session", "seq", "samples"]].itertuples(index=False):
            rest = np.concatenate([rest, np.asarray(samples, np.float64)])
            whole = len(rest) // window
            if whole:
                prob = max(model(rest[i * window : (i + 1) * window]) for i in range(whole))
                rest = rest[whole * window :]
            out.append((session, seq, prob))
        return pd.DataFrame(out, columns=["session", "seq", "prob"])

    return frames.groupBy("session").applyInPandas(run, f"session {dict(frames.dtypes)['session']}, seq {dict(frames.dtypes)['seq']}, prob double")


def register_table_functions(spark: SparkSession) -> None:
    """split_text(text) and split_sentences(text) as table functions for SQL."""

    @F.udtf(returnType="part int, text string")
    class SplitText:
        def eval(self, text: str):
            yield from enumerate(split_text(text, MAX_CHARS, OVERLAP))

    @F.udtf(returnType="part int, text string")
    class SplitSentences:
        def eval(self, text: str):
            yield from enumerate(sentences(text or ""))

    spark.udtf.register("split_text", SplitText)
    spark.udtf.register("split_sentences", SplitSentences)


