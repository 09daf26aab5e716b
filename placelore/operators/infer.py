"""Model calls: a caller-supplied batch function or a table of known responses. No client is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.functions.text import token_count

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


@dataclass(frozen=True)
class Request:
    """What a call is made with besides its prompt."""

    system_prompt: str = ""
    temperature: float = 0.0


Answer = Callable[[pd.Series, Request], "pd.Series | pd.DataFrame"]


def infer(prompts: DataFrame, answer: Answer, request: Request = Request()) -> DataFrame:
    """Adds ``response`` and its usage by running ``answer`` on Arrow batches of prompts inside the tasks.

    ``answer`` returns the responses, or a frame of ``response`` and the columns ``USAGE``; usage that it does not
    report stays NULL.
    """
    schema = prompts.withColumns(
        {"response": F.lit(None).cast("string"), **{u: F.lit(None).cast("bigint") for u in USAGE}}
    ).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = answer(batch["prompt"], request)
            if isinstance(got, pd.Series):
                got = got.to_frame("response")
            out = batch.assign(response=got["response"].to_numpy())
            for name in USAGE:
                out[name] = got[name].to_numpy() if name in got else pd.array([None] * len(batch), dtype="Int64")
            yield out

    return prompts.mapInPandas(run, schema)


def with_usage(answered: DataFrame) -> DataFrame:
    """``usage`` struct of every answered prompt; counts that the model did not report are counted from the texts."""
    prompt = F.coalesce("prompt_tokens", token_count("prompt"))
    completion = F.coalesce("completion_tokens", token_count("response"), F.lit(0))
    total = F.coalesce("total_tokens", prompt + completion)
    usage = F.struct(prompt.alias(USAGE[0]), completion.alias(USAGE[1]), total.alias(USAGE[2]))
    return answered.withColumn("usage", usage).drop(*USAGE)


def known_responses(prompts: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a table; prompts without an answer keep a NULL response."""
    return prompts.join(responses.select(*keys, "response"), keys, "left")
