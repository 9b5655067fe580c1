"""Questions written from passages by a generator of text, which may fail for a while."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .providers import BUILDING, Patience

#: What a generator is asked, the code points of a passage that it sees, and the tokens that it may write.
PROMPT = "Write ONE short question (at most 12 words) that a reader would naturally ask, which the following passage answers. Reply with the question only.\n\nPASSAGE:\n"
MOST_PASSAGE, MOST_TOKENS = 1500, 64


class Generator(Protocol):
    def generate(self, prompt: str, most_tokens: int) -> str: ...

    def retryable(self, error: Exception) -> bool: ...


class Opening:
    """A stand-in that asks for a passage's first words: the same in every run."""

    def __init__(self, words: int = 8) -> None:
        self.words = words

    def generate(self, prompt: str, most_tokens: int) -> str:
        return " ".join(prompt.removeprefix(PROMPT).split()[: self.words]) + "?"

    def retryable(self, error: Exception) -> bool:
        return False


def questioner(generator: Generator, patience: Patience = BUILDING) -> Callable[[Column], Column]:
    """A column of passages as a column of questions: the first line of each reply that says something, else empty.

    The generator goes to the tasks, so it must pickle. An error that patience doesn't mend fails the job.
    """

    @F.pandas_udf("string")
    def ask(passages: pd.Series) -> pd.Series:
        replies = (patience.call(lambda p=p: generator.generate(PROMPT + p, MOST_TOKENS), generator.retryable) for p in passages)
        return pd.Series([next((line.strip() for line in reply.split("\n") if line.strip()), "") for reply in replies], dtype=object)

    return lambda passage: ask(F.substring(F.coalesce(passage, F.lit("")), 1, MOST_PASSAGE))
