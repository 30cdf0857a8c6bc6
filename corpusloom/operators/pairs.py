"""Records to prompt and response pairs, and the registry of such preprocessors."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Preprocessor = Callable[[DataFrame], DataFrame]
_registry: dict[str, Preprocessor] = {}


def register(*names: str) -> Callable[[Preprocessor], Preprocessor]:
    """Registers a preprocessor under all ``names``; a name that is taken is an error."""

    def add(function: Preprocessor) -> Preprocessor:
        for name in names:
            if name in _registry:
                raise ValueError(f"{name} is registered already")
            _registry[name] = function
        return function

    return add


def registered() -> list[str]:
    return sorted(_registry)


def need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def _pair(df: DataFrame, prompt: Column, response: Column, drop: tuple[str, ...]) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in (*drop, "prompt", "response")), prompt.alias("prompt"), response.alias("response"))


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Takes prompt and response from the named columns; the mapping names exactly these two, in this order."""
    if list(mapping) != ["prompt", "response"]:
        raise ValueError("the mapping must have the keys prompt and response")
    need(df, *mapping.values())
    return df.select(F.col(mapping["prompt"]).alias("prompt"), F.col(mapping["response"]).alias("response"))


ALPACA_MARK = "### Response:"  # fixed value


@register("alpaca")
def alpaca(df: DataFrame) -> DataFrame:
    """``text`` cut at its one response mark, which stays with the prompt; another number of marks is an error."""
    need(df, "text")
    parts = F.split("text", ALPACA_MARK, -1)
    prompt = F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit(ALPACA_MARK))).otherwise(F.raise_error(F.lit("text must hold the response mark once")))
    return _pair(df, prompt, F.get(parts, F.lit(1)), ("text",))


DOLLY_HEAD = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n"  # fixed value
DOLLY_TAIL = "\n\n### Response:\n"  # fixed value


@register("dolly", "instruction_input_output")
def dolly(df: DataFrame) -> DataFrame:
    need(df, "instruction", "input", "output")
    asked = F.when(F.col("input") != "", F.concat_ws("\n", "instruction", "input")).otherwise(F.col("instruction"))
    return _pair(df, F.concat(F.lit(DOLLY_HEAD), asked, F.lit(DOLLY_TAIL)), F.col("output"), ("instruction", "input", "output"))


@register("p3")
def p3(df: DataFrame) -> DataFrame:
    need(df, "inputs", "targets")
    return _pair(df, F.concat("inputs", F.lit(":")), F.col("targets"), ("inputs", "targets"))


@register("spaced_p3", "spaced_flan")
def spaced(df: DataFrame) -> DataFrame:
    """A blank between prompt and response, unless white space is there on either side."""
    need(df, "inputs", "targets")
    open_ = ~(F.col("inputs").rlike(r"[ \n\t]\z") | F.col("targets").rlike(r"\A[ \n\t]"))
    return _pair(df, F.col("inputs"), F.when(open_, F.concat(F.lit(" "), "targets")).otherwise(F.col("targets")), ("inputs", "targets"))


@register("multiple_choice")
def multiple_choice(df: DataFrame) -> DataFrame:
    """The query with its options listed; the response is the right one. ``gold`` counts from 0, from the end if negative;
    a gold outside the choices, or null choices, give a null response."""
    need(df, "query", "choices", "gold")
    options = F.array_join(F.transform("choices", lambda c: F.concat(F.lit("\n - "), c)), "")
    at = F.when(F.col("gold") < 0, F.col("gold") + F.size("choices")).otherwise(F.col("gold"))
    return _pair(df, F.concat("query", F.lit("\nOptions:"), options, F.lit("\nAnswer: ")), F.get("choices", at.cast("int")), ("query", "choices", "gold"))


@register("trivia")
def trivia(df: DataFrame) -> DataFrame:
    need(df, "question", "answer")
    return _pair(df, F.concat(F.lit("Question: "), "question", F.lit("\nAnswer:")), F.col("answer"), ("question", "answer"))


def schema_items(df: DataFrame) -> DataFrame:
    """Pronoun items (text, pronoun, pronoun_loc, options, label) to context options and a continuation."""
    need(df, "text", "pronoun", "pronoun_loc", "options", "label")
    head = F.substring("text", F.lit(1), F.col("pronoun_loc"))
    tail = F.col("text").substr(F.col("pronoun_loc") + F.length("pronoun") + 1, F.length("text"))
    tidy = lambda o: F.when(F.lower(F.split(o, " ")[0]).isin("the", "a", "an", "my", "his", "her", "their") & ~head.rlike(r"(\A|[.?!]\s*)\z"), F.concat(F.lower(F.substring(o, 1, 1)), o.substr(F.lit(2), F.length(o)))).otherwise(o)
    kept = [c for c in df.columns if c not in ("text", "pronoun", "pronoun_loc", "options", "label")]
    return df.select(*kept, F.transform("options", lambda o: F.concat(head, tidy(o))).alias("context_options"), tail.alias("continuation"), F.col("label").cast("long").alias("gold"))


def resolve(name: str | None, dataset: str | None = None) -> Preprocessor:
    """A preprocessor by registered name, by ``module:function`` (a function of one record, run in Arrow batches), by the
    data set's name where none is given, else the one that changes nothing."""
    if name is None:
        return _registry.get(dataset or "", lambda df: df)
    if name in _registry:
        return _registry[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"no preprocessor {name}; registered are {', '.join(registered())}")
    row_function = getattr(importlib.import_module(module), function)
    return lambda df: each_record(df, row_function)


def each_record(df: DataFrame, function: Callable[[dict], dict]) -> DataFrame:
    """``function`` of every record, which gives prompt and response."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [function(r) for r in frame.to_dict("records")]
            yield pd.DataFrame({"prompt": [r["prompt"] for r in out], "response": [r["response"] for r in out]})

    return df.mapInPandas(run, "prompt string, response string")


def shorter_prompts(df: DataFrame, ids: str, length: int, observation=None) -> DataFrame:
    """Rows whose prompt has fewer than ``length`` tokens; an ``Observation`` gets the number of dropped ones in the same pass."""
    if observation is not None:
        df = df.observe(observation, F.count_if(~(F.size(ids) < length)).alias("dropped"), F.count(F.lit(1)).alias("rows"))
    return df.where(F.size(ids) < length)


def renamed_keys(key: Column, changes: dict[str, str]) -> Column:
    """Every old part replaced by its new one, in order."""
    for old, new in changes.items():
        key = F.replace(key, F.lit(old), F.lit(new))
    return key
