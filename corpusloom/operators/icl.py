"""In-context evaluation: task tables, few-shot prompts, scoring, and chat prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metric of each type of task.
METRICS = {
    "language_modeling": "InContextLearningLMAccuracy",
    "multiple_choice": "InContextLearningMultipleChoiceAccuracy",
    "schema": "InContextLearningMultipleChoiceAccuracy",
    "question_answering": "InContextLearningQAAccuracy",
}


@dataclass(frozen=True)
class Task:
    label: str
    kind: str
    num_fewshot: tuple[int, ...] = (0,)
    prompt: str = ""
    example_delimiter: str = "\n"
    continuation_delimiter: str = " "
    has_categories: bool = False

    def __post_init__(self):
        if self.kind not in METRICS:
            raise ValueError(f"no metric for tasks of type {self.kind}")

    def keys(self, categories: tuple[str, ...] = ()) -> list[str]:
        """The metric keys that evaluating this task logs."""
        own = [f"/{c}" for c in categories] if self.has_categories else [""]
        return [f"metrics/{self.label}/{n}-shot{c}/{METRICS[self.kind]}" for n in self.num_fewshot for c in own]


def continuation(text: Column) -> Column:
    """With a leading blank, unless white space leads it."""
    return F.when(text.rlike(r"\A\s"), text).otherwise(F.concat(F.lit(" "), text))


def exemplars(items: DataFrame, item: str, order: str, number: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """(by, exemplars): ``number + 1`` items a group in seeded order, few enough to broadcast; one is spare, as an item is
    never its own exemplar. Only the first of each group are ranked past the first exchange."""
    group = [by] if by else []
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(order).cast("string"))), order)
    top = items.select(*group, F.col(order).alias("_id"), F.col(item).alias("_text"), F.row_number().over(w).alias("_rank")).where(F.col("_rank") <= number + 1)
    return top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", "_id", "_text"))).alias("_examples"))


def prompts(items: DataFrame, key: str, context: str, answer: str, task: Task, shots: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """``items`` with ``prompt`` and ``continuation`` for ``shots`` exemplars: the task's prompt, exemplars with their
    answers, then the item's own context. A delimiter's trailing blank moves to the continuation."""
    delimiter = F.lit(task.continuation_delimiter.rstrip(" "))
    rows = items.withColumn("_whole", F.concat(F.col(context), F.lit(task.continuation_delimiter), F.ltrim(F.col(answer))))
    head = F.lit(task.prompt)
    if shots:
        shown = exemplars(rows, "_whole", key, shots, seed, by)
        rows = rows.join(F.broadcast(shown), by, "left") if by else rows.crossJoin(F.broadcast(shown))  # one row of exemplars, or one a category
        others = F.slice(F.filter("_examples", lambda e: e["_id"] != F.col(key)), 1, shots)
        head = F.concat(head, F.array_join(F.transform(others, lambda e: F.concat(e["_text"], F.lit(task.example_delimiter))), ""))
    rows = rows.withColumn("prompt", F.concat(head, F.col(context), delimiter)).withColumn("continuation", continuation(F.ltrim(F.col(answer))))
    return rows.drop("_whole", "_examples")


def expanded(items: DataFrame, choices: str = "choices") -> DataFrame:
    """One row a choice: choice_idx from 0 and choice. Items without choices give none."""
    return items.select("*", F.posexplode(choices).alias("choice_idx", "choice"))


def best_choice(scores: DataFrame, item: str, perplexity: str = "perplexity", option: str = "choice_idx", gold: str = "gold") -> DataFrame:
    """(item, picked, correct): the option of least perplexity, the first among equals; for choices and context options alike."""
    least = F.min(F.struct(F.col(perplexity).alias("p"), F.col(option).alias("o")))
    return scores.groupBy(item).agg(least["o"].alias("picked"), F.first(gold).alias("gold")).select(item, "picked", (F.col("picked") == F.col("gold")).alias("correct"))


def qa_correct(generated: Column, aliases: Column) -> Column:
    """The generation starts with an alias, after lower case, without punctuation, articles and extra blanks."""
    words = lambda c: F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    tidy = lambda c: F.array_join(F.filter(words(c), lambda w: ~w.isin("a", "an", "the", "")), " ")
    return F.exists(aliases, lambda a: F.startswith(tidy(generated), tidy(a)))


def lm_correct(generated: Column, expected: Column) -> Column:
    """All tokens of the continuation are as expected."""
    return generated == expected


# The chat markup.
CHAT_SYSTEM, CHAT_USER, CHAT_ASSISTANT = "<|im_start|>system\n{}<|im_end|>\n", "<|im_start|>user\n{}<|im_end|>\n", "<|im_start|>assistant\n{}<|im_end|>\n"
CHAT_PREFIX = "<|im_start|>assistant\n"


def chat_prompts(turns: DataFrame, conversation: str, turn: str, user: str, assistant: str, system: str = "") -> DataFrame:
    """The prompt at each turn: the system text, all earlier turns with their replies, the user's text, and the reply's head."""
    fill = lambda form, c: F.replace(F.lit(form), F.lit("{}"), c)
    so_far = Window.partitionBy(conversation).orderBy(turn)
    both = F.concat(fill(CHAT_USER, F.col(user)), fill(CHAT_ASSISTANT, F.coalesce(assistant, F.lit(""))))
    earlier = F.array_join(F.collect_list(both).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), "")
    return turns.withColumn("prompt", F.concat(F.lit(CHAT_SYSTEM.replace("{}", system)) if system else F.lit(""), earlier, fill(CHAT_USER, F.col(user)), F.lit(CHAT_PREFIX)))


def completion(generated: Column, prompt: Column) -> Column:
    """What follows the prompt."""
    return generated.substr(F.length(prompt) + 1, F.length(generated))


def accuracy(correct: Column) -> Column:
    return F.avg(correct.cast("double"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.avg(loss))


def calibration_error(df: DataFrame, confidence: str, correct: str, buckets: int = 10) -> DataFrame:
    """Expected calibration error: accuracy against mean confidence in equal buckets, weighted by their rows."""
    bucket = F.least(F.floor(F.col(confidence) * buckets), F.lit(buckets - 1))
    per = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))
