"""Stages around an external model. A model is a function of an iterator of pandas batches, loaded once per worker by whoever makes it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators import filters, grounded
from winnow.operators import metrics as M

Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
FIXED_INSTRUCTION = "Write a question that the text below answers."


def generate(df: DataFrame, model: Model, prompt: Column, out: str = "output") -> DataFrame:
    """df with the model's output for each prompt. Not deterministic: filters are never pushed through it."""
    return df.withColumn(out, F.pandas_udf(model, "string").asNondeterministic()(prompt))


#: What the model is told for each type of question: its role, and the task.
TYPED = {
    "objects": ("You describe pictures and name only what can be seen in them.", "Ask for one or more things that are in the picture; yes or no must not answer it."),
    "spatial": ("You describe how things in a picture lie to each other.", "Ask one question about where something is, seen from something else."),
    "actions": ("You describe what goes on in a picture.", "Ask one question about what a person or an animal is doing."),
    "counting": ("You count what a picture shows.", "Ask one question whose answer is a number of things in the picture."),
    "text_ocr": ("You read what is written in a picture.", "Ask one question about words that can be read in the picture."),
    "reasoning": ("You explain what a picture shows.", "Ask one question whose answer has to be concluded from what can be seen."),
}


def typed_prompt(qa_type: str) -> tuple[str, str]:
    """(role, task) for a type of question; an unknown type is an error."""
    if qa_type not in TYPED:
        raise KeyError(f"{qa_type}: none of {', '.join(T.QA_TYPES)}")
    return TYPED[qa_type]


def typed_task(qa_type: Column) -> Column:
    """The task for each row's type; null for an unknown one."""
    return F.create_map(*[F.lit(x) for k, v in TYPED.items() for x in (k, v[1])])[qa_type]


def question_records(df: DataFrame, model: Model) -> DataFrame:
    """From answers: (instruction = question made, input = "", output = answer)."""
    rows = df.withColumn("__in", T.first_field(F.col("output"), F.col("text"))).filter("__in <> ''")
    made = generate(rows, model, F.concat(F.lit("Ask a question to which this is the answer:\n"), F.col("__in")), "__q")
    return made.select(T.after_think(F.col("__q")).alias("instruction"), F.lit("").alias("input"), F.col("__in").alias("output"))


def answer_records(df: DataFrame, model: Model) -> DataFrame:
    """From questions: (fixed instruction, input = answer made, output = question)."""
    rows = df.withColumn("__in", T.first_field(F.col("instruction"), F.col("text"))).filter("__in <> ''")
    made = generate(rows, model, F.concat(F.lit("Answer the question:\n"), F.col("__in")), "__a")
    return made.select(F.lit(FIXED_INSTRUCTION).alias("instruction"), T.after_think(F.col("__a")).alias("input"), F.col("__in").alias("output"))


def visual_pairs(images: DataFrame, model: Model, per_image: int = 1, name: str = "model") -> DataFrame:
    """per_image questions with answers for each (image_path, source_text)."""
    rows = filters.repeat_rows(images, per_image)
    made = generate(rows, model, F.concat(F.lit("Ask and answer one question about the image. Context: "), F.coalesce("source_text", F.lit(""))), "__out")
    return made.withColumn("__p", T.qa_pair(F.col("__out"))).select("image_path", T.short_hash(F.col("image_path")).alias("image_id"), F.col("__p.question").alias("question"), F.col("__p.answer").alias("answer"), F.lit(name).alias("generation_model"))


def verify_cycle(pairs: DataFrame, answer_model: Model, question_model: Model, scorer: Callable[[Column, Column], Column], clip: Column, ppl: Column | None = None) -> DataFrame:
    """pairs with cycle_scores: the answer made again from the question, the question from the answer, each compared with its own."""
    out = generate(pairs, answer_model, F.concat(F.lit("Answer: "), F.col("question")), "answer_again")
    out = generate(out, question_model, F.concat(F.lit("Ask for: "), F.col("answer")), "question_again")
    return out.withColumn("cycle_scores", M.composite(scorer(F.col("answer"), F.col("answer_again")), clip, scorer(F.col("question"), F.col("question_again")), ppl if ppl is not None else F.lit(None).cast("double")))


def verify_grounded(pairs: DataFrame, model: Model | None = None, least: float = 0.55) -> DataFrame:
    """Verdicts, post-checks and keep flags; without a model the column raw_output is taken as it is."""
    rows = pairs if model is None else generate(pairs, model, F.concat_ws("\n", F.lit("Is the answer supported by the image?"), "question", "answer"), "raw_output")
    return grounded.keep_flags(grounded.post_checked(grounded.parsed(rows)), least)


def image_message(content: Column, images: Column) -> Column:
    """The parts of a message: text pieces and images by turns; an error where marks and images differ in number."""
    pieces = F.split(content, "<image>")
    checked = F.when(F.size(pieces) - 1 == F.size(images), pieces).otherwise(F.raise_error(F.lit("as many <image> marks as images are needed")).cast("array<string>"))
    item = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    parts = F.transform(checked, lambda p, i: F.when(i == 0, F.array(item("text", p))).otherwise(F.array(item("image", F.get(images, i - 1)), item("text", p))))
    return F.filter(F.flatten(parts), lambda x: (x["type"] == "image") | (T.strip(x["value"]) != ""))


def generate_with_images(df: DataFrame, model: Model, content: Column, images: Column, out: str = "output") -> DataFrame:
    """df with the model's output for each message; the model gets its parts, text and images by turns, as JSON."""
    return generate(df, model, F.to_json(image_message(content, images)), out)


def paired(score: Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]]) -> Callable[[Column, Column], Column]:
    """A scorer for verify_cycle() from a function over batches of pairs, whose model is loaded once per worker."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from score(batches)

    return F.pandas_udf(run, "double").asNondeterministic()
