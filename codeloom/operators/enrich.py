"""Enrichment by a remote model: prompts, cached answers, calls with retries, answers applied."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import strip_fence, with_newline

#: Request defaults.
OPTIONS = {"temperature": 0.5, "max_tokens": 8192, "stream": False}
#: A request and an answer of a chat service.
REQUEST = "model string, messages array<struct<role:string,content:string>>, temperature double, top_p double, n int, max_tokens int, presence_penalty double, frequency_penalty double, stream boolean, stop array<string>, user string, seed int"
RESPONSE = "id string, object string, created bigint, model string, choices array<struct<index:int,message:struct<role:string,content:string,reasoning_content:string>,finish_reason:string>>, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,prompt_tokens_details:struct<cached_tokens:int>>"
TRIES, PARSE_TRIES, DELAY = 20, 2, 1.0
# The texts of prompts around what is asked about.
CODE_HEAD, CODE_FOOT = "<代码片段>\n```\n", "\n```\n<end>\n\n"
DOC_HEAD, DOC_FOOT = "<api方法文档>\n", "<end>\n\n"
CALL_HEAD, CALL_FOOT = "<函数调用 ", "<end "
CALLED, AFTER, AT_METHOD, MAY_THROW = "代码片段中的函数：", "\n在经过", "重调用后，最终在函数:", "中\n可能抛出运行时异常:"
BY_THROW, THROWN, EXPLAINED = "重调用后，使用throw语句`", "`抛出异常\n", "异常说明："
NO_CATCH = ("no catch", "false", "")
#: Fields of an answer.
ANSWER = "analysis string, answer string, remark string, result string"


def prompt(template: str, values: list[Column], sections: Column) -> Column:
    """The template, with `{str1}`, `{str2}`, ... replaced literally, and the sections numbered below it."""
    head = F.lit(template)
    for k, value in enumerate(values):
        head = F.replace(head, F.lit(f"{{str{k + 1}}}"), value)
    return F.concat_ws("\n", head, F.array_join(F.transform(sections, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))


def request(model: str, messages: Column, **options: object) -> Column:
    """A request as a struct, with defaults for what is not given. messages: array of (role, content)."""
    given = {**OPTIONS, **options, "model": model}
    kinds = dict(c.split(" ", 1) for c in re.split(r", (?=\w+ \w)", REQUEST))
    unknown = set(given) - set(kinds)
    if unknown:
        raise ValueError(f"no such options: {sorted(unknown)}")

    def field(name: str, kind: str) -> Column:
        if name == "messages":
            return messages.cast(kind).alias(name)
        value = given.get(name)
        return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kind).alias(name)

    return F.struct(*(field(n, k) for n, k in kinds.items()))


def chat_text(messages: Column) -> Column:
    """Messages as a list in brackets, a line `{"role": "...", "content": "..."}` each, texts as they stand (nothing is escaped)."""
    # The form of the list.
    lines = F.transform(messages, lambda m: F.concat(F.lit('    {"role": "'), m["role"], F.lit('", "content": "'), m["content"], F.lit('"},\n')))
    return F.replace(F.concat(F.lit("[\n"), F.array_join(lines, ""), F.lit("]")), F.lit(",\n]"), F.lit("\n]"))


def response(text: Column) -> Column:
    """The fields of a service's answer; null where it is no object."""
    return F.from_json(text, RESPONSE)


def first_content(answer: Column) -> Column:
    """The content of the first choice; null without one."""
    return F.get(answer["choices"], F.lit(0))["message"]["content"]


def _code(text: Column) -> Column:
    return F.concat(F.lit(CODE_HEAD), text, F.lit(CODE_FOOT))


def filled(template: str | Column, value: Column) -> Column:
    """The template with `{str1}` replaced, literally."""
    return F.replace(F.lit(template), F.lit("{str1}"), value)


def main_prompt(templates: dict[str, str], code: Column, findings: Column) -> Column:
    """The main question. findings: array of (kind, callee, depth, method, exceptions, description), numbered from 1 in the text."""

    def one(f: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        called = F.concat(F.lit(CALLED), f["callee"], F.lit(AFTER), f["depth"].cast("string"))
        api = F.concat(called, F.lit(AT_METHOD), f["method"], F.lit(MAY_THROW), f["exceptions"], F.lit("\n"))
        thrown = F.concat(called, F.lit(BY_THROW), f["exceptions"], F.lit(THROWN))
        what = F.when(f["kind"] == "API", api).when((f["kind"] == "THROW") & (f["depth"] > 0), thrown).otherwise("")
        said = F.when(F.coalesce(f["description"], F.lit("")) != "", F.concat(F.lit(EXPLAINED), f["description"], F.lit("\n"))).otherwise("")
        return F.concat(F.lit(CALL_HEAD), number, F.lit(">\n"), F.coalesce(what, F.lit("")), said, F.lit(CALL_FOOT), number, F.lit(">\n"))

    head = F.lit(templates["background"] + templates["question"] + templates["input_format"] + "\n")
    return F.concat(head, _code(code), F.array_join(F.transform(findings, one), ""))


def api_prompt(templates: dict[str, str], method: Column, code: Column, doc: Column) -> Column:
    """The question about an API method: where it is called, and its document."""
    return F.concat(filled(templates["api_question"], method), F.lit(templates["api_format"] + "\n"), _code(code), F.lit(DOC_HEAD), doc, F.lit(DOC_FOOT))


def throw_prompt(templates: dict[str, str], statement: Column, code: Column) -> Column:
    """The question about a throw statement."""
    return F.concat(filled(templates["throw_question"], statement), filled(templates["throw_format"], statement), F.lit("\n"), _code(code))


def baseline_prompt(templates: dict[str, str], code: Column) -> Column:
    """The question about a method alone."""
    return F.concat(F.lit(templates["background"] + templates["question"] + templates["baseline_input_format"] + "\n"), _code(code))


def dispatched(findings: DataFrame, templates: dict[str, str]) -> DataFrame:
    """findings (kind, method, statement, code, doc) with the prompt of their kind; another kind is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown kind of finding: "), F.coalesce("kind", F.lit("null"))))
    by_kind = F.when(F.col("kind") == "API", api_prompt(templates, F.col("method"), F.col("code"), F.coalesce("doc", F.lit("")))).when(F.col("kind") == "THROW", throw_prompt(templates, F.col("statement"), F.col("code"))).otherwise(wrong)
    return findings.withColumn("prompt", by_kind)


def checked_exceptions(answered: DataFrame) -> DataFrame:
    """An API adviser's answers applied: the candidates that the answer names stay. answered: answer (array of simple names), candidates."""
    return answered.withColumn("checked", matched_exceptions(F.col("answer"), F.col("candidates")))


def progress(done: DataFrame, total: DataFrame) -> DataFrame:
    """One row: how many rows are done, of how many, in percent."""
    counts = done.agg(F.count(F.lit(1)).alias("done")).crossJoin(total.agg(F.count(F.lit(1)).alias("total")))  # one row and one row
    return counts.select("done", "total", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"), 2)).otherwise(100.0).alias("percent"))


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the stored answer, and needs_call where there is none."""
    stored = cache.groupBy(*keys).agg(F.first("answer").alias("answer"))
    return rows.join(stored, keys, "left").withColumn("needs_call", F.col("answer").isNull())


def parsed(answer: Column) -> Column:
    """The fields of an answer, with or without a code fence; null if it is no object."""
    return F.from_json(strip_fence(answer, "json"), ANSWER)


def keeps_throw(result: Column) -> Column:
    """Whether an answer keeps a throw: not `no catch`, `false`, or nothing."""
    return ~F.lower(F.trim(F.coalesce(result, F.lit("false")))).isin(*NO_CATCH)


def matched_exceptions(answer: Column, candidates: Column) -> Column:
    """Qualified candidates that end in one of the answer's simple names."""
    return F.filter(candidates, lambda q: F.exists(answer, lambda s: q.endswith(s)))


def ask(rows: DataFrame, client: Callable[[str], str], workers: int = 4, pause: float = 0.0, delay: float = DELAY, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError, OSError)) -> DataFrame:
    """rows (with prompt) and the client's answer, error: at most `workers` calls at once, `pause` seconds apart, each tried TRIES
    times, `delay` seconds apart, on a connection error and asked again PARSE_TRIES times where the answer is no JSON object.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def call(question: str) -> tuple[str | None, str | None]:
        problem = "no answer"
        for _ in range(PARSE_TRIES):
            for attempt in range(TRIES):
                try:
                    text = client(question)
                    break
                except retry_on as e:
                    problem = f"{type(e).__name__}: {e}"
                    if attempt + 1 == TRIES:
                        return None, problem
                    time.sleep(delay)
            body = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
            try:
                if isinstance(json.loads(body), dict):
                    return body, None
            except ValueError:
                pass
            problem = "no JSON object"
        return None, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            answers = []
            for question in part["prompt"]:
                answers.append(call(question))
                time.sleep(pause)
            yield part.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return rows.repartition(workers).mapInPandas(run, schema)


def advised(findings: DataFrame, templates: dict[str, str], client: Callable[[str], str], **asking: object) -> DataFrame:
    """findings (kind, method, statement, code, doc, candidates) judged by a model: with checked, what stays of the candidates, description and error.

    An API answer names the exceptions that stay, by simple names; a throw answer keeps all or, by `no catch`, none.
    Without an answer that can be read all candidates stay.
    """
    asked = ask(dispatched(findings, templates), client, **asking)
    body = strip_fence(F.col("answer"), "json")
    api, thrown = F.from_json(body, "result array<string>, remark string"), F.from_json(body, "result string, remark string")
    none = F.array().cast(findings.schema["candidates"].dataType)
    by_api = F.when(api["result"].isNull(), F.col("candidates")).otherwise(matched_exceptions(api["result"], F.col("candidates")))
    by_throw = F.when(thrown["result"].isNull() | keeps_throw(thrown["result"]), F.col("candidates")).otherwise(none)
    return asked.withColumns({"checked": F.when(F.col("kind") == "API", by_api).otherwise(by_throw), "description": F.coalesce(thrown["remark"], F.lit(""))}).drop("prompt", "answer")


def answered(rows: DataFrame, client: Callable[[str], str], **asking: object) -> DataFrame:
    """rows (prompt) with a model's answer to the main or baseline question: analysis, judgement, remark, code (without a fence, ending in a line feed) and status."""
    asked = ask(rows, client, **asking).withColumn("_a", parsed(F.col("answer")))
    fields = {"analysis": F.col("_a.analysis"), "judgement": F.col("_a.answer"), "remark": F.col("_a.remark"), "code": with_newline(strip_fence(F.col("_a.result"), "java")), "status": F.when(F.col("_a").isNull(), "failed").otherwise("answered")}
    return asked.withColumns(fields).drop("_a", "answer")


def classify(rows: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """rows with `class`: a model that each task loads once and applies to batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField("class", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            yield part.assign(**{"class": model(part[column]).astype("int32")})

    return rows.mapInPandas(run, schema)
