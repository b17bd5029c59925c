"""Text generators and judges: protocols, deterministic stand-ins and distributed runners."""

from __future__ import annotations

import asyncio
import json
import queue
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an answer starts with after a failure of the service and after any other failure.
SERVICE_ERROR, OTHER_ERROR = "[GENERATOR HTTP ERROR]", "[GENERATOR ERROR]"
#: Requests in flight in one task.
IN_FLIGHT = 10

Generator = Callable[[str], Awaitable[str]]
Judge = Callable[[str, str, list[str]], dict[str, float]]


class ServiceError(Exception):
    """The service could not be reached or answered with a failure."""


async def echo_generator(prompt: str) -> str:
    """A deterministic stand-in: the question of the prompt with its length."""
    asked = next((x[len("Frage: ") :] for x in prompt.split("\n") if x.startswith("Frage: ")), "")
    return f"{asked} [{len(prompt)}]"


class HttpGenerator:
    """Asks a text-generation service for one answer; the field ``response`` of its JSON is the answer."""

    def __init__(self, url: str, model: str, context_length: int = 110_000, timeout: float = 600.0):
        self.url, self.model, self.context_length, self.timeout = url, model, context_length, timeout

    async def __call__(self, prompt: str) -> str:
        return await asyncio.to_thread(self._ask, prompt)

    def _ask(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": {"num_ctx": self.context_length}}).encode()
        request = urllib.request.Request(self.url, data=body, headers={"Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read())["response"]
        except urllib.error.URLError as e:
            raise ServiceError(str(e)) from e


def generate(prompts: DataFrame, generator: Generator = echo_generator, in_flight: int = IN_FLIGHT, carried: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, answer, error`` of every ``query_id, prompt``; a failure of one row is its value and harms no other.

    The columns ``carried`` go through as they are, so that nothing need be joined to the answers.
    Rows of an Arrow batch are asked concurrently, at most ``in_flight`` in each task. Write the result before using it
    twice: a generator need not answer the same again.
    """

    async def ask(gate: asyncio.Semaphore, prompt: str | None) -> tuple[str | None, str | None]:
        async with gate:
            try:
                return await generator(prompt or ""), None
            except ServiceError as e:
                return f"{SERVICE_ERROR} {e}", str(e)
            except Exception as e:
                return f"{OTHER_ERROR} {e}", str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:

            async def everything(asked: list) -> list:
                gate = asyncio.Semaphore(in_flight)
                return await asyncio.gather(*[ask(gate, p) for p in asked])

            answers = asyncio.run(everything(batch["prompt"].tolist()))
            made = pd.DataFrame({"query_id": batch["query_id"], "answer": [a for a, _ in answers], "error": [e for _, e in answers]})
            yield pd.concat([made, batch[list(carried)]], axis=1)

    kept = prompts.select("query_id", "prompt", *carried)
    schema = T.StructType([*T._parse_datatype_string("query_id bigint, answer string, error string").fields, *[kept.schema[c] for c in carried]])
    return kept.mapInPandas(run, schema)


def parsed_response(raw: Column | str) -> Column:
    """The answer inside a service's JSON; an error value where it has none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.get_json_object(raw, "$.response"), F.lit(f"{OTHER_ERROR} 'response'"))


def reply_or(raw: Column | str, default: str = "{}", blank: bool = False) -> Column:
    """A judge's reply, or ``default`` for a null or empty one; with ``blank`` also for one of white space."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    seen = F.trim(raw) if blank else raw
    return F.when(raw.isNull() | (seen == ""), F.lit(default)).otherwise(raw)


def stub_judge(query: str, answer: str, contexts: list[str]) -> dict[str, float]:
    """A deterministic stand-in for a judge: scores from checksums."""
    return {"faithfulness": zlib.crc32(answer.encode()) % 101 / 100, "relevancy": zlib.crc32(f"{query}\n{answer}".encode()) % 101 / 100}


def judged(samples: DataFrame, name: str, judge: Judge = stub_judge) -> DataFrame:
    """Adds a struct ``name`` of faithfulness, relevancy and error; an exception nulls both scores and leaves its text, and
    NaN counts as null. Other columns and rows are untouched."""

    def run(queries: pd.Series, answers: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = []
        for q, a, c in zip(queries, answers, contexts):
            try:
                scores = judge(q or "", a or "", [x for x in c if x is not None] if c is not None else [])
                clean = {k: None if v is None or v != v else float(v) for k, v in scores.items()}
                rows.append((clean["faithfulness"], clean["relevancy"], None))
            except Exception as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["faithfulness", "relevancy", "error"])

    scored = F.pandas_udf(run, "faithfulness double, relevancy double, error string").asNondeterministic()
    return samples.withColumn(name, scored("query", "answer", "contexts"))


#: Seconds that a judge may take for one reply, and how often it is asked.
JUDGE_TIMEOUT, JUDGE_ATTEMPTS = 120.0, 3
#: What stands for a blank reply of either judge.
NO_REPLY, NO_CLAIMS = "{}", '{"claims": []}'


class JsonModel:
    """A language model that is made to answer in JSON: any function from a prompt to a text, with a name.

    ``generate`` asks again after a failure or a reply that is no JSON, at most ``attempts`` times with growing pauses, and
    gives up on a reply after ``timeout`` seconds. ``generate_prompts`` gives one reply a prompt, and ``agenerate`` is the
    same without blocking. A blank reply is the ``default``.
    """

    def __init__(self, ask: Callable[[str], str], name: str = "model", timeout: float = JUDGE_TIMEOUT, attempts: int = JUDGE_ATTEMPTS, default: str = NO_REPLY, pause: float = 0.5):
        self.ask, self.name, self.timeout, self.attempts, self.default, self.pause = ask, name, timeout, attempts, default, pause

    def get_model_name(self) -> str:
        return self.name

    def load_model(self) -> JsonModel:
        return self

    @staticmethod
    def wrapped(prompt: str) -> str:
        """The prompt with the demand for JSON and nothing else."""
        return f"{prompt}\n\nReply with one valid JSON object. Write no other text, no explanation and no code fence."

    @staticmethod
    def json_of(reply: str) -> str | None:
        """The JSON inside a reply, which models like to put into a fence or behind words; None without one."""
        start, end = reply.find("{"), reply.rfind("}")
        try:
            json.loads(reply[start : end + 1])
        except ValueError:
            return None
        return reply[start : end + 1]

    def generate(self, prompt: str) -> str:
        failure: Exception | None = None
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                reply = self._in_time(self.wrapped(prompt))
            except Exception as e:
                failure = e
                continue
            if not reply.strip():
                return self.default
            found = self.json_of(reply)
            if found is not None:
                return found
            failure = ValueError("the reply is no JSON")
        raise ServiceError(f"no reply in {self.attempts} attempts: {failure}") from failure

    def _in_time(self, prompt: str) -> str:
        """The reply, or a failure when it takes too long; the thread that waits for it ends with the process."""
        got: queue.Queue = queue.Queue()

        def run() -> None:
            try:
                got.put((self.ask(prompt) or "", None))
            except Exception as e:
                got.put(("", e))

        threading.Thread(target=run, daemon=True).start()
        try:
            reply, failure = got.get(timeout=self.timeout)
        except queue.Empty:
            raise TimeoutError(f"no reply in {self.timeout} s") from None
        if failure is not None:
            raise failure
        return reply

    def generate_prompts(self, prompts: list[str]) -> list[str]:
        return [self.generate(p) for p in prompts]

    async def agenerate(self, prompt: str) -> str:
        return await asyncio.to_thread(self.generate, prompt)

    async def agenerate_prompts(self, prompts: list[str]) -> list[str]:
        return list(await asyncio.gather(*[self.agenerate(p) for p in prompts]))


class ModelJudge:
    """Faithfulness and relevancy of an answer by a model: the statements of the answer with a verdict each, once against the
    contexts and once against the question; a score is the share of true verdicts, none without a statement. It is a
    ``Judge``, so a failure of a row becomes its error."""

    def __init__(self, model: JsonModel):
        self.model = model

    def __call__(self, query: str, answer: str, contexts: list[str]) -> dict[str, float | None]:
        given = "\n".join(f"{i}. {c}" for i, c in enumerate(contexts, 1)) or "none"
        task = 'List every statement of the answer as {"claims": [{"text": "...", "verdict": true or false}]}. The verdict is true if '
        return {
            "faithfulness": self._share(f"{task}the contexts support the statement.\n\nContexts:\n{given}\n\nAnswer:\n{answer}"),
            "relevancy": self._share(f"{task}the statement helps to answer the question.\n\nQuestion:\n{query}\n\nAnswer:\n{answer}"),
        }

    def _share(self, prompt: str) -> float | None:
        claims = json.loads(self.model.generate(prompt)).get("claims") or []
        verdicts = [c.get("verdict") is True for c in claims if isinstance(c, dict)]
        return sum(verdicts) / len(verdicts) if verdicts else None
