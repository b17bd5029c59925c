import asyncio
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import evaluation, generation, retrieval


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (301, [0.0, 1.0])]
    rows[7] = (7, rows[3][1])
    corpus = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3)
    queries = spark.createDataFrame(rows[:60:3], "query_id bigint, vector array<double>")
    matrix = np.array([v for _, v in rows[:300]])
    for metric in ("l2", "cosine"):
        for block in (32 << 20, 500):
            got = {}
            for r in retrieval.nearest(corpus, queries, 4, metric, block).collect():
                got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
            for q, v in rows[:60:3]:
                v = np.array(v)
                d = ((matrix - v) ** 2).sum(1) if metric == "l2" else 1 - matrix @ v / np.linalg.norm(matrix, axis=1) / np.linalg.norm(v)
                expected = np.lexsort((np.arange(300), np.round(d, 9)))[:4].tolist()
                assert sorted([got[q][k] for k in (1, 2, 3, 4)]) == sorted(expected)
    none = spark.createDataFrame([], "query_id bigint, vector array<double>")
    assert retrieval.nearest(corpus, none).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(0, "Eisen und Zink"), (1, "eisen, UND zink!"), (2, ""), (3, None)], "i int, text string")
    v = [r["v"] for r in df.select("i", retrieval.hash_embedding("text").alias("v")).orderBy("i").collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and set(v[2]) == set(v[3]) == {0.0}


def test_prompt(spark):
    df = spark.createDataFrame([(0, "Q?", ["c1", "c2"]), (1, "Q?", []), (2, None, None)], "i int, query string, contexts array<string>")
    p = [r["p"].split("\n") for r in df.select("i", retrieval.prompt("query", "contexts").alias("p")).orderBy("i").collect()]
    assert len(p[0]) == 10 and p[0][3] == "Frage: Q?" and p[0][6:8] == ["1. c1", "2. c2"] and len(p[1]) == len(p[2]) == 8


def test_batches_and_progress(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(39)], "query_id bigint")
    rows = retrieval.batches_of(df).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 40))
    assert sorted({(r["first_row"], r["last_row"]) for r in rows}) == [(1, 10), (11, 20), (21, 30), (31, 39)]
    per = spark.createDataFrame([(1, 10, 1.0), (2, 10, 0.0), (3, 10, 1.0), (4, 9, 2.0)], "batch_no bigint, n bigint, seconds double")
    done = retrieval.progress(per).orderBy("batch_no").collect()
    assert [r["percent"] for r in done] == [25, 51, 76, 100] and done[0]["rate"] == 10 and done[-1]["eta"] == 0
    assert retrieval.batches_of(df.where("query_id < 0")).count() == 0


def test_generation_failures(spark):
    async def moody(prompt):
        if prompt == "a":
            raise generation.ServiceError("down")
        if prompt == "b":
            raise KeyError("response")
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "query_id bigint, prompt string")
    got = {r["query_id"]: r for r in generation.generate(df, moody).collect()}
    assert got[1]["answer"].startswith(generation.SERVICE_ERROR) and got[2]["answer"].startswith(generation.OTHER_ERROR)
    assert got[3]["answer"] == "C" and got[3]["error"] is None and got[4]["answer"] == ""


def test_judges(spark):
    def moody(query, answer, contexts):
        if answer == "x":
            raise ValueError("no")
        return {"faithfulness": float("nan"), "relevancy": 0.5}

    df = spark.createDataFrame([(1, "q", "x", ["c"]), (2, "q", "50 g", None), (3, None, None, [])], "query_id bigint, query string, answer string, contexts array<string>")
    got = {r["query_id"]: r for r in evaluation.evaluated(df, moody, generation.stub_judge).collect()}
    assert got[1]["judge_a_scores"]["faithfulness"] is None and got[1]["judge_a_scores"]["error"] == "no" and got[1]["judge_b_scores"]["error"] is None
    assert got[2]["judge_a_scores"]["faithfulness"] is None and got[2]["judge_a_scores"]["relevancy"] == 0.5
    assert got[2]["custom_scores"]["numerical_correctness"] == 1.0 and got[2]["custom_scores"]["unsupported_precision"] == 1.0
    assert got[3]["custom_scores"]["numerical_correctness"] == 0.0


def test_rules(spark):
    cases = [("no digits", 0.0), ("75 g", 1.0), ("1.5 mg", 0.0), ("-60", 1.0), ("007 und 80", 0.0), ("50", 1.0), ("100", 1.0), ("101", 0.0), ("9" * 45, 0.0), (None, 0.0)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, answer string")
    assert [r["s"] for r in df.select("i", evaluation.numerical_correctness("answer").alias("s")).orderBy("i").collect()] == [s for _, s in cases]
    pairs = [("75 g", ["none"], 1.0), ("75 g", ["a", "year 2020"], 0.0), ("75 g", [], 1.0), ("none", [], 0.0), ("75", None, 1.0)]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(pairs)], "i int, answer string, contexts array<string>")
    assert [r["s"] for r in df.select("i", evaluation.unsupported_precision("answer", "contexts").alias("s")).orderBy("i").collect()] == [s for *_, s in pairs]
    verdicts = spark.createDataFrame([(0, [True, False]), (1, []), (2, [None, True]), (3, None)], "i int, v array<boolean>")
    assert [r["s"] for r in verdicts.select("i", evaluation.supported_share("v").alias("s")).orderBy("i").collect()] == [0.5, None, 0.5, None]
    nan = spark.range(1).select(evaluation.nan_to_null(F.lit(float("nan"))).alias("a"), evaluation.nan_to_null(F.lit(2.0)).alias("b")).first()
    assert nan["a"] is None and nan["b"] == 2.0


def test_replies(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "  "), (3, '{"response": "ja"}'), (4, "{}"), (5, "kein json")], "i int, raw string")
    rows = df.select("i", generation.parsed_response("raw").alias("p"), generation.reply_or("raw").alias("a"), generation.reply_or("raw", "[]", True).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in rows][:3] == ["{}", "{}", "  "] and [r["b"] for r in rows][:3] == ["[]"] * 3
    assert rows[3]["p"] == "ja" and all(r["p"].startswith(generation.OTHER_ERROR) for r in rows if r["i"] != 3)


def test_nearest_keeps_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(200)] + [(200, [None, 1.0]), (201, [float("nan"), 0.0]), (202, [])]
    corpus = spark.createDataFrame(rows, "id bigint, vector array<double>").coalesce(1)
    got = retrieval.nearest(corpus, spark.createDataFrame([(9, [0.0, 0.0])], "query_id bigint, vector array<double>"), 5).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, 0), (2, 3), (3, 6), (4, 9), (5, 12)]


def test_json_model():
    asked = []

    def moody(prompt):
        asked.append(prompt)
        if len(asked) == 1:
            raise OSError("down")
        return "no json" if len(asked) == 2 else '```json\n{"claims": [{"text": "a", "verdict": true}, {"text": "b", "verdict": false}]}\n```'

    model = generation.JsonModel(moody, "m", pause=0)
    assert json.loads(model.generate("x"))["claims"][0]["verdict"] is True and len(asked) == 3 and "JSON" in asked[0] and model.get_model_name() == "m" and model.load_model() is model
    assert generation.ModelJudge(model)("q", "a b", ["c"]) == {"faithfulness": 0.5, "relevancy": 0.5}
    blank = generation.JsonModel(lambda prompt: "  ", default=generation.NO_CLAIMS)
    assert blank.generate_prompts(["a", "b"]) == [generation.NO_CLAIMS] * 2 and generation.ModelJudge(blank)("q", "a", []) == {"faithfulness": None, "relevancy": None}
    assert asyncio.run(blank.agenerate_prompts(["a"])) == [generation.NO_CLAIMS]
    tries = []
    slow = generation.JsonModel(lambda prompt: tries.append(1) or time.sleep(5) or "{}", timeout=0.05, attempts=3, pause=0)
    with pytest.raises(generation.ServiceError, match="3 attempts"):
        slow.generate("x")
    assert len(tries) == 3


def test_model_judge_in_spark(spark):
    def ask(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return '{"claims": [{"verdict": true}]}'

    judge = generation.ModelJudge(generation.JsonModel(ask, attempts=2, pause=0))
    df = spark.createDataFrame([(1, "q", "good", ["c"]), (2, "q", "bad", None)], "query_id bigint, query string, answer string, contexts array<string>")
    got = {r["query_id"]: r["j"] for r in generation.judged(df, "j", judge).collect()}
    assert got[1]["faithfulness"] == 1.0 and got[1]["error"] is None and got[2]["relevancy"] is None and "down" in got[2]["error"]
