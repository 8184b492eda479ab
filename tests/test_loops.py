"""Loops whose models or transports do not say the same thing twice."""

import random

from pyspark.sql import functions as F

from weftline.config import Agent, Config
from weftline.operators import agent, frontier
from weftline.sources.models import ExtractiveLlm


class Coin(ExtractiveLlm):
    """A judge that answers anew each time."""

    def relevant(self, question, text):
        return random.SystemRandom().choice(["yes", "no"])

    def grounded(self, answer, context):
        return random.SystemRandom().choice(["grounded", "hallucinated"])


class Remembers(ExtractiveLlm):
    def answer(self, question, context, prompt="", history=()):
        return f"{len(history)}|{prompt.splitlines()[0]}|{len(context)}"

    def grounded(self, answer, context):
        return "grounded"


def found(rows):
    return rows.select("query_id", F.lit(1).alias("rank"), F.lit("some text").alias("text"), F.lit("http://e.com").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("section"), F.lit(0.5).alias("score"))


def test_every_question_is_answered_once(spark):
    q = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("some question "), "id").alias("question"))
    out = agent.answer_questions(q, found, Coin())
    assert sorted(r.query_id for r in out.collect()) == list(range(200))
    again = out.select("query_id", "answer", "rewrite_count", "hallucination_grade")
    assert sorted(map(str, again.collect())) == sorted(map(str, again.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30


def test_answers_see_the_context_block_and_the_last_messages(spark):
    past = [("user", str(i)) for i in range(7)]
    q = spark.createDataFrame([(1, "some text", past), (2, "some text", None)], f"query_id long, question string, history array<{agent.MESSAGE}>")
    got = {r.query_id: r for r in agent.answer_questions(q, found, Remembers(), Agent(generation_messages=4)).collect()}
    assert got[1].answer == "4|[1] Source: t|1" and got[2].answer == "0|[1] Source: t|1"
    assert len(got[1].history) == 9 and len(got[2].history) == 2


def test_a_page_is_fetched_once(spark):
    fetches = spark.sparkContext.accumulator(0)
    links = {"/": ["/a", "/b"], "/a": ["/c", "/b"], "/b": ["/"], "/c": []}

    def expand(rows):
        def run(batches):
            for batch in batches:
                out = []
                for order, url in zip(batch["pop_order"], batch["url"]):
                    fetches.add(1)
                    out += [(order, i, f"http://e.com{x}", "") for i, x in enumerate(links[url.removeprefix("http://e.com")])]
                yield pd.DataFrame(out, columns=["pop_order", "pos", "url", "anchor_text"])

        import pandas as pd

        return rows.select("pop_order", "url").mapInPandas(run, "pop_order long, pos int, url string, anchor_text string")

    seen = []
    pops, enqueued, counters = frontier.crawl(spark, ["http://e.com/"], expand, Config(), progress=seen.append)
    assert pops.count() == 4 and fetches.value == 4 and counters["popped"] == 4
    assert [x["depth"] for x in seen] == [0, 1, 2] and enqueued.count() == counters["enqueued"]


def test_queue_places_do_not_run_over(spark):
    rows = spark.range(1).select(frontier._place(3, F.lit(1 << 40), F.lit(1 << 30)).alias("a"), frontier._place(3, F.lit((1 << 40) + 1), F.lit(0)).alias("b"), frontier._place(4, F.lit(0), F.lit(0)).alias("c"))
    assert rows.select((F.col("a") < F.col("b")) & (F.col("b") < F.col("c"))).first()[0]


def test_busy_host_is_scheduled_in_parts(spark):
    n = 5000
    rows = spark.range(0, n, 1, 8).select(F.lit("h").alias("host"), "id", (F.col("id") * 7919 % 3000).alias("t"))
    got = {r.id: r.starts for r in frontier.schedule(rows, 2, "host", "t", "id").collect()}
    at = None
    for i in range(n):
        t = i * 7919 % 3000
        at = t if at is None else max(t, at + 2)
        assert got[i] == at
