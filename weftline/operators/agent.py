"""Answering questions in bounded rounds: retrieve, grade, rewrite at most twice, answer, check, remember.

One row per question; documents are an array in rank order. Models are injected and run in Arrow batches; every
decision around them is an expression.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import Agent
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.sources.models import ExtractiveLlm, Llm
from weftline.sources.scratch import Scratch

DOC = "struct<rank:int,text:string,url:string,title:string,section:string,score:double>"
MESSAGE = "struct<role:string,content:string>"
# fixed values
NO_ANSWER = "I don't have enough information to answer this question."
NO_ANSWER_HI = "मुझे इस प्रश्न का उत्तर देने के लिए पर्याप्त जानकारी नहीं मिली।"
ANSWER_FAILED = "Sorry, I encountered an error generating the answer. Please try again."
INTENTS = ("factual", "eligibility", "procedural", "comparison")


def citation_dedup(docs: DataFrame, query: str = "query_id", rank: str = "rank", url: str = "url") -> DataFrame:
    """G-7: per question the first document of each citation key."""
    order = Window.partitionBy(query, "__key").orderBy(rank)
    keyed = docs.withColumn("__key", U.citation_key(F.coalesce(F.col(url), F.lit(""))))
    return keyed.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__key")


def _deduped(docs: Column) -> Column:
    """G-7 inside an array."""
    keys = F.transform(docs, lambda d: U.citation_key(F.coalesce(d["url"], F.lit(""))))
    return F.filter(docs, lambda d, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def context_block(docs: Column) -> Column:
    """G-8."""
    def part(d, i):
        name = F.coalesce(F.nullif(d["title"], F.lit("")), d["url"])
        return F.format_string("[%d] Source: %s\nURL: %s\nSection: %s\n\n%s", i + 1, name, d["url"], F.coalesce(d["section"], F.lit("")), d["text"])

    return F.array_join(F.transform(docs, part), "\n\n---\n\n")


def citations(docs: Column) -> Column:
    """G-9: index, url, title, section and score of each document."""
    return F.transform(docs, lambda d, i: F.struct((i + 1).alias("index"), F.coalesce(d["url"], F.lit("")).alias("url"), F.coalesce(d["title"], F.lit("")).alias("title"), F.coalesce(d["section"], F.lit("")).alias("section"), F.coalesce(d["score"], F.lit(0.0)).alias("score")))


def remembered(messages: DataFrame, most: int = 20, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """G-13 over rows: the last `most` messages of each conversation."""
    last = Window.partitionBy(conv).orderBy(F.desc(turn))
    return messages.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= most).drop("__r")


def memory(history: Column, question: Column, answer: Column, most: int = 20) -> Column:
    """G-13 inside an array: the exchange appended, the oldest messages dropped."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    both = F.concat(F.coalesce(history, F.array().cast(f"array<{MESSAGE}>")), F.array(said("user", question), said("assistant", answer)))
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)


def analyzed(questions: DataFrame, llm: Llm = ExtractiveLlm(), config: Agent = Agent()) -> DataFrame:
    """G-0 to G-3: initial state with language and intent; an intent outside the known ones is factual."""

    @F.pandas_udf("string")
    def intent(q: pd.Series) -> pd.Series:
        llm.load(config)
        return q.map(lambda x: llm.intent(x).strip().lower())

    found = intent.asNondeterministic()("question")
    state = questions.withColumn("rewritten", F.col("question")).withColumn("rewrite_count", F.lit(0)).withColumn("language", T.language_of(F.col("question"))).withColumn("intent", found)
    state = state.withColumn("intent", F.when(F.col("intent").isin(*INTENTS), F.col("intent")).otherwise("factual"))
    return state if "history" in questions.columns else state.withColumn("history", F.array().cast(f"array<{MESSAGE}>"))


def graded(state: DataFrame, llm: Llm, config: Agent) -> DataFrame:
    """G-5: documents whose first 400 characters the judge finds relevant; sufficient from config.min_relevant on. A judge that fails keeps the document."""

    @F.pandas_udf("array<boolean>")
    def keep(q: pd.Series, texts: pd.Series) -> pd.Series:
        llm.load(config)

        def one(question, text):
            try:
                return "yes" in llm.relevant(question, (text or "")[:400]).lower()
            except Exception:
                return True

        return pd.Series([[one(a, t) for t in b] for a, b in zip(q, texts)])

    rows = state.withColumn("__k", keep.asNondeterministic()("rewritten", F.transform("docs", lambda d: d["text"])))
    rows = rows.withColumn("relevant", F.filter("docs", lambda d, i: F.get(F.col("__k"), i))).drop("__k")
    return rows.withColumn("sufficient", F.size("relevant") >= config.min_relevant)


def rewritten(state: DataFrame, llm: Llm, config: Agent) -> DataFrame:
    """G-6: the first line of the rewriter's reply without quotes; a failure keeps the question."""

    @F.pandas_udf("string")
    def again(q: pd.Series, now: pd.Series, history: pd.Series) -> pd.Series:
        llm.load(config)

        def one(question, current, past):
            try:
                return llm.rewrite(question, [(m["role"], m["content"]) for m in (past if past is not None else [])][-2:])
            except Exception:
                return current

        return pd.Series([one(*x) for x in zip(q, now, history)])

    first = F.trim(F.split(T.strip(again.asNondeterministic()("question", "rewritten", "history")), "\n", 2)[0])
    return state.withColumn("rewritten", F.regexp_replace(first, "^[\"']+|[\"']+$", "")).withColumn("rewrite_count", F.col("rewrite_count") + 1)


def answered(state: DataFrame, llm: Llm, config: Agent) -> DataFrame:
    """G-7 to G-12, G-15: answer with citations, check it against its sources, answer once more if it does not hold, grade it."""

    @F.pandas_udf("struct<answer:string,grounded:string,answers:string,regenerated:int>")
    def reply(q: pd.Series, texts: pd.Series, prompts: pd.Series, history: pd.Series, nothing: pd.Series) -> pd.DataFrame:
        llm.load(config)
        rows = []
        for question, context, prompt, past, none in zip(q, texts, prompts, history, nothing):
            context = list(context)
            said = [(m["role"], m["content"]) for m in (past if past is not None else [])][-config.generation_messages :]
            tries, grounded = 0, "grounded"
            if not context:
                answer = none
            else:
                while True:
                    try:
                        answer = llm.answer(question, context, prompt, said).strip()
                    except Exception:
                        answer = ANSWER_FAILED
                    try:
                        grounded = llm.grounded(answer[:500], [c[:300] for c in context[:3]]) if answer else "grounded"
                    except Exception:
                        grounded = "grounded"
                    if grounded == "grounded" or tries >= config.max_regenerations:
                        break
                    tries += 1
            try:
                good = "answers" if not answer else "answers" if llm.answers(question, answer[:400]) == "yes" else "does_not_answer"
            except Exception:
                good = "answers"
            rows.append((answer, grounded, good if answer else "does_not_answer", tries))
        return pd.DataFrame(rows, columns=["answer", "grounded", "answers", "regenerated"])

    docs = F.when(F.size("relevant") > 0, F.col("relevant")).otherwise(F.col("docs"))
    rows = state.withColumn("used", _deduped(docs) if config.dedup else docs)
    none = F.when(F.lit(config.language_aware) & (F.col("language") == "hi"), NO_ANSWER_HI).otherwise(NO_ANSWER)
    rows = rows.withColumn("context", context_block(F.col("used")))
    texts = F.transform("used", lambda d: d["text"])
    rows = rows.withColumn("__a", reply.asNondeterministic()("question", texts, "context", "history", none))
    rows = rows.withColumn("sources", citations(F.col("used")))
    return rows.select("*", "__a.answer", F.col("__a.grounded").alias("hallucination_grade"), F.col("__a.answers").alias("answer_grade"), F.col("__a.regenerated").alias("regen_count")).drop("__a")


def answer_questions(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: Llm = ExtractiveLlm(), config: Agent = Agent()) -> DataFrame:
    """G-16: the whole loop for all questions (query_id, question, history optional).

    retrieve: takes (query_id, rewritten) rows and returns (query_id, rank, text, url, title, section, score). After
    each round only the questions with too little go on to be rewritten (G-14); the rounds are united before answering.
    Every round, and the answers, are written before they are read twice, so that each model is asked once and a question
    goes one way only, whatever the models say."""
    scratch = Scratch()
    waiting, settled = scratch.cut(analyzed(questions, llm, config)), None
    for turn in range(config.max_rewrites + 1):
        found = retrieve(waiting.select("query_id", "rewritten"))
        row = F.struct(F.col("rank").cast("int").alias("rank"), "text", "url", "title", "section", F.col("score").cast("double").alias("score"))
        per = found.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("docs"))
        state = waiting.join(per, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast(f"array<{DOC}>")))
        state = scratch.cut(graded(state, llm, config))
        last = turn == config.max_rewrites or state.where("NOT sufficient").isEmpty()
        done = state if last else state.where("sufficient")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        waiting = scratch.cut(rewritten(state.where("NOT sufficient"), llm, config).drop("docs", "relevant", "sufficient"))
    rows = answered(settled, llm, config)
    out = scratch.cut(rows.withColumn("history", memory(F.col("history"), F.col("question"), F.col("answer"), config.memory_messages)))
    scratch.keep(out)
    return out
