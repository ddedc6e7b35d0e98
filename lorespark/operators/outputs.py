"""Model outputs and chat responses: cleaning, parsing, checks, components, batch calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorespark.functions.scalars import error_class, slugify, strip

_OPTIONS = {"allowSingleQuotes": "false"}
ITEM = "struct<chunk_id:string,topic:string,summary:string,triggers:array<string>,has_conditions:boolean,status:string,context:string,conditions:string,constraints:string,response:string>"
_CLOSE = {"[": "]", "{": "}"}


def clean_output(raw: str | None) -> str | None:
    """A model's text without code fences, from its first bracket to that one's end, without trailing commas."""
    if raw is None:
        return None
    text = re.sub(r"```\s*", "", re.sub(r"(?i)```json\s*", "", raw)).strip()
    start = re.search(r"[\[{]", text)
    if not start:
        return text
    text = text[start.start() :]
    depth = 0
    # strings whole, so that brackets in them don't count
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', text, re.S):
        if m[0] == text[0]:
            depth += 1
        elif m[0] == _CLOSE[text[0]]:
            depth -= 1
            if not depth:
                text = text[: m.end()].strip()
                break
    return re.sub(r",\s*\]", "]", re.sub(r",\s*}", "}", text))


def _cleaned() -> Callable:
    """A column function over Arrow arrays: only the raw texts go to the Python worker."""
    return F.arrow_udf(lambda raw: pa.array([clean_output(x.as_py()) for x in raw], pa.string()), "string").asNondeterministic()


def clean_outputs(raw: DataFrame) -> DataFrame:
    """``raw`` with ``cleaned`` and ``ok``: whether that is JSON."""
    x = raw.withColumn("cleaned", _cleaned()(F.col("raw")))
    return x.withColumn("ok", F.try_parse_json("cleaned").isNotNull())


def parse_model_output(raw: DataFrame) -> DataFrame:
    """One row per item, with its position; an object counts as an array of one, unparseable texts give none."""
    many = F.from_json("cleaned", f"array<{ITEM}>", _OPTIONS)
    one = F.when(F.col("cleaned").startswith("{"), F.array(F.from_json("cleaned", ITEM, _OPTIONS)))
    items = F.when(F.col("cleaned").startswith("["), many).otherwise(one)
    x = clean_outputs(raw).drop("ok")
    return x.select(*raw.columns, F.posexplode(items).alias("position", "item")).where("item is not null and item.chunk_id is not null")


def quarantine_outputs(raw: DataFrame, n: int = 500) -> DataFrame:
    """Texts that give no item, with their first characters."""
    x = clean_outputs(raw).drop("ok")
    kind = F.when(F.col("cleaned").startswith("["), F.from_json("cleaned", f"array<{ITEM}>", _OPTIONS)).when(F.col("cleaned").startswith("{"), F.array(F.from_json("cleaned", ITEM, _OPTIONS)))
    bad = kind.isNull() | F.exists(kind, lambda i: i.isNull() | i["chunk_id"].isNull())
    return x.where(bad).select(*raw.columns, F.left("cleaned", F.lit(n)).alias("preview"))


def item_issues(item: str = "item") -> Column:
    """What is wrong with an item; empty if nothing."""
    f = lambda n: F.col(f"{item}.{n}")
    empty = lambda n: F.when(F.coalesce(f(n), F.lit("")) == "", F.lit(n))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(f("chunk_id"), F.lit("")).rlike("^[a-z0-9-]+$"), F.lit("chunk_id")),
            empty("topic"),
            empty("summary"),
            F.when(F.coalesce(F.size(f("triggers")), F.lit(0)) < 1, F.lit("triggers")),
            F.when(f("has_conditions").isNull(), F.lit("has_conditions")),
            F.when(~F.coalesce(f("status"), F.lit("active")).isin("active", "review", "deprecated"), F.lit("status")),
            empty("context"),
            empty("response"),
        )
    )


def flag_missing_conditions(items: DataFrame) -> DataFrame:
    """``status`` of items: review where conditions are said to exist but don't."""
    missing = F.col("item.has_conditions") & (F.coalesce("item.conditions", F.lit("")) == "")
    return items.withColumn("status", F.when(missing, "review").otherwise(F.coalesce("item.status", F.lit("active"))))


def render(template: str, values: dict[str, Column]) -> Column:
    """Literals and columns of a template cut at ``{{KEY}}``, in one pass; an unknown key is empty."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(values.get(p, F.lit("")), F.lit("")) for k, p in enumerate(parts)])


def segment_prompts(segs: DataFrame, template: str) -> DataFrame:
    """``segs(heading_path, page_start, page_end, content, ...)`` with ``prompt``: HEADING, PAGES and CONTENT put in."""
    pages = F.concat(F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string"))
    return segs.withColumn("prompt", render(template, {"HEADING": F.array_join("heading_path", " › "), "PAGES": pages, "CONTENT": F.col("content")}))


Model = Callable[[list[str]], list[str]]
CALLED = StructType([StructField("raw", StringType()), StructField("failure", StringType())])


HELD = 512  # outputs that a task holds at once, before they go back to Spark


def called(prompt: Column, model: Model | None = None, load: Callable[[], Model] | None = None, batch: int = 64, tries: int = 2) -> Column:
    """A model function over ``prompt`` in batches: a struct of ``raw`` and ``failure``, one of which is null; only prompts go to Python.

    ``load`` gives the function, once a task. In a batch that fails, each prompt is tried by itself,
    ``tries`` times; what then fails has its error's type and text in ``failure``. A null prompt isn't asked.
    """
    if (model is None) == (load is None):
        raise ValueError("give either a model function or one that loads it")

    def one(ask: Model, text: str) -> tuple[str | None, str | None]:
        for k in range(tries):
            try:
                return ask([text])[0], None
            except Exception as e:  # noqa: BLE001  the caller's function: one bad prompt doesn't cost the others
                if k == tries - 1:
                    return None, f"{type(e).__name__}: {e}"
        return None, None

    def some(ask: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = list(ask(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} outputs for {len(texts)} prompts")
            return [(g, None) for g in got]
        except Exception:  # noqa: BLE001
            return [one(ask, t) for t in texts]

    @F.pandas_udf(CALLED)
    def ask_all(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = load() if load else model
        for series in prompts:
            for at in range(0, len(series), HELD):
                part = series.iloc[at : at + HELD]
                texts = part.dropna()
                told = [r for k in range(0, len(texts), batch) for r in some(ask, texts.iloc[k : k + batch].tolist())]
                yield pd.DataFrame(told, columns=["raw", "failure"], index=texts.index, dtype=object).reindex(part.index).astype(object).where(lambda x: x.notna(), None)

    return ask_all.asNondeterministic()(prompt)


def extract_chunks(segs: DataFrame, model: Model | None = None, batch: int = 64, document: str | None = None, load: Callable[[], Model] | None = None, tries: int = 2) -> DataFrame:
    """A model function (``called``) applied to ``prompt``: the segments' other columns, ``raw`` and ``failure``.

    ``document``: a column whose text each call carries before the prompt (procedures; questions and
    answers are read from the segment alone).
    """
    prompt = F.col("prompt") if document is None else F.concat(F.coalesce(F.col(document), F.lit("")), F.lit("\n\n"), F.col("prompt"))
    x = segs.withColumn("called", called(prompt, model, load, batch, tries))
    return x.select(*[c for c in segs.columns if c != "prompt"], "called.raw", "called.failure")


def extraction_failures(extracted: DataFrame) -> DataFrame:
    """The segments whose call failed, with why."""
    return extracted.where("failure is not null").drop("raw")


def extract_qna(segs: DataFrame, per: str = "section") -> DataFrame:
    """Chunks of ``segs(source, heading, content)`` that hold questions: lines that end in a question mark.

    One for each section, ``{topic-slug}-overview``, with every question as a trigger and the
    answers in order under ``### question``; or (``per="question"``) one for each question.
    What stands before the first question is the chunk's context.
    """
    x = segs.withColumn("lines", F.filter(F.transform(F.split("content", "\n"), strip), lambda s: s != ""))
    x = x.withColumn("asks", F.array_compact(F.transform("lines", lambda s, i: F.when(s.rlike(r"\?$"), i + 1)))).where(F.size("asks") > 0)
    until = lambda k: F.coalesce(F.get("asks", k + 1), F.size("lines") + 1)
    told = F.transform("asks", lambda s, k: F.struct(F.get("lines", s - 1).alias("question"), F.array_join(F.slice("lines", s + 1, until(k) - s - 1), "\n").alias("answer")))
    first = F.array_join(F.filter(F.slice("lines", F.lit(1), F.get("asks", F.lit(0)) - 1), lambda s: s != F.col("heading")), "\n")
    x = x.withColumn("qna", told).withColumn("context", first).drop("lines", "asks")
    block = lambda q: F.concat(F.lit("### "), q["question"], F.lit("\n"), q["answer"])
    if per == "question":
        x = x.select("source", "heading", "context", F.posexplode_outer("qna").alias("position", "q"))
        return x.select("source", slugify(F.col("q.question")).alias("chunk_id"), F.col("heading").alias("topic"), "position", F.array("q.question").alias("triggers"), "context", block(F.col("q")).alias("response"))
    triggers, response = F.transform("qna", lambda q: q["question"]), F.array_join(F.transform("qna", block), "\n\n")
    return x.select("source", F.concat(slugify(F.col("heading")), F.lit("-overview")).alias("chunk_id"), F.col("heading").alias("topic"), F.lit(0).alias("position"), triggers.alias("triggers"), "context", response.alias("response"))


#: What a chat says without saying anything, sentence by sentence, and what names a person or an account.
PLEASANTRY = r"(?i)^\W*(hi|hello|hey|thanks|thank you|many thanks|you're welcome|you are welcome|happy to help|glad to help|my pleasure|good (morning|afternoon|evening)|(kind|best) regards|have a (nice|great|good) day)\b.*$"
PERSONAL = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]"),
    (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "[address]"),
    (r"\+?[0-9(][0-9() -]{6,}[0-9]", "[number]"),
    (r"(?i)(#|\b(ticket|case|order|account)\s+(no\.?\s*)?)[0-9]{3,}", "[reference]"),
    (r"\b(Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{L}+([ -]\p{Lu}\p{L}+)*", "[name]"),
    # who somebody says to be, is greeted as, or signs as
    (r"\b((?i:my name is|i am called|ich heiße|mein name ist|je m.appelle|me llamo|mi nombre es)) \p{Lu}\p{L}+([ -]\p{Lu}\p{L}+)*", "$1 [name]"),
    (r"\b((?i:this is|here is|it is|i am|i.m)) \p{Lu}\p{L}+([ -]\p{Lu}\p{L}+)* ((?i:from|of|speaking|here|calling|writing))\b", "$1 [name] $3"),
    (r"\b((?i:hi|hello|hey|dear|hallo|liebe|lieber|bonjour|hola)) \p{Lu}\p{L}+([ -]\p{Lu}\p{L}+)*([,!:])", "$1 [name]$3"),
    (r"\b((?i:regards|cheers|sincerely|grüße|saludos|cordialement|yours)),?\s+\p{Lu}\p{L}+([ -]\p{Lu}\p{L}+)*", "$1, [name]"),
]


def without_personal(c: Column) -> Column:
    for pattern, name in PERSONAL:
        c = F.regexp_replace(c, pattern, F.lit(name))
    return c


def without_pleasantries(c: Column) -> Column:
    """Sentences that say nothing are left out."""
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), "\n"), lambda s: ~s.rlike(PLEASANTRY) & (strip(s) != "")), " ")


def extract_chat_patterns(turns: DataFrame) -> DataFrame:
    """(symptom, fix, n): resolved support patterns of ``turns(conv_id, turn, role, text)`` and how many conversations have each.

    A conversation is resolved if the assistant has the last word after the user's first, and
    doesn't ask in it. The symptom is what the user said first, the fix what the assistant said
    last; personal data and pleasantries go, case and signs of the symptom don't count.
    """
    said = lambda role: F.when(F.col("role") == role, F.col("turn"))
    x = turns.where("role in ('user', 'assistant') and text is not null").groupBy("conv_id").agg(
        F.min_by("text", said("user")).alias("symptom"), F.min(said("user")).alias("asked"), F.max_by("text", said("assistant")).alias("fix"), F.max(said("assistant")).alias("answered"), F.max("turn").alias("last")
    )
    x = x.where("asked < answered and answered = last and not rtrim(fix) like '%?'")
    symptom = F.trim(F.regexp_replace(F.lower(without_pleasantries(without_personal(F.col("symptom")))), r"[^\p{L}\p{N}]+", " "))
    x = x.select(symptom.alias("symptom"), without_pleasantries(without_personal(F.col("fix"))).alias("fix")).where("symptom <> '' and fix <> ''")
    return x.groupBy("symptom", "fix").agg(F.count("*").alias("n"))


def conversation_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): a conversation's turns in order, a line each."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))))
    return turns.groupBy("conv_id").agg(said.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda t: t["said"]), "\n").alias("transcript"))


#: What a user is shown when the model call fails, by class of error; the last for all others.
ALERT_TITLE = "Assistant unavailable"
ALERTS = {
    "auth": "API key error — please check your configuration.",
    "rate_limit": "The AI provider is rate-limiting requests. Please try again in a moment.",
    "": "The AI service is temporarily unavailable. Please try again.",
}


def error_to_alert(kind: Column) -> Column:
    """A chat response (JSON) for a class of error."""
    body = F.when(kind == "auth", ALERTS["auth"]).when(kind == "rate_limit", ALERTS["rate_limit"]).otherwise(ALERTS[""])
    data = F.struct(F.lit("danger").alias("severity"), F.lit(ALERT_TITLE).alias("title"), body.alias("body"))
    return F.to_json(F.struct(F.lit("alert").alias("type"), data.alias("data")))


def parse_retrieval(raw: DataFrame) -> DataFrame:
    """``raw`` with ``ids``: those of the array in a model's answer, none if it holds no array."""
    x = raw.withColumn("cleaned", _cleaned()(F.col("raw")))
    ids = F.when(F.col("cleaned").startswith("["), F.from_json("cleaned", "array<string>", _OPTIONS))
    return x.withColumn("ids", F.coalesce(ids, F.array().cast("array<string>"))).drop("cleaned")


RESPONSE = (
    "struct<type:string,data:struct<title:string,intro:string,body:string,severity:string,question:string,reason:string,summary:string,ctaLabel:string,followUp:string,"
    "steps:array<struct<title:string,body:string>>,options:array<struct<label:string,description:string>>,items:array<string>>>"
)


def _valid(r: Column) -> Column:
    """Whether a parsed response has what its type needs."""
    d = lambda n: r["data"][n].isNotNull()
    all_of = lambda c, test: F.coalesce(F.forall(c, test), F.lit(False))
    kind = r["type"]
    return F.coalesce(
        F.when(kind == "steps", d("title") & all_of(r["data"]["steps"], lambda s: s["title"].isNotNull() & s["body"].isNotNull()))
        .when(kind == "choices", d("question") & all_of(r["data"]["options"], lambda o: o["label"].isNotNull()))
        .when(kind == "alert", d("title") & d("body") & r["data"]["severity"].isin("info", "warning", "danger"))
        .when(kind == "checklist", d("title") & all_of(r["data"]["items"], lambda i: i.isNotNull()))
        .when(kind == "escalation", d("reason") & d("summary"))
        .when(kind == "summary", d("title") & d("body"))
        .when(kind == "text", d("body")),
        F.lit(False),
    )


def parse_chat_response(raw: DataFrame) -> DataFrame:
    """One row per response: position, type and the parsed struct; what isn't valid becomes text."""
    x = clean_outputs(raw).drop("ok")
    texts = F.when(F.col("cleaned").startswith("["), F.from_json("cleaned", "array<string>", _OPTIONS)).otherwise(F.array("cleaned"))
    x = x.withColumn("many", F.col("cleaned").startswith("[")).select(*raw.columns, "many", F.posexplode(F.coalesce(texts, F.array(F.lit(None).cast("string")))).alias("position", "one"))
    x = x.withColumn("parsed", F.from_json("one", RESPONSE, _OPTIONS)).withColumn("ok", _valid(F.col("parsed")))
    body = F.when(F.col("many") & F.col("one").isNotNull(), F.col("one")).otherwise(F.col("raw"))
    return x.select(
        *raw.columns, "position", F.when(F.col("ok"), F.col("parsed.type")).otherwise("text").alias("type"), F.when(F.col("ok"), F.col("parsed.data")).alias("data"), F.when(~F.col("ok"), body).alias("fallback")
    )


def response_components(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per step, option or item, numbered from 1; one row, number 0, for the other types."""
    part = lambda i, text: F.struct(i.cast("int").alias("n"), text.alias("text"))
    numbered = lambda c, text: F.transform(c, lambda s, i: part(i + 1, text(s)))
    data = F.col("data")
    single = F.coalesce(F.when(F.col("type") == "escalation", F.coalesce(data["ctaLabel"], F.lit("Create Support Ticket"))), data["body"], F.col("fallback"))
    rows = (
        F.when(F.col("type") == "steps", numbered(data["steps"], lambda s: s["title"]))
        .when(F.col("type") == "choices", numbered(data["options"], lambda s: s["label"]))
        .when(F.col("type") == "checklist", numbered(data["items"], lambda s: s))
        .otherwise(F.array(part(F.lit(0), single)))
    )
    return parsed.select(*keys, "position", "type", F.explode(rows).alias("p")).select(*keys, "position", "type", "p.n", "p.text")


#: Phrases that no answer may hold.
FORBIDDEN = [
    "Have you completed this step?",
    "Let me know when done",
    "Please confirm",
    "Once you've done this",
    "When you're ready",
    "Are you ready to...",
    "as shown",
    "refer to diagram",
    "refer to the documentation",
    "according to the manual",
    "the PDF states",
]


def forbidden_phrases(responses: DataFrame, phrases: list[str] = FORBIDDEN) -> DataFrame:
    """(the key columns, phrase) for each phrase that ``raw`` holds, in any case."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("raw"), F.lit(p.lower())), F.lit(p)) for p in phrases]))
    return responses.withColumn("phrase", F.explode(held))


def answer(contexts: DataFrame) -> DataFrame:
    """Deterministic answers for ``contexts(qid, context, constraints, conditions)``: no context, alert, choices, or steps."""
    lines = F.filter(F.split("context", r"\n+"), lambda s: s != "")
    steps = F.transform(lines, lambda s, k: F.struct(F.concat(F.lit("Step "), (k + 1).cast("string")).alias("title"), s.alias("body")))
    kind = (
        F.when(F.coalesce("context", F.lit("")) == "", "text").when(F.coalesce("constraints", F.lit("")) != "", "alert").when(F.coalesce("conditions", F.lit("")) != "", "choices").otherwise("steps")
    )
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.struct(F.lit("This is outside the knowledge base.").alias("body")).alias("data")))
    alert = F.to_json(F.struct(F.lit("alert").alias("type"), F.struct(F.lit("warning").alias("severity"), F.lit("Before you start").alias("title"), F.col("constraints").alias("body")).alias("data")))
    options = F.transform(F.split("conditions", r"\. "), lambda c: F.struct(c.alias("label")))
    choices = F.to_json(F.struct(F.lit("choices").alias("type"), F.struct(F.lit("Which applies?").alias("question"), options.alias("options")).alias("data")))
    plain = F.to_json(F.struct(F.lit("steps").alias("type"), F.struct(F.lit("Steps").alias("title"), steps.alias("steps")).alias("data")))
    raw = F.when(kind == "text", text).when(kind == "alert", alert).when(kind == "choices", choices).otherwise(plain)
    return contexts.select("qid", kind.alias("kind"), raw.alias("raw"))


def answer_by_model(asked: DataFrame, model: Model | None = None, load: Callable[[], Model] | None = None, batch: int = 16, tries: int = 2) -> DataFrame:
    """``asked(qid, question, block, ...)`` with ``raw`` and ``failure``: a model's answer to the context block and the question.

    A call that fails twice gives the alert that its error's class calls for, so every question has an answer; ``parse_chat_response`` reads both.
    """
    prompt = F.concat(F.coalesce("block", F.lit("")), F.lit("\n\nQUESTION: "), F.coalesce("question", F.lit("")))
    x = asked.withColumn("called", called(prompt, model, load, batch, tries))
    failure = F.col("called.failure")
    alert = error_to_alert(error_class(failure, F.lit(0)))
    return x.withColumns({"raw": F.when(failure.isNotNull(), alert).otherwise(F.coalesce("called.raw", F.lit(""))), "failure": failure}).drop("called")
