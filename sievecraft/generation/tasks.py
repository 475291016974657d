"""Eight kinds of samples: the prompt for a batch, and the parser of replies as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_response
from ..sources.samples import ENTITIES, MESSAGES

Messages = list[dict[str, str]]


def _list(value: Any) -> list[str]:
    return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value or [])


def _get(item: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{key}", kind)


@dataclass
class Task:
    """A task renders one system and one user message, and parses replies: response -> rows of samples."""

    domain: str = ""
    name: ClassVar[str] = ""
    goal: ClassVar[str] = ""
    shape: ClassVar[str] = ""
    required: ClassVar[tuple[str, ...]] = ("text",)
    #: Sample columns beyond text and label.
    metadata: ClassVar[dict[str, str]] = {}

    @classmethod
    def from_config(cls, config: dict) -> Task:
        own = config.get("task", config)
        return cls(**{f.name: (_list(own[f.name]) if f.default_factory is list else own[f.name]) for f in fields(cls) if f.name in own})

    def required_keys(self) -> set[str]:
        return set(self.required)

    def details(self) -> list[str]:
        """Lines of the prompt that depend on the configuration."""
        return []

    def build_messages(self, batch_size: int = 5) -> Messages:
        lines = [f"Write {batch_size} {self.goal}.", f"Subject area: {self.domain}" if self.domain else "", *self.details(), "Make them differ in subject, length and tone.", f"Answer with a JSON array only, each element like {self.shape}."]
        return [
            {"role": "system", "content": f"You write training data: {self.goal}. You answer with a JSON array and nothing else."},
            {"role": "user", "content": "\n".join(x for x in lines if x)},
        ]

    def keep(self, item: Column) -> Column:
        """Which parsed objects have what a sample needs."""
        raise NotImplementedError

    def columns(self, item: Column) -> dict[str, Column]:
        """text, label and metadata of an object."""
        raise NotImplementedError

    def parse(self, replies: DataFrame, reply: str = "response") -> DataFrame:
        """replies without reply, one row per sample: pos in the reply, text, label, metadata columns.

        A reply that isn't JSON, or no array, gives none; so do elements that aren't objects or lack keys. An element
        whose text or label isn't a string is dropped by itself.
        """
        keep = [F.col(f"`{c}`") for c in replies.columns if c != reply]
        items = F.try_variant_get(F.try_parse_json(clean_response(F.col(reply))), "$", "array<variant>")
        each = replies.select(*keep, F.posexplode(items).alias("pos", "_item"))
        each = each.filter(F.startswith(F.schema_of_variant("_item"), F.lit("OBJECT")))
        item = F.col("_item")
        made = {"text": F.lit(None).cast("string"), "label": F.lit(None).cast("string")} | self.columns(item)
        rows = each.filter(F.coalesce(self.keep(item), F.lit(False))).select(*keep, "pos", *[v.alias(k) for k, v in made.items()])
        return rows.filter(F.col("text").isNotNull())

    def valid(self, samples: DataFrame) -> DataFrame:
        """Rows in which every required key has a value that isn't empty."""
        kinds = dict(samples.dtypes)
        ok = F.lit(True)
        for k in self.required:
            ok &= (F.size(k) > 0) if kinds[k].startswith("array") else F.coalesce(F.col(k) != "", F.lit(False))
        return samples.filter(ok)


def _string(item: Column, key: str) -> Column:
    """The value if it is a JSON string, else null."""
    raw = F.try_variant_get(item, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(item, f"$.{key}", "string"))


@dataclass
class Classification(Task):
    labels: list[str] = field(default_factory=list)
    label_descriptions: dict[str, str] = field(default_factory=dict)
    name = "classification"
    goal = "short texts, each with the label that fits it"
    shape = '{"text": "...", "label": "..."}'
    required = ("text", "label")

    def details(self) -> list[str]:
        return [f"Labels, about equally often: {', '.join(self.labels)}", *[f"{k}: {v}" for k, v in self.label_descriptions.items()]]

    def keep(self, item: Column) -> Column:
        return _string(item, "text").isNotNull() & _string(item, "label").isin(self.labels)

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "text"), "label": _string(item, "label")}


def python_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]: negative ends count from the back, ends beyond the text are cut."""
    n = F.length(text)
    at = lambda i: F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))
    return F.substring(text, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0)))


def verified_entities(text: Column, entities: Column) -> Column:
    """Entities whose four values are there and whose span in text is their text."""
    return F.filter(entities, lambda e: e["label"].isNotNull() & F.coalesce(python_slice(text, e["start"], e["end"]) == e["text"], F.lit(False)))


@dataclass
class Ner(Task):
    entity_types: list[str] = field(default_factory=list)
    name = "ner"
    goal = "sentences with their named entities marked by character offsets"
    shape = '{"text": "...", "entities": [{"text": "...", "label": "...", "start": 0, "end": 1}]}'
    metadata = {"entities": ENTITIES}

    def details(self) -> list[str]:
        return [f"Kinds of entities: {', '.join(self.entity_types)}", "One to five entities in each; start and end count characters, end excluded."]

    def keep(self, item: Column) -> Column:
        return _string(item, "text").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        text = _string(item, "text")
        raw = F.coalesce(_get(item, "entities", "array<variant>"), F.array().cast("array<variant>"))
        spans = F.transform(raw, lambda v: F.struct(_get(v, "text").alias("text"), _get(v, "label").alias("label"), _get(v, "start", "int").alias("start"), _get(v, "end", "int").alias("end")))
        return {"text": text, "entities": verified_entities(text, spans)}


@dataclass
class Qa(Task):
    contexts: list[str] = field(default_factory=list)
    name = "qa"
    goal = "questions with correct answers"
    shape = '{"question": "...", "answer": "..."}'
    required = ("text", "label")
    metadata = {"context": "string"}

    def details(self) -> list[str]:
        shown = "\n---\n".join(self.contexts[:5])
        return [f"Ask about these passages and put the passage in context:\n{shown}" if shown else ""]

    def keep(self, item: Column) -> Column:
        return _string(item, "question").isNotNull() & _string(item, "answer").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "question"), "label": _string(item, "answer"), "context": _get(item, "context")}


@dataclass
class Preference(Task):
    criteria: str = ""
    name = "preference"
    goal = "prompts, each with a better and a worse answer"
    shape = '{"prompt": "...", "chosen": "...", "rejected": "..."}'
    required = ("text", "chosen", "rejected")
    metadata = {"chosen": "string", "rejected": "string"}

    def details(self) -> list[str]:
        return [f"Better means: {self.criteria}" if self.criteria else ""]

    def keep(self, item: Column) -> Column:
        return _string(item, "prompt").isNotNull() & _get(item, "chosen").isNotNull() & _get(item, "rejected").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "prompt"), "chosen": _get(item, "chosen"), "rejected": _get(item, "rejected")}


@dataclass
class Sft(Task):
    system_prompt: str = ""
    complexity: str = "mixed"
    response_style: str = "detailed"
    name = "sft"
    goal = "instructions with full answers"
    shape = '{"instruction": "...", "response": "..."}'
    required = ("text", "instruction", "response")
    metadata = {"instruction": "string", "response": "string", "system_prompt": "string"}
    answer: ClassVar[str] = "response"

    def details(self) -> list[str]:
        return [f"The answering model is told: {self.system_prompt}" if self.system_prompt else "", f"Difficulty: {self.complexity}", f"Answers: {self.response_style}"]

    def keep(self, item: Column) -> Column:
        return _string(item, "instruction").isNotNull() & _get(item, "response").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "instruction"), "instruction": _string(item, "instruction"), "response": _get(item, "response"), "system_prompt": F.lit(self.system_prompt)}


def alternates(messages: Column) -> Column:
    """Two messages or more, each with a role and content, user and assistant in turn from the user on."""
    right = F.transform(messages, lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & m["content"].isNotNull())
    return (F.size(messages) >= 2) & F.forall(right, lambda x: F.coalesce(x, F.lit(False)))


@dataclass
class Conversation(Task):
    min_turns: int = 2
    max_turns: int = 6
    system_prompt: str = ""
    name = "conversation"
    goal = "conversations between a user and an assistant"
    shape = '{"messages": [{"role": "user", "content": "..."}, {"role": "assistant", "content": "..."}]}'
    required = ("text", "messages")
    metadata = {"messages": MESSAGES, "system_prompt": "string"}

    def details(self) -> list[str]:
        return [f"The assistant is told: {self.system_prompt}" if self.system_prompt else "", f"{self.min_turns} to {self.max_turns} messages each; the user begins and roles take turns."]

    def _messages(self, item: Column) -> Column:
        raw = _get(item, "messages", "array<variant>")
        return F.transform(raw, lambda m: F.struct(_get(m, "role").alias("role"), _get(m, "content").alias("content")))

    def keep(self, item: Column) -> Column:
        return alternates(self._messages(item))

    def columns(self, item: Column) -> dict[str, Column]:
        m = self._messages(item)
        return {"text": F.get(m, F.lit(0))["content"], "messages": m, "system_prompt": F.lit(self.system_prompt)}


@dataclass
class Summarization(Task):
    min_doc_length: int = 200
    max_doc_length: int = 1000
    summary_style: str = "abstractive"
    name = "summarization"
    goal = "documents with summaries"
    shape = '{"document": "...", "summary": "..."}'
    required = ("text", "label")

    def details(self) -> list[str]:
        return [f"Words in a document: {self.min_doc_length} to {self.max_doc_length}", f"Summaries: {self.summary_style}"]

    def keep(self, item: Column) -> Column:
        return _string(item, "document").isNotNull() & _string(item, "summary").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "document"), "label": _string(item, "summary")}


@dataclass
class Distillation(Task):
    teacher_style: str = "detailed"
    complexity: str = "mixed"
    name = "distillation"
    goal = "instructions with a teacher's reasoning and answer"
    shape = '{"instruction": "...", "reasoning": "...", "teacher_response": "..."}'
    required = ("text", "instruction", "teacher_response", "reasoning")
    metadata = {"instruction": "string", "teacher_response": "string", "reasoning": "string"}

    def details(self) -> list[str]:
        return [f"The teacher's style: {self.teacher_style}", f"Difficulty: {self.complexity}"]

    def keep(self, item: Column) -> Column:
        return _string(item, "instruction").isNotNull() & _get(item, "teacher_response").isNotNull() & _get(item, "reasoning").isNotNull()

    def columns(self, item: Column) -> dict[str, Column]:
        return {"text": _string(item, "instruction"), "instruction": _string(item, "instruction"), "teacher_response": _get(item, "teacher_response"), "reasoning": _get(item, "reasoning")}


TASKS: dict[str, type[Task]] = {t.name: t for t in (Classification, Ner, Qa, Preference, Sft, Conversation, Summarization, Distillation)}


def create_task(config: dict) -> Task:
    name = config.get("type", "classification")
    if name not in TASKS:
        raise ValueError(f"task type is {name!r}; it must be one of {', '.join(TASKS)}")
    return TASKS[name].from_config(config)
