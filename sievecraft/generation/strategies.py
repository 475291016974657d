"""Strategies change a batch's messages by its index; each has its text in our own words."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from typing import Any, Protocol

logger = logging.getLogger(__name__)
Messages = list[dict[str, str]]


class Strategy(Protocol):
    def apply(self, messages: Messages, batch_index: int) -> Messages: ...


def _add(messages: Messages, text: str) -> Messages:
    """A copy with text below the last message."""
    return [*messages[:-1], {**messages[-1], "content": f"{messages[-1]['content']}\n\n{text}"}]


def _vary(batch_index: int) -> str:
    return f"Batch {batch_index + 1}: choose subjects, words and forms that no batch before has used."


class Direct:
    """The first batch as it is, later ones with a request to vary."""

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        return _add(messages, _vary(batch_index)) if batch_index else messages


@dataclass
class FewShot:
    """The first three examples as JSON lines; without examples, like Direct."""

    examples: list[Any] = field(default_factory=list)

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        if not self.examples:
            return Direct().apply(messages, batch_index)
        lines = [f"- {json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else x}" for x in self.examples[:3]]
        out = _add(messages, "\n".join(["Aim for the quality of these examples, with other content:", *lines]))
        return _add(out, _vary(batch_index)) if batch_index else out


PERSONAS = (
    "a nurse on the night shift", "a law student", "a farmer", "a retired teacher", "a mechanic", "a novelist", "a shop owner",
    "a physicist", "a teenager who plays games", "a travel guide",
)


@dataclass
class Persona:
    """One persona per batch, in turn."""

    personas: list[str] = field(default_factory=lambda: list(PERSONAS))

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        who = (self.personas or PERSONAS)[batch_index % len(self.personas or PERSONAS)]
        return _add(messages, f"Write as {who} would: their words, interests and point of view.")


DEPTHS = {
    "brief": "Note in a sentence what the next element should show, then write it.",
    "moderate": "Before each element, settle what makes it useful, what it must contain, and how it differs from the others. Then write it.",
    "detailed": "Before each element, work out what is asked, weigh several ideas, name their weak points, plan content and tone, and check the result against the request. Then write it.",
}


@dataclass
class ChainOfThought:
    reasoning_depth: str = "moderate"

    def __post_init__(self) -> None:
        if self.reasoning_depth not in DEPTHS:
            raise ValueError(f"reasoning_depth is {self.reasoning_depth!r}; it must be one of {', '.join(DEPTHS)}")

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        out = _add(messages, DEPTHS[self.reasoning_depth])
        return _add(out, _vary(batch_index)) if batch_index else out


MODES = (
    "wording that can be read in two ways", "negations and double negations", "irony", "rare words and technical terms",
    "spelling errors and slang", "very short or very long inputs", "several topics at once", "facts that seem to contradict each other",
)


@dataclass
class Adversarial:
    """One kind of hard case per batch, in turn."""

    modes: list[str] = field(default_factory=lambda: list(MODES))

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        mode = (self.modes or MODES)[batch_index % len(self.modes or MODES)]
        return _add(messages, f"Make the elements hard for a model by means of {mode}. They must still be correct.")


EVOLUTIONS = (
    "put further conditions on the request", "ask for more steps of reasoning", "bring in a second field of knowledge",
    "replace general terms by concrete ones from real life", "address readers of another level", "let later parts depend on earlier ones",
    "cover a special or extreme case",
)


@dataclass
class EvolInstruct:
    """evolution_rounds ways of making it harder, from the batch's place in the list on."""

    evolution_rounds: int = 1

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        ways = [EVOLUTIONS[(batch_index + r) % len(EVOLUTIONS)] for r in range(self.evolution_rounds)]
        return _add(messages, "\n".join(["Start from a plain element and make it harder:", *[f"- {w}" for w in ways]]))


class AutoOptimize:
    """Wraps a strategy: before the first batch the model criticises a sample of its own, and what it wants improved
    goes below the system message of all batches. It runs once, on the driver; if it fails, nothing is added."""

    def __init__(self, base: Strategy, provider: Any, parse: Any, calibration_size: int = 5):
        self.base, self.provider, self.parse, self.size = base, provider, parse, calibration_size
        self.refinement: str | None = None

    def calibrate(self, messages: Messages) -> str:
        try:
            rows = self.parse(self.provider.complete(messages, temperature=0.7).content)
            if not rows:
                return ""
            shown = "\n".join(f"- {json.dumps(r, ensure_ascii=False)}" for r in rows[: self.size])
            ask = f"Grade these from 1 to 5 and say what to improve.\n\n{shown}\n\nForm of the answer:\nRating: n/5\nImprovements:\n- ..."
            reply = self.provider.complete([{"role": "user", "content": ask}], temperature=0.3).content
        except (OSError, ValueError, RuntimeError) as e:
            logger.warning("calibration failed: %s", e)
            return ""
        for marker in ("Improvements:", "improvements:", "Improvement:"):
            if marker in reply:
                return "Heed these improvements:\n" + reply.split(marker, 1)[1].strip()[:500]
        return ""

    def apply(self, messages: Messages, batch_index: int) -> Messages:
        messages = self.base.apply(messages, batch_index)
        if self.refinement is None:
            self.refinement = self.calibrate(messages)
        if not self.refinement:
            return messages
        at = next((i for i, m in enumerate(messages) if m["role"] == "system"), None)
        if at is None:
            return messages
        return [{**m, "content": f"{m['content']}\n\n{self.refinement}"} if i == at else m for i, m in enumerate(messages)]


STRATEGIES: dict[str, type] = {
    "direct": Direct,
    "few_shot": FewShot,
    "persona": Persona,
    "cot": ChainOfThought,
    "adversarial": Adversarial,
    "evolinstruct": EvolInstruct,
}


def create_strategy(name: str, config: dict | None = None) -> Strategy:
    """config: keywords of the strategy. Those of the AutoOptimize wrapper, and examples where they don't apply, are left out."""
    if name not in STRATEGIES:
        raise ValueError(f"strategy is {name!r}; it must be one of {', '.join(STRATEGIES)}")
    own = {k: v for k, v in (config or {}).items() if k not in ("auto_optimize", "calibration_size")}
    if name != "few_shot":
        own.pop("examples", None)
    return STRATEGIES[name](**own)
