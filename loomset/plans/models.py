"""Stand-ins for a language model, so that the inference surface can be run without one."""

from __future__ import annotations

import json
import re


def make_echo(**settings):
    """Answers with the whole prompt."""

    def generate(prompts: list[str]) -> list[str]:
        return [f" Echo: {prompt} \n" for prompt in prompts]

    return generate


def make_short_tempered(**settings):
    """Fails on prompts with the word ``and`` in them."""

    def generate(prompts: list[str]) -> list[str]:
        for prompt in prompts:
            if " and " in prompt:
                raise ValueError("refused")
        return [f"{len(prompt)} characters" for prompt in prompts]

    return generate


def make_acme(**settings):
    """Talks about itself after repeating the prompt."""

    def generate(prompts: list[str]) -> list[str]:
        return [f"{prompt} I am Acme. Deep Acme." for prompt in prompts]

    return generate


def make_counter(offset: int = 0, **settings):
    """Reads the order number out of a math prompt and boxes a number made from it."""

    def answer(prompt: str) -> str:
        order = int(re.search(r"Order (\d+)", prompt).group(1))
        return f"The answer is \\boxed{{{order % 97 + (offset if order % 3 else 0)}}}."

    return lambda prompts: [answer(prompt) for prompt in prompts]


def make_trained_counter(**settings):
    return make_counter(offset=0)


def make_base_counter(**settings):
    return make_counter(offset=1)


def make_endpoint(max_tokens: int, temperature: float):
    """Replies as an inference endpoint does: a JSON list, or an error object."""

    def reply(prompt: str) -> str:
        if "ring" in prompt:
            return json.dumps({"error": "overloaded"})
        return json.dumps([{"generated_text": f" SELECT '{prompt}' LIMIT {max_tokens} "}])

    return lambda prompts: [reply(prompt) for prompt in prompts]


def share_of_digits(completions, ground_truth, **columns) -> list[float]:
    """A reward in plain Python: share of the completion's characters that are digits."""
    texts = [completion[0]["content"] for completion in completions]
    return [sum(c.isdigit() for c in text) / max(len(text), 1) for text in texts]
