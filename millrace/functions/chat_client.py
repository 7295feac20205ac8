"""Chat completions over HTTP: single prompts, or a conversation that a bounded memory keeps; blocking or awaited."""

from __future__ import annotations

import asyncio
import json
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

ROLES = ("system", "user", "assistant", "tool")


@dataclass
class Memory:
    """The messages of a conversation: the system's stay, of the others the latest ``max_messages``."""

    max_messages: int = 100
    messages: list[dict[str, str]] = field(default_factory=list)

    def add(self, role: str, content: str) -> Memory:
        if role not in ROLES:
            raise ValueError(f"role must be one of {', '.join(ROLES)}")
        self.messages.append({"role": role, "content": content})
        others = [i for i, m in enumerate(self.messages) if m["role"] != "system"]
        gone = set(others[: max(0, len(others) - self.max_messages)])
        self.messages = [m for i, m in enumerate(self.messages) if i not in gone]
        return self


def as_json(answer: str) -> str | None:
    """The JSON value in an answer, fenced or within prose, or None."""
    for candidate in (answer, *re.findall(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL), *re.findall(r"(\{.*\}|\[.*\])", answer, re.DOTALL)):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


class ChatClient:
    """Any class with ``complete(prompt) -> str`` can stand in for it where only single prompts are asked."""

    def __init__(
        self, model_name: str, api_key: str, base_url: str | None = None, temperature: float = 0.2, max_tokens: int | None = None, frequency_penalty: float | None = None, max_retries: int = 3, wait: Callable[[int], float] | None = None
    ):
        self.url = (base_url or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
        self.key, self.max_retries, self.wait = api_key, max_retries, wait or (lambda attempt: min(10, 4 * 2**attempt))
        self.body = {"model": model_name, "temperature": temperature, "max_tokens": max_tokens, "frequency_penalty": frequency_penalty}

    def _post(self, messages: list[dict[str, str]]) -> str:
        body = {k: v for k, v in self.body.items() if v is not None} | {"messages": messages}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=120) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    def _answer(self, messages: list[dict[str, str]]) -> str:
        return retried(lambda: self._post(messages), self.max_retries, self.wait)

    def complete(self, prompt: str) -> str:
        return self._answer([{"role": "user", "content": prompt}])

    def chat(self, memory: Memory, return_format: str = "text") -> Any:
        """The answer to a conversation, which is added to it; with ``json`` the value found in it, or the answer itself."""
        answer = self._answer(memory.messages)
        memory.add("assistant", answer)
        found = as_json(answer) if return_format == "json" else None
        return answer if found is None else json.loads(found)

    async def acomplete(self, prompt: str) -> str:
        return await asyncio.to_thread(self.complete, prompt)

    async def achat(self, memory: Memory, return_format: str = "text") -> Any:
        return await asyncio.to_thread(self.chat, memory, return_format)


def retried(call: Callable[[], Any], max_retries: int, wait: Callable[[int], float]) -> Any:
    """What ``call`` gives; tried again after network errors."""
    for attempt in range(max_retries + 1):
        try:
            return call()
        except OSError:
            if attempt == max_retries:
                raise
            time.sleep(wait(attempt))
    raise AssertionError
