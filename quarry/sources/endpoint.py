"""A generator that asks a chat model behind an HTTP endpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

# What the model is told and asked.
SYSTEM_PROMPT = """Ты готовишь QA-датасет для корпоративного AI-ассистента.
Используй только факты из документа. Не выдумывай. Создай вопросы разных
типов: факты, обязанности, сроки, ограничения, процедуры и краткое содержание.
Верни только JSON-массив объектов с полями instruction, input, output.
В поле input дословно скопируй фрагмент документа, на котором основан ответ."""
REQUEST = "Создай {count} QA-примеров для документа.\n\nDOCUMENT:\n{text}"
TEMPERATURE = 0.2
BASE_URL = "http://localhost:8000/v1"
TIMEOUT = 300


def endpoint(model: str, base_url: str = BASE_URL, timeout: float = TIMEOUT) -> Callable[[str, int], str]:
    """A generator for ``qa.build_dataset``: (document text, number of questions) -> the model's reply.

    Tasks ask one document after another; a failed request is that document's failure.
    """
    url = f"{base_url.rstrip('/')}/chat/completions"

    def ask(text: str, count: int) -> str:
        messages = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": REQUEST.format(count=count, text=text)}]
        body = json.dumps({"model": model, "temperature": TEMPERATURE, "messages": messages}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return ask
