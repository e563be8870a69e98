"""Model services, and stand-ins that need none."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from cuespark.functions.retry import ServiceError

FILTER_PROMPT = 'Does the picture show burned-in subtitle text? Answer with a JSON object only: {"has_text": true} or {"has_text": false}.'
ANALYZE_PROMPT = (
    "Read the burned-in subtitles of the picture. Answer with a JSON object only, with a list named subtitles. "
    "Each entry has text (the words as shown), style (regular or italic), color (white, yellow, cyan or other) and "
    "position (top or bottom). Leave out signs, logos and credits that are part of the scene. Without subtitles the list is empty."
)
RECONCILE_PROMPT = "The lines are readings of one subtitle, some with mistakes. Answer with the one correct text and nothing else."


def read_image(image: str | bytes) -> bytes:
    """The bytes of a picture: of a path, of a file: URI as listings give it, or of a URI of another file system."""
    if isinstance(image, bytes | bytearray | memoryview):
        return bytes(image)
    scheme = urllib.parse.urlsplit(image).scheme
    if len(scheme) < 2:
        path = image
    elif scheme == "file":
        path = urllib.request.url2pathname(urllib.parse.urlsplit(image).path)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(image)
        with system.open_input_stream(path) as stream:
            return stream.read()
    with open(path, "rb") as file:
        return file.read()


class VisionClient(Protocol):
    def analyze(self, image: str | bytes, prompt: str = "", system: str = "", json_mode: bool = False) -> str: ...


class TextClient(Protocol):
    def chat(self, prompt: str, system: str) -> str: ...


@dataclass(frozen=True)
class HttpClient:
    """An endpoint that speaks the chat-completions protocol. Made on the driver, it connects on executors only."""

    model: str
    host: str = "http://localhost:11434"
    timeout: float = 300.0
    key: str = "none"

    def _ask(self, messages: list[dict[str, Any]], json_mode: bool = False) -> str:
        body = {"model": self.model, "messages": messages} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        request = urllib.request.Request(
            f"{self.host}/v1/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                value = json.load(answer)
        except urllib.error.HTTPError as error:
            raise ServiceError(error.code, str(error)) from error
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            raise ServiceError(0, str(error)) from error
        content = value["choices"][0]["message"]["content"]
        if not content:
            raise RuntimeError(f"{self.model} has answered without text")
        return content

    def messages(self, image: bytes, prompt: str, system: str) -> list[dict[str, Any]]:
        """The system's message first, if any; of the user's parts the text, if any, before the picture."""
        url = "data:image/jpeg;base64," + base64.b64encode(image).decode()
        parts = [{"type": "text", "text": prompt}] * bool(prompt) + [{"type": "image_url", "image_url": {"url": url}}]
        return [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": parts}]

    def analyze(self, image: str | bytes, prompt: str = "", system: str = "", json_mode: bool = False) -> str:
        return self._ask(self.messages(read_image(image), prompt, system), json_mode)

    def chat(self, prompt: str, system: str) -> str:
        return self._ask([{"role": "system", "content": system}, {"role": "user", "content": prompt}])


@dataclass(frozen=True)
class ScriptedClient:
    """A deterministic stand-in: answers are functions of the image's path or of the prompt."""

    seen: Callable[[str], str] | None = None
    said: Callable[[str], str] | None = None

    def analyze(self, image: str, prompt: str = "", system: str = "", json_mode: bool = False) -> str:
        return self.seen(image)

    def chat(self, prompt: str, system: str) -> str:
        return self.said(prompt)
